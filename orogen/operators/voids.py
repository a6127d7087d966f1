"""Void handling: rules that find voids, counts, and two ways to fill them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SENTINEL = -9999.0


def void_rule(v: Column, rule: str, nodata: float = SENTINEL) -> Column:
    """Heights with voids as null.  full: NaN or below -1000; window: also exactly 0; bil: the nodata value only."""
    low = F.isnan(v) | (v < -1000)
    if rule == "full":
        return F.when(~low, v)
    if rule == "window":
        return F.when(~(low | (v == 0)), v)
    if rule == "bil":
        return F.nullif(v, F.lit(nodata))
    raise ValueError(f"rule {rule}")


def void_count(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count_if(F.col("h").isNull()).alias("voids"), F.count("*").alias("cells"))


def elevation_range(cells: DataFrame) -> DataFrame:
    valid = cells.filter(F.col("h").isNotNull() & ~F.isnan("h"))
    return valid.agg(F.min("h").alias("lowest"), F.max("h").alias("highest"), F.count("*").alias("valid"))


#: Lines of the raster in a strip, whose columns are swept together.
STRIP = 1024


def fill_sweep(cells: DataFrame) -> DataFrame:
    """Voids become the mean of the nearest valid heights up, down, left and right; void if there is none.

    Running values over lines of the raster, in both directions; the original voids stay voids to each other.
    Columns are swept in strips, which start with the last valid height of the strips before them, so that
    a column is not one unit of work.
    """
    cells = cells.withColumn("strip", F.floor(F.col("r") / STRIP))
    edges = cells.filter(F.col("h").isNotNull()).groupBy("strip", "c").agg(F.min_by("h", "r").alias("first"), F.max_by("h", "r").alias("last"))
    strips = cells.groupBy("strip", "c").agg(F.count("*").alias("n")).drop("n").join(edges, ["strip", "c"], "left")
    before, after = Window.partitionBy("c").orderBy("strip"), Window.partitionBy("c").orderBy(F.desc("strip"))
    back = (Window.unboundedPreceding, -1)
    strips = strips.select("strip", "c", F.last("last", True).over(before.rowsBetween(*back)).alias("above"), F.last("first", True).over(after.rowsBetween(*back)).alias("below"))
    # a frame that runs back costs a step a row; one that runs on would be gone through again for every row
    last = lambda key, *order: F.last("h", True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(*back))
    found = cells.withColumns({"up": last(("strip", "c"), "r"), "down": last(("strip", "c"), F.desc("r"))}).withColumns({"left": last(("r",), "c"), "right": last(("r",), F.desc("c"))})
    found = found.join(strips, ["strip", "c"], "left").withColumns({"up": F.coalesce("up", "above"), "down": F.coalesce("down", "below")})
    near = ("up", "down", "left", "right")
    total = sum((F.coalesce(F.col(k), F.lit(0.0)) for k in near), F.lit(0.0))
    n = sum((F.col(k).isNotNull().cast("int") for k in near), F.lit(0))
    return found.select("r", "c", F.coalesce("h", F.try_divide(total, n.cast("double"))).alias("h"))


def fill_sequential(cells: DataFrame, raster_id: str = "raster_id") -> DataFrame:
    """Voids in row-major order, each from the nearest heights up, down, left and right at that time.

    Later cells see filled ones, so a raster is one unit of work by definition; rasters run in parallel.
    """

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = part["r"].min(), part["c"].min()
        grid = np.full((part["r"].max() - r0 + 1, part["c"].max() - c0 + 1), np.nan)
        r, c = part["r"].to_numpy() - r0, part["c"].to_numpy() - c0
        grid[r, c] = part["h"].to_numpy(float)
        here = np.zeros(grid.shape, bool)
        here[r, c] = True
        for i, j in np.argwhere(here & np.isnan(grid)):
            lines = (grid[:i, j][::-1], grid[i + 1 :, j], grid[i, :j][::-1], grid[i, j + 1 :])
            near = [x[k] for x in lines if len(k := np.flatnonzero(~np.isnan(x))[:1])]
            if near:
                grid[i, j] = float(np.mean(near))
        return part.assign(h=grid[r, c])

    return cells.groupBy(raster_id).applyInPandas(fill, cells.select(raster_id, "r", "c", "h").schema)
