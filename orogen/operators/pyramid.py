"""Multi-resolution operators: box averages, maximum pyramids, choice of a level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def downsample(cells: DataFrame, factors: list[int]) -> DataFrame:
    """Box averages for all factors from one scan: factor, r, c, h (null where a box holds voids only)."""
    spread = cells.withColumn("factor", F.explode(F.array(*(F.lit(f).cast("long") for f in factors))))
    boxes = spread.groupBy("factor", F.floor(F.col("r") / F.col("factor")).alias("r"), F.floor(F.col("c") / F.col("factor")).alias("c"))
    return boxes.agg(F.avg("h").alias("h"))


def max_pyramid(cells: DataFrame, rows: int, columns: int, levels: int = 7, mode: str = "floor") -> DataFrame:
    """Levels 1 .. of 2 x 2 maxima: level, r, c, h.

    ``floor`` halves sizes downwards (a last odd row or column is dropped), ``ceil`` keeps it, so that
    every level bounds the raster from above.
    """
    sizes, m, n = [], rows, columns
    for k in range(1, levels + 1):
        m, n = (max(1, m // 2), max(1, n // 2)) if mode == "floor" else (-(-m // 2), -(-n // 2))
        sizes.append((k, m, n))
    level = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("level"), F.lit(m).cast("long").alias("m"), F.lit(n).cast("long").alias("n")) for k, m, n in sizes)))
    spread = cells.select("r", "c", "h", level.alias("s")).select("s.*", F.floor(F.col("r") / F.pow(F.lit(2), F.col("s.level"))).alias("r"), F.floor(F.col("c") / F.pow(F.lit(2), F.col("s.level"))).alias("c"), "h")
    return spread.filter((F.col("r") < F.col("m")) & (F.col("c") < F.col("n"))).groupBy("level", "r", "c").agg(F.max("h").alias("h"))


def select_level(levels: DataFrame, min_scale: float, radius: float, most: int) -> DataFrame:
    """Per file the finest level that is coarse and small enough, else the coarsest: path, ifd."""
    fits = (F.col("scale") >= min_scale) & (F.floor(F.lit(2.0 * radius) / F.col("scale")) <= most)
    return levels.groupBy("path").agg(F.coalesce(F.min(F.when(fits, F.col("ifd"))), F.max("ifd")).alias("ifd"))


def factor(target: float, scale: float) -> int:
    """Downsampling factor of an overview: max(2, round(target / scale))."""
    return max(2, int(target / scale + 0.5))
