"""Windows of rasters: crop, cap, stitch, assembly of tiles, splat, bounds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crop(cells: DataFrame, row: int, column: int, rows: int, columns: int) -> DataFrame:
    """The rectangle with its own row and column numbers; the filter reaches the scan."""
    inside = F.col("r").between(row, row + rows - 1) & F.col("c").between(column, column + columns - 1)
    return cells.filter(inside).withColumns({"r": F.col("r") - row, "c": F.col("c") - column})


def cap_start(centre: int, size: int, most: int) -> int:
    """First row (or column) of a window of at most ``most`` cells around a cell, kept inside the raster."""
    out = min(most, size)
    return min(max(0, min(max(centre, 0), size - 1) - out // 2), size - out)


def stitch(windows: list[tuple[DataFrame, int, int]], rows: int, columns: int) -> DataFrame:
    """Windows placed at (row, column) offsets on one grid; where they overlap the later valid one wins."""
    placed = [w.select((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), "h", F.lit(k).alias("order")) for k, (w, dr, dc) in enumerate(windows)]
    valid = reduce(DataFrame.unionByName, placed).filter(F.col("h").isNotNull() & ~F.isnan("h") & F.col("r").between(0, rows - 1) & F.col("c").between(0, columns - 1))
    return valid.groupBy("r", "c").agg(F.max_by("h", "order").alias("h"))


def assemble(tiles: DataFrame, rows: int, columns: int, missing: float = 0.0) -> DataFrame:
    """A 3 x 3 neighbourhood of tiles(tr, tc, r, c, h) as one raster; cells of missing tiles get ``missing``.

    The north-west tile must be there.
    """
    spark = tiles.sparkSession
    if tiles.filter("tr = 0 AND tc = 0").isEmpty():
        raise ValueError("the north-west tile is missing")
    lines = spark.range(9 * rows).select(F.floor(F.col("id") / (3 * rows)).alias("tr"), F.floor(F.col("id") / rows % 3).alias("tc"), (F.col("id") % rows).alias("r"))
    grid = lines.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).alias("c"))
    joined = grid.join(tiles, ["tr", "tc", "r", "c"], "left")
    return joined.select((F.col("tr") * rows + F.col("r")).alias("r"), (F.col("tc") * columns + F.col("c")).alias("c"), F.coalesce("h", F.lit(missing)).alias("h"))


def load_neighbourhood(loader: Callable[[int, int], DataFrame | None], latitude: int, longitude: int, rows: int, columns: int) -> DataFrame:
    """The 3 x 3 tiles about a tile as one raster; ``loader`` gives the cells (r, c, h) of a tile, or None for a missing one.

    The first row is the northern one.
    """
    found = []
    for tr in range(3):
        for tc in range(3):
            cells = loader(latitude + 1 - tr, longitude - 1 + tc)
            if cells is not None:
                found.append(cells.select(F.lit(tr).cast("long").alias("tr"), F.lit(tc).cast("long").alias("tc"), "r", "c", "h"))
    if not found:
        raise ValueError("no tile is there")
    return assemble(reduce(DataFrame.unionByName, found), rows, columns)


def splat(cells: DataFrame, part: DataFrame, row: int, column: int, name: str, outside: float = 1.0) -> DataFrame:
    """A layer of a cropped window back in the whole raster, ``outside`` elsewhere."""
    back = part.select((F.col("r") + row).alias("r"), (F.col("c") + column).alias("c"), F.col(name))
    return cells.join(back, ["r", "c"], "left").withColumn(name, F.coalesce(name, F.lit(outside)))


def local_metres(e: Column, n: Column, origin_e: float, origin_n: float, width: float, height: float) -> tuple[Column, Column]:
    """Tile-local metres of a point, null outside the tile (both ends included)."""
    x, y = e - origin_e, F.lit(origin_n) - n
    inside = x.between(0, width) & y.between(0, height)
    return F.when(inside, x), F.when(inside, y)
