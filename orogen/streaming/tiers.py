"""Windows of a terrain that follow a viewer: a gated position becomes a window with its layers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.operators import grid, shadow, surface
from orogen.sources import files
from orogen.streaming.drift import reload_batches

PENUMBRA = 200.0


def layers(cells: DataFrame, rows: int, columns: int, scale: float, sun: tuple[float, float], occlusion: bool) -> DataFrame:
    """Normals, shadow and, if asked for, occlusion of a window: r, c, h, nx, ny, nz, lit (1 with the sun down), ao."""
    azimuth, elevation = sun
    out = surface.normals(cells, scale, scale)
    if elevation > 0:
        out = out.join(shadow.azimuth_shadow(cells, rows, columns, azimuth, elevation, scale, scale, PENUMBRA), ["r", "c"])
    else:
        out = out.withColumn("lit", F.lit(1.0))
    return out.join(shadow.ambient_occlusion(cells, rows, columns, scale, scale), ["r", "c"]) if occlusion else out.withColumn("ao", F.lit(1.0))


def window(cells: DataFrame, meta: dict, e: float, n: float, radius: float, sun: tuple[float, float], occlusion: bool = True, most: int = 8192) -> tuple[DataFrame, dict]:
    """The window of a raster about a position, with its layers, and its metadata (origin, size, requested centre).

    The centre is the one asked for, also where the window is cut off by the raster's border or by ``most`` cells a side.
    """
    r, c, m, k = files.window_around(meta, e, n, radius)
    at_r, at_c = int((meta["y0"] - n) / meta["scale"]), int((e - meta["x0"]) / meta["scale"])
    if m > most:
        r, m = r + grid.cap_start(at_r - r, m, most), most
    if k > most:
        c, k = c + grid.cap_start(at_c - c, k, most), most
    found = files.rebased(meta, (r, c, m, k)) | {"centre_e": e, "centre_n": n}
    return layers(grid.crop(cells, r, c, m, k), m, k, meta["scale"], sun, occlusion), found


def fine_window(spark: SparkSession, folder: str, e: float, n: float, radius: float, side: float = 50_000.0) -> tuple[DataFrame, dict] | None:
    """Heights about a position from the 50 km tiles of a folder, stitched, and their metadata; None where no tile is near.

    The tiles are those whose square overlaps the one asked for: at most (2 * radius / side + 2) squared.
    """
    near = files.tile_files(spark, folder).filter((F.col("n") < n + radius) & (F.col("n") + side > n - radius) & (F.col("e") < e + radius) & (F.col("e") + side > e - radius)).orderBy("path").collect()
    if not near:
        return None
    metas = [files.tiff_metadata(spark, x["path"]).filter("ifd = 0").first().asDict() for x in near]
    scale = metas[0]["scale"]
    x0, y0 = math.floor((e - radius) / scale) * scale, math.ceil((n + radius) / scale) * scale
    size = math.ceil(2 * radius / scale) + 1
    placed = []
    for tile, meta in zip(near, metas, strict=True):
        try:
            part = files.window_around(meta, e, n, radius)
        except ValueError:  # the file holds less than its square
            continue
        own = files.rebased(meta, part)
        cells = files.read_geotiff(spark, tile["path"], window=part).select((F.col("r") - part[0]).alias("r"), (F.col("c") - part[1]).alias("c"), "h")
        placed.append((cells, round((y0 - own["y0"]) / scale), round((own["x0"] - x0) / scale)))
    if not placed:
        return None
    return grid.stitch(placed, size, size), {"rows": size, "columns": size, "scale": scale, "x0": x0, "y0": y0, "centre_e": e, "centre_n": n}


def follow(requests: DataFrame, load: Callable[[float, float], tuple[DataFrame, dict] | None], path: str, checkpoint: str, key: str = "user_id", report: Callable[[str], None] = lambda what: None):
    """Stores the window of the newest gated position of each viewer in every micro-batch, as path/key=.../batch=...

    ``load`` makes the window of a position (x, y); a failed or empty load leaves the last window in place and is
    reported.  Positions that newer ones of the same batch overtake are dropped, as a busy worker drops them.
    """

    def work(newest: DataFrame, number: int) -> None:
        for row in newest.toLocalIterator():  # one row a viewer
            try:
                found = load(row["x"], row["y"])
            except ValueError as why:
                report(f"{row[key]}: {why}")
                continue
            if found is not None:
                cells, meta = found
                kept = cells.withColumns({k: F.lit(v) for k, v in meta.items() if k not in cells.columns and not isinstance(v, str)})
                kept.write.mode("overwrite").parquet(f"{path}/key={row[key]}/batch={number}")
                report(f"{row[key]}: window about {row['x']:.0f}, {row['y']:.0f}")

    return reload_batches(requests, work, checkpoint, key)
