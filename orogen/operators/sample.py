"""Sampling between cells: bilinear, bicubic, blends of tiers, screen-space occlusion."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.operators.surface import smoothstep


def gather(points: DataFrame, cells: DataFrame, rows: int, columns: int, row: Column, column: Column, corners: list[tuple[int, int, Column]], name: str = "value") -> DataFrame:
    """Weighted sums of cells around points: one equi-join of exploded corners, clamped at the border.

    points need the key ``id``; corners are (row offset, column offset, weight).
    """
    clamp = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), x)).cast("long")
    spread = points.select("id", F.explode(F.array(*(F.struct(clamp(row + i, rows).alias("r"), clamp(column + j, columns).alias("c"), w.alias("w")) for i, j, w in corners))).alias("x")).select("id", "x.*")
    return spread.join(cells.select("r", "c", "h"), ["r", "c"]).groupBy("id").agg(F.sum(F.round(F.col("w") * F.col("h"), 9).cast("decimal(24,9)")).cast("double").alias(name))


def bilinear(points: DataFrame, cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """Heights at points(id, x, y) in units of cells: id, value."""
    r, c = F.floor("y"), F.floor("x")
    fy, fx = F.col("y") - r, F.col("x") - c
    corners = [(0, 0, (1 - fy) * (1 - fx)), (0, 1, (1 - fy) * fx), (1, 0, fy * (1 - fx)), (1, 1, fy * fx)]
    return gather(points, cells, rows, columns, r, c, corners)


def catmull_rom(t: Column) -> list[Column]:
    """Weights of the four cells around a position."""
    return [0.5 * w for w in (-t * t * t + 2.0 * t * t - t, 3.0 * t * t * t - 5.0 * t * t + 2.0, -3.0 * t * t * t + 4.0 * t * t + t, t * t * t - t * t)]


#: Columns of a piece of a raster line.
PIECE = 64


def line_pieces(cells: DataFrame) -> DataFrame:
    """Raster lines in pieces of PIECE columns with one more before and two after: r, piece, heights by column."""
    at = F.floor(F.col("c") / PIECE)
    inside = F.col("c") - at * PIECE
    pieces = F.array_compact(F.array(at, F.when(inside < 2, at - 1), F.when(inside == PIECE - 1, at + 1)))
    spread = cells.select("r", "c", "h", F.explode(pieces).alias("piece"))
    return spread.groupBy("r", "piece").agg(F.map_from_entries(F.collect_list(F.struct("c", "h"))).alias("line"))


def bicubic(points: DataFrame, cells: DataFrame, rows: int, columns: int, dx: float | None = None, dy: float | None = None) -> DataFrame:
    """Catmull-Rom heights at points(id, x, y) in units of cells: id, value; with metres of a cell also slopes sx, sy.

    Each point meets a piece of four lines, clamped at the border; void and missing cells add nothing, and points
    without any cell are left out.
    """
    r, c = F.floor("y"), F.floor("x")
    fy, fx = F.col("y") - r, F.col("x") - c
    clamp = lambda x, n: F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), x))
    piece = F.floor(clamp(c, columns) / PIECE)
    places = [clamp(c + j - 1, columns).alias(f"c{j}") for j in range(4)]
    wx, wy, vx, vy = catmull_rom(fx), catmull_rom(fy), catmull_rom_slope(fx), catmull_rom_slope(fy)
    weights = [*(w.alias(f"w{j}") for j, w in enumerate(wx)), *(w.alias(f"v{j}") for j, w in enumerate(vx))]
    lines = F.explode(F.array(*(F.struct(clamp(r + i - 1, rows).alias("r"), wy[i].alias("wy"), vy[i].alias("vy")) for i in range(4)))).alias("l")
    asked = points.select("id", piece.alias("piece"), *places, *weights, lines).select("*", "l.*").drop("l")
    seen = asked.join(line_pieces(cells), ["r", "piece"])
    exact = lambda across, along: sum((F.coalesce(F.round(F.col(along) * F.col(f"{across}{j}") * F.element_at("line", F.col(f"c{j}")), 9), F.lit(0.0)).cast("decimal(24,9)") for j in range(4)), F.lit(0).cast("decimal(24,9)"))
    total = lambda across, along: F.sum(exact(across, along).cast("decimal(28,9)")).cast("double")
    some = sum(F.when(F.element_at("line", F.col(f"c{j}")).isNotNull(), 1).otherwise(0) for j in range(4))
    out = [total("w", "wy").alias("value")]
    if dx is not None:
        out += [(total("v", "wy") / dx).alias("sx"), (total("w", "vy") / dy).alias("sy")]
    return seen.groupBy("id").agg(*out, F.sum(some).alias("some")).filter("some > 0").drop("some")


def catmull_rom_slope(t: Column) -> list[Column]:
    """Derivatives of the weights of the four cells."""
    return [0.5 * w for w in (-3.0 * t * t + 4.0 * t - 1.0, 9.0 * t * t - 10.0 * t, -9.0 * t * t + 8.0 * t + 1.0, 3.0 * t * t - 2.0 * t)]


def smooth_normals(points: DataFrame, cells: DataFrame, rows: int, columns: int, dx: float, dy: float) -> DataFrame:
    """Normals of the bicubic surface at points(id, x, y): id, nx, ny, nz."""
    found = bicubic(points, cells, rows, columns, dx, dy)
    size = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + 1.0)
    return found.select("id", (-F.col("sx") / size).alias("nx"), (-F.col("sy") / size).alias("ny"), (1.0 / size).alias("nz"))


def tier_blend(base: DataFrame, fine: DataFrame, extent_x: float, extent_y: float, dx: float, dy: float, margin: float = 500.0) -> DataFrame:
    """A fine tier (r, c, h on the base grid) over the base, faded in over ``margin`` metres from its edges."""
    x, y = F.col("c") * dx, F.col("r") * dy
    edge = F.least(x, F.lit(extent_x) - x, y, F.lit(extent_y) - y)
    inside = (x >= 0) & (x < extent_x) & (y >= 0) & (y < extent_y)
    t = F.when(inside & F.col("f").isNotNull(), smoothstep(0.0, margin, edge)).otherwise(0.0)
    joined = base.join(fine.withColumnRenamed("h", "f"), ["r", "c"], "left")
    return joined.select("r", "c", (F.col("h") + (F.coalesce("f", "h") - F.col("h")) * t).alias("h"))


#: Directions of horizon probes, half of them for the small setting.
DIRECTIONS = ((1.0, 0.0), (0.707, 0.707), (0.0, 1.0), (-0.707, 0.707), (-1.0, 0.0), (-0.707, -0.707), (0.0, -1.0), (0.707, -0.707))


def horizon_occlusion(cells: DataFrame, rows: int, columns: int, dx: float, dy: float, directions: int = 4, reach: float = 600.0, step: float = 25.0) -> DataFrame:
    """Openness by horizon angles: r, c, ao = mean of 1 - sin(max(0, horizon)) over directions.

    Probes read the cell they lie in (nearest below), clamped at the border.
    """
    probes = [(d, k, int(math.floor(DIRECTIONS[d][1] * k * step / dy)), int(math.floor(DIRECTIONS[d][0] * k * step / dx)), k * step) for d in range(directions) for k in range(1, int(reach / step) + 1)]
    least: dict[tuple[int, int, int], float] = {}
    for d, _, i, j, far in probes:  # of probes in one cell the nearest sees the steepest rise, the farthest the flattest fall
        least.setdefault((d, i, j), far)
    table = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.lit(far).alias("far")) for (d, i, j), far in least.items())))
    clamp = lambda x, n: F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), x))
    asked = cells.select("r", "c", "h", table.alias("p")).select("r", "c", "h", "p.d", "p.far", clamp(F.col("r") + F.col("p.i"), rows).alias("pr"), clamp(F.col("c") + F.col("p.j"), columns).alias("pc"))
    seen = asked.join(cells.select(F.col("r").alias("pr"), F.col("c").alias("pc"), F.col("h").alias("ph")), ["pr", "pc"])
    steep = seen.groupBy("r", "c", "d").agg(F.max((F.col("ph") - F.col("h")) / F.col("far")).alias("slope"))
    slope = F.greatest(F.lit(0.0), F.col("slope"))
    open_ = F.round(1.0 - slope / F.sqrt(1.0 + slope * slope), 9)  # sin(atan(slope))
    return steep.groupBy("r", "c").agg((F.sum(open_.cast("decimal(18,9)")).cast("double") / directions).alias("ao"))


def hemisphere_occlusion(cells: DataFrame, kernel: list[tuple[int, int, float]], rows: int, columns: int) -> DataFrame:
    """Openness by samples around a cell: mean of smoothstep(-50, 50, height of the sample over the ground).

    kernel: row offset, column offset and metres above the cell.
    """
    table = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.lit(z).alias("z")) for i, j, z in kernel)))
    clamp = lambda x, n: F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), x))
    asked = cells.select("r", "c", "h", table.alias("p")).select("r", "c", (F.col("h") + F.col("p.z")).alias("z"), clamp(F.col("r") + F.col("p.i"), rows).alias("pr"), clamp(F.col("c") + F.col("p.j"), columns).alias("pc"))
    seen = asked.join(cells.select(F.col("r").alias("pr"), F.col("c").alias("pc"), F.col("h").alias("ph")), ["pr", "pc"])
    value = F.round(smoothstep(-50.0, 50.0, F.col("z") - F.col("ph")), 9)
    return seen.groupBy("r", "c").agg((F.sum(value.cast("decimal(18,9)")).cast("double") / len(kernel)).alias("ao"))


def hemisphere_kernel(samples: int, dx: float, dy: float, reach: float = 600.0) -> list[tuple[int, int, float]]:
    """Samples on rings of 30, 60 degrees (four azimuths each, the second turned by 45), for level ground."""
    out = []
    for ring in range(samples // 4):
        el = math.radians((30, 60, 30, 60)[ring % 4])
        for k in range(4):
            az = math.radians(90 * k + (45 if ring % 2 else 0) + (22.5 if ring > 1 else 0))
            x, y, z = math.cos(el) * math.cos(az), math.cos(el) * math.sin(az), math.sin(el)
            out.append((math.floor(y * reach / dy + 0.5), math.floor(x * reach / dx + 0.5), round(z * reach, 6)))
    return out


#: Directions of hemisphere samples (x, y, z): rings of 30, 60, 45 and 15 degrees; the small setting takes two.
HEMISPHERE = (
    (0.866, 0.0, 0.5), (0.0, 0.866, 0.5), (-0.866, 0.0, 0.5), (0.0, -0.866, 0.5),
    (0.354, 0.354, 0.866), (-0.354, 0.354, 0.866), (-0.354, -0.354, 0.866), (0.354, -0.354, 0.866),
    (0.653, 0.271, 0.707), (-0.271, 0.653, 0.707), (-0.653, -0.271, 0.707), (0.271, -0.653, 0.707),
    (0.683, 0.683, 0.259), (-0.683, 0.683, 0.259), (-0.683, -0.683, 0.259), (0.683, -0.683, 0.259),
)
#: Rows and columns of a block of cells.
TILE = 128


def view_occlusion(cells: DataFrame, rows: int, columns: int, dx: float, dy: float, samples: int, horizon: bool = False, reach: float = 600.0, step: float = 25.0) -> DataFrame:
    """Openness of all cells from bilinear heights around them: r, c, ao.

    cells: r, c, h and, unless ``horizon``, the unit normal nx, ny, nz.  Samples on a hemisphere about the normal count
    smoothstep(-50, 50, height over the ground); a horizon search takes 1 - sin(max(0, horizon)) of its directions.
    Heights beyond the border are those on it; a cell of zero normal looks up; void cells and those that see a void have
    a null.  Cells go to the blocks within reach (each about 1.9 times at 30 m), so a task holds one block and its margin.
    """
    names = ["h"] if horizon else ["h", "nx", "ny", "nz"]
    far_r, far_c = (int(math.ceil(reach / x)) + 2 for x in (dy, dx))
    around = lambda x, far: F.sequence(F.floor((F.col(x) - far) / TILE), F.floor((F.col(x) + far) / TILE))
    last_r, last_c = (rows - 1) // TILE, (columns - 1) // TILE
    spread = cells.select("r", "c", *names, F.explode(around("r", far_r)).alias("br")).filter(F.col("br").between(0, last_r))
    spread = spread.select("*", F.explode(around("c", far_c)).alias("bc")).filter(F.col("bc").between(0, last_c))

    def look(group: pa.Table) -> pa.Table:
        br, bc = group["br"][0].as_py(), group["bc"][0].as_py()
        r, c = (group[x].to_numpy() for x in ("r", "c"))
        top, left = max(0, br * TILE - far_r), max(0, bc * TILE - far_c)
        bottom, right = min(rows, (br + 1) * TILE + far_r), min(columns, (bc + 1) * TILE + far_c)
        h = np.full((bottom - top, right - left), np.nan)
        h[r - top, c - left] = group["h"].to_numpy(zero_copy_only=False)
        own = np.flatnonzero((r // TILE == br) & (c // TILE == bc))
        r, c = r[own], c[own]
        z = h[r - top, c - left]

        def height(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            y, x = np.clip(y, 0, rows - 1) - top, np.clip(x, 0, columns - 1) - left
            i, j = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
            fy, fx = y - i, x - j
            i1, j1 = np.minimum(i + 1, h.shape[0] - 1), np.minimum(j + 1, h.shape[1] - 1)
            upper = h[i, j] * (1 - fx) + np.where(fx > 0, h[i, j1] * fx, 0)
            return upper * (1 - fy) + np.where(fy > 0, (h[i1, j] * (1 - fx) + np.where(fx > 0, h[i1, j1] * fx, 0)) * fy, 0)

        total = np.zeros(len(r))
        if horizon:
            for x, y in DIRECTIONS[:samples]:
                slope = np.zeros(len(r))
                for k in range(1, int(reach / step) + 1):
                    far = k * step
                    slope = np.maximum(slope, (height(r + y * far / dy, c + x * far / dx) - z) / far)
                total += 1 - slope / np.sqrt(1 + slope * slope)  # sin(atan(slope))
        else:
            n = np.stack([group[x].to_numpy(zero_copy_only=False)[own] for x in names[1:]], axis=1).astype(float)
            n[(n == 0).all(axis=1)] = 0, 0, 1
            up = np.where(np.abs(n[:, 1:2]) < 0.9, np.array([[0.0, 1.0, 0.0]]), np.array([[1.0, 0.0, 0.0]]))
            t = np.cross(n, up)
            t /= np.sqrt((t * t).sum(axis=1))[:, None]
            b = np.cross(n, t)
            for x, y, up_ in HEMISPHERE[:samples]:
                to = t * x + b * y + n * up_
                over = z + to[:, 2] * reach - height(r + to[:, 1] * reach / dy, c + to[:, 0] * reach / dx)
                s = np.clip((over + 50) / 100, 0, 1)
                total += s * s * (3 - 2 * s)
        return pa.table([pa.array(r), pa.array(c), pa.array(total / samples, from_pandas=True)], ["r", "c", "ao"])

    return spread.groupBy("br", "bc").applyInArrow(look, "r long, c long, ao double")
