"""Cast shadows and ambient occlusion."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def west_shadow(cells: DataFrame, dx: float, elevation: float) -> DataFrame:
    """1 where the sun in the west reaches a cell, 0 where a cell before it in its row is in the way."""
    raised = cells.withColumn("raised", F.col("h") + F.col("c") * (dx * math.tan(elevation)))
    before = Window.partitionBy("r").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("raised").over(before)
    return raised.select("r", "c", F.when(F.col("raised") < top, 0.0).otherwise(1.0).alias("lit"))


def snapped(x: float) -> float:
    """A step next to a whole number is that number, so that rays along axes and diagonals meet every cell."""
    return float(round(x)) if abs(x - round(x)) < 1e-6 else x


def ray_steps(azimuth: float, dx: float, dy: float) -> tuple[float, float, float]:
    """Steps in row and column of rays away from the sun, the larger one 1, and metres per step."""
    dc, dr = -math.sin(azimuth), math.cos(azimuth)
    if abs(dc) >= abs(dr):
        dc, dr = math.copysign(1.0, dc), dr / abs(dc)
    else:
        dc, dr = dc / abs(dr), math.copysign(1.0, dr)
    dc, dr = snapped(dc), snapped(dr)
    return dr, dc, math.hypot(dc * dx, dr * dy)


def ray_starts(rows: int, columns: int, dr: float, dc: float) -> list[tuple[int, int]]:
    """Cells where rays enter: one edge of the raster, or two for slanted light."""
    out = []
    if dc:
        out += [(r, 0 if dc > 0 else columns - 1) for r in range(rows)]
    if dr:
        out += [(0 if dr > 0 else rows - 1, c) for c in range(columns)]
    return out


#: Cells of a tile, and cells along rays that are held at a time.
TILE, HELD = 1 << 18, 1 << 20


def _tiling(rows: int, columns: int) -> tuple[int, int]:
    """Rows and columns of a tile."""
    wide = max(1, min(columns, 512))
    return TILE // wide, wide


def _packed(cells: DataFrame, high: int, wide: int) -> DataFrame:
    """Cells as bytes by tile: tr, tc and rows, columns, heights and flags (1: height, 2: row, 4: column is there)."""

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            r, c, h = (batch.column(n) for n in ("r", "c", "h"))
            flags = sum((x.is_valid().to_numpy(zero_copy_only=False) * np.uint8(1 << k) for k, x in enumerate((h, r, c))), np.zeros(batch.num_rows, np.uint8))
            r, c, h = r.fill_null(-1).to_numpy(zero_copy_only=False), c.fill_null(-1).to_numpy(zero_copy_only=False), h.fill_null(0.0).to_numpy(zero_copy_only=False)
            tr, tc = r // high, c // wide
            order = np.lexsort((tc, tr))
            first = np.flatnonzero(np.r_[True, (np.diff(tr[order]) != 0) | (np.diff(tc[order]) != 0)])
            parts = [order[i:j] for i, j in zip(first, [*first[1:], len(order)], strict=True)]
            at = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(tr[at]), pa.array(tc[at]), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (r, c, h, flags))], ["tr", "tc", "r", "c", "h", "flags"])

    plain = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("h").cast("double").alias("h"))
    return plain.mapInArrow(pack, "tr long, tc long, r binary, c binary, h binary, flags binary")


class _Sun:
    """Rays of one azimuth over a raster of rows x columns cells, with the steps of ray_steps().

    Rays are numbered: first those of ray_starts() that enter by the side, then those by the end.
    """

    def __init__(self, rows: int, columns: int, azimuth: float, dx: float, dy: float, rise: float):
        self.rows, self.columns, self.rise = rows, columns, rise
        self.dr, self.dc, self.metres = ray_steps(azimuth, dx, dy)
        self.edge = rows if self.dc else 0
        self.r0, self.c0 = (0 if self.dr > 0 else rows - 1), (0 if self.dc > 0 else columns - 1)

    @staticmethod
    def _span(start, step: float, low: int, high: int):
        """Steps (real numbers, one more on both sides) on which start + k * step may be in [low, high)."""
        if not step:
            inside = (start >= low) & (start < high)
            return np.where(inside, 0.0, np.inf), np.where(inside, np.inf, -np.inf)
        a, b = (low - start) / step, (high - start) / step
        return np.floor(np.minimum(a, b)) - 1, np.ceil(np.maximum(a, b)) + 1

    def paths(self, ra: int, ca: int, high: int, wide: int) -> Iterator[tuple]:
        """Rays that may meet a tile, in ascending order and bounded pieces: ray, k, r, c (a row for each ray), inside."""
        for side in (True, False):
            if not (self.dc if side else self.dr):
                continue
            # starts run along one axis; the other coordinate of all starts is the same
            count, step, fixed, across = (self.rows, self.dr, self.c0, self.dc) if side else (self.columns, self.dc, self.r0, self.dr)
            low, size, low2, size2 = (ra, high, ca, wide) if side else (ca, wide, ra, high)
            k_low, k_high = self._span(np.float64(fixed), across, low2, low2 + size2)
            k_low = max(k_low, 0.0)
            if k_high < k_low:
                continue
            moved = (k_low * step, k_high * step)
            begin, end = max(0, math.floor(low - 1 - max(moved))), min(count, math.ceil(low + size + 1 - min(moved)) + 1)
            most = int(min(k_high - k_low, (size / abs(step) + 4) if step else np.inf)) + 2
            piece = max(1, HELD // most)
            for i in range(begin, end, piece):
                starts = np.arange(i, min(end, i + piece))
                a, b = self._span(starts.astype(float), step, low, low + size)
                a, b = np.maximum(a, k_low), np.minimum(b, k_high)
                some = b >= a
                if not some.any():
                    continue
                starts, a, b = starts[some], a[some].astype(np.int64), b[some].astype(np.int64)
                k = a[:, None] + np.arange(int((b - a).max()) + 1)
                moving = np.floor(starts[:, None].astype(float) + k * step).astype(np.int64)
                other = np.floor(float(fixed) + k * across).astype(np.int64)
                r, c = (moving, other) if side else (other, moving)
                inside = (r >= max(ra, 0)) & (r < min(ra + high, self.rows)) & (c >= max(ca, 0)) & (c < min(ca + wide, self.columns))
                some = inside.any(axis=1)
                yield starts[some] + (0 if side else self.edge), k[some], r[some], c[some], inside[some]

    def raised(self, heights: np.ndarray, valid: np.ndarray, ra: int, ca: int):
        """paths() of a tile with places in it and heights raised by the sun's slope (-inf: no height)."""
        high, wide = heights.shape
        for ray, k, r, c, inside in self.paths(ra, ca, high, wide):
            place = np.where(inside, (r - ra) * wide + (c - ca), 0)
            ok = inside & valid.ravel()[place]
            yield ray, k, r, c, inside, place, ok, np.where(ok, heights.ravel()[place] + (k * self.metres) * self.rise, -np.inf)

    def crossing(self, heights: np.ndarray, valid: np.ndarray, ra: int, ca: int):
        """Rays that enter the tile from another one or leave it for one: ray, first step in the tile, highest raised height."""
        for ray, k, r, c, inside, _, _, raised in self.raised(heights, valid, ra, ca):
            line = np.arange(len(ray))
            first, last = inside.argmax(axis=1), inside.shape[1] - 1 - inside[:, ::-1].argmax(axis=1)
            start_r, start_c = r[line, last], c[line, last]
            side = ray < self.edge
            after = k[line, last] + 1
            next_r = np.floor(np.where(side, ray, self.r0).astype(float) + after * self.dr)
            next_c = np.floor(np.where(side, self.c0, ray - self.edge).astype(float) + after * self.dc)
            leaves = (next_r >= 0) & (next_r < self.rows) & (next_c >= 0) & (next_c < self.columns) & ((next_r != start_r) | (next_c != start_c))
            some = leaves | (k[line, first] > 0)
            yield ray[some], k[line, first][some], raised.max(axis=1)[some]

    def lit(self, heights: np.ndarray, valid: np.ndarray, ra: int, ca: int, rays: np.ndarray, tops: np.ndarray, penumbra: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of cells in shadow and their light; ``tops`` are the highest raised heights of ``rays`` before this tile."""
        out, found = np.ones(heights.size), np.zeros(heights.size, bool)
        for ray, _, _, _, _, place, ok, raised in self.raised(heights, valid, ra, ca):
            before = np.full(len(ray), -np.inf)
            if len(rays):
                at = np.minimum(np.searchsorted(rays, ray), len(rays) - 1)
                before = np.where(rays[at] == ray, tops[at], -np.inf)
            top = np.maximum.accumulate(np.column_stack([before, raised[:, :-1]]), axis=1)
            # NaN is above all numbers, as in SQL
            dark = ok & ((raised < top) | (np.isnan(top) & ~np.isnan(raised)))
            place = place[dark]
            out[place] = np.maximum(0.0, 1.0 - (top[dark] - raised[dark]) / penumbra)  # the last, the highest ray, stays
            found[place] = True
        places = np.flatnonzero(found)
        return places, out[places]


def _rounded9(x: np.ndarray) -> np.ndarray:
    """x in billionths, halves of its decimal form up."""
    scaled = x * 1e9
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP) * 10**9)
    return out


def _lit(cells: DataFrame, rows: int, columns: int, azimuths: list[float], elevation: float, dx: float, dy: float, penumbra: float, name: str, mean: bool) -> DataFrame:
    """Light of one azimuth, or the mean of all: r, c, name.

    The raster is cut into tiles.  A first pass takes, of every ray that goes from tile to tile, the highest raised
    height in each; their running maximum is what a second pass starts the ray with.  So no table has a row for each
    cell and azimuth, and a line as long as the raster is not one unit of work.
    """
    high, wide = _tiling(rows, columns)
    rise = math.tan(elevation)
    packed = _packed(cells, high, wide)

    def grids(group: pa.Table):
        """The group's cells, and its tile as heights and a mask."""
        r, c, h, flags = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in group[n]]) for n, t in (("r", "<i8"), ("c", "<i8"), ("h", "<f8"), ("flags", "u1")))
        ra, ca = group["tr"][0].as_py() * high, group["tc"][0].as_py() * wide
        use = np.flatnonzero((flags == 7) & (r >= 0) & (r < rows) & (c >= 0) & (c < columns))
        use = use[np.argsort(h[use], kind="stable")]  # of repeated cells the highest
        heights, valid = np.zeros((high, wide)), np.zeros((high, wide), bool)
        heights[r[use] - ra, c[use] - ca] = h[use]
        valid[r[use] - ra, c[use] - ca] = True
        return r, c, flags, ra, ca, heights, valid

    def suns():
        return [_Sun(rows, columns, a, dx, dy, rise) for a in azimuths]

    def first(group: pa.Table) -> pa.Table:
        *_, ra, ca, heights, valid = grids(group)
        turn, ray, k, top = [], [], [], []
        for t, sun in enumerate(suns()):
            for a, b, x in sun.crossing(heights, valid, ra, ca):
                turn.append(np.full(len(a), t, np.int32)), ray.append(a), k.append(b), top.append(x)
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        n = sum(map(len, ray))
        tr, tc = (pa.array(np.full(n, group[x][0].as_py(), np.int64)) for x in ("tr", "tc"))
        return pa.table([tr, tc, pa.array(join(turn, np.int32)), pa.array(join(ray, np.int64)), pa.array(join(k, np.int64)), pa.array(join(top, float))], ["tr", "tc", "turn", "ray", "k", "top"])

    def second(group: pa.Table, more: pa.Table | None = None) -> pa.Table:
        if not group.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["r", "c", name])
        r, c, flags, ra, ca, heights, valid = grids(group)
        turn, ray, top = (more[x].to_numpy() for x in ("turn", "ray", "top")) if more is not None else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((ray, turn))
        turn, ray, top = turn[order], ray[order], top[order]
        total = np.full(heights.size, 10**9 * len(azimuths) if mean else 1.0, float)
        for t, sun in enumerate(suns()):
            i, j = np.searchsorted(turn, t, "left"), np.searchsorted(turn, t, "right")
            places, light = sun.lit(heights, valid, ra, ca, ray[i:j], top[i:j], penumbra)
            if mean:  # sums of whole billionths, which no order of adding changes
                total[places] += _rounded9(light) - 10**9
            else:
                total[places] = light
        if mean:
            total = total / 1e9 / len(azimuths)
        inside = (flags & 6 == 6) & (r >= 0) & (r < rows) & (c >= 0) & (c < columns)
        out = np.ones(len(r))
        out[inside] = total.reshape(high, wide)[r[inside] - ra, c[inside] - ca]
        return pa.table([pa.array(r, mask=flags & 2 == 0), pa.array(c, mask=flags & 4 == 0), pa.array(out)], ["r", "c", name])

    schema = f"r long, c long, {name} double"
    tiles = packed.groupBy("tr", "tc")
    if rows <= high and columns <= wide:
        return tiles.applyInArrow(lambda group: second(group), schema)
    passed = tiles.applyInArrow(first, "tr long, tc long, turn int, ray long, k long, top double")
    before = Window.partitionBy("turn", "ray").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    tops = passed.withColumn("top", F.max("top").over(before)).filter(F.col("top") > float("-inf")).select("tr", "tc", "turn", "ray", "top")
    return tiles.cogroup(tops.groupBy("tr", "tc")).applyInArrow(lambda group, more: second(group, more), schema)


def azimuth_shadow(cells: DataFrame, rows: int, columns: int, azimuth: float, elevation: float, dx: float, dy: float, penumbra: float) -> DataFrame:
    """Soft shadows for any azimuth: r, c, lit in [0, 1].

    Along each ray heights are raised by the sun's slope; a cell below an earlier one is in shadow,
    which fades over ``penumbra`` metres.  Where rays share a cell the highest shadowed ray decides;
    cells that no ray meets are lit.
    """
    return _lit(cells, rows, columns, [azimuth], elevation, dx, dy, penumbra, "lit", False)


def ambient_occlusion(cells: DataFrame, rows: int, columns: int, dx: float, dy: float, azimuths: int = 16, elevation: float = math.radians(10), penumbra: float = 200.0) -> DataFrame:
    """Mean of soft shadows over evenly spread azimuths: r, c, ao."""
    return _lit(cells, rows, columns, [k * math.tau / azimuths for k in range(azimuths)], elevation, dx, dy, penumbra, "ao", True)
