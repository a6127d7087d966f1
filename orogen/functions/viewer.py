"""Scalar functions around a viewer: gates, codecs, labels, positions, presets, references."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Projections by EPSG code.
PROJECTIONS = {
    4326: "+proj=longlat +datum=WGS84 +no_defs",
    3035: "+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80 +towgs84=0,0,0,0,0,0,0 +units=m +no_defs",
    31287: "+proj=lcc +lat_0=47.5 +lon_0=13.3333333333333 +lat_1=49 +lat_2=46 +x_0=400000 +y_0=400000 +ellps=bessel +towgs84=577.326,90.129,463.919,5.137,1.474,5.297,2.4232 +units=m +no_defs",
}
#: Radii of smooth normals, in metres, and steps by quality: divisor of the base step, distances, factors.
SMOOTH = (0.0, 500.0, 1000.0, 2000.0, 5000.0)
STEP_DIVISORS, STEP_DISTANCES, LEVEL_DISTANCES, SPHERES = (20.0, 10.0, 5.0, 3.0), (1e9, 20000.0, 8000.0, 4000.0), (1e9, 30000.0, 15000.0, 8000.0), (0.1, 0.2, 0.4, 0.8)


def is_geographic(proj4: Column) -> Column:
    return F.contains(proj4, F.lit("longlat")) | F.contains(proj4, F.lit("latlong"))


def projection(epsg: Column, wkt_proj4: Column | None = None) -> Column:
    """The projection of a file: that of its text, else of its code; codes that are not known raise an error."""
    known = F.element_at(F.create_map(*(F.lit(x) for pair in PROJECTIONS.items() for x in pair)), epsg.cast("int"))
    found = known if wkt_proj4 is None else F.coalesce(wkt_proj4, known)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no projection for EPSG:"), F.coalesce(epsg.cast("string"), F.lit("none")))))


def start_position(e: Column, n: Column, west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """A position if it is in the bounds, else their centre."""
    inside = e.between(west, east) & n.between(south, north)
    return F.when(inside, e).otherwise((west + east) * 0.5), F.when(inside, n).otherwise((south + north) * 0.5)


def camera_height(centre: Column) -> Column:
    """2000 m over the cell in the middle, over 1000 m if that is void."""
    return F.coalesce(F.when(centre > -1000, centre), F.lit(1000.0)) + 2000.0


def drift_threshold(rows: Column, columns: Column, dx: Column, dy: Column, most: float) -> Column:
    """A threshold that a window of this size allows: a quarter of its shorter side at most."""
    return F.least(F.lit(most), F.least(columns * dx, rows * dy) * 0.5 * 0.5)


def overview_factors(scale: Column, levels: Column, close: float = 8.0, base: float = 32.0) -> Column:
    """Factors of an overview cache of a file of one level below 20 m; null for others, which need none."""
    factor = lambda to: F.greatest(F.floor(F.lit(to) / scale + 0.5), F.lit(2).cast("long"))
    return F.when((levels == 1) & (scale < 20), F.when(scale < 5, F.array(factor(close), factor(base))).otherwise(F.array(factor(base))))


def level_label(scale: Column, factors: Column) -> Column:
    """Metres of cached levels, joined: ``8m+32m``."""
    return F.array_join(F.transform(factors, lambda f: F.concat(F.bround(scale * f, 0).cast("long").cast("string"), F.lit("m"))), "+")


def clock_angle(x: Column, y: Column, centre_x: float, centre_y: float) -> Column:
    """Clockwise angle from the top (y grows down), from 0 below a full turn; half a turn at the centre."""
    a = F.atan2(x - centre_x, -(y - centre_y))
    # at the centre -(0) is a negative zero, which IEEE's atan2 tells from zero and Spark's does not
    return F.when((x == centre_x) & (y == centre_y), math.pi).when(a < 0, a + math.tau).otherwise(a)


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
    return F.hypot(x - ax - dx * t, y - ay - dy * t)


def tick_distance(x: Column, y: Column, radius: float, angle: Column, inner: float = 0.72) -> Column:
    """Distance from a tick on a dial about the origin."""
    to_x, to_y = F.sin(angle), -F.cos(angle)
    return segment_distance(x, y, to_x * (radius * inner), to_y * (radius * inner), to_x * radius, to_y * radius)


def aligned(width: Column, to: int = 64) -> Column:
    """The next multiple of a power of two."""
    return (width + (to - 1)).bitwiseAND(F.lit(~(to - 1)).cast("long"))


def next_smooth(radius: Column) -> Column:
    """The preset after the first one that is not below the radius, in a circle."""
    at = F.lit(0)
    for k in range(len(SMOOTH) - 1, -1, -1):
        at = F.when(F.lit(SMOOTH[k]) >= radius, k).otherwise(at)
    return F.element_at(F.array(*map(F.lit, SMOOTH)), F.pmod(at + 1, F.lit(len(SMOOTH))) + 1)


def by_quality(quality: Column, values: tuple[float, ...]) -> Column:
    """The value of a quality from 0 (best) to 3."""
    return F.element_at(F.array(*map(F.lit, values)), quality.cast("int") + 1)


def packed_normal(nx: Column, ny: Column) -> Column:
    """Two signed 16-bit parts of a normal in 32 bits."""
    part = lambda x: F.floor(F.abs(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))) * 32767.0 + 0.5) * F.when(x < 0, -1).otherwise(1)
    low = lambda x: part(x).cast("long").bitwiseAND(F.lit(65535).cast("long"))
    return F.shiftleft(low(nx), 16).bitwiseOR(low(ny))


def unpacked_normal(packed: Column) -> tuple[Column, Column, Column]:
    signed = lambda x: F.when(x >= 32768, x - 65536).otherwise(x) / 32767.0
    nx, ny = signed(F.shiftright(packed, 16).bitwiseAND(F.lit(65535).cast("long"))), signed(packed.bitwiseAND(F.lit(65535).cast("long")))
    return nx, ny, F.sqrt(F.greatest(F.lit(0.0), 1.0 - nx * nx - ny * ny))


def byte_level(x: Column) -> Column:
    """0 .. 1 as a byte, cut and clamped; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x * 255.0)))).cast("int")


def grayscale(cells: DataFrame) -> DataFrame:
    """Heights between the lowest and the highest as bytes: r, c, gray (null for voids; 0 on level ground)."""
    ends = cells.agg(F.min("h").alias("low"), F.max("h").alias("high"))
    share = F.when(F.col("high") > F.col("low"), (F.col("h") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.col("h") * 0.0)
    return cells.join(F.broadcast(ends)).select("r", "c", byte_level(share).alias("gray"))


def overall_progress(complete: Column, done: Column, total: Column, file: Column, files: Column) -> Column:
    """Share of a download: bytes, or files looked at while no bytes are known."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.when(complete, 1.0).when(total > 0, clamp(done / total)).when(files > 0, clamp((file + 1) / files)).otherwise(0.0)


def place_label(latitude: Column, longitude: Column, elevation: Column) -> Column:
    """Latitude, longitude and whole metres, which go away if unknown."""
    parts = F.array_compact(F.array(F.format_string("LAT %.2f°N", F.abs(latitude)), F.format_string("LON %.2f°E", F.abs(longitude)), F.when(elevation.isNotNull(), F.format_string("ELEV %d M", elevation.cast("long")))))
    return F.array_join(parts, " ")


def bandwidth(ticks: Column, frequency: float, bytes_: Column) -> Column:
    """GB a second."""
    return bytes_ / (ticks / frequency) / 1e9


def to_geographic(x: Column, y: Column, dx: Column, dy: Column, step_x: Column, step_y: Column, west: Column, north: Column) -> tuple[Column, Column]:
    """Latitude and longitude of metres on a tile of degrees."""
    return north - y / dy * F.abs(step_y), x / dx * step_x + west


def shuffled(rows: DataFrame, order: str, seed: int = 12345) -> DataFrame:
    """Rows with a place in a fixed random order: the sort key is a hash, so no row waits for another."""
    return rows.withColumn("draw", F.xxhash64(F.col(order), F.lit(seed))).orderBy("draw", order)


def preferred(rows: DataFrame, kind: str, best: str, order: str) -> DataFrame:
    """The first row of the best kind, else the first row."""
    return rows.groupBy().agg(F.min_by(F.struct(*rows.columns), F.struct((F.col(kind) != best), F.col(order))).alias("x")).select("x.*")
