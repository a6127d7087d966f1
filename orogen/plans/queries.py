"""Queries of the raster operators over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.functions import geo
from orogen.operators import grid, pyramid, render, sample, shadow, surface, voids
from orogen.plans import tiles as plans
from orogen.sources import tables as T
from orogen.streaming import drift

QUERIES: dict = {}
SQL: dict[str, str] = {}
DX = 30.0
AZIMUTH, ELEVATION, PENUMBRA = math.radians(242.0), math.radians(10.0), 200.0
SUN = geo.sun_direction(math.radians(242.0), math.radians(35.0))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def size(cells: DataFrame) -> tuple[int, int]:
    row = cells.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    return (row["r"] if row["r"] is not None else -1) + 1, (row["c"] if row["c"] is not None else -1) + 1


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


@query(f"WITH {T.V2}, s AS (SELECT r, c, coalesce(h, {d(-9999.0)}) AS v, CASE WHEN c % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE coalesce(h, {d(-9999.0)}) END AS z FROM v2) SELECT r, c, CASE WHEN isnan(v) OR v < -1000 THEN NULL ELSE v END AS h_full, CASE WHEN isnan(z) OR z < -1000 OR z = 0 THEN NULL ELSE z END AS h_window, nullif(v, {d(-9999.0)}) AS h_bil FROM s")
def void_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = T.raster_with_voids(spark, sf_dir).withColumn("v", F.coalesce("h", F.lit(voids.SENTINEL)))
    raw = raw.withColumn("z", F.when(F.col("c") % 7 == 0, 0.0).otherwise(F.col("v")))
    return raw.select("r", "c", voids.void_rule(F.col("v"), "full").alias("h_full"), voids.void_rule(F.col("z"), "window").alias("h_window"), voids.void_rule(F.col("v"), "bil").alias("h_bil"))


@query(f"WITH {T.V2} SELECT count(*) FILTER (WHERE h IS NULL) AS voids, count(*) AS cells FROM v2")
def void_count(spark, sf_dir):
    return voids.void_count(T.raster_with_voids(spark, sf_dir))


@query(f"WITH {T.V2} SELECT min(h) AS lowest, max(h) AS highest, count(*) AS valid FROM v2 WHERE h IS NOT NULL")
def elevation_range(spark, sf_dir):
    return voids.elevation_range(T.raster_with_voids(spark, sf_dir))


NORMALS = "near AS (SELECT r, c, h, (lag(h) OVER l - lead(h) OVER l) / CAST(60 AS DOUBLE) AS a, (lag(h) OVER k - lead(h) OVER k) / CAST(60 AS DOUBLE) AS b FROM v1 WINDOW l AS (PARTITION BY r ORDER BY c), k AS (PARTITION BY c ORDER BY r)), norm AS (SELECT r, c, h, coalesce(a / sqrt(a * a + b * b + 1), 0) AS nx, coalesce(b / sqrt(a * a + b * b + 1), 0) AS ny, coalesce(1 / sqrt(a * a + b * b + 1), 0) AS nz FROM near)"


@query(f"WITH {T.V1}, {NORMALS} SELECT r, c, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz FROM norm")
def normals(spark, sf_dir):
    return rounded(surface.normals(T.raster(spark, sf_dir), DX, DX).drop("h"), "nx", "ny", "nz")


LIGHT = f"({d(0.15)} + {d(1.0 - 0.15)} * greatest(CAST(0 AS DOUBLE), nx * {d(SUN[0])} + ny * {d(SUN[1])} + nz * {d(SUN[2])}))"


@query(f"WITH {T.V1}, {NORMALS} SELECT r, c, round({LIGHT}, 6) + 0.0 AS light FROM norm")
def hillshade(spark, sf_dir):
    n = surface.normals(T.raster(spark, sf_dir), DX, DX)
    return rounded(n.select("r", "c", surface.brightness(F.col("nx"), F.col("ny"), F.col("nz"), SUN).alias("light")), "light")


WEST = DX * math.tan(math.radians(35.0))


@query(f"WITH {T.V1}, raised AS (SELECT r, c, h + c * {d(WEST)} AS x FROM v1) SELECT r, c, CASE WHEN x < max(x) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS lit FROM raised")
def shadow_west(spark, sf_dir):
    return shadow.west_shadow(T.raster(spark, sf_dir), DX, math.radians(35.0))


def rays_sql(azimuth: float, cells: str, elevation: float = ELEVATION) -> str:
    dr, dc, metres = shadow.ray_steps(azimuth, DX, DX)
    edges = []
    if dc:
        edges.append(f"SELECT r AS ray, CAST(r AS DOUBLE) AS sr, CAST({'0' if dc > 0 else '(SELECT max(c) FROM ' + cells + ')'} AS DOUBLE) AS sc FROM (SELECT DISTINCT r FROM {cells})")
    if dr:
        before = f"(SELECT max(r) + 1 FROM {cells})" if dc else "0"
        edges.append(f"SELECT {before} + c AS ray, CAST({'0' if dr > 0 else '(SELECT max(r) FROM ' + cells + ')'} AS DOUBLE) AS sr, CAST(c AS DOUBLE) AS sc FROM (SELECT DISTINCT c FROM {cells})")
    return (
        f"SELECT r, c, arg_max(greatest(CAST(0 AS DOUBLE), 1 - (top - raised) / {d(PENUMBRA)}), ray) AS lit FROM (SELECT p.r, p.c, ray, h + dist * {d(math.tan(elevation))} AS raised, max(h + dist * {d(math.tan(elevation))}) OVER (PARTITION BY ray ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top "
        f"FROM (SELECT ray, k, CAST(floor(sr + k * {d(dr)}) AS BIGINT) AS r, CAST(floor(sc + k * {d(dc)}) AS BIGINT) AS c, k * {d(metres)} AS dist FROM ({' UNION ALL '.join(edges)}), (SELECT unnest(range(0, (SELECT greatest(max(r), max(c)) + 2 FROM {cells}))) AS k)) p JOIN {cells} v ON p.r = v.r AND p.c = v.c) WHERE raised < top GROUP BY r, c"
    )


@query(f"WITH {T.V1}, dark AS ({rays_sql(AZIMUTH, 'v1')}) SELECT r, c, round(coalesce(lit, 1), 6) + 0.0 AS lit FROM v1 LEFT JOIN dark USING (r, c)")
def shadow_azimuth(spark, sf_dir):
    cells = T.raster(spark, sf_dir)
    return rounded(shadow.azimuth_shadow(cells, *size(cells), AZIMUTH, ELEVATION, DX, DX, PENUMBRA), "lit")


_AO = " UNION ALL ".join(f"SELECT r, c, round(coalesce(lit, 1), 9) AS lit FROM crop LEFT JOIN ({rays_sql(k * math.tau / 16, 'crop', math.radians(10))}) USING (r, c)" for k in range(16))


@query(f"WITH {T.V1}, crop AS (SELECT r - 100 AS r, c, h FROM v1 WHERE r BETWEEN 100 AND 163), layers AS ({_AO}), ao AS (SELECT r, c, CAST(sum(CAST(lit AS DECIMAL(18,9))) AS DOUBLE) / 16 AS ao FROM layers GROUP BY r, c) SELECT v1.r, v1.c, round(coalesce(ao, 1), 6) + 0.0 AS ao FROM v1 LEFT JOIN ao ON v1.r = ao.r + 100 AND v1.c = ao.c")
def ao_true_hemi(spark, sf_dir):
    """Occlusion of a window of the raster, the rest open, as its SQL has it; ao_whole takes all cells."""
    cells = T.raster(spark, sf_dir)
    part = grid.crop(cells, 100, 0, 64, 64)
    ao = shadow.ambient_occlusion(part, 64, 64, DX, DX)
    return rounded(grid.splat(cells, ao, 100, 0, "ao").select("r", "c", "ao"), "ao")


@query()
def ao_whole(spark, sf_dir):
    """Occlusion of all cells of the raster."""
    cells = T.raster(spark, sf_dir)
    return rounded(shadow.ambient_occlusion(cells, *size(cells), DX, DX), "ao")


@query(f"WITH {T.V2} SELECT f AS factor, r // f AS r, c // f AS c, round(avg(h), 6) + 0.0 AS h FROM v2, (SELECT CAST(unnest([2, 4, 8]) AS BIGINT) AS f) GROUP BY ALL")
def downsample_multi(spark, sf_dir):
    return rounded(pyramid.downsample(T.raster_with_voids(spark, sf_dir), [2, 4, 8]), "h")


@query(f"WITH {T.V1}, n AS (SELECT max(r) + 1 AS m, max(c) + 1 AS n FROM v1), s AS (SELECT CAST(l AS BIGINT) AS level, greatest(1, m >> l) AS m, greatest(1, n >> l) AS n FROM n, (SELECT unnest(range(1, 8)) AS l)) SELECT level, r >> level AS r, c >> level AS c, max(h) AS h FROM v1, s WHERE (r >> level) < m AND (c >> level) < n GROUP BY ALL")
def max_pyramid(spark, sf_dir):
    cells = T.raster(spark, sf_dir)
    return pyramid.max_pyramid(cells, *size(cells))


FILL = "near AS (SELECT r, c, h, last_value(h IGNORE NULLS) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(h IGNORE NULLS) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b, last_value(h IGNORE NULLS) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e, first_value(h IGNORE NULLS) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM v2)"


@query(f"WITH {T.V2}, {FILL} SELECT r, c, round(coalesce(h, (coalesce(a, 0) + coalesce(b, 0) + coalesce(e, 0) + coalesce(f, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (e IS NOT NULL)::INT + (f IS NOT NULL)::INT, 0)), 6) AS h FROM near")
def fill_sweep(spark, sf_dir):
    return rounded(voids.fill_sweep(T.raster_with_voids(spark, sf_dir)), "h")


@query()
def fill_sequential(spark, sf_dir):
    cells = T.raster_with_voids(spark, sf_dir).withColumn("raster_id", F.floor(F.col("r") / 64).cast("string"))
    return voids.fill_sequential(cells)


@query(f"WITH {T.V1} SELECT r - 100 AS r, c - 10 AS c, h FROM v1 WHERE r BETWEEN 100 AND 299 AND c BETWEEN 10 AND 41")
def crop_rebase(spark, sf_dir):
    return grid.crop(T.raster(spark, sf_dir), 100, 10, 200, 32)


@query(f"WITH {T.V1}, n AS (SELECT max(r) + 1 AS m, max(c) + 1 AS n FROM v1), s AS (SELECT least(greatest(0, 60 - least(256, m) // 2), m - least(256, m)) AS r0, least(256, m) AS rn, least(greatest(0, 50 - least(48, n) // 2), n - least(48, n)) AS c0, least(48, n) AS cn FROM n) SELECT r - r0 AS r, c - c0 AS c, h FROM v1, s WHERE r BETWEEN r0 AND r0 + rn - 1 AND c BETWEEN c0 AND c0 + cn - 1")
def cap_window(spark, sf_dir):
    cells = T.raster(spark, sf_dir)
    m, n = size(cells)
    return grid.crop(cells, grid.cap_start(60, m, 256), grid.cap_start(50, n, 48), min(256, m), min(48, n))


@query(f"WITH {T.V2}, w AS (SELECT r, c, h, 0 AS o FROM v2 WHERE r < 40 UNION ALL SELECT r - 5, c + 3, h + 1, 1 FROM v2 WHERE r BETWEEN 30 AND 80 UNION ALL SELECT r - 30, c - 2, h + 2, 2 FROM v2 WHERE r BETWEEN 60 AND 120) SELECT r, c, arg_max(h, o) AS h FROM w WHERE h IS NOT NULL AND r BETWEEN 0 AND 79 AND c BETWEEN 0 AND 63 GROUP BY r, c")
def stitch_windows(spark, sf_dir):
    v = T.raster_with_voids(spark, sf_dir)
    up = lambda rows, by: rows.withColumn("h", F.col("h") + by)
    return grid.stitch([(v.filter("r < 40"), 0, 0), (up(v.filter("r BETWEEN 30 AND 80"), 1.0), -5, 3), (up(v.filter("r BETWEEN 60 AND 120"), 2.0), -30, -2)], 80, 64)


@query()
def stitch_whole(spark, sf_dir):
    """Three overlapping windows that hold all rows and columns, on a grid of the raster's size."""
    v = T.raster_with_voids(spark, sf_dir)
    m, n = size(v)
    up = lambda rows, by: rows.withColumn("h", F.col("h") + by)
    first, last = F.col("r") < -(-m // 2), F.col("r") >= m * 5 // 8
    middle = F.col("r").between(m * 3 // 8, m * 3 // 4)
    return grid.stitch([(v.filter(first), 0, 0), (up(v.filter(middle), 1.0), -(m // 16), n // 20), (up(v.filter(last), 2.0), 0, 0)], m, n)


@query(f"WITH {T.V1}, g AS (SELECT a AS r, b AS c FROM (SELECT unnest(range(0, 192)) AS a), (SELECT unnest(range(0, 48)) AS b)) SELECT g.r, g.c, CASE WHEN g.r // 64 = 1 AND g.c // 16 = 2 THEN CAST(0 AS DOUBLE) ELSE coalesce(h, 0) END AS h FROM g LEFT JOIN v1 USING (r, c)")
def assemble_3x3(spark, sf_dir):
    v = T.raster(spark, sf_dir).filter("r < 192 AND c < 48")
    tiled = v.select(F.floor(F.col("r") / 64).alias("tr"), F.floor(F.col("c") / 16).alias("tc"), (F.col("r") % 64).alias("r"), (F.col("c") % 16).alias("c"), "h")
    return grid.assemble(tiled.filter("NOT (tr = 1 AND tc = 2)"), 64, 16)


@query()
def assemble_whole(spark, sf_dir):
    """The whole raster from 3 x 3 tiles of a third of its rows and columns; that in the middle of the east is missing."""
    v = T.raster(spark, sf_dir)
    m, n = size(v)
    rows, columns = max(1, -(-m // 3)), max(1, -(-n // 3))
    tiled = v.select(F.floor(F.col("r") / rows).alias("tr"), F.floor(F.col("c") / columns).alias("tc"), (F.col("r") % rows).alias("r"), (F.col("c") % columns).alias("c"), "h")
    return grid.assemble(tiled.filter("NOT (tr = 1 AND tc = 2)"), rows, columns).filter((F.col("r") < m) & (F.col("c") < n))


@query(f"WITH {T.V1}, fine AS (SELECT r, c, h + 5 AS f FROM v1 WHERE r < 60 AND c < 60), x AS (SELECT v1.r, v1.c, h, f, v1.c * CAST(30 AS DOUBLE) AS x, v1.r * CAST(30 AS DOUBLE) AS y FROM v1 LEFT JOIN fine ON v1.r = fine.r AND v1.c = fine.c), t AS (SELECT r, c, h, f, CASE WHEN x < 1800 AND y < 1800 AND f IS NOT NULL THEN greatest(0, least(1, least(x, 1800 - x, y, 1800 - y) / CAST(500 AS DOUBLE))) ELSE 0 END AS t FROM x) SELECT r, c, round(h + (coalesce(f, h) - h) * t * t * (3 - 2 * t), 6) + 0.0 AS h FROM t")
def tier_blend(spark, sf_dir):
    base = T.raster(spark, sf_dir)
    fine = base.filter("r < 60 AND c < 60").withColumn("h", F.col("h") + 5)
    return rounded(sample.tier_blend(base, fine, 1800.0, 1800.0, DX, DX), "h")


def points(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"))
    return o.select("id", (F.col("id") * 37 % 6400 / 100.0).alias("x"), (F.col("id") * 53 % 50000 / 100.0).alias("y"))


POINTS = "pts AS (SELECT CAST(o_orderkey AS BIGINT) AS id, (o_orderkey * 37 % 6400) / CAST(100 AS DOUBLE) AS x, (o_orderkey * 53 % 50000) / CAST(100 AS DOUBLE) AS y FROM orders), f AS (SELECT id, floor(y) AS r, floor(x) AS c, y - floor(y) AS fy, x - floor(x) AS fx FROM pts), n AS (SELECT max(r) AS m, max(c) AS n FROM v1)"
_BI = "SELECT id, r + i AS r, c + j AS c, (CASE i WHEN 0 THEN 1 - fy ELSE fy END) * (CASE j WHEN 0 THEN 1 - fx ELSE fx END) AS w FROM f, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)"


def _cr(t: str) -> str:
    return f"[0.5::DOUBLE * (-{t}*{t}*{t} + 2::DOUBLE*{t}*{t} - {t}), 0.5::DOUBLE * (3::DOUBLE*{t}*{t}*{t} - 5::DOUBLE*{t}*{t} + 2::DOUBLE), 0.5::DOUBLE * (-3::DOUBLE*{t}*{t}*{t} + 4::DOUBLE*{t}*{t} + {t}), 0.5::DOUBLE * ({t}*{t}*{t} - {t}*{t})]"


_BC = f"SELECT id, r + i - 2 AS r, c + j - 2 AS c, ({_cr('fy')})[i] * ({_cr('fx')})[j] AS w FROM f, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([1, 2, 3, 4]) AS j)"


def _gather_sql(corners: str) -> str:
    return f"WITH {T.V1}, {POINTS}, k AS ({corners}) SELECT id, round(CAST(sum(CAST(round(w * h, 9) AS DECIMAL(24,9))) AS DOUBLE), 6) + 0.0 AS value FROM k, n, v1 WHERE v1.r = greatest(0, least(m, k.r)) AND v1.c = greatest(0, least(n, k.c)) GROUP BY id"


@query(_gather_sql(_BI))
def sample_bilinear(spark, sf_dir):
    cells = T.raster(spark, sf_dir)
    return rounded(sample.bilinear(points(spark, sf_dir), cells, *size(cells)), "value")


@query(_gather_sql(_BC))
def sample_bicubic(spark, sf_dir):
    cells = T.raster(spark, sf_dir)
    return rounded(sample.bicubic(points(spark, sf_dir), cells, *size(cells)), "value")


def _probes(n: int) -> list[tuple[int, int, int, float]]:
    near: dict = {}
    for k in range(n):
        for s in range(1, 25):
            x, y = sample.DIRECTIONS[k]
            near.setdefault((k, math.floor(y * s * 25.0 / DX), math.floor(x * s * 25.0 / DX)), s * 25.0)
    return [(*key, far) for key, far in near.items()]


_HB = ", ".join(f"({k}, {i}, {j}, {d(far)})" for k, i, j, far in _probes(4))


@query(f"WITH {T.V1}, n AS (SELECT max(r) AS m, max(c) AS n FROM v1), p(d, i, j, far) AS (VALUES {_HB}), q AS (SELECT a.r, a.c, a.h, d, far, greatest(0, least(m, a.r + i)) AS pr, greatest(0, least(n, a.c + j)) AS pc FROM v1 a, n, p), s AS (SELECT q.r, q.c, d, max((b.h - q.h) / far) AS slope FROM q JOIN v1 b ON b.r = pr AND b.c = pc GROUP BY ALL), t AS (SELECT r, c, greatest(0, slope) AS t FROM s) SELECT r, c, round(CAST(sum(CAST(round(1 - t / sqrt(1 + t * t), 9) AS DECIMAL(18,9))) AS DOUBLE) / 4, 6) + 0.0 AS ao FROM t GROUP BY r, c")
def hbao(spark, sf_dir):
    cells = T.raster(spark, sf_dir)
    return rounded(sample.horizon_occlusion(cells, *size(cells), DX, DX), "ao")


_SS = ", ".join(f"({i}, {j}, {d(z)})" for i, j, z in sample.hemisphere_kernel(8, DX, DX))


@query(f"WITH {T.V1}, n AS (SELECT max(r) AS m, max(c) AS n FROM v1), p(i, j, z) AS (VALUES {_SS}), q AS (SELECT a.r, a.c, a.h + z AS z, greatest(0, least(m, a.r + i)) AS pr, greatest(0, least(n, a.c + j)) AS pc FROM v1 a, n, p), s AS (SELECT q.r, q.c, greatest(0, least(1, (z - b.h + 50) / 100)) AS t FROM q JOIN v1 b ON b.r = pr AND b.c = pc) SELECT r, c, round(CAST(sum(CAST(round(t * t * (3 - 2 * t), 9) AS DECIMAL(18,9))) AS DOUBLE) / 8, 6) + 0.0 AS ao FROM s GROUP BY r, c")
def ssao(spark, sf_dir):
    cells = T.raster(spark, sf_dir)
    return rounded(sample.hemisphere_occlusion(cells, sample.hemisphere_kernel(8, DX, DX), *size(cells)), "ao")


@query("WITH l AS (SELECT CAST(p_partkey AS BIGINT) AS path, CAST(i AS BIGINT) AS ifd, CAST(1 + p_size % 5 AS DOUBLE) * (1 << i) AS scale FROM part, (SELECT unnest(range(0, 4)) AS i)) SELECT path, coalesce(min(ifd) FILTER (WHERE scale >= 3 AND floor(40000 / scale) <= 8192), max(ifd)) AS ifd FROM l GROUP BY path")
def select_level(spark, sf_dir):
    part = T.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("path"), "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("ifd"))
    return pyramid.select_level(part.select("path", "ifd", ((1 + F.col("p_size") % 5) * F.pow(F.lit(2.0), F.col("ifd"))).alias("scale")), 3.0, 20000.0, 8192)


SQUARES = "sq AS (SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_suppkey * 7919 % 2000000 AS DOUBLE) AS e, CAST(s_suppkey * 104729 % 2500000 AS DOUBLE) AS n, CAST(20000 + s_suppkey % 5 * 10000 AS DOUBLE) AS radius FROM supplier)"


@query(f"WITH {T.TILES}, {SQUARES}, t AS (SELECT path, CAST(regexp_extract(path, 'N(\\d+)E', 1) AS BIGINT) AS tn, CAST(regexp_extract(path, 'E(\\d+)\\.tif$', 1) AS BIGINT) AS te FROM tiles) SELECT id, path FROM sq, t WHERE tn < n + radius AND tn + 50000 > n - radius AND te < e + radius AND te + 50000 > e - radius")
def tile_overlap(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    squares = s.select("id", (F.col("id") * 7919 % 2000000).cast("double").alias("e"), (F.col("id") * 104729 % 2500000).cast("double").alias("n"), (20000 + F.col("id") % 5 * 10000).cast("double").alias("radius"))
    return plans.overlapping(T.tile_catalog(spark, sf_dir), squares)


@query("SELECT CAST(p_partkey AS BIGINT) AS k, printf('Copernicus_DSM_COG_10_N%02d_00_E%03d_00_DEM', CAST(p_partkey % 90 AS INT), CAST(p_partkey % 180 AS INT)) || '/' || printf('Copernicus_DSM_COG_10_N%02d_00_E%03d_00_DEM', CAST(p_partkey % 90 AS INT), CAST(p_partkey % 180 AS INT)) || '.tif' AS path FROM part")
def tile_path_format(spark, sf_dir):
    k = F.col("p_partkey").cast("long")
    return T.table(spark, sf_dir, "part").select(k.alias("k"), geo.tile_path((k % 90).cast("int"), (k % 180).cast("int")).alias("path"))


def requests(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("long").alias("id"), F.least(F.dayofyear("o_orderdate"), F.lit(365)).cast("long").alias("day"), (F.col("o_orderkey") % 24).cast("double").alias("hour"), (F.col("o_custkey") % 60 + 0.5).cast("double").alias("lat"))


REQ = "req AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(least(dayofyear(o_orderdate), 365) AS BIGINT) AS day, CAST(o_orderkey % 24 AS DOUBLE) AS hour, CAST(o_custkey % 60 + 0.5 AS DOUBLE) AS lat FROM orders)"


@query(f"WITH {REQ}, a AS (SELECT id, hour, radians(lat) AS lat, radians(CAST(23.45 AS DOUBLE) * sin(radians(CAST(360 AS DOUBLE) / CAST(365 AS DOUBLE) * (day + 284)))) AS decl, radians(15 * (hour - 12)) AS turn FROM req), b AS (SELECT *, sin(lat) * sin(decl) + cos(lat) * cos(decl) * cos(turn) AS s FROM a), e AS (SELECT *, asin(greatest(-1, least(1, s))) AS el FROM b), z AS (SELECT *, acos(greatest(-1, least(1, (sin(decl) - s * sin(lat)) / (cos(el) * cos(lat))))) AS az FROM e) SELECT id, round(CASE WHEN cos(el) < 1e-6 THEN 0 WHEN hour > 12 THEN {d(2 * math.pi)} - az ELSE az END, 5) + 0.0 AS azimuth, round(el, 5) + 0.0 AS elevation FROM z")
def sun_position(spark, sf_dir):
    az, el = geo.sun_position(F.col("day"), F.col("hour"), F.col("lat"))
    return rounded(requests(spark, sf_dir).select("id", az.alias("azimuth"), el.alias("elevation")), "azimuth", "elevation", digits=5)


@query(f"WITH {REQ} SELECT id, CASE WHEN a < 93 THEN 'summer' WHEN a < 183 THEN 'autumn' WHEN a < 273 THEN 'winter' ELSE 'spring' END AS season, (day + 399) % 365 + 1 AS wrapped FROM (SELECT id, day, (day - 172 + 365) % 365 AS a FROM req)")
def season(spark, sf_dir):
    return requests(spark, sf_dir).select("id", geo.season(F.col("day")).alias("season"), geo.wrapped_day(F.col("day") + 400).alias("wrapped"))


@query(f"WITH {REQ} SELECT id, strftime(DATE '2023-01-01' + CAST(day - 1 AS INT), '%b %-d') AS label, printf('Time: %02d:%02d', CAST(floor(h) AS INT), CAST(floor((h - floor(h)) * 60) AS INT)) AS clock FROM (SELECT *, hour / 2 AS h FROM req)")
def calendar_label(spark, sf_dir):
    return requests(spark, sf_dir).select("id", geo.calendar_label(F.col("day")).alias("label"), geo.clock_label(F.col("hour") / 2).alias("clock"))


def _files(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("remote"))
    local = T.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path")).distinct().join(docs, "path").select("path", F.when(F.col("path") % 3 == 0, F.lit(0)).when(F.col("path") % 3 == 1, F.floor(F.col("remote") / 2)).otherwise(F.col("remote")).cast("long").alias("local"))
    return docs, local


FILES = "f AS (SELECT doc_id AS path, n_chars AS remote FROM documents), l AS (SELECT DISTINCT path, CASE path % 3 WHEN 0 THEN 0 WHEN 1 THEN remote // 2 ELSE remote END AS local FROM f WHERE path IN (SELECT doc_id FROM labels))"
STATE = "st AS (SELECT path, remote, coalesce(local, 0) AS local, CASE WHEN coalesce(local, 0) = remote AND remote > 0 THEN 'complete' WHEN coalesce(local, 0) > 0 AND coalesce(local, 0) < remote THEN 'resume' ELSE 'restart' END AS state FROM f LEFT JOIN l USING (path))"


@query(f"WITH {FILES}, {STATE} SELECT path, remote, CAST(local AS BIGINT) AS local, state, CAST(CASE state WHEN 'resume' THEN remote - local WHEN 'restart' THEN remote ELSE 0 END AS BIGINT) AS rest FROM st")
def download_plan(spark, sf_dir):
    return plans.classify(*_files(spark, sf_dir))


@query(f"WITH {FILES} SELECT path, remote FROM f WHERE path NOT IN (SELECT path FROM l)")
def download_missing(spark, sf_dir):
    return plans.missing(*_files(spark, sf_dir))


@query("SELECT o_custkey AS session, o_orderkey AS seq, CAST(sum(o_orderkey % 65536) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS done FROM orders")
def download_progress(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 65536).cast("long").alias("bytes"))
    return plans.progress(o).drop("bytes")


@query("SELECT path, b, CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / CAST(1073741824 AS DOUBLE)) WHEN b >= 1048576 THEN printf('%d MB', b // 1048576) ELSE printf('%d KB', b // 1024) END AS label FROM (SELECT doc_id AS path, n_chars * n_chars * 17 AS b FROM documents)")
def size_label(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), (F.col("n_chars") * F.col("n_chars") * 17).alias("b"))
    return docs.select("path", "b", geo.size_label(F.col("b")).alias("label"))


@query("WITH p AS (SELECT CAST(c_custkey AS BIGINT) AS id, '/data/' || CAST(c_custkey % 7 AS VARCHAR) || '/x/' || CAST(c_custkey AS VARCHAR) AS path FROM customer), m(mount, free) AS (VALUES ('/', 1), ('/data', 2), ('/data/3', 3), ('/data/4/x', 4), ('/data/44', 5)) SELECT path, arg_max(mount, length(mount)) AS mount, CAST(arg_max(free, length(mount)) AS BIGINT) AS free FROM p JOIN m ON mount = '/' OR path = mount OR starts_with(path, mount || '/') GROUP BY path")
def mount_of_path(spark, sf_dir):
    k = F.col("c_custkey").cast("long")
    paths = T.table(spark, sf_dir, "customer").select(F.concat(F.lit("/data/"), (k % 7).cast("string"), F.lit("/x/"), k.cast("string")).alias("path"))
    mounts = spark.createDataFrame([("/", 1), ("/data", 2), ("/data/3", 3), ("/data/4/x", 4), ("/data/44", 5)], "mount string, free long")
    return plans.longest_mount(paths, mounts)


THRESHOLD = 2000.0


@query(f"WITH RECURSIVE {T.TRACK}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM track), g AS (SELECT user_id, k, event_id, x, y, x AS lx, y AS ly, TRUE AS pass FROM n WHERE k = 1 UNION ALL SELECT n.user_id, n.k, n.event_id, n.x, n.y, CASE WHEN abs(n.x - lx) > {THRESHOLD} OR abs(n.y - ly) > {THRESHOLD} THEN n.x ELSE lx END, CASE WHEN abs(n.x - lx) > {THRESHOLD} OR abs(n.y - ly) > {THRESHOLD} THEN n.y ELSE ly END, abs(n.x - lx) > {THRESHOLD} OR abs(n.y - ly) > {THRESHOLD} FROM g JOIN n ON n.user_id = g.user_id AND n.k = g.k + 1) SELECT user_id, event_id, x, y FROM g WHERE pass")
def drift_gate(spark, sf_dir):
    return drift.drift_gate(T.track(spark, sf_dir), THRESHOLD).select("user_id", "event_id", "x", "y")


@query(f"WITH {T.TRACK}, t AS (SELECT user_id, event_id, CAST(floor(x / 1000) AS BIGINT) AS tx, CAST(floor(y / 1000) AS BIGINT) AS ty, ts FROM track), m AS (SELECT *, lag(tx) OVER w AS px, lag(ty) OVER w AS py FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, tx, ty FROM m WHERE px <> tx OR py <> ty")
def tile_slide(spark, sf_dir):
    return drift.tile_slides(T.track(spark, sf_dir), 1000.0).select("user_id", "event_id", "tx", "ty")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_message(spark, sf_dir):
    return plans.latest(T.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 hour, ts)) AS BIGINT) AS at, count(*) AS n FROM events GROUP BY 1")
def fps_tumbling(spark, sf_dir):
    return drift.tumbling_rate(T.table(spark, sf_dir, "events"), 3600).select(F.unix_timestamp("at").alias("at"), "n")


@query(f"WITH {T.TRACK} SELECT event_id, CASE WHEN x - 500 BETWEEN 0 AND 3000 AND 4000 - y BETWEEN 0 AND 3000 THEN x - 500 END AS lx, CASE WHEN x - 500 BETWEEN 0 AND 3000 AND 4000 - y BETWEEN 0 AND 3000 THEN 4000 - y END AS ly FROM track")
def bounds_check(spark, sf_dir):
    x, y = grid.local_metres(F.col("x"), F.col("y"), 500.0, 4000.0, 3000.0, 3000.0)
    return T.track(spark, sf_dir).select("event_id", x.alias("lx"), y.alias("ly"))


def _smooth(a: float, b: float, x: str) -> str:
    t = f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), ({x} - {d(a)}) / {d(b - a)}))"
    return f"({t}) * ({t}) * ({d(3.0)} - {d(2.0)} * ({t}))"


def _tint(k: int) -> str:
    out = d(surface.TINTS[0][k])
    for colour, (a, b) in zip(surface.TINTS[1:], surface.STEPS, strict=True):
        out = f"({out} + ({d(colour[k])} - ({out})) * {_smooth(a, b, 'z')})"
    return out


def _pixel(k: int, light: str, distance: str) -> str:
    shaded = f"floor(greatest(CAST(0 AS DOUBLE), least(CAST(255 AS DOUBLE), {_tint(k)} * {light})))"
    return f"CAST(floor({shaded} + ({d(surface.SKY[k])} - {shaded}) * {_smooth(15000.0, 60000.0, distance)}) AS BIGINT)"


def _bgra(light: str, distance: str) -> str:
    return f"{_pixel(2, light, distance)} + {_pixel(1, light, distance)} * 256 + {_pixel(0, light, distance)} * 65536 + CAST(4278190080 AS BIGINT)"


@query(f"WITH {T.V1}, s AS (SELECT r, c, h + 700 AS z, r * CAST(300 AS DOUBLE) AS far FROM v1) SELECT r, c, {_bgra(d(0.8), 'far')} AS bgra FROM s")
def hypsometric_fog(spark, sf_dir):
    cells = T.raster(spark, sf_dir)
    return cells.select("r", "c", surface.pixel(F.col("h") + 700, F.lit(0.8), F.col("r") * 300.0).alias("bgra"))


EYE, STEP, STEPS, WIDTH, HEIGHT = (960.0, 6000.0, 2600.0), 40.0, 150, 64, 36
VIEW = render.camera(0.3, -0.35, math.radians(60), WIDTH, HEIGHT)


def _ray_sql() -> str:
    f, r, u, tx, ty = VIEW
    axes = [f"({d(f[k])} + {d(r[k])} * x + {d(u[k])} * y)" for k in range(3)]
    norm = "sqrt(" + " + ".join(f"{a} * {a}" for a in axes) + ")"
    rays = f"xy AS (SELECT CAST(i % {WIDTH} AS BIGINT) AS px, CAST(i // {WIDTH} AS BIGINT) AS py, ({d(2.0)} * (i % {WIDTH} + {d(0.5)}) / {d(float(WIDTH))} - 1) * {d(tx)} AS x, (1 - {d(2.0)} * (i // {WIDTH} + {d(0.5)}) / {d(float(HEIGHT))}) * {d(ty)} AS y FROM (SELECT unnest(range(0, {WIDTH * HEIGHT})) AS i)), ray AS (SELECT px, py, {axes[0]} / {norm} AS ux, {axes[1]} / {norm} AS uy, {axes[2]} / {norm} AS uz FROM xy)"
    at = [f"({d(e)} + {n} * (k * {d(STEP)}))" for e, n in zip(EYE, ("ux", "uy", "uz"), strict=True)]
    path = f"path AS (SELECT px, py, k, CAST(floor({at[1]} / {d(DX)}) AS BIGINT) AS r, CAST(floor({at[0]} / {d(DX)}) AS BIGINT) AS c, {at[2]} AS z FROM ray, (SELECT unnest(range(1, {STEPS + 1})) AS k))"
    hit = "hit AS (SELECT px, py, min(k) AS k, arg_min(h, k) AS z FROM path JOIN v1 ON path.r = v1.r AND path.c = v1.c WHERE path.z <= h GROUP BY px, py)"
    return f"WITH {T.V1}, {rays}, {path}, {hit} SELECT px, py, coalesce({_bgra(d(0.8), f'(k * {d(STEP)})')}, CAST(4287090411 AS BIGINT)) AS bgra FROM ray LEFT JOIN hit USING (px, py)"


@query(_ray_sql())
def render_fixed_step(spark, sf_dir):
    cells = T.raster(spark, sf_dir)
    hits = render.first_hit(render.rays(spark, WIDTH, HEIGHT, VIEW), cells, EYE, *size(cells), DX, DX, STEP, STEPS)
    return render.image(hits, STEP, 0.8)


@query()
def crs_round_trip(spark, sf_dir):
    """Points to EPSG:3035 and back: the error in degrees stays below 1e-7."""
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), (F.col("o_orderkey") % 3000 / 100.0 + 38).alias("lat"), (F.col("o_custkey") % 3500 / 100.0 - 5).alias("lon"))
    e, n = geo.to_laea(F.col("lat"), F.col("lon"))
    back = o.withColumns({"e": e, "n": n})
    lat, lon = geo.from_laea(F.col("e"), F.col("n"))
    return back.select("id", "lat", "lon", "e", "n", lat.alias("lat2"), lon.alias("lon2"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Void rule, shadow from the west, share of shaded cells per row."""
    cells = T.raster(spark, sf_dir).withColumn("h", voids.void_rule(F.col("h"), "full"))
    lit = shadow.west_shadow(cells, DX, math.radians(35.0))
    return lit.groupBy("r").agg(F.count_if(F.col("lit") == 0).alias("shaded"), F.count("*").alias("cells"))


@query(f"WITH {T.V1}, raised AS (SELECT r, c, h + c * {d(WEST)} AS x FROM v1), lit AS (SELECT r, x < max(x) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dark FROM raised) SELECT r, count(*) FILTER (WHERE dark) AS shaded, count(*) AS cells FROM lit GROUP BY r")
def shaded_rows(spark, sf_dir):
    return flagship(spark, sf_dir)
