"""Queries of what surrounds a viewer: gates, presets, codecs, labels, references, occlusion of the view, smooth slopes."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from orogen.functions import geo
from orogen.functions import viewer as V
from orogen.operators import render, sample, shadow, surface
from orogen.plans import queries as Q
from orogen.plans import tiles as plans
from orogen.plans.queries import DX, FILES, NORMALS, POINTS, REQ, SQL, SQUARES, STATE, THRESHOLD, _cr, _files, d, points, query, requests, rounded, size
from orogen.sources import tables as T
from orogen.streaming import drift


def _part(spark, sf_dir, *columns):
    return T.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), *columns)


_CODES = " ".join(f"WHEN {code} THEN '{text}'" for code, text in V.PROJECTIONS.items())


@query(f"WITH x AS (SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 3 WHEN 0 THEN 4326 WHEN 1 THEN 3035 ELSE 31287 END AS epsg, CASE WHEN p_partkey % 7 = 0 THEN '+proj=latlong +ellps=bessel' END AS own FROM part) SELECT id, coalesce(own, CASE epsg {_CODES} END) AS proj4, coalesce(own, CASE epsg {_CODES} END) LIKE '%lat%long%' OR coalesce(own, CASE epsg {_CODES} END) LIKE '%longlat%' AS geographic FROM x")
def projections(spark, sf_dir):
    """Projections of files, by their own text or their code."""
    k = F.col("p_partkey")
    rows = _part(spark, sf_dir, F.when(k % 3 == 0, 4326).when(k % 3 == 1, 3035).otherwise(31287).alias("epsg"), F.when(k % 7 == 0, "+proj=latlong +ellps=bessel").alias("own"))
    return rows.select("id", V.projection(F.col("epsg"), F.col("own")).alias("proj4")).withColumn("geographic", V.is_geographic(F.col("proj4")))


@query(f"WITH {SQUARES} SELECT id, CASE WHEN i THEN e ELSE 900000 END AS e, CASE WHEN i THEN n ELSE 1250000 END AS n FROM (SELECT *, e BETWEEN 300000 AND 1500000 AND n BETWEEN 500000 AND 2000000 AS i FROM sq)")
def start_positions(spark, sf_dir):
    """Positions inside the bounds of a tile, or its centre."""
    s = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    at = (F.col("id") * 7919 % 2000000).cast("double"), (F.col("id") * 104729 % 2500000).cast("double")
    e, n = V.start_position(*at, *(F.lit(float(x)) for x in (300000, 500000, 1500000, 2000000)))
    return s.select("id", e.alias("e"), n.alias("n"))


_F = "greatest(CAST(floor({to} / scale + 0.5) AS BIGINT), 2)"


@query(f"WITH x AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_size / CAST(2 AS DOUBLE) AS scale, CAST(1 + p_partkey % 3 % 2 AS BIGINT) AS levels FROM part), y AS (SELECT *, levels = 1 AND scale < 20 AS cached, {_F.format(to=8.0)} AS a, {_F.format(to=32.0)} AS b FROM x) SELECT id, CASE WHEN cached THEN CASE WHEN scale < 5 THEN CAST(round_even(scale * a, 0) AS BIGINT) || 'm+' ELSE '' END || CAST(round_even(scale * b, 0) AS BIGINT) || 'm' END AS label, cached AND scale < 5 AS close_from_cache, scale < 5 AS fine FROM y")
def tier_plan(spark, sf_dir):
    """Which levels of a file are cached, and where close and fine tiers come from."""
    scale, levels = F.col("p_size") / 2.0, (1 + F.col("p_partkey") % 3 % 2).cast("long")
    factors = V.overview_factors(scale, levels)
    return _part(spark, sf_dir, V.level_label(scale, factors).alias("label"), (factors.isNotNull() & (scale < 5)).alias("close_from_cache"), (scale < 5).alias("fine"))


_SUN = f"a AS (SELECT id, who, hour, radians(lat) AS lat, radians(CAST(23.45 AS DOUBLE) * sin(radians(CAST(360 AS DOUBLE) / CAST(365 AS DOUBLE) * (day + 284)))) AS decl, radians(15 * (hour - 12)) AS turn FROM req), b AS (SELECT *, sin(lat) * sin(decl) + cos(lat) * cos(decl) * cos(turn) AS s FROM a), e AS (SELECT *, asin(greatest(-1, least(1, s))) AS el FROM b), z AS (SELECT id, who, el, CASE WHEN cos(el) < 1e-6 THEN 0 WHEN hour > 12 THEN {d(2 * math.pi)} - acos(greatest(-1, least(1, (sin(decl) - s * sin(lat)) / (cos(el) * cos(lat))))) ELSE acos(greatest(-1, least(1, (sin(decl) - s * sin(lat)) / (cos(el) * cos(lat))))) END AS az FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY id) AS k FROM z WHERE el > 0)"


@query(f"WITH RECURSIVE {REQ.replace('req AS (SELECT', 'req AS (SELECT o_custkey AS who,')}, {_SUN}, g AS (SELECT who, k, id, az AS la, el AS le, TRUE AS pass FROM n WHERE k = 1 UNION ALL SELECT n.who, n.k, n.id, CASE WHEN p THEN az ELSE la END, CASE WHEN p THEN el ELSE le END, p FROM (SELECT n.*, la, le, abs(az - la) > 0.00175 OR abs(el - le) > 0.00175 AS p FROM g JOIN n ON n.who = g.who AND n.k = g.k + 1) n) SELECT id FROM g WHERE pass")
def sun_gate(spark, sf_dir):
    """Frames of each customer for which shadows are computed anew."""
    who = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").alias("who"))
    az, el = geo.sun_position(F.col("day"), F.col("hour"), F.col("lat"))
    frames = requests(spark, sf_dir).join(who, "id").select("id", "who", az.alias("azimuth"), el.alias("elevation"))
    return drift.sun_gate(frames, "who", "id").select("id")


@query(f"WITH {T.V2}, n AS (SELECT max(r) + 1 AS m, max(c) + 1 AS n FROM v2) SELECT coalesce(CASE WHEN h > -1000 THEN h END, 1000) + 2000 AS height FROM v2, n WHERE r = m // 2 AND c = n // 2")
def camera_height(spark, sf_dir):
    """Height of a camera over the middle of the raster."""
    cells = T.raster_with_voids(spark, sf_dir)
    m, n = size(cells)
    return cells.filter((F.col("r") == m // 2) & (F.col("c") == n // 2)).select(V.camera_height(F.col("h")).alias("height"))


@query(f"WITH {FILES}, {STATE} SELECT CAST(coalesce(sum(greatest(remote - CASE state WHEN 'resume' THEN local ELSE 0 END, 0)), 0) AS BIGINT) AS total FROM st WHERE state <> 'complete'")
def session_total(spark, sf_dir):
    """Bytes that a session still has to fetch."""
    return plans.classify(*_files(spark, sf_dir)).agg(F.coalesce(F.sum(F.greatest("rest", F.lit(0))), F.lit(0)).cast("long").alias("total"))


@query("SELECT CAST(p_partkey AS BIGINT) AS id, least(CAST(2000 AS DOUBLE), least((p_size * 100) * CAST(5 AS DOUBLE), (p_partkey % 700 + 1) * CAST(4 AS DOUBLE)) * 0.25::DOUBLE) AS threshold FROM part")
def drift_thresholds(spark, sf_dir):
    """Drift thresholds that windows of many sizes allow."""
    k = F.col("p_partkey")
    return _part(spark, sf_dir, V.drift_threshold(k % 700 + 1, F.col("p_size") * 100, F.lit(5.0), F.lit(4.0), 2000.0).alias("threshold"))


@query(f"WITH x AS (SELECT CAST(o_orderkey AS BIGINT) AS id, (o_orderkey % 211) / CAST(100 AS DOUBLE) - 1 AS x, (o_custkey % 199) / CAST(100 AS DOUBLE) - 1 AS y FROM orders), a AS (SELECT *, atan2(x, -y) AS a FROM x), b AS (SELECT *, CASE WHEN a < 0 THEN a + {d(math.tau)} ELSE a END AS angle, sin(CAST(id % 12 AS DOUBLE)) AS tx, -cos(CAST(id % 12 AS DOUBLE)) AS ty FROM a), t AS (SELECT *, greatest(0, least(1, ((x - 0.72::DOUBLE * tx) * 0.28::DOUBLE * tx + (y - 0.72::DOUBLE * ty) * 0.28::DOUBLE * ty) / (0.28::DOUBLE * 0.28::DOUBLE))) AS t FROM b) SELECT id, round(angle, 6) + 0.0 AS angle, round(sqrt(pow(x - (0.72::DOUBLE + 0.28::DOUBLE * t) * tx, 2) + pow(y - (0.72::DOUBLE + 0.28::DOUBLE * t) * ty, 2)), 6) + 0.0 AS tick, (id + 63) // 64 * 64 AS width FROM t")
def dial(spark, sf_dir):
    """Angles on a dial, distances from its ticks, aligned widths."""
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), (F.col("o_orderkey") % 211 / 100.0 - 1).alias("x"), (F.col("o_custkey") % 199 / 100.0 - 1).alias("y"))
    tick = V.tick_distance(F.col("x"), F.col("y"), 1.0, (F.col("id") % 12).cast("double"))
    return rounded(o.select("id", V.clock_angle(F.col("x"), F.col("y"), 0.0, 0.0).alias("angle"), tick.alias("tick"), V.aligned(F.col("id")).alias("width")), "angle", "tick")


@query("SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN k <= 0 THEN 500 WHEN k <= 500 THEN 1000 WHEN k <= 1000 THEN 2000 WHEN k <= 2000 THEN 5000 WHEN k <= 5000 THEN 0 ELSE 500 END::DOUBLE AS smooth, 30::DOUBLE / CASE c_custkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 3 END AS step, CASE c_custkey % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.2 WHEN 2 THEN 0.4 ELSE 0.8 END::DOUBLE AS sphere FROM (SELECT *, c_custkey % 61 * 100 AS k FROM customer)")
def presets(spark, sf_dir):
    """Next radius of smooth normals, and steps by quality."""
    k = F.col("c_custkey")
    rows = T.table(spark, sf_dir, "customer")
    return rows.select(k.cast("long").alias("id"), V.next_smooth((k % 61 * 100).cast("double")).alias("smooth"), (30.0 / V.by_quality(k % 4, V.STEP_DIVISORS)).alias("step"), V.by_quality(k % 4, V.SPHERES).alias("sphere"))


_I16 = "CAST(sign({x}) * floor(abs({x}) * 32767 + 0.5) AS BIGINT)"


@query(f"WITH {T.V1}, {NORMALS}, i AS (SELECT r, c, {_I16.format(x='round(nx, 6)')} AS x, {_I16.format(x='round(ny, 6)')} AS y, nz FROM norm) SELECT r, c, (x & 65535) * 65536 + (y & 65535) AS packed, round(x / 32767.0::DOUBLE, 6) + 0.0 AS nx, round(sqrt(greatest(0, 1 - x / 32767.0::DOUBLE * x / 32767.0::DOUBLE - y / 32767.0::DOUBLE * y / 32767.0::DOUBLE)), 5) + 0.0 AS nz, CAST(floor(round(nz, 6) * 255) AS INT) AS level FROM i")
def normal_codec(spark, sf_dir):
    """Normals packed into 32 bits and back, and a byte of a share."""
    n = rounded(surface.normals(T.raster(spark, sf_dir), DX, DX), "nx", "ny", "nz")
    n = n.select("r", "c", V.packed_normal(F.col("nx"), F.col("ny")).alias("packed"), V.byte_level(F.col("nz")).alias("level"))
    nx, _, nz = V.unpacked_normal(F.col("packed"))
    return rounded(rounded(n.select("r", "c", "packed", nx.alias("nx"), nz.alias("nz"), "level"), "nx"), "nz", digits=5)


@query(f"WITH {T.V2} SELECT r, c, CAST(floor((h - low) / (high - low) * 255) AS INT) AS gray FROM v2, (SELECT min(h) AS low, max(h) AS high FROM v2)")
def grayscale(spark, sf_dir):
    """The raster as bytes between its lowest and highest cell."""
    return V.grayscale(T.raster_with_voids(spark, sf_dir))


@query("SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 11 = 0 THEN 1 WHEN t > 0 THEN greatest(0, least(1, o_custkey / t::DOUBLE)) WHEN n > 0 THEN greatest(0, least(1, (o_custkey % 9 + 1) / n::DOUBLE)) ELSE 0 END::DOUBLE AS share FROM (SELECT *, o_orderkey % 5 * 100 AS t, o_orderkey % 7 AS n FROM orders)")
def overall_progress(spark, sf_dir):
    """Shares of downloads in all phases."""
    o, k = T.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(k.cast("long").alias("id"), V.overall_progress(k % 11 == 0, F.col("o_custkey"), k % 5 * 100, F.col("o_custkey") % 9, k % 7).alias("share"))


@query("SELECT CAST(c_custkey AS BIGINT) AS id, printf('LAT %.2f°N LON %.2f°E', abs((c_custkey * 37 % 18000 - 9000) / 100.0::DOUBLE), (c_custkey * 53 % 18000) / 100.0::DOUBLE) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE printf(' ELEV %d M', CAST(trunc(c_custkey * 7.3::DOUBLE) AS BIGINT)) END AS label FROM customer")
def place_labels(spark, sf_dir):
    """Labels of places, with and without heights."""
    k = F.col("c_custkey").cast("long")
    label = V.place_label((k * 37 % 18000 - 9000) / 100.0, (k * 53 % 18000) / 100.0, F.when(k % 3 != 0, k * 7.3))
    return T.table(spark, sf_dir, "customer").select(k.alias("id"), label.alias("label"))


@query("SELECT event_id, (event_id * 1000003) / ((event_id % 977 + 1) / 24000000.0::DOUBLE) / 1000000000.0::DOUBLE AS rate FROM events")
def bandwidth(spark, sf_dir):
    """Rates of transfers timed in ticks."""
    e = F.col("event_id")
    return T.table(spark, sf_dir, "events").select("event_id", V.bandwidth(e % 977 + 1, 24e6, e * 1000003).alias("rate"))


@query(f"WITH {T.TRACK} SELECT event_id, round(48 - y / 30.0::DOUBLE * (1 / 3600.0::DOUBLE), 9) AS lat, round(x / 20.0::DOUBLE * (1 / 3600.0::DOUBLE) + 11, 9) AS lon, CAST(floor(48 - y / 30.0::DOUBLE * (1 / 3600.0::DOUBLE)) AS BIGINT) AS tile_lat FROM track")
def track_to_geographic(spark, sf_dir):
    """Degrees of positions in metres on a tile, and the tile they are in."""
    lat, lon = V.to_geographic(F.col("x"), F.col("y"), F.lit(20.0), F.lit(30.0), F.lit(1 / 3600.0), F.lit(-1 / 3600.0), F.lit(11.0), F.lit(48.0))
    return T.track(spark, sf_dir).select("event_id", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"), F.floor(lat).alias("tile_lat"))


def _slope(t: str) -> str:
    return f"[0.5::DOUBLE * (-3::DOUBLE*{t}*{t} + 4::DOUBLE*{t} - 1::DOUBLE), 0.5::DOUBLE * (9::DOUBLE*{t}*{t} - 10::DOUBLE*{t}), 0.5::DOUBLE * (-9::DOUBLE*{t}*{t} + 8::DOUBLE*{t} + 1::DOUBLE), 0.5::DOUBLE * (3::DOUBLE*{t}*{t} - 2::DOUBLE*{t})]"


_DERIVED = f"k AS (SELECT id, r + i - 2 AS r, c + j - 2 AS c, ({_cr('fy')})[i] * ({_slope('fx')})[j] AS wx, ({_slope('fy')})[i] * ({_cr('fx')})[j] AS wy FROM f, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([1, 2, 3, 4]) AS j)), s AS (SELECT id, sum(wx * h) / 30 AS sx, sum(wy * h) / 30 AS sy FROM k, n, v1 WHERE v1.r = greatest(0, least(m, k.r)) AND v1.c = greatest(0, least(n, k.c)) GROUP BY id)"


@query(f"WITH {T.V1}, {POINTS}, {_DERIVED} SELECT id, round(-sx / sqrt(sx * sx + sy * sy + 1), 5) + 0.0 AS nx, round(-sy / sqrt(sx * sx + sy * sy + 1), 5) + 0.0 AS ny, round(1 / sqrt(sx * sx + sy * sy + 1), 5) + 0.0 AS nz FROM s")
def smooth_normals(spark, sf_dir):
    """Normals of the bicubic surface at points."""
    cells = T.raster(spark, sf_dir)
    return rounded(sample.smooth_normals(points(spark, sf_dir), cells, *size(cells), DX, DX), "nx", "ny", "nz", digits=5)


@query(f"WITH {T.TILES} SELECT path, CAST(regexp_extract(path, 'E(\\d+)\\.tif$', 1) AS BIGINT) + 50000 * 0.5::DOUBLE AS e, CAST(regexp_extract(path, 'N(\\d+)E', 1) AS BIGINT) + 50000 - 50000 * 0.5::DOUBLE AS n FROM tiles ORDER BY path LIMIT 1")
def first_tile(spark, sf_dir):
    """The first tile by name, and its centre."""
    n, e = geo.tile_corner(F.col("path"))
    tiles = T.tile_catalog(spark, sf_dir).filter(n.isNotNull()).orderBy("path").limit(1)
    return tiles.select("path", (e + 50000 * 0.5).alias("e"), (n + 50000 - 50000 * 0.5).alias("n"))


@query("WITH x AS (SELECT p_partkey, p_size, p_size % 5 = 4 AS best FROM part) SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN best THEN 'discrete' ELSE 'other' END AS kind FROM x ORDER BY NOT best, p_partkey LIMIT 1")
def preferred_device(spark, sf_dir):
    """The first device of the best kind, else the first."""
    return V.preferred(_part(spark, sf_dir, F.when(F.col("p_size") % 5 == 4, "discrete").otherwise("other").alias("kind")), "kind", "discrete", "id")


def _look_sql(asked: str) -> str:
    """Bilinear heights at asked(r, c, ..., y, x), clamped at the border."""
    at = lambda i, j: f"hs[({i}) * (n + 1) + ({j}) + 1]"
    across = lambda i: f"({at(i, 'j')} * (1 - fx) + {at(i, 'least(n, j + 1)')} * fx)"
    return (
        f"q AS (SELECT *, greatest(0, least(m, y)) AS py, greatest(0, least(n, x)) AS px FROM ({asked}), n), f AS (SELECT *, CAST(floor(py) AS BIGINT) AS i, CAST(floor(px) AS BIGINT) AS j, py - floor(py) AS fy, px - floor(px) AS fx FROM q), "
        f"g AS (SELECT f.* EXCLUDE (hs), {across('i')} * (1 - fy) + {across('least(m, i + 1)')} * fy AS ground FROM f)"
    )


#: The border, and all heights in order.
_BORDER = "n AS (SELECT max(r) AS m, max(c) AS n, list(h ORDER BY r, c) AS hs FROM v1)"
_DIRECTIONS = ", ".join(f"({k}, {d(x)}, {d(y)})" for k, (x, y) in enumerate(sample.DIRECTIONS[:4]))


@query(f"WITH {T.V1}, {_BORDER}, w(k, wx, wy) AS (VALUES {_DIRECTIONS}), s AS (SELECT CAST(unnest(range(1, 25)) * 25 AS DOUBLE) AS far), {_look_sql('SELECT r, c, h, k, far, r + wy * far / 30 AS y, c + wx * far / 30 AS x FROM v1, w, s')}, t AS (SELECT r, c, k, greatest(0, max(atan2(ground - h, far))) AS a FROM g GROUP BY r, c, k) SELECT r, c, round(avg(1 - sin(a)), 6) + 0.0 AS ao FROM t GROUP BY r, c")
def horizon_view(spark, sf_dir):
    """Openness of all cells by horizons in four directions, from bilinear heights."""
    cells = T.raster(spark, sf_dir)
    return rounded(sample.view_occlusion(cells, *size(cells), DX, DX, 4, horizon=True), "ao")


_KERNEL = ", ".join(f"({d(x)}, {d(y)}, {d(z)})" for x, y, z in sample.HEMISPHERE)
_CROSS = "SELECT *, {a}y * {b}z - {a}z * {b}y AS {o}x, {a}z * {b}x - {a}x * {b}z AS {o}y, {a}x * {b}y - {a}y * {b}x AS {o}z"


@query(
    f"WITH {T.V1}, {NORMALS}, {_BORDER}, k(kx, ky, kz) AS (VALUES {_KERNEL}), u AS (SELECT r, c, h, nx, ny, CASE WHEN nx = 0 AND ny = 0 AND nz = 0 THEN CAST(1 AS DOUBLE) ELSE nz END AS nz FROM norm), u1 AS (SELECT *, CASE WHEN abs(ny) < 0.9 THEN 0 ELSE 1 END::DOUBLE AS ux, CASE WHEN abs(ny) < 0.9 THEN 1 ELSE 0 END::DOUBLE AS uy, 0::DOUBLE AS uz FROM u), "
    f"u2 AS ({_CROSS.format(a='n', b='u', o='p')} FROM u1), u3 AS (SELECT r, c, h, nx, ny, nz, px / l AS tx, py / l AS ty, pz / l AS tz FROM (SELECT *, sqrt(px * px + py * py + pz * pz) AS l FROM u2)), u4 AS ({_CROSS.format(a='n', b='t', o='q')} FROM u3), "
    f"{_look_sql('SELECT r, c, h + (tz * kx + qz * ky + nz * kz) * 600 AS z, r + (ty * kx + qy * ky + ny * kz) * 600 / 30 AS y, c + (tx * kx + qx * ky + nx * kz) * 600 / 30 AS x FROM u4, k')}, s AS (SELECT r, c, greatest(0, least(1, (z - ground + 50) / 100)) AS s FROM g) SELECT r, c, round(avg(s * s * (3 - 2 * s)), 6) + 0.0 AS ao FROM s GROUP BY r, c"
)
def hemisphere_view(spark, sf_dir):
    """Openness of all cells by 16 samples on a hemisphere about the normal, from bilinear heights."""
    cells = T.raster(spark, sf_dir)
    return rounded(sample.view_occlusion(surface.normals(cells, DX, DX), *size(cells), DX, DX, 16), "ao")


@query(SQL["drift_gate"])
def drift_gate_stream(spark, sf_dir):
    """The drift gate as a stream over the whole track."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    return drift.gated(T.track(spark, sf_dir), THRESHOLD, f"{folder}/drift-{uuid.uuid4().hex}").select("user_id", "event_id", "x", "y")


_SHADED = (
    Q._ray_sql().split(" SELECT px, py, coalesce(")[0].replace("arg_min(h, k) AS z", "arg_min(h, k) AS z, arg_min(path.r, k) AS r, arg_min(path.c, k) AS c")
    + f", {NORMALS}, dark AS ({Q.rays_sql(Q.AZIMUTH, 'v1')}), crop AS (SELECT * FROM v1), layers AS ({Q._AO}), ao AS (SELECT r, c, CAST(sum(CAST(lit AS DECIMAL(18,9))) AS DOUBLE) / 16 AS ao FROM layers GROUP BY r, c), "
    + f"lights AS (SELECT norm.r, norm.c, round(({d(0.15)} * (1 + (ao - 1) * {d(0.8)}) + {d(1.0 - 0.15)} * greatest(CAST(0 AS DOUBLE), nx * {d(Q.SUN[0])} + ny * {d(Q.SUN[1])} + nz * {d(Q.SUN[2])})) * (0.5::DOUBLE + 0.5::DOUBLE * coalesce(lit, 1)), 6) AS light FROM norm JOIN ao ON ao.r = norm.r AND ao.c = norm.c LEFT JOIN dark ON dark.r = norm.r AND dark.c = norm.c) "
    + f"SELECT ray.px, ray.py, coalesce({Q._bgra('light', f'(k * {d(Q.STEP)})')}, CAST(4287090411 AS BIGINT)) AS bgra FROM ray LEFT JOIN (SELECT px, py, k, z, light FROM hit JOIN lights ON lights.r = hit.r AND lights.c = hit.c) USING (px, py)"
)


@query(_SHADED)
def render_shaded(spark, sf_dir):
    """The view with normals, cast shadow and occlusion of the cells that rays hit."""
    cells = T.raster(spark, sf_dir)
    m, n = size(cells)
    lit = shadow.azimuth_shadow(cells, m, n, Q.AZIMUTH, Q.ELEVATION, DX, DX, Q.PENUMBRA)
    layered = surface.normals(cells, DX, DX).join(lit, ["r", "c"]).join(shadow.ambient_occlusion(cells, m, n, DX, DX), ["r", "c"])
    hits = render.first_hit(render.rays(spark, Q.WIDTH, Q.HEIGHT, Q.VIEW), layered, Q.EYE, m, n, DX, DX, Q.STEP, Q.STEPS, ("nx", "ny", "nz", "lit", "ao"))
    return render.shaded_image(hits, Q.STEP, Q.SUN)
