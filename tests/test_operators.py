"""Operators against plain loops, properties and round trips."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.functions import geo
from orogen.operators import grid, pyramid, render, sample, shadow, surface, voids
from orogen.plans import tiles
from orogen.sources import files
from orogen.streaming import drift


def frame(spark, array):
    rows = [(r, c, None if np.isnan(array[r, c]) else float(array[r, c])) for r in range(array.shape[0]) for c in range(array.shape[1])]
    return spark.createDataFrame(rows, "r long, c long, h double")


def array(df, shape, name="h"):
    out = np.full(shape, np.nan)
    for row in df.collect():
        out[row["r"], row["c"]] = np.nan if row[name] is None else row[name]
    return out


HILLS = np.round(np.random.default_rng(3).normal(1500, 80, (9, 7)), 3)


def loop_shadow(h, azimuth, elevation, dx, dy, penumbra):
    dr, dc, metres = shadow.ray_steps(azimuth, dx, dy)
    out = np.ones(h.shape)
    for r, c in shadow.ray_starts(*h.shape, dr, dc):
        top, k = -math.inf, 0
        while True:
            i, j = math.floor(r + k * dr), math.floor(c + k * dc)
            if not (0 <= i < h.shape[0] and 0 <= j < h.shape[1]):
                break
            x = h[i, j] + k * metres * math.tan(elevation)
            if x < top:
                out[i, j] = max(0.0, 1 - (top - x) / penumbra)
            top, k = max(top, x), k + 1
    return out


@pytest.mark.parametrize("degrees", [0, 22.5, 90, 135, 180, 225, 242, 270, 315, 337.5])
def test_azimuth_shadow_is_the_loop(spark, degrees):
    got = shadow.azimuth_shadow(frame(spark, HILLS), 9, 7, math.radians(degrees), 0.4, 30.0, 30.0, 200.0)
    assert np.allclose(array(got, HILLS.shape, "lit"), loop_shadow(HILLS, math.radians(degrees), 0.4, 30.0, 30.0, 200.0))


def test_clock_angle_at_the_centre_is_that_of_sql(spark):
    from orogen.functions import viewer

    points = [(x, y) for x in (-1.0, 0.0, 0.5) for y in (-1.0, 0.0, 0.5)]
    got = spark.createDataFrame(points, "x double, y double").select("x", "y", viewer.clock_angle(F.col("x"), F.col("y"), 0.0, 0.0).alias("a")).collect()
    assert len(got) == 9 and all(math.isclose(r["a"], math.atan2(r["x"], -r["y"]) % math.tau) for r in got)


def test_sweep_across_strips_is_the_loop_and_runs_back_only(spark, monkeypatch):
    monkeypatch.setattr(voids, "STRIP", 4, raising=False)
    rng = np.random.default_rng(8)
    h = np.round(rng.normal(1500, 80, (23, 6)), 3)
    h[rng.random(h.shape) < 0.6] = np.nan
    h[3:14, 2] = h[:, 5] = np.nan
    got = voids.fill_sweep(frame(spark, h))
    # a frame that follows the row is gone through again for every row
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
    want = h.copy()
    for i, j in np.argwhere(np.isnan(h)):
        lines = (h[:i, j][::-1], h[i + 1 :, j], h[i, :j][::-1], h[i, j + 1 :])
        near = [x[~np.isnan(x)][0] for x in lines if (~np.isnan(x)).any()]
        want[i, j] = np.mean(near) if near else np.nan
    assert np.allclose(array(got, h.shape), want, rtol=1e-12, atol=0, equal_nan=True)


def test_points_of_large_views_are_not_broadcast(spark):
    view = render.camera(0.3, -1.4, math.radians(60), 64, 36)
    hits = lambda steps: render.first_hit(render.rays(spark, 64, 36, view), frame(spark, HILLS), (100.0, 130.0, 1900.0), 9, 7, 30.0, 30.0, 40.0, steps)
    plan = hits(1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "strategy=merge" not in hits(100)._jdf.queryExecution().optimizedPlan().toString()
    assert hits(250).filter("k is not null").collect() and sorted(hits(250).collect(), key=str) == sorted(hits(200).collect(), key=str)


@pytest.mark.parametrize("degrees", [0, 22.5, 90, 242, 315])
def test_shadow_across_tiles_is_the_loop_and_joins_no_rays(spark, degrees, monkeypatch):
    monkeypatch.setattr(shadow, "_tiling", lambda rows, columns: (5, 4), raising=False)
    h = np.round(np.random.default_rng(4).normal(1500, 300, (33, 14)), 3)
    got = shadow.azimuth_shadow(frame(spark, h), 33, 14, math.radians(degrees), 0.2, 30.0, 30.0, 200.0)
    # rays times cells were once one side of a join, taken for small and gathered by the driver
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert np.array_equal(array(got, h.shape, "lit"), loop_shadow(h, math.radians(degrees), 0.2, 30.0, 30.0, 200.0))


def test_occlusion_across_tiles_is_the_mean_of_loops(spark, monkeypatch):
    monkeypatch.setattr(shadow, "_tiling", lambda rows, columns: (7, 5), raising=False)
    h = np.round(np.random.default_rng(5).normal(1500, 300, (20, 11)), 3)
    got = shadow.ambient_occlusion(frame(spark, h), 20, 11, 30.0, 30.0)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    loops = [loop_shadow(h, k * math.tau / 16, math.radians(10), 30.0, 30.0, 200.0) for k in range(16)]
    assert np.allclose(array(got, h.shape, "ao"), np.mean(loops, axis=0), rtol=0, atol=1e-8)


def test_whole_occlusion_query_across_tiles_joins_no_rays(spark, monkeypatch, tmp_path):
    from orogen.plans.queries import QUERIES
    from orogen.sources import tables

    monkeypatch.setattr(shadow, "_tiling", lambda rows, columns: (9, 5), raising=False)
    vectors = np.random.default_rng(6).normal(0, 0.2, (40, 12)).astype("f4").tolist()
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["ao_whole"](spark, str(tmp_path))
    # a join of the rays of all azimuths with cells took the driver's memory at 6 times sf0.1
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    h = array(tables.raster(spark, str(tmp_path)), (40, 12))
    loops = [loop_shadow(h, k * math.tau / 16, math.radians(10), 30.0, 30.0, 200.0) for k in range(16)]
    assert got.count() == h.size and np.allclose(array(got, h.shape, "ao"), np.mean(loops, axis=0), rtol=0, atol=1e-6)


def test_flat_ground_is_open_and_upright(spark):
    flat = frame(spark, np.full((6, 6), 100.0))
    assert set(array(shadow.ambient_occlusion(flat, 6, 6, 30.0, 30.0), (6, 6), "ao").ravel()) == {1.0}
    n = surface.normals(flat, 30.0, 30.0).filter("r BETWEEN 1 AND 4 AND c BETWEEN 1 AND 4").collect()
    assert {(x["nx"], x["ny"], x["nz"]) for x in n} == {(0.0, 0.0, 1.0)}


@pytest.mark.parametrize("shape", [(1, 1), (1, 5), (5, 1)])
def test_thin_rasters(spark, shape):
    h = np.arange(shape[0] * shape[1], dtype=float).reshape(shape)
    df = frame(spark, h)
    assert (array(shadow.west_shadow(df, 30.0, 1.0), shape, "lit") == 1).all()
    assert array(shadow.azimuth_shadow(df, *shape, 1.0, 0.5, 30.0, 30.0, 200.0), shape, "lit").shape == shape
    assert {x["nz"] for x in surface.normals(df, 30.0, 30.0).collect()} == {0.0}


def loop_fill(h):
    h = h.copy()
    for i, j in np.argwhere(np.isnan(h)):
        near = [x[~np.isnan(x)][:1] for x in (h[:i, j][::-1], h[i + 1 :, j], h[i, :j][::-1], h[i, j + 1 :])]
        near = np.concatenate(near)
        if len(near):
            h[i, j] = near.mean()
    return h


def test_fills(spark):
    h = HILLS.copy()
    h[0, 0] = h[2, 1:5] = h[8, 6] = np.nan
    got = voids.fill_sequential(frame(spark, h).withColumn("raster_id", F.lit("a")))
    assert np.allclose(array(got, h.shape), loop_fill(h))
    assert not np.isnan(array(voids.fill_sweep(frame(spark, h)), h.shape)).any()
    empty = frame(spark, np.full((3, 3), np.nan))
    assert voids.fill_sweep(empty).filter("h IS NOT NULL").count() == 0


def test_pyramids(spark):
    df = frame(spark, HILLS)
    top = pyramid.max_pyramid(df, 9, 7, 3, "ceil").filter("level = 3").collect()
    assert max(x["h"] for x in top) == HILLS.max()
    assert pyramid.max_pyramid(df, 9, 7, 1).count() == 12
    assert pyramid.downsample(df, [50]).collect()[0]["h"] == pytest.approx(HILLS.mean())
    assert pyramid.factor(32, 30) == 2


def test_windows(spark):
    df = frame(spark, HILLS)
    once = grid.crop(df, 2, 1, 5, 4)
    assert np.array_equal(array(grid.crop(once, 1, 1, 2, 2), (2, 2)), HILLS[3:5, 2:4])
    assert grid.crop(df, 100, 100, 5, 5).count() == 0
    ones = [(df.filter("r < 4"), 0, 0), (df.filter("r >= 4"), 0, 0)]
    assert np.array_equal(array(grid.stitch(ones, 9, 7), HILLS.shape), array(grid.stitch(ones[::-1], 9, 7), HILLS.shape))
    with pytest.raises(Exception, match="north-west"):
        grid.assemble(spark.createDataFrame([(1, 1, 0, 0, 1.0)], "tr long, tc long, r long, c long, h double"), 1, 1).collect()


def test_samples_at_cells(spark):
    pts = spark.createDataFrame([(1, 3.0, 2.0), (2, 0.0, 0.0)], "id long, x double, y double")
    for f in (sample.bilinear, sample.bicubic):
        got = {r["id"]: r["value"] for r in f(pts, frame(spark, HILLS), 9, 7).collect()}
        assert got == pytest.approx({1: HILLS[2, 3], 2: HILLS[0, 0]})


def test_adaptive_march(spark):
    d = np.array([[0.0, 0.6, -0.8], [0.0, 0.0, 1.0]])
    t = render.march(np.zeros((50, 50)), (100.0, 100.0, 80.0), d, 10.0, 10.0, 1000.0, 0.5)
    assert abs(t[0] - 100) < 1 and np.isnan(t[1])


def test_tiles(spark):
    squares = spark.createDataFrame([(1, 50000.0, 50000.0, 1000.0), (2, 25000.0, 25000.0, 25000.0)], "id long, e double, n double, radius double")
    names = [f"CRS3035RES50000mN{n}E{e}.tif" for n in (0, 50000) for e in (0, 50000)] + ["other.tif"]
    got = tiles.overlapping(spark.createDataFrame([(p,) for p in names], "path string"), squares).collect()
    assert sum(r["id"] == 1 for r in got) == 4 and [r["path"] for r in got if r["id"] == 2] == [names[0]]
    assert tiles.manifest(spark, 47, 11, extra=("a", "b", "c")).count() == 28


def test_labels(spark):
    row = spark.range(1).select(geo.calendar_label(F.lit(365)).alias("a"), geo.calendar_label(F.lit(60)).alias("b"), geo.wrapped_day(F.lit(0)).alias("c"), geo.wrapped_hour(F.lit(-1)).alias("d")).first()
    assert tuple(row) == ("Dec 31", "Mar 1", 365, 23)


def test_bil_and_tiff(spark, tmp_path):
    grid_ = np.array([[1, 2, -32767], [4, 5, 6]], "<i2")
    (tmp_path / "a.bil").write_bytes(grid_.tobytes())
    keys = {"BYTEORDER": "I", "NROWS": 2, "NCOLS": 3, "NODATA": -32767, "ULXMAP": 11, "ULYMAP": 48, "XDIM": 0.1, "YDIM": 0.1}
    (tmp_path / "a.hdr").write_text("\n".join(f"{k} {v}" for k, v in keys.items()))
    got = array(files.read_bil(spark, str(tmp_path)), (2, 3))
    assert np.isnan(got[0, 2]) and got[1, 2] == 6
    assert files.header(spark, str(tmp_path / "a.hdr")).first()["values"]["NROWS"] == "2"
    with pytest.raises(ValueError, match="NROWS"):
        files.parse_header("BYTEORDER I")
    coarse = HILLS[::2, ::2]
    (tmp_path / "a.tif").write_bytes(files.write_tiff([HILLS, coarse], 30.0, 4e6, 2e6, 3035))
    path = str(tmp_path / "a.tif")
    assert np.allclose(array(files.read_geotiff(spark, path), HILLS.shape), HILLS, atol=1e-3)
    part = files.read_geotiff(spark, path, 0, (3, 2, 4, 3)).collect()
    assert len(part) == 12 and min(r["r"] for r in part) == 3
    meta = files.tiff_metadata(spark, path).orderBy("ifd").collect()
    assert [r["rows"] for r in meta] == [9, 5] and meta[0]["epsg"] == 3035 and meta[0]["scale"] == 30.0


def test_store_prunes(spark, tmp_path):
    path = str(tmp_path / "store")
    files.write_store(frame(spark, HILLS), path, 4)
    part = files.read_store(spark, path, (4, 0, 3, 3), 4)
    assert part.count() == 9
    assert "PartitionFilters: [isnotnull(chunk_r" in part._jdf.queryExecution().toString()


def test_stream_is_the_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(u, f"2024-01-01 00:{k:02d}:00", k, float(x), float(y)) for u in range(3) for k, (x, y) in enumerate(rng.normal(0, 50, (30, 2)).cumsum(axis=0))]
    track = spark.createDataFrame(rows, "user_id long, ts string, event_id long, x double, y double").withColumn("ts", F.to_timestamp("ts"))
    track.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(track.schema).parquet(str(tmp_path / "in"))
    q = drift.drift_stream(stream, 80.0).writeStream.format("memory").queryName("gate").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = drift.drift_gate(track, 80.0)
    assert sorted((r["user_id"], r["event_id"]) for r in spark.table("gate").collect()) == sorted((r["user_id"], r["event_id"]) for r in want.collect())


def test_whole_rasters(spark):
    from orogen.plans.queries import QUERIES
    from orogen.sources import tables

    sf = "/root/testdata/sf0.001"
    h = array(tables.raster(spark, sf), (500, 64))
    ao = np.mean([loop_shadow(h, k * math.tau / 16, math.radians(10), 30.0, 30.0, 200.0) for k in range(16)], axis=0)
    assert np.allclose(array(QUERIES["ao_whole"](spark, sf), h.shape, "ao"), ao, atol=2e-6)
    tiled = h.copy()
    tiled[167:334, 44:] = 0
    assert np.array_equal(array(QUERIES["assemble_whole"](spark, sf), h.shape), tiled)
    v = array(tables.raster_with_voids(spark, sf), h.shape)
    want = np.full(h.shape, np.nan)
    want[:250] = v[:250]
    moved = np.full(h.shape, np.nan)
    moved[187 - 31 : 376 - 31, 3:] = v[187:376, :-3] + 1
    last = np.full(h.shape, np.nan)
    last[312:] = v[312:] + 2
    for part in (moved, last):
        want = np.where(np.isnan(part), want, part)
    assert np.allclose(array(QUERIES["stitch_whole"](spark, sf), h.shape), want, equal_nan=True)


def _tiff(grid, tile, compression, predictor, order="<"):
    """A float TIFF in tiles or strips, written tag by tag."""
    import zlib

    rows, columns = grid.shape
    high, wide = tile or (5, columns)

    def packed(block):
        if predictor == 3:
            planes = np.ascontiguousarray(block.astype(">f4")).view(np.uint8).reshape(block.shape[0], block.shape[1], 4).transpose(0, 2, 1).reshape(block.shape[0], -1)
            raw = np.diff(planes, axis=1, prepend=np.zeros((len(planes), 1), np.uint8)).astype(np.uint8).tobytes()
        elif predictor == 2:
            raw = np.diff(block.astype("<f4").view("<u4"), axis=1, prepend=np.uint32(0)).astype(order + "u4").tobytes()
        else:
            raw = block.astype(order + "f4").tobytes()
        return zlib.compress(raw) if compression == 8 else lzw(raw) if compression == 5 else raw

    def lzw(raw):
        table, bits, n, width, last = {bytes([k]): k for k in range(256)}, 256, 9, 9, b""
        size = 258
        for k in range(len(raw)):
            if last + raw[k : k + 1] in table:
                last += raw[k : k + 1]
                continue
            bits, n = bits << width | table[last], n + width
            table[last + raw[k : k + 1]], size, last = size, size + 1, raw[k : k + 1]
            width = 9 if size < 511 + 1 else 10 if size < 1024 else 11 if size < 2048 else 12
            if size >= 4094:
                bits, n = bits << width | 256, n + width
                table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        bits, n = bits << width | table[last], n + width
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        bits, n = bits << width | 257, n + width
        return (bits << -n % 8).to_bytes(-(-n // 8), "big")

    blocks = []
    for a in range(0, rows, high):
        for b in range(0, columns, wide):
            part = grid[a : a + high, b : b + wide]
            blocks.append(packed(np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]))) if tile else part))
    head = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8)
    where = (322, 323, 324, 325) if tile else (None, 278, 273, 279)
    text = b'PROJCS["Some system"]|'
    tags = [(256, 4, [columns]), (257, 4, [rows]), (258, 3, [32]), (259, 3, [compression]), (277, 3, [1]), (317, 3, [predictor]), (339, 3, [3]), (33550, 12, [30.0, 30.0, 0.0]), (33922, 12, [0.0, 0, 0, 1000.0, 9000.0, 0]), (34735, 3, [1, 1, 0, 2, 3072, 0, 1, 3035, 3073, 34737, len(text), 0]), (34737, 2, [text])]
    tags += [(where[0], 4, [wide])] * bool(tile) + [(where[1], 4, [high]), (where[2], 4, None), (where[3], 4, [len(x) for x in blocks])]
    tags.sort(key=lambda x: x[0])
    extra, entries = 8 + 2 + 12 * len(tags) + 4, b""
    tail = bytearray()
    starts = None
    for turn in range(2):
        entries, tail = b"", bytearray()
        for tag, kind, values in tags:
            values = values if values is not None else starts or [0] * len(blocks)
            raw = values[0] if kind == 2 else struct.pack(order + {3: "H", 4: "I", 12: "d"}[kind] * len(values), *values)
            count = len(raw) if kind == 2 else len(values)
            if len(raw) > 4:
                place = extra + len(tail)
                tail += raw
                raw = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
        at = extra + len(tail)
        starts = [at + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    return head + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + bytes(tail) + b"".join(blocks)


@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("compression, predictor, order", [(1, 1, "<"), (1, 1, ">"), (8, 1, "<"), (8, 2, "<"), (8, 3, ">"), (5, 1, "<"), (5, 2, "<"), (5, 3, "<")])
def test_geotiff_forms(spark, tmp_path, tile, compression, predictor, order):
    grid = np.cumsum(np.random.default_rng(3).normal(0, 3, (37, 70)), axis=1).astype(np.float32) + 1500
    content = _tiff(grid, tile, compression, predictor, order)
    assert np.array_equal(files.tiff_window(content)[0], grid)
    part, r, c = files.tiff_window(content, 0, (10, 20, 22, 33))
    assert (r, c) == (10, 20) and np.array_equal(part, grid[10:32, 20:53])
    if compression == 8 and predictor == 3:
        (tmp_path / "a.tif").write_bytes(content)
        meta = files.tiff_metadata(spark, str(tmp_path / "a.tif")).first().asDict()
        assert (meta["rows"], meta["columns"], meta["epsg"], meta["wkt"]) == (37, 70, 3035, 'PROJCS["Some system"]')
        window = files.window_around(meta, 1000 + 30 * 30.0, 9000 - 15 * 30.0, 120.0)
        assert window == (11, 26, 8, 8)
        again = files.rebased(meta, window)
        assert (again["x0"], again["y0"]) == (1000 + 26 * 30.0, 9000 - 11 * 30.0)
        cells = files.read_geotiff(spark, str(tmp_path / "a.tif"), window=window)
        assert cells.count() == 64 and cells.filter("r = 11 AND c = 26").first()["h"] == float(grid[11, 26])
        with pytest.raises(ValueError):
            files.window_around(meta, 0.0, 0.0, 10.0)


def test_tiles_below_a_folder(spark, tmp_path):
    for name in ("x/y/CRS3035RES50000mN100000E200000.tif", "x/CRS3035RES50000mN150000E200000.tif", "x/other.tif"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = sorted((r["n"], r["e"], r["first"]) for r in files.tile_files(spark, str(tmp_path)).collect())
    assert got == [(100000, 200000, False), (150000, 200000, True)]


def test_overview_cache_is_kept_while_fresh(spark, tmp_path):
    import os

    path = tmp_path / "a.tif"
    path.write_bytes(files.write_tiff([np.arange(40 * 40, dtype=np.float32).reshape(40, 40)], 2.0, 0.0, 0.0, 3035))
    said = []
    first = files.overview_cache(spark, str(path), lambda share, what: said.append(what))
    assert {r["factor"] for r in first.select("factor").distinct().collect()} == {4, 16} and said[-1] == "overview cache built"
    files.overview_cache(spark, str(path), lambda share, what: said.append(what))
    assert said[-1] == "overview cache hit"
    os.utime(path, (2e9, 2e9))
    files.overview_cache(spark, str(path), lambda share, what: said.append(what))
    assert said[-1] == "overview cache built"
    path.write_bytes(files.write_tiff([np.ones((4, 4), np.float32)], 25.0, 0.0, 0.0, 3035))
    assert files.overview_cache(spark, str(path)) is None


def test_projections_return(spark):
    from orogen.functions import crs

    points = spark.createDataFrame([(47.0 + k / 7, 10.0 + k / 3) for k in range(12)], "lat double, lon double")
    for epsg in (4326, 3035, 31287):
        x, y = crs.from_wgs84(F.col("lat"), F.col("lon"), epsg)
        there = points.select("lat", "lon", x.alias("x"), y.alias("y"))
        lat, lon = crs.to_wgs84(F.col("x"), F.col("y"), epsg)
        assert there.filter((F.abs(lat - F.col("lat")) > 1e-7) | (F.abs(lon - F.col("lon")) > 1e-7)).count() == 0
    lat, lon = crs.from_lambert(np.array([400000.0]), np.array([400000.0]))
    assert math.degrees(lat[0]) == pytest.approx(47.5, abs=1e-9) and math.degrees(lon[0]) == pytest.approx(13 + 1 / 3, abs=1e-9)
    with pytest.raises(ValueError):
        crs.to_wgs84(F.lit(0.0), F.lit(0.0), 1)


def test_windows_follow_a_viewer(spark, tmp_path):
    from datetime import datetime

    from orogen.streaming import tiers

    h = np.add.outer(np.arange(60.0), np.arange(50.0) * 2)
    h[30, 20] += 500
    cells, meta = frame(spark, h), {"rows": 60, "columns": 50, "scale": 30.0, "x0": 1000.0, "y0": 9000.0}
    sun = (math.radians(270), math.radians(20))
    got, found = tiers.window(cells, meta, 1000 + 20.5 * 30, 9000 - 30.5 * 30, 300.0, sun)
    assert (found["rows"], found["columns"], found["centre_e"]) == (21, 21, 1615.0)
    assert got.count() == 21 * 21 and got.filter("h = 570").select("r", "c").first() == (10, 10)
    assert got.filter("r = 10 AND c = 11").first()["lit"] < 1 and got.filter("ao < 1").count() > 0
    assert tiers.window(cells, meta, 1100.0, 8900.0, 3000.0, (0.0, -0.1), False, 16)[1] | {"x0": 0, "y0": 0} == {"rows": 16, "columns": 16, "scale": 30.0, "x0": 0, "y0": 0, "centre_e": 1100.0, "centre_n": 8900.0}
    track = spark.createDataFrame([(u, datetime(2024, 1, 1, 0, k), k, 1300.0 + 100 * k * u, 8500.0) for u in (1, 2) for k in range(4)], "user_id long, ts timestamp, event_id long, x double, y double")
    track.coalesce(1).write.parquet(str(tmp_path / "in"))
    said = []
    gate = drift.drift_stream(spark.readStream.schema(track.schema).parquet(str(tmp_path / "in")), 150.0)
    load = lambda e, n: tiers.window(cells, meta, e, n, 120.0, sun, False)
    tiers.follow(gate, load, str(tmp_path / "out"), str(tmp_path / "cp"), report=said.append).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in kept.select("key", "centre_e").distinct().collect()) == [(1, 1500.0), (2, 1900.0)] and len(said) == 2


def test_newer_generations_pass_and_older_are_stale(spark, tmp_path):
    from datetime import datetime

    rows = [(1, datetime(2024, 1, 1, 0, k), k, float(x), 0.0, g) for k, (x, g) in enumerate([(0, 0), (10, 0), (500, 0), (510, 1), (520, 1), (900, 0), (530, 2)])]
    track = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, x double, y double, generation long")
    assert sorted(r["event_id"] for r in drift.gated(track, 100.0, str(tmp_path)).collect()) == [0, 2, 3, 6]


def test_fine_windows_come_from_tiles(spark, tmp_path):
    from orogen.streaming import tiers

    h = np.random.default_rng(5).normal(1500, 10, (50, 100)).astype(np.float32)
    for k in range(2):
        (tmp_path / f"CRS3035RES50000mN0E{50000 * k}.tif").write_bytes(files.write_tiff([h[:, 50 * k : 50 * k + 50]], 1000.0, 50000.0 * k, 50000.0, 3035))
    got, meta = tiers.fine_window(spark, str(tmp_path), 50000.0, 25000.0, 5000.0)
    assert (meta["x0"], meta["y0"]) == (45000.0, 30000.0)
    out = array(got, (meta["rows"], meta["columns"]))
    assert np.array_equal(out[:10, :10], h[20:30, 45:55])
    assert tiers.fine_window(spark, str(tmp_path), 500000.0, 25000.0, 5000.0) is None


def test_neighbourhood_by_a_loader(spark):
    tile = lambda a, b: None if (a, b) == (47, 12) else frame(spark, np.full((2, 3), a * 100.0 + b))
    out = array(grid.load_neighbourhood(tile, 47, 11, 2, 3), (6, 9))
    assert out[0, 0] == 4810 and out[5, 8] == 4612 and out[2, 6] == 0 and out[2, 3] == 4711


def test_settings_timing_and_footprints(spark, tmp_path):
    from orogen.functions import host

    path = str(tmp_path / "s.toml")
    assert host.Settings.load(path) == host.Settings()
    host.Settings(vat_mode=3, tile_5m_path='a "b"\\c', fog_enabled=False).save(path)
    assert host.Settings.load(path) == host.Settings(vat_mode=3, tile_5m_path='a "b"\\c', fog_enabled=False)
    (tmp_path / "s.toml").write_text("vat_mode = 'x'\nlod_mode = 2\n")
    assert host.Settings.load(path) == host.Settings(lod_mode=2)
    said = []
    assert host.timed("work", said.append)(lambda x: x + 1)(2) == 3 and said[0].startswith("work,") and len(said) == 2
    (tmp_path / "a.kml").write_text("<kml><Document><Placemark><name>A</name><styleUrl>#s</styleUrl><Polygon><outerBoundaryIs><LinearRing><coordinates>1,2,0 3,4.5,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>")
    row = host.placemarks(spark, str(tmp_path / "a.kml")).first()
    assert row["name"] == "A" and [tuple(p) for p in row["points"]] == [(1.0, 2.0), (3.0, 4.5)]
