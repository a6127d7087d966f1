"""Raster files: headers, BIL grids, float GeoTIFFs, directories of tiles, overview caches, and a chunked Parquet store."""

from __future__ import annotations

import math
import os
import shutil
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.functions.geo import tile_corner
from orogen.functions.viewer import overview_factors
from orogen.operators.pyramid import downsample

CELLS = "path string, r long, c long, h double"
REQUIRED = ("BYTEORDER", "NROWS", "NCOLS", "NODATA", "ULXMAP", "ULYMAP", "XDIM", "YDIM")


def parse_header(text: str) -> dict[str, str]:
    """Key and value of each line; ValueError if a required key is missing."""
    found = {p[0]: p[1] for line in text.splitlines() if len(p := line.split()) >= 2}
    if lost := [k for k in REQUIRED if k not in found]:
        raise ValueError(f"header without {lost[0]}")
    return found


def header(spark: SparkSession, path: str) -> DataFrame:
    """A .hdr file as one map: values."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= 2)
    return lines.agg(F.map_from_entries(F.collect_list(F.struct(F.col("p")[0], F.col("p")[1]))).alias("values"))


def _rows(path: str, grid: np.ndarray, row: int = 0, column: int = 0):
    """Cells of a grid in batches of whole rows."""
    step = max(1, 262_144 // max(1, grid.shape[1]))
    for a in range(0, grid.shape[0], step):
        part = grid[a : a + step]
        r, c = np.divmod(np.arange(part.size), part.shape[1])
        h = pa.array(part.ravel().astype(float), from_pandas=True)
        yield pa.RecordBatch.from_arrays([pa.array([path] * part.size), pa.array(r + a + row), pa.array(c + column), h], ["path", "r", "c", "h"])


def read_bil(spark: SparkSession, path: str) -> DataFrame:
    """16-bit BIL grids (with the .hdr beside each) as cells; the nodata value becomes null."""
    heads = spark.read.text(f"{path}/*.hdr", wholetext=True).select(F.regexp_replace(F.input_file_name(), r"\.hdr$", "").alias("name"), F.col("value").alias("head"))
    data = spark.read.format("binaryFile").load(f"{path}/*.bil").select(F.regexp_replace("path", r"\.bil$", "").alias("stem"), "content")
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    both = data.join(heads, plain(F.col("stem")) == plain(F.col("name")))

    def decode(batches):
        for batch in batches:
            for name, head, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                meta = parse_header(head.as_py())
                rows, columns, nodata = (int(meta[k]) for k in ("NROWS", "NCOLS", "NODATA"))
                raw = content.as_buffer()
                if raw.size != rows * columns * 2:
                    raise ValueError(f"{name}: {raw.size} bytes for {rows} x {columns} samples")
                grid = np.frombuffer(raw, "<i2" if meta["BYTEORDER"] == "I" else ">i2").reshape(rows, columns).astype(float)
                yield from _rows(name.as_py(), np.where(grid == nodata, np.nan, grid))

    return both.select("stem", "head", "content").mapInArrow(decode, CELLS)


def tiff_levels(content: bytes) -> list[dict[int, tuple]]:
    """Tags of each image directory of a classic TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(content[:2]))
    if order is None or struct.unpack_from(order + "H", content, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    kinds = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d"}
    out, at = [], struct.unpack_from(order + "I", content, 4)[0]
    while at:
        tags: dict = {"order": order}
        (n,) = struct.unpack_from(order + "H", content, at)
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", content, at + 2 + 12 * k)
            form = kinds.get(kind)
            if form is None:
                continue
            form = f"{count}s" if form == "s" else form * count
            size = struct.calcsize(order + form)
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", content, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(order + form, content, place)
        out.append(tags)
        (at,) = struct.unpack_from(order + "I", content, at + 2 + 12 * n)
    return out


def lzw_decode(data: bytes) -> bytes:
    """TIFF LZW: codes of 9 to 12 bits, the first bit leading; 256 clears the table, 257 ends."""
    table: list[bytes] = [bytes([k]) for k in range(256)] + [b"", b""]
    out, bits, have, width, last = bytearray(), 0, 0, 9, b""
    for byte in bytes(data):
        bits, have = (bits << 8 | byte) & 0xFFFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("broken LZW data")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        size = len(table) + 1  # the writer's table is one entry ahead
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return bytes(out)


#: Compression tags that are read.
PLAIN, LZW, DEFLATE = (1,), (5,), (8, 32946)


def tiff_block(raw: bytes, order: str, rows: int, columns: int, compression: int, predictor: int) -> np.ndarray:
    """Samples of a strip or tile of 32-bit floats."""
    if compression in LZW:
        raw = lzw_decode(raw)
    elif compression in DEFLATE:
        raw = zlib.decompress(raw)
    elif compression not in PLAIN:
        raise ValueError(f"compression {compression} is not read")
    if len(raw) < rows * columns * 4:
        raise ValueError("a strip or tile ends early")
    raw = raw[: rows * columns * 4]
    if predictor == 1:
        return np.frombuffer(raw, order + "f4").reshape(rows, columns)
    if predictor == 2:
        steps = np.frombuffer(raw, order + "u4").reshape(rows, columns)
        return np.cumsum(steps, axis=1, dtype=np.uint32).view(np.float32)
    if predictor == 3:  # bytes in planes, the leading first, as differences along the line
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, columns * 4), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(rows, 4, columns).transpose(0, 2, 1)).view(">f4")[..., 0]
    raise ValueError(f"predictor {predictor} is not read")


def tiff_window(content: bytes, level: int = 0, window: tuple[int, int, int, int] | None = None) -> tuple[np.ndarray, int, int]:
    """Samples of a 32-bit float image in a window (row, column, rows, columns): plain, LZW or Deflate, in strips or tiles.

    Only strips and tiles that overlap the window are decoded.  Returns samples and the first row and column.
    """
    tags = tiff_levels(content)[level]
    columns, rows = tags[256][0], tags[257][0]
    if tags.get(258, (32,))[0] != 32 or tags.get(339, (3,))[0] != 3 or tags.get(277, (1,))[0] != 1:
        raise ValueError("only images of one 32-bit float sample are read")
    r0, c0, m, n = window or (0, 0, rows, columns)
    r1, c1 = min(rows, r0 + m), min(columns, c0 + n)
    r0, c0 = max(0, r0), max(0, c0)
    if r1 <= r0 or c1 <= c0:
        raise ValueError("empty window")
    tiled = 324 in tags
    high, wide = (tags[323][0], tags[322][0]) if tiled else (tags.get(278, (rows,))[0], columns)
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags.get(279))
    across = -(-columns // wide)
    out = np.empty((r1 - r0, c1 - c0))
    for i in range(r0 // high, (r1 - 1) // high + 1):
        held = high if tiled else min(high, rows - i * high)
        for j in range(c0 // wide, (c1 - 1) // wide + 1):
            at, size = places[i * across + j], sizes[i * across + j] if sizes else held * wide * 4
            block = tiff_block(bytes(content[at : at + size]), tags["order"], held, wide, tags.get(259, (1,))[0], tags.get(317, (1,))[0])
            a, b, e, f = max(r0, i * high), min(r1, (i + 1) * high), max(c0, j * wide), min(c1, (j + 1) * wide)
            out[a - r0 : b - r0, e - c0 : f - c0] = block[a - i * high : b - i * high, e - j * wide : f - j * wide]
    return out, r0, c0


def window_around(meta: dict, e: float, n: float, radius: float) -> tuple[int, int, int, int]:
    """The window (row, column, rows, columns) of a square of ``radius`` about a position; meta as tiff_metadata gives it.

    ValueError if none of it is on the image.
    """
    scale = meta["scale"]
    c0, c1 = math.floor((e - radius - meta["x0"]) / scale), math.ceil((e + radius - meta["x0"]) / scale)
    r0, r1 = math.floor((meta["y0"] - n - radius) / scale), math.ceil((meta["y0"] - n + radius) / scale)
    r0, c0, r1, c1 = max(0, r0), max(0, c0), min(meta["rows"], r1), min(meta["columns"], c1)
    if r1 <= r0 or c1 <= c0:
        raise ValueError("empty window")
    return r0, c0, r1 - r0, c1 - c0


def rebased(meta: dict, window: tuple[int, int, int, int]) -> dict:
    """Metadata of a window: its size and its own origin."""
    r, c, m, n = window
    return {**meta, "rows": m, "columns": n, "x0": meta["x0"] + c * meta["scale"], "y0": meta["y0"] - r * meta["scale"]}


def read_geotiff(spark: SparkSession, path: str, level: int = 0, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Float GeoTIFFs as cells; NaN and heights below -1000 are null, in windows also exact 0."""

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                grid, r0, c0 = tiff_window(memoryview(content.as_buffer()), level, window)
                void = (grid < -1000) | ((grid == 0) if window else False)
                yield from _rows(name.as_py(), np.where(void, np.nan, grid), r0, c0)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, CELLS)


def tiff_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Per image directory: path, ifd, rows, columns, scale, x0, y0, epsg, wkt (0 scale and null keys where absent)."""

    def describe(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                levels = tiff_levels(memoryview(content.as_buffer()))
                base = levels[0].get(33550, (0.0,))[0]
                tie = levels[0].get(33922, (0.0,) * 6)
                keys = levels[0].get(34735, ())
                epsg = [keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k] in (2048, 3072)]
                wkt = geo_text(keys, levels[0].get(34737, (b"",))[0])
                for k, tags in enumerate(levels):
                    out.append((name.as_py(), k, tags[257][0], tags[256][0], base * levels[0][256][0] / tags[256][0], tie[3], tie[4], epsg[-1] if epsg else None, wkt))
            names = ["path", "ifd", "rows", "columns", "scale", "x0", "y0", "epsg", "wkt"]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 9, kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(describe, "path string, ifd int, rows long, columns long, scale double, x0 double, y0 double, epsg int, wkt string")


#: How the text of a reference system begins.
SYSTEMS = ("PROJCS[", "GEOGCS[", "PROJCRS[", "GEODCRS[")


def geo_text(keys: tuple, text: bytes) -> str | None:
    """The reference system in the ASCII parameters that keys 3073 or 2049 point to, if it is one."""
    for k in range(4, len(keys) - 3, 4):
        if keys[k] in (3073, 2049) and keys[k + 1] == 34737:
            found = bytes(text)[keys[k + 3] : keys[k + 3] + keys[k + 2]].decode("ascii", "replace").rstrip("|\0 ")
            if found.startswith(SYSTEMS):
                return found
    return None


def tile_files(spark: SparkSession, path: str) -> DataFrame:
    """Files named like 50 km tiles below a folder: path, n, e, first (whether it is the first by path)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif").load(path).select("path")
    n, e = tile_corner(F.col("path"))
    found = files.select("path", n.alias("n"), e.alias("e")).filter("n is not null")
    return found.join(F.broadcast(found.agg(F.min("path").alias("least"))), F.lit(True), "left").select("path", "n", "e", (F.col("path") == F.col("least")).alias("first"))


def overview_cache(spark: SparkSession, path: str, report=lambda share, what: None) -> DataFrame | None:
    """The cached levels of a file (factor, r, c, h), built unless they are at least as recent as it is; None if it needs none.

    The cache is a Parquet table beside the file, written under another name first.  A folder that can't be written
    gives the levels without a cache.
    """
    meta = tiff_metadata(spark, path).orderBy("ifd").collect()
    scale = meta[0]["scale"]
    factors = spark.range(1).select(overview_factors(F.lit(float(scale)), F.lit(len(meta))).alias("f")).first()["f"] if scale else None
    if not factors:
        return None
    plain = path.removeprefix("file://")
    cache = os.path.join(os.path.dirname(plain), f".tmp_levels_{os.path.basename(plain)}")
    if os.path.exists(cache) and os.path.getmtime(cache) >= os.path.getmtime(plain):
        report(1.0, "overview cache hit")
        return spark.read.parquet(f"file://{cache}")
    report(0.0, "building overview cache")
    levels = downsample(read_geotiff(spark, path).select("r", "c", "h"), list(factors))
    if not os.access(os.path.dirname(cache), os.W_OK):
        return levels
    levels.write.mode("overwrite").parquet(f"file://{cache}.part")
    if os.path.exists(cache):
        shutil.rmtree(cache)
    os.rename(f"{cache}.part", cache)
    report(1.0, "overview cache built")
    return spark.read.parquet(f"file://{cache}")


def write_tiff(levels: list[np.ndarray], scale: float, x0: float, y0: float, epsg: int) -> bytes:
    """Float images, finest first, as one classic TIFF; georeference in the first directory."""
    body, at = bytearray(b"II" + struct.pack("<HI", 42, 0)), 4
    for k, grid in enumerate(levels):
        data = len(body)
        body += grid.astype("<f4").tobytes()
        tags = [(256, 4, (grid.shape[1],)), (257, 4, (grid.shape[0],)), (258, 3, (32,)), (259, 3, (1,)), (262, 3, (1,)), (273, 4, (data,)), (277, 3, (1,)), (278, 4, (grid.shape[0],)), (279, 4, (grid.nbytes // grid.itemsize * 4,)), (339, 3, (3,))]
        if k == 0:
            tags += [(33550, 12, (scale, scale, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x0, y0, 0.0)), (34735, 3, (1, 1, 0, 1, 3072, 0, 1, epsg))]
        entries = b""
        for tag, kind, values in tags:
            raw = struct.pack("<" + {3: "H", 4: "I", 12: "d"}[kind] * len(values), *values)
            if len(raw) > 4:
                place, raw = len(body), raw
                body += raw
                raw = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", body, at, len(body))
        body += struct.pack("<H", len(tags)) + entries
        at = len(body)
        body += struct.pack("<I", 0)
    return bytes(body)


def write_store(cells: DataFrame, path: str, chunk: int = 256) -> None:
    """Cells as a Parquet store partitioned by square chunks; windows prune partitions by chunk."""
    keyed = cells.withColumns({"chunk_r": F.floor(F.col("r") / chunk), "chunk_c": F.floor(F.col("c") / chunk)})
    keyed.repartition("chunk_r", "chunk_c").sortWithinPartitions("r", "c").write.partitionBy("chunk_r", "chunk_c").parquet(path)


def read_store(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, chunk: int = 256) -> DataFrame:
    """Cells of a window (row, column, rows, columns); only its chunks are read."""
    cells = spark.read.parquet(path)
    if window:
        r, c, m, n = window
        cells = cells.filter(F.col("chunk_r").between(r // chunk, (r + m - 1) // chunk) & F.col("chunk_c").between(c // chunk, (c + n - 1) // chunk) & F.col("r").between(r, r + m - 1) & F.col("c").between(c, c + n - 1))
    return cells.drop("chunk_r", "chunk_c")
