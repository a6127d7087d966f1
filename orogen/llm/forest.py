"""Approximate nearest neighbours with a forest of hash prefixes.

Each tree gives every vector a hash string of 64 sign bits of random projections and keeps a block
of vectors as a sorted array of these strings.  A query descends in every tree to its longest
matching prefix (a binary search), then ascends in all trees together, one prefix bit at a time,
until enough vectors share a prefix with it in some tree; those are compared exactly.

Vectors are dealt into blocks of about ``BLOCK``, the query set into blocks of ``QUERIES``.  The
tasks read the vector blocks in place; query blocks of at most ``HELD`` bytes go to them at a time,
by a broadcast of that size whatever the tables are.  Every vector is indexed, nothing is sampled;
a task merges the best hits of its blocks by query before they are sent on.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orogen.llm.cluster import dropped, written

BLOCK, QUERIES = 8192, 2048
#: Bytes of query vectors that are broadcast at a time (one block of queries at least).
HELD = 32 << 20
#: Trees, and the share of a block that a query ascends to.  The vectors at hand are nearly isotropic
#: (second moments within 1.0 to 1.6 of each other), where no index does much: on 2,000 vectors shares of 0.05, 0.1, 0.3, 0.6
#: and 0.75 find 0.26, 0.41, 0.73, 0.91 and 0.99 of the true neighbours (the last compares 0.89 of all vectors).
TREES, SHARE = 8, 0.75


def planes(dimension: int, trees: int = TREES, bits: int = 64) -> np.ndarray:
    """Projections of all trees, one below the other; the same for every block."""
    return np.random.default_rng(dimension).normal(size=(dimension, trees * bits))


def strings(x: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings as unsigned integers, a column for each tree; the first bit leads."""
    bits = (x @ planes(x.shape[1], trees) > 0).reshape(len(x), trees, 8, 8)
    return np.packbits(bits, axis=3)[..., 0].copy().view(">u8")[..., 0].astype(np.uint64)


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, trees: int = TREES, share: float = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest found for each query in one block: places of queries, ids, cosines.

    One row of a query's id and vector is the query itself and no candidate.
    """
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    size, q_size = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    near, near_q = (x / size[:, None]).astype(np.float32), (q / q_size[:, None]).astype(np.float32)  # a first ranking
    h, hq = strings(x, trees), strings(q, trees)
    n, least = len(x), min(len(x), max(64, int(share * len(x)), 4 * k))
    # the place of every vector in every tree's sorted array
    places, arrays = np.empty((trees, n), np.uint16 if n < 65_535 else np.uint32), []
    for t in range(trees):
        by = np.argsort(h[:, t], kind="stable")
        places[t, by] = np.arange(n)
        arrays.append(h[by, t])
    # begin and end of the entries that share p leading bits, for p from the root on
    low, high = np.zeros((65, trees, len(q)), np.int32), np.full((65, trees, len(q)), n, np.int32)
    for t in range(trees):
        open_ = np.arange(len(q))
        for p in range(1, 65):
            mask = np.uint64((1 << 64) - (1 << (64 - p)))
            a = hq[open_, t] & mask
            low[p, t], high[p, t] = 0, 0
            low[p, t, open_] = np.searchsorted(arrays[t], a, "left")
            high[p, t, open_] = np.searchsorted(arrays[t], a | ~mask, "right")
            open_ = open_[high[p, t, open_] > low[p, t, open_]]
            if not len(open_):
                low[p + 1 :, t], high[p + 1 :, t] = 0, 0
                break
    found = (high - low).sum(axis=1)  # entries on each level, twice if in two trees
    first, last = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
    out: list[tuple] = []
    for i in range(len(q)):
        if i % 256 == 0:
            products = near_q[i : i + 256] @ near.T
        levels = np.flatnonzero(found[:, i] >= least)
        level = int(levels[-1]) if len(levels) else 0
        while True:
            begin = low[level, :, i].astype(places.dtype)[:, None]
            width = (high[level, :, i] - low[level, :, i]).astype(places.dtype)[:, None]
            seen = np.logical_or.reduce(places - begin < width, axis=0)  # unsigned: places before the begin wrap round
            if level == 0 or np.count_nonzero(seen) >= least:
                break
            level -= 1
        for j in range(first[i], last[i]):
            if seen[j] and (x[j] == q[i]).all():
                seen[j] = False
                break
        at = np.flatnonzero(seen)
        if not len(at):
            continue
        if len(at) > k:
            rough = products[i % 256, at]
            edge = np.partition(rough, len(rough) - k)[len(rough) - k]
            at = at[rough >= edge - 1e-5]
        score = (x[at] * q[i]).sum(axis=1) / (size[at] * q_size[i])
        best = np.lexsort((ids[at], -score))[:k]
        out.append((np.full(len(best), i), ids[at[best]], score[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def usable(vector: Column) -> Column:
    """Vectors that can be compared: not null or zero, all components finite."""
    big = F.lit(float("inf"))
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def neighbours(vectors: DataFrame, query, k: int = 5, id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, queries: int = QUERIES, trees: int = TREES, share: float = SHARE, held: int = HELD) -> DataFrame:
    """The k nearest found (cosine) of each query among all other rows: query_id, rank, id, score.

    ``query`` is a condition on the id.  Vectors that are null, zero or hold null or non-finite
    components, and rows without an id, take no part; vectors of different lengths are never
    compared.  Ties go to the smaller id.  A row finds all rows but itself, repeated rows and others of its id
    too, and repeated queries have results of their own.  With fewer than k candidates all are given; an empty table gives
    an empty result.  Other columns are not read.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("dim", F.size("v"))
    sizes = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(query(F.col("id"))).alias("q")).collect()}
    if not sizes:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id} long, score double")
    blocks = F.create_map(*(F.lit(x) for d, (n, _) in sizes.items() for x in (d, max(1, -(-n // block)))))
    parts = F.create_map(*(F.lit(x) for d, (_, q) in sizes.items() for x in (d, max(1, -(-q // queries)))))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "v", F.lit("block")), F.element_at(blocks, F.col("dim"))).cast("int"))
    asked = rows.filter(query(F.col("id"))).withColumn("part", F.pmod(F.xxhash64("id", "v", F.lit("part")), F.element_at(parts, F.col("dim"))).cast("int"))

    def bundle(group: pa.Table) -> pa.Table:
        values = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
        ids = group["id"].to_numpy().astype("<i8")
        return pa.table([group["dim"][:1], group["at"][:1], pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["dim", "at", "ids", "vectors"])

    many = min(1000, 4 * sum(-(-n // block) for n, _ in sizes.values()))  # files of few blocks each, so that cores share them evenly
    kept = written(rows.withColumnRenamed("block", "at").repartition(many, "dim", "at").groupBy("dim", "at").applyInArrow(bundle, "dim int, at int, ids binary, vectors binary"), "forest-blocks")
    bundled = written(asked.withColumnRenamed("part", "at").select("id", "v", "dim", "at").groupBy("dim", "at").applyInArrow(bundle, "dim int, at int, ids binary, vectors binary"), "forest-queries")
    slabs: list[list] = []
    room = 0
    for r in sorted(bundled.select("dim", "at", F.length("vectors").alias("bytes")).collect()):
        if room < r["bytes"]:
            slabs.append([])
            room = held
        slabs[-1].append((r["dim"], r["at"]))
        room -= r["bytes"]
    found = [_answers(kept, bundled, slab[0], slab[-1], k, trees, share) for slab in slabs]
    dropped(kept, bundled)
    if not found:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id} long, score double")
    return reduce(DataFrame.unionByName, found).withColumnRenamed("id", id)


def _answers(kept: DataFrame, bundled: DataFrame, first: tuple[int, int], last: tuple[int, int], k: int, trees: int, share: float) -> DataFrame:
    """Results of the query blocks from ``first`` to ``last`` (dim, at), which all tasks hold: query_id, rank, id, score."""
    spark = kept.sparkSession
    pair = lambda p: F.struct(F.lit(p[0]), F.lit(p[1]))
    chosen = bundled.filter(F.struct("dim", "at").between(pair(first), pair(last)))
    asked: dict[int, list] = {}
    for r in chosen.collect():
        asked.setdefault(r["dim"], []).append((r["at"], bytes(r["ids"]), bytes(r["vectors"])))
    held = spark.sparkContext.broadcast(asked)

    def unit(batches):
        best: dict[tuple[int, int], tuple] = {}  # by query block: places, ids, scores of the nearest so far
        for batch in batches:
            for dim, ids, vectors in zip(*(batch.column(c) for c in ("dim", "ids", "vectors")), strict=True):
                dim = dim.as_py()
                x, own = np.frombuffer(vectors.as_buffer(), "<f8").reshape(-1, dim), np.frombuffer(ids.as_buffer(), "<i8")
                for part, q_ids, q in held.value.get(dim, ()):
                    hits = search(x, own, np.frombuffer(q, "<f8").reshape(-1, dim), np.frombuffer(q_ids, "<i8"), k, trees, share)
                    if (dim, part) in best:
                        hits = tuple(np.concatenate(c) for c in zip(best[dim, part], hits, strict=True))
                        order = np.lexsort((hits[1], -hits[2], hits[0]))
                        place = hits[0][order]
                        order = order[np.arange(len(place)) - np.searchsorted(place, place, "left") < k]
                        hits = tuple(c[order] for c in hits)
                    best[dim, part] = hits
        for (dim, part), (place, ids, score) in best.items():
            q_ids = next(np.frombuffer(i, "<i8") for at, i, _ in held.value[dim] if at == part)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), dim, np.int32)), pa.array(np.full(len(place), part, np.int32)), pa.array(place), pa.array(q_ids[place]), pa.array(ids), pa.array(score)], ["dim", "part", "place", "query_id", "id", "score"])

    # each task sends k hits a query at most, so there are few tasks for a core
    hits = kept.coalesce(4 * spark.sparkContext.defaultParallelism).mapInArrow(unit, "dim int, part int, place long, query_id long, id long, score double")
    w = Window.partitionBy("dim", "part", "place").orderBy(F.col("score").desc(), F.col("id"))
    out = written(hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score"), "forest-found")
    held.destroy()
    return out
