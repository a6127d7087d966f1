"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

A document that exceeds the capacity is cut into pieces of full length behind a shorter first one.
Pieces are dealt by a hash of document, piece and ids (and the turn of a repeated row) into groups of about ``GROUP`` documents, and each
group is packed on its own: a piece goes where the sum, over residual gaps, of the squared number of
open sequences with that gap becomes smallest.  A group keeps one counter per gap, so its memory is
bounded; one shuffle carries rows of a few numbers, never texts or ids.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm import bytework as B
from orogen.llm.tokens import encoder

#: Documents whose pieces are packed together.
GROUP = 6_144


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces are placed longest first, ties in the given order.

    Among places that leave equal sums the tightest wins, then the sequence opened last.
    """
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened, far = 0, np.iinfo(np.int64).max
    for k in order:
        s = int(lengths[k])
        if s == capacity:
            sequence[k], opened = opened, opened + 1
            continue
        there = count[s:capacity]  # gaps s .. capacity - 1
        change = np.where(there > 0, 2 * (count[: capacity - s] - there) + 2, far)
        if there[0] > 0:
            change[0] = 1 - 2 * there[0]  # a full sequence is no longer open
        best = int(change.argmin())
        if change[best] <= 2 * count[capacity - s] + 1:
            gap = best + s
            at = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, at, opened = capacity, opened, opened + 1
        sequence[k], offset[k] = at, capacity - gap
        if gap > s:
            stacks[gap - s].append(at)
            count[gap - s] += 1
    return sequence, offset


def pieces(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", capacity: int = 2048, end: int = 0) -> DataFrame:
    """Token pieces of each whole text: id, piece, start, length, ids_crc32 (of its uint32 ids).

    ``turn`` numbers rows of one id and text that come together.
    """

    def cut(batches):
        enc = encoder(path, True, ids=True)
        seen: Counter[tuple] = Counter()  # documents of the task, to tell repeated rows apart
        for batch in batches:
            owner, piece, start, length, crc, turn = [], [], [], [], [], []
            names = batch.column(0).to_pylist()
            for i, j, n, ids in enc.each(batch.column(1)):
                at = 0
                for k, m in zip(range(i, j), n.tolist(), strict=True):
                    own = np.empty(m + 1, "<u4")
                    own[:m] = ids[at : at + m]
                    own[m] = end
                    at += m
                    a, p, same = 0, 0, (names[k], m, zlib.crc32(own))
                    seen[same] += 1
                    while a <= m:
                        b = a + ((m + 1 - 1) % capacity + 1 if a == 0 else capacity)
                        owner.append(k)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[a:b]))
                        turn.append(seen[same])
                        a, p = b, p + 1
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, turn))], ["id", "piece", "start", "length", "ids_crc32", "turn"])

    chosen = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long, turn long").withColumnRenamed("id", id)


def pack(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", capacity: int = 2048, end: int = 0, group: int = GROUP) -> DataFrame:
    """Packs the pieces of all documents; sequence_id and offset join the columns of pieces().

    A null text counts as empty (one piece: the end id).  Repeated rows are packed as often as they
    come, null ids included.  An empty table gives an empty result.  The number of groups follows
    the number of rows, so a group's work does not grow with the input.
    """
    found = pieces(docs, path, text, id, capacity, end)
    groups = max(1, -(-docs.count() // group))
    dealt = found.withColumn("g", F.pmod(F.xxhash64(F.col(id), "piece", "length", "ids_crc32", "turn", F.lit("packing")), F.lit(groups)))
    kind = found.schema[id].dataType.simpleString()

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), *((x, "ascending") for x in ("ids_crc32", "id", "piece", "start"))])
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        number = sequence * groups + rows["g"][0].as_py()
        return rows.drop_columns(["g", "turn"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.withColumnRenamed(id, "id").groupBy("g").applyInArrow(place, schema).withColumnRenamed("id", id)
