"""Token counts: batch encoding inside Arrow functions that return lengths only.

An encoder is loaded once per Python worker.  Texts are cut at safe boundaries (white space for a
vocabulary that drops it; the beginning of a white-space run for a byte-level vocabulary, whose
pattern never joins a character before such a run with what follows), equal pieces are encoded once
per batch, and batches are balanced by bytes rather than rows.  A bounded memo carries pieces from
batch to batch; it only saves time.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm import bytework as B

#: Pieces that a worker remembers; beyond that it begins anew.
MEMO = 1_500_000


class Encoder:
    """Piece by piece encoding with a memo.

    ``keep_space`` False: pieces are words between white space (for vocabularies that drop white
    space).  True: a piece is a run of white space with the run of other characters after it.
    """

    def __init__(self, path: str, keep_space: bool, ids: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.keep_space, self.want_ids = keep_space, ids
        self.clear()

    def clear(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0
        self.lengths = np.zeros(1024, np.int32)
        self.begins = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.n_ids = 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys in the memo, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for known, at in self.levels:
            if not len(left):
                break
            k = keys[left]
            p = np.minimum(np.searchsorted(known, k), len(known) - 1)
            hit = known[p] == k
            out[left[hit]] = at[p[hit]]
            left = left[~hit]
        return out

    def _add(self, keys: np.ndarray, texts: list[str]) -> np.ndarray:
        """Encodes new pieces; keys are sorted."""
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int32, len(found))
        at = np.arange(self.n, self.n + len(n))
        while self.n + len(n) > len(self.lengths):
            self.lengths = np.concatenate((self.lengths, np.zeros_like(self.lengths)))
            self.begins = np.concatenate((self.begins, np.zeros_like(self.begins)))
        self.lengths[at] = n
        if self.want_ids:
            total = int(n.sum())
            while self.n_ids + total > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            self.begins[at] = self.n_ids + np.cumsum(n) - n
            self.ids[self.n_ids : self.n_ids + total] = np.fromiter((i for x in found for i in x), np.uint32, total)
            self.n_ids += total
        self.n += len(n)
        self.levels.append((keys, at))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            (a, x), (b, y) = self.levels[-2:]
            keys, values = np.concatenate((a, b)), np.concatenate((x, y))
            order = np.argsort(keys, kind="stable")
            self.levels[-2:] = [(keys[order], values[order])]
        return at

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.keep_space:
            return B.spans(data, offsets)
        space = B.SPACE[data]
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = space[1:] & ~space[:-1]
        # no cut after a character that may itself be white space to the pattern
        wide = np.flatnonzero(start[1:-1] & (data[:-1] >= 0x80)) + 1
        if len(wide):
            start[wide[_after_wide_space(data, wide)]] = False
        filled = offsets[:-1][np.diff(offsets) > 0]
        start[filled] = True
        start[-1] = False
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        return starts, ends, np.diff(np.searchsorted(starts, offsets))

    def places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Memo places of all pieces in order, and pieces per document."""
        starts, ends, counts = self.pieces(data, offsets)
        h = B.hashes(data, starts, ends, lower=False)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        if self.n + len(keys) > MEMO:
            self.clear()
        at = self._place(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw = data.tobytes()
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            at[new] = self._add(keys[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(s, e, strict=True)])
        return at[back], counts

    def each(self, texts: pa.Array):
        """Yields (i, j, per-document token counts of [i, j), ids in order or None)."""
        data, offsets = B.buffers(texts)
        for i, j in B.slices(offsets):
            parts = [(int(offsets[i]), int(offsets[j]), offsets[i : j + 1] - offsets[i])]
            if j - i == 1:
                parts = [(a, b, np.array([0, b - a])) for a, b in B.cuts(data, int(offsets[i]), int(offsets[j]))]
            total, ids = np.zeros(j - i, np.int64), []
            for a, b, inner in parts:
                at, counts = self.places(data[a:b], inner)
                n = self.lengths[at]
                total += B.sums(n, counts)
                if self.want_ids:
                    ids.append(self.ids[B.ranges(self.begins[at], n.astype(np.int64))])
            yield i, j, total, np.concatenate(ids) if ids else None


def _after_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters that end just before ``at`` are white space beyond ASCII."""
    a, b = data[at - 1], data[np.maximum(at - 2, 0)]
    c = data[np.maximum(at - 3, 0)]
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    general = (c == 0xE2) & (b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
    return two | general | ((c == 0xE2) & (b == 0x81) & (a == 0x9F)) | ((c == 0xE1) & (b == 0x9A) & (a == 0x80)) | ((c == 0xE3) & (b == 0x80) & (a == 0x80))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, keep_space: bool, ids: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    key = (path, keep_space, ids)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def count_tokens(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", keep_space: bool = False, limit: int = 2048) -> DataFrame:
    """Tokens of each whole text: id, n_bytes, n_tokens, over_limit.

    ``keep_space`` says whether the vocabulary keeps white space (byte-level BPE) or drops it.
    Null texts count as empty (0 tokens); repeated rows give repeated rows; null ids stay; other
    columns of the input are not read.  One narrow stage: no shuffle, nothing is collected.
    """

    def lengths(batches):
        enc = encoder(path, keep_space)
        for batch in batches:
            _, offsets = B.buffers(batch.column(1))
            n = np.zeros(batch.num_rows, np.int64)
            for i, j, total, _ in enc.each(batch.column(1)):
                n[i:j] = total
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    chosen = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(lengths, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id)
