"""Vectorised work on the bytes of a text column.

Texts arrive as Arrow arrays.  They are cut into slices of about ``SLICE`` bytes at document
borders; a single longer text is cut at white space, so that working memory follows the slice and
not the batch.  Words are hashed for a whole slice at once, eight bytes at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of one slice.
SLICE = 1 << 20

#: The white space of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space, control characters and ASCII punctuation.
PUNCT = SPACE.copy()
PUNCT[:0x80] |= np.array([not chr(i).isalnum() for i in range(0x80)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: The low k bytes of eight.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Added to the eight bytes at each place of a word before they are mixed.
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts); nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, limit: int = SLICE):
    """Ranges [i, j) of documents with at most ``limit`` bytes, or of one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def cuts(data: np.ndarray, start: int, end: int, limit: int = SLICE):
    """Ranges of about ``limit`` bytes that begin at ASCII white space after another ASCII character.

    A run without such a place stays whole.
    """
    while end - start > limit:
        at, found = start + limit, -1
        while at < end and found < 0:
            piece = data[at - 1 : min(at + 65_536, end)]
            ok = np.flatnonzero(SPACE[piece[1:]] & ~SPACE[piece[:-1]] & (piece[:-1] < 0x80))
            if len(ok):
                found = at + int(ok[0])
            at += 65_536
        if found < 0:
            break
        yield start, found
        start = found
    yield start, end


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice whose offsets begin at 0, and words per document."""
    word = np.zeros(len(data) + 1, bool)
    np.logical_not(space[data], out=word[:-1])
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    after = np.empty_like(word)
    after[:-1] = word[1:]
    after[-1] = False
    before[offsets[:-1]] = False
    inner = offsets[1:] - 1
    after[inner[inner >= 0]] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span (none empty): its bytes, eight at a time, mixed with their place and added.

    The mixing is not linear, so words that are built alike do not cancel out.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    np.take(LOWER, data, out=padded[: len(data)]) if lower else np.copyto(padded[: len(data)], data)
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes that begin at each byte
    n = ends - starts
    first = eight[starts] & _MASK[np.minimum(n, 8)]
    out = mix(first + _STEP)
    long = np.flatnonzero(n > 8)
    if len(long):
        more = (n[long] - 1) // 8
        place = ranges(np.ones(len(long), np.int64), more)
        at = np.repeat(starts[long], more) + 8 * place
        left = np.minimum(np.repeat(ends[long], more) - at, 8)
        part = mix((eight[at] & _MASK[left]) + (place.astype(np.uint64) + np.uint64(1)) * _STEP)
        out[long] += np.add.reduceat(part, np.cumsum(more) - more)
    return mix(out + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(texts: pa.Array, space: np.ndarray = SPACE, lower: bool = True, limit: int = SLICE):
    """Yields (i, j, words of each document of [i, j), hashes of all these words in order)."""
    data, offsets = buffers(texts)
    for i, j in slices(offsets, limit):
        if j - i == 1 and offsets[j] - offsets[i] > limit:
            found = []
            for a, b in cuts(data, int(offsets[i]), int(offsets[j]), limit):
                part = data[a:b]
                s, e, _ = spans(part, np.array([0, b - a]), space)
                found.append(hashes(part, s, e, lower))
            h = np.concatenate(found)
            yield i, j, np.array([len(h)]), h
        else:
            part = data[offsets[i] : offsets[j]]
            s, e, n = spans(part, offsets[i : j + 1] - offsets[i], space)
            yield i, j, n, hashes(part, s, e, lower)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs with the given lengths (0 for empty ones)."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    at = np.concatenate(([0], np.cumsum(counts)))
    return total[at[1:]] - total[at[:-1]]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
