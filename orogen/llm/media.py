"""Telephony audio columns: G.711 mu-law and A-law, IMA ADPCM, resampled PCM in WAV containers.

Companded bytes are expanded by lookup tables.  ADPCM predicts each sample from the one before, so
numpy runs along the samples of a block and across all blocks at once.  Work is batch by batch in
narrow Arrow stages; nothing is collected or shuffled.  One format is used for each text, by its bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from orogen.llm import bytework as B

#: Format tags of the RIFF registry.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
#: Index changes of IMA ADPCM by code.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def ima_steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM: the public table, 11 % apart, from 7 to 32767."""
    # fixed values
    return np.array(
        [
            7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
            130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
            1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
            7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
        ],
        np.int32,
    )


def mulaw_table() -> np.ndarray:
    """16-bit samples of the 256 mu-law codes (G.711: complemented sign, exponent, mantissa)."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit samples of the 256 A-law codes (G.711: even bits inverted)."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, (mantissa << 4) + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


_MULAW, _ALAW, _STEPS = mulaw_table(), alaw_table(), ima_steps()


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks of equal size, one row of bytes each: a row of samples each.

    A block has a header (first sample, step index, reserved byte) and two codes a byte, low first.
    """
    n, width = blocks.shape
    out = np.empty((n, 2 * (width - 4) + 1), np.int32)
    now = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(_STEPS) - 1)
    out[:, 0] = now
    codes = np.empty((n, 2 * (width - 4)), np.uint8)
    codes[:, ::2], codes[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    for k in range(codes.shape[1]):
        code, step = codes[:, k], _STEPS[index]
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        now = np.clip(now + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code], 0, len(_STEPS) - 1)
        out[:, k + 1] = now
    return out.astype(np.int16)


def ima_encode(samples: np.ndarray) -> np.ndarray:
    """Blocks of equal size for rows of samples (an odd number each), across all rows at once."""
    n, width = samples.shape
    x = samples.astype(np.int32)
    codes = np.zeros((n, width - 1), np.uint8)
    now, index = x[:, 0].copy(), np.zeros(n, np.int32)
    for k in range(1, width):
        step, left = _STEPS[index], x[:, k] - now
        sign, left = (left < 0).astype(np.uint8) << 3, np.abs(left)
        code, change = np.zeros(n, np.uint8), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = left >= part
            code |= np.where(hit, bit, 0).astype(np.uint8)
            left, change = left - np.where(hit, part, 0), change + np.where(hit, part, 0)
        now = np.clip(now + np.where(sign > 0, -change, change), -32768, 32767)
        codes[:, k - 1] = code | sign
        index = np.clip(index + IMA_INDEX[codes[:, k - 1]], 0, len(_STEPS) - 1)
    head = np.zeros((n, 4), np.uint8)
    head[:, :2] = np.ascontiguousarray(x[:, :1].astype("<i2")).view(np.uint8)
    return np.concatenate((head, codes[:, ::2] | codes[:, 1::2] << 4), axis=1)


def wav(tag: int, rate: int, payload: bytes, block: int = 1, bits: int = 8) -> bytes:
    """A mono WAV file; companded and ADPCM forms have the extended header and a fact chunk."""
    speed = rate * block if tag != IMA_ADPCM else rate * block // (2 * (block - 4) + 1)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, speed, block, bits)
    fact = b""
    if tag != PCM:
        per = 2 * (block - 4) + 1 if tag == IMA_ADPCM else 1
        fmt += struct.pack("<HH", 2, per) if tag == IMA_ADPCM else struct.pack("<H", 0)
        fact = struct.pack("<4sII", b"fact", 4, len(payload) // block * per)
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + fact + struct.pack("<4sI", b"data", len(payload)) + payload + pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def parse(media: bytes) -> tuple[int, int, int, memoryview]:
    """Format tag, rate, bytes per block and data of a WAV file; ValueError if it is none."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(view):
        name, n = struct.unpack_from("<4sI", view, at)
        if name == b"fmt ":
            tag, _, rate, _, block, _ = struct.unpack_from("<HHIIHH", view, at + 8)
            form = (tag, rate, block)
        elif name == b"data" and form:
            return *form, view[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data in the WAV file")


def expand(tag: int, block: int, data: np.ndarray) -> np.ndarray:
    """16-bit samples of stored bytes."""
    if tag == MULAW:
        return _MULAW[data]
    if tag == ALAW:
        return _ALAW[data]
    if tag == IMA_ADPCM:
        return ima_decode(data[: len(data) // block * block].reshape(-1, block)).reshape(-1)
    if tag == PCM:
        return data[: len(data) // 2 * 2].view("<i2")
    raise ValueError(f"format {tag}")


def double_rate(x: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """Twice the rate: each sample, and the midpoint to the next by the 4-tap filter (-1, 9, 9, -1) / 16.

    ``lengths`` are those of signals that stand one after another (all above 0); each repeats its first and last sample
    beyond its ends.
    """
    out = np.empty(2 * len(x), np.int16)
    out[::2] = x
    if len(x):
        ends = np.cumsum([len(x)] if lengths is None else lengths)
        begins, y = np.append(0, ends[:-1]), x.astype(np.int32)
        before, after, second = np.append(y[:1], y[:-1]), np.append(y[1:], y[-1:]), np.append(y[2:], [y[-1]] * min(2, len(y)))
        before[begins], after[ends - 1], second[ends - 1] = y[begins], y[ends - 1], y[ends - 1]
        second[np.maximum(ends - 2, begins)] = y[ends - 1]
        out[1::2] = np.clip((9 * (y + after) - before - second + 8) >> 4, -32768, 32767)
    return out


#: Formats of store(), and the bytes of an ADPCM block there.
FORMATS, IMA_BLOCK = (MULAW, ALAW, IMA_ADPCM), 576


def store(docs: DataFrame, text: str = "text", id: str = "doc_id", unit: int = 576, rate: int = 8000, tags: tuple[int, ...] = FORMATS) -> DataFrame:
    """Texts as media columns: id, n_bytes, media (a telephony WAV).

    The UTF-8 bytes, filled with bytes 255 up to a positive multiple of ``unit``, are the stored data, so
    the form is lossless: 8-bit mu-law or A-law samples, or ADPCM blocks of 576 bytes, one of ``tags`` by the CRC of the
    data.  A null text counts as empty; repeated rows and null ids stay; other columns are not read.
    """
    if IMA_ADPCM in tags and unit % IMA_BLOCK:
        raise ValueError("data must be whole ADPCM blocks")

    def make(batches):
        for batch in batches:
            data, offsets = B.buffers(batch.column(1))
            raw, at, n = memoryview(data), offsets.tolist(), np.diff(offsets)
            media, size, first = [], 0, 0
            for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                payload = bytes(raw[a:b]) + b"\xff" * (max(1, -(-(b - a) // unit)) * unit - (b - a))
                tag = tags[zlib.crc32(payload) % len(tags)]
                media.append(wav(tag, rate, payload, IMA_BLOCK, 4) if tag == IMA_ADPCM else wav(tag, rate, payload))
                size += len(media[-1])
                if size > 4 * B.SLICE or k == len(n) - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first : k + 1], pa.array(n[first : k + 1]), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])
                    media, size, first = [], 0, k + 1

    chosen = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(make, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id)


def samples(media: list[bytes | None], to: int) -> list[np.ndarray | None]:
    """16-bit samples at ``to`` Hz of WAV files, decoded and resampled together; None for what can't be read."""
    out: list[np.ndarray | None] = [None] * len(media)
    groups: dict[tuple[int, int, int], list[tuple[int, np.ndarray]]] = {}
    for k, item in enumerate(media):
        try:
            tag, rate, block, data = parse(item)
            data = np.frombuffer(data, np.uint8)
            if tag not in (PCM, *FORMATS) or rate <= 0 or tag == IMA_ADPCM and block <= 4:
                continue
        except (ValueError, TypeError, struct.error):
            continue
        data = data[: len(data) // block * block] if tag == IMA_ADPCM else data[: len(data) // 2 * 2] if tag == PCM else data
        groups.setdefault((tag, rate, block), []).append((k, data))
    for (tag, rate, block), items in groups.items():
        x = expand(tag, block, np.concatenate([d for _, d in items]))
        per = [len(d) // block * (2 * (block - 4) + 1) if tag == IMA_ADPCM else len(d) // (2 if tag == PCM else 1) for _, d in items]
        while rate < to:
            full = np.array([n for n in per if n], np.int64)
            x, rate, per = double_rate(x, full), 2 * rate, [2 * n for n in per]
        edges = np.append(0, np.cumsum(per))
        for (k, _), a, b in zip(items, edges[:-1], edges[1:], strict=True):
            out[k] = x[a:b]
    return out


def resampled(stored: DataFrame, media: str = "media", to: int = 16000, pcm: str = "pcm") -> DataFrame:
    """Adds ``pcm``: the stored audio as a 16-bit PCM WAV at ``to`` Hz (a power of two times its rate).

    A null, broken or unsupported medium gives null; a column of that name is replaced; others stay.
    """
    rows = stored.drop(pcm)
    decode = _decoder(rows.columns.index(media), to, pcm)
    return rows.mapInArrow(decode, StructType([*rows.schema.fields, StructField(pcm, BinaryType())]))


def _decoder(at: int, to: int, pcm: str):
    """Adds the resampled audio of column ``at`` to Arrow batches, which it cuts by bytes, so that many blocks are decoded at once."""

    def decode(batches):
        for batch in batches:
            sizes = np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(at))])
            i = 0
            while i < batch.num_rows:
                j = min(batch.num_rows, max(i + 1, int(np.searchsorted(sizes, sizes[i] + 4 * B.SLICE, "right")) - 1))
                part = batch.slice(i, j - i)
                found = samples([x.as_buffer() if x.is_valid else None for x in part.column(at)], to)
                files = [None if x is None else wav(PCM, to, x.astype("<i2").tobytes(), 2, 16) for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(files, pa.binary())], [*part.schema.names, pcm])
                i = j

    return decode


def described(stored: DataFrame, id: str = "doc_id", media: str = "media", pcm: str = "pcm", to: int = 16000) -> DataFrame:
    """What is read back from the stored columns: id, n_bytes, data and media digests, feature.

    Without a column of that name the PCM column is made here, batch by batch of Arrow, and read back from it: eight
    times the text, it need not pass through the JVM.

    The feature names the resampled PCM as stored: format of the medium, samples, rate, root mean square, zero
    crossings and CRC.  A null or broken medium has null digests and feature.
    """

    there = pcm in stored.columns
    decode = _decoder(2, to, "pcm")

    def read(batches):
        for batch in batches if there else decode(batches):
            rows = []
            for item, sound in zip(batch.column(2), batch.column(3), strict=True):
                try:
                    whole = memoryview(item.as_buffer())
                    tag, _, _, data = parse(whole)
                    _, rate, _, pcm_ = parse(sound.as_buffer())
                except (ValueError, TypeError, AttributeError, struct.error):
                    rows.append((None,) * 6)
                    continue
                x = np.frombuffer(pcm_, "<i2")
                size = np.sqrt(np.dot(x.astype(np.float64), x.astype(np.float64)) / max(1, len(x)))
                turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
                feature = f"tag={tag};n={len(x)};rate={rate};rms={size:.1f};zc={turns};crc={zlib.crc32(pcm_):08x}"
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(whole), hashlib.sha256(whole).hexdigest(), feature))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "n_bytes", *names])

    chosen = stored.select(F.col(id).alias("id"), "n_bytes", F.col(media).alias("media"), *([F.col(pcm).alias("pcm")] if there else []))
    kind = chosen.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return chosen.mapInArrow(read, schema).withColumnRenamed("id", id)
