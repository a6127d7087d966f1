"""Chat formatting by columnar byte assembly.

Turns come sorted by conversation.  For a batch, the lengths of all segments (header, escaped text,
footer) give cumulative offsets; headers, texts and footers are then scattered with numpy into one
preallocated buffer that becomes the Arrow column.  Control strings inside texts are escaped by one
backslash behind their first character (and texts that already look escaped get one more), so the
template can always be read back.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm import bytework as B

#: Fixed values of the template: header and footer by role; other roles are named in the header.
TEMPLATE = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("[OUT] ", " </s>\n")}
OTHER = ("[ROLE] ", "\n", " [/ROLE]\n")
BEGIN = "<s>"
#: Control strings without their first character, by that character.
_CONTROL = r"(\[/?INST\]|\[/?OUT\]|\[/?ROLE\]|</?s>|<</?SYS>>)"
_ESCAPE = r"(?:(\[)(\\*)(/?INST\]|/?OUT\]|/?ROLE\]))|(?:(<)(\\*)(/?s>|</?SYS>>))"
_BACK = re.compile(r"([\[<])\\(\\*)((?<=[\[\\])/?(?:INST|OUT|ROLE)\]|/?s>|</?SYS>>)")


def escaped(texts: pa.Array) -> pa.Array:
    """Texts without control strings."""
    return pc.replace_substring_regex(texts, pattern=_ESCAPE, replacement=r"\1\4\\\2\5\3\6")


def unescaped(text: str) -> str:
    """The inverse of escaped(): one backslash fewer in each escaped control string."""
    return _BACK.sub(_less, text) if "\\" in text else text


def _less(m: re.Match) -> str:
    square = m[3].endswith("]")
    return m[1] + m[2] + m[3] if square == (m[1] == "[") else m[0]


def assemble(roles: list, texts: pa.Array, counts: np.ndarray) -> tuple[pa.Array, list[list[tuple[int, int]]]]:
    """Conversations of ``counts`` consecutive turns as formatted strings, with spans (byte offset, length) of assistant texts."""
    kinds = {r: k for k, r in enumerate(dict.fromkeys(roles))}
    heads, feet = [], []
    for r in kinds:
        head, foot = TEMPLATE.get(r) or (OTHER[0] + escaped(pa.array([json.dumps(r)]))[0].as_py() + OTHER[1], OTHER[2])
        heads.append(head.encode())
        feet.append(foot.encode())
    kind = np.fromiter((kinds[r] for r in roles), np.int64, len(roles))
    data, offsets = B.buffers(escaped(pc.fill_null(texts, "")))
    size = np.diff(offsets)
    begin = BEGIN.encode()
    head_size, foot_size = (np.array([len(x) for x in y] or [0], np.int64) for y in (heads, feet))
    first = np.zeros(len(roles), np.int64)
    starts = np.cumsum(counts) - counts
    first[starts[counts > 0]] = len(begin)
    lengths = np.stack((first, head_size[kind], size, foot_size[kind])) if len(roles) else np.zeros((4, 0), np.int64)
    ends = np.cumsum(lengths.T.reshape(-1)).reshape(-1, 4) if len(roles) else np.zeros((0, 4), np.int64)
    places = ends - lengths.T
    out = np.empty(int(ends[-1, 3]) if len(roles) else 0, np.uint8)
    source = np.frombuffer(begin + b"".join(heads) + b"".join(feet) or b"\0", np.uint8)
    head_at = len(begin) + np.cumsum(head_size) - head_size
    foot_at = len(begin) + head_size.sum() + np.cumsum(foot_size) - foot_size
    zero = np.zeros(len(roles), np.int64)
    for part, (src, at) in enumerate(((source, zero), (source, head_at[kind]), (data, offsets[:-1]), (source, foot_at[kind]))):
        if len(roles):
            out[B.ranges(places[:, part], lengths[part])] = src[B.ranges(at, lengths[part])]
    total = B.sums(lengths.sum(axis=0), counts)
    edges = np.concatenate(([0], np.cumsum(total))).astype(np.int64)
    made = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(edges), pa.py_buffer(out))
    loss = np.fromiter((r == "assistant" for r in roles), bool, len(roles))
    owner = np.repeat(np.arange(len(counts)), counts)
    spans: list[list[tuple[int, int]]] = [[] for _ in counts]
    for k in np.flatnonzero(loss):
        spans[owner[k]].append((int(places[k, 2] - edges[owner[k]]), int(size[k])))
    return made, spans


def read(formatted: str) -> list[tuple[str | None, str]]:
    """Roles and texts of a formatted conversation; ValueError if it isn't one."""
    if not formatted.startswith(BEGIN):
        raise ValueError("no beginning")
    at, out = len(BEGIN), []
    while at < len(formatted):
        for role, (head, foot) in TEMPLATE.items():
            if formatted.startswith(head, at):
                at += len(head)
                break
        else:
            if not formatted.startswith(OTHER[0], at):
                raise ValueError(f"no header at {at}")
            line = formatted.index(OTHER[1], at)
            role, at, foot = json.loads(unescaped(formatted[at + len(OTHER[0]) : line])), line + 1, OTHER[2]
        end = formatted.index(foot, at)
        out.append((role, unescaped(formatted[at:end])))
        at = end + len(foot)
    return out


SCHEMA = "formatted string, loss_spans array<struct<at:long,length:long>>"


def format_conversations(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: id, formatted, loss_spans (byte offset and length of assistant texts).

    Turns go in the order (turn, role, text), nulls first; a null text counts as empty, a null role
    is written as such; repeated rows are repeated turns; null ids are one conversation; an empty
    table gives an empty result; other columns are not read.  A conversation is one value of the
    result, so its turns meet in one task, sorted by Spark (which spills) and streamed batch by batch.
    """
    chosen = turns.select(F.col(id).alias("id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def build(batches):
        held = None  # turns of a conversation that may go on
        for batch in batches:
            table = pa.Table.from_batches([batch.select(["id", "role", "text"])])
            table = table if held is None else pa.concat_tables([held, table])
            ids = table["id"].combine_chunks()
            if not len(ids):
                continue
            new = _changes(ids)
            held = table.slice(new[-1])
            yield from rows(table, new)
        if held is not None and len(held):
            yield from rows(held, np.array([0, len(held)]))

    def rows(table: pa.Table, edges: np.ndarray):
        k = 0
        size = pc.fill_null(pc.binary_length(table["text"]), 0).to_numpy().astype(np.int64)
        total = np.concatenate(([0], np.cumsum(size)))
        while k < len(edges) - 1:
            m = max(k + 1, int(np.searchsorted(total[edges], total[edges[k]] + B.SLICE, "right")) - 1)
            part = table.slice(edges[k], edges[m] - edges[k])
            made, spans = assemble(part["role"].to_pylist(), part["text"].combine_chunks(), np.diff(edges[k : m + 1]))
            names = pa.array([[{"at": a, "length": b} for a, b in x] for x in spans], pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([table["id"].combine_chunks().take(pa.array(edges[k:m])), made.cast(pa.string()) if made.nbytes < 1 << 31 else made, names], ["id", "formatted", "loss_spans"])
            k = m

    dealt = chosen.repartition("id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("id", "turn", "role", "text")))
    return dealt.mapInArrow(build, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id)


def _changes(ids: pa.Array) -> np.ndarray:
    """Places where a new id begins, 0 among them."""
    if len(ids) == 1:
        return np.array([0])
    a, b = ids[:-1], ids[1:]
    same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
    return np.concatenate(([0], np.flatnonzero(~same) + 1))


def read_back(formatted: DataFrame, id: str = "conv_id") -> DataFrame:
    """Digests of what the formatted strings hold: turns, text under the loss mask, lengths."""

    def digest(batches):
        for batch in batches:
            out = []
            for whole, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = hashlib.sha256()
                found = read(whole)
                for role, text in found:
                    turns.update(f"{role or ''}\n{text}\n".encode())
                raw = whole.encode()
                loss = "".join(unescaped(raw[x["at"] : x["at"] + x["length"]].decode()) for x in spans)
                out.append((len(found), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    chosen = formatted.select(F.col(id).alias("id"), "formatted", "loss_spans")
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(digest, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id)
