"""n-gram language model scores from Elias-Fano tries.

Counting.  All words and bigrams of the training texts count, however rare.  Texts are cut into blocks of
about BLOCK tokens.  A block sends its distinct words with their counts to shards by ranges of their hash, whose number
follows the corpus; a shard adds up what the blocks sent, numbers its words and tells each block the totals and numbers of
its own.  Then blocks send their distinct bigrams, as numbers, to shards by the hash of the context; those of a context
that comes more than SHARD times are spread by the next word too.  A hot word or bigram is one entry a block.

Trie.  A shard builds the trie of its contexts.  First level: context numbers, ascending, with pointers to where the next
words of each begin, both monotone Elias-Fano sequences, and the number of different next words.  Second level: the
numbers of next words, ascending within a context, as one monotone sequence (context's place * words + word), and their
discounted probabilities in 16 bits, log-spaced.  The levels are mapped from a file without a name that goes with the task.
A block's bigrams are looked up there: the context by successor search in the first level, its pointers, and the next word
by successor search between them.

Probabilities.  Words are add-one estimates from exact counts.  Bigrams interpolate: P(w | c) = (count - D) / count(c)
(nothing if unseen) + share(c) * P(w), where share(c) = D * different next words of c / count(c) is the mass
that the discounts leave; but for the rounding of the stored part it sums to one.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm import bytework as B
from orogen.llm.cluster import dropped, written

DISCOUNT = 0.75
#: Tokens of a block, and tokens for each shard, about.
BLOCK, SHARD = 250_000, 1_500_000
#: The hash that stands for the end of a text; those of words are larger.  Its number, among numbers of words; 0 is the beginning.
END, END_NUMBER = 1, 1
#: Steps of a stored probability to a power of ten.
STEPS = 4096


class EliasFano:
    """A monotone sequence in packed bits: low bits one after another, high bits in unary.

    Beside them stands, for each 64 bits of the unary part, how many entries come before.
    """

    def __init__(self, raw: np.ndarray):
        self.n, self.shift, words, self.universe, size = (int(x) for x in raw[:40].view(np.int64))
        self.high = raw[40 : 40 + 8 * words].view(np.uint64)
        self.before = raw[40 + 8 * words : 40 + 16 * words].view(np.int64)
        low = raw[40 + 16 * words : size]
        self.low = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))  # the eight bytes that begin at each byte
        self.size = size

    @staticmethod
    def stored(values: np.ndarray, universe: int) -> bytes:
        """The bytes of ascending values below the universe."""
        n, values = len(values), values.astype(np.uint64)
        shift = min(48, max(0, (universe // max(1, n)).bit_length() - 1))
        bits = np.zeros(-(-(n + (universe >> shift) + 1) // 64) * 64, np.uint8)
        bits[(values >> np.uint64(shift)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.bitwise_count(high).astype(np.int64)
        low = np.unpackbits(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :shift]
        low = np.packbits(low.ravel(), bitorder="little").tobytes()
        low += b"\0" * (8 + -len(low) % 8)
        head = np.array([n, shift, len(high), universe, 40 + 16 * len(high) + len(low)], np.int64)
        return head.tobytes() + high.tobytes() + (np.cumsum(ones) - ones).tobytes() + low

    def _low(self, place: np.ndarray) -> np.ndarray:
        at = place.astype(np.int64) * self.shift
        return self.low[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << self.shift) - 1)

    def get(self, place: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, place, "right") - 1
        high = 64 * word + _nth(self.high[word], place - self.before[word]) - place
        return high << self.shift | self._low(place).astype(np.int64)

    def find(self, value: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | None = None) -> np.ndarray:
        """Places of values among those from begin to end, -1 where the successor is another value."""
        out = np.full(len(value), -1, np.int64)
        inside = (value >= 0) & (value < self.universe)
        value = np.where(inside, value, 0)
        high = value >> self.shift
        at = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1 - high, 0)
        stop = self._zero(high) - high
        at, stop = np.maximum(at, begin), np.where(inside, np.minimum(stop, self.n if end is None else end), 0)
        low = (value & ((1 << self.shift) - 1)).astype(np.uint64)
        last = stop.copy()
        left = np.flatnonzero(at < stop)
        while len(left):  # successor search among the entries that share the high part, whose low bits ascend
            middle = (at[left] + stop[left]) >> 1
            less = self._low(middle) < low[left]
            at[left] = np.where(less, middle + 1, at[left])
            stop[left] = np.where(less, stop[left], middle)
            left = left[at[left] < stop[left]]
        there = np.flatnonzero(at < last)
        there = there[self._low(at[there]) == low[there]]
        out[there] = at[there]
        return out

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Places of the zeros with these numbers in the unary part."""
        zeros = 64 * np.arange(len(self.before)) - self.before
        word = np.searchsorted(zeros, k, "right") - 1
        return 64 * word + _nth(~self.high[word], k - zeros[word])


def _nth(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the set bit with number k in each word."""
    words, k, out = words.copy(), k.astype(np.int64), np.zeros(len(words), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = words & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        up = k >= ones
        k, out = k - np.where(up, ones, 0), out + np.where(up, width, 0)
        words = np.where(up, words >> np.uint64(width), low)
    return out


class Trie:
    """Contexts, pointers, numbers of next words; next words and their stored probabilities."""

    def __init__(self, raw: np.ndarray):
        parts, at = [], 8
        for _ in range(3):
            parts.append(EliasFano(raw[at:]))
            at += parts[-1].size
        self.contexts, self.pointers, self.next = parts
        self.words = int(raw[:8].view(np.int64)[0])
        self.continuations = raw[at : at + 4 * self.contexts.n].view(np.uint32)
        at += 4 * self.contexts.n
        self.codes = raw[at : at + 2 * self.next.n].view(np.uint16)

    @staticmethod
    def stored(context: np.ndarray, word: np.ndarray, share: np.ndarray) -> bytes:
        """The bytes of bigrams, ascending, whose discounted probabilities are ``share``."""
        contexts, first, different = np.unique(context, return_index=True, return_counts=True)
        place = np.repeat(np.arange(len(contexts)), different)
        words = int(word.max(initial=0)) + 1
        pointers = np.append(first, len(word))
        parts = EliasFano.stored(contexts, int(contexts.max(initial=0)) + 1), EliasFano.stored(pointers, len(word) + 1), EliasFano.stored(place * words + word, max(1, len(contexts) * words))
        return np.int64(words).tobytes() + b"".join(parts) + different.astype(np.uint32).tobytes() + quantised(share).tobytes()

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of contexts in the first level and of next words in the second, -1 for unknown ones."""
        first = self.contexts.find(context)
        second, some = np.full(len(word), -1, np.int64), np.flatnonzero((first >= 0) & (word < self.words))
        k = first[some]
        second[some] = self.next.find(k * self.words + word[some], self.pointers.get(k), self.pointers.get(k + 1))
        return first, second


def quantised(share: np.ndarray) -> np.ndarray:
    """16 bits for a probability: 1 + the steps down from 1 (0 stands for none)."""
    return np.clip(1 + np.round(-STEPS * np.log10(share)), 1, 65_535).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((1 - code.astype(float)) / STEPS), 0.0)


def mapped(raw: bytes) -> np.ndarray:
    """The bytes as pages of a file without a name in the task's temporary folder."""
    with tempfile.TemporaryFile() as file:
        file.write(raw)
        file.flush()
        return np.frombuffer(mmap.mmap(file.fileno(), len(raw), access=mmap.ACCESS_READ), np.uint8)


def _tokens(texts: pa.Array):
    """Yields (i, j, tokens per document, hashes): words and one end for each document."""
    for i, j, counts, h in B.words(texts):
        n = counts + 1
        out = np.full(int(n.sum()), END, np.uint64)
        last = np.zeros(len(out), bool)
        last[np.cumsum(n) - 1] = True
        out[~last] = np.maximum(h, np.uint64(END + 1))
        yield i, j, n, out


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers, all their first bytes first, so that bytes that hardly differ stand together, compressed."""
    x = np.ascontiguousarray(x).astype("<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(x).to_bytes(7, "little") + bytes([width]) + pa.compress(planes, "zstd", asbytes=True)


def _numbers(x: pa.BinaryScalar) -> np.ndarray:
    raw = x.as_buffer()
    n, width = int.from_bytes(raw[:7].to_pybytes(), "little"), raw[7]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(raw[8:], width * n, "zstd"), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _steps(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Ascending runs, which begin at the edges, as their first values and differences."""
    out = x.copy()
    out[1:] -= x[:-1]
    edges = edges[edges < len(x)]
    out[edges] = x[edges]
    return out


def _runs(steps: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The inverse of _steps()."""
    total = np.cumsum(steps, dtype=np.int64)
    length = np.diff(np.append(edges, len(steps)))
    return total - np.repeat(total[edges] - steps[edges].astype(np.int64), length)


class Pairs:
    """Distinct bigrams of a block, from its tokens (places among its words): contexts and next words by their numbers.

    ``place`` is the context's place among the words plus 1 (0 for the beginning), ``next`` that of the next word.
    """

    def __init__(self, ids: np.ndarray, n: np.ndarray, numbers: np.ndarray, totals: np.ndarray, shards: int):
        one = np.empty(len(ids), np.int64)
        one[1:] = ids[:-1] + 1
        one[np.cumsum(n) - n] = 0
        width = len(numbers) + 1
        code, self.at = np.unique(one * width + ids, return_inverse=True)
        context, word = code // width, code % width
        # the number of the beginning is 0; it comes as often as the end does
        self.context, self.word, self.place, self.next = np.append(0, numbers)[context], numbers[word], context, word
        # every block has an end, whose number is the least
        self.totals = np.append(totals[:1], totals)
        mixed = B.mix(self.context.astype(np.uint64) + np.uint64(1))
        spread = self.totals[context] > SHARD
        mixed[spread] = B.mix(mixed[spread] + self.word[spread].astype(np.uint64))
        self.shard = ((mixed >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        self.order = np.argsort(self.shard, kind="stable")


def score(docs: DataFrame, training, text: str = "text", id: str = "doc_id") -> DataFrame:
    """log10 probabilities of whole texts under a model of the rows that meet ``training`` (a condition on the id).

    Returns id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (add-one
    unigrams) and score.  Null texts count as empty (one token: the end); rows with a null id are held
    out; repeated rows stay and count as often; very long texts are one block of their own; other columns are
    not read.  Without training rows every token is unknown and both scores are 0.
    """
    spark = docs.sparkSession
    trained = F.coalesce(training(F.col("id")), F.lit(False))
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).select("id", "text", (~trained).alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    kept = f"block long, size long, ids array<{kind}>, held array<boolean>, n binary, "

    def cut(batches):
        number, size, parts = TaskContext.get().partitionId() << 32, 0, []

        def block() -> pa.RecordBatch:
            words, ids = np.unique(np.concatenate([x[3] for x in parts]), return_inverse=True)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.concat_arrays([p[k] for p in parts]) for k in (0, 1))]
            steps = _steps(words, np.zeros(1, np.int64))
            blobs = [pa.array([_packed(x)], pa.binary()) for x in (np.concatenate([x[2] for x in parts]), steps, ids)]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(ids)]), *lists, *blobs], ["block", "size", "ids", "held", "n", "words", "tokens"])

        for batch in batches:
            for i, j, n, h in _tokens(batch.column(1)):
                parts.append((batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), n, h))
                size += len(h)
                if size >= BLOCK:
                    yield block()
                    number, size, parts = number + 1, 0, []
        if parts:
            yield block()

    blocks = written(rows.mapInArrow(cut, kept + "words binary, tokens binary"), "lm-blocks")
    shards = max(1, -(-int(blocks.agg(F.sum("size")).first()[0] or 0) // SHARD))

    def counts(row, k: int, ids: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
        taken = ~np.array(row["held"][k].as_py(), bool)
        return np.bincount(ids, np.repeat(taken, n).astype(float), width).astype(np.int64)

    def word_shard(words: np.ndarray) -> np.ndarray:
        return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)

    def ask_words(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                n, steps, ids = (_numbers(batch[x][k]).astype(t) for x, t in (("n", np.int64), ("words", np.uint64), ("tokens", np.int64)))
                words = np.cumsum(steps, dtype=np.uint64)
                found = counts(batch, k, ids, n, len(words))
                edges = np.searchsorted(word_shard(words), np.arange(shards + 1))
                some = np.flatnonzero(np.diff(edges))
                steps = _steps(words, edges[some])
                blobs = [pa.array([_packed(x[edges[s] : edges[s + 1]]) for s in some], pa.binary()) for x in (steps, found)]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), batch["block"][k].as_py())), *blobs], ["shard", "block", "words", "counts"])

    def add_words(group: pa.Table) -> pa.Table:
        """Totals of words over all blocks, times 2, plus 1 in the one block that stands for the word; and their places."""
        keys = [np.cumsum(_numbers(x), dtype=np.uint64) for x in group["words"]]
        found_here = np.concatenate([_numbers(x) for x in group["counts"]]).astype(np.int64)
        edges = np.cumsum([0, *map(len, keys)])
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, found_here, len(found)).astype(np.int64)
        some = np.flatnonzero(found_here > 0)
        stands = np.full(len(found), -1, np.int64)
        stands[at[some]] = some
        out = 2 * total[at] + (stands[at] == np.arange(len(at)))
        cuts = list(zip(edges[:-1], edges[1:], strict=True))
        return pa.table([group["shard"], group["block"], pa.array([_packed(out[i:j]) for i, j in cuts], pa.binary()), pa.array([_packed(_steps(at[i:j], np.zeros(1, np.int64))) for i, j in cuts], pa.binary())], ["shard", "block", "totals", "places"])

    answers = blocks.mapInArrow(ask_words, "shard int, block long, words binary, counts binary").groupBy("shard").applyInArrow(add_words, "shard int, block long, totals binary, places binary")

    def numbered(own: pa.Table, rows: pa.Table) -> pa.Table:
        """The block's row with its words by their numbers: the end 1, others 2 + shard + shards * place."""
        steps, ids = (_numbers(own[x][0]) for x in ("words", "tokens"))
        order = np.argsort(rows["shard"].to_numpy())
        shard = rows["shard"].to_numpy()[order].astype(np.int64)
        totals = np.concatenate([np.zeros(0, np.uint64), *(_numbers(rows["totals"][int(k)]) for k in order)]).astype(np.int64)
        numbers = np.concatenate([np.zeros(0, np.int64), *(2 + s + shards * np.cumsum(_numbers(rows["places"][int(k)]), dtype=np.int64) for k, s in zip(order, shard, strict=True))])
        numbers[:1] = END_NUMBER  # the end has the least hash
        by = np.argsort(numbers)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        stands, totals, numbers = (totals & 1)[by], (totals >> 1)[by], numbers[by]
        blobs = [pa.array([_packed(x)], pa.binary()) for x in (rank[ids.astype(np.int64)], _steps(numbers, np.zeros(1, np.int64)), totals)]
        n, taken = _numbers(own["n"][0]).astype(np.int64), ~np.array(own["held"][0].as_py(), bool)
        sums = [pa.array([int(x)], pa.int64()) for x in (n[taken].sum(), stands.sum())]
        names = ["block", "size", "ids", "held", "n"]
        return pa.table([*(own[x] for x in names), *blobs, *sums], [*names, "tokens", "numbers", "totals", "trained", "different"])

    known = written(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(numbered, kept + "tokens binary, numbers binary, totals binary, trained long, different long"), "lm-numbered")
    dropped(blocks)
    N, V = (int(x or 0) for x in known.agg(F.sum("trained"), F.sum("different")).first())

    def read(row, k: int = 0) -> tuple[Pairs, np.ndarray, np.ndarray, np.ndarray]:
        """Bigrams, tokens, tokens per document, totals of the words."""
        n, ids, steps, totals = (_numbers(row[x][k]).astype(np.int64) for x in ("n", "tokens", "numbers", "totals"))
        return Pairs(ids, n, np.cumsum(steps), totals, shards), ids, n, totals

    asked = "shard int, block long, contexts binary, sizes binary, often binary, words binary, counts binary"

    def ask_pairs(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                pairs, ids, n, _ = read(batch, k)
                found = counts(batch, k, pairs.at, n, len(pairs.word))
                shard, context, word, place, found = (x[pairs.order] for x in (pairs.shard, pairs.context, pairs.word, pairs.place, found))
                begins = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (shard[1:] != shard[:-1]))) if len(word) else np.zeros(0, np.int64)
                sizes = np.diff(np.append(begins, len(word)))
                heads = np.searchsorted(shard[begins], np.arange(shards + 1))
                edges = np.append(begins, len(word))[heads]
                some = np.flatnonzero(np.diff(edges))
                per_context = (_steps(context[begins], heads[some]), sizes, pairs.totals[place[begins]])
                blobs = [pa.array([_packed(x[heads[s] : heads[s + 1]]) for s in some], pa.binary()) for x in per_context]
                blobs += [pa.array([_packed(x[edges[s] : edges[s + 1]]) for s in some], pa.binary()) for x in (_steps(word, begins), found)]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), batch["block"][k].as_py())), *blobs], ["shard", "block", "contexts", "sizes", "often", "words", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        """For each block the stored probabilities of its bigrams (none: 0) and how many next words its contexts have here.

        A row without a block has the contexts that are spread over shards.
        """
        heads, often, contexts, words, found = [], [], [], [], []
        for k in range(group.num_rows):
            size = _numbers(group["sizes"][k]).astype(np.int64)
            heads.append(np.cumsum(_numbers(group["contexts"][k]), dtype=np.int64))
            often.append(_numbers(group["often"][k]).astype(np.int64))
            contexts.append(np.repeat(heads[-1], size))
            words.append(_runs(_numbers(group["words"][k]), np.cumsum(size) - size))
            found.append(_numbers(group["counts"][k]).astype(np.int64))
        context, word = np.concatenate(contexts), np.concatenate(words)
        own, at = np.unique(np.concatenate(heads), return_index=True)
        total = np.concatenate(often)[at]
        next_, rank = np.unique(word, return_inverse=True)
        code, back = np.unique(np.searchsorted(own, context) * len(next_) + rank, return_inverse=True)
        count = np.bincount(back, np.concatenate(found), len(code))
        width = max(1, len(next_))
        some = count > 0
        trie = Trie(mapped(Trie.stored(own[code[some] // width], next_[code[some] % width], (count[some] - DISCOUNT) / total[code[some] // width])))
        _, second = trie.find(own[code // width], next_[code % width])  # each bigram once, whoever asks
        first = trie.contexts.find(own)
        found_codes = np.append(trie.codes, np.uint16(0))[second][back]
        found_conts = np.append(trie.continuations, np.uint32(0))[first]
        edges = np.cumsum([0, *map(len, words)])
        codes = [_packed(found_codes[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        conts = [_packed(found_conts[np.searchsorted(own, h)]) for h in heads]
        shard, block = group["shard"].to_pylist(), group["block"].to_pylist()
        hot = np.flatnonzero(total > SHARD)
        if len(hot):
            shard, block = [*shard, shard[0]], [*block, None]
            codes.append(_packed(own[hot]))
            conts.append(_packed(found_conts[hot]))
        return pa.table([pa.array(shard, pa.int32()), pa.array(block, pa.int64()), pa.array(codes, pa.binary()), pa.array(conts, pa.binary())], ["shard", "block", "codes", "continuations"])

    answers = written(known.mapInArrow(ask_pairs, asked).groupBy("shard").applyInArrow(answer, "shard int, block long, codes binary, continuations binary"), "lm-answers")

    def opened(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(_numbers(batch[x][k]).astype(np.int64)) for x in ("codes", "continuations")], ["context", "n"])

    # at most one context for every SHARD tokens of the corpus
    spread = answers.filter("block is null").select("codes", "continuations").mapInArrow(opened, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")).orderBy("context").collect()
    spread = spark.sparkContext.broadcast((np.array([r["context"] for r in spread], np.int64), np.array([r["n"] for r in spread], np.int64)))

    def scored(own: pa.Table, rows: pa.Table) -> pa.Table:
        pairs, ids, n, totals = read(own)
        order = np.argsort(rows["shard"].to_numpy())
        codes = np.empty(len(pairs.word), np.int64)
        codes[pairs.order] = np.concatenate([np.zeros(0, np.uint64), *(_numbers(rows["codes"][int(k)]) for k in order)]).astype(np.int64)
        conts = np.concatenate([np.zeros(0, np.uint64), *(_numbers(rows["continuations"][int(k)]) for k in order)]).astype(np.int64)
        context, shard = pairs.place[pairs.order], pairs.shard[pairs.order]
        begins = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (shard[1:] != shard[:-1]))) if len(context) else np.zeros(0, np.int64)
        different = np.zeros(len(totals) + 1, np.int64)
        different[context[begins]] = conts
        hot, sums = spread.value
        if len(hot):
            numbers = np.zeros(len(totals) + 1, np.int64)
            numbers[pairs.place] = pairs.context
            at = np.minimum(np.searchsorted(hot, numbers), len(hot) - 1)
            is_hot = (hot[at] == numbers) & (pairs.totals > SHARD)
            different[is_hot] = sums[at[is_hot]]
        share = np.where(pairs.totals > 0, DISCOUNT * different / np.maximum(pairs.totals, 1), 1.0)
        uni = np.log10((totals + 1) / (N + V + 1))
        p = np.log10(restored(codes) + share[pairs.place] * 10.0 ** uni[pairs.next])
        sums_ = [n, B.sums((totals[ids] > 0).astype(np.int64), n), np.full(len(n), N), B.sums(uni[ids], n), B.sums(p[pairs.at], n)]
        return pa.table([own["ids"].combine_chunks().flatten(), own["held"].combine_chunks().flatten(), *map(pa.array, sums_)], names)

    names = [id, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"`{id}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return known.groupBy("block").cogroup(answers.filter("block is not null").groupBy("block")).applyInArrow(scored, schema)
