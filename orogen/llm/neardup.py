"""Near duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. Document frequencies of five-word shingles, over all documents, in a count sketch of fixed size.
2. Each text gets 36 consistent weighted samples; three of them are a band.  Equal texts are one class
   from here on.  Classes that share a band value are a bucket.
3. A small bucket is compared pair by pair.  Pairs of which enough samples agree are verified: weighted Jaccard
   similarity of the whole texts.
4. A larger bucket is compared with one member, its centre.  Every member becomes its difference from the bucket's
   template (what most members have), a weighted set that is short for copies.  With D the weight of a difference and
   W that of the text, two texts are similar exactly if their differences overlap by (x + y) / 2 at least, x = D - W / 9
   (for a similarity of 0.8).  So whoever is close enough to the member next to the template is linked to it without a look
   at the texts; all pairs beyond share one of the rarest parts of their differences (a prefix filter), which become the
   buckets of the next round.  What a template crowd has in common is no part of any difference.
5. Links become groups by alternating large and small stars.

Only step 2 is approximate (a pair at 0.8 shares no band with probability 2e-4).  Members, not pairs, are shuffled; hot
keys meet only in joins that adaptive execution can split and in sums that combine before the shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orogen.llm import bytework as B
from orogen.llm.cluster import dropped, sketch, written
from orogen.llm.cluster import small as small_or_shuffled

WORDS, SIMILARITY = 5, 0.8
#: Bands of samples: a pair at 0.8 shares one with probability 1 - (1 - 0.8^3)^12 = 0.9998.
BANDS, ROWS = 12, 3
#: Members of a bucket up to which all its pairs are compared.
FEW = 16
#: Pairs that a bucket of differences may have; those of a larger one differ from a template of their own again.
PAIRS = 1 << 22
#: Rounds of differences; after them buckets of any size are joined under the bound on their overlap.
ROUNDS = 6
#: Samples that must agree for texts to be compared: a pair at 0.8 has fewer with probability 1e-4.
AGREE = 19
#: Columns of the samples, four to a column.
PACKED = [f"s{k}" for k in range(BANDS * ROWS // 4)]
#: log2 of the counters of a sketch of frequencies.
SKETCH = 20
#: 64-bit words of the map of a difference.
MAP = [f"m{k}" for k in range(8)]
#: A shingle in fewer than one of RARE documents counts as rare; IDF lies in [1, 1 + LIFT].
RARE, LIFT = 500, 0.15
#: Weight that a place of the map stands for: that of a rare shingle.
UNIT = 1 + LIFT

_ODD = np.random.default_rng(5).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(counts: np.ndarray, h: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words and runs per document; a shorter text is one run of all its words."""
    total = len(h)
    ends = np.cumsum(counts)
    begins = ends - counts
    per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = B.ranges(begins, per)
    out = np.zeros(len(at), np.uint64)
    left = np.minimum(np.repeat(ends, per) - at, width)
    for k in range(width):
        inside = k < left
        out += np.where(inside, h[np.minimum(at + k, max(total - 1, 0))] * _ODD[k], np.uint64(0)) if total else np.uint64(0)
    return B.mix(out + left.astype(np.uint64)), per


def distinct(h: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document in a fixed order, their number of times, and how many each document has."""
    owner = np.repeat(np.arange(len(per), dtype=np.uint64), per)
    key = h ^ B.mix(owner + np.uint64(1))  # another order for each document; one sort does for all
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(key)))
    hs, owner = h[order][first], owner[first].astype(np.int64)
    back = np.argsort(owner, kind="stable")
    return hs[back], times[back], np.bincount(owner, minlength=len(per))


def packed(found: np.ndarray) -> np.ndarray:
    """16 bits of each sample, four to a signed 64-bit number."""
    bits = B.mix(np.ascontiguousarray(found).view(np.uint64)) >> np.uint64(48)
    return np.ascontiguousarray(bits.astype(np.uint16)).view(np.int64)


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at 0, 1/n, ..., 1 (the ends pulled in)."""
    u = np.clip(np.arange(n + 1) / n, 0.02 / n, 1 - 0.02 / n)
    low, high = np.zeros(n + 1), np.full(n + 1, 60.0)
    for _ in range(60):  # bisection of 1 - (1 + x) exp(-x) = u
        mid = (low + high) / 2
        up = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


_Q = _gamma_quantiles(1 << 12)
_R, _RI = _Q[:-1] + np.diff(_Q) / 2, 1 / (_Q[:-1] + np.diff(_Q) / 2)
_LC = np.log(_gamma_quantiles(1 << 14))
_LC, _DC = _LC[:-1].copy(), np.diff(_LC)


def samples(h: np.ndarray, weight: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """ICWS: for each document (of ``counts`` shingles) and k functions, the smallest log a = ln c - r (t - beta + 1).

    r and c follow Gamma(2, 1), beta is uniform, t = floor(ln weight / r + beta), all from one hash of
    the shingle per function.  The value names its shingle and t, so equal values are equal samples.
    Documents without shingles get NaN.
    """
    out = np.full((len(counts), k), np.nan)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    log = np.log(weight)
    edges = np.cumsum(counts) - counts
    for a in range(0, len(some), 128):
        part = some[a : a + 128]
        i, j = edges[part[0]], edges[part[-1]] + counts[part[-1]]
        for b in range(k):
            x = B.mix(h[i:j] * _ODD[8 + b % 48] + np.uint64((b + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            r = (x & np.uint64(0xFFF)).astype(np.int64)
            c = (x >> np.uint64(12) & np.uint64(0x3FFF)).astype(np.int64)
            beta = (x >> np.uint64(26) & np.uint64(0xFFF)) * (1 / 4096)
            t = np.floor(log[i:j] * _RI[r] + beta)
            value = _LC[c] + _DC[c] * ((x >> np.uint64(38)) * (1 / (1 << 26))) - _R[r] * (t - beta + 1)
            out[part, b] = np.minimum.reduceat(value, edges[part] - i)
    return out


def bands(found: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of samples, as signed 64-bit numbers."""
    bits = np.ascontiguousarray(found).view(np.uint64).reshape(len(found), n, rows)
    out = np.zeros((len(found), n), np.uint64)
    for k in range(rows):
        out = B.mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return out.view(np.int64)


class Idf:
    """Weights of shingles by their document frequency.

    A counter holds a share of all shingles besides the one asked for; the mean is taken off.  Below
    n / RARE documents a shingle counts as rare (1 + LIFT); one in every document weighs 1.
    """

    def __init__(self, counts: np.ndarray, n: int):
        df = counts - counts.mean()
        rare = max(1.0, n / RARE)
        depth = np.log(max(n, 2) / rare) or 1.0
        rarity = np.log(max(n, 2) / np.clip(df, rare, max(n, 2))) / depth
        self.table = (1 + LIFT * np.round(np.clip(rarity, 0, 1) * 32) / 32).astype(np.float32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return self.table[(h >> np.uint64(64 - SKETCH)).astype(np.int64)]


def idf(texts: DataFrame) -> Idf:
    """Document frequencies over all rows of texts (column text); the sketch has 4 MB for any input."""

    def keys(batch):
        for _, _, per, h in B.words(batch.column(0)):
            yield distinct(*shingles(per, h))[0]

    return Idf(sketch(texts, keys, SKETCH), texts.count())


def weighted(words: tuple, weigh: Idf) -> tuple[np.ndarray, np.ndarray]:
    h, times, _ = distinct(*shingles(*words))
    return h, times * weigh(h)


def difference(a: tuple[np.ndarray, np.ndarray], c: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How a differs from c, as a weighted set: what it has more of and, under other names, less of."""
    keys, at = np.unique(np.concatenate([a[0], c[0]]), return_inverse=True)
    more = np.bincount(at, np.concatenate([a[1], -c[1]]), len(keys))
    keys, more = keys[more != 0], more[more != 0]
    return np.where(more > 0, keys, B.mix(keys)), np.abs(more)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of shingles with weights (1 for two empty ones)."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][x], b[1][y]).sum(dtype=np.float64))
    whole = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - both
    return both / whole if whole else 1.0


def text_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word sequence, as signed 64-bit numbers."""
    first, second = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for _, _, per, h in B.words(texts):
        place = np.arange(len(h)) - np.repeat(np.cumsum(per) - per, per)
        for odd, out in ((_ODD[60], first), (_ODD[61], second)):
            z = B.mix(h + (place.astype(np.uint64) + np.uint64(1)) * odd)
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(z, out=total[1:])
            at = np.concatenate(([0], np.cumsum(per)))
            out.append(B.mix(total[at[1:]] - total[at[:-1]] + per.astype(np.uint64)))
    return np.concatenate(first).view(np.int64), np.concatenate(second).view(np.int64)


def keyed(docs: DataFrame, text: str = "text", names: tuple[str, str] = ("k1", "k2")) -> DataFrame:
    """Rows with the keys of their text in two more columns."""
    at = docs.columns.index(text)

    def add(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, text_keys(batch.column(at)))], [*batch.schema.names, *names])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in names)]))


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id and class_id (smallest id of its group).

    Texts are words between white space, A-Z lowered.  Equal word sequences are copies; null counts as
    empty, and texts without words are copies of each other.  A text of fewer than five words is one
    shingle.  Repeated rows stay, with one class.  Texts, not ids, are compared: rows with a null id are
    searched like others, but name a class only if no row of it has an id (then class_id is null).  An id
    of several texts names each of their classes of which it is the smallest.  Other columns are not read.
    """
    signed, named = grouped(docs, text, id, similarity)
    return signed.join(named, ["k1", "k2"]).select(F.col("id").cast(docs.schema[id].dataType).alias(id), "class_id")


def grouped(docs: DataFrame, text: str = "text", id: str = "doc_id", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows (id, k1, k2: their text's key), and for each text k1, k2, least (its smallest id), group and class_id."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    weigh = spark.sparkContext.broadcast(idf(texts.select("text")))
    names = [f"b{k}" for k in range(BANDS)]
    columns = [*names, *PACKED]

    def sign(batches):
        for batch in batches:
            found = []
            for _, _, per, h in B.words(batch.column(1)):
                s, times, counts = distinct(*shingles(per, h))
                drawn = samples(s, times * weigh.value(s), counts, BANDS * ROWS)
                found.append(np.concatenate([bands(drawn), packed(drawn)], axis=1))
            made = np.concatenate(found) if found else np.zeros((0, len(columns)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, text_keys(batch.column(1))), *(pa.array(np.ascontiguousarray(made[:, k])) for k in range(len(columns)))], ["id", "k1", "k2", *columns])

    signed = written(texts.mapInArrow(sign, "id long, k1 long, k2 long, " + ", ".join(f"{n} long" for n in columns)), "neardup-signed")
    classes = written(signed.groupBy("k1", "k2").agg(F.min("id").alias("least"), *(F.max(n).alias(n) for n in columns)), "neardup-classes")
    stars = _groups(classes.withColumnRenamed("k1", "id"), texts, names, weigh, similarity)
    stars = stars.unionByName(stars.select(F.col("root").alias("rep"), "root").distinct())
    lead = stars.join(classes.select(F.col("k1").alias("rep"), "least"), "rep").groupBy("root").agg(F.min("least").alias("lead"))
    named = classes.select("k1", "k2", "least").join(stars.join(lead, "root").withColumnRenamed("rep", "k1"), "k1", "left")
    class_id = F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("lead")).alias("class_id")
    named = written(named.select("k1", "k2", "least", F.coalesce("root", "k1").alias("group"), class_id), "neardup-named")
    dropped(classes)
    weigh.destroy()  # what is returned is read from tables
    return signed.select("id", "k1", "k2"), named


def _groups(profile: DataFrame, texts: DataFrame, names: list[str], weigh, similarity: float) -> DataFrame:
    """Groups of linked texts, as components() gives them.

    ``profile`` has a row for each text: its key (id), its bands and samples.
    """
    spark, part = profile.sparkSession, (1 - similarity) / (1 + similarity)
    # no texts but those that share a band with another are read again
    rows = profile.select("id", F.posexplode(F.array(*names)).alias("band", "value")).select("id", F.xxhash64("band", "value").alias("bucket"))
    rows = rows.withColumns({"line": F.lit(0).cast("long"), "seeks": F.lit(True), "found": F.lit(True)})
    kept = facts = roots = None
    links: list[DataFrame] = []

    def one(text: str) -> tuple[np.ndarray, np.ndarray]:
        _, _, per, h = next(B.words(pa.array([text], pa.string())))
        return weighted((per, h), weigh.value)

    def verify(batches):
        memo: dict[int, tuple] = {}
        for batch in batches:
            ok = []
            a, b, x, y = (batch.column(k) for k in range(4))
            for k, j in enumerate(b.to_pylist()):
                if j not in memo:
                    if len(memo) > 200:
                        memo.clear()
                    memo[j] = one(y[k].as_py())
                ok.append(jaccard(one(x[k].as_py()), memo[j]) >= similarity)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    def differ(batches):
        memo: dict[int, tuple] = {}
        for batch in batches:
            line, id, centre, x, y = (batch.column(k) for k in range(5))
            for i, j, *words in B.words(x):
                h, times, counts = distinct(*shingles(*words))
                edges, weight, found = np.append(0, np.cumsum(counts)), times * weigh.value(h), []
                for k in range(i, j):
                    c, own = centre[k].as_py(), slice(edges[k - i], edges[k - i + 1])
                    if c not in memo:
                        if len(memo) > 200:
                            memo.clear()
                        memo[c] = one(y[k].as_py())
                    f, v = difference((h[own], weight[own]), memo[c])
                    size, other = float(weight[own].sum(dtype=np.float64)), float(memo[c][1].sum(dtype=np.float64))
                    found.append((size, float(v.sum()) <= part * (size + other), f.tobytes(), v.astype("<f8").tobytes()))
                yield pa.RecordBatch.from_arrays([*(z.slice(i, j - i) for z in (line, id, centre)), *map(pa.array, zip(*found, strict=True))], ["line", "id", "centre", "size", "near", "parts", "weights"])

    for turn in range(ROUNDS + 1):
        last = turn == ROUNDS
        crowd = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("seeks").alias("seekers"), F.count_if("found").alias("finds")).filter("n > 1 AND seekers > 0 AND finds > 0")
        members = written(rows.join(crowd, "bucket"), "neardup-members")
        large = F.lit(False) if last else F.col("n") > FEW if not turn else F.col("seekers") * F.col("finds") > PAIRS
        if not turn:
            own = small_or_shuffled(written(members.select("id").distinct(), "neardup-candidates"))
            kept = written(keyed(texts.select("text")).select(F.col("k1").alias("id"), "text").join(own, "id", "left_semi").dropDuplicates(["id"]), "neardup-texts")
        pairs = _pairs(members.filter(~large), facts, profile, roots)
        pairs = written(pairs, "neardup-pairs")
        both = pairs.join(kept.withColumnsRenamed({"id": "a", "text": "x"}), "a").join(kept.withColumnsRenamed({"id": "b", "text": "y"}), "b")
        links.append(written(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "neardup-links"))
        # the centre of a bucket is who shares most buckets with most others: in a family of copies, their origin
        standing = members.groupBy("id").agg(F.sum("n").alias("standing"))
        crowded = members.filter(large).select("bucket", "id")
        best = crowded.join(standing, "id").groupBy("bucket").agg(F.max(F.struct("standing", (-F.col("id")).alias("low"), "id"))["id"].alias("centre"))
        # at first buckets of one centre go together
        line = F.xxhash64("bucket", "centre") if turn else F.xxhash64("centre")
        around = written(crowded.join(best, "bucket").select(line.alias("line"), "id", "centre").distinct(), "neardup-around")
        dropped(members, pairs)
        if around.isEmpty():
            return components(reduce(DataFrame.unionByName, links))
        both = around.join(kept.withColumnRenamed("text", "x"), "id").join(kept.withColumnsRenamed({"id": "centre", "text": "y"}), "centre")
        apart_ = written(both.select("line", "id", "centre", "x", "y").mapInArrow(differ, "line long, id long, centre long, size double, near boolean, parts binary, weights binary"), "neardup-differences")
        facts, least, close = _prefixes(spark, apart_, part)
        links += [near.filter("a <> b") for near in (apart_.filter("near").select(F.col("id").alias("a"), F.col("centre").alias("b")), close)]
        links = [written(reduce(DataFrame.unionByName, links), "neardup-links")]
        roots = components(links[0])
        seeking = least.filter("NOT close").select("line", "id", "next")
        seeking = apart(seeking, "id", "next", roots).select("line", "id", F.lit(True).alias("seeks"))
        seeking = written(seeking, "neardup-seeking")
        rows = facts.join(seeking.select("line").distinct(), "line", "left_semi").join(seeking, ["line", "id"], "left").na.fill({"seeks": False})
        rare = rows.select("line", "id", "seeks", F.lit(True).alias("found"), F.explode("rare").alias("bucket"))
        rest = rows.filter("seeks").select("line", "id", "seeks", F.lit(False).alias("found"), F.explode("rest").alias("bucket"))
        rows = rare.unionByName(rest)


def _pairs(members: DataFrame, facts: DataFrame | None, profile: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs (a, b), a > b, of members of a bucket of which enough samples agree, in different groups by now.

    With facts (of differences) only those whose maps allow the overlap that similarity takes.
    """
    if facts is None:
        samples_ = members.select("id", "bucket").join(profile.select("id", *PACKED), "id")
        other = samples_.select("bucket", *(F.col(x).alias(f"b_{x}") for x in ("id", *PACKED)))
        return samples_.join(other, "bucket").filter("id > b_id").filter(agreeing() >= AGREE).select(F.col("id").alias("a"), F.col("b_id").alias("b")).distinct()
    known = members.select("line", "bucket", "id", "seeks", "found").join(facts.select("line", "id", "excess", "beyond", *MAP), ["line", "id"])
    other = known.filter("found").select("bucket", *(F.col(x).alias(f"b_{x}") for x in ("id", "excess", "beyond", *MAP)))
    shared = sum(F.bit_count(F.col(x).bitwiseAND(F.col(f"b_{x}"))) for x in MAP)
    bound = shared * F.lit(UNIT) + F.least("beyond", "b_beyond")
    found = known.filter("seeks").join(other, "bucket").filter("id <> b_id").filter(2 * bound >= F.col("excess") + F.col("b_excess") - 1e-6)
    pairs = apart(found.select(F.greatest("id", "b_id").alias("a"), F.least("id", "b_id").alias("b")).distinct(), "a", "b", roots)
    agree = profile.select("id", *PACKED)
    pairs = pairs.join(agree.withColumnRenamed("id", "a"), "a").join(agree.select(F.col("id").alias("b"), *(F.col(x).alias(f"b_{x}") for x in PACKED)), "b")
    return pairs.filter(agreeing() >= AGREE).select("a", "b")


def _prefixes(spark, differences: DataFrame, part: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the next round takes from the differences of lines.

    Facts: line, id, excess (x), map of the difference (and the weight beyond UNIT on its places), keys of the rarest
    parts (rare) and of the rest.  Then line, id, next (the member next to the
    line's template), close (similar to it for sure); and these sure links.
    """
    key = lambda line, f: B.mix(f ^ B.mix(line))

    def opened(batch, k: int):
        """Parts and weights of rows, one after another, and how many each row has."""
        n = np.array([len(x.as_buffer()) // 8 for x in batch.column(k)], np.int64)
        f, v = (np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in batch.column(q)), kind) for q, kind in ((k, "<u8"), (k + 1, "<f8")))
        return f, v, n

    def keys(batch):
        f, _, n = opened(batch, 1)
        yield key(np.repeat(batch.column(0).to_numpy().view(np.uint64), n), f)

    counts = sketch(differences.select("line", "parts", "weights"), keys, SKETCH)
    often = spark.sparkContext.broadcast(counts.astype(np.float32))  # never too small
    per = differences.groupBy("line").agg(F.count("*").alias("n"))
    per = small_or_shuffled(written(per, "neardup-lines"))

    def common(batches):
        for batch in batches:
            f, v, n = opened(batch, 2)
            line, of = (np.repeat(batch.column(k).to_numpy(), n) for k in (0, 1))
            hit = np.flatnonzero(often.value[(key(line.view(np.uint64), f) >> np.uint64(64 - SKETCH)).astype(np.int64)] > 0.5 * of)
            _, first, times = np.unique(key(line[hit].view(np.uint64), f[hit]), return_index=True, return_counts=True)
            hit = hit[first]
            yield pa.RecordBatch.from_arrays([pa.array(line[hit]), pa.array(f[hit].view(np.int64)), pa.array(v[hit]), pa.array(times)], ["line", "f", "v", "times"])

    # the sketch names what may be common; whether it is, is counted
    template = differences.join(per, "line").select("line", "n", "parts", "weights").mapInArrow(common, "line long, f long, v double, times long")
    template = template.groupBy("line", "f").agg(F.min("v").alias("v"), F.sum("times").alias("times")).join(per, "line").filter("times > 0.5 * n")
    template = template.groupBy("line").agg(F.collect_list(F.struct("f", "v", "times")).alias("t"))
    template = written(template.select("line", F.col("t.f").alias("tf"), F.col("t.v").alias("tv"), F.col("t.times").alias("tt")).join(per, "line", "right"), "neardup-templates")

    def adjust(batches):
        """Differences from the template, rarest parts first."""
        for batch in batches:
            f, v, n = opened(batch, 7)
            line, size, of = (batch.column(k).to_numpy() for k in (0, 2, 3))
            edges, out = np.append(0, np.cumsum(n)), []
            for k in range(batch.num_rows):
                own, w = f[edges[k] : edges[k + 1]], v[edges[k] : edges[k + 1]]
                rarity = often.value[(key(line[k : k + 1].view(np.uint64), own) >> np.uint64(64 - SKETCH)).astype(np.int64)]
                t, tw, there = (batch.column(q)[k].values for q in (4, 5, 6))
                if t is not None and len(t):
                    t, tw, there = t.to_numpy().view(np.uint64), tw.to_numpy(), there.to_numpy()
                    names, at = np.unique(np.concatenate([own, t]), return_inverse=True)
                    more = np.bincount(at, np.concatenate([w, -tw]), len(names))
                    seldom = np.zeros(len(names))
                    seldom[at] = np.concatenate([rarity, there])
                    some = np.abs(more) > 1e-9
                    names, more, seldom = names[some], more[some], seldom[some]
                    own, w, rarity = np.where(more > 0, names, B.mix(names ^ np.uint64(1))), np.abs(more), np.where(more > 0, seldom, np.maximum(of[k] - seldom, 0))
                order = np.lexsort((own, rarity))
                own, w = own[order], w[order]
                out.append((float(w.sum()) - part * size[k], own.astype("<u8").tobytes(), w.astype("<f8").tobytes(), (rarity[order] > 1.5).tobytes()))
            kinds = [pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            made = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["line", "id", "excess", "parts", "weights", "shared"])

    marks = differences.join(small_or_shuffled(template), "line").select("line", "id", "size", "n", "tf", "tv", "tt", "parts", "weights")
    marks = written(marks.mapInArrow(adjust, "line long, id long, excess double, parts binary, weights binary, shared binary"), "neardup-marks")
    least = marks.groupBy("line").agg(F.min(F.struct("excess", "id")).alias("m")).select("line", F.col("m.excess").alias("least"), F.col("m.id").alias("next"))
    least = small_or_shuffled(written(least, "neardup-least"))
    marks = marks.join(least, "line")

    def cut(batches):
        for batch in batches:
            f, w, n = opened(batch, 4)
            line, excess, low = (batch.column(k).to_numpy() for k in (0, 2, 3))
            edges, maps, beyond, rare, rest = np.append(0, np.cumsum(n)), np.zeros((len(n), 64 * len(MAP)), np.uint8), np.zeros(len(n)), [], []
            for k in range(len(n)):
                own, mine = f[edges[k] : edges[k + 1]], w[edges[k] : edges[k + 1]]
                weight = np.bincount((B.mix(own) >> np.uint64(55)).astype(np.int64), mine, maps.shape[1])
                maps[k], beyond[k] = weight > 0, np.maximum(weight - UNIT, 0).sum()
                need = (excess[k] + abs(low[k])) / 2
                left = np.cumsum(mine[::-1])[::-1]  # weight from each part on
                upto = int((left > need * (1 + 1e-9) if low[k] <= 0 else left > need - 1e-6).sum())
                names = key(line[k : k + 1].view(np.uint64), own).view(np.int64)
                some = np.frombuffer(batch.column(6)[k].as_buffer(), bool)  # a part that one member has alone is no bucket
                rare.append(names[:upto][some[:upto]])
                rest.append(names[upto:][some[upto:]])
            words = np.packbits(maps, axis=1).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in z])), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *z]))) for z in (rare, rest)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(beyond), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(len(MAP))), *lists], ["line", "id", "excess", "beyond", *MAP, "rare", "rest"])

    facts = marks.select("line", "id", "excess", "least", "parts", "weights", "shared").mapInArrow(cut, "line long, id long, excess double, beyond double, " + ", ".join(f"{x} long" for x in MAP) + ", rare array<long>, rest array<long>")
    near = marks.select("line", "id", "next", (F.col("excess") + F.col("least") <= 0).alias("close"))
    facts = written(facts, "neardup-facts")
    often.destroy()
    return facts, near, near.filter("close").select(F.col("id").alias("a"), F.col("next").alias("b"))


def agreeing():
    """How many samples of a row and of its b_ columns are equal: 16 bits each, four to a number."""
    equal = []
    for name in PACKED:
        differ = F.col(name).bitwiseXOR(F.col(f"b_{name}"))
        equal += [F.when(F.shiftrightunsigned(differ, 16 * k).bitwiseAND(0xFFFF) == 0, 1).otherwise(0) for k in range(4)]
    return sum(equal[1:], equal[0])


def apart(rows: DataFrame, x: str, y: str, roots: DataFrame) -> DataFrame:
    """Rows whose ids x and y are in different groups."""
    own = rows.join(roots.withColumnsRenamed({"rep": x, "root": "__x"}), x, "left").join(roots.withColumnsRenamed({"rep": y, "root": "__y"}), y, "left")
    return own.filter(F.coalesce("__x", x) != F.coalesce("__y", y)).select(*rows.columns)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rep, root (its smallest id), for all ids but the roots.

    Alternates large and small stars until nothing changes; the number of rounds follows the
    logarithm of the component size.
    """
    edges, mark = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), None
    while True:
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        new = written(small, "neardup-stars")
        row = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
        if mark is not None:
            dropped(edges)
        if (row["n"], row["h"]) == mark:
            return new.select(F.col("v").alias("rep"), F.col("u").alias("root"))
        edges, mark = new, (row["n"], row["h"])
