"""Operators against brute force, exact round trips and held-out accuracy on small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orogen.llm import bytework, chat, forest, html, lm, media, mixing, neardup, packing, queries, tokens, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score string"
LONG = "lorem ipsum " * 30_000
TEXTS = [None, "", "  \n", "one", "a b c d", "x" * 5000, LONG, LONG, "same words here again and again now", "same words here again and again now", "<|endoftext|> it's　wide  spaces  \n\n end ", "é́ ÀÉ café"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if k == 3 else k, t, "en", None if k % 3 == 0 else f"s{k % 2}", 0, 7, "clash") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4]], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_and_hashes():
    texts = [*TEXTS, "A b\tC\x0bd", "\x1c"]
    counts, found = [], []
    for _, _, n, h in bytework.words(pa.array(texts, pa.string()), limit=4096):
        counts += n.tolist()
        found += h.tolist()
    plain = [w for t in texts for w in words(t)]
    assert counts == [len(words(t)) for t in texts]
    assert len(set(plain)) == len(set(found)) == len(set(zip(plain, found, strict=True)))


@pytest.mark.parametrize("name, keep", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_are_the_library_s(name, keep):
    rng = np.random.default_rng(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(list(" ab\n\té'1.　<| \x1c "), 50)) for _ in range(500)]
    enc = tokens.encoder(public_tokenizers.path(name), keep, True)
    want = [x.ids for x in enc.library.encode_batch(texts, add_special_tokens=False)]
    counts, ids = [], []
    for _, _, n, i in enc.each(pa.array(texts)):
        counts += n.tolist()
        ids += i.tolist()
    assert counts == [len(x) for x in want] and ids == [i for x in want for i in x]


def test_token_counts(spark, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = tokens.count_tokens(odd, path).collect()
    assert len(got) == len(TEXTS) + 1
    at = {r["doc_id"]: r for r in got}
    assert at[0]["n_tokens"] == at[1]["n_tokens"] == 0 and at[6]["over_limit"] and at[6]["n_bytes"] == len(LONG)
    assert tokens.count_tokens(none, path).count() == 0


def test_packing(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(odd, path).collect()
    by = Counter()
    for r in got:
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= 2048
    for s in by:
        ends = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == ends
            ends += r["length"]
    ids = [*tokens.encoder(path, True, True).library.encode(LONG, add_special_tokens=False).ids, 0]
    mine = sorted((r for r in got if r["doc_id"] == 6), key=lambda r: r["piece"])
    assert [r["ids_crc32"] for r in mine] == [zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in mine]
    assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] == 2048 for r in mine[1:])
    assert packing.pack(none, path).count() == 0


def test_packing_spreads_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "the same words " * 20)] * 3000, "doc_id long, text string").repartition(2)
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), group=500)
    per = [r["count"] for r in got.groupBy((F.col("sequence_id") % 6).alias("g")).count().collect()]
    assert sum(per) == 3000 and len(per) == 6 and max(per) < 700


def test_words_built_alike_keep_their_ids(spark):
    line, texts = "ab", []
    for _ in range(12):
        line += line.translate(str.maketrans("ab", "ba"))
        texts += [line, line.translate(str.maketrans("ab", "ba"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    for name, keep in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        library = tokens.encoder(public_tokenizers.path(name), keep).library
        got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, public_tokenizers.path(name), keep_space=keep).collect()}
        assert got == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    ids = {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    assert all(crc[k, 0] == zlib.crc32(np.array(i, "<u4").tobytes()) for k, i in ids.items() if len(i) <= 2048)
    classes = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert all(classes[k] == k for k in classes)


def test_sum_of_squares_is_near_the_bound():
    n = np.clip(np.random.default_rng(2).exponential(600, 6000), 1, 2048).astype(np.int64)
    s, _ = packing.sum_of_squares(n, 2048)
    assert np.bincount(s, n).max() <= 2048 and s.max() + 1 <= 1.02 * n.sum() / 2048


def test_mix(spark, odd, none):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(mixing.SQL).fetchall())
    names = [c[0] for c in con.execute(mixing.SQL).description]
    assert sorted(map(tuple, mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).select(*names).collect())) == want
    got = mixing.mix(odd).collect()
    assert len(got) == len(TEXTS) + 1 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.emitted(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got[None] == 10 and sum(got.values()) == pytest.approx(1.5 * 2015)
    assert got["c"] / got["b"] == pytest.approx(2.0)


def test_near_duplicates(spark, odd, none):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(40):
        base = list(rng.choice(vocabulary, int(rng.integers(60, 300))))
        for c in range(int(rng.integers(1, 30))):
            own = list(base)
            for k in rng.choice(len(own), int(rng.integers(0, 5)), replace=False):
                own[k] = f"e{g}x{c}x{k}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    weigh = neardup.idf(docs.select("text"))
    sets = [neardup.weighted(next(bytework.words(pa.array([t])))[2:], weigh) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [(i, j) for i in range(len(rows)) for j in range(i) if neardup.jaccard(sets[i], sets[j]) >= 0.8]
    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    lost = sum(got[i] != got[j] for i, j in links)
    assert lost <= 0.005 * len(links)
    assert all(root(k) == root(got[k]) for k in range(len(rows)))
    few = {(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(odd).collect()}
    assert {(0, 0), (1, 0), (2, 0), (6, 6), (7, 6), (8, 8), (9, 8)} <= few
    assert neardup.near_duplicates(none).count() == 0


def test_far_texts_meet_the_group_of_a_centre(spark):
    rng = np.random.default_rng(11)
    rows, lone = [], []
    for g in range(12):
        base = [f"g{g}w{k}" for k in rng.permutation(400)]
        more = [f"m{g}x{k}" for k in range(108)]
        family = [" ".join([*base[:k], f"e{g}x{k}", *base[k + 1 :]]) for k in rng.integers(20, 380, 40)]
        family += [" ".join(base), " ".join(base + more[:20]), " ".join(base + more)]
        lone.append(len(rows) + len(family) - 1)
        rows += [(len(rows) + k, t) for k, t in enumerate(family)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weigh = neardup.idf(docs.select("text"))
    sets = {k: neardup.weighted(next(bytework.words(pa.array([rows[k][1]])))[2:], weigh) for n in lone for k in range(n - 2, n + 1)}
    assert all(neardup.jaccard(sets[n], sets[n - 2]) < 0.8 <= neardup.jaccard(sets[n], sets[n - 1]) for n in lone)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert all(got[n] == got[n - 1] == got[n - 2] for n in lone)


def test_weighted_samples_estimate_jaccard():
    rng = np.random.default_rng(6)
    h = bytework.mix(np.arange(1, 400, dtype=np.uint64))
    a, b = rng.uniform(0.5, 3, 399), rng.uniform(0.5, 3, 399)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    s = neardup.samples(np.concatenate((h, h)), np.concatenate((a, b)), np.array([399, 399]), 1500)
    assert abs((s[0] == s[1]).mean() - true) < 0.05


def test_components(spark):
    chain = spark.createDataFrame([(k + 1, k) for k in range(50)] + [(100, 99)], "a long, b long")
    got = {r["rep"]: r["root"] for r in neardup.components(chain).collect()}
    assert all(got[k] == 0 for k in range(1, 51)) and got[100] == 99


def test_toxicity(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held_out = lambda id: F.crc32(id.cast("string").cast("binary")) % 5 == 0
    machine = toxicity.learn(docs, labels, held_out=held_out)
    rows = toxicity.score(docs, machine).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).select("score", "toxic").collect()
    p, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    rank = np.argsort(np.argsort(p)) + 1
    assert (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum()) > 0.9
    got = toxicity.score(odd, machine)
    assert got.count() == len(TEXTS) + 1 and got.filter("score BETWEEN 0 AND 1").count() == len(TEXTS) + 1
    assert toxicity.score(none, machine).count() == 0
    blank = toxicity.learn(docs, labels.filter("false"))
    assert toxicity.score(odd, blank).agg(F.max("predicted")).first()[0] == 0


def test_pairs_count_in_the_machine():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.sort(np.array([1] * a + [2] * b + [int(rng.integers(3, 60))])))
        y.append(float(a and b))
    place = np.full(1 << toxicity.BITS, -1, np.int32)
    place[:60] = np.arange(60)
    m = toxicity.fit(rows, np.array(y), float(np.mean(y)), place, epochs=30)
    at = lambda *t: float(m.score(np.zeros(len(t), int), m.place[np.array(t)], 1)[0])
    x = [0, 1, 2, 17]
    pairs = sum(float(m.vector[a] @ m.vector[b]) for i, a in enumerate(x) for b in x[:i])
    plain = 1 / (1 + math.exp(-(m.bias + float(m.weight[x].sum()) + pairs)))
    assert m.score(np.zeros(4, int), np.array(x), 1)[0] == pytest.approx(plain, abs=1e-5)
    assert at(1, 2) > 0.8 and at(1) < 0.5 and at(2) < 0.5


def test_language_model(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    training = lambda id: F.crc32(id.cast("string").cast("binary")) % 7 != 2
    got = {r["doc_id"]: r for r in lm.score(docs, training).collect()}
    count, plain = Counter(), {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    for k, w in plain.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            count.update([*w, None])
    N, V = sum(count.values()), len(count)
    for k, w in plain.items():
        base = sum(math.log10((count[x] + 1) / (N + V + 1)) for x in [*w, None])
        assert got[k]["base_score"] == pytest.approx(base) and got[k]["n_known"] == sum(count[x] > 0 for x in [*w, None])
        assert got[k]["train_tokens"] == N and got[k]["n_tokens"] == len(w) + 1
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.score(odd, training).count() == len(TEXTS) + 1
    assert lm.score(none, training).count() == 0
    assert {r["score"] for r in lm.score(odd, lambda id: F.lit(False)).collect()} == {0.0}


@pytest.mark.parametrize("shard", [1_500_000, 300])
def test_language_model_is_an_interpolated_bigram(spark, monkeypatch, shard):
    monkeypatch.setattr(lm, "BLOCK", 2_000)
    monkeypatch.setattr(lm, "SHARD", shard)  # with 300 common words are spread over shards
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(f"w{min(x, 200)}" for x in rng.zipf(1.4, int(rng.integers(0, 200))))) for k in range(100)]
    rows += [(100, None), (101, "so rare a phrase w1"), (102, "\0end w1 \0end"), (200, "so rare a phrase w3"), (201, "rare a novelty")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, block string").repartition(4)
    got = {r["doc_id"]: r for r in lm.score(docs, lambda id: id < 200).collect()}
    texts = [[None, *words(t), "."] for k, t in rows if k < 200]
    one, two = Counter(), Counter()
    for t in texts:
        one.update(t)
        two.update(zip(t, t[1:], strict=False))
    N, V, D = sum(one.values()) - len(texts), len(one) - 1, lm.DISCOUNT
    follow = Counter(a for a, _ in two)

    def p(v, w):
        out = (one[w] + 1) / (N + V + 1)
        return max(two[v, w] - D, 0) / one[v] + D * follow[v] / one[v] * out if one[v] else out

    for k, t in rows:
        t = [None, *words(t), "."]
        assert got[k]["train_tokens"] == N and got[k]["held_out"] == (k >= 200)
        assert got[k]["base_score"] == pytest.approx(sum(math.log10((one[w] + 1) / (N + V + 1)) for w in t[1:]))
        assert got[k]["score"] == pytest.approx(sum(math.log10(p(*x)) for x in zip(t, t[1:], strict=False)), abs=2.5e-4 * len(t))


def test_end_of_text_is_no_word(spark):
    docs = spark.createDataFrame([(k, "\0end a") for k in range(20)], "doc_id long, text string")
    got = lm.score(docs, lambda id: F.lit(True)).first()
    assert got["base_score"] == pytest.approx(3 * math.log10(21 / 64)) and got["n_known"] == got["n_tokens"] == 3


def test_trie_finds_its_bigrams():
    rng = np.random.default_rng(3)
    code = np.unique(rng.integers(0, 50 * 1000, 4000))
    context, word = 7 * (code // 1000), code % 1000
    share = rng.uniform(1e-6, 1, len(code))
    trie = lm.Trie(lm.mapped(lm.Trie.stored(context, word, share)))
    known = dict(zip(zip(context.tolist(), word.tolist(), strict=True), share, strict=True))
    c, w = rng.integers(0, 360, 20_000), rng.integers(0, 1100, 20_000)
    first, second = trie.find(c, w)
    assert np.array_equal(first >= 0, np.isin(c, context))
    assert [k >= 0 for k in second] == [(a, b) in known for a, b in zip(c.tolist(), w.tolist(), strict=True)]
    hit = second >= 0
    want = np.array([known[a, b] for a, b in zip(c[hit].tolist(), w[hit].tolist(), strict=True)])
    assert np.abs(np.log10(lm.restored(trie.codes[second[hit]]) / want)).max() <= 0.5 / lm.STEPS + 1e-9
    assert trie.continuations.sum() == len(code) and lm.Trie(np.frombuffer(lm.Trie.stored(*[np.zeros(0, np.int64)] * 2, np.zeros(0)), np.uint8)).next.n == 0


def test_elias_fano():
    for values in (np.unique(np.random.default_rng(1).integers(0, 10**7, 5000)), np.array([0, 0, 3, 3, 9]), np.arange(100), np.zeros(0, np.int64)):
        ef = lm.EliasFano(np.frombuffer(lm.EliasFano.stored(values, 10**7), np.uint8))
        assert np.array_equal(ef.get(np.arange(len(values))), values)
        assert np.array_equal(values[ef.find(values)], values)
        other = np.setdiff1d(np.arange(-5, 10**6, 37), values)
        assert (ef.find(other) == -1).all()


def test_forest(spark):
    x = np.random.default_rng(5).normal(size=(1200, 16)).astype(np.float32)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(5000, x[0].tolist(), 0), (5001, None, 0), (5002, [0.0] * 16, 0), (5003, [float("nan")] * 16, 0), (5004, [1.0, None], 0), (5006, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = forest.neighbours(df, lambda id: id % 50 == 0, block=400, queries=10).collect()
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    right = 0
    for q in range(0, 1200, 50):
        s = x @ x[q]
        best = sorted((-round(v, 9), k) for k, v in [*enumerate(s), (5000, s[0])] if k != q)[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        right += len({m[1] for m in mine} & {k for _, k in best})
    assert right >= 0.9 * 5 * 24
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    pairs = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 3)) for r in forest.neighbours(twice, lambda id: id == 0).collect())
    assert pairs == sorted(2 * [(0, 1, 0, 1.0), (0, 2, 7, 0.707), (0, 3, 0, 0.0)] + [(0, 1, 7, 0.707), (0, 2, 0, 0.0), (0, 3, 0, 0.0)])
    assert [r["vec_id"] for r in got if r["query_id"] == 0 and r["rank"] == 1] == [5000]
    assert not any(r["query_id"] in (5001, 5002, 5003, 5004, 5006) for r in got)
    assert forest.neighbours(df.filter("false"), lambda id: id % 50 == 0).count() == 0


def test_forest_sends_bounded_queries(spark):
    x = np.random.default_rng(6).normal(size=(300, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = forest.neighbours(df, lambda id: id % 20 == 0, block=100, queries=8)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # query vectors, repeated for every block, once went through the driver as a broadcast side
    parts = forest.neighbours(df, lambda id: id % 20 == 0, block=100, queries=8, held=1)
    assert sorted(parts.collect()) == sorted(whole.collect()) and whole.count() == 75


PAGE = '<html><head><title>T</title></head><body class="x"><div id="top"><p>Site of all</p></div><nav><ul><li>Menu</li></ul></nav><div class="ad">Buy {k}</div><article><h1>Title {k}</h1><p><b>Text &amp; more {k}<br>line<p>Second<script>var a="</p>";</script> {k}</p><p>Share this page</p><section id="comments"><p>Reader {k}</p></section></article><aside>Side</aside><footer>&copy; {k}</footer></body></html>'


def test_main_text(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.replace("{k}", str(k)), 1) for k in range(12)] + [(100, "http://h.example/x", None, 1), (101, None, "", 1), (102, "http://o.example/", "plain <b>te</b>xt &lt; <", 1), (None, "http://h.example/1", "<p>" * 3000 + "deep", 1)]
    got = {r["page_id"]: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert len(got) == len(rows)
    assert got[3]["text"] == "Title 3 Text & more 3 line Second 3" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[100]["text"] == got[101]["text"] == "" and got[102]["text"] == "plain text < <" and got[None]["text"] == "deep"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def learnt(pages):
    tree = html.folded(html.parse(pages[0]))
    for x in pages[1:]:
        html.merge(tree, html.load(html.dump(html.folded(html.parse(x)))))
    html.decide(tree)
    return html.opened(html.rules(tree))


def test_template_decides_without_known_names():
    rng = np.random.default_rng(2)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    pages, want = [], []
    for k in range(30):
        title, lead, parts = say(6), say(60), [say(int(rng.integers(30, 90))) for _ in range(int(rng.integers(2, 60)))]
        body = "".join(f"<div class=q7>{x}</div>" for x in parts) + "<div class=q7>Printed from our site</div>"
        menu = "".join(f"<div class=x><a href=/{k}{j}>{say(2)}</a></div>" for j in range(9))
        pages.append(f"<body><div class=a1>Welcome to all</div><div class=zz>{menu}</div><div class=b2>{say(7)}</div><div class=cc><h2>{title}</h2><div class=l1><p>{lead}</p></div><div class=k>{body}</div></div><div class=end><span>Seen {k} times</span> {say(8)}</div></body>")
        want.append(" ".join([title, lead, *parts]))
    rules = learnt(pages)
    for page, text in zip(pages, want, strict=True):
        assert html.extract(html.parse(page), rules) == (text, "template")
    assert "Welcome" in html.extract(html.parse(pages[0]), None)[0]
    other = "<article><p>Of another make</p></article>"
    assert html.extract(html.parse(f"<div class=new>{other}</div>"), rules) == ("Of another make", "marks")


def test_simple_tree_matching_against_brute_force():
    rng = np.random.default_rng(7)

    def grow(depth):
        node = html.Node("abc"[int(rng.integers(3))])
        node.runs = [grow(depth - 1) for _ in range(int(rng.integers(0, 4)))] if depth else []
        return node

    def brute(a, b):
        def best(x, y):
            if not x or not y:
                return 0
            return max(best(x[1:], y), best(x, y[1:]), brute(x[0], y[0]) + best(x[1:], y[1:]))

        return 1 + best(a.runs, b.runs) if a.key == b.key else 0

    for _ in range(300):
        a, b = grow(3), grow(3)
        assert html._score(a, b, {}) == brute(a, b)


def test_long_sequences_align_in_order():
    x, y = ([html.Node(f"k{k}") for k in range(n)] for n in (400, 500))
    pairs = html._in_order(x, y[::-1][:50] + y[50:], list(range(400)), list(range(500)))
    assert pairs == sorted(pairs) and all(x[i].key == (y[::-1][:50] + y[50:])[j].key for i, j in pairs) and len(pairs) == 350


def test_odd_pages():
    deep = "<div>" * 100_000 + "deep <p>more"
    assert html.extract(html.parse(deep), None)[0] == "deep more"
    html.merge(html.folded(html.parse(deep)), html.folded(html.parse(deep)))
    assert html.extract(html.parse("<b><i>" * 50_000 + "x</q>" * 20 + "</i></b>" * 50_000), None)[0] == "x" * 20
    long = "y>" * 50_000
    assert html.extract(html.parse(f'<p title="{long}">text</p>'), None)[0] == "text"
    assert html.extract(html.parse('<p title="never ends>some <b>text</p>' * 3), None)[0] != ""
    assert html.extract(html.parse("<p>a</p><p" + " x" * 9), None)[0] == "a"


def test_chat(spark):
    parts = ["[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "[", "<", "\\", "/s>", "[\\INST]", "é", "\n", "[/ROLE]"]
    rng = np.random.default_rng(8)
    rows = [(int(c), t, [None, "user", "assistant", "system", "to\nol"][int(rng.integers(5))], "".join(rng.choice(parts, int(rng.integers(0, 8)))), 1) for c in range(30) for t in range(int(rng.integers(1, 40)))]
    rows += [(99, 0, "assistant", None, 1), (None, 0, "user", "x", 1), (99, 1, "user", LONG, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert len(got) == 32
    for c, r in got.items():
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: x[1])
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine).encode()).hexdigest()
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.filter("false"))).count() == 0


def test_media(spark, odd, none):
    got = {r["doc_id"]: r for r in media.described(media.resampled(media.store(odd))).collect()}
    for k, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[None if k == 3 else k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert media.described(media.resampled(media.store(none))).count() == 0
    pcm = media.resampled(media.store(odd).filter("doc_id = 4")).first()["pcm"]
    assert media.parse(pcm)[:3] == (media.PCM, 16000, 2)


def test_media_that_cannot_be_read(spark):
    rows = [(1, 0, None), (2, 0, b"junk"), (3, 0, b"RIFF"), (4, 2, media.wav(media.MULAW, 8000, b"ab"))]
    df = media.resampled(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, n_bytes long, media binary, pcm string"))
    got = {r["doc_id"]: r for r in media.described(df).collect()}
    assert [got[k]["payload_sha256"] for k in (1, 2, 3)] == [None] * 3 and got[4]["payload_bytes"] == 2
    assert {r["doc_id"]: r["pcm"] is None for r in df.collect()} == {1: True, 2: True, 3: True, 4: False}


def decoded(block):
    """IMA ADPCM, sample by sample."""
    steps, now, index = media.ima_steps().tolist(), int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [now]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = steps[index]
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            now = max(-32768, min(32767, now - change if code & 8 else now + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(now)
    return out


def test_adpcm_and_resampling_against_one_sample_at_a_time(spark):
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (7, 576)).astype(np.uint8)
    assert [decoded(bytes(b)) for b in blocks] == media.ima_decode(blocks).tolist()
    files = [media.wav(tag, 8000, rng.integers(0, 256, 576 * k).astype(np.uint8).tobytes(), 576 if tag == 17 else 1) for tag in media.FORMATS for k in (1, 3)]
    found = media.samples([*files, None, b"", media.wav(media.ALAW, 8000, b"")], 16000)
    for file, x in zip(files, found, strict=False):
        tag, _, _, data = media.parse(file)
        raw = sum((decoded(bytes(data[k : k + 576])) for k in range(0, len(data), 576)), []) if tag == 17 else [int((media.mulaw_table() if tag == 7 else media.alaw_table())[b]) for b in data]
        at = lambda k, r=raw: r[max(0, min(len(r) - 1, k))]
        want = [v for k in range(len(raw)) for v in (raw[k], max(-32768, min(32767, (9 * (at(k) + at(k + 1)) - at(k - 1) - at(k + 2) + 8) >> 4)))]
        assert x.tolist() == want
    assert found[-3] is None and found[-2] is None and len(found[-1]) == 0
    tags = {r["feature"].split(";")[0] for r in media.described(media.resampled(media.store(spark.createDataFrame([(k, f"text {k}") for k in range(30)], "doc_id long, text string")))).collect()}
    assert tags == {"tag=6", "tag=7", "tag=17"}
    docs = spark.createDataFrame([(k, "text " * k) for k in range(300)], "doc_id long, text string")
    assert sorted(media.described(media.store(docs)).collect()) == sorted(media.described(media.resampled(media.store(docs))).collect())


def test_companding_and_adpcm():
    u, a = media.mulaw_table(), media.alaw_table()
    assert (u[0], u[127], u[128], u[255]) == (-32124, 0, 32124, 0) and (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    t = np.arange(505)
    rows = np.stack([8000 * np.sin(t / s) for s in (5, 9, 20, 60)]).astype(np.int16)
    out = media.ima_decode(media.ima_encode(rows))
    assert out.shape == rows.shape and np.abs(out[:, 20:].astype(int) - rows[:, 20:]).mean() < 500


def test_pipeline(spark):
    import corpus_pipeline

    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names, name
        if name != "mixing":
            assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.count() <= docs.count()
        docs = out
    classes = neardup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"))
    kept = corpus_pipeline.keep_one_of_each_group(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert kept.count() == classes.select("class_id").distinct().count()
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_keeps_rows_without_ids(spark):
    import corpus_pipeline

    base = [[f"{g}word{k}" for k in range(200)] for g in "abcd"]
    near = lambda g: " ".join([*base[g][:100], "other", *base[g][101:]])
    a, b, c, d = (" ".join(w) for w in base)
    texts = [(None, a), (None, b), (None, b), (None, c), (None, near(2)), (5, d), (None, near(3)), (None, d), (7, "one id two texts of it"), (7, "and this is the other of them")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect())
    assert max(got.values()) == 1 and len(got) == 6
    assert {(None, a), (None, b), (5, d), *texts[-2:]} < set(got)
    assert len({(None, c), (None, near(2))} & set(got)) == 1


def test_queries_cover_the_list():
    assert [q.split("_")[0] for q in queries.queries()] == [*(f"op{k}" for k in range(1, 11)), "pipeline"]


def test_template_crowds_are_not_compared_pair_by_pair(spark, monkeypatch):
    seen = Counter()
    real = neardup.written

    def watched(df, name):
        out = real(df, name)
        seen[name] += out.count() if name in ("neardup-pairs", "neardup-facts") else 0
        return out

    monkeypatch.setattr(neardup, "written", watched)
    common = " ".join(f"c{k}" for k in range(160))
    for n in (300, 1200):
        seen.clear()
        docs = spark.createDataFrame([(i, common + " " + " ".join(f"u{i}x{k}" for k in range(30))) for i in range(n)], "doc_id long, text string").repartition(4)
        assert neardup.near_duplicates(docs).select("class_id").distinct().count() == n
        assert seen["neardup-pairs"] < n and seen["neardup-facts"] < 8 * n


def brute_classes(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    weigh = neardup.idf(docs.select("text"))
    sets = [neardup.weighted(next(bytework.words(pa.array([t])))[2:], weigh) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if root(i) != root(j) and neardup.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return docs, [root(k) for k in range(len(rows))]


@pytest.mark.parametrize("pairs, rounds", [(1 << 22, 6), (200, 3)])
def test_large_families_with_edits_of_edits(spark, monkeypatch, pairs, rounds):
    """All classes of a family whose members differ from its origin by up to a third, and from each other's edits."""
    monkeypatch.setattr(neardup, "PAIRS", pairs)
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    rng = np.random.default_rng(12)
    origin = [f"o{k}" for k in range(200)]
    texts = [origin]
    for k in range(400):
        own = list(texts[int(rng.integers(len(texts)))])
        kind, at = int(rng.integers(3)), int(rng.integers(0, len(own) - 40))
        if kind == 0:
            for j in rng.choice(len(own), int(rng.integers(1, 9)), replace=False):
                own[j] = f"e{k}x{j}"
        elif kind == 1:
            del own[at : at + int(rng.integers(1, 30))]
        else:
            own[at:at] = [f"i{k}x{j}" for j in range(int(rng.integers(1, 40)))]
        if len(own) > 100:
            texts.append(own)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs, want = brute_classes(spark, rows)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert sum(got[k] != want[k] for k in range(len(rows))) <= 2
    assert len(set(want)) > 3


def test_null_ids_and_shared_ids_are_compared(spark):
    base = [f"w{k}" for k in range(100)]
    near = " ".join([*base[:50], "x", *base[51:]])
    rows = [(None, " ".join(base)), (5, near), (7, "one text of seven words is here"), (7, "another text that has nothing in common")]
    got = [(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter(got) == Counter([(None, 5), (5, 5), (7, 7), (7, 7)])


def test_stages_keep_columns_nulls_and_repeats(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, score string, predicted int, size int, copies string, target string, k1 string, text_key long, n_chars long"
    tail = ("own", 7, 8, "c", "t", "k", 9, 10)
    rows = [(1, None, "en", None, *tail), (None, "", None, "s", *tail), (3, "a clean text of a few words", "en", "s", *tail), (3, "a clean text of a few words", "en", "s", *tail), (None, "another text without an id", "de", "s", *tail), (4, LONG, "en", "t", *tail)]
    docs = spark.createDataFrame(rows, schema)
    empty = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        for r in out.collect():
            assert tuple(r)[4:] == tail, name
        assert stage(spark, empty, SF).count() == 0, name
    assert corpus_pipeline.reject_toxic(spark, docs, SF).count() == len(rows)
    kept = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect())
    assert kept == Counter([(1, None), (3, "a clean text of a few words"), (None, "another text without an id"), (4, LONG)])
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.filter("piece = 0").count() == len(rows) and corpus_pipeline.pack(spark, empty, SF).count() == 0


def test_queries_keep_to_their_contracts(spark):
    columns = {
        "op1_main_text": "page_id url text n_chars",
        "op2_hash_forest": "query_id rank vec_id score",
        "op3_toxicity": "doc_id held_out score predicted",
        "op4_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op5_minhash_neardup": "doc_id class_id",
        "op6_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op7_mix_sources": "doc_id size source_size target taken",
        "op8_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op9_telephony": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op10_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    }
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {name: queries.queries()[name](spark, SF).collect() for name in columns}
    for name, wanted in columns.items():
        assert rows[name][0].__fields__[: len(wanted.split())] == wanted.split(), name
    odd = next(r for r in rows["op6_chat_format"] if r["conv_id"] == -7)
    assert odd["turns_sha256"] == hashlib.sha256(b"user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n").hexdigest()
    assert (odd["n_turns"], odd["loss_chars"], odd["loss_sha256"]) == (2, 21, hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest())
    remainder = lambda k, by: zlib.crc32(str(k).encode()) % by
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows["op3_toxicity"])
    assert all(r["held_out"] == (remainder(r["doc_id"], 7) == 2) for r in rows["op8_lm_score"])
    assert {r["query_id"] % 50 for r in rows["op2_hash_forest"]} == {0}
    for name in ("op3_toxicity", "op4_token_counts", "op5_minhash_neardup", "op7_mix_sources", "op8_lm_score", "op9_telephony"):
        assert Counter(r["doc_id"] for r in rows[name]) == Counter(docs.keys()), name
    for r in rows["op9_telephony"]:
        raw = (docs[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokens.encoder(path, True, True).library
    ids = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in docs.items()}
    covered, held = Counter(), Counter()
    for r in rows["op10_packing"]:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        covered[r["doc_id"]] += r["length"]
        held[r["sequence_id"]] += r["length"]
    assert covered == Counter({k: len(i) for k, i in ids.items()}) and max(held.values()) <= 2048
    assert len(held) <= 1.02 * sum(held.values()) / 2048 + 2
