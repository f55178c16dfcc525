"""The corpus operators against brute force, held-out accuracy and edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelgrain.llm import ann, bpe, dedup, langid, lm, mixing, quality, rules, toxicity, urls
from voxelgrain.llm.common import crc_split

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
#: Nulls in any column, empty text, a very long one, repeated rows and clashing names.
EDGE = [
    (1, None, "en", "a", 1, 0.5, "x"),
    (2, "", "en", None, 0, None, None),
    (3, "  \n\t ", None, "a", 5, 0.1, "y"),
    (4, "word " * 30_000, "en", "a", 1, 0.5, "x"),
    (5, "one two three", "en", "b", 1, 0.5, "x"),
    (5, "one two three", "en", "b", 1, 0.5, "x"),
    (None, "one two three four five six", "de", "b", None, 0.5, "x"),
    (7, "\u00e9t\u00e9 \u00c9T\u00c9 123 !!", None, None, 1, 0.5, "x"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")


def words(t):
    return (t or "").encode().lower().split()


def shingles(t, k):
    w = words(t)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components_by_brute_force(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_dedup_equals_brute_force(spark):
    r = random.Random(3)
    rows, vocab = [], [f"w{i}" for i in range(60)]
    for g in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([3, 9, 40, 120]))]
        for _ in range(r.choice([1, 4, 25])):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, block=8).collect()
    want = components_by_brute_force(rows, 4)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_dedup_edges(edge, empty):
    got = dedup.near_duplicates(edge, shingle=5).collect()
    assert len(got) == len(EDGE)
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    assert [x.n_shingles for x in by[1] + by[2] + by[3]] == [0, 0, 0] and all(x.kept for x in by[1])
    assert [x.component_id for x in by[5]] == [5, 5] and by[4][0].n_shingles == 1
    assert by[None][0].component_id is None and by[None][0].kept
    assert dedup.near_duplicates(empty).count() == 0


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    for n in (60, 400, 3000):
        base = r.integers(0, 2**64, n, dtype=np.uint64)
        other = np.concatenate([base[: int(n * 0.9)], r.integers(0, 2**64, n - int(n * 0.9), dtype=np.uint64)])
        a, b = np.unique(base), np.unique(other)
        bits, m = dedup.sketch([a, b])
        z = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        j, se = dedup.estimate(np.array([z]), m[:1].astype(float), m[1:].astype(float), np.array([float(len(a))]), np.array([float(len(b))]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(j[0] - true) <= 4 * se[0] + 0.01


def test_toxicity_learns_and_handles_edges(spark, edge, empty):
    bad, good = ["idiot", "scum", "trash"], ["tree", "house", "river", "cloud"]
    r = random.Random(5)
    rows = []
    for i in range(600):
        toxic = i % 5 == 0
        w = [r.choice(good) for _ in range(20)] + ([r.choice(bad) for _ in range(2)] if toxic else [])
        r.shuffle(w)
        rows.append((i, " ".join(w), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.train_and_score(d, d.select("doc_id", "toxic"), ["doc_id", "toxic"], crc_split("doc_id", 3) != 1).collect()
    assert sum((x.score >= 0.7) == bool(x.toxic) for x in out) >= 0.95 * len(out)
    assert not any(x.score >= 0.7 for x in out if not x.toxic)
    model = (np.array([3]), np.array([1.0]))
    assert all(0 <= x.score <= 1 for x in toxicity.score(edge, model, ["doc_id", "key"]).collect())
    assert toxicity.score(empty, model, ["doc_id"]).count() == 0
    at, w = toxicity.fit(d.limit(0).withColumnRenamed("toxic", "y"))
    assert len(at) == len(w) == 0


def test_bpe_equals_the_library(spark, docs, edge, empty):
    lib = Tokenizer.from_file(PATH)
    texts = [x.text or "" for x in docs.limit(60).collect()] + ["<|endoftext|> a <|endoftext|>", "a   b \n c", "\u00a0x  ", "'s 'll we're", "aaaaaaa" * 9, ""]
    coder = bpe.Encoder(PATH)
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
        assert coder.decode(ids) == t
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice([" ", " ", "\n", "\t", "a", "b", "'s", "1", "!", "\u2003", "\x1c", "\u00e9"]) for _ in range(r.randint(1, 9)))
        assert np.frombuffer(coder.encode([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
    enc = bpe.encode(edge, PATH, ["doc_id", "key"])
    back = bpe.decode(enc, PATH, ["doc_id"]).collect()
    assert sorted(x.text for x in back) == sorted(t[1] or "" for t in EDGE)
    assert bpe.digests(empty, PATH, ["doc_id"]).count() == 0


def lm_by_brute_force(rows):
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    tokens = lambda t: [*words(t), b"\0end"]
    c = Counter(w for _, t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    grams, total, fan = Counter(), Counter(), Counter()
    for _, t in train:
        line = [b"\0two", b"\0one", *tokens(t)]
        grams.update(tuple(line[i : i + 3]) for i in range(len(line) - 2))
        grams.update(tuple(line[i : i + 2]) for i in range(1, len(line) - 1))
    for g, k in grams.items():
        total[g[:-1]] += k
        fan[g[:-1]] += 1
    out = {}
    for i, t in rows:
        base = score = known = 0
        line = [b"\0two", b"\0one", *tokens(t)]
        for k in range(2, len(line)):
            w = line[k]
            q = (c[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(q)
            known += c[w] > 0
            for context in ((line[k - 1],), (line[k - 2], line[k - 1])):
                if total[context]:
                    q = max(grams[*context, w] - 0.75, 0) / total[context] + 0.75 * fan[context] / total[context] * q
            score += math.log10(q)
        out[i] = (len(tokens(t)), known, n, base, score)
    return out


@pytest.mark.parametrize("shuffled", [False, True])
def test_lm_equals_brute_force(docs, shuffled):
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    want = lm_by_brute_force(rows)
    d = docs.repartition(7, F.rand()) if shuffled else docs
    got = lm.score(d, crc_split("doc_id", 5) != 1, chunk_bytes=100_000, shard_tokens=5_000 if shuffled else 50_000).collect()
    assert len(got) == len(rows)
    for x in got:
        tokens, known, n, base, score = want[x.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (tokens, known, n)
        assert abs(x.base_score - base) < 1e-6 and abs(x.score - score) < 0.03 * tokens


def test_lm_edges(edge, empty):
    got = lm.score(edge, crc_split("doc_id", 5) != 1).collect()
    assert len(got) == len(EDGE) and {x.n_tokens for x in got if x.doc_id in (1, 2, 3)} == {1}
    assert all(x.train_tokens == 0 for x in lm.score(edge, F.lit(False)).collect())
    assert lm.score(empty, F.lit(True)).count() == 0


def test_elias_fano_finds_what_is_there():
    r = np.random.default_rng(0)
    for n, top in ((0, 64), (1, 64), (50, 64), (5000, 64), (5000, 13), (4000, 40)):
        v = np.sort(r.integers(0, 2**top, n, dtype=np.uint64))
        e = lm.EliasFano(*lm.EliasFano.parts(v))
        assert (e.get(np.arange(n)) == v).all()
        whole = np.zeros(n, np.int64), np.full(n, n)
        bounds = np.zeros(n, np.uint64), np.full(n, 2**top - 1, np.uint64)
        found = e.search(*whole, v, *bounds)
        assert (v[found] == v).all()
        other = r.integers(0, 2**top, n, dtype=np.uint64)
        assert ((e.search(*whole, other, *bounds) >= 0) == np.isin(other, v)).all()


def test_successors_are_those_of_their_context():
    r = np.random.default_rng(3)
    words = np.unique(r.integers(16, 2**64, 40, dtype=np.uint64))
    grams = Counter(tuple(g) for g in r.integers(0, 40, (900, 3)).tolist())
    pairs = sorted({g[:2] for g in grams})
    number = {p: k for k, p in enumerate(pairs)}
    tri = sorted(grams)
    trie = lm.Trie(words, np.array([a << 32 | b for a, b in pairs], np.uint64), np.array([number[g[:2]] << 32 | g[2] for g in tri], np.uint64), np.array([grams[g] for g in tri]))
    assert (trie.find(words) == np.arange(40)).all()
    every = np.array([(a, b) for a in range(-1, 40) for b in range(-1, 40)])
    one = np.ones(len(every), np.int64)
    at = trie.successor(trie.second, trie.nodes(trie.to2, every[:, 0]), one, every[:, 1])
    assert at.tolist() == [number.get((a, b), -1) for a, b in every.tolist()]
    at = np.arange(len(pairs))
    assert trie.count_of_pair(at).tolist() == [sum(k for g, k in grams.items() if g[:2] == p) for p in pairs]
    assert np.diff(np.array(trie.nodes(trie.to3, at)), axis=0)[0].tolist() == [sum(g[:2] == p for g in grams) for p in pairs]
    ask = np.array([(number[g[:2]], w) for g in tri for w in range(40)])
    found = trie.successor(trie.third, trie.nodes(trie.to3, ask[:, 0]), np.ones(len(ask), np.int64), ask[:, 1])
    where = {g: k for k, g in enumerate(tri)}
    assert found.tolist() == [where.get((*pairs[p], w), -1) for p, w in ask.tolist()]


def test_langid(docs, edge, empty):
    split = crc_split("doc_id", 5)
    model = langid.fit(docs.where(split != 0))
    got = langid.predict(docs, model, ["doc_id", "lang"]).where(crc_split("doc_id", 5) == 0).collect()
    assert sum(x.lang == x.lang_pred for x in got) >= 0.9 * len(got)
    by = {x.doc_id: x for x in langid.predict(edge, model, ["doc_id"]).collect()}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[1].score == 0
    assert by[7].lang_pred != "und"
    assert langid.predict(edge, langid.fit(empty), ["doc_id"]).where("lang_pred <> 'und'").isEmpty()
    assert langid.predict(empty, model, ["doc_id"]).count() == 0


def test_mixture_selects_languages():
    like = np.log(np.array([[0.9, 0.05, 0.05], [0.05, 0.9, 0.05]]))
    pi = langid.mixture(like, np.array([0, 0]), np.array([60.0, 40.0]), 2)
    assert pi[0, 2] == 0 and abs(pi[0, 0] - 0.6) < 0.05 and pi[1].sum() == 0


def test_ann_recall_and_edges(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(2000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [1.0, None] + [0.0] * 14), (9400, [1.0] * 3)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for y in ann.nearest(d, F.col("vec_id") % 100 == 0, block_rows=700, query_rows=7).orderBy("query_id", "rank").collect():
        got[y.query_id].append((y.vec_id, y.score))
    hits = 0
    for q in range(0, 2000, 100):
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        dist[q] = np.inf
        best = np.lexsort((np.arange(2000), dist))[:10]
        hits += len({i for i, _ in got[q]} & set(best.tolist()))
        assert all(abs(s - dist[i]) < 1e-12 for i, s in got[q])
    assert hits >= 0.9 * 200 and set(got) == set(range(0, 2000, 100))
    few = ann.nearest(d.where("vec_id in (0, 5, 9000)"), F.col("vec_id") == 0).collect()
    assert [(y.query_id, y.vec_id, y.rank) for y in few] == [(0, 5, 1)]
    assert ann.nearest(d.limit(0), F.lit(True)).count() == 0


def test_multi_index_finds_every_code_near_in_a_substring():
    r = np.random.default_rng(6)
    codes = r.integers(0, 1 << 10, (500, 4), dtype=np.uint32)
    index = ann.MultiIndex(codes, 10)
    gaps = np.bitwise_count(codes ^ codes[3])
    for reach in (0, 1, 2, 3):
        found = index.probe(codes[3], reach)
        assert (found == np.flatnonzero((gaps <= reach).any(1))).all()
        # pigeonhole: every code within the radius is among them
        assert np.isin(np.flatnonzero(gaps.sum(1) <= 4 * (reach + 1) - 1), found).all()


def test_ann_ties_repeated_ids_and_infinities(spark):
    rows = [(0, [1.0, 0.0]), (5, [2.0, 0.0]), (3, [0.0, 0.0 + 1e-300]), (4, [2.0, 0.0]), (0, [1.0, 1.0]), (100, [float("inf"), 0.0]), (None, [1.0, 0.0]), (7, None)]
    d = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, query string")
    got = [(x.query_id, x.rank, x.vec_id, x.score) for x in ann.nearest(d, F.col("vec_id") % 100 == 0, k=3).collect()]
    want = []
    live = [(i, v) for i, v in rows if i is not None and v and all(map(math.isfinite, v))]
    for n, (i, v) in enumerate(live):
        if i % 100 == 0:
            near = sorted((math.dist(v, w), j) for m, (j, w) in enumerate(live) if m != n)[:3]
            want += [(i, k + 1, j, s) for k, (s, j) in enumerate(near)]
    assert sorted(got) == sorted(want)


def test_ann_prunes_where_neighbours_are_near():
    r = np.random.default_rng(2)
    x = np.repeat(r.normal(size=(300, 32)), 10, 0) + 0.05 * r.normal(size=(3000, 32))
    mean, rot, reach = ann.learn(x, 9)
    index, code = ann.MultiIndex(ann.codes(x, mean, rot)), ann.codes(x, mean, rot)
    share, met = [], []
    for i in range(0, 3000, 60):
        found = index.probe(code[i], reach)
        share.append(len(found) / len(x))
        met.append(np.isin(np.arange(i - i % 10, i - i % 10 + 10), found).mean())
    assert np.mean(share) < 0.05 and np.mean(met) >= 0.95


def test_quality(spark, docs, labels, edge, empty):
    split = crc_split("doc_id", 5)
    got = quality.train_and_score(docs, labels, ["doc_id"], split != 0).join(labels, "doc_id").where("quality is not null").collect()
    assert sum((x.score >= 0.3) == bool(x.quality) for x in got) >= 0.9 * len(got)
    context = quality.context_vectors(docs)
    assert all(0 <= x.score <= 1 for x in quality.score(edge, None, context, ["doc_id", "key"]).collect())
    assert quality.fit(toxicity.labelled(docs, labels.limit(0), "quality"), context) is None
    assert quality.score(empty, None, context, ["doc_id"]).count() == 0


def test_mixing(spark, edge, empty):
    rows = [(i, "w " * (1 + i % 13), f"s{i % 4}" if i % 9 else None) for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d, bins=16).collect()
    per = defaultdict(list)
    for x in got:
        per[x.source].append(x)
    weight = {s: w for s, w in zip([*sorted(s for s in per if s), None], [5, 2, 1, 5, 2], strict=False)}
    assert abs(sum(xs[0].target for xs in per.values()) - 1.5 * sum(x.size for x in got)) < 1e-6
    free = {s: xs[0].target / weight[s] for s, xs in per.items() if xs[0].target < 2 * xs[0].source_size - 1e-9}
    assert max(free.values()) - min(free.values()) < 1e-6
    for xs in per.values():
        assert xs[0].source_size == sum(x.size for x in xs)
        assert abs(sum(x.taken for x in xs) - xs[0].target) <= 1
        assert all(0 <= x.taken <= 2 * x.size for x in xs)
    assert sorted(map(tuple, mixing.mix(d, bins=16).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix(edge).count() == len(EDGE) and mixing.mix(empty).count() == 0


def base_by_brute_force(t):
    t = t or ""
    import re

    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_rules_base_equals_brute_force(spark, docs, edge, empty):
    extra = [(900 + i, t, "en", "a", 1) for i, t in enumerate(["a b c d e a b c d e", "x x x x x x x", "l\nl\n\n \nl", "a|b #\t$ \u00e9\U0001f600", None])]
    d = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = {x.doc_id: x for x in rules.judge(d, ["doc_id"]).collect()}
    for x in d.collect():
        y = got[x.doc_id]
        want = base_by_brute_force(x.text)
        assert (y.n_words, y.word_chars, y.n_symbols, y.n_dup_lines, y.n_repeat_words) == want
        assert y.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (y.base_failed and y.kept)
    assert rules.judge(edge, ["doc_id", "key", "score"]).count() == len(EDGE)
    assert rules.judge(empty, ["doc_id"]).count() == 0


def test_chi_square_quantile():
    assert abs(rules.quantile(0.025) - rules.INSIDE) < 1e-3 and abs(rules.quantile(0.5) - rules.MEDIAN) < 1e-3


def test_mcd_equals_brute_force(spark):
    """The estimate is that of the best half that any start reaches."""
    r = np.random.default_rng(12)
    x = r.multivariate_normal([5, 1, 0.5, 0.3], np.diag([0.5, 0.2, 0.3, 0.2]) + 0.05, 400)
    x[:100] += [4, -3, 3, 2]
    d = spark.createDataFrame([("[]", *map(float, v), n) for n, v in enumerate(x)], "k string, s0 double, s1 double, s2 double, s3 double, _no long")
    e = rules.mcd(d).collect()[0]
    low = np.zeros((4, 4))
    for i in range(4):
        for j in range(i + 1):
            low[i, j] = e[f"l{i}{j}"]
    got = low @ low.T
    clean = x[100:]
    want = np.cov(clean.T, bias=True) + np.diag(np.array(rules.FLOORS) ** 2)
    assert np.abs(np.array([e[m] for m in rules.CENTRE]) - clean.mean(0)).max() < 0.1
    assert np.abs(got - want).max() < 0.12
    dist = np.einsum("ij,jk,ik->i", x - [e[m] for m in rules.CENTRE], np.linalg.inv(got), x - [e[m] for m in rules.CENTRE])
    assert (dist[:100] > rules.quantile(1e-6)).all() and not (dist[100:] > rules.quantile(1e-6)).any()


def test_rules_reject_outliers(spark):
    r = random.Random(8)
    rows = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(r.randint(80, 200))), "en", "a") for i in range(300)]
    rows += [(1000 + i, " ".join(f"{r.randint(0, 99)}|#*%" for _ in range(100)), "en", "a") for i in range(8)]
    got = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()
    assert {x.doc_id for x in got if not x.kept} == {1000 + i for i in range(8)}


def test_urls(spark):
    rows = [
        (1, "https://A.Example.com/en/712?x"), (2, "http://example.com/en/812"), (3, "http://b.example.net/de/81"), (4, "http://example.net/de/7#a"),
        (5, "x://y.org/es/"), (6, "no scheme"), (7, None), (8, "http://cheap-pills.example.org/fr/1"), (9, "http://library.example.org/fr/1"), (10, "http://com/en/"), (11, "http://notcom.xcom/en/"),
    ]
    got = {x.page_id: x for x in urls.judge(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/712", "example.com/en/7", "allow")
    assert [got[i].rule for i in (2, 3, 4, 5, 10, 11)] == ["com/en/", "example.net/de/8", "net/de/", "org/es/", "com/en/", None]
    assert [got[i].verdict for i in (2, 3, 4, 5, 8, 9)] == ["block", "block", "allow", "block", "block", "allow"]
    assert (got[6].host, got[6].path, got[7].host, got[7].path) == ("", "", "", "")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    odd = spark.createDataFrame([(None, "http://a.example.org/" + "x" * 100_000), (1, "http://a.example.org/"), (1, "http://a.example.org/")], "page_id long, url string")
    assert [x.verdict for x in urls.judge(odd).collect()][1:] == ["allow", "allow"] and urls.judge(odd).count() == 3


def test_url_model_on_names_that_it_has_not_seen():
    w = urls.fit(urls.training_urls())
    bad = ["cheap-cialis-shop", "vegas-blackjack-bonus", "free-porn-videos", "online-casino-royal", "replica-rolex", "instant-payday-loan", "warez-download", "xxx-tube", "buy-viagra-now", "poker-jackpot"]
    good = ["hotels-berlin", "city-library", "sussex-council", "physics-department", "weather-report", "cooking-recipes", "bookshop", "mathematics-journal", "railway-museum", "pharmacology-institute", "ththat", "orchard", "tionary", "analytics"]
    forms = [("www.", ".example.org", "/fr/1"), ("", ".com", "/index.html"), ("blog.", ".net", "/")]
    p = lambda names: urls.score(w, [a + n + b for n in names for a, b, _ in forms], [c for _ in names for *_, c in forms])
    assert (p(bad) >= 0.5).mean() >= 0.9 and (p(good) < 0.5).mean() >= 0.9


def test_url_grams_equal_brute_force():
    hosts, paths = ["a.bc", "", "\u00e9x"], ["/p/q", "", "/long/path"]
    row, bucket = urls.grams(hosts, paths)
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        alone = urls.grams([h], [p])[1]
        want = sum(len({raw[k : k + n] for k in range(len(raw) - n + 1)}) for raw in (f"^{h}$".encode(), f"^{p}$".encode()) for n in urls.SIZES)
        assert (np.sort(bucket[row == i]) == np.sort(alone)).all() and abs(len(alone) - want) <= 1


def test_pipeline(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    now = docs
    for name, f in p.STAGES[:-1]:
        now = f(spark, now, small)
        assert now.columns == docs.columns, name
    out = p.run(spark, small)
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns) and out.count() > 0
    assert out.where("n_tokens <> size(ids)").isEmpty()
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert p.drop_poor(spark, docs, small).join(labels, "doc_id").where("quality = 0").count() <= 1
    nothing = docs.limit(0)
    for _, f in p.STAGES:
        assert f(spark, nothing, small).count() == 0
