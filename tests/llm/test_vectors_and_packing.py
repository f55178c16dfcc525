"""Whitening, centroid clustering and packing against brute force, and their edge cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxelgrain.llm import centroids, entries, packing, whitening

SCHEMA = "vec_id long, embedding array<float>, component int, n long, v string, x int"


def rows(spark, vectors, ids=None):
    """Vectors with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, v, 7, 8, "v", 9) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)], SCHEMA)


def whitened(df, **options):
    out = whitening.whiten(df, **options).collect()
    return out, {(r["vec_id"], r["component"]): r for r in out}


def brute_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    d = fit - s / n
    e, u = np.linalg.eigh(d.T @ d / n)
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x.astype(object) - s) ** 2).sum(1), (x - s / n) @ u[:, :k] / np.sqrt(e[:k]), e / e.sum()


def test_jacobi_equals_lapack_and_keeps_small_values():
    r = np.random.default_rng(0)
    a = r.normal(size=(30, 64))
    for m in (a.T @ a, np.eye(5), np.zeros((3, 3)), np.diag([3.0, 1.0, 2.0])):
        e, u = whitening.jacobi(m)
        assert np.allclose(e, np.linalg.eigvalsh(m)[::-1], atol=1e-10)
        assert np.allclose(u @ np.diag(e) @ u.T, m, atol=1e-10) and np.allclose(u.T @ u, np.eye(len(m)), atol=1e-13)
    scale = np.diag(10.0 ** -np.arange(8))
    b = r.normal(size=(50, 8))
    graded = scale @ (b.T @ b + 50 * np.eye(8)) @ scale
    e, _ = whitening.jacobi(graded)
    exact = 1 / np.linalg.eigvalsh(np.linalg.inv(graded))  # the inverse has the small values as its large ones
    assert np.allclose(e[-3:] / exact[::-1][::-1][np.argsort(-exact)][-3:], 1, rtol=1e-9)


def test_whitening_equals_brute_force(spark):
    r = np.random.default_rng(1)
    v = (r.normal(size=(300, 20)) * np.linspace(2, 0.2, 20)).tolist()
    v += [v[3]] * 150  # a hot vector counts once
    n, dev, w, share = brute_whitening(v, 16)
    out, got = whitened(rows(spark, v))
    assert len(out) == 450 * 16 and {r["n"] for r in out} == {n}
    mine = np.array([[got[i, k]["whitened"] for k in range(1, 17)] for i in range(450)])
    for k in range(16):
        assert np.allclose(mine[:, k], w[:, k], atol=1e-8) or np.allclose(mine[:, k], -w[:, k], atol=1e-8)
        assert got[0, k + 1]["explained"] == pytest.approx(share[k], rel=1e-9)
    assert [int(got[i, 1]["deviation"]) for i in range(450)] == dev.tolist()
    assert 0 <= out[0]["identity_error"] < 1e-9


def test_whitening_edges(spark):
    good = [[1.0, 2.0, 0.5], [0.0, 1.0, 0.25], [2.0, 0.0, 0.125], [1.5, 0.5, 4.0]]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0]]
    out, got = whitened(rows(spark, good + good[:1] + bad, [0, 1, 2, 3, None, 5, 6, 7, 8, 9, 10]))
    assert len(out) == 5 * 3 and {r["n"] for r in out} == {4} and got[None, 1]["whitened"] == got[0, 1]["whitened"]
    # one vector alone, and dimensions without variance
    out, _ = whitened(rows(spark, [[1.0, 2.0]] * 3))
    assert len(out) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in out)
    out, got = whitened(rows(spark, [[0.0, 1.0], [3.0, 1.0]]))
    assert got[0, 2]["whitened"] is None and got[0, 2]["explained"] == 0 and abs(got[0, 1]["whitened"]) == pytest.approx(1) and out[0]["identity_error"] < 1e-12
    for none in ([], [None], [[]], [[None]]):
        assert whitening.whiten(rows(spark, none)).collect() == []
    with pytest.raises(Exception, match="beyond 2\\^52"):
        whitening.whiten(rows(spark, [[1e30], [1.0]])).collect()


def test_whitening_of_large_numbers_is_exact(spark):
    v = [[float(2**40), 1.0], [0.0, 5.0], [-float(2**41), 3.0]]
    n, dev, _, _ = brute_whitening(v, 1)
    _, got = whitened(rows(spark, v))
    assert [int(got[i, 1]["deviation"]) for i in range(3)] == dev.tolist() and max(dev) > 2**63


def brute_clusters(ids, vectors, k, rounds, seed=3):
    x = [[int(np.floor(1024 * float(np.float32(c)))) for c in v] for v in vectors]
    order = sorted(range(len(x)), key=lambda i: hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest())
    c = [x[i] for i in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, q, strict=True)), j) for j, q in enumerate(c)) for v in x]

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            mine = [v for v, (_, a) in zip(x, at, strict=True) if a == j]
            c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)] if mine else c[j]
    at = assign()
    total = sum(d for d, _ in at)
    return {(i, a, d, sum(e for e, b in at if b == a), total, hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for i, (d, a) in zip(ids, at, strict=True)}


@pytest.mark.parametrize("dim", [3, 8, 20])
def test_clusters_equal_brute_force(spark, dim):
    v = np.random.default_rng(dim).normal(size=(200, dim)).tolist()
    v += [v[5]] * 60 + [[0.0] * dim] * 4
    want = brute_clusters(range(len(v)), v, 8, 4)
    got = {tuple(r) for r in centroids.cluster(rows(spark, v), rounds=4, dim=dim).collect()}
    assert {(*w[:3], int(w[3]), int(w[4]), w[5]) for w in want} == {(*g[:3], int(g[3]), int(g[4]), g[5]) for g in got}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 40))
def test_partial_distances_find_the_nearest(seed, k, d):
    r = np.random.default_rng(seed)
    v, c = r.integers(-3, 4, (30, d)), r.integers(-3, 4, (k, d))  # many ties
    full = ((v[:, None] - c[None]) ** 2).sum(2)
    at, best = centroids.nearest(v, c, 4)
    assert (at == full.argmin(1)).all() and (best == full.min(1)).all()


def test_cluster_edges(spark):
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [1.0, float("-inf")], [1.0]]
    out = centroids.cluster(rows(spark, [[1.0, 1.0], [1.0, 1.0], [5.0, 5.0], *bad], [1, 1, None, *range(2, 8)]), dim=2).collect()
    # two equal rows of one id start two centroids, the one without an id starts none: all go to the first, which leaves
    assert sorted((r["vec_id"] or 0, r["cluster"]) for r in out) == [(0, 0), (1, 1), (1, 1)]
    for none in ([], [None], [[1.0]]):
        assert centroids.cluster(rows(spark, none), dim=2).collect() == []
    assert centroids.cluster(rows(spark, [[1.0, 2.0]], [None]).where("vec_id is null"), dim=2).collect() == []
    with pytest.raises(Exception, match="beyond 2\\^27"):
        centroids.cluster(rows(spark, [[1e9, 1.0]]), dim=2).collect()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 40)), min_size=0, max_size=40))
def test_plan_holds_every_piece_once(lengths):
    count = np.zeros(65, np.int64)
    for n, k in lengths:
        count[n] += k
    made = packing.plan(count)
    used = np.zeros(65, np.int64)
    for mine, uses in made:
        assert sum(mine) <= 64 and uses > 0
        for n in mine:
            used[n] += uses
    assert (used == count).all()
    place = packing.runs(made)
    assert all((np.diff(start) > 0).all() for start, _, _ in place.values())


def test_plan_is_near_the_bound():
    r = np.random.default_rng(2)
    for n in (300, 3_000, 60_000):
        count = np.bincount(np.minimum(512, r.gamma(2, 60, n).astype(int) + 1), minlength=513)
        bound = -(-int((count * np.arange(513)).sum()) // 512)
        made = packing.plan(count)
        assert sum(u for _, u in made) <= 1.005 * bound + 1
        assert len(made) < 4 * 513  # whatever n is
    # the fit alone finds halves that fit exactly
    halves = np.zeros(513, np.int64)
    halves[[200, 312, 100, 412]] = 70
    assert sum(u for _, u in packing.plan(halves)) == 140


def check_packing(out, texts, capacity):
    """``texts``: the whole multiset of texts; every piece is checked against the library."""
    tk = Tokenizer.from_file(entries.TOKENIZER)
    want = defaultdict(int)
    for i, t in texts:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, p, a, z - a, zlib.crc32(ids[a:z].tobytes())] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in out:
        got[tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_packing_of_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    out = entries.op13_best_fit_packing(spark, small).collect()
    sequences = check_packing(out, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], 2048)
    assert len(sequences) <= 1.01 * sum(r["length"] for r in out) / 2048 + 1


def test_packing_edges(spark):
    texts = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "x " * 50), (5, "word " * 20_000), (6, "a<|endoftext|>b"), (7, "  \n ")] + [(8, "the same text")] * 200
    df = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in texts], "doc_id long, text string, length int, _row string, piece int")
    check_packing(packing.pack(df, entries.TOKENIZER, 64).collect(), texts, 64)
    assert packing.pack(df.limit(0), entries.TOKENIZER).collect() == []


def test_contract_columns(spark, small):
    a, b, c = entries.op11_embedding_whitening(spark, small), entries.op12_centroid_clustering(spark, small), entries.op13_best_fit_packing(spark, small)
    assert a.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert b.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert c.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    n = spark.read.parquet(f"{small}/embeddings.parquet").count()
    assert a.count() == 16 * n and b.count() == n and a.selectExpr("max(identity_error)").first()[0] < 1e-9
