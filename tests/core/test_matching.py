"""Largest matchings against a search for alternating paths in one process."""

import numpy as np
import pytest

from voxelgrain.operators import volume as V
from voxelgrain.operators.matching import maximum_matching

SCHEMA = "tomo string, a long, b long"
VOXEL = "tomo string, z int, y int, x int, label long"


def largest(edges):
    """Size of a largest matching: each node looks for a partner in turn."""
    to, mate = {}, {}
    for a, b in edges:
        to.setdefault(a, []).append(b)

    def seek(a, seen):
        for b in to[a]:
            if b not in seen:
                seen.add(b)
                if b not in mate or seek(mate[b], seen):
                    mate[b] = a
                    return True
        return False

    return sum(seek(a, set()) for a in to)


def pairs(spark, edges):
    got = maximum_matching(spark.createDataFrame([("t", a, b) for a, b in edges], SCHEMA)).collect()
    found = [(r.a, r.b) for r in got]
    assert set(found) <= set(edges) and len({a for a, _ in found}) == len({b for _, b in found}) == len(found)
    return len(found)


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    r = np.random.default_rng(seed)
    edges = [tuple(map(int, e)) for e in np.unique(r.integers(0, 60, (95 + 10 * seed, 2)), axis=0)]
    assert pairs(spark, edges) == largest(edges)


def test_a_path_that_must_be_turned_over(spark):
    # one chain: the only perfect matching takes every other edge
    chain = [(k, k) for k in range(12)] + [(k + 1, k) for k in range(11)]
    assert pairs(spark, chain) == 12
    star = [(1, b) for b in range(9)] + [(a, 100) for a in range(5)]
    assert pairs(spark, star) == 2


def test_nulls_repeats_and_volumes(spark):
    rows = [("t", 1, 1), ("t", 1, 1), ("u", 1, 1), (None, 1, 1), ("t", None, 2), ("t", 2, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, maximum_matching(df).collect())) == [("t", 1, 1), ("u", 1, 1)]
    assert maximum_matching(df.limit(0)).isEmpty()


def lay(spark, objects):
    """Objects as stretches of one line: label -> (first, end)."""
    return spark.createDataFrame([("t", 0, 0, x, k) for k, (lo, hi) in objects.items() for x in range(lo, hi)], VOXEL)


def test_more_pairs_than_mutual_best(spark):
    # 1 is the best of both 10 and 11, but 2 has 10 alone
    seg = lay(spark, {1: (0, 20), 2: (20, 26)})
    gt = lay(spark, {10: (6, 26), 11: (0, 6)})
    mutual, best = V.matching(seg, gt, 0.1, mutual=True).first(), V.matching(seg, gt, 0.1).first()
    assert (mutual.tp, mutual.fp, mutual.fn) == (1, 1, 1) and (best.tp, best.fp, best.fn) == (2, 0, 0)


@pytest.mark.parametrize(("limit", "criterion"), [(0.1, "iou"), (0.3, "iou"), (0.4, "iop"), (0.6, "iou")])
def test_volumes_equal_a_search(spark, limit, criterion):
    r = np.random.default_rng(4)
    cut = lambda: [0, *sorted(set(r.integers(1, 200, 24).tolist())), 200]
    line = lambda c: {k + 1: (lo, hi) for k, (lo, hi) in enumerate(zip(c, c[1:], strict=False))}
    seg, gt = line(cut()), line(cut())
    edges = []
    for a, (p, q) in seg.items():
        for b, (u, v) in gt.items():
            n = max(0, min(q, v) - max(p, u))
            if n and (n / ((q - p) + (v - u) - n) if criterion == "iou" else n / (q - p)) >= limit:
                edges.append((a, b))
    tp = largest(edges)
    got = V.matching(lay(spark, seg), lay(spark, gt), limit, criterion).first()
    assert (got.tp, got.fp, got.fn) == (tp, len(seg) - tp, len(gt) - tp)
