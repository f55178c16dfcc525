"""Compartments: fixtures in rows, the partition of graphs against brute force."""

from itertools import product

import numpy as np
import pytest

from voxelgrain.plans import compartments as P

SCHEMA = "tomo string, z int, y int, x int, "


def rows(spark, a, column, kind):
    return spark.createDataFrame([("a", *map(int, p), a[tuple(p)].item()) for p in np.argwhere(np.ones(a.shape, bool)) if column == "value" or a[tuple(p)]], f"{SCHEMA}{column} {kind}")


def test_a_wall_divides_a_slice(spark):
    b = np.zeros((1, 60, 60))
    b[0, :, 29:31] = 1.0
    out = P.segment_slices(rows(spark, b, "value", "double"), far=10.0, context=False).collect()
    left, right = {r.label for r in out if r.x < 29}, {r.label for r in out if r.x > 30}
    assert len(left) == len(right) == 1 and left != right and len(out) > 3000


def test_small_rooms_keep_their_ground_and_go(spark):
    b = np.zeros((1, 40, 60))
    b[0, :, 19] = b[0, 20, :19] = 1.0  # two small rooms left of a large one
    out = P.segment_slices(rows(spark, b, "value", "double"), far=25.0, context=False, iterations=0).collect()
    assert {r.label for r in out} == {1} and min(r.x for r in out) >= 19


def test_columns_of_regions_are_joined(spark):
    a = np.zeros((5, 16, 16), np.int64)
    for z in range(5):
        a[z, :, :8], a[z, :, 8:] = 2 * z + 1, 2 * z + 2
    got = P.merge_slices(rows(spark, a, "label", "long"), min_extent=0).collect()
    assert {(r.x < 8, r.label) for r in got} == {(True, 1), (False, 2)} and len(got) == a.size
    assert P.merge_slices(rows(spark, a, "label", "long"), min_extent=6).isEmpty()
    assert {r.share for r in P.slice_overlaps(rows(spark, a, "label", "long")).collect()} == {1.0}


def contracted(edges):
    """One pair after the other, the round's mutual best pairs first."""
    part = {n: n for e in edges for n in e[:2]}
    w = {}
    for a, b, x in edges:
        if a != b:
            w[min(a, b), max(a, b)] = w.get((min(a, b), max(a, b)), 0) + x
    while True:
        best = {}
        for (a, b), x in w.items():
            if x > 0:
                for n in (a, b):
                    best[n] = max(best.get(n, (-1, 0, 0)), (x, -a, -b))
        pairs = [(-k[1], -k[2]) for n, k in best.items() if n == -k[1] and best[-k[2]] == k]
        if not pairs:
            return part
        to = {b: a for a, b in pairs}
        part = {n: to.get(p, p) for n, p in part.items()}
        new = {}
        for (a, b), x in w.items():
            a, b = to.get(a, a), to.get(b, b)
            if a != b:
                new[min(a, b), max(a, b)] = new.get((min(a, b), max(a, b)), 0) + x
        w = new


def value(edges, part):
    """What is gained by the edges inside parts."""
    return sum(x for a, b, x in edges if part[a] == part[b])


def optimum(edges):
    nodes = sorted({n for e in edges for n in e[:2]})
    return max(value(edges, dict(zip(nodes, p, strict=True))) for p in product(range(len(nodes)), repeat=len(nodes)) if all(c <= k for k, c in enumerate(p)))


def test_partition_equals_contraction_and_is_near_the_optimum(spark):
    r = np.random.default_rng(4)
    graphs = {}
    for g in range(6):
        n = 6
        graphs[f"g{g}"] = [(a, b, float(r.integers(-8, 9)) / 4) for a in range(n) for b in range(a + 1, n) if r.random() < 0.6]
    graphs["tree"] = [(1, 2, 1.0), (2, 3, -1.0), (3, 4, 2.0), (4, 5, 0.5)]
    graphs["ties"] = [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 1, 1.0), (9, 9, 5.0)]
    graphs["doubled"] = [(1, 2, -1.0), (2, 1, 3.0), (2, 3, 0.0)]
    edges = spark.createDataFrame([(t, a, b, w) for t, e in graphs.items() for a, b, w in e], "tomo string, a long, b long, w double")
    got = {}
    for row in P.partition(edges).collect():
        got.setdefault(row.tomo, {})[row.node] = row.part
    for t, e in graphs.items():
        assert got[t] == contracted(e), t
        assert value(e, got[t]) >= 0.7 * optimum(e) if t.startswith("g") else value(e, got[t]) == optimum(e)
    assert P.partition(edges.where("false")).isEmpty()


def test_edge_costs(spark):
    s = spark.createDataFrame([("a", 1, 2, 0.5), ("a", 1, 3, 1.0), ("a", 1, 4, 0.25)], "tomo string, a long, b long, share double")
    w = {r.b: r.w for r in P.edge_costs(s).collect()}
    assert w[2] == pytest.approx(0) and w[3] == pytest.approx(np.log(999)) and w[4] == pytest.approx(np.log(1 / 3))


def test_plateaus(spark):
    a = np.array([[[1, 1, 1, 1, 1, 1], [1, 3, 3, 1, 2, 2], [1, 3, 1, 1, 2, 3], [1, 1, 1, 1, 1, 1]], [[0] * 6] * 4], float)
    got = {}
    for r in P.plateau_maxima(rows(spark, a, "value", "double")).collect():
        got.setdefault(r.label, set()).add((r.z, r.y, r.x))
    assert sorted(map(sorted, got.values())) == [[(0, 1, 1), (0, 1, 2), (0, 2, 1)], [(0, 2, 5)], sorted((1, y, x) for y in range(4) for x in range(6))]
