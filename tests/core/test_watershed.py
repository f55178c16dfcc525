"""The watershed in rounds against a flood by a queue."""

import heapq

import numpy as np
import pytest

from voxelgrain.operators.watershed import watershed

SCHEMA = "tomo string, z int, y int, x int, "


def flood(height, seeds, planar):
    """Takes the lowest edge out of what is labelled, again and again."""
    label, heap = {p: s for p, s in seeds.items() if p in height and s and s > 0}, []
    axes = (1, 2) if planar else (0, 1, 2)

    def push(p):
        for axis in axes:
            for d in (-1, 1):
                q = tuple(c + d * (k == axis) for k, c in enumerate(p))
                if q in height and q not in label:
                    a, b = height[p], height[q]
                    heapq.heappush(heap, (max(a, b), min(a, b), min(p, q), max(p, q), p, q))

    for p in list(label):
        push(p)
    while heap:
        *_, p, q = heapq.heappop(heap)
        if q not in label:
            label[q] = label[p]
            push(q)
    return label


def run(spark, height, seeds, planar=False):
    h = spark.createDataFrame([("a", *p, v) for p, v in height.items()], SCHEMA + "height double")
    s = spark.createDataFrame([("a", *p, v) for p, v in seeds.items()], SCHEMA + "label long")
    return {(r.z, r.y, r.x): r.label for r in watershed(h, s, planar).collect()}


@pytest.mark.parametrize("case", ["random", "plateaus", "smooth", "planar", "islands"])
def test_equals_a_flood_by_a_queue(spark, case):
    r = np.random.default_rng(7)
    shape = (4, 12, 11)
    if case == "smooth":
        z, y, x = np.indices(shape)
        a = np.sin(y / 2) + np.cos(x / 1.7) + 0.3 * z
    else:
        a = r.random(shape) if case == "random" else r.integers(0, 4, shape).astype(float)
    keep = r.random(shape) < (0.55 if case == "islands" else 0.95)
    height = {tuple(p): float(a[tuple(p)]) for p in (np.argwhere(keep) - 1).tolist()}
    seeds = {tuple(p): 1 + k % 5 for k, p in enumerate((r.integers(0, 10, (9, 3)) - 1).tolist())}
    planar = case == "planar"
    assert run(spark, height, seeds, planar) == flood(height, seeds, planar)


def test_edges_of_the_watershed(spark):
    # one line: the pass in the middle divides
    line = {(0, 0, x): float(h) for x, h in enumerate([0, 1, 2, 9, 2, 1, 0])}
    assert run(spark, line, {(0, 0, 0): 3, (0, 0, 6): 8}) == {(0, 0, x): 3 if x < 4 else 8 for x in range(7)}
    assert run(spark, line, {}) == {} and run(spark, {}, {(0, 0, 0): 1}) == {}
    assert run(spark, line, {(0, 0, 1): 0, (0, 0, 9): 4, (0, 0, 2): None}) == {}
    assert set(run(spark, line, {(0, 0, 2): 5}).values()) == {5}
    h = spark.createDataFrame([("a", 0, 0, 0, 1.0), ("a", 0, 0, 0, 0.0), ("a", 0, 0, 1, None), ("a", 0, 0, 2, float("nan")), (None, 0, 0, 3, 1.0), ("a", 0, None, 0, 1.0), ("b", 0, 0, 1, 1.0)], SCHEMA + "height double")
    s = spark.createDataFrame([("a", 0, 0, 0, 2), ("a", 0, 0, 0, 6), (None, 0, 0, 3, 1)], SCHEMA + "label long")
    assert [tuple(r) for r in watershed(h, s).collect()] == [("a", 0, 0, 0, 6)]
