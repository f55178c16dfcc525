"""The eikonal equation in blocks and rounds against a march by a queue and against closed forms."""

import heapq
import math

import numpy as np
import pytest

from voxelgrain.operators import eikonal as E
from voxelgrain.operators.distance import nearest_structure

SCHEMA = "tomo string, z int, y int, x int"


def march(mask, start, size):
    """Fast marching: voxels become final in the order of their distance."""
    d = np.where(start & mask, 0.0, np.inf)
    done = np.zeros(mask.shape, bool)
    heap = [(0.0, tuple(p)) for p in np.argwhere(d == 0).tolist()]

    def solve(p):
        terms = []
        for axis, s in enumerate(size):
            best = np.inf
            for step in (-1, 1):
                q = tuple(c + step * (k == axis) for k, c in enumerate(p))
                if all(0 <= c < n for c, n in zip(q, mask.shape, strict=True)) and done[q]:
                    best = min(best, d[q])
            if best < np.inf:
                terms.append((best, s))
        terms.sort()
        u = np.inf
        for k in range(1, len(terms) + 1):
            if k > 1 and terms[k - 1][0] >= u:
                break
            a = sum(1 / s**2 for _, s in terms[:k])
            b = sum(t / s**2 for t, s in terms[:k])
            c = sum(t * t / s**2 for t, s in terms[:k]) - 1
            u = (b + math.sqrt(b * b - a * c)) / a
        return u

    while heap:
        v, p = heapq.heappop(heap)
        if done[p]:
            continue
        done[p] = True
        for axis in range(3):
            for step in (-1, 1):
                q = tuple(c + step * (k == axis) for k, c in enumerate(p))
                if all(0 <= c < n for c, n in zip(q, mask.shape, strict=True)) and mask[q] and not done[q]:
                    u = solve(q)
                    if u < d[q]:
                        d[q] = u
                        heapq.heappush(heap, (u, q))
    return d


def frame(spark, mask, tomo="a"):
    return spark.createDataFrame([(tomo, *p) for p in np.argwhere(mask).tolist()], SCHEMA)


def dense(df, shape):
    out = np.full(shape, np.inf)
    for r in df.collect():
        out[r.z, r.y, r.x] = r.distance
    return out


@pytest.mark.parametrize("size", [(1.0, 1.0, 1.0), (2.5, 1.0, 0.5)])
def test_equals_a_march(spark, size):
    r = np.random.default_rng(1)
    mask = r.random((5, 14, 15)) < 0.75
    start = mask & (r.random(mask.shape) < 0.004)
    start[tuple(np.argwhere(mask)[0])] = True
    want = march(mask, start, size)
    got = dense(E.eikonal_distance(frame(spark, mask), frame(spark, start), size, block=(5, 8, 7)), mask.shape)
    assert np.isfinite(want).sum() > 700
    np.testing.assert_allclose(got, want, rtol=1e-9)
    near = dense(E.eikonal_distance(frame(spark, mask), frame(spark, start), size, limit=6.0, block=(5, 8, 7)), mask.shape)
    np.testing.assert_allclose(near, np.where(want < 6.0, want, np.inf), rtol=1e-9)


def test_error_falls_with_the_voxel_size():
    error = []
    for n in (8, 16, 32):
        at = np.argwhere(np.ones((n + 1,) * 3, bool))
        middle = (at == n // 2).all(1)
        d = E.relax(at, np.where(middle, 0.0, np.inf), ~middle, (1 / n,) * 3)
        error.append(np.abs(d - np.linalg.norm((at - n // 2) / n, axis=1)).max())
    assert error[0] > 1.4 * error[1] > 1.9 * error[2] and error[2] < 0.06
    # from a plane the scheme is exact
    flat = at[:, 0] == 0
    assert E.relax(at, np.where(flat, 0.0, np.inf), ~flat, (0.5, 1, 1)) == pytest.approx(at[:, 0] * 0.5)


def test_goes_around_a_wall(spark):
    mask = np.ones((1, 9, 21), bool)
    mask[0, :8, 10] = False
    start = np.zeros_like(mask)
    start[0, 0, 9] = True
    d = dense(E.eikonal_distance(frame(spark, mask), frame(spark, start), block=(4, 4, 4)), mask.shape)
    around = 8 + 2 + 8  # down, past the end of the wall, up
    assert around - 1 <= d[0, 0, 11] <= around + 1.5 and d[0, 0, 5] == 4


def test_edges_of_the_distance(spark):
    none = spark.createDataFrame([], SCHEMA)
    line = spark.createDataFrame([("a", 0, 0, x) for x in range(5)] * 2 + [("a", 0, 0, 9), ("b", 0, 0, 0), (None, 0, 0, 0), ("a", None, 0, 0)], SCHEMA)
    start = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 0, 1), ("a", 5, 5, 5), (None, 0, 0, 0), ("a", None, 0, 0), ("c", 0, 0, 0)], SCHEMA)
    assert E.eikonal_distance(none, start).isEmpty() and E.eikonal_distance(line, none).isEmpty()
    got = sorted(map(tuple, E.eikonal_distance(line, start, (1.0, 1.0, 3.0), block=(2, 2, 2)).collect()))
    assert got == [("a", 0, 0, x, 3.0 * abs(x - 1)) for x in range(5)]


def test_membrane_by_path(spark):
    r = np.random.default_rng(5)
    shape, size, limit = (6, 16, 16), (2.0, 1.0, 1.0), 7.0
    membrane = r.random(shape) < 0.5
    reference = np.zeros(shape, int)
    reference[2, 3:5, 3:5], reference[3, 12, 11:14], reference[0, 0, 15] = 1, 2, 3
    ref = spark.createDataFrame([("a", *p, int(reference[tuple(p)])) for p in np.argwhere(reference).tolist()], SCHEMA + ", label long")
    want = np.zeros(shape, bool)
    for k in (1, 2):  # object 3 lies in a slice that is cut off
        at = np.argwhere(membrane[1:-1]) + [1, 0, 0]
        gap = ((at[:, None] - np.argwhere(reference == k)[None]) ** 2).sum(2).min(1)
        start = np.zeros(shape, bool)
        start[tuple(at[gap.argmin()])] = True
        inner = membrane.copy()
        inner[[0, -1]] = False
        want |= march(inner, start, size) < limit
    got = np.zeros(shape, bool)
    for p in E.membrane_by_path(frame(spark, membrane), ref, limit, size, 1, 6).collect():
        got[p.z, p.y, p.x] = True
    assert want.sum() > 20
    np.testing.assert_array_equal(got, want)
    # a fragment of three voxels does not count
    few = spark.createDataFrame([("a", 0, 0, x) for x in range(3)] + [("a", 0, 9, x) for x in range(8)], SCHEMA)
    one = spark.createDataFrame([("a", 0, 1, 0, 1)], SCHEMA + ", label long")
    near = lambda least: sorted((p.y, p.x) for p in E.membrane_by_path(few, one, 4.0, min_size=least).collect())
    assert near(0) == [(0, 0), (0, 1), (0, 2)] and near(3) == [(9, x) for x in range(4)]
    assert E.membrane_by_path(few.limit(0), one, 4.0).isEmpty() and E.membrane_by_path(few, one.limit(0), 4.0).isEmpty()


def test_first_end_points_of_the_structure(spark):
    obj = spark.createDataFrame([("a", 0, 0, 0, 1), ("a", 0, 9, 9, 1)], SCHEMA + ", label long")
    to = spark.createDataFrame([("a", 0, 9, 7, 5), ("a", 0, 2, 0, 5), ("a", 0, 0, 2, 5), ("a", 0, 8, 9, 5), ("a", 0, 1, 0, 5)], SCHEMA + ", label long")
    assert tuple(nearest_structure(obj, to, by_structure=True).first().ep_structure) == (0, 1, 0)
    back = to.where("x = 9 or y = 0 or z = 9").unionByName(spark.createDataFrame([("a", 0, 1, 0, 5)], SCHEMA + ", label long"))
    row = nearest_structure(obj, back, by_structure=True).first()
    assert (tuple(row.ep_structure), tuple(row.ep_object), row.distance) == ((0, 1, 0), (0, 0, 0), 1.0)
