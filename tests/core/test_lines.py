"""Distance fields and filters along lines against brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelgrain.operators import lines as L

SCHEMA = "tomo string, z int, y int, x int"


def table(spark, points, tomo="a"):
    return spark.createDataFrame([(tomo, *map(int, p)) for p in points], SCHEMA)


def nearest(p, features, size):
    """(distance, first nearest feature) by looking at all of them."""
    return min((sum(((a - b) * s) ** 2 for a, b, s in zip(p[::-1], f[::-1], size[::-1], strict=True)), tuple(f)) for f in features)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5), st.sampled_from([1.0, 0.5, 2.25]))
def test_envelope_equals_all_gaps(seed, lines, scale):
    r = np.random.default_rng(seed)
    line, pos, value = [], [], []
    for k in range(lines):
        at = np.sort(r.choice(np.arange(-9, 12), r.integers(1, 15), False))
        line += [k] * len(at)
        pos += at.tolist()
        value += r.choice([0, 1, 4, 9, 16, 30, 200], len(at)).tolist()
    line, pos, value = np.array(line), np.array(pos), np.array(value, float)
    q_line = np.repeat(np.arange(lines), 31)
    q_pos = np.tile(np.arange(-15, 16), lines)
    got = L.envelope(line, pos, value, q_line, q_pos, scale)
    for i in range(len(q_line)):
        mine = np.flatnonzero(line == q_line[i])
        cost = value[mine] + ((q_pos[i] - pos[mine]) * scale) ** 2
        assert got[i] == mine[np.argmin(cost)]  # the leftmost of equals


@pytest.mark.parametrize("size", [(1.0, 1.0, 1.0), (2.5, 1.0, 0.75)])
def test_distance_field_equals_brute_force(spark, size):
    r = np.random.default_rng(3)
    grid = np.argwhere(r.random((5, 9, 8)) < 0.7) - 2  # gaps and negative coordinates
    features = [tuple(p) for p in r.integers(-4, 9, (12, 3)).tolist()] + [(0, 0, 0), (0, 0, 2), (0, 2, 0)]
    out = L.distance_field(table(spark, grid), table(spark, features + features[:3]), size).collect()
    assert len(out) == len(grid)
    for row in out:
        d2, f = nearest((row.z, row.y, row.x), sorted(set(features)), size)
        assert row.distance == pytest.approx(d2**0.5, abs=1e-12) and (row.near_z, row.near_y, row.near_x) == f


def test_distance_field_by_object_and_edges(spark):
    v = spark.createDataFrame([("a", 1, 0, 0, 0), ("a", 2, 0, 0, 5), ("a", 2, 0, 0, 5), ("b", 1, 0, 0, 1), (None, 1, 0, 0, 0), ("a", 1, None, 0, 0)], "tomo string, label long, z int, y int, x int")
    f = spark.createDataFrame([("a", 1, 0, 3, 4), ("a", 2, 0, 0, 4), ("b", 7, 0, 0, 0), ("a", 1, 0, None, 0)], "tomo string, label long, z int, y int, x int")
    got = {(r.tomo, r.label): r.distance for r in L.distance_field(v, f, keys=("tomo", "label")).collect()}
    assert got == {("a", 1): 5.0, ("a", 2): 1.0}
    assert L.distance_field(v.where("false"), f).isEmpty() and L.distance_field(v, f.where("false")).isEmpty()


def test_lines_are_never_cut():
    f = pd.DataFrame({"k": [0, 0, 0, 1, 1, 2, 2, 2, 2, 3], "x": range(10)})
    for step in (1, 2, 3, 7, 10):
        parts = list(L.whole_lines((f.iloc[i : i + step] for i in range(0, 10, step)), ["k"]))
        assert pd.concat([p for p, _ in parts])["x"].tolist() == list(range(10))
        seen = [k for p, _ in parts for k in p["k"].unique()]
        assert seen == sorted(set(seen))
    assert list(L.whole_lines(iter([f.iloc[:0]]), ["k"])) == []


def image(spark, a):
    return spark.createDataFrame([("a", *map(int, p), float(a[tuple(p)])) for p in np.argwhere(np.ones(a.shape, bool))], SCHEMA + ", value double")


def dense(df, shape, column):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[column]
    return out


def along(a, taps, axis):
    r = len(taps) // 2
    pad = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(3)], "symmetric")
    return sum(t * np.take(pad, range(k, k + a.shape[axis]), axis) for k, t in enumerate(taps))


def test_derivatives_equal_numpy(spark):
    a = np.random.default_rng(0).random((5, 12, 9))
    orders = {"g": (0, 0, 0), "dz": (1, 0, 0), "dx": (0, 0, 1), "dyx": (0, 1, 1), "dyy": (0, 2, 0)}
    got = L.derivatives(image(spark, a), 1.2, orders)
    for name, o in orders.items():
        want = a
        for axis, k in enumerate(o):
            want = along(want, L.gaussian_taps(1.2, k), axis)
        assert np.allclose(dense(got, a.shape, name), want)
    flat = L.smooth(image(spark, a), 1.2, planar=True)
    want = along(along(a, L.gaussian_taps(1.2), 1), L.gaussian_taps(1.2), 2)
    assert np.allclose(dense(flat, a.shape, "value"), want)


def test_taps_answer_to_polynomials():
    x = np.arange(-30, 31, dtype=float)
    for sigma in (0.8, 2.0, 4.0):
        g, d, dd = (L.gaussian_taps(sigma, k) for k in range(3))
        mid = slice(30 - len(g) // 2, 31 + len(g) // 2)
        assert g.sum() == pytest.approx(1) and d.sum() == pytest.approx(0, abs=1e-12) and dd.sum() == pytest.approx(0, abs=1e-12)
        assert (d * x[mid]).sum() == pytest.approx(1) and (dd * x[mid] ** 2 / 2).sum() == pytest.approx(1)
