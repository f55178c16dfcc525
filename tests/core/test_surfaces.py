"""Surfaces and outlines from cases of cubes against geometry and against meshes built triangle by triangle."""

import math

import numpy as np
import pytest

from voxelgrain.operators import meshes as M

SCHEMA = "tomo string, z int, y int, x int, label long"


def frame(spark, array, tomo="a"):
    return spark.createDataFrame([(tomo, *p, int(array[tuple(p)])) for p in np.argwhere(array).tolist()], SCHEMA)


def got(df):
    return {(r.tomo, r.label): r for r in df.collect()}


def mesh(mask, size):
    """All triangles of a mask, cube by cube."""
    m = np.pad(mask, 1).astype(int)
    out = []
    for o in np.ndindex(*[n - 1 for n in m.shape]):
        case = sum(int(m[tuple(np.add(o, c))]) << k for k, c in enumerate(M.CORNERS))
        for loop in M.loops(case):
            p = (loop + o) * size
            out += [(p.mean(0), a, b) for a, b in zip(p, np.roll(p, -1, 0), strict=True)]
    return np.array(out)


def test_all_cases_close_and_mirror():
    for case in range(256):
        edges = [s for ring in M.rings() for s in M.cuts(ring, case)]
        # each crossed edge of the cube is left once and entered once
        assert sorted(map(sorted, (a for a, _ in edges))) == sorted(map(sorted, (b for _, b in edges)))
        crossed = sum((case >> a & 1) != (case >> b & 1) for a in range(8) for b in range(a) if (a ^ b) in (1, 2, 4))
        assert len(edges) == crossed
    table = {t[0]: t[1:] for t in M.case_table()}
    assert table[0][0] == table[255][0] == 0
    # turns and mirrors of the cube keep areas
    for perm in ([1, 0, 2], [0, 2, 1], [2, 1, 0]):
        for case in range(256):
            turned = sum(1 << int(np.dot(M.CORNERS[k][perm], (4, 2, 1))) for k in range(8) if case >> k & 1)
            assert table[case][0] == pytest.approx(table[turned][0]) and table[case][5] == pytest.approx(table[turned][5])


def test_one_voxel_and_a_box(spark):
    a = np.zeros((6, 7, 8), int)
    a[1, 1, 1] = 1
    a[2:5, 3:6, 3:7] = 2
    r = got(M.surfaces(frame(spark, a), (2.0, 1.0, 1.0)))
    # an octahedron with half axes 1, 1/2, 1/2
    assert r["a", 1].surface == pytest.approx(8 * np.linalg.norm(np.cross([-1, 0.5, 0], [-1, 0, 0.5])) / 2)
    assert r["a", 1].volume == pytest.approx(8 * 1 * 0.5 * 0.5 / 6)
    t = mesh(a == 2, np.array([2.0, 1.0, 1.0]))
    n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) / 2
    assert r["a", 2].surface == pytest.approx(np.linalg.norm(n, axis=1).sum())
    assert r["a", 2].volume == pytest.approx((t.mean(1) * n).sum() / 3)


def test_random_masks_equal_their_meshes(spark):
    r = np.random.default_rng(3)
    size = np.array([1.5, 1.0, 0.7])
    a = (r.random((5, 6, 6)) < 0.5) * r.integers(1, 3, (5, 6, 6))
    rows = got(M.surfaces(frame(spark, a), tuple(size)))
    for k in (1, 2):
        t = mesh(a == k, size)
        n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) / 2
        assert n.sum(0) == pytest.approx([0, 0, 0], abs=1e-9)
        sides = [tuple(map(tuple, np.round([p, q], 6))) for f in t for p, q in zip(f, np.roll(f, -1, 0), strict=True)]
        assert sorted(sides) == sorted((q, p) for p, q in sides)  # every side has its other triangle
        assert rows["a", k].surface == pytest.approx(np.linalg.norm(n, axis=1).sum())
        assert rows["a", k].volume == pytest.approx((t.mean(1) * n).sum() / 3)


def test_balls(spark):
    z, y, x = np.indices((34, 66, 66))
    d2 = ((z - 16.5) * 2) ** 2 + (y - 32.5) ** 2 + (x - 32.5) ** 2
    r = got(M.surfaces(frame(spark, (d2 <= 30**2).astype(int)), (2.0, 1.0, 1.0)))["a", 1]
    assert r.volume == pytest.approx(4 / 3 * math.pi * 30**3, rel=0.01)
    assert r.crofton == pytest.approx(4 * math.pi * 30**2, rel=0.01)
    assert 1.05 < r.surface / (4 * math.pi * 30**2) < 1.12
    assert sum(w for _, w in M.directions((1.0, 1.0, 1.0))) == pytest.approx(1)


def test_border_empty_and_repeated(spark):
    a = np.zeros((4, 4, 4), int)
    a[1:3, 1:3, 1:3], a[0, 0, 0] = 1, 2
    v = frame(spark, a)
    r = got(M.surfaces(v, shape=(4, 4, 4)))
    assert r["a", 1].volume == pytest.approx(got(M.surfaces(v))["a", 1].volume)
    assert r["a", 2].volume is None and r["a", 2].surface == pytest.approx(math.sqrt(3) / 8)
    thin = got(M.surfaces(frame(spark, a[1:2]), shape=(1, 4, 4)))["a", 1]
    assert (thin.surface, thin.volume, thin.crofton) == (0, None, 0)
    odd = v.unionByName(v).unionByName(spark.createDataFrame([("a", None, 0, 0, 1), (None, 0, 0, 0, 1), ("a", 0, 0, 0, None)], SCHEMA))
    assert got(M.surfaces(odd)) == got(M.surfaces(v)) and M.outlines(odd).exceptAll(M.outlines(v)).isEmpty()
    assert M.surfaces(v.limit(0)).isEmpty() and M.outlines(v.limit(0)).isEmpty()


def test_outlines(spark):
    a = np.zeros((2, 9, 9), int)
    a[0, 2:6, 2:5], a[0, 7, 7], a[1, 1, 1], a[1, 2, 2] = 1, 2, 3, 3
    r = {(o.label, o.z): (o.area, o.perimeter) for o in M.outlines(frame(spark, a), (1.0, 2.0, 2.0)).collect()}
    corner = math.sqrt(2)  # of a pixel of 2 x 2
    assert r[1, 0] == (48.0, pytest.approx(2 * (3 + 2) * 2 + 4 * corner)) and r[2, 0] == (4.0, pytest.approx(4 * corner))
    assert r[3, 1] == (8.0, pytest.approx(8 * corner))  # kept apart
    open_ = M.outlines(frame(spark, a[:, 2:, :]), shape=(2, 7, 9)).where("label = 1").first().perimeter
    assert open_ == pytest.approx(3 + 3 + 2 + 2 * math.sqrt(0.5))
