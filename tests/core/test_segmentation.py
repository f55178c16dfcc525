"""Segmentation, radii and filters: fixtures and brute force."""

import numpy as np
import pytest

from voxelgrain.operators import distance as D
from voxelgrain.operators import lines as L
from voxelgrain.plans import filters as E
from voxelgrain.plans import segmentation as G

SCHEMA = "tomo string, z int, y int, x int, "


def volume(spark, a, column="label", kind="long"):
    return spark.createDataFrame([("a", *map(int, p), a[tuple(p)].item()) for p in np.argwhere(a != 0)], f"{SCHEMA}{column} {kind}")


def image(spark, a):
    return spark.createDataFrame([("a", *map(int, p), float(a[tuple(p)])) for p in np.argwhere(np.ones(a.shape, bool))], f"{SCHEMA}value double")


def dense(df, shape, column="value"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[column]
    return out


def prediction(spark, shape, balls):
    """Two touching balls: foreground inside, border on their rims."""
    at = np.indices(shape)
    fg, bd = np.zeros(shape), np.zeros(shape)
    for c, r in balls:
        d = np.sqrt(sum((x - k) ** 2 for x, k in zip(at, c, strict=True)))
        fg[d <= r] = 1.0
        bd[(d <= r) & (d > r - 1.5)] = 1.0
    rows = [("a", *map(int, p), float(fg[tuple(p)]), float(bd[tuple(p)])) for p in np.argwhere(np.ones(shape, bool))]
    return spark.createDataFrame(rows, SCHEMA + "foreground double, border double"), fg


BALLS = [((5, 7, 7), 5), ((5, 7, 17), 5)]


@pytest.mark.parametrize("options", [{}, {"distance_seeds": 1.5}, {"planar": True}, {"distance_seeds": 1.5, "planar": True}])
def test_touching_balls_are_told_apart(spark, options):
    p, fg = prediction(spark, (11, 15, 25), BALLS)
    out = G.segment(p, **options).collect()
    mid = [r for r in out if r.z == 5]
    left, right = {r.label for r in mid if r.x < 11}, {r.label for r in mid if r.x > 13}
    assert len(left) == len(right) == 1 and left != right
    if not options.get("planar"):
        assert len(out) == int(fg.sum()) and len({r.label for r in out}) == 2
        assert G.segment(p, min_size=10_000, **options).isEmpty()
    else:  # a slice with rims alone has no seed
        assert {r.z for r in out} < set(range(11)) and all(fg[r.z, r.y, r.x] for r in out)


def test_borders_of_the_volume(spark):
    p, _ = prediction(spark, (9, 15, 25), [((4, 7, 6), 4), ((7, 7, 17), 4)])
    labels = lambda **o: G.segment_with_borders(p, (9, 15, 25), **o).select("label").distinct().count()
    assert labels() == 2 and labels(exclude_border=True) == 0 and labels(exclude_partial=3) == 1
    inside = p.where("x < 12").select("tomo", "z", "y", "x")
    out = G.segment_with_borders(p, (9, 15, 25), mask=inside)
    assert {r.label for r in out.collect()} == {1} and out.where("x >= 12").isEmpty()


def test_no_border_seeds_the_whole_foreground(spark):
    rows = [("a", 0, 0, x, 1.0, 0.0) for x in range(5)] + [("a", 0, 0, 6, None, 0.0)]
    p = spark.createDataFrame(rows, SCHEMA + "foreground double, border double")
    assert {r.label for r in G.segment(p, distance_seeds=8.0).collect()} == {1}
    assert G.segment(p.where("false")).isEmpty()


def test_radii(spark):
    a = np.zeros((9, 12, 30), int)
    a[2:7, 2:9, 2:9], a[0:3, 5:8, 15:18], a[4, 4, 25] = 1, 2, 3
    v = volume(spark, a)
    get = lambda **o: {r.label: r.radius for r in G.radii(v, min_size=1, **o).collect()}
    assert get(planar=False) == {1: 2.0, 2: 1.0} and get(planar=True)[1] == 3.0
    # every voxel of the outer slices is boundary, unless they are those of the volume
    assert get(planar=False, shape=a.shape)[2] == pytest.approx(1.0)
    assert get(planar=False, size=(0.5, 1.0, 1.0))[1] == 1.0


@pytest.mark.parametrize("planar", [True, False])
def test_edge_filters_equal_numpy(spark, planar):
    a = np.random.default_rng(1).random((4, 9, 10))
    axes = (1, 2) if planar else (0, 1, 2)
    t = [L.gaussian_taps(0.8, k) for k in range(3)]

    def along(b, taps, axis):
        r = len(taps) // 2
        pad = np.pad(b, [(r, r) if k == axis else (0, 0) for k in range(3)], "symmetric")
        return sum(w * np.take(pad, range(k, k + b.shape[axis]), axis) for k, w in enumerate(taps))

    def apply(b, orders, taps=t):
        for axis in axes:
            b = along(b, taps[orders.get(axis, 0)], axis)
        return b

    first, second = [apply(a, {k: 1}) for k in axes], [apply(a, {k: 2}) for k in axes]
    get = lambda m: dense(E.edge_filter(image(spark, a), 0.8, m, planar), a.shape)
    assert np.allclose(get("ggm"), np.sqrt(sum(g * g for g in first)))
    assert np.allclose(get("laplace"), sum(second))
    smooth = apply(a, {})
    rise, spread = np.array([-0.5, 0, 0.5]), np.array([0.25, 0.5, 0.25])
    slopes = []
    for k in axes:
        b = smooth
        for axis in axes:
            b = along(b, rise if axis == k else spread, axis)
        slopes.append(b)
    assert np.allclose(get("sobel"), np.sqrt(sum(s * s for s in slopes) / len(axes)))
    u = [L.gaussian_taps(0.4)] * 3
    tensor = np.stack([np.stack([apply(g * h, {}, u) for h in first], -1) for g in first], -1)
    values = np.linalg.eigvalsh(tensor)
    out = E.structure_tensor(image(spark, a), 0.8, 0.4, planar)
    for k in range(len(axes)):
        assert np.allclose(dense(out, a.shape, f"e{k + 1}"), values[..., -1 - k], atol=1e-7)


def test_eigenvalues_of_special_matrices(spark):
    ms = [np.zeros((3, 3)), np.eye(3) * 2, np.diag([3.0, 3.0, 1.0]), np.diag([1.0, -2.0, 5.0]), np.ones((3, 3))]
    df = spark.createDataFrame([(i, *[float(m[r]) for r in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))]) for i, m in enumerate(ms)], "i int, xx double, yy double, zz double, xy double, xz double, yz double")
    from pyspark.sql import functions as F

    e = E.eigenvalues_3d(*[F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")])
    for r in df.select("i", *[x.alias(f"e{k}") for k, x in enumerate(e)]).collect():
        assert np.allclose([r.e0, r.e1, r.e2], np.linalg.eigvalsh(ms[r.i])[::-1], atol=1e-7)


def test_ridges_find_a_dark_line(spark):
    a = np.ones((1, 24, 24))
    a[0, :, 11:13] = 0.0
    out = dense(E.edge_filter(image(spark, a), 1.0, "sato"), a.shape)[0]
    assert out.min() == 0 and out.max() == 1 and (out.argmax(1) >= 10).all() and (out.argmax(1) <= 13).all()
    with pytest.raises(ValueError):
        E.edge_filter(image(spark, a), 1.0, "none")
    assert E.edge_filter(image(spark, a * 0 + 1), 1.0, "sato").where("value <> 0").isEmpty()


def test_ridge_zone_leaves_objects_out(spark):
    a = np.ones((1, 24, 24))
    a[0, :, 11:13] = 0.0
    zone, thing = np.zeros(a.shape, int), np.zeros(a.shape, int)
    zone[0, 4:20, 6:18], thing[0, 12:14, 6:18] = 1, 1
    out = E.ridge_zone(image(spark, a), volume(spark, zone), volume(spark, thing), 1.0, iterations=0).collect()
    assert out and all(4 <= r.y < 12 for r in out) and {r.x for r in out} >= {11, 12}


def test_orientation_of_a_plate_and_a_rod(spark):
    a = np.zeros((5, 14, 14), int)
    a[2, 1:13, 1:13] = 1
    rod = np.zeros((5, 14, 14), int)
    rod[2, 6, 1:13] = 2
    get = lambda b: E.orientation(volume(spark, b), 1.0, 1.0).first()
    plate, line = get(a), get(rod)
    assert plate.label == 1 and line.label == 2
    # a plate has one direction of change, a rod two
    assert plate.e1 > 5 * plate.e2 and line.e2 > 5 * line.e3 and line.e1 < 1.5 * line.e2


def test_nearest_structure_of_overlaps_nulls_and_far_objects(spark):
    a = np.zeros((12, 12, 12), int)
    a[1:10, 1:10, 1:10] = 1
    b = np.zeros(a.shape, int)
    b[5, 5, 5] = 9  # inside of the block, at none of its surfaces
    r = D.nearest_structure(volume(spark, a), volume(spark, b)).first()
    assert r.distance == 0 and tuple(r.ep_object) == tuple(r.ep_structure) == (5, 5, 5) and r.structure_label == 9
    odd = spark.createDataFrame([("a", None, 0, 0, 1), ("a", 0, 0, 900, 2), ("b", 0, 0, 0, 3), ("a", 0, 0, 0, None)], SCHEMA + "label long")
    got = D.nearest_structure(odd, volume(spark, b)).collect()
    assert [(x.label, round(x.distance, 3)) for x in got] == [(2, round((895**2 + 50) ** 0.5, 3))]


@pytest.mark.parametrize("limit", [1.0, 4.0, 7.3])
def test_pairs_within_a_limit_equal_brute_force(spark, limit):
    r = np.random.default_rng(3)
    a = np.where(r.random((6, 16, 16)) < 0.05, r.integers(1, 9, (6, 16, 16)), 0)
    size = (1.5, 1.0, 1.0)
    pts = {k: np.argwhere(a == k) for k in range(1, 9)}
    want = {}
    for i in pts:
        for j in pts:
            if i < j and len(pts[i]) and len(pts[j]):
                best = min((((p - q) * size) @ ((p - q) * size), tuple(p), tuple(q)) for p in pts[i] for q in pts[j])
                if best[0] <= limit**2:
                    want[i, j] = (round(best[0] ** 0.5, 9), best[1], best[2])
    got = {(x.id_a, x.id_b): (round(x.distance, 9), tuple(x.ep_a), tuple(x.ep_b)) for x in D.pairwise(volume(spark, a), limit, size, surface=False).collect()}
    assert got == want
