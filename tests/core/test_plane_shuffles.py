"""Passes along two axes share one shuffle by planes; distances in slices take one shuffle of domain and features."""

import re

import numpy as np

from voxelgrain import catalog_segments as S
from voxelgrain import views
from voxelgrain.operators import lines as L
from voxelgrain.plans import segmentation as G


def shuffles(df) -> int:
    """Shuffles of voxels by columns."""
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_derivatives_take_two_shuffles(spark, small):
    orders = {"v": (0, 0, 0), "dz": (1, 0, 0), "dx": (0, 0, 1)}
    image = spark.createDataFrame([("t", z, y, x, float(z * y - x)) for z in range(3) for y in range(4) for x in range(5)], "tomo string, z int, y int, x int, value double")
    assert shuffles(L.derivatives(image, 1.0, orders)) == 2
    # the image is grouped in the partitions in which its lines lie
    dense = views.dense_image(spark, small)
    assert shuffles(L.derivatives(dense, 1.0, orders)) == shuffles(dense) + 1


def test_predictions_write_no_gradient(spark, monkeypatch):
    image = spark.createDataFrame([("t", 0, 0, x, float(x)) for x in range(3)], "tomo string, z int, y int, x int, value double").repartition(1)
    made, own = [], S.stage
    monkeypatch.setattr(S, "dense_image", lambda s, d: image)
    monkeypatch.setattr(S, "stage", lambda df, name: made.append(df.columns) or own(df, name))
    S.predictions(spark, "")
    assert made == [["tomo", "z", "y", "x", "v", "slope"]]


def test_distances_in_slices_take_one_shuffle(spark):
    r = np.random.default_rng(8)
    pick = lambda share: [(t, z, y, x) for t in "ab" for z in range(3) for y in range(9) for x in range(9) if r.random() < share and (t, z) != ("b", 1)]
    rows, to = pick(0.5), [p for p in pick(0.1) if p[:2] != ("a", 2)]
    columns = "tomo string, z int, y int, x int"
    domain, features = spark.createDataFrame([*rows, *rows[:5], ("a", None, 1, 1)], columns), spark.createDataFrame([*to, *to[:3]], columns)
    got = G.distances(domain, features, (2.0, 1.0, 1.5), planar=True)
    by_slice = lambda v: v.select("tomo", views.F.col("z").alias("_slice"), *"zyx")
    lines = L.distance_field(by_slice(domain), by_slice(features), (2.0, 1.0, 1.5), ("tomo", "_slice"))
    assert shuffles(got) < shuffles(lines)
    want = {}
    for t, z, y, x in rows:
        near = [((y - b) ** 2 + (1.5 * (x - c)) ** 2, z, b, c) for s, a, b, c in sorted(to) if (s, a) == (t, z)]
        if near:
            want[t, z, y, x] = min(near)
    assert len(want) < len(rows)
    for out in (got, lines.drop("_slice")):
        found = {(q.tomo, q.z, q.y, q.x): (q.distance, q.near_z, q.near_y, q.near_x) for q in out.collect()}
        assert found.keys() == want.keys()
        assert all(abs(found[k][0] ** 2 - w[0]) < 1e-9 and found[k][1:] == w[1:] for k, w in want.items())
