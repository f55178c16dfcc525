"""Work in blocks gives what the whole volume gives, whatever the size of a block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain.operators import components as C
from voxelgrain.operators import distance as D
from voxelgrain.operators.watershed import watershed


@pytest.fixture(scope="module")
def noise():
    r = np.random.default_rng(4)
    return [("t", z, y, x, int(r.integers(1, 3))) for z in range(-3, 4) for y in range(-6, 7) for x in range(10) if r.random() < 0.3]


def test_components_over_blocks(spark, noise):
    v = spark.createDataFrame(noise, "tomo string, z int, y int, x int, label long")
    for options in ({"connectivity": 3}, {"connectivity": 1, "per_label": True}, {"connectivity": 3, "planar": True}):
        one, many = ({tuple(r) for r in C.components(v, **options, block_edge=e).collect()} for e in (64, 3))
        assert one == many and len(one) == len(noise)


def test_floods_over_blocks(spark, noise):
    r = np.random.default_rng(5)
    height = spark.createDataFrame([("t", z, y, x, float(r.integers(0, 6))) for z in range(-2, 4) for y in range(9) for x in range(9)], "tomo string, z int, y int, x int, height double")
    seeds = spark.createDataFrame([("t", -2, 1, 1, 5), ("t", 3, 8, 0, 2), ("t", 0, 4, 7, 9), ("t", 0, 4, 8, 9)], "tomo string, z int, y int, x int, label long")
    for planar in (False, True):
        one, many = ({tuple(r) for r in watershed(height, seeds, planar, block_edge=e).collect()} for e in (64, 4))
        assert one == many and len(one) == (3 * 81 if planar else 6 * 81)


def test_pairs_in_pieces(spark, noise, monkeypatch):
    """Pieces and cells do not show: least distances and their first end points are those of all voxels."""
    monkeypatch.setattr(D, "PIECE", 5)
    v = spark.createDataFrame(noise, "tomo string, z int, y int, x int, label long").withColumn("label", F.col("label") + 10 * (F.col("x") > 4).cast("long"))
    objects = {}
    for r in v.collect():
        objects.setdefault(r.label, []).append((r.z, r.y, r.x))
    want = {}
    for a in objects:
        for b in objects:
            if a < b:
                d2, p, q = min((2.25 * (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2, p, q) for p in objects[a] for q in objects[b])
                if d2 <= 9:
                    want[a, b] = (pytest.approx(d2**0.5), p, q)
    got = {(r.id_a, r.id_b): (r.distance, tuple(r.ep_a), tuple(r.ep_b)) for r in D.pairwise(v, 3.0, (1.5, 1.0, 1.0), surface=False).collect()}
    assert got == want


def test_no_join_of_pairs_or_cells_is_broadcast(spark, noise):
    """Spread sides look small on disk; a broadcast of them went through the driver."""
    v = spark.createDataFrame(noise, "tomo string, z int, y int, x int, label long")
    plan = D.pairwise(v, 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BroadcastHashJoin" not in plan


def test_nearest_from_both_sides(spark, noise):
    """Whichever side has fewer voxels is spread; the result is that of all voxels, and nothing spread is broadcast."""
    v = spark.createDataFrame(noise, "tomo string, z int, y int, x int, label long")
    few = v.where("x = 0 and y > 3").withColumn("label", F.lit(7).cast("long"))
    many = v.where("x > 5")
    at = lambda t: [((r.z, r.y, r.x), r.label) for r in t.collect()]
    for a, b in ((few, many), (many, few)):
        want = {}
        for p, label in at(a):
            for q, s in at(b):
                m = (sum((i - j) ** 2 for i, j in zip(p, q, strict=True)), p, q, s)
                want[label] = min(want.get(label, m), m)
        got = {r.label: (round(r.distance**2), tuple(r.ep_object), tuple(r.ep_structure), r.structure_label) for r in D.nearest_structure(a, b, surface=False).collect()}
        assert got == want
