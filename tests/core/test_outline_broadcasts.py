"""Floods, outlines and lines: no table of voxels, nodes or pairs goes through the driver."""

import re

import numpy as np
import pytest

from voxelgrain.operators import components as C
from voxelgrain.operators import distance as D
from voxelgrain.operators import watershed as W
from voxelgrain.plans import outlines as O
from voxelgrain.storage import stage


def keys(*texts: str) -> set[str]:
    """Keys of the joins that are broadcast."""
    return {re.sub(r"#\d+L?", "", k) for t in texts for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", t)} | {"none" for t in texts if "BroadcastNestedLoopJoin" in t}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that the modules write."""
    found = []

    def noted(df, name, own=stage):
        found.append(plan(df))
        return own(df, name)

    for module in (C, D, O, W):
        monkeypatch.setattr(module, "stage", noted)
    return found


def staged(spark, rows, columns):
    return stage(spark.createDataFrame(rows, columns), "input")  # so that Spark knows how small it is


def test_watershed(spark, plans):
    r = np.random.default_rng(4)
    at = [("t", z, y, x) for z in range(2) for y in range(6) for x in range(6)]
    height = staged(spark, [(*p, float(h)) for p, h in zip(at, r.random(len(at)), strict=True)], "tomo string, z int, y int, x int, height double")
    seeds = staged(spark, [(*at[0], 1), (*at[-1], 2)], "tomo string, z int, y int, x int, label long")
    got = W.watershed(height, seeds, block_edge=3)
    assert got.count() == len(at) and len(plans) > 3 and not keys(plan(got), *plans)


def test_outline_instances(spark, plans):
    ring = [("t", z, y, x) for z in range(3) for y in range(4, 13) for x in range(4, 13) if min(y - 4, 12 - y, x - 4, 12 - x) < 3]
    got = O.instances_from_outlines(staged(spark, ring, "tomo string, z int, y int, x int"), (3, 20, 20), far=3.0, closing=1)
    # the box of a volume and its largest label are rows by tomogram
    assert got.count() > len(ring) and len(plans) > 8 and keys(plan(got), *plans) <= {"tomo", "tomo, _slice"}


def test_direct_pairs(spark, plans):
    v = staged(spark, [("t", 0, 0, x, k) for k, x in ((1, 0), (2, 4), (3, 8))], "tomo string, z int, y int, x int, label long")
    got = D.direct_pairs(D.pairwise(v, 9.0), v)
    assert sorted((r.id_a, r.id_b) for r in got.collect()) == [(1, 2), (2, 3)]
    assert not keys(plan(got), *plans)
