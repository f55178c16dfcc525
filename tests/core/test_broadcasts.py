"""Tables of voxels, nodes and objects take few bytes on disk and many in a driver: joins with them are not broadcast."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain import views
from voxelgrain.operators import components as C
from voxelgrain.operators import distance as D
from voxelgrain.operators import eikonal as K
from voxelgrain.operators import volume as V
from voxelgrain.storage import stage


@pytest.fixture(scope="module")
def noise(spark):
    r = np.random.default_rng(3)
    rows = [("t", z, y, x, int(r.integers(1, 4))) for z in range(4) for y in range(9) for x in range(9) if r.random() < 0.6]
    return stage(spark.createDataFrame(rows, "tomo string, z int, y int, x int, label long"), "noise")  # so that Spark knows how small it is


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that the modules write."""
    found = []

    def noted(df, name, own=C.stage):
        found.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df, name)

    for module in (C, D, K):
        monkeypatch.setattr(module, "stage", noted)
    return found


def keys(*texts: str) -> set[str]:
    """Keys of the joins that are broadcast."""
    return {re.sub(r"#\d+L?", "", k) for t in texts for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", t)} | {"none" for t in texts if "BroadcastNestedLoopJoin" in t}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mode", ["inner", "between", "outer"])
def test_boundary(noise, mode):
    assert not keys(plan(V.boundary(noise, mode)))


def test_inner_boundary_of_repeated_and_shared_voxels(spark, noise):
    own = {(r.z, r.y, r.x, r.label) for r in noise.collect()} | {(1, 1, 1, k) for k in (1, 2, 3)}
    v = spark.createDataFrame([("t", *p) for p in [*own, *own]], noise.schema)
    rim = {p for p in own if any((p[0] + a, p[1] + b, p[2] + c, p[3]) not in own for a, b, c in V.FACES)}
    got = [(r.z, r.y, r.x, r.label) for r in V.boundary(v).collect()]
    assert len(got) == len(rim) and set(got) == rim


def test_components(noise, plans):
    got = V.size_filter(C.components(noise, 1, block_edge=3).withColumnRenamed("component", "label"), 2)
    assert len(plans) > 3 and not keys(plan(got), *plans)


def test_nearest_structure(noise, plans):
    D.nearest_structure(noise.where("label = 1"), noise.where("label = 2")).collect()
    assert len(plans) > 3 and keys(*plans) <= {"tomo"}


def test_membrane_by_path(noise, plans):
    got = K.membrane_by_path(noise.where("label < 3"), noise.where("label = 3"), 4.0, min_size=1)
    assert len(plans) > 3 and keys(plan(got), *plans) <= {"tomo"}


def test_dense_image(spark, small):
    image = views.dense_image(spark, small)
    assert "BroadcastExchange" not in plan(image)
    li = views.table(spark, small, "lineitem")
    assert image.count() == 7 * 64 * 64 * li.select(F.floor(F.col("l_orderkey") / views.ORDERS)).distinct().count()
    assert image.agg(F.sum("value")).first()[0] == li.where("l_linenumber between 1 and 7").agg(F.sum("l_quantity")).first()[0]
