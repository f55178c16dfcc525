"""Steps that make several rows of one are dealt out by the number of rows, and results do not show it."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain import storage
from voxelgrain.operators import matching, meshes
from voxelgrain.operators import relational as R
from voxelgrain.operators import volume as V
from voxelgrain.plans import outlines as O
from voxelgrain.plans import sites as S


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(storage, "ROWS", 40)


@pytest.fixture(scope="module")
def noise(spark):
    r = np.random.default_rng(8)
    rows = [("t", z, y, x, int(r.integers(1, 3)), float(r.integers(0, 9))) for z in range(3) for y in range(9) for x in range(9) if r.random() < 0.7]
    return spark.createDataFrame(rows, "tomo string, z int, y int, x int, label long, value double")


def dealt(df) -> int:
    """Partitions of the last shuffle whose number the code has set."""
    return max((int(n) for n in re.findall(r", (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())), default=0)


def at(df):
    return {(r.z, r.y, r.x): r.label for r in df.collect()}


def test_dilate(noise, few):
    own = at(noise)
    want = dict(own)
    for p, label in own.items():
        for o in V.FACES:
            q = tuple(i + j for i, j in zip(p, o, strict=True))
            if q not in own:
                want[q] = max(want.get(q, 0), label)
    got = V.dilate(noise)
    assert dealt(got) >= 7 * len(own) // 40 and at(got) == want


def test_closing(spark, few):
    v = spark.createDataFrame([("t", z, y, x, 1) for z in range(5) for y in range(5) for x in range(5) if (z, y, x) != (2, 2, 2)], "tomo string, z int, y int, x int, label long")
    got = V.closing(v)
    assert dealt(got) >= 4 * 124 // 40 and len(at(got)) == 125


def test_laplace(noise, few):
    img = {(r.z, r.y, r.x): r.value for r in noise.collect()}
    near = {p: [img.get((p[0], p[1] + a, p[2] + b)) for _, a, b in V.CROSS_2D] for p in img}
    got = S.laplace(noise)
    assert dealt(got) >= 4 * len(img) // 40
    assert {(r.z, r.y, r.x): r.edge for r in got.collect()} == {p: sum(n) - 4 * img[p] for p, n in near.items() if None not in n}


def test_gradient(noise, few):
    img = {(r.z, r.y, r.x): r.value for r in noise.collect()}
    got = S.gradient(noise)
    assert dealt(got) >= 8 * len(img) // 40
    want = {}
    for z, y, x in img:
        w = [(a, b, img.get((z, y + a, x + b))) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
        if all(v is not None for _, _, v in w):
            want[z, y, x] = pytest.approx(np.hypot(sum(v * a * (2 - abs(b)) for a, b, v in w), sum(v * b * (2 - abs(a)) for a, b, v in w)))
    assert {(r.z, r.y, r.x): r.edge for r in got.collect()} == want


def test_surfaces(noise, few):
    cubes = meshes._cases(noise, "zyx", None)
    assert dealt(cubes) >= 8 * noise.count() // 40
    assert cubes.agg(F.sum(F.bit_count("case"))).first()[0] == 8 * noise.count()


def test_ragged_pivot(spark, few, monkeypatch):
    monkeypatch.setattr(R, "RUN", 7)
    r = np.random.default_rng(2)
    rows = [("abc"[k % 3], None if k % 11 == 0 else float(r.integers(0, 4))) for k in range(200)] + [(None, 1.0)] * 90
    got = R.ragged_pivot(spark.createDataFrame(rows, "g string, v double"), "g", "v", ["a", "c"])
    sides = {g: sorted((v for h, v in rows if h == g), key=lambda v: (v is not None, v)) for g in ("a", "b", "c", None)}
    want = {k + 1: tuple(sides[g][k] if k < len(sides[g]) else None for g in "ac") for k in range(max(map(len, sides.values())))}
    assert dealt(got) >= 290 // 40 and got.columns == ["row", "a", "c"] and dict(got.dtypes)["row"] == "int"
    assert {r.row: (r.a, r.c) for r in got.collect()} == want
    assert "Window [row_number" not in got._jdf.queryExecution().executedPlan().toString()


def test_polygons(spark, few, monkeypatch):
    """Bands do not show: a triangle of 40 rows, cut every three."""
    rows = [("t", 1, 0, 0, n, y, x) for n, (y, x) in enumerate([(-5.0, 0.0), (35.0, 0.0), (35.0, 80.0)])]
    points = spark.createDataFrame(rows, "tomo string, label long, z int, contour int, n int, y double, x double")
    monkeypatch.setattr(O, "BAND", 3)
    got = O.fill_polygons(points)
    assert dealt(got) >= 2
    assert {(r.y, r.x) for r in got.collect()} == {(y, x) for y in range(-5, 35) for x in range(80) if x < 2 * (y + 5)}


def test_matching_broadcasts_nothing(spark, monkeypatch):
    plans, write = [], matching.stage
    monkeypatch.setattr(matching, "stage", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    edges = spark.createDataFrame([("t", 1, 1), ("t", 1, 2), ("t", 2, 1), ("t", 3, 2), ("t", 3, 3)], "tomo string, a long, b long")
    assert matching.maximum_matching(edges).count() == 3
    assert plans and not any("Broadcast" in p for p in plans)


def test_refine_shapes_reads_what_is_written(noise, few):
    """A ring asks for the grown objects three times; they are not made anew for each."""
    out = S.refine_shapes(noise.select(*V.POS, "label"), noise.select(*V.POS, F.lit(0.0).alias("edge")), 1, 2, 1.0)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hash") <= 8
