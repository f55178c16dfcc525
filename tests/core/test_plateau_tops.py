"""Tops of slices are found block by block, over their edges too; walls make no gradient."""

import numpy as np

from voxelgrain import catalog_segments as S
from voxelgrain.plans import compartments as P


def test_tops_over_the_edges_of_blocks(spark):
    r = np.random.default_rng(9)
    v = {("t", z, y, x): float(r.integers(0, 4)) for z in (-1, 0, 31, 32) for y in range(28, 37) for x in range(-4, 5) if r.random() < 0.8}
    got = {(q.tomo, q.z, q.y, q.x): q._top for q in P._tops(spark.createDataFrame([(*k, h) for k, h in v.items()], "tomo string, z int, y int, x int, value double")).collect()}
    want = {(t, z, y, x): all(v.get((t, z, y + b, x + c), -1.0) <= h for _, b, c in P.RING) for (t, z, y, x), h in v.items()}
    assert got == want and len(set(want.values())) == 2


def test_walls_filter_the_image_alone(spark, monkeypatch):
    image = spark.createDataFrame([("t", z, 0, x, float(x + z)) for z in range(2) for x in range(5)], "tomo string, z int, y int, x int, value double")
    made, own = [], S.stage
    monkeypatch.setattr(S, "dense_image", lambda s, d: image)
    monkeypatch.setattr(S, "stage", lambda df, name: made.append(df.columns) or own(df, name))
    walls = {tuple(q[:4]): q.value for q in S.walls(spark, "").collect()}
    assert made == [["tomo", "z", "y", "x", "v"]]
    assert walls == {tuple(q[:4]): 1 - q.foreground for q in S.predictions(spark, "").collect()}
