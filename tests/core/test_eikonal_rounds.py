"""Rounds of the eikonal distance move blocks and what changed on their faces, not voxels."""

import numpy as np

from voxelgrain.operators import eikonal as K


def test_a_round_has_a_row_a_block_and_face(spark, monkeypatch):
    made, own = [], K.stage
    monkeypatch.setattr(K, "stage", lambda df, name: made.append((name, own(df, name))) or made[-1][1])
    at = [("t", 7, z, y, x) for z in range(-3, 5) for y in range(8) for x in range(8)]
    mask = spark.createDataFrame(at, "tomo string, label long, z int, y int, x int")
    got = K.eikonal_distance(mask, mask.where("z = -3"), (2.0, 1.0, 1.0), keys=("tomo", "label"), block=(4, 4, 4))
    rounds = [df.count() for name, df in made if name == "eikonal"]
    # z from -3 to 4 meets blocks -1, 0 and 1, with four blocks in each
    assert len(rounds) >= 3 and max(rounds) <= 12 + 12 * 6 and rounds[-1] == 12
    rows = got.collect()
    assert len(rows) == len(at) and all(r.label == 7 and abs(r.distance - 2.0 * (r.z + 3)) < 1e-9 for r in rows)


def test_order_of_neighbours_does_not_matter():
    r = np.random.default_rng(6)
    near = r.random((3, 500)) * 4
    near[r.random(near.shape) < 0.2] = np.inf
    size = (2.5, 1.0, 1.5)
    want = K.upwind(near, size)
    for turn in ([1, 2, 0], [2, 1, 0], [0, 2, 1]):
        assert np.allclose(K.upwind(near[turn], tuple(size[k] for k in turn)), want, rtol=0, atol=1e-12, equal_nan=True)
    one = np.isfinite(near).sum(0) == 1
    assert np.allclose(want[one], np.where(np.isfinite(near), near + np.array(size)[:, None], np.inf).min(0)[one])
