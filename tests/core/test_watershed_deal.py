"""Heights and seeds are shuffled once, into their blocks: rows of one voxel are joined there."""

from voxelgrain.operators import watershed as W


def test_blocks_take_one_shuffle_and_no_join(spark, monkeypatch):
    plans = []

    def noted(df, name, own=W.stage):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return own(df, name)

    monkeypatch.setattr(W, "stage", noted)
    rows = [("t", 0, 0, x, h) for x, h in enumerate((3.0, 1.0, 2.0, 9.0, 1.0))]
    v = spark.createDataFrame([*rows, ("t", 0, 0, 0, 0.5), ("t", 0, 0, 4, None), ("t", 0, 0, 6, None)], "tomo string, z int, y int, x int, height double")
    seeds = spark.createDataFrame([("t", 0, 0, 0, 3), ("t", 0, 0, 0, 7), ("t", 0, 0, 4, 2), ("t", 0, 0, 6, 5), ("t", 0, 0, 2, 0)], "tomo string, z int, y int, x int, label int")
    for edge in (2, 32):
        got = {r.x: r.label for r in W.watershed(v, seeds, block_edge=edge).collect()}
        assert got == {0: 7, 1: 7, 2: 7, 3: 2, 4: 2}, edge
    first = next(p for name, p in plans if name == "watershed-blocks")
    assert "Join" not in first and "Aggregate" not in first
