"""Predictions are set against the means of their tomogram without a shuffle of the image; derivatives carry no column that no pass needs."""

from voxelgrain import catalog_segments as S
from voxelgrain.operators import lines as L


def test_predictions_join_means_by_broadcast(spark, monkeypatch):
    rows = [("t", z, y, x, float(z + y * x)) for z in range(2) for y in range(3) for x in range(3)]
    image = spark.createDataFrame(rows, "tomo string, z int, y int, x int, value double")
    monkeypatch.setattr(S, "dense_image", lambda s, d: image)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a large image
    try:
        plan = S.predictions(spark, "")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_derivatives_shuffle_no_image_after_the_first_pass(spark, monkeypatch):
    made = []

    def noted(*args, own=L.line_filter, **more):
        made.append(out := own(*args, **more))
        return out

    monkeypatch.setattr(L, "line_filter", noted)
    image = spark.createDataFrame([("t", 0, 0, 0, 1.0)], "tomo string, z int, y int, x int, value double")
    L.derivatives(image, 1.0, {"v": (0, 0, 0)})
    assert len(made) == 3 and not any("value" in m.columns for m in made)
