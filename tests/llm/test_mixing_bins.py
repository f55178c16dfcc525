"""Bins of sources with low weights."""

from pyspark.sql import functions as F

from voxelgrain.llm import mixing


def test_bins_are_small_at_weight_0_05(spark, monkeypatch):
    keys = []
    kept = mixing.stage
    monkeypatch.setattr(mixing, "stage", lambda df, name: keys.append(kept(df, name)) or keys[-1])
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("1 2 3").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(d)
    assert keys[0].groupBy("bin").count().agg(F.max("count")).first()[0] <= 100
    assert got.count() == 20_000 and abs(got.agg(F.sum("taken")).first()[0] - 90_000) <= 1
