"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, name: str = "voxelgrain", **settings: str) -> SparkSession:
    """A session with the library's settings; ``settings`` come on top."""
    b = SparkSession.builder.appName(name)
    b = b.master(master) if master else b
    for k, v in (SETTINGS | settings).items():
        b = b.config(k, v)
    return b.getOrCreate()
