"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task sorts or hashes, about.
ROWS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where unset, in local mode alone, a temporary folder, set once."""
    kept = spark.sparkContext.getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or kept
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not kept:
        spark.sparkContext.setCheckpointDir(root)
    return root


def parts(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows. Adaptive execution goes by bytes, of which
    sorted coordinates have so few that one task would get many million rows;
    a number given to ``repartition`` is kept."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts lineage and
    survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
