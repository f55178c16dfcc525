"""Voxel and measurement tables made from the star-schema test tables.

A volume is a sparse voxel table (tomo, z, y, x, label): background is absent.
Each view comes with the same view as DuckDB SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPE = (8, 64, 64)
#: Orders whose lines make one tomogram: their number grows with the table.
ORDERS = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(spark: SparkSession, sf_dir: str, flag: str, shift: int) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    y, x = (F.col("l_partkey") % 64).cast("int"), (F.col("l_suppkey") * 7 % 64).cast("int")
    tomo = F.concat(F.lit("tomo"), F.floor(F.col("l_orderkey") / ORDERS).cast("string"))
    label = (1 + F.floor((y + shift) / 8) * 9 + F.floor((x + shift) / 8)).cast("long")
    return li.select(tomo.alias("tomo"), F.col("l_linenumber").cast("int").alias("z"), y.alias("y"), x.alias("x"), label.alias("label")).distinct()


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation: 64 square objects in each tomogram."""
    return _grid(spark, sf_dir, "R", 0)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second segmentation, shifted by three voxels."""
    return _grid(spark, sf_dir, "A", 3)


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of the objects whose label divides by 7: a membrane, say."""
    return voxels(spark, sf_dir).where(F.col("label") % 7 == 0)


def vesicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(spark, sf_dir).where(F.col("label") % 7 != 0)


def dense_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tomo, z, y, x, value): the quantity ordered at every position of every tomogram, dealt out by planes of x."""
    li = table(spark, sf_dir, "lineitem")
    at = [F.concat(F.lit("tomo"), F.floor(F.col("l_orderkey") / ORDERS).cast("string")).alias("tomo"), F.col("l_linenumber").cast("int").alias("z"), (F.col("l_partkey") % 64).cast("int").alias("y"), (F.col("l_suppkey") * 7 % 64).cast("int").alias("x")]
    lines = li.select(*at, F.col("l_quantity").cast("double").alias("value"))
    grid = lines.select("tomo").distinct()
    for c, lo, hi in (("z", 1, 7), ("y", 0, 63), ("x", 0, 63)):
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    # every position adds a zero, so that no join is needed
    every = lines.where("tomo is not null and z between 1 and 7 and y between 0 and 63 and x between 0 and 63").unionByName(grid.withColumn("value", F.lit(0.0)))
    # whole lines along z and y are in one partition: a pass along z needs no shuffle of its own
    return every.repartition("tomo", "x").groupBy("tomo", "z", "y", "x").agg(F.sum("value").alias("value"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tomo, id, radius, ribbon_distance, pd_distance, boundary_distance) in nm."""
    li = table(spark, sf_dir, "lineitem")
    m = li.groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"), F.max("l_discount").alias("d"), F.max("l_suppkey").alias("s"))
    return m.select(
        F.concat(F.lit("tomo"), (F.col("s") % 20).cast("string")).alias("tomo"),
        (F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"),
        (F.col("q") / 2 + 5).alias("radius"),
        (F.col("q") * 4).alias("ribbon_distance"),
        (F.col("t") * 2000).alias("pd_distance"),
        (F.col("d") * 1000).alias("boundary_distance"),
    )


def _grid_sql(name: str, flag: str, shift: int) -> str:
    return f"""{name} AS (SELECT DISTINCT 'tomo' || CAST(l_orderkey // {ORDERS} AS VARCHAR) AS tomo, CAST(l_linenumber AS INTEGER) AS z,
  CAST(l_partkey % 64 AS INTEGER) AS y, CAST(l_suppkey * 7 % 64 AS INTEGER) AS x,
  CAST(1 + ((l_partkey % 64 + {shift}) // 8) * 9 + ((l_suppkey * 7 % 64 + {shift}) // 8) AS BIGINT) AS label
  FROM lineitem WHERE l_returnflag = '{flag}')"""


VOXELS_SQL = _grid_sql("vox", "R", 0)
TRUTH_SQL = _grid_sql("gt", "A", 3)
DENSE_SQL = f"""found AS (SELECT 'tomo' || CAST(l_orderkey // {ORDERS} AS VARCHAR) AS tomo, CAST(l_linenumber AS INTEGER) AS z, CAST(l_partkey % 64 AS INTEGER) AS y, CAST(l_suppkey * 7 % 64 AS INTEGER) AS x,
  CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY ALL),
 dense AS MATERIALIZED (SELECT t.tomo, CAST(a.i AS INTEGER) AS z, CAST(b.i AS INTEGER) AS y, CAST(c.i AS INTEGER) AS x, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT tomo FROM found) t, range(1, 8) a(i), range(64) b(i), range(64) c(i)
  LEFT JOIN found f ON f.tomo = t.tomo AND f.z = a.i AND f.y = b.i AND f.x = c.i)"""
STRUCTURE_SQL = "structure AS (SELECT * FROM vox WHERE label % 7 = 0), ves AS (SELECT * FROM vox WHERE label % 7 <> 0)"
MEASURES_SQL = """meas AS (SELECT 'tomo' || CAST(s % 20 AS VARCHAR) AS tomo, CAST(l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS BIGINT) AS id,
  q / 2 + 5 AS radius, q * 4 AS ribbon_distance, t * 2000 AS pd_distance, d * 1000 AS boundary_distance
  FROM (SELECT l_orderkey, l_partkey, l_linenumber, max(l_quantity) q, max(l_tax) t, max(l_discount) d, max(l_suppkey) s FROM lineitem GROUP BY ALL))"""
