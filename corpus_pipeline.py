"""Training-corpus pipeline: five stages over the table of documents.

Every stage works on all rows that the one before kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrain.llm import bpe, dedup, mixing, rules, toxicity
from voxelgrain.llm.common import beside, crc_split, stage
from voxelgrain.llm.entries import TOKENIZER

TOXIC = 0.7


def named(out: DataFrame, docs: DataFrame, results: list[str]) -> list:
    """The columns of ``docs`` in the result of an operator that kept all of them."""
    return [F.col(f"`{n}`").alias(c) for n, c in zip(beside(docs.columns, results), docs.columns, strict=True)]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under ``TOXIC``; learns from labelled rows.

    Null and empty texts score by the intercept alone; rows without an id teach
    nothing and are judged as others are. Very long texts are read whole, equal
    rows stay or go together, an empty table gives none, and further columns of
    any name are carried along.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.labelled(docs.where(crc_split("doc_id", 3) != 1), labels, "toxic"))
    scored = toxicity.score(docs, model, [*docs.columns])
    return scored.where(F.col("score") < TOXIC).select(*named(scored, docs, ["score"]))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier rule keep.

    Null, empty and very short texts fail the base rules and go; very long ones
    are counted whole. Equal rows stay or go together, null languages and sources
    are groups of their own, an empty table gives none, and further columns of
    any name are carried along.
    """
    judged = rules.judge(docs, [*docs.columns])
    return judged.where("kept").select(*named(judged, docs, rules.RESULTS))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8).

    Where ids repeat, every row stands for itself, so that only rows whose own
    text has a copy go. Rows without words or without an id all stay. Very long
    texts are compared whole, an empty table gives none, and further columns of
    any name are carried along.
    """
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        found = dedup.near_duplicates(docs.select("doc_id", "text"), shingle=5, per_cent=80)
        gone = found.where(~F.col("kept")).select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    row = beside(["_row"], docs.columns)[0]
    rows = stage(docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "pipeline-rows")
    found = dedup.near_duplicates(rows.select("text", row), shingle=5, per_cent=80, id_col=row).select(row, "component_id")
    first = found.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(F.struct("doc_id", row))[row].alias(row)).select(row)
    return rows.join(first, row, "left_semi").unionByName(rows.where(F.col(row).isNull())).select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a part taken counts as a whole.

    Every row is mixed for itself, whatever its id, null or repeated. Null and
    empty texts have no words and are never taken; a null source is one of its
    own. An empty table gives none, and further columns of any name are carried
    along.
    """
    mixed = mixing.mix(docs, keep=[*docs.columns]).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return mixed.select(*named(mixed, docs, mixing.RESULTS), F.explode(F.sequence(F.lit(1), times)).alias(beside(["_copy"], docs.columns)[0])).select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; null and empty texts have none, equal rows the same.

    Executors come here with their heaps filled by the stages before, so that
    workers hold small caches.
    """
    return bpe.encode(docs, TOKENIZER, ["doc_id", "lang", "source"], cache=100_000, slice_bytes=2_000_000)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("minhash_near_dedup", drop_copies), ("mix_sources", mix_sources), ("bpe", encode)]
#: The models of the stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
