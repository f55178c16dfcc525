"""Queries over the corpus tables: one for each operator, with its parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrain.llm import ann, bpe, centroids, dedup, langid, lm, mixing, packing, quality, rules, toxicity, urls, whitening
from voxelgrain.llm.common import crc_split

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# Every query reads one row of its table for one row of its result (op6: for its
# queries). Nulls, empty and very long texts, ties, repeated rows and empty tables
# have the results that the docstrings of the operators state.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents: four-word shingles, similarity 0.8."""
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, per_cent=80)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learns from labels with crc32 mod 3 other than 1, blocks from 0.7."""
    docs = table(spark, sf_dir, "documents")
    split = crc_split("doc_id", 3)
    out = toxicity.train_and_score(docs, table(spark, sf_dir, "labels"), ["doc_id"], split != 1)
    return out.select("doc_id", (split == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of token ids and of the decoded text."""
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER, ["doc_id"])


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram and base scores of every document; learns from crc32 mod 5 other than 1."""
    return lm.score(table(spark, sf_dir, "documents"), crc_split("doc_id", 5) != 1)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of every document; learns from crc32 mod 5 other than 0."""
    docs = table(spark, sf_dir, "documents")
    split = crc_split("doc_id", 5)
    out = langid.predict(docs, langid.fit(docs.where(split != 0)), ["doc_id"])
    return out.select("doc_id", (split == 0).alias("held_out"), "lang_pred", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every vector whose id divides by 100, among all others."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learns from labels with crc32 mod 5 other than 0, keeps from 0.3."""
    docs = table(spark, sf_dir, "documents")
    split = crc_split("doc_id", 5)
    out = quality.train_and_score(docs, table(spark, sf_dir, "labels"), ["doc_id"], split != 0)
    return out.select("doc_id", (split == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    out = rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every URL."""
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every vector; a deviation beyond a long is null."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector: 8 centroids, 10 rounds; an inertia beyond a long is null."""
    out = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return out.withColumns({c: F.expr(f"try_cast({c} as bigint)") for c in ("cluster_inertia", "inertia")})


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document, 2048 tokens a sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_minhash_near_dedup, op2_toxicity, op3_bpe, op4_lm_score, op5_language_id, op6_nearest_neighbours, op7_quality, op8_mix_sources, op9_quality_rules, op10_url_filter, op11_embedding_whitening, op12_centroid_clustering, op13_best_fit_packing]
    return {f.__name__: f for f in ops}


WORDS_SQL = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
LOWER_WORDS_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

DEDUP_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {LOWER_WORDS_SQL} AS ws FROM documents),
 l AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
 s AS (SELECT DISTINCT doc_id, unnest(sh) AS sh FROM l), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r(id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT sym.b, r.m FROM r JOIN sym ON sym.a = r.id WHERE r.m < sym.b),
 c AS (SELECT id, min(m) AS m FROM r GROUP BY id)
 SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

MIX_SQL = f"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len({WORDS_SQL}), 0) AS BIGINT) AS size,
  -ln((CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
  / greatest(0.05, coalesce(length(regexp_replace(text, '[^\\p{{L}}\\p{{M}}]', '', 'g')) / greatest(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')), 1)
   * ln(1.0 + len(list_distinct({WORDS_SQL}))) / ln(1.0 + greatest(len({WORDS_SQL}), 1)), 0.0)) AS k FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
 v AS (SELECT source, source_size, [5, 2, 1][(i - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM s),
 o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(w) OVER (ORDER BY cap / w DESC, source DESC) AS open, (SELECT 1.5 * sum(source_size) FROM s) AS total FROM v),
 u AS (SELECT arg_min((total - held) / open, held) AS unit FROM o WHERE w * ((total - held) / open) <= cap),
 t AS (SELECT source, source_size, CASE WHEN w * unit > cap THEN cap ELSE w * unit END::DOUBLE AS target FROM v, u),
 g AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
 q AS (SELECT d.*, g.source_size, g.target, g.epochs, round(g.target - g.epochs * g.source_size)::BIGINT AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source)
 SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(0, rest - before)) AS BIGINT) AS taken FROM q"""


def centroids_sql(k: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3) -> str:
    """Rounds of assignment and floored means, each a pair of tables."""
    gap = "CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    steps = [f"""x AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim}),
 c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM x WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT i, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := {gap}, k := cluster)) AS m FROM x, c{r} GROUP BY i)")
        if r < rounds:
            sums = f"SELECT cluster, dim, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS q FROM (SELECT m.k AS cluster, dim, sum(e) AS s, count(*) AS n FROM (SELECT m, unnest(v) AS e, unnest(range({dim})) AS dim FROM a{r}) GROUP BY ALL)"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT cluster, list(q ORDER BY dim) AS c FROM ({sums}) GROUP BY cluster) n USING (cluster))")
    return f"""WITH {", ".join(steps)}
 SELECT vec_id, m.k AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON cluster = m.k"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": DEDUP_SQL, "op8_mix_sources": MIX_SQL, "op12_centroid_clustering": centroids_sql()}
