"""Toxicity: FTRL-proximal logistic regression over hashed n-grams.

Features of a document are the distinct hashed words, word stems (first five
letters), word pairs and skip-grams (pairs with a word between). Every
coordinate has a learning rate of its own and an L1 penalty keeps the weights
few, so the model is a short list of buckets and weights that is broadcast for
scoring. It is fitted in one streaming task over a bounded sample of the
labelled rows (``max_docs``): that task reads every row once for each epoch and
holds the model and one batch, however long the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.common import TEXT, Hashes, beside, bounded, kept, labelled, mix, slices, words_of

BITS = 20
MAX_DOCS = 20_000
STEM = 5
#: A word pair's distance: 1 for neighbours, more for skip-grams.
GAPS = (1, 2)


class Features:
    """Hashed features of texts, as buckets in the order of the text."""

    def __init__(self, bits: int = BITS):
        self.bits, self.words = bits, Hashes(11)
        self.stems = Hashes(12)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(document number, bucket) of every feature, repeats included."""
        cut = [words_of(t) for t in texts]
        sizes = np.array([len(c) for c in cut], np.int64)
        flat = [w for c in cut for w in c]
        h = self.words.of(flat)
        stem = self.stems.of([w.decode("utf-8", "ignore")[:STEM].encode() for w in flat])
        doc = np.repeat(np.arange(len(cut)), sizes)
        docs, made = [doc, doc], [h, stem]
        for gap in GAPS:
            same = np.flatnonzero(doc[gap:] == doc[:-gap])
            docs.append(doc[same])
            made.append(mix(h[same] * np.uint64(2 * gap + 1) + (h[same + gap] ^ np.uint64(gap))))
        return np.concatenate(docs), (np.concatenate(made) >> np.uint64(64 - self.bits)).astype(np.int32)


class Ftrl:
    """Per-coordinate FTRL-proximal state; the last coordinate is the intercept."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(z), self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(rows: DataFrame, bits: int = BITS, epochs: int = 3, max_docs: int = MAX_DOCS, **rates) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) other than zero, from rows (doc_id, text, y).

    About ``max_docs`` rows are read at most, in the order of a hash of the id,
    and all of them in every epoch. Null and empty texts teach the intercept;
    very long ones are read whole; repeated rows count each time. With no rows
    the model is empty and scores one half.
    """
    few = bounded(rows.select("doc_id", "text", "y"), "doc_id", max_docs)
    few = few.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    few = few.repartition(1).sortWithinPartitions("epoch", F.xxhash64("doc_id", F.lit("order")), "text").select("text", "y")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, feats = Ftrl(bits, **rates), Features(bits)
        for b in slices(batches, limit=2_000_000):
            texts, ys = b.column(0).to_pylist(), b.column(1).to_pylist()
            doc, bucket = feats.batch(texts)
            order = np.argsort(doc, kind="stable")
            cut = np.split(bucket[order], np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1])
            for f, y in zip(cut, ys, strict=True):
                model.learn(np.append(np.unique(f), np.int32(1 << bits)), y)
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["bucket", "weight"])

    made = few.mapInArrow(train, "bucket long, weight double").toPandas()  # 2^bits rows at most
    return made["bucket"].to_numpy(np.int64), made["weight"].to_numpy(np.float64)


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str], text: str = "text", bits: int = BITS) -> DataFrame:
    """``keep`` columns and ``score``, the probability of label 1.

    Null and empty texts have the intercept alone; very long ones are scored
    whole; repeated rows score alike; an empty table gives none. A kept column
    with the name of a result gets ``_in`` at its end.
    """
    keep, src = beside(keep, ["score"]), documents.select(*kept(documents, keep, ["score"]), F.col(text).alias(TEXT))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value = shared.value
        w = np.zeros((1 << bits) + 1, np.float32)
        w[at] = value
        feats = Features(bits)
        for b in slices(batches, TEXT, 2_000_000):
            doc, bucket = feats.batch(b.column(b.num_columns - 1).to_pylist())
            live = np.flatnonzero(w[bucket])
            pair = np.unique(doc[live].astype(np.int64) << bits | bucket[live])
            total = np.bincount(pair >> bits, w[pair & ((1 << bits) - 1)], b.num_rows) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array(p, pa.float64())], names=[*keep, "score"])

    return src.mapInArrow(work, ", ".join([f"`{c}` {t}" for c, t in src.dtypes[:-1]] + ["score double"]))


def train_and_score(documents: DataFrame, labels: DataFrame, keep: list[str], train_where, text: str = "text", **options) -> DataFrame:
    """Fit on the labelled rows for which ``train_where`` holds, score all rows."""
    model = fit(labelled(documents.where(train_where).select("doc_id", F.col(text).alias("text")), labels, "toxic"), **options)
    return score(documents, model, keep, text, options.get("bits", BITS))
