"""Quality classifier: random-indexing word vectors and a small network.

Random indexing: every hashed word has a fixed sparse random vector of -1, 0
and 1; the context vector of a word is the sum of the random vectors around it
over all training texts, in whole numbers, so the table is counted in one pass
and its size is fixed. A document is the mean and spread of its words' own and
context vectors. A two-layer numpy network reads that; every fifth labelled
document is held back from training, and a temperature fitted on those
calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.common import TEXT, Hashes, beside, bounded, kept, labelled, mix, slices

BUCKETS = 1 << 16
DIM = 32
NEAR = 2
MAX_DOCS = 20_000
HIDDEN = 32


def index_vectors(buckets: int = BUCKETS, dim: int = DIM) -> np.ndarray:
    """Random vectors with a quarter of entries +-1, from a fixed seed."""
    r = np.random.default_rng(7)
    return ((r.integers(0, 2, (buckets, dim), dtype=np.int8) * 2 - 1) * (r.random((buckets, dim), np.float32) < 0.25)).astype(np.int8)


class Words:
    """Texts as runs of word buckets; case is kept."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.hashes = buckets, Hashes(21)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        cut = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        flat = [w for c in cut for w in c]
        return np.repeat(np.arange(len(cut)), [len(c) for c in cut]), (mix(self.hashes.of(flat)) % np.uint64(self.buckets)).astype(np.int64)


def context_vectors(documents: DataFrame, text: str = "text", buckets: int = BUCKETS, dim: int = DIM) -> np.ndarray:
    """Unit context vectors, buckets x dim, from all texts of ``documents``.

    Each task adds up one table of that size, whatever it reads.
    """
    src = documents.select(F.col(text).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = Words(buckets), np.zeros((buckets, dim), np.int32)
        own, seen = index_vectors(buckets, dim), np.zeros(buckets, bool)
        for b in slices(batches, TEXT, 2_000_000):
            doc, w = words.batch(b.column(0).to_pylist())
            if not len(w):
                continue
            near = np.zeros((len(w), dim), np.int8)  # 2 * NEAR entries of -1, 0 or 1 each
            for gap in range(1, NEAR + 1):
                same = np.flatnonzero(doc[gap:] == doc[:-gap])
                near[same] += own[w[same + gap]]
                near[same + gap] += own[w[same]]
            order = np.argsort(w, kind="stable")
            ws = w[order]
            first = np.flatnonzero(np.concatenate([[True], ws[1:] != ws[:-1]]))
            pairs[ws[first]] += np.add.reduceat(near[order], first, dtype=np.int32)
            seen[ws[first]] = True
        at = np.flatnonzero(seen)
        for part in np.array_split(at, max(1, len(at) // 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(pairs[part].ravel(), pa.int32()), dim).cast(pa.list_(pa.int32()))], names=["bucket", "v"])

    each = src.mapInArrow(work, "bucket long, v array<int>")
    total = each.groupBy("bucket").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(dim)]).toPandas()  # ``buckets`` rows at most
    out = np.zeros((buckets, dim))
    if len(total):
        out[total["bucket"]] = total.drop(columns="bucket").to_numpy(np.float64)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)).astype(np.float32)


class Pool:
    """Document vectors: mean, spread and length of the mean, and log length."""

    def __init__(self, context: np.ndarray):
        self.table = np.concatenate([(index_vectors(*context.shape) / np.sqrt(context.shape[1] / 4)).astype(np.float32), context], 1)
        self.words = Words(len(context))

    def batch(self, texts: list[str | None]) -> np.ndarray:
        doc, w = self.words.batch(texts)
        n = np.bincount(doc, minlength=len(texts)).astype(np.float32)
        d = self.table.shape[1]
        mean, square = np.zeros((len(texts), d), np.float32), np.zeros((len(texts), d), np.float32)
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        for i in range(0, d, 16):  # some dimensions at a time bound the memory
            v = self.table[:, i : i + 16][w]
            if len(first):
                mean[doc[first], i : i + 16] = np.add.reduceat(v, first)
                square[doc[first], i : i + 16] = np.add.reduceat(v * v, first)
        n1 = np.maximum(n, 1)[:, None]
        mean /= n1
        spread = np.sqrt(np.maximum(square / n1 - mean * mean, 0))
        half = d // 2
        norm = np.stack([np.linalg.norm(mean[:, :half], axis=1), np.linalg.norm(mean[:, half:], axis=1), np.log1p(n)], 1)
        return np.concatenate([mean, spread, norm], 1)


class Network:
    """One hidden layer of rectified units, trained by Adam on log loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 30, rate: float = 3e-3, seed: int = 3):
        r = np.random.default_rng(seed)
        self.mu, self.sd = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mu) / self.sd
        self.t = 1.0
        self.p = [r.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.array(np.log((y.mean() + 0.01) / (1.01 - y.mean())))]
        held = np.arange(len(y)) % 5 == 4
        tr = np.flatnonzero(~held)
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(epochs):
            r.shuffle(tr)
            for i in range(0, len(tr), 128):
                at = tr[i : i + 128]
                h = np.maximum(x[at] @ self.p[0] + self.p[1], 0)
                err = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -35, 35))) - y[at]) / len(at)
                back = np.outer(err, self.p[2]) * (h > 0)
                grads = [x[at].T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ err + 1e-4 * self.p[2], err.sum()]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if held.any():  # fewer than five rows hold none back: temperature 1
            z = self._raw(x[held])
            loss = lambda t: np.mean(np.logaddexp(0, z / t) - y[held] * z / t)
            self.t = float(min(np.exp(np.linspace(-1.5, 2, 71)), key=loss))

    def _raw(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def prob(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._raw((x - self.mu) / self.sd) / self.t, -35, 35)))


def fit(rows: DataFrame, context: np.ndarray, max_docs: int = MAX_DOCS) -> Network | None:
    """Network from (doc_id, text, y); only the document vectors of about
    ``max_docs`` rows at most come to the driver. Null and empty texts are the
    zero vector, repeated rows count each time. None without rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(context)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(shared.value)
        for b in slices(batches, "text", 2_000_000):
            x = pool.batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary()), b.column(2)], names=["doc_id", "x", "y"])

    got = bounded(rows.select("doc_id", "text", "y"), "doc_id", max_docs).mapInArrow(work, "doc_id long, x binary, y int").toPandas()
    if not len(got):
        return None
    got = got.assign(h=(got["doc_id"].to_numpy(np.int64) * 2654435761) % (1 << 32)).sort_values(["h", "x"])
    return Network(np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1).astype(np.float64), got["y"].to_numpy(float))


def score(documents: DataFrame, model: Network | None, context: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``score``, the calibrated probability of label 1.

    Null and empty texts get the network's value for no words; very long texts
    are pooled whole; without a model every score is one half. Repeated rows
    score alike; an empty table gives none. A kept column with the name of a
    result gets ``_in`` at its end.
    """
    keep, src = beside(keep, ["score"]), documents.select(*kept(documents, keep, ["score"]), F.col(text).alias(TEXT))
    shared = documents.sparkSession.sparkContext.broadcast((model and vars(model), context))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, vectors = shared.value
        pool, net = Pool(vectors), None
        if state:
            net = Network.__new__(Network)
            vars(net).update(state)
        for b in slices(batches, TEXT, 2_000_000):
            p = net.prob(pool.batch(b.column(b.num_columns - 1).to_pylist())) if net else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array(p, pa.float64())], names=[*keep, "score"])

    return src.mapInArrow(work, ", ".join([f"`{c}` {t}" for c, t in src.dtypes[:-1]] + ["score double"]))


def train_and_score(documents: DataFrame, labels: DataFrame, keep: list[str], train_where, text: str = "text", max_docs: int = MAX_DOCS) -> DataFrame:
    """Word vectors and network from the rows for which ``train_where`` holds."""
    train = documents.where(train_where).select("doc_id", F.col(text).alias("text"))
    context = context_vectors(train)
    return score(documents, fit(labelled(train, labels, "quality"), context, max_docs), context, keep, text)
