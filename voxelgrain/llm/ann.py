"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: the signs of rotations, each learned by iterative
quantisation on a bounded sample. A code is split into substrings of ``WIDTH``
bits, and each substring of a block of vectors is indexed by value. A query
probes each index at every value within ``reach`` bits of its own. By the
pigeonhole principle that finds every code within a Hamming radius of
``substrings * (reach + 1) - 1``, and many beyond; all that is found is ranked
by the exact distance of the original vectors. Substrings and reach are learned
on the sample: of all pairs the one that probes the least and still meets the
wanted share of the sample's true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelgrain.llm.common import stage

WIDTH = 20
MOST_SUBSTRINGS, MOST_REACH = 56, 4
#: Share of the sample's true neighbours that probing must meet.
RECALL = 0.96
SAMPLE = 8_000
BLOCK_ROWS = 32_768
QUERY_ROWS = 2_048


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of vectors that take part: not null, not zero, all components finite."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(some, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def rotations(x: np.ndarray, number: int, steps: int = 15, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(centre, dim x bits): rotations that bring the sample near its signs."""
    r, mean = np.random.default_rng(seed), x.mean(0)
    y = x - mean
    out = []
    for _ in range(number):
        rot = np.linalg.qr(r.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(steps):
            u, _, vt = np.linalg.svd(y.T @ np.sign(y @ rot))
            rot = u @ vt
        out.append(rot)
    return mean, np.concatenate(out, 1)


def codes(x: np.ndarray, mean: np.ndarray, rot: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The substrings of each vector's code, as whole numbers."""
    out = np.zeros((len(x), rot.shape[1] // width), np.uint32)
    for t in range(out.shape[1]):
        bits = (x - mean) @ rot[:, t * width : (t + 1) * width] > 0
        out[:, t] = bits @ (1 << np.arange(width, dtype=np.uint32))
    return out


def ball(width: int, reach: int) -> np.ndarray:
    """All differences of ``width`` bits with ``reach`` ones at most."""
    return np.array([sum(1 << b for b in bits) for k in range(reach + 1) for bits in combinations(range(width), k)], np.uint32)


def learn(sample: np.ndarray, k: int, recall: float = RECALL, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, int]:
    """(centre, rotations, reach) from a sample of vectors.

    Measured on the k nearest of 300 vectors of the sample; in more data the k
    nearest are nearer, so that more of them are met there.
    """
    dim = sample.shape[1]
    mean, rot = rotations(sample, -(-MOST_SUBSTRINGS * width // dim))
    code = codes(sample, mean, rot[:, : MOST_SUBSTRINGS * width], width)
    rng = np.random.default_rng(11)
    gaps = []
    for i in rng.choice(len(sample), min(300, len(sample)), False):
        d = ((sample - sample[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        gaps.append(np.bitwise_count(code[near] ^ code[i]))
    gaps = np.concatenate(gaps) if gaps else np.zeros((0, MOST_SUBSTRINGS), np.uint8)
    best = None
    for reach in range(MOST_REACH + 1):
        met = np.logical_or.accumulate(gaps <= reach, axis=1).mean(0) if len(gaps) else np.ones(MOST_SUBSTRINGS)
        chance = sum(comb(width, j) for j in range(reach + 1)) / 2**width
        for m, share in enumerate(met.tolist(), 1):
            probed = 1 - (1 - chance) ** m
            # those that meet the wanted share by the least probing, before the nearest to it
            rank = (share < recall, probed if share >= recall else -share, m)
            if best is None or rank < best[0]:
                best = rank, m, reach
    return mean, rot[:, : best[1] * width], best[2]


class MultiIndex:
    """Substrings of a block of codes, each with its rows by value."""

    def __init__(self, code: np.ndarray, width: int = WIDTH):
        self.code, self.width, self.balls = code, width, {}
        self.rows, self.starts = [], []
        kind = np.uint16 if len(code) < 1 << 16 else np.uint32
        for t in range(code.shape[1]):
            self.rows.append(np.argsort(code[:, t], kind="stable").astype(kind))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(code[:, t], minlength=1 << width))]).astype(kind))

    def probe(self, q: np.ndarray, reach: int) -> np.ndarray:
        """All rows with a substring within ``reach`` bits of that of ``q``."""
        hit = np.zeros(len(self.code), bool)
        if reach not in self.balls:
            self.balls[reach] = ball(self.width, reach)
        around = self.balls[reach]
        for rows, starts, value in zip(self.rows, self.starts, q, strict=True):
            at = around ^ value
            lo, hi = starts[at], starts[at + 1]
            full = np.flatnonzero(hi > lo)
            lo, size = lo[full].astype(np.int64), (hi[full] - lo[full]).astype(np.int64)
            end = np.cumsum(size)
            hit[rows[np.repeat(lo - end + size, size) + np.arange(end[-1] if len(end) else 0)]] = True
        return np.flatnonzero(hit)


def _search(table: pa.Table, model: tuple, k: int) -> pa.Table:
    """Nearest of one block of candidates for one block of queries."""
    mean, rot, reach = model
    side = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
    ids, row = table.column("id").to_numpy(), table.column("row").to_numpy()
    x = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(len(ids), -1)
    order = np.lexsort((row, ids))
    side, ids, row, x = side[order], ids[order], row[order], x[order]
    qid, qrow, q, cid, crow, c = ids[side], row[side], x[side], ids[~side], row[~side], x[~side]
    out: list[tuple[int, int, int, float]] = []
    if len(cid) and len(qid):
        index, qc = MultiIndex(codes(c, mean, rot)), codes(q, mean, rot)
        for i in range(len(qid)):
            wide = reach
            while True:
                rows = index.probe(qc[i], wide)
                rows = rows[crow[rows] != qrow[i]]
                if len(rows) >= k or len(rows) >= len(cid) - 1 or wide >= index.width:
                    break
                # a block that gives fewer than k is searched whole in the end
                wide = wide + 1 if wide < MOST_REACH else index.width
                if wide == index.width:
                    rows = np.flatnonzero(crow != qrow[i])
                    break
            d = np.sqrt(((c[rows] - q[i]) ** 2).sum(1))
            best = np.lexsort((crow[rows], cid[rows], d))[:k]
            out += zip([int(qid[i])] * len(best), [int(qrow[i])] * len(best), cid[rows[best]].tolist(), d[best].tolist(), strict=True)
    a, r, b, s = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"query_id": pa.array(a, pa.int64()), "row": pa.array(r, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row.

    Every row that takes part is indexed; queries and candidates meet in blocks
    of bounded size, and a block pair returns k rows a query. Vectors that are
    null or zero, or hold null or non-finite components, or whose number of
    components is not that of most rows, take no part. Equal distances rank by
    id. Repeated ids: each row is a query of its own and a candidate for every
    other row, those of its own id included. With fewer than k candidates all
    are returned; an empty table gives none. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.withColumn("_query", queries), id_col, vector)
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = width["count"]
    asked = usable(vectors.where(queries), id_col, vector).select("id").distinct().withColumn("query", F.lit(True))
    # rows get numbers once, in a written table
    packed = rows.where(F.size("v") == width["w"]).mapInArrow(_to_bytes, "id long, v binary").join(asked, "id", "left").withColumn("row", F.monotonically_increasing_id())
    packed = stage(packed.select("id", "row", F.coalesce("query", F.lit(False)).alias("query"), "v"), "ann-rows")
    some = F.pmod(F.xxhash64("id", "row", F.lit("ann")), F.lit(1_000_000)) < max(1, min(1_000_000, int(1_000_000 * sample / n)))
    few = packed.where(some).orderBy("id", "row").select("v").limit(2 * sample).toPandas()
    if not len(few):
        few = packed.orderBy("id", "row").limit(1000).select("v").toPandas()
    model = spark.sparkContext.broadcast(learn(np.frombuffer(b"".join(few["v"]), np.float64).reshape(len(few), -1), k))
    blocks = -(-n // block_rows)
    q_blocks = max(1, -(-packed.where("query").count() // query_rows))
    cand = packed.select(F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"), F.lit(False).alias("query"), "id", "row", "v")
    ask = packed.where("query").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("row", F.lit("query")), F.lit(q_blocks)).cast("int").alias("q_block"), F.lit(True).alias("query"), "id", "row", "v")
    found = cand.unionByName(ask).groupBy("block", "q_block").applyInArrow(lambda t: _search(t, model.value, k), "query_id long, row long, vec_id long, score double")
    w = Window.partitionBy("query_id", "row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column(1)
        flat, off = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[i:j].tobytes() for i, j in zip(off, off[1:], strict=False)], pa.binary())], names=["id", "v"])
