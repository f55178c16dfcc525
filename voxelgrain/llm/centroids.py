"""Centroid clustering in whole numbers, with partial-distance search.

Every round streams the written vectors once: tasks assign them and return one
sum a centroid and dimension, and the driver holds the centroids alone. Within
a task squared differences are added up over the dimensions of highest variance
first, and a centroid is given up as soon as its part is strictly above the
best whole distance; what survives has all dimensions added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.common import finite_vectors, stage

SCALE = 1024
#: Whole numbers of this size and over could overflow a squared distance of 64 bits.
LARGEST = 2**27
#: Dimensions added at a time.
STEP = 8


def nearest(v: np.ndarray, c: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of every vector's nearest centroid, ties to the smaller number.

    Columns of both stand in the order in which they are to be added.
    """
    n, d = v.shape
    first = np.stack([((v[:, :step] - q[:step]) ** 2).sum(1) for q in c], 1)
    at = first.argmin(1)
    best = first[np.arange(n), at] + ((v[:, step:] - c[at, step:]) ** 2).sum(1)
    for j in range(len(c)):
        rows = np.flatnonzero((first[:, j] <= best) & (at != j))
        part = first[rows, j]
        for a in range(step, d, step):
            part = part + ((v[rows, a : a + step] - c[j, a : a + step]) ** 2).sum(1)
            live = part <= best[rows]
            rows, part = rows[live], part[live]
        win = (part < best[rows]) | ((part == best[rows]) & (j < at[rows]))
        at[rows[win]], best[rows[win]] = j, part[win]
    return at, best


def _read(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.int32).reshape(-1, width).astype(np.int64)


def _variance_order(rows: DataFrame, width: int) -> np.ndarray:
    """Dimensions by falling variance; the order changes the work, not the result."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(width), np.zeros(width)
        for b in batches:
            x = _read(b.column(0), width).astype(np.float64)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(s), pa.array(q)], names=["i", "n", "s", "q"])

    made = rows.select("v").mapInArrow(work, "i int, n long, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    var = {r["i"]: r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in made.collect()}  # one row a dimension
    return np.array(sorted(range(width), key=lambda i: (-var[i], i)), np.int64)


def _round(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """(next centroids, counts, inertias) of one assignment of all vectors."""
    k, width = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids[:, order]
        sums, more = np.zeros((k, width), object), np.zeros((k, 2), object)  # Python's whole numbers
        for b in batches:
            x = _read(b.column(0), width)
            at, dist = nearest(x[:, order], c)
            for j in np.unique(at).tolist():
                mine = at == j
                sums[j] += x[mine].sum(0)
                more[j] += [int(mine.sum()), sum(dist[mine].tolist())]
        table = np.concatenate([sums, more], 1)
        hit = np.flatnonzero(more[:, 0] > 0)
        cols = [pa.array(np.repeat(hit, width + 2), pa.int32()), pa.array(np.tile(np.arange(width + 2), len(hit)), pa.int32()), pa.array([Decimal(int(s)) for s in table[hit].ravel()], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(cols, names=["cluster", "i", "s"])

    made = rows.select("v").mapInArrow(work, "cluster int, i int, s decimal(38,0)").groupBy("cluster", "i").agg(F.sum("s").alias("s"))
    table = [[0] * (width + 2) for _ in range(k)]
    for r in made.collect():  # k * (width + 2) rows
        table[r["cluster"]][r["i"]] = int(r["s"])
    new = np.array([[s // t[width] for s in t[:width]] if t[width] else c for t, c in zip(table, centroids.tolist(), strict=True)], np.int64)
    return new, [t[width] for t in table], [t[width + 1] for t in table]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector.

    Vectors that are null, hold null or non-finite components or have another
    number of components than ``dim`` take no part. The first centroids are the
    ``k`` vectors of least SHA-256 of ``seed:id``; of rows with one id the one
    with the smaller bytes goes first, and rows without an id start none but
    are assigned. With fewer vectors than ``k`` there are fewer centroids; with
    none, or no id at all, no rows. Repeated rows each count. Equal distances go
    to the smaller number, a centroid without vectors stays. Inertias are exact
    decimals of 38 digits. Components of 131,072 and over raise OverflowError.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = f"`{id_col}` {dict(vectors.dtypes)[id_col]}, cluster int, distance long"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(SCALE * b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if len(x) and np.abs(x).max() >= LARGEST:
                raise OverflowError(f"a component times {SCALE} is beyond 2^27")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x.astype(np.int32).reshape(-1, dim)], pa.binary())], names=[id_col, "v"])

    usable = finite_vectors(vectors, id_col, vector).where(F.size("v") == dim)
    rows = stage(usable.mapInArrow(pack, f"`{id_col}` {dict(vectors.dtypes)[id_col]}, v binary"), "centroids-rows")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256)
    first = rows.where(F.col(id_col).isNotNull()).select(draw.alias("draw"), "v").orderBy("draw", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"{schema}, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string")
    centroids = np.stack([np.frombuffer(r["v"], np.int32) for r in first]).astype(np.int64)
    order = _variance_order(rows, dim)
    for _ in range(rounds):
        centroids, _, _ = _round(rows, centroids, order)
    _, _, inertia = _round(rows, centroids, order)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids[:, order]
        for b in batches:
            at, dist = nearest(_read(b.column(1), dim)[:, order], c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), pa.array(dist, pa.int64())], names=[id_col, "cluster", "distance"])

    of = [(j, Decimal(n), Decimal(sum(inertia)), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, (n, c) in enumerate(zip(inertia, centroids.tolist(), strict=True))]
    about = spark.createDataFrame(of, "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string")
    return rows.mapInArrow(assign, schema).join(F.broadcast(about), "cluster").select(f"`{id_col}`", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
