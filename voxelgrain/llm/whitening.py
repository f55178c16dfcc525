"""Embedding whitening by cyclic Jacobi rotations.

Vectors become whole numbers x, of which every distinct one counts once. Spark
sums them and their centred products over all tasks; the driver gets one row a
pair of dimensions, turns the covariance until its off-diagonals vanish and
ships the whitening matrix, dimensions x components, back to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.common import finite_vectors, stage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Whole numbers beyond this do not come exactly from a double.
LARGEST = 2**52


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors in columns) of a symmetric matrix, by falling value.

    Pairs are turned in row order until every off-diagonal is under half a unit
    in the last place of its two diagonals' geometric mean, so that small values
    keep their leading digits. The largest entry of every vector is positive.
    """
    a, d = a.astype(np.float64).copy(), len(a)
    v = np.eye(d)
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= 2.0**-53 * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                half = (a[q, q] - a[p, p]) / (2 * off)
                t = (1.0 if half >= 0 else -1.0) / (abs(half) + np.hypot(half, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                new_p, new_q = a[p, p] - t * off, a[q, q] + t * off
                row_p, row_q = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[:, p], a[q], a[:, q] = row_p, row_p, row_q, row_q
                a[p, p], a[q, q], a[p, q], a[q, p] = new_p, new_q, 0.0, 0.0
                v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
        if not turned:
            break
    value = np.diag(a)
    order = np.argsort(-value, kind="stable")
    v = v[:, order]
    return value[order], v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0)


def _grid(v: pa.Array, width: int) -> np.ndarray:
    """The whole numbers of a batch of vectors, one row a vector."""
    x = np.floor(SCALE * v.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(x) and np.abs(x).max() >= LARGEST:
        raise OverflowError(f"a component times {SCALE} is beyond 2^52")
    return x.astype(np.int64).reshape(-1, width) + SHIFT


def _read(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.int64).reshape(-1, width)


def _count_and_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of every dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for b in batches:
            x = _read(b.column(0), width)
            n += len(x)
            high, low = (x >> 26).sum(0).tolist(), (x & (2**26 - 1)).sum(0).tolist()  # neither overflows
            total = [t + (h << 26) + lo for t, h, lo in zip(total, high, low, strict=True)]
        cols = [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(cols, names=["i", "n", "s"])

    made = fit.select("x").mapInArrow(work, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rows = sorted(made.collect())  # one a dimension
    return int(rows[0]["n"]), [int(r["s"]) for r in rows]


def _products(fit: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """Sum over all vectors of the outer product of ``of`` them, d x d."""
    i, j = np.triu_indices(d)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            y = of(_read(b.column(0), width))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    out = np.zeros((d, d))
    for r in fit.select("x").mapInArrow(work, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # d * (d + 1) / 2 rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) by row and component.

    Rows whose vector is null, holds null or non-finite entries or has another
    number of entries than most rows (the smaller number on a tie; empty ones
    count) take no part. Repeated rows count once in the fit list and each
    return their own rows; a null id is returned as such. Equal eigenvalues keep
    the order in which the rotations leave them. A component without variance
    (under the rounding error of the trace) has a null ``whitened`` and is left
    out of ``identity_error``, which is null where no component has any; where
    the trace is 0, ``explained`` is null. ``deviation`` is an exact decimal of
    38 digits. Entries of 2^46 and over raise OverflowError. An empty table, or
    one of empty vectors, gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = f"`{id_col}` {dict(vectors.dtypes)[id_col]}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = finite_vectors(vectors, id_col, vector)
    most = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if most is None or not most["w"]:
        return spark.createDataFrame([], schema)
    width = most["w"]
    rows = rows.where(F.size("v") == width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in _grid(b.column(0), width)], pa.binary())], names=["x"])

    fit = stage(rows.select("v").mapInArrow(pack, "x binary").distinct(), "whitening-fit")
    n, sums = _count_and_sums(fit, width)
    # x - S/n as a whole part and a fraction, so that no digit is lost
    whole, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    fraction = np.array([r / n for r in rest])
    centred = lambda x: (x - whole) - fraction
    values, turn = jacobi(_products(fit, width, centred, width) / n)
    trace = float(values.sum())
    k = min(components, width)
    live = values[:k] > max(trace, 0.0) * width * 2.0**-52
    weight = np.where(live, turn[:, :k] / np.sqrt(np.where(live, values[:k], 1.0)), 0.0)
    whitened = lambda x: centred(x) @ weight
    error = None
    if live.any():
        cov = _products(fit, width, whitened, k)[np.ix_(live, live)] / n  # whitened values are centred
        error = float(np.abs(cov - np.eye(int(live.sum()))).max())
    explained = [float(v) / trace if trace > 0 else None for v in values[:k]]

    def deviations(x: np.ndarray) -> pa.Array:
        gap = x - whole
        if width * ((float(np.abs(gap).max(initial=0)) + 1) * n) ** 2 < 2.0**62:
            return pa.array(((n * gap - np.array(rest, np.int64)) ** 2).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
        exact = gap.astype(object) * n - np.array(rest, object)
        return pa.array([Decimal(int(s)) for s in (exact * exact).sum(1)], pa.decimal128(38, 0))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _grid(b.column(1), width)
            at = np.repeat(np.arange(len(x)), k)
            w = whitened(x)
            cols = [
                b.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), n, np.int64)),
                deviations(x).take(pa.array(at)),
                pa.array(w.ravel(), mask=np.tile(~live, len(x))),
                pa.array(explained * len(x), pa.float64()),
                pa.array([error] * len(at), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(emit, schema)
