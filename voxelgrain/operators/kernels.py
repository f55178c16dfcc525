"""Numpy kernels for one object or one tomogram, run by Spark group by group.

They cover what has no relational form: thinning, thickness, paths.
The group is an object, (tomo, label), or its part of a slice, padded to its
bounding box.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.operators.lines import envelope
from voxelgrain.storage import stage

Size = tuple[float, float, float]
FACES = ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))


def dense(pdf: pd.DataFrame, pad: int = 1, value: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(array, corner) of a group's voxels in their padded bounding box."""
    p = pdf[["z", "y", "x"]].to_numpy(np.int64)
    lo = p.min(0) - pad
    a = np.zeros(p.max(0) - lo + 1 + pad, bool if value is None else pdf[value].dtype)
    a[tuple((p - lo).T)] = True if value is None else pdf[value].to_numpy()
    return a, lo


def distance_transform(mask: np.ndarray, size: Size = (1, 1, 1)) -> np.ndarray:
    """Exact Euclidean distance of each voxel of the mask to the background.

    Three passes of lower envelopes, in time linear in the voxels; infinite where
    there is no background at all.
    """
    d = np.where(mask, np.inf, 0.0)
    for axis, s in enumerate(size):
        rows = np.moveaxis(d, axis, -1)
        flat = rows.reshape(-1, rows.shape[-1]).copy()
        line, pos = np.nonzero(np.isfinite(flat))
        full, number = np.unique(line, return_inverse=True)
        if len(full):
            q_line, q_pos = np.repeat(np.arange(len(full)), flat.shape[1]), np.tile(np.arange(flat.shape[1]), len(full))
            value = flat[line, pos]
            won = envelope(number, pos, value, q_line, q_pos, float(s))
            flat[full] = (value[won] + ((q_pos - pos[won]) * s) ** 2).reshape(len(full), -1)
        d = np.moveaxis(flat.reshape(rows.shape), -1, axis)
    return np.sqrt(d)


def local_maxima(a: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Voxels of the mask that none of their 26 neighbours exceeds."""
    p = np.pad(a, 1, constant_values=-np.inf)
    best = np.full(a.shape, -np.inf)
    for o in (tuple(i - 1 for i in k) for k in np.ndindex(3, 3, 3)):
        best = np.maximum(best, p[tuple(slice(1 + d, 1 + d + n) for d, n in zip(o, a.shape, strict=True))])
    return mask & (a >= best)


def label(mask: np.ndarray) -> np.ndarray:
    """Face-connected components, numbered by their first voxel."""
    out, n = np.zeros(mask.shape, np.int64), 0
    for start in map(tuple, np.argwhere(mask)):
        if out[start]:
            continue
        n += 1
        out[start], todo = n, [start]
        while todo:
            p = todo.pop()
            for o in FACES:
                q = tuple(a + b for a, b in zip(p, o, strict=True))
                if all(0 <= c < m for c, m in zip(q, mask.shape, strict=True)) and mask[q] and not out[q]:
                    out[q] = n
                    todo.append(q)
    return out


def geodesic(mask: np.ndarray, start: np.ndarray, size: Size = (1, 1, 1)) -> np.ndarray:
    """Length of the shortest path inside the mask over all 26 neighbours.

    ``start`` holds lengths known so far: 0 where paths begin, infinite elsewhere.
    """
    out = np.where(mask, start, np.inf)
    around = [tuple(i - 1 for i in k) for k in np.ndindex(3, 3, 3) if k != (1, 1, 1)]
    steps = [(o, float(np.sqrt(sum((d * s) ** 2 for d, s in zip(o, size, strict=True))))) for o in around]
    heap = [(float(out[p]), p) for p in map(tuple, np.argwhere(np.isfinite(out)))]
    heapq.heapify(heap)
    while heap:
        d, p = heapq.heappop(heap)
        if d > out[p]:
            continue
        for o, w in steps:
            q = tuple(a + b for a, b in zip(p, o, strict=True))
            if all(0 <= c < m for c, m in zip(q, mask.shape, strict=True)) and mask[q] and d + w < out[q]:
                out[q] = d + w
                heapq.heappush(heap, (d + w, q))
    return out


def thin(mask: np.ndarray) -> np.ndarray:
    """Skeleton of a 2D mask by parallel thinning in two half steps."""
    a = np.pad(mask, 1).astype(np.uint8)
    while True:
        gone = 0
        for half in (0, 1):
            ring = [a[:-2, 1:-1], a[:-2, 2:], a[1:-1, 2:], a[2:, 2:], a[2:, 1:-1], a[2:, :-2], a[1:-1, :-2], a[:-2, :-2]]
            count = sum(r.astype(int) for r in ring)
            turns = sum(((ring[k] == 0) & (ring[(k + 1) % 8] == 1)).astype(int) for k in range(8))
            n, e, s, w = ring[0], ring[2], ring[4], ring[6]
            side = (n * e * s == 0) & (e * s * w == 0) if half == 0 else (n * e * w == 0) & (n * s * w == 0)
            drop = (a[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (turns == 1) & side
            a[1:-1, 1:-1][drop] = 0
            gone += int(drop.sum())
        if not gone:
            return a[1:-1, 1:-1].astype(bool)


def longest_path(skeleton: np.ndarray) -> np.ndarray:
    """The longest shortest path of each skeleton: its two farthest ends joined."""
    out = np.zeros(skeleton.shape, bool)
    left = skeleton.copy()
    ring = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]

    def walk(start):
        seen, todo = {start: None}, [start]
        for p in todo:
            for o in ring:
                q = (p[0] + o[0], p[1] + o[1])
                if 0 <= q[0] < skeleton.shape[0] and 0 <= q[1] < skeleton.shape[1] and skeleton[q] and q not in seen:
                    seen[q] = p
                    todo.append(q)
        return todo, seen

    while left.any():
        todo, _ = walk(tuple(np.argwhere(left)[0]))
        for p in todo:
            left[p] = False
        end, seen = walk(todo[-1])
        p = end[-1]
        while p is not None:
            out[p] = True
            p = seen[p]
    return out


def long_pieces(skeleton: np.ndarray, least: int) -> np.ndarray:
    """The pieces of a 2D skeleton, corners touching, of ``least`` voxels or more."""
    left = {tuple(p) for p in np.argwhere(skeleton).tolist()}
    out = np.zeros(skeleton.shape, bool)
    while left:
        todo = [left.pop()]
        for y, x in todo:
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        if len(todo) >= least:
            out[tuple(np.array(todo).T)] = True
    return out


def fill_holes(mask: np.ndarray, max_size: int) -> np.ndarray:
    """Closes holes (background cut off from the border) under ``max_size``."""
    back = label(~mask)
    open_ = set(np.unique(np.concatenate([np.take(back, i, a).ravel() for a in range(mask.ndim) for i in (0, -1)])))
    n = np.bincount(back.ravel())
    holes = [k for k in range(1, len(n)) if k not in open_ and n[k] < max_size]
    return mask | np.isin(back, holes)


def gradient_tensor(mask: np.ndarray, size: Size = (1, 1, 1)) -> np.ndarray:
    """Eigenvalues, ascending, of the mean outer product of the gradient."""
    g = np.stack(np.gradient(mask.astype(float), *size))[:, np.ones(mask.shape, bool)]
    return np.linalg.eigvalsh(g @ g.T / max(1, g.shape[1]))


# -- by group --------------------------------------------------------------


def per_object(v: DataFrame, schema: str, f: Callable[[pd.DataFrame], dict], keys: tuple[str, ...] = ("tomo", "label")) -> DataFrame:
    """One row for each object: its keys and what ``f`` makes of its voxels."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | f(pdf)])

    types = dict(v.dtypes)
    return v.groupBy(*keys).applyInPandas(work, ", ".join([f"{k} {types[k]}" for k in keys] + [schema]))


def fit_spheres(v: DataFrame, size: Size = (1, 1, 1), factor: float = 1.0, planar: bool = False) -> DataFrame:
    """Centre and radius of the largest ball in each object (first on ties).

    ``planar`` takes the distance within slices.
    """

    def f(pdf):
        m, lo = dense(pdf)
        d = np.stack([distance_transform(s[None], size)[0] for s in m]) if planar else distance_transform(m, size)
        at = np.array(np.unravel_index(int(d.argmax()), d.shape)) + lo
        return {"z": int(at[0]), "y": int(at[1]), "x": int(at[2]), "radius": float(d.max()) * factor}

    return per_object(v, "z int, y int, x int, radius double", f)


def thickness(v: DataFrame, size: Size = (1, 1, 1)) -> DataFrame:
    """Twice the mean distance to the surface over its local maxima."""

    def f(pdf):
        m, _ = dense(pdf)
        d = distance_transform(m, size)
        return {"thickness": float(2 * d[local_maxima(d, m)].mean())}

    return per_object(v, "thickness double", f)


def anisotropy(v: DataFrame, size: Size = (1, 1, 1)) -> DataFrame:
    """Largest over smallest eigenvalue of each object's gradient tensor."""

    def f(pdf):
        e = gradient_tensor(dense(pdf, 2)[0], size)
        return {"anisotropy": float(e[-1] / (e[0] + 1e-10))}

    return per_object(v, "anisotropy double", f)


def axes(v: DataFrame, size: Size = (1, 1, 1)) -> DataFrame:
    """Full axis lengths of the ellipsoid with each object's second moments.

    Spark sums the moments; only one row an object goes to numpy.
    """
    at = {c: F.col(c).cast("double") * float(s) for c, s in zip("zyx", size, strict=True)}
    m = v.groupBy("tomo", "label").agg(*[F.covar_pop(at[c], at[d]).alias(f"_{c}{d}") for c, d in ("zz", "zy", "zx", "yy", "yx", "xx")])

    def work(batches):
        for pdf in batches:
            zz, zy, zx, yy, yx, xx = (pdf[c].to_numpy(float) for c in ("_zz", "_zy", "_zx", "_yy", "_yx", "_xx"))
            cov = np.stack([zz, zy, zx, zy, yy, yx, zx, yx, xx], 1).reshape(-1, 3, 3)
            e = np.linalg.eigvalsh(cov + np.diag(np.array(size) ** 2 / 12))
            yield pdf[["tomo", "label"]].assign(major=4 * np.sqrt(e[:, 2]), minor=4 * np.sqrt(e[:, 0]))

    types = dict(v.dtypes)
    return m.mapInPandas(work, f"tomo {types['tomo']}, label {types['label']}, major double, minor double")


def voxels_of(a: np.ndarray, lo: np.ndarray, name: str = "label") -> pd.DataFrame:
    p = np.argwhere(a)
    return pd.DataFrame({"z": p[:, 0] + lo[0], "y": p[:, 1] + lo[1], "x": p[:, 2] + lo[2], name: a[tuple(p.T)]}).astype({"z": "int32", "y": "int32", "x": "int32"})


def close_holes(v: DataFrame, max_size: int) -> DataFrame:
    """Objects with their holes under ``max_size`` voxels filled."""

    def work(pdf):
        m, lo = dense(pdf)
        return voxels_of(fill_holes(m, max_size).astype(np.int64) * int(pdf["label"].iloc[0]), lo).assign(tomo=pdf["tomo"].iloc[0])[["tomo", "z", "y", "x", "label"]]

    return v.groupBy("tomo", "label").applyInPandas(work, "tomo string, z int, y int, x int, label long")


def skeletons(v: DataFrame, min_size: int = 10, prune: bool = True) -> DataFrame:
    """Skeleton of each object per slice, each piece cut down to its longest path; pieces under ``min_size`` go."""

    def work(pdf):
        m, lo = dense(pdf)
        s = thin(m[1])
        s = longest_path(s) if prune else s
        keep = long_pieces(s, min_size)[None]
        return voxels_of(keep.astype(np.int64) * int(pdf["label"].iloc[0]), lo + np.array([1, 0, 0])).assign(tomo=pdf["tomo"].iloc[0])[["tomo", "z", "y", "x", "label"]]

    return v.groupBy("tomo", "label", "z").applyInPandas(work, "tomo string, z int, y int, x int, label long")


def geodesic_distance(mask: DataFrame, start: DataFrame, size: Size = (1, 1, 1), block: tuple[int, int, int] = (32, 32, 32)) -> DataFrame:
    """Path length inside the mask from the start voxels; unreachable ones are left out.

    Each round lengthens paths inside blocks with a halo of one voxel, starting
    from the lengths of the round before; it is written, and the last round is
    the one that shortens none. A task holds one block, whatever the tomogram.
    """
    pos = ["tomo", "z", "y", "x"]
    where = [F.col("tomo"), *[F.col(c).cast("int").alias(c) for c in "zyx"]]
    first = start.select(*where).distinct().withColumn("distance", F.lit(0.0))
    state = stage(mask.select(*where).distinct().join(first, pos, "left"), "geodesic")

    def relax(pdf):
        m, lo = dense(pdf)
        known, at = np.full(m.shape, np.inf), tuple((pdf[["z", "y", "x"]].to_numpy(np.int64) - lo).T)
        known[at] = pdf["distance"].fillna(np.inf)
        d = geodesic(m, known, size)[at]
        return pdf.assign(distance=np.where(np.isfinite(d), d, np.nan), moved=d < known[at])

    while True:
        made = stage(blockwise(state, block, (1, 1, 1), relax, "tomo string, z int, y int, x int, distance double, moved boolean"), "geodesic")
        state = made.drop("moved")
        if made.where("moved").isEmpty():
            return state.where("distance is not null")


def blockwise(v: DataFrame, block: tuple[int, int, int], halo: tuple[int, int, int], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs ``f`` on blocks with a halo and keeps what it returns inside each block.

    Every voxel goes to all blocks whose halo holds it; ``f`` gets the rows of one
    block and returns rows with z, y, x.
    """
    out = v
    for c, b, h in zip("zyx", block, halo, strict=True):
        out = out.withColumn(f"b{c}", F.explode(F.sequence(F.floor((F.col(c) - h) / b), F.floor((F.col(c) + h) / b))))

    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        made = f(pdf.drop(columns=["bz", "by", "bx"]))
        for c, b, k in zip("zyx", block, key[1:], strict=True):
            made = made[(made[c] >= k * b) & (made[c] < (k + 1) * b)]
        return made

    return out.groupBy("tomo", "bz", "by", "bx").applyInPandas(work, schema)
