"""Edge, ridge and orientation filters of images, as passes over lines and column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgrain.operators import lines as L
from voxelgrain.operators import volume as V
from voxelgrain.operators.components import largest_component

FILTERS = ("sobel", "laplace", "ggm", "structure-tensor", "sato")
#: Widths of the ridges that the ridge filter looks for.
RIDGES = (1.0, 3.0, 5.0, 7.0, 9.0)
#: Rows of a slice in which the ridge filter's derivatives are made in one task.
BAND = 64


def eigenvalues_2d(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Of [[a, b], [b, c]], the larger first."""
    mid, r = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b)
    return mid + r, mid - r


def eigenvalues_3d(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Of a symmetric 3 x 3 matrix, falling, by the cosine form of its cubic."""
    q = (xx + yy + zz) / 3
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    det = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(1.0))))) / 3
    first, last = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return first, 3 * q - first - last, last


def _norm(names: list[str]) -> Column:
    return F.sqrt(sum((F.col(n) * F.col(n) for n in names[1:]), F.col(names[0]) * F.col(names[0])))


def _orders(planar: bool, order: int) -> dict[str, tuple[int, int, int]]:
    return {f"d{a}": tuple(order * int(k == n) for k in range(3)) for n, a in enumerate("zyx") if not (planar and a == "z")}


def gradient_magnitude(image: DataFrame, sigma: float, planar: bool = True) -> DataFrame:
    """(tomo, z, y, x, value): length of the Gaussian gradient."""
    orders = _orders(planar, 1)
    return L.derivatives(image, sigma, orders, planar).select(*V.POS, _norm([*orders]).alias("value"))


def laplacian(image: DataFrame, sigma: float, planar: bool = True) -> DataFrame:
    """Sum of the second Gaussian derivatives."""
    orders = _orders(planar, 2)
    return L.derivatives(image, sigma, orders, planar).select(*V.POS, sum((F.col(n) for n in [*orders][1:]), F.col([*orders][0])).alias("value"))


def sobel(image: DataFrame, sigma: float, planar: bool = True) -> DataFrame:
    """Sobel gradient of the smoothed image: root mean square over the axes."""
    flat, slope = np.array([1, 2, 1]) / 4, np.array([-1, 0, 1]) / 2
    out, axes = L.smooth(image, sigma, planar).select(*V.POS, "value"), "yx" if planar else "zyx"
    have = {"": "value"}
    for axis in axes:
        # one slope at most along the way; a name holds the axis that has it
        made = {}
        for of, column in have.items():
            made[f"s{of}"] = (column, flat)
            if not of:
                made[f"s{axis}"] = (column, slope)
        made["s"] = (have[""], flat)
        out = L.line_filter(out, axis, made, keep=[])
        have = {k[1:]: k for k in made}
    names = [f"s{a}" for a in axes]
    return out.select(*V.POS, (_norm(names) / math.sqrt(len(names))).alias("value"))


def structure_tensor(image: DataFrame, inner: float, outer: float, planar: bool = True) -> DataFrame:
    """(tomo, z, y, x, tensor products, eigenvalues e1 >= e2 [>= e3]).

    Gaussian gradients at ``inner``, their products smoothed at ``outer``.
    """
    orders = _orders(planar, 1)
    g = L.derivatives(image, inner, orders, planar)
    axes = "yx" if planar else "zyx"
    pairs = [(a, b) for k, a in enumerate(axes) for b in axes[k:]]
    names = tuple(f"t{a}{b}" for a, b in pairs)
    t = g.select(*V.POS, *[(F.col(f"d{a}") * F.col(f"d{b}")).alias(n) for (a, b), n in zip(pairs, names, strict=True)])
    t = L.smooth(t, outer, planar, names)
    c = {n: F.col(n) for n in names}
    e = eigenvalues_2d(c["tyy"], c["tyx"], c["txx"]) if planar else eigenvalues_3d(c["txx"], c["tyy"], c["tzz"], c["tyx"], c["tzx"], c["tzy"])
    return t.select(*V.POS, *names, *[x.alias(f"e{k}") for k, x in enumerate(e, 1)])


def ridges(image: DataFrame, sigmas: tuple[float, ...] = RIDGES, dark: bool = True) -> DataFrame:
    """(tomo, z, y, x, value): how much of a dark (or bright) line in its slice a voxel is on.

    The larger eigenvalue of the Hessian, times the square of the scale, the
    largest over all scales and at least 0. Lines along y are cut into bands of
    ``BAND`` rows with what the widest filter sees around them; a task takes bands
    whole and makes all scales of them, so that no derivative is shuffled.
    """
    taps = [[L.gaussian_taps(s, o) for o in range(3)] for s in sigmas]
    reach = max(len(t[0]) // 2 for t in taps)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (tomo, z, x, _band, v, on): a line's values in and around a band, mirrored, and which are there."""
        for f, number in L.whole_lines(frames, ["tomo", "z", "x"]):
            pos, value = f["y"].to_numpy(np.int64), f["value"].to_numpy(np.float64)
            top = np.flatnonzero(np.diff(number, prepend=-1))
            rows = {"_row": [], "_band": [], "v": [], "on": []}
            for a, z in zip(top, np.append(top[1:], len(pos)), strict=True):
                lo, n = pos[a], pos[z - 1] - pos[a] + 1
                line, there = np.zeros(n), np.zeros(n, bool)
                line[pos[a:z] - lo], there[pos[a:z] - lo] = value[a:z], True
                for k in np.unique(pos[a:z] // BAND).tolist():
                    at = np.arange(k * BAND - reach, (k + 1) * BAND + reach) - lo
                    seen, core = at % (2 * n), at[reach : reach + BAND]
                    rows["_row"].append(a)
                    rows["_band"].append(k)
                    rows["v"].append(line[np.where(seen < n, seen, 2 * n - 1 - seen)])
                    rows["on"].append(((core >= 0) & (core < n) & there[np.clip(core, 0, n - 1)]).tobytes())
            yield f.iloc[rows.pop("_row")][["tomo", "z", "x"]].reset_index(drop=True).assign(**rows)

    def filtered(a: np.ndarray, t: np.ndarray, start: int, n: int) -> np.ndarray:
        return sum(w * a[:, start + k : start + k + n] for k, w in enumerate(t))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, number in L.whole_lines(frames, ["tomo", "z", "_band"]):
            for g in np.split(np.arange(len(f)), np.flatnonzero(np.diff(number)) + 1):
                x, v = f["x"].to_numpy(np.int64)[g], np.stack(f["v"].to_numpy()[g])
                on = np.frombuffer(b"".join(f["on"].to_numpy()[g]), bool).reshape(len(g), BAND)
                used = np.flatnonzero(on.any(0))
                first, last = x[on[:, used].argmax(0)], x[len(g) - 1 - on[::-1, used].argmax(0)]
                best = np.zeros(on.shape)
                for lo, hi in sorted(set(zip(first.tolist(), last.tolist(), strict=True))):  # rows of one extent make a matrix
                    rows = used[(first == lo) & (last == hi)]
                    mine, n = np.flatnonzero((x >= lo) & (x <= hi)), hi - lo + 1
                    for s, t in zip(sigmas, taps, strict=True):
                        r = len(t[0]) // 2
                        h = []
                        for o in (2, 1, 0):
                            a = np.zeros((len(rows), n))
                            a[:, x[mine] - lo] = np.where(on[mine], filtered(v[mine], t[o], reach - r, BAND), 0.0)[:, rows].T
                            h.append(filtered(np.pad(a, ((0, 0), (r, r)), "symmetric"), t[2 - o], 0, n)[:, x[mine] - lo].T)
                        mid, root = (h[0] + h[2]) / 2, np.sqrt((h[0] - h[2]) * (h[0] - h[2]) / 4 + h[1] * h[1])
                        at = np.ix_(mine, rows)
                        best[at] = np.maximum(best[at], (mid + root if dark else root - mid) * s * s)
                i, j = np.nonzero(on)
                yield pd.DataFrame({"tomo": f["tomo"].iloc[g[0]], "z": f["z"].iloc[g[0]], "y": (f["_band"].iloc[g[0]] * BAND + j).astype(np.int32), "x": x[i].astype(np.int32), "value": best[i, j]})

    src = image.select("tomo", *[F.col(c).cast("int").alias(c) for c in "zyx"], F.col("value").cast("double").alias("value"))
    lines = src.repartition("tomo", "z", "x").sortWithinPartitions("tomo", "z", "x", "y")
    bands = lines.mapInPandas(cut, "tomo string, z int, x int, _band long, v array<double>, on binary")
    bands = bands.repartition("tomo", "z", "_band").sortWithinPartitions("tomo", "z", "_band", "x")
    return bands.mapInPandas(make, "tomo string, z int, y int, x int, value double")


def ridge_map(image: DataFrame, sigma: float, sigmas: tuple[float, ...] = RIDGES, dark: bool = True) -> DataFrame:
    """Ridges smoothed and stretched to 0..1 in every slice; a flat slice is 0."""
    s = L.smooth(ridges(image, sigmas, dark), sigma, planar=True).select(*V.POS, "value")
    ends = s.groupBy("tomo", "z").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return s.join(ends, ["tomo", "z"]).select(*V.POS, F.coalesce(F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)).alias("value"))


def edge_filter(image: DataFrame, sigma: float, method: str = "sato", planar: bool = True) -> DataFrame:
    """(tomo, z, y, x, value): the edges of an image (tomo, z, y, x, value).

    ``structure-tensor`` gives its larger eigenvalue at scales ``sigma`` and half
    of it. ``sato`` works in slices alone and leaves out local levelling. Lines
    of an image are mirrored at their ends; absent voxels between are 0.
    """
    if method not in FILTERS:
        raise ValueError(f"unknown filter {method}; there are {FILTERS}")
    if method == "structure-tensor":
        return structure_tensor(image, sigma, sigma / 2, planar).select(*V.POS, F.col("e1").alias("value"))
    if method == "sato":
        if not planar:
            raise NotImplementedError("the ridge filter works in slices")
        return ridge_map(image, sigma)
    return {"sobel": sobel, "laplace": laplacian, "ggm": gradient_magnitude}[method](image, sigma, planar)


def ridge_zone(image: DataFrame, zone: DataFrame, objects: DataFrame, sigma: float, limit: float = 0.5, iterations: int = 2) -> DataFrame:
    """Part of a zone on a ridge and free of objects: its largest component, closed."""
    on = ridge_map(image, sigma).where(F.col("value") > limit)
    free = V.in_mask(V.in_mask(on.select(*V.POS), zone), objects, inside=False)
    top = largest_component(free).withColumn("label", F.lit(1).cast("long"))
    return V.closing(top, iterations=iterations)


def orientation(v: DataFrame, inner: float, outer: float) -> DataFrame:
    """(tomo, label, anisotropy, e1, e2, e3) of objects: structure tensor of their own mask, averaged.

    The tensor of each object in its padded bounding box, mean over its voxels;
    anisotropy is the largest over the smallest eigenvalue (+ 1e-10).
    """
    pad = int(4 * (inner + outer) + 0.5) + 1
    box = v.groupBy("tomo", "label").agg(*[f(c).alias(f"{n}_{c}") for c in "zyx" for n, f in (("lo", F.min), ("hi", F.max))])
    grid = box
    for c in "zyx":
        grid = grid.withColumn(c, F.explode(F.sequence(F.col(f"lo_{c}") - pad, F.col(f"hi_{c}") + pad)))
    own = F.concat_ws("/", "tomo", "label").alias("tomo")
    inside = v.select(*V.POS, "label", F.lit(1.0).alias("_in"))
    image = grid.select(*V.POS, "label").join(inside, [*V.POS, "label"], "left").select(own, "z", "y", "x", F.coalesce("_in", F.lit(0.0)).alias("value"), F.col("tomo").alias("_tomo"), "label")
    t = structure_tensor(image.select(*V.POS, "value"), inner, outer, planar=False)
    names = ["tzz", "tzy", "tzx", "tyy", "tyx", "txx"]
    mean = t.join(image.where("value > 0").select(*V.POS, "_tomo", "label"), V.POS).groupBy(F.col("_tomo").alias("tomo"), "label").agg(*[F.avg(n).alias(n) for n in names])
    c = {n: F.col(n) for n in names}
    e = eigenvalues_3d(c["txx"], c["tyy"], c["tzz"], c["tyx"], c["tzx"], c["tzy"])
    return mean.select("tomo", "label", *[x.alias(f"e{k}") for k, x in enumerate(e, 1)]).withColumn("anisotropy", F.col("e1") / (F.greatest(F.col("e3"), F.lit(0.0)) + 1e-10))
