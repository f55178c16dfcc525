"""Compartments: regions of slices between membranes, joined over z.

Slices are divided by a watershed; regions of neighbouring slices that overlap
become a weighted graph, and rounds of contraction on a written edge table
partition it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.operators import components as C
from voxelgrain.operators import volume as V
from voxelgrain.operators.blocks import BLOCK
from voxelgrain.operators.kernels import dense, label, voxels_of
from voxelgrain.operators.watershed import watershed
from voxelgrain.plans.segmentation import distances
from voxelgrain.storage import stage

#: Added to the label of small seeds, which only hold ground for themselves.
SMALL = 1 << 40
RING = [(0, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def _tops(v: DataFrame) -> DataFrame:
    """(tomo, z, y, x, value, _top): whether no voxel around it in its slice is higher.

    A voxel goes to its own block of ``BLOCK`` voxels an edge and to those that it
    touches, so that no neighbour is a row of a shuffle. A voxel without a value
    counts for none around it and is a top itself.
    """
    dealt = v.select(*V.POS, F.col("value").cast("double").alias("value")).dropna(subset=V.POS).withColumn("_bz", F.floor(F.col("z") / BLOCK))
    for c in "yx":
        dealt = dealt.withColumn(f"_b{c}", F.explode(F.sequence(F.floor((F.col(c) - 1) / BLOCK), F.floor((F.col(c) + 1) / BLOCK))))
    types = dict(v.dtypes)

    def work(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        at = np.stack([t[c].to_numpy().astype(np.int64) for c in "zyx"])
        mine = np.all([at[k] // BLOCK == t[f"_b{c}"][0].as_py() for k, c in enumerate("zyx")], axis=0)
        low = at - at.min(1, keepdims=True) + 1
        wide = low.max(1) + 2
        p = (low[0] * wide[1] + low[1]) * wide[2] + low[2]
        none = np.isnan(t["value"].fill_null(0.0).to_numpy())  # above all numbers, as in Spark
        value = np.where(none, np.inf, t["value"].fill_null(-np.inf).to_numpy())
        node, back = np.unique(p, return_inverse=True)
        most = np.full(len(node), -np.inf)
        np.maximum.at(most, back, value)
        near = np.full(len(node), -np.inf)
        for _, dy, dx in RING:
            to = node + dy * wide[2] + dx
            i = np.minimum(np.searchsorted(node, to), len(node) - 1)
            near = np.maximum(near, np.where(node[i] == to, most[i], -np.inf))
        top = (near[back] <= value) | t["value"].is_null().to_numpy(zero_copy_only=False)
        return t.select([*V.POS, "value"]).append_column("_top", pa.array(top)).filter(pa.array(mine))

    return dealt.groupBy("tomo", "_bz", "_by", "_bx").applyInArrow(work, f"{', '.join(f'{c} {types[c]}' for c in V.POS)}, value double, _top boolean")


def plateau_maxima(v: DataFrame) -> DataFrame:
    """(tomo, z, y, x, label): in-slice maxima of ``value``, one label a plateau.

    A plateau is a set of equal values that touch, corners included; it is a
    maximum if no voxel next to it is higher. Labels number the plateaus.
    """
    marked = stage(_tops(v), "plateau-tops")
    # equal values share a number: the components of one are its plateaus
    flat = stage(C.components(marked.select(*V.POS, F.col("value").alias("label")), 3, per_label=True, planar=True).join(marked.select(*V.POS, "_top"), V.POS), "plateaus")
    good = flat.groupBy("tomo", "component").agg(F.min(F.col("_top").cast("int")).alias("_all")).where("_all = 1")
    return flat.join(good, ["tomo", "component"], "left_semi").select(*V.POS, F.col("component").alias("label"))


def _smooth_region(max_hole: int, iterations: int):
    """Fills small holes of a region of a slice and closes it, inside its bounding box."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        m, lo = dense(pdf, 0)
        back = label(~m)
        n = np.bincount(back.ravel())
        m = m | np.isin(back, np.flatnonzero(n < max_hole)[np.flatnonzero(n < max_hole) > 0])

        def step(a, grow):
            p = np.pad(a[0], 1)
            parts = [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]
            return (np.logical_or if grow else np.logical_and).reduce(parts)[None]

        closed = m
        for grow in (True, False):
            for _ in range(iterations):
                closed = step(closed, grow)
        out = voxels_of((m | closed).astype(np.int64) * int(pdf["label"].iloc[0]), lo)
        return out.assign(tomo=pdf["tomo"].iloc[0])[["tomo", "z", "y", "x", "label"]]

    return work


def segment_slices(boundaries: DataFrame, limit: float = 0.4, far: float = 30.0, min_seed: int = 50, max_hole: int = 500, iterations: int = 4, context: bool = True) -> DataFrame:
    """(tomo, z, y, x, label): compartments of every slice, labels unique in a volume.

    ``boundaries`` is a dense table (tomo, z, y, x, value) of membrane
    probabilities. Large seeds are the parts of a slice farther than ``far`` from
    all values of ``limit`` and over, of ``min_seed`` voxels at least; with
    ``context`` that distance is the one in the volume. Small seeds are the maxima
    of the distance in the slice that meet no large seed. A watershed over value
    + 1 - distance / largest distance of the slice gives each its region; those
    of large seeds are kept, their holes under ``max_hole`` voxels filled, and
    closed within their box. Where two then meet the larger label wins. Slices
    of volumes without any boundary have no distances and no compartments; rows
    with a null value are left out.
    """
    b = stage(boundaries.select(*V.POS, F.col("value").cast("double").alias("value")).dropna(), "compartments-values")
    inside, walls = b.where(F.col("value") < limit), b.where(F.col("value") >= limit)
    flat = distances(inside, walls, planar=True).select(*V.POS, F.col("distance").alias("flat"))
    deep = distances(inside, walls).select(*V.POS, F.col("distance").alias("deep")) if context else flat.withColumnRenamed("flat", "deep")
    d = b.join(deep, V.POS, "left").join(flat, V.POS, "left")
    d = stage(d.withColumns({"deep": F.when(F.col("value") >= limit, 0.0).otherwise(F.col("deep")), "flat": F.when(F.col("value") >= limit, 0.0).otherwise(F.col("flat"))}), "compartments-distances")
    large = C.components(d.where(F.col("deep") > far), 3, planar=True).select(*V.POS, F.col("component").alias("label"))
    large = stage(V.size_filter(large, min_seed), "compartments-large")
    small = plateau_maxima(d.where("flat is not null").select(*V.POS, F.col("flat").alias("value")))
    met = small.join(large.select(*V.POS), V.POS, "left_semi").select("tomo", "label").distinct()
    small = small.join(met, ["tomo", "label"], "left_anti").select(*V.POS, (F.col("label") + SMALL).alias("label"))
    top = d.groupBy("tomo", "z").agg(F.max("deep").alias("_top"))
    height = d.where("deep is not null").join(top, ["tomo", "z"]).select(*V.POS, (F.col("value") + F.coalesce(F.try_divide(F.col("_top") - F.col("deep"), F.col("_top")), F.lit(0.0))).alias("height"))
    parts = watershed(height, large.unionByName(small), planar=True).where(F.col("label") < SMALL)
    grown = parts.groupBy("tomo", "z", "label").applyInPandas(_smooth_region(max_hole, iterations), "tomo string, z int, y int, x int, label long")
    return stage(grown.groupBy(*V.POS).agg(F.max("label").alias("label")), "compartments-slices")


def slice_overlaps(v: DataFrame) -> DataFrame:
    """(tomo, a, b, share): regions of slices z and z + 1 that overlap; share of a's voxels in b."""
    size = v.groupBy("tomo", F.col("label").alias("a")).agg(F.count(F.lit(1)).alias("_n"))
    a, b = v.select(*V.POS, F.col("label").alias("a")), v.select("tomo", (F.col("z") - 1).alias("z"), "y", "x", F.col("label").alias("b"))
    both = a.join(b, V.POS).where("a <> b").groupBy("tomo", "a", "b").agg(F.count(F.lit(1)).alias("_m"))
    return both.join(size, ["tomo", "a"]).select("tomo", "a", "b", (F.col("_m") / F.col("_n")).alias("share"))


def edge_costs(shares: DataFrame, beta: float = 0.5) -> DataFrame:
    """(tomo, a, b, w): log odds of a share, clipped at 0.001, shifted by ``beta``; over 0 joins."""
    p = F.greatest(F.lit(0.001), F.least(F.lit(0.999), 1 - F.col("share")))
    return shares.select("tomo", "a", "b", (F.log((1 - p) / p) + float(np.log((1 - beta) / beta))).alias("w"))


def partition(edges: DataFrame) -> DataFrame:
    """(tomo, node, part) for weighted edges (tomo, a, b, w): rounds of contraction.

    Weights over 0 attract, others repel; those of one pair count together. In
    each round every node names its best edge (ties: smaller nodes) and pairs
    that name each other and attract become one, their edges added up, until no
    edge attracts. The best edge of all is always named by both, so that every
    round joins something. A part is named by its least node.
    """
    total = lambda e: e.where("a <> b").groupBy("tomo", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))
    left = stage(total(edges), "partition-edges")
    names = stage(edges.select("tomo", F.col("a").alias("node")).union(edges.select("tomo", "b")).distinct().withColumn("part", F.col("node")), "partition-names")
    while True:
        good = left.where("w > 0").select("tomo", "a", "b", F.struct("w", (-F.col("a")).alias("p"), (-F.col("b")).alias("q")).alias("k"))
        best = good.select("tomo", F.col("a").alias("n"), "k").union(good.select("tomo", "b", "k")).groupBy("tomo", "n").agg(F.max("k").alias("k"))
        pairs = stage(best.groupBy("tomo", "k").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select("tomo", (-F.col("k.p")).alias("_to"), (-F.col("k.q")).alias("_from")), "partition-pairs")
        if pairs.isEmpty():
            return names
        moved = lambda t, c: t.join(pairs.withColumnRenamed("_from", c), ["tomo", c], "left").withColumn(c, F.coalesce("_to", F.col(c))).drop("_to")
        left = stage(total(moved(moved(left, "a"), "b")), "partition-edges")
        names = stage(moved(names, "part"), "partition-names")


def merge_slices(v: DataFrame, beta: float = 0.5, min_extent: int = 10) -> DataFrame:
    """Regions of slices joined over z; joined ones of fewer than ``min_extent`` slices go (0: none)."""
    parts = partition(edge_costs(slice_overlaps(v), beta))
    out = v.join(parts.select("tomo", F.col("node").alias("label"), "part"), ["tomo", "label"], "left").select(*V.POS, F.coalesce("part", F.col("label")).alias("label"))
    return V.z_extent_filter(out, min_extent) if min_extent else out


def segment_compartments(boundaries: DataFrame, depth: int, exclude: int = 0, min_extent: int = 10, **options) -> DataFrame:
    """Compartments of volumes: slices segmented, without ``exclude`` at both ends of z, then joined."""
    slices = segment_slices(boundaries, **options)
    inside = slices.where(F.col("z").between(exclude, depth - exclude - 1))
    return V.relabel_sequential(merge_slices(inside, min_extent=min_extent))
