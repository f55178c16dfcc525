"""Analyses composed of the operators: selection, evaluation, statistics, pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.operators import components as C
from voxelgrain.operators import distance as D
from voxelgrain.operators import relational as R
from voxelgrain.operators import volume as V
from voxelgrain.operators.lines import distance_field
from voxelgrain.plans.segmentation import distances

#: Distances in nm below which an object belongs to a pool; later pools win.
RA_V, MP_V, DOCKED_PD, DOCKED_MEMBRANE = 80.0, 50.0, 100.0, 2.0


def assign_vesicle_pools(measures: DataFrame) -> DataFrame:
    """RA-V by ribbon distance, MP-V by ribbon and membrane, Docked-V by density and membrane."""
    near = F.col("ribbon_distance") < RA_V
    member = F.col("boundary_distance") < MP_V
    return R.assign_pools(measures, [("RA-V", near), ("MP-V", near & member), ("Docked-V", (F.col("pd_distance") < DOCKED_PD) & (F.col("boundary_distance") < DOCKED_MEMBRANE))])


def select_structures(parts: DataFrame, vesicles: DataFrame, max_distance: float, n: int, exclude: int = 0, depth: int | None = None, connectivity: int = 3) -> DataFrame:
    """The n parts nearest to most vesicles, relabelled 1..n by their count.

    Parts are connected components of the slab; tomograms in which no vesicle is
    near keep all their parts.
    """
    inside = V.slab(parts, exclude, depth) if exclude and depth else parts
    c = C.components(inside, connectivity).withColumnRenamed("component", "label")
    top = D.top_structures(D.nearest_structure(vesicles, c), max_distance, n)
    chosen = c.join(top.select("tomo", F.col("structure_label").alias("label"), "rank"), ["tomo", "label"]).select(*V.POS, F.col("rank").cast("long").alias("label"))
    return chosen.unionByName(c.join(top.select("tomo").distinct(), "tomo", "left_anti").select(*V.POS, "label"))


def select_densities(densities: DataFrame, ribbons: DataFrame, n: int = 1, connectivity: int = 3) -> DataFrame:
    """The n densities nearest to each ribbon."""
    c = C.components(densities, connectivity).withColumnRenamed("component", "label")
    near = D.top_n_per_structure(D.nearest_structure(c, ribbons), n)
    return c.join(near.select("tomo", "label").distinct().hint("merge"), ["tomo", "label"], "left_semi").select(*V.POS, "label")


def membrane_near(membrane: DataFrame, reference: DataFrame, radius: float, n: int = 1, connectivity: int = 3) -> DataFrame:
    """The n largest membrane fragments nearer than ``radius``; where none is, of all."""
    c = C.components(membrane, connectivity).withColumnRenamed("component", "label")
    sizes = V.label_sizes(c).join(D.nearest_structure(c, reference).select("tomo", "label", "distance"), ["tomo", "label"], "left")
    sizes = sizes.withColumn("far", (~F.coalesce(F.col("distance") < radius, F.lit(False))).cast("int"))
    first = sizes.groupBy("tomo").agg(F.min("far").alias("far"))
    top = R.top_n(sizes.join(first, ["tomo", "far"]), ["tomo"], n, F.desc("size"), "label")
    return c.join(top.select("tomo", "label"), ["tomo", "label"], "left_semi").select(*V.POS)


def evaluate(seg: DataFrame, gt: DataFrame, min_seg: int = 0, min_gt: int = 0, iterations: int = 0, criterion: str = "iou", limit: float = 0.5, shape: tuple | None = None, mutual: bool = False) -> DataFrame:
    """(tomo, tp, fp, fn, dice) of the components of two foregrounds; see ``matching``."""
    a = C.components_filtered(seg, min_seg)
    b = C.components_filtered(gt, min_gt)
    if iterations:
        a = V.closing(V.dilate(a, iterations=iterations, shape=shape), iterations=iterations, shape=shape)
    return V.matching(a, b, limit, criterion, mutual).join(V.dice(a, b), "tomo", "left")


def thin_zone(zone: DataFrame, mask: DataFrame, distance: float = 6.0, iterations: int = 2) -> DataFrame:
    """Zone voxels within ``distance`` of the mask in their slice, closed."""
    near = distances(zone.select(*V.POS), mask, planar=True).where(F.col("distance") <= distance)
    kept = near.select(*V.POS, F.lit(1).cast("long").alias("label"))
    return V.closing(kept, V.SQUARE_2D, iterations)


def merge_zones(prediction: DataFrame, wide: DataFrame, thin: DataFrame, iterations: int = 2) -> DataFrame:
    """(prediction and closed wide) or thin, closed."""
    one = lambda v: v.select(*V.POS).distinct().withColumn("label", F.lit(1).cast("long"))
    both = V.in_mask(one(prediction), V.closing(one(wide), iterations=iterations))
    return V.closing(V.overlay(both, one(thin)), iterations=iterations)


def inside_fraction(outer: DataFrame, inner: DataFrame, voxel_volume: float = 1.0) -> DataFrame:
    """Volume of each outer object and of the inner voxels in it, and their ratio."""
    n = V.label_sizes(outer)
    m = V.in_mask(outer, inner).groupBy("tomo", "label").agg(F.count(F.lit(1)).alias("inner"))
    out = n.join(m, ["tomo", "label"], "left").withColumn("inner", F.coalesce("inner", F.lit(0)))
    return out.select("tomo", "label", (F.col("size") * voxel_volume).alias("volume"), (F.col("inner") * voxel_volume).alias("inner_volume"), F.try_divide("inner", "size").alias("fraction"))


def proximity(inner: DataFrame, membrane: DataFrame, size: tuple = (1.0, 1.0, 1.0)) -> DataFrame:
    """Minimum, median and maximum distance of each object's voxels to the membrane."""
    each = distance_field(inner.select(*V.POS), membrane, size).select(*V.POS, "distance")
    d = inner.select(*V.POS, F.col("label").alias("object")).join(each, V.POS)
    return d.groupBy("tomo", F.col("object").alias("label")).agg(F.min("distance").alias("min"), F.percentile("distance", 0.5).alias("median"), F.max("distance").alias("max"))


def density(counts: DataFrame, areas: DataFrame, key: list[str]) -> DataFrame:
    """Objects per surface: ``n`` over ``area``."""
    return counts.join(areas, key).withColumn("density", F.try_divide("n", "area"))
