"""Instances from predictions: seeds, distances, watershed; radii on the same distances.

Predictions are dense tables (tomo, z, y, x, foreground, border) with values from
0 to 1. Every step is a join, a pass over lines or a written round, so that no
task holds a volume, a slice or an object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.operators import components as C
from voxelgrain.operators import volume as V
from voxelgrain.operators.lines import Size, distance_field
from voxelgrain.operators.watershed import watershed
from voxelgrain.storage import stage

UNIT: Size = (1.0, 1.0, 1.0)



def distances(domain: DataFrame, features: DataFrame, size: Size = UNIT, planar: bool = False) -> DataFrame:
    """(tomo, z, y, x, distance, near_z, near_y, near_x) in the volume or within slices."""
    if not planar:
        return distance_field(domain, features, size)
    slices = lambda v: v.select("tomo", F.col("z").alias("_slice"), *"zyx")
    return distance_field(slices(domain), slices(features), size, ("tomo", "_slice"), planar=True).drop("_slice")


def flood_from(seeds: DataFrame, mask: DataFrame, min_size: int = 0, planar: bool = False) -> DataFrame:
    """Seeds (tomo, z, y, x, label) grown over the mask, each voxel from its nearest seed's side.

    The height is the distance to the seeds; objects under ``min_size`` go.
    """
    height = stage(distances(mask, seeds, planar=planar).withColumnRenamed("distance", "height"), "flood-height")
    return V.size_filter(watershed(height, seeds, planar), min_size)


def _seeds(v: DataFrame, planar: bool) -> DataFrame:
    """Components over faces, numbered from 1 in every volume."""
    return stage(C.components(v, 1, planar=planar).select(*V.POS, F.col("component").alias("label")), "seeds")


def segment(prediction: DataFrame, seed_limit: float = 0.5, min_size: int = 0, distance_seeds: float | None = None, border_limit: float = 0.5, planar: bool = False) -> DataFrame:
    """Instances (tomo, z, y, x, label) of a foreground and border prediction.

    Seeds are the components in which foreground - border is over ``seed_limit``
    or, with ``distance_seeds``, those of the foreground (0.5 at least) farther
    than that from all voxels whose border is at least ``border_limit``. Where a
    volume has no such border, nothing is near one and the whole foreground
    seeds. A watershed over the distance to the seeds fills the mask, foreground
    + border over 0.5. ``planar`` works slice by slice. Rows with a null value
    are background.
    """
    p = prediction.where("foreground is not null and border is not null")
    mask = p.where("foreground + border > 0.5")
    if distance_seeds is None:
        core = p.where(F.col("foreground") - F.col("border") > seed_limit)
    else:
        inside = p.where((F.col("border") < border_limit) & (F.col("foreground") >= 0.5))
        far = distances(inside, p.where(F.col("border") >= border_limit), planar=planar)
        core = inside.join(far.select(*V.POS, "distance"), V.POS, "left").where(F.coalesce("distance", F.lit(float("inf"))) > distance_seeds)
    return flood_from(_seeds(core, planar), mask, min_size, planar)


def segment_with_borders(prediction: DataFrame, shape: tuple[int, int, int], exclude_border: bool = False, exclude_partial: int = 0, mask: DataFrame | None = None, **options) -> DataFrame:
    """``segment`` inside a mask, without objects at the ends of z, relabelled 1..n.

    ``exclude_border`` drops objects that touch the first or last slice. Where it
    is off, ``exclude_partial`` drops those whose largest slice is nearer than so
    many slices to one of their ends: less than their full diameter is inside.
    """
    p = prediction if mask is None else V.in_mask(prediction, mask)
    out = segment(p, **options)
    if exclude_border:
        ends = out.groupBy("tomo", "label").agg(F.min("z").alias("_lo"), F.max("z").alias("_hi")).where((F.col("_lo") > 0) & (F.col("_hi") < shape[0] - 1))
        out = out.join(ends.select("tomo", "label"), ["tomo", "label"], "left_semi").select(*V.POS, "label")
    elif exclude_partial:
        out = V.whole_in_z(out, exclude_partial)
    return V.relabel_sequential(out)


def radii(v: DataFrame, size: Size = UNIT, planar: bool = True, min_size: int = 500, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """(tomo, label, z, y, x, radius): the voxel of each object farthest from its boundary.

    The boundary is the object's voxels with a neighbour over a face that is not
    of the object; with ``shape``, what lies outside the volume is none. ``planar``
    takes distances in slices, where a slice without boundary gives none. Only
    objects of more than ``min_size`` voxels count; the first farthest voxel in
    z, y, x order is taken.
    """
    kept = V.size_filter(v, min_size, strict=True)
    whole = V.erode(kept, border=shape is not None, shape=shape).select(*V.POS)
    rim = kept.join(whole, V.POS, "left_anti")
    keys = ("tomo", "label", "_slice") if planar else ("tomo", "label")
    unit = lambda t: t.withColumn("_slice", F.col("z"))
    far = distance_field(unit(kept), unit(rim), size, keys)
    best = far.groupBy("tomo", "label").agg(F.min(F.struct((-F.col("distance")).alias("d"), "z", "y", "x")).alias("m"))
    return best.select("tomo", "label", "m.z", "m.y", "m.x", (-F.col("m.d")).alias("radius"))
