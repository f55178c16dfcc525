"""Contact sites and per-object statistics of inner structures, and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelgrain.operators import components as C
from voxelgrain.operators import distance as D
from voxelgrain.operators import volume as V
from voxelgrain.plans.segmentation import radii
from voxelgrain.storage import parts, stage


def contact_sites(inner: DataFrame, membrane: DataFrame, voxel_volume: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(sites, report): voxels of ``inner`` that touch or lie in the membrane.

    Sites are connected over faces, edges and corners: (tomo, z, y, x, site). The
    report has a row a tomogram of ``inner``: n_sites and volume, zero where
    nothing touches.
    """
    touching = V.contacts(inner.select(*V.POS).distinct().withColumn("label", F.lit(1).cast("long")), membrane)
    sites = C.components(touching, 3).withColumnRenamed("component", "site")
    found = sites.groupBy("tomo").agg(F.count_distinct("site").alias("n_sites"), (F.count(F.lit(1)) * float(voxel_volume)).alias("volume"))
    report = inner.select("tomo").distinct().join(found, "tomo", "left")
    return sites, report.select("tomo", F.coalesce("n_sites", F.lit(0)).alias("n_sites"), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def object_statistics(outer: DataFrame, inner: DataFrame, voxel_size: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """One row for each outer object, whether or not it holds inner voxels.

    Volume and surface of the object; of the inner voxels in it volume, surface,
    share of the object, number of parts (by faces), volume of the largest part,
    surface of the inner voxels over volume of the object; and the inner part's
    centre relative to the object's. Measures of nothing are 0, ratios null.
    """
    volume = float(voxel_size[0] * voxel_size[1] * voxel_size[2])
    key = ["tomo", "label"]
    within = outer.select(*V.POS, "label").join(inner.select(*V.POS).distinct(), V.POS, "left_semi")
    whole = V.objects(outer).select(*key, F.col("area").alias("n"), "c_z", "c_y", "c_x")
    centre = within.groupBy(*key).agg(F.count(F.lit(1)).alias("n_inner"), *[F.avg(c).alias(f"i_{c}") for c in "zyx"])
    # parts of one object only: the object's label is part of the tomogram's name
    tagged = within.select(F.concat_ws("|", "tomo", "label").alias("tomo"), "z", "y", "x", "label")
    parts = C.components(tagged, 1).groupBy("tomo", "component").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy(F.col("tomo").alias("_key")).agg(F.count(F.lit(1)).alias("n_parts"), F.max("n").alias("largest"))
    out = whole.join(V.surface_area(outer, voxel_size).withColumnRenamed("area", "surface"), key).join(centre, key, "left")
    out = out.join(V.surface_area(within, voxel_size).withColumnRenamed("area", "inner_surface"), key, "left")
    out = out.withColumn("_key", F.concat_ws("|", "tomo", "label")).join(parts, "_key", "left")
    zero = lambda c, f=1.0: F.coalesce(F.col(c) * f, F.lit(0.0))
    return out.select(
        *key,
        (F.col("n") * volume).alias("volume"),
        "surface",
        zero("n_inner", volume).alias("inner_volume"),
        zero("inner_surface").alias("inner_surface"),
        (F.coalesce("n_inner", F.lit(0)) / F.col("n")).alias("inner_share"),
        F.coalesce("n_parts", F.lit(0)).cast("long").alias("n_parts"),
        zero("largest", volume).alias("largest_part"),
        (zero("inner_surface") / (F.col("n") * volume)).alias("surface_density"),
        *[((F.col(f"i_{c}") - F.col(f"c_{c}")) * float(s)).alias(f"offset_{c}") for c, s in zip("zyx", voxel_size, strict=True)],
    )


def objects_per_region(regions: DataFrame, v: DataFrame) -> DataFrame:
    """(tomo, region, n): distinct objects with a voxel in each region."""
    both = regions.select(*V.POS, F.col("label").alias("region")).join(v.select(*V.POS, "label"), V.POS)
    return both.where("label <> 0").groupBy("tomo", "region").agg(F.count_distinct("label").alias("n"))


def fullest_region(regions: DataFrame, v: DataFrame) -> DataFrame:
    """(tomo, region, n): the region with most objects; of equal ones the first."""
    best = F.max_by(F.struct("region", "n"), F.struct("n", -F.col("region")))
    return objects_per_region(regions, v).groupBy("tomo").agg(best.alias("m")).select("tomo", "m.*")


def presynaptic_mask(regions: DataFrame, v: DataFrame, iterations: int = 5, shape: tuple | None = None) -> DataFrame:
    """Voxels of the region with most objects in each slice, opened in the slice.

    ``regions`` are the compartments of each slice; slices are handled one by
    one, so the same label in two slices is two regions.
    """
    slice_ = lambda t: t.withColumn("tomo", F.concat_ws("|", "tomo", "z"))
    best = fullest_region(slice_(regions), slice_(v)).select("tomo", F.col("region").alias("label"))
    tagged = regions.withColumn("_tomo", F.col("tomo")).withColumn("tomo", F.concat_ws("|", "tomo", "z"))
    chosen = tagged.join(best, ["tomo", "label"], "left_semi").select(F.col("_tomo").alias("tomo"), "z", "y", "x", F.lit(1).cast("long").alias("label"))
    return V.opening(chosen, V.CROSS_2D, iterations, shape) if iterations else chosen


def binary_size_filter(v: DataFrame, min_size: int) -> DataFrame:
    """Mask of the objects of at least ``min_size`` voxels."""
    return V.size_filter(v, min_size).select(*V.POS)


def in_mask_boundary(v: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels of ``v`` on the inner boundary of the mask."""
    return V.in_mask(v, V.boundary(mask.select(*V.POS).distinct().withColumn("label", F.lit(1).cast("long"))))


def value_at_first_voxel(v: DataFrame, other: DataFrame) -> DataFrame:
    """(tomo, label, value): the other volume's label at each object's first voxel, 0 for none."""
    at = V.first_voxel(v).join(other.select(*V.POS, F.col("label").alias("value")), V.POS, "left")
    return at.select("tomo", "label", F.coalesce("value", F.lit(0)).alias("value"))


def map_labels(v: DataFrame, mapping: DataFrame) -> DataFrame:
    """Objects under the labels of ``mapping`` (tomo, label, value); value 0 drops them."""
    return v.join(mapping, ["tomo", "label"]).where("value <> 0").select(*V.POS, F.col("value").alias("label"))


def close_along_z(v: DataFrame, iterations: int = 2) -> DataFrame:
    """Each object closed along z; where two reach a voxel the larger label wins."""
    tagged = v.select(F.concat_ws("|", "tomo", "label").alias("tomo"), "z", "y", "x", "label", F.col("tomo").alias("_t"))
    names = tagged.select("tomo", F.col("_t")).distinct()
    closed = V.closing(tagged.drop("_t"), ((-1, 0, 0), (1, 0, 0)), iterations).join(names, "tomo")
    return closed.groupBy(F.col("_t").alias("tomo"), "z", "y", "x").agg(F.max("label").alias("label"))


def crop_around_mean(v: DataFrame, halo: tuple[int, int, int]) -> DataFrame:
    """Voxels within ``halo`` of the mean foreground coordinate, rounded down."""
    mid = v.groupBy("tomo").agg(*[F.floor(F.avg(c)).cast("int").alias(f"_m{c}") for c in "zyx"])
    keep = F.lit(True)
    for c, h in zip("zyx", halo, strict=True):
        keep = keep & F.col(c).between(F.col(f"_m{c}") - h, F.col(f"_m{c}") + h - 1)
    return v.join(mid, "tomo").where(keep).select(*v.columns)


def component_boxes(v: DataFrame, min_size: int, least: tuple[int, int, int], shape: tuple[int, int, int], connectivity: int = 1) -> DataFrame:
    """(tomo, component, size, lo_c, hi_c): boxes of components over a size, half open.

    A box shorter than ``least`` along an axis is widened evenly and cut at the
    volume's ends.
    """
    c = C.components(v, connectivity).groupBy("tomo", "component").agg(F.count(F.lit(1)).alias("size"), *[f(a).alias(f"{n}_{a}") for a in "zyx" for n, f in (("lo", F.min), ("hi", F.max))]).where(F.col("size") > min_size)
    cols: list[Column] = []
    for a, m, n in zip("zyx", least, shape, strict=True):
        short = F.greatest(F.lit(0), F.lit(m) - (F.col(f"hi_{a}") + 1 - F.col(f"lo_{a}")))
        cols += [F.greatest(F.lit(0), F.col(f"lo_{a}") - F.floor(short / 2)).cast("int").alias(f"lo_{a}"), F.least(F.lit(n), F.col(f"hi_{a}") + 1 + F.ceil(short / 2)).cast("int").alias(f"hi_{a}")]
    return c.select("tomo", "component", "size", *cols)


def points_to_labels(points: DataFrame, shape: tuple[int, int, int], exclude: list[int] | None = None) -> DataFrame:
    """Label volume of annotated points (tomo, id, z, y, x, radius), some ids left out."""
    kept = points.where(~F.col("id").isin(exclude)) if exclude else points
    return V.paint_spheres(kept, shape)


def points_by_boundary(v: DataFrame, min_radius: float = 0.0, factor: float = 1.0, size: tuple = (1.0, 1.0, 1.0), planar: bool = True, min_size: int = 0, shape: tuple | None = None) -> DataFrame:
    """(tomo, id, z, y, x, radius): the voxel of each object farthest from its boundary, and how far that is, times ``factor``."""
    r = radii(v, size, planar, min_size, shape)
    return r.select("tomo", F.col("label").alias("id"), "z", "y", "x", (F.col("radius") * factor).alias("radius")).where(F.col("radius") >= min_radius)


def labels_to_points(v: DataFrame, min_radius: float = 0.0, factor: float = 1.0, planar: bool = True) -> DataFrame:
    """(tomo, id, z, y, x, radius): centre and radius of each object by its size.

    The radius is that of the disk as large as the object's largest slice, or
    (``planar`` false) of the ball as large as the object, times ``factor``.
    """
    per = v.groupBy("tomo", "label", "z").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), F.avg("x").alias("x"))
    best = per.groupBy("tomo", "label").agg(F.max_by(F.struct("z", "y", "x", "n"), F.struct("n", -F.col("z"))).alias("m"), F.sum("n").alias("size"))
    radius = F.sqrt(F.col("m.n") / F.lit(3.141592653589793)) if planar else F.cbrt(F.col("size") * (3 / (4 * 3.141592653589793)))
    return best.select("tomo", F.col("label").alias("id"), "m.z", "m.y", "m.x", (radius * factor).alias("radius")).where(F.col("radius") >= min_radius)


def label_counts(v: DataFrame, volumes: DataFrame) -> DataFrame:
    """``volumes`` (tomo, ...) with n, the number of labels; 0 for an empty volume."""
    n = v.where("label > 0").groupBy("tomo").agg(F.count_distinct("label").alias("n"))
    return volumes.join(n, "tomo", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def count_report(files: DataFrame, skip: list[str]) -> DataFrame:
    """(dataset, tomograms, manual, total) of files (dataset, name, manual), some prefixes left out."""
    keep = F.lit(True)
    for prefix in skip:
        keep = keep & ~F.col("name").startswith(prefix)
    return files.where(keep).groupBy("dataset").agg(F.count_distinct("name").alias("tomograms"), F.count_if("manual").alias("manual"), F.count(F.lit(1)).alias("total"))


def outside_domain(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose trimmed, lower-cased text is not one of ``allowed``; null is not."""
    return rows.where(~F.coalesce(F.lower(F.trim(F.col(column))).isin(allowed), F.lit(False)))


def shift_ids(rows: DataFrame, names: DataFrame, at: int, shifts: dict[str, int]) -> DataFrame:
    """Ids moved by the shift of the name that stands at id ``at`` of their tomogram.

    ``names`` is (tomo, id, name); tomograms without a known name stay.
    """
    move = F.lit(0)
    for name, by in shifts.items():
        move = F.when(F.col("_name") == name, F.lit(by)).otherwise(move)
    of = names.where(F.col("id") == at).select("tomo", F.col("name").alias("_name"))
    return rows.join(of, "tomo", "left").withColumn("id", F.col("id") + F.coalesce(move, F.lit(0))).drop("_name")


def with_parameters(rows: DataFrame, parameters: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the parameters of their version and instrument; rows without any stay."""
    return rows.join(parameters, keys, "left")


def first_rating(ratings: DataFrame, keys: list[str], order: str, good: str) -> DataFrame:
    """Keys whose first rating is ``good``."""
    return ratings.groupBy(*keys).agg(F.min_by("rating", order).alias("rating")).where(F.col("rating") == good).select(*keys)


def surface_dice(a: DataFrame, b: DataFrame, tolerance: float = 1.0, size: D.Size = D.UNIT) -> DataFrame:
    """(tomo, surface_dice): share of both surfaces that lies within ``tolerance`` of the other."""
    surface = lambda v: V.boundary(v.select(*V.POS).distinct().withColumn("label", F.lit(1).cast("long"))).select(*V.POS)
    reach = [range(-int(tolerance // s), int(tolerance // s) + 1) for s in size]
    ball = [(z, y, x) for z in reach[0] for y in reach[1] for x in reach[2] if (z * size[0]) ** 2 + (y * size[1]) ** 2 + (x * size[2]) ** 2 <= tolerance**2]
    sa, sb = surface(a), surface(b)

    def near(one: DataFrame, other: DataFrame, name: str) -> DataFrame:
        close = one.join(V.shifted(other, ball).distinct(), V.POS, "left_semi").groupBy("tomo").agg(F.count(F.lit(1)).alias(f"near_{name}"))
        return one.groupBy("tomo").agg(F.count(F.lit(1)).alias(f"n_{name}")).join(close, "tomo", "left")

    both = near(sa, sb, "a").join(near(sb, sa, "b"), "tomo", "full_outer").na.fill(0)
    return both.select("tomo", F.try_divide(F.col("near_a") + F.col("near_b"), F.col("n_a") + F.col("n_b")).alias("surface_dice"))


def gradient(image: DataFrame, value: str = "value") -> DataFrame:
    """(tomo, z, y, x, edge): Sobel magnitude in each slice, over voxels with all eight neighbours."""
    kernel = [(a, b, a * (2 - abs(b)), b * (2 - abs(a))) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dy", "dx", "gy", "gx"), k, strict=True)]) for k in kernel])).alias("o")
    image = stage(image.select(*V.POS, F.col(value).alias("_v")), "gradient")
    n = parts(image.sparkSession, image.count() * len(kernel))
    near = image.select(*V.POS, "_v", each)
    at = [(F.col(c) - F.col(f"o.d{c}")).cast("int").alias(c) for c in "yx"]
    near = near.select("tomo", "z", *at, *[(F.col("_v") * F.col(f"o.{g}")).alias(g) for g in ("gy", "gx")])
    sums = near.repartition(n, *V.POS).groupBy(*V.POS).agg(F.sum("gy").alias("gy"), F.sum("gx").alias("gx"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(kernel))
    return sums.join(image.select(*V.POS).repartition(n, *V.POS).hint("merge"), V.POS, "left_semi").select(*V.POS, F.sqrt(F.col("gy") * F.col("gy") + F.col("gx") * F.col("gx")).alias("edge"))


def laplace(image: DataFrame, value: str = "value") -> DataFrame:
    """(tomo, z, y, x, edge): sum of the four neighbours in the slice less four times the voxel."""
    image, near = V.gathered(image.select(*V.POS, F.col(value).alias("_v")), V.CROSS_2D, "laplace")
    near = near.groupBy(*V.POS).agg(F.sum("_v").alias("_s"), F.count(F.lit(1)).alias("_n")).where("_n = 4")
    return image.join(near.hint("merge"), V.POS).select(*V.POS, (F.col("_s") - 4 * F.col("_v")).alias("edge"))


def refine_shapes(v: DataFrame, edge: DataFrame, erosion: int = 2, growth: int = 2, limit: float = 0.0) -> DataFrame:
    """Objects eroded to seeds and grown again through voxels with an edge up to ``limit``.

    Growth is one ring of face neighbours at a time; a voxel that several seeds
    reach in one ring goes to the largest label. Objects that the erosion
    swallows keep their first shape.
    """
    v = stage(v, "refine-shapes")
    seeds = stage(V.erode(v, V.CROSS_2D, erosion), "refine-seeds")
    lost = v.join(seeds.select("tomo", "label").distinct().hint("merge"), ["tomo", "label"], "left_anti")
    grown, open_ = V.overlay(lost, seeds), stage(edge.where(F.col("edge") <= limit).select(*V.POS), "refine-open")
    for _ in range(growth):
        grown = stage(grown, "refine-grown")  # each ring asks for it three times; looks small on disk, so never broadcast
        ring = V.shifted(grown, V.CROSS_2D).join(open_.hint("merge"), V.POS, "left_semi").join(grown.select(*V.POS).hint("merge"), V.POS, "left_anti").groupBy(*V.POS).agg(F.max("label").alias("label"))
        grown = grown.unionByName(ring)
    return grown


def first_per_slice(v: DataFrame) -> DataFrame:
    """(tomo, z, label, n, rank): objects of each slice by size, the first of equal labels first."""
    n = v.groupBy("tomo", "z", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("tomo", "z").orderBy(F.desc("n"), "label")))
