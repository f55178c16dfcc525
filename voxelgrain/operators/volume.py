"""Operators on sparse label volumes: tables (tomo, z, y, x, label).

All of them are joins, groupings and windows on voxel coordinates; none holds a
volume in one place. Label 0 is background and never stored.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelgrain.operators.matching import maximum_matching
from voxelgrain.storage import parts, stage

POS = ["tomo", "z", "y", "x"]
FACES = ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))
FULL = tuple(o for o in product((-1, 0, 1), repeat=3) if o != (0, 0, 0))
CROSS_2D = ((0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))
SQUARE_2D = tuple((0, a, b) for a, b in product((-1, 0, 1), repeat=2) if (a, b) != (0, 0))


def neighbourhood(connectivity: int = 1, planar: bool = False) -> tuple:
    """Offsets: faces only (1) or all (3); ``planar`` leaves z out."""
    if planar:
        return CROSS_2D if connectivity == 1 else SQUARE_2D
    if connectivity == 2:
        return tuple(o for o in FULL if sum(map(abs, o)) <= 2)
    return FACES if connectivity == 1 else FULL


def ball(radius: int, planar: bool = False) -> tuple:
    """Offsets of a ball (or disk), its centre left out."""
    r = range(-radius, radius + 1)
    return tuple((z, y, x) for z in ((0,) if planar else r) for y in r for x in r if 0 < z * z + y * y + x * x <= radius * radius)


def shifted(v: DataFrame, offsets, names: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """A row for each voxel and offset, moved by it."""
    moves = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"d{n}") for d, n in zip(o, names, strict=True)]) for o in offsets])).alias("_o")
    return v.select("*", moves).withColumns({n: (F.col(n) + F.col(f"_o.d{n}")).cast("int") for n in names}).drop("_o")


def gathered(v: DataFrame, offsets, name: str, keys: list[str] = POS) -> tuple[DataFrame, DataFrame]:
    """(v, v moved by each offset), written once and dealt out by ``keys`` alike, so many rows a task."""
    v = stage(v, name)
    n = parts(v.sparkSession, v.count() * len(offsets))
    return v.repartition(n, *keys), shifted(v, offsets).repartition(n, *keys)


# -- objects ---------------------------------------------------------------


def label_sizes(v: DataFrame) -> DataFrame:
    """Unique labels with their voxel counts."""
    return v.groupBy("tomo", "label").agg(F.count(F.lit(1)).alias("size"))


def objects(v: DataFrame) -> DataFrame:
    """Region properties: area, centroid, half-open bounding box."""
    aggs = [F.count(F.lit(1)).alias("area")]
    for c in ("z", "y", "x"):
        aggs += [F.min(c).alias(f"min_{c}"), (F.max(c) + 1).alias(f"max_{c}"), F.avg(c).alias(f"c_{c}")]
    return v.groupBy("tomo", "label").agg(*aggs)


def intensity(v: DataFrame, image: DataFrame, value: str = "value") -> DataFrame:
    """Maximum, mean, minimum and population deviation of the image per object."""
    return v.join(image, POS).groupBy("tomo", "label").agg(F.max(value).alias("intensity_max"), F.avg(value).alias("intensity_mean"), F.min(value).alias("intensity_min"), F.stddev_pop(value).alias("intensity_std"))


def size_filter(v: DataFrame, min_size: int, strict: bool = False) -> DataFrame:
    """Objects of at least (``strict``: more than) ``min_size`` voxels; 0 is no filter."""
    if min_size == 0 and not strict:
        return v
    ok = label_sizes(v).where(F.col("size") > min_size if strict else F.col("size") >= min_size)
    return v.join(ok.select("tomo", "label").hint("merge"), ["tomo", "label"], "left_semi")


def z_extent_filter(v: DataFrame, min_extent: int) -> DataFrame:
    ok = v.groupBy("tomo", "label").agg((F.max("z") - F.min("z") + 1).alias("e")).where(F.col("e") >= min_extent)
    return v.join(ok.select("tomo", "label"), ["tomo", "label"], "left_semi")


def border_filter(v: DataFrame, shape: tuple[int, int, int], z_only: bool = False, planar: bool = False) -> DataFrame:
    """Objects whose bounding box touches no face of the volume.

    ``planar`` leaves z out of account, as for 2D data.
    """
    box, touches = objects(v), F.lit(False)
    axes = ("z",) if z_only else ("y", "x") if planar else ("z", "y", "x")
    for c in axes:
        touches = touches | (F.col(f"min_{c}") <= 0) | (F.col(f"max_{c}") >= shape["zyx".index(c)])
    return v.join(box.where(touches).select("tomo", "label"), ["tomo", "label"], "left_anti")


def whole_in_z(v: DataFrame, slices: int = 4) -> DataFrame:
    """Objects whose largest slice lies ``slices`` or more from both z ends.

    Of equal slices the first counts.
    """
    per = v.groupBy("tomo", "label", "z").agg(F.count(F.lit(1)).alias("mass"))
    mid = per.groupBy("tomo", "label").agg(F.max_by("z", F.struct("mass", -F.col("z"))).alias("mid"), F.min("z").alias("lo"), F.max("z").alias("hi"))
    ok = mid.where((F.col("mid") - F.col("lo") >= slices) & (F.col("hi") - F.col("mid") >= slices))
    return v.join(ok.select("tomo", "label"), ["tomo", "label"], "left_semi")


def relabel_sequential(v: DataFrame) -> DataFrame:
    """Labels 1..n per tomogram in their order; ranks run over labels, not voxels."""
    rank = F.dense_rank().over(Window.partitionBy("tomo").orderBy("label")).cast("long")
    new = v.select("tomo", "label").distinct().withColumn("new", rank)
    return v.join(new, ["tomo", "label"]).select(*POS, F.col("new").alias("label"))


def first_voxel(v: DataFrame) -> DataFrame:
    """First voxel of each object in z, y, x order."""
    at = F.min(F.struct("z", "y", "x"))
    return v.groupBy("tomo", "label").agg(at.alias("p")).select("tomo", "label", "p.*")


# -- masks -----------------------------------------------------------------


def in_mask(v: DataFrame, mask: DataFrame, inside: bool = True) -> DataFrame:
    """Voxels in (or outside) the mask."""
    return v.join(mask.select(*POS).distinct().hint("merge"), POS, "left_semi" if inside else "left_anti")


def overlapping(v: DataFrame, mask: DataFrame) -> DataFrame:
    """Whole objects of which at least one voxel lies in the mask."""
    hit = in_mask(v, mask).select("tomo", "label").distinct()
    return v.join(hit, ["tomo", "label"], "left_semi")


def crop(v: DataFrame, lo: tuple, hi: tuple, shift: bool = False) -> DataFrame:
    """Voxels in the half-open box; ``shift`` moves its corner to the origin."""
    out = v.where(" and ".join(f"{c} >= {a} and {c} < {b}" for c, a, b in zip("zyx", lo, hi, strict=True)))
    return out.withColumns({c: (F.col(c) - a).cast("int") for c, a in zip("zyx", lo, strict=True)}) if shift else out


def bounding_box(*volumes: DataFrame) -> DataFrame:
    """Joint bounding box of volumes per tomogram: lo_z, hi_z and so on, inclusive."""
    both = volumes[0].select(*POS)
    for v in volumes[1:]:
        both = both.unionByName(v.select(*POS))
    return both.groupBy("tomo").agg(*[f(c).alias(f"{n}_{c}") for c in "zyx" for n, f in (("lo", F.min), ("hi", F.max))])


def crop_to_joint_box(v: DataFrame, *volumes: DataFrame, halo: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Voxels of ``v`` in the joint bounding box of the volumes and a halo."""
    keep = F.lit(True)
    for c, h in zip("zyx", halo, strict=True):
        keep = keep & F.col(c).between(F.col(f"lo_{c}") - h, F.col(f"hi_{c}") + h)
    return v.join(bounding_box(*volumes), "tomo").where(keep).select(*v.columns)


def slab(v: DataFrame, exclude: int, depth: int) -> DataFrame:
    """Leaves out ``exclude`` slices at both z ends; 0 leaves out none."""
    return v.where(F.col("z").between(exclude, depth - exclude - 1))


def threshold(prediction: DataFrame, limit: float | Column, value: str = "value") -> DataFrame:
    return prediction.where(F.col(value) > limit).select(*POS)


def downsample(v: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th voxel along each axis, coordinates divided."""
    return v.where(" and ".join(f"{c} % {step} = 0" for c in "zyx")).withColumns({c: F.floor(F.col(c) / step).cast("int") for c in "zyx"})


def resize_labels(v: DataFrame, scale: tuple[float, float, float], shape: tuple[int, int, int]) -> DataFrame:
    """Nearest-voxel resize: each new voxel takes the old one under its index."""
    new = [max(1, round(s * f)) for s, f in zip(shape, scale, strict=True)]
    out = v
    for c, old, n in zip("zyx", shape, new, strict=True):
        # new indices i with floor(i * old / n) = c
        first, last = F.ceil(F.col(c) * n / old), F.ceil((F.col(c) + 1) * n / old) - 1
        out = out.where(first <= last).withColumn(c, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return out


# -- overlay ---------------------------------------------------------------


def overlay(*volumes: DataFrame, deal: int | None = None) -> DataFrame:
    """Volumes over each other: where several have a voxel the last wins.

    ``deal``: partitions to deal the voxels into; else adaptive execution finds them.
    """
    layers = [v.select(*POS, "label", F.lit(k).alias("_p")) for k, v in enumerate(volumes)]
    both = layers[0]
    for v in layers[1:]:
        both = both.unionByName(v)
    both = both.repartition(deal, *POS) if deal else both
    return both.groupBy(*POS).agg(F.max_by("label", F.struct("_p", "label")).alias("label"))


def append(v: DataFrame, other: DataFrame) -> DataFrame:
    """Adds the objects of ``other`` under labels after those of ``v``."""
    top = v.groupBy("tomo").agg(F.max("label").alias("_top"))
    moved = other.join(top, "tomo", "left").select(*POS, (F.col("label") + F.coalesce("_top", F.lit(0))).alias("label"))
    return overlay(v, moved)


def stack_slices(v: DataFrame) -> DataFrame:
    """Labels of separate slices made unique: ranks of (z, label) per tomogram."""
    rank = F.dense_rank().over(Window.partitionBy("tomo").orderBy("z", "label")).cast("long")
    new = v.select("tomo", "z", "label").distinct().withColumn("new", rank)
    return v.join(new, ["tomo", "z", "label"]).select(*POS, F.col("new").alias("label"))


def paint_spheres(spheres: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels of balls (tomo, id, z, y, x, radius), clipped; the later id wins."""
    r = F.ceil("radius").cast("int")
    span = lambda c: F.explode(F.sequence(F.col(c) - F.col("_r"), F.col(c) + F.col("_r")))
    v = spheres.withColumn("_r", r)
    for c in "zyx":
        v = v.withColumn(f"_{c}", span(c))
    d2 = sum(((F.col(f"_{c}") - F.col(c)) * (F.col(f"_{c}") - F.col(c)) for c in "yx"), (F.col("_z") - F.col("z")) * (F.col("_z") - F.col("z")))
    ok = d2 <= F.col("radius") * F.col("radius")
    for c, n in zip("zyx", shape, strict=True):
        ok = ok & (F.col(f"_{c}") >= 0) & (F.col(f"_{c}") < n)
    return v.where(ok).groupBy("tomo", *[F.col(f"_{c}").cast("int").alias(c) for c in "zyx"]).agg(F.max("id").alias("label"))


# -- morphology ------------------------------------------------------------


def dilate(v: DataFrame, offsets=FACES, iterations: int = 1, shape: tuple | None = None) -> DataFrame:
    """Grown objects; a voxel reached by several gets the largest label."""
    for _ in range(iterations):
        v = stage(v.select(*POS, "label"), "dilate")
        n = parts(v.sparkSession, v.count() * (len(offsets) + 1))
        grown = shifted(v, offsets)
        if shape:
            grown = crop(grown, (0, 0, 0), shape)
        old = v.withColumn("_own", F.lit(1))
        v = old.unionByName(grown.withColumn("_own", F.lit(0))).repartition(n, *POS).groupBy(*POS).agg(F.max(F.struct("_own", "label"))["label"].alias("label"))
    return v


def erode(v: DataFrame, offsets=FACES, iterations: int = 1, border: bool = False, shape: tuple | None = None) -> DataFrame:
    """Voxels all of whose neighbours are of the same object.

    ``border`` counts neighbours outside ``shape`` as present.
    """
    for _ in range(iterations):
        v, near = gathered(v.select(*POS, "label"), [tuple(-d for d in o) for o in offsets], "erode", [*POS, "label"])
        have = near.groupBy(*POS, "label").agg(F.count(F.lit(1)).alias("_n"))
        need = F.lit(len(offsets))
        if border and shape:
            outside = [F.when((F.col("z") + a < 0) | (F.col("z") + a >= shape[0]) | (F.col("y") + b < 0) | (F.col("y") + b >= shape[1]) | (F.col("x") + c < 0) | (F.col("x") + c >= shape[2]), 1).otherwise(0) for a, b, c in offsets]
            need = need - sum(outside[1:], outside[0])
        # written voxels look small on disk: they are never broadcast
        v = v.join(have.hint("merge"), [*POS, "label"], "left").where(F.coalesce("_n", F.lit(0)) >= need).select(*POS, "label")
    return v


def opening(v: DataFrame, offsets=FACES, iterations: int = 1, shape: tuple | None = None) -> DataFrame:
    return dilate(erode(v, offsets, iterations), offsets, iterations, shape)


def closing(v: DataFrame, offsets=FACES, iterations: int = 1, shape: tuple | None = None) -> DataFrame:
    """Grow, then shrink; voxels that were there stay."""
    v = stage(v.select(*POS, "label"), "closing")
    closed = erode(dilate(v, offsets, iterations), offsets, iterations)
    deal = parts(v.sparkSession, 4 * v.count())
    return overlay(closed if shape is None else crop(closed, (0, 0, 0), shape), v, deal=deal)


def boundary(v: DataFrame, mode: str = "inner", offsets=FACES) -> DataFrame:
    """Voxels with a neighbour of another label or of the background.

    ``inner``: of the objects; ``between``: only where two objects touch;
    ``outer``: the background voxels next to an object (largest label).
    """
    own = v.select(*POS, "label")
    if mode == "inner":
        # a bit for each side on which the object goes on, 0 for the voxel itself: one shuffle and no join
        to = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"d{n}") for n, d in zip("zyx", o, strict=True)], F.lit(bit).alias("bit")) for o, bit in [((0, 0, 0), 0), *[(o, 1 << k) for k, o in enumerate(offsets)]]]))
        spread = own.select("*", to.alias("_o")).select("tomo", *[(F.col(c) + F.col(f"_o.d{c}")).cast("int").alias(c) for c in "zyx"], "label", "_o.bit")
        sides = spread.groupBy(*POS, "label").agg(F.bit_or("bit").alias("_in"), F.min("bit").alias("_own"))
        return sides.where((F.col("_own") == 0) & (F.col("_in") < (1 << len(offsets)) - 1)).select(*POS, "label")
    near = shifted(own, offsets).withColumnRenamed("label", "_near")
    if mode == "outer":
        return near.join(own.hint("merge"), POS, "left_anti").groupBy(*POS).agg(F.max("_near").alias("label"))
    if mode == "between":
        touching = near.join(own.hint("merge"), POS).where("_near <> label").select(*POS).distinct()
        return own.join(touching.hint("merge"), POS, "left_semi")
    raise ValueError(f"unknown mode {mode}; there are inner, between and outer")


def separate_instances(v: DataFrame) -> DataFrame:
    """Binary mask in which touching objects are cut apart."""
    return in_mask(v, boundary(v, "between"), inside=False).select(*POS)


def surface_area(v: DataFrame, voxel_size: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Area of the faces at which an object ends, (tomo, label, area)."""
    z, y, x = voxel_size
    face = {0: y * x, 1: z * x, 2: z * y}
    total = v.groupBy("tomo", "label").agg(F.count(F.lit(1)).alias("n"))
    # each voxel has two faces along an axis; shared faces are not surface
    out, area = total, F.lit(0.0)
    for k in range(3):
        step = tuple(int(i == k) for i in range(3))
        shared = shifted(v.select(*POS, "label"), [step]).join(v.select(*POS, "label"), [*POS, "label"], "left_semi").groupBy("tomo", "label").agg(F.count(F.lit(1)).alias(f"s{k}"))
        out = out.join(shared, ["tomo", "label"], "left")
        area = area + (2 * F.col("n") - 2 * F.coalesce(F.col(f"s{k}"), F.lit(0))) * face[k]
    return out.select("tomo", "label", area.alias("area"))


def z_max_filter(v: DataFrame, size: int) -> DataFrame:
    """Largest label of ``size`` slices along z, for annotations with gaps."""
    return shifted(v.select(*POS, "label"), [(d - size // 2, 0, 0) for d in range(size)]).groupBy(*POS).agg(F.max("label").alias("label"))


def membrane_shell(v: DataFrame, thickness: int, shape: tuple[int, int, int]) -> DataFrame:
    """Rim of each object per slice: what an erosion by a disk takes away."""
    inner = erode(v, ball(thickness, planar=True), border=True, shape=shape)
    return in_mask(v, inner, inside=False)


def contacts(a: DataFrame, b: DataFrame, offsets=FACES) -> DataFrame:
    """Voxels of ``a`` that touch or lie in ``b``."""
    near = shifted(b.select(*POS), [*offsets, (0, 0, 0)]).distinct()
    return a.join(near, POS, "left_semi")


# -- comparison ------------------------------------------------------------


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared voxels of each pair of objects: (tomo, label_a, label_b, n)."""
    joined = a.select(*POS, F.col("label").alias("label_a")).join(b.select(*POS, F.col("label").alias("label_b")), POS)
    return joined.groupBy("tomo", "label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))


def scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlaps with intersection over union, over a and over b."""
    sa = label_sizes(a).select("tomo", F.col("label").alias("label_a"), F.col("size").alias("size_a"))
    sb = label_sizes(b).select("tomo", F.col("label").alias("label_b"), F.col("size").alias("size_b"))
    o = overlaps(a, b).join(sa, ["tomo", "label_a"]).join(sb, ["tomo", "label_b"])
    return o.select("*", (F.col("n") / (F.col("size_a") + F.col("size_b") - F.col("n"))).alias("iou"), (F.col("n") / F.col("size_a")).alias("iop"), (F.col("n") / F.col("size_b")).alias("iot"))


def matching(seg: DataFrame, gt: DataFrame, limit: float = 0.5, criterion: str = "iou", mutual: bool = False) -> DataFrame:
    """(tomo, tp, fp, fn): pairs of at least ``limit``, each object in one match.

    As many pairs as can be: over one half of IoU no object has two, and those
    that are each other's best are all; else a largest matching is sought.
    ``mutual`` counts only pairs that are each other's best, at any limit.
    """
    s = scores(seg, gt).where(F.col(criterion) >= limit)
    if mutual or (criterion == "iou" and limit > 0.5):
        best = lambda k, other: F.row_number().over(Window.partitionBy("tomo", k).orderBy(F.desc(criterion), other))
        pairs = s.withColumn("ra", best("label_a", "label_b")).withColumn("rb", best("label_b", "label_a")).where("ra = 1 and rb = 1")
    else:
        pairs = maximum_matching(s.select("tomo", F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    tp = pairs.groupBy("tomo").agg(F.count(F.lit(1)).alias("tp"))
    count = lambda v, c: v.groupBy("tomo").agg(F.count_distinct("label").alias(c))
    out = count(seg, "n_seg").join(count(gt, "n_gt"), "tomo", "full_outer").join(tp, "tomo", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("tomo", zero("tp").alias("tp"), (zero("n_seg") - zero("tp")).alias("fp"), (zero("n_gt") - zero("tp")).alias("fn"))


def dice(a: DataFrame, b: DataFrame) -> DataFrame:
    """2 n(A and B) / (n(A) + n(B)) of the foregrounds, per tomogram."""
    flags = a.select(*POS, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*POS, F.lit(0).alias("a"), F.lit(1).alias("b")))
    cell = flags.groupBy(*POS).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return cell.groupBy("tomo").agg((2 * F.sum(F.col("a") * F.col("b")) / (F.sum("a") + F.sum("b"))).alias("dice"))


def symmetric_best_dice(a: DataFrame, b: DataFrame) -> DataFrame:
    """Smaller of the mean best dice of a's objects and of b's, per tomogram."""
    sa = label_sizes(a).select("tomo", F.col("label").alias("label_a"), F.col("size").alias("size_a"))
    sb = label_sizes(b).select("tomo", F.col("label").alias("label_b"), F.col("size").alias("size_b"))
    o = overlaps(a, b).join(sa, ["tomo", "label_a"]).join(sb, ["tomo", "label_b"]).withColumn("d", 2 * F.col("n") / (F.col("size_a") + F.col("size_b")))
    best = lambda side, sizes: sizes.select("tomo", side).join(o.groupBy("tomo", side).agg(F.max("d").alias("d")), ["tomo", side], "left").groupBy("tomo").agg(F.avg(F.coalesce("d", F.lit(0.0))).alias(f"best_{side}"))
    return best("label_a", sa).join(best("label_b", sb), "tomo").select("tomo", F.least("best_label_a", "best_label_b").alias("sbd"))


def additional_objects(seg: DataFrame, gt: DataFrame, limit: float = 0.5, criterion: str = "iou") -> DataFrame:
    """Objects of ``seg`` whose best score with any of ``gt`` is at most ``limit``, relabelled."""
    found = scores(seg, gt).where(F.col(criterion) > limit).select("tomo", F.col("label_a").alias("label")).distinct()
    return relabel_sequential(seg.join(found, ["tomo", "label"], "left_anti"))
