"""Regions from outlines: point files, polygons, floods of the inside.

Outlines are points or voxels that a person has drawn slice by slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelgrain.operators import components as C
from voxelgrain.operators import volume as V
from voxelgrain.operators.lines import distance_field, smooth
from voxelgrain.operators.watershed import watershed
from voxelgrain.storage import parts, stage

#: Rows of a slice in which the sides of an object meet in one task.
BAND = 64


def natural(name: Column) -> Column:
    """A key that sorts names with the numbers in them by value: f2 before f10."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 30, "0")).otherwise(p))


def voxelise(rows: DataFrame, columns: list[tuple[str, str]], shape: tuple[int, int, int]) -> DataFrame:
    """(tomo, z, y, x, label) of coordinate files (tomo, file, ...), one file a slice.

    ``columns`` names a pair (y, x) for each structure; structure k has label
    k + 1 and is drawn over the ones before. Files are slices in natural order,
    those without a point included. Coordinates are clipped to the slice and
    cut to whole numbers; points whose first one is then not above 0 are
    padding and left out, as are nulls and slices past the end of ``shape``.
    """
    files = rows.select("tomo", "file").dropna().distinct()
    files = files.withColumn("z", (F.row_number().over(Window.partitionBy("tomo").orderBy(natural(F.col("file")), "file")) - 1).cast("int"))
    pairs = F.array(*[F.struct(F.lit(k + 1).cast("long").alias("label"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")) for k, (y, x) in enumerate(columns)])
    points = rows.select("tomo", "file", F.explode(pairs).alias("p")).join(files, ["tomo", "file"]).select("tomo", "z", "p.*")
    clip = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(n - 1)))
    points = points.where("y is not null and x is not null and not isnan(y) and not isnan(x)").withColumns({"y": clip("y", shape[1]), "x": clip("x", shape[2])})
    kept = points.where((F.col("y") > 0) & (F.col("z") < shape[0]))
    return kept.groupBy("tomo", "z", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(F.max("label").alias("label"))


def fill_polygons(points: DataFrame) -> DataFrame:
    """(tomo, label, z, y, x): the pixels inside of contours (tomo, label, z, contour, n, y, x).

    A contour is closed, its points in the order of n. Scan lines: each side that
    crosses a row gives one crossing, the crossings of an object in a row are
    sorted, and what lies between the first and second, third and fourth, ... is
    inside. So contours within contours are holes. A pixel counts by its
    coordinates; of the rim, low sides are inside and high sides are not. Points
    with a null are left out. Sides are dealt out by object and band of ``BAND``
    rows, as many tasks as their crossings ask for.
    """
    unit = ["tomo", "label", "z"]
    p = points.select(*unit, "contour", "n", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).dropna()
    spark = p.sparkSession
    p = p.repartition(parts(spark, p.count()), *unit, "contour")
    ring = Window.partitionBy(*unit, "contour").orderBy("n", "y", "x")
    to = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(ring)).alias(f"{c}1")
    side = p.select(*unit, F.col("y").alias("y0"), F.col("x").alias("x0"), to("y"), to("x"))
    side = side.withColumns({"_lo": F.ceil(F.least("y0", "y1")), "_hi": F.ceil(F.greatest("y0", "y1")) - 1}).where("_lo <= _hi")
    side = stage(side.withColumn("_band", F.explode(F.expr(f"sequence(floor(_lo / {BAND}), floor(_hi / {BAND}))"))), "polygons-sides")
    first, last = F.greatest(F.col("_lo"), F.col("_band") * BAND), F.least(F.col("_hi"), F.col("_band") * BAND + BAND - 1)
    crossings = side.agg(F.sum(last - first + 1)).first()[0] or 0
    side = side.repartition(parts(spark, crossings), *unit, "_band")
    row = side.withColumn("y", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    row = row.select(*unit, "_band", "y", (F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("c"))
    turn = F.row_number().over(Window.partitionBy(*unit, "_band", "y").orderBy("c")) - 1
    span = row.withColumn("_k", F.floor(turn / 2)).groupBy(*unit, "_band", "y", "_k").agg(F.ceil(F.min("c")).alias("_lo"), (F.ceil(F.max("c")) - 1).alias("_hi"))
    return span.where("_lo <= _hi").select(*unit, "y", F.explode(F.sequence(F.col("_lo").cast("int"), F.col("_hi").cast("int"))).alias("x"))


def _slices(v: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """All positions of the slices in which ``v`` has a voxel."""
    out = v.select("tomo", F.col("z").cast("int").alias("z")).dropna().distinct()
    for c, n in (("y", shape[1]), ("x", shape[2])):
        out = out.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out


def fill_outlines(outlines: DataFrame, shape: tuple[int, int, int], sigma: float = 1.0) -> DataFrame:
    """(tomo, z, y, x): what an outline shuts in around the middle of its slice.

    The smoothed outline is flooded from the middle and from the frame of the
    slice; what the middle's flood has reached is the inside. Gaps in the
    outline leak as little as the smoothing lets them. Slices without an
    outline stay empty.
    """
    drawn = V.crop(outlines.select(*V.POS).dropna().distinct(), (0, 0, 0), shape)
    ground = stage(_slices(drawn, shape).join(drawn.withColumn("value", F.lit(1.0)).hint("merge"), V.POS, "left").fillna(0.0, ["value"]), "outlines")
    height = stage(smooth(ground, sigma, planar=True).withColumnRenamed("value", "height"), "outlines-height")
    middle = (F.col("y") == shape[1] // 2) & (F.col("x") == shape[2] // 2)
    frame = F.col("y").isin(0, shape[1] - 1) | F.col("x").isin(0, shape[2] - 1)
    seeds = height.select(*V.POS, F.when(frame, 2).when(middle, 1).cast("long").alias("label")).where("label is not null")
    return watershed(height, seeds, planar=True).where("label = 1").select(*V.POS)


def close_each(v: DataFrame, iterations: int) -> DataFrame:
    """Every object closed by itself within its bounding box.

    Voxels of an object keep their label; a free one goes to the largest label
    that closes over it.
    """
    v = v.select(*V.POS, "label")
    box = V.objects(v)
    grown = v
    for _ in range(iterations):
        grown = grown.unionByName(V.shifted(grown, V.FACES)).distinct()
        grown = stage(grown.join(box.hint("merge"), ["tomo", "label"]).where(" and ".join(f"{c} >= min_{c} and {c} < max_{c}" for c in "zyx")).select(*v.columns), "close-each")
    return V.overlay(V.erode(grown, iterations=iterations), v)


def instances_from_outlines(boundaries: DataFrame, shape: tuple[int, int, int], far: float = 20.0, closing: int = 2) -> DataFrame:
    """Instances (tomo, z, y, x, label) from closed outlines of objects.

    Every connected outline, corners included, is one object. In each slice its
    centroid is a seed, and so is what lies farther than ``far`` from every
    thinned outline, for the background; a flood over one minus the distance to
    the thinned outlines (as a share of the slice's largest) plus the depth in
    them (likewise) parts the two. Slices whose outlines vanish when thinned
    have no such distance: they get no background. A second flood, over all
    slices and within objects and outlines, starts from the first and crosses
    the edges of the outlines last. Then every object is closed.
    """
    drawn = V.crop(boundaries.select(*V.POS).dropna().distinct(), (0, 0, 0), shape)
    parts = stage(C.components(drawn, 3).select(*V.POS, F.col("component").alias("label")), "outline-parts")
    ground = stage(_slices(parts, shape), "outline-slices")
    thinned = stage(V.erode(drawn.withColumn("label", F.lit(1)), V.CROSS_2D).select(*V.POS), "outline-thin")
    by_slice = lambda t: t.select("tomo", F.col("z").alias("_slice"), *"zyx")
    reach = lambda domain, to: distance_field(by_slice(domain), by_slice(to), keys=("tomo", "_slice"), planar=True).select(*V.POS, "distance")
    outside = reach(ground, thinned).withColumnRenamed("distance", "out")
    depth = reach(thinned, V.in_mask(ground, thinned, inside=False)).withColumnRenamed("distance", "deep")
    both = stage(ground.join(outside.hint("merge"), V.POS, "left").join(depth.hint("merge"), V.POS, "left"), "outline-distances")
    most = both.groupBy("tomo", "z").agg(F.max("out").alias("_out"), F.max("deep").alias("_deep"))
    share = lambda c: F.coalesce(F.col(c) / (F.col(f"_{c}") + 1e-6), F.lit(0.0))
    height = stage(both.join(most.hint("merge"), ["tomo", "z"]).select(*V.POS, "out", (1 - share("out") + share("deep")).alias("height")), "outline-height")
    middle = parts.groupBy("tomo", "label", "z").agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in "yx"]).select(*V.POS, "label")
    top = parts.groupBy("tomo").agg((F.max("label") + 1).alias("label"))
    away = height.where(F.col("out") > far).join(top, "tomo").select(*V.POS, "label")
    # the background's label is the largest, so it wins where a seed lies in it
    first = watershed(height.select(*V.POS, "height"), middle.unionByName(away), planar=True)
    first = stage(first.join(top.withColumnRenamed("label", "_top"), "tomo").where("label < _top").select(*V.POS, "label"), "outline-first")
    mask = first.select(*V.POS).unionByName(drawn).distinct()
    edge = V.boundary(drawn.withColumn("label", F.lit(1))).select(*V.POS).unionByName(V.boundary(drawn.withColumn("label", F.lit(1)), "outer").select(*V.POS)).withColumn("height", F.lit(1.0))
    rim = mask.join(edge.hint("merge"), V.POS, "left").fillna(0.0, ["height"])
    out = watershed(rim, first)
    return close_each(stage(out, "outline-instances"), closing) if closing else out
