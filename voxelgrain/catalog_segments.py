"""Queries on distances, filters, watersheds and compartments, with SQL where it can say the same.

``catalog`` imports this module, which adds its queries to those of the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrain.catalog import BOTH, query, r6
from voxelgrain.catalog_shapes import AT, INSIDE, balls
from voxelgrain.operators import eikonal as K
from voxelgrain.operators import lines as L
from voxelgrain.operators import meshes as M
from voxelgrain.operators import volume as V
from voxelgrain.operators.watershed import watershed
from voxelgrain.plans import compartments as P
from voxelgrain.plans import filters as E
from voxelgrain.plans import outlines as O
from voxelgrain.plans import segmentation as G
from voxelgrain.plans import sites as S
from voxelgrain.storage import stage
from voxelgrain.views import DENSE_SQL, ORDERS, VOXELS_SQL, dense_image, structure, table, truth, vesicles, voxels

NEAR = ("near_z", "near_y", "near_x")

# -- distances -------------------------------------------------------------

query("distance_field", f"""{BOTH}, d AS (SELECT v.tomo, v.z, v.y, v.x, min(struct_pack(d2 := ((v.x-s.x)*(v.x-s.x) + (v.y-s.y)*(v.y-s.y)) + 6.25*(v.z-s.z)*(v.z-s.z), z := s.z, y := s.y, x := s.x)) AS m FROM ves v JOIN structure s ON s.tomo = v.tomo GROUP BY ALL)
 SELECT {AT}, round(sqrt(m.d2), 6) AS distance, m.z AS near_z, m.y AS near_y, m.x AS near_x FROM d""")(
    lambda s, d: L.distance_field(vesicles(s, d), structure(s, d), (2.5, 1.0, 1.0)).select(*V.POS, r6("distance", "distance"), *NEAR)
)


def radii_sql(planar: bool) -> str:
    """Objects of more than 20 voxels against their own rim."""
    gap = "(k.y-r.y)*(k.y-r.y) + (k.x-r.x)*(k.x-r.x)" + ("" if planar else " + (k.z-r.z)*(k.z-r.z)")
    return f"""{INSIDE}, big AS (SELECT tomo, label FROM ball GROUP BY ALL HAVING count(*) > 20), k AS (SELECT * FROM ball SEMI JOIN big USING (tomo, label)), r AS (SELECT * FROM k ANTI JOIN e USING ({AT}, label)),
 d AS (SELECT k.tomo, k.label, k.z, k.y, k.x, min({gap}) AS d2 FROM k JOIN r ON r.tomo = k.tomo AND r.label = k.label {"AND r.z = k.z" if planar else ""} GROUP BY ALL)
 SELECT tomo, label, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(sqrt(d2), 6) AS radius FROM d QUALIFY row_number() OVER (PARTITION BY tomo, label ORDER BY d2 DESC, z, y, x) = 1"""


for _name, _planar in (("radii", False), ("radii_of_slices", True)):
    query(_name, radii_sql(_planar))(lambda s, d, planar=_planar: G.radii(balls(s, d), planar=planar, min_size=20).select("tomo", "label", "z", "y", "x", r6("radius", "radius")))

query("points_by_boundary", f"SELECT tomo, label AS id, z, y, x, round(1.5 * radius, 4) AS radius FROM ({radii_sql(True)}) WHERE 1.5 * radius >= 1.5")(
    lambda s, d: S.points_by_boundary(balls(s, d), 1.5, 1.5, min_size=20).select("tomo", "id", "z", "y", "x", F.round("radius", 4).alias("radius"))
)

# -- filters ---------------------------------------------------------------


def along_sql(source: str, axis: str, column: str, taps, size: int = 64) -> str:
    """Rows of ``source`` with ``value``, the sum over taps along an axis, mirrored at the ends."""
    r = len(taps) // 2
    at, last = f"d.{axis} + k.i", size - 1
    keys = " AND ".join(f"s.{c} = d.{c}" for c in ("tomo", "z", "y", "x") if c != axis)
    return f"""SELECT d.tomo, d.z, d.y, d.x, sum(k.w * s.{column}) AS value FROM {source} d, (VALUES {", ".join(f"({n - r}, {float(w)!r}::DOUBLE)" for n, w in enumerate(taps))}) k(i, w)
 JOIN {source} s ON {keys} AND s.{axis} = CASE WHEN {at} < 0 THEN -({at}) - 1 WHEN {at} > {last} THEN {2 * last + 1} - ({at}) ELSE {at} END GROUP BY ALL"""


def planar_sql(source: str, name: str, y, x, column: str = "value") -> str:
    """CTEs that end in ``name``: the source filtered along y, then x."""
    return f"{name}_y AS MATERIALIZED ({along_sql(source, 'y', column, y)}), {name} AS MATERIALIZED ({along_sql(f'{name}_y', 'x', 'value', x)})"


SIGMA = 1.0
FLAT, FIRST, SECOND = (L.gaussian_taps(SIGMA, k) for k in range(3))
HALF = L.gaussian_taps(SIGMA / 2)
RISE, SPREAD = (-0.5, 0.0, 0.5), (0.25, 0.5, 0.25)
GRADIENT_SQL = f"WITH {DENSE_SQL}, {planar_sql('dense', 'gy', FIRST, FLAT)}, {planar_sql('dense', 'gx', FLAT, FIRST)}, g AS MATERIALIZED (SELECT {AT}, gy.value AS gy, gx.value AS gx, gy.value*gy.value AS yy, gy.value*gx.value AS yx, gx.value*gx.value AS xx FROM gy JOIN gx USING ({AT}))"


def filtered(method: str):
    return lambda s, d: E.edge_filter(dense_image(s, d), SIGMA, method).select(*V.POS, F.round("value", 4).alias("value"))


query("gradient_magnitude", f"{GRADIENT_SQL} SELECT {AT}, round(sqrt(gy*gy + gx*gx), 4) AS value FROM g")(filtered("ggm"))
query("laplacian_of_gaussian", f"WITH {DENSE_SQL}, {planar_sql('dense', 'a', SECOND, FLAT)}, {planar_sql('dense', 'b', FLAT, SECOND)} SELECT {AT}, round(a.value + b.value, 4) AS value FROM a JOIN b USING ({AT})")(filtered("laplace"))
query("smoothed_sobel", f"WITH {DENSE_SQL}, {planar_sql('dense', 's', FLAT, FLAT)}, {planar_sql('s', 'a', RISE, SPREAD)}, {planar_sql('s', 'b', SPREAD, RISE)} SELECT {AT}, round(sqrt((a.value*a.value + b.value*b.value) / 2), 4) AS value FROM a JOIN b USING ({AT})")(filtered("sobel"))
query("structure_tensor", f"""{GRADIENT_SQL}, {planar_sql("g", "tyy", HALF, HALF, "yy")}, {planar_sql("g", "tyx", HALF, HALF, "yx")}, {planar_sql("g", "txx", HALF, HALF, "xx")}
 SELECT {AT}, round((tyy.value + txx.value)/2 + sqrt((tyy.value-txx.value)*(tyy.value-txx.value)/4 + tyx.value*tyx.value), 3) AS value FROM tyy JOIN tyx USING ({AT}) JOIN txx USING ({AT})""")(
    lambda s, d: E.edge_filter(dense_image(s, d), SIGMA, "structure-tensor").select(*V.POS, F.round("value", 3).alias("value"))
)
query("ridge_map")(lambda s, d: E.edge_filter(dense_image(s, d), SIGMA, "sato"))

# -- segmentation ----------------------------------------------------------


def squash(c):
    return 1 / (1 + F.exp(-c))


def predictions(s: SparkSession, d: str) -> DataFrame:
    """Foreground and border of blobs: the smoothed image and its gradient, set against their means."""
    made = L.derivatives(dense_image(s, d), 2.0, {"v": (0, 0, 0), "dz": (1, 0, 0), "dy": (0, 1, 0), "dx": (0, 0, 1)})
    slope = F.sqrt(F.col("dz") * F.col("dz") + F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))
    image = stage(made.select(*V.POS, "v", slope.alias("slope")), "predictions")
    mean = image.groupBy("tomo").agg(F.avg("v").alias("_v"), F.avg("slope").alias("_s"))
    # a row a tomogram: without the hint the whole image is shuffled for it, each time it is read
    return image.join(F.broadcast(mean), "tomo").select(*V.POS, squash(8 * (F.col("v") / F.col("_v") - 1)).alias("foreground"), squash(6 * (F.col("slope") / F.col("_s") - 2)).alias("border"))


def walls(s: SparkSession, d: str) -> DataFrame:
    """Membrane probabilities: high where the smoothed image is low; the foreground of ``predictions``, whose gradient is not made."""
    image = stage(L.derivatives(dense_image(s, d), 2.0, {"v": (0, 0, 0)}), "walls")
    mean = image.groupBy("tomo").agg(F.avg("v").alias("_v"))
    return image.join(F.broadcast(mean), "tomo").select(*V.POS, (1 - squash(8 * (F.col("v") / F.col("_v") - 1))).alias("value"))


# Floods and contractions have no SQL here: tests/core holds them against brute force.
query("watershed")(lambda s, d: watershed(L.smooth(dense_image(s, d), 1.5).withColumnRenamed("value", "height"), structure(s, d)))
query("segment")(lambda s, d: G.segment(predictions(s, d), 0.3, min_size=20))
query("segment_by_distance")(lambda s, d: G.segment(predictions(s, d), min_size=20, distance_seeds=2.0))
query("segment_slices")(lambda s, d: G.segment(predictions(s, d), 0.3, min_size=5, planar=True))
query("segment_with_borders")(lambda s, d: G.segment_with_borders(predictions(s, d), (8, 64, 64), exclude_partial=1, seed_limit=0.3))
query("compartments")(lambda s, d: P.segment_compartments(walls(s, d), 8, min_extent=2, far=3.0, min_seed=10, max_hole=20, iterations=1))

# -- surfaces and paths ----------------------------------------------------

SPACING = (2.5, 1.0, 1.5)


def cases_sql(axes: str) -> str:
    """CTE ``cube``: the corners that each object has of the cubes or squares around its voxels."""
    corners = M.CORNERS[: 1 << len(axes), 3 - len(axes) :].tolist()
    moved = ", ".join(f"{c} - o.d{c} AS {c}" for c in axes)
    return f"""o(bit, {", ".join(f"d{c}" for c in axes)}) AS (VALUES {", ".join(f"({1 << k}, {', '.join(map(str, c))})" for k, c in enumerate(corners))}),
 cube AS (SELECT tomo, label, z, y, x, sum(bit) AS k FROM (SELECT tomo, label, bit, {"" if "z" in axes else "z, "}{moved} FROM vox, o) GROUP BY ALL)"""


def values_sql(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"{v!r}" if isinstance(v, int) else f"{v!r}::DOUBLE" for v in r) + ")" for r in rows)


query("object_surfaces", f"""WITH {VOXELS_SQL}, {cases_sql("zyx")}, t(k, area, az, ay, ax, moment, crossing) AS (VALUES {values_sql(M.case_table(SPACING))})
 SELECT tomo, label, round(sum(area), 4) AS surface, round(sum(moment + (z*{SPACING[0]}*az + y*{SPACING[1]}*ay + x*{SPACING[2]}*ax)/3), 4) AS volume, round(sum(crossing), 4) AS crofton FROM cube JOIN t USING (k) GROUP BY ALL""")(
    lambda s, d: M.surfaces(voxels(s, d), SPACING).select("tomo", "label", *[F.round(c, 4).alias(c) for c in ("surface", "volume", "crofton")])
)
query("object_outlines", f"""WITH {VOXELS_SQL}, {cases_sql("yx")}, t(k, length) AS (VALUES {values_sql(M.square_table(SPACING))}), n AS (SELECT tomo, label, z, count(*) * {SPACING[1] * SPACING[2]} AS area FROM vox GROUP BY ALL)
 SELECT tomo, label, z, CAST(any_value(area) AS DOUBLE) AS area, round(sum(length), 6) AS perimeter FROM cube JOIN t USING (k) JOIN n USING (tomo, label, z) GROUP BY ALL""")(
    lambda s, d: M.outlines(voxels(s, d), SPACING).select("tomo", "label", "z", "area", r6("perimeter", "perimeter"))
)


def gaps(s: SparkSession, d: str) -> DataFrame:
    """The positions of each tomogram at which nothing was ordered: paths lead through these."""
    return dense_image(s, d).where("value = 0").select(*V.POS)


# Marches have no SQL here: tests/core holds them against a queue.
query("eikonal_distance")(lambda s, d: K.eikonal_distance(gaps(s, d), gaps(s, d).where("y = 0"), SPACING))
query("membrane_by_path")(lambda s, d: K.membrane_by_path(gaps(s, d), structure(s, d), 9.0, SPACING, exclude=1, depth=8, min_size=5))
query("optimal_matching")(lambda s, d: V.matching(voxels(s, d), truth(s, d), 0.02))  # largest matchings: tests/core

# -- outlines --------------------------------------------------------------

TOMO_SQL = f"'tomo' || CAST(l_orderkey // {ORDERS} AS VARCHAR) AS tomo"


def order_points(s: SparkSession, d: str) -> DataFrame:
    """The lines of each order as the points of a contour, all in slices by order."""
    li = table(s, d, "lineitem")
    tomo = F.concat(F.lit("tomo"), F.floor(F.col("l_orderkey") / ORDERS).cast("string"))
    return li.select(tomo.alias("tomo"), F.col("l_orderkey").cast("long").alias("label"), (F.col("l_orderkey") % 8).cast("int").alias("z"), F.lit(0).alias("contour"), F.col("l_linenumber").cast("int").alias("n"), (F.col("l_partkey") % 64).alias("y"), (F.col("l_suppkey") * 7 % 64).alias("x"))


query("polygons", f"""WITH p AS (SELECT {TOMO_SQL}, l_orderkey AS label, l_linenumber AS n, l_partkey % 64 AS y, l_suppkey * 7 % 64 AS x FROM lineitem),
 e AS (SELECT tomo, label, CAST(y AS DOUBLE) AS y0, CAST(x AS DOUBLE) AS x0, CAST(coalesce(lead(y) OVER w, first_value(y) OVER w) AS DOUBLE) AS y1, CAST(coalesce(lead(x) OVER w, first_value(x) OVER w) AS DOUBLE) AS x1 FROM p WINDOW w AS (PARTITION BY tomo, label ORDER BY n, y, x)),
 c AS (SELECT tomo, label, r.y, x0 + (r.y - y0) * (x1 - x0) / (y1 - y0) AS c FROM e, range(64) r(y) WHERE least(y0, y1) <= r.y AND r.y < greatest(y0, y1)),
 i AS (SELECT tomo, label, c.y, r.x FROM c, range(64) r(x) WHERE c.c <= r.x GROUP BY ALL HAVING count(*) % 2 = 1)
 SELECT tomo, label, count(*) AS pixels, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(x) AS BIGINT) AS sum_x FROM i GROUP BY ALL""")(
    lambda s, d: O.fill_polygons(order_points(s, d)).groupBy("tomo", "label").agg(F.count(F.lit(1)).alias("pixels"), F.sum("y").alias("sum_y"), F.sum("x").alias("sum_x"))
)
query("point_files", f"""WITH p AS (SELECT {TOMO_SQL}, dense_rank() OVER (PARTITION BY l_orderkey // {ORDERS} ORDER BY CAST(l_quantity AS INTEGER)) - 1 AS z, l_partkey, l_suppkey FROM lineitem),
 b AS (SELECT tomo, z, l_partkey % 64 AS y, l_suppkey * 7 % 64 AS x, 1 AS label FROM p UNION ALL SELECT tomo, z, l_suppkey % 64, l_partkey * 5 % 64, 2 FROM p)
 SELECT tomo, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(max(label) AS BIGINT) AS label FROM b WHERE y > 0 AND z < 40 GROUP BY ALL""")(
    lambda s, d: O.voxelise(
        table(s, d, "lineitem").select(F.concat(F.lit("tomo"), F.floor(F.col("l_orderkey") / ORDERS).cast("string")).alias("tomo"), F.concat(F.lit("slice"), F.col("l_quantity").cast("int").cast("string"), F.lit(".txt")).alias("file"), (F.col("l_partkey") % 64).alias("y1"), (F.col("l_suppkey") * 7 % 64).alias("x1"), (F.col("l_suppkey") % 64).alias("y2"), (F.col("l_partkey") * 5 % 64).alias("x2")),
        [("y1", "x1"), ("y2", "x2")],
        (40, 64, 64),
    )
)


def frames(v: DataFrame, wide: int) -> DataFrame:
    """Rectangles as wide as the box of each object, with lines of ``wide`` pixels."""
    box = v.groupBy("tomo", "label").agg(*[f(c).alias(f"{n}_{c}") for c in "zyx" for n, f in (("lo", F.min), ("hi", F.max))])
    for c in "zyx":
        box = box.withColumn(c, F.explode(F.sequence(f"lo_{c}", f"hi_{c}")))
    rim = [F.least(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(c)) for c in "yx"]
    return box.where(F.least(*rim) < wide).select(*V.POS)


# floods again: tests/core
query("fill_outlines")(lambda s, d: O.fill_outlines(frames(truth(s, d).where("label % 20 = 1"), 1), (8, 64, 64)))
query("outline_instances")(lambda s, d: O.instances_from_outlines(frames(structure(s, d), 3), (8, 64, 64), far=3.0))
