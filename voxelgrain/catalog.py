"""All queries of the library's own operators, with their SQL oracles.

Every entry applies an operator to whole tables; the SQL beside it is for DuckDB
and computes the same rows in another way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrain.operators import distance as D
from voxelgrain.operators import relational as R
from voxelgrain.operators import volume as V
from voxelgrain.plans import analysis as A
from voxelgrain.plans import sites as S
from voxelgrain.streaming import ingest
from voxelgrain.views import MEASURES_SQL, ORDERS, SHAPE, STRUCTURE_SQL, TRUTH_SQL, VOXELS_SQL, measurements, structure, table, truth, vesicles, voxels

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
VOX, GT, MEAS = f"WITH {VOXELS_SQL}", f"WITH {VOXELS_SQL}, {TRUTH_SQL}", f"WITH {MEASURES_SQL}"
BOTH = f"WITH {VOXELS_SQL}, {STRUCTURE_SQL}"
OFFSETS_SQL = "off(dz, dy, dx) AS (VALUES (-1,0,0),(1,0,0),(0,-1,0),(0,1,0),(0,0,-1),(0,0,1))"
POOL_NAMES = ["RA-V", "MP-V", "Docked-V", "unassigned"]
POOL_SQL = "CASE WHEN pd_distance < 100 AND boundary_distance < 2 THEN 'Docked-V' WHEN ribbon_distance < 80 THEN 'RA-V' WHEN ribbon_distance < 100 THEN 'MP-V' ELSE 'unassigned' END"
POOLED = f"{MEAS}, pooled AS (SELECT *, {POOL_SQL} AS pool FROM meas)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def pooled(s: SparkSession, d: str) -> DataFrame:
    near = F.col("ribbon_distance")
    docked = (F.col("pd_distance") < 100) & (F.col("boundary_distance") < 2)
    return R.assign_pools(measurements(s, d), [("MP-V", near < 100), ("RA-V", near < 80), ("Docked-V", docked)])


# -- objects, masks --------------------------------------------------------

query("label_sizes", f"{VOX} SELECT tomo, label, count(*) AS size FROM vox GROUP BY ALL")(lambda s, d: V.label_sizes(voxels(s, d)))

query("region_properties", f"""{VOX} SELECT tomo, label, count(*) AS area, min(z) AS min_z, max(z)+1 AS max_z, min(y) AS min_y, max(y)+1 AS max_y, min(x) AS min_x, max(x)+1 AS max_x,
 round(avg(z),6) AS c_z, round(avg(y),6) AS c_y, round(avg(x),6) AS c_x FROM vox GROUP BY ALL""")(
    lambda s, d: V.objects(voxels(s, d)).select("tomo", "label", "area", *[f"{m}_{c}" for c in "zyx" for m in ("min", "max")], *[r6(f"c_{c}", f"c_{c}") for c in "zyx"])
)


@query("intensity_statistics", f"""{VOX}, img AS (SELECT tomo, z, y, x, CAST((z*31 + y*17 + x*7) % 101 AS DOUBLE) AS value FROM vox)
 SELECT tomo, label, max(value) AS intensity_max, round(avg(value),6) AS intensity_mean, min(value) AS intensity_min, round(stddev_pop(value),6) AS intensity_std FROM vox JOIN img USING (tomo,z,y,x) GROUP BY ALL""")
def _intensity(s, d):
    v = voxels(s, d)
    image = v.select(*V.POS, ((F.col("z") * 31 + F.col("y") * 17 + F.col("x") * 7) % 101).cast("double").alias("value"))
    return V.intensity(v, image).select("tomo", "label", "intensity_max", r6("intensity_mean", "intensity_mean"), "intensity_min", r6("intensity_std", "intensity_std"))


query("size_filter", f"{VOX} SELECT * FROM vox SEMI JOIN (SELECT tomo, label FROM vox GROUP BY ALL HAVING count(*) >= 20) USING (tomo, label)")(lambda s, d: V.size_filter(voxels(s, d), 20))
query("size_filter_strict", f"{VOX} SELECT * FROM vox SEMI JOIN (SELECT tomo, label FROM vox GROUP BY ALL HAVING count(*) > 20) USING (tomo, label)")(lambda s, d: V.size_filter(voxels(s, d), 20, strict=True))
query("z_extent_filter", f"{VOX} SELECT * FROM vox SEMI JOIN (SELECT tomo, label FROM vox GROUP BY ALL HAVING max(z)-min(z)+1 >= 7) USING (tomo, label)")(lambda s, d: V.z_extent_filter(voxels(s, d), 7))
query("border_filter", f"{VOX} SELECT * FROM vox ANTI JOIN (SELECT tomo, label FROM vox GROUP BY ALL HAVING min(y) <= 0 OR min(x) <= 0 OR max(y)+1 >= 64 OR max(x)+1 >= 64) USING (tomo, label)")(lambda s, d: V.border_filter(voxels(s, d), SHAPE, planar=True))
query("whole_in_z", f"""{VOX}, per AS (SELECT tomo, label, z, count(*) AS m FROM vox GROUP BY ALL), mid AS (SELECT tomo, label, arg_max(z, m*100 - z) AS mid, min(z) lo, max(z) hi FROM per GROUP BY ALL)
 SELECT * FROM vox SEMI JOIN (SELECT * FROM mid WHERE mid-lo >= 2 AND hi-mid >= 2) USING (tomo, label)""")(lambda s, d: V.whole_in_z(voxels(s, d), 2))
query("relabel_sequential", f"{VOX} SELECT tomo, z, y, x, dense_rank() OVER (PARTITION BY tomo ORDER BY label) AS label FROM vox")(lambda s, d: V.relabel_sequential(voxels(s, d)))
query("first_voxel", f"{VOX} SELECT tomo, label, z, y, x FROM vox QUALIFY row_number() OVER (PARTITION BY tomo, label ORDER BY z, y, x) = 1")(lambda s, d: V.first_voxel(voxels(s, d)))
query("in_mask", f"{GT} SELECT vox.* FROM vox SEMI JOIN gt USING (tomo, z, y, x)")(lambda s, d: V.in_mask(voxels(s, d), truth(s, d)))
query("outside_mask", f"{GT} SELECT vox.* FROM vox ANTI JOIN gt USING (tomo, z, y, x)")(lambda s, d: V.in_mask(voxels(s, d), truth(s, d), inside=False))
query("overlapping_objects", f"{GT} SELECT * FROM vox SEMI JOIN (SELECT DISTINCT vox.tomo, vox.label FROM vox JOIN (SELECT * FROM gt WHERE label % 5 = 0) g USING (tomo, z, y, x)) USING (tomo, label)")(lambda s, d: V.overlapping(voxels(s, d), truth(s, d).where("label % 5 = 0")))
query("crop", f"{VOX} SELECT tomo, z-2 AS z, y-8 AS y, x-8 AS x, label FROM vox WHERE z >= 2 AND z < 6 AND y >= 8 AND y < 40 AND x >= 8 AND x < 40")(lambda s, d: V.crop(voxels(s, d), (2, 8, 8), (6, 40, 40), shift=True))
query("crop_to_joint_box", f"""{GT}, a AS (SELECT * FROM vox WHERE label BETWEEN 20 AND 24), b AS (SELECT * FROM gt WHERE label BETWEEN 30 AND 33), u AS (SELECT tomo,z,y,x FROM a UNION ALL SELECT tomo,z,y,x FROM b),
 box AS (SELECT tomo, min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM u GROUP BY tomo)
 SELECT vox.* FROM vox JOIN box USING (tomo) WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0-2 AND y1+2 AND x BETWEEN x0-2 AND x1+2""")(
    lambda s, d: V.crop_to_joint_box(voxels(s, d), voxels(s, d).where("label between 20 and 24"), truth(s, d).where("label between 30 and 33"), halo=(0, 2, 2))
)

query("slab", f"{VOX} SELECT * FROM vox WHERE z BETWEEN 2 AND 5")(lambda s, d: V.slab(voxels(s, d), 2, 8))
query("downsample", f"{VOX} SELECT tomo, CAST(z//2 AS INTEGER) AS z, CAST(y//2 AS INTEGER) AS y, CAST(x//2 AS INTEGER) AS x, label FROM vox WHERE z%2=0 AND y%2=0 AND x%2=0")(lambda s, d: V.downsample(voxels(s, d), 2))
query("resize_labels", f"""{VOX}, zs AS (SELECT i, CAST(floor(i*8/4.0) AS INTEGER) o FROM range(4) t(i)), ys AS (SELECT i, CAST(floor(i*64/96.0) AS INTEGER) o FROM range(96) t(i))
 SELECT tomo, CAST(zs.i AS INTEGER) AS z, CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS x, label FROM vox JOIN zs ON zs.o = vox.z JOIN ys a ON a.o = vox.y JOIN ys b ON b.o = vox.x""")(lambda s, d: V.resize_labels(voxels(s, d), (0.5, 1.5, 1.5), SHAPE))
query("overlay", f"{GT} SELECT tomo, z, y, x, coalesce(gt.label, vox.label) AS label FROM vox FULL JOIN gt USING (tomo, z, y, x)")(lambda s, d: V.overlay(voxels(s, d), truth(s, d)))
query("append_objects", f"{GT}, top AS (SELECT tomo, max(label) m FROM vox GROUP BY tomo), g AS (SELECT tomo, z, y, x, label + m AS label FROM gt JOIN top USING (tomo)) SELECT tomo, z, y, x, coalesce(g.label, vox.label) AS label FROM vox FULL JOIN g USING (tomo, z, y, x)")(lambda s, d: V.append(voxels(s, d), truth(s, d)))
query("stack_slices", f"{VOX} SELECT tomo, z, y, x, dense_rank() OVER (PARTITION BY tomo ORDER BY z, label) AS label FROM vox")(lambda s, d: V.stack_slices(voxels(s, d)))


@query("paint_spheres", """WITH sph AS (SELECT 'tomo' || CAST(p_partkey % 3 AS VARCHAR) AS tomo, p_partkey AS id, CAST(p_partkey % 8 AS INTEGER) z, CAST(p_partkey * 7 % 64 AS INTEGER) y, CAST(p_partkey * 13 % 64 AS INTEGER) x, p_size % 4 + 1 AS r FROM part),
 o AS (SELECT a.i dz, b.i dy, c.i dx FROM range(-4,5) a(i), range(-4,5) b(i), range(-4,5) c(i))
 SELECT tomo, CAST(z+dz AS INTEGER) AS z, CAST(y+dy AS INTEGER) AS y, CAST(x+dx AS INTEGER) AS x, max(id) AS label FROM sph JOIN o ON dz*dz+dy*dy+dx*dx <= r*r
 WHERE z+dz BETWEEN 0 AND 7 AND y+dy BETWEEN 0 AND 63 AND x+dx BETWEEN 0 AND 63 GROUP BY tomo, z+dz, y+dy, x+dx""")
def _paint(s, d):
    k = F.col("p_partkey")
    sph = table(s, d, "part").select(F.concat(F.lit("tomo"), (k % 3).cast("string")).alias("tomo"), k.alias("id"), (k % 8).cast("int").alias("z"), (k * 7 % 64).cast("int").alias("y"), (k * 13 % 64).cast("int").alias("x"), (F.col("p_size") % 4 + 1).alias("radius"))
    return V.paint_spheres(sph, SHAPE)


# -- morphology ------------------------------------------------------------

NEAR = f"{VOX}, {OFFSETS_SQL}, near AS (SELECT tomo, z+dz AS z, y+dy AS y, x+dx AS x, label FROM vox, off)"
query("dilate", f"{NEAR}, g AS (SELECT tomo,z,y,x,max(label) AS label FROM near ANTI JOIN vox USING (tomo,z,y,x) GROUP BY ALL) SELECT * FROM vox UNION ALL SELECT * FROM g")(lambda s, d: V.dilate(voxels(s, d)))
query("erode", f"{NEAR}, c AS (SELECT tomo,z,y,x,label,count(*) n FROM near GROUP BY ALL) SELECT vox.* FROM vox JOIN c USING (tomo,z,y,x,label) WHERE n = 6")(lambda s, d: V.erode(voxels(s, d)))
query("boundary_inner", f"{NEAR}, c AS (SELECT tomo,z,y,x,label,count(*) n FROM near GROUP BY ALL) SELECT vox.* FROM vox LEFT JOIN c USING (tomo,z,y,x,label) WHERE coalesce(n,0) < 6")(lambda s, d: V.boundary(voxels(s, d)))
query("boundary_outer", f"{NEAR} SELECT tomo,z,y,x,max(label) AS label FROM near ANTI JOIN vox USING (tomo,z,y,x) GROUP BY ALL")(lambda s, d: V.boundary(voxels(s, d), "outer"))
query("separate_instances", f"{NEAR} SELECT tomo,z,y,x FROM vox WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.tomo=vox.tomo AND near.z=vox.z AND near.y=vox.y AND near.x=vox.x AND near.label<>vox.label)")(lambda s, d: V.separate_instances(voxels(s, d)))
query("surface_area", f"{NEAR} SELECT n.tomo, n.label, CAST(count(*) AS DOUBLE) AS area FROM near n ANTI JOIN vox USING (tomo,z,y,x,label) GROUP BY ALL")(lambda s, d: V.surface_area(voxels(s, d)))
query("z_max_filter", f"{VOX} SELECT tomo, CAST(z+i AS INTEGER) AS z, y, x, max(label) AS label FROM vox, range(-2,2) t(i) GROUP BY ALL")(lambda s, d: V.z_max_filter(voxels(s, d), 4))
query("contacts", f"{BOTH}, {OFFSETS_SQL} SELECT ves.* FROM ves SEMI JOIN (SELECT tomo, z+dz z, y+dy y, x+dx x FROM structure, off) USING (tomo,z,y,x)")(lambda s, d: V.contacts(vesicles(s, d), structure(s, d)))

# -- comparison ------------------------------------------------------------

SCORES = f"""{GT}, o AS (SELECT vox.tomo, vox.label AS la, gt.label AS lb, count(*) n FROM vox JOIN gt USING (tomo,z,y,x) GROUP BY ALL), sa AS (SELECT tomo, label la, count(*) a FROM vox GROUP BY ALL), sb AS (SELECT tomo, label lb, count(*) b FROM gt GROUP BY ALL),
 sc AS (SELECT *, n/(a+b-n) AS iou FROM o JOIN sa USING (tomo, la) JOIN sb USING (tomo, lb))"""
query("overlap_scores", f"{SCORES} SELECT tomo, la AS label_a, lb AS label_b, n, round(iou,6) AS iou, round(n/a,6) AS iop, round(n/b,6) AS iot FROM sc")(lambda s, d: V.scores(voxels(s, d), truth(s, d)).select("tomo", "label_a", "label_b", "n", r6("iou", "iou"), r6("iop", "iop"), r6("iot", "iot")))
query("object_matching", f"""{SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY tomo, la ORDER BY iou DESC, lb) ra, row_number() OVER (PARTITION BY tomo, lb ORDER BY iou DESC, la) rb FROM sc WHERE iou >= 0.02),
 tp AS (SELECT tomo, count(*) tp FROM r WHERE ra=1 AND rb=1 GROUP BY tomo) SELECT tomo, coalesce(tp,0) AS tp, na-coalesce(tp,0) AS fp, nb-coalesce(tp,0) AS fn
 FROM (SELECT tomo, count(*) na FROM sa GROUP BY tomo) FULL JOIN (SELECT tomo, count(*) nb FROM sb GROUP BY tomo) USING (tomo) LEFT JOIN tp USING (tomo)""")(lambda s, d: V.matching(voxels(s, d), truth(s, d), 0.02, mutual=True))
query("dice", f"{GT} SELECT tomo, round(2*(SELECT count(*) FROM vox v SEMI JOIN gt USING (tomo,z,y,x) WHERE v.tomo=t.tomo)/((SELECT count(*) FROM vox v WHERE v.tomo=t.tomo)+(SELECT count(*) FROM gt g WHERE g.tomo=t.tomo)),6) AS dice FROM (SELECT DISTINCT tomo FROM vox) t")(lambda s, d: V.dice(voxels(s, d), truth(s, d)).select("tomo", r6("dice", "dice")))
query("symmetric_best_dice", f"""{SCORES}, dd AS (SELECT *, 2*n/(a+b) AS dc FROM sc), ba AS (SELECT tomo, avg(coalesce(m,0)) v FROM sa LEFT JOIN (SELECT tomo, la, max(dc) m FROM dd GROUP BY ALL) USING (tomo, la) GROUP BY tomo),
 bb AS (SELECT tomo, avg(coalesce(m,0)) v FROM sb LEFT JOIN (SELECT tomo, lb, max(dc) m FROM dd GROUP BY ALL) USING (tomo, lb) GROUP BY tomo) SELECT tomo, round(least(ba.v, bb.v),6) AS sbd FROM ba JOIN bb USING (tomo)""")(lambda s, d: V.symmetric_best_dice(voxels(s, d), truth(s, d)).select("tomo", r6("sbd", "sbd")))
query("additional_objects", f"{SCORES}, x AS (SELECT * FROM vox ANTI JOIN (SELECT tomo, la AS label FROM sc WHERE iou > 0.03) USING (tomo, label)) SELECT tomo, z, y, x, dense_rank() OVER (PARTITION BY tomo ORDER BY label) AS label FROM x")(lambda s, d: V.additional_objects(voxels(s, d), truth(s, d), 0.03))

# -- components and distances ----------------------------------------------

NEAREST = f"{BOTH}, n AS (SELECT a.tomo, a.label, b.label sl, (a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x) AS d2, a.z az, a.y ay, a.x ax, b.z bz, b.y by_, b.x bx FROM ves a JOIN structure b ON a.tomo = b.tomo), m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY tomo, label ORDER BY d2, az, ay, ax, bz, by_, bx) = 1)"
query("nearest_structure", f"{NEAREST} SELECT tomo, label, round(sqrt(d2),6) AS distance, az, ay, ax, bz, by_, bx, sl AS structure_label FROM m")(
    lambda s, d: D.nearest_structure(vesicles(s, d), structure(s, d)).select("tomo", "label", r6("distance", "distance"), F.col("ep_object.z").alias("az"), F.col("ep_object.y").alias("ay"), F.col("ep_object.x").alias("ax"), F.col("ep_structure.z").alias("bz"), F.col("ep_structure.y").alias("by_"), F.col("ep_structure.x").alias("bx"), "structure_label")
)
query("flagship_pools", f"{NEAREST} SELECT tomo, CASE WHEN sqrt(d2) < 2 THEN 'docked' ELSE 'free' END AS pool, count(*) AS n, round(avg(sqrt(d2)),6) AS mean_distance FROM m GROUP BY ALL")(
    lambda s, d: R.assign_pools(D.nearest_structure(vesicles(s, d), structure(s, d)), [("free", F.lit(True)), ("docked", F.col("distance") < 2)]).groupBy("tomo", "pool").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("distance"), "mean_distance"))
)
query("top_structures", f"{NEAREST}, c AS (SELECT tomo, sl AS structure_label, count(*) AS objects FROM m WHERE sqrt(d2) <= 10 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY tomo ORDER BY objects DESC, structure_label) AS rank FROM c QUALIFY rank <= 3")(lambda s, d: D.top_structures(D.nearest_structure(vesicles(s, d), structure(s, d)), 10.0, 3))
query("top_n_per_structure", f"{NEAREST} SELECT tomo, sl AS structure_label, label, row_number() OVER (PARTITION BY tomo, sl ORDER BY d2, label) AS rank FROM m QUALIFY rank <= 2")(lambda s, d: D.top_n_per_structure(D.nearest_structure(vesicles(s, d), structure(s, d)), 2).select("tomo", "structure_label", "label", "rank"))

# -- measurement tables ----------------------------------------------------

query("pool_assignment", f"{POOLED} SELECT tomo, id, pool FROM pooled")(lambda s, d: pooled(s, d).select("tomo", "id", "pool"))
query("pool_query_filter", f"{MEAS} SELECT * FROM meas WHERE radius > 10 AND ribbon_distance <= 120 AND boundary_distance < 50")(lambda s, d: R.query_filter(measurements(s, d), "radius > 10, ribbon_distance <= 120, no_such_column > 3, boundary_distance < 50", strict=False))
query("counts_per_group", f"""{POOLED} SELECT tomo, count(*) FILTER (pool='RA-V') AS "RA-V", count(*) FILTER (pool='MP-V') AS "MP-V", count(*) FILTER (pool='Docked-V') AS "Docked-V", count(*) FILTER (pool='unassigned') AS unassigned FROM pooled GROUP BY tomo""")(lambda s, d: R.counts_per_group(pooled(s, d), "tomo", "pool", POOL_NAMES))
query("category_summary", f"""{POOLED}, c AS (SELECT t.tomo, p.pool, count(m.id) AS n FROM (SELECT DISTINCT tomo FROM pooled) t CROSS JOIN (VALUES ('RA-V'),('MP-V'),('Docked-V'),('unassigned')) p(pool) LEFT JOIN pooled m ON m.tomo=t.tomo AND m.pool=p.pool GROUP BY ALL)
 SELECT pool, round(avg(n),6) AS mean, round(stddev_samp(n),6) AS std FROM c GROUP BY pool""")(lambda s, d: R.category_summary(pooled(s, d), "tomo", "pool", POOL_NAMES).select("pool", r6("mean", "mean"), r6("std", "std")))
query("mean_std", f"{POOLED} SELECT pool, round(avg(radius),6) AS radius_mean, round(stddev_samp(radius),6) AS radius_std FROM pooled GROUP BY pool")(lambda s, d: R.mean_std(pooled(s, d), ["pool"], ["radius"]).select("pool", r6("radius_mean", "radius_mean"), r6("radius_std", "radius_std")))
query("with_total", f"{MEAS} SELECT tomo, round(avg(radius),6) AS mean FROM meas GROUP BY tomo UNION ALL SELECT 'all', round(avg(radius),6) FROM meas")(lambda s, d: R.with_total(measurements(s, d), "tomo", {"mean": F.round(F.avg("radius"), 6)}))
query("bridge_groups", f"""{MEAS}, b(grp, tomo) AS (VALUES ('a','tomo1'),('a','tomo2'),('b','tomo2'),('b','tomo3')) SELECT grp AS "group", round(avg(radius),6) AS radius_mean, round(stddev_pop(radius),6) AS radius_std FROM meas JOIN b USING (tomo) GROUP BY grp""")(lambda s, d: R.bridge_groups(measurements(s, d), s.createDataFrame([("a", "tomo1"), ("a", "tomo2"), ("b", "tomo2"), ("b", "tomo3")], "group string, tomo string"), "tomo", ["radius"]).select("group", r6("radius_mean", "radius_mean"), r6("radius_std", "radius_std")))
query("conditional_means", f"""{POOLED} SELECT tomo, count(*) AS n_all, round(avg(radius),6) AS all_radius, count(*) FILTER (pool='RA-V') AS "n_RA-V", round(avg(radius) FILTER (pool='RA-V'),6) AS "RA-V_radius", count(*) FILTER (pool='MP-V') AS "n_MP-V", round(avg(radius) FILTER (pool='MP-V'),6) AS "MP-V_radius" FROM pooled GROUP BY tomo""")(lambda s, d: R.conditional_means(pooled(s, d), "tomo", "pool", ["RA-V", "MP-V"], ["radius"]).select("tomo", "n_all", r6("all_radius", "all_radius"), "n_RA-V", r6("`RA-V_radius`", "RA-V_radius"), "n_MP-V", r6("`MP-V_radius`", "MP-V_radius")))
query("by_condition", """SELECT o_orderstatus AS condition, o_orderpriority AS used_for, count(DISTINCT o_custkey) AS n_groups, sum(o_orderkey) AS total, grouping(o_orderstatus)*2+grouping(o_orderpriority) AS level FROM orders GROUP BY GROUPING SETS ((o_orderstatus),(o_orderpriority),())""")(
    lambda s, d: R.by_condition(table(s, d, "orders").select(F.col("o_orderstatus").alias("condition"), F.col("o_orderpriority").alias("used_for"), "o_custkey", "o_orderkey"), "condition", "used_for", "o_custkey", "o_orderkey")
)
query("micro_scores", f"""{POOLED}, t AS (SELECT tomo, count(*) FILTER (pool='RA-V') tp, count(*) FILTER (pool='MP-V') fp, count(*) FILTER (pool='Docked-V') fn FROM pooled GROUP BY tomo) SELECT tomo, round(tp/(tp+fp),6) AS precision, round(tp/(tp+fn),6) AS recall, round(2*tp/(2*tp+fp+fn),6) AS f1 FROM t""")(
    lambda s, d: R.micro_scores(pooled(s, d).select("tomo", *[(F.col("pool") == p).cast("int").alias(c) for p, c in (("RA-V", "tp"), ("MP-V", "fp"), ("Docked-V", "fn"))]), ["tomo"]).select("tomo", r6("precision", "precision"), r6("recall", "recall"), r6("f1", "f1"))
)
query("histogram", f"{MEAS} SELECT CAST(least(15, floor((radius-5)/(25/16.0))) AS INTEGER) AS bin, count(*) AS n FROM meas WHERE radius BETWEEN 5 AND 30 GROUP BY ALL")(lambda s, d: R.histogram(measurements(s, d), "radius", 5, 30, 16))
query("confusion", f"""{POOLED}, x AS (SELECT pool, CASE WHEN ribbon_distance < 90 THEN 'RA-V' ELSE 'unassigned' END AS other FROM pooled) SELECT pool, count(*) FILTER (other='RA-V') AS "RA-V", count(*) FILTER (other='unassigned') AS unassigned FROM x GROUP BY pool""")(lambda s, d: R.confusion(pooled(s, d).withColumn("other", F.when(F.col("ribbon_distance") < 90, "RA-V").otherwise("unassigned")), "pool", "other", ["RA-V", "unassigned"]))
query("uniqueness", f"{MEAS} SELECT count(DISTINCT radius) AS n_distinct, count(radius) AS n, round(count(DISTINCT radius)/count(radius),9) AS share FROM meas")(lambda s, d: R.uniqueness(measurements(s, d), "radius").select("n_distinct", "n", F.round("share", 9).alias("share")))
query("accuracy", f"{POOLED} SELECT round(avg(CASE WHEN pool = CASE WHEN ribbon_distance < 90 THEN 'RA-V' ELSE 'unassigned' END THEN 1.0 ELSE 0 END),9) AS accuracy FROM pooled")(lambda s, d: R.accuracy(pooled(s, d).withColumn("other", F.when(F.col("ribbon_distance") < 90, "RA-V").otherwise("unassigned")), "pool", "other").select(F.round("accuracy", 9).alias("accuracy")))
query("top_n_per_group", f"{MEAS} SELECT *, row_number() OVER (PARTITION BY tomo ORDER BY ribbon_distance, id) AS rank FROM meas QUALIFY rank <= 3")(lambda s, d: R.top_n(measurements(s, d), ["tomo"], 3, "ribbon_distance", "id"))
query("split_tasks", f"{MEAS} SELECT tomo, id, ntile(7) OVER (PARTITION BY tomo ORDER BY id) - 1 AS task FROM meas")(lambda s, d: R.split_tasks(measurements(s, d), 7, "id", ["tomo"]).select("tomo", "id", "task"))
query("ordered_split", f"{MEAS}, k AS (SELECT tomo, id, count(*) OVER (PARTITION BY tomo) n, row_number() OVER (PARTITION BY tomo ORDER BY id) k FROM meas) SELECT tomo, id, CASE WHEN k <= floor(n*0.8) THEN 'train' WHEN k <= floor(n*0.8)+floor(n*0.1) THEN 'val' ELSE 'test' END AS split FROM k")(lambda s, d: R.ordered_split(measurements(s, d), "id", ["tomo"]).select("tomo", "id", "split"))
query("standardise", f"{MEAS} SELECT tomo, id, round((radius - avg(radius) OVER (PARTITION BY tomo))/stddev_pop(radius) OVER (PARTITION BY tomo),6) AS radius_standard FROM meas")(lambda s, d: R.standardise(measurements(s, d), "radius", ["tomo"]).select("tomo", "id", r6("radius_standard", "radius_standard")))
query("upsert", f"{MEAS}, n AS (SELECT tomo, id, radius+1 AS radius FROM meas WHERE id % 5 = 0) SELECT tomo, id, radius FROM meas WHERE id % 5 <> 0 UNION ALL SELECT * FROM n")(lambda s, d: R.upsert(measurements(s, d).select("tomo", "id", "radius"), measurements(s, d).where("id % 5 = 0").select("tomo", "id", (F.col("radius") + 1).alias("radius")), ["tomo", "id"]))
query("missing_work", f"{MEAS} SELECT tomo, id FROM meas WHERE NOT (id % 3 = 0)")(lambda s, d: R.missing(measurements(s, d).select("tomo", "id"), measurements(s, d).where("id % 3 = 0"), ["id"]))
query("key_mismatch", "SELECT c_custkey AS k, 'left' AS only_in FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")(lambda s, d: R.key_mismatch(table(s, d, "customer").select(F.col("c_custkey").alias("k")), table(s, d, "orders").select(F.col("o_custkey").alias("k")), ["k"]))
query("merge_update", "SELECT coalesce(o.k, c.k) AS k, coalesce(o.v, c.v) AS v FROM (SELECT c_custkey k, c_acctbal v FROM customer) c FULL JOIN (SELECT o_custkey k, max(o_totalprice) v FROM orders GROUP BY ALL) o ON o.k = c.k")(lambda s, d: R.merge_update(table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v")), ["k"]))
query("zip_by_order", "WITH c AS (SELECT c_nationkey n, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) p FROM customer), q AS (SELECT s_nationkey n, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) p FROM supplier) SELECT n, p AS position, c_custkey, s_suppkey FROM c JOIN q USING (n, p)")(lambda s, d: R.zip_by_order(table(s, d, "customer").select(F.col("c_nationkey").alias("n"), "c_custkey"), table(s, d, "supplier").select(F.col("s_nationkey").alias("n"), "s_suppkey"), "c_custkey", "s_suppkey", ["n"]))
query("first_equal_content", "SELECT a.doc_id AS a, min(b.doc_id) AS b FROM documents a JOIN documents b ON a.text = b.text GROUP BY a.doc_id")(lambda s, d: R.first_equal_content(table(s, d, "documents").select(F.col("doc_id").alias("a"), "text"), table(s, d, "documents").select(F.col("doc_id").alias("b"), "text"), "text", "a", "b"))
query("keyword_hits", "SELECT term, count(*) AS hits, count(DISTINCT p_brand) AS datasets FROM part, (VALUES ('a'),('e'),('part'),('10')) t(term) WHERE contains(lower(p_name), term) AND NOT regexp_full_match(p_name, '\\s*\\d+\\s*') GROUP BY term")(lambda s, d: R.keyword_hits(table(s, d, "part"), ["a", "e", "part", "10"], "p_name", "p_brand"))
query("deviating_values", "WITH v AS (SELECT l_returnflag AS k, list_sort(list(DISTINCT l_quantity)) AS vs FROM lineitem GROUP BY ALL) SELECT k, len(vs) AS n, vs[1] AS first FROM v WHERE len(vs) > 1")(lambda s, d: R.deviating(table(s, d, "lineitem").select(F.col("l_returnflag").alias("k"), "l_quantity"), "k", "l_quantity").select("k", F.size("values").cast("long").alias("n"), F.col("values")[0].alias("first")))
query("ragged_pivot", f"""{POOLED}, n AS (SELECT pool, radius, row_number() OVER (PARTITION BY pool ORDER BY radius) AS k FROM pooled) SELECT k AS row, max(radius) FILTER (pool='RA-V') AS "RA-V", max(radius) FILTER (pool='Docked-V') AS "Docked-V" FROM n WHERE pool IN ('RA-V','Docked-V') GROUP BY k""")(lambda s, d: R.ragged_pivot(pooled(s, d).where(F.col("pool").isin("RA-V", "Docked-V")), "pool", "radius", ["RA-V", "Docked-V"]))
query("update_pool", f"{POOLED} SELECT id, 'checked' AS pool FROM pooled WHERE id % 11 = 0 UNION ALL SELECT id, pool FROM pooled WHERE id % 11 <> 0")(lambda s, d: R.update_pool(pooled(s, d).select("id", "pool"), measurements(s, d).where("id % 11 = 0"), "checked"))
query("correct_pools", f"{POOLED} SELECT id, CASE WHEN id % 6 = 0 THEN pool WHEN id % 3 = 0 THEN 'RA-V' WHEN id % 2 = 0 THEN 'MP-V' ELSE pool END AS pool FROM pooled")(
    lambda s, d: R.correct_pools(pooled(s, d).select("id", "pool"), measurements(s, d).where("id % 3 = 0").select("id", F.lit(1).alias("value")).unionByName(measurements(s, d).where("id % 2 = 0").select("id", F.lit(2).alias("value"))), {1: "RA-V", 2: "MP-V"})
)
query("status_table", "SELECT c_custkey, n_orders, CASE WHEN n_orders IS NULL THEN 'missing' WHEN n_orders = 0 THEN 'empty' ELSE 'ok' END AS status FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) FILTER (o_orderstatus='F') AS n_orders FROM orders GROUP BY ALL) USING (c_custkey)")(lambda s, d: R.status_table(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_orders")), ["c_custkey"], "n_orders"))
query("union_tagged", "SELECT c_custkey AS k, 'customer' AS origin FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")(lambda s, d: R.union_tagged({"customer": table(s, d, "customer").select(F.col("c_custkey").alias("k")), "supplier": table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))}))
query("json_props", "SELECT event_type, count(*) AS n, count(*) FILTER (props IS NULL) AS n_null FROM events GROUP BY ALL")(lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("props").isNull()).alias("n_null")))


# -- analyses --------------------------------------------------------------

VESICLE_POOL_SQL = "CASE WHEN pd_distance < 100 AND boundary_distance < 2 THEN 'Docked-V' WHEN ribbon_distance < 80 AND boundary_distance < 50 THEN 'MP-V' WHEN ribbon_distance < 80 THEN 'RA-V' ELSE 'unassigned' END"
query("vesicle_pools", f"{MEAS} SELECT tomo, {VESICLE_POOL_SQL} AS pool, count(*) AS n, round(avg(radius),6) AS mean_radius FROM meas GROUP BY ALL")(lambda s, d: A.assign_vesicle_pools(measurements(s, d)).groupBy("tomo", "pool").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("radius"), "mean_radius")))
query("inside_fraction", f"{GT} SELECT tomo, label, CAST(count(*)*8 AS DOUBLE) AS volume, CAST(count(g)*8 AS DOUBLE) AS inner_volume, round(count(g)/count(*),6) AS fraction FROM vox LEFT JOIN (SELECT tomo,z,y,x,1 AS g FROM gt) USING (tomo,z,y,x) GROUP BY ALL")(lambda s, d: A.inside_fraction(voxels(s, d), truth(s, d), 8.0).select("tomo", "label", "volume", "inner_volume", r6("fraction", "fraction")))
query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY ALL")(lambda s, d: ingest.windowed_counts(table(s, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total")))

# -- sites, regions and reports --------------------------------------------

query("object_statistics", f"""{GT}, {OFFSETS_SQL}, ins AS (SELECT vox.* FROM vox SEMI JOIN gt USING (tomo,z,y,x)), n AS (SELECT tomo, label, count(*) n, avg(z) cz, avg(y) cy, avg(x) cx FROM vox GROUP BY ALL),
 i AS (SELECT tomo, label, count(*) n, avg(z) cz, avg(y) cy, avg(x) cx FROM ins GROUP BY ALL),
 f AS (SELECT tomo, label, CAST(count(*) AS DOUBLE) a FROM (SELECT tomo, z+dz AS z, y+dy AS y, x+dx AS x, label FROM vox, off) q ANTI JOIN vox USING (tomo,z,y,x,label) GROUP BY ALL),
 g AS (SELECT tomo, label, CAST(count(*) AS DOUBLE) a FROM (SELECT tomo, z+dz AS z, y+dy AS y, x+dx AS x, label FROM ins, off) q ANTI JOIN ins USING (tomo,z,y,x,label) GROUP BY ALL)
 SELECT n.tomo, n.label, CAST(n.n AS DOUBLE) AS volume, f.a AS surface, CAST(coalesce(i.n,0) AS DOUBLE) AS inner_volume, coalesce(g.a,0) AS inner_surface, round(coalesce(i.n,0)/n.n,6) AS inner_share,
 round(coalesce(g.a,0)/n.n,6) AS surface_density, round(i.cz-n.cz,6) AS offset_z, round(i.cy-n.cy,6) AS offset_y, round(i.cx-n.cx,6) AS offset_x
 FROM n JOIN f USING (tomo, label) LEFT JOIN i USING (tomo, label) LEFT JOIN g USING (tomo, label)""")(
    lambda s, d: S.object_statistics(voxels(s, d), truth(s, d)).select("tomo", "label", "volume", "surface", "inner_volume", "inner_surface", *[r6(c, c) for c in ("inner_share", "surface_density", "offset_z", "offset_y", "offset_x")])
)
PER_REGION = f"{GT}, r AS (SELECT gt.tomo, gt.label AS region, count(DISTINCT vox.label) AS n FROM gt JOIN vox USING (tomo,z,y,x) GROUP BY ALL)"
query("objects_per_region", f"{PER_REGION} SELECT * FROM r")(lambda s, d: S.objects_per_region(truth(s, d), voxels(s, d)))
query("fullest_region", f"{PER_REGION} SELECT tomo, region, n FROM r QUALIFY row_number() OVER (PARTITION BY tomo ORDER BY n DESC, region) = 1")(lambda s, d: S.fullest_region(truth(s, d), voxels(s, d)))
query("presynaptic_mask", f"""{GT}, r AS (SELECT gt.tomo, gt.z, gt.label AS region, count(DISTINCT vox.label) AS n FROM gt JOIN vox USING (tomo,z,y,x) GROUP BY ALL),
 b AS (SELECT tomo, z, region FROM r QUALIFY row_number() OVER (PARTITION BY tomo, z ORDER BY n DESC, region) = 1) SELECT gt.tomo, gt.z, gt.y, gt.x FROM gt JOIN b ON b.tomo = gt.tomo AND b.z = gt.z AND b.region = gt.label""")(lambda s, d: S.presynaptic_mask(truth(s, d), voxels(s, d), 0).select(*V.POS))
query("size_filter_large", f"{VOX} SELECT * FROM vox SEMI JOIN (SELECT tomo, label FROM vox GROUP BY ALL HAVING count(*) >= 95) USING (tomo, label)")(lambda s, d: V.size_filter(voxels(s, d), 95))
query("size_filter_strict_large", f"{VOX} SELECT * FROM vox SEMI JOIN (SELECT tomo, label FROM vox GROUP BY ALL HAVING count(*) > 95) USING (tomo, label)")(lambda s, d: V.size_filter(voxels(s, d), 95, strict=True))
query("size_filter_to_mask", f"{VOX} SELECT tomo, z, y, x FROM vox SEMI JOIN (SELECT tomo, label FROM vox GROUP BY ALL HAVING count(*) >= 95) USING (tomo, label)")(lambda s, d: S.binary_size_filter(voxels(s, d), 95))
query("z_extent_of_slices", f"{VOX}, s AS (SELECT * FROM vox WHERE (z + label) % 3 <> 0) SELECT * FROM s SEMI JOIN (SELECT tomo, label FROM s GROUP BY ALL HAVING max(z)-min(z)+1 >= 6) USING (tomo, label)")(lambda s, d: V.z_extent_filter(voxels(s, d).where("(z + label) % 3 <> 0"), 6))
query("in_mask_boundary", f"{GT}, {OFFSETS_SQL}, c AS (SELECT tomo, z+dz AS z, y+dy AS y, x+dx AS x, count(*) n FROM gt, off GROUP BY ALL), e AS (SELECT gt.tomo, gt.z, gt.y, gt.x FROM gt LEFT JOIN c USING (tomo,z,y,x) WHERE coalesce(n,0) < 6) SELECT vox.* FROM vox SEMI JOIN e USING (tomo,z,y,x)")(lambda s, d: S.in_mask_boundary(voxels(s, d), truth(s, d)))
FIRST = f"{GT}, f AS (SELECT * FROM vox QUALIFY row_number() OVER (PARTITION BY tomo, label ORDER BY z, y, x) = 1), m AS (SELECT f.tomo, f.label, coalesce(gt.label, 0) AS value FROM f LEFT JOIN gt USING (tomo,z,y,x))"
query("value_at_first_voxel", f"{FIRST} SELECT * FROM m")(lambda s, d: S.value_at_first_voxel(voxels(s, d), truth(s, d)))
query("map_labels", f"{FIRST} SELECT vox.tomo, z, y, x, value AS label FROM vox JOIN m USING (tomo, label) WHERE value <> 0")(lambda s, d: S.map_labels(voxels(s, d), S.value_at_first_voxel(voxels(s, d), truth(s, d))))
query("close_along_z", f"""{VOX}, g AS (SELECT DISTINCT tomo, z+i AS z, y, x, label FROM vox, range(-1,2) t(i)), c AS (SELECT g.* FROM g SEMI JOIN (SELECT tomo, z+1 AS z, y, x, label FROM g) USING (tomo,z,y,x,label)), e AS (SELECT c.* FROM c SEMI JOIN (SELECT tomo, z-1 AS z, y, x, label FROM g) USING (tomo,z,y,x,label))
 SELECT tomo, CAST(z AS INTEGER) AS z, y, x, max(label) AS label FROM (SELECT * FROM e UNION SELECT tomo, z, y, x, label FROM vox) GROUP BY ALL""")(lambda s, d: S.close_along_z(voxels(s, d), 1))
query("closing", f"""{NEAR}, d AS (SELECT * FROM vox UNION ALL (SELECT tomo,z,y,x,max(label) AS label FROM near ANTI JOIN vox USING (tomo,z,y,x) GROUP BY ALL)), n2 AS (SELECT tomo, z+dz AS z, y+dy AS y, x+dx AS x, label, count(*) n FROM d, off GROUP BY ALL),
 e AS (SELECT d.* FROM d JOIN n2 USING (tomo,z,y,x,label) WHERE n = 6) SELECT * FROM vox UNION ALL SELECT e.* FROM e ANTI JOIN vox USING (tomo,z,y,x)""")(lambda s, d: V.closing(voxels(s, d)))
query("crop_around_mean", f"{VOX}, m AS (SELECT tomo, CAST(floor(avg(z)) AS INT) mz, CAST(floor(avg(y)) AS INT) my, CAST(floor(avg(x)) AS INT) mx FROM vox GROUP BY tomo) SELECT vox.* FROM vox JOIN m USING (tomo) WHERE z >= mz-2 AND z < mz+2 AND y >= my-10 AND y < my+10 AND x >= mx-10 AND x < mx+10")(lambda s, d: S.crop_around_mean(voxels(s, d), (2, 10, 10)))
query("labels_to_points", f"{VOX}, p AS (SELECT tomo, label, z, count(*) n, avg(y) y, avg(x) x FROM vox GROUP BY ALL) SELECT tomo, label AS id, z, round(y,6) AS y, round(x,6) AS x, round(sqrt(n/pi())*1.2,6) AS radius FROM p QUALIFY row_number() OVER (PARTITION BY tomo, label ORDER BY n DESC, z) = 1")(lambda s, d: S.labels_to_points(voxels(s, d), 0.0, 1.2).select("tomo", "id", "z", r6("y", "y"), r6("x", "x"), r6("radius", "radius")))
query("label_counts", f"{VOX} SELECT t.tomo, CAST((SELECT count(DISTINCT label) FROM vox WHERE vox.tomo = t.tomo) AS BIGINT) AS n FROM (VALUES ('tomo0'),('tomo1'),('tomo2'),('tomo3')) t(tomo)")(lambda s, d: S.label_counts(voxels(s, d), s.createDataFrame([(f"tomo{k}",) for k in range(4)], "tomo string")))
query("count_report", "SELECT p_brand AS dataset, count(DISTINCT p_name) AS tomograms, count(*) FILTER (p_size > 25) AS manual, count(*) AS total FROM part WHERE NOT starts_with(p_name, 'a') AND NOT starts_with(p_name, 's') GROUP BY p_brand")(lambda s, d: S.count_report(table(s, d, "part").select(F.col("p_brand").alias("dataset"), F.col("p_name").alias("name"), (F.col("p_size") > 25).alias("manual")), ["a", "s"]))
query("outside_domain", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS NULL OR lower(trim(o_orderstatus)) NOT IN ('f', 'o')")(lambda s, d: S.outside_domain(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["f", "o"]))
query("shift_ids", "SELECT c_nationkey AS tomo, c_custkey + CASE n_name WHEN 'FRANCE' THEN 2 WHEN 'GERMANY' THEN 3 ELSE 0 END AS id FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")(lambda s, d: S.shift_ids(table(s, d, "customer").select(F.col("c_nationkey").alias("tomo"), F.col("c_custkey").alias("id")), table(s, d, "nation").select(F.col("n_nationkey").alias("tomo"), F.lit(4).alias("id"), F.col("n_name").alias("name")), 4, {"FRANCE": 2, "GERMANY": 3}).select("tomo", "id"))
query("with_parameters", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1")(lambda s, d: S.with_parameters(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), table(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("k"), "n_name"), ["k"]).select("c_custkey", "n_name"))
query("first_rating", "SELECT o_custkey FROM (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) r FROM orders GROUP BY ALL) WHERE r = 'F'")(lambda s, d: S.first_rating(table(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("rating")), ["o_custkey"], "o_orderkey", "F"))
SURFACE = "sa AS (SELECT tomo,z,y,x FROM vox p WHERE (SELECT count(*) FROM off JOIN vox q ON q.tomo=p.tomo AND q.z=p.z+dz AND q.y=p.y+dy AND q.x=p.x+dx) < 6), sb AS (SELECT tomo,z,y,x FROM gt p WHERE (SELECT count(*) FROM off JOIN gt q ON q.tomo=p.tomo AND q.z=p.z+dz AND q.y=p.y+dy AND q.x=p.x+dx) < 6)"
query("surface_dice", f"""{GT}, {OFFSETS_SQL}, {SURFACE}, o7 AS (SELECT * FROM off UNION ALL SELECT 0,0,0), na AS (SELECT tomo, count(*) n FROM sa SEMI JOIN (SELECT tomo, z+dz AS z, y+dy AS y, x+dx AS x FROM sb, o7) USING (tomo,z,y,x) GROUP BY tomo), nb AS (SELECT tomo, count(*) n FROM sb SEMI JOIN (SELECT tomo, z+dz AS z, y+dy AS y, x+dx AS x FROM sa, o7) USING (tomo,z,y,x) GROUP BY tomo)
 SELECT a.tomo, round((na.n+nb.n)/(a.n+b.n),6) AS surface_dice FROM (SELECT tomo, count(*) n FROM sa GROUP BY tomo) a JOIN (SELECT tomo, count(*) n FROM sb GROUP BY tomo) b USING (tomo) JOIN na USING (tomo) JOIN nb USING (tomo)""")(lambda s, d: S.surface_dice(voxels(s, d), truth(s, d), 1.0).select("tomo", r6("surface_dice", "surface_dice")))
IMAGE_SQL = f"img AS (SELECT 'tomo' || CAST(l_orderkey // {ORDERS} AS VARCHAR) AS tomo, CAST(l_linenumber AS INTEGER) AS z, CAST(l_partkey % 64 AS INTEGER) AS y, CAST(l_suppkey * 7 % 64 AS INTEGER) AS x, CAST(max(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"


def image(s, d):
    at = F.concat(F.lit("tomo"), F.floor(F.col("l_orderkey") / ORDERS).cast("string")).alias("tomo"), F.col("l_linenumber").cast("int").alias("z"), (F.col("l_partkey") % 64).cast("int").alias("y"), (F.col("l_suppkey") * 7 % 64).cast("int").alias("x")
    return table(s, d, "lineitem").groupBy(*at).agg(F.max("l_quantity").cast("double").alias("value"))


EDGES_SQL = f"WITH {IMAGE_SQL}, o(dy, dx) AS (SELECT a, b FROM range(-1,2) i(a), range(-1,2) j(b) WHERE a <> 0 OR b <> 0), n AS (SELECT tomo, z, CAST(y-dy AS INTEGER) AS y, CAST(x-dx AS INTEGER) AS x, dy, dx, value AS v FROM img, o)"
query("edge_laplace", f"{EDGES_SQL}, s AS (SELECT tomo, z, y, x, sum(v) AS v FROM n WHERE dy*dx = 0 GROUP BY ALL HAVING count(*) = 4) SELECT tomo, z, y, x, round(s.v-4*value,6) AS edge FROM s JOIN img USING (tomo,z,y,x)")(lambda s, d: S.laplace(image(s, d)).select(*V.POS, r6("edge", "edge")))
query("edge_sobel", f"{EDGES_SQL}, s AS (SELECT tomo, z, y, x, sum(v*dy*(2-abs(dx))) AS gy, sum(v*dx*(2-abs(dy))) AS gx FROM n GROUP BY ALL HAVING count(*) = 8) SELECT tomo, z, y, x, round(sqrt(gy*gy+gx*gx),6) AS edge FROM s SEMI JOIN img USING (tomo,z,y,x)")(lambda s, d: S.gradient(image(s, d)).select(*V.POS, r6("edge", "edge")))
query("refine_shapes")(lambda s, d: S.refine_shapes(V.dilate(voxels(s, d)), image(s, d).select(*V.POS, F.col("value").alias("edge")), 1, 2, 25.0))
query("id_list", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 9, 77)")(lambda s, d: table(s, d, "customer").where(F.col("c_custkey").isin(1, 5, 9, 77)).select("c_custkey", "c_name"))
query("prefix_filter", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'a') OR starts_with(p_name, 'b')")(lambda s, d: table(s, d, "part").where(F.col("p_name").startswith("a") | F.col("p_name").startswith("b")).select("p_partkey", "p_name"))
query("name_groups", "SELECT CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'first' WHEN contains(o_orderpriority, 'LOW') THEN 'last' ELSE 'middle' END AS grp, count(*) AS n FROM orders GROUP BY 1")(lambda s, d: table(s, d, "orders").groupBy(F.when(F.col("o_orderpriority").contains("URGENT"), "first").when(F.col("o_orderpriority").contains("LOW"), "last").otherwise("middle").alias("grp")).agg(F.count(F.lit(1)).alias("n")))
query("semi_by_list", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")(lambda s, d: table(s, d, "orders").join(table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_custkey").distinct())
query("intersect_keys", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")(lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))))
query("union_keys", "SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier")(lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k")).union(table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))).distinct())
query("ratio_of_sums", "SELECT l_returnflag, round(sum(l_discount)/sum(l_quantity),9) AS ratio FROM lineitem GROUP BY l_returnflag")(lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_discount") / F.sum("l_quantity"), 9).alias("ratio")))
query("sorted_ranks", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier QUALIFY place <= 50")(lambda s, d: R.first_rows(table(s, d, "supplier"), 50, F.desc("s_acctbal"), "s_suppkey").select("s_suppkey", F.col("rank").alias("place")))


from voxelgrain import catalog_shapes, catalog_segments  # noqa: E402, F401, I001  they add their queries to these


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
