"""Queries on components, lines, shapes and joins, with their SQL oracles.

``catalog`` imports this module, which adds its queries to those of the catalog.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelgrain.catalog import BOTH, IMAGE_SQL, OFFSETS_SQL, VOX, image, query, r6
from voxelgrain.functions import scalar as X
from voxelgrain.operators import components as C
from voxelgrain.operators import distance as D
from voxelgrain.operators import kernels as K
from voxelgrain.operators import relational as R
from voxelgrain.operators import volume as V
from voxelgrain.plans import analysis as A
from voxelgrain.plans import sites as S
from voxelgrain.views import MEASURES_SQL, SHAPE, STRUCTURE_SQL, TRUTH_SQL, VOXELS_SQL, measurements, structure, table, truth, vesicles, voxels

AT = "tomo, z, y, x"


def components_sql(source: str, name: str, full: bool = True) -> str:
    """CTEs that end in ``name``: the rows of ``source`` with their component."""
    steps = "SELECT a, b, c FROM range(-1,2) i(a), range(-1,2) j(b), range(-1,2) k(c)" if full else "VALUES (-1,0,0),(1,0,0),(0,-1,0),(0,1,0),(0,0,-1),(0,0,1)"
    return f"""{name}_v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {AT}) AS id FROM {source}), {name}_o(dz, dy, dx) AS ({steps}),
 {name}_e AS MATERIALIZED (SELECT s.id AS a, t.id AS b FROM (SELECT id, tomo, z+dz AS z, y+dy AS y, x+dx AS x FROM {name}_v, {name}_o) s JOIN {name}_v t USING ({AT})),
 {name}_r(id, m) USING KEY (id) AS (SELECT id, id FROM {name}_v UNION SELECT e.b, min(r.m) FROM {name}_r r JOIN {name}_e e ON e.a = r.id JOIN recurring.{name}_r old ON old.id = e.b WHERE r.m < old.m GROUP BY e.b),
 {name} AS (SELECT v.* EXCLUDE (id), dense_rank() OVER (PARTITION BY tomo ORDER BY m) AS component FROM {name}_v v JOIN {name}_r USING (id))"""


REC = f"WITH RECURSIVE {VOXELS_SQL}"

# -- components ------------------------------------------------------------

ALL_PARTS = f"{REC}, {components_sql('vox', 'c')}"
query("connected_components", f"{ALL_PARTS} SELECT {AT}, component FROM c")(lambda s, d: C.components(voxels(s, d)))
query("largest_component", f"{ALL_PARTS}, n AS (SELECT tomo, component, count(*) AS n FROM c GROUP BY ALL) SELECT {AT} FROM c SEMI JOIN (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY tomo ORDER BY n DESC, component) = 1) USING (tomo, component)")(lambda s, d: C.largest_component(voxels(s, d)))
query("components_size_filter", f"{ALL_PARTS} SELECT {AT}, component AS label FROM c SEMI JOIN (SELECT tomo, component FROM c GROUP BY ALL HAVING count(*) >= 5) USING (tomo, component)")(lambda s, d: C.components_filtered(voxels(s, d), 5).select(*V.POS, "label"))

BY_FACES = f"{REC}, {components_sql('vox', 'c', full=False)}"
query("split_and_restore", f"{BY_FACES} SELECT {AT}, label FROM c SEMI JOIN (SELECT tomo, component FROM c GROUP BY ALL HAVING count(*) >= 6) USING (tomo, component)")(lambda s, d: C.split_and_restore(voxels(s, d), 6).select(*V.POS, "label"))


def _box_sql(axis: str, least: int, end: int) -> str:
    short = f"greatest(0, {least} - (max({axis}) + 1 - min({axis})))"
    return f"CAST(greatest(0, min({axis}) - {short} // 2) AS INTEGER) AS lo_{axis}, CAST(least({end}, max({axis}) + 1 + ({short} + 1) // 2) AS INTEGER) AS hi_{axis}"


query("component_boxes", f"{BY_FACES} SELECT tomo, component, count(*) AS size, {_box_sql('z', 4, SHAPE[0])}, {_box_sql('y', 16, SHAPE[1])}, {_box_sql('x', 16, SHAPE[2])} FROM c GROUP BY tomo, component HAVING count(*) > 2")(
    lambda s, d: S.component_boxes(voxels(s, d), 2, (4, 16, 16), SHAPE)
)
query("contact_sites", f"""{REC}, {STRUCTURE_SQL}, {OFFSETS_SQL}, reach AS (SELECT tomo, z+dz AS z, y+dy AS y, x+dx AS x FROM structure, off UNION ALL SELECT {AT} FROM structure), t AS (SELECT DISTINCT {AT} FROM ves SEMI JOIN reach USING ({AT})), {components_sql('t', 'c')}
 SELECT tomo, count(DISTINCT component) AS n_sites, CAST(count(component) * 8 AS DOUBLE) AS volume FROM (SELECT DISTINCT tomo FROM ves) LEFT JOIN c USING (tomo) GROUP BY tomo""")(lambda s, d: S.contact_sites(vesicles(s, d), structure(s, d), 8.0)[1])

PARTS = f"{REC}, {STRUCTURE_SQL}, {components_sql('structure', 'c', full=False)}"
TO_PARTS = f"{PARTS}, n AS (SELECT a.tomo, a.label, b.component, (a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x) AS d2, a.z*4096+a.y*64+a.x AS pa, b.z*4096+b.y*64+b.x AS pb FROM ves a JOIN c b ON a.tomo = b.tomo)"
query("select_structures", f"""{TO_PARTS}, m AS (SELECT tomo, label, arg_min(component, (d2::BIGINT << 30) + (pa::BIGINT << 15) + pb) AS component, min(d2) AS d2 FROM n GROUP BY ALL), k AS (SELECT tomo, component, count(*) AS objects FROM m WHERE d2 <= 36 GROUP BY ALL),
 top AS (SELECT tomo, component, row_number() OVER (PARTITION BY tomo ORDER BY objects DESC, component) AS rank FROM k QUALIFY rank <= 2)
 SELECT {AT}, rank AS label FROM c JOIN top USING (tomo, component) UNION ALL SELECT {AT}, component FROM c WHERE tomo NOT IN (SELECT tomo FROM top)""")(lambda s, d: A.select_structures(structure(s, d), vesicles(s, d), 6.0, 2, connectivity=1))
query("membrane_near", f"""{TO_PARTS}, d AS (SELECT tomo, component, sqrt(min(d2)) >= 2 AS far FROM n GROUP BY ALL), s AS (SELECT tomo, component, count(*) AS size FROM c GROUP BY ALL),
 f AS (SELECT * FROM s JOIN d USING (tomo, component) QUALIFY far = bool_and(far) OVER (PARTITION BY tomo)), top AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY tomo ORDER BY size DESC, component) <= 2)
 SELECT {AT} FROM c SEMI JOIN top USING (tomo, component)""")(lambda s, d: A.membrane_near(structure(s, d), vesicles(s, d), 2.0, 2, connectivity=1))
query("evaluate_components", f"""{REC}, {TRUTH_SQL}, {STRUCTURE_SQL}, g7 AS (SELECT * FROM gt WHERE label % 7 = 0), {components_sql('structure', 'p')}, {components_sql('g7', 'q')},
 a AS (SELECT {AT}, component AS la FROM p SEMI JOIN (SELECT tomo, component FROM p GROUP BY ALL HAVING count(*) >= 2) USING (tomo, component)), b AS (SELECT {AT}, component AS lb FROM q SEMI JOIN (SELECT tomo, component FROM q GROUP BY ALL HAVING count(*) >= 2) USING (tomo, component)),
 sa AS (SELECT tomo, la, count(*) AS a FROM a GROUP BY ALL), sb AS (SELECT tomo, lb, count(*) AS b FROM b GROUP BY ALL), o AS (SELECT tomo, la, lb, count(*) AS n FROM a JOIN b USING ({AT}) GROUP BY ALL), sc AS (SELECT *, n/(a+b-n) AS iou FROM o JOIN sa USING (tomo, la) JOIN sb USING (tomo, lb)),
 r AS (SELECT *, row_number() OVER (PARTITION BY tomo, la ORDER BY iou DESC, lb) AS ra, row_number() OVER (PARTITION BY tomo, lb ORDER BY iou DESC, la) AS rb FROM sc WHERE iou >= 0.1), tp AS (SELECT tomo, count(*) AS tp FROM r WHERE ra = 1 AND rb = 1 GROUP BY tomo),
 t AS (SELECT tomo, na, va, nb, vb FROM (SELECT tomo, count(*) AS na, sum(a) AS va FROM sa GROUP BY tomo) FULL JOIN (SELECT tomo, count(*) AS nb, sum(b) AS vb FROM sb GROUP BY tomo) USING (tomo))
 SELECT tomo, coalesce(tp, 0) AS tp, coalesce(na, 0) - coalesce(tp, 0) AS fp, coalesce(nb, 0) - coalesce(tp, 0) AS fn, round(2 * coalesce((SELECT sum(n) FROM o WHERE o.tomo = t.tomo), 0) / (coalesce(va, 0) + coalesce(vb, 0)), 6) AS dice FROM t LEFT JOIN tp USING (tomo)""")(
    lambda s, d: A.evaluate(structure(s, d), truth(s, d).where("label % 7 = 0"), 2, 2, limit=0.1, mutual=True).select("tomo", "tp", "fp", "fn", r6("dice", "dice"))
)

# -- pairs and lines -------------------------------------------------------

#: Least squared distance and its first end points in one number: 15 bits for each point.
PAIRS = f"""{VOX}, n AS (SELECT a.tomo, a.label AS id_a, b.label AS id_b, min((((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))::BIGINT << 30) + ((a.z*4096+a.y*64+a.x)::BIGINT << 15) + (b.z*4096+b.y*64+b.x)) AS k
 FROM vox a JOIN vox b ON a.tomo = b.tomo AND a.label < b.label GROUP BY ALL),
 u AS (SELECT tomo, id_a, id_b, k >> 30 AS d2, (k >> 15) & 32767 AS pa, k & 32767 AS pb FROM n WHERE (k >> 30) <= 400),
 p AS (SELECT tomo, id_a, id_b, sqrt(d2) AS distance, pa // 4096 AS az, pa // 64 % 64 AS ay, pa % 64 AS ax, pb // 4096 AS bz, pb // 64 % 64 AS by_, pb % 64 AS bx FROM u)"""
query("pairwise_distances", f"{PAIRS} SELECT tomo, id_a, id_b, round(distance,6) AS distance FROM p")(lambda s, d: D.pairwise(voxels(s, d), 20.0).select("tomo", "id_a", "id_b", r6("distance", "distance")))
query("nearest_neighbours", f"""{PAIRS}, b AS (SELECT tomo, id_a AS id, id_b AS o, distance FROM p UNION ALL SELECT tomo, id_b, id_a, distance FROM p)
 SELECT DISTINCT tomo, least(id,o) AS id_a, greatest(id,o) AS id_b, round(distance,6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY tomo, id ORDER BY distance, o) AS k FROM b) WHERE k <= 2""")(lambda s, d: D.neighbours(D.pairwise(voxels(s, d), 20.0), 2).select("tomo", "id_a", "id_b", r6("distance", "distance")))
query("distance_lines", f"{PAIRS} SELECT tomo, id_a, id_b, round_even(distance,2) AS distance, {', '.join(f'CAST({p}{c} // 2 AS INTEGER) AS {e}_{n}' for p, e in (('a', 'begin'), ('b', 'end')) for c, n in (('z', 'z'), ('y_' if p == 'b' else 'y', 'y'), ('x', 'x')))} FROM p")(
    lambda s, d: D.lines(D.pairwise(voxels(s, d), 20.0), 2)
)
query("lines_in_box", f"{PAIRS} SELECT tomo, id_a, id_b, CAST(ay-10 AS INTEGER) AS begin_y, CAST(by_-10 AS INTEGER) AS end_y FROM p WHERE least(az,bz) > 0 AND greatest(az,bz) < 8 AND least(ay,by_) > 10 AND greatest(ay,by_) < 50 AND least(ax,bx) > 10 AND greatest(ax,bx) < 50")(
    lambda s, d: D.lines_in_box(D.lines(D.pairwise(voxels(s, d), 20.0)), (0, 10, 10), (8, 50, 50)).select("tomo", "id_a", "id_b", "begin_y", "end_y")
)
LINE = f"""{PAIRS}, l AS (SELECT *, greatest(abs(az-bz), abs(ay-by_), abs(ax-bx)) AS n FROM p), t AS (SELECT l.*, unnest(range(0, n+1)) AS t FROM l),
 ln AS (SELECT tomo, id_a, id_b, {', '.join(f'CAST(floor(a{c} + (b{c}{u} - a{c}) * t / greatest(n, 1) + 0.5) AS INTEGER) AS {c}' for c, u in (('z', ''), ('y', '_y'), ('x', '')))} FROM t)""".replace("by_y", "by_")
query("line_voxels", f"{LINE} SELECT * FROM ln")(lambda s, d: D.line_voxels(D.pairwise(voxels(s, d), 20.0)))
query("direct_pairs", f"{LINE}, hit AS (SELECT DISTINCT ln.tomo, id_a, id_b FROM ln JOIN vox USING ({AT}) WHERE label <> id_a AND label <> id_b) SELECT tomo, id_a, id_b, round(distance,6) AS distance FROM p ANTI JOIN hit USING (tomo, id_a, id_b)")(
    lambda s, d: D.direct_pairs(D.pairwise(voxels(s, d), 20.0), voxels(s, d)).select("tomo", "id_a", "id_b", r6("distance", "distance"))
)
query("centroid_distances", f"{VOX}, o AS (SELECT tomo, label, avg(z) AS z, avg(y) AS y, avg(x) AS x FROM vox GROUP BY ALL), p AS (SELECT a.tomo, a.label AS id_a, b.label AS id_b, sqrt((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) AS distance FROM o a JOIN o b ON a.tomo = b.tomo AND a.label < b.label) SELECT tomo, id_a, id_b, round(distance,6) AS distance FROM p WHERE distance <= 12")(
    lambda s, d: D.centroid_distances(V.objects(voxels(s, d)), 12.0).select("tomo", "id_a", "id_b", r6("distance", "distance"))
)
query("proximity", f"{BOTH}, n AS (SELECT a.tomo, a.label, a.z, a.y, a.x, min((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) AS d2 FROM ves a JOIN structure b ON a.tomo=b.tomo GROUP BY ALL) SELECT tomo, label, round(sqrt(min(d2)),6) AS min, round(quantile_cont(sqrt(d2),0.5),6) AS median, round(sqrt(max(d2)),6) AS max FROM n GROUP BY ALL")(
    lambda s, d: A.proximity(vesicles(s, d), structure(s, d)).select("tomo", "label", r6("min", "min"), r6("median", "median"), r6("max", "max"))
)
query("select_densities", f"""{REC}, {STRUCTURE_SQL}, {components_sql('structure', 'c')}, n AS (SELECT a.tomo, a.component, b.label, (a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x) AS d2, a.z*4096+a.y*64+a.x AS pa, b.z*4096+b.y*64+b.x AS pb FROM c a JOIN ves b ON a.tomo = b.tomo),
 m AS (SELECT tomo, component, arg_min(label, (d2::BIGINT << 30) + (pa::BIGINT << 15) + pb) AS label, min(d2) AS d2 FROM n GROUP BY ALL), k AS (SELECT tomo, component FROM m QUALIFY row_number() OVER (PARTITION BY tomo, label ORDER BY d2, component) <= 1)
 SELECT {AT}, component AS label FROM c SEMI JOIN k USING (tomo, component)""")(lambda s, d: A.select_densities(structure(s, d), vesicles(s, d)))

# -- shapes ----------------------------------------------------------------

SQUARE_SQL = "sq(dy, dx) AS (SELECT a, b FROM range(-1,2) i(a), range(-1,2) j(b) WHERE a <> 0 OR b <> 0)"
query("thin_zone", f"""{BOTH}, {SQUARE_SQL}, k AS (SELECT * FROM ves a WHERE EXISTS (SELECT 1 FROM structure b WHERE b.tomo = a.tomo AND b.z = a.z AND (a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x) <= 9)),
 g AS (SELECT tomo, z, y+dy AS y, x+dx AS x FROM k, sq UNION SELECT {AT} FROM k), e AS (SELECT tomo, z, y+dy AS y, x+dx AS x FROM g, sq), f AS (SELECT {AT} FROM e GROUP BY ALL HAVING count(*) = 8)
 SELECT tomo, z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(1 AS BIGINT) AS label FROM (SELECT * FROM g SEMI JOIN f USING ({AT}) UNION SELECT {AT} FROM k)""")(lambda s, d: A.thin_zone(vesicles(s, d), structure(s, d), 3.0, 1))
query("object_axes", f"""{VOX}, m AS (SELECT tomo, label, {', '.join(f"covar_pop({a}, {b}) + {'1/12.0' if a == b else '0'} AS {a}{b}" for a, b in ('zz', 'zy', 'zx', 'yy', 'yx', 'xx'))} FROM vox GROUP BY ALL),
 q AS (SELECT *, (zz+yy+xx)/3 AS q FROM m), p AS (SELECT *, sqrt(((zz-q)*(zz-q)+(yy-q)*(yy-q)+(xx-q)*(xx-q)+2*(zy*zy+zx*zx+yx*yx))/6) AS p FROM q),
 r AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE acos(greatest(-1, least(1, ((zz-q)*((yy-q)*(xx-q)-yx*yx) - zy*(zy*(xx-q)-yx*zx) + zx*(zy*yx-(yy-q)*zx)) / (2*p*p*p)))) / 3 END AS phi FROM p)
 SELECT tomo, label, round(4*sqrt(q+2*p*cos(phi)),6) AS major, round(4*sqrt(q+2*p*cos(phi+2*pi()/3)),6) AS minor FROM r""")(lambda s, d: K.axes(voxels(s, d)).select("tomo", "label", r6("major", "major"), r6("minor", "minor")))

BALLS_SQL = """WITH sph AS (SELECT 'tomo' || CAST(p_partkey % 3 AS VARCHAR) AS tomo, 1 + p_partkey % 40 AS id, CAST(p_partkey % 8 AS INTEGER) AS z, CAST(p_partkey * 7 % 64 AS INTEGER) AS y, CAST(p_partkey * 13 % 64 AS INTEGER) AS x, p_size % 4 + 1 AS r FROM part),
 o AS (SELECT a.i AS dz, b.i AS dy, c.i AS dx FROM range(-4,5) a(i), range(-4,5) b(i), range(-4,5) c(i)),
 ball AS (SELECT tomo, z+dz AS z, y+dy AS y, x+dx AS x, max(id) AS label FROM sph JOIN o ON dz*dz+dy*dy+dx*dx <= r*r WHERE z+dz BETWEEN 0 AND 7 AND y+dy BETWEEN 0 AND 63 AND x+dx BETWEEN 0 AND 63 GROUP BY ALL)"""
ROW = "tomo, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, label"


def balls(s, d):
    """Painted balls of 40 labels: solid objects, unlike the scattered voxels of the views."""
    k = F.col("p_partkey")
    points = table(s, d, "part").select(F.concat(F.lit("tomo"), (k % 3).cast("string")).alias("tomo"), (1 + k % 40).alias("id"), (k % 8).cast("int").alias("z"), (k * 7 % 64).cast("int").alias("y"), (k * 13 % 64).cast("int").alias("x"), (F.col("p_size") % 4 + 1).alias("radius"))
    return S.points_to_labels(points, SHAPE)


INSIDE = f"{BALLS_SQL}, {OFFSETS_SQL}, i AS (SELECT tomo, z+dz AS z, y+dy AS y, x+dx AS x, label FROM ball, off), f AS (SELECT {AT}, label FROM i GROUP BY ALL HAVING count(*) = 6), e AS (SELECT * FROM ball SEMI JOIN f USING ({AT}, label))"
query("points_to_labels", f"{BALLS_SQL} SELECT {ROW} FROM ball")(balls)
query("erode_balls", f"{INSIDE} SELECT {ROW} FROM e")(lambda s, d: V.erode(balls(s, d)))
query("opening", f"{INSIDE}, g AS (SELECT tomo, z+dz AS z, y+dy AS y, x+dx AS x, max(label) AS label FROM e, off GROUP BY ALL), w AS (SELECT * FROM e UNION ALL SELECT * FROM g ANTI JOIN e USING ({AT})) SELECT {ROW} FROM w")(lambda s, d: V.opening(balls(s, d)))
query("boundary_of_balls", f"{INSIDE} SELECT {ROW} FROM ball ANTI JOIN e USING ({AT}, label)")(lambda s, d: V.boundary(balls(s, d)))
query("membrane_shell", f"""{BALLS_SQL}, near AS (SELECT b.tomo, b.z, b.y, b.x, b.label, count(*) FILTER (b.y+dy BETWEEN 0 AND 63 AND b.x+dx BETWEEN 0 AND 63) AS need, count(n.label) AS have FROM ball b JOIN o ON dz = 0 AND dy*dy+dx*dx BETWEEN 1 AND 4
 LEFT JOIN ball n ON n.tomo = b.tomo AND n.z = b.z AND n.y = b.y+dy AND n.x = b.x+dx AND n.label = b.label GROUP BY ALL) SELECT {ROW} FROM near WHERE have < need""")(lambda s, d: V.membrane_shell(balls(s, d), 2, SHAPE))
query("fit_spheres", f"""{BALLS_SQL}, near AS (SELECT b.*, dz*dz+dy*dy+dx*dx AS d2, n.label AS other FROM ball b, (SELECT * FROM o WHERE dz*dz+dy*dy+dx*dx <= 16) o LEFT JOIN ball n ON n.tomo = b.tomo AND n.z = b.z+dz AND n.y = b.y+dy AND n.x = b.x+dx AND n.label = b.label),
 dist AS (SELECT tomo, label, z, y, x, min(d2) FILTER (other IS NULL) AS d2 FROM near GROUP BY ALL) SELECT tomo, label, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(sqrt(d2),6) AS radius FROM dist QUALIFY row_number() OVER (PARTITION BY tomo, label ORDER BY d2 DESC, z, y, x) = 1""")(
    lambda s, d: K.fit_spheres(balls(s, d)).select("tomo", "label", "z", "y", "x", r6("radius", "radius"))
)
query("threshold", f"WITH {IMAGE_SQL} SELECT {AT} FROM img WHERE value > 25")(lambda s, d: V.threshold(image(s, d), 25.0).select(*V.POS))

# -- tables ----------------------------------------------------------------

query("equal_join", "SELECT s_suppkey, s_acctbal AS s_acctbal_left, s_nationkey AS s_acctbal_right FROM supplier")(lambda s, d: R.equal_join(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("s_acctbal")), ["s_suppkey"]))
query("suffix_join", "WITH a AS (SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), b AS (SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL) SELECT p_brand, p_size, a.n AS n_left, b.n AS n_right FROM a JOIN b USING (p_brand, p_size)")(
    lambda s, d: R.suffix_join(*[table(s, d, "part").where(F.col("p_partkey") % 2 == k).groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n")) for k in (0, 1)], ["p_brand", "p_size"])
)
query("join_distances", f"WITH {MEASURES_SQL} SELECT tomo, id, ribbon_distance, pd_distance, boundary_distance FROM meas")(lambda s, d: R.join_distances({n: measurements(s, d).select("tomo", "id", F.col(f"{n}_distance").alias("distance")) for n in ("ribbon", "pd", "boundary")}, ["tomo", "id"]))
query("finite", "SELECT c_custkey, c_acctbal AS v FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0")(
    lambda s, d: R.finite(table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, float("inf")).when(F.col("c_custkey") % 7 == 0, float("nan")).when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal").cast("double")).alias("v")), "v")
)
query("drop_columns", "SELECT n_nationkey, n_name FROM nation")(lambda s, d: R.drop_columns(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_regionkey", "absent"]))
query("all_in", "SELECT o_custkey, bool_and(o_orderstatus IN ('F', 'O')) AS complete FROM orders GROUP BY ALL")(lambda s, d: R.all_in(table(s, d, "orders"), ["o_custkey"], ["status", "o_orderstatus"], ["F", "O"]))
query("name_contains_any", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_name), '12')")(lambda s, d: table(s, d, "part").where(R.name_contains_any(F.col("p_name"), ["AN", "12"])).select("p_partkey"))
query("replace_values", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'part' ELSE o_orderstatus END AS status FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", R.replace_values(F.col("o_orderstatus"), {"F": "done", "P": "part"}).alias("status")))
query("prefix_join", "WITH n AS (SELECT DISTINCT substr(p_name, 1, 4) AS name FROM part), f AS (SELECT DISTINCT p_name AS file FROM part) SELECT name, arg_min(file, (CASE WHEN file = name THEN '0' ELSE '1' END) || file) AS file, count(*) AS matches FROM n JOIN f ON starts_with(file, name) GROUP BY name")(
    lambda s, d: R.prefix_join(table(s, d, "part").select(F.substring("p_name", 1, 4).alias("name")).distinct(), table(s, d, "part").select(F.col("p_name").alias("file")).distinct(), "name", "file")
)
query("binary_recall", "SELECT o_custkey, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 9) AS recall FROM orders GROUP BY ALL")(lambda s, d: R.binary_recall(table(s, d, "orders"), F.col("o_orderstatus") == "F", ["o_custkey"]).select("o_custkey", F.round("recall", 9).alias("recall")))
query("list_sizes", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 1 THEN 1 WHEN 2 THEN 3 END AS n FROM nation")(lambda s, d: table(s, d, "nation").select("n_nationkey", R.list_sizes(F.when(F.col("n_nationkey") % 3 == 1, "7").when(F.col("n_nationkey") % 3 == 2, "1,2,3")).alias("n")))
query("append_column", "WITH c AS (SELECT c_nationkey AS n, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row FROM customer), q AS (SELECT s_nationkey AS n, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS row FROM supplier) SELECT n, row, c_custkey, s_suppkey FROM c FULL JOIN q USING (n, row)")(
    lambda s, d: R.append_column(table(s, d, "customer").select(F.col("c_nationkey").alias("n"), "c_custkey"), table(s, d, "supplier").select(F.col("s_nationkey").alias("n"), "s_suppkey"), "c_custkey", "s_suppkey", ["n"])
)
query("density", f"{VOX}, {OFFSETS_SQL}, f AS (SELECT tomo, z+dz AS z, y+dy AS y, x+dx AS x, label FROM vox, off), a AS (SELECT tomo, label, CAST(count(*) AS DOUBLE) AS area FROM f ANTI JOIN vox USING ({AT}, label) GROUP BY ALL), n AS (SELECT tomo, label, count(*) AS n FROM vox GROUP BY ALL) SELECT tomo, label, round(n / area, 6) AS density FROM n JOIN a USING (tomo, label)")(
    lambda s, d: A.density(V.label_sizes(voxels(s, d)).withColumnRenamed("size", "n"), V.surface_area(voxels(s, d)), ["tomo", "label"]).select("tomo", "label", r6("density", "density"))
)
query("scalar_helpers", f"WITH {MEASURES_SQL} SELECT tomo, id, greatest(1, CAST(round_even(ribbon_distance / 8, 0) AS INTEGER)) AS voxels, round(least(pd_distance, 60) / 60, 6) AS clipped, 2 * radius * 1.5 AS diameter, round(sqrt((ribbon_distance - pd_distance) ** 2 * 4 + (boundary_distance - radius) ** 2), 6) AS norm FROM meas")(
    lambda s, d: measurements(s, d).select("tomo", "id", X.nm_to_voxels(F.col("ribbon_distance"), 8).alias("voxels"), r6(X.clipped_distance(F.col("pd_distance"), 60), "clipped"), X.diameter(F.col("radius"), 1.5).alias("diameter"), r6(X.euclidean([F.col("ribbon_distance"), F.col("boundary_distance")], [F.col("pd_distance"), F.col("radius")], [2, 1]), "norm"))
)
query("path_names", "SELECT p_partkey, p_brand AS stem, p_name || '/' || p_brand || '.h5' AS below, lower(p_name) AS clean FROM part")(
    lambda s, d: table(s, d, "part").withColumn("path", F.concat(F.lit("/data/"), "p_name", F.lit("/"), "p_brand", F.lit(".h5"))).select("p_partkey", X.stem(F.col("path")).alias("stem"), X.relative_to(F.col("path"), "/data/").alias("below"), X.clean_name(F.concat("p_name", F.lit("??"))).alias("clean"))
)
