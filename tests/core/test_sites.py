"""Contact sites, object statistics and shape refinement on small volumes."""

from voxelgrain.operators import distance as D
from voxelgrain.plans import sites as S

SCHEMA = "tomo string, z int, y int, x int, label long"


def volume(spark, voxels):
    return spark.createDataFrame([("t", *p) for p in voxels], SCHEMA)


def test_contact_sites_are_counted_as_parts(spark):
    inner = volume(spark, [(0, 0, x, 1) for x in (0, 1, 2, 8, 9)] + [(5, 5, 5, 1)])
    membrane = volume(spark, [(0, 1, x, 1) for x in (0, 1, 8)])
    sites, report = S.contact_sites(inner, membrane, 2.0)
    assert sorted((r.x, r.site) for r in sites.collect()) == [(0, 1), (1, 1), (8, 2)]
    assert [tuple(r) for r in report.collect()] == [("t", 2, 6.0)]
    none = S.contact_sites(inner, membrane.where("false"))[1]
    assert [tuple(r) for r in none.collect()] == [("t", 0, 0.0)]


def test_object_statistics_with_and_without_inner_voxels(spark):
    outer = volume(spark, [(z, y, x, 1) for z in range(3) for y in range(3) for x in range(3)] + [(0, 9, 9, 2)])
    inner = volume(spark, [(0, 0, 0, 1), (2, 2, 2, 1), (2, 2, 1, 1)])
    got = {r.label: r for r in S.object_statistics(outer, inner).collect()}
    assert (got[1].volume, got[1].surface, got[1].inner_volume, got[1].n_parts, got[1].largest_part) == (27.0, 54.0, 3.0, 2, 2.0)
    assert got[1].inner_surface == 16.0 and got[2].n_parts == 0 and got[2].inner_volume == 0.0 and got[2].offset_z is None


def test_component_boxes_are_widened_and_cut(spark):
    v = volume(spark, [(1, 5, x, 1) for x in range(4, 8)] + [(7, 7, 7, 1)])
    got = [tuple(r) for r in S.component_boxes(v, 2, (4, 2, 6), (8, 8, 8)).collect()]
    assert got == [("t", 1, 4, 0, 4, 5, 7, 3, 8)]


def test_refined_shapes_stop_at_edges(spark):
    v = volume(spark, [(0, y, x, 1) for y in range(5) for x in range(5)] + [(0, 9, 9, 2)])
    edge = spark.createDataFrame([("t", 0, y, x, 0.0 if x < 4 else 9.0) for y in range(6) for x in range(6)], "tomo string, z int, y int, x int, edge double")
    got = {(r.y, r.x): r.label for r in S.refine_shapes(v, edge, 2, 4, 1.0).collect()}
    assert got[(9, 9)] == 2 and got[(2, 2)] == 1 and not any(x >= 4 for (_, x), label in got.items() if label == 1)


def test_pairs_without_a_limit_equal_brute_force(spark):
    import random

    r = random.Random(4)
    voxels = {(r.randrange(6), r.randrange(40), r.randrange(40)): 1 + r.randrange(6) for _ in range(120)}
    got = {(x.id_a, x.id_b): x.distance for x in D.pairwise(volume(spark, [(*p, k) for p, k in voxels.items()]), size=(2.0, 1.0, 1.0)).collect()}
    want = {}
    for p, a in voxels.items():
        for q, b in voxels.items():
            if a < b:
                d = (4 * (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5
                want[a, b] = min(d, want.get((a, b), 1e9))
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_nearest_structure_far_away(spark):
    objects = volume(spark, [(0, 0, 0, 1), (0, 0, 3, 2)])
    structure = volume(spark, [(0, 0, 5, 7), (300, 0, 0, 8)])
    got = {r.label: (r.distance, r.structure_label) for r in D.nearest_structure(objects, structure).collect()}
    assert got == {1: (5.0, 7), 2: (2.0, 7)}
    far = {r.label: r.distance for r in D.nearest_structure(objects, structure.where("label = 8")).collect()}
    assert far == {1: 300.0, 2: (90000 + 9) ** 0.5}
    assert D.nearest_structure(objects, structure.where("false")).count() == 0
