"""Hand-made volumes and tables with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain.operators import components as C
from voxelgrain.operators import distance as D
from voxelgrain.operators import kernels as K
from voxelgrain.operators import relational as R
from voxelgrain.operators import volume as V
from voxelgrain.plans import segmentation as G
from voxelgrain.sources import mrc, tables
from voxelgrain.streaming import ingest


def volume(spark, array, tomo="t"):
    p = np.argwhere(array)
    rows = [(tomo, int(z), int(y), int(x), int(array[z, y, x])) for z, y, x in p]
    return spark.createDataFrame(rows, "tomo string, z int, y int, x int, label long")


def labels_of(df):
    return sorted(r.label for r in df.select("label").distinct().collect())


def test_pairwise_distances_on_a_line(spark):
    a = np.zeros((4, 64, 64), int)
    for i, x in enumerate((0, 16, 32, 48, 63), 1):
        a[1, 16, x] = i
    want = {(1, 2): 16, (1, 3): 32, (1, 4): 48, (1, 5): 63, (2, 3): 16, (2, 4): 32, (2, 5): 47, (3, 4): 16, (3, 5): 31, (4, 5): 15}
    for size in (1.0, 2.3, 4.4):
        got = D.pairwise(volume(spark, a), 64 * size, (size,) * 3).collect()
        assert {(r.id_a, r.id_b): pytest.approx(r.distance) for r in got} == {k: pytest.approx(v * size) for k, v in want.items()}


def test_size_filter(spark):
    a = np.zeros((1, 30, 30), int)
    a[0, 2:22, 2:22], a[0, 25:28, 25:28] = 5, 7
    v = volume(spark, a)
    assert labels_of(V.size_filter(v, 100)) == [5] and V.size_filter(v, 0).count() == 409
    assert labels_of(V.relabel_sequential(V.size_filter(v, 100))) == [1]
    assert labels_of(C.split_and_restore(v, 100)) == [5]


def test_identical_segmentations(spark):
    a = np.zeros((4, 32, 32), int)
    a[:, 6:26, 6:26] = 1
    v = volume(spark, a)
    m = V.matching(v, v).first()
    assert (m.tp, m.fp, m.fn) == (1, 0, 0) and V.dice(v, v).first().dice == 1 and V.symmetric_best_dice(v, v).first().sbd == 1


def test_nearest_with_anisotropic_voxels(spark):
    a, b = np.zeros((20, 20, 20), int), np.zeros((20, 20, 20), int)
    a[10, 10, 10], b[10, 10, 5] = 1, 9
    assert D.nearest_structure(volume(spark, a), volume(spark, b)).first().distance == 5
    assert D.nearest_structure(volume(spark, a), volume(spark, b), (2.0, 2.0, 3.0)).first().distance == 15
    assert D.nearest_structure(volume(spark, a), volume(spark, a)).first().distance == 0


def test_contacts_and_junctions(spark):
    crista, membrane = np.zeros((24, 12, 12), int), np.zeros((24, 12, 12), int)
    for z, y, x in ((5, 5, 5), (6, 6, 5)):
        crista[z, y, x], membrane[z, y, x - 1] = 1, 1
    touching = V.contacts(volume(spark, crista), volume(spark, membrane))
    assert touching.count() == 2 and C.components(touching, 3).select("component").distinct().count() == 1
    crista[20, 5, 5], membrane[20, 5, 4] = 1, 1
    touching = V.contacts(volume(spark, crista), volume(spark, membrane))
    assert C.components(touching, 3).select("component").distinct().count() == 2
    far = np.zeros((24, 12, 12), int)
    far[5, 5, 10] = 1
    assert V.contacts(volume(spark, crista), volume(spark, far)).count() == 0


def test_components_equal_kernel(spark):
    a = (np.random.default_rng(1).random((6, 14, 14)) < 0.3).astype(int)
    got = C.components(volume(spark, a), 1).collect()
    want = K.label(a.astype(bool))
    assert all(want[r.z, r.y, r.x] == r.component for r in got) and len(got) == a.sum()


def test_membrane_shell_stays_in_its_slices(spark):
    a = np.zeros((21, 30, 30), int)
    a[5:16, 5:25, 5:25] = 1
    shell = V.membrane_shell(volume(spark, a), 2, a.shape)
    z = [r.z for r in shell.select("z").distinct().collect()]
    assert min(z) == 5 and max(z) == 15 and 0 < shell.count() < a.sum()


def test_closing_and_opening(spark):
    a = np.zeros((5, 12, 12), int)
    a[2, 3:9, 3:9] = 3
    a[2, 5, 5] = 0
    closed = V.closing(volume(spark, a), V.SQUARE_2D, 1, a.shape)
    assert closed.count() == 36 and labels_of(closed) == [3]
    a[2, 5, 5], a[2, 10, 10] = 3, 3
    assert V.opening(volume(spark, a), V.SQUARE_2D).count() == 36


def test_kernels(spark):
    a = np.zeros((11, 11, 11), int)
    a[2:9, 2:9, 2:9] = 4
    s = K.fit_spheres(volume(spark, a)).first()
    assert (s.z, s.y, s.x, s.radius) == (5, 5, 5, 4)
    assert K.thickness(volume(spark, a)).first().thickness == 8
    assert K.axes(volume(spark, a)).first().major == pytest.approx(4 * np.sqrt(49 / 12))
    assert K.anisotropy(volume(spark, a)).first().anisotropy == pytest.approx(1)
    b = a.copy()
    b[5, 5, 5] = 0
    assert K.close_holes(volume(spark, b), 10).count() == 343
    flat = np.zeros((1, 9, 40), int)
    flat[0, 2:7, 2:38] = 1
    line = K.skeletons(volume(spark, flat))
    assert 20 <= line.count() <= 45
    pieces = np.zeros((9, 20), bool)
    pieces[1, :7] = pieces[5, 3:10] = True  # each counts for itself
    assert not K.long_pieces(pieces, 8).any() and (K.long_pieces(pieces, 7) == pieces).all()
    mask = np.random.default_rng(3).random((5, 6, 7)) < 0.7
    d = K.distance_transform(mask)
    back = np.argwhere(~mask)
    assert all(d[tuple(p)] == pytest.approx(np.sqrt(((back - p) ** 2).sum(1).min())) for p in np.argwhere(mask))


def test_segment_two_blobs(spark):
    rows = [("t", 0, y, x, 0.9 if (y - 8) ** 2 + (x - c) ** 2 <= 16 else 0.0, 0.0) for y in range(17) for x in range(30) for c in [8 if x < 15 else 21]]
    got = G.segment(spark.createDataFrame(rows, "tomo string, z int, y int, x int, foreground double, border double"))
    assert labels_of(got) == [1, 2]


def test_geodesic_goes_around(spark):
    a = np.ones((1, 5, 5), int)
    a[0, :4, 2] = 0
    start = np.zeros_like(a)
    start[0, 0, 0] = 1
    d = {(r.y, r.x): r.distance for r in K.geodesic_distance(volume(spark, a), volume(spark, start)).collect()}
    assert d[0, 0] == 0 and d[0, 4] > 8 and len(d) == a.sum()


def test_geodesic_over_blocks_is_that_of_the_whole(spark):
    a = (np.random.default_rng(5).random((5, 14, 15)) < 0.45).astype(int)
    start = np.zeros_like(a)
    start[tuple(np.argwhere(a)[0])] = 1
    size = (2.0, 1.0, 1.5)
    want = K.geodesic(a > 0, np.where(start > 0, 0.0, np.inf), size)
    got = {(r.z, r.y, r.x): r.distance for r in K.geodesic_distance(volume(spark, a), volume(spark, start), size, (3, 4, 5)).collect()}
    assert set(got) == set(map(tuple, np.argwhere(np.isfinite(want)))) and len(got) > 50
    assert all(d == pytest.approx(want[p]) for p, d in got.items())
    nowhere = K.geodesic_distance(volume(spark, a), volume(spark, start).where("false"))
    assert nowhere.isEmpty() and K.geodesic_distance(volume(spark, a).where("false"), volume(spark, start)).isEmpty()


def test_skeletons_keep_objects_apart(spark):
    flat = np.zeros((1, 9, 40), int)
    flat[0, 2:4, 2:38], flat[0, 4:7, 2:38] = 1, 2
    assert labels_of(K.skeletons(volume(spark, flat))) == [1, 2]


def test_blockwise_sees_the_halo(spark):
    a = np.ones((4, 8, 8), int)
    count = lambda pdf: pdf.assign(n=len(pdf))
    got = K.blockwise(volume(spark, a), (4, 4, 4), (0, 1, 1), count, "tomo string, z int, y int, x int, label long, n long")
    assert got.count() == a.size and {r.n for r in got.select("n").distinct().collect()} == {4 * 25}


def test_mrc_round_trip(spark, tmp_path):
    a = np.arange(3 * 4 * 5, dtype=np.int16).reshape(3, 4, 5)
    (tmp_path / "a.mrc").write_bytes(mrc.encode(a, (1.554, 1.554, 1.554)))
    got = mrc.read(spark, str(tmp_path), 2).collect()
    assert len(got) == 60 and all(a[r.z, r.y, r.x] == r.value for r in got)
    h = mrc.headers(spark, str(tmp_path)).first()
    assert h.shape == [3, 4, 5] and h.voxel_size == pytest.approx([1.554] * 3)


def test_listing_points_and_splits(spark, tmp_path):
    text = ["OBJECT 1", "NAME:  Vesicles", " 3 contours", "OBJECT 2", "NAME: PD", "  1 contours"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no int, line string")
    assert [tuple(r)[1:] for r in tables.object_listing(lines).orderBy("object_id").collect()] == [(1, "Vesicles", 3), (2, "PD", 1)]
    p = spark.createDataFrame([(1, "Ves", 1.0, 2.0, 3.0, 4.0), (2, "wimp", 1.0, 1.0, 1.0, 2.0), (3, "Ves", 1.0, 1.0, 1.0, 0.0)], "object_id int, name string, x double, y double, z double, size double")
    assert [tuple(r) for r in tables.points(p, 10, ["WIMP"], 2.0).collect()] == [(1, "Ves", 3, 8, 1, 2.0)]
    (tmp_path / "s.json").write_text('{"train": ["a", "b"], "val": ["c"]}')
    assert sorted((r.split, r.file) for r in tables.splits(spark, str(tmp_path / "s.json"), "d").collect()) == [("train", "a"), ("train", "b"), ("val", "c")]
    with pytest.raises(ValueError):
        tables.check_count(tables.manifest(spark, str(tmp_path)), 7)


def test_ingest_processes_each_file_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    spark.range(3).write.parquet(src)
    for _ in range(2):
        ingest.ingest_new(spark, src, "id long", out, mark).awaitTermination()
    spark.range(10, 12).write.mode("append").parquet(src)
    ingest.ingest_new(spark, src, "id long", out, mark, lambda df: df.withColumn("id", F.col("id") + 100)).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 110, 111]


def test_joins_and_null_rules(spark):
    a = spark.createDataFrame([(1, 1.0), (2, float("nan"))], "id int, v double")
    assert R.nan_to_null(a).agg(F.avg("v")).first()[0] == 1 and R.finite(a, "v").count() == 1
    with pytest.raises(ValueError):
        R.equal_join(a, a.where("id = 1"), ["id"])
    assert R.equal_join(a, a, ["id"]).columns == ["id", "v_left", "v_right"]
    with pytest.raises(Exception):
        R.query_filter(a, "nothing > 1")
    pools = spark.createDataFrame([("A", 1), ("B", 2), ("C, D", 3), ("E", 4)], "pool string, n int")
    assert sorted(r.n for r in R.query_filter(pools, "pool in ('A', 'C, D', concat('', 'E')), n > 1").collect()) == [3, 4]
    assert R.query_filter(pools, "n > 1, , no_such > 2, pool <> 'E'", strict=False).count() == 2
    names = spark.createDataFrame([("ab",), ("abc",)], "name string")
    files = spark.createDataFrame([("abc",), ("abd",)], "file string")
    assert sorted((r.name, r.file, r.matches) for r in R.prefix_join(names, files, "name", "file").collect()) == [("ab", "abc", 2), ("abc", "abc", 1)]
