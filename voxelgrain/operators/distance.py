"""Distances between objects: nearest voxels, pairs, neighbours, lines.

Both sides are reduced to voxels that have a neighbour outside (the nearest
voxels of disjoint objects are always such) and met in grid cells, so that only
voxels of neighbouring cells are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelgrain.operators.volume import POS, boundary
from voxelgrain.storage import stage

Size = tuple[float, float, float]
UNIT: Size = (1.0, 1.0, 1.0)
#: Points of an object in one row: two rows are compared as one small matrix.
PIECE = 256


def _squared(a: str, b: str, size: Size) -> Column:
    part = [(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * F.lit(float(s)) for c, s in zip("zyx", size, strict=True)]
    return part[0] * part[0] + part[1] * part[1] + part[2] * part[2]


def _cells(v: DataFrame, edge: float, size: Size, spread: bool) -> DataFrame:
    """Adds the grid cell of each voxel; ``spread``: a row for all 27 around it."""
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    for c, s in zip("zyx", size, strict=True):
        cell = F.floor(F.col(f"p.{c}") * float(s) / edge)
        v = v.withColumn(f"c{c}", cell)
        if spread:
            v = v.withColumn(f"_d{c}", F.explode(near)).withColumn(f"c{c}", F.col(f"c{c}") + F.col(f"_d{c}")).drop(f"_d{c}")
    return v


def _box(v: DataFrame, edge: float, size: Size) -> DataFrame:
    """Adds the grid cell of each voxel (tomo, p): columns cz, cy, cx."""
    return v.withColumns({f"c{c}": F.floor(F.col(f"p.{c}") * float(s) / edge) for c, s in zip("zyx", size, strict=True)})


def nearest_structure(objects: DataFrame, structure: DataFrame, size: Size = UNIT, edge: float = 2.0, surface: bool = True, by_structure: bool = False) -> DataFrame:
    """(tomo, label, distance, ep_object, ep_structure, structure_label).

    For every object the least distance to any voxel of the structure, with end
    points and the structure's label; of equal distances the first end points
    in z, y, x order, those of the object before those of the structure
    (``by_structure``: the other way round). Objects that share a voxel with the structure are at 0,
    the first such voxel. Objects in tomograms without structure give no row, nor
    do voxels with a null coordinate.

    Voxels are looked up in cells of ``edge``: what is found within one edge is
    final and written; what is not goes on to cells of twice the edge, until no
    object is left. The side with fewer voxels is spread over the 27 cells around
    it, so no pass joins on the tomogram alone. Voxels and objects take few bytes on
    disk and many in a driver: none of their joins is broadcast through it.
    """
    objects = objects.select("tomo", "z", "y", "x", "label").dropna()
    structure = structure.select("tomo", "z", "y", "x", "label").dropna()
    near = lambda v: boundary(v) if surface else v
    point = F.struct("z", "y", "x")
    shared = objects.join(structure.select(*POS, F.col("label").alias("structure_label")).hint("merge"), POS)
    out = stage(shared.groupBy("tomo", "label").agg(F.min(F.struct(F.lit(0.0).alias("d2"), point.alias("ep_object"), point.alias("ep_structure"), "structure_label")).alias("m")), "nearest-shared")
    left = near(objects).select("tomo", "label", point.alias("p"))
    left = stage(left.join(out.select("tomo", "label").hint("merge"), ["tomo", "label"], "left_anti"), "nearest-left")
    b = stage(near(structure).select("tomo", F.col("label").alias("structure_label"), point.alias("p")), "nearest-structure")
    left = left.join(b.select("tomo").distinct(), "tomo", "left_semi")
    ends = ("ep_structure", "ep_object") if by_structure else ("ep_object", "ep_structure")
    while (n_left := left.count()) > 0:
        here = b.join(left.select("tomo").distinct(), "tomo", "left_semi")
        wide = n_left < here.count()
        x = (_cells(left, edge, size, True) if wide else _box(left, edge, size)).withColumnRenamed("p", "ep_object")
        y = (_box(here, edge, size) if wide else _cells(here, edge, size, True)).withColumnRenamed("p", "ep_structure")
        # a side with 27 rows a voxel looks small on disk: it is never broadcast
        both = x.hint("merge").join(y, ["tomo", "cz", "cy", "cx"]).withColumn("d2", _squared("ep_object", "ep_structure", size)).where(F.col("d2") <= edge * edge)
        best = both.groupBy("tomo", "label").agg(F.min(F.struct("d2", *ends, "structure_label")).alias("m"))
        found = stage(best.select("tomo", "label", F.struct("m.d2", "m.ep_object", "m.ep_structure", "m.structure_label").alias("m")), "nearest-found")
        out = out.unionByName(found)
        left = stage(left.join(found.select("tomo", "label").hint("merge"), ["tomo", "label"], "left_anti"), "nearest-left")
        edge *= 2
    return out.select("tomo", "label", F.sqrt("m.d2").alias("distance"), "m.ep_object", "m.ep_structure", "m.structure_label")


def pairwise(v: DataFrame, max_distance: float | None = None, size: Size = UNIT, surface: bool = True) -> DataFrame:
    """(tomo, id_a, id_b, distance, ep_a, ep_b), id_a < id_b: least distances of pairs.

    With ``max_distance`` only pairs up to it: voxels are met in cells as wide as
    that, each cell and the half of its neighbours that come after it, so that
    nothing is joined by tomogram. Without, every pair of a tomogram: pairs of
    objects are met by their bounding boxes, and a voxel takes part only if it is
    no farther from the other object's box than the two boxes allow the least
    distance to be. Voxels with a null coordinate take no part.
    """
    v = v.select(*POS, "label").dropna()
    s = stage((boundary(v) if surface else v).select("tomo", "label", F.struct("z", "y", "x").alias("p")), "pairs-surface")
    if max_distance is not None:
        return _pairs_within(s, max_distance, size)
    box = s.groupBy("tomo", "label").agg(*[f(f"p.{c}").alias(f"{n}{c}") for c in "zyx" for n, f in (("lo", F.min), ("hi", F.max))], F.min("p").alias("any"))
    side = lambda n: box.select("tomo", F.col("label").alias(f"id_{n}"), *[F.col(f"{e}{c}").alias(f"{n}_{e}{c}") for c in "zyx" for e in ("lo", "hi")], F.col("any").alias(f"{n}_any"))
    pairs = side("a").join(side("b"), "tomo").where("id_a < id_b")
    # any two voxels bound the least distance from above
    pairs = pairs.withColumn("most", _squared("a_any", "b_any", size))
    to_box = lambda n: sum(
        (F.pow(F.greatest(F.lit(0), F.col(f"{n}_lo{c}") - F.col(f"p.{c}"), F.col(f"p.{c}") - F.col(f"{n}_hi{c}")) * float(w), 2) for c, w in zip("zyx", size, strict=True)), F.lit(0.0)
    )
    mine = lambda n, other: (
        pairs.join(s.withColumnRenamed("label", f"id_{n}"), ["tomo", f"id_{n}"]).where(to_box(other) <= F.col("most")).select("tomo", "id_a", "id_b", F.col("p").alias(f"ep_{n}"))
    )
    both = mine("a", "b").join(mine("b", "a"), ["tomo", "id_a", "id_b"]).withColumn("d2", _squared("ep_a", "ep_b", size))
    best = both.groupBy("tomo", "id_a", "id_b").agg(F.min(F.struct("d2", "ep_a", "ep_b")).alias("m"))
    return best.select("tomo", "id_a", "id_b", F.sqrt("m.d2").alias("distance"), "m.ep_a", "m.ep_b")


def _pairs_within(s: DataFrame, limit: float, size: Size) -> DataFrame:
    """Pairs of objects with voxels (tomo, label, p) within a limit.

    Each two cells meet once, in the later of them. The points of one object and
    cell travel in pieces of ``PIECE`` points at most; every two pieces whose boxes
    are near enough give one row at most, their least distance with its first end
    points, so that pairs of points are never rows of a shuffle or a sort.
    """
    edge = max(float(limit), 1e-9)
    cell = ["tomo", "cz", "cy", "cx"]
    held = _box(s, edge, size).groupBy("label", *cell).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    held = held.withColumn("ps", F.explode(F.expr(f"transform(sequence(0, (size(ps) - 1) div {PIECE}), i -> slice(ps, cast(i * {PIECE} + 1 as int), {PIECE}))")))
    held = held.select("label", *cell, *[F.col(f"ps.{c}").alias(c) for c in "zyx"])
    held = stage(held.withColumns({f"{n}{c}": f(c) for c in "zyx" for n, f in (("lo", F.array_min), ("hi", F.array_max))}), "pairs-pieces")
    steps = F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(o, ("dz", "dy", "dx"), strict=True)]) for o in product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)])
    body = [f"{n}{c}" for c in "zyx" for n in ("", "lo", "hi")]
    a = held.withColumn("_o", F.explode(steps)).select("tomo", F.col("label").alias("id_1"), F.expr("_o.dz = 0 and _o.dy = 0 and _o.dx = 0").alias("_same"), *[(F.col(f"c{c}") + F.col(f"_o.d{c}")).alias(f"c{c}") for c in "zyx"], *[F.col(c).alias(f"{c}_1") for c in body])
    b = held.select(*cell, F.col("label").alias("id_2"), *[F.col(c).alias(f"{c}_2") for c in body])
    gap = [F.greatest(F.lit(0), F.col(f"lo{c}_1") - F.col(f"hi{c}_2"), F.col(f"lo{c}_2") - F.col(f"hi{c}_1")) * F.lit(float(w)) for c, w in zip("zyx", size, strict=True)]
    # the sides are spread and hold arrays: their sizes on disk say little, so neither is broadcast
    met = a.hint("merge").join(b, cell).where("id_1 <> id_2 and (not _same or id_1 < id_2)").where(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= limit * limit)
    swap = F.col("id_1") > F.col("id_2")
    side = lambda x, y, n: [F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{n}") for c in "zyx"]
    met = met.select("tomo", F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"), *side("1", "2", "a"), *side("2", "1", "b"))
    types = dict(met.dtypes)
    point = ", ".join(f"{c}: {types[f'{c}_a'].removeprefix('array<').removesuffix('>')}" for c in "zyx")
    near = met.mapInArrow(_least(float(limit), size), f"tomo {types['tomo']}, id_a {types['id_a']}, id_b {types['id_b']}, d2 double, ep_a struct<{point}>, ep_b struct<{point}>")
    best = near.groupBy("tomo", "id_a", "id_b").agg(F.min(F.struct("d2", "ep_a", "ep_b")).alias("m"))
    return best.select("tomo", "id_a", "id_b", F.sqrt("m.d2").alias("distance"), "m.ep_a", "m.ep_b")


def _least(limit: float, size: Size):
    """Rows of two sorted lists of points to their least squared distance and its first end points."""
    scale = tuple(float(s) for s in size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lists = [batch.column(k) for k in range(3, 9)]
            raw = [c.flatten() for c in lists]
            values = [r.to_numpy(zero_copy_only=False).astype(np.float64) for r in raw]
            a, b = (np.concatenate([[0], np.cumsum(lists[k].value_lengths().to_numpy(zero_copy_only=False))]).tolist() for k in (0, 3))
            d2, at_a, at_b = np.empty(n), np.empty(n, np.int64), np.empty(n, np.int64)
            for k in range(n):
                i, j = slice(a[k], a[k + 1]), slice(b[k], b[k + 1])
                d = None
                for axis, w in enumerate(scale):
                    part = np.subtract.outer(values[axis][i], values[3 + axis][j])
                    part *= w
                    part *= part
                    d = part if d is None else np.add(d, part, out=d)
                m = int(d.argmin())
                p, q = divmod(m, b[k + 1] - b[k])
                d2[k], at_a[k], at_b[k] = d[p, q], a[k] + p, b[k] + q
            ok = np.flatnonzero(d2 <= limit * limit)
            ends = [pa.StructArray.from_arrays([r.take(pa.array(at[ok])) for r in raw[o : o + 3]], names=list("zyx")) for at, o in ((at_a, 0), (at_b, 3))]
            keys = [batch.column(k).take(pa.array(ok)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(d2[ok]), *ends], names=["tomo", "id_a", "id_b", "d2", "ep_a", "ep_b"])

    return work


def centroid_distances(objects: DataFrame, max_distance: float, size: Size = UNIT) -> DataFrame:
    """Distances of object centres up to ``max_distance``, in grid cells."""
    p = objects.select("tomo", "label", F.struct(F.col("c_z").alias("z"), F.col("c_y").alias("y"), F.col("c_x").alias("x")).alias("p"))
    a = _cells(p, max_distance, size, True).select("tomo", "cz", "cy", "cx", F.col("label").alias("id_a"), F.col("p").alias("ep_a"))
    b = _cells(p, max_distance, size, False).select("tomo", "cz", "cy", "cx", F.col("label").alias("id_b"), F.col("p").alias("ep_b"))
    both = a.join(b, ["tomo", "cz", "cy", "cx"]).where("id_a < id_b").withColumn("distance", F.sqrt(_squared("ep_a", "ep_b", size)))
    return both.where(F.col("distance") <= max_distance).select("tomo", "id_a", "id_b", "distance")


def neighbours(pairs: DataFrame, k: int, unique: bool = True) -> DataFrame:
    """Pairs in which one object is among the k nearest of the other."""
    both = pairs.select("tomo", F.col("id_a").alias("id"), F.col("id_b").alias("other"), "distance").unionByName(pairs.select("tomo", F.col("id_b").alias("id"), F.col("id_a").alias("other"), "distance"))
    near = both.withColumn("rank", F.row_number().over(Window.partitionBy("tomo", "id").orderBy("distance", "other"))).where(F.col("rank") <= k)
    if not unique:
        return near
    return near.select("tomo", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), "distance").distinct()


def within(distances: DataFrame, max_distance: float) -> DataFrame:
    return distances.where(F.col("distance") <= max_distance)


def lines(pairs: DataFrame, scale: int = 1, digits: int = 2) -> DataFrame:
    """End points divided by ``scale`` and rounded distances, for display."""
    end = lambda p: [F.floor(F.col(f"{p}.{c}") / scale).cast("int").alias(f"{'begin' if p == 'ep_a' else 'end'}_{c}") for c in "zyx"]
    return pairs.select("tomo", "id_a", "id_b", F.bround("distance", digits).alias("distance"), *end("ep_a"), *end("ep_b"))


def lines_in_box(lines_: DataFrame, lo: tuple, hi: tuple) -> DataFrame:
    """Lines with both ends strictly inside the box, moved to its corner."""
    ok = F.lit(True)
    for e in ("begin", "end"):
        for c, a, b in zip("zyx", lo, hi, strict=True):
            ok = ok & (F.col(f"{e}_{c}") > a) & (F.col(f"{e}_{c}") < b)
    return lines_.where(ok).withColumns({f"{e}_{c}": F.col(f"{e}_{c}") - a for e in ("begin", "end") for c, a in zip("zyx", lo, strict=True)})


def line_voxels(pairs: DataFrame) -> DataFrame:
    """Voxels on the straight line between the end points of each pair."""
    n = F.greatest(*[F.abs(F.col(f"ep_a.{c}") - F.col(f"ep_b.{c}")) for c in "zyx"])
    t = pairs.withColumn("_n", n).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = lambda c: F.floor(F.col(f"ep_a.{c}") + (F.col(f"ep_b.{c}") - F.col(f"ep_a.{c}")) * F.col("_t") / F.greatest("_n", F.lit(1)) + 0.5).cast("int").alias(c)
    return t.select("tomo", "id_a", "id_b", *[at(c) for c in "zyx"])


def direct_pairs(pairs: DataFrame, v: DataFrame) -> DataFrame:
    """Pairs whose line meets no voxel of a third object.

    A written pair is a few bytes and a line of many voxels: neither these nor the
    pairs that are hit are broadcast.
    """
    pairs = stage(pairs, "direct-pairs")
    hit = line_voxels(pairs).hint("merge").join(v.select(*POS, "label"), POS).where("label <> id_a and label <> id_b").select("tomo", "id_a", "id_b").distinct()
    return pairs.join(hit.hint("merge"), ["tomo", "id_a", "id_b"], "left_anti")


def top_structures(nearest: DataFrame, max_distance: float, n: int) -> DataFrame:
    """The n structures nearest to most objects within a limit, numbered from 1."""
    c = within(nearest, max_distance).groupBy("tomo", "structure_label").agg(F.count(F.lit(1)).alias("objects"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("tomo").orderBy(F.desc("objects"), "structure_label"))).where(F.col("rank") <= n)


def top_n_per_structure(nearest: DataFrame, n: int) -> DataFrame:
    """The n nearest objects of each structure."""
    return nearest.withColumn("rank", F.row_number().over(Window.partitionBy("tomo", "structure_label").orderBy("distance", "label"))).where(F.col("rank") <= n)
