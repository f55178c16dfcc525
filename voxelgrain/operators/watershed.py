"""Seeded watershed without a queue: a minimum spanning forest grown in rounds.

Neighbouring voxels are joined by an edge as high as the higher of the two. A
tree without a seed goes over its lowest edge, which is down the steepest descent
where there is one. Each block of the volume does so for itself, as long as the
lowest edges of its trees end inside it; then nodes are trees, and only the lowest
edges between them and those over the faces of blocks are left. In rounds, nodes
without a seed point along their lowest edge, pointers are doubled until each node
knows the end of its path, and edges shrink to the lowest pass of every two nodes,
until all that can reach a seed has one. Rounds are written tables of (volume,
node) rows, at most as many as the logarithm of the number of nodes; nothing is
grouped by volume or slice, and no join of nodes or voxels is broadcast: they take
few bytes on disk and many in a driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.operators.blocks import BLOCK, contract
from voxelgrain.storage import stage

#: Coordinates from -2^20 on and under 2^20 fit into one number; positions in z, y, x order are numbers in order.
BITS, HALF = 21, 1 << 20


def _chase(up: DataFrame) -> DataFrame:
    """Pointers (tomo, n, m) doubled until each leads to a root, a node without one.

    Of two nodes that point at each other the smaller becomes the root.
    """
    back = up.select("tomo", F.col("n").alias("m"), F.col("m").alias("_back"))
    up = stage(up.join(back.hint("merge"), ["tomo", "m"], "left").where((F.coalesce("_back", F.col("m")) != F.col("n")) | (F.col("n") > F.col("m"))).select("tomo", "n", "m"), "watershed-up")
    while True:
        over = up.select("tomo", F.col("n").alias("m"), F.col("m").alias("_next"))
        jumped = stage(up.join(over.hint("merge"), ["tomo", "m"], "left").select("tomo", "n", F.coalesce("_next", F.col("m")).alias("m"), F.col("_next").isNotNull().alias("_moved")), "watershed-jump")
        up = jumped.select("tomo", "n", "m")
        if jumped.where("_moved").isEmpty():
            return up


def watershed(height: DataFrame, seeds: DataFrame, planar: bool = False, block_edge: int = BLOCK) -> DataFrame:
    """(tomo, z, y, x, label): the rows of ``height`` that a seed's flood reaches.

    The forest is that of a flood which always takes the lowest edge between a
    labelled and an unlabelled voxel. Edges are ordered by the higher height of
    their two ends, then the lower one, then their positions, so that plateaus
    and ties have one result. Voxels are neighbours over faces, in slices alone
    if ``planar``. ``seeds`` are (tomo, z, y, x, label > 0); those outside of
    ``height`` and those with a label of 0 or null are no seeds, and of several
    at one voxel the largest counts. Rows with a null coordinate or height
    (NaN among them) take no part, repeated ones have their lowest height. Voxels
    cut off from every seed are left out. Blocks have ``block_edge`` voxels an
    edge; their size does not change the result.
    """
    pos = ["tomo", "z", "y", "x"]
    whole = [F.col("tomo"), *[F.col(c).cast("int").alias(c) for c in "zyx"]]
    level = F.nanvl(F.col("height").cast("double"), F.lit(None).cast("double")).alias("height")
    ground = height.select(*whole, level).dropna().withColumn("label", F.lit(None).cast("long"))
    seed = seeds.where("label > 0").select(*whole, F.lit(None).cast("double").alias("height"), F.col("label").cast("long").alias("label")).dropna(subset=[*pos, "label"])
    # nodes: seeds by their negative label, other voxels by their position; both
    # tables go to the blocks as they are, which bring rows of one voxel together
    done = stage(_blocks(ground.unionByName(seed), planar, block_edge), "watershed-blocks")
    voxels = done.where("not edge").select(*pos, F.col("a").alias("m"))
    key = F.struct("hi", "lo", "p", "q").alias("k")
    inner = done.where("edge and b is not null").select("tomo", "a", "b", key)
    half = done.where("edge and b is null")
    over = half.where("first").select("tomo", "p", "q", "a", "hi", "lo").join(half.where("not first").select("tomo", "p", "q", F.col("a").alias("b")).hint("merge"), ["tomo", "p", "q"])
    edges = inner.unionByName(over.select("tomo", "a", "b", key))
    names = voxels.where("m >= 0").select("tomo", F.col("m").alias("n"), "m").distinct()
    while True:
        # the lowest pass of every two nodes; two seeds never merge
        low = edges.where("a <> b and (a >= 0 or b >= 0)").groupBy("tomo", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("k").alias("k"))
        edges = stage(low, "watershed-edges")
        if edges.isEmpty():
            break
        ends = edges.unionByName(edges.select("tomo", F.col("b").alias("a"), F.col("a").alias("b"), "k")).where("a >= 0")
        up = _chase(ends.groupBy("tomo", F.col("a").alias("n")).agg(F.min_by("b", "k").alias("m")))
        on = up.select("tomo", F.col("n").alias("m"), F.col("m").alias("_to"))
        names = stage(names.join(on.hint("merge"), ["tomo", "m"], "left").select("tomo", "n", F.coalesce("_to", F.col("m")).alias("m")), "watershed-names")
        for end in ("a", "b"):
            to = up.select("tomo", F.col("n").alias(end), F.col("m").alias("_to"))
            edges = edges.join(to.hint("merge"), ["tomo", end], "left").withColumn(end, F.coalesce("_to", F.col(end))).drop("_to")
    settled = voxels.where("m < 0").select(*pos, (-F.col("m")).alias("label"))
    later = names.where("m < 0").select("tomo", "n", (-F.col("m")).alias("label"))
    return settled.unionByName(voxels.where("m >= 0").withColumnRenamed("m", "n").join(later.hint("merge"), ["tomo", "n"]).select(*pos, "label"))


def _blocks(voxels: DataFrame, planar: bool, edge: int) -> DataFrame:
    """Blocks contracted for themselves: rows of voxels and of edges that are left.

    Of the rows of a voxel the lowest height and the largest label count; one
    without a height is none.
    A voxel has its node as ``a``. An edge inside a block has both nodes; one
    over a face comes from both blocks, with the node of that side alone, that
    of its first voxel or not.
    """
    steps = [1, 1 << BITS] + ([] if planar else [1 << 2 * BITS])
    axes = "yx" if planar else "zyx"
    # a voxel goes to its own block, and to those that begin at one of its faces
    moves = [F.struct(*[F.lit(m.get(c, 0)).alias(c) for c in "zyx"]) for m in ({}, *[{c: d} for c in axes for d in (-1, 1)])]
    to = [F.floor((F.col(c) + F.col(f"_o.{c}")) / edge).alias(f"_b{c}") for c in "zyx"]
    own = F.expr(" and ".join(f"_b{c} = floor({c} / {edge})" for c in "zyx"))
    dealt = voxels.withColumn("_o", F.explode(F.array(*moves))).select("*", *to).withColumn("halo", ~own)
    # positions and halos are made anew in the task: they need not be shuffled
    dealt = dealt.where("halo or (_o.z = 0 and _o.y = 0 and _o.x = 0)").drop("_o", "halo")
    schema = f"tomo {dict(voxels.dtypes)['tomo']}, edge boolean, first boolean, z int, y int, x int, a long, b long, hi double, lo double, p long, q long"

    def work(f: pa.Table) -> pa.Table:
        f = f.combine_chunks()
        tomo = f["tomo"].slice(0, 1)
        at = np.stack([f[c].to_numpy().astype(np.int64) for c in "zyx"])
        p = (at[0] + HALF << 2 * BITS) + (at[1] + HALF << BITS) + at[2] + HALF
        order = np.argsort(p, kind="stable")
        top = np.flatnonzero(np.diff(p[order], prepend=-1))
        height = np.minimum.reduceat(f["height"].fill_null(np.inf).to_numpy()[order], top)
        label = np.maximum.reduceat(f["label"].fill_null(0).to_numpy()[order], top)
        some = np.maximum.reduceat(f["height"].is_valid().to_numpy()[order], top)
        row, height, label = order[top][some], height[some], label[some]
        p, at, seeded = p[row], at[:, row], label > 0
        halo = np.any([at[k] // edge != f[f"_b{c}"][0].as_py() for k, c in enumerate("zyx")], axis=0)
        up, (a, b, hi, lo, low, to) = contract(p, height, seeded, halo, steps)
        name = np.where(seeded, -label, p)
        own, over = np.flatnonzero(~halo), halo[a] | halo[b]
        of = lambda n: tomo.take(np.zeros(n, np.int64))
        flag = lambda on, n: pa.array(np.full(n, on))
        v = {"tomo": of(len(own)), "edge": flag(False, len(own)), "a": pa.array(name[up[own]])} | {c: pa.array(at[k][own].astype(np.int32)) for k, c in enumerate("zyx")}
        e = {"tomo": of(len(a)), "edge": flag(True, len(a)), "first": pa.array(~halo[a]), "a": pa.array(np.where(halo[a], name[b], name[a])), "b": pa.array(name[b], mask=over), "hi": pa.array(hi), "lo": pa.array(lo), "p": pa.array(low), "q": pa.array(to)}
        return pa.concat_tables([pa.table(v), pa.table(e)], promote_options="default").select(names)

    names = [c.split()[0] for c in schema.split(", ")]
    return dealt.groupBy("tomo", "_bz", "_by", "_bx").applyInArrow(work, schema)
