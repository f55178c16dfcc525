"""Connected components of graphs and of sparse volumes, without a driver-side graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelgrain.operators.blocks import BLOCK, block, first_voxels
from voxelgrain.operators.volume import POS, neighbourhood, shifted, size_filter
from voxelgrain.storage import stage


def graph_components(edges: DataFrame) -> DataFrame:
    """(id, comp) for edges (a, b): the least id reachable from each id.

    Nodes point to their least neighbour, pointers are doubled down to roots,
    and only edges between different roots go on to the next round. Nodes take few
    bytes on disk and many in a driver: no join here is broadcast through it.
    """
    names, rest = None, edges.where("a <> b")
    while True:
        rest = stage(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if rest.isEmpty():
            return names if names is not None else edges.select(F.col("a").alias("id"), F.col("a").alias("comp")).limit(0)
        both = rest.union(rest.select("b", "a"))
        up = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), "up")
        while True:
            over = up.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
            jumped = stage(up.join(over.hint("merge"), "comp").select("id", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("moved")), "jump")
            up = jumped.select("id", "comp")
            if jumped.where("moved").isEmpty():
                break
        root = up.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        names = up if names is None else names.join(root.hint("merge"), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
        a, b = up.select(F.col("id").alias("a"), F.col("comp").alias("ra")), up.select(F.col("id").alias("b"), F.col("comp").alias("rb"))
        rest = rest.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def components(v: DataFrame, connectivity: int = 3, per_label: bool = False, planar: bool = False, block_edge: int = BLOCK) -> DataFrame:
    """Voxels with the number of their component, 1..n per tomogram.

    Components are numbered by their first voxel in z, y, x order. With
    ``per_label`` only voxels of one label connect; ``planar`` works slice by
    slice. Connectivity 1 is faces, 3 also edges and corners. Blocks of
    ``block_edge`` voxels an edge are connected for themselves, then their
    components over the faces of the blocks. A row with a null coordinate is no
    voxel and left out.
    """
    half = [o for o in neighbourhood(connectivity, planar) if o > (0, 0, 0)]
    more = ["label"] if per_label else []
    own = v.select(*POS, *more)
    types = dict(own.dtypes)
    head, cells = ["tomo", "z", "y", "x", *more], ["_bz", "_by", "_bx"]

    def work(f: pd.DataFrame) -> pd.DataFrame:
        first = first_voxels(f, half, per_label)
        return f.assign(**{f"_r{c}": f[c].to_numpy()[first] for c in "zyx"})

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in head], "_bz long, _by long, _bx long", *[f"_r{c} {types[c]}" for c in "zyx"]])
    named = own.dropna(subset=list("zyx")).select(*head, *block(block_edge)).groupBy("tomo", *cells).applyInPandas(work, schema)
    key = F.struct("tomo", "_rz", "_ry", "_rx", *more)
    named = stage(named.select(*head, *cells, key.alias("id")), "components-blocks")
    rim = named.where(" or ".join(f"pmod({c}, {block_edge}) in (0, {block_edge - 1})" for c in "zyx"))
    moved = shifted(rim.withColumnRenamed("id", "a"), half).where(" or ".join(f"_b{c} <> floor({c} / {block_edge})" for c in "zyx")).drop(*cells)
    edges = moved.join(rim.drop(*cells).withColumnRenamed("id", "b").hint("merge"), head).select("a", "b")
    found = graph_components(edges)
    named = named.drop(*cells).join(found.hint("merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    order = named.select("tomo", "comp").distinct()
    order = order.withColumn("component", F.row_number().over(Window.partitionBy("tomo").orderBy("comp")).cast("long"))
    return named.join(order.hint("merge"), ["tomo", "comp"]).select(*own.columns, "component")


def components_filtered(v: DataFrame, min_size: int, connectivity: int = 3) -> DataFrame:
    """Components of at least ``min_size`` voxels as labels."""
    return size_filter(components(v, connectivity).withColumnRenamed("component", "label"), min_size)


def split_and_restore(v: DataFrame, min_size: int, connectivity: int = 1) -> DataFrame:
    """Drops small components; what is left keeps its original labels."""
    c = components(v, connectivity).withColumnRenamed("component", "label")
    return v.join(size_filter(c, min_size).select(*POS), POS, "left_semi")


def largest_component(v: DataFrame, connectivity: int = 3) -> DataFrame:
    """Voxels of the largest component per tomogram (first on ties)."""
    c = components(v, connectivity)
    top = c.groupBy("tomo", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("tomo").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return c.join(top.hint("merge"), ["tomo", "component"], "left_semi").select(*POS)
