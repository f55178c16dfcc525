"""Largest matchings of bipartite graphs, grown along alternating paths in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.storage import stage


def _join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of tables that grow with the volumes: none goes through the driver in any round."""
    return a.join(b.hint("merge"), on, how)


def _greedy(edges: DataFrame) -> DataFrame:
    """Edges no two of which share a node, and to which none can be added.

    An edge is taken where it comes first at both of its ends, in the order of a
    hash, so that few rounds do for chains as well.
    """
    rank = F.struct(F.xxhash64("tomo", "a", "b").alias("h"), F.col("a").alias("a"), F.col("b").alias("b"))
    left, out = stage(edges.withColumn("_k", rank), "matching-left"), None
    while not left.isEmpty():
        first = lambda end: left.groupBy("tomo", end).agg(F.min("_k").alias("_k")).select("tomo", "_k.a", "_k.b")  # noqa: B023, E731
        taken = stage(_join(first("a"), first("b"), ["tomo", "a", "b"]), "matching-taken")
        out = taken if out is None else out.unionByName(taken)
        for end in ("a", "b"):
            left = _join(left, taken.select("tomo", end), ["tomo", end], "left_anti")
        left = stage(left, "matching-left")
    return edges.limit(0) if out is None else stage(out, "matching")


def maximum_matching(edges: DataFrame) -> DataFrame:
    """(tomo, a, b): as many of the edges (tomo, a, b) as can be without a shared node.

    The nodes a and b are two kinds, whatever their numbers. From a greedy start,
    alternating trees grow from all free nodes a at once, layer by layer; every
    node joins one tree, so the trees share none, and one path of each tree that
    has reached a free node b is turned over. When none has, the matching is a
    largest one. Layers and matchings are written tables of edges and nodes; the
    work is never grouped by volume or component. Which of several largest
    matchings comes out is fixed by a hash and by numbers. Edges with a null are
    left out, repeated ones count once.
    """
    edges = stage(edges.select("tomo", "a", "b").dropna().distinct(), "matching-edges")
    matched = _greedy(edges)
    while True:
        free = _join(edges.select("tomo", "a").distinct(), matched, ["tomo", "a"], "left_anti")
        front, layers, seen = free.withColumn("root", F.col("a")), [], None
        while True:
            met = _join(front, edges, ["tomo", "a"])
            if seen is not None:
                met = _join(met, seen, ["tomo", "b"], "left_anti")
            grown = met.groupBy("tomo", "b").agg(F.min(F.struct("root", "a")).alias("m")).select("tomo", "b", "m.a", "m.root")
            layer = stage(_join(grown, matched.withColumnRenamed("a", "mate"), ["tomo", "b"], "left"), "matching-layer")
            if layer.isEmpty():
                return matched
            layers.append(layer)
            ends = layer.where("mate is null").groupBy("tomo", "root").agg(F.min("b").alias("b")).select("tomo", "b")
            if not ends.isEmpty():
                break
            front = layer.select("tomo", F.col("mate").alias("a"), "root")
            seen = layer.select("tomo", "b") if seen is None else seen.unionByName(layer.select("tomo", "b"))
        turned = None
        for layer in reversed(layers):
            pairs = stage(_join(ends, layer, ["tomo", "b"]).select("tomo", "a", "b"), "matching-pairs")
            turned = pairs if turned is None else turned.unionByName(pairs)
            ends = _join(pairs.select("tomo", "a"), matched, ["tomo", "a"]).select("tomo", "b")
        matched = stage(_join(matched, turned.select("tomo", "a"), ["tomo", "a"], "left_anti").unionByName(turned), "matching")
