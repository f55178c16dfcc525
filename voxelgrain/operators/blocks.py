"""Work inside blocks of a volume: what a block settles for itself needs no row outside it.

A block is a cube of ``BLOCK`` voxels an edge, so that a task holds that many
at most, however large the volume is. Names given in a block are positions,
and edges over its faces are left to the written rounds of the callers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 32


def block(block_edge: int, names: str = "zyx") -> list[Column]:
    """The block of a voxel: columns _bz, _by, _bx."""
    return [F.floor(F.col(c) / block_edge).alias(f"_b{a}") for c, a in zip(names, "zyx", strict=True)]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node reachable from each of 0..n-1 over edges a - b."""
    up = np.arange(n)
    while len(a):
        ra, rb = up[a], up[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        up = _ends(up)
    return up


def _ends(up: np.ndarray) -> np.ndarray:
    while not np.array_equal(up, nxt := up[up]):
        up = nxt
    return up


def first_voxels(f: pd.DataFrame, offsets: list[tuple[int, int, int]], per_label: bool) -> np.ndarray:
    """For each row of a block the row of the first voxel, in z, y, x order, of its component inside the block."""
    at = f[["z", "y", "x"]].to_numpy(np.int64)
    wide = at.max(0) - at.min(0) + 3
    at = at - at.min(0) + 1
    number = lambda o: (o[..., 0] * wide[1] + o[..., 1]) * wide[2] + o[..., 2]
    key = number(at)
    if per_label:
        key = key + pd.factorize(f["label"], use_na_sentinel=False)[0] * int(wide.prod())
    node, row, back = np.unique(key, return_index=True, return_inverse=True)
    ends = []
    for o in offsets:
        to = node + number(np.array(o))
        i = np.searchsorted(node, to)
        ok = np.flatnonzero(node[np.minimum(i, len(node) - 1)] == to)
        ends.append((ok, i[ok]))
    a, b = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
    return row[roots(len(node), a, b)][back]


def contract(p: np.ndarray, height: np.ndarray, seeded: np.ndarray, halo: np.ndarray, steps: list[int]) -> tuple[np.ndarray, tuple]:
    """(root of each node, edges left) of a flood as far as a block settles it.

    Nodes have ascending positions ``p``; those in the ``halo`` belong to other
    blocks. A tree without a seed goes over its lowest edge as long as that ends
    in the block: it is the lowest of all, since every edge of a tree inside is
    known. What is left are the edges between trees, the lowest of every two
    inside the block, and all to the halo: (a, b, hi, lo, p, q), a and b nodes.
    """
    ends = []
    for s in steps:
        i = np.searchsorted(p, p + s)
        ok = np.flatnonzero(p[np.minimum(i, len(p) - 1)] == p + s)
        ends.append((ok, i[ok]))
    a, b = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
    inside = ~(halo[a] & halo[b])
    a, b = a[inside], b[inside]
    hi, lo = np.maximum(height[a], height[b]), np.minimum(height[a], height[b])
    order = np.lexsort((p[b], p[a], lo, hi))
    a, b, hi, lo = a[order], b[order], hi[order], lo[order]
    pa, pb, up = p[a], p[b], np.arange(len(p))
    live, still = np.arange(len(a)), seeded | halo
    while len(live):
        ra, rb = up[a[live]], up[b[live]]
        live = live[(ra != rb) & ~(seeded[ra] & seeded[rb])]
        ra, rb = up[a[live]], up[b[live]]
        best = np.full(len(p), len(a))
        np.minimum.at(best, ra, live)
        np.minimum.at(best, rb, live)
        go = np.flatnonzero((best < len(a)) & ~still)
        to = up[a[best[go]]] + up[b[best[go]]] - go
        go, to = go[~halo[to]], to[~halo[to]]
        nxt = np.arange(len(p))
        nxt[go] = to
        mutual = go[(nxt[to] == go) & (go < to)]
        nxt[mutual] = mutual
        if not (nxt != np.arange(len(p))).any():
            break
        up = _ends(nxt)[up]
    ra, rb = up[a[live]], up[b[live]]
    out = halo[ra] | halo[rb]
    pair = np.minimum(ra, rb) * len(p) + np.maximum(ra, rb)
    low = np.zeros(len(live), bool)
    low[np.unique(pair, return_index=True)[1]] = True  # edges ascend: the first is the lowest
    k = live[out | low]
    return up, (up[a[k]], up[b[k]], hi[k], lo[k], pa[k], pb[k])
