"""Distances inside masks by the eikonal equation, block by block in rounds.

The distance u solves |grad u| = 1 inside the mask, in the upwind scheme of first
order: at each voxel the sum over axes of ((u - least neighbour)+ / spacing)^2 is
1. That has one solution, whatever order the voxels are updated in, so blocks can
be relaxed apart from each other until none of them moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.operators import components as C
from voxelgrain.operators import volume as V
from voxelgrain.operators.distance import nearest_structure
from voxelgrain.storage import parts, stage

Size = tuple[float, float, float]
AXES = "zyx"
#: Voxels of blocks that are relaxed together, about.
TOGETHER = 1 << 16


def upwind(near: np.ndarray, size: Size) -> np.ndarray:
    """The update from the least neighbour along each axis, (3, n), infinite where none.

    Axes are taken in from the nearest neighbour on, as long as the next one
    lies under what the former give.
    """
    a, w = list(near), [np.full(near.shape[1], 1 / float(h) ** 2) for h in size]
    for i, j in ((0, 1), (1, 2), (0, 1)):  # put in order, equal ones as they are
        swap = a[j] < a[i]
        a[i], a[j] = np.where(swap, a[j], a[i]), np.where(swap, a[i], a[j])
        w[i], w[j] = np.where(swap, w[j], w[i]), np.where(swap, w[i], w[j])
    some = np.isfinite(a[0])
    low = np.where(some, a[0], 0.0)
    above = np.where(some, 1 / np.sqrt(w[0]), np.inf)
    p, q, r = w[0], 0.0, -1.0
    for k in (1, 2):
        gap = np.where(np.isfinite(a[k]), a[k] - low, np.inf)
        more = gap < above
        g = np.where(more, gap, 0.0)
        p, q, r = p + w[k], q + w[k] * g, r + w[k] * g * g
        above = np.where(more, (q + np.sqrt(np.maximum(q * q - p * r, 0.0))) / p, above)
    return low + above


def relax(at: np.ndarray, known: np.ndarray, free: np.ndarray, size: Size, limit: float = np.inf) -> np.ndarray:
    """Distances of voxels ``at`` (n, 3) after all updates; only ``free`` ones move."""
    lo = at.min(0) - 1
    span = at.max(0) - lo + 2
    key = ((at[:, 0] - lo[0]) * span[1] + at[:, 1] - lo[1]) * span[2] + at[:, 2] - lo[2]
    order = np.argsort(key)
    find = key[order]
    n = len(at)

    def neighbour(step: int) -> np.ndarray:
        want = key + step
        i = np.minimum(np.searchsorted(find, want), n - 1)
        return np.where(find[i] == want, order[i], n)  # n: no such voxel

    side = np.stack([[neighbour(-s), neighbour(s)] for s in (int(span[1] * span[2]), int(span[2]), 1)])
    d = np.append(known, np.inf)
    todo = np.flatnonzero(free)
    tiny = 1e-12 * min(size)
    while len(todo):
        new = upwind(d[side[:, :, todo]].min(1), size)
        better = (new < d[todo] - tiny) & (new < limit)
        moved = todo[better]
        d[moved] = new[better]
        touched = np.zeros(n + 1, bool)
        touched[side[:, :, moved].ravel()] = True
        todo = np.flatnonzero(touched[:n] & free)
    return d[:n]


def eikonal_distance(
    mask: DataFrame, start: DataFrame, size: Size = (1.0, 1.0, 1.0), limit: float | None = None, keys: tuple[str, ...] = ("tomo",), block: tuple[int, int, int] = (32, 32, 32)
) -> DataFrame:
    """(keys, z, y, x, distance) inside the mask from the start voxels, in units of ``size``.

    Voxels that cannot be reached, or not within less than ``limit``, are left
    out; start voxels outside the mask count for nothing. A block is one row, its
    voxels and those it knows of beside it as bytes. Each round is written; it
    relaxes the blocks that got a message, and these send what has moved on their
    faces to the blocks beside them. The last round is the one that sends
    nothing. Rows with a null key or coordinate are left out, repeated ones count
    once.
    """
    unit, types = list(keys), dict(mask.dtypes)
    pos = [*unit, *AXES]
    clean = lambda v: v.select(*unit, *[F.col(c).cast("int").alias(c) for c in AXES]).dropna().distinct()
    first = clean(start).withColumn("distance", F.lit(0.0))
    cell = [f"_b{c}" for c in AXES]
    own = {f"_b{c}": F.floor(F.col(c) / b) for c, b in zip(AXES, block, strict=True)}
    key = [*unit, *cell]
    voxels = stage(clean(mask).join(first.hint("merge"), pos, "left").withColumns(own), "eikonal-voxels")
    n = parts(voxels.sparkSession, voxels.count())
    head = ", ".join([*[f"`{k}` {types[k]}" for k in unit], *[f"{c} long" for c in cell]])
    schema = f"{head}, at binary, d binary"
    most = np.inf if limit is None else float(limit)
    packed = voxels.repartition(n, *key).groupBy(*key).applyInArrow(_packed(key, block), schema)
    made = stage(packed.withColumn("inbox", F.lit(None).cast("array<struct<at:binary,d:binary>>")).mapInArrow(_round(key, block, size, most, True), f"{schema}, sent boolean"), "eikonal")
    while not (sent := made.where("sent")).isEmpty():
        inbox = sent.repartition(n, *key).groupBy(*key).agg(F.collect_list(F.struct("at", "d")).alias("inbox"))
        state = made.where("not sent").drop("sent").repartition(n, *key)
        made = stage(state.join(inbox.hint("merge"), key, "left").mapInArrow(_round(key, block, size, most, False), f"{schema}, sent boolean"), "eikonal")
    fields = ", ".join([*[f"`{k}` {types[k]}" for k in unit], "z int, y int, x int, distance double"])
    return made.where("not sent").mapInArrow(_unpacked(unit, block), fields)


def _packed(key: list[str], block: tuple[int, int, int]) -> Callable:
    """A block's voxels as one row: places in the block with a rim of one voxel, and distances."""

    def work(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        local = [t[c].to_numpy().astype(np.int64) - t[f"_b{c}"][0].as_py() * b + 1 for c, b in zip(AXES, block, strict=True)]
        at = np.ravel_multi_index(local, [b + 2 for b in block]).astype(np.int32)
        d = t["distance"].fill_null(np.inf).to_numpy().astype(np.float64)
        order = np.argsort(at)
        return t.slice(0, 1).select(key).append_column("at", pa.array([at[order].tobytes()], pa.binary())).append_column("d", pa.array([d[order].tobytes()], pa.binary()))

    return work


def _met(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places of a block and their distances, the least of what it knows and what it is told."""
    told = row["inbox"] or []
    at = np.concatenate([np.frombuffer(m["at"], np.int32) for m in [row, *told]])
    d = np.concatenate([np.frombuffer(m["d"], np.float64) for m in [row, *told]])
    if not told:
        return at, d
    order = np.argsort(at, kind="stable")
    at, d = at[order], d[order]
    top = np.flatnonzero(np.diff(at, prepend=-1))
    return at[top], np.minimum.reduceat(d, top)


def _round(key: list[str], block: tuple[int, int, int], size: Size, limit: float, first: bool) -> Callable:
    """Blocks with a message relaxed, and what they send; in the first round all blocks with a start."""
    wide = [b + 2 for b in block]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["at", "d", "inbox"]).to_pylist()
            cells = np.stack([batch.column(c).to_numpy() for c in key[-3:]], 1)
            met = [(k, *_met(r)) for k, r in enumerate(rows) if first or r["inbox"]]
            met = [m for m in met if not first or np.isfinite(m[2]).any()]
            # row of the batch, cell, at, d, sent
            busy = {m[0] for m in met}
            out = [(k, cells[k], r["at"], r["d"], False) for k, r in enumerate(rows) if k not in busy]
            while met:
                held = np.cumsum([len(at) for _, at, _ in met])
                some, met = met[: max(1, int(np.searchsorted(held, TOGETHER)))], met[max(1, int(np.searchsorted(held, TOGETHER))) :]
                cut = np.cumsum([len(at) for _, at, _ in some])[:-1]
                local = np.stack(np.unravel_index(np.concatenate([at for _, at, _ in some]), wide), 1)
                known = np.concatenate([d for _, _, d in some])
                mine = np.all((local >= 1) & (local <= np.array(block)), axis=1)
                apart = local.copy()  # blocks lie side by side and never touch
                apart[:, 0] += np.repeat(np.arange(len(some)), [len(at) for _, at, _ in some]) * (wide[0] + 1)
                new = relax(apart, known, mine, size, limit)
                moved = mine & (np.isfinite(new) if first else new < known)
                for (k, at, _), d, m, o in zip(some, np.split(new, cut), np.split(moved, cut), np.split(local, cut), strict=True):
                    out.append((k, cells[k], at.tobytes(), d.tobytes(), False))
                    for axis, b in enumerate(block):
                        for step, face, rim in ((-1, 1, b + 1), (1, b, 0)):
                            go = np.flatnonzero(m & (o[:, axis] == face))
                            if len(go):
                                to, place = cells[k].copy(), o[go].copy()
                                to[axis] += step
                                place[:, axis] = rim
                                out.append((k, to, np.ravel_multi_index(place.T, wide).astype(np.int32).tobytes(), d[go].tobytes(), True))
            if out:
                row, cell, at, d, sent = zip(*out, strict=True)
                cell, row = np.stack(cell), pa.array(row)
                cols = [*[batch.column(c).take(row) for c in key[:-3]], *[pa.array(cell[:, j]) for j in range(3)], pa.array(at, pa.binary()), pa.array(d, pa.binary()), pa.array(sent)]
                yield pa.RecordBatch.from_arrays(cols, names=[*key, "at", "d", "sent"])

    return work


def _unpacked(unit: list[str], block: tuple[int, int, int]) -> Callable:
    """Rows (unit, z, y, x, distance) of the voxels of blocks that are reached."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.stack([batch.column(f"_b{c}").to_numpy() for c in AXES], 1)
            for k in range(batch.num_rows):
                at, d = np.frombuffer(batch.column("at")[k].as_py(), np.int32), np.frombuffer(batch.column("d")[k].as_py(), np.float64)
                local = np.stack(np.unravel_index(at, [b + 2 for b in block]), 1)
                on = np.all((local >= 1) & (local <= np.array(block)), axis=1) & np.isfinite(d)
                where = (local[on] - 1 + cells[k] * np.array(block)).astype(np.int32)
                same = pa.array(np.full(len(where), k))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(same) for c in unit], *[pa.array(where[:, j]) for j in range(3)], pa.array(d[on])], names=[*unit, *AXES, "distance"])

    return work


def membrane_by_path(membrane: DataFrame, reference: DataFrame, max_distance: float, size: Size = (1.0, 1.0, 1.0), exclude: int = 0, depth: int | None = None, min_size: int = 0) -> DataFrame:
    """(tomo, z, y, x): membrane within ``max_distance`` along itself of a reference object.

    The path to each object starts at the membrane voxel nearest to it (in
    voxels; the first of equally near ones). ``exclude`` slices are cut off both
    ends of the ``depth``; membrane fragments, joined over faces, of
    ``min_size`` voxels or fewer are left out (0: none are). No path is shorter
    than the straight line, so each object gets only the membrane around its
    start, met in cells as wide as the limit.
    """
    if exclude and depth:
        membrane, reference = V.slab(membrane, exclude, depth), V.slab(reference, exclude, depth)
    membrane = membrane.select(*V.POS).dropna().distinct()
    if min_size:
        parts = C.components(membrane, 1).withColumnRenamed("component", "label")
        membrane = V.size_filter(parts, min_size, strict=True).select(*V.POS)
    membrane = stage(membrane, "membrane")
    near = nearest_structure(reference, membrane.withColumn("label", F.lit(1).cast("long")), by_structure=True)
    start = stage(near.select("tomo", "label", "ep_structure.*"), "membrane-start")
    cell = [f"_c{c}" for c in AXES]
    in_cell = {k: F.floor(F.col(c) * float(s) / float(max_distance)) for k, c, s in zip(cell, AXES, size, strict=True)}
    spread = start.withColumns(in_cell)
    for k in cell:
        spread = spread.withColumn(k, F.explode(F.array(*[F.col(k) + d for d in (-1, 0, 1)])))
    spread = spread.withColumnsRenamed({c: f"_s{c}" for c in AXES})
    gap = sum((F.pow((F.col(c) - F.col(f"_s{c}")) * float(s), 2) for c, s in zip(AXES, size, strict=True)), F.lit(0.0))
    local = membrane.withColumns(in_cell).join(spread.hint("merge"), ["tomo", *cell]).where(gap <= float(max_distance) ** 2)
    reached = eikonal_distance(local.select("tomo", "label", *AXES), start, size, max_distance, ("tomo", "label"))
    return reached.select(*V.POS).distinct()
