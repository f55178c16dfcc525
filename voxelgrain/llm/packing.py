"""Best-fit packing of tokenised documents by non-negative least squares.

A document becomes pieces of at most ``capacity`` tokens. The driver sees only
the histogram of their lengths, ``capacity`` numbers at most whatever the
corpus holds: it enumerates the patterns of one to three lengths that fill a
sequence exactly, fits how often each is to be used to the histogram by
non-negative least squares, rounds, and packs what is left by best fit, again
length by length. Spark then ranks the pieces of every length, and a piece finds
its sequence by its rank in the runs of patterns that use its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelgrain.llm.bpe import Encoder, share
from voxelgrain.llm.common import slices, stage

CAPACITY = 2048
#: Id that ends every document.
END = 0
#: Rounds of the active set, each of which may take in one pattern a length.
ROUNDS = 8
#: Rows ranked together: numbers of rows are cut into blocks of 2^16.
BLOCK_BITS = 16


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's pieces.

    Its ids and one ``END``; if longer than ``capacity``, the first piece takes
    what does not fill a whole one. Null and empty texts are one piece of one id.
    """
    end, shared = END.to_bytes(4, "little"), share(documents, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(state=shared.value)
        for b in slices(batches, "_text", 8_000_000):
            rows: list[tuple[int, int, int, int]] = []
            doc: list[int] = []
            for i, ids in enumerate(coder.encode(b.column(1).to_pylist())):
                raw = memoryview(ids + end)
                total = len(raw) // 4
                cuts = [0, *range((total - 1) % capacity + 1, total + 1, capacity)]
                doc += [i] * (len(cuts) - 1)
                rows += [(p, a, z - a, zlib.crc32(raw[4 * a : 4 * z])) for p, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), *cols], names=[id_col, "piece", "start", "length", "ids_crc32"])

    src = documents.select(id_col, F.col(text).alias("_text"))
    return src.mapInArrow(work, f"`{id_col}` {src.dtypes[0][1]}, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All sets of one to three of the lengths that fill a sequence exactly; 0 stands for none."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    out = [np.array([[capacity, 0, 0]])[: int(there[capacity])]]
    a = np.flatnonzero(there)
    pair = a[(2 * a >= capacity) & (a < capacity)]
    pair = pair[there[capacity - pair]]
    out.append(np.stack([pair, capacity - pair, np.zeros_like(pair)], 1))
    for x in a[3 * a >= capacity].tolist():  # x >= y >= z
        y = a[(a <= x) & (2 * a >= capacity - x) & (a < capacity - x)]
        y = y[there[capacity - x - y]]
        out.append(np.stack([np.full_like(y, x), y, capacity - x - y], 1))
    return np.concatenate(out)


def fit(pattern: np.ndarray, count: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(pattern numbers, uses >= 0) that come near to the counts of lengths.

    Active-set least squares: a round takes in the patterns of steepest descent
    that share no length, solves for all that are in and lets go of those that
    come out negative, until none does. Rounds end where they gain under 1 %.
    """
    capacity = len(count) - 1
    goal = count.astype(float)
    goal[0] = 0.0
    inside, x, least = np.zeros(0, np.int64), np.zeros(0), float((goal**2).sum())

    def columns(at: np.ndarray) -> np.ndarray:
        m = np.zeros((capacity + 1, len(at)))
        for j in range(3):
            np.add.at(m, (pattern[at, j], np.arange(len(at))), 1.0)
        m[0] = 0.0
        return m

    norm = np.sqrt((pattern > 0).sum(1))
    for _ in range(rounds):
        slope = (goal - columns(inside) @ x)[pattern].sum(1) / norm
        slope[inside] = 0
        steep = np.flatnonzero(slope > 0.5)
        taken, fresh = np.zeros(capacity + 1, bool), []
        for p in steep[np.argsort(-slope[steep], kind="stable")][: 32 * capacity].tolist():
            ls = [n for n in pattern[p].tolist() if n]
            if not taken[ls].any():
                taken[ls] = True
                fresh.append(p)
        if not fresh:
            break
        trial = np.concatenate([inside, np.array(fresh, np.int64)])
        while True:
            m = columns(trial)
            best = np.linalg.solve(m.T @ m + 1e-6 * np.eye(len(trial)), m.T @ goal)
            if (best > 0).all():
                break
            trial = trial[best > 0]
        off = float(((goal - m @ best) ** 2).sum())
        if off > 0.99 * least:
            break
        inside, x, least = trial, best, off
    return inside, x


def best_fit(count: np.ndarray) -> list[tuple[list[int], int]]:
    """[(lengths, uses)] for counts of lengths: each sequence starts with the
    longest piece and takes, again and again, the one that leaves the least gap;
    a filling is used as often as its pieces last."""
    capacity, left, out = len(count) - 1, count.tolist(), []
    there = [n for n in range(1, capacity + 1) if left[n]]
    while there:
        gap, mine = capacity, []
        free = dict.fromkeys(there, 0)
        k = len(there)
        while k and gap:
            k = bisect_right(there, gap, 0, k)
            if not k:
                break
            n = there[k - 1]
            if free[n] == left[n]:
                k -= 1
                continue
            free[n] += 1
            mine.append(n)
            gap -= n
        uses = min(left[n] // free[n] for n in set(mine))
        out.append((mine, uses))
        for n in set(mine):
            left[n] -= uses * free[n]
        there = [n for n in there if left[n]]
    return out


def plan(count: np.ndarray) -> list[tuple[list[int], int]]:
    """[(lengths, uses)] that hold every piece of a histogram, ``count[n]`` of length n."""
    left = count.astype(np.int64).copy()
    kinds = patterns(np.flatnonzero(left), len(count) - 1)
    inside, x = fit(kinds, left.astype(float))
    out = []
    for p in np.argsort(-x, kind="stable").tolist():
        mine = [n for n in kinds[inside[p]].tolist() if n]
        uses = min(int(x[p]), *[int(left[n]) // mine.count(n) for n in mine])
        if uses > 0:
            out.append((mine, uses))
            for n in mine:
                left[n] -= uses
    return out + best_fit(left)


def runs(made: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: ranks at which runs of one place in a pattern start, their first sequence, their offset."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for lengths, uses in made:
        offset = 0
        for n in lengths:
            out.setdefault(n, []).append((used.get(n, 0), first, offset))
            used[n] = used.get(n, 0) + uses
            offset += n
        first += uses
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in out.items()}


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence_id and offset in it.

    Null and empty texts are one piece that holds the end alone. Very long texts
    fill sequences of their own but for their first piece. Repeated rows and
    repeated or null ids are each packed; which of the pieces of one length goes
    where follows their order in the written table. An empty table gives no
    rows. Other columns are not read.
    """
    made = pieces(documents, path, capacity, id_col, text).withColumn("_row", F.monotonically_increasing_id())
    rows = stage(made.withColumn("_block", F.shiftright("_row", BLOCK_BITS)), "packing-pieces")
    count = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # ``capacity`` rows at most
        count[r["length"]] = r["count"]
    place = runs(plan(count))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("length", "_block").count().select("length", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_block").orderBy("_row"))
    ranked = rows.withColumn("_in", inside).join(blocks, ["length", "_block"]).withColumn("_rank", F.col("_before") + F.col("_in") - 1)
    keep = [id_col, "piece", "start", "length", "ids_crc32"]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length).tolist():
                mine = np.flatnonzero(length == n)
                start, first, at = place[n]
                k = np.searchsorted(start, rank[mine], "right") - 1
                sequence[mine], offset[mine] = first[k] + rank[mine] - start[k], at[k]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    kept = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
    return ranked.select(*keep, "_rank").mapInArrow(locate, f"{kept}, sequence_id long, offset long")
