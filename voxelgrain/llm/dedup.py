"""Near-duplicates: MinHash bands, Odd sketches and exact confirmation.

1. Each document gets its set of word shingles (64-bit hashes), a key of the
   whole set, MinHash bands and an Odd sketch: one-permutation MinHash samples
   folded into a parity bitmap. Documents with one set are one node from here on.
2. Nodes that share a band meet in a bucket; a pair belongs to the first band
   it shares. A bucket is cut into blocks of bounded size; a task compares the
   sketches of two blocks (the population count of their XOR estimates how many
   samples differ), leaves out what cannot reach the threshold, and returns a
   forest of the likeliest links, never all pairs of a group. The links are
   confirmed on full sets and joined into components.
3. Buckets that still hold several components are compared again. Rows with a
   candidate in another component get their full sets, and a task confirms, in
   order of likelihood, every candidate that would still join two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.common import Hashes, mix, offsets, slices, stage, words_of

BANDS, ROWS = 28, 4
SAMPLES = 1024
SKETCH_BITS = 2048
BLOCK = 1024
#: Standard errors of the estimate that a pair may lie under the threshold.
MARGIN = 5.5


class Shingler:
    """Sorted distinct shingle hashes of texts, for one size of shingle."""

    def __init__(self, size: int):
        self.size, self.words = size, Hashes(41)

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [words_of(t) for t in texts]
        n = [len(c) for c in cut]
        flat = self.words.of([w for c in cut for w in c])
        at, k = offsets(n), self.size
        p = np.uint64(0x9DDFEA08EB382D69)
        many = max(0, len(flat) - k + 1)
        roll = flat[:many].copy()
        for j in range(1, k):
            roll = roll * p + flat[j : j + many]
        roll = mix(roll + np.uint64(k))
        out = []
        for i, m in enumerate(n):
            if m >= k:
                out.append(np.unique(roll[at[i] : at[i] + m - k + 1]))
            elif m:  # fewer words than a shingle: the whole sequence is one
                h = np.uint64(0)
                with np.errstate(over="ignore"):
                    for w in flat[at[i] : at[i + 1]]:
                        h = h * p + w
                    out.append(mix(np.array([h + np.uint64(m << 32)])))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(Odd sketch bytes, number of samples) of sorted sets.

    The samples of a set are the least hash in each of ``SAMPLES`` equal ranges.
    """
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    cell = doc * SAMPLES + (flat >> np.uint64(64 - SAMPLES.bit_length() + 1)).astype(np.int64)
    first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
    bit = (mix(flat[first]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(doc[first] * SKETCH_BITS + bit, minlength=len(sets) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), SKETCH_BITS), axis=1), np.bincount(doc[first], minlength=len(sets))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """Band hashes of non-empty sets, one row of ``BANDS`` each."""
    starts, flat = offsets([len(s) for s in sets])[:-1], np.concatenate(sets)
    r = np.random.default_rng(9)
    a = r.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = r.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
    out = np.zeros((len(sets), BANDS), np.uint64)
    for j in range(BANDS * ROWS):
        low = np.minimum.reduceat(flat * a[j] + b[j], starts)
        out[:, j // ROWS] = mix(out[:, j // ROWS] + low + np.uint64(j))
    return out


def _prepare(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Shingler(shingle)
        for b in slices(batches, "_text", 4_000_000):
            sets = cutter.batch(b.column(1).to_pylist())
            full = [i for i, s in enumerate(sets) if len(s)]
            key, band, odd, marks, n = [None] * len(sets), [None] * len(sets), [None] * len(sets), [None] * len(sets), [0] * len(sets)
            if full:
                some = [sets[i] for i in full]
                hashed = bands(some).astype(np.int64)
                bits, samples = sketch(some)
                for row, i in enumerate(full):
                    key[i], band[i], odd[i], marks[i], n[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), hashed[row], bits[row].tobytes(), hashed[row].astype(np.uint32).tobytes(), int(samples[row])
            size = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(odd, pa.binary()), pa.array(marks, pa.binary()), pa.array(n, pa.int32())], names=["id", "n_shingles", "key", "bands", "sketch", "marks", "samples"])

    return work


def prepare(documents: DataFrame, shingle: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    src = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("_text"))
    return stage(src.mapInArrow(_prepare(shingle), "id long, n_shingles long, key binary, bands array<long>, sketch binary, marks binary, samples int"), "dedup-sets")


def _ranges(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, variance) of the samples in which two sets differ.

    ``common`` shingles are in both sets, ``a`` and ``b`` in one alone; each
    falls into one of the ranges. A range gives 1 if only one set has a sample
    there and 2 if both have and the samples differ. The variance is that of
    Poisson loads less what the known sizes explain.
    """
    c, a, b = common / SAMPLES, a / SAMPLES, b / SAMPLES
    whole = np.maximum(c + a + b, 1e-9)
    no_a, no_b, none = np.exp(-c - a), np.exp(-c - b), np.exp(-whole)
    hit = (1 - none) / whole  # chance that the least hash is a given part, over its load
    slope = (none * (1 + whole) - 1) / whole**2
    one, two = no_a + no_b - 2 * none, np.maximum(1 - no_a - no_b + none - c * hit, 0)
    mean = one + 2 * two
    by_c, by_a, by_b = no_a + no_b - 2 * (hit + c * slope), no_a - 2 * c * slope, no_b - 2 * c * slope
    var = one + 4 * two - mean**2 - c * by_c**2 - a * by_a**2 - b * by_b**2
    return SAMPLES * mean, SAMPLES * np.maximum(var, 0)


def estimate(z: np.ndarray, na: np.ndarray, nb: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, standard error) from differing bits ``z``, samples and set sizes.

    Of the ranges that the union fills, a share as large as the similarity has
    one sample in both sets; how many are filled follows from the size of the
    union, (sa + sb) / (1 + similarity). Newton steps solve for the similarity.
    """
    n = float(SKETCH_BITS)
    differ = -n / 2 * np.log(np.maximum(1 - 2 * z / n, 1e-3))
    # more or fewer ranges filled than the sizes let expect: the same holds of the union
    scale = (2 - np.exp(-sa / SAMPLES) - np.exp(-sb / SAMPLES)) * SAMPLES / np.maximum(na + nb, 1)
    both = np.clip((na + nb - differ) / 2, 0, np.minimum(na, nb)) * scale
    j = np.minimum(both / np.maximum((na + nb) * scale - both, 1), 1)
    for _ in range(4):
        load = (sa + sb) / (1 + j) / SAMPLES
        none = np.exp(-load)
        filled = np.maximum(SAMPLES * (1 - none), 1)
        slope = np.maximum(filled - SAMPLES * j * load * none / (1 + j), 0.1)
        j = np.clip(j - (j * filled - both) / slope, 0, 1)
    common = (sa + sb) * j / (1 + j)
    _, var = _ranges(common, sa - common, sb - common)
    noise = np.maximum(n / 4 * (np.exp(np.minimum(4 * differ / n, 20)) - 1) - differ, 0.25)
    return j, np.sqrt(var + noise) / (2 * slope)


def most_bits(sa: np.ndarray, sb: np.ndarray, threshold: float) -> np.ndarray:
    """Most differing bits of a pair of sets of these sizes at the threshold.

    Bits are allowed up to ``MARGIN`` standard errors over their mean, with
    Bernstein's term for the tail of small counts. No pair has more than two for
    each shingle that only one set has, so sparse ranges need no more.
    """
    n = float(SKETCH_BITS)
    common = (sa + sb) * threshold / (1 + threshold)
    a, b = np.maximum(sa - common, 0), np.maximum(sb - common, 0)
    differ, var = _ranges(common, a, b)
    left = np.exp(-2 * differ / n)
    spread = var * left**2 + n / 4 * (1 - left**2 * (1 + 4 * differ / n))
    return np.minimum(2 * (a + b), n / 2 * (1 - left) + MARGIN * np.sqrt(spread) + MARGIN**2 / 3) + 1e-6


def may_link(z: np.ndarray, na: np.ndarray, nb: np.ndarray, sa: np.ndarray, sb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the pairs that may reach the threshold, their similarity)."""
    ok = np.flatnonzero(z <= most_bits(sa, sb, threshold))
    return ok, estimate(z[ok], na[ok], nb[ok], sa[ok], sb[ok])[0]


def _find(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _candidates(rows: list[tuple], threshold: float) -> tuple[np.ndarray, ...]:
    """(a, b, ids, components): row numbers of pairs that may be linked.

    Rows are (side, id, comp, samples, size, sketch, marks, band). Rows of side
    0 are compared with all rows. Likelier pairs come first.
    """
    left, ident, comp = np.array([r[0] == 0 for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    na, size = np.array([r[3] for r in rows], float), np.array([r[4] for r in rows], float)
    bits = np.ascontiguousarray(np.frombuffer(b"".join(r[5] for r in rows), np.uint64).reshape(len(rows), -1).T)
    marks, band = np.frombuffer(b"".join(r[6] for r in rows), np.uint32).reshape(len(rows), -1), rows[0][7]
    out: list[tuple] = []
    at_left = np.flatnonzero(left)
    for i in range(0, len(at_left), 64):
        a = at_left[i : i + 64]
        may = (comp[a][:, None] != comp[None, :]) & (ident[a][:, None] != ident[None, :]) & ~(left[None, :] & (ident[a][:, None] > ident[None, :]))
        may &= np.minimum(size[a][:, None], size[None, :]) >= threshold * np.maximum(size[a][:, None], size[None, :])
        x, y = np.nonzero(may)
        if len(x) > 0.3 * may.size:
            z = np.zeros(may.shape, np.int64)
            for word in bits:
                z += np.bitwise_count(word[a][:, None] ^ word[None, :])
            z = z[x, y]
        else:
            z = np.zeros(len(x), np.int64)
            for word in bits:
                z += np.bitwise_count(word[a[x]] ^ word[y])
        x = a[x]
        ok, j = may_link(z, na[x], na[y], size[x], size[y], threshold)
        x, y = x[ok], y[ok]
        own = (marks[x] == marks[y]).argmax(1) == band
        out.append((x[own], y[own], j[own]))
    a, b, j = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, int) for k in range(3))
    order = np.lexsort((np.maximum(ident[a], ident[b]), np.minimum(ident[a], ident[b]), -j))
    return a[order], b[order], ident, comp


def _forest(a: np.ndarray, b: np.ndarray, comp: np.ndarray) -> list[int]:
    """Numbers of the pairs of a spanning forest over components, likeliest first.

    Every component takes its first pair to another one, components merge, and
    so on until no pair is left between two of them.
    """
    _, part = np.unique(comp, return_inverse=True)
    chosen: list[int] = []
    live = np.arange(len(a))
    while True:
        live = live[part[a[live]] != part[b[live]]]
        if not len(live):
            return chosen
        best = np.full(part.max() + 1, len(a))
        np.minimum.at(best, part[a[live]], live)
        np.minimum.at(best, part[b[live]], live)
        parent: dict[int, int] = {}
        for k in np.unique(best[best < len(a)]).tolist():
            x, y = _find(parent, int(part[a[k]])), _find(parent, int(part[b[k]]))
            if x != y:
                parent[x] = y
                chosen.append(k)
        part = np.array([_find(parent, p) for p in range(part.max() + 1)])[part]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of a partition that is sorted by (bucket, i, j), with two rows or more."""
    key, rows = None, []
    for b in batches:
        for bucket, i, j, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (bucket, i, j) != key:
                if len(rows) > 1:
                    yield key, rows
                key, rows = (bucket, i, j), []
            rows.append(tuple(row))
    if len(rows) > 1:
        yield key, rows


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in "ij" else pa.int64()) for c, n in zip(cols, names, strict=True)], names=names)


def _likely(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = set()
        for _, rows in _groups(batches):
            a, b, ident, comp = _candidates(rows, threshold)
            for k in _forest(a, b, comp):
                x, y = int(ident[a[k]]), int(ident[b[k]])
                out.add((min(x, y), max(x, y)))
        yield _batch(list(out), ["a", "b"])

    return work


def _needed(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches):
            a, b, ident, _ = _candidates(rows, threshold)
            if len(a):
                yield _batch([(*key, int(ident[k])) for k in np.unique(np.concatenate([a, b]))], ["bucket", "i", "j", "id"])

    return work


def _exact(threshold: float, per_cent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = set()
        for _, rows in _groups(batches):
            sets = [np.frombuffer(r[8], np.uint64) for r in rows]
            a, b, ident, comp = _candidates(rows, threshold)
            parent: dict[int, int] = {}
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                x, y = _find(parent, int(comp[p])), _find(parent, int(comp[q]))
                if x == y:
                    continue
                same = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if 100 * same >= per_cent * (len(sets[p]) + len(sets[q]) - same):
                    parent[x] = y
                    out.add((int(ident[p]), int(ident[q])))
        yield _batch(list(out), ["a", "b"])

    return work


def _slots(ids: DataFrame, most_bits: int = 24) -> tuple[int, np.ndarray]:
    """(slots, bitmap) of hashed ids; 2 MB at most, however many ids there are."""
    n = ids.count()
    slots = 1 << min(most_bits, max(10, (16 * n).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(slots))
    got = ids.select((slot / 32).cast("long").alias("w"), (slot % 32).cast("int").alias("s")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("m")).toPandas()
    bitmap = np.zeros(slots // 32, np.uint32)
    bitmap[got["w"].to_numpy(np.int64)] = got["m"].to_numpy(np.int64).astype(np.uint32)
    return slots, bitmap


def full_sets(documents: DataFrame, ids: DataFrame, shingle: int, id_col: str, text: str) -> DataFrame:
    """(id, shingles): the whole sets of the documents with these ids.

    A bitmap of fixed size tells which texts may be needed; only those are cut
    again and moved. An id that repeats has a row for each of its sets.
    """
    slots, bitmap = _slots(ids)
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)
    src = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("_text")).where("id is not null").withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(slots)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, marks = Shingler(shingle), shared.value
        for b in batches:
            slot = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.flatnonzero((marks[slot // 32] >> (slot % 32).astype(np.uint32)) & 1)
            for part in slices(iter([b.take(pa.array(at))]), "_text", 4_000_000):
                got = cutter.batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in got], pa.binary())], names=["id", "shingles"])

    return stage(src.mapInArrow(work, "id long, shingles binary").join(ids, "id", "left_semi").dropDuplicates(), "dedup-full")


def confirm(pairs: DataFrame, full: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; of a repeated id any set counts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * same >= per_cent * (len(x) + len(y) - same) and len(x) > 0)
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    both = pairs.join(full.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(full.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): least id reachable, for all ids in edges (a, b).

    Every node points to its least neighbour, pointers are doubled until they
    reach roots, and edges between different roots go on to the next round.
    """
    names, rest = None, edges.select("a", "b").where("a <> b")
    while True:
        rest = stage(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
        if rest.isEmpty():
            return names if names is not None else edges.sparkSession.createDataFrame([], "id long, comp long")
        both = rest.union(rest.select("b", "a"))
        up = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), "cc-up")
        while True:
            over = up.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
            jumped = stage(up.join(over, "comp").select("id", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("moved")), "cc-jump")
            up, moved = jumped.select("id", "comp"), not jumped.where("moved").isEmpty()
            if not moved:
                break
        root = up.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        names = up if names is None else names.join(root, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
        a, b = up.select(F.col("id").alias("a"), F.col("comp").alias("ra")), up.select(F.col("id").alias("b"), F.col("comp").alias("rb"))
        rest = rest.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def _merge(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) after links (a, b) between ids have joined their components."""
    of = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
    merged = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return comp.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))


def _blocks(now: DataFrame, block: int) -> DataFrame:
    """Groups (bucket, i, j) of rows to compare, from (id, comp, bucket, ...).

    Only buckets with several components count. Rows outside a bucket's largest
    component are asked about (side 0) in blocks i; all rows answer in blocks j.
    """
    per_comp = now.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    about = per_comp.groupBy("bucket").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "comp"))["comp"].alias("main"), F.max("n").alias("of_main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    now = now.join(about, "bucket").withColumn("ni", F.ceil((F.col("rows") - F.col("of_main")) / block).cast("int")).withColumn("nj", F.ceil(F.col("rows") / block).cast("int"))
    mine = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    asks = F.when(F.col("comp") != F.col("main"), F.transform(upto("nj"), lambda j: at(mine("ni", "i"), j, 0)))
    answers = F.when((F.col("comp") == F.col("main")) | (F.col("ni") > 1) | (F.col("nj") > 1), F.transform(upto("ni"), lambda i: at(i, mine("nj", "j"), 1)))
    none = F.array().cast("array<struct<i:int,j:int,side:int>>")
    both = now.withColumn("_at", F.explode(F.concat(F.coalesce(asks, none), F.coalesce(answers, none))))
    return both.select("bucket", "_at.i", "_at.j", "_at.side", "id", "comp", "samples", "n_shingles", "sketch", "marks", "band")


def _sorted(group: DataFrame) -> DataFrame:
    return group.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def near_duplicates(documents: DataFrame, shingle: int = 5, per_cent: int = 80, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Rows are linked whose shingle sets have 100 * intersection >= per_cent *
    union; a component's id is its least id and that row is kept. Rows without
    words, with a null text or a null id are linked with nothing and kept.
    Rows that repeat an id share its component; each repeat of the component's
    own id is marked kept. An empty table gives none.
    """
    docs = prepare(documents, shingle, id_col, text)
    live = docs.where(F.col("key").isNotNull() & F.col("id").isNotNull())
    node = live.groupBy("key").agg(F.min("id").alias("node"))
    # one row for each set: its sketch and bands under its least id
    nodes = stage(live.select("id", "key", "bands", "sketch", "marks", "samples", "n_shingles").join(node.withColumnRenamed("node", "id"), ["key", "id"]).dropDuplicates(["key"]).drop("key"), "dedup-nodes")
    in_bucket = nodes.select("id", F.posexplode("bands").alias("band", "bucket")).dropDuplicates(["bucket", "id"])
    crowded = in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = stage(in_bucket.join(crowded, "bucket").join(nodes.drop("bands"), "id"), "dedup-rows")
    limit = per_cent / 100
    # first round: every node is a component of its own
    group = _blocks(rows.withColumn("comp", F.col("id")), block)
    pairs = stage(_sorted(group).mapInArrow(_likely(limit), "a long, b long").distinct(), "dedup-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = confirm(pairs, full_sets(documents, ids, shingle, id_col, text), per_cent)
    comp = stage(_merge(nodes.select("id", F.col("id").alias("comp")).distinct(), links), "dedup-comp")
    # second round: what may still join two components, on full sets in the task
    group = _blocks(rows.join(comp, "id"), block)
    needed = stage(_sorted(group).mapInArrow(_needed(limit), "bucket long, i int, j int, id long").distinct(), "dedup-needed")
    if not needed.isEmpty():
        full = full_sets(documents, needed.select("id").distinct(), shingle, id_col, text)
        more = _sorted(group.join(needed, ["bucket", "i", "j", "id"]).join(full, "id").select(*group.columns, "shingles")).mapInArrow(_exact(limit, per_cent), "a long, b long").distinct()
        comp = stage(_merge(comp, more), "dedup-comp")
    named = node.join(comp.withColumnRenamed("id", "node"), "node").select("key", F.col("comp").alias("component"))
    linked = docs.select("id", "n_shingles", "key").join(named, "key", "left")
    alone = linked.groupBy("id").agg(F.min("component").alias("component")).where("id is not null and component is not null")
    # rows that repeat an id share one component
    out = docs.select("id", "n_shingles").join(alone, "id", "left") if _repeats(docs) else linked
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _repeats(docs: DataFrame) -> bool:
    return not docs.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()
