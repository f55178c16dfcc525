"""Trigram language model in Elias-Fano tries, one trie for each shard of contexts.

Texts are cut into chunks, which are written once. A chunk sends each shard one
block: the part of its own trie (word, pair, trigram, with counts in training
texts) whose contexts belong to that shard. A shard adds up its blocks, builds a
trie and answers every block; chunks then add up the log probabilities of their
texts. Shards are as many as the tokens call for, and the pairs of a frequent
first word are spread over several of them by the second word.

A trie has three levels in one memory map: words (ascending hashes), pairs and
trigrams. Pointers between levels, running counts and the ids of successors are
monotone sequences in Elias-Fano form, read by sampled select over the packed
bits, never unpacked. Ids of successors are relative to their context: each
range continues where the one before ended, and a successor is searched between
the two pointers of its context only. Trigrams keep their discounted probability
as one byte.

    P(w | u v) = max(c(u v w) - D, 0) / c(u v) + D * successors(u v) / c(u v) * P(w | v)
    P(w | v) = max(c(v w) - D, 0) / c(v) + D * successors(v) / c(v) * P(w)

with P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). All counts cover all training
texts and nothing is pruned. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.common import Hashes, mix, offsets, slices, stage, stage_in_buckets, words_of

DISCOUNT = 0.75
CHUNK_BYTES = 5_000_000
SHARD_TOKENS = 4_000_000
#: Least share of a chunk's trigrams for which a first word is reported as frequent:
#: 20,000 words of a chunk, and of the corpus, at most.
LEAST_SHARE = 1 / 20_000
#: A word's pairs are spread over shards in parts of a shard over this number at most.
SPLIT = 8
#: Words that blocks name by number, the commonest of ``SAMPLE_CHUNKS`` chunks. This
#: only shortens blocks: any other word is named by its hash.
COMMON, SAMPLE_CHUNKS = 1 << 17, 8
#: Hashes of the marks: two before each text, one after it, one to follow that.
#: Words never hash to them.
BEGIN2, BEGIN, END, AFTER = 1, 2, 3, 4
LEVELS = 255
LOWEST = -12.0
LOW32 = 0xFFFFFFFF
#: Place of the k-th one of a byte, at 8 * byte + k; masks and constants of a select in a word.
SELECT = np.zeros(256 * 8, np.uint8)
for _byte in range(256):
    _ones = [k for k in range(8) if _byte >> k & 1]
    SELECT[8 * _byte : 8 * _byte + len(_ones)] = _ones
PAIRS, FOURS, BYTES, EACH, SIGNS = (np.uint64(m * 0x0101010101010101) for m in (0x55, 0x33, 0x0F, 0x01, 0x80))
ONE, TWO, THREE, FOUR, EIGHT, LAST, BYTE = (np.uint64(k) for k in (1, 2, 3, 4, 8, 63, 255))
#: Items of a sequence that are read at once.
READ = 1 << 15


def small(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the least type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal weight lie together."""
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64).tobytes()
    kinds = b"".join(a.dtype.str.encode().ljust(8) for a in arrays)
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + kinds + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8).tolist()
    at, out = 8 * (n + 1) + 8 * n, []
    for k, size in enumerate(sizes):
        kind = np.dtype(raw[8 * (n + 1) + 8 * k : 8 * (n + 1) + 8 * k + 8].decode().strip())
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def by_use(numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of 0..n-1 by falling use, ``numbers`` in that order): small numbers are common."""
    order = np.argsort(-np.bincount(numbers, minlength=n), kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place[numbers]


def quantise(p: np.ndarray) -> np.ndarray:
    """log10 of probabilities as one byte; 0 stands for probability 0."""
    with np.errstate(divide="ignore"):
        x = np.log10(p)
    return np.where(p > 0, 1 + np.clip(np.rint((1 - x / LOWEST) * (LEVELS - 1)), 0, LEVELS - 1), 0).astype(np.uint8)


def dequantise(code: np.ndarray) -> np.ndarray:
    table = np.concatenate([[0.0], 10.0 ** (LOWEST * (1 - np.arange(LEVELS) / (LEVELS - 1)))])
    return table[code]


class EliasFano:
    """A non-decreasing sequence of 64-bit values in packed form.

    ``low`` holds l bits of each item, ``high`` the rest in unary; ``rank`` has
    the ones before each word of ``high``, ``hint`` the word of every 64th one.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray, hint: np.ndarray):
        self.n, self.l, self.low, self.high, self.rank, self.hint = n, low_bits, low, high, rank, hint

    @staticmethod
    def parts(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(n, low bits, low, high, rank, hint) of ascending values."""
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        l = max(0, (top // max(1, n)).bit_length() - 1)  # noqa: E741
        low = np.zeros(n * l // 64 + 2, np.uint64)
        if l and n:
            rest = values & np.uint64((1 << l) - 1)
            off = (np.arange(n) * l % 64).astype(np.uint64)
            words = (n * l - l) // 64 + 1  # words in which an item starts; none is skipped
            first = -(-64 * np.arange(words) // l)
            low[:words] = np.add.reduceat(rest << off, first)  # bits of items don't meet: a sum joins them
            last = np.append(first[1:], n) - 1
            over = np.flatnonzero(off[last].astype(np.int64) + l > 64)
            low[over + 1] |= rest[last[over]] >> (np.uint64(64) - off[last[over]])
        top_bits = (values >> np.uint64(l)).astype(np.int64)
        at = top_bits + np.arange(n)
        bits = np.zeros(-(-(n + (int(top_bits[-1]) if n else 0) + 1) // 64) * 64, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        rank = offsets(np.bitwise_count(high)).astype(np.uint32 if n < 1 << 32 else np.uint64)
        return n, l, low, high, rank, (at[::64] >> 6).astype(np.uint32)

    def get(self, at: np.ndarray) -> np.ndarray:
        """Items at these indexes, each below n."""
        word = self.hint[at >> 6].astype(np.int64)
        on = np.flatnonzero(self.rank[word + 1] <= at)
        while len(on):  # a few words on at most, but for runs of zeros
            word[on] += 1
            on = on[self.rank[word[on] + 1] <= at[on]]
        left, x = (at - self.rank[word]).astype(np.uint64), self.high[word]
        # ones of each byte and those below it, all bytes of a word at once
        ones = x - (x >> ONE & PAIRS)
        ones = (ones & FOURS) + (ones >> TWO & FOURS)
        ones = (ones + (ones >> FOUR) & BYTES) * EACH
        # the byte is after all those that end before the wanted one
        shift = np.bitwise_count((left * EACH | SIGNS) - ones & SIGNS).astype(np.uint64) * EIGHT
        left -= ones << EIGHT >> shift & BYTE
        bit = shift + SELECT[(x >> shift & BYTE) * EIGHT + left]
        top = (word * 64 - at).astype(np.uint64) + bit << np.uint64(self.l)
        if not self.l:
            return top
        off = at * self.l
        w, o = off >> 6, (off & 63).astype(np.uint64)
        # the second shift in two steps: a shift by 64 is not defined
        rest = self.low[w] >> o | self.low[w + 1] << np.uint64(1) << (np.uint64(63) - o)
        return top | rest & np.uint64((1 << self.l) - 1)

    def steps(self, at: "EliasFano | None" = None) -> np.ndarray:
        """Differences between each two items in a row, of those ``at`` the indexes of another sequence."""
        n = self.n if at is None else at.n
        runs = (np.arange(k, min(k + READ + 1, n)) for k in range(0, n - 1, READ))
        out = [np.diff(self.get(r if at is None else at.get(r).astype(np.int64))) for r in runs]
        return small(np.concatenate(out)) if out else np.zeros(0, np.uint8)

    def search(self, lo: np.ndarray, hi: np.ndarray, values: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Index of each value within [lo, hi), -1 where it is not there.

        Items of a range lie between ``least`` and ``most``; ids of hashed words
        lie evenly there, so interpolation takes few steps.
        """
        out = np.full(len(values), -1, np.int64)
        live = np.flatnonzero((lo < hi) & (least <= values) & (values <= most))
        lo, hi, values, least, most = lo[live], hi[live], values[live], least[live].astype(np.float64), most[live].astype(np.float64)
        while len(live):
            share = (values - least + 0.5) / (most - least + 1)
            mid = np.clip(lo + (share * (hi - lo)).astype(np.int64), lo, hi - 1)
            got = self.get(mid)
            hit = got == values
            out[live[hit]] = mid[hit]
            less = got < values
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            least, most = np.where(less, got + 1.0, least), np.where(less, most, got - 1.0)
            on = np.flatnonzero(~hit & (lo < hi))
            live, lo, hi, values, least, most = live[on], lo[on], hi[on], values[on], least[on], most[on]
        return out


def relative(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids that ascend in each range, made one ascending sequence.

    Every range is raised by the last value of the ranges before it.
    """
    fan = np.diff(starts)
    full = np.flatnonzero(fan)
    if not len(full):
        return ids.astype(np.uint64)
    base = offsets(ids[starts[1:][full] - 1].astype(np.int64) + 1)[:-1]
    return (ids + np.repeat(base, fan[full])).astype(np.uint64)


class Trie:
    """Words, pairs and trigrams of one shard, in one memory map without a file.

    ``words``: ascending hashes; ``pairs``: ascending first << 32 | second;
    ``trigrams``: ascending pair << 32 | third, all as indexes; ``counts`` of
    the trigrams are positive.
    """

    def __init__(self, words: np.ndarray, pairs: np.ndarray, trigrams: np.ndarray, counts: np.ndarray, discount: float = DISCOUNT):
        n1, n2 = len(words), len(pairs)
        parent = (trigrams >> np.uint64(32)).astype(np.int64)
        to3 = offsets(np.bincount(parent, minlength=n2))
        to2 = offsets(np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=n1))
        total = offsets(counts)[to3]
        share = quantise(np.maximum(counts - discount, 0) / np.maximum(np.diff(total), 1)[parent])
        made = [EliasFano.parts(v) for v in (to2, to3, total, relative((pairs & np.uint64(LOW32)).astype(np.int64), to2), relative((trigrams & np.uint64(LOW32)).astype(np.int64), to3))]
        arrays = [a for p in made for a in p[2:]] + [words, share]
        at = offsets([-(-a.nbytes // 8) * 8 for a in arrays])
        self.map = mmap.mmap(-1, int(at[-1]) + 8)
        view = []
        for a, p in zip(arrays, at, strict=False):
            v = np.frombuffer(self.map, a.dtype, len(a), int(p))
            v[:] = a
            view.append(v)
        self.to2, self.to3, self.total, self.second, self.third = (EliasFano(*made[k][:2], *view[4 * k : 4 * k + 4]) for k in range(5))
        self.words, self.share = view[-2:]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word, -1 where unknown."""
        at = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        return np.where(self.words[at] == hashes, at, -1) if len(self.words) else np.full(len(hashes), -1)

    @staticmethod
    def nodes(pointer: EliasFano, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the nodes under ``at`` (-1: none)."""
        safe = np.maximum(at, 0)
        if pointer.n < 2:
            return safe * 0, safe * 0
        lo, hi = pointer.get(safe).astype(np.int64), pointer.get(safe + 1).astype(np.int64)
        return lo, np.where(at >= 0, hi, lo)

    def count_of_word(self, nodes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Count of the words whose pairs are these nodes."""
        return (self.total.get(nodes[1]) - self.total.get(nodes[0])).astype(np.int64)

    def count_of_pair(self, at: np.ndarray) -> np.ndarray:
        safe = np.maximum(at, 0)
        return np.where(at >= 0, (self.total.get(np.minimum(safe + 1, self.total.n - 1)) - self.total.get(safe)).astype(np.int64), 0)

    def successor(self, ids: EliasFano, nodes: tuple[np.ndarray, np.ndarray], fan: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Node of each ``nxt`` within the nodes of its context only, or -1.

        Context k is asked about ``fan[k]`` successors in a row.
        """
        lo, hi = nodes
        if not ids.n:
            return np.full(len(nxt), -1, np.int64)
        base = np.where(lo > 0, ids.get(np.clip(lo - 1, 0, ids.n - 1)) + np.uint64(1), np.uint64(0))
        base, lo, hi = np.repeat(base, fan), np.repeat(lo, fan), np.repeat(np.where(lo < hi, hi, lo), fan)
        hi = np.where(nxt >= 0, hi, lo)
        return ids.search(lo, hi, base + np.maximum(nxt, 0).astype(np.uint64), base, base + np.uint64(len(self.words)))

    def shares(self, at: np.ndarray) -> np.ndarray:
        """One byte for the discounted probability of each trigram (-1: none)."""
        return np.where(at >= 0, self.share[np.maximum(at, 0)], 0).astype(np.uint8) if len(self.share) else np.zeros(len(at), np.uint8)

    def missing(self, ids: EliasFano, pointer: EliasFano, at: np.ndarray, fan: np.ndarray, nxt: np.ndarray, known: np.ndarray) -> np.ndarray:
        """``known`` nodes of the successors of ``at``, those of -1 searched as in ``successor``."""
        out = known.astype(np.int64)
        ask = np.flatnonzero(known < 0)
        fan = np.bincount(np.repeat(np.arange(len(at)), fan)[ask], minlength=len(at))
        some = np.flatnonzero(fan)
        out[ask] = self.successor(ids, self.nodes(pointer, at[some]), fan[some], nxt[ask])
        return out

    def steps(self) -> list[np.ndarray]:
        """Count and successors of every word, and of every pair."""
        of_words = (self.total.steps(self.to2), self.to2.steps()) if self.to2.n > 1 else (self.words, self.words)
        return [*of_words, self.total.steps(), self.to3.steps()]

    def answer(self, place: np.ndarray, asked: np.ndarray, fan1: np.ndarray, second: np.ndarray, fan2: np.ndarray, third: np.ndarray, pair: np.ndarray, tri: np.ndarray, steps: list[np.ndarray]) -> list[np.ndarray]:
        """Counts and successors of the words asked and of their pairs, shares of trigrams.

        ``place`` has the words' indexes, ``pair`` and ``tri`` the nodes that are
        known and -1 for others.
        """
        word = place[asked]
        pair = self.missing(self.second, self.to2, word, fan1, place[second], pair)
        tri = self.missing(self.third, self.to3, pair, fan2, place[third], tri)
        there = np.flatnonzero(pair >= 0)
        of_pairs = np.zeros((2, len(pair)), np.int64)
        for out, step in zip(of_pairs, steps[2:], strict=True):
            out[there] = step[pair[there]]
        return [steps[0][word], steps[1][word], *of_pairs, self.shares(tri)]


class Layout:
    """A chunk's own trie, its nodes in the order in which shards hold them.

    ``words`` are the chunk's ascending hashes, ``tokens`` indexes into them,
    ``size`` the tokens of each text with its marks.
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, size: np.ndarray, learn: np.ndarray, hot: tuple[np.ndarray, np.ndarray], shards: int):
        ends = np.cumsum(size)
        open_ = np.ones(len(tokens), bool)
        open_[ends - 1] = open_[ends - 2] = False
        self.at = np.flatnonzero(open_)  # where a trigram begins
        t = tokens.astype(np.int64)
        pair, in_pair = np.unique(t[self.at] << 32 | t[self.at + 1], return_inverse=True)
        tri, in_tri = np.unique(in_pair.astype(np.int64) << 32 | t[self.at + 2], return_inverse=True)
        first, second, parent = pair >> 32, pair & LOW32, tri >> 32
        count = np.bincount(in_tri, np.repeat(learn, size)[self.at], len(tri)).astype(np.int64)
        parts = np.ones(len(words), np.int64)
        if len(hot[0]):
            k = np.minimum(np.searchsorted(hot[0], words), len(hot[0]) - 1)
            parts = np.where(hot[0][k] == words, hot[1][k], 1)
        shard_of = lambda w, part: (mix(words[w] + np.uint64(0x9E3779B97F4A7C15) * part.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        shard = shard_of(first, (mix(words[second]) % parts[first].astype(np.uint64)))
        order = np.argsort(shard, kind="stable")
        rank = np.empty(len(pair), np.int64)
        rank[order] = np.arange(len(pair))
        order3 = np.argsort(rank[parent], kind="stable")
        rank3 = np.empty(len(tri), np.int64)
        rank3[order3] = np.arange(len(tri))
        self.first, self.second, self.shard = first[order], second[order], shard[order]
        self.parent, self.third, self.count = rank[parent[order3]], (tri & LOW32)[order3], count[order3]
        self.in_pair, self.in_tri = rank[in_pair], rank3[in_tri]
        # a word is asked about wherever its pairs may be
        split = np.flatnonzero(parts > 1)
        split = split[np.isin(split, first)]
        every = np.repeat(split, parts[split])
        part = np.arange(len(every)) - np.repeat(offsets(parts[split])[:-1], parts[split])
        asked = np.unique(np.concatenate([self.shard << 32 | self.first, shard_of(every, part) << 32 | every]))
        self.asked, self.asked_shard = asked & LOW32, asked >> 32
        self.words, self.shards = words, shards

    def blocks(self, common: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(shard, block): words asked, their pairs and trigrams, by a dictionary.

        The dictionary names words by steps between their numbers in ``common``,
        and the rest by their hashes.
        """
        number = rank_in(common, self.words)
        # the dictionary's order: common words first, the commonest before the others
        weight = np.where(number >= 0, number, len(common) + np.arange(len(number)))
        cut1, cut2 = (np.searchsorted(s, np.arange(self.shards + 1)) for s in (self.asked_shard, self.shard))
        cut3 = np.searchsorted(self.parent, cut2)
        for s in np.unique(self.asked_shard).tolist():
            a, p, t = slice(cut1[s], cut1[s + 1]), slice(cut2[s], cut2[s + 1]), slice(cut3[s], cut3[s + 1])
            used, at = np.unique(np.concatenate([self.asked[a], self.second[p], self.third[t]]), return_inverse=True)
            order = np.argsort(weight[used])
            place = np.empty(len(used), np.int64)
            place[order] = np.arange(len(used))
            used, at = used[order], place[at]
            some = np.count_nonzero(number[used] >= 0)
            n1, n2 = len(self.asked[a]), len(self.second[p])
            fan1 = np.bincount(np.searchsorted(self.asked[a], self.first[p]), minlength=n1)
            fan2 = np.bincount(self.parent[t] - cut2[s], minlength=n2)
            yield s, pack(self.words[used[some:]], *map(small, (np.diff(number[used[:some]], prepend=0), at[:n1], fan1, at[n1 : n1 + n2], fan2, at[n1 + n2 :], self.count[t])))


def rank_in(common: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word in ``common``, -1 for those not there."""
    if not len(common):
        return np.full(len(words), -1)
    order = np.argsort(common)
    at = order[np.minimum(np.searchsorted(common, words, sorter=order), len(common) - 1)]
    return np.where(common[at] == words, at, -1)


def read_block(data: bytes, common: np.ndarray) -> list[np.ndarray]:
    """[words, asked, fan1, second, fan2, third, count] of a block."""
    hashes, steps, *rest = unpack(data)
    return [np.concatenate([common[np.cumsum(steps, dtype=np.int64)], hashes]) if len(steps) else hashes, *rest]


def _chunks(chunk_bytes: int):
    """Rows (chunk, tokens, entries, hot, data): the texts of a chunk as word numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = Hashes(31), TaskContext.get().partitionId() << 32
        rows, held = [], 0

        def made() -> pa.RecordBatch:
            marks = np.array([BEGIN2, BEGIN], np.uint64), np.array([END, AFTER], np.uint64)
            texts = [np.concatenate([marks[0], h, marks[1]]) for _, h, _ in rows]
            size, flat = np.array([len(t) for t in texts]), np.concatenate(texts)
            words, tokens = np.unique(flat, return_inverse=True)
            learn = np.array([bool(r[2]) for r in rows])
            # frequent first words of training trigrams, with how many there are
            n = np.bincount(tokens, np.repeat(learn, size), len(words)).astype(np.int64)
            n[np.searchsorted(words, [END, AFTER])] = 0
            often = np.flatnonzero(n > max(1, LEAST_SHARE * n.sum()))
            ids = np.array([r[0] if r[0] is not None else 0 for r in rows], np.int64)
            none = np.array([r[0] is None for r in rows], np.uint8)
            held_out = np.array([2 if r[2] is None else int(not r[2]) for r in rows], np.uint8)
            order, tokens = by_use(tokens, len(words))
            data = pack(words, small(order), small(tokens), small(size), ids, none, held_out)
            hot = [[{"h": h, "n": c} for h, c in zip(words[often].astype(np.int64).tolist(), n[often].tolist(), strict=True)]]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([int(size.sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array(hot, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))), pa.array([data], pa.binary())],
                names=["chunk", "tokens", "entries", "hot", "data"],
            )

        for b in slices(batches, "_text", min(chunk_bytes, 2_000_000)):
            for i, t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                # words are kept as hashes only: a chunk's memory is bounded by its text
                rows.append((i, np.maximum(hashes.of(words_of(t)), np.uint64(16)), y))
                held += 16 + len(t or "")
                if held >= chunk_bytes:
                    yield made()
                    rows, held, number = [], 0, number + 1
        if rows:
            yield made()

    return work


def _layout(data: bytes, hot: tuple[np.ndarray, np.ndarray], shards: int) -> tuple[Layout, list[np.ndarray]]:
    words, order, tokens, size, ids, none, held = unpack(data)
    tokens, size = order[tokens].astype(np.int64), size.astype(np.int64)
    return Layout(words, tokens, size, held == 0, hot, shards), [tokens, size, ids, none, held]


def _common(chunks: DataFrame) -> np.ndarray:
    """Hashes of the commonest words of a few chunks, the commonest first."""
    # by their numbers alone: an ordered table would go through one task with all its data
    chosen = [r["chunk"] for r in chunks.select("chunk").orderBy(F.xxhash64("chunk")).limit(SAMPLE_CHUNKS).collect()]
    some = [unpack(r["data"])[:3] for r in chunks.where(F.col("chunk").isin(chosen)).select("data").toLocalIterator()]
    if not some:
        return np.zeros(0, np.uint64)
    words, at = np.unique(np.concatenate([w[order] for w, order, _ in some]), return_inverse=True)
    use = np.bincount(at, np.concatenate([np.bincount(t, minlength=len(o)) for _, o, t in some]))
    return words[np.argsort(-use, kind="stable")[:COMMON]]


def _blocks(hot, common, shards: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = list(_layout(data.as_py(), hot.value, shards)[0].blocks(common.value))
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(got), pa.int64()), pa.array([s for s, _ in got], pa.int32()), pa.array([d for _, d in got], pa.binary())], names=["chunk", "shard", "data"])

    return work


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, ascending."""
    values = np.sort(values)
    return values[np.flatnonzero(np.append(True, values[1:] != values[:-1]))] if len(values) else values


def build(blocks: list[list[np.ndarray]], discount: float = DISCOUNT) -> tuple[Trie, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The trie of the training trigrams of all blocks, and what each block knows of it.

    That is the place of its words, and the nodes of the pairs and trigrams that
    its own training texts have, -1 for others.
    """
    vocabulary = distinct(np.concatenate([b[0] for b in blocks])) if blocks else np.zeros(0, np.uint64)
    places, seen, keys, thirds, counts = [], [], [], [], []
    for b in blocks:
        words, asked, fan1, second, fan2, third, count = b
        place = np.searchsorted(vocabulary, words)
        on = np.flatnonzero(count)
        parent = np.repeat(np.arange(len(fan2)), fan2)[on]
        pair = (np.repeat(place[asked], fan1) << 32 | place[second]).astype(np.uint64)
        keys.append(pair[parent])
        thirds.append(place[third[on]].astype(np.uint32))
        counts.append(count[on])
        places.append(place.astype(np.uint32))
        b[0] = b[6] = None  # hashes and counts are not needed again
        seen.append((on.astype(np.uint32), parent.astype(np.uint32)))
    pair, third = (np.concatenate(k) if k else np.zeros(0, np.uint64) for k in (keys, thirds))
    del keys, thirds
    pairs, in_pair = np.unique(pair, return_inverse=True)
    in_pair = in_pair.astype(np.int32)
    del pair
    trigrams, in_tri = np.unique(in_pair.astype(np.uint64) << np.uint64(32) | third, return_inverse=True)
    del third
    trie = Trie(vocabulary, pairs, trigrams, np.bincount(in_tri, np.concatenate(counts) if counts else None, len(trigrams)).astype(np.int64), discount)
    known, ends = [], offsets([len(on) for on, _ in seen])
    in_tri = in_tri.astype(np.int32)
    for b, place, (on, parent), i, j in zip(blocks, places, seen, ends[:-1], ends[1:], strict=True):
        two, three = np.full(len(b[3]), -1, np.int32), np.full(len(b[5]), -1, np.int32)
        two[parent], three[on] = in_pair[i:j], in_tri[i:j]
        known.append((place, two, three))
    return trie, known


def _answer(hot, common):
    def work(table: pa.Table) -> pa.Table:
        """Build one shard's trie from its blocks and answer each of them."""
        shard, data = table.column("shard")[0].as_py(), table.column("data")
        blocks = [read_block(d.as_py(), common.value) for d in data]
        trie, known = build(blocks)
        vocabulary, steps, out = trie.words, trie.steps(), []
        for b, (place, pair, tri) in zip(blocks, known, strict=True):
            made = trie.answer(place.astype(np.int64), *b[1:6], pair, tri, steps)
            out.append(pack(*map(small, made[:4]), made[4]))
        count = steps[0].astype(np.int64)
        mark = np.isin(vocabulary, np.array([BEGIN2, BEGIN], np.uint64))
        texts, tokens = int(count[vocabulary == BEGIN].sum()), int(count[~mark].sum())
        types = int(((count > 0) & ~mark & ~np.isin(vocabulary, hot.value[0])).sum())
        n = len(out)
        cols = {"chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int64()), "shard": pa.array([shard] * (n + 1), pa.int32()), "data": pa.array([*out, b""], pa.binary())}
        return pa.table(cols | {k: pa.array([0] * n + [v], pa.int64()) for k, v in (("texts", texts), ("tokens", tokens), ("types", types))})

    return work


def score(documents: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all texts.

    ``train`` tells which rows are learned from; null counts as held out with a
    null mark. Null and empty texts are the end mark alone; a very long text is
    a chunk of its own and is scored whole. Ids may be null and may repeat: rows
    are scored one by one, and a repeated training row counts each time. With no
    training rows N is 0 and every token is equally unlikely; an empty table
    gives no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    src = documents.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"), train.cast("boolean").alias("_train"))
    chunks = stage_in_buckets(src.mapInArrow(_chunks(chunk_bytes), "chunk long, tokens long, entries long, hot array<struct<h:long,n:long>>, data binary"), "lm-chunks", "chunk")
    all_tokens, entries = chunks.agg(F.sum("tokens"), F.sum("entries")).first()
    shards = max(1, -(-int(all_tokens or 0) // shard_tokens))
    # first words that fill a good part of a shard: at most 1 / LEAST_SHARE words
    least = max(LEAST_SHARE, 1 / (SPLIT * shards))
    often = chunks.select(F.explode("hot").alias("w")).groupBy("w.h").agg(F.sum("w.n").alias("n")).where(F.col("n") > int(entries or 0) * least).toPandas()
    hashes, n = often["h"].to_numpy(np.int64).astype(np.uint64), often["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    hot_words, hot_parts = hashes[order], np.minimum(shards, -(-n[order] * SPLIT * shards // max(1, int(entries or 0))))
    hot = spark.sparkContext.broadcast((hot_words, hot_parts))
    common = spark.sparkContext.broadcast(_common(chunks))  # 1 MB at most
    blocks = chunks.select("chunk", "data").mapInArrow(_blocks(hot, common, shards), "chunk long, shard int, data binary")
    # a shard a task
    answers = stage(blocks.repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(_answer(hot, common), "chunk long, shard int, data binary, texts long, tokens long, types long"), "lm-answers")
    texts, tokens, types = (int(x or 0) for x in answers.where(F.col("chunk") < 0).agg(F.sum("texts"), F.sum("tokens"), F.sum("types")).first())
    total = tokens + texts
    kinds = types + int((~np.isin(hot_words, np.array([BEGIN2, BEGIN], np.uint64))).sum()) + (texts > 0)
    codes = answers.where(F.col("chunk") >= 0).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "data"))).alias("codes"))
    joined = chunks.select("chunk", "data").join(codes, "chunk").select("data", F.transform("codes", lambda c: c["data"]).alias("codes"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                lay, (tok, size, ids, none, held) = _layout(b.column(0)[k].as_py(), hot.value, shards)
                got = [unpack(c) for c in b.column(1)[k].as_py()]
                count1, fan1, count2, fan2, code = (np.concatenate([g[j] for g in got]) for j in range(5))
                count = np.bincount(lay.asked, count1, len(lay.words))
                fan = np.bincount(lay.asked, fan1, len(lay.words))
                own = count.copy()
                own[np.searchsorted(lay.words, END)] = texts
                p1 = (own + 0.5) / (total + 0.5 * (kinds + 1))
                # a pair's probability after its first word, a trigram's after its pair
                c1 = np.maximum(count, 1)
                p2 = np.maximum(count2 - DISCOUNT, 0) / c1[lay.first] + np.where(count > 0, DISCOUNT * fan / c1, 1.0)[lay.first] * p1[lay.second]
                back = np.where(count2 > 0, DISCOUNT * fan2 / np.maximum(count2, 1), 1.0)
                # of the n + 2 trigrams of a text the last only carries its pair
                n_of = size - 3
                starts = offsets(size - 2)[:-1]
                doc = np.repeat(np.arange(len(ids)), n_of)
                here = np.arange(len(doc)) - np.repeat(offsets(n_of)[:-1] - starts, n_of)
                word = tok[lay.at[here] + 2]
                p3 = dequantise(code)[lay.in_tri[here]] + back[lay.in_pair[here]] * p2[lay.in_pair[here + 1]]
                sums = [np.bincount(doc, x, len(ids)) for x in (np.log10(p1)[word], np.log10(p3), (own > 0)[word])]
                cols = [
                    pa.array(ids, pa.int64(), mask=none.astype(bool)),
                    pa.array(held == 1, pa.bool_(), mask=held == 2),
                    pa.array(n_of, pa.int64()),
                    pa.array(sums[2].astype(np.int64)),
                    pa.array(np.full(len(ids), total), pa.int64()),
                    pa.array(sums[0], pa.float64()),
                    pa.array(sums[1], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.mapInArrow(work, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
