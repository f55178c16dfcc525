"""Byte-level BPE by a pair occurrence index.

The pieces of a batch that are not yet known are laid out as one row of
symbols with links to left and right neighbours. An index maps each adjacent
pair that has a rank to all its positions; ranks are taken in ascending order
from a heap, each rank's pair is merged at every position it still holds, and
the lists of the pairs to the left and right are brought up to date. A merge
only ever makes pairs of higher rank, so one ascending sweep settles all pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.common import TEXT, beside, kept, offsets, slices

#: Split of a text before merging, as byte-level vocabularies of this kind define it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Signs that are one piece together where they end a chunk.
SIGNS = ".,;:!?)"
#: Entries kept in a worker's cache, after which it starts afresh.
CACHE_PIECES = 1_000_000
#: Bytes of text that a worker encodes at once, about.
SLICE_BYTES = 4_000_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Ranks, ids and bytes of a tokenizer file (JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letter = byte_letters()
        byte = {c: b for b, c in letter.items()}
        ids = data["model"]["vocab"]
        spelled = lambda t: bytes(byte[c] for c in t)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes = {i: spelled(t) for t, i in ids.items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.single = [ids[letter[b]] for b in range(256)]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in data["model"]["merges"]]
        #: By rank: left id, right id, id of both together.
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        keys = np.array([a << 32 | b for a, b, _ in self.merges], np.int64)
        #: The ranks again, in the order of the pairs' keys.
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.min_scalar_type(max(1, len(order) - 1)))
        #: Ranks of pairs of single bytes, -1 where there is none.
        byte_pairs = (np.repeat(np.array(self.single, np.int64), 256) << 32) | np.tile(np.array(self.single, np.int64), 256)
        at = np.minimum(np.searchsorted(self.keys, byte_pairs), max(0, len(self.keys) - 1))
        self.start = np.where(self.keys[at] == byte_pairs, order[at], -1) if len(order) else np.full(65536, -1)
        self.split = "(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")"
        self.table = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]


def encode_pieces(pieces: list[bytes], v: Vocabulary) -> list[bytes]:
    """Ids of every piece, as little-endian unsigned 32-bit integers."""
    raw = b"".join(pieces)
    ends = np.cumsum([len(p) for p in pieces])
    sym = np.array(v.single, np.int64)[np.frombuffer(raw, np.uint8)]
    n = len(sym)
    if not n:
        return [b""] * len(pieces)
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    starts = np.concatenate([[0], ends[:-1]])[np.diff(np.concatenate([[0], ends])) > 0]
    before[starts] = -1
    after[ends[ends > 0] - 1] = -1
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(places: np.ndarray, keys: np.ndarray) -> None:
        """Enter places of pairs that have a rank."""
        at = np.searchsorted(v.keys, keys)
        hit = np.flatnonzero(v.keys[np.minimum(at, len(v.keys) - 1)] == keys)
        if len(hit):
            enter(places[hit], v.ranks[at[hit]])

    def enter(places: np.ndarray, rank: np.ndarray) -> None:
        order = np.argsort(rank, kind="stable")
        rank, places = rank[order], places[order]
        edge = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
        for x, r in enumerate(rank[edge[:-1]].tolist()):
            part = places[edge[x] : edge[x + 1]]
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    left = np.flatnonzero(after >= 0)
    byte = np.frombuffer(raw, np.uint8).astype(np.int32)
    rank = v.start[byte[left] << 8 | byte[left + 1]]
    hit = rank >= 0
    if hit.any():
        enter(left[hit], rank[hit].astype(v.ranks.dtype))
    while heap:
        rank = heapq.heappop(heap)
        a, b, new = v.merges[rank]
        parts = index.pop(rank)
        i = parts[0] if len(parts) == 1 else np.concatenate(parts)
        j = after[i]
        holds = (sym[i] == a) & (j >= 0) & (sym[j] == b)
        i, j = i[holds], j[holds]
        if not len(i):
            continue
        if a == b or len(parts) > 1:
            i = np.unique(i)
            if a == b:  # of a run of equal symbols every second pair merges
                run = np.cumsum(np.concatenate([[True], after[i[:-1]] != i[1:]]))
                i = i[(np.arange(len(i)) - np.searchsorted(run, run)) % 2 == 0]
            j = after[i]
        r = after[j]
        sym[i], sym[j], after[i] = new, -1, r
        right = r >= 0
        before[r[right]] = i[right]
        q = before[i]
        leftward = q >= 0
        note(np.concatenate([i[right], q[leftward]]), np.concatenate([new << 32 | sym[r[right]], sym[q[leftward]] << 32 | new]))
    live = sym >= 0
    count = np.concatenate([[0], np.cumsum(live)])
    ids = sym[live].astype("<u4").tobytes()
    bounds = (count[np.concatenate([[0], ends])] * 4).tolist()
    return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def is_letters(text: str) -> bool:
    """Letters up to the end of the Latin blocks, which every version of Unicode has: one piece."""
    return text.isalpha() and (text.isascii() or max(text) < "\u0250")


class Encoder:
    """Encodes texts batch by batch; what was seen before comes from caches.

    A text falls apart at every single space that other characters than spaces
    surround: the pattern always starts a piece there. Chunks of a batch are numbered
    by Arrow, those that follow a space are cached with their ids in ``later``, and
    the ids of texts are gathered by number. A text in which a space touches more white space on both sides or at its end is
    cut by the pattern as a whole.
    """

    def __init__(self, path: str | None = None, state: dict | None = None, cache: int = CACHE_PIECES):
        """From a tokenizer file, or from the ``state`` of another encoder, whose caches are then shared.

        A cache of more than ``cache`` entries starts afresh before the next batch.
        """
        self.cache = cache
        self.state = state if state is not None else {"v": vars(Vocabulary(path)), "pieces": {}, "later": {}}
        self.v = Vocabulary.__new__(Vocabulary)
        vars(self.v).update(self.state["v"])
        self.pattern = regex.compile(PATTERN)
        self.pieces, self.later = self.state["pieces"], self.state["later"]
        self.whole = re.compile(r"\s (?:\s|\Z)").search

    def _learn(self, words: set[str], odd: set[str]) -> None:
        """Ids of words after a space and of other pieces that no cache holds yet."""
        new, rest = list(words.difference(self.later)), list(odd.difference(self.pieces))
        for i in range(0, max(len(new), len(rest)), CACHE_PIECES):  # bounds what is laid out at once
            w, o = new[i : i + CACHE_PIECES], rest[i : i + CACHE_PIECES]
            ids = encode_pieces([b" " + x.encode() for x in w] + [x.encode() for x in o], self.v)
            self.later.update(zip(w, ids, strict=False))
            self.pieces.update(zip(o, ids[len(w) :], strict=True))

    def _chunks(self, chunks: list[str], apart: list[list[str]]) -> list[bytes]:
        """Ids of chunks that follow a space, most of them a word or a word and
        signs after it; the pieces of ``apart`` are learned with them."""
        words, signed, found, find = set(), {}, {}, self.pattern.findall
        for c in set(chunks).difference(self.later):
            if is_letters(c):
                words.add(c)
                continue
            stem = c.rstrip(SIGNS)
            if stem and is_letters(stem):
                words.add(stem)
                signed[c] = stem, c[len(stem) :]
            else:
                found[c] = find(" " + c)
        self._learn(words, set().union({sign for _, sign in signed.values()}, *found.values(), *apart))
        later, known = self.later, self.pieces
        later.update({c: later[stem] + known[sign] for c, (stem, sign) in signed.items()})
        later.update({c: self._ids(part) for c, part in found.items()})
        return [later[c] for c in chunks]

    def _ids(self, part: list[str]) -> bytes:
        known = self.pieces
        return b"".join([known[p] for p in part])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A null text counts as empty; special tokens in a text become their ids."""
        for cache in (self.pieces, self.later):
            if len(cache) > self.cache:
                cache.clear()
        special, find = self.v.special, self.pattern.findall
        texts, odd = [t or "" for t in texts], {}
        for i, t in enumerate(texts):
            if any(x in t for x in special) or self.whole(t):  # cut as a whole, at special tokens first
                odd[i] = [p if p in special else find(p) for p in (regex.split(self.v.split, t) if special else [t])]
        cut = pa.compute.split_pattern(pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.string()), " ")
        coded = cut.flatten().dictionary_encode()
        ends = cut.offsets.to_numpy().astype(np.int64)
        # the first chunk of a text has no space before it: such ones come after all others
        lead = [find(c) for c in coded.take(pa.array(ends[:-1])).cast(pa.string()).to_pylist()]
        table = self._chunks(coded.dictionary.to_pylist(), lead + [p for parts in odd.values() for p in parts if p.__class__ is list])
        code = coded.indices.to_numpy().astype(np.int64)
        code[ends[:-1]] = len(table) + np.arange(len(texts))
        table += map(self._ids, lead)
        starts = offsets(np.fromiter(map(len, table), np.int64, len(table)) // 4)
        size = np.diff(starts)[code]
        at = offsets(size)
        ids = np.frombuffer(b"".join(table), "<u4")[np.repeat(starts[code] - at[:-1], size) + np.arange(at[-1])]
        raw, cuts = ids.tobytes(), (at[ends] * 4).tolist()
        out = [raw[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
        for i, parts in odd.items():
            out[i] = b"".join(self._ids(p) if p.__class__ is list else special[p].to_bytes(4, "little") for p in parts)
        return out

    def decode(self, ids: bytes) -> str:
        """Text of the ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.v.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def share(df: DataFrame, path: str) -> Broadcast:
    """The vocabulary for all workers, some MB; each keeps its caches from task to task."""
    return df.sparkSession.sparkContext.broadcast(Encoder(path).state)


def _run(documents: DataFrame, path: str, keep: list[str], text: str, fields: list[tuple[str, str, pa.DataType]], row, cache: int = CACHE_PIECES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    results = [f[0] for f in fields]
    shared = share(documents, path)
    src = documents.select(*kept(documents, keep, results), F.col(text).alias(TEXT))
    names = [*beside(keep, results), *results]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(state=shared.value, cache=cache)
        for b in slices(batches, TEXT, slice_bytes):
            texts = b.column(b.num_columns - 1).to_pylist()
            made = list(zip(*[row(coder, ids) for ids in coder.encode(texts)], strict=True)) or [[]] * len(fields)
            cols = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(list(c), f[2]) for c, f in zip(made, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(work, ", ".join([f"`{c}` {t}" for c, t in [*src.dtypes[:-1], *[f[:2] for f in fields]]]))


def encode(documents: DataFrame, path: str, keep: list[str], text: str = "text", cache: int = CACHE_PIECES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``keep`` columns and ids (array<int>), n_tokens of every whole text.

    The tokenizer file is read on the driver and broadcast. Null and empty
    texts have no tokens; repeated rows are encoded alike; an empty table gives
    none; columns not in ``keep`` are not read. A kept column with the name of a
    result gets ``_in`` at its end. ``cache`` and ``slice_bytes`` bound what a
    worker holds, at the price of time; they do not change the result.
    """
    row = lambda coder, ids: (np.frombuffer(ids, "<i4"), len(ids) // 4)
    return _run(documents, path, keep, text, [("ids", "array<int>", pa.list_(pa.int32())), ("n_tokens", "bigint", pa.int64())], row, cache, slice_bytes)


def decode(encoded: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` columns and text of every list of ids; a null list gives null."""
    src = encoded.select(*kept(encoded, keep, ["text"]), F.col(ids).alias("_ids"))
    shared = share(encoded, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(state=shared.value)
        for b in batches:
            texts = [None if x is None else coder.decode(np.array(x, "<u4").tobytes()) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array(texts, pa.string())], names=[*beside(keep, ["text"]), "text"])

    return src.mapInArrow(work, ", ".join([f"`{c}` {t}" for c, t in src.dtypes[:-1]] + ["text string"]))


def digests(documents: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens and SHA-256 of the ids and of the decoded text.

    Encodes and decodes in one pass without shipping the ids; edge cases as in
    ``encode``.
    """
    row = lambda coder, ids: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids).encode()).hexdigest())
    fields = [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _run(documents, path, keep, text, fields, row)
