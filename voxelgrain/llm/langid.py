"""Language identification as inference of a mixture of languages.

Each language has a model of hashed character 1- to 4-grams of lower-case words
with their borders. A document is taken as a mixture: every word comes from one
language, with a likelihood from its n-grams. Expectation-maximisation finds the
proportions; the set of languages is selected by penalised likelihood (a
language is dropped as long as the Bayesian information criterion gets better
without it). The prediction is the language with the largest proportion and the
score that proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.common import CACHE_WORDS, TEXT, beside, kept, slices

BUCKETS = 1 << 15
SIZES = (1, 2, 3, 4)
ITERATIONS = 10
UNKNOWN = "und"
#: Distinct words of one batch that are counted by n-gram at a time.
PART = 50_000


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def ngrams(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the n-grams of all words, borders as spaces."""
    text = " " + " ".join(words) + " "
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), size + 1)
    word = np.concatenate([[0], word])  # a border counts for the word before it
    out_w, out_b, h = [], [], np.zeros(len(cp), np.uint64)
    border = cp == 32
    crossed = np.cumsum(border)
    for n in SIZES:
        m = len(cp) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint64(0x100000001B3)) ^ (cp[n - 1 :] * np.uint64(0x9E3779B97F4A7C15))
        # no border inside: at most at its two ends, and not a border alone
        inside = crossed[n - 2 : n - 2 + m] - crossed[:m] if n > 2 else np.zeros(m, np.int64)
        ok = np.flatnonzero((inside == 0) & ~(border[:m] & border[n - 1 :])) if n > 1 else np.flatnonzero(~border)
        owner = np.where(border[ok], ok + 1, ok)
        out_w.append(word[owner])
        x = h[ok] + np.uint64(n)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out_b.append((x >> np.uint64(33)).astype(np.int64) % buckets)
    return np.concatenate(out_w) if out_w else np.zeros(0, np.int64), np.concatenate(out_b) if out_b else np.zeros(0, np.int64)


def count(documents: DataFrame, lang: str = "lang", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n) over all documents with a text and a language.

    Every task sends one row a language and bucket at most.
    """
    src = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, TEXT, 4_000_000):
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for one in set(langs):
                seen: dict[str, int] = {}
                for g, t in zip(langs, texts, strict=True):
                    if g == one:
                        for w in t.lower().split():
                            seen[w] = seen.get(w, 0) + 1
                have = total.setdefault(one, np.zeros(buckets))
                items = [(x, n) for w, n in seen.items() if (x := _letters(w))]
                for i in range(0, len(items), PART):
                    part = items[i : i + PART]
                    word, bucket = ngrams([w for w, _ in part], buckets)
                    have += np.bincount(bucket, np.array([n for _, n in part], float)[word], buckets)
        for one, have in total.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(have[at].astype(np.int64))], names=["lang", "bucket", "n"])

    return src.mapInArrow(work, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(documents: DataFrame, lang: str = "lang", text: str = "text", buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods buckets x languages), languages x buckets numbers."""
    got = count(documents, lang, text, buckets).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.zeros((buckets, len(langs)))
    table[got["bucket"], np.searchsorted(langs, got["lang"])] = got["n"]
    table += 0.5
    return langs, np.log(table / table.sum(0)).astype(np.float32) if langs else table


def mixture(like: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Proportions documents x languages by expectation-maximisation.

    ``like`` holds each distinct (document, word)'s log likelihoods and
    ``weight`` its count; ``doc`` ascends. After each fit, every document drops
    its smallest language while that does not cost more likelihood than the
    penalty, half the log of its number of words, saves.
    """
    n_langs = like.shape[1]
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    present = doc[starts]
    total = np.add.reduceat(weight, starts) if len(doc) else np.zeros(0)
    out = np.zeros((n_docs, n_langs))
    if not len(doc) or not n_langs:
        return out
    # languages by words, so that every step runs along contiguous numbers
    p = np.ascontiguousarray(np.exp(like - like.max(1, keepdims=True)).astype(np.float64).T)
    size = np.diff(np.append(starts, len(doc)))

    def em(pi: np.ndarray, p: np.ndarray, size: np.ndarray, weight: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.cumsum(size) - size
        row, part = np.repeat(np.arange(len(size)), size), np.empty(p.shape[1])

        def joint() -> np.ndarray:
            total = np.zeros(p.shape[1])
            for k in range(n_langs):
                np.multiply(p[k], pi[k][row], out=part)
                np.add(total, part, out=total)
            return np.maximum(total, 1e-300, out=total)

        for _ in range(iterations):
            share = np.divide(weight, joint())
            pi = np.stack([pi[k] * np.add.reduceat(np.multiply(p[k], share, out=part), first) for k in range(n_langs)]) / n
        return pi, np.add.reduceat(weight * np.log(joint()), first)

    pi, best = em(np.full((n_langs, len(starts)), 1 / n_langs), p, size, weight, total)
    live = np.arange(len(starts))  # documents whose set of languages may still shrink
    for _ in range(n_langs - 1):
        live = live[(pi[:, live] > 0).sum(0) > 1]
        if not len(live):
            break
        on = np.zeros(len(starts), bool)
        on[live] = True
        mine = np.flatnonzero(np.repeat(on, size))
        trial = pi[:, live]
        trial[np.where(trial > 0, trial, np.inf).argmin(0), np.arange(len(live))] = 0
        trial /= trial.sum(0)
        trial, fit_ = em(trial, p[:, mine], size[live], weight[mine], total[live])
        better = fit_ + 0.5 * np.log(np.maximum(total[live], 2)) >= best[live]
        live = live[better]
        pi[:, live], best[live] = trial[:, better], fit_[better]
    pi = pi.T
    out[present] = pi
    return out


class Reader:
    """Log likelihood rows of words, cached; one worker reads with one."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table
        self.row: dict[str, int] = {}
        self.like = np.zeros((0, len(langs)), np.float32)

    def rows(self, words: set[str]) -> dict[str, int]:
        """Row of each word in ``like``; -1 for words without a letter."""
        if len(self.row) > CACHE_WORDS:
            self.row, self.like = {}, np.zeros((0, len(self.langs)), np.float32)
        fresh = [(w, x) for w in words if w not in self.row for x in [_letters(w)]]
        named = [(w, x) for w, x in fresh if x]
        self.row.update((w, -1) for w, x in fresh if not x)
        made = [self.like]
        for i in range(0, len(named), PART):
            part = [x for _, x in named[i : i + PART]]
            word, bucket = ngrams(part, len(self.table))
            each = [np.bincount(word, self.table[bucket, k], len(part)) for k in range(len(self.langs))]
            made.append(np.array(each, np.float32).reshape(len(self.langs), len(part)).T)
        self.row.update(zip([w for w, _ in named], range(len(self.like), len(self.like) + len(named)), strict=True))
        self.like = np.concatenate(made)
        return self.row

    def proportions(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, whether a text has a letter)."""
        cut = [t.lower().split() if t else [] for t in texts]
        row = self.rows({w for c in cut for w in c})
        at = np.fromiter(map(row.__getitem__, chain.from_iterable(cut)), np.int64)
        doc = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        doc, at = doc[at >= 0], at[at >= 0]
        pair, n = np.unique(doc * np.int64(max(1, len(self.like))) + at, return_counts=True)
        doc, at = np.divmod(pair, max(1, len(self.like)))
        seen = np.zeros(len(cut), bool)
        seen[doc] = True
        return mixture(self.like[at], doc, n.astype(np.float64), len(cut)), seen


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score and proportions (map of language to share).

    Null texts, texts without a letter, and all texts if no language was
    learned, are ``und`` with score 0. Of equal proportions the language first
    by code point is taken. Repeated rows get equal results; an empty table
    gives none. A kept column with the name of a result gets ``_in`` at its end.
    """
    results = ["lang_pred", "score", "proportions"]
    keep, src = beside(keep, results), documents.select(*kept(documents, keep, results), F.col(text).alias(TEXT))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        reader = Reader(langs, table)
        for b in slices(batches, TEXT, 4_000_000):
            pi, seen = reader.proportions(b.column(b.num_columns - 1).to_pylist())
            known = seen & bool(langs)
            top = pi.argmax(1) if langs else np.zeros(len(seen), int)
            pred = [langs[k] if ok else UNKNOWN for k, ok in zip(top, known, strict=True)]
            score = np.where(known, pi[np.arange(len(top)), top] if langs else 0.0, 0.0)
            parts = [[(g, float(x)) for g, x in zip(langs, r, strict=True) if x > 0] for r in pi]
            cols = [pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(parts, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], *cols], names=[*keep, *results])

    return src.mapInArrow(work, ", ".join([f"`{c}` {t}" for c, t in src.dtypes[:-1]] + ["lang_pred string, score double, proportions map<string,double>"]))
