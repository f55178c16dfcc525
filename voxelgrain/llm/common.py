"""What the corpus operators share: words, splits, shared folders, batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgrain.storage import shared_dir, stage  # noqa: F401

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Entries after which a worker's word cache starts afresh.
CACHE_WORDS = 300_000
#: Name of the text column on its way to the workers.
TEXT = "_text_of_operator"


def crc_split(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(parts)


def stage_in_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``stage``, in as many buckets by ``key`` as a shuffle has partitions.

    A join or grouping by ``key`` then moves only the other side. The table's
    name is dropped at once; its files stay, as those of ``stage`` do.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark).rstrip('/')}/{table}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018 - resolved before the name goes
    spark.sql(f"DROP TABLE {table}")
    return out


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a text, A-Z lower-cased, no other letter changed."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Hashes(dict):
    """word -> 64-bit hash, kept until ``CACHE_WORDS`` words are held."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def offsets(lengths: list[int] | np.ndarray) -> np.ndarray:
    """Start of every run, and the total at the end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if batch.num_rows < 2 or col.nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        size = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def finite_vectors(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the vectors, as doubles, that are not null and hold neither null nor non-finite components."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col), v.alias("v"))


def beside(keep: list[str], results: list[str]) -> list[str]:
    """Names of kept columns beside those of results.

    A kept column whose name is that of a result, in any case, gets ``_in`` at
    its end, again and again until it is free.
    """
    out, taken = [], {r.lower() for r in results}
    for c in keep:
        while c.lower() in taken:
            c += "_in"
        taken.add(c.lower())
        out.append(c)
    return out


def kept(df: DataFrame, keep: list[str], results: list[str]) -> list[Column]:
    """Columns ``keep`` of ``df`` under the names that ``beside`` gives them."""
    return [F.col(f"`{c}`").alias(n) for c, n in zip(keep, beside(keep, results), strict=True)]


def labelled(documents: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, y) of rows with a label of 0 or 1.

    Several label rows of one document count as one, the largest; a null label
    or id is no label.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return documents.select("doc_id", "text").join(y, "doc_id")


def bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows of ``df`` at most, chosen by a hash of ``key``."""
    total = df.count()
    if total <= most:
        return df
    share = int(most / total * 1_000_000)
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_000)) < share)
