"""URL filter: host and path rules, then a logistic regression on n-grams.

Rules are (verdict, host, path prefix). A rule fits its host and all of that
host's subdomains when the path starts with the rule's; of several that fit the
longest (host and path together) decides. Any other URL is judged by a logistic
regression over hashed character 3- to 5-grams of host and path that is fitted
on a small labelled table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.common import TEXT, beside, kept, mix, offsets

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: The labelled table: parts of unwanted host names by subject, each joined to the
#: others of its line, and names of ordinary hosts. All stand in the same forms of
#: URL, so that only the name tells them apart.
UNWANTED = (
    (("buy", "cheap", "discount", "online"), ("viagra", "cialis", "pills", "meds", "xanax")),
    (("online", "best", "free", "vegas"), ("casino", "poker", "slots", "blackjack", "betting", "jackpot")),
    (("free", "hot", "live", "xxx"), ("porn", "sex", "nude", "xxx", "escorts", "milf", "webcam-sex")),
    (("fast", "quick", "instant", "bad-credit"), ("payday-loans", "cash-advance", "loan-approval")),
    (("replica", "fake", "cheap"), ("rolex", "handbags", "watches", "diplomas")),
    (("free", "full", "cracked"), ("warez", "keygen", "serial-keys", "cracks", "torrent-download")),
    (("ad", "ads", "click", "popup"), ("tracker", "clicks", "banner", "popunder", "adserver")),
    (("win", "claim", "free"), ("iphone-prize", "gift-card", "lottery-winner", "bitcoin-double")),
    (("seo", "link", "spam"), ("link-farm", "backlinks", "spam", "traffic-bot", "malware")),
)
WANTED = (
    "news", "library", "university", "museum", "science", "garden", "recipes", "weather", "history", "theatre",
    "travel", "council", "research", "opendata", "school", "music", "chess", "physics", "books", "wiki", "journal",
    "health", "football", "photography", "marketing", "orchestra", "farmers-market", "shipping", "hotels", "airport",
    "bakery", "cycling", "documentation", "developer", "software", "hardware", "engineering", "mathematics", "biology",
    "chemistry", "medicine", "hospital", "pharmacology", "nursing", "dentist", "law-firm", "court", "parliament",
    "government", "elections", "economics", "finance", "banking", "insurance", "accounting", "real-estate",
    "architecture", "construction", "furniture", "kitchen", "restaurant", "wine", "coffee", "tea-house", "fashion",
    "shoes", "jewellery", "watchmaker", "toys", "games", "puzzles", "cinema", "film-festival", "television", "radio",
    "podcast", "magazine", "newspaper", "publishing", "poetry", "philosophy", "religion", "church", "archaeology",
    "geography", "maps", "climate", "forest", "rivers", "mountains", "wildlife", "birds", "gardeners", "farming",
    "veterinary", "sports", "tennis", "swimming", "running", "yoga", "essex-county", "sussex-archive", "middlesex",
    "train-timetable", "public-transport", "ferry", "bridge-club", "volunteers", "charity", "scouts", "kindergarten",
    "college", "academy", "thesis", "conference", "workshop", "statistics", "census", "genealogy", "antiques",
    "auction", "classifieds", "jobs", "careers", "translation", "dictionary", "grammar", "language-course",
)
FORMS = (("www.", ".com", "/"), ("", ".net", "/en/12"), ("", ".org", "/2021/05/article.html"), ("blog.", ".example.com", "/de/345/"), ("m.", ".example.org", "/fr/67.html"), ("shop.", ".co.uk", "/es/890"), ("en.", ".example.net", ""))
BUCKETS = 1 << 16
SIZES = (3, 4, 5)


def training_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 if unwanted) of the small labelled table."""
    bad = [f"{a}{sign}{b}" for firsts, seconds in UNWANTED for a, b in product(firsts, seconds) for sign in ("-", "") if a != b]
    bad += [b for _, seconds in UNWANTED for b in seconds]
    good = [*WANTED, *[f"{a}-{b}" for a, b in zip(WANTED, WANTED[7:], strict=False)], *[f"{a}{b}" for a, b in zip(WANTED, WANTED[11:], strict=False)]]
    return [(a + name + b, path, y) for y, names in ((1, bad), (0, good)) for name in names for a, b, path in FORMS]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def grams(hosts: list[str], paths: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct hashed n-grams of bytes of hosts and paths.

    Each kind and size has a seed of its own; all rows are hashed at once.
    """
    out = []
    for seed, parts in ((1, hosts), (2, paths)):
        raw = [f"^{p}$".encode("utf-8", "surrogatepass") for p in parts]
        at = offsets([len(r) for r in raw])
        row = np.repeat(np.arange(len(raw)), np.diff(at))
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        for n in SIZES:
            many = max(0, len(data) - n + 1)
            value = np.zeros(many, np.uint64)
            for k in range(n):  # at most 5 bytes: the value is the n-gram itself
                value = value << np.uint64(8) | data[k : k + many]
            own = row[:many] == row[n - 1 :][:many]
            bucket = mix(value[own] << np.uint64(6) | np.uint64(seed * 8 + n)) % np.uint64(buckets)
            out.append(row[:many][own].astype(np.int64) * buckets + bucket.astype(np.int64))
    key = np.unique(np.concatenate(out))
    return key // buckets, key % buckets


def fit(rows: list[tuple[str, str, int]], buckets: int = BUCKETS, epochs: int = 200, rate: float = 0.5, l2: float = 1e-3) -> np.ndarray:
    """Full-batch logistic regression, both labels of equal weight; the last weight is the intercept."""
    row, flat = grams([r[0] for r in rows], [r[1] for r in rows], buckets)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(rows))))
    y = np.array([r[2] for r in rows], float)
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b, seen = np.zeros(buckets), 0.0, np.full(buckets, 1e-8)
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[flat], len(rows)) * scale + b)))
        err = (p - y) * each
        g = np.bincount(flat, (err * scale)[row], buckets) + l2 * w / len(rows)
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        b -= rate * err.sum()
    return np.append(w, b)


def score(w: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Probability that each URL is unwanted."""
    if not hosts:
        return np.zeros(0)
    row, flat = grams(hosts, paths, len(w) - 1)
    n = np.bincount(row, minlength=len(hosts))
    return 1 / (1 + np.exp(-(np.bincount(row, w[flat], len(hosts)) / np.sqrt(np.maximum(1, n)) + w[-1])))


def judge(pages: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules=RULES, table: list | None = None, threshold: float = 0.5) -> DataFrame:
    """Judge every URL: ``keep`` columns, host, path, rule, verdict, p_block.

    ``p_block`` is null where a rule decides. Nulls and texts without ``://``
    have an empty host and path; no rule fits them and the model judges the two
    empty strings. Very long URLs are read whole. Null and repeated ids: rows
    are judged one by one. An empty table gives none, other columns are not read.
    A kept column with the name of a result gets ``_in`` at its end.
    """
    w = fit(training_urls() if table is None else table)
    results = ["host", "path", "rule", "verdict", "ruled", "p_block", "_host", "_path"]
    base = pages.select(*kept(pages, [*keep], results), F.col(url).alias(TEXT)).withColumn("_host", host_of(F.col(TEXT))).withColumn("_path", path_of(F.col(TEXT)))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("_host") == h) | F.col("_host").endswith("." + h)) & F.col("_path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    shared, keep = pages.sparkSession.sparkContext.broadcast(w), beside([*keep], results)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            open_ = np.flatnonzero(cols[-1].is_null().to_numpy(zero_copy_only=False))
            p = np.full(b.num_rows, np.nan)
            host, path = (c.take(pa.array(open_)).to_pylist() for c in cols[-4:-2])
            p[open_] = score(shared.value, [h or "" for h in host], [q or "" for q in path])
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p, pa.float64(), mask=np.isnan(p))], names=[*b.schema.names, "p_block"])

    ready = base.select(*keep, F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), verdict.alias("ruled"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema) + ", p_block double"
    out = ready.mapInArrow(scored, schema)
    model = F.when(F.col("p_block") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*keep, "host", "path", "rule", F.coalesce("ruled", model).alias("verdict"), "p_block")
