"""Quality rules: robust multivariate outliers, in DataFrame operations only.

Every document gets word, symbol, line and repetition counts. Documents that
fail the base rules go. The others are described by a vector of transformed
statistics; for each (language, source) a minimum-covariance-determinant
estimate of centre and scatter is found: from each of several starts (median and
spread; mean and covariance; median and correlation of squashed values) rows are
ranked by distance, the half that lies nearest gives the next estimate, and so
on until its determinant no longer falls; the start that ends with the least
determinant wins. The estimate is scaled to be consistent for normal data and
reweighted once. A document is rejected when its squared Mahalanobis distance is
over a chi-square quantile. Groups too small for their own estimate use that of
their language, or of the whole table.

A step is one scan: rows are counted in bins of the logarithm of their distance
with sums and products, so the nearest half and its moments come from a small
table; of the bin in which the half ends a share counts.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelgrain.llm.common import WORD, beside, stage

WINDOW = 5
#: Concentration steps at most, and the change of the logarithm of a determinant
#: from which it counts as no longer falling.
STEPS, CONVERGED = 25, 1e-3
SMALLEST_GROUP = 40
#: A document is an outlier if normal data would lie as far out with this chance.
TAIL = 1e-6
#: Fixed values of the chi-square distribution with four degrees of freedom: its
#: median and 0.975 quantile, and the factor that makes the covariance of what lies
#: inside that quantile consistent, 0.975 / P(chi-square with six degrees <= it).
MEDIAN, INSIDE, CONSISTENT = 3.3567, 11.1433, 1.0645
#: Added to the spread of each statistic, so that a constant one makes no outliers.
FLOORS = (0.1, 0.02, 0.02, 0.05)
#: Ordinary prose that every ratio is blended with, so that a few words or lines
#: alone don't make an outlier.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_LINES = 20, 100, 10
#: Bins for each unit of the logarithm of a distance, and the bins at both ends.
BINS, FIRST, LAST = 32, -320, 480
#: Estimates are broadcast up to this many rows, of about 200 bytes each.
BROADCAST_ROWS = 20_000
SALTS = 64
STATS = ("s0", "s1", "s2", "s3")
STATS_INPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]


def _without(text: Column, chars: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def counts(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Nulls and empty texts count 0 everywhere. Windows are compared by a 64-bit
    hash of their five word hashes.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # each step is a projection of its own: what it reads is computed once
    df = documents.select(*keep, t.alias("_t")).withColumn("_w", F.transform(F.regexp_extract_all(F.col("_t"), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    n = F.size("_w")
    at = lambda k: F.get(F.col("_w"), k)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_g", windows)
    twice = F.size("_g") > F.size(F.array_distinct("_g"))
    # (hash, position) sorted: a window found twice has a neighbour with its hash
    pairs = F.when(twice, F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.withColumn("_p", pairs)
    same = lambda i, j: F.coalesce(F.get(F.col("_p"), i)["h"] == F.get(F.col("_p"), j)["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("_p", lambda x, k: same(k, k - 1) | same(k, k + 1)), lambda x: x["i"]))
    df = df.withColumn("_s", starts)
    covered = F.aggregate("_s", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.length(_without(x, SPACES)) > 0)
    df = df.withColumn("_l", lines)
    return df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(_without(F.col("_t"), SPACES)).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def statistics() -> list[Column]:
    """The transformed vector: length, word length, symbols, repetition."""
    n = F.col("n_words") + PRIOR_WORDS
    return [
        F.log1p(F.col("n_words")).alias("s0"),
        F.log((F.col("word_chars") + PRIOR_CHARS) / n).alias("s1"),
        F.sqrt(F.col("n_symbols") / n).alias("s2"),
        F.sqrt((F.col("n_dup_lines") / (F.col("n_lines") + PRIOR_LINES) + F.col("n_repeat_words") / n) / 2).alias("s3"),
    ]


def quantile(tail: float) -> float:
    """The value that chi-square with four degrees of freedom exceeds with chance ``tail``.

    Solves exp(-x / 2) (1 + x / 2) = tail by bisection.
    """
    lo, hi = 0.0, 2000.0
    for _ in range(200):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if -x / 2 + math.log1p(x / 2) > math.log(tail) else (lo, x)
    return lo


PAIRS = list(combinations_with_replacement(range(len(STATS)), 2))
CENTRE, SCATTER = [f"m{i}" for i in range(len(STATS))], [f"c{i}{j}" for i, j in PAIRS]
FACTOR = [f"l{i}{j}" for i in range(len(STATS)) for j in range(i + 1)]


def _factors(est: DataFrame) -> DataFrame:
    """Adds the lower factor l_ij of the scatter c_ij and the logarithm of its determinant.

    One projection, in which later columns name earlier ones.
    """
    made = []
    for i in range(len(STATS)):
        for j in range(i + 1):
            rest = reduce(lambda a, b: a - b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.col(f"c{j}{i}"))
            made.append((F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")).alias(f"l{i}{j}"))
    logdet = reduce(lambda a, b: a + b, [2 * F.log(f"l{i}{i}") for i in range(len(STATS))])
    return est.select("*", *made, logdet.alias("logdet"))


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    made = []
    for i, s in enumerate(STATS):
        rest = reduce(lambda a, b: a - b, [F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)], F.col(s) - F.col(f"m{i}"))
        made.append((rest / F.col(f"l{i}{i}")).alias(f"y{i}"))
    return df.select("*", *made, reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(len(STATS))]).alias("d2"))


def _with(rows: DataFrame, est: DataFrame, key: str, how: str = "inner", few: bool | None = None) -> DataFrame:
    """Rows with their group's estimate, whatever share of rows one group has.

    A written table of estimates is broadcast if it has few rows (counted here,
    unless the caller has); else both sides are salted.
    """
    if est.count() <= BROADCAST_ROWS if few is None else few:
        return rows.join(F.broadcast(est), key, how)
    salted = est.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*STATS, "_no"), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")


def _starts(rows: DataFrame, smallest: int) -> DataFrame:
    """Three estimates (k, start, n, m, c) of each group of ``smallest`` rows or more."""
    aggs = [F.percentile_approx(s, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, s in enumerate(STATS)]
    aggs += [F.avg(s).alias(f"a{i}") for i, s in enumerate(STATS)] + [F.covar_pop(STATS[i], STATS[j]).alias(f"v{i}{j}") for i, j in PAIRS]
    base = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *aggs).where(F.col("n") >= smallest)
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(floor)).alias(f"d{i}") for i, floor in enumerate(FLOORS)]
    base = base.select("k", "n", *spread, *[F.col(f"q{i}")[1].alias(f"q{i}") for i in range(len(STATS))], *[c for c in base.columns if c[0] in "av"])
    base = stage(base.repartition(1), "mcd-base")
    squashed = _with(rows, base.select("k", *[f"{c}{i}" for c in "qd" for i in range(len(STATS))]), "k")
    squashed = squashed.select("k", *[F.tanh((F.col(s) - F.col(f"q{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i, s in enumerate(STATS)])
    pairs = list(combinations(range(len(STATS)), 2))
    turned = squashed.groupBy("k").agg(*[(F.covar_pop(f"z{i}", f"z{j}") / F.greatest(F.stddev_pop(f"z{i}") * F.stddev_pop(f"z{j}"), F.lit(1e-6))).alias(f"r{i}{j}") for i, j in pairs])
    base = base.join(turned, "k")
    floor = lambda i, j: FLOORS[i] ** 2 if i == j else 0.0
    one = [F.col(f"q{i}").alias(m) for i, m in enumerate(CENTRE)] + [(F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    two = [F.col(f"a{i}").alias(m) for i, m in enumerate(CENTRE)] + [(F.col(f"v{i}{j}") + floor(i, j)).alias(f"c{i}{j}") for i, j in PAIRS]
    three = [F.col(f"q{i}").alias(m) for i, m in enumerate(CENTRE)] + [((F.lit(1.0) if i == j else 0.9 * F.col(f"r{i}{j}")) * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}{j}") for i, j in PAIRS]
    each = [base.select("k", F.lit(no).alias("start"), "n", *cols) for no, cols in enumerate((one, two, three))]
    return stage(_factors(reduce(DataFrame.unionByName, each)).repartition(1), "mcd-start")


def _moments(near: DataFrame, key: list[str], consistent: float = 1.0) -> DataFrame:
    """Estimates from sums (w, s_i, p_ij) of differences to the centre m_i."""
    sums = near.groupBy(*key).agg(F.sum("w").alias("w"), *[F.sum(c).alias(c) for c in [f"s{i}_" for i in range(len(STATS))] + [f"p{i}{j}" for i, j in PAIRS]], *[F.first(m).alias(m) for m in CENTRE], F.first("n").alias("n"))
    mean = lambda i: F.col(f"s{i}_") / F.col("w")
    cov = lambda i, j: consistent * (F.col(f"p{i}{j}") / F.col("w") - mean(i) * mean(j)) + (FLOORS[i] ** 2 if i == j else 0.0)
    return sums.select(*key, "n", *[(F.col(m) + mean(i)).alias(m) for i, m in enumerate(CENTRE)], *[cov(i, j).alias(f"c{i}{j}") for i, j in PAIRS])


def _sums(far: DataFrame, key: list[str]) -> DataFrame:
    """Rows added up: w of them, sums and products of differences to the centre."""
    diff = lambda i: F.col(STATS[i]) - F.col(f"m{i}")
    cols = [F.count(F.lit(1)).alias("w"), *[F.sum(diff(i)).alias(f"s{i}_") for i in range(len(STATS))], *[F.sum(diff(i) * diff(j)).alias(f"p{i}{j}") for i, j in PAIRS]]
    return far.groupBy(*key).agg(*cols, *[F.first(m).alias(m) for m in CENTRE], F.first("n").alias("n"))


def mcd(rows: DataFrame, smallest: int = SMALLEST_GROUP, steps: int = STEPS) -> DataFrame:
    """(k, n, m_i, l_ij): reweighted estimates of the groups ``k`` of ``rows``.

    ``rows`` has a row for each group that a document counts in, and ``_no``, any
    number that differs between documents, for salting. Tables of estimates are
    written, with a row a group.
    """
    est = _starts(rows, smallest)
    few = est.count() <= BROADCAST_ROWS  # no step adds a group
    for _ in range(steps):
        far = _distance(_with(rows, est, "k", few=few))
        at = F.greatest(F.lit(FIRST), F.least(F.lit(LAST), F.floor(F.log(F.col("d2") + 1e-12) * BINS))).cast("int")
        binned = _sums(far.withColumn("bin", at), ["k", "start", "bin"])
        before = F.coalesce(F.sum("w").over(Window.partitionBy("k", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        near = binned.withColumn("before", before).where(F.col("before") < F.col("n") / 2)
        # of the bin in which the half ends so much counts as makes it a half
        share = F.least(F.lit(1.0), (F.col("n") / 2 - F.col("before")) / F.col("w"))
        near = near.withColumn("share", share).withColumns({c: F.col(c) * F.col("share") for c in ["w", *[f"s{i}_" for i in range(len(STATS))], *[f"p{i}{j}" for i, j in PAIRS]]})
        new = _factors(_moments(near, ["k", "start"])).repartition(1)
        new = stage(new.join(est.select("k", "start", F.col("logdet").alias("was")), ["k", "start"]), "mcd-step")
        est, moved = new.drop("was"), new.where(F.abs(F.col("logdet") - F.col("was")) > CONVERGED)
        if moved.isEmpty():
            break
    best = est.groupBy("k").agg(F.min_by(F.struct("n", *CENTRE, *SCATTER, *FACTOR), F.struct("logdet", "start")).alias("e")).select("k", "e.*")
    best = stage(best.repartition(1), "mcd-best")
    scale = _distance(_with(rows, best, "k", few=few)).groupBy("k").agg((F.greatest(F.percentile_approx("d2", 0.5, 1000), F.lit(1e-6)) / MEDIAN).alias("scale"))
    best = stage(best.join(scale, "k").repartition(1), "mcd-scaled")
    inside = _distance(_with(rows, best, "k", few=few)).where(F.col("d2") <= INSIDE * F.col("scale"))
    final = _factors(_moments(_sums(inside, ["k"]), ["k"], CONSISTENT))
    return stage(final.select("k", "n", *CENTRE, *FACTOR).repartition(1), "mcd")


def judge(documents: DataFrame, keep: list[str], text: str = "text", groups: tuple[str, ...] = ("lang", "source"), tail: float = TAIL, smallest: int = SMALLEST_GROUP, steps: int = STEPS) -> DataFrame:
    """``keep`` columns, the counts, base_failed, distance and kept.

    Null languages and sources form groups of their own. Documents that fail
    the base rules (null and empty texts among them) take no part in the
    estimates, have a null distance and are not kept. With fewer than
    ``smallest`` rows, a group uses its language's estimate, and a language the
    whole table's; a table with fewer keeps all that pass the base rules. Very
    long texts are counted whole. Repeated rows are judged alike; an empty table
    gives none. A kept column with the name of a result gets ``_in`` at its end.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    marks = [f"_g{i}" for i in range(len(groups))]
    key = [F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("")).alias(m) for g, m in zip(groups, marks, strict=True)]
    src = documents.select(*[F.col(c).alias(k) for c, k in zip(keep, names, strict=True)], F.col(text).alias("_text"), *key)
    rows = counts(src, [*names, *marks], "_text")
    # the keys of a row's groups, the narrowest first; that of the whole table is "[]"
    levels = [f"_level{d}" for d in range(len(marks), -1, -1)]
    keys = [F.to_json(F.array(*marks[:d])).alias(f"_level{d}") if d else F.lit("[]").alias("_level0") for d in range(len(marks), -1, -1)]
    rows = stage(rows.withColumn("base_failed", base_failed()).select("*", *statistics(), *keys, F.xxhash64(*names, *STATS_INPUT).alias("_no")), "rule-stats")
    passed = rows.where(~F.col("base_failed"))
    est = mcd(passed.select(F.explode(F.array(*levels)).alias("k"), *STATS, "_no"), smallest, steps)
    out, used = passed, []
    for level in levels:
        out = _with(out, est.select(F.col("k").alias(level), F.struct(*CENTRE, *FACTOR).alias(f"_e{level}")), level, "left")
        used.append(F.col(f"_e{level}"))
    out = _distance(out.withColumn("_e", F.coalesce(*used)).select(*rows.columns, "_e.*")).withColumn("distance", F.col("d2"))
    measures = RESULTS[:-2]
    back = [F.col(k).alias(c) for c, k in zip(beside(keep, RESULTS), names, strict=True)]
    kept = out.select(*back, *measures, "distance", F.coalesce(F.col("distance") <= quantile(tail), F.lit(True)).alias("kept"))
    gone = rows.where("base_failed").select(*back, *measures, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return kept.unionByName(gone)
