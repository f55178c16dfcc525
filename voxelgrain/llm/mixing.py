"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word budget. A budget of e whole source sizes and a rest is
spent as e complete epochs over the source and one weighted draw without
replacement for the rest: every document has an exponential key -ln(u) / w with
u from a hash of its id and w its quality weight, keys are sorted within the
source and sizes summed up to the rest. Keys are first counted in fixed bins of
their logarithm, so that only the one bin of each source in which the budget
ends is sorted. A weight only shifts the logarithm: with 4,096 bins none is
expected to hold more than 0.2 % of a source, whatever its weight is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelgrain.llm.common import WORD, beside, stage

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_EPOCHS = 2
#: Sources whose targets are broadcast at most, of about 100 bytes each.
BROADCAST_SOURCES = 50_000
BINS = 4096
RESULTS = ["size", "source_size", "target", "taken"]
#: Logarithms of keys between which bins are cut; keys beyond go to the end bins.
LEAST, MOST = -12.0, 8.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Quality from 0.05 to 1: letters of any script times variety of words.

    The first factor is the share of letters and marks among the characters
    other than white space, the second ln(1 + distinct words) / ln(1 + words):
    near 1 for prose of any length, low for boilerplate and repeated text. Texts
    without words, and null, have the least weight.
    """
    full = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]", ""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    variety = F.log(1.0 + F.size(F.array_distinct(words))) / F.log(1.0 + F.greatest(F.size(words), F.lit(1)))
    return F.greatest(F.lit(0.05), F.coalesce(letters / F.greatest(full, F.lit(1)) * variety, F.lit(0.0)))


def targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MOST_EPOCHS) -> list[tuple]:
    """(source, size, target) for a table (source, size), one row a source.

    Water filling: a source whose share by weight is above ``most`` times its
    size is held there, and what it can't take is shared anew by weight among
    the others until none is above. Sources are few: this runs on the driver.
    """
    rows = sorted(((r[0], int(r[1])) for r in sizes.collect()), key=lambda r: (r[0] is None, r[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(rows)}
    left, open_, target = total_share * sum(n for _, n in rows), dict(rows), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s, n in open_.items() if weight[s] * unit > most * n]
        if not full:
            target.update({s: weight[s] * unit for s in open_})
            break
        for s in full:
            target[s] = float(most * open_.pop(s))
            left -= target[s]
    return [(s, n, float(target[s])) for s, n in rows]


def mix(documents: DataFrame, size: Column | None = None, weight: Column | None = None, seed: int = 17, bins: int = BINS, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST_EPOCHS, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row.

    With ``keep`` these columns of the row come instead of doc_id and source; one
    with the name of another result gets ``_in`` at its end.

    ``taken`` is words: whole epochs times the size, and in the fractional draw
    the size of each document that fits and, of the one in which the budget
    ends, as many words as are left. Null texts have size 0 and take none; a
    null source is a source of its own, last in order. Ties of keys (repeated
    rows) are broken by id and then shared between equal rows in any order,
    which leaves the multiset of results the same. A null id draws by a digest
    of its text. Very long texts are measured whole, and the last one taken may
    be taken in part. An empty table gives no rows. Columns other than doc_id,
    text and source are not read.
    """
    spark = documents.sparkSession
    size = n_words(F.col("text")) if size is None else size
    weight = quality_weight(F.col("text")) if weight is None else weight
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    more = [f"_keep{i}" for i in range(len(keep or []))]
    drawn = documents.select("doc_id", "source", size.alias("size"), (-F.log(u) / weight).alias("key"), *[F.col(f"`{c}`").alias(m) for c, m in zip(keep or [], more, strict=True)])
    drawn = stage(drawn.withColumn("bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.log("key") - LEAST) * (bins / (MOST - LEAST))))).cast("int")), "mix-keys")
    by_bin = stage(drawn.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    plan = targets(by_bin.groupBy("source").agg(F.sum("bin_size")), weights, total_share, most)
    goal = spark.createDataFrame([(s, n, t, int(t // n) if n else 0) for s, n, t in plan], "source string, source_size long, target double, epochs int")
    goal = goal.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    few = F.broadcast if len(plan) <= BROADCAST_SOURCES else lambda df: df  # else AQE splits hot sources
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    # sources x bins rows at most
    ends = by_bin.withColumn("before", F.coalesce(F.sum("bin_size").over(before), F.lit(0))).alias("b").join(few(goal.alias("g")), F.col("g.source").eqNullSafe(F.col("b.source")))
    cut = ends.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("bin_size") > F.col("rest"))).select(F.col("g.source").alias("source"), F.col("bin").alias("cut_bin"), "before")
    goals = goal.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left").select(F.col("g.source").alias("source"), "source_size", "target", "epochs", "rest", F.coalesce("cut_bin", F.lit(bins)).alias("cut_bin"), F.coalesce("before", F.lit(0)).alias("before"))
    every = drawn.alias("d").join(few(goals.alias("g")), F.col("g.source").eqNullSafe(F.col("d.source"))).select("d.doc_id", "d.source", "d.size", "d.key", "d.bin", "source_size", "target", "epochs", "rest", "cut_bin", "before", *more)
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = every.where(F.col("bin") == F.col("cut_bin"))
    at = at.withColumn("so_far", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = at.withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("so_far"))))
    off = every.where(F.col("bin") != F.col("cut_bin")).withColumn("part", F.when(F.col("bin") < F.col("cut_bin"), F.col("size")).otherwise(F.lit(0)))
    named = ["doc_id", "source"] if keep is None else [F.col(m).alias(n) for m, n in zip(more, beside(keep, RESULTS), strict=True)]
    cols = [*named, "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")]
    return off.select(*cols).unionByName(at.select(*cols))
