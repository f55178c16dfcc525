"""Filters, joins, aggregates, windows and set operations on measurement tables.

Each function takes and returns lazy DataFrames; Catalyst plans them. NaN counts
as NULL (``nan_to_null`` at ingest), standard deviations are of the sample unless
named otherwise, and ties break by the id named in the docstring.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelgrain.storage import parts, stage

#: Rows of one value that are written out together.
RUN = 1 << 16

# -- ingest and filters ----------------------------------------------------


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of every float column becomes NULL."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def finite(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(F.col(col)) < float("inf")))


def query_filter(df: DataFrame, text: str, strict: bool = True) -> DataFrame:
    """Conjunction of comma-separated conditions such as ``radius > 5, pool in ('A', 'B')``.

    Commas inside quotes or brackets belong to a condition. A condition that Spark can't resolve raises; with ``strict`` off it is left
    out, as an interactive tool would.
    """
    parts = re.findall(r"""((?:'[^']*'|"[^"]*"|`[^`]*`|\((?:[^()'"]|'[^']*'|"[^"]*"|\([^()]*\))*\)|[^,])+)""", text)
    for part in filter(None, (p.strip() for p in parts)):
        try:
            narrowed = df.where(F.expr(part))
            narrowed.schema  # noqa: B018  resolves the condition
        except Exception:
            if strict:
                raise
            continue
        df = narrowed
    return df


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drops the columns that exist among ``names``."""
    return df.drop(*names)


def first_existing(df: DataFrame, candidates: list[str]) -> Column:
    """The first of the candidate columns that the table has."""
    for c in candidates:
        if c in df.columns:
            return F.col(c)
    raise ValueError(f"none of {candidates} in {df.columns}")


def all_in(df: DataFrame, key: list[str], candidates: list[str], allowed: list) -> DataFrame:
    """Groups in which every row's status is one of the allowed values."""
    return df.groupBy(*key).agg(F.bool_and(F.coalesce(first_existing(df, candidates).isin(allowed), F.lit(False))).alias("complete"))


def name_contains_any(col: Column, words: list[str]) -> Column:
    """Whether the name holds one of the words, whatever their case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(col), F.lit(w.lower())) for w in words], F.lit(False))


def replace_values(col: Column, mapping: dict) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), col), col) if pairs else col


# -- joins -----------------------------------------------------------------


def key_mismatch(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one of the two tables has."""
    x, y = a.select(*key).distinct(), b.select(*key).distinct()
    return x.join(y, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("only_in", F.lit("right")))


def equal_join(a: DataFrame, b: DataFrame, key: list[str], suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """Inner join of tables that must have the same keys; others raise.

    Columns that both have get the suffixes.
    """
    if not key_mismatch(a, b, key).isEmpty():
        raise ValueError(f"the tables differ in their keys {key}")
    return suffix_join(a, b, key, suffixes)


def suffix_join(a: DataFrame, b: DataFrame, key: list[str], suffixes: tuple[str, str] = ("_left", "_right"), how: str = "inner") -> DataFrame:
    both = (set(a.columns) & set(b.columns)) - set(key)
    for c in both:
        a, b = a.withColumnRenamed(c, c + suffixes[0]), b.withColumnRenamed(c, c + suffixes[1])
    return a.join(b, key, how)


def join_distances(tables: dict[str, DataFrame], key: list[str], col: str = "distance") -> DataFrame:
    """One distance column a structure: {name: table} becomes name_distance columns."""
    parts = [t.select(*key, F.col(col).alias(f"{n}_distance")) for n, t in tables.items()]
    return reduce(lambda a, b: a.join(b, key), parts)


def merge_update(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Full outer merge in which values of ``b`` go over those of ``a``."""
    cols = [c for c in a.columns if c not in key]
    x, y = a.alias("x"), b.alias("y")
    on = reduce(lambda p, q: p & q, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in key])
    keys = [F.coalesce(F.col(f"y.{k}"), F.col(f"x.{k}")).alias(k) for k in key]
    vals = [F.coalesce(F.col(f"y.{c}"), F.col(f"x.{c}")).alias(c) if c in b.columns else F.col(f"x.{c}") for c in cols]
    return x.join(y, on, "full_outer").select(*keys, *vals)


def zip_by_order(a: DataFrame, b: DataFrame, order_a: str, order_b: str, within: list[str]) -> DataFrame:
    """Pairs the n-th rows of both tables in each group of ``within``."""
    number = lambda df, o: df.withColumn("_n", F.row_number().over(Window.partitionBy(*within).orderBy(o)))
    return number(a, order_a).join(number(b, order_b), [*within, "_n"]).withColumnRenamed("_n", "position")


def first_equal_content(a: DataFrame, b: DataFrame, content: str, id_a: str, id_b: str) -> DataFrame:
    """For each row of ``a`` the first row of ``b`` with equal content, by hash."""
    x = a.select(id_a, F.sha2(F.col(content).cast("binary"), 256).alias("h"))
    y = b.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("h")).agg(F.min(id_b).alias(id_b))
    return x.join(y, "h").select(id_a, id_b)


def prefix_join(names: DataFrame, files: DataFrame, name: str, file: str) -> DataFrame:
    """Files whose name starts with a row's name; an equal name comes first.

    All prefixes of a file's name are looked up, which makes it an equality join.
    """
    cut = files.withColumn("_len", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(file))))).withColumn(name, F.substring(F.col(file), F.lit(1), F.col("_len")))
    hits = names.join(cut, name)
    best = F.row_number().over(Window.partitionBy(name).orderBy(F.col(file) != F.col(name), file))
    return hits.withColumn("_r", best).withColumn("matches", F.count(F.lit(1)).over(Window.partitionBy(name))).where("_r = 1").drop("_r", "_len")


# -- aggregates ------------------------------------------------------------


def mean_std(df: DataFrame, key: list[str], cols: list[str], population: bool = False) -> DataFrame:
    f = F.stddev_pop if population else F.stddev_samp
    return df.groupBy(*key).agg(*[a for c in cols for a in (F.avg(c).alias(f"{c}_mean"), f(c).alias(f"{c}_std"))])


def format_mean_std(mean: Column, std: Column, factor: float = 100, digits: int = 2) -> Column:
    show = lambda c: F.format_string(f"%.{digits}f", c * factor)
    return F.concat(show(mean), F.lit(" +- "), show(std))


def counts_per_group(df: DataFrame, group: str, category: str, values: list[str]) -> DataFrame:
    """Rows for each group and category, 0 where a group lacks one."""
    return df.groupBy(group).pivot(category, values).count().na.fill(0, values)


def category_summary(df: DataFrame, group: str, category: str, values: list[str]) -> DataFrame:
    """Mean and deviation of the counts of each category over the groups."""
    wide = counts_per_group(df, group, category, values)
    return wide.unpivot([group], values, category, "n").groupBy(category).agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"))


def with_total(df: DataFrame, key: str, aggs: dict[str, Column], total: str = "all") -> DataFrame:
    """Aggregates for each key and over all rows, under the name ``total``."""
    made = df.rollup(key).agg(F.grouping(key).alias("_g"), *[c.alias(n) for n, c in aggs.items()])
    return made.select(F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(key)).alias(key), *aggs)


def bridge_groups(df: DataFrame, bridge: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Population statistics over overlapping groups given by (group, key) rows."""
    return mean_std(df.join(bridge, key), ["group"], cols, population=True)


def micro_scores(df: DataFrame, key: list[str]) -> DataFrame:
    """Precision, recall and F1 from summed tp, fp and fn; null where undefined."""
    s = df.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return s.select(*key, F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def binary_recall(df: DataFrame, hit: Column, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.coalesce(F.try_divide(F.count_if(hit), F.count(F.lit(1))), F.lit(0.0)).alias("recall"))


def conditional_means(df: DataFrame, group: str, category: str, values: list[str], cols: list[str]) -> DataFrame:
    """Counts and means of each measure, over all rows and for each category."""
    aggs = [F.count(F.lit(1)).alias("n_all")] + [F.avg(c).alias(f"all_{c}") for c in cols]
    for v in values:
        own = F.col(category) == v
        aggs += [F.count_if(own).alias(f"n_{v}")] + [F.avg(F.when(own, F.col(c))).alias(f"{v}_{c}") for c in cols]
    return df.groupBy(group).agg(*aggs)


def by_condition(df: DataFrame, condition: str, used_for: str, group: str, count: str) -> DataFrame:
    """Groups and summed counts for each condition, each use, and in all."""
    sets = df.groupingSets([[condition], [used_for], []], condition, used_for)
    return sets.agg(F.count_distinct(group).alias("n_groups"), F.sum(count).alias("total"), F.grouping_id(condition, used_for).alias("level"))


def confusion(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    return df.groupBy(a).pivot(b, values).count().na.fill(0, values)


def accuracy(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("int")).alias("accuracy"))


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins; the upper end belongs to the last one."""
    b = F.least(F.lit(bins - 1), F.floor((F.col(col) - lo) / ((hi - lo) / bins)))
    return df.where(F.col(col).between(lo, hi)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def list_sizes(col: Column) -> Column:
    """Entries of a comma-separated list: null for null, 1 for a number."""
    return F.when(col.isNotNull(), F.size(F.split(col.cast("string"), ",")))


def uniqueness(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count_distinct(col).alias("n_distinct"), F.count(col).alias("n"), F.try_divide(F.count_distinct(col), F.count(col)).alias("share"))


def deviating(df: DataFrame, key: str, col: str, digits: int = 3) -> DataFrame:
    """Groups with more than one rounded value, with the values."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(F.bround(col, digits))).alias("values")).where(F.size("values") > 1)


# -- windows and shapes ----------------------------------------------------


def top_n(df: DataFrame, key: list[str], n: int, *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in an order, with their ``rank``: only they meet in one task."""
    w = Window.orderBy(*order)
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(w))


def split_tasks(df: DataFrame, n: int, order: str, within: list[str]) -> DataFrame:
    """Task numbers from 0; the first tasks get one row more where it doesn't divide."""
    return df.withColumn("task", F.ntile(n).over(Window.partitionBy(*within).orderBy(order)) - 1)


def ordered_split(df: DataFrame, order: str, within: list[str], train: float = 0.8, val: float = 0.1) -> DataFrame:
    """train, val and test in the order of a column; the rest is test."""
    w = Window.partitionBy(*within)
    n, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order))
    return df.withColumn("split", F.when(k <= F.floor(n * train), "train").when(k <= F.floor(n * train) + F.floor(n * val), "val").otherwise("test"))


def hash_split(df: DataFrame, key: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """A lasting random split: it depends on the key alone."""
    u = F.crc32(F.col(key).cast("string").cast("binary")) % 1000
    return df.withColumn("split", F.when(u < int(train * 1000), "train").when(u < int((train + val) * 1000), "val").otherwise("test"))


def ragged_pivot(df: DataFrame, column: str, value: str, values: list[str]) -> DataFrame:
    """One column a group, padded with nulls: rows are numbered within each.

    Values are counted and the counts sorted in ranges, each of which starts where
    the ones before it end; then every value is repeated, in runs of ``RUN`` rows at
    most. So neither a group nor a frequent value is sorted in one task.
    """
    spark = df.sparkSession
    seen = stage(df.groupBy(F.col(column).alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "pivot-counts")
    ranges = seen.repartitionByRange(parts(spark, seen.count()), "_g", "_v").withColumn("_p", F.spark_partition_id())
    ranges = stage(ranges, "pivot-ranges")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    heads = ranges.groupBy("_g", "_p").agg(F.sum("_n").alias("_n"))  # a row for each group and range
    heads = heads.select(F.col("_g").alias("_of"), F.col("_p").alias("_in"), F.coalesce(F.sum("_n").over(before("_g").orderBy("_p")), F.lit(0)).alias("_head"))
    placed = ranges.withColumn("_at", F.coalesce(F.sum("_n").over(before("_g", "_p").orderBy("_v")), F.lit(0)))
    placed = placed.join(F.broadcast(heads), F.col("_g").eqNullSafe(F.col("_of")) & (F.col("_p") == F.col("_in")))
    runs = placed.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))))
    runs = runs.select("_g", "_v", (F.col("_head") + F.col("_at") + F.col("_r")).alias("_at"), F.least(F.col("_n") - F.col("_r"), F.lit(RUN)).alias("_n"))
    runs = stage(runs, "pivot-runs")
    total = runs.agg(F.sum("_n")).first()[0] or 0
    row = F.explode(F.expr("sequence(cast(_at + 1 as int), cast(_at + _n as int))")).alias("row")
    dealt = runs.repartition(parts(spark, total), "_g", "_at").select("_g", "_v", row).repartition(parts(spark, total), "row")
    return dealt.groupBy("row").agg(*[F.max(F.when(F.col("_g") == v, F.col("_v"))).alias(v) for v in values])


def standardise(df: DataFrame, col: str, within: list[str]) -> DataFrame:
    w = Window.partitionBy(*within)
    return df.withColumn(f"{col}_standard", (F.col(col) - F.avg(col).over(w)) / F.stddev_pop(col).over(w))


# -- sets and updates ------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` in place of the old rows with their keys."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def missing(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is still to do: the manifest without what is done."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def append_column(a: DataFrame, b: DataFrame, order_a: str, order_b: str, within: list[str]) -> DataFrame:
    """Columns side by side in row order in each group, padded with nulls."""
    number = lambda df, o: df.withColumn("row", F.row_number().over(Window.partitionBy(*within).orderBy(o)))
    return number(a, order_a).join(number(b, order_b), [*within, "row"], "full_outer")


def union_tagged(tables: dict[str, DataFrame], tag: str = "origin") -> DataFrame:
    parts = [t.withColumn(tag, F.lit(n)) for n, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def assign_pools(df: DataFrame, rules: list[tuple[str, Column]], default: str = "unassigned") -> DataFrame:
    """A pool for each row; of several rules that hold the last wins."""
    pool = F.lit(default)
    for name, holds in rules:
        pool = F.when(holds, F.lit(name)).otherwise(pool)
    return df.withColumn("pool", pool)


def update_pool(pools: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Replaces the pool ``name``: its old rows go, the ids leave other pools."""
    rest = pools.where(~F.col("pool").eqNullSafe(F.lit(name))).join(ids.select("id"), "id", "left_anti")
    return rest.unionByName(ids.select("id").distinct().withColumn("pool", F.lit(name)))


def correct_pools(assigned: DataFrame, corrections: DataFrame, names: dict[int, str]) -> DataFrame:
    """(id, pool) after corrections (id, value): one value other than 0 decides,
    several leave the pool as it was."""
    one = corrections.where(F.col("value") != 0).groupBy("id").agg(F.collect_set("value").alias("v")).where(F.size("v") == 1)
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return assigned.join(one, "id", "left").select("id", F.coalesce(F.element_at(lookup, F.col("v")[0]), F.col("pool")).alias("pool"))


def status_table(expected: DataFrame, found: DataFrame, key: list[str], count: str) -> DataFrame:
    """missing, empty or ok for each expected row."""
    state = F.when(F.col(count).isNull(), "missing").when(F.col(count) == 0, "empty").otherwise("ok")
    return expected.join(found, key, "left").withColumn("status", state)


def keyword_hits(names: DataFrame, words: list[str], name: str, dataset: str) -> DataFrame:
    """Term counts over object names that are no bare numbers: (term, hits, datasets)."""
    ok = names.where(~F.col(name).rlike(r"^\s*\d+\s*$"))
    term = F.explode(F.array(*[F.lit(w.lower()) for w in words])).alias("term")
    hit = ok.select(dataset, F.lower(F.col(name)).alias("_n"), term).where(F.contains(F.col("_n"), F.col("term")))
    return hit.groupBy("term").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct(dataset).alias("datasets"))
