"""Manifests, splits, annotation listings and table files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, stem, extension, length) of all files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("extension"), "length")


def check_count(files: DataFrame, expected: int) -> DataFrame:
    """The manifest, if it lists ``expected`` files; raises otherwise."""
    n = files.count()
    if n != expected:
        raise ValueError(f"expected {expected} files, found {n}")
    return files


def splits(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(dataset, split, file) from a JSON file {split: [file, ...]}."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("split", "files"))
    return parsed.select(F.lit(dataset).alias("dataset"), "split", F.explode("files").alias("file"))


def object_listing(lines: DataFrame) -> DataFrame:
    """Objects of a listing (file, line_no, line): lines OBJECT n, NAME: s, ``n contours``.

    Values belong to the last OBJECT line before them in their file.
    """
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    number = F.when(F.col("line").rlike(r"^\s*OBJECT\s+\d+"), F.regexp_extract("line", r"OBJECT\s+(\d+)", 1).cast("int"))
    rows = lines.withColumn("object_id", F.last(number, ignorenulls=True).over(w)).where("object_id is not null")
    name = F.when(F.col("line").rlike(r"^\s*NAME:"), F.trim(F.regexp_extract("line", r"NAME:(.*)$", 1)))
    contours = F.when(F.col("line").rlike(r"\d+\s+contours"), F.regexp_extract("line", r"(\d+)\s+contours", 1).cast("int"))
    return rows.groupBy("file", "object_id").agg(F.max(name).alias("name"), F.max(contours).alias("contours"))


def points(table: DataFrame, height: int, exclude: list[str] | None = None, resolution: float | None = None) -> DataFrame:
    """Point annotations (object_id, name, x, y, z, size) as (object_id, name, z, y, x, radius).

    y is flipped, names that hold an excluded word (any case) and sizes of 0 or
    less are dropped, and sizes are divided by the resolution.
    """
    ok = F.col("size") > 0
    for word in exclude or []:
        ok = ok & ~F.contains(F.lower("name"), F.lit(word.lower()))
    to_int = lambda c: F.floor(c + 0.5).cast("int")
    return table.where(ok).select("object_id", "name", to_int(F.col("z")).alias("z"), to_int(height - F.col("y")).alias("y"), to_int(F.col("x")).alias("x"), (F.col("size") / (resolution or 1.0)).alias("radius"))


def point_lines(spheres: DataFrame, height: int, min_radius: float = 0.0) -> DataFrame:
    """Text lines ``id contour x y z radius`` of an export, y flipped."""
    ok = spheres.where(F.col("radius") >= min_radius)
    return ok.select(F.format_string("%d %d %d %d %d %.2f", F.col("id").cast("int"), F.lit(1), F.col("x").cast("int"), (F.lit(height) - F.col("y")).cast("int"), F.col("z").cast("int"), F.col("radius").cast("double")).alias("value"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, JSON or Parquet by extension."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind in ("json", "parquet"):
        return getattr(spark.read, kind)(path)
    raise ValueError(f"no table format {kind!r}")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """By extension; without one, CSV."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "csv"
    if kind == "csv":
        df.write.mode(mode).csv(path if path.endswith(".csv") else path + ".csv", header=True)
    elif kind in ("json", "parquet"):
        getattr(df.write.mode(mode), kind)(path)
    else:
        raise ValueError(f"no table format {kind!r}")


def write_by_pool(df: DataFrame, path: str, column: str = "pool") -> None:
    """One folder for each value of the column."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)
