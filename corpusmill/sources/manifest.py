"""Fingerprints and manifests of files and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.staging import staged


def fingerprint_rows(rows: DataFrame, order: list[Column], value: Column) -> DataFrame:
    """One row, ``fingerprint``: SHA-256 over the rows' SHA-256 values in order.

    Only digests are gathered for the order; for a listing of files that is what a driver holds anyway.
    """
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    marks = rows.select(F.struct(*keys, F.sha2(value, 256).alias("h")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), "")
    return marks.agg(F.sha2(joined, 256).alias("fingerprint"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, their number from 0 in the order of the columns ``order``: ranges are sorted apart, and only their sizes are gathered."""
    cuts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cuts = staged(cuts.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranges")
    sizes = cuts.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return cuts.join(F.broadcast(before), "_range").withColumn("place", F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def fingerprint_tree(rows: DataFrame, order: list[Column], value: Column, width: int = 1024, levels: int | None = None) -> DataFrame:
    """One row, ``fingerprint``: a tree of SHA-256 digests over the rows' values in order (rows that are equal in it, by digest).

    Every ``width`` digests one after another are joined and digested, and so on up to one: the same rows have the same fingerprint
    however they are spread, and no task holds more than ``width`` of them at a time.  No rows have that of an empty text.
    With ``levels`` the tree ends there, with a row for every digest of that level (``width ** levels`` rows each); no rows have none.
    """
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    marks = rows.select(*keys, F.sha2(value, 256).alias("h"))
    level = staged(numbered(marks, [*[f"k{i}" for i in range(len(keys))], "h"]).select("place", "h"), "digests")
    made = 0
    while True:
        made += 1
        group = F.floor(F.col("place") / width)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "h"))), lambda x: x["h"]), "")
        level = staged(level.groupBy(group.alias("place")).agg(F.sha2(joined, 256).alias("h")), "digests")
        if levels == made:
            return level.select(F.col("h").alias("fingerprint"))
        if level.limit(2).count() < 2:
            if levels:
                return level.select(F.col("h").alias("fingerprint"))
            one = level.agg(F.max("h").alias("h"))
            return one.select(F.coalesce("h", F.sha2(F.lit(""), 256)).alias("fingerprint"))


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path, length, modified, sha256`` of the files under ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def mismatches(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, problem`` for files of ``manifest(path, length, sha256)`` that are missing or differ."""
    rows = manifest.alias("m").join(found.alias("f"), F.col("m.path") == F.col("f.path"), "left")
    problem = (
        F.when(F.col("f.path").isNull(), "missing")
        .when(F.col("m.length") != F.col("f.length"), "size mismatch")
        .when(F.lower("m.sha256") != F.col("f.sha256"), "sha256 mismatch")
    )
    return rows.select("m.path", problem.alias("problem")).filter("problem is not null")
