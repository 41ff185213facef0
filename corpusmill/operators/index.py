"""Tokens of a corpus kept as a table under a fingerprint of the rows, and read again when these are the same."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(rows: DataFrame, columns: list[str]) -> str:
    """A digest of a set of rows, whatever their order: their number, and exact sums of the four words of each row's MD5.

    Sums are partial on every executor, so nothing but one row is gathered.
    """
    digest = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    words = [F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(4)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *words).select(F.md5(F.concat_ws(",", "n", *[f"w{i}" for i in range(4)])).alias("x"))
    return found.first()["x"]


def indexed(rows: DataFrame, tokens: Column, folder: str, key: str = "item", text: str = "text", version: str = "1") -> DataFrame:
    """``key, toks`` of ``rows``, from ``folder`` if they are there, else made and written there first.

    The folder's name holds the fingerprint of ids and texts and ``version``, which must change with ``tokens``.  A table
    without its mark of success, or that can't be read, is made again.
    """
    spark = rows.sparkSession
    path = f"{folder.rstrip('/')}/tokens-{version}-{fingerprint(rows, [key, text])}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        try:
            return spark.read.parquet(path).select(key, "toks")
        except AnalysisException:
            pass
    rows.select(key, tokens.alias("toks")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select(key, "toks")
