"""Intermediate tables in the folder that driver and executors share: a long plan cut into short ones.

Rows that several branches read are computed once, plans stay small, and a lost executor costs no recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOCAL: dict[str, str] = {}
#: The tables that this process made, as long as they aren't discarded.
MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where the master is this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="corpusmill-"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def no_rows(spark: SparkSession, schema: str | StructType) -> DataFrame:
    """A table without rows to add others to.  One from an empty list is an RDD of Python's, for which every core starts another worker."""
    return spark.range(1).select(F.from_json(F.lit("{}"), schema).alias("r")).select("r.*").limit(0)


def discard(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this process made so far, and returns their number.

    For the end of a job: DataFrames that were returned before may read these tables, so write or collect them first.  Stored indexes,
    replies and published runs stay.
    """
    n = 0
    while MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(MADE.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n
