"""Helpers shared by the training-data operators: written tables, group blocks, connected components."""

from __future__ import annotations

import itertools
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.staging import MADE

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local master may go without the setting (tests); a cluster without it is an error, since a
    machine-local folder would not be seen by the other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="corpusmill-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path for a table in the shared folder, which ``corpusmill.operators.staging.discard`` deletes at the end of a job."""
    MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_on_worker(key: tuple, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, kept for later tasks of the same Python worker (functions travel by value, so
    their own globals are new for each task).  For bounded tables that follow from ``key`` alone.
    """
    store = sys.modules.setdefault("_corpusmill_kept", types.ModuleType("_corpusmill_kept"))
    if key not in store.__dict__:
        store.__dict__[key] = build()
    return store.__dict__[key]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first ``name_1``, ``name_2``, ... that no column of ``df`` has (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1))) if x.lower() not in taken)


def without_documents(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose id and text's hash are in ``gone(doc_id, text_hash)``; columns as they were, whatever their names."""
    ident, mark = free_name(docs, "gone_id"), free_name(docs, "gone_text")
    gone = gone.select(F.col("doc_id").alias(ident), F.col("text_hash").alias(mark)).distinct()
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone[ident]) & (F.xxhash64(docs[text_col]) == gone[mark]), "left_anti")


def block_pairs(df: DataFrame, key: str, ident: str, cap: int, sized: str | None = None) -> DataFrame:
    """Deals the rows of every group to tasks that hold at most about ``2 * cap`` of them.

    A group of n rows is cut by hash into g = ceil(n / cap) blocks.  Every unordered pair of blocks is a
    task (``key``, ``bi``, ``bj``); a row of block ``b`` goes to the g tasks that name its block, so that
    each pair of rows meets in exactly one task when pairs inside a block are left to ``bi = bj``.
    Groups of one row are dropped.  No task ever sees an unbounded group.  ``sized``: the column that holds n, if it
    is known already.  The columns of ``df`` are the caller's own; ``b``, ``bi`` and ``bj`` are added.
    """
    if sized is None:
        sized = "_n"
        df = df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(sized)), key)
    rows = df.filter(F.col(sized) > 1).withColumn("_g", F.ceil(F.col(sized) / F.lit(cap)).cast("int"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64(ident, F.lit(77)), F.col("_g")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return rows.withColumn("bi", F.least("b", "_o")).withColumn("bj", F.greatest("b", "_o")).drop(sized, "_g", "_o")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): ``node``, ``root`` (the smallest node), for every node of an edge.

    Alternating large-star and small-star steps (Kiveris et al., 2014): in both, every node points its
    neighbours to the smallest node that it knows.  Each step is written to the shared folder; the edge
    count never grows.  The smallest neighbours are a table of their own, one row a node, so that a hot node is
    a plain skewed join, which AQE splits.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "edges-low")
        large = written(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "edges-large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "edges-low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("b")).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
