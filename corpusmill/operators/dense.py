"""Exact nearest neighbours by dot product: block products in Arrow batches, best k (items or owners) a partition, then best k of all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.staging import no_rows
from corpusmill.operators.topk import OWNED, ROW, Best

#: The most queries that one scan answers; more are asked in blocks, a scan each.
MOST_QUERIES = 4096


def _searcher(shared, k: int, owned: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best, dim = Best(ids, k), queries.shape[1]
        for batch in batches:
            step = max(16, 1_000_000 // len(ids))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                vectors = part.column(1).to_pylist()
                whole = np.array([v is not None and len(v) == dim and None not in v for v in vectors], dtype=bool)
                if whole.any():
                    part = part.filter(pa.array(whole))
                    block = np.array([v for v, ok in zip(vectors, whole.tolist(), strict=True) if ok], dtype=np.float64)
                    best.add(queries @ block.T, part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_pylist() if owned else None)
        yield best.rows(owned)

    return run


def _scored(items: DataFrame, queries: DataFrame, k: int, owned: bool) -> DataFrame:
    """The best ``k`` of each partition for each query, by a scan for each block of queries."""
    spark = items.sparkSession
    asked = queries.select("query_id", "vector").filter("vector is not null")
    n = asked.count()
    blocks = -(-n // MOST_QUERIES)
    out = no_rows(spark, OWNED if owned else ROW)
    rows = items.select(F.col("item").cast("long"), "vector", *(["ref"] if owned else []))
    for block in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
        if len(some):
            shared = spark.sparkContext.broadcast((some["query_id"].to_numpy(np.int64), np.array(some["vector"].tolist(), dtype=np.float64)))
            out = out.unionByName(rows.mapInArrow(_searcher(shared, k, owned), OWNED if owned else ROW))
    return out


def nearest(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``items(item, vector)`` and ``queries(query_id, vector)`` to ``query_id, item, score, rank``: the ``k`` largest dot products.

    Ties go to the smaller item.  Vectors that are null, hold nulls or are of another length than the queries' take no part.
    """
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "item")
    return _scored(items, queries, k, False).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_owners(items: DataFrame, queries: DataFrame, owner: DataFrame, k: int) -> DataFrame:
    """The best part of each owner, then the best ``k`` owners: ``query_id, ref, item, score, rank``; ``owner(item, ref)``.

    Each partition returns the best parts of its best ``k`` owners.
    """
    owned = items.join(owner.select("item", F.col("ref").cast("string").alias("ref")), "item")
    found = _scored(owned, queries, k, True)
    first = Window.partitionBy("query_id", "ref").orderBy(F.round("score", 9).desc(), "item")
    best = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "item")
    return best.withColumn("ref", F.col("ref").cast(owner.schema["ref"].dataType)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rerank(pairs: DataFrame, score, k: int) -> DataFrame:
    """Orders ``pairs(query_id, item, rank, ...)`` by the Column that ``score`` makes of them; ties keep their rank."""
    rows = pairs.withColumn("rerank_score", score)
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k)


def encode(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray], text: str = "text", batch: int = 64) -> DataFrame:
    """Adds ``vector``, unit length, by a function from texts to a matrix, which runs on executors, ``batch`` texts a call.

    Null is an empty text; a vector of zeros stays one.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts, out = part.fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                found = np.asarray(encoder(texts[at : at + batch]), dtype=np.float64)
                norm = np.linalg.norm(found, axis=1, keepdims=True)
                out.extend((found / np.where(norm == 0, 1, norm)).tolist())
            yield pd.Series(out, index=part.index)

    return rows.withColumn("vector", F.pandas_udf(run, "array<double>")(F.col(text)))


def search(items: DataFrame, queries: DataFrame, encoder: Callable[[list[str]], np.ndarray], k: int) -> DataFrame:
    """:func:`nearest` of ``items(item, vector)`` for ``queries(query_id, text)`` encoded by ``encoder``."""
    return nearest(items, encode(queries, encoder).select("query_id", "vector"), k)
