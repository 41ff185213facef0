"""Exact nearest neighbours by dot product over a stored index that skips what can't be among the best.

``build`` takes some vectors as pivots (their number is a parameter), gives every vector to its nearest one, and cuts each
pivot's vectors, in the order of their distance, into blocks: a table in folders by pivot, and a table of the blocks with their
pivot, least and greatest distance and greatest length.  From these follows how large a dot product with a block's vectors can
be.  ``nearest`` first compares each query with the few blocks of the largest bounds, which gives a score that a
neighbour must reach; then only with the blocks whose bound reaches it.  What is left out can't matter, so the result is exact.

A pivot with many vectors (copies, say) is dealt to several tasks.  Queries are broadcast in blocks of ``MOST_QUERIES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.dense import MOST_QUERIES
from corpusmill.operators.staging import no_rows, staged

PIVOTS, BLOCK, SLICE = 64, 256, 50_000
#: Blocks that every task proposes for the first look; slack for rounding where bounds are compared with scores.
FIRST, NEAR = 4, 1e-8


@dataclass
class Index:
    spark: SparkSession
    path: str
    pivots: np.ndarray

    def vectors(self) -> DataFrame:
        """``pivot, block, item, vector``."""
        return self.spark.read.parquet(f"{self.path}/vectors")

    def blocks(self) -> DataFrame:
        """``pivot, block, n, least, most, length``."""
        return self.spark.read.parquet(f"{self.path}/blocks")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def build(items: DataFrame, path: str, pivots: int = PIVOTS) -> Index:
    """The index of ``items(item, vector)`` in ``path``.

    Vectors that are null, hold nulls, or haven't the most frequent length take no part.
    """
    spark = items.sparkSession
    whole = items.select(F.col("item").cast("long"), F.col("vector").cast("array<double>")).filter(F.coalesce(~F.exists("vector", lambda x: x.isNull()), F.lit(False)))
    usual = whole.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = usual["n"] if usual else 0
    whole = whole.filter(F.size("vector") == dim)
    some = whole.orderBy(F.xxhash64("item"), "item").limit(pivots).select("vector").collect()
    centres = np.array([r[0] for r in some], dtype=np.float64).reshape(len(some), dim)
    shared = spark.sparkContext.broadcast(centres)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        square = (centres**2).sum(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column("vector"), dim)
                pivot = (square - 2 * x @ centres.T).argmin(1)
                distance = np.sqrt(((x - centres[pivot]) ** 2).sum(1))
                yield part.append_column("pivot", pa.array(pivot.astype(np.int32))).append_column("distance", pa.array(distance)).append_column("length", pa.array(np.sqrt((x**2).sum(1))))

    given = staged(whole.mapInArrow(give, "item long, vector array<double>, pivot int, distance double, length double"), "given") if dim else whole.filter("false").selectExpr("*", "0 pivot", "0d distance", "0d length")
    slices = given.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))  # a row a pivot
    dealt = given.join(F.broadcast(slices), "pivot").withColumn("slice", F.pmod(F.xxhash64("item"), F.col("slices")).cast("int")).drop("slices")
    dealt = dealt.repartition("pivot", "slice").sortWithinPartitions("pivot", "slice", "distance", "item")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, inside, group = (TaskContext.get().partitionId() << 32) - 1, BLOCK, None
        for batch in batches:
            numbers = []
            for key in zip(batch.column("pivot").to_pylist(), batch.column("slice").to_pylist(), strict=True):
                if inside == BLOCK or key != group:
                    block, inside, group = block + 1, 0, key
                inside += 1
                numbers.append(block)
            yield batch.append_column("block", pa.array(numbers, pa.int64()))

    rows = dealt.mapInArrow(cut, "pivot int, item long, vector array<double>, distance double, length double, slice int, block long")
    rows.drop("slice").write.mode("overwrite").partitionBy("pivot").parquet(f"{path}/vectors")
    made = spark.read.schema("block long, item long, vector array<double>, distance double, length double, pivot int").parquet(f"{path}/vectors")
    told = made.groupBy("pivot", "block").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("least"), F.max("distance").alias("most"), F.max("length").alias("length"))
    told.write.mode("overwrite").parquet(f"{path}/blocks")
    return Index(spark, path, centres)


def bounds(queries: np.ndarray, pivots: np.ndarray, least: np.ndarray, most: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How large the dot product of each query (rows) with a vector of each block (columns; its pivot, distances, length) can be.

    q.v = q.p + q.(v - p) <= q.p + |q| most; and q.v = (q.q + v.v - |q - v|^2) / 2, where |q - v| is at least what |q - p| lacks
    to lie between the distances.  The smaller counts.
    """
    dots, norm = queries @ pivots.T, np.sqrt((queries**2).sum(1))[:, None]
    apart = np.sqrt(np.maximum(0, norm**2 + (pivots**2).sum(1) - 2 * dots))
    gap = np.maximum(0, np.maximum(apart - most, least - apart))
    return np.minimum(dots + norm * most, (norm**2 + length**2 - gap**2) / 2)


def nearest(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``query_id, item, score, rank``, as :func:`corpusmill.operators.dense.nearest`; and ``query_id, compared, all``: with how many vectors of how many each query was compared."""
    spark, dim = index.spark, index.pivots.shape[1]
    asked = staged(queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")).filter((F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull())), "asked")
    n = asked.count()
    blocks = index.blocks()
    found, looked = no_rows(spark, "query_id long, item long, score double"), no_rows(spark, "query_id long, block long, n long")
    parts = -(-n // MOST_QUERIES) if len(index.pivots) else 0
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toPandas()
        if not len(rows):
            continue
        ids, matrix = rows["query_id"].to_numpy(np.int64), np.array(rows["vector"].tolist(), dtype=np.float64)
        shared = spark.sparkContext.broadcast((ids, matrix, index.pivots))

        def proposals(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix, pivots = shared.value
            best = pd.DataFrame({"query_id": [], "block": [], "n": [], "bound": []})
            for f in frames:
                bound = bounds(matrix, pivots[f["pivot"]], *(f[c].to_numpy() for c in ("least", "most", "length")))
                top = np.argsort(-bound, axis=1)[:, : FIRST * k]
                new = pd.DataFrame({"query_id": np.repeat(ids, top.shape[1]), "block": f["block"].to_numpy()[top.ravel()], "n": f["n"].to_numpy()[top.ravel()], "bound": np.take_along_axis(bound, top, 1).ravel()})
                best = pd.concat([best, new]).sort_values(["query_id", "bound"], ascending=[True, False]).groupby("query_id").head(FIRST * k)
            yield best.astype({"query_id": "int64", "block": "int64", "n": "int64", "bound": "float64"})

        up = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        first = blocks.mapInPandas(proposals, "query_id long, block long, n long, bound double")
        first = first.withColumn("so_far", F.coalesce(F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("place", F.row_number().over(up))
        first = staged(first.filter((F.col("so_far") < k) | (F.col("place") <= FIRST)).select("query_id", "block", "n"), "first")
        scored = staged(_compared(index, first, shared, k), "scored")
        w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "item")
        reach = {r["query_id"]: r["score"] for r in scored.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == k).collect()}  # a row a query
        least = spark.sparkContext.broadcast(np.array([reach.get(int(i), -np.inf) for i in ids]))

        def needed(frames: Iterator[pd.DataFrame], shared=shared, least=least) -> Iterator[pd.DataFrame]:
            ids, matrix, pivots = shared.value
            for f in frames:
                bound = bounds(matrix, pivots[f["pivot"]], *(f[c].to_numpy() for c in ("least", "most", "length")))
                q, b = np.nonzero(bound >= least.value[:, None] - NEAR)
                yield pd.DataFrame({"query_id": ids[q], "block": f["block"].to_numpy()[b], "n": f["n"].to_numpy()[b]})

        more = blocks.mapInPandas(needed, "query_id long, block long, n long").join(first, ["query_id", "block"], "left_anti").select("query_id", "block", "n")
        more = staged(more, "more")
        found = found.unionByName(scored).unionByName(_compared(index, more, shared, k))
        looked = looked.unionByName(first).unionByName(more)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "item")
    total = blocks.agg(F.sum("n").alias("all"))
    share = looked.groupBy("query_id").agg(F.sum("n").alias("compared")).crossJoin(F.broadcast(total))  # one row
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), share


def _compared(index: Index, pairs: DataFrame, shared, k: int) -> DataFrame:
    """The best ``k`` of each task for ``pairs(query_id, block)``: only the blocks that are named are read."""
    wanted = pairs.groupBy("block").agg(F.collect_list("query_id").alias("who"))
    folders = [r[0] for r in index.blocks().join(wanted, "block", "left_semi").select("pivot").distinct().collect()]  # at most as many as pivots
    rows = index.vectors().filter(F.col("pivot").isin(folders) if folders else F.lit(False)).join(wanted, "block").select("block", "item", "vector", "who")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, _ = shared.value
        at = {int(i): n for n, i in enumerate(ids)}
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.diff(block, prepend=block[:1] - 1)) if len(block) else []
            for s, e in zip(cuts, [*cuts[1:], len(block)], strict=True):
                part = batch.slice(s, e - s)
                x, item = _matrix(part.column("vector"), matrix.shape[1]), part.column("item").to_numpy()
                who = [at[i] for i in part.column("who")[0].as_py()]
                for q, score in zip(who, matrix[who] @ x.T, strict=True):
                    held = best.get(q, (np.empty(0), np.empty(0, np.int64)))
                    score, items = np.concatenate([held[0], score]), np.concatenate([held[1], item])
                    order = np.lexsort((items, -np.round(score, 9)))[:k]
                    best[q] = score[order], items[order]
        for q, (score, item) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), ids[q])), pa.array(item), pa.array(score)], names=["query_id", "item", "score"])

    return rows.mapInArrow(run, "query_id long, item long, score double")
