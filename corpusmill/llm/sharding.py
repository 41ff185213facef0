"""Two-pass external shuffle into shards.

Pass one scatters the rows uniformly into buckets that fit a task's memory, by a seeded hash (Spark's shuffle
files are the external store).  Pass two reads one bucket a task, puts its rows into the order of their hashes,
so that the order in which they arrived doesn't matter, permutes them by Fisher-Yates with a generator
seeded by (seed, bucket), and writes them to the shared folder.  The buckets one after another are a uniform
permutation of the table; shards are equal runs of it (law ``rows``: counts differ by one at most).

A shuffle has a file segment for every task on either side, so one to hundreds of thousands of buckets would drown
in them.  Beyond ``most_buckets`` the rows are first scattered to groups of buckets, a folder each; then some groups at
a time, with ``most_buckets`` buckets together, go on to their buckets.  What is in a bucket, and so the result, is the same.

The hash covers the row's id and its place in the input, so a hot id or a hot text spreads over all buckets.
The input must be read again the same way if a task is lost: a table in files, or a checkpoint.  Buckets' counts are
broadcast if they are at most ``FEW`` (12 TB), else joined in a shuffle by bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import free_name, fresh_path, written

BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 4096
#: The most buckets whose counts are broadcast.
FEW = 200_000


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of range(n): from the end, each place swaps with a random place up to itself."""
    order = list(range(n))
    picks = rng.integers(0, np.arange(n, 0, -1)).tolist() if n else []
    for i, j in zip(range(n - 1, -1, -1), picks, strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _permuter(bucket: str, mark: str, pos: str, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        number, key = table.column(bucket).to_numpy(), table.column(mark).to_numpy()
        order = np.lexsort((key, number))
        table = table.drop_columns([mark])
        starts = np.flatnonzero(np.diff(number[order], prepend=-1))
        for s, e in zip(starts, [*starts[1:], len(order)], strict=True):
            rng = np.random.Generator(np.random.PCG64([seed, int(number[order[s]])]))
            rows = order[s:e][fisher_yates(e - s, rng)]
            for at in range(0, len(rows), 2000):
                part = rows[at : at + 2000]
                out = table.take(pa.array(part)).combine_chunks()
                yield from out.append_column(pos, pa.array(np.arange(at, at + len(part), dtype=np.int64))).to_batches()

    return run


def external_shuffle(df: DataFrame, size: Column, id_col: str, *, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, most_buckets: int = MOST_BUCKETS, path: str | None = None) -> tuple[DataFrame, str, str]:
    """Writes the rows of ``df`` in random order; returns the written table and its columns (bucket, position).

    ``size``: a row's bytes, which decide the number of buckets (nulls count as 0); a task holds a bucket of about
    ``bucket_bytes`` twice.  ``most_buckets``: of one shuffle.  Files are in ``path``, else in a fresh folder of the shared
    one; each holds whole buckets in order.  All columns are kept; the two new ones take free names.  An empty table gives
    an empty table.
    """
    spark = df.sparkSession
    total = df.agg(F.sum(F.coalesce(size, F.lit(0)) + 64)).first()[0] or 0
    buckets = int(max(1, -(-total // bucket_bytes)))
    bucket, mark, pos, group = (free_name(df, n) for n in ("bucket", "mark", "pos", "bucket_group"))
    marked = df.withColumn(mark, F.xxhash64(F.lit(seed), F.col(id_col), F.monotonically_increasing_id()))
    marked = marked.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), F.col(mark)), F.lit(buckets)).cast("int"))
    schema = T.StructType([f for f in marked.schema if f.name != mark] + [T.StructField(pos, T.LongType())])
    path = path or fresh_path(spark, "shuffled")

    def permute(rows: DataFrame, first: int, n: int) -> None:
        """Writes the rows of the ``n`` buckets from ``first``."""
        scattered = rows.repartitionById(n, F.col(bucket) - first)
        scattered.mapInArrow(_permuter(bucket, mark, pos, seed), schema).write.mode("append").parquet(path)

    if buckets <= most_buckets:
        permute(marked, 0, buckets)
    else:
        each = -(-buckets // most_buckets)  # buckets of a group
        groups = -(-buckets // each)
        held = fresh_path(spark, "scattered")
        dealt = marked.withColumn(group, F.floor(F.col(bucket) / each).cast("int"))
        dealt.repartitionById(groups, F.col(group)).write.partitionBy(group).parquet(held)
        dealt = spark.read.schema(dealt.schema).parquet(held)
        together = max(1, most_buckets // each)
        for g in range(0, groups, together):
            end = min(buckets, (g + together) * each)
            permute(dealt.filter(F.col(group).between(g, g + together - 1)).drop(group), g * each, end - g * each)
    return spark.read.schema(schema).parquet(path), bucket, pos


def _offsets(counts: DataFrame, number: str, count: str, wide: int = 4096) -> DataFrame:
    """``counts`` with ``before`` (the counts of all smaller numbers) and ``all``; sums go up in runs of ``wide`` numbers, so no task holds them all."""
    run = F.floor(F.col(number) / wide)
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = counts.groupBy(run.alias("run")).agg(F.sum(count).alias("n"))  # a run of 4096 buckets is one row
    runs = runs.select("run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.sum("n").over(every).alias("all"))
    inside = Window.partitionBy("run").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("run", run).withColumn("inside", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return rows.join(runs, "run").select(number, (F.col("base") + F.col("inside")).alias("before"), "all")


def shard(df: DataFrame, n_shards: int, size: Column, id_col: str, **options) -> DataFrame:
    """``df`` after :func:`external_shuffle`, with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each).

    Shard s has floor(N / n) rows, the first N mod n one more.  Null ids and texts and repeated rows are rows
    like others.  Columns named ``shard`` or ``slot`` in ``df`` are replaced.
    """
    table, bucket, pos = external_shuffle(df.drop("shard", "slot"), size, id_col, **options)
    number, before, every = (free_name(table, n) for n in ("bucket_number", "before", "every"))
    counts = written(table.groupBy(F.col(bucket).alias("number")).agg(F.count(F.lit(1)).alias("n")), "counts")  # one row a bucket
    offsets = _offsets(counts, "number", "n").toDF(number, before, every)
    rows = table.join(F.broadcast(offsets) if counts.count() <= FEW else offsets, F.col(bucket) == F.col(number))
    at, few = F.col(before) + F.col(pos), F.floor(F.col(every) / n_shards)
    more = F.col(every) - few * n_shards
    edge = more * (few + 1)
    first = at < edge
    which = F.when(first, F.floor(at / (few + 1))).otherwise(more + F.floor((at - edge) / F.greatest(few, F.lit(1))))
    rows = rows.withColumn("shard", which.cast("int"))
    start = F.when(first, F.col("shard") * (few + 1)).otherwise(edge + (F.col("shard") - more) * few)
    return rows.withColumn("slot", (at - start).cast("long")).drop(number, before, every, bucket, pos)
