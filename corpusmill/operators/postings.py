"""A stored inverted index: postings in buckets by the hash of their term, cut into blocks.

``build`` numbers the items of a task in stretches (shards) of bounded items and tokens, turns each shard's tokens into postings and writes them, a
folder a bucket, sorted by term.  A posting is an item's place in its shard and how often it holds the term; each shard's items, with their
owners and sizes, are one row of a bucket of their own.  ``rank`` reads only this bucket and those of the terms that are asked for, and of these only the
terms' blocks; they meet by shard, where a question's score is a sum over its own postings, so the work grows with postings and not with
questions times items.  A task keeps each question's best ``k``; a shard whose bounds stay below a question's ``k``-th score is
skipped for it.  Scores, ties and the items without a term (they score 0, before negative scores) are those of ``lexical``; items
that score 0 only take part for questions that have fewer than ``k`` better ones.

``stored`` keeps an index under the fingerprint of its rows, for later jobs and sessions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.index import fingerprint
from corpusmill.operators.lexical import EPSILON, K1, MOST_CELLS, MOST_QUERIES, B, ordered
from corpusmill.operators.staging import no_rows, shared_dir, staged

#: Tokens of a shard that isn't a single item: what a task that builds or searches it holds.
SHARD_TOKENS = 1 << 20
#: Items of a shard at most; postings of a block; postings of a bucket, about; buckets at most.
SHARD, BLOCK, BUCKET, MOST_BUCKETS = 1 << 14, 512, 4_000_000, 4096
#: Scores this close count as equal where a shard is skipped (they are compared at nine digits).
NEAR = 2e-9

POSTINGS = "shard long, term string, items array<int>, times array<int>, ids array<long>, owners array<long>"
NAMES = ["shard", "term", "items", "times", "ids", "owners"]
#: Of what is stored: indexes of another form aren't opened.
FORM = 2
ITEMS = -1  # the bucket of the items themselves


@dataclass
class Index:
    """An index in ``path``; ``owned`` if its items have owners."""

    spark: SparkSession
    path: str
    n_items: int
    avgdl: float
    mean_raw: float
    buckets: int
    owned: bool

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def read(self, terms: DataFrame, wanted: list[int] | None = None) -> DataFrame:
        """Blocks of ``terms(term)``: only their buckets (``wanted``, if they are known) are listed and read."""
        if wanted is None:
            wanted = [r[0] for r in terms.select(self.bucket(F.col("term"))).distinct().collect()]  # at most MOST_BUCKETS
        rows = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("bucket").isin(wanted) if wanted else F.lit(False))
        return rows.join(terms.select("term").distinct(), "term", "left_semi")

    def items(self) -> DataFrame:
        """``shard, items, owners, sizes``: one row a shard."""
        return self.shards().select("shard", F.col("ids").alias("items"), "owners", F.col("times").alias("sizes"))

    def shards(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings").filter(F.col("bucket") == ITEMS)

    def terms(self) -> DataFrame:
        """``term, df, raw`` (inverse document frequency before negative ones are lifted)."""
        return self.spark.read.parquet(f"{self.path}/terms")


def _builder(owned: bool):
    most_items, most_tokens = SHARD, SHARD_TOKENS

    def shard(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        toks = table.column("toks").chunk(0)
        item = table.column("item").to_numpy()
        owner = table.column("owner").to_numpy() if owned else item
        sizes = np.diff(toks.offsets.to_numpy())
        coded = toks.flatten().dictionary_encode()
        names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        place = np.repeat(np.arange(len(item)), sizes)
        cell, tf = np.unique(code * max(1, len(item)) + place, return_counts=True)  # by term, then place
        code, place = np.divmod(cell, max(1, len(item)))
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        counts = np.diff(np.append(starts, len(code)))
        blocks = -(-counts // BLOCK)
        first = np.repeat(starts - BLOCK * (np.cumsum(blocks) - blocks), blocks) + BLOCK * np.arange(blocks.sum())
        ends = pa.array(np.append(first, len(code)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (place, tf)]
        none = pa.nulls(len(first), pa.list_(pa.int64()))
        columns = [pa.array(np.full(len(first), number, dtype=np.int64)), names.take(pa.array(code[first])), *lists, none, none]
        for at in range(0, len(first), 2000):
            yield pa.RecordBatch.from_arrays([c.slice(at, 2000) for c in columns], names=NAMES)
        own = [pa.array([x], pa.list_(t)) for x, t in ((sizes.astype(np.int32), pa.int32()), (item, pa.int64()), (owner, pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([None], pa.string()), pa.nulls(1, pa.list_(pa.int32())), *own], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n, total = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            at, ends = 0, batch.column("toks").offsets.to_numpy().astype(np.int64)
            while at < batch.num_rows:
                fit = int(np.searchsorted(ends, ends[at] + most_tokens - total, side="right")) - 1 - at  # items whose tokens still fit
                take = min(most_items - n, max(fit, 0 if held else 1), batch.num_rows - at)
                if take:
                    held.append(batch.slice(at, take))
                    total += int(ends[at + take] - ends[at])
                    at, n = at + take, n + take
                if n == most_items or at < batch.num_rows:
                    yield from shard(number, held)
                    number, held, n, total = number + 1, [], 0, 0
            if held and held[-1].num_rows < batch.num_rows:  # a copy: a slice would hold its whole batch beside the next
                held[-1] = held[-1].take(pa.array(np.arange(held[-1].num_rows)))
        if held:
            yield from shard(number, held)

    return run


def _tasks(spark: SparkSession) -> int:
    """Tasks to deal work to that Spark would take for small by its bytes alone."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def build(items: DataFrame, path: str) -> Index:
    """Writes the index of ``items(item, toks, [owner])`` (longs, arrays of strings) to ``path``; null arrays hold no tokens.

    Items are distinct.  The statistics come last, so a folder without them is no index.
    """
    spark = items.sparkSession
    owned = "owner" in items.columns
    items = items.select(F.col("item").cast("long"), F.coalesce("toks", F.expr("cast(array() as array<string>)")).alias("toks"), *([F.col("owner").cast("long")] if owned else []))
    rows = staged(items.mapInArrow(_builder(owned), POSTINGS), "postings")
    tokens = F.sum(F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x))
    n = rows.filter("term is null").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), tokens.alias("total")).first()
    avgdl = n["total"] / n["n"] if n["n"] else 0.0
    buckets = int(min(MOST_BUCKETS, max(16, -(-(n["total"] or 0) // BUCKET))))
    rows = rows.withColumn("bucket", F.when(F.col("term").isNull(), ITEMS).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")))
    # a common term has a block for every BLOCK items that hold it, so where buckets can't be small their rows are dealt on by shard
    slices = max(1, -(-(n["total"] or 0) // (buckets * BUCKET)))
    tasks = max(_tasks(spark), -(-(n["total"] or 0) // BUCKET))
    dealt = rows.repartition(tasks, "bucket", F.pmod(F.xxhash64("shard"), F.lit(slices))).sortWithinPartitions("bucket", "term", "shard")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    df = spark.read.parquet(f"{path}/postings").filter(F.col("bucket") != ITEMS).groupBy("term").agg(F.sum(F.size("items")).alias("df"))
    df.select("term", "df", (F.log(F.lit(n["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")).write.mode("overwrite").parquet(f"{path}/terms")
    mean = spark.read.parquet(f"{path}/terms").agg(F.avg("raw")).first()[0] or 0.0
    meta = {"n_items": n["n"], "avgdl": avgdl, "mean_raw": mean, "buckets": buckets, "owned": owned}
    spark.range(1, numPartitions=1).select(F.lit(json.dumps(meta)).alias("meta")).write.mode("overwrite").parquet(f"{path}/meta")
    return Index(spark, path, **meta)


def opened(spark: SparkSession, path: str) -> Index | None:
    """The index in ``path``; None if there is none, or one that wasn't finished."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        return None
    return Index(spark, path, **json.loads(spark.read.parquet(f"{path}/meta").first()["meta"]))


def stored(rows: DataFrame, tokens: Column, version: str, item: str = "item", text: str = "text", owner: str | None = None, folder: str | None = None, source: DataFrame | None = None) -> Index:
    """The index of ``rows`` under their fingerprint in ``folder`` (else in the shared folder): opened if it is there, else built.

    ``version`` stands for what ``tokens`` does to ``text``, and must change with it.  Where rows are made from others at some cost,
    these may be the ``source`` to take the fingerprint of; ``version`` then stands for how rows are made from them, too.
    """
    spark = rows.sparkSession
    columns = [item, text, *([owner] if owner else [])] if source is None else source.columns
    path = f"{(folder or shared_dir(spark) + '/indexes').rstrip('/')}/{FORM}-{version}-{fingerprint(rows if source is None else source, columns)}"
    found = opened(spark, path)
    if found:
        return found
    return build(rows.select(F.col(item).alias("item"), tokens.alias("toks"), *([F.col(owner).alias("owner")] if owner else [])), path)


class _Best:
    """A question's best ``k`` of a task: scores, items and owners, best first, an owner once."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.item, self.owner = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> float:
        """What a score must reach to matter."""
        return self.score[-1] - NEAR if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, item: np.ndarray, owner: np.ndarray) -> None:
        score, item, owner = np.concatenate([self.score, score]), np.concatenate([self.item, item]), np.concatenate([self.owner, owner])
        order = np.lexsort((item, -np.round(score, 9)))
        _, first = np.unique(owner[order], return_index=True)
        order = order[np.sort(first)[: self.k]]
        self.score, self.item, self.owner = score[order], item[order], owner[order]


def _searcher(shared, k: int, fill: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of, questions, avgdl = shared.value  # term -> number; (query_id, term numbers, weights)
        best = [_Best(k) for _ in questions]

        def search(rows: list[dict]) -> None:
            """All questions against the blocks of one shard."""
            own = next(r for r in rows if r["term"] is None)
            all_items, all_owners, sizes = own["ids"], own["owners"], own["times"]
            rows = sorted((r for r in rows if r["term"] is not None), key=lambda r: place_of[r["term"]])
            if not rows and not fill:
                return
            number = np.array([place_of[r["term"]] for r in rows], dtype=np.int64)
            size = [len(r["items"]) for r in rows]
            place, tf = (np.concatenate([r[c] for r in rows]) if rows else np.empty(0, np.int64) for c in ("items", "times"))
            parts = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[place] / (avgdl or 1.0)))
            ends = np.cumsum(size, dtype=np.int64)
            terms, first = np.unique(number, return_index=True)
            last = np.append(first[1:], len(number)) - 1
            start, end = (ends[first] - np.array(size, dtype=np.int64)[first], ends[last]) if len(terms) else (first, first)
            bound = np.maximum.reduceat(parts, start) if len(terms) else np.empty(0)
            for b, (_, wanted, weight) in zip(best, questions, strict=True):
                at = np.searchsorted(terms, wanted)
                inside = at < len(terms)
                inside[inside] = terms[at[inside]] == wanted[inside]
                at, w = at[inside], weight[inside]
                if not fill and (not len(at) or np.maximum(w * bound[at], 0).sum() < b.least()):
                    continue
                spans = [(s, e) for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]
                where = np.concatenate([place[s:e] for s, e in spans]) if spans else np.empty(0, np.int64)
                value = np.concatenate([parts[s:e] * x for (s, e), x in zip(spans, w.tolist(), strict=True)]) if spans else np.empty(0)
                score = np.bincount(where, value, minlength=len(all_items))
                if fill:
                    b.add(score, all_items, all_owners)
                    continue
                keep = np.round(score, 9) > 0
                keep &= score >= b.least()
                if keep.any():
                    b.add(score[keep], all_items[keep], all_owners[keep])

        shard, held = None, []
        for batch in batches:
            names = ("items", "times", "ids", "owners")
            flat = {c: batch.column(c).flatten().to_numpy() for c in names}
            offsets = {c: batch.column(c).offsets.to_numpy() - batch.column(c).offsets[0].as_py() for c in names}
            for i, (s, term) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("term").to_pylist(), strict=True)):
                if s != shard and held:
                    search(held)
                    held = []
                shard = s
                held.append({"term": term} | {c: flat[c][offsets[c][i] : offsets[c][i + 1]] for c in names})
        if held:
            search(held)
        for b, (query_id, _, _) in zip(best, questions, strict=True):
            if len(b.item):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.item), query_id, dtype=np.int64)), pa.array(b.item), pa.array(b.owner), pa.array(b.score)], names=["query_id", "item", "owner", "score"])

    return run


FOUND = "query_id long, item long, owner long, score double"


def _best(index: Index, wanted: DataFrame, k: int, fill: bool) -> DataFrame:
    """The best ``k`` of each question, from tasks' bests; ``wanted(query_id, term, w, bucket)`` in bounded blocks of questions."""
    spark = index.spark
    size = wanted.agg(F.count_distinct("query_id").alias("q"), F.count(F.lit(1)).alias("cells")).first()
    blocks = max(1, min(size["q"], max(-(-size["cells"] // MOST_CELLS), -(-size["q"] // MOST_QUERIES))))
    out = no_rows(spark, FOUND)
    for block in range(blocks):
        part = wanted.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = part.toPandas()  # at most about MOST_CELLS
        if not len(rows):
            continue
        place = {t: i for i, t in enumerate(sorted(rows["term"].dropna().unique().tolist()))}
        questions = []
        for query_id, own in rows.groupby("query_id"):
            own = own[own["term"].notna()]
            questions.append((int(query_id), own["term"].map(place).to_numpy(np.int64), own["w"].to_numpy(np.float64)))
        blocks_read = index.read(part.filter("term is not null").select("term"), sorted({int(x) for x in rows["bucket"].dropna().unique()}))
        shared = spark.sparkContext.broadcast((place, questions, index.avgdl))
        by_shard = blocks_read.unionByName(index.shards()).select(*NAMES).repartition(_tasks(spark), "shard").sortWithinPartitions("shard")
        out = out.unionByName(by_shard.mapInArrow(_searcher(shared, k, fill), FOUND))
    return out


def rank(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The best ``k`` items of each of ``queries(query_id, toks)``, of an index with owners the best item of the best ``k`` owners.

    Returns ``query_id, item, owner, score, rank``; queries without tokens have no rows.
    """
    asked = queries.filter(F.size("toks") > 0)
    times = asked.select("query_id", F.explode("toks").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    idf = F.when(F.col("raw") < 0, EPSILON * index.mean_raw).otherwise(F.col("raw"))
    wanted = staged(times.join(index.terms(), "term", "left").select("query_id", F.when(F.col("raw").isNotNull(), F.col("term")).alias("term"), (F.col("times") * idf).alias("w"), F.when(F.col("raw").isNotNull(), index.bucket(F.col("term"))).alias("bucket")), "wanted")
    by_owner = Window.partitionBy("query_id", "owner").orderBy(*ordered())
    by_query = Window.partitionBy("query_id").orderBy(*ordered())

    def ranked(found: DataFrame) -> DataFrame:
        if index.owned:
            found = found.withColumn("_o", F.row_number().over(by_owner)).filter("_o = 1").drop("_o")
        return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)

    found = staged(ranked(_best(index, wanted.filter("term is not null"), k, False)), "ranked")
    full = found.groupBy("query_id").count().filter(F.col("count") >= k)
    short = staged(wanted.join(full, "query_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    filled = ranked(_best(index, short, k, True))
    return found.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(filled)
