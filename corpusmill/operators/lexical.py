"""BM25 ranking as joins and aggregations, over one corpus or over many small ones at once.

``items``: [group columns], ``item`` (long, its order breaks ties), ``toks`` (array of strings).
``queries``: ``query_id``, ``toks``.  With group columns every group has its own statistics, and ``pairs``
(query_id, group columns) tells which groups a query is asked of.

One corpus is scanned against blocks of questions; many small ones are joined by term, and the shuffles carry (item,
term, count) rows after map-side aggregation.  An item without a query term scores 0 and still takes part, as
does one with a negative score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import common
from corpusmill.operators.staging import no_rows, staged
from corpusmill.operators.topk import OWNED, ROW, Best

K1, B, EPSILON = 1.5, 0.75, 0.25


def statistics(items: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Group, ``n_items``, ``avgdl``, ``n_terms``, ``mean_idf``: one row a group."""
    sizes = items.groupBy(*group).agg(F.count(F.lit(1)).alias("n_items"), F.avg(F.size("toks")).alias("avgdl"))
    terms = items.select(*group, "item", F.explode(F.array_distinct("toks")).alias("term")).groupBy(*group, "term").agg(F.count(F.lit(1)).alias("df"))
    terms = _with_sizes(terms, sizes, group).withColumn("raw", _raw_idf())
    ideal = terms.groupBy(*group).agg(F.count(F.lit(1)).alias("n_terms"), F.avg("raw").alias("mean_idf"))
    return _with_sizes(ideal, sizes, group)


def _raw_idf() -> Column:
    return F.log(F.col("n_items") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def _with_sizes(rows: DataFrame, sizes: DataFrame, group: Sequence[str]) -> DataFrame:
    return rows.join(sizes, list(group)) if group else rows.join(F.broadcast(sizes))  # without groups: one row


def scores(items: DataFrame, queries: DataFrame, group: Sequence[str] = (), pairs: DataFrame | None = None) -> DataFrame:
    """``query_id``, group, ``item``, ``score`` of the items that have a query term.

    Inverse document frequencies that are negative become a quarter of their mean over all terms; a query
    token counts as often as it occurs.
    """
    group = list(group)
    if pairs is not None and group:
        items = items.join(pairs.select(*group).distinct(), group, "left_semi")
    sizes = items.groupBy(*group).agg(F.count(F.lit(1)).alias("n_items"), F.avg(F.size("toks")).alias("avgdl"))
    tf = items.select(*group, "item", F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy(*group, "item", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = _with_sizes(tf.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("df")), sizes, group).withColumn("raw", _raw_idf())
    mean = df.groupBy(*group).agg(F.avg("raw").alias("mean_raw"))
    wanted = queries.select("query_id", F.explode("toks").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    idf = df.join(wanted.select("term").distinct(), "term", "left_semi")
    idf = _with_sizes(idf, mean, group).withColumn("idf", F.when(F.col("raw") < 0, EPSILON * F.col("mean_raw")).otherwise(F.col("raw")))
    found = tf.join(idf.select(*group, "term", "idf", "avgdl"), [*group, "term"])
    if pairs is not None:
        wanted = wanted.join(pairs, "query_id")
    found = found.join(wanted, [*(group if pairs is not None else []), "term"])
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return found.groupBy("query_id", *group, "item").agg(F.sum(F.col("times") * weight).alias("score"))


def ordered(score: str = "score", item: str = "item") -> list[Column]:
    """Best first; scores that differ by rounding only are ties, which go to the earlier item."""
    return [F.round(score, 9).desc(), F.col(item).asc()]


#: The most weights (pairs of a question and one of its terms) and questions that one scan of the items answers; more take several scans.
MOST_CELLS, MOST_QUERIES = 2_000_000, 4096
#: Tokens that a scan holds at a time, and weights that it adds up at a time (more only where one item alone has more).
MOST_TOKENS, MOST_ADDED = 1 << 20, 1 << 20


def _pieces(batch: pa.RecordBatch, most_rows: int, most_tokens: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most_rows`` items and, if they are more than one, ``most_tokens`` tokens."""
    at, ends = 0, batch.column(1).offsets.to_numpy().astype(np.int64)
    while at < batch.num_rows:
        fit = int(np.searchsorted(ends, ends[at] + most_tokens, side="right")) - 1 - at
        take = min(max(1, fit), most_rows, batch.num_rows - at)
        yield batch.slice(at, take)
        at += take


def _runs(added: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of items that add up at most ``most`` weights, or of one item."""
    at, ends = 0, np.append(0, np.cumsum(added))
    while at < len(added):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, to
        at = to


def _scanner(shared, k: int | None, owned: bool):
    most_tokens, most_added = MOST_TOKENS, MOST_ADDED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, starts, counts, who, weight, query_ids, avgdl = shared.value
        n, names = len(query_ids), pa.array(terms, pa.string())
        best = None if k is None else Best(query_ids, k)
        for batch in batches:
            for part in _pieces(batch, max(16, 1_000_000 // n), most_tokens):
                toks = part.column(1)
                size = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                place = pc.fill_null(pc.index_in(toks.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(size)), size)
                known = place >= 0
                cell, tf = np.unique(row[known] * len(starts) + place[known], return_counts=True)  # one (item, term) each
                row, term = np.divmod(cell, max(1, len(starts)))
                part_score = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / avgdl))
                times = counts[term]
                item = part.column(0).to_numpy(zero_copy_only=False)
                for lo, hi in _runs(np.bincount(row, weights=times, minlength=len(size)).astype(np.int64), most_added):
                    own = slice(*np.searchsorted(row, [lo, hi]))  # an item's weights stay together, so sums don't depend on the cut
                    after = np.cumsum(times[own])
                    posting = np.arange(after[-1] if len(after) else 0) + np.repeat(starts[term[own]] - after + times[own], times[own])
                    cell = who[posting] * (hi - lo) + np.repeat(row[own] - lo, times[own])
                    score = np.bincount(cell, weights=weight[posting] * np.repeat(part_score[own], times[own]), minlength=n * (hi - lo)).astype(np.float64).reshape(n, hi - lo)
                    if best is None:
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, hi - lo)), pa.array(np.tile(item[lo:hi], n)), pa.array(score.ravel())], names=["query_id", "item", "score"])
                    else:
                        best.add(score, item[lo:hi], part.column(2).slice(lo, hi - lo).to_pylist() if owned else None)
        if best is not None:
            yield best.rows(owned)

    return run


@dataclass(frozen=True)
class Stored:
    """Items that several scans read, and what BM25 asks of all of them: written and counted once."""

    items: DataFrame
    n_items: int
    avgdl: float
    terms: DataFrame
    mean_raw: float | None


def stored(items: DataFrame) -> Stored:
    """``items(item, toks, [ref])`` for several calls of :func:`rank` or :func:`rank_owners`."""
    items = staged(items.select(F.col("item").cast("long"), "toks", *(["ref"] if "ref" in items.columns else [])), "tokens")
    n = items.agg(F.count(F.lit(1)).alias("n_items"), F.avg(F.size("toks")).alias("avgdl")).first()
    df = items.select("item", F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = staged(df.select("term", (F.log(F.lit(n["n_items"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")), "idf")
    return Stored(items, n["n_items"], n["avgdl"] or 1.0, terms, terms.agg(F.avg("raw")).first()[0])


def _scanned(items: DataFrame | Stored, asked: DataFrame, k: int | None, owned: bool = False) -> DataFrame:
    """``query_id, item, score`` [and ``ref``]: the best ``k`` of each partition (all items if None), by a scan for each block of questions.

    What a block sends is bounded by ``MOST_CELLS`` and ``MOST_QUERIES``: its terms' weights, as a broadcast variable.
    """
    spark = asked.sparkSession
    empty = no_rows(spark, OWNED if owned else ROW)
    wanted = staged(asked.select("query_id", F.explode("toks").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")), "wanted")
    size = wanted.agg(F.count_distinct("query_id").alias("q"), F.count(F.lit(1)).alias("cells")).first()
    if not size["q"]:
        return empty
    n = items if isinstance(items, Stored) else stored(items)
    if not n.n_items:
        return empty
    items, mean = n.items.select("item", "toks", *(["ref"] if owned else [])), n.mean_raw
    weights = wanted.join(n.terms, "term").select("query_id", "term", (F.col("times") * F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw"))).alias("w"))
    blocks = min(size["q"], max(-(-size["cells"] // max(1, MOST_CELLS)), -(-size["q"] // MOST_QUERIES)))
    ids = wanted.select("query_id").distinct()
    out = empty
    for block in range(blocks):
        inside = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block
        query_ids = np.array(sorted(r[0] for r in ids.filter(inside).collect()), dtype=np.int64)
        if not len(query_ids):
            continue
        rows = weights.filter(inside).toPandas().sort_values(["term", "query_id"])
        terms, counts = np.unique(rows["term"].to_numpy(dtype=object), return_counts=True) if len(rows) else (np.empty(0, object), np.empty(0, np.int64))
        starts = np.cumsum(counts) - counts
        who = np.searchsorted(query_ids, rows["query_id"].to_numpy(np.int64))
        shared = spark.sparkContext.broadcast((terms.tolist(), starts, counts, who, rows["w"].to_numpy(np.float64), query_ids, n.avgdl))
        out = out.unionByName(items.mapInArrow(_scanner(shared, k, owned), OWNED if owned else ROW))
    return out


def rank(items: DataFrame | Stored, queries: DataFrame, k: int | None, group: Sequence[str] = (), pairs: DataFrame | None = None) -> DataFrame:
    """The best ``k`` items (all if None) of each query, or of each query and group: adds ``rank`` from 1.

    Queries without tokens have no rows.  Without groups the items are scanned once for each block of queries: with
    ``k`` no row a query and item is made, and a partition returns its best.  With groups, postings are joined, and
    every item of a paired group is ranked.
    """
    group = list(group)
    asked = queries.filter(F.size("toks") > 0)
    if group:
        items = items.items if isinstance(items, Stored) else items
        pairs = staged(pairs.select("query_id", *group), "pairs")  # its size is known, so few pairs don't make all items move
        items = staged(items.join(pairs.select(*group).distinct(), group, "left_semi").select(*group, "item", "toks"), "tokens")
        found = scores(items, asked, group, pairs)
        every = pairs.join(asked.select("query_id"), "query_id").join(items.select(*group, "item"), group).select("query_id", *group, "item")
        found = every.join(found, ["query_id", *group, "item"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    else:
        found = _scanned(items, asked, k)
    w = Window.partitionBy("query_id", *group).orderBy(*ordered())
    out = found.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)


def rank_owners(items: DataFrame | Stored, queries: DataFrame, k: int) -> DataFrame:
    """The best part of each owner, then the best ``k`` owners of each query: ``query_id, ref, item, score, rank``.

    ``items(item, ref, toks)``.  Each partition returns its best ``k`` owners.
    """
    found = staged(_scanned(items, queries.filter(F.size("toks") > 0), k, owned=True), "owners")
    return rollup(found.drop("ref"), found.select("item", "ref").distinct(), k)


def rollup(ranked: DataFrame, owner: DataFrame, k: int) -> DataFrame:
    """From a full ranking of parts to their owners: the first part of each owner, then the best ``k``.

    ``owner``: ``item``, ``ref``.  Returns ``query_id, ref, item, score, rank``.
    """
    w = Window.partitionBy("query_id", "ref").orderBy(*ordered())
    best = ranked.drop("rank").join(owner, "item").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*ordered()))).filter(F.col("rank") <= k)


def overlap_rerank(ranked: DataFrame, texts: DataFrame, queries: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Reorders by the number of distinct common tokens, then score, then rank; adds ``overlap``, replaces ``rank``."""
    rows = ranked.join(texts.select("item", F.col("toks").alias("_t")), "item").join(queries.select("query_id", F.col("toks").alias("_q")), "query_id")
    rows = rows.withColumn("overlap", common(F.col("_t"), F.col("_q"))).drop("_t", "_q")
    w = Window.partitionBy(*by).orderBy(F.desc("overlap"), F.round("score", 9).desc(), "rank")
    return rows.withColumn("rank", F.row_number().over(w))


def sections(parts: DataFrame) -> DataFrame:
    """Sections to rank: ``parts(ref, section_key, path, item, text)`` to ``ref, section_key, text``, the parts' texts in order."""
    ordered_parts = F.array_sort(F.collect_list(F.struct("item", "text")))
    grouped = parts.groupBy("ref", "section_key").agg(F.min_by("path", "item").alias("path"), ordered_parts.alias("p"))
    pieces = F.concat(F.array(F.array_join("path", " > ")), F.transform("p", lambda x: x["text"]))
    return grouped.select("ref", "section_key", F.array_join(F.filter(pieces, lambda x: F.trim(x) != ""), "\n").alias("text"))


def section_key(section_id: Column, path: Column, item: Column) -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(section_id, blank), F.nullif(F.array_join(path, "::"), blank), item.cast("string"))
