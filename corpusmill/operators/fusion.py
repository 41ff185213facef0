"""Rank fusion over ``rankings(query_id, source, src_ord, ref, score, rank)``.

A source may name a reference more than once: its contributions add up, and its worst rank is the one that is
reported.  References with equal scores come in the order in which the sources first name them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-9
#: What a source weighs in the default fusion, and the order of the sources.
WEIGHTS = {"base": 0.5, "sections_leads": 0.5, "sections_leads_stem": 0.5, "dense": 2.0, "chunk_dense": 2.0, "exact_reference": 5.0, "prefix_overlap": 2.0}
SOURCES = list(WEIGHTS)


def profiles(rankings: DataFrame, top_n: int = 5) -> DataFrame:
    """``query_id, source, ref, rank, probability, strength, confidence``: a row for each of a source's first ``top_n``.

    Probabilities are the softmax of z-scores.  A lone document has strength and confidence 1; else confidence is a
    quarter of the top probability's lead over uniform and three quarters of the relative gap to the runner-up.
    """
    by = Window.partitionBy("query_id", "source")
    in_order = by.orderBy("rank", "ref")
    rows = rankings.withColumn("_i", F.row_number().over(in_order)).filter(F.col("_i") <= top_n)
    spread = F.stddev_pop("score").over(by)
    z = F.when(spread <= TINY, F.lit(0.0)).otherwise((F.col("score") - F.avg("score").over(by)) / spread)
    rows = rows.withColumn("_z", z).withColumn("_n", F.count(F.lit(1)).over(by))
    rows = rows.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(by)))
    rows = rows.withColumn("probability", F.col("_e") / F.sum("_e").over(by))
    uniform = 1 / F.col("_n")
    first = lambda c, i: F.max(F.when(F.col("_i") == i, F.col(c))).over(by)
    rows = rows.withColumn("_p", first("probability", 1)).withColumn("_s1", first("score", 1)).withColumn("_s2", first("score", 2))
    lead = F.greatest(F.lit(0.0), (F.col("_p") - uniform) / F.greatest(F.lit(TINY), 1 - uniform))
    gap = F.greatest(F.lit(0.0), (F.col("_s1") - F.col("_s2")) / F.greatest(F.lit(TINY), F.abs("_s1")))
    alone = F.col("_n") == 1
    strength = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("probability") - uniform) / F.greatest(F.lit(TINY), F.col("_p") - uniform)))
    return rows.select(
        "query_id", "source", "ref", "rank", "probability",
        F.when(alone, 1.0).otherwise(strength).alias("strength"),
        F.when(alone, 1.0).otherwise(F.least(F.lit(1.0), 0.25 * lead + 0.75 * gap)).alias("confidence"),
    )


def _weight(weights: dict[str, float] | None) -> Column:
    out = F.lit(1.0)
    for source, w in (weights or {}).items():
        out = F.when(F.col("source") == source, F.lit(float(w))).otherwise(out)
    return out


def _fused(rows: DataFrame, top_k: int) -> DataFrame:
    """Sums ``part`` by reference; a source's rank is its worst, and the first mention breaks ties."""
    by_source = rows.groupBy("query_id", "ref", "source").agg(F.sum("part").alias("part"), F.max("rank").alias("rank"), F.min(F.struct("src_ord", "rank")).alias("first"))
    named = F.array_sort(F.collect_list(F.struct("source", "rank")))
    out = by_source.groupBy("query_id", "ref").agg(F.sum("part").alias("score"), named.alias("named"), F.min("first").alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "first")
    out = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    listed = lambda f: F.array_join(F.transform("named", f), ",")
    return out.select("query_id", "rank", "ref", "score", listed(lambda x: x["source"]).alias("sources"), listed(lambda x: F.concat(x["source"], F.lit(":"), x["rank"])).alias("ranks"))


def reciprocal_rank(rankings: DataFrame, top_k: int = 5, constant: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """``query_id, rank, ref, score, sources, ranks`` (``source:rank``, comma separated): sums of weight / (constant + rank)."""
    return _fused(rankings.withColumn("part", _weight(weights) / (constant + F.col("rank"))), top_k)


def confidence_weighted(rankings: DataFrame, top_k: int = 5, constant: int = 60, weights: dict[str, float] | None = None, top_n: int = 5, alpha: float = 1.0, beta: float = 0.5) -> DataFrame:
    """:func:`reciprocal_rank` with each part raised by its source's confidence and the document's strength there."""
    found = profiles(rankings, top_n)
    strength = found.groupBy("query_id", "source", "ref").agg(F.min("strength").alias("strength"))
    confidence = found.groupBy("query_id", "source").agg(F.max("confidence").alias("confidence"))
    rows = rankings.join(strength, ["query_id", "source", "ref"], "left").join(confidence, ["query_id", "source"], "left")
    raised = (1 + alpha * F.coalesce("confidence", F.lit(0.0))) * (1 + beta * F.coalesce("strength", F.lit(0.0)))
    return _fused(rows.withColumn("part", _weight(weights) * raised / (constant + F.col("rank"))), top_k)


def anchored(rankings: DataFrame, anchor: str = "dense", free: tuple[str, ...] = ("dense", "chunk_dense"), extra: DataFrame | None = None) -> DataFrame:
    """Other sources keep only what the anchor source names (or ``extra(query_id, ref)``); ranks stay as they were.

    A query for which the anchor names nothing keeps all.
    """
    refs = rankings.filter((F.col("source") == anchor) & (F.col("rank") <= 20)).select("query_id", "ref").distinct()
    has = refs.select("query_id").distinct().withColumn("_has", F.lit(True))
    if extra is not None:
        refs = refs.unionByName(extra.select("query_id", "ref")).distinct()
    rows = rankings.join(has, "query_id", "left").join(refs.withColumn("_in", F.lit(True)), ["query_id", "ref"], "left")
    return rows.filter(F.col("source").isin(*free) | F.col("_has").isNull() | F.col("_in").isNotNull()).drop("_has", "_in")


def prepended(primary: DataFrame, rest: DataFrame) -> DataFrame:
    """``primary`` (query_id, ref, score, rank) before ``rest``; each reference once; ranked anew."""
    both = primary.select("query_id", "ref", "score", "rank", F.lit(0).alias("_p")).unionByName(rest.select("query_id", "ref", "score", "rank", F.lit(1).alias("_p")))
    once = Window.partitionBy("query_id", "ref").orderBy("_p", "rank")
    first = both.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_p", "rank"))).drop("_p", "_n")
