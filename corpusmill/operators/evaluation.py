"""Retrieval metrics, answer scores, verdicts, summaries and consistency checks as joins and aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t

KS = (1, 3, 5, 8)
#: Phrases of answers that abstain, and words that say nothing about an answer point.
ABSTENTION = ["aucune reponse ne peut etre donnee", "impossible de repondre", "impossible de determiner", "ne permettent pas de repondre", "ne permet pas de repondre", "ne contiennent aucune disposition", "faute de source", "preuve insuffisante"]
POINT_STOPWORDS = (
    "afin ainsi alors apres apprecier avec avant cette confondre dans dont elle elles entre etre eventuel eventuels effet effets examiner faut indique indiquee "
    "leur leurs maniere mais meme permettre position pour quand quelle quelles sans selon situation sont sous suffisamment tous toute toutes verifier"
).split()


def relevance(retrieved: DataFrame, golds: DataFrame) -> DataFrame:
    """``retrieved(query_id, rank, id)`` with ``rel`` 1 or 0 by ``golds(query_id, id)``."""
    marked = golds.select("query_id", "id").distinct().withColumn("_g", F.lit(1))
    return retrieved.join(marked, ["query_id", "id"], "left").withColumn("rel", F.coalesce("_g", F.lit(0))).drop("_g")


def _gain(position: Column) -> Column:
    return 1 / F.log2(position + 1)


def per_query(queries: DataFrame, retrieved: DataFrame, golds: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """``query_id, first_rank`` and, for each k, ``hit_k`` and ``ndcg_k``; queries without gold or results score 0.

    The ideal order is that of the retrieved list alone, so one gold found first is 1 however many there are.
    """
    rows = relevance(retrieved.filter(F.col("rank") <= max(ks)), golds)
    aggs = [F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rank")]
    for k in ks:
        inside = (F.col("rank") <= k) & (F.col("rel") == 1)
        aggs += [F.sum(F.when(inside, _gain(F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}"), F.count_if(inside).cast("int").alias(f"n_{k}")]
    found = queries.select("query_id").join(rows.groupBy("query_id").agg(*aggs), "query_id", "left")
    out = ["query_id", "first_rank"]
    for k in ks:
        n = F.coalesce(f"n_{k}", F.lit(0))
        ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _gain(i.cast("double"))), F.lit(0.0), lambda a, x: a + x)
        out += [(n > 0).cast("int").alias(f"hit_{k}"), F.when(n > 0, F.col(f"dcg_{k}") / ideal).otherwise(0.0).alias(f"ndcg_{k}")]
    return found.select(*out)


def metrics(queries: DataFrame, retrieved: DataFrame, golds: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """``metric, k, value``: means over all queries, those without gold included; ``mrr`` has k 0."""
    rows = per_query(queries, retrieved, golds, ks)
    one = rows.agg(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr_0"), *[F.avg(f"{m}_{k}").alias(f"{m}_{k}") for m in ("hit", "ndcg") for k in ks])
    cells = [F.struct(F.lit(c.split("_")[0]).alias("metric"), F.lit(int(c.split("_")[1])).alias("k"), F.coalesce(F.col(c), F.lit(0.0)).alias("value")) for c in one.columns]
    return one.select(F.inline(F.array(*cells)))


def layered(queries: DataFrame, retrieved: DataFrame, golds: DataFrame, layers: list[str], most: int = 8) -> DataFrame:
    """``query_id, layer, rank, first_miss``: the first hit of each layer, and the first layer that misses a gold it could find.

    ``retrieved(query_id, layer, rank, id)``, ``golds(query_id, layer, id)``.
    """
    order = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer")).cast("int")
    hit = retrieved.filter(F.col("rank") <= most).join(golds, ["query_id", "layer", "id"], "left_semi").groupBy("query_id", "layer").agg(F.min("rank").alias("rank"))
    has = golds.select("query_id", "layer").distinct().withColumn("_g", F.lit(True))
    every = queries.select("query_id", F.explode(F.array(*[F.lit(x) for x in layers])).alias("layer"))
    rows = every.join(hit, ["query_id", "layer"], "left").join(has, ["query_id", "layer"], "left")
    miss = F.when(F.col("_g") & F.col("rank").isNull(), order)
    first = F.min(miss).over(Window.partitionBy("query_id"))
    return rows.select("query_id", "layer", "rank", F.get(F.array(*[F.lit(x) for x in layers]), first - 1).alias("first_miss"))


def transitions(rows: DataFrame, golds: DataFrame, layers: list[str]) -> DataFrame:
    """``step, misses``: how many queries a layer loses that the one before had (from :func:`layered`)."""
    order = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer"))
    has = golds.select("query_id", "layer").distinct().withColumn("_g", F.lit(True))
    w = Window.partitionBy("query_id").orderBy(order)
    seen = rows.join(has, ["query_id", "layer"], "left").withColumn("_before", F.lag("rank").over(w)).withColumn("_name", F.lag("layer").over(w))
    lost = seen.filter(F.col("_before").isNotNull() & F.col("rank").isNull() & F.col("_g"))
    return lost.groupBy(F.concat("_name", F.lit("->"), "layer").alias("step")).agg(F.count(F.lit(1)).alias("misses"))


def _within(where: Column) -> Callable[[Column], Column]:
    return lambda term: F.contains(where, t.match_text(term))


def passage_matches(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """``gold_id, chunk_id`` of chunks that meet a gold: reference, id lists, and all / any terms in section, text or both.

    ``chunks(chunk_id, ref, section, text)``; ``gold(gold_id, ref, ids_all, ids_any, section_all, section_any, text_all,
    text_any, both_all, both_any)``; an empty list asks nothing.
    """
    rows = chunks.join(gold, "ref")
    section, body = t.match_text(F.col("section")), t.match_text(F.col("text"))
    both = F.concat_ws(" ", section, body)
    ok = (F.size("ids_all") == 0) | F.array_contains("ids_all", F.col("chunk_id"))
    ok = ok & ((F.size("ids_any") == 0) | F.array_contains("ids_any", F.col("chunk_id")))
    for name, where in (("section", section), ("text", body), ("both", both)):
        ok = ok & F.forall(f"{name}_all", _within(where)) & ((F.size(f"{name}_any") == 0) | F.exists(f"{name}_any", _within(where)))
    return rows.filter(ok).select("gold_id", "chunk_id")


def phrase(text: Column) -> Column:
    """Folded letters, digits and percent signs; ligatures spelled out."""
    plain = F.replace(F.replace(F.lower(t.fold(F.coalesce(text, F.lit("")))), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9%]+", " "))


def point_tokens(text: Column) -> Column:
    words = F.filter(F.split(phrase(text), " "), lambda w: ~w.isin(*POINT_STOPWORDS) & ((F.length(w) >= 3) | w.rlike(r"\d")))
    singular = F.transform(F.filter(words, lambda w: (F.length(w) > 4) & F.endswith(w, F.lit("s"))), lambda w: F.left(w, F.length(w) - 1))
    return F.array_distinct(F.concat(words, singular))


def point_covered(point: Column, answer: Column) -> Column:
    """Enough of an expected point's words in the answer: 60 % of up to five, else 45 % and three; nothing expected is covered."""
    return t.let(point_tokens(point), lambda e: t.let(F.size(F.array_intersect(e, point_tokens(answer))), lambda hits: F.when(F.size(e) == 0, True).when(F.size(e) <= 5, hits / F.size(e) >= 0.6).otherwise((hits / F.size(e) >= 0.45) & (hits >= 3))))


def abstains(answer: Column) -> Column:
    said = phrase(answer)
    return (said == "") | t.any_marker(said, ABSTENTION)


def auto_verdict(rows: DataFrame) -> DataFrame:
    """Adds ``verdict`` to rows ``error, failure_hits, status, answer, trace_score, n_points, point_recall, n_required,
    required_hits, has_source, coverage``: the first rule that applies.
    """
    points = (F.col("n_points") == 0) | (F.col("point_recall") >= 0.4)
    key = (F.col("required_hits") > 0) | (F.col("n_required") == 0)
    traced = (F.col("coverage") >= 0.5) & (F.col("trace_score") >= 0.75)
    passed = (key & points) | (key & traced) | (F.col("has_source") & points & traced)
    verdict = (
        F.when(F.col("error"), "runtime_error")
        .when(F.col("failure_hits") > 0, "needs_review_failure_signal")
        .when((F.col("status") == "insufficient_evidence") | abstains(F.col("answer")), "candidate_fail_insufficient_evidence")
        .when(~F.col("status").isin("supported", "partial"), "needs_human_review_unknown_status")
        .when(passed, "candidate_pass")
        .otherwise("needs_human_review")
    )
    return rows.withColumn("verdict", verdict)


def coverage(covered: Column, required: Column, missing: Column, status: Column) -> Column:
    """Covered axes among those required or named; at most a quarter without sufficient evidence; three digits."""
    share = F.least(F.lit(1.0), covered / F.greatest(required, covered + missing, F.lit(1)))
    return F.bround(F.when(status == "insufficient_evidence", F.least(share, F.lit(0.25))).otherwise(share), 3)


def summary(rows: DataFrame) -> DataFrame:
    """``part, name, n, value``: counts by status and verdict, means without errors, and means by theme.

    ``rows(error, status, verdict, judge, theme, coverage, trace, doc_recall, answer_recall, seconds)``.
    """
    one = F.lit(1)
    blank = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    verdict = blank("verdict", F.lit("unknown"))
    named = {
        "answer_status": blank("status", F.when(F.col("error"), "error").otherwise("unknown")),
        "auto_verdict": verdict,
        "judge_verdict": F.nullif(F.col("judge"), F.lit("")),
        "effective_verdict": F.coalesce(F.nullif(F.col("judge"), F.lit("")), verdict),
    }
    counted = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("name")) for k, v in named.items()])).alias("x")).select("x.*").filter("name is not null")
    out = counted.groupBy("part", "name").agg(F.count(one).alias("n"), F.lit(None).cast("double").alias("value"))
    values = ("coverage", "trace", "doc_recall", "answer_recall")
    ok = rows.filter("not error").agg(F.count(one).alias("n"), *[F.bround(F.avg(v), 3).alias(v) for v in values], F.bround(F.avg("seconds"), 1).alias("seconds"))
    means = ok.select("n", F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.coalesce(F.col(v), F.lit(0.0)).alias("value")) for v in (*values, "seconds")])).alias("x"))
    themes = rows.groupBy(blank("theme", F.lit("unknown")).alias("theme")).agg(F.count(one).alias("n"), *[F.bround(F.avg(v), 3).alias(v) for v in values])
    themes = themes.select("theme", "n", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col(v).alias("value")) for v in values])).alias("x"))
    return out.unionByName(means.select(F.lit("mean").alias("part"), "x.name", "n", "x.value")).unionByName(themes.select(F.lit("theme").alias("part"), F.concat("theme", F.lit("/"), "x.v").alias("name"), "n", "x.value"))


def coverage_gaps(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``side, n, first``: references of documents without chunks and of chunks without a document, the first ten of each."""
    d, c = documents.select("ref").distinct(), chunks.select("ref").distinct()
    rows = d.join(c, "ref", "left_anti").select(F.lit("documents_without_chunks").alias("side"), "ref").unionByName(c.join(d, "ref", "left_anti").select(F.lit("chunks_without_document").alias("side"), "ref"))
    w = Window.partitionBy("side").orderBy("ref")
    rows = rows.withColumn("_n", F.row_number().over(w))
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= 10, F.col("ref")))), ",").alias("first"))


def drift(before: DataFrame, after: DataFrame, tolerance: float) -> DataFrame:
    """``metric, before, after, delta, within`` of two tables ``metric, value``; a metric that one lacks is not within."""
    rows = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full")
    delta = F.abs(F.col("after") - F.col("before"))
    return rows.select("metric", "before", "after", delta.alias("delta"), F.coalesce(delta <= tolerance, F.lit(False)).alias("within"))


def same_order(left: DataFrame, right: DataFrame) -> DataFrame:
    """``query_id, same``: do two rankings ``query_id, rank, id`` name the same ids in the same order?"""
    listed = lambda df, name: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias(name))
    rows = listed(left, "a").join(listed(right, "b"), "query_id", "full")
    return rows.select("query_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def payload_errors(hits: DataFrame) -> DataFrame:
    """``query_id, errors``: payload rows ``query_id, citation_id, chunk_id, text`` with gaps in their numbers, repeated chunks or blank texts."""
    w = Window.partitionBy("query_id").orderBy("citation_id")
    rows = hits.withColumn("_n", F.row_number().over(w))
    found = rows.groupBy("query_id").agg(
        F.count_if(~F.col("citation_id").eqNullSafe(F.col("_n").cast("long"))).alias("gaps"),
        (F.count(F.lit(1)) - F.count_distinct("chunk_id")).alias("repeats"),
        F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"),
    )
    said = F.array(F.when(F.col("gaps") > 0, "citation ids are not contiguous"), F.when(F.col("repeats") > 0, "chunk ids repeat"), F.when(F.col("blank") > 0, "blank text"))
    return found.select("query_id", F.array_join(F.array_compact(said), "; ").alias("errors"))


def answer_errors(answers: DataFrame) -> DataFrame:
    """``answer_id, valid, n_citations, errors`` of rows ``answer_id, status, conclusion, limits, bullets, n_extracts``."""
    bullets, status = F.col("bullets"), F.col("status")
    n = F.size(bullets)
    cited = F.transform(bullets, t.citation_ids)
    every = F.flatten(cited)
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    supported, insufficient = status == "supported", status == "insufficient_evidence"
    said = F.array(
        F.when(~(supported | insufficient) | status.isNull(), "unknown status"),
        F.when(blank("conclusion"), "no conclusion"),
        F.when(blank("limits"), "no limits"),
        F.when(n == 0, "no bullets"),
        F.when(supported & ~n.between(2, 4), "2 to 4 bullets"),
        F.when(supported & F.exists(cited, lambda c: F.size(c) == 0), "bullet without citation"),
        F.when(insufficient & ~n.between(1, 2), "1 to 2 bullets"),
        F.when((F.col("n_extracts") > 0) & F.exists(every, lambda i: (i < 1) | (i > F.col("n_extracts"))), "unknown citation"),
    )
    errors = F.array_join(F.array_compact(said), "; ")
    return answers.select("answer_id", (errors == "").alias("valid"), F.size(every).alias("n_citations"), errors.alias("errors"))


def agentic_scores(rows: DataFrame) -> DataFrame:
    """Scores of answered questions, one row each, with ``run_id``.

    ``rows(run_id, required, optional, points, signals, refs, answer, labels, stages, reviewed, concluded, iterations)``: arrays of
    expected references, of expected points, of phrases that give a failure away, and of the references cited; the answer's whole
    text; what the steps of the run were called; whether sources were reviewed, and whether there is a conclusion.
    """
    cited = lambda ref: F.exists("refs", lambda r: (F.trim(r) != "") & (F.trim(ref) != "") & t.family_match(F.trim(r), F.trim(ref)))
    share = lambda hits, of: F.when(F.size(of) > 0, F.bround(F.size(hits) / F.size(of), 3)).otherwise(1.0)
    steps = F.lower(F.col("labels"))
    has = lambda *names: t.any_marker(steps, list(names))
    scored = rows.withColumns({
        "required_hits": F.filter("required", cited), "missing_required": F.filter("required", lambda x: ~cited(x)), "optional_hits": F.filter("optional", cited),
        "point_hits": F.filter("points", lambda p: point_covered(p, F.col("answer"))),
        "signal_hits": F.filter("signals", lambda x: (phrase(x) != "") & F.contains(phrase(F.col("answer")), phrase(x))),
        "has_plan": has("plan") | F.contains(F.lower("stages"), F.lit("plan")), "has_review": F.col("reviewed"), "has_retrieval": has("recherche"),
        "has_answer": has("réponse", "reponse") | F.col("concluded"), "has_relaunch": (F.col("iterations") > 1) | has("relance", "intra-document"),
    })
    parts = ["has_plan", "has_review", "has_retrieval", "has_answer"]
    trace = sum((F.col(p).cast("int") for p in parts), F.lit(0)) / 4
    return scored.select(
        "run_id", "required_hits", "missing_required", share(F.col("required_hits"), F.col("required")).alias("required_recall"), "optional_hits", "point_hits",
        share(F.col("point_hits"), F.col("points")).alias("point_recall"), "signal_hits", F.bround(F.least(F.lit(1.0), trace + F.when(F.col("has_relaunch"), 0.1).otherwise(0.0)), 3).alias("trace_score"), *parts, "has_relaunch",
    )


#: What errors of each kind say, in the order in which kinds are tried.
FAILURES = {
    "missing_api_key": ["api key is missing"],
    "provider_rate_limit": ["ratelimiterror", "resource_exhausted", "quota exceeded"],
    "provider_timeout": ["apitimeouterror", "request timed out"],
    "provider_internal": ["internalservererror", " 503 "],
    "format_invalid": ["could not parse model output", "json output appears truncated", "must be ", "supported answers must contain", "insufficient_evidence answers must contain", "citations reference unknown retrieval excerpts"],
}


def failure_kind(valid: Column, errors: Column) -> Column:
    """``valid``, one of :data:`FAILURES`, or ``runtime_error``; ``errors`` is their text."""
    said = F.concat(F.lit(" "), F.lower(F.coalesce(errors, F.lit(""))), F.lit(" "))
    kind = F.when(valid, "valid")
    for name, markers in FAILURES.items():
        kind = kind.when(t.any_marker(said, markers), name)
    return kind.otherwise("runtime_error")


def batch_review(rows: DataFrame) -> DataFrame:
    """One row of counts over answers ``valid, has_conclusion, has_justification, has_limits, with_citation, errors``."""
    kind = failure_kind(F.col("valid"), F.col("errors"))
    flags = ["has_conclusion", "has_justification", "has_limits", "with_citation"]
    return rows.withColumn("_kind", kind).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"), *[F.count_if(f).alias(f"n_{f}") for f in flags],
        *[F.count_if(F.col("_kind") == k).alias(f"n_{k}") for k in (*FAILURES, "runtime_error")],
    )


def doc_distribution(passages: DataFrame) -> DataFrame:
    """``query_id, ref, n, docs, most``: passages a document among a question's ``passages(query_id, ref)``, how many documents, and the largest ``n``."""
    w = Window.partitionBy("query_id")
    counted = passages.groupBy("query_id", "ref").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("query_id", "ref", "n", F.count(F.lit(1)).over(w).alias("docs"), F.max("n").over(w).alias("most"))
