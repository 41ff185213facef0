"""Evidence passages inside the best documents: scores of question against chunk, and the search that uses them.

Chunks are rows ``item, ref, path (array), legal (array), text``; hits are ranked tables keyed by ``query_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.functions.text import bigrams, common
from corpusmill.operators import lexical, patterns
from corpusmill.operators.staging import staged


def long_tokens(text: Column) -> Column:
    return F.filter(t.tokens(text), lambda w: F.length(w) >= 4)


def token_overlap(query: Column, text: Column) -> Column:
    """Common terms of four characters or more, and twice the common neighbours."""
    return t.let(overlap_terms(query), lambda a: t.let(overlap_terms(text), lambda b: terms_overlap(a, b)))


def overlap_terms(text: Column) -> Column:
    """What :func:`token_overlap` compares of a text."""
    return t.let(long_tokens(text), lambda a: F.struct(F.array_distinct(a).alias("w"), bigrams(a).alias("b")))


def terms_overlap(a: Column, b: Column) -> Column:
    return (common(a["w"], b["w"]) + 2 * common(a["b"], b["b"])).cast("double")


def lexical_question(query: Column) -> Column:
    return t.let(t.significant_tokens(query), lambda q: F.struct(q.alias("q"), bigrams(q).alias("b")))


def lexical_passage(path: Column, legal: Column, text: Column) -> Column:
    section = F.array_join(path, " ")
    full = F.concat_ws("\n", section, F.array_join(legal, " "), text)
    return t.let(t.significant_tokens(section), lambda s: t.let(t.significant_tokens(full), lambda c: F.struct(s.alias("s"), bigrams(s).alias("sb"), c.alias("c"), bigrams(c).alias("cb"))))


def lexical_score(q: Column, p: Column) -> Column:
    capped = lambda most, each, n: F.least(F.lit(most), F.lit(each) * n)
    whole = capped(5.0, 0.8, common(q["q"], p["c"])) + capped(12.0, 5.0, common(q["b"], p["cb"]))
    return whole + capped(12.0, 3.0, common(q["q"], p["s"])) + capped(28.0, 10.0, common(q["b"], p["sb"]))


def lexical_evidence(query: Column, path: Column, legal: Column, text: Column) -> Column:
    """Capped counts of common terms and neighbours, in the whole chunk and in its section path."""
    return t.let(lexical_question(query), lambda q: t.let(lexical_passage(path, legal, text), lambda p: lexical_score(q, p)))


def numeric_question(query: Column) -> Column:
    return F.struct(t.numeric_intent(query).alias("asks"), t.numeric_tokens(query).alias("numbers"), F.array_distinct(t.significant_tokens(query)).alias("terms"))


def numeric_passage(path: Column, text: Column) -> Column:
    def of(x: Column) -> Column:
        section, body = x["section"], x["body"]
        full = F.concat_ws("\n", section, body)
        points = lambda test, n: F.when(test, F.lit(n)).otherwise(0.0)
        score = points(t.fold(body).rlike(t.AMOUNT), 4.0) + points(t.fold(full).rlike(t.SCALE), 3.0)
        score = score + F.when(t.fold(section).rlike(t.NUMERIC_SECTION), 2.0).when(t.fold(F.left(body, F.lit(500))).rlike(t.NUMERIC_SECTION), 1.0).otherwise(0.0)
        words = F.regexp_extract_all(t.folded(full), F.lit("[a-z0-9]+"), F.lit(0))
        return F.struct(score.alias("points"), t.numeric_tokens(body).alias("body"), t.numeric_tokens(section).alias("section"), words.alias("words"))

    return t.let(F.struct(t.normalize_ws(F.array_join(path, " ")).alias("section"), t.normalize_ws(text).alias("body")), of)


def numeric_score(q: Column, p: Column) -> Column:
    in_section = F.array_intersect(q["numbers"], p["section"])
    score = p["points"] + t.let(F.array_intersect(q["numbers"], p["body"]), lambda found: 3.0 * F.size(found) + 2.0 * F.size(F.array_except(in_section, found)))
    return F.when(q["asks"], score + F.least(F.lit(4.0), 0.75 * common(q["terms"], p["words"]))).otherwise(0.0)


def numeric_evidence(query: Column, path: Column, text: Column) -> Column:
    """0 unless the question asks for a number; else points for amounts, scales, sections about numbers, and the question's numbers."""
    return t.let(numeric_question(query), lambda q: F.when(q["asks"], t.let(numeric_passage(path, text), lambda p: numeric_score(q, p))).otherwise(0.0))


def structural_question(query: Column) -> Column:
    return F.struct(t.general_rule_intent(query).alias("rule"), t.exception_intent(query).alias("exception"))


def structural_passage(path: Column, text: Column) -> Column:
    flags = lambda section: F.struct(t.any_marker(section, t.PRINCIPLE).alias("principle"), F.contains(section, F.lit("derogation")).alias("derogation"), t.folded(text).rlike(t.NON_PRINCIPLE_LEAD).alias("remark"))
    return t.let(t.folded(F.array_join(path, " ")), flags)


def structural_score(q: Column, p: Column) -> Column:
    score = F.when(p["principle"], 8.0).otherwise(0.0) - F.when(p["derogation"] & ~q["exception"], 8.0).otherwise(0.0) - F.when(p["remark"], 6.0).otherwise(0.0)
    return F.when(q["rule"], score).otherwise(0.0)


def structural(query: Column, path: Column, text: Column) -> Column:
    """For questions about the general rule: principle sections up, derogations and remarks down."""
    return t.let(structural_question(query), lambda q: t.let(structural_passage(path, text), lambda p: structural_score(q, p)))


def asked_features(queries: DataFrame) -> DataFrame:
    """``query_id, asked`` (tokens to rank by) and what evidence needs of each question, ``lex, num, str``; made once a question."""
    text = F.col("text")
    search = F.col("search") if "search" in queries.columns else text
    return queries.select("query_id", t.tokens(search).alias("asked"), lexical_question(text).alias("lex"), numeric_question(text).alias("num"), structural_question(text).alias("str"))


def prioritized(ranked: DataFrame, near: DataFrame, features: DataFrame, keep: int) -> DataFrame:
    """Local ranks reordered by BM25 plus evidence; the best ``keep`` a document.

    ``ranked(query_id, ref, item, score, rank)``, ``near(item, lex, num, str)`` of chunks, ``features`` of :func:`asked_features`.  Returns
    ``query_id, ref, item, score, local_rank, numeric`` (numeric evidence).
    """
    said = features.select("query_id", *[F.col(c).alias(f"q_{c}") for c in ("lex", "num", "str")])
    rows = ranked.join(near.select("item", "lex", "num", "str"), "item").join(said, "query_id")
    rows = rows.withColumn("numeric", numeric_score(F.col("q_num"), F.col("num")))
    total = F.col("score") + 2.0 * lexical_score(F.col("q_lex"), F.col("lex"))
    total = total + F.when(F.col("q_num.asks"), 3.0).otherwise(0.0) * F.col("numeric") + structural_score(F.col("q_str"), F.col("str"))
    w = Window.partitionBy("query_id", "ref").orderBy(F.round(total, 9).desc(), "rank", "item")
    return rows.withColumn("local_rank", F.row_number().over(w)).filter(F.col("local_rank") <= keep).select("query_id", "ref", "item", "score", "local_rank", "numeric")


def _haystack(path: Column, legal: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.array_join(path, " "), F.array_join(legal, " "), text)


def prefixes_of(parts: Column) -> Column:
    """All leading parts, joined by dashes."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"))


def _local(pairs: DataFrame, chunks: DataFrame, features: DataFrame, keep: int) -> DataFrame:
    """:func:`prioritized` hits of ``pairs(query_id, ref)``; only chunks of these documents are tokenized, and each once, however many questions ask it."""
    near = chunks.join(pairs.select("ref").distinct(), "ref", "left_semi")
    search = F.concat_ws("\n", "ref", F.array_join("path", " "), F.nullif(F.array_join("legal", " "), F.lit("")), "text")
    path, legal, text = F.col("path"), F.col("legal"), F.col("text")
    near = staged(near.select("item", "ref", t.tokens(search).alias("toks"), lexical_passage(path, legal, text).alias("lex"), numeric_passage(path, text).alias("num"), structural_passage(path, text).alias("str")), "passages")
    ranked = staged(lexical.rank(near.select("item", "ref", "toks"), features.select("query_id", F.col("asked").alias("toks")), None, ["ref"], pairs.select("query_id", "ref").distinct()), "local")
    return staged(prioritized(ranked, near, features, keep), "prioritized")


def mentions(named: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, item`` of chunks whose path or text contains a string of ``named(query_id, cited)``, in any case."""
    wanted = staged(named.select("query_id", F.upper("cited").alias("pattern")).distinct(), "named")
    hay = chunks.select("item", F.upper(F.concat_ws("\n", F.array_join("path", " "), "text")).alias("text"))
    return patterns.occurrences(hay, wanted, "item").join(wanted, "pattern").select("query_id", "item").distinct()


def direct_search(queries: DataFrame, stage1: DataFrame, chunks: DataFrame, *, top_docs: int = 5, per_doc: int = 2, most: int = 6) -> DataFrame:
    """Passages of the stage-1 documents, then of documents that the question or these passages cite, then chunks that name them.

    ``queries(query_id, text, [search])``, where ``search`` is what chunks are ranked by if not the text; ``stage1(query_id, ref,
    rank)``.  Returns ``query_id, global_rank, document_rank, local_rank, local_score, ref, item``.  One hop: at most six references are followed, those of at least three
    parts; each cited document takes the next document rank, whether or not it adds passages.
    """
    extra = ["search"] if "search" in queries.columns else []
    queries = staged(queries.select("query_id", "text", *extra, t.numeric_intent(F.col("text")).alias("_numeric")), "questions")
    features = staged(asked_features(queries), "features")
    docs = staged(stage1.filter(F.col("rank") <= top_docs).select("query_id", "ref", F.col("rank").alias("document_rank")), "stage1")
    base = _local(docs, chunks, features, per_doc).join(docs, ["query_id", "ref"]).withColumn("phase", F.lit(0))
    at = Window.partitionBy("query_id").orderBy("document_rank", "local_rank")
    first = base.withColumn("o", F.row_number().over(at)).filter(F.col("o") <= most)
    cited = first.join(chunks.select("item", "path", "legal", "text"), "item").select("query_id", "o", F.posexplode(t.references(_haystack(F.col("path"), F.col("legal"), F.col("text")), 4)).alias("p", "cited"))
    own = queries.select("query_id", F.lit(0).alias("o"), F.posexplode(t.references(F.col("text"), 4)).alias("p", "cited"))
    named = own.unionByName(cited).groupBy("query_id", "cited").agg(F.min(F.struct("o", "p")).alias("at"))
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).filter("n <= 6")
    named = staged(named.select("query_id", "cited", "n"), "cited")
    if named.isEmpty():  # nothing to follow
        return _ordered(base.drop("phase"), queries, most)
    n_docs = docs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_docs"))
    has_own = own.select("query_id").distinct().withColumn("own", F.lit(True))
    start = queries.select("query_id").join(n_docs, "query_id", "left").join(has_own, "query_id", "left")
    start = start.select("query_id", F.when(F.col("own"), 0).otherwise(F.coalesce("n_docs", F.lit(0)) + 1).alias("start"))

    refs = chunks.select("ref").distinct().select("ref", F.explode(prefixes_of(F.split(t.normalize_reference(F.col("ref")), "-"))).alias("prefix"))
    follow = named.filter(t.followable(F.col("cited"))).withColumn("prefix", t.normalize_reference(F.col("cited"))).join(refs, "prefix")
    follow = follow.withColumn("step", F.row_number().over(Window.partitionBy("query_id").orderBy("n", "ref"))).join(start, "query_id")
    follow = staged(follow.select("query_id", "ref", "start", "step"), "followed")
    steps = follow.groupBy("query_id").agg(F.max("step").alias("steps"))
    follow = follow.groupBy("query_id", "ref").agg((F.min("start") + F.min("step") - 1).alias("document_rank"))
    followed = _local(follow, chunks, features, per_doc).join(follow, ["query_id", "ref"]).withColumn("phase", F.lit(1))
    hits = base.unionByName(followed)
    once = Window.partitionBy("query_id", "item").orderBy("phase")
    hits = hits.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n", "phase")

    mention = mentions(named, chunks).join(chunks.select("item", "ref", "path", "text"), "item")
    mention = mention.join(hits.select("query_id", "item"), ["query_id", "item"], "left_anti").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    mention = mention.withColumn("numeric", numeric_evidence(F.col("_q"), F.col("path"), F.col("text")))
    best = Window.partitionBy("query_id").orderBy(F.desc("numeric"), "ref", "item")
    mention = mention.withColumn("local_rank", F.row_number().over(best)).filter(F.col("local_rank") <= max(2, per_doc))
    mention = mention.join(start, "query_id").join(steps, "query_id", "left")
    mention = mention.select("query_id", "ref", "item", F.lit(0.0).alias("score"), "local_rank", "numeric", (F.col("start") + F.coalesce("steps", F.lit(0))).alias("document_rank"))
    return _ordered(hits.unionByName(mention), queries, most)


def _ordered(hits: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """The best ``most`` hits of each question: by numbers if it asks for one, then local rank, document, score."""
    hits = hits.join(queries.select("query_id", "_numeric"), "query_id")
    lead = F.when(F.col("_numeric"), -F.round(F.col("numeric") - 0.6 * F.greatest(F.lit(0), F.col("document_rank") - 1), 9)).otherwise(0.0)
    order = Window.partitionBy("query_id").orderBy(lead, "local_rank", "document_rank", F.round("score", 9).desc(), "item")
    hits = hits.withColumn("global_rank", F.row_number().over(order)).filter(F.col("global_rank") <= most)
    return hits.select("query_id", "global_rank", "document_rank", "local_rank", F.col("score").alias("local_score"), "ref", "item")


def intra_document(queries: DataFrame, wanted: DataFrame, chunks: DataFrame, most: int = 8, per_doc: int = 8) -> DataFrame:
    """The best passages of named documents: ``wanted(query_id, ref, rank)``, at most eight a question."""
    docs = staged(wanted.filter("rank <= 8").select("query_id", "ref", F.col("rank").alias("document_rank")), "wanted")
    rows = _local(docs, chunks, staged(asked_features(queries), "features"), per_doc).join(docs, ["query_id", "ref"])
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "document_rank", "local_rank", "item")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("query_id", "rank", "ref", "item", F.col("score").alias("local_score"))


def two_stage(docs: DataFrame, local: DataFrame, per_doc: int = 3, most: int = 6) -> DataFrame:
    """Round robin over the documents' best chunks: ``docs(query_id, ref, doc_rank)``, ``local(query_id, ref, item, score, rank)``."""
    rows = local.filter(F.col("rank") <= per_doc).join(docs.select("query_id", "ref", "doc_rank"), ["query_id", "ref"])
    w = Window.partitionBy("query_id").orderBy("rank", "doc_rank", F.round("score", 9).desc(), "item")
    return rows.withColumn("global_rank", F.row_number().over(w)).filter(F.col("global_rank") <= most)


def _pick(scores: list[float], docs: list[str], paths: list[tuple], most: int) -> list[int]:
    """Indices in the order of their selection: greedy by normalized score less what repeats document, section or parent."""
    low, high = min(scores), max(scores)
    if high - low < 1e-9:
        return list(range(len(scores)))[:most]
    value = [(s - low) / (high - low) for s in scores]
    left, out = list(range(len(scores))), []
    count: dict[str, int] = {}
    seen_path, seen_parent = set(), set()

    def take(i: int) -> None:
        out.append(i)
        left.remove(i)
        count[docs[i]] = count.get(docs[i], 0) + 1

    while left and len(out) < most:  # spread over documents and sections
        open_ = [i for i in left if count.get(docs[i], 0) < 3]
        if not open_:
            break
        cost = {i: (0.0, 0.15, 0.30)[count.get(docs[i], 0)] + 0.15 * ((docs[i], paths[i]) in seen_path) + 0.05 * ((docs[i], paths[i][:-1]) in seen_parent) for i in open_}
        best = max(open_, key=lambda i: (value[i] - cost[i], -i))
        if value[best] - cost[best] < 0:
            break
        take(best)
        seen_path.add((docs[best], paths[best]))
        seen_parent.add((docs[best], paths[best][:-1]))
    while left and len(out) < most:  # then up to four a document
        open_ = [i for i in left if count.get(docs[i], 0) < 4]
        if not open_:
            break
        take(max(open_, key=lambda i: (value[i] - (0.10 if count.get(docs[i], 0) >= 3 else 0.0), -i)))
    rest = sorted(left, key=lambda i: (-value[i], i))
    return out + rest[: most - len(out)]


def diverse(candidates: DataFrame, most: int = 8) -> DataFrame:
    """``candidates(query_id, rank, ref, path, item, score)`` (bounded by the reranker's pool) to ``query_id, pick, item``."""

    def select(rows: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        picks = _pick(rows["score"].tolist(), rows["ref"].tolist(), [tuple(p) for p in rows["path"]], most)
        chosen = rows.iloc[picks]
        return pd.DataFrame({"query_id": chosen["query_id"], "pick": range(1, len(picks) + 1), "item": chosen["item"]})

    return candidates.groupBy("query_id").applyInPandas(select, "query_id long, pick int, item long")
