"""Queries of ranking, fusion, passages and the reference tree, over the whole corpus and all questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.operators import dense, fusion, lexical, passages, postings, references, runtime
from corpusmill.operators.staging import staged
from corpusmill.plans.q_text import SIG
from corpusmill.plans.registry import query
from corpusmill.plans.tables import bm25_ctes, chunks, corpus, f, n, questions, ranked, sql, tok, vector_queries, vectors

DOC_ITEMS = f"SELECT item, {tok('text')} AS toks FROM corpus"
TITLE_ITEMS = f"SELECT item, {tok('title')} AS toks FROM corpus"
CHUNK_ITEMS = f"SELECT item, {tok('text')} AS toks FROM chunk"
LOCAL_ITEMS = f"SELECT ref, item, {tok('text')} AS toks FROM chunk"
Q = f"SELECT query_id, {tok('text')} AS toks FROM question"


def doc_items(spark: SparkSession, d: str, column: str = "text") -> DataFrame:
    return corpus(spark, d).select("item", "ref", t.tokens(F.col(column)).alias("toks"))


def chunk_items(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("item", "ref", t.tokens(F.col("text")).alias("toks"))


def doc_index(spark: SparkSession, d: str, column: str = "text") -> postings.Index:
    """The stored index of the documents' texts or titles; queries share it."""
    return postings.stored(corpus(spark, d).select("item", F.col(column).alias("text")), t.tokens(F.col("text")), "tokens-1")


def chunk_index(spark: SparkSession, d: str) -> postings.Index:
    """The stored index of the documents' chunks, under the documents' fingerprint."""
    return postings.stored(chunks(spark, d).select("item", "doc", "text"), t.tokens(F.col("text")), "chunk-tokens-1", owner="doc", source=corpus(spark, d).select("item", "text"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("query_id", t.tokens(F.col("text")).alias("toks"))


def _scores(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("query_id", *cols, F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(sql("SELECT n AS n_items, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM bd) AS n_terms, round(m, 6) AS mean_idf FROM bn, bm", "corpus", "question", **bm25_ctes("b", DOC_ITEMS, Q)))
def bm25_stats(spark, d):
    s = lexical.statistics(doc_items(spark, d))
    return s.select("n_items", F.round("avgdl", 6).alias("avgdl"), "n_terms", F.round("mean_idf", 6).alias("mean_idf"))


@query(sql("SELECT query_id, item, round(score, 6) AS score, rank FROM br WHERE rank <= 5", "corpus", "question", **bm25_ctes("b", DOC_ITEMS, Q), br=ranked("b")))
def bm25_doc_topk(spark, d):
    return _scores(postings.rank(doc_index(spark, d), asked(spark, d), 5), "item")


@query(sql("SELECT query_id, item, round(score, 6) AS score, rank FROM br WHERE rank <= 30", "corpus", "question", **bm25_ctes("b", TITLE_ITEMS, "SELECT query_id, toks[1:2] AS toks FROM (" + Q + ")"), br=ranked("b")))
def bm25_zero_fill(spark, d):
    few = asked(spark, d).withColumn("toks", F.slice("toks", 1, 2))
    return _scores(postings.rank(doc_index(spark, d, "title"), few, 30), "item")


_ROLL = {"bb": "SELECT r.query_id, c.ref, r.item, r.score, row_number() OVER (PARTITION BY r.query_id, c.ref ORDER BY round(r.score, 9) DESC, r.item) AS o FROM bs r JOIN chunk c ON c.item = r.item", "bo": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM bb WHERE o = 1"}


@query(sql("SELECT query_id, ref, item, round(score, 6) AS score, rank FROM bo WHERE rank <= 5", "chunk", "question", **bm25_ctes("b", CHUNK_ITEMS, Q), **_ROLL))
def bm25_chunk_to_doc(spark, d):
    found = postings.rank(chunk_index(spark, d), asked(spark, d), 5)
    return _scores(found.join(corpus(spark, d).select(F.col("item").alias("owner"), "ref"), "owner"), "ref", "item")


_TOP_DOCS = {**bm25_ctes("b", DOC_ITEMS, Q), "br": ranked("b"), "top": "SELECT r.query_id, c.ref, r.item AS doc, r.rank AS doc_rank, r.score AS doc_score FROM br r JOIN corpus c ON c.item = r.item WHERE r.rank <= 5"}
_LOCAL = {**_TOP_DOCS, **bm25_ctes("l", LOCAL_ITEMS, Q, "ref", "SELECT query_id, ref FROM top"), "lr": ranked("l", "ref")}


def top_docs(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """``query_id, ref, doc, doc_rank, doc_score``."""
    best = postings.rank(doc_index(spark, d), asked(spark, d), k)
    return staged(best, "top").join(corpus(spark, d).select("item", "ref"), "item").select("query_id", "ref", F.col("item").alias("doc"), F.col("rank").alias("doc_rank"), F.col("score").alias("doc_score"))


def local_ranks(spark: SparkSession, d: str) -> DataFrame:
    pairs = top_docs(spark, d).select("query_id", "ref")
    return lexical.rank(chunk_items(spark, d), asked(spark, d), None, ["ref"], pairs)


@query(sql("SELECT query_id, ref, item, round(score, 6) AS score, rank FROM lr", "corpus", "chunk", "question", **_LOCAL))
def bm25_local(spark, d):
    return _scores(local_ranks(spark, d), "ref", "item")


@query(sql(f"""SELECT l.query_id, l.ref, l.item, len(list_intersect({tok('c.text')}, {tok('q.text')}))::INT AS overlap,
row_number() OVER (PARTITION BY l.query_id, l.ref ORDER BY len(list_intersect({tok('c.text')}, {tok('q.text')})) DESC, round(l.score, 9) DESC, l.rank) AS rank
FROM lr l JOIN chunk c ON c.item = l.item JOIN question q ON q.query_id = l.query_id""", "corpus", "chunk", "question", **_LOCAL))
def token_overlap_rerank(spark, d):
    texts = chunk_items(spark, d).select("item", "toks")
    rows = lexical.overlap_rerank(local_ranks(spark, d), texts, asked(spark, d), ["query_id", "ref"])
    return rows.select("query_id", "ref", "item", "overlap", F.col("rank").cast("long").alias("rank"))


_SEC_ITEMS = f"SELECT ref, section AS item, {tok('title || chr(10) || text')} AS toks FROM chunk"


@query(sql("SELECT query_id, ref, item AS section, round(score, 6) AS score, rank FROM sr WHERE rank <= 2", "corpus", "chunk", "question", **_TOP_DOCS, **bm25_ctes("s", _SEC_ITEMS, Q, "ref", "SELECT query_id, ref FROM top"), sr=ranked("s", "ref")))
def section_bm25(spark, d):
    parts = chunks(spark, d).select("ref", F.col("section").cast("string").alias("section_key"), F.array("title").alias("path"), "item", "text")
    items = lexical.sections(parts).select("ref", F.col("section_key").cast("int").alias("item"), t.tokens(F.col("text")).alias("toks"))
    best = lexical.rank(items, asked(spark, d), 2, ["ref"], top_docs(spark, d).select("query_id", "ref"))
    return _scores(best.withColumnRenamed("item", "section"), "ref", "section")


_TERMS = "list_filter({x}, lambda w: length(w) >= 4)"
_BI = "list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1])"


@query(sql("""SELECT query_id, item, (len(list_intersect(list_distinct(qt), list_distinct(dt))) + 2 * len(list_intersect(list_distinct(qb), list_distinct(db))))::INT AS overlap
FROM (SELECT t.query_id, t.doc AS item, q.qt, q.qb, e.dt, e.db FROM top t JOIN qx q ON q.query_id = t.query_id JOIN dx e ON e.item = t.doc)""", "corpus", "question", **_TOP_DOCS,
    q0=f"SELECT query_id, {_TERMS.format(x=tok('text'))} AS qt FROM question", qx="SELECT *, " + _BI.format(x="qt") + " AS qb FROM q0",
    d0=f"SELECT item, {_TERMS.format(x=tok('text'))} AS dt FROM corpus", dx="SELECT *, " + _BI.format(x="dt") + " AS db FROM d0"))
def doc_overlap_score(spark, d):
    q = questions(spark, d).select("query_id", F.col("text").alias("q"))
    rows = top_docs(spark, d).join(q, "query_id").join(corpus(spark, d).select(F.col("item").alias("doc"), "text"), "doc")
    return rows.select("query_id", F.col("doc").alias("item"), passages.token_overlap(F.col("q"), F.col("text")).cast("int").alias("overlap"))


_EV = {
    "qs0": f"SELECT query_id, {SIG.format(x=f('text'))} AS s FROM question",
    "qs": "SELECT *, " + _BI.format(x="s") + " AS b FROM qs0",
    "cs0": f"SELECT item, ref, {SIG.format(x=f('title || chr(10) || chr(10) || text'))} AS s, {SIG.format(x=f('title'))} AS h FROM chunk",
    "cs": "SELECT *, " + _BI.format(x="s") + " AS b, " + _BI.format(x="h") + " AS hb FROM cs0",
    "ev": """SELECT l.query_id, l.item, least(5.0, 0.8 * len(list_intersect(q.s, c.s))) + least(12.0, 5.0 * len(list_intersect(q.b, c.b)))
      + least(12.0, 3.0 * len(list_intersect(q.s, c.h))) + least(28.0, 10.0 * len(list_intersect(q.b, c.hb))) AS evidence
      FROM lr l JOIN qs q ON q.query_id = l.query_id JOIN cs c ON c.item = l.item""",
}


def scored_parts(spark: SparkSession, d: str) -> DataFrame:
    """Local ranks with question and chunk texts: ``query_id, ref, item, score, rank, q, path, body``."""
    q = questions(spark, d).select("query_id", F.col("text").alias("q"))
    c = chunks(spark, d).select("item", F.array("title").alias("path"), F.col("text").alias("body"))
    return local_ranks(spark, d).join(q, "query_id").join(c, "item")


def no_legal():
    """No legal references."""
    return F.expr("cast(array() as array<string>)")



@query(sql("SELECT query_id, item, round(evidence::DOUBLE, 6) AS evidence FROM ev", "corpus", "chunk", "question", **_LOCAL, **_EV))
def lexical_evidence(spark, d):
    rows = scored_parts(spark, d)
    return rows.select("query_id", "item", F.round(passages.lexical_evidence(F.col("q"), F.col("path"), no_legal(), F.col("body")), 6).alias("evidence"))


_INTENT = "'\\b(seuil|seuils|taux|plafond|plafonds|bareme|chiffre\\s+d[''’ ]affaires|combien|calcul|calcule|pourcentage|euros?|ht|hors\\s+taxe)\\b'"
_SECTION = "'\\b(seuil|seuils|taux|limite|limites|plafond|plafonds|bareme|chiffre\\s+d[''’ ]affaires)\\b'"


_NUM = f"""SELECT l.query_id, l.item,
CASE WHEN regexp_matches(strip_accents({n('c.body')}), '\\b\\d[\\d\\s]*(?:[,.]\\d+)?\\s*(?:€|euros?\\b|%|pour\\s*cent\\b)', 'i') THEN 4.0 ELSE 0.0 END
+ CASE WHEN regexp_matches(strip_accents({n('c.title')}), {_SECTION}, 'i') THEN 2.0 WHEN regexp_matches(strip_accents(left({n('c.body')}, 500)), {_SECTION}, 'i') THEN 1.0 ELSE 0.0 END
+ CASE WHEN l.item % 3 = 0 THEN 3.0 ELSE 0.0 END
+ least(4.0, 0.75 * len(list_intersect(q.s, list_distinct({SIG.format(x=f("c.title || chr(10) || c.body"))})))) AS evidence
FROM lr l JOIN qn q ON q.query_id = l.query_id JOIN cn c ON c.item = l.item"""


@query(sql("SELECT query_id, item, round(evidence::DOUBLE, 6) AS evidence FROM (" + _NUM + ")", "corpus", "chunk", "question", **_LOCAL,
    qn=f"SELECT query_id, list_distinct({SIG.format(x=f('text'))}) AS s FROM (SELECT query_id, text || ' taux 1500' AS text FROM question)",
    cn="SELECT item, regexp_replace(title, '\\d', '', 'g') AS title, regexp_replace(text, '\\d', '', 'g') || CASE WHEN item % 3 = 0 THEN ' plafond 1 500 euros' ELSE '' END AS body FROM chunk"))
def numeric_evidence(spark, d):
    bare = lambda c: F.regexp_replace(c, r"\d", "")
    rows = scored_parts(spark, d).withColumn("body", F.concat(bare("body"), F.when(F.col("item") % 3 == 0, " plafond 1 500 euros").otherwise("")))
    rows = rows.withColumn("path", F.transform("path", bare)).withColumn("q", F.concat("q", F.lit(" taux 1500")))
    return rows.select("query_id", "item", F.round(passages.numeric_evidence(F.col("q"), F.col("path"), F.col("body")), 6).alias("evidence"))


@query(sql("""SELECT l.query_id, l.item, CASE WHEN l.query_id % 2 = 1 THEN 0.0 ELSE CASE WHEN l.item % 3 = 0 THEN 8.0 ELSE 0.0 END
+ CASE WHEN l.item % 5 = 0 AND l.query_id % 4 <> 2 THEN -8.0 ELSE 0.0 END + CASE WHEN l.item % 7 = 0 THEN -6.0 ELSE 0.0 END END::DOUBLE AS structural FROM lr l""", "corpus", "chunk", "question", **_LOCAL))
def structural_score(spark, d):
    item, qid = F.col("item"), F.col("query_id")
    path = F.array("path0", F.when(item % 3 == 0, "Règle générale").otherwise(""), F.when(item % 5 == 0, "Dérogations").otherwise(""))
    said = F.concat("q", F.when(qid % 2 == 0, " droit commun").otherwise(""), F.when(qid % 4 == 2, " exceptions").otherwise(""))
    rows = scored_parts(spark, d).withColumn("path0", F.get("path", F.lit(0))).withColumn("body", F.concat(F.when(item % 7 == 0, "Réponse : ").otherwise(""), "body"))
    return rows.select("query_id", "item", passages.structural(said, path, F.col("body")).alias("structural"))


_DOT = "SELECT q.query_id, v.item, v.ref, list_dot_product(q.v, v.v) AS score FROM vecq q, vec v"


@query(sql("SELECT query_id, item, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM dot) WHERE rank <= 10", "vec", "vecq", dot=_DOT))
def dense_topk(spark, d):
    return _scores(dense.nearest(vectors(spark, d).select("item", "vector"), vector_queries(spark, d), 10), "item")


@query(sql("""SELECT query_id, ref, item, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ref ORDER BY round(score, 9) DESC, item) AS o FROM dot) WHERE o = 1) WHERE rank <= 5""", "vec", "vecq", dot=_DOT))
def dense_rollup(spark, d):
    v = vectors(spark, d)
    return _scores(dense.nearest_owners(v.select("item", "vector"), vector_queries(spark, d), v.select("item", "ref"), 5), "ref", "item")


@query(sql("""SELECT query_id, item, rank AS old_rank, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, rank) AS rank FROM (SELECT r.*, c.text FROM br r JOIN corpus c ON c.item = r.item WHERE r.rank <= 16)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, rank) <= 8""", "corpus", "question", **bm25_ctes("b", DOC_ITEMS, Q), br=ranked("b")))
def rerank_stub(spark, d):
    best = postings.rank(doc_index(spark, d), asked(spark, d), 16)
    rows = dense.rerank(best.join(corpus(spark, d).select("item", "text"), "item"), F.length("text"), 8)
    return rows.select("query_id", "item", F.col("rank").cast("long").alias("old_rank"), F.col("new_rank").cast("long").alias("rank"))


# --- fusion ---

_RANKINGS = {
    **bm25_ctes("b", DOC_ITEMS, Q), "br": ranked("b"), **bm25_ctes("t", TITLE_ITEMS, Q), "tr": ranked("t"),
    "rk": "SELECT r.query_id, 'base' AS source, 0 AS src_ord, c.ref, r.score, r.rank FROM br r JOIN corpus c USING (item) WHERE rank <= 20 UNION ALL SELECT r.query_id, 'dense', 3, c.ref, r.score, r.rank FROM tr r JOIN corpus c USING (item) WHERE rank <= 20",
}


def rankings(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings of all questions: the text's as "base", the title's in the place of "dense"."""
    refs = corpus(spark, d).select("item", "ref")
    out = None
    for source, at, column in (("base", 0, "text"), ("dense", 3, "title")):
        one = postings.rank(doc_index(spark, d, column), asked(spark, d), 20).join(refs, "item")
        one = one.select("query_id", F.lit(source).alias("source"), F.lit(at).alias("src_ord"), "ref", "score", F.col("rank").cast("long").alias("rank"))
        out = one if out is None else out.unionByName(one)
    return staged(out, "rankings")


_PROFILE = {
    **_RANKINGS,
    "p0": "SELECT *, count(*) OVER w AS n, avg(score) OVER w AS m, stddev_pop(score) OVER w AS sd FROM rk WHERE rank <= 5 WINDOW w AS (PARTITION BY query_id, source)",
    "p1": "SELECT *, exp(z - max(z) OVER (PARTITION BY query_id, source)) AS e FROM (SELECT *, CASE WHEN sd <= 1e-9 THEN 0.0 ELSE (score - m) / sd END AS z FROM p0)",
    "p2": "SELECT *, e / sum(e) OVER w AS p, max(CASE WHEN rank = 1 THEN score END) OVER w AS s1, max(CASE WHEN rank = 2 THEN score END) OVER w AS s2 FROM p1 WINDOW w AS (PARTITION BY query_id, source)",
    "p3": "SELECT *, max(CASE WHEN rank = 1 THEN p END) OVER (PARTITION BY query_id, source) AS top FROM p2",
    "pf": """SELECT query_id, source, ref, rank, p AS probability,
      CASE WHEN n = 1 THEN 1.0 ELSE least(1.0, greatest(0.0, (p - 1.0 / n) / greatest(1e-9, top - 1.0 / n))) END AS strength,
      CASE WHEN n = 1 THEN 1.0 ELSE least(1.0, 0.25 * greatest(0.0, (top - 1.0 / n) / greatest(1e-9, 1 - 1.0 / n)) + 0.75 * greatest(0.0, (s1 - s2) / greatest(1e-9, abs(s1)))) END AS confidence FROM p3""",
}


@query(sql("SELECT query_id, source, ref, rank, round(probability, 6) AS probability, round(strength, 6) AS strength, round(confidence, 6) AS confidence FROM pf", "corpus", "question", **_PROFILE))
def rank_profiles(spark, d):
    r6 = [F.round(c, 6).alias(c) for c in ("probability", "strength", "confidence")]
    return fusion.profiles(rankings(spark, d)).select("query_id", "source", "ref", "rank", *r6)


def _fuse_sql(part: str, k: int) -> dict[str, str]:
    return {
        "fs": f"SELECT query_id, ref, source, sum(part) AS part, max(rank) AS rank, min(src_ord * 1000 + rank) AS o FROM ({part}) GROUP BY query_id, ref, source",
        "ff": "SELECT query_id, ref, sum(part) AS score, string_agg(source, ',' ORDER BY source) AS sources, string_agg(source || ':' || rank, ',' ORDER BY source) AS ranks, min(o) AS o FROM fs GROUP BY query_id, ref",
        "fr": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, o) AS rank FROM ff) WHERE rank <= {k}",
    }


_FUSED = "SELECT query_id, rank, ref, round(score, 9) AS score, sources, ranks FROM fr"


def _fused(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "ref", F.round("score", 9).alias("score"), "sources", "ranks")


@query(sql(_FUSED, "corpus", "question", **_RANKINGS, **_fuse_sql("SELECT *, 1.0 / (60 + rank) AS part FROM rk", 5)))
def rrf(spark, d):
    return _fused(fusion.reciprocal_rank(rankings(spark, d)))


@query(sql(_FUSED, "corpus", "question", **_RANKINGS, **_fuse_sql("SELECT *, CASE source WHEN 'base' THEN 2.0 ELSE 1.0 END / (60 + rank) AS part FROM rk", 5)))
def rrf_weighted(spark, d):
    return _fused(fusion.reciprocal_rank(rankings(spark, d), weights={"base": 2.0}))


_CW = """SELECT r.*, CASE r.source WHEN 'base' THEN 0.5 ELSE 2.0 END * (1 + coalesce(c.confidence, 0)) * (1 + 0.5 * coalesce(s.strength, 0)) / (60 + r.rank) AS part FROM rk r
LEFT JOIN (SELECT query_id, source, ref, min(strength) AS strength FROM pf GROUP BY ALL) s ON s.query_id = r.query_id AND s.source = r.source AND s.ref = r.ref
LEFT JOIN (SELECT query_id, source, max(confidence) AS confidence FROM pf GROUP BY ALL) c ON c.query_id = r.query_id AND c.source = r.source"""


@query(sql(_FUSED, "corpus", "question", **_PROFILE, **_fuse_sql(_CW, 20)))
def cw_rrf(spark, d):
    return _fused(fusion.confidence_weighted(rankings(spark, d), 20, weights=fusion.WEIGHTS))


@query(sql("SELECT query_id, source, ref, rank FROM rk r WHERE source = 'dense' OR EXISTS (SELECT 1 FROM rk a WHERE a.source = 'dense' AND a.query_id = r.query_id AND a.ref = r.ref)", "corpus", "question", **_RANKINGS))
def anchor_filter(spark, d):
    return fusion.anchored(rankings(spark, d)).select("query_id", "source", "ref", "rank")


_EXACT_Q = "SELECT query_id, text || ' BOI-EN-SRC' || (query_id % 20) || ' and boi-fr-src' || (query_id % 7) AS text FROM question"


def exact_questions(spark: SparkSession, d: str) -> DataFrame:
    """The questions, each with two references in it."""
    tail = F.concat(F.lit(" BOI-EN-SRC"), F.col("query_id") % 20, F.lit(" and boi-fr-src"), F.col("query_id") % 7)
    return questions(spark, d).withColumn("text", F.concat("text", tail))


_OVERLAP = "(len(list_intersect(list_distinct({q}t), list_distinct(e.dt))) + 2 * len(list_intersect(list_distinct({q}b), list_distinct(e.db))))"
_DOCX = {"d0": f"SELECT item, ref, {_TERMS.format(x=tok('search'))} AS dt FROM (SELECT item, ref, concat_ws(' ', ref, nullif(title, ''), lang, source) AS search FROM corpus)", "dx": "SELECT *, " + _BI.format(x="dt") + " AS db FROM d0"}
_EXACT = {
    "eq": _EXACT_Q, "q0": f"SELECT query_id, {_TERMS.format(x=tok('text'))} AS qt FROM eq", "qx": "SELECT *, " + _BI.format(x="qt") + " AS qb FROM q0", **_DOCX,
    "target": "SELECT query_id, 'EN-SRC' || (query_id % 20) AS t, 1 AS o FROM question UNION ALL SELECT query_id, 'FR-SRC' || (query_id % 7), 2 FROM question",
    "cand": "SELECT t.query_id, e.ref, arg_min(len(string_split(e.ref, '-')) - 1 - len(string_split(t.t, '-')), t.o) AS extra, any_value(e.item) AS item FROM target t JOIN dx e ON starts_with(e.ref, 'BOI-' || t.t || '-') OR e.ref = 'BOI-' || t.t GROUP BY t.query_id, e.ref",
    "sc": "SELECT c.query_id, c.ref, CASE WHEN c.extra = 0 THEN 120.0 ELSE 105.0 - least(c.extra, 6) END + least(30.0, " + _OVERLAP.format(q="q.q") + ") AS score FROM cand c JOIN dx e ON e.item = c.item JOIN qx q ON q.query_id = c.query_id",
    "xr": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY -score, ref) AS rank FROM sc) WHERE rank <= 20",
}


def doc_texts(spark: SparkSession, d: str) -> DataFrame:
    """``ref, text``: what a document is scored by in exact and prefix rankings."""
    return corpus(spark, d).select("ref", F.concat_ws(" ", "ref", F.nullif("title", F.lit("")), "lang", "source").alias("text"))


def _ranks(df: DataFrame) -> DataFrame:
    return df.select("query_id", "ref", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(sql("SELECT query_id, ref, round(score::DOUBLE, 6) AS score, rank FROM xr", "corpus", "question", **_EXACT))
def exact_reference_rank(spark, d):
    return _ranks(references.exact_ranking(exact_questions(spark, d), doc_texts(spark, d)))


_PREFIX = {
    "q0": f"SELECT query_id, {_TERMS.format(x=tok('text'))} AS qt, 'EN-SRC' || (query_id % 20) AS prefix FROM question", "qx": "SELECT *, " + _BI.format(x="qt") + " AS qb FROM q0", **_DOCX,
    "sc": "SELECT q.query_id, e.ref, least(30.0, " + _OVERLAP.format(q="q.q") + ") AS ov, (CASE WHEN split_part(e.ref, '-', 3) = split_part(q.prefix, '-', 2) THEN 2 ELSE 1 END) AS depth FROM qx q JOIN dx e ON starts_with(e.ref, 'BOI-' || q.prefix)",
    "xr": "SELECT * FROM (SELECT query_id, ref, ov + 0.25 * depth AS score, row_number() OVER (PARTITION BY query_id ORDER BY -(ov + 0.25 * depth), ref) AS rank FROM sc WHERE ov > 0) WHERE rank <= 20",
}


@query(sql("SELECT query_id, ref, round(score::DOUBLE, 6) AS score, rank FROM xr", "corpus", "question", **_PREFIX))
def prefix_overlap_rank(spark, d):
    q = questions(spark, d).withColumn("prefix", F.concat(F.lit("EN-SRC"), F.col("query_id") % 20))
    return _ranks(references.prefix_ranking(q, doc_texts(spark, d)))


@query(sql("""SELECT query_id, ref, row_number() OVER (PARTITION BY query_id ORDER BY p, rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ref ORDER BY p, rank) AS o
FROM (SELECT query_id, ref, rank, 0 AS p FROM rk WHERE source = 'dense' AND rank <= 3 UNION ALL SELECT query_id, ref, rank, 1 FROM fr)) WHERE o = 1""", "corpus", "question", **_RANKINGS, **_fuse_sql("SELECT *, 1.0 / (60 + rank) AS part FROM rk", 5)))
def prepend_ranked(spark, d):
    r = rankings(spark, d)
    rows = fusion.prepended(r.filter("source = 'dense' and rank <= 3"), fusion.reciprocal_rank(r))
    return rows.select("query_id", "ref", F.col("rank").cast("long").alias("rank"))


# --- passages ---


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as passages, ``item, ref, path, legal, text``: a table, as they are read many times."""
    return staged(chunks(spark, d).select("item", "ref", F.array("title").alias("path"), no_legal().alias("legal"), "text"), "parts")


_FULL_ITEMS = f"SELECT ref, item, {tok('ref || chr(10) || title || chr(10) || text')} AS toks FROM chunk"
_DIRECT = {
    **_TOP_DOCS, **bm25_ctes("l", _FULL_ITEMS, Q, "ref", "SELECT query_id, ref FROM top"), "lr": ranked("l", "ref"), **_EV,
    "num": f"""SELECT l.query_id, l.item, CASE WHEN regexp_matches(strip_accents({n('q.text')}), {_INTENT}, 'i') THEN 1 ELSE 0 END AS asks FROM lr l JOIN question q ON q.query_id = l.query_id""",
    "pr": "SELECT l.query_id, l.ref, l.item, l.score, row_number() OVER (PARTITION BY l.query_id, l.ref ORDER BY round(l.score + 2 * e.evidence, 9) DESC, l.rank, l.item) AS local_rank FROM lr l JOIN ev e ON e.query_id = l.query_id AND e.item = l.item",
    "hit": "SELECT p.*, t.doc_rank FROM pr p JOIN top t ON t.query_id = p.query_id AND t.ref = p.ref WHERE local_rank <= 2",
}
_PLAIN_ORDER = "row_number() OVER (PARTITION BY query_id ORDER BY local_rank, doc_rank, round(score, 9) DESC, item)"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("global_rank").cast("long").alias("rank"), F.col("document_rank").cast("long").alias("doc_rank"), F.col("local_rank").cast("long").alias("local_rank"), "ref", "item", F.round("local_score", 6).alias("score"))


@query(sql(f"SELECT query_id, rank, doc_rank, local_rank, ref, item, round(score, 6) AS score FROM (SELECT *, {_PLAIN_ORDER} AS rank FROM hit) WHERE rank <= 6", "corpus", "chunk", "question", **_DIRECT))
def direct_passages(spark, d):
    stage1 = top_docs(spark, d).withColumnRenamed("doc_rank", "rank")
    return _hits(passages.direct_search(questions(spark, d), stage1, parts(spark, d)))


_NAMED_Q = "SELECT query_id, text || ' voir BOI-EN-SRC' || (query_id % 20) || '-' || (query_id % 3) AS text FROM question"
_FOLLOW = {
    **_TOP_DOCS, "nq": _NAMED_Q,
    "named": "SELECT query_id, 'BOI-EN-SRC' || (query_id % 20) || '-' || (query_id % 3) AS cited FROM question",
    "fol": "SELECT n.query_id, c.ref, row_number() OVER (PARTITION BY n.query_id ORDER BY c.ref) - 1 AS doc_rank FROM named n JOIN (SELECT DISTINCT ref FROM chunk) c ON c.ref = n.cited OR starts_with(c.ref, n.cited || '-')",
    **bm25_ctes("l", _FULL_ITEMS, f"SELECT query_id, {tok('text')} AS toks FROM nq", "ref", "SELECT query_id, ref FROM top UNION SELECT query_id, ref FROM fol"), "lr": ranked("l", "ref"),
    **_EV, "qs0": _EV["qs0"].replace("FROM question", "FROM nq"), "pr": _DIRECT["pr"],
    "hit": "SELECT p.*, t.doc_rank, 0 AS phase FROM pr p JOIN top t ON t.query_id = p.query_id AND t.ref = p.ref WHERE local_rank <= 2 UNION ALL SELECT p.*, f.doc_rank, 1 FROM pr p JOIN fol f ON f.query_id = p.query_id AND f.ref = p.ref WHERE local_rank <= 2",
    "once": "SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY query_id, item ORDER BY phase) = 1",
}


@query(sql(f"SELECT query_id, rank, doc_rank, local_rank, ref, item, round(score, 6) AS score FROM (SELECT *, {_PLAIN_ORDER} AS rank FROM once) WHERE rank <= 40", "corpus", "chunk", "question", **_FOLLOW))
def follow_references(spark, d):
    """As ``direct_passages``, with references in the questions that are followed one hop (in the tables no text names a reference, so the SQL has none that passages cite)."""
    stage1 = top_docs(spark, d).withColumnRenamed("doc_rank", "rank")
    named = questions(spark, d).withColumn("text", F.concat("text", F.lit(" voir BOI-EN-SRC"), F.col("query_id") % 20, F.lit("-"), F.col("query_id") % 3))
    return _hits(passages.direct_search(named, stage1, parts(spark, d), most=40))


@query(sql("SELECT query_id, ref, item, overlap, global_rank AS rank FROM (SELECT o.*, row_number() OVER (PARTITION BY o.query_id ORDER BY o.rank, t.doc_rank, round(o.score, 9) DESC, o.item) AS global_rank FROM ov o JOIN top t ON t.query_id = o.query_id AND t.ref = o.ref WHERE o.rank <= 3) WHERE global_rank <= 6", "corpus", "chunk", "question", **_LOCAL,
    ov=f"SELECT l.query_id, l.ref, l.item, l.score, len(list_intersect({tok('c.text')}, {tok('q.text')}))::INT AS overlap, row_number() OVER (PARTITION BY l.query_id, l.ref ORDER BY len(list_intersect({tok('c.text')}, {tok('q.text')})) DESC, round(l.score, 9) DESC, l.rank) AS rank FROM lr l JOIN chunk c ON c.item = l.item JOIN question q ON q.query_id = l.query_id"))
def two_stage(spark, d):
    local = lexical.overlap_rerank(local_ranks(spark, d), chunk_items(spark, d).select("item", "toks"), asked(spark, d), ["query_id", "ref"])
    rows = passages.two_stage(top_docs(spark, d), local)
    return rows.select("query_id", "ref", "item", "overlap", F.col("global_rank").cast("long").alias("rank"))


@query(sql("SELECT query_id, rank, ref, item, round(score, 6) AS score FROM (SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY round(p.score, 9) DESC, t.doc_rank, p.local_rank, p.item) AS rank FROM pr p JOIN top t ON t.query_id = p.query_id AND t.ref = p.ref WHERE p.local_rank <= 8) WHERE rank <= 8", "corpus", "chunk", "question", **_DIRECT))
def intra_document(spark, d):
    wanted = top_docs(spark, d).select("query_id", "ref", F.col("doc_rank").alias("rank"))
    rows = passages.intra_document(questions(spark, d), wanted, parts(spark, d))
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "ref", "item", F.round("local_score", 6).alias("score"))


@query()
def diverse_selection(spark, d):
    """Eight of the sixteen best passages of each question, spread over documents and sections."""
    stage1 = top_docs(spark, d).withColumnRenamed("doc_rank", "rank")
    hits = passages.direct_search(questions(spark, d), stage1, parts(spark, d), per_doc=8, most=16)
    pool = hits.join(parts(spark, d).select("item", "path"), "item").select("query_id", F.col("global_rank").alias("rank"), "ref", "path", "item", F.col("local_score").alias("score"))
    return passages.diverse(pool)


def whole_corpus(spark: SparkSession, d: str) -> runtime.Corpus:
    c = corpus(spark, d)
    search = F.concat_ws("\n", "ref", "title", F.concat_ws(" ", "lang", "source"))
    docs = c.select("item", "ref", "title", F.concat_ws("\n", search, "text").alias("base"), F.concat_ws("\n", search, t.first_sentence(F.col("text"))).alias("leads"), search.alias("score_text"))
    return runtime.Corpus(docs, parts(spark, d))


_SNIP = "left(CASE WHEN contains(x, '. ') THEN split_part(x, '. ', 1) WHEN contains(x, ' ; ') THEN split_part(x, ' ; ', 1) WHEN contains(x, ' : ') THEN split_part(x, ' : ', 1) ELSE x END, 220)"
_SEARCHED = "concat_ws(chr(10), ref, title, concat_ws(' ', lang, source), {})"
_SOURCES = {
    **bm25_ctes("b", f"SELECT item, {tok(_SEARCHED.format('text'))} AS toks FROM corpus", Q), "br": ranked("b"),
    **bm25_ctes("t", f"SELECT item, {tok(_SEARCHED.format(_SNIP))} AS toks FROM (SELECT item, ref, title, lang, source, {n('text')} AS x FROM corpus)", Q), "tr": ranked("t"),
    "rk": "SELECT r.query_id, 'base' AS source, 0 AS src_ord, c.ref, r.score, r.rank FROM br r JOIN corpus c USING (item) WHERE rank <= 20 UNION ALL SELECT r.query_id, 'sections_leads', 1, c.ref, r.score, r.rank FROM tr r JOIN corpus c USING (item) WHERE rank <= 20",
    **{k: _PROFILE[k] for k in ("p0", "p1", "p2", "p3", "pf")},
}
_RUNTIME = {
    **_SOURCES, **_fuse_sql(_CW.replace("THEN 0.5 ELSE 2.0 END", "THEN 0.5 ELSE 0.5 END"), 20), "top": "SELECT query_id, ref, rank AS doc_rank FROM fr WHERE rank <= 8",
    **bm25_ctes("l", _FULL_ITEMS, Q, "ref", "SELECT query_id, ref FROM top"), "lr": ranked("l", "ref"), **_EV, "pr": _DIRECT["pr"], "hit": _DIRECT["hit"].replace("local_rank <= 2", "local_rank <= 8"),
}
#: The prefix's source: overlap with what a document is scored by, and with the best of its chunks, 30 at most.
_PREFIXED = {
    **{k: x for k, x in _SOURCES.items() if k not in ("p0", "p1", "p2", "p3", "pf")},
    "q0": _PREFIX["q0"], "qx": _PREFIX["qx"], **_DOCX, "c0": f"SELECT ref, {_TERMS.format(x=tok('text'))} AS dt FROM chunk", "cx": "SELECT *, " + _BI.format(x="dt") + " AS db FROM c0",
    "dov": "SELECT q.query_id, e.ref, " + _OVERLAP.format(q="q.q") + " AS d, (CASE WHEN split_part(e.ref, '-', 3) = split_part(q.prefix, '-', 2) THEN 2 ELSE 1 END) AS depth FROM qx q JOIN dx e ON starts_with(e.ref, 'BOI-' || q.prefix)",
    "cov": "SELECT q.query_id, e.ref, max(" + _OVERLAP.format(q="q.q") + ") AS c FROM qx q JOIN cx e ON starts_with(e.ref, 'BOI-' || q.prefix) GROUP BY ALL",
    "sc": "SELECT d.query_id, d.ref, least(30.0, d.d + coalesce(c.c, 0)) AS ov, d.depth FROM dov d LEFT JOIN cov c ON c.query_id = d.query_id AND c.ref = d.ref", "xr": _PREFIX["xr"],
    "rk2": "SELECT * FROM rk UNION ALL SELECT query_id, 'prefix_overlap', 6, ref, score::DOUBLE, rank FROM xr WHERE rank <= 20",
    **{k: _PROFILE[k].replace("FROM rk ", "FROM rk2 ") for k in ("p0", "p1", "p2", "p3", "pf")},
    **_fuse_sql(_CW.replace("FROM rk r", "FROM rk2 r").replace("CASE r.source WHEN 'base' THEN 0.5 ELSE 2.0 END", "CASE r.source WHEN 'prefix_overlap' THEN 2.0 ELSE 0.5 END"), 20),
}


def _found(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "ref", "item", F.round("score", 6).alias("score"))


@query(sql(f"SELECT query_id, rank, ref, item, round(score, 6) AS score FROM (SELECT *, {_PLAIN_ORDER} AS rank FROM hit) WHERE rank <= 8", "corpus", "chunk", "question", **_RUNTIME))
def retrieve(spark, d):
    """The whole runtime over all questions: final passages."""
    _, found = runtime.retrieve(whole_corpus(spark, d), questions(spark, d))
    return _found(found)


@query()
def retrieve_reranked(spark, d):
    """The whole runtime with a stand-in for the reranker (common tokens) and diverse selection."""
    reranker = F.size(F.array_intersect(t.tokens(F.col("question")), t.tokens(F.col("passage")))).cast("double")
    _, found = runtime.retrieve(whole_corpus(spark, d), questions(spark, d), reranker=reranker)
    return found


@query()
def retrieve_older(spark, d):
    """The older generation's whole retrieval over all questions, with acronyms spelled out: final passages."""
    mapping = staged(references.acronym_map(acronym_views(spark, d), ratio=1.0), "acronyms")
    q = questions(spark, d).withColumn("text", F.concat(F.lit("TOA et TIA "), "text"))
    _, _, found, _ = runtime.retrieve_older(whole_corpus(spark, d), q, mapping)
    return found


@query(sql("SELECT query_id, rank, ref, round(score, 9) AS score FROM fr WHERE rank <= 8", "corpus", "chunk", "question", **_PREFIXED))
def retrieve_stage1(spark, d):
    """The documents that the runtime finds first, with a prefix for every question."""
    q = questions(spark, d).withColumn("prefix", F.concat(F.lit("EN-SRC"), F.col("query_id") % 20))
    found = runtime.stage1(whole_corpus(spark, d), q, runtime.Options())
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "ref", F.round("score", 9).alias("score"))


# --- reference tree ---

_CORES = {
    "core": "SELECT ref, string_split(ref, '-') AS c FROM corpus",
    "pre": "SELECT ref, len(c) AS depth, c[1:i] AS p FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM core)",
    "cnt": "SELECT p, count(*) AS n FROM pre GROUP BY p",
}


@query(sql("SELECT c.ref, greatest(0, coalesce(n.n, 1) - 1) AS descendants FROM core c LEFT JOIN cnt n ON n.p = c.c AND len(c.c) >= 4", "corpus", **_CORES))
def descendant_counts(spark, d):
    return references.descendant_counts(corpus(spark, d))


@query(sql("SELECT array_to_string(p, '-') AS prefix, n FROM cnt WHERE len(p) >= 2", "corpus", **_CORES))
def prefix_counts(spark, d):
    return references.prefix_counts(corpus(spark, d), 2).select(F.array_join("prefix", "-").alias("prefix"), "n")


_FAMILY = {
    **_CORES,
    "fam": "SELECT b.ref, coalesce(max(CASE WHEN n.n > 1 AND n.n <= 25 AND (len(b.p) = b.depth OR len(b.p) >= 3) THEN len(b.p) END), max(b.depth)) AS len FROM pre b JOIN cnt n ON n.p = b.p GROUP BY b.ref",
    "mem": "SELECT f.ref, array_to_string(b.p, '-') AS prefix, b.ref AS member, row_number() OVER (PARTITION BY f.ref ORDER BY b.depth, b.ref) AS place FROM fam f JOIN core c ON c.ref = f.ref JOIN pre b ON b.p = c.c[1:f.len]",
}


@query(sql("SELECT * FROM mem", "corpus", **_FAMILY))
def family_selection(spark, d):
    c = corpus(spark, d)
    rows = references.family_members(references.family_prefixes(c, c, least=3), c)
    return rows.select("ref", F.array_join("prefix", "-").alias("prefix"), "member", F.col("place").cast("long").alias("place"))


@query(sql("""SELECT query_id, member, row_number() OVER (PARTITION BY query_id ORDER BY o) AS place FROM (SELECT t.query_id, m.member, min(t.doc_rank * 1000000 + m.place) AS o
FROM top t JOIN mem m ON m.ref = t.ref WHERE t.doc_rank <= 2 GROUP BY t.query_id, m.member)""", "corpus", "question", **_TOP_DOCS, **_FAMILY))
def family_union(spark, d):
    hits = top_docs(spark, d).select("query_id", "ref", F.col("doc_rank").alias("rank"))
    return references.family_union(hits, corpus(spark, d), least=3).withColumn("place", F.col("place").cast("long"))


_GUIDED = {
    **_TOP_DOCS, **_FAMILY,
    "un": "SELECT t.query_id, m.member AS ref FROM top t JOIN mem m ON m.ref = t.ref WHERE t.doc_rank <= 1 GROUP BY ALL",
    **bm25_ctes("g", f"SELECT u.query_id AS fam_id, c.item, {tok('c.text')} AS toks FROM un u JOIN corpus c ON c.ref = u.ref", Q, "fam_id", "SELECT DISTINCT query_id, query_id AS fam_id FROM un"), "gr": ranked("g", "fam_id"),
    "g1": "SELECT g.query_id, c.ref, g.score, g.rank, min(g.score) OVER w AS lo, max(g.score) OVER w AS hi FROM gr g JOIN corpus c ON c.item = g.item WINDOW w AS (PARTITION BY g.query_id)",
    "g2": "SELECT g.query_id, g.ref, g.rank AS family_rank, t.doc_rank AS prior_rank, CASE WHEN hi - lo > 1e-9 THEN (score - lo) / (hi - lo) ELSE 1.0 END + 1.0 / (20 + g.rank) + coalesce(0.25 / (20 + t.doc_rank), 0) AS combined FROM g1 g LEFT JOIN top t ON t.query_id = g.query_id AND t.ref = g.ref",
}


@query(sql("SELECT query_id, ref, round(combined, 6) AS combined, family_rank, prior_rank, row_number() OVER (PARTITION BY query_id ORDER BY round(combined, 9) DESC, family_rank, coalesce(prior_rank, 9999), ref) AS rank FROM g2", "corpus", "question", **_GUIDED))
def family_guided(spark, d):
    hits = top_docs(spark, d).select("query_id", "ref", F.col("doc_rank").alias("rank"))
    c = corpus(spark, d)
    union = references.family_union(hits, c, top=1, least=3)
    items = doc_items(spark, d).join(union.select("query_id", F.col("member").alias("ref")), "ref").select(F.col("query_id").alias("family"), "item", "toks")
    pairs = union.select("query_id", F.col("query_id").alias("family")).distinct()
    ranks = lexical.rank(items, asked(spark, d), None, ["family"], pairs).join(c.select("item", "ref"), "item").select("query_id", "ref", "score", "rank")
    rows = references.family_scores(ranks, hits)
    long = [F.col(x).cast("long").alias(x) for x in ("family_rank", "prior_rank", "rank")]
    return rows.select("query_id", "ref", F.round("combined", 6).alias("combined"), *long)


_SPEC = {
    **_TOP_DOCS, **_CORES,
    "fact": f"SELECT c.ref, len(k.c) AS depth, array_to_string(k.c[1:3], '-') AS stem, list_distinct(list_filter({tok('c.title')}, lambda x: NOT list_contains({tok('c.ref')}, x))) AS tail, greatest(0, coalesce(n.n, 1) - 1) AS below FROM corpus c JOIN core k ON k.ref = c.ref LEFT JOIN cnt n ON n.p = k.c AND len(k.c) >= 3",
    "h": "SELECT t.query_id, t.ref, t.doc_rank AS rank, t.doc_score AS score, f.*EXCLUDE (ref) FROM top t JOIN fact f ON f.ref = t.ref",
    "lim": "SELECT *, min(depth) OVER w AS d0, max(depth) OVER w AS d1, max(below) OVER w AS most, count(*) OVER (PARTITION BY query_id, stem) - 1 AS others FROM h WINDOW w AS (PARTITION BY query_id)",
    "bon": f"""SELECT l.*, CASE WHEN others > 0 AND depth >= 3 THEN 0.05 * greatest(0.0, CASE WHEN len(tail) > 0 THEN len(list_intersect(tail, {tok('q.text')})) / len(tail) ELSE 0.0 END
      + 0.2 * CASE WHEN d1 > d0 THEN (depth - d0) / (d1 - d0) ELSE 0.0 END - 0.35 * CASE WHEN most > 0 THEN below / most ELSE 0.0 END) ELSE 0.0 END AS bonus FROM lim l JOIN question q ON q.query_id = l.query_id""",
}


@query(sql("SELECT query_id, ref, round(score + bonus, 6) AS score, round(bonus, 6) AS bonus, row_number() OVER (PARTITION BY query_id ORDER BY round(score + bonus, 9) DESC, round(bonus, 9) DESC, rank) AS rank FROM bon", "corpus", "question", **_SPEC))
def specificity_rerank(spark, d):
    hits = top_docs(spark, d).select("query_id", "ref", F.col("doc_score").alias("score"), F.col("doc_rank").alias("rank"))
    docs = corpus(spark, d).select("ref", F.col("title").alias("tail"))
    rows = references.specificity(hits, docs, questions(spark, d), least=3)
    return rows.select("query_id", "ref", F.round("score", 6).alias("score"), F.round("bonus", 6).alias("bonus"), F.col("rank").cast("long").alias("rank"))


def acronym_views(spark: SparkSession, d: str) -> DataFrame:
    """Every whole paragraph, with the initials of its first three words, if it has three, as an acronym before it: something to spell out."""
    p = paragraphs_of_corpus(spark, d)
    words = F.slice(F.filter(F.split(t.folded(F.col("text")), " "), lambda w: w.rlike("^[a-z]{3,}$")), 1, 3)
    rows = p.select("ref", "text", words.alias("w"))
    initials = F.array_join(F.transform("w", lambda w: F.upper(F.left(w, F.lit(1)))), "")
    return rows.select("ref", F.concat_ws(": ", F.when(F.size("w") == 3, initials), "text").alias("text"))


def paragraphs_of_corpus(spark: SparkSession, d: str) -> DataFrame:
    from corpusmill.plans.tables import paragraphs

    return paragraphs(spark, d)


#: A letter beyond ASCII is part of a word, but of no acronym.
_ASCII = "regexp_replace({}, '[\\x{{AA}}\\x{{B5}}\\x{{BA}}\\x{{C0}}-\\x{{D6}}\\x{{D8}}-\\x{{F6}}\\x{{F8}}-\\x{{2FF}}\\x{{370}}-\\x{{1FFF}}\\x{{3040}}-\\x{{D7FF}}]', '_', 'g')"
_FUNCTION = "[" + ", ".join(f"'{w}'" for w in references.FUNCTION_WORDS) + "]"
_ACRONYMS = {
    "av": f"SELECT ref, CASE WHEN len(w) = 3 THEN upper(left(w[1], 1) || left(w[2], 1) || left(w[3], 1)) || ': ' || text ELSE text END AS text FROM (SELECT ref, text, list_filter(string_split({f('text')}, ' '), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))[1:3] AS w FROM para)",
    "used": f"SELECT DISTINCT ref, a FROM (SELECT ref, unnest(regexp_extract_all({_ASCII.format('text')}, '\\b[A-Z]{{2,6}}(?:\\s?[0-9])?\\b')) AS a FROM av) WHERE NOT list_contains({_FUNCTION}, lower(a))",
    "mine": "SELECT ref, list(a) AS mine FROM used WHERE a IN (SELECT a FROM used GROUP BY a HAVING count(*) BETWEEN 2 AND 500) GROUP BY ref",
    "seg": f"SELECT mine, unnest(string_split_regex({n('text')}, '\\s+-\\s+|\\s*:\\s*|\\(|\\)|;|,')) AS s FROM av JOIN mine USING (ref)",
    "wd": f"SELECT mine, list_filter(regexp_extract_all(replace({f('s')}, chr(39), ' '), '[A-Za-zÀ-ÿ0-9]+'), lambda w: NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains({_FUNCTION}, w)) AS w FROM seg",
    "ph": "SELECT mine, w, s, unnest(range(2, least(6, len(w) - s + 1) + 1)) AS k FROM (SELECT mine, w, unnest(range(1, len(w))) AS s FROM wd WHERE len(w) >= 2)",
    "cand": "SELECT array_to_string(list_transform(w[s : s + k - 1], lambda x: upper(regexp_extract(x, '^([a-z])', 1))), '') AS acronym, array_to_string(w[s : s + k - 1], ' ') AS phrase, mine FROM ph",
    "amap": "SELECT * FROM (SELECT acronym, phrase, count(*) AS support FROM cand WHERE length(acronym) BETWEEN 2 AND 6 AND list_contains(mine, acronym) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY acronym ORDER BY support DESC, phrase) = 1",
}
_EXPANDED = {
    **_ACRONYMS, "tq": "SELECT query_id, 'TOA et TIA ' || text AS text FROM question",
    "tw": f"SELECT query_id, folded, w, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT query_id, {f('text')} AS folded, regexp_extract_all({_ASCII.format(n('text'))}, '\\b[A-Za-z]{{2,6}}(?:\\s?[0-9])?\\b') AS w FROM tq)",
    "tm": "SELECT t.query_id, m.phrase, min(t.pos) AS pos FROM tw t JOIN amap m ON m.acronym = upper(t.w[t.pos]) AND m.support >= 2 WHERE NOT contains(t.folded, m.phrase) GROUP BY t.query_id, m.phrase",
    "tp": "SELECT query_id, string_agg(phrase, ' ' ORDER BY pos, phrase) AS more FROM (SELECT * FROM tm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos, phrase) <= 3) GROUP BY query_id",
}


@query(sql("SELECT acronym, phrase, support FROM amap WHERE support >= 2", "para", **_ACRONYMS))
def acronym_map(spark, d):
    return references.acronym_map(acronym_views(spark, d), ratio=1.0)


@query(sql(f"SELECT q.query_id, concat_ws(' ', {n('q.text')}, p.more) AS expanded FROM tq q LEFT JOIN tp p ON p.query_id = q.query_id", "para", "question", **_EXPANDED))
def acronym_expand(spark, d):
    mapping = references.acronym_map(acronym_views(spark, d), ratio=1.0)
    q = questions(spark, d).withColumn("text", F.concat(F.lit("TOA et TIA "), "text"))
    return references.expand_queries(q, mapping).select("query_id", "expanded")


@query("""WITH r AS (SELECT doc_id AS item, 'BOI-' || upper(lang) || '-' || upper(source) || CASE WHEN doc_id % 2 = 0 THEN '-20240115' ELSE '' END AS ref FROM documents)
SELECT item, (replace(ref, '-20240115', '') = 'BOI-EN-SRC1' OR starts_with(ref, 'BOI-EN-SRC1-') AND ref <> 'BOI-EN-SRC1-20240115' OR replace(ref, '-20240115', '') IN ('BOI', 'BOI-EN')) AS matches FROM r""")
def family_match_join(spark, d):
    ref = F.concat(F.lit("BOI-"), F.upper("lang"), F.lit("-"), F.upper("source"), F.when(F.col("item") % 2 == 0, "-20240115").otherwise(""))
    return corpus(spark, d).select("item", t.family_match(ref, F.lit("BOI-EN-SRC1-20230101")).alias("matches"))
