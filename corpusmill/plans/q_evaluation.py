"""Queries of metrics, verdicts, summaries, checks and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import evaluation as ev
from corpusmill.operators import patterns, sampling
from corpusmill.plans.q_retrieval import _RANKINGS, rankings
from corpusmill.plans.registry import query
from corpusmill.plans.tables import chunks, corpus, questions, sql, table

# Gold of a question: the documents that hold its text. Retrieved: the "base" ranking.
_GOLD = {**_RANKINGS, "gold": "SELECT q.query_id, c.ref FROM question q JOIN corpus c ON contains(c.text, q.text)", "rel": "SELECT r.query_id, r.rank, CASE WHEN g.ref IS NULL THEN 0 ELSE 1 END AS rel FROM rk r LEFT JOIN (SELECT DISTINCT * FROM gold) g ON g.query_id = r.query_id AND g.ref = r.ref WHERE r.source = 'base'"}


def golds(spark: SparkSession, d: str) -> DataFrame:
    asked = questions(spark, d).select("query_id", F.col("text").alias("pattern"))
    return patterns.occurrences(corpus(spark, d), asked, "ref").join(asked, "pattern").select("query_id", F.col("ref").alias("id"))


def retrieved(spark: SparkSession, d: str) -> DataFrame:
    return rankings(spark, d).filter("source = 'base'").select("query_id", "rank", F.col("ref").alias("id"))


def _metric(spark: SparkSession, d: str, name: str) -> DataFrame:
    m = ev.metrics(questions(spark, d), retrieved(spark, d), golds(spark, d))
    return m.filter(F.col("metric") == name).select("k", F.round("value", 6).alias("value"))


_N = "(SELECT count(*) FROM question)"


@query(sql(f"SELECT k::INT AS k, round((SELECT count(DISTINCT query_id) FROM rel WHERE rel = 1 AND rank <= k) / {_N}, 6)::DOUBLE AS value FROM (VALUES (1), (3), (5), (8)) v(k)", "corpus", "question", **_GOLD))
def hit_at_k(spark, d):
    return _metric(spark, d, "hit")


@query(sql(f"SELECT 0 AS k, round(coalesce(sum(1.0 / r), 0) / {_N}, 6)::DOUBLE AS value FROM (SELECT query_id, min(rank) AS r FROM rel WHERE rel = 1 AND rank <= 8 GROUP BY query_id)", "corpus", "question", **_GOLD))
def mrr(spark, d):
    return _metric(spark, d, "mrr")


@query(sql(f"""SELECT k::INT AS k, round(coalesce(sum(dcg / idcg), 0) / {_N}, 6)::DOUBLE AS value FROM (SELECT k, query_id, sum(1 / log2(rank + 1)) AS dcg, list_sum(list_transform(range(1, count(*) + 1), lambda i: 1 / log2(i + 1))) AS idcg
FROM rel, (VALUES (1), (3), (5), (8)) v(k) WHERE rel = 1 AND rank <= k GROUP BY k, query_id) GROUP BY k""", "corpus", "question", **_GOLD))
def ndcg_at_k(spark, d):
    return _metric(spark, d, "ndcg")


_LAYERED = {**_GOLD, "lay": "SELECT q.query_id, l.layer, l.o, (SELECT min(r.rank) FROM rk r JOIN gold g ON g.query_id = r.query_id AND g.ref = r.ref WHERE r.source = l.layer AND r.query_id = q.query_id AND r.rank <= 8) AS rank, (SELECT count(*) FROM gold g WHERE g.query_id = q.query_id) AS n FROM question q, (VALUES ('base', 1), ('dense', 2)) l(layer, o)"}


@query(sql("SELECT query_id, layer, rank, arg_min(CASE WHEN n > 0 AND rank IS NULL THEN layer END, CASE WHEN n > 0 AND rank IS NULL THEN o END) OVER (PARTITION BY query_id) AS first_miss FROM lay", "corpus", "question", **_LAYERED))
def layered_eval(spark, d):
    r = rankings(spark, d).select("query_id", F.col("source").alias("layer"), "rank", F.col("ref").alias("id"))
    g = golds(spark, d).select("query_id", F.explode(F.array(F.lit("base"), F.lit("dense"))).alias("layer"), "id")
    return ev.layered(questions(spark, d), r, g, ["base", "dense"])


@query(sql("SELECT 'base->dense' AS step, count(*) AS misses FROM lay a JOIN lay b ON b.query_id = a.query_id WHERE a.layer = 'base' AND b.layer = 'dense' AND a.rank IS NOT NULL AND b.rank IS NULL AND b.n > 0 HAVING count(*) > 0", "corpus", "question", **_LAYERED))
def layer_transitions(spark, d):
    r = rankings(spark, d).select("query_id", F.col("source").alias("layer"), "rank", F.col("ref").alias("id"))
    g = golds(spark, d).select("query_id", F.explode(F.array(F.lit("base"), F.lit("dense"))).alias("layer"), "id")
    return ev.transitions(ev.layered(questions(spark, d), r, g, ["base", "dense"]), g, ["base", "dense"])


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled document as an evaluated answer."""
    x = table(spark, d, "labels")
    i = F.col("doc_id")
    return x.select(
        (i % 17 == 0).alias("error"),
        F.when(i % 17 == 0, "").when(F.col("quality") == 1, "supported").otherwise("insufficient_evidence").alias("status"),
        F.when(F.col("quality") == 1, "candidate_pass").otherwise("needs_human_review").alias("verdict"),
        F.when(i % 5 == 0, "pass").otherwise("").alias("judge"),
        F.concat(F.lit("theme"), i % 4).alias("theme"),
        ((i % 8) / 8).alias("coverage"), ((i % 4) / 4).alias("trace"), ((i % 2) / 2).alias("doc_recall"), ((i % 16) / 16).alias("answer_recall"), (i % 32).cast("double").alias("seconds"),
    )


_RUNS = "SELECT doc_id % 17 = 0 AS error, CASE WHEN doc_id % 17 = 0 THEN '' WHEN quality = 1 THEN 'supported' ELSE 'insufficient_evidence' END AS status, CASE WHEN quality = 1 THEN 'candidate_pass' ELSE 'needs_human_review' END AS verdict, CASE WHEN doc_id % 5 = 0 THEN 'pass' ELSE '' END AS judge, 'theme' || (doc_id % 4) AS theme, (doc_id % 8) / 8 AS coverage, (doc_id % 4) / 4 AS trace, (doc_id % 2) / 2 AS doc_recall, (doc_id % 16) / 16 AS answer_recall, (doc_id % 32)::DOUBLE AS seconds FROM labels"


@query(sql("""SELECT part, name, count(*) AS n, NULL::DOUBLE AS value FROM (SELECT 'answer_status' AS part, coalesce(nullif(status, ''), CASE WHEN error THEN 'error' ELSE 'unknown' END) AS name FROM runs UNION ALL SELECT 'auto_verdict', verdict FROM runs
UNION ALL SELECT 'judge_verdict', judge FROM runs WHERE judge <> '' UNION ALL SELECT 'effective_verdict', coalesce(nullif(judge, ''), verdict) FROM runs) GROUP BY part, name
UNION ALL SELECT 'mean', m.name, count(*), round_even(avg(m.v), CASE WHEN m.name = 'seconds' THEN 1 ELSE 3 END) FROM (SELECT unnest([{'name': 'coverage', 'v': coverage}, {'name': 'trace', 'v': trace}, {'name': 'doc_recall', 'v': doc_recall}, {'name': 'answer_recall', 'v': answer_recall}, {'name': 'seconds', 'v': seconds}]) AS m FROM runs WHERE NOT error) GROUP BY m.name
UNION ALL SELECT 'theme', theme || '/' || m.name, count(*), round_even(avg(m.v), 3) FROM (SELECT theme, unnest([{'name': 'coverage', 'v': coverage}, {'name': 'trace', 'v': trace}, {'name': 'doc_recall', 'v': doc_recall}, {'name': 'answer_recall', 'v': answer_recall}]) AS m FROM runs) GROUP BY theme, m.name""", runs=_RUNS))
def eval_summary(spark, d):
    return ev.summary(runs(spark, d))


@query(sql("SELECT 'documents_without_chunks' AS side, count(*) AS n, array_to_string(list_sort(list(ref))[1:10], ',') AS first FROM corpus WHERE item % 7 = 3 UNION ALL SELECT 'chunks_without_document', count(*), array_to_string(list_sort(list(ref))[1:10], ',') FROM corpus WHERE item % 11 = 5 AND item % 7 <> 3", "corpus"))
def coverage_antijoin(spark, d):
    c = chunks(spark, d).filter("doc % 7 <> 3")
    return ev.coverage_gaps(corpus(spark, d).filter("item % 11 <> 5 or item % 7 = 3"), c)


@query("SELECT 'm' || quality || toxic AS metric, count(*)::DOUBLE AS before, round(count(*) * 1.001 + toxic, 9)::DOUBLE AS after, round(abs(count(*) * 0.001 + toxic), 9)::DOUBLE AS delta, abs(count(*) * 0.001 + toxic) <= 1.0 AS within FROM labels GROUP BY quality, toxic")
def metric_drift(spark, d):
    g = table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).cast("double").alias("value"))
    g = g.select(F.concat(F.lit("m"), "quality", "toxic").alias("metric"), "value", "toxic")
    after = g.select("metric", F.round(F.col("value") * 1.001 + F.col("toxic"), 9).alias("value"))
    rows = ev.drift(g, after, 1.0)
    return rows.withColumn("delta", F.round("delta", 9))


@query(sql("SELECT query_id, query_id % 3 <> 0 AS same FROM question", "question"))
def order_match(spark, d):
    r = retrieved(spark, d)
    other = r.withColumn("rank", F.when((F.col("query_id") % 3 == 0) & (F.col("rank") == 1), 99).otherwise(F.col("rank")))
    return ev.same_order(r, other)


@query("SELECT conv_id AS query_id, concat_ws('; ', CASE WHEN sum(CASE WHEN turn + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END <> r THEN 1 ELSE 0 END) > 0 THEN 'citation ids are not contiguous' END, CASE WHEN count(*) <> count(DISTINCT text) THEN 'chunk ids repeat' END, CASE WHEN sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) > 0 THEN 'blank text' END) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY conv_id")
def payload_validation(spark, d):
    c = table(spark, d, "conversations")
    n = F.col("turn") + F.when(F.col("conv_id") % 5 == 0, 1).otherwise(0)
    return ev.payload_errors(c.select(F.col("conv_id").alias("query_id"), n.alias("citation_id"), F.col("text").alias("chunk_id"), "text"))


_POINT_STOP = """['afin', 'ainsi', 'alors', 'apres', 'apprecier', 'avec', 'avant', 'cette', 'confondre', 'dans', 'dont', 'elle', 'elles', 'entre', 'etre',
'eventuel', 'eventuels', 'effet', 'effets', 'examiner', 'faut', 'indique', 'indiquee', 'leur', 'leurs', 'maniere', 'mais', 'meme', 'permettre', 'position',
'pour', 'quand', 'quelle', 'quelles', 'sans', 'selon', 'situation', 'sont', 'sous', 'suffisamment', 'tous', 'toute', 'toutes', 'verifier']"""
_POINT_WORDS = f"list_filter(string_split({{p}}, ' '), lambda w: NOT list_contains({_POINT_STOP}, w) AND (length(w) >= 3 OR regexp_matches(w, '\\d')))"
_PT = f"list_distinct(list_concat({_POINT_WORDS}, list_transform(list_filter({_POINT_WORDS}, lambda w: length(w) > 4 AND ends_with(w, 's')), lambda w: left(w, length(w) - 1))))"
# Points whose verdict hangs on the stop words, on the length rules, on ligatures and on the plural.
_POINTS = ["", "Vérifier suffisamment la situation selon leurs effets", "les des une par sur est", "Il faut examiner les taux réduits de 5 %", "Œuvres, ex æquo", "m² et ﬁscalité"]
_REPLIES = ["", "taux", "les des une", "taux reduit 5 %", "oeuvre aequo", "m2 fiscalite"]
_FOLDED = {"Vérifier suffisamment la situation selon leurs effets": "verifier suffisamment la situation selon leurs effets", "Il faut examiner les taux réduits de 5 %": "il faut examiner les taux reduits de 5 %", "Œuvres, ex æquo": "oeuvres ex aequo", "m² et ﬁscalité": "m2 et fiscalite"}
_PHRASE = "trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9%]+', ' ', 'g'))"


_CASES = " ".join(f"WHEN {i} THEN '{_FOLDED.get(p, p)}'" for i, p in enumerate(_POINTS))
_ANSWERS = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_REPLIES))


@query(sql("""SELECT conv_id, turn, kind, CASE WHEN len(e) = 0 THEN true WHEN len(e) <= 5 THEN h / len(e) >= 0.6 ELSE h / len(e) >= 0.45 AND h >= 3 END AS covered
FROM (SELECT conv_id, turn, kind, e, len(list_intersect(e, a)) AS h FROM tk)""",
nx="SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations",
said=f"SELECT conv_id, turn, k AS kind, CASE k WHEN 0 THEN text {_CASES.replace('WHEN 0 THEN', 'WHEN 99 THEN')} END AS point, coalesce(answer, '') || ' ' || CASE k {_ANSWERS} END AS answer FROM nx, range({len(_POINTS)}) r(k)",
tk="SELECT conv_id, turn, kind, " + _PT.format(p=_PHRASE.format(x="point")) + " AS e, " + _PT.format(p=_PHRASE.format(x="answer")) + " AS a FROM said"))
def answer_point_recall(spark, d):
    """Every turn as a point that the next should cover (kind 0), and made-up points that the next turn and a made-up reply should cover."""
    from pyspark.sql import Window

    c = table(spark, d, "conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    pairs = F.array(*[F.struct(F.lit(p).alias("point"), F.lit(r).alias("reply")) for p, r in zip(_POINTS, _REPLIES, strict=True)])
    c = c.select("conv_id", "turn", "text", F.coalesce("answer", F.lit("")).alias("answer"), F.posexplode(pairs).alias("kind", "x"))
    point = F.when(F.col("kind") == 0, F.col("text")).otherwise(F.col("x.point"))
    return c.select("conv_id", "turn", F.col("kind").cast("long").alias("kind"), ev.point_covered(point, F.concat_ws(" ", "answer", "x.reply")).alias("covered"))


@query(sql("""SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'runtime_error' WHEN toxic = 1 THEN 'needs_review_failure_signal' WHEN quality = 0 OR doc_id % 13 = 0 THEN 'candidate_fail_insufficient_evidence'
WHEN doc_id % 11 = 0 THEN 'needs_human_review_unknown_status' WHEN (k AND p) OR (k AND t) OR (doc_id % 2 = 0 AND p AND t) THEN 'candidate_pass' ELSE 'needs_human_review' END AS verdict
FROM (SELECT *, doc_id % 3 = 0 OR (doc_id % 7) / 7.0 >= 0.4 AS p, doc_id % 5 > 0 OR doc_id % 4 = 0 AS k, (doc_id % 6) / 6.0 >= 0.5 AND (doc_id % 8) / 8.0 >= 0.75 AS t FROM labels)"""))
def auto_verdict(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "labels").select(
        "doc_id", (i % 19 == 0).alias("error"), F.col("toxic").alias("failure_hits"),
        F.when(F.col("quality") == 0, "insufficient_evidence").when(i % 11 == 0, "odd").otherwise("supported").alias("status"),
        F.when(i % 13 == 0, "Impossible de déterminer").otherwise("Le taux est de 10 %").alias("answer"),
        ((i % 8) / 8).alias("trace_score"), F.when(i % 3 == 0, 0).otherwise(2).alias("n_points"), ((i % 7) / 7).alias("point_recall"),
        (i % 4).alias("n_required"), (i % 5).alias("required_hits"), (i % 2 == 0).alias("has_source"), ((i % 6) / 6).alias("coverage"),
    )
    return ev.auto_verdict(rows).select("doc_id", "verdict")


@query(sql("SELECT 'g1' AS gold_id, item AS chunk_id FROM chunk WHERE contains(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), 'the and') AND (contains(trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')), 'the') OR contains(trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')), 'and'))", "chunk"))
def passage_gold(spark, d):
    c = chunks(spark, d).select(F.col("item").alias("chunk_id"), F.lit("r").alias("ref"), F.col("title").alias("section"), "text")
    gold = spark.sql("SELECT 'g1' AS gold_id, 'r' AS ref, cast(array() as array<long>) AS ids_all, cast(array() as array<long>) AS ids_any, cast(array() as array<string>) AS section_all, array('Thé', 'and') AS section_any, array('the AND') AS text_all, cast(array() as array<string>) AS text_any, cast(array() as array<string>) AS both_all, cast(array() as array<string>) AS both_any")
    return ev.passage_matches(c, gold)


@query("SELECT conv_id AS answer_id, errors = '' AS valid, n AS n_citations, errors FROM (SELECT conv_id, (sum(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END))::INT AS n, concat_ws('; ', CASE WHEN count(*) NOT BETWEEN 2 AND 4 THEN '2 to 4 bullets' END, CASE WHEN sum(turn % 2) > 0 THEN 'bullet without citation' END, CASE WHEN max(CASE WHEN turn % 2 = 0 THEN turn + 1 END) > 3 THEN 'unknown citation' END) AS errors FROM conversations GROUP BY conv_id)")
def validate_answers(spark, d):
    bullet = F.concat("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("]"))).otherwise(""))
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("answer_id")).agg(F.array_sort(F.collect_list(F.regexp_replace(bullet, r"\[(?!\d+\]$)", "("))).alias("bullets"))
    rows = rows.select("answer_id", F.lit("supported").alias("status"), F.lit("c").alias("conclusion"), F.lit("l").alias("limits"), "bullets", F.lit(3).alias("n_extracts"))
    return ev.answer_errors(rows)


@query("SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id) LIMIT 100")
def random_sample(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    return sampling.random_sample(rows, F.col("doc_id").cast("string"), 100, seed=7)


@query("SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id)) AS turn FROM documents) ORDER BY turn, lang LIMIT 101")
def stratified_sample(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    out = sampling.stratified_sample(rows, F.col("doc_id").cast("string"), "lang", 101, seed=7)
    return out.withColumn("turn", F.col("turn").cast("long"))
