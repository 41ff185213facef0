"""Queries of the agent's rules, ingestion, logs and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import agent, lexical
from corpusmill.plans.q_agent import axes_sql
from corpusmill.plans.q_retrieval import _LOCAL, _TOP_DOCS, asked, doc_items, local_ranks, top_docs
from corpusmill.plans.registry import query
from corpusmill.plans.tables import chunks, corpus, questions, sql, table
from corpusmill.sources import ingest
from corpusmill.streaming import progress


def _markers(prefix: str) -> str:
    return " + ".join("(contains(q, '" + m.replace("'", "''") + "'))::INT" for m in agent.TAXONOMY[prefix])


_TAX = " UNION ALL ".join(f"SELECT query_id, '{p}' AS prefix, {_markers(p)} AS score FROM said" for p in agent.TAXONOMY)


@query(sql(f"SELECT query_id, prefix, score::INT AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prefix) AS rank FROM ({_TAX}) WHERE score > 0) WHERE rank <= 4", "question", said="SELECT query_id, lower(strip_accents(text || CASE query_id % 3 WHEN 0 THEN ' Quel taux de TVA pour une location meublée (LMNP) ?' WHEN 1 THEN ' plus-value, succession et dividende' ELSE '' END)) AS q FROM question"))
def taxonomy_route(spark, d):
    tail = F.when(F.col("query_id") % 3 == 0, " Quel taux de TVA pour une location meublée (LMNP) ?").when(F.col("query_id") % 3 == 1, " plus-value, succession et dividende").otherwise("")
    rows = agent.taxonomy_route(questions(spark, d).withColumn("text", F.concat("text", tail)))
    return rows.withColumn("rank", F.col("rank").cast("long"))


@query(sql("SELECT query_id, ref, place FROM (SELECT query_id, ref, row_number() OVER (PARTITION BY query_id ORDER BY late, pos) AS place FROM (SELECT t.query_id, c.ref, c.item AS pos, CASE WHEN row_number() OVER (PARTITION BY t.query_id, array_to_string(string_split(c.ref, '-')[1:3], '-') ORDER BY c.item) > 1 THEN 1 ELSE 0 END AS late FROM question t JOIN corpus c ON c.item % 50 = t.query_id % 50)) WHERE place <= 6", "corpus", "question"))
def branch_diversify(spark, d):
    pairs = questions(spark, d).select("query_id", (F.col("query_id") % 50).alias("m")).join(corpus(spark, d).select("ref", F.col("item").alias("pos"), (F.col("item") % 50).alias("m")), "m")
    return agent.diversify(pairs, 6).withColumn("place", F.col("place").cast("long"))


@query(sql("SELECT query_id, ref, place FROM (SELECT query_id, ref, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS place FROM (SELECT r.query_id, c.ref, r.rank, CASE WHEN row_number() OVER (PARTITION BY r.query_id, array_to_string(string_split(c.ref, '-')[1:3], '-') ORDER BY r.rank) > 1 THEN 1 ELSE 0 END AS late FROM br r JOIN corpus c ON c.item = r.item)) WHERE place <= 6", "corpus", "question", **_TOP_DOCS))
def branch_diversify_ranked(spark, d):
    """The ranking of the whole corpus for each question, spread over branches.

    Six places take the first document of up to six branches and, if there are fewer, the first others: all of these are
    among the best twelve documents and the best of each of the best six branches.
    """
    most, q = 6, asked(spark, d)
    items = lexical.stored(doc_items(spark, d).withColumn("ref", agent.branch_key(F.col("ref"))))
    best = lexical.rank(items, q, 2 * most).select("query_id", "item", "score")
    leads = lexical.rank_owners(items, q, most).select("query_id", "item", "score")
    ranks = best.unionByName(leads).dropDuplicates(["query_id", "item"])
    ranks = ranks.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*lexical.ordered())))
    return agent.diversify(ranks.join(corpus(spark, d).select("item", "ref"), "item"), most).withColumn("place", F.col("place").cast("long"))


@query("SELECT user_id, event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000, 6) AS step_s, round((epoch_us(ts) - first(epoch_us(ts)) OVER w) / 1000000, 6) AS elapsed_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def step_timings(spark, d):
    return progress.step_timings(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", F.round("step_s", 6).alias("step_s"), F.round("elapsed_s", 6).alias("elapsed_s"))


@query("SELECT user_id, count(*) AS n_left FROM events WHERE event_id % 3 <> 0 GROUP BY user_id")
def resume(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    return progress.remaining(e, e.filter("event_id % 3 = 0"), ["event_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_left"))


_MATRIX = {
    **_LOCAL,
    "ax": "SELECT DISTINCT query_id, unnest(list_filter(string_split(text, ' '), lambda w: length(w) >= 4)[1:3]) AS axis FROM question",
    "hits": f"SELECT a.query_id, a.axis, l.ref, l.rank FROM ax a JOIN lr l ON l.query_id = a.query_id AND l.rank <= 3 JOIN chunk c ON c.item = l.item WHERE {axes_sql('a.axis', 'c.text')}",
    "cand": "SELECT query_id, axis, list(ref ORDER BY rank, ref) AS refs, bool_or(rank = 1) AS final FROM hits GROUP BY query_id, axis",
    "claim": f"SELECT a.query_id, a.axis, bool_or(length(b.axis) % 2 = 0) AS c, bool_or(length(b.axis) % 2 = 1) AS m FROM ax a JOIN ax b ON b.query_id = a.query_id AND {axes_sql('a.axis', 'b.axis')} GROUP BY a.query_id, a.axis",
}


@query(sql("""SELECT a.query_id, a.axis, 'core' AS role, true AS blocking, CASE WHEN coalesce(h.final, false) AND coalesce(k.c, false) THEN 'covered_final' WHEN coalesce(h.final, false) THEN 'final_unclaimed' WHEN h.refs IS NOT NULL THEN 'candidate_only' WHEN coalesce(k.m, false) THEN 'missing' ELSE 'not_found' END AS status,
coalesce(array_to_string(list_filter(h.refs, lambda x, i: list_position(h.refs, x) = i)[1:8], ','), '') AS candidate_refs FROM ax a LEFT JOIN cand h ON h.query_id = a.query_id AND h.axis = a.axis LEFT JOIN claim k ON k.query_id = a.query_id AND k.axis = a.axis""", "corpus", "chunk", "question", **_MATRIX))
def evidence_matrix(spark, d):
    """For every question: its first words as axes, against its best chunks."""
    words = F.slice(F.filter(F.split("text", " "), lambda w: F.length(w) >= 4), 1, 3)
    axes = questions(spark, d).select("query_id", F.explode(F.array_distinct(words)).alias("axis"), F.lit("core").alias("role"), F.lit(True).alias("blocking"))
    found = local_ranks(spark, d).filter("rank <= 3").join(chunks(spark, d).select("item", "text"), "item").select("query_id", "rank", "ref", "text", (F.col("rank") == 1).alias("final"))
    covered = axes.select("query_id", "axis").filter(F.length("axis") % 2 == 0)
    return agent.evidence_matrix(axes, found, covered, axes.select("query_id", "axis").filter(F.length("axis") % 2 == 1))


@query()
def agent_loop_stub(spark, d):
    """All questions through plan, review and answer with the stand-in client."""
    text = corpus(spark, d).select("ref", "text")
    found = top_docs(spark, d).join(text, "ref").select("query_id", F.col("doc_rank").alias("rank"), "ref", "text")
    return agent.answer(questions(spark, d), found)


@query()
def html_tree_rows(spark, d):
    """Sections, paragraphs and tables of every page, one row each."""
    return ingest.tree_rows(ingest.parse_html(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("document_id"), "html")))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://([^/:?#]+)', 1), ''), '') AS host FROM pages")
def page_hosts(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    rows = progress.hourly(table(spark, d, "events").select("ts", "event_type", "value"))
    return rows.select("event_type", "start", "n", F.round("total", 4).alias("total"))
