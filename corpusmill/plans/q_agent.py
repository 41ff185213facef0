"""Queries of plans, facet queries, candidate references, answers, scores, prompts, encoders and question banks."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.operators import agent, dense, index, lexical, postings
from corpusmill.operators import agent_loop as agent_loop_operator
from corpusmill.operators import agent_rules as rules
from corpusmill.operators import evaluation as ev
from corpusmill.operators.replies import Recorded
from corpusmill.operators.staging import shared_dir, staged
from corpusmill.plans.q_retrieval import _LOCAL, _TOP_DOCS, chunk_items, doc_index, local_ranks, top_docs
from corpusmill.plans.registry import query
from corpusmill.plans.tables import chunks, corpus, questions, sql, table
from corpusmill.sources import questions as bank
from corpusmill.streaming import events, progress


def text_list(items) -> str:
    """A SQL list of texts."""
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def folded(x: str) -> str:
    return f"lower(strip_accents(coalesce({x}, '')))"


def marked(x: str, markers: list[str]) -> str:
    """Does SQL text ``x`` contain a marker?"""
    return f"(len(list_filter({text_list(markers)}, lambda m: contains({x}, m))) > 0)"


def firsts(x: str) -> str:
    """A SQL list's first occurrences in order."""
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def shortened(x: str, limit: int) -> str:
    return f"(CASE WHEN length({collapsed(x)}) <= {limit} THEN {collapsed(x)} ELSE rtrim({collapsed(x)}[1:{limit - 3}]) || '...' END)"


def prefixed(x: str) -> str:
    return f"regexp_extract(regexp_replace(upper(trim(coalesce({x}, ''))), '^BOI-', ''), '\\b(?:{'|'.join(rules.FAMILIES)})(?:-[A-Z0-9]+){{0,8}}\\b')[1:80]"


def worded(x: str, least: int = 1) -> str:
    return f"list_distinct(list_filter(regexp_extract_all({folded(x)}, '[a-z0-9]+'), lambda w: length(w) >= {least}))"


def joined(*parts: str) -> str:
    return f"trim(array_to_string(list_filter([{', '.join(parts)}], lambda x: x <> ''), ' '))"


# --- prefixes ---

_VALUES = ["BOI-TVA-BASE-10-20", "  boi-rppm-rcm-40-50-20-20240730", "voir RPPM-RCM et BIC-10", "is", "XIS-TVAX", "", "BOI-EN-SRC0-1", "BIC-A-B-C-D-E-F-G-H-I-J", "PAT-" + "LONG" * 30]


@query(sql(f"SELECT ref, no, {prefixed('value')} AS prefix FROM (SELECT ref, unnest(range(1, {len(_VALUES) + 2})) AS no, CASE WHEN no <= {len(_VALUES)} THEN ({text_list(_VALUES)})[no] ELSE ref END AS value FROM corpus)", "corpus"))
def tax_prefix(spark, d):
    values = F.concat(F.array(*[F.lit(v) for v in _VALUES]), F.array("ref"))
    return corpus(spark, d).select("ref", F.posexplode(values).alias("no", "value")).select("ref", (F.col("no") + 1).cast("long").alias("no"), rules.tax_prefix(F.col("value")).alias("prefix"))


# --- plans: every question with made-up tails and the facets that a planner might propose ---

_TAILS = ["", " Combien de taxe ?", " Si je relève du régime réel, quel calcul ?", " Puis je bénéficier de 1 500 € HT de loyers ?", " Chiffre d'affaires de 20 000 euros TTC"]
_FACETS = [
    ("Seuil de recettes", "trouver le plafond", "seuil recettes franchise", "BOI-TVA-DECLA-30", "2", "core", None, ["seuil de 85 000 €", "taux", "BOI-TVA-DECLA-30-20", "règle"]),
    ("", "Sortie du régime", "", "bic", "x", "alternative", "oui", ["limites"]),
    ("Cadrer la réponse", "distinction utile seulement", "portée", "", "1", "core", "true", []),
    ("Option éventuelle", "dispositif spécial", "conditions particulières", "XX", "-3", "odd", "", ["abattement forfaitaire pour charges et taux", " "]),
    ("Rien", "", "", "IS", "1", "core", "true", ["preuve"]),
    ("Règle   générale " + "longue " * 20, "champ " * 60, "doctrine " * 40, "RSA-CHAMP-20-30", "12", "calculation", "0", ["a", "bb", "application", "plafond"]),
    ("Dernier axe", "but", "requête", "", "9", "", None, None),
]


def plan_rows(spark: SparkSession, d: str) -> DataFrame:
    asked_all = planned(spark, d)
    names = ["name", "goal", "query", "prefix", "priority", "role", "blocking"]
    one = [F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, f[:7], strict=True)], (F.lit(None) if f[7] is None else F.array(*[F.lit(x) for x in f[7]])).cast("array<string>").alias("expected")) for f in _FACETS]
    rows = asked_all.select("query_id", F.col("text").alias("question"), F.lit("").alias("reformulated"), F.posexplode(F.array(*one)).alias("no", "f"))
    return rows.select("query_id", "question", "reformulated", (F.col("no") + 1).alias("facet"), "f.*")


def planned(spark: SparkSession, d: str) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(x) for x in _TAILS]), (F.col("query_id") % len(_TAILS) + 1).cast("int"))
    return questions(spark, d).withColumn("text", F.concat("text", tail))


def _facet_value(i: int, f: tuple) -> str:
    return f"({i}, " + ", ".join("NULL" if x is None else q(x) for x in f[:7]) + f", {'NULL' if f[7] is None else text_list(f[7])}::VARCHAR[])"


_OWN = "name || ' ' || goal || ' ' || query || ' ' || array_to_string(expected, ' ')"
_PLAN = {
    "pq": f"SELECT query_id, text || ({text_list(_TAILS)})[query_id % {len(_TAILS)} + 1] AS text FROM question",
    "pf": "SELECT * FROM (VALUES " + ", ".join(_facet_value(i, f) for i, f in enumerate(_FACETS, start=1)) + ") v(facet, name, goal, query, prefix, priority, role, blocking, expected)",
    "pc": f"SELECT query_id, text AS question, facet, prefix, priority, role, blocking, {shortened('name', 90)} AS name, {shortened('goal', 220)} AS goal, {shortened('query', 220)} AS query, list_transform(list_filter(coalesce(expected, []), lambda x: trim(x) <> ''), lambda x: {shortened('x', 120)})[1:4] AS expected FROM pq, pf",
    "pm": f"SELECT *, {folded('question')} AS q, {folded(_OWN)} AS o, {folded('question || chr(32) || ' + _OWN)} AS a FROM pc WHERE query <> '' OR goal <> ''",
    "pa": f"SELECT *, {marked('q', rules.ASKS_AMOUNT)} AND {marked('a', rules.NAMES_AMOUNT)} AS amount, ({marked('q', rules.ASSUMES_REGIME)} AND {marked('q', rules.ASKS_RESULT)} AND NOT {marked('q', rules.ASKS_RIGHT)} AND {marked('a', rules.REGIME_CHANGE)}) OR {marked('o', rules.OUT_OF_SCOPE)} OR ({marked('o', rules.LIMITED)} AND {marked('o', rules.CLARIFIES)}) OR ({marked('o', rules.OPTIONAL)} AND NOT {marked('q', rules.ASKS_OPTION)}) AS aside, CASE WHEN role IN ('core', 'calculation', 'reserve', 'alternative') THEN role ELSE 'core' END AS r FROM pm",
    "pn": f"""SELECT query_id, facet, coalesce(nullif(name, ''), 'Axe fiscal ' || facet) AS name, coalesce(nullif(goal, ''), 'Identifier la doctrine applicable') AS goal, coalesce(nullif(query, ''), goal) AS query, {prefixed('prefix')} AS prefix,
greatest(1, least(9, coalesce(try_cast(priority AS INT), facet)))::INT AS priority, expected, CASE WHEN aside THEN 'reserve' WHEN amount THEN 'calculation' ELSE r END AS role,
CASE WHEN aside THEN false WHEN amount THEN true WHEN blocking IN ('0') THEN false WHEN blocking IN ('true', 'oui') THEN true ELSE r IN ('core', 'calculation') END AS blocking FROM pa""",
    "plan": "SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY priority, facet) AS facet) FROM pn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY priority, facet) <= 5",
}


@query(sql("SELECT * REPLACE (array_to_string(expected, '|') AS expected, facet::INT AS facet) FROM plan", "question", **_PLAN))
def plan_facets(spark, d):
    return rules.plan_facets(plan_rows(spark, d)).withColumn("expected", F.array_join("expected", "|"))


_THRESHOLD = " ".join(f"CASE WHEN {marked('f', ms)} THEN {text_list(ws)} ELSE [] END" + ("," if i < 2 else "") for i, (ms, ws) in enumerate(rules.THRESHOLD_TERMS))
_BARE = "list_filter(list_transform(expected[1:3], lambda x: trim(regexp_replace(regexp_replace(x, '(?i)\\bBOI-[A-Z0-9]+(?:-[A-Z0-9]+)*\\b', ' ', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '')"
_ASKED_WORDS = "list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '\\b\\d[\\d\\s.,]*\\d?\\b', ' ', 'g'), '(?i)\\b(euros?|ht|ttc)\\b', ' ', 'g'), '[A-Za-zÀ-ÿ'']+'), lambda w: trim(lower(strip_accents(w)), '''')), lambda w: length(w) >= 4 AND NOT list_contains(" + text_list(rules.QUESTION_STOPWORDS) + ", w))"
_SPECIFIC = f"list_filter(expected, lambda x: len({worded('x', 4)}) > 0 AND (len(list_filter({worded('x', 4)}, lambda w: NOT list_contains({text_list(rules.GENERIC)}, w))) > 0 OR regexp_matches(x, '\\d|%|€')))"
_EXPANSION = "array_to_string(" + firsts("list_concat(CASE WHEN contains(g, 'abattement') AND (contains(g, 'forfaitaire') OR contains(g, 'charge')) THEN ['application abattement', 'taux abattement', 'conditions abattement'] ELSE [] END, CASE WHEN contains(g, 'abattement') AND contains(g, 'taux') THEN ['application abattement', 'pourcentage'] ELSE [] END)") + ", ' ')"
_FACET_SQL = {
    "fe": f"SELECT p.*, k.text, array_to_string({_BARE}, ' ') AS ev, {_ASKED_WORDS} AS asked, {firsts(_SPECIFIC)} AS sp FROM plan p JOIN pq k ON k.query_id = p.query_id",
    "ff": f"SELECT *, {joined('query', 'goal', 'ev')} AS focus, {folded('name || chr(32) || goal || chr(32) || query || chr(32) || array_to_string(sp, chr(32))')} AS ctx FROM fe",
    "ft": f"SELECT *, {folded('text || chr(32) || focus')} AS f FROM ff",
    "fs": f"SELECT *, CASE WHEN regexp_matches(text || focus, '\\d') THEN list_concat({_THRESHOLD}) ELSE [] END AS terms, len(sp) >= 2 OR (len(sp) = 1 AND ({marked('ctx', rules.WORTH)} OR regexp_matches(ctx, '\\d|%'))) AS worth FROM ft",
    "fv": f"SELECT query_id, facet, prefix, name, query, i, trim(regexp_replace(regexp_replace(sp[i], '(?i)\\bBOI-[A-Z0-9]+(?:-[A-Z0-9]+)*\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS e FROM (SELECT *, unnest(range(1, least(3, len(sp)) + 1)) AS i FROM fs WHERE worth)",
    "fx": f"SELECT query_id, facet, string_agg({joined('prefix', 'prefix', 'name', 'query', 'e', _EXPANSION)}[1:300], '|' ORDER BY i) AS evidence FROM (SELECT *, {folded('e')} AS g FROM fv WHERE e <> '') GROUP BY query_id, facet",
}


@query(sql(f"""SELECT s.query_id, s.facet::INT AS facet, {joined('s.prefix', 's.name', 's.query', 's.text')}[1:500] AS search,
{joined('s.prefix', 's.query', "array_to_string(" + firsts('s.terms') + ", ' ')", 's.goal', 's.ev', "array_to_string((" + firsts('s.asked') + ")[1:36], ' ')")}[1:500] AS passages, coalesce(x.evidence, '') AS evidence
FROM fs s LEFT JOIN fx x ON x.query_id = s.query_id AND x.facet = s.facet""", "question", **_PLAN, **_FACET_SQL))
def facet_queries(spark, d):
    rows = rules.facet_queries(rules.plan_facets(plan_rows(spark, d)), planned(spark, d))
    return rows.select("query_id", "facet", "search", "passages", F.array_join("evidence", "|").alias("evidence"))


_LABELS = " ".join(f"WHEN {q(p)} THEN {q(label)}" for p, (label, _) in rules.PLAN_TERMS.items())
_TERMS = " ".join(f"WHEN {q(p)} THEN {q(terms)}" for p, (_, terms) in rules.PLAN_TERMS.items())
_HITS = " UNION ALL ".join("SELECT query_id, " + q(p) + " AS prefix, len(list_filter(" + text_list(ms) + ", lambda m: contains(k, m))) AS n FROM (SELECT query_id, " + folded("text") + " AS k FROM pq)" for p, ms in agent.TAXONOMY.items())


@query(sql(f"""SELECT k.query_id, coalesce(r.rank, 1)::INT AS facet, CASE r.prefix {_LABELS} ELSE 'Doctrine fiscale applicable' END AS name, CASE r.prefix {_TERMS} ELSE k.text END AS query, coalesce(r.prefix, '') AS prefix
FROM pq k LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, prefix) AS rank FROM ({_HITS}) WHERE n > 0 QUALIFY rank <= 4) r ON r.query_id = k.query_id""", "question", pq=_PLAN["pq"]))
def fallback_plan(spark, d):
    """Questions with made-up tails, as a planner without a reply plans them."""
    return rules.fallback_facets(planned(spark, d)).select("query_id", "facet", "name", "query", "prefix")


# --- candidate references: the best documents of each question as routes, their best chunks as passages ---

_OTHER = "CASE WHEN item % 3 = 0 THEN 'BOI-TVA-BASE-' || (item % 5) || '-' || (item % 4) || '-20240115' ELSE ref END"
_GAP_PREFIX = ["TVA-BASE-1-2", "BOI-TVA-BASE-2", "", "TVA-BASE-0-0-20230101"]
_CUT = "list_slice(string_split(p, '-'), 1, len(string_split(p, '-')) - CASE WHEN regexp_matches(p, '-\\d{8}$') THEN 1 ELSE 0 END)"


def _parts(x: str) -> str:
    return f"(CASE WHEN {prefixed(x)} = '' THEN [] ELSE {_CUT.replace('p,', prefixed(x) + ',')} END)"


_CAND = {
    **_LOCAL,
    "cg": f"SELECT query_id AS gap, query_id, text || CASE WHEN query_id % 4 = 1 THEN ' taux TVA base, voir boi-tva-base-9-9' ELSE ' base TVA' END AS axis, {prefixed(f'({text_list(_GAP_PREFIX)})[query_id % 4 + 1]')} AS prefix FROM question",
    "cs": f"SELECT t.query_id, t.doc_rank, {_OTHER.replace('item', 't.doc').replace('ELSE ref', 'ELSE t.ref')} AS ref, t.doc FROM top t",
    "cr": "SELECT s.query_id, 1 AS route, k.text, v.kind, v.b, v.o, s.doc_rank AS place, s.ref FROM cs s JOIN question k ON k.query_id = s.query_id JOIN (VALUES ('stage2', 6.0, 1, 3), ('stage1', 3.0, 2, 5), ('selected', 1.0, 3, 1)) v(kind, b, o, most) ON s.doc_rank <= v.most",
    "cp": "SELECT l.query_id, s.doc_rank * 1000 + l.rank AS place, s.ref, c.title, '' AS path, c.text FROM lr l JOIN chunk c ON c.item = l.item JOIN cs s ON s.query_id = l.query_id AND s.doc = c.doc WHERE l.rank <= 2",
    "cw": f"SELECT *, {worded('axis', 4)} AS w, {_parts('prefix')} AS pp FROM cg",
    "cx": f"SELECT g.gap, r.ref, 1 AS s, r.route AS a, r.o AS b, r.place AS p, r.b AS boost, len(list_intersect(g.w, {worded('r.text')})) AS n1, len(list_intersect(g.w, {worded('r.ref')})) AS n2, g.prefix <> '' AND starts_with(upper(r.ref), 'BOI-' || g.prefix) AS under, len(g.pp) >= 4 AND len({_parts('r.ref')}) >= 4 AND g.pp[1:len(g.pp) - 1] = ({_parts('r.ref')})[1:len({_parts('r.ref')}) - 1] AS beside FROM cr r JOIN cw g ON g.query_id = r.query_id",
    "cy": f"SELECT g.gap, c.ref, c.place AS p, len(list_intersect(g.w, {worded('c.ref || chr(32) || c.title || chr(32) || c.path || chr(32) || ' + shortened('c.text', 300))})) AS n, g.prefix <> '' AND starts_with(upper(c.ref), 'BOI-' || g.prefix) AS under, len(g.pp) >= 4 AND len({_parts('c.ref')}) >= 4 AND g.pp[1:len(g.pp) - 1] = ({_parts('c.ref')})[1:len({_parts('c.ref')}) - 1] AS beside FROM cp c JOIN cw g ON g.query_id = c.query_id",
    "ce": """SELECT gap, 'BOI-TVA-BASE-9-9' AS ref, 0 AS s, 0 AS a, 0 AS b, 0 AS p, 1000.0 AS score FROM cg WHERE query_id % 4 = 1
UNION ALL SELECT gap, upper(ref), s, a, b, p, n1 * 2.0 + n2 + boost + CASE WHEN under THEN 0.5 WHEN beside THEN 0.75 ELSE 0 END FROM cx WHERE n1 > 0 OR n2 > 0 OR under OR beside
UNION ALL SELECT gap, upper(ref), 2, 0, 0, p, n + CASE WHEN under THEN 2 WHEN beside THEN 1 ELSE 0 END FROM cy WHERE n + CASE WHEN under THEN 2 WHEN beside THEN 1 ELSE 0 END > 0""",
    "cb": "SELECT gap, ref, max(score) AS score, min({'s': s, 'a': a, 'b': b, 'p': p}) AS o FROM ce GROUP BY gap, ref",
    "cn": f"SELECT gap, ref, row_number() OVER (PARTITION BY gap ORDER BY score DESC, o, ref) AS pos, nullif(array_to_string(({_parts('ref')})[1:3], '-'), '') AS branch FROM cb",
    "cl": "SELECT gap, ref, pos, CASE WHEN branch IS NOT NULL AND row_number() OVER (PARTITION BY gap, branch ORDER BY pos) > 1 THEN 1 ELSE 0 END AS late FROM cn",
}


@query(sql("SELECT gap, ref, row_number() OVER (PARTITION BY gap ORDER BY late, pos) AS place FROM cl QUALIFY place <= 6", "corpus", "chunk", "question", **_CAND))
def candidate_refs(spark, d):
    """A gap a question, with and without a prefix or a reference that its text names."""
    i = F.col("query_id")
    axis = F.concat("text", F.when(i % 4 == 1, " taux TVA base, voir boi-tva-base-9-9").otherwise(" base TVA"))
    prefix = F.element_at(F.array(*[F.lit(p) for p in _GAP_PREFIX]), (i % 4 + 1).cast("int"))
    asked_all = questions(spark, d)
    gaps = asked_all.select(i.alias("gap"), "query_id", axis.alias("axis"), prefix.alias("prefix"))
    other = F.when(F.col("doc") % 3 == 0, F.concat(F.lit("BOI-TVA-BASE-"), F.col("doc") % 5, F.lit("-"), F.col("doc") % 4, F.lit("-20240115"))).otherwise(F.col("ref"))
    top = staged(top_docs(spark, d), "top")
    seen = top.select("query_id", "doc_rank", "doc", other.alias("ref"))
    kinds = F.array(*[F.when(F.col("doc_rank") <= most, F.lit(k)) for k, most in (("stage2", 3), ("stage1", 5), ("selected", 1))])
    routes = seen.join(asked_all, "query_id").select("query_id", F.lit(1).alias("route"), "text", F.explode(F.array_compact(kinds)).alias("kind"), F.col("doc_rank").alias("place"), "ref")
    best = local_ranks(spark, d).filter("rank <= 2").select("query_id", "item", "rank").join(chunks(spark, d).select("item", "doc", "title", "text"), "item").join(seen, ["query_id", "doc"])
    passages = best.select("query_id", (F.col("doc_rank") * 1000 + F.col("rank")).alias("place"), "ref", "title", F.lit("").alias("path"), "text")
    return rules.candidate_refs(gaps, routes, passages).withColumn("place", F.col("place").cast("long"))


# --- answers, scores, prompts ---

_SAID = ["", "Le taux est de 10 %.", "Impossible de répondre.", "Les sources insuffisantes ne permettent pas de conclure"]
_AXES = ["Taux de TVA", "taux", "Seuil de recettes annuelles", "recettes annuelles seuil plafond", "Exonération", ""]


def axes_sql(a: str, b: str) -> str:
    x, y = folded(f"trim({a})"), folded(f"trim({b})")
    words = lambda c: f"list_distinct(list_filter(regexp_extract_all({folded(c)}, '[a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains({text_list(agent.AXIS_STOPWORDS)}, w)))"
    m, n = f"len(list_intersect({words(a)}, {words(b)}))", f"least(len({words(a)}), len({words(b)}))"
    return f"({x} <> '' AND {y} <> '' AND (contains({x}, {y}) OR contains({y}, {x}) OR ({n} > 0 AND ({m} = {n} OR ({m} >= 2 AND {m} >= {n} * 0.67)))))"


@query(sql(f"SELECT item, a, b, {axes_sql('x', 'y')} AS same FROM (SELECT item, a, b, CASE a WHEN 7 THEN title ELSE ({text_list(_AXES)})[a] END AS x, CASE b WHEN 7 THEN title ELSE ({text_list(_AXES)})[b] END AS y FROM corpus, range(1, 8) r(a), range(1, 8) s(b))", "corpus"))
def axes_match(spark, d):
    """Every title and some made-up axes with each other."""
    axes = F.concat(F.array(*[F.lit(a) for a in _AXES]), F.array("title"))
    rows = corpus(spark, d).select("item", "title", F.posexplode(axes).alias("a", "x")).select("item", "a", "x", F.posexplode(axes).alias("b", "y"))
    return rows.select("item", (F.col("a") + 1).cast("long").alias("a"), (F.col("b") + 1).cast("long").alias("b"), agent.axes_match(F.col("x"), F.col("y")).alias("same"))


def replies(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled document as an answer, of several kinds."""
    i = F.col("doc_id")
    said, axes = F.array(*[F.lit(x) for x in _SAID]), F.array(*[F.lit(x) for x in _AXES])
    return table(spark, d, "labels").select(
        i.alias("answer_id"), (i % 11 != 0).alias("readable"), F.when(i % 7 == 0, "preuve insuffisante").otherwise("supported").alias("status"), F.element_at(said, (i % 4 + 1).cast("int")).alias("conclusion"),
        F.when(i % 3 == 0, F.array(F.lit("puce"))).otherwise(F.array(F.lit(" "))).alias("bullets"), F.when(i % 5 == 0, axes).alias("covered"), axes.alias("required"),
        F.when(i % 2 == 0, F.slice(axes, 2, 3)).alias("missing"), F.when(i % 13 < 6, F.slice(axes, 1, 1)).when(i % 13 < 9, F.slice(axes, 4, 1)).alias("aside"),
    )


_REPLY = f"""SELECT doc_id AS answer_id, doc_id % 11 <> 0 AS readable, lower(strip_accents(concat_ws(chr(10), CASE WHEN doc_id % 7 = 0 THEN 'preuve insuffisante' ELSE 'supported' END, ({text_list(_SAID)})[doc_id % 4 + 1]))) AS said,
({text_list(_SAID)})[doc_id % 4 + 1] <> '' OR doc_id % 3 = 0 OR doc_id % 5 = 0 AS concluded, {text_list(_AXES[:5])} AS required, CASE WHEN doc_id % 2 = 0 THEN {text_list(_AXES[1:4])} ELSE [] END AS missing,
CASE WHEN doc_id % 13 < 6 THEN {q(_AXES[0])} WHEN doc_id % 13 < 9 THEN {q(_AXES[3])} ELSE '' END AS aside FROM labels"""


@query(sql(f"""SELECT answer_id, CASE WHEN ok THEN 'supported' ELSE 'insufficient_evidence' END AS status, CASE WHEN readable THEN array_to_string(r, '|') ELSE '' END AS required,
CASE WHEN NOT readable THEN 'réponse structurée' WHEN ok THEN '' WHEN len(m) > 0 THEN array_to_string(m, '|') ELSE {q(rules.NOTHING_NAMED)} END AS missing
FROM (SELECT *, readable AND concluded AND NOT {marked('said', rules.NO_CONCLUSION)} AS ok, list_filter(required, lambda x: NOT {axes_sql('x', 'aside')}) AS r, list_filter(missing, lambda x: NOT {axes_sql('x', 'aside')}) AS m FROM reply)""", reply=_REPLY))
def answer_status(spark, d):
    return rules.clean_status(replies(spark, d)).select("answer_id", "status", F.array_join("required", "|").alias("required"), F.array_join("missing", "|").alias("missing"))


_RUN_REFS = ["BOI-TVA-BASE-10-20240115", "boi-bic-champ", "", "BOI-IS"]


def scored_runs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    some = lambda *xs: F.array(*[F.lit(x) for x in xs])
    none = F.array().cast("array<string>")
    rows = table(spark, d, "labels").join(corpus(spark, d).select(F.col("item").alias("doc_id"), "text"), "doc_id")
    return rows.select(
        i.alias("run_id"), F.when(i % 4 == 0, none).otherwise(some("BOI-TVA-BASE", "BOI-RSA")).alias("required"), some("BOI-BIC-CHAMP-10", "BOI-CF").alias("optional"),
        F.when(i % 5 == 0, none).otherwise(F.array(F.substring_index("text", "\n", 1), F.lit("taux réduit"))).alias("points"), some("Taux erroné", "?!").alias("signals"),
        F.slice(some(*_RUN_REFS), F.lit(1), (i % 5).cast("int")).alias("refs"), F.concat("text", F.when(i % 3 == 0, "\nle taux  errone, TAUX réduits").otherwise("")).alias("answer"),
        F.when(i % 2 == 0, "Plan fiscal produit Recherche par axe").otherwise("Relance RÉPONSE").alias("labels"), F.when(i % 7 == 0, "plan_and_route").otherwise("").alias("stages"),
        (i % 3 == 1).alias("reviewed"), (i % 6 == 0).alias("concluded"), (i % 4).cast("int").alias("iterations"),
    )


def _family_sql(x: str, y: str) -> str:
    """Are two references equal without a final date, or one an ancestor of the other?"""
    a, b = (f"regexp_replace(trim(upper({z})), '-[0-9]{{8}}$', '')" for z in (x, y))
    return f"({a} = {b} OR starts_with({a}, {b} || '-') OR starts_with({b}, {a} || '-'))"


def _phrase_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9%]+', ' ', 'g'))"


_CITED = "len(list_filter(refs, lambda r: trim(r) <> '' AND " + _family_sql("r", "x") + ")) > 0"
_RUNS = f"""SELECT doc_id AS run_id, CASE WHEN doc_id % 4 = 0 THEN [] ELSE ['BOI-TVA-BASE', 'BOI-RSA'] END AS required, ['BOI-BIC-CHAMP-10', 'BOI-CF'] AS optional, ['Taux erroné', '?!'] AS signals,
({text_list(_RUN_REFS)})[1 : doc_id % 5] AS refs, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'le taux  errone, TAUX réduits' ELSE '' END AS answer,
lower(CASE WHEN doc_id % 2 = 0 THEN 'Plan fiscal produit Recherche par axe' ELSE 'Relance RÉPONSE' END) AS labels, CASE WHEN doc_id % 7 = 0 THEN 'plan_and_route' ELSE '' END AS stages, doc_id % 3 = 1 AS reviewed, doc_id % 6 = 0 AS concluded, doc_id % 4 AS iterations
FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL"""


@query(sql(f"""SELECT run_id, array_to_string(rh, '|') AS required_hits, array_to_string(list_filter(required, lambda x: NOT ({_CITED})), '|') AS missing_required,
(CASE WHEN len(required) > 0 THEN round_even(len(rh) / len(required), 3) ELSE 1.0 END)::DOUBLE AS required_recall, array_to_string(list_filter(optional, lambda x: {_CITED}), '|') AS optional_hits,
round_even(least(1.0, (plan::INT + reviewed::INT + contains(labels, 'recherche')::INT + (contains(labels, 'réponse') OR contains(labels, 'reponse') OR concluded)::INT) / 4 + CASE WHEN again THEN 0.1 ELSE 0.0 END), 3)::DOUBLE AS trace_score, again AS has_relaunch,
array_to_string(list_filter(signals, lambda x: {_phrase_sql('x')} <> '' AND contains({_phrase_sql('answer')}, {_phrase_sql('x')})), '|') AS signal_hits
FROM (SELECT *, list_filter(required, lambda x: {_CITED}) AS rh, contains(labels, 'plan') OR contains(stages, 'plan') AS plan, iterations > 1 OR contains(labels, 'relance') OR contains(labels, 'intra-document') AS again FROM run)""", run=_RUNS))
def agentic_scores(spark, d):
    lists = ["required_hits", "missing_required", "optional_hits", "signal_hits"]
    rows = ev.agentic_scores(scored_runs(spark, d)).withColumns({c: F.array_join(c, "|") for c in lists})
    return rows.select("run_id", "required_hits", "missing_required", "required_recall", "optional_hits", "trace_score", "has_relaunch", "signal_hits")


_ERRORS = ["", "API key is missing", "x RateLimitError", "Request timed out", "status 503", "answer_status must be one of", "RuntimeError: x", "quota exceeded; must be "]


def _kind_sql() -> str:
    """The kind of an error text ``e``, by the markers of each kind in their order."""
    said = "' ' || lower(e) || ' '"
    cases = " ".join(f"WHEN {marked(said, markers)} THEN {q(name)}" for name, markers in ev.FAILURES.items())
    return f"CASE WHEN e = '' THEN 'valid' {cases} ELSE 'runtime_error' END"


@query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE k = 'valid') AS n_valid, count(*) FILTER (WHERE doc_id % 2 = 0) AS n_has_conclusion, count(*) FILTER (WHERE doc_id % 3 = 0) AS n_has_justification, count(*) FILTER (WHERE quality = 1) AS n_has_limits, count(*) FILTER (WHERE toxic = 0) AS n_with_citation,
{", ".join(f"count(*) FILTER (WHERE k = {q(k)}) AS n_{k}" for k in (*ev.FAILURES, "runtime_error"))}
FROM (SELECT *, {_kind_sql()} AS k FROM (SELECT *, ({text_list(_ERRORS)})[doc_id % 8 + 1] AS e FROM labels))""")
def batch_review(spark, d):
    i = F.col("doc_id")
    errors = F.element_at(F.array(*[F.lit(e) for e in _ERRORS]), (i % 8 + 1).cast("int"))
    return ev.batch_review(table(spark, d, "labels").select((errors == "").alias("valid"), (i % 2 == 0).alias("has_conclusion"), (i % 3 == 0).alias("has_justification"), (F.col("quality") == 1).alias("has_limits"), (F.col("toxic") == 0).alias("with_citation"), errors.alias("errors")))


@query(sql("SELECT query_id, ref, n, count(*) OVER (PARTITION BY query_id) AS docs, max(n) OVER (PARTITION BY query_id) AS most FROM (SELECT query_id, ref, count(*) AS n FROM lr WHERE rank <= 3 GROUP BY query_id, ref)", "corpus", "chunk", "question", **_LOCAL))
def doc_distribution(spark, d):
    return ev.doc_distribution(local_ranks(spark, d).filter("rank <= 3"))


@query(sql("""SELECT k.query_id, 'QUESTION:' || chr(10) || k.text || chr(10) || chr(10) || CASE WHEN k.query_id % 2 = 0 THEN 'DONNEES CHIFFREES:' || chr(10) || '- 5 %' || chr(10) || chr(10) ELSE '' END || 'EXTRAITS:' || chr(10) || coalesce(x.e, '') || chr(10) || chr(10) || 'Réponds.' AS prompt
FROM question k LEFT JOIN (SELECT t.query_id, string_agg('[' || t.doc_rank || '] BOI: ' || t.ref || chr(10) || 'Titre: ' || c.title || chr(10) || 'Date: ' || CASE WHEN t.doc % 2 = 0 THEN '2024-01-15' ELSE 'inconnue' END || chr(10) || 'Section: (sans section)' || chr(10) || 'Texte: ' || c.text, chr(10) || chr(10) ORDER BY t.doc_rank) AS e
FROM top t JOIN corpus c ON c.item = t.doc GROUP BY t.query_id) x ON x.query_id = k.query_id""", "corpus", "question", **_TOP_DOCS))
def answer_prompt(spark, d):
    """Questions with their best documents, whole, as numbered extracts."""
    c = corpus(spark, d).select(F.col("item").alias("doc"), "title", "text")
    hits = top_docs(spark, d).join(c, "doc").select("query_id", F.col("doc_rank").alias("rank"), "ref", "title", F.when(F.col("doc") % 2 == 0, "2024-01-15").alias("date"), F.lit("").alias("path"), "text")
    numbers = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("5 %"))).otherwise(F.array().cast("array<string>"))
    rows = questions(spark, d).join(rules.extracts(hits), "query_id", "left")
    return rows.select("query_id", rules.prompt(F.col("text"), F.col("extracts"), numbers, "Réponds.").alias("prompt"))


# --- encoders, stored tokens, question banks ---


def letters(texts: list[str]) -> np.ndarray:
    """A stand-in for an encoder: how often each letter from a to z occurs."""
    return np.array([[x.count(chr(97 + i)) for i in range(26)] for x in texts], dtype=np.float64).reshape(-1, 26)


def _letters_sql(x: str) -> str:
    return f"list_transform(range(97, 123), lambda i: length({x}) - length(replace({x}, chr(i::INT), '')))::DOUBLE[]"


@query(sql("""SELECT query_id, item, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank
FROM (SELECT k.query_id, c.item, coalesce(list_dot_product(k.v, c.v) / nullif(sqrt(list_dot_product(k.v, k.v)) * sqrt(list_dot_product(c.v, c.v)), 0), 0) AS score FROM lq k, lc c)) WHERE rank <= 5""", "corpus", "question", lq=f"SELECT query_id, {_letters_sql('text')} AS v FROM question", lc=f"SELECT item, {_letters_sql('coalesce(text, chr(32))')} AS v FROM corpus"))
def encode_search(spark, d):
    """All documents and questions encoded (by a stand-in), and the nearest documents."""
    items = staged(dense.encode(corpus(spark, d).select("item", "text"), letters).select("item", "vector"), "encoded")
    found = dense.search(items, questions(spark, d), letters, 5)
    return found.select("query_id", "item", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(sql("SELECT item, len(regexp_extract_all(lower(strip_accents(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))), '[A-Za-zÀ-ÿ0-9]+')) AS n FROM corpus", "corpus"))
def stored_index(spark, d):
    """Tokens of all documents, made and stored, and read from there by a second call."""
    rows = corpus(spark, d).select("item", "text")
    for _ in range(2):
        found = index.indexed(rows, t.tokens(F.col("text")), shared_dir(spark))
    return found.select("item", F.size("toks").cast("long").alias("n"))


@query("""SELECT doc_id AS no, CASE WHEN doc_id % 3 = 2 THEN 'Q' || lpad(doc_id::VARCHAR, greatest(3, length(doc_id::VARCHAR))::INT, '0') ELSE 'c' || doc_id END AS id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS question, source AS theme, CASE WHEN doc_id % 2 = 0 THEN 'a|b' ELSE 'one' END AS required_docs, lang AS expected_points
FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND text IS NOT NULL""")
def question_bank(spark, d):
    """Every document as a case of a question bank, its fields under one or another of their names."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").withColumn("text", F.btrim("text", F.lit(" \t\n\r"))).filter("text <> ''")
    refs = F.struct(F.struct(F.array(F.lit("a"), F.lit(" "), F.lit("b")).alias("must_include")).alias("expected_bofip_refs"), F.array("lang").alias("expected_answer_points"))
    row = F.struct(
        F.when(i % 3 == 0, F.concat(F.lit("c"), i)).alias("id"), F.when(i % 3 == 1, F.concat(F.lit("c"), i)).alias("legacy_id"),
        F.when(i % 4 == 0, F.col("text")).alias("runtime_question"), F.when(i % 4 == 1, F.col("text")).alias("user_question"), F.when(i % 4 != 1, F.col("text")).alias("question"),
        F.when(i % 2 == 0, F.lit("")).otherwise(F.lit(None)).alias("theme"), F.col("source").alias("domain"), F.when(i % 2 == 1, F.lit("one")).alias("must_include_sources"), refs.alias("gold_eval"),
    )
    rows = bank.parse_questions(docs.select(i.alias("no"), F.to_json(row).alias("json")))
    return rows.select("no", "id", "question", "theme", F.array_join("required_docs", "|").alias("required_docs"), F.array_join("expected_points", "|").alias("expected_points"))


# --- the loop ---


def gap_client(task: str, payload: dict) -> dict:
    """A stand-in that plans two axes, finds the second missing until passages were relaunched, and cites its first source."""
    if task == "plan":
        words = payload["question"].split()
        return {"facets": [{"name": " ".join(words[:6]), "search_query": " ".join(words[:12]), "role": "core", "blocking": True, "expected_evidence": [" ".join(words[2:6]), " ".join(words[6:10])]}, {"name": " ".join(words[-4:]), "search_query": " ".join(words[-8:]), "priority": "2", "role": "core"}]}
    if task == "review":
        found = payload["chunks"]
        late = any(c["stage"] in ("intra_document", "global_relaunch") for c in found)
        first, second = (payload["axes"] * 2)[:2]
        missing = [] if late else [{"axis": second, "search_query": second, "why_needed": "preuve", "role": "core"}]
        return {"covered_axes": payload["axes"] if late else [first], "missing_axes": missing, "useful_chunk_ids": [c["id"] for c in found[:3]]}
    if not payload["sources"]:
        return {"answer_status": "insufficient_evidence"}
    return {"answer_status": "supported", "conclusion": payload["sources"][0][:80], "bullets": ["selon [1]"], "axes_requis": [g["axis"] for g in payload["review"]["missing"]]}


def looped(spark: SparkSession, d: str, tell=None) -> DataFrame:
    """All questions through the whole loop, with BM25 over chunks and inside documents; replies are kept in the shared folder."""
    items = lexical.stored(chunk_items(spark, d))
    texts = chunks(spark, d).select("item", F.col("ref").alias("_ref"), "title", F.lit("").alias("path"), "text")
    toks = lambda asked_: asked_.select("query_id", t.tokens(F.col("text")).alias("toks"))

    def passages(ranks: DataFrame) -> DataFrame:
        """With their texts: hits are staged, so their size is known, and few of them don't make all texts move."""
        return staged(ranks, "hits").join(texts, "item").select("query_id", "rank", F.coalesce("ref", "_ref").alias("ref"), "item", "title", "path", "text")

    def search(asked_: DataFrame) -> DataFrame:
        return passages(lexical.rank(items, toks(asked_), 8).withColumn("ref", F.lit(None).cast("string")))

    def within(asked_: DataFrame, wanted: DataFrame) -> DataFrame:
        found = lexical.rank(items, toks(asked_), None, ["ref"], wanted.select("query_id", "ref")).filter("rank <= 6")
        w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "item")
        return passages(found.withColumn("rank", F.row_number().over(w)).filter("rank <= 8"))

    by_text, refs = doc_index(spark, d), corpus(spark, d).select("item", "ref")

    def documents(asked_: DataFrame) -> DataFrame:
        return postings.rank(by_text, toks(asked_), 8).join(refs, "item").select("query_id", "ref", "rank")

    client = Recorded(gap_client, f"{shared_dir(spark)}/replies", "gap-2")
    return agent_loop_operator.run(questions(spark, d), search, within, client, tell=tell, documents=documents)


@query()
def agent_loop(spark, d):
    return looped(spark, d)


@query()
def agent_step_timings(spark, d):
    """The loop's steps of every question, from the log that its tasks write, which a stream follows: order, fields, and whether time went on."""
    folder = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    looped(spark, d, events.Emitter(f"{folder}/log", "loop")).write.format("noop").mode("overwrite").save()
    events.follow(spark, f"{folder}/log", f"{folder}/checkpoint", f"{folder}/rows").awaitTermination()
    timed = progress.step_timings(spark.read.parquet(f"{folder}/rows"), "key", "ts", "no")
    return timed.select(F.col("key").alias("query_id"), "no", "label", F.element_at("fields", "sources").alias("sources"), (F.coalesce("step_s", F.lit(0.0)) >= 0).alias("forward"), F.col("elapsed_s").isNotNull().alias("timed"))
