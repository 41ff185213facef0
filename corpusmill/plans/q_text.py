"""Queries of the text functions and search texts, over all documents, items or pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import slow
from corpusmill.functions import text as t
from corpusmill.operators import search_text as st
from corpusmill.plans.registry import query
from corpusmill.plans.tables import chunks, corpus, est, f, n, paragraphs, questions, sql, table, tok


def _each(spark: SparkSession, sf_dir: str, name: str, value: Column) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", value.alias(name))


@query(f"SELECT doc_id, {n('text')} AS clean FROM documents")
def normalize_ws(spark, d):
    return _each(spark, d, "clean", t.normalize_ws(F.col("text")))


@query(f"SELECT doc_id, strip_accents({n('text')}) AS plain FROM documents")
def fold_accents(spark, d):
    return _each(spark, d, "plain", t.fold_accents(F.col("text")))


@query(f"SELECT doc_id, array_to_string({tok('text')}, ' ') AS toks, len({tok('text')})::INT AS n FROM documents")
def tokenize(spark, d):
    toks = t.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(toks, " ").alias("toks"), F.size(toks).alias("n"))


@query(f"SELECT doc_id, array_to_string(regexp_extract_all({f('text')}, '[A-Za-zÀ-ÿ0-9][A-Za-zÀ-ÿ0-9\\-_\\.]*'), ' ') AS toks FROM documents")
def tokenize_hyphenated(spark, d):
    return _each(spark, d, "toks", F.array_join(t.tokens(F.col("text"), hyphenated=True), " "))


@query(f"SELECT doc_id, {est('text')} AS n_tokens FROM documents")
def token_count(spark, d):
    return _each(spark, d, "n_tokens", t.token_count(F.col("text")))


@query(sql(f"SELECT item, coalesce(nullif(trim(regexp_replace(lower({n('title')}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'node') AS slug FROM corpus", "corpus"))
def slugify(spark, d):
    return corpus(spark, d).select("item", t.slugify(F.col("title")).alias("slug"))


REF_RE = "\\bBOI-[A-Z0-9]+(?:-[A-Z0-9]+)*\\b"


@query(sql(f"SELECT item, array_to_string(list_transform(regexp_extract_all('see ' || lower(ref) || ', ' || title || ' (' || ref || ')', '{REF_RE}', 0, 'i'), lambda x: upper(x))[1:1], ',') AS refs FROM corpus", "corpus"))
def extract_refs(spark, d):
    """All references of every text, which is followed by a mention of its own."""
    said = F.concat_ws(" ", "text", F.lit("see"), F.lower("ref"), F.concat(F.lit("("), F.col("ref"), F.lit(")")))
    return corpus(spark, d).select("item", F.array_join(t.references(said), ",").alias("refs"))


@query(sql("SELECT item, 'article ' || (item % 300) || ' du CGI' AS refs FROM corpus", "corpus"))
def extract_legal_refs(spark, d):
    """All articles named in every text, which is followed by a made-up one, said twice."""
    article = F.concat(F.lit("rticle "), F.col("item") % 300, F.lit(" du CGI"))
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" see a"), article, F.lit("; and A"), article, F.lit("."))
    return corpus(spark, d).select("item", F.array_join(t.legal_refs(said), ",").alias("refs"))


@query(r"""SELECT doc_id, md5(clean) AS clean_md5, clean <> text AS has_secret FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text,
'\bsk-[A-Za-z0-9_\-]{12,}\b', '[REDACTED_SECRET]', 'g'), '\bhf_[A-Za-z0-9_\-]{12,}\b', '[REDACTED_SECRET]', 'g'),
'\b(api[_-]?key|authorization|x-api-key)\s*[:=]\s*[''"]?[^''"\s]+', '[REDACTED_SECRET]', 'gi') AS clean FROM documents)""")
def redact_secrets(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(F.encode(t.redact_secrets(F.col("text")), "UTF-8")).alias("clean_md5"), t.contains_secret(F.col("text")).alias("has_secret"))


@query(f"SELECT doc_id, CASE WHEN length({n('text')}) <= 80 THEN {n('text')} ELSE rtrim(left({n('text')}, 77)) || '...' END AS short FROM documents")
def clip_text(spark, d):
    return _each(spark, d, "short", t.clip(F.col("text"), 80))


@query(f"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({f('text')}, '\\d(?:[\\d\\s .,]*\\d)?'),
lambda x: CASE WHEN length(regexp_replace(x, '\\D', '', 'g')) >= 3 OR regexp_matches(x, '[\\s .]') THEN regexp_replace(x, '\\D', '', 'g') END), lambda x: x IS NOT NULL))), ','), '') AS numbers FROM documents""")
def numeric_tokens(spark, d):
    plain = F.filter(t.numeric_tokens(F.col("text")), lambda x: x.rlike(r"^\d+$"))
    return _each(spark, d, "numbers", F.array_join(F.sort_array(plain), ","))


@query("SELECT doc_id, CASE WHEN doc_id % 7 + 1 = doc_id % 5 + 1 THEN (doc_id % 7 + 1)::VARCHAR ELSE (doc_id % 7 + 1) || ',' || (doc_id % 5 + 1) END AS ids FROM documents")
def citation_ids(spark, d):
    """All cited numbers of every text, which is followed by made-up citations."""
    said = F.concat(F.lit("["), F.col("doc_id") % 7 + 1, F.lit(", x] and ["), F.col("doc_id") % 7 + 1, F.lit(","), F.col("doc_id") % 5 + 1, F.lit("] "))
    said = F.concat_ws(" ", "text", F.replace(said, F.lit(", x"), F.lit("")))
    return _each(spark, d, "ids", F.array_join(t.citation_ids(said), ","))


@query(f"""SELECT query_id, regexp_matches(strip_accents({n('text')}), '\\b(seuil|seuils|taux|plafond|plafonds|bareme|chiffre\\s+d[''’ ]affaires|combien|calcul|calcule|pourcentage|euros?|ht|hors\\s+taxe)\\b', 'i') AS numeric,
contains({f('text')}, 'regle generale') OR contains({f('text')}, 'regles generales') OR contains({f('text')}, 'droit commun') OR contains({f('text')}, 'principes generaux') AS general,
contains({f('text')}, 'derogation') OR contains({f('text')}, 'exception') AS exception, contains({f('text')}, 'rescrit') OR contains({f('text')}, 'boi-res') AS rescript
FROM (SELECT item_id AS query_id, text || CASE item_id % 4 WHEN 0 THEN ' Quel est le taux ?' WHEN 1 THEN ' règle générale' WHEN 2 THEN ' dérogation' ELSE ' rescrit BOI-RES-1' END AS text FROM benchmark)""")
def intent_flags(spark, d):
    tail = F.when(F.col("query_id") % 4 == 0, " Quel est le taux ?").when(F.col("query_id") % 4 == 1, " règle générale").when(F.col("query_id") % 4 == 2, " dérogation").otherwise(" rescrit BOI-RES-1")
    q = questions(spark, d).withColumn("text", F.concat("text", tail))
    return q.select("query_id", t.numeric_intent(F.col("text")).alias("numeric"), t.general_rule_intent(F.col("text")).alias("general"), t.exception_intent(F.col("text")).alias("exception"), t.rescript_intent(F.col("text")).alias("rescript"))


@query(sql(f"SELECT item, no, {est('text')} <= 5 AND (regexp_full_match(text, '[\\W_]+|\\(\\d+(?:[-–]\\d+)?\\)|\\d+(?:[-–]\\d+)?|N(?:[+-]\\d+)?|Article\\s+\\d+(?:\\s+et\\s+\\d+)?|Cf\\..*|Remarques?\\s*:?', 'i') OR length(text) <= 12) AS trivial FROM para", "para"))
def trivial_fragments(spark, d):
    return paragraphs(spark, d).select("item", "no", t.trivial_fragment(F.col("text")).alias("trivial"))


SIG = "list_filter(regexp_extract_all({x}, '[a-z0-9]+', 0, 'i'), lambda w: length(w) >= 4 AND NOT list_contains(['avec','dans','dois','dont','elle','egal','etre','fait','fixe','hors','leur','pour','quel','quelle','sans','taxe'], w))"


@query(f"""SELECT query_id, len(list_distinct(s))::INT AS n_terms, (SELECT count(DISTINCT s[i] || ' ' || s[i + 1]) FROM range(1, len(s)) r(i))::INT AS n_bigrams
FROM (SELECT item_id AS query_id, {SIG.format(x=f('text'))} AS s FROM benchmark)""")
def significant_bigrams(spark, d):
    s = t.significant_tokens(F.col("text"))
    return questions(spark, d).select("query_id", F.size(F.array_distinct(s)).alias("n_terms"), F.size(t.bigrams(s)).alias("n_bigrams"))


@query(sql("""SELECT item, array_to_string(CASE WHEN regexp_full_match(p[-1], '\\d{8}') THEN p[:-2] ELSE p END, '/') AS core,
len(CASE WHEN regexp_full_match(p[-1], '\\d{8}') THEN p[:-2] ELSE p END)::INT AS depth FROM (SELECT item, string_split(ref || CASE WHEN item % 2 = 0 THEN '-20240115' ELSE '' END, '-') AS p FROM corpus)""", "corpus"))
def reference_core(spark, d):
    parts = t.reference_parts(F.concat("ref", F.when(F.col("item") % 2 == 0, "-20240115").otherwise("")))
    return corpus(spark, d).select("item", F.array_join(parts, "/").alias("core"), F.size(parts).alias("depth"))


@query(sql("""SELECT item, starts_with(lower(ref), 'boi-en-src1') AS by_prefix, regexp_matches(ref, '^BOI-EN-SRC1(-|$)') AS is_child,
(CASE WHEN p[2] <> 'EN' THEN 0 WHEN p[3] <> 'SRC1' THEN 1 ELSE 2 END)::INT AS depth FROM (SELECT *, string_split(ref, '-') AS p FROM corpus)""", "corpus"))
def reference_predicates(spark, d):
    ref, target = F.col("ref"), F.lit("BOI-EN-SRC1")
    return corpus(spark, d).select("item", t.matches_prefix(ref, target).alias("by_prefix"), t.exact_or_child(ref, target).alias("is_child"), t.match_depth(ref, target).alias("depth"))


@query(sql(f"SELECT item, concat_ws(chr(10), ref, nullif(title, ''), lang || ' ' || source) AS search_text FROM corpus WHERE {n('title')} <> '' UNION ALL SELECT item, concat_ws(chr(10), ref, lang || ' ' || source) FROM corpus WHERE {n('title')} = ''", "corpus"))
def doc_text_base(spark, d):
    return corpus(spark, d).select("item", st.document_base(st.fields(F.col("ref"), F.col("title"), F.array("lang", "source"))).alias("search_text"))


@query(sql(f"""SELECT item, concat_ws(chr(10), ref, CASE WHEN len(s) >= 2 THEN s[-2] || ' - ' || s[-1] ELSE s[1] END) AS search_text
FROM (SELECT item, ref, list_filter(list_transform(string_split({n("title || ' - ' || lang || ' - ' || source")}, ' - '), lambda x: trim(x)), lambda x: x <> '') AS s FROM corpus)""", "corpus"))
def doc_text_title_tail(spark, d):
    title = F.concat_ws(" - ", "title", "lang", "source")
    return corpus(spark, d).select("item", st.document_title_tail(F.col("ref"), title).alias("search_text"))


_HEAD = "first_line AS (SELECT item, ref, section, arg_min(text, no) AS head FROM para GROUP BY item, ref, section)"


@query(sql("""SELECT c.item, concat_ws(chr(10), c.ref, nullif(trim(c.title), ''), s.heads) AS search_text FROM corpus c
LEFT JOIN (SELECT item, string_agg(head, ' ' ORDER BY section) AS heads FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY section) AS r FROM first_line) WHERE r <= 12 GROUP BY item) s ON s.item = c.item""", "corpus", "para", first_line="SELECT item, ref, section, arg_min(text, no) AS head FROM para GROUP BY item, ref, section"))
def doc_text_sections(spark, d):
    heads = st.section_heads(paragraphs(spark, d))
    rows = corpus(spark, d).join(heads, "item", "left")
    return rows.select("item", st.joined(F.col("ref"), F.trim("title"), F.array_join(F.slice("heads", 1, 12), " ")).alias("search_text"))


@query(sql("""SELECT c.item, concat_ws(chr(10), c.ref, s.first) AS search_text FROM corpus c
LEFT JOIN (SELECT item, string_agg(text, ' ' ORDER BY no) AS first FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY no) AS r FROM para) WHERE r <= 3 GROUP BY item) s ON s.item = c.item""", "corpus", "para"))
def doc_text_firstpara(spark, d):
    first = st.paragraphs_of(paragraphs(spark, d))
    rows = corpus(spark, d).join(first, "item", "left")
    return rows.select("item", st.joined(F.col("ref"), F.array_join(F.slice("texts", 1, 3), " ")).alias("search_text"))


SNIPPET = "left(CASE WHEN contains(x, '. ') THEN split_part(x, '. ', 1) WHEN contains(x, ' ; ') THEN split_part(x, ' ; ', 1) WHEN contains(x, ' : ') THEN split_part(x, ' : ', 1) ELSE x END, 220)"


@query(sql(f"""SELECT c.item, concat_ws(chr(10), c.ref, s.leads) AS search_text FROM corpus c
LEFT JOIN (SELECT item, string_agg({SNIPPET}, ' ' ORDER BY section) AS leads FROM (SELECT item, section, arg_min(text, no) AS x, row_number() OVER (PARTITION BY item ORDER BY section) AS r FROM para GROUP BY item, section) WHERE r <= 8 GROUP BY item) s ON s.item = c.item""", "corpus", "para"))
def doc_text_leads(spark, d):
    heads = st.section_heads(paragraphs(spark, d))
    rows = corpus(spark, d).join(heads, "item", "left")
    leads = F.transform(F.slice("heads", 1, 8), t.first_sentence)
    return rows.select("item", st.joined(F.col("ref"), F.array_join(leads, " ")).alias("search_text"))


@query(sql("SELECT item, concat_ws(chr(10), ref, trim(title || ' section ' || section), text) AS search_text FROM chunk", "chunk"))
def chunk_text_full(spark, d):
    path = F.array(F.trim(F.concat_ws(" ", "title", F.lit("section"), "section")))
    return chunks(spark, d).select("item", st.chunk_full(F.col("ref"), path, F.expr("cast(array() as array<string>)"), F.col("text")).alias("search_text"))


@query(sql("SELECT item, concat_ws(chr(10), 'section ' || section, text) AS search_text FROM chunk", "chunk"))
def chunk_text_leaf(spark, d):
    path = F.array(F.col("title"), F.concat_ws(" ", F.lit("section"), "section"))
    return chunks(spark, d).select("item", st.chunk_leaf(path, F.expr("cast(array() as array<string>)"), F.col("text")).alias("search_text"))


@query(sql("SELECT query_id, 'query: ' || trim(text) AS query_text, 'passage: ' || trim(text) AS passage_text FROM question", "question"))
def dense_texts(spark, d):
    clean = F.trim(F.col("text"))
    return questions(spark, d).select("query_id", st.query_text(clean, "multilingual-e5-large").alias("query_text"), st.passage_text(clean, "multilingual-e5-large").alias("passage_text"))


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))::INT AS n_links FROM pages")
def html_titles(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("n_links"))


@query("SELECT sha256(string_agg(sha256(url || chr(9) || length(html) || chr(9) || page_id), '' ORDER BY url, page_id)) AS fingerprint FROM pages")
def fingerprint(spark, d):
    from corpusmill.sources.manifest import fingerprint_rows

    row = F.concat_ws("\t", "url", F.length("html"), "page_id")
    return fingerprint_rows(table(spark, d, "pages"), [F.col("url"), F.col("page_id")], row)


@query()
def stem_tokens(spark, d):
    return _each(spark, d, "stems", F.array_join(slow.stems(F.col("text")), " "))


@query("SELECT doc_id, text AS repaired FROM documents")
def repair_mojibake(spark, d):
    latin = F.col("text").rlike(r"^[\x00-\xff]*$")
    broken = F.when(latin, F.decode(F.encode(F.col("text"), "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    return _each(spark, d, "repaired", t.repair_mojibake(broken))


@query()
def html_unescape(spark, d):
    """Every page with all its character references decoded."""
    return table(spark, d, "pages").select("page_id", t.unescape(F.col("html")).alias("html"))


# Every text followed by what the common cases lack: references with and without semicolon, by number, in Windows' range and
# decoded once only; ligatures, powers, fractions, decomposed letters and syllables; white space other than ASCII's.
_HARD = " &eacute;t&eacute; 2&euro;&nbsp;&notit; &#233;&#x20AC;&#128; ﬁscal m² e\u0301te\u0301\u2003½\x1c각 &amp;lt; &unknown;"
_HARD_CLEAN = "été 2€ ¬it; é€€ ﬁscal m² e\u0301te\u0301 ½ 각 &lt; &unknown;"
_HARD_PLAIN = "ete 2€ ¬it; e€€ fiscal m2 ete 1⁄2 \u1100\u1161\u11a8 &lt; &unknown;"


def _hard() -> Column:
    return F.concat("text", F.lit(_HARD))


@query(f"SELECT doc_id, ltrim({n('text')} || ' {_HARD_CLEAN}') AS clean FROM documents")
def normalize_ws_hard(spark, d):
    return _each(spark, d, "clean", t.normalize_ws(_hard()))


@query(f"SELECT doc_id, ltrim(strip_accents({n('text')}) || ' {_HARD_PLAIN}') AS plain FROM documents")
def fold_accents_hard(spark, d):
    return _each(spark, d, "plain", t.fold_accents(_hard()))


@query(f"SELECT doc_id, array_to_string(list_concat({tok('text')}, ['ete', '2', 'it', 'e', 'fiscal', 'm2', 'ete', '1', '2', 'lt', 'unknown']), ' ') AS toks FROM documents")
def tokenize_hard(spark, d):
    return _each(spark, d, "toks", F.array_join(t.tokens(_hard()), " "))


@query("SELECT doc_id, 'article\u00a0279\u00a0du CGI|CGI\u2009art.\u00a07' AS refs FROM documents")
def legal_refs_hard(spark, d):
    """Articles after every text, with white space that isn't ASCII's, a letter that ends them, and one that isn't one: ``é`` is part of a word."""
    said = F.concat("text", F.lit(" article\u00a0279\u00a0du CGI; CGI\u2009art.\u00a07\u2003État; éCGI art. 9"))
    return _each(spark, d, "refs", F.array_join(t.legal_refs(said), "|"))


_FRAGMENTS = {"русский текст здесь": False, "— § …": True, "§§§§ ---- §§§§ ----": True, "(12–14)": True, "Article 279 et 280": True, "Article\u00a0279 et\u00a0281": True, "Cf. la suite": True, "Remarques :": True, "дом": True, "deux mots à lire": False, "１２３４５６７８９０１２３４５": True, "N+1": True}


@query("SELECT doc_id, i AS no, CASE i " + " ".join(f"WHEN {i} THEN {str(v).lower()}" for i, v in enumerate(_FRAGMENTS.values())) + f" END AS trivial FROM documents, range({len(_FRAGMENTS)}) r(i)")
def trivial_fragments_hard(spark, d):
    """Fragments in several scripts, for every document."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.array(*[F.lit(x) for x in _FRAGMENTS])).alias("i", "text"))
    return rows.select("doc_id", F.col("i").cast("long").alias("no"), t.trivial_fragment(F.col("text")).alias("trivial"))


_NUMBERS = " Avec 3 maisons de campagne et un jardin clos de murs hauts; 12345678901234567890 Euros pour la parcelle entiere du domaine; le 12 mai en soiree avec des amis du village; en 1999, 1999 euros; 1\u00a0500 puis 1 500 € ou 007 pour  cent"
_NUMBER_RE = "(\\d[\\d\\s\u00a0]*\\d+|\\d+)[\\s\u00a0]*(euros?|€|%|pour[\\s\u00a0]*cent)?"
_MONTH_RE = "\\b(janvier|fevrier|février|mars|avril|mai|juin|juillet|aout|août|septembre|octobre|novembre|decembre|décembre)\\b"


@query(f"""WITH RECURSIVE said AS (SELECT doc_id, text || '{_NUMBERS}' AS x FROM documents),
found AS (SELECT doc_id, x, regexp_extract_all(x, '{_NUMBER_RE}', 0, 'i') AS m, regexp_extract_all(x, '{_NUMBER_RE}', 1, 'i') AS num, regexp_extract_all(x, '{_NUMBER_RE}', 2, 'i') AS unit FROM said),
place AS (SELECT doc_id, 0 AS i, 1::BIGINT AS at, 1::BIGINT AS after FROM found UNION ALL
  SELECT p.doc_id, p.i + 1, p.after + instr(substr(f.x, p.after), f.m[p.i + 1]) - 1, p.after + instr(substr(f.x, p.after), f.m[p.i + 1]) - 1 + length(f.m[p.i + 1]) FROM place p JOIN found f ON f.doc_id = p.doc_id WHERE p.i < len(f.m)),
fact AS (SELECT p.doc_id, f.num[p.i] AS num, lower(f.unit[p.i]) AS unit, trim(replace(substr(f.x, greatest(1, p.at - 40), p.after + 40 - greatest(1, p.at - 40)), chr(10), ' '), ' ' || chr(9) || chr(11) || chr(12) || chr(13) || '\u00a0') AS context FROM place p JOIN found f ON f.doc_id = p.doc_id WHERE p.i > 0),
whole AS (SELECT *, coalesce(nullif(ltrim(replace(num, ' ', ''), '0'), ''), '0') AS value FROM fact WHERE regexp_full_match(num, '[0-9 ]+'))
SELECT doc_id, value, CASE WHEN unit IN ('euro', 'euros', '€') THEN 'euros' WHEN unit IN ('%', 'pour cent') THEN '%' ELSE 'nombre' END AS unit, context FROM whole
WHERE unit <> '' OR NOT (try_cast(value AS HUGEINT) BETWEEN 1900 AND 2100 OR try_cast(value AS HUGEINT) BETWEEN 1 AND 31 AND regexp_matches(context, '{_MONTH_RE}', 'i'))""")
def extract_numbers(spark, d):
    """All numbers of every text, which is followed by some that tell the rules apart."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(slow.numbers(F.concat("text", F.lit(_NUMBERS)))).alias("x"))
    return rows.select("doc_id", "x.value", "x.unit", "x.context")
