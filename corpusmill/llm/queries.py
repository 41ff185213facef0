"""The registered queries of the training-data operators: whole tables, production parameters.

Queries only derive what is returned (sizes, digests) from their operator's rows.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.bpe import decode, encode, n_tokens
from corpusmill.llm.common import written
from corpusmill.llm.decontamination import decontaminate, n_hit
from corpusmill.llm.html_extract import extract, n_chars
from corpusmill.llm.jaccard import jaccard_join
from corpusmill.llm.langid import declared_language, identify
from corpusmill.llm.linedup import line_dedup
from corpusmill.llm.neardup import embedding_near_dedup
from corpusmill.llm.packing import pack
from corpusmill.llm.quality import quality_rules
from corpusmill.llm.sharding import shard
from corpusmill.llm.vector_codes import digest, vector_codes
from corpusmill.llm.warc import page_id, read_archives, read_warc, records, write_warc
from corpusmill.llm.whitening import long_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> bytes:
    return Path(public_tokenizers.path(name)).read_bytes()


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in 16 shards of a random order; law ``rows``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    rows = shard(_table(spark, sf_dir, "documents"), 16, size, "doc_id")
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return rows.select("doc_id", size.cast("long").alias("size"), crc.cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of ``documents``: word 5-grams, Jaccard similarity of 0.8 or more."""
    return jaccard_join(_table(spark, sf_dir, "documents")).drop("text_hash")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of ``embeddings`` with equal labels and a cosine of 0.98 or more."""
    return embedding_near_dedup(_table(spark, sf_dir, "embeddings"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of ``pages``."""
    rows, name = extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", F.col(name).alias("text"), n_chars(name).alias("n_chars"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in sequences of 4096 ids of ``word_bpe_49k``."""
    pieces = pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document of ``documents``; trusted are the good ones of ``labels``."""
    rows = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of ``documents`` by ``byte_bpe_50k``, and what they decode to."""
    ranks, pattern = _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = _table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = decode(encode(texts, ranks, pattern).select("doc_id", "ids"), ranks, pattern)
    return decoded.select("doc_id", n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as WARC archives, read back; a quarantined stretch would be a row with a null page_id."""
    return _pages_read(read_warc(spark, write_warc(_table(spark, sf_dir, "pages")), payload=False))


def _pages_read(rows: DataFrame) -> DataFrame:
    return rows.select(page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id(F.col("refers_to")).alias("refers_to"))


def _damaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives of 200 records, plain and zipped by turns, with stray bytes between records and one byte changed in those of pages 3, 13, 23, ..."""
    number = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            parts, zipped = [], number % 2
            for record in batch.column("record").slice(at, 200).to_pylist():
                data = record.encode() + b"\r\n\r\n"
                found = re.search(rb"<urn:x-page:(-?\d*)>", data)
                parts.append(bytearray(gzip.compress(data, mtime=0) if zipped else data))
                if found[1].endswith(b"3"):
                    parts[-1][len(parts[-1]) // 2] ^= 1
                    parts.append(b"WARC/1.1\r\nstray \x1f\x8b\x08\r\n")
            yield pa.RecordBatch.from_pydict({"path": [f"part {number}"], "content": [b"".join(parts)]})
            number += 1


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as archives that are half zipped and damaged at every tenth page: what the reader recovers, and gaps with a null page_id as one row."""
    archives = records(_table(spark, sf_dir, "pages")).mapInArrow(_damaged, "path string, content binary")
    rows = written(read_archives(archives, payload=False), "salvaged")
    gaps = rows.filter("gap is not null").agg(F.lit(None).cast("long").alias("page_id"), F.lit(0).cast("long").alias("payload_bytes"), F.lit(None).cast("string").alias("payload_digest"), F.when(F.count(F.lit(1)) > 0, "gap").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return _pages_read(rows.filter("gap is null")).unionByName(gaps.filter("record_type = 'gap'"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without lines that repeat an earlier one with at most one edit: counts and the new text's digest."""
    return _line_counts(line_dedup(_table(spark, sf_dir, "documents")))


def op9_line_dedup_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op9_line_dedup``, and without lines under 20 characters that equal an earlier one."""
    return _line_counts(line_dedup(_table(spark, sf_dir, "documents"), short_repeats=True))


def op9_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op9_line_dedup``, for lines of every length but blank ones: of those under 20 characters too, one that repeats an earlier one with at most one edit goes."""
    return _line_counts(line_dedup(_table(spark, sf_dir, "documents"), min_chars=1, short_repeats=True))


def _line_counts(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of ``documents`` from text, declared language and source."""
    rows = identify(_table(spark, sf_dir, "documents"), declared=F.col("lang"), host=F.col("source"))
    return rows.select("doc_id", "text_lang", "lang_id", "confidence", "kept")


def op10_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of ``pages`` from their whole text without tags, the language that their markup declares, and host and suffix of their address."""
    pages = _table(spark, sf_dir, "pages")
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select("page_id", text.alias("text"), declared_language(F.col("html")).alias("declared"), host.alias("host"))
    found = identify(rows, "page_id", declared=F.col("declared"), host=F.col("host"))
    return found.select(F.col("doc_id").alias("page_id"), "text_lang", "lang_id", "confidence", "kept")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of ``embeddings``."""
    return long_rows(_table(spark, sf_dir, "embeddings"), components=8).withColumnRenamed("id", "vec_id")


def op12_vector_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of ``embeddings``: four parts, 256 entries each, four rounds."""
    rows, books = vector_codes(_table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` inside windows of ten words of ``benchmark``, and the items these are from."""
    rows = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), clean=False)
    items = F.sha2(F.array_join("items", ","), 256)
    return rows.select(F.col("id").alias("doc_id"), "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_warc": op8_warc,
    "op8_warc_salvage": op8_warc_salvage,
    "op9_line_dedup": op9_line_dedup,
    "op9_line_dedup_short": op9_line_dedup_short,
    "op9_line_dedup_whole": op9_line_dedup_whole,
    "op10_language_id": op10_language_id,
    "op10_language_id_pages": op10_language_id_pages,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_vector_compression": op12_vector_compression,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}

_OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a
"""

_OP9_SQL = """
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, i AS no, parts[i] AS s FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut)),
class AS (SELECT s, min((doc_id, no)) AS place, length(s) AS n FROM line WHERE length(s) >= 20 GROUP BY s),
half AS (
  SELECT s, place, n AS k, 1 AS p, left(s, (n // 2)::INT) AS h FROM class
  UNION ALL SELECT s, place, n, 2, right(s, (n - n // 2)::INT) FROM class
  UNION ALL SELECT s, place, n - 1, 1, left(s, ((n - 1) // 2)::INT) FROM class
  UNION ALL SELECT s, place, n - 1, 2, right(s, (n - 1 - (n - 1) // 2)::INT) FROM class
), pair AS (
  SELECT DISTINCT a.s, b.s AS t FROM half a JOIN half b ON a.k = b.k AND a.p = b.p AND a.h = b.h AND a.place > b.place
), place AS (
  SELECT s, t, unnest(range(1, greatest(length(s), length(t)) + 1)) AS i FROM pair
), gone AS (
  SELECT DISTINCT s FROM place
  WHERE (length(s) = length(t) AND left(s, (i - 1)::INT) || substr(s, (i + 1)::INT) = left(t, (i - 1)::INT) || substr(t, (i + 1)::INT))
     OR (length(s) = length(t) + 1 AND left(s, (i - 1)::INT) || substr(s, (i + 1)::INT) = t)
     OR (length(t) = length(s) + 1 AND left(t, (i - 1)::INT) || substr(t, (i + 1)::INT) = s)
), stays AS (
  SELECT l.doc_id, l.no, l.s FROM line l LEFT JOIN class c ON l.s = c.s LEFT JOIN gone g ON l.s = g.s
  WHERE length(l.s) < 20 OR (g.s IS NULL AND c.place = (l.doc_id, l.no))
), made AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY no) AS text, count(*) AS n FROM stays GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(c.parts), 0)::INT AS n_lines, (coalesce(len(c.parts), 0) - coalesce(m.n, 0))::INT AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN length(coalesce(m.text, '')) END::BIGINT AS n_chars,
  CASE WHEN d.text IS NOT NULL THEN md5(coalesce(m.text, '')) END AS text_md5
FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id LEFT JOIN made m ON d.doc_id = m.doc_id
"""

#: As _OP9_SQL, with every line that isn't blank in a class and half-line keys for those of 20 characters or more.
_BLANK = "translate({}, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') = ''"
_OP9_SHORT_SQL = _OP9_SQL.replace("WHERE length(s) >= 20", f"WHERE NOT ({_BLANK.format('s')})").replace(" FROM class", " FROM class WHERE n >= 20")
_OP9_SHORT_SQL = _OP9_SHORT_SQL.replace("WHERE length(l.s) < 20 OR", f"WHERE {_BLANK.format('l.s')} OR")
#: The same with half-line keys for lines of every length.
_OP9_WHOLE_SQL = _OP9_SHORT_SQL.replace(" FROM class WHERE n >= 20", " FROM class")

_OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d HAVING count(*) > 1)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

#: As _OP8_SQL without the pages whose id ends in 3, which were damaged, and with one row for the gaps that they leave.
_OP8_SALVAGE_SQL = f"""
SELECT * FROM ({_OP8_SQL}) WHERE page_id IS NULL OR page_id % 10 <> 3
UNION ALL SELECT NULL, 0, NULL, 'gap', NULL WHERE EXISTS (SELECT 1 FROM pages WHERE page_id % 10 = 3)
"""



def _op12_sql(parts: int = 4, width: int = 16, rounds: int = 4) -> str:
    """Codebooks round by round: ``b{r}`` are the entries, ``a{r}`` the nearest entry of every part (least distance, then least index, as one number)."""
    found = f"""
WITH x AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda c: floor(1024 * c)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), part AS MATERIALIZED (
  SELECT vec_id, label, p, v[{width} * p + 1 : {width} * p + {width}] AS v FROM (SELECT *, unnest(range({parts})) AS p FROM x)
), b0 AS MATERIALIZED (
  SELECT p, e, v FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM x ORDER BY vec_id LIMIT 256) USING (vec_id)
)"""
    for r in range(rounds + 1):
        found += f""", a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, p, min(d * 256 + e) AS de FROM (
    SELECT a.vec_id, a.label, a.p, b.e, (list_dot_product(a.v, a.v) - 2 * list_dot_product(a.v, b.v) + list_dot_product(b.v, b.v))::BIGINT AS d FROM part a JOIN b{r} b ON a.p = b.p
  ) GROUP BY vec_id, p
)"""
        if r < rounds:
            found += f""", s{r} AS MATERIALIZED (
  SELECT p, e, i, sum(c)::BIGINT AS s, count(*) AS n FROM (SELECT p, a.de % 256 AS e, unnest(v) AS c, unnest(range({width})) AS i FROM a{r} a JOIN part USING (vec_id, p)) GROUP BY p, e, i
), b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(g.v, b.v) AS v FROM b{r} b
  LEFT JOIN (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS v FROM s{r} GROUP BY p, e) g ON b.p = g.p AND b.e = g.e
)"""
    return found + f""", coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', de % 256), '' ORDER BY p) AS code, sum(de // 256)::BIGINT AS error FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v::BIGINT[], ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM coded
"""


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_WORDS.format("text")} AS w, least(len(w), 10) AS n FROM benchmark WHERE text IS NOT NULL),
iw AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS k FROM i WHERE n > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
found AS MATERIALIZED (SELECT doc_id, k, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS at FROM (SELECT DISTINCT doc_id, k, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items, sha256(coalesce(m.s, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN items m ON d.doc_id = m.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op8_warc": _OP8_SQL, "op8_warc_salvage": _OP8_SALVAGE_SQL, "op3_embedding_near_dedup": _OP3_SQL, "op9_line_dedup": _OP9_SQL, "op9_line_dedup_short": _OP9_SHORT_SQL, "op9_line_dedup_whole": _OP9_WHOLE_SQL, "op12_vector_compression": _op12_sql(), "op13_benchmark_decontamination": _OP13_SQL}
