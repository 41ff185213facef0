"""Queries of chunking, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import chunking
from corpusmill.plans.registry import query
from corpusmill.plans.tables import corpus, paragraphs, sql

_TRIVIAL = "regexp_full_match(text, '[\\W_]+|\\(\\d+(?:[-–]\\d+)?\\)|\\d+(?:[-–]\\d+)?|N(?:[+-]\\d+)?|Article\\s+\\d+(?:\\s+et\\s+\\d+)?|Cf\\..*|Remarques?\\s*:?', 'i')"
_UNITS = {
    "pt": f"SELECT *, CASE WHEN greatest(1, round_even(len(string_split(text, ' ')) * 1.25, 0)) <= 5 AND ({_TRIVIAL} OR length(text) <= 12) THEN 0 ELSE 1 END AS p FROM para",
    "pu": "SELECT *, greatest(0, least(coalesce(sum(p) OVER (PARTITION BY item, section ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), sum(p) OVER (PARTITION BY item, section) - 1))::INT AS unit FROM pt",
    "un": "SELECT item, section, unit, min(no) AS first_no, max(no) AS last_no, sum(len(string_split(text, ' ')))::INT AS n_words, string_agg(text, chr(10) || chr(10) ORDER BY no) AS text FROM pu GROUP BY item, section, unit",
}


@query(sql("SELECT * FROM un", "para", **_UNITS))
def paragraph_units(spark, d):
    return chunking.paragraph_units(paragraphs(spark, d))


@query(sql("SELECT item, section, unit, md5(text) AS text_md5 FROM un", "para", **_UNITS))
def chunks_paragraph(spark, d):
    return chunking.paragraph_units(paragraphs(spark, d)).select("item", "section", "unit", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


_EST = "greatest(1, round_even({} * 1.25, 0))"
_WINDOWS = {
    **_UNITS,
    "wi": f"""SELECT item, section, unit, n_words, text, n_words AS total, 0 AS w FROM un WHERE unit = 0 UNION ALL
      SELECT u.item, u.section, u.unit, u.n_words, u.text, CASE WHEN {_EST.format('(x.total + u.n_words)')} > 120 THEN u.n_words ELSE x.total + u.n_words END, x.w + CASE WHEN {_EST.format('(x.total + u.n_words)')} > 120 THEN 1 ELSE 0 END
      FROM wi x JOIN un u ON u.item = x.item AND u.section = x.section AND u.unit = x.unit + 1""",
}


@query(sql(f"SELECT item, section, w AS \"window\", count(*)::INT AS n_units, sum(n_words)::INT AS n_words, {_EST.format('sum(n_words)')}::INT AS n_tokens, md5(string_agg(text, chr(10) || chr(10) ORDER BY unit)) AS text_md5 FROM wi GROUP BY item, section, w", "para", **_WINDOWS))
def chunks_section_window(spark, d):
    rows = chunking.section_windows(chunking.paragraph_units(paragraphs(spark, d)), 120)
    return rows.withColumn("text_md5", F.md5(F.encode("text", "UTF-8"))).drop("text")


def structured(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their sections and paragraphs, as the chunker takes them."""
    p = paragraphs(spark, d)
    name = F.concat(F.lit("s"), F.col("section"))
    para = F.struct("no", F.concat(F.lit("p"), F.col("no")).alias("paragraph_id"), name.alias("section_id"), "text", F.expr("cast(array() as array<string>)").alias("legal_refs"))
    section = F.struct("section", name.alias("section_id"), F.array("title", name).alias("path"))
    rows = p.groupBy("item").agg(F.array_sort(F.collect_list(para)).alias("paragraphs"), F.array_sort(F.collect_set(section)).alias("sections"))
    c = corpus(spark, d).select("item", F.col("item").cast("string").alias("document_id"), F.col("ref").alias("boi_reference"), "title", F.lit(None).cast("string").alias("publication_date"))
    none = F.expr("cast(array() as array<struct<table_id:string,section_id:string,order_index:int,linearized_text:string,legal_refs:array<string>>>)")
    return c.join(rows, "item").withColumn("tables", none).drop("item")


@query()
def chunks_parent_child(spark, d):
    return chunking.build_chunks(structured(spark, d), "parent_child")


@query()
def merge_small(spark, d):
    return chunking.build_chunks(structured(spark, d), "section_window")


@query()
def split_text(spark, d):
    return chunking.build_chunks(structured(spark, d), "paragraph_preserving", max_tokens=60)
