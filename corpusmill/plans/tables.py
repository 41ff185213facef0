"""The driver's tables as a retrieval corpus, in DataFrames and, statement by statement, in DuckDB SQL.

documents -> corpus: reference from language, source and id; title is the first line; a paragraph is a line that
isn't blank; four lines are a section; a chunk is a section's text.  benchmark -> queries.  embeddings -> vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as t


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in fewer partitions than there are cores (small tables) are dealt out to all."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item, ref, title, lang, source, text``."""
    d = table(spark, sf_dir, "documents")
    ref = F.concat_ws("-", F.lit("BOI"), F.upper("lang"), F.upper("source"), F.floor(F.col("doc_id") / 100), F.col("doc_id"))
    return d.select(F.col("doc_id").alias("item"), ref.alias("ref"), F.substring_index("text", "\n", 1).alias("title"), "lang", "source", "text")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item, ref, title, no, section, text`` (normalized, not blank), in order of ``no``."""
    c = corpus(spark, sf_dir)
    rows = c.select("item", "ref", "title", F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    return rows.select("item", "ref", "title", "no", F.floor(F.col("no") / 4).cast("int").alias("section"), t.normalize_ws(F.col("raw")).alias("text")).filter("text <> ''")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item`` (document * 100000 + section), ``doc, ref, title, section, text``: cut within each document's row, without a shuffle."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    four = lambda s: F.transform(F.slice(F.col("lines"), s * 4 + 1, F.lit(4)), t.normalize_ws)
    texts = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 4).cast("int")), lambda s: F.array_join(F.filter(four(s), lambda x: x != ""), "\n"))
    rows = corpus(spark, sf_dir).withColumn("lines", lines).select(F.col("item").alias("doc"), "ref", "title", F.posexplode(texts).alias("section", "text"))
    return rows.filter("text <> ''").select((F.col("doc") * 100000 + F.col("section")).alias("item"), "doc", "ref", "title", "section", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, text``."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"), F.col("label").alias("ref"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector asks all."""
    return vectors(spark, sf_dir).filter("item % 50 = 0").select(F.col("item").alias("query_id"), "vector")


# --- the same in SQL ---


def n(x: str) -> str:
    """normalize_ws"""
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def f(x: str) -> str:
    """folded"""
    return f"lower(strip_accents({n(x)}))"


def tok(x: str) -> str:
    return f"regexp_extract_all({f(x)}, '[A-Za-zÀ-ÿ0-9]+')"


def est(x: str) -> str:
    """token_count"""
    return f"(CASE WHEN {n(x)} = '' THEN 0 ELSE greatest(1, round_even(len(string_split({n(x)}, ' ')) * 1.25, 0)::INT) END)::INT"


CTES = {
    "corpus": ([], "SELECT doc_id AS item, 'BOI-' || upper(lang) || '-' || upper(source) || '-' || (doc_id // 100) || '-' || doc_id AS ref, split_part(text, chr(10), 1) AS title, lang, source, text FROM documents"),
    "line": (["corpus"], "SELECT item, ref, title, i - 1 AS no, parts[i] AS raw FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT item, ref, title, string_split(text, chr(10)) AS parts FROM corpus))"),
    "para": (["line"], f"SELECT item, ref, title, no::INT AS no, (no // 4)::INT AS section, {n('raw')} AS text FROM line WHERE {n('raw')} <> ''"),
    "chunk": (["para"], "SELECT item * 100000 + section AS item, item AS doc, ref, title, section, string_agg(text, chr(10) ORDER BY no) AS text FROM para GROUP BY item, ref, title, section"),
    "question": ([], "SELECT item_id AS query_id, text FROM benchmark"),
    "vec": ([], "SELECT vec_id AS item, embedding::DOUBLE[] AS v, label AS ref FROM embeddings"),
    "vecq": (["vec"], "SELECT item AS query_id, v FROM vec WHERE item % 50 = 0"),
}


def sql(body: str, *needs: str, **own: str) -> str:
    """``body`` after the common table expressions that it needs, in order; ``own`` are its own, by name, after them."""
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in seen:
            before, text = CTES[name]
            for b in before:
                add(b)
            seen[name] = text

    for name in needs:
        add(name)
    parts = [f"{k} AS ({v})" for k, v in {**seen, **own}.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def bm25_ctes(p: str, items: str, queries: str, group: str = "", pairs: str = "") -> dict[str, str]:
    """BM25 in SQL: ``{p}s`` (query_id, [group], item, score) for every item.

    ``items``: a select of [group], item, toks; ``queries``: of query_id, toks; ``pairs``: of query_id, group.
    """
    g, gj = (f"{group}, ", f"AND x.{group} = y.{group}") if group else ("", "")
    asked = f"JOIN ({pairs}) r ON r.query_id = q.query_id JOIN {p}i i ON i.{group} = r.{group}" if pairs else f"CROSS JOIN {p}i i"
    return {
        f"{p}i": items,
        f"{p}q": queries,
        f"{p}t": f"SELECT {g}item, t, count(*) AS tf FROM (SELECT {g}item, unnest(toks) AS t FROM {p}i) GROUP BY {g}item, t",
        f"{p}n": f"SELECT {g}count(*) AS n, avg(len(toks)) AS avgdl FROM {p}i" + (f" GROUP BY {group}" if group else ""),
        f"{p}d": f"SELECT x.*, ln(y.n - x.df + 0.5) - ln(x.df + 0.5) AS raw, y.avgdl FROM (SELECT {g}t, count(*) AS df FROM {p}t GROUP BY {g}t) x JOIN {p}n y ON true {gj}",
        f"{p}m": f"SELECT {g}avg(raw) AS m FROM {p}d" + (f" GROUP BY {group}" if group else ""),
        f"{p}w": f"SELECT x.*, CASE WHEN x.raw < 0 THEN 0.25 * y.m ELSE x.raw END AS idf FROM {p}d x JOIN {p}m y ON true {gj}",
        f"{p}u": f"SELECT query_id, t, count(*) AS times FROM (SELECT query_id, unnest(toks) AS t FROM {p}q) GROUP BY query_id, t",
        f"{p}h": f"SELECT u.query_id, {'x.' + group + ', ' if group else ''}x.item, sum(u.times * y.idf * x.tf * 2.5 / (x.tf + 1.5 * (0.25 + 0.75 * len(i.toks) / y.avgdl))) AS score FROM {p}u u JOIN {p}t x ON x.t = u.t JOIN {p}w y ON y.t = x.t {gj} JOIN {p}i i ON i.item = x.item {'AND i.' + group + ' = x.' + group if group else ''} GROUP BY ALL",
        f"{p}s": f"SELECT q.query_id, {'i.' + group + ', ' if group else ''}i.item, coalesce(h.score, 0.0) AS score FROM (SELECT query_id FROM {p}q WHERE len(toks) > 0) q {asked} LEFT JOIN {p}h h ON h.query_id = q.query_id AND h.item = i.item {'AND h.' + group + ' = i.' + group if group else ''}",
    }


def ranked(p: str, group: str = "", tie: str = "item") -> str:
    """Ranks of ``{p}s``."""
    g = f", {group}" if group else ""
    return f"SELECT *, row_number() OVER (PARTITION BY query_id{g} ORDER BY round(score, 9) DESC, {tie}) AS rank FROM {p}s"
