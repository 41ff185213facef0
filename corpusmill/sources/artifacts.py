"""Artifact sinks: repaired, without secrets, written once whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import text as t


def cleaned(rows: DataFrame) -> DataFrame:
    """String columns with wrongly decoded text repaired."""
    names = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)]
    return rows.withColumns({n: t.repair_mojibake(F.col(n)) for n in names})


def refuse_secrets(rows: DataFrame) -> DataFrame:
    """The rows as they are; a row whose text holds a secret fails the job that reads it."""
    names = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)]
    found = F.lit(False)
    for n in names:
        found = found | F.coalesce(t.contains_secret(F.col(n)), F.lit(False))
    return rows.filter(F.when(found, F.raise_error(F.lit("a secret would be written"))).otherwise(F.lit(True)).cast("boolean"))


def write(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Writes ``json``, ``csv`` (with a header) or ``parquet``; Spark's committer makes the folder appear whole."""
    out = refuse_secrets(cleaned(rows)).write.mode("overwrite")
    if kind == "csv":
        out.option("header", True).csv(path)
    else:
        out.format(kind).save(path)


def evidence_card(query: Column, status: Column, conclusion: Column, bullets: Column, sources: Column) -> Column:
    """A Markdown card of one answer, secrets removed."""
    listed = lambda items, sign: F.array_join(F.transform(items, lambda x: F.concat(F.lit(sign), x)), "\n")
    card = F.concat_ws("\n\n", F.concat(F.lit("# "), t.normalize_ws(query)), F.concat(F.lit("Status: "), status), conclusion, listed(bullets, "- "), F.lit("## Sources"), listed(sources, "- "))
    return t.redact_secrets(card)


def summary_markdown(summary: DataFrame) -> DataFrame:
    """One row, ``text``: a table of :func:`corpusmill.operators.evaluation.summary`."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "part", "name", F.col("n").cast("string"), F.coalesce(F.col("value").cast("string"), F.lit(""))), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "name", line.alias("line")))), lambda x: x["line"])
    return summary.agg(F.concat(F.lit("| part | name | n | value |\n|-|-|-|-|\n"), F.array_join(lines, "\n")).alias("text"))
