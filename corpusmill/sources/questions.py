"""Question banks: JSON arrays, objects with ``cases``, or JSON lines, with the several names that fields go by."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators import sampling

#: Where each field is looked for, in this order; lists may also be a single text.
TEXTS = {
    "theme": ["theme", "domain"], "difficulty": ["difficulty"], "question_type": ["question_type", "type"], "expected_status": ["expected_status", "gold_eval.expected_status"],
    "expected_calculation": ["expected_calculation", "gold_eval.expected_calculation"],
}
LISTS = {
    "expected_points": ["expected_answer_core", "gold_eval.expected_answer_points"],
    "required_docs": ["required_docs", "must_include_sources", "gold_eval.expected_bofip_refs.must_include"],
    "optional_docs": ["optional_docs", "should_include_sources", "gold_eval.expected_bofip_refs.should_include"],
    "failure_signals": ["failure_signals", "gold_eval.failure_signals"],
}
IDS = ["id", "query_id", "legacy_id"]


def _first(row: Column, names: list[str]) -> Column:
    """The first of the fields that says something: empty texts and lists, zero and false say nothing."""
    found = [F.get_json_object(row, f"$.{n}") for n in names]
    return F.coalesce(*[F.when(~f.isin("", "[]", "{}", "0", "false"), f) for f in found])


def _listed(value: Column) -> Column:
    items = F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>")).otherwise(F.array(value))
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")


def parse_questions(rows: DataFrame) -> DataFrame:
    """``no, json`` to ``no, id, question`` and the fields of :data:`TEXTS` and :data:`LISTS`.

    A row without a question, or whose ``runtime_question`` isn't the same as another question it has, fails the job that
    reads it.
    """
    row = F.col("json")
    text = lambda name: F.trim(F.coalesce(F.get_json_object(row, f"$.{name}"), F.lit("")))
    asked, others = text("runtime_question"), [text("user_question"), text("question")]
    unlike = functools.reduce(lambda a, b: a | b, [(o != "") & (o != asked) for o in others])
    where = F.concat(F.lit(" at row "), F.col("no").cast("string"))
    question = F.coalesce(*[F.nullif(x, F.lit("")) for x in (asked, *others)])
    question = F.when((asked != "") & unlike, F.raise_error(F.concat(F.lit("questions differ"), where)).cast("string")).otherwise(F.coalesce(question, F.raise_error(F.concat(F.lit("no question"), where)).cast("string")))
    number = F.col("no").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)  # lpad cuts what is longer
    named = F.coalesce(_first(row, IDS), F.concat(F.lit("Q"), padded))
    return rows.select("no", named.alias("id"), question.alias("question"), *[F.coalesce(_first(row, n), F.lit("")).alias(k) for k, n in TEXTS.items()], *[_listed(_first(row, n)).alias(k) for k, n in LISTS.items()])


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """:func:`parse_questions` of one file; a bank is a file that people write, so it is read whole, in order."""
    whole = spark.read.text(path, wholetext=True)
    text = F.trim(F.regexp_replace("value", "^\ufeff", ""))
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")
    if path.endswith(".json"):
        array = F.when(F.startswith(text, F.lit("[")), text).otherwise(F.get_json_object(text, "$.cases"))
        found = F.coalesce(F.from_json(array, "array<string>"), F.raise_error(F.lit("neither an array nor an object with cases")).cast("array<string>"))
    else:
        found = lines
    return parse_questions(whole.select(F.posexplode(found).alias("_no", "json")).select((F.col("_no") + 1).alias("no"), "json"))


def select_questions(bank: DataFrame, ids: list[str] | None = None, sample: int = 0, limit: int = 0, seed: int = 42) -> DataFrame:
    """The cases ``ids`` in that order (an unknown one fails the job), then a seeded sample, then the first ``limit``."""
    if ids:
        spark = bank.sparkSession
        wanted = spark.createDataFrame([(i, x.strip()) for i, x in enumerate(ids, start=1) if x.strip()], "_no int, id string")
        last = bank.withColumn("_w", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("no")))).filter("_w = 1").drop("_w")
        rows = wanted.join(last.withColumn("_known", F.lit(True)), "id", "left")
        known = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown case: "), "id"))).otherwise(F.lit(True)).cast("boolean")
        bank = rows.filter(known).withColumn("no", F.col("_no")).select(*bank.columns)
    if sample:
        bank = sampling.random_sample(bank, F.col("id"), sample, seed=seed)
    return bank.orderBy("no").limit(limit) if limit else bank
