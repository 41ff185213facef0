"""The corpus pipeline: quality rules, language ID, line dedup, near copies, packing; each stage is written and read again."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import written
from corpusmill.llm.jaccard import drop_near_copies
from corpusmill.llm.langid import keep_identified
from corpusmill.llm.linedup import line_dedup
from corpusmill.llm.packing import pack
from corpusmill.llm.quality import keep_quality, without


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; trusted are the good ones of ``labels``."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with confidence."""
    return keep_identified(docs, declared=F.col("lang"), host=F.col("source"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those of which no word is left go."""
    rows = line_dedup(docs, short_repeats=True).filter((F.col("n_removed") == 0) | (without(F.col("text"), " \t\n\x0b\x0c\r") != ""))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences of at most 4096: one row a piece."""
    pieces = pack(docs, Path(public_tokenizers.path("word_bpe_49k.json")).read_bytes())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("language", language), ("lines", lines), ("near_copies", near_copies), ("packing", packing)]

#: SQL can't express the hashed counts, the trigram model or the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
