"""Which of many strings occur in which texts, by one pass of an automaton over every text.

A text meets all strings at once (Aho and Corasick, 1975): no pair of a text and a string is made unless the string occurs.  The
strings are broadcast in blocks of at most ``MOST_CHARS`` characters, each block a scan; a task builds the block's automaton
once.  Texts are whole.  Null texts and null or empty strings occur nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.staging import no_rows, staged

MOST_CHARS = 2_000_000


def _finder(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, s in enumerate(shared.value):
            automaton.add_word(s, i)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                if text:
                    seen = {which for _, which in automaton.iter(text)}
                    rows += [i] * len(seen)
                    found += [shared.value[which] for which in sorted(seen)]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=[key, "pattern"])

    return run


def occurrences(texts: DataFrame, patterns: DataFrame, key: str, text: str = "text", pattern: str = "pattern") -> DataFrame:
    """``key, pattern``: a row for each text of ``texts(key, text)`` and string of ``patterns(pattern)`` that it contains, once a row of ``texts``."""
    spark = texts.sparkSession
    wanted = staged(patterns.select(F.col(pattern).alias("pattern")).filter(F.length("pattern") > 0).distinct(), "patterns")
    total = wanted.agg(F.sum(F.length("pattern"))).first()[0] or 0
    blocks = 1 if total <= MOST_CHARS else -(-2 * total // MOST_CHARS)
    rows = texts.select(key, F.col(text).alias("text"))
    schema = T.StructType([rows.schema[key], T.StructField("pattern", T.StringType())])
    out = no_rows(spark, schema)
    for block in range(blocks):
        held = [r[0] for r in wanted.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block).collect()]
        if held:
            out = out.unionByName(rows.mapInArrow(_finder(spark.sparkContext.broadcast(held), key), schema))
    return out
