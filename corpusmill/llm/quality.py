"""Quality rules: word and line statistics, and a hashed n-gram log-likelihood ratio.  DataFrame functions only.

A document's hashed words and word pairs are scored by two multinomials over ``BUCKETS`` buckets: one counted
on trusted documents, one on the whole corpus; both are smoothed.  The verdict is the mean log ratio a gram
(so it doesn't grow with length) against a fixed threshold: every document is judged, none by chance.

The trusted counts come from at most ``trusted_most`` labelled documents, those with the smallest hashes of their
ids (a documented bound: their ids are broadcast); the corpus counts cover all rows.  The counts leave each task as
one partial row a bucket.  The ratios, a fixed number, reach the expressions as a scalar subquery, so scoring
neither shuffles nor joins the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import free_name

BUCKETS = 1 << 16
#: The characters between words, and those that count as symbols.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def repeated_words(hashes: Column) -> Column:
    """How many words lie in a 5-word window that occurs twice or more; ``hashes``: the words' hashes, in order."""
    n = F.size(hashes)
    places = F.when(n >= 5, F.sequence(F.lit(0), n - 5)).otherwise(F.expr("array()").cast("array<int>"))
    windows = F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(5)]))

    def covered(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            near = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: near(x, i - 1) | near(x, i + 1)), lambda x: x["i"]))

        total = lambda p: F.aggregate(F.transform(p, lambda v, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - v, F.lit(5)))), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(let(ordered, twice), total))

    return let(windows, covered)


def grams(hashes: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    n = F.size(hashes)
    places = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.expr("array()").cast("array<int>"))
    pairs = F.transform(places, lambda i: F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i)))
    return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def gram_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, buckets: int = BUCKETS, trusted_most: int = 20_000, smoothing: float = 16.0) -> DataFrame:
    """One row with ``ratios``: for each bucket ln P(bucket | trusted) - ln P(bucket | corpus).

    Either count, the corpus' one at the size of the trusted one, is raised by ``smoothing``: a bucket of which few
    grams are expected says little, so a small trusted set doesn't condemn what it lacks.

    ``labels``: ``doc_id``, ``quality``, ``toxic``; trusted is quality 1 and not toxic.  Without trusted documents, or
    without documents, every ratio is 0 and the ratio rule keeps everything.
    """
    trusted = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()
    trusted = trusted.orderBy(F.xxhash64("_trusted"), "_trusted").limit(trusted_most)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.join(F.broadcast(trusted), F.col("_id") == F.col("_trusted"), "left")
    found = rows.select(F.col("_trusted").isNotNull().cast("long").alias("t"), F.explode(let(word_hashes(F.col("_text")), lambda h: grams(h, buckets))).alias("b"))
    counts = found.groupBy("b").agg(F.count(F.lit(1)).alias("r"), F.sum("t").alias("t"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("t", F.lit(0)).alias("t"))
    one = every.agg(F.sort_array(F.collect_list(F.struct("b", "r", "t"))).alias("c"), F.sum("r").alias("nr"), F.sum("t").alias("nt"))
    a = F.lit(float(smoothing))
    ratio = F.transform("c", lambda x: F.log((x["t"] + a) / (x["r"] * F.col("nt") / F.col("nr") + a)))
    return one.select(F.when(F.col("nt") > 0, ratio).otherwise(F.transform("c", lambda x: F.lit(0.0))).alias("ratios"))


def measures(text: Column, ratios: Column, *, buckets: int = BUCKETS, threshold: float = -0.08, min_words: int = 10, max_repeat: int = 20) -> Column:
    """Struct of ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``llr`` (double), ``base_failed``, ``kept``."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, SPACE) != "")
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def counted(h: Column) -> Column:
        llr = let(grams(h, buckets), lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(ratios, b)) / F.size(g)).otherwise(F.lit(0.0)))
        return F.struct(F.size(h).cast("long").alias("n_words"), repeated_words(h).cast("long").alias("n_repeat_words"), llr.alias("llr"))

    def judged(c: Column) -> Column:
        failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat * c["n_words"])
        return F.struct(
            c["n_words"].alias("n_words"),
            F.length(without(text, SPACE)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            c["llr"].alias("llr"),
            failed.alias("base_failed"),
            (~failed & (c["llr"] >= threshold)).alias("kept"),
        )

    return let(let(word_hashes(text), counted), judged)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = -0.08, **options) -> DataFrame:
    """One row per document: its id and the fields of :func:`measures`.

    A null or empty text has no words and fails; repeated rows are judged alike, each in its own row; a null id is
    never trusted; other columns are not read.  The same corpus and labels give the same verdicts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_ratios", gram_ratios(docs, labels, id_col, text_col, **options).scalar())
    found = measures(F.col("_text"), F.col("_ratios"), buckets=options.get("buckets", BUCKETS), threshold=threshold)
    return rows.select("doc_id", found.alias("_m")).select("doc_id", "_m.*")


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = -0.08, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with their columns as they were."""
    name = free_name(docs, "_ratios")
    rows = docs.withColumn(name, gram_ratios(docs, labels, id_col, text_col, **options).scalar())
    return rows.filter(measures(F.col(text_col), F.col(name), buckets=options.get("buckets", BUCKETS), threshold=threshold)["kept"]).drop(name)
