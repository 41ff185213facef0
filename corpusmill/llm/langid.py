"""Language identification by Bayesian fusion of evidence.

For a document and each language l (and "zxx", no language):

    log P(l | all) = temper * log P(text | l) + log P(declared | l) + log P(l | host) + constant

*   Text: multinomials over hashed byte trigrams, fitted on a bounded sample of rows with a declared language;
    "zxx" is uniform.  Trigrams overlap, so their sum is tempered.
*   Declared markup language: the chance of a declaration given the language, counted over the corpus (what is
    declared against what the text alone says), smoothed.
*   Host and address suffix: priors smoothed down the hierarchy corpus, suffix, host, each level with the weight
    of ``strength`` documents of the level above; counted over the corpus by grouped aggregation.

Counts leave each task as partial sums, so a hot host is one row a task.  Only ids, scores and keys are shuffled,
never texts.  Host priors are broadcast only if they are counted and few; else they are joined, which AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import without_documents, written

LANGUAGES = ("de", "en", "es", "fr")
NO_LANGUAGE = "zxx"
BUCKETS = 1 << 16
FEW_HOSTS = 100_000


def trigram_buckets(data: bytes) -> np.ndarray:
    """Hashed byte trigrams, in order."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def text_bytes(text: str | None) -> bytes:
    """What trigrams are taken from: the lower-case text with one space around it; nothing if it has no letter."""
    text = (text or "").lower()
    return f" {text} ".encode("utf-8", "replace") if any(map(str.isalpha, text)) else b""


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = text_bytes(text)
            if len(data) >= 3:
                totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                totals[lang] += np.bincount(trigram_buckets(data), minlength=BUCKETS)
    for lang, n in totals.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["lang", "b", "n"])


def fit_text_model(docs: DataFrame, id_col: str, text_col: str, declared: Column, languages: tuple[str, ...], sample: int, smoothing: float = 0.5) -> np.ndarray:
    """log P(bucket | language), languages then zxx, from about ``sample`` rows a language (those of the smallest id hashes).

    The result has a fixed size and goes to every task.
    """
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.lit(3)).alias("h"), declared.alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isin(*languages))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(1.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    some = rows.filter(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003).select("lang", "text").repartition(8)
    found = some.mapInArrow(_counter, "lang string, b int, n long").groupBy("lang", "b").agg(F.sum("n").alias("n")).toPandas()
    model = np.full((len(languages) + 1, BUCKETS), -np.log(BUCKETS))
    for i, lang in enumerate(languages):
        n = np.zeros(BUCKETS)
        own = found[found["lang"] == lang]
        n[own["b"].to_numpy()] = own["n"].to_numpy()
        if n.sum():
            model[i] = np.log((n + smoothing) / (n.sum() + smoothing * BUCKETS))
    return model.astype(np.float32)


def _scorer(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = np.zeros((part.num_rows, len(model)))
                grams = np.zeros(part.num_rows, dtype=np.int64)
                for i, text in enumerate(part.column("text").to_pylist()):
                    data = text_bytes(text)
                    for s in range(0, max(0, len(data) - 2), 1 << 20):
                        b = trigram_buckets(data[s : s + (1 << 20) + 2])
                        grams[i] += len(b)
                        scores[i] += model[:, b].sum(axis=1, dtype=np.float64)
                cols = [part.column(n) for n in ("id", "th", "declared", "suffix", "host")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(grams), pa.array(list(scores), pa.list_(pa.float64()))], names=["id", "th", "declared", "suffix", "host", "grams", "ll"])

    return run, "id long, th long, declared string, suffix string, host string, grams long, ll array<double>"


def address_suffix(host: Column) -> Column:
    """The last label of a host name; null if it has no dot or ends in digits."""
    return F.nullif(F.lower(F.regexp_extract(host, r"\.([A-Za-z]{2,24})\.?$", 1)), F.lit(""))


def declared_language(markup: Column) -> Column:
    """The primary language that a page's html element declares, in lower case; else null."""
    return F.nullif(F.lower(F.regexp_extract(markup, r"(?is)<html\s(?:[^>]*?[\s\"'])?(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def _argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, declared: Column, host: Column, suffix: Column | None = None, languages: tuple[str, ...] = LANGUAGES, sample: int = 2000, temper: float = 0.1, strength: float = 20.0, min_confidence: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash``, ``text_lang`` (text alone), ``lang_id``, ``confidence``, ``kept``.

    ``declared``, ``host``, ``suffix``: columns of ``docs`` (strings or null); a null or unknown declaration is "other"
    or "none", a null host or suffix has the prior of the level above.  ``lang_id`` is "zxx" for text without a language
    and for a null, empty or letterless text, whose ``confidence`` is 1.  ``kept``: one of ``languages``, with ``confidence``
    of ``min_confidence`` or more.  Ties go to the first language.  Rows equal in id and text get the same result.
    """
    names = [*languages, NO_LANGUAGE]
    model = fit_text_model(docs, id_col, text_col, declared, languages, sample)
    suffix = address_suffix(host) if suffix is None else suffix
    score, schema = _scorer(model)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), declared.alias("declared"), suffix.alias("suffix"), host.alias("host"), F.col(text_col).alias("text"))
    scored = written(base.mapInArrow(score, schema), "language-scores")
    known = F.when(F.col("declared").isNull(), "none").when(F.col("declared").isin(*languages), F.col("declared")).otherwise("other")
    scored = scored.withColumn("declared", known).withColumn("first", F.when(F.col("grams") > 0, _argmax(F.col("ll"))))

    each = [F.count_if(F.col("first") == i + 1).cast("double") for i in range(len(names))]
    voted = scored.filter("first is not null")
    # Declarations: at most len(languages) + 2 rows.
    table = {r["declared"]: r["c"] for r in voted.groupBy("declared").agg(F.array(*each).alias("c")).collect()}
    totals = [sum(c[i] for c in table.values()) for i in range(len(names))]
    all_votes = sum(totals)
    prior = [(t + 1.0) / (all_votes + len(names)) for t in totals]
    said = F.array(*[F.lit(0.0) for _ in names])
    for value in ("none", "other", *languages):
        logs = [float(np.log((table.get(value, [0.0] * len(names))[i] + 1.0) / (totals[i] + len(languages) + 2))) for i in range(len(names))]
        said = F.when(F.col("declared") == value, F.array(*[F.lit(x) for x in logs])).otherwise(said)

    def below(counts: str, parent: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, parent, lambda c, p: (c + strength * p) / (total + strength))

    hosts = voted.filter("host is not null").groupBy("host", "suffix").agg(F.array(*each).alias("c"))
    hosts = written(hosts, "language-hosts")
    sums = [F.sum(F.col("c")[i]) for i in range(len(names))]
    top = F.array(*[F.lit(p) for p in prior])
    suffixes = hosts.filter("suffix is not null").groupBy("suffix").agg(F.array(*sums).alias("cs")).select("suffix", below("cs", top).alias("ps"))
    priors = hosts.join(suffixes, "suffix", "left").withColumn("ps", F.coalesce("ps", top)).select(F.col("host").alias("at"), F.col("suffix").alias("sfx"), below("c", F.col("ps")).alias("prior"))
    if hosts.count() <= FEW_HOSTS:
        priors = F.broadcast(priors)
    rows = scored.join(priors, (F.col("host") == F.col("at")) & F.col("suffix").eqNullSafe(F.col("sfx")), "left").withColumn("prior", F.coalesce("prior", top))
    logs = F.zip_with(F.zip_with("ll", said, lambda a, b: a * temper + b), "prior", lambda a, p: a + F.log(p))
    rows = rows.withColumn("post", logs)
    best = F.array_max("post")
    confidence = 1 / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    label = F.get(F.array(*[F.lit(x) for x in names]), _argmax(F.col("post")) - 1)
    none = F.col("grams") == 0
    out = rows.select(
        F.col("id").alias("doc_id"),
        F.col("th").alias("text_hash"),
        F.when(none, NO_LANGUAGE).otherwise(F.get(F.array(*[F.lit(x) for x in names]), F.col("first") - 1)).alias("text_lang"),
        F.when(none, NO_LANGUAGE).otherwise(label).alias("lang_id"),
        F.when(none, 1.0).otherwise(F.round(confidence, 6)).alias("confidence"),
    )
    return out.withColumn("kept", (F.col("lang_id") != NO_LANGUAGE) & (F.col("confidence") >= min_confidence))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`identify` keeps, with their columns as they were."""
    return without_documents(docs, identify(docs, id_col, text_col, **options).filter("not kept"), id_col, text_col)
