"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import bpe, html_extract, jaccard, langid, linedup, neardup, packing, quality, sharding, warc

LONG = "word%d other thing, and more. " * 6000
TEXTS = [(1, "a line of words that is long enough\nshort"), (1, "a line of words that is long enough\nshort"), (2, ""), (3, None), (None, "the same words as others have in it"), (4, "the same words as others have in it"), (5, "x" * 30_000), (6, LONG), (7, " \n\t "), (1, "another text under the same id, all different")]
CLASH = ["kept", "shard", "slot", "bucket", "pos", "mark", "n_lines", "n_removed", "ids", "decoded", "main_text", "llr", "fp", "th", "id", "rank", "grp", "_ratios", "_made", "nul", "host", "gone_id", "gone_text", "bucket_group", "bucket_number", "before", "every", "all", "run", "n", "number", "_b", "_o", "_n", "_c", "_g", "b", "bi", "bj", "_gone_id", "_gone_th", "doc_id_1", "text_hash", "cls", "key", "keys", "sketch", "grams", "declared", "suffix", "score", "record", "path", "content", "step", "bytes"]
WORDS = Path(public_tokenizers.path("word_bpe_49k.json")).read_bytes()
BYTES = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
    return df.withColumns({c: F.lit("z") for c in CLASH})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, None), (4, 0, 1)], "doc_id long, quality int, toxic int")


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 3, F.octet_length("text"), "doc_id").collect()
    assert len(rows) == len(TEXTS)
    assert sorted(r["shard"] for r in rows).count(0) == 4
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.shard(empty, 3, F.octet_length("text"), "doc_id").count() == 0


def test_jaccard(docs, empty):
    rows = jaccard.jaccard_join(docs).collect()
    assert len(rows) == len(TEXTS)
    same = [r for r in rows if r["n_links"] == 1]
    assert {r["doc_id"] for r in same} == {1, 4, None}
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [False]
    assert all(r["kept"] for r in rows if r["doc_id"] in (2, 3, 7))
    left = jaccard.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len(TEXTS) - 1
    assert jaccard.jaccard_join(empty).count() == 0


def test_embeddings(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 2), (9, [1.0, 0.0], 2), (10, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("fp", F.lit(1))
    found = neardup.embedding_near_dedup(df)
    out = {(r["vec_id"], r["n_links"]): r for r in found.collect()}
    assert found.count() == len(rows)
    assert out[(1, 2)]["kept"] and out[(2, 2)]["component_id"] == 1
    assert all(out[(i, 0)]["kept"] for i in (3, 4, 5, 6, 7, 8, 10))
    assert out[(None, 1)]["component_id"] == 9
    assert neardup.embedding_near_dedup(df.limit(0)).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, WORDS, size=64, open_windows=2, merge_windows=2).collect()
    per_window = {}
    for r in rows:
        per_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in per_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r["length"] for r in rows if r["doc_id"] == 6) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 6)
    assert [r["length"] for r in rows if r["doc_id"] == 3] == [1]
    assert packing.pack(empty, WORDS).count() == 0


def test_quality(docs, empty, labels):
    rows = quality.quality_rules(docs, labels).collect()
    assert len(rows) == len(TEXTS)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (2, 3, 5, 7))
    assert [r["n_words"] for r in rows if r["doc_id"] == 3] == [0]
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    kept.collect()
    assert quality.quality_rules(docs, labels.limit(0)).filter("llr <> 0").count() == 0
    assert quality.quality_rules(empty, labels).count() == 0


def test_bpe(docs, empty):
    pattern = public_tokenizers.PATTERN
    rows = bpe.decode(bpe.encode(docs, BYTES, pattern), BYTES, pattern).collect()
    assert len(rows) == len(TEXTS)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows)
    assert bpe.encode(empty, BYTES, pattern).count() == 0


def test_lines(docs, empty):
    rows = linedup.line_dedup(docs).collect()
    assert len(rows) == len(TEXTS)
    first = [r["text"] for r in rows if r["doc_id"] == 1 and r["n_lines"] == 2]
    assert first == ["a line of words that is long enough\nshort"] * 2  # rows equal in id and text are one document
    assert [r["text"] for r in rows if r["doc_id"] is None] == [""]
    assert [r["text"] for r in rows if r["doc_id"] == 4] == ["the same words as others have in it"]
    assert [(r["text"], r["n_lines"]) for r in rows if r["doc_id"] == 3] == [(None, 0)]
    assert linedup.line_dedup(empty).count() == 0


def test_language(docs, empty):
    options = {"declared": F.col("lang"), "host": F.col("source")}
    rows = langid.identify(docs, **options).collect()
    assert len(rows) == len(TEXTS)
    assert all(r["lang_id"] == "zxx" and not r["kept"] for r in rows if r["doc_id"] in (2, 3, 7))
    kept = langid.keep_identified(docs, **options)
    assert kept.columns == docs.columns
    assert langid.identify(empty, **options).count() == 0


def test_html(spark):
    rows = [(1, None), (1, ""), (2, "<p>" + "a b " * 50_000), (3, "<<<>>> &amp &#x; </p></p><"), (None, "<article><p>One.<p>Two &amp; three</article><footer>no</footer>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("main_text", F.lit("z"))
    found, name = html_extract.extract(df)
    out = found.collect()
    assert name != "main_text"
    assert [r[name] for r in out if r["page_id"] == 1] == ["", ""]
    assert [r[name] for r in out if r["page_id"] is None] == ["One.\n\nTwo & three"]
    assert html_extract.extract(df.limit(0))[0].count() == 0


def test_warc(spark):
    rows = [(1, "http://a", "p" * 200), (2, None, "p" * 200), (2, "u\r\nx", "p" * 200), (3, "u", None), (None, "u", ""), (4, "u", "é" * 70_000), (5, "u", "short"), (6, "u", "short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("z"))
    out = warc.read_warc(spark, warc.write_warc(df)).withColumn("page_id", warc.page_id(F.col("record_id"))).collect()
    assert len(out) == len(rows)
    assert not any(r["gap"] for r in out)
    assert [r["refers_to"] for r in out if r["page_id"] == 2] == ["urn:x-page:1"] * 2
    assert {r["record_type"] for r in out if r["page_id"] in (5, 6, 3, None)} == {"response"}
    assert [r["payload_bytes"] for r in out if r["page_id"] == 4] == [140_000]
    assert warc.read_warc(spark, warc.write_warc(df.limit(0))).count() == 0


def test_stages(spark, docs, empty, labels, tmp_path):
    folder = f"file://{tmp_path}"
    labels.write.parquet(f"{folder}/labels.parquet")
    for rows in (docs, empty):
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, folder)
            out.collect()
            if name != "packing":
                assert out.columns == rows.columns
