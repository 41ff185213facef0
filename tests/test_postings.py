"""The stored inverted index against the scan, and strings found in texts against plain search."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dense, lexical, patterns, postings, staging


def ranks(df, *more):
    return sorted((r["query_id"], r["rank"], r["item"], round(r["score"], 8), *(r[c] for c in more)) for r in df.collect())


@pytest.fixture(scope="module")
def words():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i * 7, [w for w in rng.choices(vocabulary, weights=range(40, 0, -1), k=rng.randint(0, 25))], i % 13) for i in range(300)]
    items += [(5000 + i, ["w1", "same"], 3) for i in range(20)] + [(6000, [], 4), (6001, None, 5)]
    asked = [(i, rng.choices([*vocabulary, "unknown"], k=rng.randint(1, 8))) for i in range(25)] + [(90, []), (91, ["unknown"]), (92, ["same"]), (93, ["w0", "w0", "w39"])]
    return items, asked


@pytest.mark.parametrize(("shard", "block"), [(1 << 14, 512), (16, 4)])
def test_index_ranks_as_the_scan_does(spark, tmp_path, monkeypatch, words, shard, block):
    monkeypatch.setattr(postings, "SHARD", shard)
    monkeypatch.setattr(postings, "BLOCK", block)
    items = spark.createDataFrame(words[0], "item long, toks array<string>, owner long").repartition(3)
    asked = spark.createDataFrame(words[1], "query_id long, toks array<string>")
    plain = items.withColumn("toks", F.coalesce("toks", F.array().cast("array<string>")))
    index = postings.build(items.drop("owner"), f"file://{tmp_path}/items")
    for k in (1, 7, 400):
        assert ranks(postings.rank(index, asked, k)) == ranks(lexical.rank(plain.select("item", "toks"), asked, k))
    owned = postings.build(items, f"file://{tmp_path}/owned")
    want = lexical.rank_owners(plain.select("item", F.col("owner").cast("string").alias("ref"), "toks"), asked, 5)
    assert ranks(postings.rank(owned, asked, 5), "owner") == ranks(want.withColumn("owner", F.col("ref").cast("long")), "owner")
    again = postings.opened(spark, f"file://{tmp_path}/items")
    assert again == index and postings.opened(spark, f"file://{tmp_path}/none") is None


def test_tasks_hold_bounded_tokens(spark, tmp_path, monkeypatch, words):
    """Shards and the scan's pieces are cut by tokens too: long items make small ones, and results stay."""
    items = spark.createDataFrame([(i, t or []) for i, t, _ in words[0]], "item long, toks array<string>").coalesce(1)
    asked = spark.createDataFrame(words[1], "query_id long, toks array<string>")
    want = ranks(lexical.rank(items, asked, 7))
    monkeypatch.setattr(postings, "SHARD_TOKENS", 30)
    monkeypatch.setattr(lexical, "MOST_TOKENS", 30)
    index = postings.build(items, f"file://{tmp_path}/small")
    size = {i: len(t or []) for i, t, _ in words[0]}
    shards = [r["items"] for r in index.items().collect()]
    assert sorted(i for s in shards for i in s) == sorted(size) and all(len(s) == 1 or sum(size[i] for i in s) <= 30 for s in shards)
    assert ranks(postings.rank(index, asked, 7)) == ranks(lexical.rank(items, asked, 7)) == want


def test_scans_start_python_once(spark, tmp_path):
    """What scans add their rows to isn't an RDD of Python's, which would start another worker on every core."""
    items = staging.staged(spark.range(50).select(F.col("id").alias("item"), F.array(F.lit("a"), F.col("id").cast("string")).alias("toks"), F.array(F.col("id").cast("double")).alias("vector")), "items")
    asked = staging.staged(items.filter("item < 3").withColumnRenamed("item", "query_id"), "asked")
    index = postings.build(items.select("item", "toks"), f"file://{tmp_path}/index")
    texts = items.select("item", F.lit("one two").alias("text"))
    found = [
        lexical.rank(items.select("item", "toks"), asked, 2), lexical._scanned(items, asked, 2), postings._best(index, staging.no_rows(spark, "query_id long, term string, w double, bucket int"), 2, True),
        dense.nearest(items, asked, 2), patterns.occurrences(texts, spark.range(1).select(F.lit("two").alias("pattern")), "item"),
    ]
    assert not [x for x in found if "ExistingRDD" in x._jdf.queryExecution().executedPlan().toString()]
    assert [found[i].count() for i in (0, 2, 3, 4)] == [6, 0, 6, 50] and found[2].columns == ["query_id", "item", "owner", "score"]


def test_a_shard_does_not_hold_the_batch_before(monkeypatch):
    """The items of a batch that the next shard begins with are held without their batch."""
    monkeypatch.setattr(postings, "SHARD_TOKENS", 300)
    monkeypatch.setattr(postings, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))

    def batch(first):
        return pa.RecordBatch.from_arrays([pa.array(range(first, first + 200)), pa.array([["x" * 500] * 10] * 200)], names=["item", "toks"])

    one, before = batch(0).nbytes, pa.total_allocated_bytes()
    most, ids = 0, []
    for out in postings._builder(False)(batch(i * 200) for i in range(4)):
        most = max(most, pa.total_allocated_bytes() - before)
        ids += [x for x in out.column("ids").to_pylist() if x]
    assert [x for own in ids for x in own] == list(range(800)) and max(map(len, ids)) == 30
    assert most < 1.8 * one


def test_scans_share_what_is_stored(spark, words):
    """Items that are scanned twice are written and counted once, and ranked as before."""
    items = spark.createDataFrame([(i, t or [], f"o{o}") for i, t, o in words[0]], "item long, toks array<string>, ref string")
    asked = spark.createDataFrame(words[1], "query_id long, toks array<string>")
    want = ranks(lexical.rank(items, asked, 7)), ranks(lexical.rank_owners(items, asked, 5), "ref")
    both, made = lexical.stored(items), len(staging.MADE)
    assert (ranks(lexical.rank(both, asked, 7)), ranks(lexical.rank_owners(both, asked, 5), "ref")) == want
    assert not [x for x in staging.MADE[made:] if "/tokens-" in x or "/idf-" in x]
    assert lexical.rank(lexical.stored(items.limit(0)), asked, 3).count() == 0


@pytest.mark.parametrize("most", [1, 40])
def test_a_scan_adds_up_bounded_weights(spark, monkeypatch, words, most):
    items = spark.createDataFrame([(i, t or [], f"o{o}") for i, t, o in words[0]], "item long, toks array<string>, ref string").coalesce(1)
    asked = spark.createDataFrame(words[1], "query_id long, toks array<string>")
    run = lambda: (lexical.rank(items, asked, None).collect(), lexical.rank_owners(items, asked, 5).collect())
    want = run()
    monkeypatch.setattr(lexical, "MOST_ADDED", most)
    assert [sorted(x) for x in run()] == [sorted(x) for x in want]
    cuts = list(lexical._runs(np.array([3, 50, 0, 2, 39, 1]), 40))
    assert [c[0] for c in cuts] == [0, *[c[1] for c in cuts[:-1]]] and cuts[-1][1] == 6 and (0, 1) in cuts and (1, 2) in cuts


def test_few_pairs_do_not_make_all_items_move(spark):
    """The documents that a search names meet all items without a shuffle of the items' tokens."""
    items = spark.range(2000).select(F.col("id").alias("item"), F.col("id").cast("string").alias("ref"), F.array(F.lit("a"), F.col("id").cast("string")).alias("toks"))
    items = staging.staged(items, "items")
    asked = spark.createDataFrame([(1, ["a"])], "query_id long, toks array<string>")
    pairs = asked.crossJoin(items.filter("item < 3").select("ref")).groupBy("query_id", "ref").count()
    plans, real = [], staging.staged
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lexical, "staged", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
        assert lexical.rank(items, asked, None, ["ref"], pairs).count() == 3
    assert "BroadcastHashJoin" in dict(plans)["tokens"] and "SortMergeJoin" not in dict(plans)["tokens"]


def test_what_is_read_grows_with_postings(spark, tmp_path):
    """Ten times the items, of which no more hold the terms: the same blocks are read, from the same buckets."""
    schema = "item long, toks array<string>"
    some = [(i, ["asked", f"x{i}"]) for i in range(50)]
    terms = spark.createDataFrame([("asked",)], "term string")
    read = []
    for n in (500, 5000):
        items = spark.createDataFrame(some + [(100 + i, [f"y{i % 97}", "common"]) for i in range(n)], schema)
        index = postings.build(items.coalesce(1), f"file://{tmp_path}/n{n}")
        rows = index.read(terms)
        read.append((rows.count(), rows.agg(F.sum(F.size("items"))).first()[0]))
        plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
        assert "PartitionFilters: [isnotnull(bucket" in plan and "(bucket#" in plan.split("PartitionFilters", 1)[1].split("\n")[0]
    assert read == [(1, 50), (1, 50)]


def test_a_posting_is_a_place_and_a_count(spark, tmp_path, words):
    """Ids, owners and sizes are stored once a shard, and not with every posting; tokens aren't written on the way."""
    items = spark.createDataFrame(words[0], "item long, toks array<string>, owner long").coalesce(1)
    made = len(staging.MADE)
    index = postings.build(items, f"file://{tmp_path}/owned")
    assert not [x for x in staging.MADE[made:] if "/tokens-" in x]
    rows = index.read(index.terms()).select("items", "times", "ids", "owners").collect()
    own = index.items().first()
    assert rows and all(r["ids"] is None and r["owners"] is None and max(r["items"]) < len(own["items"]) for r in rows)
    size = {i: len(t or []) for i, t, _ in words[0]}
    assert dict(zip(own["items"], own["sizes"], strict=True)) == size and sum(sum(r["times"]) for r in rows) == sum(size.values())
    assert index.n_items == len(size) and index.avgdl == sum(size.values()) / len(size)


def test_the_source_stands_for_rows_made_from_it(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, "b c")], "item long, text string")
    made = rows.select((F.col("item") * 10).alias("item"), "item", "text").toDF("item", "owner", "text")
    run = lambda r: postings.stored(made, F.split("text", " "), "v1", owner="owner", folder=f"file://{tmp_path}", source=r)
    assert run(rows) == run(rows.orderBy(F.desc("item"))) and run(rows).path != run(rows.withColumn("text", F.upper("text"))).path


def test_stored_index_is_built_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, "b c")], "item long, text string")
    first = postings.stored(rows, F.split("text", " "), "v1", folder=f"file://{tmp_path}")
    made = sorted(p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet"))
    assert postings.stored(rows.orderBy(F.desc("item")), F.split("text", " "), "v1", folder=f"file://{tmp_path}") == first
    assert sorted(p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")) == made
    assert postings.stored(rows.limit(1), F.split("text", " "), "v1", folder=f"file://{tmp_path}").path != first.path


@pytest.mark.parametrize("most", [2_000_000, 10])
def test_occurrences_equal_plain_search(spark, monkeypatch, most):
    monkeypatch.setattr(patterns, "MOST_CHARS", most)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abé😀\n ") for _ in range(n))
    texts = [(i, text(rng.choice([0, 3, 60, 3000]))) for i in range(60)] + [(99, None), (5, "ab"), (5, "ab")]
    wanted = [text(rng.randint(1, 5)) for _ in range(40)] + ["", None, "ab", "ab"]
    found = patterns.occurrences(spark.createDataFrame(texts, "item long, text string"), spark.createDataFrame([(w,) for w in wanted], "pattern string"), "item")
    want = [(i, w) for i, x in texts for w in {w for w in wanted if w} if x and w in x]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert patterns.occurrences(spark.createDataFrame(texts, "item long, text string"), spark.createDataFrame([], "pattern string"), "item").count() == 0


def test_intermediate_tables_are_discarded(spark):
    from corpusmill.operators import staging

    staging.discard(spark)
    df = staging.staged(spark.range(5), "some")
    assert df.count() == 5 and len(staging.MADE) == 1
    assert staging.discard(spark) == 1 and staging.MADE == [] and staging.discard(spark) == 0
