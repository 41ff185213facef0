import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import agent, dense, evaluation, fusion, lexical, passages, references, runtime
from corpusmill.operators.passages import _pick
from corpusmill.operators.topk import Best


def bm25(docs, query):
    """The published formula, with negative idf replaced by a quarter of the mean."""
    n = len(docs)
    avgdl = sum(map(len, docs)) / n
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    return [sum(idf.get(q, 0) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for q in query) for d in docs]


@pytest.mark.parametrize("cells", [lexical.MOST_CELLS, 0])
@pytest.mark.parametrize("docs", [["a b c", "a a d", "e f", ""], ["a b"], ["a b", "a c"]])
def test_bm25_ranks_every_item(spark, docs, cells, monkeypatch):
    monkeypatch.setattr(lexical, "MOST_CELLS", cells)  # by scan, or by joined postings
    toks = [d.split() for d in docs]
    items = spark.createDataFrame(list(enumerate(toks)), "item long, toks array<string>")
    queries = spark.createDataFrame([(1, ["a", "a", "d", "z"]), (2, [])], "query_id long, toks array<string>")
    expected = bm25(toks, ["a", "a", "d", "z"])
    order = sorted(range(len(docs)), key=lambda i: (-round(expected[i], 9), i))
    for k in (None, len(docs)):
        rows = sorted(lexical.rank(items, queries, k).collect(), key=lambda r: r["rank"])
        assert [r["item"] for r in rows] == order
        assert [r["score"] for r in rows] == pytest.approx([expected[i] for i in order])


def test_local_bm25_has_its_own_statistics(spark):
    items = spark.createDataFrame([("x", 1, ["a", "b"]), ("x", 2, ["c"]), ("y", 3, ["a"])], "ref string, item long, toks array<string>")
    queries = spark.createDataFrame([(1, ["a"])], "query_id long, toks array<string>")
    pairs = spark.createDataFrame([(1, "x"), (1, "y")], "query_id long, ref string")
    got = {r["item"]: r["score"] for r in lexical.rank(items, queries, None, ["ref"], pairs).collect()}
    assert got[1] == pytest.approx(bm25([["a", "b"], ["c"]], ["a"])[0])
    assert got[3] == pytest.approx(bm25([["a"]], ["a"])[0])
    assert got[3] < 0  # one item: the mean idf is negative


def test_dense(spark):
    items = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [1.0, 0.0])], "item long, vector array<float>")
    queries = spark.createDataFrame([(9, [0.8, 0.2])], "query_id long, vector array<float>")
    assert [r["item"] for r in dense.nearest(items, queries, 2).orderBy("rank").collect()] == [0, 3]
    owner = spark.createDataFrame([(0, "A"), (1, "B"), (3, "A")], "item long, ref string")
    assert [r["ref"] for r in dense.nearest_owners(items, queries, owner, 5).orderBy("rank").collect()] == ["A", "B"]


def rankings(spark, rows):
    return spark.createDataFrame(rows, "query_id long, source string, src_ord int, ref string, score double, rank int")


def test_fusion_ties_and_weights(spark):
    tie = rankings(spark, [(1, "base", 0, "A", 10.0, 1), (1, "base", 0, "B", 9.0, 2), (1, "dense", 3, "B", 0.9, 1), (1, "dense", 3, "A", 0.8, 2)])
    assert [r["ref"] for r in fusion.reciprocal_rank(tie).orderBy("rank").collect()] == ["A", "B"]
    flip = rankings(spark, [(1, "base", 0, "A", 10.0, 1), (1, "base", 0, "B", 9.0, 2), (1, "dense", 3, "B", 0.9, 2), (1, "dense", 3, "A", 0.8, 4)])
    assert fusion.reciprocal_rank(flip).orderBy("rank").first()["ref"] == "B"
    assert fusion.reciprocal_rank(flip, weights={"base": 2.0}).orderBy("rank").first()["ref"] == "A"


def test_a_reference_named_twice_adds_up(spark):
    twice = rankings(spark, [(1, "base", 0, "A", 3.0, 1), (1, "base", 0, "A", 2.0, 2), (1, "base", 0, "B", 1.0, 3)])
    row = fusion.reciprocal_rank(twice).orderBy("rank").first()
    assert (row["ref"], row["ranks"]) == ("A", "base:2")
    assert row["score"] == pytest.approx(1 / 61 + 1 / 62)


def test_profiles(spark):
    rows = fusion.profiles(rankings(spark, [(1, "base", 0, "A", 10.0, 1), (1, "base", 0, "B", 5.0, 2), (1, "dense", 3, "C", 0.5, 1)])).collect()
    got = {r["ref"]: r for r in rows}
    p = math.e / (math.e + 1 / math.e)
    assert got["A"]["confidence"] == pytest.approx(0.25 * (p - 0.5) / 0.5 + 0.75 * 0.5)
    assert (got["A"]["strength"], got["B"]["strength"], got["C"]["confidence"]) == (1.0, 0.0, 1.0)


REFS = ["BOI-RPPM-RCM-40-50-20240730", "BOI-RPPM-RCM-40-50-20-20240730", "BOI-RPPM-RCM-40-50-60-20240730", "BOI-RPPM-RCM-40-55-20240730"]


def test_families(spark):
    refs = spark.createDataFrame([(r,) for r in REFS], "ref string")
    found = references.family_members(references.family_prefixes(refs.filter(F.col("ref") == REFS[0]), refs), refs)
    assert [r["member"] for r in found.orderBy("place").collect()] == REFS[:3]
    wide = references.family_members(references.family_prefixes(refs.filter(F.col("ref") == REFS[0]), refs, levels=1), refs)
    assert wide.count() == 4
    below = {r["ref"]: r["descendants"] for r in references.descendant_counts(refs).collect()}
    assert below[REFS[0]] == 2 and below[REFS[3]] == 0


def test_acronyms(spark):
    views = spark.createDataFrame([("d1", "PEA - Plan d'épargne en actions"), ("d2", "Plan épargne actions (PEA)")], "ref string, text string")
    rows = references.acronym_map(views).collect()
    assert [(r["acronym"], r["phrase"]) for r in rows] == [("PEA", "plan epargne actions")]
    q = spark.createDataFrame([(1, "Qu'est-ce qu'un PEA ?"), (2, "plan épargne actions PEA")], "query_id long, text string")
    out = {r["query_id"]: r["expanded"] for r in references.expand_queries(q, references.acronym_map(views)).collect()}
    assert out == {1: "Qu'est-ce qu'un PEA ? plan epargne actions", 2: "plan épargne actions PEA"}


def test_specificity(spark):
    refs = ["BOI-A-B-C", "BOI-A-B-C-10", "BOI-Z"]
    docs = spark.createDataFrame([(refs[0], "regime general"), (refs[1], "cession de titres"), (refs[2], "autre")], "ref string, tail string")
    hits = spark.createDataFrame([(1, refs[0], 0.80, 1), (1, refs[1], 0.78, 2), (1, refs[2], 0.1, 3)], "query_id long, ref string, score double, rank int")
    q = spark.createDataFrame([(1, "cession de titres")], "query_id long, text string")
    rows = references.specificity(hits, docs, q, weight=0.10).orderBy("rank").collect()
    assert [r["ref"] for r in rows] == [refs[1], refs[0], refs[2]]
    assert rows[2]["bonus"] == 0


def test_diversity():
    flat = _pick([1.0, 1.0, 1.0], ["a", "a", "a"], [(), (), ()], 2)
    assert flat == [0, 1]
    picks = _pick([1.0, 0.95, 0.9, 0.5, 0.0], ["a", "a", "a", "b", "c"], [("s",)] * 5, 3)
    assert picks[0] == 0 and len(set(picks)) == 3
    assert sorted(_pick([1.0, 0.9, 0.8, 0.7, 0.6, 0.0], ["a"] * 6, [("s", str(i)) for i in range(6)], 6)) == list(range(6))


@pytest.fixture(scope="module")
def small(spark):
    docs = [(0, "BOI-TVA-A-10", "Taux de TVA", "le taux normal"), (1, "BOI-TVA-A-20", "Exonérations", "les exonérations de taxe"), (2, "BOI-IS-B-10", "Bénéfice", "le bénéfice imposable")]
    documents = spark.createDataFrame(docs, "item long, ref string, title string, base string").withColumns({"leads": F.col("base"), "score_text": F.concat_ws(" ", "ref", "title")})
    parts = [(10, "BOI-TVA-A-10", ["Taux"], [], "Le taux normal est de 20 % voir BOI-IS-B-10."), (11, "BOI-TVA-A-10", ["Autre"], [], "Rien de plus."), (20, "BOI-TVA-A-20", ["Exo"], [], "Exonération de taxe."), (30, "BOI-IS-B-10", ["IS"], [], "Le bénéfice est imposable.")]
    return runtime.Corpus(documents, spark.createDataFrame(parts, "item long, ref string, path array<string>, legal array<string>, text string"))


def test_retrieve(spark, small):
    q = spark.createDataFrame([(1, "Quel est le taux normal ?"), (2, "BOI-TVA-A-20 exonération")], "query_id long, text string")
    docs, hits = runtime.retrieve(small, q)
    first = {r["query_id"]: r["ref"] for r in docs.filter("rank = 1").collect()}
    assert first == {1: "BOI-TVA-A-10", 2: "BOI-TVA-A-20"}
    assert {r["query_id"]: r["item"] for r in hits.filter("rank = 1").collect()} == {1: 10, 2: 20}


def test_older_retrieval(spark, small):
    q = spark.createDataFrame([(1, "Quel TN ?"), (2, "exonérations de taxe"), (3, "rien")], "query_id long, text string")
    mapping = spark.createDataFrame([("TN", "taux normal", 2)], "acronym string, phrase string, support int")
    expanded, docs, hits, families = runtime.retrieve_older(small, q, mapping)
    assert {r["query_id"]: r["expanded"] for r in expanded.collect()} == {1: "Quel TN ? taux normal", 2: "exonérations de taxe", 3: "rien"}
    assert {r["query_id"]: r["ref"] for r in docs.filter("rank = 1 and query_id < 3").collect()} == {1: "BOI-TVA-A-10", 2: "BOI-TVA-A-20"}
    assert {r["query_id"]: r["item"] for r in hits.filter("rank = 1 and query_id < 3").collect()} == {1: 10, 2: 20}
    members = {r["query_id"]: r["member"] for r in families.filter("place = 1 and query_id < 3").collect()}
    assert set(members.values()) <= {"BOI-TVA-A-10", "BOI-TVA-A-20"} and set(members) == {1, 2}


def test_references_are_followed(spark, small):
    q = spark.createDataFrame([(1, "taux normal")], "query_id long, text string")
    stage1 = spark.createDataFrame([(1, "BOI-TVA-A-10", 1)], "query_id long, ref string, rank int")
    rows = passages.direct_search(q, stage1, small.chunks, per_doc=1).collect()
    followed = [r for r in rows if r["ref"] == "BOI-IS-B-10"]
    assert [(r["document_rank"], r["item"]) for r in followed] == [(2, 30)]


def test_agent(spark):
    q = spark.createDataFrame([(1, "Quel taux ?"), (2, "Rien")], "query_id long, text string")
    found = spark.createDataFrame([(1, 1, "BOI-TVA-A", "Le taux est de 20 %")], "query_id long, rank int, ref string, text string")
    out = {r["query_id"]: r for r in agent.answer(q, found).collect()}
    assert (out[1]["status"], out[2]["status"]) == ("supported", "insufficient_evidence")
    assert agent.call(lambda task, payload: 1 / 0, "plan", {})["answer_status"] == "insufficient_evidence"
    assert agent.parse_json('so: ```json\n{"a": 1}\n```') == {"a": 1}
    routed = agent.taxonomy_route(spark.createDataFrame([(1, "TVA et succession, droits d'enregistrement")], "query_id long, text string")).orderBy("rank").collect()
    assert [(r["prefix"], r["score"]) for r in routed] == [("ENR", 2), ("TVA", 1)]


def test_metrics(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "x"), (2, 2, "c")], "query_id long, rank int, id string")
    gold = spark.createDataFrame([(1, "a"), (1, "zz"), (2, "c")], "query_id long, id string")
    got = {(r["metric"], r["k"]): r["value"] for r in evaluation.metrics(queries, found, gold).collect()}
    assert got[("hit", 1)] == pytest.approx(1 / 3) and got[("hit", 3)] == pytest.approx(2 / 3)
    assert got[("mrr", 0)] == pytest.approx(0.5)
    assert got[("ndcg", 1)] == pytest.approx(1 / 3)  # the ideal is that of the list itself
    assert got[("ndcg", 3)] == pytest.approx((1 + 1 / math.log2(3)) / 3)


@pytest.mark.parametrize("step", [1, 4, 40])
def test_best_of_items_and_owners(step):
    rng = np.random.default_rng(step)
    score, item = rng.integers(0, 6, (3, 40)) / 7, rng.permutation(40).astype(np.int64)
    owners = [f"o{i % 9}" for i in range(40)]
    for k in (1, 4, 50):
        plain, owned = Best(np.arange(3), k), Best(np.arange(3), k)
        for at in range(0, 40, step):
            plain.add(score[:, at : at + step], item[at : at + step])
            owned.add(score[:, at : at + step], item[at : at + step], owners[at : at + step])
        got, got_owned = plain.rows().to_pylist(), owned.rows(True).to_pylist()
        for q in range(3):
            every = sorted((-round(s, 9), i, o) for s, i, o in zip(score[q], item.tolist(), owners, strict=True))
            assert [(r["score"], r["item"]) for r in got if r["query_id"] == q] == [(score[q][item.tolist().index(i)], i) for _, i, _ in every[:k]]
            firsts = list({o: i for _, i, o in reversed(every)}.items())[::-1]
            firsts = sorted(firsts, key=lambda x: [e[1] for e in every].index(x[1]))
            assert [(r["ref"], r["item"]) for r in got_owned if r["query_id"] == q] == firsts[:k]


def test_overlap_meets_a_text_with_all_its_questions(spark):
    """Each text is cut into terms once; the result is that of every pair by itself, the best chunk added, 30 at most."""
    docs = spark.createDataFrame([("A", "taxe foncière bâtie"), ("B", None)], "ref string, text string")
    chunks = spark.createDataFrame([("A", "taxe foncière des locaux"), ("A", "locaux loués vides"), ("A", None), ("C", "taxe")], "ref string, text string")
    asked = spark.createDataFrame([(1, "la taxe foncière"), (2, "locaux loués vides"), (3, "")], "query_id long, text string")
    pairs = asked.select("query_id").crossJoin(docs.select("ref"))
    found = lambda c: {(r["query_id"], r["ref"]): r["overlap"] for r in references._overlap(pairs, asked, docs, c).collect()}
    assert found(chunks) == {(1, "A"): 8.0, (2, "A"): 7.0, (3, "A"): 0.0, (1, "B"): 0.0, (2, "B"): 0.0, (3, "B"): 0.0}
    assert found(None)[1, "A"] == 4.0 and references._overlap(pairs.limit(0), asked, docs, chunks).collect() == []
    plan = references._overlap(pairs, asked, docs, chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_asking") > 0


def test_acronyms_are_found_in_initials(spark):
    """Words without an initial (digits aside, those that don't begin with a to z) are passed over, and may stand inside a phrase."""
    rows = [("a", "TVB est dit"), ("a", "taxe valeur bâtie; vide"), ("b", "TVB: taxe valeur bâtie"), ("b", "taxe œuvre valeur bâtie"), ("c", "taxe valeur bâtie")]
    found = references.acronym_map(spark.createDataFrame(rows, "ref string, text string"), ratio=1.0).collect()
    assert [tuple(r) for r in found] == [("TVB", "taxe valeur batie", 2)]
    one = spark.createDataFrame([("taxe 3e æuvre valeur batie", ["TVB"]), ("taxe valeur", ["TVB"]), ("taxe", ["T"])], "s string, a array<string>")
    assert [tuple(r) for r in one.select(F.inline(references._spelled(F.col("s"), F.col("a")))).collect()] == [("TVB", "taxe 3e æuvre valeur batie")]
