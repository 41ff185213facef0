"""Rules, loop, question banks, stored tokens and encoders of the agent."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.operators import agent, agent_loop, agent_rules, dense, eval_run, index
from corpusmill.operators import evaluation as ev
from corpusmill.sources import questions as bank

AXES = ["Taux de TVA", "taux", "Seuil de recettes annuelles", "recettes annuelles, plafond seuil", "Exonération", "", "  ", "avec dans pour", "ﬁscalité m²", "fiscalite m2"]
REFS = ["BOI-TVA-BASE-10-20-20240115", "boi-res-bic-10", "voir RPPM-RCM", "ISLAND", "is", "", None, "BOI-PAT", "XTVA", "TVA-" + "A-" * 12]


def test_two_forms_of_a_rule_agree(spark):
    pairs = list(itertools.product(AXES, AXES))
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    found = {r["i"]: r["x"] for r in rows.select("i", agent.axes_match(F.col("a"), F.col("b")).alias("x")).collect()}
    assert [found[i] for i in range(len(pairs))] == [agent_loop.same_axis(a, b) for a, b in pairs]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(REFS)], "i int, r string")
    found = {r["i"]: r["x"] for r in rows.select("i", agent_rules.tax_prefix(F.col("r")).alias("x")).collect()}
    assert [found[i] for i in range(len(REFS))] == [agent_loop.prefix_of(r) for r in REFS]


def chunk(i, rank=1, facet="axe", text="texte", stage="", ref="BOI-X", pos=0):
    return {"id": str(i), "rank": rank, "facet": facet, "text": text, "stage": stage, "ref": ref, "title": "", "path": "", "pos": pos}


FACETS = [{"name": "seuil recettes", "goal": "g", "query": "q", "prefix": "", "role": "core", "blocking": True}, {"name": "option annexe", "goal": "g2", "query": "q2", "prefix": "", "role": "reserve", "blocking": False}]


def test_reviews():
    chunks = [chunk(1, 2, "seuil recettes"), chunk(2, 1, "autre chose")]
    review = agent_loop.review_of({"useful_chunk_ids": ["2", "9", "2"], "covered_axes": ["seuil recettes", " "], "rejected_chunks": [{"chunk_id": "9"}, "x"], "missing_axes": [{"axis": "option annexe"}, {"search_query": "utile seulement"}, {}, "y"]}, chunks)
    assert review["useful"] == ["2"] and review["rejected"] == [] and [g["axis"] for g in review["missing"]] == ["option annexe"] and [g["axis"] for g in review["aside"]] == ["utile seulement"]
    # The covered facet has no useful passage about it, the other gap matches a facet that doesn't block.
    done = agent_loop.completed(review, FACETS, chunks)
    assert [g["axis"] for g in done["missing"]] == ["seuil recettes"] and [g["axis"] for g in done["aside"]] == ["utile seulement", "option annexe"]
    inferred = agent_loop.review_of({"covered_axes": ["seuil recettes"]}, chunks)
    assert inferred["useful"] == ["1"]
    unproved = agent_loop.review_of({"covered_axes": ["sans rapport"]}, chunks)
    assert unproved["covered"] == [] and unproved["missing"][0]["axis"] == "sans rapport"
    # Nothing said: every facet that blocks is a gap.
    assert [g["axis"] for g in agent_loop.completed(agent_loop.review_of({}, []), FACETS, [])["missing"]] == ["seuil recettes"]
    both = agent_loop.merged({**review, "useful": ["1", "2"]}, {**review, "useful": ["3"], "rejected": ["1"], "missing": []})
    assert both["useful"] == ["2", "3"] and both["missing"] == [] and both["covered"] == ["seuil recettes"]


def test_selection():
    chunks = [chunk(i, rank=i) for i in range(1, 15)] + [chunk("r", 3, "taux tva", stage="intra_document"), chunk("p", 9, "taux tva", ref="BOI-TVA-BASE-10-20")]
    none = {"useful": [], "rejected": [], "covered": [], "missing": [], "aside": []}
    assert agent_loop.selected(chunks, none, 12) == ["1", "2", "3", "r", "4", "5", "6", "7", "8", "9", "p", "10"]
    gap = {"axis": "taux tva", "query": "", "why": "", "prefix": "TVA-BASE", "role": "core", "blocking": True}
    out = agent_loop.selected(chunks, {**none, "useful": ["5", "4"], "missing": [gap]}, 12)
    assert out == ["p", "4", "5", "r"]
    out = agent_loop.selected(chunks, {**none, "rejected": ["1"], "missing": [gap]}, 4)
    assert out == ["p", "r", "2", "3"]


TEXTS = {1: ("BOI-TVA-BASE-10", "alpha beta gamma"), 2: ("BOI-TVA-BASE-10", "delta epsilon zeta"), 3: ("BOI-BIC-CHAMP", "omega sigma"), 4: ("BOI-BIC-CHAMP", "delta omega")}


@pytest.fixture
def searches(spark):
    rows = spark.createDataFrame([(i, r, "titre", "", x) for i, (r, x) in TEXTS.items()], "item long, ref string, title string, path string, text string")

    def ranked(asked, pairs, most):
        n = F.size(F.array_intersect(F.split("text", " "), F.split("q", " ")))
        found = pairs(asked.withColumnRenamed("text", "q").drop("prefix")).withColumn("n", n).filter("n > 0")
        w = Window.partitionBy("query_id").orderBy(F.desc("n"), "item")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("query_id", "rank", "ref", "item", "title", "path", "text")

    def search(asked):
        return ranked(asked, lambda a: a.join(rows, F.lit(True)), 1)

    def within(asked, wanted):
        return ranked(asked, lambda a: a.join(wanted.select("query_id", "ref"), "query_id").join(rows, "ref"), 8)

    return search, within


@pytest.fixture
def client():
    def run(task, payload):
        if task == "plan":
            if payload["question"] == "broken":
                raise OSError("no network")
            return json.dumps({"facets": [{"name": "alpha axis", "search_query": "alpha beta", "role": "core"}, {"name": "rien", "search_query": "", "goal": ""}]})
        if task == "review":
            ids = [c["id"] for c in payload["chunks"]]
            if payload["question"].endswith("done"):
                return {"covered_axes": ["alpha axis"], "useful_chunk_ids": ids, "missing_axes": []}
            if "2" in ids or "4" in ids:
                return {"covered_axes": ["alpha axis", "delta axis"], "useful_chunk_ids": ids, "missing_axes": []}
            where = "omega" if payload["question"].endswith("far") else "delta epsilon"
            return {"covered_axes": ["alpha axis"], "useful_chunk_ids": ids, "missing_axes": [{"axis": "delta axis", "search_query": where, "bofip_prefix": "TVA", "role": "core", "blocking": True}]}
        if not payload["sources"]:
            return "no json"
        return "```json\n" + json.dumps({"conclusion": "oui", "axes_manquants": ["x"], "axes_requis": ["alpha axis"], "justification_bullets": [f"{len(payload['sources'])} [1]"]}) + "\n```"

    return run


def test_loop(spark, searches, client):
    asked = spark.createDataFrame([(1, "alpha near"), (2, "alpha done"), (3, "broken"), (4, "alpha far")], "query_id long, text string")
    out = {r["query_id"]: r for r in agent_loop.run(asked, *searches, client).collect()}
    assert len(out) == 4
    # The gap is filled inside a document that the first search found.
    assert out[1]["relaunches"] == 1 and set(out[1]["sources"]) == {"1", "2"} and out[1]["status"] == "supported" and list(out[1]["missing"]) == []
    assert out[2]["relaunches"] == 0 and list(out[2]["sources"]) == ["1"] and out[2]["bullets"] == ["1 [1]"]
    # The client fails: the question itself is searched for, nothing is found, and the answer can't be read.
    assert out[3]["status"] == "insufficient_evidence" and list(out[3]["sources"]) == [] and list(out[3]["missing"]) == ["réponse structurée"]
    # The documents known so far don't have it, the whole corpus does.
    assert out[4]["relaunches"] == 1 and set(out[4]["sources"]) & {"3", "4"}
    once = {r["query_id"]: r for r in agent_loop.run(asked, *searches, client, agent_loop.Loop(relaunch=False)).collect()}
    assert list(once[1]["sources"]) == ["1"] and once[1]["relaunches"] == 0
    unread = {r["query_id"]: r for r in agent_loop.run(asked, *searches, client, agent_loop.Loop(review=False)).collect()}
    assert list(unread[1]["sources"]) == ["1"]


def test_loop_tells_the_plan_and_asks_by_prompt(spark, searches, client):
    """Facts, ambiguities and axes left out reach review and answer; the answer is asked by a prompt; first documents are routes."""

    def telling(task, payload):
        if task == "plan":
            more = {"facts": ["un fait", " ", "x" * 300], "ambiguities": ["laquelle ?"], "excluded_axes": [{"axis": "hors", "reason": "non demandé"}, {}, "z"], "reformulated_question": "alpha, autrement"}
            return {**json.loads(client(task, payload)), **more}
        if task == "answer":
            return {"conclusion": json.dumps([payload["plan"], payload["prompt"]]), "bullets": ["b [1]"]}
        assert payload["plan"]["excluded"] == [{"axis": "hors", "reason": "non demandé"}]
        return client(task, payload)

    asked = spark.createDataFrame([(1, "alpha near")], "query_id long, text string")
    seen = []

    def documents(rows):
        seen.append(rows.columns)
        return rows.select("query_id", F.lit("BOI-TVA-X-10").alias("ref"), F.lit(1).alias("rank"))

    plan, prompt = json.loads(agent_loop.run(asked, *searches, telling, documents=documents).first()["conclusion"])
    assert plan["facts"] == ["un fait", "x" * 177 + "..."] and plan["ambiguities"] == ["laquelle ?"] and plan["question"] == "alpha, autrement"
    assert prompt.startswith("QUESTION:\nalpha near\n\nEXTRAITS:\n[1] BOI: ") and "[2] BOI: " in prompt
    assert seen == [["query_id", "text", "prefix"]]
    assert agent_loop.context_of({}, "q") == {"question": "q", "facts": [], "ambiguities": [], "excluded": []}


def test_point_scores(spark):
    rows = spark.createDataFrame([(1, ["BOI-A"], [], ["taux réduit applicable", ""], [], ["BOI-A-10", ""], "le taux reduit est applicable", "", "", False, True, 1)], "run_id int, required array<string>, optional array<string>, points array<string>, signals array<string>, refs array<string>, answer string, labels string, stages string, reviewed boolean, concluded boolean, iterations int")
    r = ev.agentic_scores(rows).first()
    assert r["required_hits"] == ["BOI-A"] and r["point_hits"] == ["taux réduit applicable", ""] and r["point_recall"] == 1 and r["trace_score"] == 0.25


def test_question_banks(spark, tmp_path):
    cases = [{"id": "b", "question": "Q un", "required_docs": "BOI-1"}, {"user_question": "Q deux", "gold_eval": {"expected_answer_points": ["p", ""]}, "domain": "d"}, {"legacy_id": 7, "runtime_question": "Q trois", "question": "Q trois"}]
    files = {"a.json": json.dumps(cases), "c.json": json.dumps({"cases": cases}), "l.jsonl": "\n".join(map(json.dumps, cases)) + "\n\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
        rows = bank.read_questions(spark, f"file://{tmp_path}/{name}").orderBy("no").collect()
        assert [(r["id"], r["question"]) for r in rows] == [("b", "Q un"), ("Q002", "Q deux"), ("7", "Q trois")]
        assert rows[0]["required_docs"] == ["BOI-1"] and rows[1]["expected_points"] == ["p"] and rows[1]["theme"] == "d"
    read = bank.read_questions(spark, f"file://{tmp_path}/a.json")
    assert [r["id"] for r in bank.select_questions(read, ["7", " b "]).orderBy("no").collect()] == ["7", "b"]
    assert [r["id"] for r in bank.select_questions(read, limit=2).collect()] == ["b", "Q002"]
    with pytest.raises(Exception, match="unknown case"):
        bank.select_questions(read, ["nobody"]).collect()
    for bad in ({"id": "x"}, {"runtime_question": "a", "question": "b"}):
        (tmp_path / "bad.jsonl").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="at row 1"):
            bank.read_questions(spark, f"file://{tmp_path}/bad.jsonl").collect()


def test_long_numbers_of_cases_stay_whole(spark):
    rows = spark.createDataFrame([(n, '{"question": "q"}') for n in (7, 999, 1013, 12345)], "no long, json string")
    assert [r["id"] for r in bank.parse_questions(rows).orderBy("no").collect()] == ["Q007", "Q999", "Q1013", "Q12345"]


def test_stored_tokens(spark, tmp_path):
    rows = spark.createDataFrame([(1, "un deux"), (2, None), (3, "trois")], "item long, text string")
    folder = f"file://{tmp_path}"
    run = lambda df: {r["item"]: r["toks"] for r in index.indexed(df, t.tokens(F.col("text")), folder).collect()}
    assert run(rows) == run(rows.repartition(3)) == {1: ["un", "deux"], 2: [], 3: ["trois"]}
    made = list(tmp_path.iterdir())
    assert len(made) == 1
    (made[0] / "_SUCCESS").unlink()
    assert run(rows) == {1: ["un", "deux"], 2: [], 3: ["trois"]}
    run(rows.filter("item < 3"))
    assert len(list(tmp_path.iterdir())) == 2


def test_encoder(spark):
    rows = spark.createDataFrame([(1, "aab"), (2, None), (3, "")], "query_id long, text string")
    count = lambda texts: np.array([[x.count("a"), x.count("b")] for x in texts], dtype=float)
    found = {r["query_id"]: r["vector"] for r in dense.encode(rows, count, batch=2).collect()}
    assert np.allclose(found[1], [2 / 5**0.5, 1 / 5**0.5]) and found[2] == found[3] == [0, 0]


def test_evaluation_resumes(spark, tmp_path):
    cases = [
        {"id": "a", "question": "Q un", "required_docs": ["BOI-TVA"], "expected_answer_core": "taux réduit"},
        {"id": "b", "question": "Q deux", "failure_signals": ["taux normal"]},
        {"id": "c", "question": "Q trois", "required_docs": "BOI-IS", "expected_calculation": "mille euros", "theme": "IS"},
    ]
    bank_rows = bank.parse_questions(spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases, start=1)], "no int, json string"))
    replies = {"Q un": ("supported", "Le taux réduit.", ["1"]), "Q deux": ("supported", "Le taux normal.", ["2"]), "Q trois": ("insufficient_evidence", "", [])}
    asked = []

    def answer(questions):
        rows = questions.collect()
        asked.append(sorted(r["text"] for r in rows))
        out = [(r["query_id"], *replies[r["text"]][:2], "", ["x [1]"], ["axe"], ["axe"], [], replies[r["text"]][2], 0) for r in rows]
        return spark.createDataFrame(out, "query_id long, status string, conclusion string, limits string, bullets array<string>, covered array<string>, required array<string>, missing array<string>, sources array<string>, relaunches int")

    def judge(task, payload):
        return {"verdict": "pass", "confidence": "0.9", "grounding": "bad"} if payload["question"] == "Q un" else "nothing"

    passages = spark.createDataFrame([(1, "BOI-TVA-BASE-10"), (2, "BOI-BIC")], "id long, ref string")
    folder = f"file://{tmp_path}/run"
    first = eval_run.run_eval(bank_rows.filter("no < 3"), answer, passages, folder, judge)
    assert first.count() == 2
    rows = {r["id"]: r for r in eval_run.run_eval(bank_rows, answer, passages, folder, judge).collect()}
    assert asked == [["Q deux", "Q un"], ["Q trois"]] and len(rows) == 3
    assert rows["a"]["verdict"] == "candidate_pass" and rows["a"]["required_hits"] == ["BOI-TVA"] and rows["a"]["point_recall"] == 1 and rows["a"]["judge"] == "pass" and rows["a"]["confidence"] == 0.9
    assert rows["b"]["verdict"] == "needs_review_failure_signal" and rows["b"]["judge"] == "needs_human_review"
    assert rows["c"]["verdict"] == "candidate_fail_insufficient_evidence" and rows["c"]["missing_required"] == ["BOI-IS"] and rows["c"]["point_recall"] == 0
    with pytest.raises(ValueError, match="lacks"):
        eval_run.run_eval(bank_rows.filter("no = 3"), answer, passages, folder)
    nobody = eval_run.per_case(bank_rows, answer(spark.createDataFrame([(1, "Q un")], "query_id long, text string")), passages).collect()
    assert {r["id"]: r["verdict"] for r in nobody} == {"a": "candidate_pass", "b": "runtime_error", "c": "runtime_error"}
