"""Replies and events of tasks that are lost, embedding caches, published runs, typed records, fingerprints of many rows."""

import hashlib
import json
import math
import os
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import agent, replies
from corpusmill.sources import manifest, npy, published, records
from corpusmill.streaming import events, progress

ROOT = Path(__file__).parents[1]
KILLED = """
import os, sys, json, uuid
from pathlib import Path
from pyspark import TaskContext
from pyspark.sql import SparkSession
from corpusmill.operators import agent, replies
from corpusmill.operators.agent_loop import _called
from corpusmill.streaming import events
base = Path(sys.argv[1])
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

def client(task, payload):
    Path(base / "calls" / uuid.uuid4().hex).write_text(json.dumps(payload))
    if payload["i"] == 6 and TaskContext.get().attemptNumber() == 0:
        os._exit(1)  # the worker dies after it asked, before it has a reply
    return {"said": payload["i"]}

(base / "calls").mkdir()
recorded, tell = replies.Recorded(client, str(base / "replies")), events.Emitter(str(base / "log"), "r1")

def run(i):
    said = agent.call(recorded, "ask", {"i": i})["said"]
    tell(i, 1, "asked", said=said)
    return i, said

rows = _called(spark.range(10).repartition(1).selectExpr("id as i").sortWithinPartitions("i"), ["i"], "i long, said long", run)
print(json.dumps(sorted(map(tuple, rows.collect()))))
"""


def test_a_killed_task_asks_nothing_twice(spark, tmp_path):
    done = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path)], cwd=ROOT, env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300, check=True)
    assert json.loads(done.stdout.strip().splitlines()[-1]) == [[i, i] for i in range(10)]
    asked = sorted(json.loads(f.read_text())["i"] for f in (tmp_path / "calls").iterdir())
    assert asked == sorted([*range(10), 6])  # only the question whose reply was lost with the worker is asked again
    log = events.events(spark, f"file://{tmp_path}/log")
    assert sorted((r["key"], r["label"], r["fields"]["said"]) for r in log.collect()) == [(i, "asked", str(i)) for i in range(10)]


def test_a_stream_follows_events_once(spark, tmp_path):
    folder, tell = f"file://{tmp_path}/log", events.Emitter(f"{tmp_path}/log", "r")
    for again in range(2):
        for key in (1, 2):
            for no, label in enumerate(("plan", "answer")[: again + 1], start=1):
                tell(key, no, label, attempt=again)
        events.follow(spark, folder, f"{tmp_path}/checkpoint", f"file://{tmp_path}/rows").awaitTermination()
    rows = progress.step_timings(spark.read.parquet(f"file://{tmp_path}/rows"), "key", "ts", "no").collect()
    assert sorted((r["key"], r["label"], r["fields"]["attempt"], r["step_s"] is None or r["step_s"] >= 0) for r in rows) == sorted((k, x, n, True) for k in (1, 2) for x, n in (("plan", "0"), ("answer", "1")))
    events.Emitter("/proc/no/such/place", "r")(1, 1, "lost")  # told nowhere, and the work goes on


def test_replies_and_pauses(tmp_path):
    calls, pauses = [], []

    def client(task, payload):
        calls.append(task)
        if len(calls) == 1:
            raise RuntimeError("429: retry in 7.5s, 'retryDelay': '9s'")
        if len(calls) == 2:
            raise RuntimeError("down")
        return "no reply" if len(calls) < 5 else '```json\n{"x": "é"}\n```'

    kept = replies.Recorded(client, str(tmp_path))
    assert agent.call(kept, "plan", {"q": 1}, pause=pauses.append)["answer_status"] == "insufficient_evidence"
    assert pauses == [9.0, 6.0] and len(calls) == 3  # a reply that can't be read isn't kept
    for _ in range(3):
        assert agent.call(kept, "plan", {"q": 1}, pause=pauses.append) == {"x": "é"}
    assert len(calls) == 5 and agent.asked_delay("retry in 100s") == 100.0 and agent.asked_delay(None) is None
    assert agent.call(lambda *_: 1 / 0, "plan", {}, pause=pauses.append)["error"].startswith("client failed")
    assert len(list(tmp_path.rglob("*.json"))) == 1


@pytest.mark.parametrize("kind", ["<f4", "<f8", "<f2"])
def test_npy_is_read_by_ranges(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    parts = [rng.normal(size=(n, 5)).astype(kind) for n in (17, 0, 4)]
    for i, part in enumerate(parts):
        np.save(tmp_path / f"{i}.npy", part)
    spark.dataSource.register(npy.NpySource)
    found = spark.read.format("npy").option("split", 60).load(str(tmp_path))
    assert found.rdd.getNumPartitions() > 3
    want = np.concatenate(parts).astype(np.float32)
    rows = sorted(found.collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in rows] == list(range(21)) and np.array_equal(np.array([r["vector"] for r in rows], dtype=np.float32), want)
    assert [r["at"] for r in rows] == [*range(17), *range(4)]
    assert npy.scan(spark, str(tmp_path / "0.npy"), 17).count() == 17
    assert [r["vector"] for r in npy.scan(spark, str(tmp_path), 3, dense=False).collect()] == [[0.0]] * 3
    assert npy.scan(spark, str(tmp_path), 21, dense=False).filter("vector[0] <> 0").count() == 21
    with pytest.raises(ValueError, match="21 vectors for 3"):
        npy.scan(spark, str(tmp_path), 3)
    np.save(tmp_path / "9.npy", np.zeros(3))
    with pytest.raises(ValueError, match="not a matrix"):
        npy.n_rows(str(tmp_path))


def test_npy_parts_are_a_matrix(spark, tmp_path):
    rows = spark.createDataFrame([(i * 3, [float(i), -i / 7]) for i in range(40)], "item long, vector array<float>").repartition(3)
    where = {(r["file"], r["at"]): r["item"] for r in npy.write(rows, str(tmp_path)).collect()}
    back = {where[r["file"], r["at"]]: list(r["vector"]) for r in npy.scan(spark, str(tmp_path), 40).collect()}
    assert back == {r["item"]: list(r["vector"]) for r in rows.collect()}
    assert np.concatenate([np.load(f) for f in sorted(tmp_path.glob("*.npy"))]).shape == (40, 2)


def test_runs_are_published_once_and_whole(spark, tmp_path, monkeypatch):
    sink = published.Published(spark, f"file://{tmp_path}/out")
    one, two = spark.createDataFrame([(1, "a"), (2, "cafÃ©")], "id int, x string"), spark.createDataFrame([(3, "b")], "id int, x string")
    assert sink.read() is None
    assert sink.append(one, "r/1") and not sink.append(one, "r/1")

    monkeypatch.setattr(published.Published, "_swap", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # dies when its rows are written and before they are listed
        sink.append(two, "r2")
    monkeypatch.undo()
    assert sorted((r["id"], r["x"], r["run"]) for r in sink.read().collect()) == [(1, "a", "r/1"), (2, "café", "r/1")]
    assert sink.append(two, "r2") and not sink.append(two, "r2")

    other = published.Published(spark, f"file://{tmp_path}/out")
    latest, ahead = published.Published._latest, []

    def overtaken(self):
        found = latest(self)
        if self is other and len(ahead) == 1:
            sink.append(two, "r3")  # another writer takes the number between the look and the rename
        ahead.append(1)
        return found

    monkeypatch.setattr(published.Published, "_latest", overtaken)
    assert other.append(one, "r4")
    monkeypatch.undo()
    assert [r["run"] for r in sink.runs()] == ["r/1", "r2", "r3", "r4"] and sink.read().count() == 6
    with pytest.raises(Exception, match="secret"):
        sink.append(spark.createDataFrame([("sk-abcdefghijklmnop",)], "x string"), "r5")
    assert len(sink.runs()) == 4


def test_run_identity_and_public_table(spark, tmp_path):
    assert published.run_id(" My Éval, 2! ", datetime(2026, 1, 2, 3, 4, 5)) == "20260102_030405_my-val-2"
    assert published.run_id("??", datetime(2026, 1, 2)).endswith("_eval")
    assert published.code_version(tmp_path) == {"commit": "", "changes": ""}
    rows = spark.createDataFrame([("q2", "t sk-abcdefghijklmnop", "supported", "candidate_pass", 0.5, None, "hidden"), ("q1", "é,\"x\"", "supported", "candidate_fail", 1.0, "pass", "hidden")], "id string, theme string, status string, verdict string, coverage double, judge string, question string")
    published.write_public(rows, f"file://{tmp_path}/public")
    found = spark.read.option("header", True).option("escape", "\\").csv(f"file://{tmp_path}/public")
    assert found.columns == published.PUBLIC
    out = {r["id"]: r for r in found.collect()}
    assert out["q1"]["effective_verdict"] == "pass" and out["q2"]["effective_verdict"] == "candidate_pass" and "sk-" not in out["q2"]["theme"] and out["q1"]["theme"] == 'é,"x"'


def test_records_that_dont_fit_are_put_aside(spark):
    fields = [records.Field("id", "string", "string"), records.Field("n", "integer", "bigint"), records.Field("xs", "list", "array<string>", False, "array('d')"), records.Field("w", "number", "double", False), records.Field("o", "boolean", "boolean", True, "null", True)]
    good = {"id": "a", "n": 3, "o": None}
    cases = [
        (good, None), ({**good, "xs": ["p", "q"], "w": 2, "o": True, "more": {}}, None), ({**good, "xs": []}, None), ({**good, "w": 0.25}, None),
        ({**good, "n": "3"}, "not integer: n"), ({**good, "n": 3.5}, "not integer: n"), ({**good, "id": None}, "null: id"), ({"id": "a", "o": None}, "missing: n"), ({"id": "a", "n": 1}, "missing: o"),
        ({**good, "xs": "p"}, "not list: xs"), ({**good, "o": "yes"}, "not boolean: o"), ({**good, "w": "1"}, "not number: w"), ([good], "not an object"), (3, "not an object"), ({**good, "n": 10**30}, "not integer: n"),
    ]
    rows = [(i, json.dumps(x), p) for i, (x, p) in enumerate(cases)] + [(90, "{", "not JSON"), (91, None, "not JSON"), (92, "", "not JSON")]
    df = spark.createDataFrame(rows, "i int, json string, want string").withColumn("id", F.lit("another"))
    found = {r["i"]: r for r in records.decode(df.drop("id"), fields).collect()}
    assert {i: r["problem"] for i, r in found.items()} == {i: p for i, _, p in rows}
    assert found[0]["record"].asDict() == {"id": "a", "n": 3, "xs": ["d"], "w": None, "o": None}
    assert found[1]["record"]["xs"] == ["p", "q"] and found[1]["record"]["w"] == 2.0 and found[2]["record"]["xs"] == []
    fits, aside = records.split(records.decode(df.drop("id"), fields))
    assert fits.count() == 4 and aside.count() == len(rows) - 4 and "problem" in aside.columns and "n" in fits.columns
    chunk = {"chunk_id": "c", "source_type": "s", "document_id": "d", "boi_reference": "r", "strategy": "x", "text": "t", "token_count": 1, "chunk_kind": "k"}
    one = records.split(records.decode(spark.createDataFrame([(json.dumps(chunk),)], "json string"), records.CHUNK))[0].first()
    assert one["legal_refs"] == [] and one["section_path"] == [] and one["section_id"] is None


@pytest.mark.parametrize("width", [2, 7, 1024])
def test_fingerprint_is_a_tree(spark, width):
    rows = [(i % 5, f"v{i * 37 % 101}") for i in range(60)] + [(None, "n"), (2, "v1"), (2, "v1")]
    digests = [hashlib.sha256(v.encode()).hexdigest() for _, v in rows]
    level = [h for _, h in sorted(zip([(k is not None, k or 0) for k, _ in rows], digests, strict=True))]
    while True:
        level = [hashlib.sha256("".join(level[i : i + width]).encode()).hexdigest() for i in range(0, len(level), width)]
        if len(level) == 1:
            break
    assert math.ceil(math.log(len(rows), width)) >= 1
    df = spark.createDataFrame(rows, "k int, v string")
    for n in (1, 5):
        assert manifest.fingerprint_tree(df.repartition(n), [F.col("k")], F.col("v"), width).first()[0] == level[0]
    assert manifest.fingerprint_tree(df.limit(0), [F.col("k")], F.col("v")).first()[0] == hashlib.sha256(b"").hexdigest()


def test_fingerprint_tree_ends_at_a_level(spark):
    """With ``levels`` a row for every digest of that level, none lost, also where the tree ends before."""
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(11)], "k int, v string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level = [sha(f"v{i}") for i in range(11)]
    for _ in range(2):
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    found = lambda df: sorted(r[0] for r in manifest.fingerprint_tree(df, [F.col("k")], F.col("v"), 2, levels=2).collect())
    assert found(rows.repartition(3)) == sorted(level) and len(level) == 3
    assert found(rows.filter("k < 2")) == [sha(sha("v0") + sha("v1"))] and found(rows.limit(0)) == []
