"""Evaluation of a question bank: answers, scores, verdicts and, if asked for, a judge, appended to a folder that a later run resumes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import agent
from corpusmill.operators import evaluation as ev
from corpusmill.operators.staging import staged
from corpusmill.streaming import progress

JUDGED = "id string, verdict string, confidence double, answer_quality int, grounding int, agentic_process int, status_quality int, root_cause string, rationale string, action string"
GRADES = ["answer_quality", "grounding", "agentic_process", "status_quality"]


def per_case(bank: DataFrame, answers: DataFrame, passages: DataFrame) -> DataFrame:
    """A row a case: what was answered, its scores and its verdict.

    ``bank`` as :mod:`corpusmill.sources.questions` reads it; ``answers`` as :func:`corpusmill.operators.agent_loop.run` returns
    them, by ``no``; ``passages(id, ref)``.  A case without an answer is an error.
    """
    cited = answers.select(F.col("query_id").alias("no"), F.posexplode("sources").alias("p", "pid")).join(passages.select(F.col("id").cast("string").alias("pid"), "ref"), "pid")
    refs = cited.groupBy("no").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "ref"))), lambda x: x["ref"]).alias("refs"))
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    rows = bank.join(answers.withColumnRenamed("query_id", "no").withColumn("_answered", F.lit(True)), "no", "left").join(refs, "no", "left")
    rows = rows.withColumns({c: texts(F.col(c)) for c in ("refs", "bullets", "covered", "required", "missing")})
    points = F.concat("expected_points", F.when(F.col("expected_calculation") != "", F.array("expected_calculation")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumns({"error": F.col("_answered").isNull(), "points": points, "answer": F.concat_ws("\n", "conclusion", "limits", F.array_join("bullets", "\n"), F.array_join("covered", "\n"))})
    again = F.coalesce("relaunches", F.lit(0)) > 0
    scores = ev.agentic_scores(rows.select(
        F.col("id").alias("run_id"), F.col("required_docs").alias("required"), F.col("optional_docs").alias("optional"), "points", F.col("failure_signals").alias("signals"), "refs", "answer",
        F.when(F.col("error"), "").otherwise("plan recherche").alias("labels"), F.lit("").alias("stages"), (~F.col("error")).alias("reviewed"),
        (F.coalesce("conclusion", F.lit("")) != "").alias("concluded"), F.when(again, 2).otherwise(1).alias("iterations"),
    ))
    found = rows.join(scores.withColumnRenamed("run_id", "id"), "id").withColumn("coverage", F.coalesce(ev.coverage(F.size("covered"), F.size("required"), F.size("missing"), F.col("status")), F.lit(0.0)))
    known = found.withColumns({
        "failure_hits": F.size("signal_hits"), "n_points": F.size("points"), "n_required": F.size("required_docs"), "_required_hits": F.col("required_hits"), "required_hits": F.size("required_hits"),
        "has_source": F.exists("refs", lambda r: F.startswith(F.upper(r), F.lit("BOI-"))), "_answer": F.col("answer"), "answer": F.concat_ws("\n", "conclusion", "limits", F.array_join("bullets", "\n")),
    })
    judged = ev.auto_verdict(known)
    return judged.select("id", "no", "question", "theme", "status", "error", "conclusion", "limits", "bullets", "covered", "required", "missing", "refs", F.col("_required_hits").alias("required_hits"), "missing_required", "required_recall", "optional_hits", "point_hits", "point_recall", "signal_hits", "trace_score", "coverage", "verdict")


def judge(rows: DataFrame, client: Callable[[str, dict], object]) -> DataFrame:
    """:data:`JUDGED` of rows from :func:`per_case`; a client that fails or says nothing readable leaves the case to people."""

    def grade(value: object) -> float:
        try:
            return float(value)
        except (TypeError, ValueError):
            return 0.0

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, payload in part.itertuples(index=False):
                said = agent.call(client, "judge", json.loads(payload))
                text = lambda key: str(said.get(key) or "")  # noqa: B023, E731
                out.append((name, text("verdict") or "needs_human_review", grade(said.get("confidence")), *[int(grade(said.get(g))) for g in GRADES], text("root_cause_stage"), text("rationale") or text("error"), text("recommended_action")))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in JUDGED.split(", ")])

    asked = F.to_json(F.struct("question", "status", "conclusion", "limits", "bullets", "refs", "missing_required", "point_recall", "coverage"))
    return rows.filter("not error").select("id", asked.alias("payload")).mapInPandas(run, JUDGED)


def _done(bank: DataFrame, folder: str) -> DataFrame | None:
    try:
        return bank.sparkSession.read.parquet(folder)
    except AnalysisException:
        return None


def run_eval(bank: DataFrame, answer: Callable[[DataFrame], DataFrame], passages: DataFrame, folder: str, judged_by: Callable[[str, dict], object] | None = None) -> DataFrame:
    """All cases of a bank, one row each, from ``folder``: those found there stay, the others are answered, scored and appended.

    ``answer(questions(query_id, text))`` as :func:`corpusmill.operators.agent_loop.run` returns it.  A folder with cases that
    the bank lacks is of another run, an error.
    """
    done = _done(bank, folder)
    if done is not None and (other := progress.unexpected(bank, done, ["id"]).first()):
        raise ValueError(f"the folder holds a case that the bank lacks: {other['id']}")
    left = bank if done is None else progress.remaining(bank, done, ["id"])
    left = staged(left, "cases")
    if not left.isEmpty():
        rows = staged(per_case(left, answer(left.select(F.col("no").cast("long").alias("query_id"), F.col("question").alias("text"))), passages), "scored")
        said = judge(rows, judged_by) if judged_by else bank.sparkSession.createDataFrame([], JUDGED)
        rows = rows.join(said.withColumnRenamed("verdict", "judge"), "id", "left")
        rows.write.mode("append").parquet(folder)
    return bank.sparkSession.read.parquet(folder)
