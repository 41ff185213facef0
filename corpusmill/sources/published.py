"""Tables that grow by whole runs: rows are staged first, and appear when a numbered list of runs that names them is put in place.

    folder/rows/<run>-<random>/        what a run wrote
    folder/runs/<number>.json          the runs so far, and where their rows are; the highest number counts

A list appears by a rename that fails if the number is taken, so of two writers one starts again from the other's list.  A run that is
named already adds nothing.  Rows of a writer that died before its rename are in no list, and never read.
"""

from __future__ import annotations

import json
import re
import subprocess
import uuid
from datetime import datetime
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.sources.artifacts import cleaned, refuse_secrets

ATTEMPTS = 20


class Published:
    """A published table in ``folder``, of any store that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = self._path("runs").getFileSystem(spark._jsc.hadoopConfiguration())

    def _latest(self) -> tuple[int, list[dict]]:
        if not self._fs.exists(self._path("runs")):
            return 0, []
        found = [re.fullmatch(r"(\d{8})\.json", s.getPath().getName()) for s in self._fs.listStatus(self._path("runs"))]
        number = max((int(m[1]) for m in found if m), default=0)
        if not number:
            return 0, []
        return number, json.loads(self.spark.read.text(f"{self.folder}/runs/{number:08d}.json", wholetext=True).first()[0])

    def runs(self) -> list[dict]:
        """``run`` and ``path`` of every run, in the order of their publication."""
        return self._latest()[1]

    def _swap(self, number: int, runs: list[dict]) -> bool:
        """Puts list ``number`` in place; False if it is there."""
        draft, target = self._path(f"runs/.{number:08d}-{uuid.uuid4().hex}"), self._path(f"runs/{number:08d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        fs = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.NONE
        try:
            fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, options)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def append(self, rows: DataFrame, run: str) -> bool:
        """Adds the rows of ``run``, repaired and without secrets; False if the run is there already, and nothing was done."""
        if any(r["run"] == run for r in self.runs()):
            return False
        path = f"{self.folder}/rows/{re.sub(r'[^A-Za-z0-9_.-]+', '-', run)}-{uuid.uuid4().hex}"
        refuse_secrets(cleaned(rows)).write.parquet(path)
        for _ in range(ATTEMPTS):
            number, runs = self._latest()
            if any(r["run"] == run for r in runs):
                return False
            if self._swap(number + 1, [*runs, {"run": run, "path": path}]):
                return True
        raise RuntimeError(f"{ATTEMPTS} other writers were faster")

    def read(self) -> DataFrame | None:
        """The rows of all runs, with ``run``; None before the first."""
        out = None
        for r in self.runs():
            one = self.spark.read.parquet(r["path"]).withColumn("run", F.lit(r["run"]))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out


def run_id(label: str = "eval", now: datetime | None = None) -> str:
    """The time and a label of letters, digits and dashes."""
    safe = re.sub(r"[^A-Za-z0-9]+", "-", label.strip().lower()).strip("-") or "eval"
    return f"{(now or datetime.now()):%Y%m%d_%H%M%S}_{safe}"


def code_version(root: Path) -> dict[str, str]:
    """``commit`` and ``changes`` (a digest of what isn't committed; empty if all is) of a working copy; empty where there is none."""
    import hashlib

    def git(*args: str) -> str:
        try:
            return subprocess.check_output(["git", *args], cwd=root, text=True, stderr=subprocess.DEVNULL).strip()
        except (OSError, subprocess.CalledProcessError):
            return ""

    changed = git("status", "--porcelain=v1", "--untracked-files=all")
    return {"commit": git("rev-parse", "--short", "HEAD"), "changes": hashlib.sha256(changed.encode()).hexdigest()[:16] if changed else ""}


#: The columns of the public table of an evaluation.
PUBLIC = ["id", "theme", "difficulty", "answer_status", "auto_verdict", "coverage", "trace_score", "required_doc_recall", "answer_point_recall", "iterations", "total_s", "judge_verdict", "effective_verdict"]


def public(cases: DataFrame) -> DataFrame:
    """:data:`PUBLIC` of rows of :func:`corpusmill.operators.eval_run.run_eval`, secrets redacted; what a case lacks is null.

    The effective verdict is the judge's, if there is one.  Questions, answers and passages aren't part of it.
    """
    named = {"answer_status": "status", "auto_verdict": "verdict", "required_doc_recall": "required_recall", "answer_point_recall": "point_recall", "judge_verdict": "judge"}
    have = {c: F.col(named.get(c, c)) for c in PUBLIC if named.get(c, c) in cases.columns}
    verdicts = [F.nullif(F.col(c), F.lit("")) for c in ("judge", "verdict") if c in cases.columns]
    have["effective_verdict"] = F.coalesce(*verdicts) if verdicts else F.lit(None).cast("string")
    types = dict(cases.select(*[x.alias(c) for c, x in have.items()]).dtypes)
    return cases.select(*[(t.redact_secrets(have[c]) if types.get(c) == "string" else have.get(c, F.lit(None).cast("string"))).alias(c) for c in PUBLIC])


def write_public(cases: DataFrame, path: str) -> None:
    """:func:`public` as CSV with a header: one file, as a bank's cases are few and a row is short."""
    rows = refuse_secrets(cleaned(public(cases)))
    rows.repartitionByRange(1, "id").sortWithinPartitions("id").write.mode("overwrite").option("header", True).csv(path)
