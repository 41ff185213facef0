"""The driver's contract: names, and a sample of SQL twins on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
SAMPLE = ["normalize_ws", "token_count", "doc_text_leads", "bm25_doc_topk", "bm25_zero_fill", "bm25_local", "dense_rollup", "cw_rrf", "exact_reference_rank", "family_selection", "chunks_section_window", "ndcg_at_k", "eval_summary", "stratified_sample", "taxonomy_route"]


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and np.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, (float, np.floating)) else x.item() if isinstance(x, np.generic) else x


def rows(df):
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


def test_test_modules_have_names_of_their_own():
    """Two modules of one base name, without packages, would stop the collection of all tests."""
    names = [f.name for f in Path(__file__).parent.rglob("test_*.py")]
    assert len(names) == len(set(names))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_twins(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    assert rows(entry.queries()[name](spark, str(DATA)).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_it_works_without_the_training_data_operators(tmp_path):
    root = Path(entry.__file__).parent
    for f in ("__spark_entry__.py", "corpusmill"):
        (tmp_path / f).symlink_to(root / f) if f.endswith(".py") else None
    (tmp_path / "corpusmill").mkdir()
    for f in (root / "corpusmill").iterdir():
        if f.name not in ("llm", "__pycache__"):
            (tmp_path / "corpusmill" / f.name).symlink_to(f)
    code = "import __spark_entry__ as e; print(sorted(k for k in e.queries() if k[:2] == 'op' or k == 'pipeline'))"
    found = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
    assert found.stdout.strip().splitlines()[-1] in ("[]", "['order_match']")
