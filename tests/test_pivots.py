"""The index of vectors with pivots against the scan."""

import numpy as np
import pytest

from corpusmill.operators import dense, pivots


def ranks(df):
    return sorted((r["query_id"], r["rank"], r["item"], round(r["score"], 8)) for r in df.collect())


def test_bounds_hold():
    rng = np.random.default_rng(1)
    queries, centres = rng.normal(size=(20, 6)), rng.normal(size=(5, 6))
    for scale in (0.1, 1.0, 5.0):
        for at in range(5):
            v = centres[at] + scale * rng.normal(size=(30, 6))
            d, length = np.sqrt(((v - centres[at]) ** 2).sum(1)), np.sqrt((v**2).sum(1))
            top = pivots.bounds(queries, centres[[at]], np.array([d.min()]), np.array([d.max()]), np.array([length.max()]))
            assert (top[:, 0] >= (queries @ v.T).max(1) - 1e-9).all()


@pytest.mark.parametrize(("block", "slice_"), [(256, 50_000), (8, 40)])
def test_index_finds_what_the_scan_finds(spark, tmp_path, monkeypatch, block, slice_):
    monkeypatch.setattr(pivots, "BLOCK", block)
    monkeypatch.setattr(pivots, "SLICE", slice_)
    rng = np.random.default_rng(2)
    made = rng.normal(size=(400, 5))
    made[100:250] = made[0]  # copies: ties, and a pivot with many vectors
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(made)] + [(900, None), (901, [1.0]), (902, [None] * 5), (903, [0.0] * 5)]
    items = spark.createDataFrame(rows, "item long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 400, 25)] + [(1000, None), (1001, [0.0] * 5)], "query_id long, vector array<double>")
    index = pivots.build(items, f"file://{tmp_path}/x", 12)
    for k in (1, 10, 500):
        found, _ = pivots.nearest(index, asked, k)
        assert ranks(found) == ranks(dense.nearest(items, asked, k))


def test_most_of_a_clustered_table_is_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 32)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    centres /= np.sqrt((centres**2).sum(1))[:, None]
    made = centres[rng.integers(0, 40, 4000)] + 0.01 * rng.normal(size=(4000, 16))
    made /= np.sqrt((made**2).sum(1))[:, None]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "item long, vector array<double>")
    asked = items.filter("item % 100 = 0").withColumnRenamed("item", "query_id")
    found, looked = pivots.nearest(pivots.build(items, f"file://{tmp_path}/x"), asked, 5)
    assert ranks(found) == ranks(dense.nearest(items, asked, 5))
    rows = looked.collect()
    assert {r["all"] for r in rows} == {4000} and sum(r["compared"] for r in rows) < 0.25 * 4000 * len(rows), sum(r["compared"] for r in rows) / 4000 / len(rows)


def test_empty_tables(spark, tmp_path):
    items = spark.createDataFrame([(1, [1.0, 0.0])], "item long, vector array<double>")
    asked = items.withColumnRenamed("item", "query_id")
    assert pivots.nearest(pivots.build(items.limit(0), f"file://{tmp_path}/none"), asked, 3)[0].count() == 0
    assert pivots.nearest(pivots.build(items, f"file://{tmp_path}/one"), asked.limit(0), 3)[0].count() == 0
