"""Whitening, vector codes and decontamination against plain versions, with nulls, ties, repeats, long texts, empty tables and clashing names."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import decontamination, fm_index, vector_codes, whitening

NAN, INF = float("nan"), float("inf")
CLASH = ["id", "x", "c", "v", "at", "n", "s", "code", "error", "label_error", "whitened", "deviation", "spans", "items", "clean", "block", "w", "slice", "of_label", "component"]


def clashing(df):
    return df.withColumns({c: F.lit("z") for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    made = rng.normal(size=(90, 8)) @ rng.normal(size=(8, 8)) / 10 + rng.normal(size=8)
    made[60:80] = made[0]  # copies
    rows = [(i, [float(np.float32(c)) for c in v], i % 3 if i % 7 else None) for i, v in enumerate(made)]
    rows += [(3, rows[5][1], 1), (None, rows[6][1], 2), (90, None, 1), (91, [None] * 8, 1), (92, [NAN] + [0.0] * 7, 1), (93, [INF] * 8, None), (94, [1.0, 2.0], 0), (95, [], 0)]
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), rows


def kept(rows):
    return [r for r in rows if r[1] is not None and len(r[1]) == 8 and all(c is not None and math.isfinite(c) for c in r[1])]


def test_whitening_is_that_of_the_covariance(vectors):
    df, rows = vectors
    rows = kept(rows)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v, _ in rows])
    n, sums = len(x), x.sum(0)
    off = x - sums / n
    cov = off.T @ off / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    want = off @ u / np.sqrt(e)
    found = whitening.long_rows(df, components=5).collect()
    assert len(found) == 5 * n and {r["component"] for r in found} == set(range(1, 6))
    assert {r["n"] for r in found} == {n}
    assert {r["identity_error"] for r in found}.pop() < 1e-9
    deviations = sorted(sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x)
    for k in range(1, 6):
        mine = [r for r in found if r["component"] == k]
        assert sorted(r["deviation"] for r in mine) == deviations
        assert mine[0]["explained"] == pytest.approx(e[k - 1] / np.trace(cov), rel=1e-9)
        by_id = {r["vec_id"] if "vec_id" in r else r["id"]: r["whitened"] for r in mine if r["id"] not in (3, None)}
        theirs = {i: want[at, k - 1] for at, (i, _, _) in enumerate(rows) if i not in (3, None)}
        sign = np.sign(by_id[0] * theirs[0])
        assert all(by_id[i] * sign == pytest.approx(theirs[i], abs=1e-7) for i in theirs)


def test_whitening_without_variance_rows_or_room(spark):
    schema = "vec_id long, embedding array<double>"
    same = spark.createDataFrame([(i, [0.5, -0.25, 3.0]) for i in range(4)], schema)
    found = whitening.long_rows(same).collect()
    assert len(found) == 12 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 and r["identity_error"] is None for r in found)
    flat = whitening.long_rows(spark.createDataFrame([(1, [0.0, 7.0]), (2, [1.0, 7.0])], schema)).collect()
    assert sorted((r["component"], r["whitened"] is None) for r in flat) == [(1, False), (1, False), (2, True), (2, True)]
    assert abs(flat[0]["whitened"] or 1) == pytest.approx(1) and {r["identity_error"] for r in flat}.pop() < 1e-12
    assert whitening.long_rows(same.limit(0)).count() == 0
    assert whitening.long_rows(same.filter("false").union(spark.createDataFrame([(1, None), (2, [])], schema))).count() == 0
    huge = whitening.long_rows(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], schema)).collect()
    assert all(r["deviation"] is None for r in huge)
    rows, model, _ = whitening.whiten(spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(9)], schema))
    assert len(model) == 2 and len(rows.first()["whitened"]) == 2


def test_nearest_is_the_lowest_of_the_nearest():
    rng = np.random.default_rng(3)
    for n, d, k in [(50, 16, 256), (7, 3, 5), (40, 5, 70), (3, 1, 2), (20, 6, 1)]:
        x, book = rng.integers(-3, 4, (n, d)), rng.integers(-3, 4, (k, d))
        full = ((x[:, None] - book[None]) ** 2).sum(2)
        index, best = vector_codes.nearest(x, book)
        assert (index == full.argmin(1)).all() and (best == full.min(1)).all()


def codes_of(rows, parts, entries, rounds):
    """Loops over lists."""
    x = sorted(((i is None, i or 0, [math.floor(1024 * c) for c in v], label) for i, v, label in rows), key=lambda r: r[:3])
    width = len(x[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v, _ in x]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        got = [[[] for _ in b] for b in books]
        for c in cut:
            for p in range(parts):
                got[p][best(p, c[p])[1]].append(c[p])
        books = [[[sum(z) // len(z) for z in zip(*got[p][i], strict=True)] or e if got[p][i] else e for i, e in enumerate(b)] for p, b in enumerate(books)]
    out, by_label = [], {}
    for (null, i, _, label), c in zip(x, cut, strict=True):
        pairs = [best(p, c[p]) for p in range(parts)]
        out.append((None if null else i, label, "".join(f"{j:02x}" for _, j in pairs), sum(d for d, _ in pairs)))
        by_label[label] = by_label.get(label, 0) + out[-1][-1]
    return sorted(((*r, by_label[r[1]]) for r in out), key=repr), books


@pytest.mark.parametrize("entries", [256, 6])
def test_codes_equal_loops(vectors, entries, monkeypatch):
    df, rows = vectors
    want, books = codes_of(kept(rows), 4, entries, 4)
    for most in (100_000, 1):  # labels broadcast, and joined
        monkeypatch.setattr(vector_codes, "MOST_LABELS", most)
        found, mine = vector_codes.vector_codes(df, entries=entries)
        assert sorted(((r["id"], r["label"], r["code"], r["error"], r["label_error"]) for r in found.collect()), key=repr) == want
        assert [b.tolist() for b in mine] == books


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label string"
    few = spark.createDataFrame([(1, [0.1, 0.2, 0.3], None), (2, [0.4, 0.5, 0.6], "a"), (2, [1e200, -1e200, 0.0], "a")], schema)
    rows, books = vector_codes.vector_codes(few)
    assert {r["error"] for r in rows.collect()} == {0} and [b.shape for b in books] == [(3, 1)] * 4
    rows, books = vector_codes.vector_codes(few.limit(0))
    assert rows.count() == 0 and vector_codes.digest(books) == vector_codes.digest([])
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, "a"), (2, [], "a")], schema))[0].count() == 0


def test_suffixes_and_search_equal_plain_ones():
    rng = random.Random(9)
    for _ in range(60):
        texts = [[rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 6))]
        texts += [texts[0]] * 3
        symbols = np.array([s for t in texts for s in [*t, 0]])
        value = [(0, i) if s == 0 else (1, s) for i, s in enumerate(symbols.tolist())]
        assert fm_index.suffix_order(symbols).tolist() == sorted(range(len(value)), key=lambda i: value[i:])
        index = fm_index.FmIndex(symbols)
        phrases = np.array([[rng.randint(1, 9) % index.n_symbols or 1 for _ in range(4)] for _ in range(40)])
        if index.n_symbols == 1:
            continue
        lengths = np.array([rng.randint(1, 4) for _ in phrases])
        which, low, high = index.search(phrases, lengths)
        mine = {(w, p) for w, s, e in zip(which.tolist(), low, high, strict=True) for p in index.locate(np.arange(s, e)).tolist()}
        theirs = {(w, p) for w in range(len(phrases)) for p in range(len(symbols)) if symbols[p : p + lengths[w]].tolist() == phrases[w][: lengths[w]].tolist()}
        assert mine == theirs


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def leaks_of(texts, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(len(w) - size + 1) if len(w) >= size else [0] * bool(w):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for text in texts:
        w = words(text)
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    found |= windows[tuple(w[i : i + n])]
                    hit[i : i + n] = [True] * n
        edges = [i for i in range(len(w) + 1) if (i < len(w) and hit[i]) != (i > 0 and hit[i - 1])]
        out.append((len(w), list(zip(edges[::2], edges[1::2], strict=True)), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.mark.parametrize(("most", "shard", "stretch"), [(2_000_000, 6 << 20, 1 << 20), (40, 6 << 20, 1 << 20), (2_000_000, 60, 1 << 20), (60, 200, 16)])
def test_leaks_equal_a_plain_search(spark, monkeypatch, most, shard, stretch):
    monkeypatch.setattr(decontamination, "STRETCH", stretch)
    rng = random.Random(4)
    some = ["alpha", "Beta", "été", "ÉTÉ", "7", "x"]
    mark = [" ", ", ", "\n", " - ", "_", "\x00"]
    text = lambda n: "".join(rng.choice(some) + rng.choice(mark) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 4, 5, 7, 30]))) for i in range(12)] + [(3, text(6)), (None, text(4)), (50, None), (51, "")]
    texts = [text(rng.choice([0, 1, 3, 10, 40])) for _ in range(60)] + [None, "", "...", "été " * 300, items[5][1], items[5][1], items[5][1].upper(), "only words of their own", text(3000)]
    docs = clashing(spark.createDataFrame([(i % 20 or None, t) for i, t in enumerate(texts)], "doc_id long, text string")).repartition(2)
    found = decontamination.decontaminate(docs, clashing(spark.createDataFrame(items, "item_id long, text string")), size=5, most_words=most, shard_bytes=shard).collect()
    want = dict(zip(texts, leaks_of(texts, items, 5), strict=True))
    assert sorted(repr(r["text"]) for r in found) == sorted(map(repr, texts))
    for r in found:
        assert (r["n_words"], [(s["start"], s["end"]) for s in r["spans"]], r["items"]) == want[r["text"]]
        kept = [w for i, w in enumerate(words(r["text"])) if not any(s["start"] <= i < s["end"] for s in r["spans"])]
        assert r["clean"] is None if r["text"] is None else words(r["clean"]) == kept


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words " * 9), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words " * 9)], "item_id long, text string")
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0
    for none in (items.limit(0), spark.createDataFrame([(1, None), (2, "?!")], "item_id long, text string")):
        found = decontamination.decontaminate(docs, none).collect()
        assert len(found) == 2 and all(r["spans"] == [] and r["items"] == [] and r["clean"] == r["text"] for r in found)
    assert decontamination.decontaminate(docs, items).filter("size(spans) = 1").select("clean").first()["clean"].strip() == ""
