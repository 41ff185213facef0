"""The training-data operators over the whole job."""

import random

from corpusmill.llm import linedup

R = random.Random(11)


def close(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(a) - len(b) == 1 and b in {a[:i] + a[i + 1 :] for i in range(len(a))}


def test_short_lines_that_repeat_go(spark):
    long = ["".join(R.choice("abcd ") for _ in range(R.randint(19, 24))) + "x" for _ in range(12)]
    lines = [*long, *[x[:5] + "Z" + x[6:] for x in long], "Page 1", "Page 2", "a", "", "  ", "\t", "x" * 19, "x" * 20, "x" * 21, "é"]
    rows = [(i, "\n".join(R.choice(lines) for _ in range(R.randint(1, 8)))) for i in range(40)]
    out = linedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), short_repeats=True).collect()
    seen, want = [], {}
    for i, text in rows:
        stays = []
        for line in text.split("\n"):
            if not line.strip():
                stays.append(line)
                continue
            if not any(line == s or min(len(line), len(s)) >= 20 and close(line, s) for s in seen):
                stays.append(line)
            seen.append(line)
        want[i] = "\n".join(stays)
    assert {r["doc_id"]: r["text"] for r in out} == want


def test_the_pipeline_drops_short_repeats(spark):
    import corpus_pipeline

    rows = [(1, "Menu\nfirst text", "en", "s", 15), (2, "Menu\nsecond text", "en", "s", 16)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, df, "").collect()} == {1: "Menu\nfirst text", 2: "second text"}
