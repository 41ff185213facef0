"""Queries over whole texts, by brute force."""

import html

import pytest

import __spark_entry__ as entry
from corpusmill.operators import staging


@pytest.fixture
def folder(spark, tmp_path):
    texts = ["First line\n" + "word " * 50 + "see BOI-TVA-BASE-10, BOI-A, BOI-B, BOI-C, BOI-D, BOI-E and article 150 U du CGI [41, 42] and [43]", "", None, "one line"]
    rows = [(i, x, "en", "src0", len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    pages = [(1, "<title>a &amp; b</title><p>caf&eacute; &#233; &lt;tag&gt;</p>"), (2, None), (3, "<p>no title &copy;</p>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    return f"file://{tmp_path}", pages


def test_whole_texts_are_searched(spark, folder):
    run = lambda name: {r[0]: r[1] for r in entry.queries()[name](spark, folder[0]).collect()}
    refs = run("extract_refs")
    assert refs[0] == "BOI-TVA-BASE-10,BOI-A,BOI-B,BOI-C,BOI-D,BOI-E,BOI-EN-SRC0-0-0" and refs[2] == "BOI-EN-SRC0-0-2"
    legal = run("extract_legal_refs")
    assert "article 150 U du CGI" in legal[0] and "article 0 du CGI" in legal[0] and legal[2] == "article 2 du CGI"
    ids = run("citation_ids")
    assert ids == {0: "41,42,43,1", 1: "2", 2: "3", 3: "4"}


def test_whole_pages_are_unescaped(spark, folder):
    out = {r["page_id"]: r["html"] for r in entry.queries()["html_unescape"](spark, folder[0]).collect()}
    assert out == {i: x and html.unescape(x) for i, x in folder[1]}


def test_acronyms_are_spelled_out_by_whole_paragraphs(spark, tmp_path):
    texts = ["zz yy TVQR here, then taxe valeur quand reste", "TVQR said; taxe valeur quand reste", "Été grande maison et du texte"]
    rows = [(i, x, "en", "src0", len(x)) for i, x in enumerate([*texts, texts[2]])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    out = {r["acronym"]: r["phrase"] for r in entry.queries()["acronym_map"](spark, f"file://{tmp_path}").collect()}
    assert out["TVQR"] == "taxe valeur quand reste" and out["EGM"] == "ete grande maison"


def test_branches_come_from_the_whole_ranking(spark, tmp_path):
    rows = [(i, "alpha beta gamma" if i == 7 else "other words", "en", f"src{i % 3}", 10) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, "alpha gamma")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    made = len(staging.MADE)
    out = {r["place"]: r["ref"] for r in entry.queries()["branch_diversify_ranked"](spark, f"file://{tmp_path}").collect()}
    assert [out[i] for i in sorted(out)] == [f"BOI-EN-SRC{i % 3}-0-{i}" for i in (7, 0, 2, 1, 3, 4)]
    assert len([x for x in staging.MADE[made:] if "/tokens-" in x]) == 1  # both rankings read the same tokens
