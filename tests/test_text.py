import html
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import slow
from corpusmill.functions import text as t
from corpusmill.functions.french import stem
from corpusmill.functions.slow import facts
from corpusmill.operators.chunking import is_trivial, n_tokens


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (t.normalize_ws, " a\xa0b  c&amp;d\n", "a b c&d"),
        (t.normalize_ws, None, ""),
        (t.fold_accents, "Éàçœuvre ñ", "Eacœuvre n"),
        (t.tokens, "L'œuvre d’été 2024", ["l", "uvre", "d", "ete", "2024"]),
        (lambda c: t.tokens(c, True), "boi-tva-10. a_b", ["boi-tva-10.", "a_b"]),
        (t.slugify, "Été à Paris !", "t-paris"),
        (t.slugify, "  ", "node"),
        (t.reference_parts, "BOI-RPPM-RCM-40-50-20240730", ["BOI", "RPPM", "RCM", "40", "50"]),
        (t.references, "voir BOI-TVA-10 et boi-tva-10, BOI-IS", ["BOI-TVA-10", "BOI-IS"]),
        (t.legal_refs, "article 279 du CGI, Article 279 du cgi; CGI art. 7", ["article 279 du CGI", "CGI art. 7"]),
        (t.citation_ids, "a [1, 2] b [2] c [x]", [1, 2]),
        (t.numeric_tokens, "1 500,50 et 3.000 puis 12", ["150050", "1500.50", "3000"]),
        (t.first_sentence, "Un ; deux. Trois", "Un ; deux"),
        (t.redact_secrets, "sk-abcdefghijklmnop et api_key = zzz", "[REDACTED_SECRET] et [REDACTED_SECRET]"),
        (t.retry_delay, "Please retry in 3.5s, 'retryDelay': '12s'", 12.0),
        (t.match_text, "taxe d’aménagement", "taxe d amenagement"),
        (t.repair_mojibake, "Ã©tÃ©", "été"),
        (t.repair_mojibake, "Ã©tÃ© €", "Ã©tÃ© €"),
        (t.trivial_fragment, "(70)", True),
        (t.trivial_fragment, "une phrase entière qui compte assez de mots", False),
    ],
)
def test_functions(spark, function, value, expected):
    assert one(spark, value, function) == expected


@pytest.mark.parametrize(("words", "expected"), [(0, 0), (1, 1), (2, 2), (6, 8), (10, 12), (100, 125)])
def test_token_count_rounds_half_to_even(spark, words, expected):
    assert one(spark, " ".join(["w"] * words), t.token_count) == expected == n_tokens(words)


def test_predicates(spark):
    rows = [("BOI-TVA-10-20-20240115", "BOI-TVA-10", True), ("BOI-TVA-100", "BOI-TVA-10", False), ("BOI-TVA", "BOI-TVA-10-20200101", True)]
    found = spark.createDataFrame(rows, "a string, b string, e boolean").select(t.family_match(F.col("a"), F.col("b")).alias("m"), "e").collect()
    assert all(r["m"] == r["e"] for r in found)
    assert one(spark, "BOI-RES-TVA-1", lambda c: t.matches_prefix(c, F.lit("tva")))
    assert not one(spark, "BOI-IS-1", lambda c: t.matches_prefix(c, F.lit("")))
    assert one(spark, "BOI-A-B-10", lambda c: t.match_depth(c, F.lit("A-B-20"))) == 2


PIECES = ["&eacute;", "&euro", "&amp;lt;", "&notit;", "&#233;", "&#x20AC;", "&#128;", "&#0;", "&#xD800;", "&#99999999999", "&#1;", "&#127;", "&;", "&nbsp;", "&NewLine;", "&nvlt;", "&é;", "ﬁ", "²", "e\u0301", "½", "각", "ǆ", "\u0344", "İ", "œ", "\x85", "\x1c", "\u2003", "㎏", "𝒜", "\uffff", "a", " ", ";", "lt;", "<"]


@settings(max_examples=25, deadline=None)
@given(values=st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join) | st.text(alphabet=st.characters(codec="utf-8"), max_size=20), min_size=40, max_size=40))
def test_references_and_folding_equal_the_standard_library(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "x string").select("x", t.normalize_ws(F.col("x")).alias("n"), t.fold_accents(F.col("x")).alias("f")).collect()
    for r in rows:
        clean = " ".join(html.unescape(r["x"]).split())
        assert r["n"] == clean
        assert r["f"] == "".join(c for c in unicodedata.normalize("NFKD", clean) if not unicodedata.combining(c))


def test_stems():
    assert stem("application") == stem("applique") == "appliqu"
    assert [stem(w) for w in ("chevaux", "continuellement", "majestueusement", "vraiment")] == ["cheval", "continuel", "majestu", "vrai"]


def test_facts():
    found = facts("En 2024, le 15 janvier : 1 500 euros et 20 % pour 42 parts")
    assert [f[:2] for f in found] == [("1500", "euros"), ("20", "%"), ("42", "nombre")]
    assert [f[0] for f in facts("3 maisons")] == ["3"]
    assert facts("le 3 mai") == []
    assert [f[:2] for f in facts("12345678901234567890 euros, 1\u00a0500, ٣٤")] == [("12345678901234567890", "euros"), ("34", "nombre")]
    assert facts("1" * 5000) == []


def test_plain_facts():
    """With SQL's classes ``mai`` before another letter's accent is a month, white space that isn't ASCII's stays, and numbers have any length."""
    assert facts("le 3 maié") != [] and facts("le 3 maié", plain=True) == []
    assert facts("le 3 ÉMARS", plain=True) == facts("le 3 mai", plain=True) == [] and [f[0] for f in facts("le 3 AOÛTS", plain=True)] == ["3"]
    assert facts("\u20037 %\u00a0", plain=True) == [("7", "%", "\u20037 %")]
    assert facts("٣٤, 1\u00a0500", plain=True) == [] and [f[:2] for f in facts("1" * 5000 + " euros", plain=True)] == [("1" * 5000, "euros")]


def test_fragments_are_judged_alike():
    assert not is_trivial("русский текст здесь")
    assert is_trivial("— § …")


def test_stems_are_those_of_the_tokens(spark):
    texts = ["Les exon\u00e9rations&nbsp;fiscales &eacute;t&eacute;", "\ufb01scaux m\u00b2 e\u0301te\u0301s", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    found = {r["i"]: r["s"] for r in rows.select("i", slow.stems(F.col("text")).alias("s")).collect()}
    tokens = {r["i"]: r["s"] for r in rows.select("i", t.tokens(F.col("text")).alias("s")).collect()}
    assert found == {i: [stem(w) for w in ws] for i, ws in tokens.items()}
