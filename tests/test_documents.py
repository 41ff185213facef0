import time

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.chunking import build_chunks, chunk_document, split_text
from corpusmill.sources import artifacts, ingest, manifest
from corpusmill.streaming import progress

PAGE = '<html><head><title>Titre</title></head><body><h1>Un</h1><p>10</p><p>Premier alinéa.</p><p>Selon l\'article 279 du CGI <a href="#x">ici</a>.</p><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table></body></html>'
XML = '<document type="Contenu" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:b="urn:b"><dc:title>Le titre</dc:title><dc:date>2024-01-15</dc:date><dc:language>fr</dc:language><dc:subject>TVA</dc:subject><dc:identifier>1234-PGP</dc:identifier><dc:identifier>http://x/1</dc:identifier><b:contenu_type>Commentaire</b:contenu_type><b:contenu_id>BOI-TVA-TEST-20240115</b:contenu_id></document>'


def test_page():
    page = ingest.parse_page("d", PAGE)
    assert [s["title"] for s in page["sections"]] == ["Un"]
    assert [(p["paragraph_number"], p["text"]) for p in page["paragraphs"]] == [("10", "Premier alinéa."), (None, "Selon l'article 279 du CGI ici .")]
    assert page["tables"][0]["linearized_text"] == "A | B\n1 | 2"
    assert page["legal_refs"] == ["article 279 du CGI"]
    assert page["paragraphs"][1]["links"][0]["is_internal"]


def test_nested_and_orphan():
    page = ingest.parse_page("d", "<p>Avant</p><h1>a</h1><h2>b</h2><h3>c</h3><h4>d</h4><h2>e</h2>")
    assert [s["level"] for s in page["sections"]] == [0, 1, 2, 3, 4, 2]
    assert page["sections"][4]["path"] == ["a", "b", "c", "d"]
    assert page["sections"][0]["order_index"] == 5
    assert page["paragraphs"][0]["section_id"] == page["sections"][0]["section_id"]


def test_scan_and_build(spark, tmp_path):
    folder = tmp_path / "Contenu" / "A" / "1234" / "2024-01-15"
    folder.mkdir(parents=True)
    (folder / "document.xml").write_text(XML)
    (folder / "data.htm").write_text("<p>old</p>")
    (folder / "data.html").write_text(PAGE)
    row = ingest.build_documents(ingest.scan(spark, f"file://{tmp_path}")).collect()
    assert len(row) == 1
    r = row[0]
    assert (r["document_id"], r["boi_reference"], r["source_url"], r["content_type"], r["publication_date"]) == ("1234-PGP", "BOI-TVA-TEST-20240115", "http://x/1", "Commentaire", "2024-01-15")
    assert (len(r["paragraphs"]), r["subjects"], r["document_type"]) == (2, ["TVA"], "Contenu")
    assert ingest.tree_rows(ingest.build_documents(ingest.scan(spark, f"file://{tmp_path}"))).count() == 4


def document(paragraphs, sections=("A",)):
    return {"document_id": "d", "boi_reference": "BOI-X", "title": "T", "publication_date": None, "sections": [{"section_id": s, "path": [s]} for s in sections], "paragraphs": [{"paragraph_id": f"p{i}", "section_id": s, "text": x, "legal_refs": []} for i, (s, x) in enumerate(paragraphs)], "tables": []}


LONG = "une phrase assez longue pour ne pas être triviale du tout ici"


def test_trivial_fragments_join_the_next_unit():
    chunks = chunk_document(document([("A", "(70)"), ("A", LONG)]), "paragraph_preserving", max_tokens=100)
    assert [c["text"] for c in chunks] == [f"(70) {LONG}"]
    assert chunks[0]["paragraph_range"] == ["p0", "p1"]


def test_long_paragraphs_are_split():
    text = " ".join(f"mot{i}" for i in range(500))
    for strategy in ("paragraph_preserving", "section_window", "parent_child"):
        chunks = chunk_document(document([("A", text)]), strategy, max_tokens=80)
        assert all(c["token_count"] <= 80 for c in chunks)
    assert " ".join(split_text(text, 80)) == text


def test_sections_merge_only_if_asked():
    doc = document([("A", "(60)"), ("B", LONG)], ("A", "B"))
    assert len(chunk_document(doc)) == 2
    assert len(chunk_document(doc, across_sections=True)) == 1


def test_parents_and_children(spark):
    doc = document([("A", LONG), ("A", LONG + " encore")])
    chunks = chunk_document(doc, "parent_child")
    assert [c["chunk_kind"] for c in chunks] == ["parent_section", "child_paragraph", "child_paragraph"]
    assert {c["parent_chunk_id"] for c in chunks[1:]} == {chunks[0]["chunk_id"]}
    with pytest.raises(ValueError, match="strategy"):
        chunk_document(doc, "other")
    ddl = "document_id string, boi_reference string, title string, publication_date string, sections array<struct<section_id:string,path:array<string>>>, paragraphs array<struct<paragraph_id:string,section_id:string,text:string,legal_refs:array<string>>>, tables array<struct<table_id:string,section_id:string,order_index:int,linearized_text:string>>"
    assert build_chunks(spark.createDataFrame([doc], ddl), "parent_child").count() == 3


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("Ã©tÃ©",)], "x string")
    artifacts.write(rows, f"file://{tmp_path}/a", "csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/a").first()["x"] == "été"
    with pytest.raises(Exception, match="secret"):
        artifacts.write(spark.createDataFrame([("sk-abcdefghijklmnop",)], "x string"), f"file://{tmp_path}/b")
    found = manifest.files(spark, f"file://{tmp_path}/a", "*.csv")
    wanted = found.select("path", "length", F.lit("00").alias("sha256")).unionByName(spark.createDataFrame([("gone", 1, "")], "path string, length long, sha256 string"))
    assert {r["problem"] for r in manifest.mismatches(found, wanted).collect()} == {"missing", "sha256 mismatch"}


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1, "b": "é"}\n\n{"a": 2}\n')
    rows = ingest.read_jsonl(spark, f"file://{path}", "a int, b string").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1, "é"), (2, None)]


def test_stream(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,id*7,0) AS ts, 'e' AS event_type, 1.0D AS value FROM range(60)")
    events.write.parquet(f"{tmp_path}/in")
    q = progress.follow(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/cp", f"{tmp_path}/out")
    end = time.time() + 60
    while q.isActive and time.time() < end:
        time.sleep(0.2)
    q.stop()
    batch = {(r["start"], r["n"]) for r in progress.hourly(events).collect()}
    streamed = {(r["start"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert streamed and streamed <= batch


def test_relations_keep_their_types(spark):
    xml = '<d type="X"><dc:relation type="isPartOf">BOI-A &amp; B</dc:relation><relation>BOI-C</relation><dc:relation type="void"/> <other type="no">x</other></d>'
    row = ingest.xml_fields(spark.createDataFrame([(xml,), ("<d/>",), (None,)], "xml string")).select("relation_links").collect()
    assert [(r["type"], r["target"]) for r in row[0][0]] == [("isPartOf", "BOI-A & B"), (None, "BOI-C")]
    assert row[1][0] == [] and not row[2][0]
