"""Raw XML and HTML to structured documents: XPath for the metadata, one Arrow pass a document for the HTML tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.functions.text import LEGAL
from corpusmill.operators.chunking import clean, slug

HEADINGS = {f"h{i}": i for i in range(1, 7)}
TEXTS = ("p", "li", "blockquote")
_NUMBER = re.compile(r"[§]?\d+(?:\s?[A-Za-z])?")
_LEGAL = [re.compile(p, re.I) for p in LEGAL]
_UNSEEN = ("script", "style", "template")


def legal_refs(text: str) -> list[str]:
    """As ``functions.text.legal_refs``, for one string."""
    found = [m[0].strip() for p in _LEGAL for m in p.finditer(text)]
    return list({r.lower(): r for r in reversed(found)}.values())[::-1]


class _Block:
    """An open heading, text block or table: its text so far, its links, its cells."""

    def __init__(self, tag: str, anchor: str | None):
        self.tag, self.anchor = tag, anchor
        self.parts: list[str] = []
        self.links: list[dict] = []
        self.rows: list[tuple[bool, list[list[str]]]] = []

    def text(self) -> str:
        return clean(" ".join(filter(None, map(str.strip, self.parts))))


class _Reader(HTMLParser):
    """Collects the blocks of a page in the order in which they open; p and li end where HTML says they end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[_Block] = []
        self.open: list[_Block] = []
        self.title: list[str] = []
        self.hidden = 0
        self.in_title = False
        self.link: dict | None = None

    def close_tag(self, *tags: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag == "table":
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = {k: v or "" for k, v in attrs}
        if tag in _UNSEEN:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a" and "href" in found:
            self.link = {"text": "", "href": found["href"], "is_internal": found["href"].startswith("#"), "source_anchor": None}
            for b in self.open:
                b.links.append(self.link)
        elif tag == "tr":
            for b in self.open:
                if b.tag == "table":
                    b.rows.append((False, []))
        elif tag in ("td", "th"):
            for b in self.open:
                if b.tag == "table":
                    if not b.rows:
                        b.rows.append((False, []))
                    head, cells = b.rows[-1]
                    b.rows[-1] = (head or tag == "th", [*cells, []])
        if tag in HEADINGS or tag in TEXTS or tag == "table":
            if tag != "li":
                self.close_tag("p")
            else:
                self.close_tag("p", "li") if self.open and self.open[-1].tag == "p" else self.close_tag("li")
            block = _Block(tag, found.get("id") or found.get("name") or None)
            self.blocks.append(block)
            self.open.append(block)
        elif tag in ("ul", "ol", "div", "section", "article", "hr"):
            self.close_tag("p")

    def handle_endtag(self, tag: str) -> None:
        if tag in _UNSEEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a":
            self.link = None
        if any(b.tag == tag for b in self.open):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
            return
        if self.hidden:
            return
        if self.link is not None:
            self.link["text"] = clean(self.link["text"] + " " + data)
        for b in self.open:
            b.parts.append(data)
            if b.tag == "table" and b.rows and b.rows[-1][1]:
                b.rows[-1][1][-1].append(data)


def parse_page(document_id: str, html: str | None) -> dict:
    """Title, section tree, paragraphs, tables, links and legal references of one page.

    A paragraph that is a bare number numbers the next one.  What comes before any heading belongs to a section of level 0,
    named after the page, that stands first but is numbered last.
    """
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    title = clean("".join(reader.title)) or None
    sections: list[dict] = []
    paragraphs: list[dict] = []
    tables: list[dict] = []
    above: list[dict] = []
    number = None

    def section_id(n: int, name: str) -> str:
        return f"{document_id}__section__{n:04d}__{slug(name)}"

    for b in reader.blocks:
        here = above[-1]["section_id"] if above else None
        text = b.text()
        if b.tag == "table":
            rows = [(head, cells) for head, raw in b.rows if (cells := [c for c in (clean(" ".join(map(str.strip, x))) for x in raw) if c])]
            header = next((i for i, (head, _) in enumerate(rows) if head), None)
            headers = rows.pop(header)[1] if header is not None else []
            lines = "\n".join(" | ".join(x) for x in ([headers] if headers else []) + [c for _, c in rows])
            if lines:
                tables.append({"table_id": f"{document_id}__table__{len(tables):04d}", "section_id": here, "order_index": len(tables), "headers": headers, "rows": [c for _, c in rows], "caption": None, "linearized_text": lines, "legal_refs": legal_refs(lines)})
        elif not text:
            continue
        elif b.tag in HEADINGS:
            while above and above[-1]["level"] >= HEADINGS[b.tag]:
                above.pop()
            new = {"section_id": section_id(len(sections), text), "parent_section_id": above[-1]["section_id"] if above else None, "level": HEADINGS[b.tag], "order_index": len(sections), "title": text, "anchor": b.anchor, "path": [s["title"] for s in above] + [text]}
            sections.append(new)
            above.append(new)
        elif b.tag == "p" and _NUMBER.fullmatch(text):
            number = text
        else:
            links = [x | {"source_anchor": b.anchor} for x in b.links]
            paragraphs.append({"paragraph_id": f"{document_id}__paragraph__{len(paragraphs):05d}", "section_id": here, "order_index": len(paragraphs), "html_tag": b.tag, "anchor": b.anchor, "paragraph_number": number, "text": text, "legal_refs": legal_refs(text), "links": links})
            number = None
    orphans = [x for x in paragraphs + tables if x["section_id"] is None]
    if orphans:
        name = title or document_id
        root = {"section_id": section_id(len(sections), name), "parent_section_id": None, "level": 0, "order_index": len(sections), "title": name, "anchor": None, "path": [name]}
        sections.insert(0, root)
        for x in orphans:
            x["section_id"] = root["section_id"]
    refs = [r for x in paragraphs + tables for r in x["legal_refs"]]
    return {"document_id": document_id, "html_title": title, "sections": sections, "paragraphs": paragraphs, "tables": tables, "legal_refs": list({r.lower(): r for r in reversed(refs)}.values())[::-1]}


_LINK = "array<struct<text:string,href:string,is_internal:boolean,source_anchor:string>>"
DDL = (
    "document_id string, html_title string, "
    "sections array<struct<section_id:string,parent_section_id:string,level:int,order_index:int,title:string,anchor:string,path:array<string>>>, "
    f"paragraphs array<struct<paragraph_id:string,section_id:string,order_index:int,html_tag:string,anchor:string,paragraph_number:string,text:string,legal_refs:array<string>,links:{_LINK}>>, "
    "tables array<struct<table_id:string,section_id:string,order_index:int,headers:array<string>,rows:array<array<string>>,caption:string,linearized_text:string,legal_refs:array<string>>>, legal_refs array<string>"
)


def parse_html(pages: DataFrame) -> DataFrame:
    """``document_id, html`` to structured rows (``DDL``); one row a page, no shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(DDL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_pylist([parse_page(i, h) for i, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], schema=schema)

    return pages.select("document_id", "html").mapInArrow(run, DDL)


def tree_rows(documents: DataFrame) -> DataFrame:
    """One row for each section, paragraph and table: ``document_id, node_type, node_id, parent_node_id, order_index, title, path, paragraph_number, text``."""
    null = F.lit(None).cast("string")
    no_path = F.lit(None).cast("array<string>")

    def rows(array: str, kind: str, node: str, parent: str, title: Column, path: Column, number: Column, text: Column) -> DataFrame:
        x = documents.select("document_id", F.explode(array).alias("x"))
        return x.select("document_id", F.lit(kind).alias("node_type"), F.col(f"x.{node}").alias("node_id"), F.col(f"x.{parent}").alias("parent_node_id"), "x.order_index", title.alias("title"), path.alias("path"), number.alias("paragraph_number"), text.alias("text"))

    sections = rows("sections", "section", "section_id", "parent_section_id", F.col("x.title"), F.col("x.path"), null, null)
    paragraphs = rows("paragraphs", "paragraph", "paragraph_id", "section_id", null, no_path, F.col("x.paragraph_number"), F.col("x.text"))
    return sections.unionByName(paragraphs).unionByName(rows("tables", "table", "table_id", "section_id", F.col("x.caption"), no_path, null, F.col("x.linearized_text")))


def scan(spark: SparkSession, root: str, kind: str = "Contenu") -> DataFrame:
    """``folder, category_path, xml, html`` of the documents under ``root/kind``: each document.xml with its data.html, else data.htm."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/{kind}")
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), name.alias("name"), F.col("content").cast("string").alias("body"))
    xml = rows.filter("name = 'document.xml'").select("folder", F.col("body").alias("xml"))
    best = Window.partitionBy("folder").orderBy(F.desc("name"))
    html = rows.filter("name in ('data.html', 'data.htm')").withColumn("n", F.row_number().over(best)).filter("n = 1").select("folder", F.col("body").alias("html"))
    category = F.split(F.regexp_extract("folder", f"{kind}/(.*)$", 1), "/")
    return xml.join(html, "folder").withColumn("category_path", category).orderBy("folder")


def xml_fields(documents: DataFrame) -> DataFrame:
    """Adds the metadata of a document's ``xml``: title, reference, date, type, language, subjects, identifiers, ids and source."""
    def many(name: str) -> Column:
        found = F.xpath("xml", F.lit(f'//*[local-name()="{name}"]/text()'))
        return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")

    one = lambda name: F.get(many(name), F.lit(0))
    rows = documents.withColumn("identifiers", many("identifier")).withColumn("subjects", many("subject"))
    is_url = lambda x: F.startswith(x, F.lit("http"))
    tags = F.regexp_extract_all("xml", F.lit(r"<(?:[\w.-]+:)?relation\b[^>]*>[^<]*<"), F.lit(0))
    links = F.transform(tags, lambda x: F.struct(F.nullif(t.unescape(F.regexp_extract(x, r"""\btype\s*=\s*["']([^"']*)["']""", 1)), F.lit("")).alias("type"), t.normalize_ws(F.regexp_extract(x, ">([^<]*)<", 1)).alias("target")))
    parent = F.element_at(F.split("folder", "/"), -2) if "folder" in documents.columns else F.lit(None).cast("string")
    title = F.coalesce(one("title"), F.lit(""))
    return rows.withColumns({
        "title": title, "boi_reference": F.coalesce(one("contenu_id"), title), "publication_date": one("date"), "language": one("language"), "content_type": one("contenu_type"),
        "document_type": F.nullif(F.xpath_string("xml", F.lit("/*/@type")), F.lit("")), "relations": many("relation"), "relation_links": F.filter(links, lambda x: x["target"] != ""), "data_ref": one("dataRef"),
        "source_url": F.get(F.filter("identifiers", is_url), F.lit(0)), "document_id": F.coalesce(F.get(F.filter("identifiers", lambda x: ~is_url(x)), F.lit(0)), parent),
    })


def build_documents(scanned: DataFrame) -> DataFrame:
    """Scanned files to whole documents: metadata, tree, and the length of their texts."""
    meta = xml_fields(scanned)
    tree = parse_html(meta.select("document_id", "html")).withColumnRenamed("document_id", "_id")
    rows = meta.drop("xml", "html").join(tree, F.col("document_id") == F.col("_id")).drop("_id")
    total = lambda array, field: F.aggregate(F.transform(array, lambda x: F.length(x[field])), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("raw_text_length", total("paragraphs", "text") + total("tables", "linearized_text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped and missing fields are null."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
