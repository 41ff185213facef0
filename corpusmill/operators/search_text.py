"""What is searched: texts built from a document's or a chunk's fields, blank parts left out, joined by line feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import normalize_ws, title_segments


def joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: normalize_ws(x) != ""), "\n")


def fields(ref: Column, title: Column, category: Column, html_title: Column | None = None, subjects: Column | None = None) -> dict[str, Column]:
    none = F.lit("")
    return {"ref": ref, "title": title, "html_title": none if html_title is None else html_title, "category": F.array_join(category, " "), "subjects": none if subjects is None else F.array_join(subjects, " ")}


def document_base(x: dict[str, Column]) -> Column:
    return joined(x["ref"], x["title"], x["html_title"], x["category"], x["subjects"])


def document_title(x: dict[str, Column]) -> Column:
    return joined(x["ref"], x["title"], x["html_title"])


def document_title_tail(ref: Column, title: Column) -> Column:
    """Reference and the last two segments of the title; without a title, the reference."""
    s = title_segments(title)
    tail = F.when(F.size(s) >= 2, F.concat_ws(" - ", F.element_at(s, -2), F.element_at(s, -1))).otherwise(F.get(s, F.lit(0)))
    return joined(ref, tail)


def document_sections(x: dict[str, Column], titles: Column) -> Column:
    return joined(document_base(x), F.array_join(F.slice(titles, 1, 12), " "))


def document_sections_firstpara(x: dict[str, Column], titles: Column, texts: Column) -> Column:
    return joined(document_sections(x, titles), F.array_join(F.slice(texts, 1, 3), " "))


def document_sections_leads(x: dict[str, Column], titles: Column, leads: Column) -> Column:
    return joined(document_sections(x, titles), F.array_join(F.slice(leads, 1, 8), " "))


def section_heads(paragraphs: DataFrame) -> DataFrame:
    """``item, heads``: the first paragraph of each section, in order (rows ``item, section, no, text``)."""
    heads = paragraphs.groupBy("item", "section").agg(F.min_by("text", "no").alias("head"))
    return heads.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("section", "head"))), lambda x: x["head"]).alias("heads"))


def paragraphs_of(paragraphs: DataFrame) -> DataFrame:
    """``item, texts``: the paragraphs in order."""
    return paragraphs.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]).alias("texts"))


def chunk_full(ref: Column, path: Column, legal: Column, text: Column) -> Column:
    return joined(ref, F.array_join(path, " "), F.array_join(legal, " "), text)


def chunk_leaf(path: Column, legal: Column, text: Column) -> Column:
    return joined(F.when(F.size(path) > 0, F.element_at(path, -1)).otherwise(""), F.array_join(legal, " "), text)


def chunk_body(text: Column) -> Column:
    return text


def query_text(text: Column, model: str) -> Column:
    """What an encoder is given for a query; models of the E5 family want a prefix."""
    return F.concat(F.lit("query: "), text) if "e5" in model.lower() else text


def passage_text(text: Column, model: str) -> Column:
    return F.concat(F.lit("passage: "), text) if "e5" in model.lower() else text
