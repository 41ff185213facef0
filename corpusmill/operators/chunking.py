"""Documents to chunks: paragraph units and section windows as expressions, all strategies by document in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t

STRATEGIES = ("paragraph_preserving", "section_window", "parent_child")


def paragraph_units(paragraphs: DataFrame) -> DataFrame:
    """``item, section, unit, first_no, last_no, n_words, text``: trivial fragments go with the next paragraph of their section, or the last.

    ``paragraphs(item, section, no, text)``; texts are normalized and not blank.
    """
    by = Window.partitionBy("item", "section")
    rows = paragraphs.withColumn("_p", (~t.trivial_fragment(F.col("text"))).cast("int"))
    before = F.coalesce(F.sum("_p").over(by.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("unit", F.greatest(F.lit(0), F.least(before, F.sum("_p").over(by) - 1)).cast("int"))
    inside = F.array_sort(F.collect_list(F.struct("no", "text")))
    units = rows.groupBy("item", "section", "unit").agg(F.min("no").alias("first_no"), F.max("no").alias("last_no"), inside.alias("x"))
    text = F.array_join(F.transform("x", lambda p: p["text"]), "\n\n")
    return units.select("item", "section", "unit", "first_no", "last_no", t.n_words(text).cast("int").alias("n_words"), text.alias("text"))


def section_windows(units: DataFrame, max_tokens: int = 350) -> DataFrame:
    """``item, section, window, n_units, n_words, n_tokens, text``: units of a section packed in order while their tokens fit.

    A window's tokens depend on its number of words alone, so the fold carries (words, window).
    """
    grouped = units.groupBy("item", "section").agg(F.array_sort(F.collect_list(F.struct("unit", "n_words", "text"))).alias("u"))
    empty = F.struct(F.lit(0).alias("w"), F.lit(0).alias("g"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(state, u):
        total = state["w"] + u["n_words"]
        opens = (F.size(state["out"]) > 0) & (t.tokens_of_words(total) > max_tokens)
        g = state["g"] + opens.cast("int")
        return F.struct(F.when(opens, u["n_words"]).otherwise(total).alias("w"), g.alias("g"), F.concat(state["out"], F.array(g)).alias("out"))

    windows = F.aggregate("u", empty, step, lambda s: s["out"])
    rows = grouped.withColumn("g", windows).select("item", "section", F.explode(F.arrays_zip("u", "g")).alias("x"))
    rows = rows.select("item", "section", F.col("x.g").alias("window"), F.col("x.u.unit").alias("unit"), F.col("x.u.n_words").alias("n_words"), F.col("x.u.text").alias("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("unit", "text"))), lambda x: x["text"])
    out = rows.groupBy("item", "section", "window").agg(F.count(F.lit(1)).cast("int").alias("n_units"), F.sum("n_words").cast("int").alias("n_words"), F.array_join(parts, "\n\n").alias("text"))
    return out.select("item", "section", "window", "n_units", "n_words", t.tokens_of_words(F.col("n_words")).alias("n_tokens"), "text")


# --- by document ---

_SENTENCE = re.compile(r"(?<=[.!?:;])\s+")
_TRIVIAL = re.compile(t.TRIVIAL, re.I)


def n_tokens(words: int) -> int:
    """The token estimate of a number of words (half to even)."""
    return max(1, round(words * 1.25)) if words else 0


def clean(text: str | None) -> str:
    from html import unescape

    return " ".join(unescape(text or "").replace("\xa0", " ").split())


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", clean(text).lower()).strip("-") or "node"


def is_trivial(text: str) -> bool:
    return n_tokens(len(text.split())) <= 5 and (len(text) <= 12 or bool(_TRIVIAL.fullmatch(text)))


def _unique(refs: list[str]) -> list[str]:
    return list({r.lower(): r for r in reversed(refs)}.values())[::-1]


def split_text(text: str, limit: int) -> list[str]:
    """Sentences packed while they fit ``limit`` tokens; a sentence that doesn't fit is cut between words."""
    text = clean(text)
    if n_tokens(len(text.split())) <= limit:
        return [text]
    packed: list[list[str]] = []
    for sentence in filter(None, map(str.strip, _SENTENCE.split(text))):
        words = sentence.split()
        if packed and n_tokens(len(packed[-1]) + len(words)) <= limit:
            packed[-1] += words
        else:
            packed.append(words)
    most = max(1, next(n for n in range(limit + 2, 0, -1) if n == 1 or n_tokens(n) <= limit))
    return [" ".join(words[i : i + most]) for words in packed for i in range(0, len(words), most)]


class _Chunker:
    """The chunks of one document (a dict with ``sections``, ``paragraphs``, ``tables``)."""

    def __init__(self, doc: dict, strategy: str, max_tokens: int, min_tokens: int, across: bool, tables: bool):
        self.doc, self.strategy, self.most, self.least, self.across, self.tables = doc, strategy, max_tokens, min_tokens, across, tables
        self.paths = {s["section_id"]: list(s["path"]) for s in doc.get("sections") or []}

    def path(self, section: str | None) -> list[str]:
        return self.paths.get(section, [self.doc["title"]]) if section else [self.doc["title"]]

    def units(self) -> Iterator[tuple[str | None, list[dict]]]:
        """Sections in the order in which paragraphs first name them, with their units."""
        groups: dict[str | None, list[dict]] = {}
        for p in self.doc.get("paragraphs") or []:
            groups.setdefault(p["section_id"], []).append(p)
        for section, members in groups.items():
            found: list[dict] = []
            waiting: list[dict] = []
            for p in members:
                part = {"ids": [p["paragraph_id"]], "text": clean(p["text"]), "refs": list(p.get("legal_refs") or [])}
                if not part["text"]:
                    continue
                waiting.append(part)
                if not is_trivial(part["text"]):
                    found.append(self.glued(waiting))
                    waiting = []
            if waiting:
                found[-1:] = [self.glued(found[-1:] + waiting)]
            yield section, found

    @staticmethod
    def glued(parts: list[dict]) -> dict:
        return {"ids": [i for p in parts for i in p["ids"]], "text": "\n\n".join(p["text"] for p in parts), "refs": _unique([r for p in parts for r in p["refs"]])}

    def windows(self, units: list[dict]) -> list[list[dict]]:
        out: list[list[dict]] = []
        total = 0
        for u in units:
            n = len(u["text"].split())
            if out and n_tokens(total + n) <= self.most:
                out[-1].append(u)
                total += n
            else:
                out.append([u])
                total = n
        return out

    def emit(self, section: str | None, unit: dict, kind: str, parent: str | None = None, base: str | None = None) -> list[dict]:
        path = self.path(section)
        base = base or "__".join([self.doc["document_id"], self.strategy, slug(unit["ids"][0]), slug(unit["ids"][-1]), slug("|".join(path))])
        parts = split_text(unit["text"], self.most)
        several = len(parts) > 1
        return [
            {
                "chunk_id": f"{base}__part{i:03d}" if several else base, "source_type": "BOFIP", "document_id": self.doc["document_id"], "boi_reference": self.doc["boi_reference"],
                "doc_version": self.doc.get("publication_date"), "strategy": self.strategy, "section_id": section, "parent_chunk_id": parent, "section_path": path, "paragraph_range": list(unit["ids"]),
                "text": part, "token_count": n_tokens(len(part.split())), "chunk_kind": f"{kind}_split" if several else kind, "legal_refs": list(unit["refs"]),
            }
            for i, part in enumerate(parts)
        ]

    def small(self, c: dict) -> bool:
        return c["token_count"] < self.least or is_trivial(c["text"])

    def fits(self, a: dict, b: dict) -> bool:
        same = self.across or a["section_id"] == b["section_id"]
        return same and "table" not in (a["chunk_kind"], b["chunk_kind"]) and a["token_count"] + b["token_count"] <= self.most

    def merged(self, a: dict, b: dict) -> dict:
        text = a["text"] + "\n\n" + b["text"]
        new = {"chunk_id": a["chunk_id"] + "__merge__" + b["chunk_id"].rsplit("__", 1)[-1], "text": text, "token_count": n_tokens(len(text.split())), "chunk_kind": "paragraph_window"}
        return a | new | {"parent_chunk_id": None, "paragraph_range": a["paragraph_range"] + b["paragraph_range"], "legal_refs": _unique(a["legal_refs"] + b["legal_refs"])}

    def merge_small(self, chunks: list[dict]) -> list[dict]:
        """Small chunks join the next one, pair by pair; what is still small joins the one before."""
        forward: list[dict] = []
        queue = chunks[::-1]
        while queue:
            c = queue.pop()
            if queue and self.small(c) and self.fits(c, queue[-1]):
                c = self.merged(c, queue.pop())
            forward.append(c)
        out: list[dict] = []
        for c in forward:
            if out and self.small(c) and self.fits(out[-1], c):
                out[-1] = self.merged(out[-1], c)
            else:
                out.append(c)
        return out

    def run(self) -> list[dict]:
        out: list[dict] = []
        for section, units in self.units():
            if self.strategy == "paragraph_preserving":
                out += [c for u in units for c in self.emit(section, u, "paragraph")]
                continue
            for n, window in enumerate(self.windows(units)):
                whole = self.glued(window)
                if self.strategy == "section_window":
                    out += self.emit(section, whole, "paragraph_window" if len(window) > 1 else "paragraph")
                    continue
                name = "__".join([self.doc["document_id"], "parent_child", "parent", slug("|".join(self.path(section))), slug(whole["ids"][0]), slug(whole["ids"][-1]), f"w{n:03d}"])
                parents = self.emit(section, whole, "parent_section", base=name)
                out += parents + [c for u in window for c in self.emit(section, u, "child_paragraph", parents[0]["chunk_id"])]
        if self.strategy == "section_window":
            out = self.merge_small(out)
        for table in sorted((self.doc.get("tables") or []) if self.tables else [], key=lambda x: x["order_index"]):
            text = clean(table["linearized_text"])
            if text:
                name = "__".join([self.doc["document_id"], self.strategy, slug(table["table_id"]), slug("|".join(self.path(table["section_id"])))])
                out += self.emit(table["section_id"], {"ids": [table["table_id"]], "text": text, "refs": list(table.get("legal_refs") or [])}, "table", base=name)
        return out


DDL = "chunk_id string, source_type string, document_id string, boi_reference string, doc_version string, strategy string, section_id string, parent_chunk_id string, section_path array<string>, paragraph_range array<string>, text string, token_count int, chunk_kind string, legal_refs array<string>"
_S = pa.list_(pa.string())
SCHEMA = pa.schema([(n, _S if n in ("section_path", "paragraph_range", "legal_refs") else pa.int32() if n == "token_count" else pa.string()) for n in (p.split()[0] for p in DDL.split(", "))])


def chunk_document(doc: dict, strategy: str = "section_window", max_tokens: int = 350, min_tokens: int = 40, across_sections: bool = False, tables: bool = True) -> list[dict]:
    """The chunks of one document."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    return _Chunker(doc, strategy, max_tokens, min_tokens, across_sections, tables).run()


def build_chunks(documents: DataFrame, strategy: str = "section_window", max_tokens: int = 350, min_tokens: int = 40, across_sections: bool = False, tables: bool = True) -> DataFrame:
    """The chunks of all documents (rows ``document_id, boi_reference, title, publication_date, sections, paragraphs, tables``): no shuffle."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = [c for doc in batch.slice(at, 64).to_pylist() for c in chunk_document(doc, strategy, max_tokens, min_tokens, across_sections, tables)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return documents.mapInArrow(run, DDL)
