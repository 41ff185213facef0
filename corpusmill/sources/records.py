"""Typed decoding of JSON records: what fits gets the defaults of what it lacks, what doesn't is put aside with its reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How JSON's kinds are called in reasons, by the beginning of their type's name in a variant.
KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "list": "ARRAY", "object": "OBJECT"}
NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


@dataclass(frozen=True)
class Field:
    """A field of a record: its kind (``string``, ``integer``, ``number``, ``boolean``, ``list`` or ``object``), its type in Spark, and whether
    it must be there; if not, ``default`` (SQL; null by default) stands for it.  A null counts as absent unless ``nullable``.
    """

    name: str
    kind: str
    type: str
    required: bool = True
    default: str = "null"
    nullable: bool = False


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def decode(rows: DataFrame, fields: list[Field], json: str = "json") -> DataFrame:
    """``rows`` with ``record`` (a struct of ``fields``; null if it doesn't fit) and ``problem`` (null if it does).

    The problem is the first in the order of ``fields``: no JSON, no object, a field that is missing, null or of another kind, or one whose
    value its type can't hold (a whole number beyond a long, an entry of a list of another kind).  Other fields are ignored.
    """
    found = rows.withColumn("_v", F.try_parse_json(json))
    checks = F.when(F.col("_v").isNull(), "not JSON").when(~_kind(F.col("_v")).startswith("OBJECT"), "not an object")
    values = []
    for f in fields:
        value = F.try_variant_get("_v", f'$["{f.name}"]', "variant")
        kind = F.coalesce(_kind(value), F.lit("ABSENT"))
        absent = kind.isin("ABSENT") if f.nullable else kind.isin("ABSENT", "VOID")
        typed = F.try_variant_get("_v", f'$["{f.name}"]', f.type)
        fits = F.lit(False)
        for k in NUMBERS if f.kind == "number" else (KINDS[f.kind],):
            fits = fits | kind.startswith(k)
        if f.required:
            checks = checks.when(absent, F.when(kind == "VOID", f"null: {f.name}").otherwise(f"missing: {f.name}"))
        checks = checks.when(~absent & (kind != "VOID") & ~fits, F.concat(F.lit(f"not {f.kind}: {f.name}"))).when(fits & typed.isNull(), f"doesn't fit: {f.name}")
        values.append(F.when(absent, F.expr(f"cast({f.default} as {f.type})")).otherwise(typed).alias(f.name))
    found = found.withColumn("problem", checks)
    return found.withColumn("record", F.when(F.col("problem").isNull(), F.struct(*values))).drop("_v")


def split(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records, flat, and the quarantine: both keep the other columns."""
    others = [c for c in decoded.columns if c not in ("record", "problem")]
    return decoded.filter("problem is null").select(*others, "record.*"), decoded.filter("problem is not null").drop("record")


#: The fields of chunks and documents, and what stands for those that are left out.
_LIST = "cast(array() as array<string>)"
CHUNK = [
    Field("chunk_id", "string", "string"), Field("source_type", "string", "string"), Field("document_id", "string", "string"), Field("boi_reference", "string", "string"),
    Field("doc_version", "string", "string", False), Field("strategy", "string", "string"), Field("section_id", "string", "string", False), Field("parent_chunk_id", "string", "string", False),
    Field("section_path", "list", "array<string>", False, _LIST), Field("paragraph_range", "list", "array<string>", False, _LIST), Field("text", "string", "string"),
    Field("token_count", "integer", "bigint"), Field("chunk_kind", "string", "string"), Field("legal_refs", "list", "array<string>", False, _LIST),
]
DOCUMENT = [
    Field("document_id", "string", "string"), Field("boi_reference", "string", "string"), Field("title", "string", "string"), Field("document_type", "string", "string"),
    *[Field(n, "string", "string", False) for n in ("content_type", "publication_date", "source_url", "language")],
    *[Field(n, "list", "array<string>", False, _LIST) for n in ("subjects", "identifiers", "category_path")],
    Field("raw_xml_path", "string", "string", False, "''"), Field("raw_html_path", "string", "string", False, "''"), Field("version_status", "string", "string", False),
    Field("legal_refs", "list", "array<string>", False, _LIST), Field("html_title", "string", "string", False), Field("raw_text_length", "integer", "bigint", False, "0"),
]
