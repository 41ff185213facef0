"""WARC archives: a writer on Spark's own file sinks, and a salvage reader.

Writer.  Every page is a record (WARC/1.1, version line, named fields, block).  Of pages whose payloads are equal
and of at least ``least`` bytes, that with the smallest id is a response; the others are revisits that name it and
carry no payload.  Records end in CR LF CR LF, which is the sink's line separator, so the files can be in any
store that Spark writes to.

Reader.  Archives are read as binary files, plain or in gzip members of one or more records.  A record must have a
version line, a length, its end mark, and the digests that it states.  Where a check fails, the reader quarantines the
bytes from there to the next gzip member or version line at which a whole valid record begins, logs the gap with
its reason, and goes on; later records are never lost to an earlier fault.  Inside a member the same holds for its
content; of a member that is cut off or damaged, the whole records before the fault whose digests agree are kept.
Blocks that prove to be none are looked through up to ``PATIENCE`` times the archive's length in all; from then on, a record whose
block holds another version line is a gap, with that reason, and what begins at that line is read.  So the time is linear in a plain
archive, and in the content of a zipped one whose members are whole.

Scale: digests meet by partial aggregation; only payloads that occur twice have a row in the table of first
pages, which is broadcast after it has been counted and found small, and joined (AQE splits a hot digest) if not.
A file is one row of the reader, so the writer bounds the bytes of its files: records go to files with others of
like size, as many to a file as ``file_bytes`` allows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh_path

CRLF = "\r\n"
ID_PREFIX = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
FEW = 100_000


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)))


def _clean(value: Column) -> Column:
    """A header value as it is, but for line ends, which are percent-encoded, so that it can't end its line."""
    for c in ("\r", "\n"):
        value = F.replace(value, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return value


def _most_bytes(url: Column, payload: Column) -> Column:
    """A bound of a record's bytes: payload, url (an escaped character takes three), and less than 2048 for the rest."""
    return F.coalesce(F.octet_length(payload), F.lit(0)).cast("long") + 3 * F.coalesce(F.octet_length(url), F.lit(0)) + 2048


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, least: int = 100) -> DataFrame:
    """A ``record`` string for every row, its WARC record without the end mark, and a bound of its ``bytes``.

    A null payload is empty, a null url has no field, a null id is written as an empty one and never is a first page.
    Rows that repeat both id and payload are each written, as that page's responses.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha2(F.encode("payload", "UTF-8"), 256)).withColumn("n", F.octet_length("payload"))
    first = base.filter(F.col("n") >= least).groupBy(F.col("digest").alias("twice")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1 and first is not null").drop("c")
    few = first.limit(FEW + 1).count() <= FEW
    rows = base.join(F.broadcast(first) if few else first, F.col("digest") == F.col("twice"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    name = lambda c: F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "),
        name(F.col("id")),
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}"),
        _field("WARC-Target-URI", _clean(F.col("url"))),
        F.lit("WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.lit(f"{CRLF}WARC-Block-Digest: sha256:"),
        F.sha2(F.encode("block", "UTF-8"), 256),
        F.lit(CRLF),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), name(F.col("first")), F.lit(CRLF))).otherwise(""),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}Content-Length: "),
        F.octet_length("block"),
        F.lit(CRLF + CRLF),
    )
    return rows.withColumn("block", block).select(F.concat(head, "block").alias("record"), _most_bytes(F.col("url"), F.col("payload")).alias("bytes"))


def write_warc(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, least: int = 100, file_records: int = 4000, file_bytes: int = 64 << 20) -> str:
    """Writes :func:`records` as uncompressed archives; returns their folder.

    A file has at most ``file_records`` records and ``file_bytes`` bytes, or one record: records of up to
    file_bytes / file_records bytes are written together, those up to 16 times as long in files of a sixteenth as many,
    and so on.  Each of these sizes that occurs is a write of its own (four at most for the defaults).
    """
    path = path or fresh_path(pages.sparkSession, "warc")
    most = [file_records]
    while most[-1] > 1:
        most.append(max(1, most[-1] // 16))

    def step(size: Column) -> Column:
        out = F.lit(len(most) - 1)
        for i in range(len(most) - 2, -1, -1):
            out = F.when(size <= file_bytes // most[i], i).otherwise(out)
        return out

    rows = records(pages, id_col, url_col, payload_col, least=least)
    found = sorted(r[0] for r in pages.select(step(_most_bytes(F.col(url_col), F.col(payload_col)))).distinct().collect()) or [0]
    for i in found:
        some = rows.filter(step(F.col("bytes")) == i).select("record")
        some.write.mode("append").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", most[i]).text(path)
    return path


class Fault(Exception):
    """A record that isn't valid; the text says why.  ``cost``: the bytes that were looked through to find out."""

    def __init__(self, why: str, cost: int = 0):
        super().__init__(why)
        self.cost = cost


#: How often over, in all, blocks may be looked through that prove to be none, before those that claim later records are no longer.
PATIENCE = 16


_VERSION = re.compile(rb"WARC/[01]\.\d+\r?\n")
_STARTS = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.\d+\r?\n")


_CHUNK = 1 << 14


def _checked(stated: str | None, data: bytes, what: str) -> bool:
    """Is a digest stated that agrees with ``data``?  One that differs is a fault, one of another kind isn't looked at."""
    algorithm, _, value = (stated or "").partition(":")
    if algorithm not in ("sha256", "sha1", "md5") or not re.fullmatch(r"[0-9a-fA-F]+", value):
        return False
    if hashlib.new(algorithm, data).hexdigest() != value.lower():
        raise Fault(f"{what} digest differs")
    return True


def _content(fields: dict[str, str], block: bytes) -> tuple[bytes | None, int, bool]:
    """Payload, its length, and whether a digest vouches for the record."""
    sure = _checked(fields.get("warc-block-digest"), block, "block")
    payload, length = block, len(block)
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise Fault("HTTP header doesn't end")
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        length = int(stated[1]) if stated else len(payload)
    if fields["warc-type"] == "revisit":
        payload = None
    else:
        length = len(payload)
        sure |= _checked(fields.get("warc-payload-digest"), payload, "payload")
    return payload, length, sure


def parse_record(data: bytes, at: int, patient: bool = True) -> tuple[dict, int]:
    """The record that begins at ``at`` and where it ends (its end mark included); raises :class:`Fault`.

    Unless ``patient``, a block in which another version line stands isn't looked through, and is a fault.
    """
    version = _VERSION.match(data, at)
    if not version:
        raise Fault("no version line")
    fields: dict[str, str] = {}
    begin = version.end()
    while True:
        stop = data.find(b"\r\n", begin)
        if stop < 0:
            raise Fault("no end of header")
        line, begin = data[begin:stop], stop + 2
        if not line:
            break
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Fault("bad field")
        name = name.strip().lower()
        if name in fields and name != "warc-concurrent-to":  # two headers run into one
            raise Fault("a field is repeated")
        fields.setdefault(name, value.strip())
    length = fields.get("content-length") or ""
    if not (length.isascii() and length.isdigit()) or "warc-type" not in fields or "warc-record-id" not in fields:
        raise Fault("a mandatory field is missing")
    last = begin + int(length)
    if last > len(data):
        raise Fault("block is cut off")
    if data[last : last + 4] != b"\r\n\r\n":
        raise Fault("no end mark after the block")
    if not patient and _VERSION.search(data, begin, last):
        raise Fault("claims a later record, after many that proved to be none")
    try:
        payload, length, sure = _content(fields, data[begin:last])
    except Fault as e:
        raise Fault(str(e), last - begin) from None
    return {"fields": fields, "payload": payload, "length": length, "sure": sure}, last + 4


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str | None, list[tuple[int, int]]]:
    """The content of the gzip member at ``at`` and where it ends; if it is faulty, what could be inflated, the reason, and
    (place in ``data``, bytes of content up to there) in steps of 64 bytes.
    """
    view, begin = memoryview(data), at
    member, found = zlib.decompressobj(31), []
    why = None
    while not member.eof and at < len(data) and why is None:
        try:
            found.append(member.decompress(view[at : at + _CHUNK]))
            at = min(len(data), at + _CHUNK)
        except zlib.error as e:
            why = f"gzip member: {e}"
    if why is None and member.eof:
        return b"".join(found), at - len(member.unused_data), None, []
    member, found, marks, size = zlib.decompressobj(31), [], [], 0
    for at in range(begin, len(data), 64):
        marks.append((at, size))
        try:
            found.append(member.decompress(view[at : at + 64]))
        except zlib.error:
            break
        size += len(found[-1])
    return b"".join(found), begin, why or "gzip member is cut off", marks


def salvage(data: bytes, zipped: bool = True) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, record) and ("gap", start, end, reason) that cover ``data`` in order.

    Items overlap only where they come from one gzip member: its records and gaps have its place, and records kept of
    a faulty member stand, with no length, before the gap that holds it.  ``zipped``: may there be gzip members?
    """

    def one(at: int) -> tuple[list[tuple[str, object]], int, str | None]:
        """What begins at ``at`` and where it ends; or the reason why it doesn't end well, what is kept, and where to go on."""
        if not zipped or data[at : at + 3] != b"\x1f\x8b\x08":
            record, end = parse_record(data, at, spent <= PATIENCE * len(data))
            return [("record", record)], end, None
        inner, end, why, marks = _inflated(data, at)
        found = list(salvage(inner, False))
        if why is not None:
            kept = [(b, x) for kind, _, b, x in found if kind == "record" and x["sure"]]
            past = max((b for b, _ in kept), default=0)
            return [("record", x) for _, x in kept], max(p for p, n in marks if n <= past) if past else at, why
        if found and not any(kind == "record" for kind, *_ in found):
            raise Fault(f"in gzip member: {found[0][3]}")
        return [(kind, x if kind == "record" else f"bytes {a} to {b} in gzip member: {x}") for kind, a, b, x in found], end, None

    at, bad, why = 0, None, ""
    spent = 0
    while at < len(data):
        try:
            found, end, fault = one(at)
        except Fault as e:
            found, end, fault = [], at, str(e)
            spent += e.cost
        if bad is not None and found:
            yield "gap", bad, at, why
            bad = None
        for kind, x in found:
            yield kind, at, at if fault is not None else end, x
        if fault is not None:
            if bad is None:
                bad, why = at, fault
            start = (_STARTS if zipped else _VERSION).search(data, max(at + 1, end))
            at = start.start() if start else len(data)
            continue
        if bad is not None:
            yield "gap", bad, at, why
            bad = None
        at = end
    if bad is not None:
        yield "gap", bad, len(data), why


SCHEMA = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("gap", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
DDL = "archive string, start long, stop long, gap string, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                path, rows, size = path.as_py(), [], 0
                for kind, start, stop, x in salvage(content.as_py()):
                    row = dict.fromkeys(SCHEMA.names) | {"archive": path, "start": start, "stop": stop}
                    if kind == "gap":
                        row["gap"] = x
                    else:
                        f, payload = x["fields"], x["payload"]
                        digest = (f.get("warc-payload-digest") or "").rpartition(":")[2].lower() or None
                        if payload is not None:
                            digest, size = hashlib.sha256(payload).hexdigest(), size + len(payload)
                        row |= {"record_id": _bare(f["warc-record-id"]), "record_type": f["warc-type"], "target_uri": f.get("warc-target-uri"), "refers_to": _bare(f.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": x["length"], "payload": payload if with_payload else None}
                    rows.append(row)
                    if len(rows) >= 1000 or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return run


def read_archives(files: DataFrame, *, payload: bool = True) -> DataFrame:
    """:func:`read_warc` of archives that are rows: ``path`` (string) and ``content`` (binary); a null content has no rows."""
    return files.select("path", F.coalesce("content", F.lit(b"")).alias("content")).mapInArrow(_reader(payload), DDL)


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """A row for each record of the archives under ``path``, and one, with ``gap`` set to the reason, for each quarantined stretch.

    ``payload_digest`` is the SHA-256 of the payload; a revisit's is the one that it states, ``payload_bytes`` likewise.
    Empty files have no rows.  A file is read whole; Spark refuses one of more than 2 GB with an error.
    """
    return read_archives(spark.read.format("binaryFile").load(path), payload=payload)


def page_id(uri: Column) -> Column:
    """The page id in a record id that :func:`records` wrote; null if there is none."""
    return F.nullif(F.regexp_extract(uri, f"^{ID_PREFIX}(-?\\d*)$", 1), F.lit("")).cast("long")
