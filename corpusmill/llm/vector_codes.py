"""Vector code compression: each of the parts of a vector becomes the number of its nearest codebook entry.

Components become integers, so distances, ties and means are exact and every run gives the same codes.  A codebook is learnt in
rounds (assign all, then move every entry to the mean of what it got), each one scan of the integer vectors, which are written once:
a task returns one row of counts and sums an entry, these are added up by entry, and only the new codebooks (entries times
dimensions, whatever the number of vectors) pass through the driver to the next round's broadcast.

The nearest entry is found by partial distances.  The dimensions of a part are taken in descending variance of the codebook.
The first few give every entry a partial distance; the entry with the least is completed and is the first best complete
distance.  From then on each dimension is added only to the pairs of vector and entry that are left, and a mask drops those
whose sum is strictly above the best, which is lowered as chunks of entries complete.  Entries that tie with the best are
never dropped, so the lowest index among equals is exact.

Vectors take part as in ``whitening``: not null, without null or non-finite components, of the usual length; others have no row.
A length that the number of parts doesn't divide is padded with zeros.  Fewer vectors than entries give a smaller codebook.
Rows that share an id are ordered by their vectors where the first entries are taken, null ids come last.  Integers end at
2**25 in either direction, so no distance leaves a long.  ``label_error`` beyond a long is null.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import written
from corpusmill.llm.whitening import usable

SCALE, LIMIT = 1024.0, float(2**25)
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors taken together; dimensions that every entry gets before the first best distance is known; entries completed together.
ROWS, FIRST, CHUNK = 1024, 4, 64
#: The most labels whose sums are broadcast; more are joined in a shuffle, each label in so many slices.
MOST_LABELS, SLICES = 100_000, 32


def _entry(c: Column) -> Column:
    return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c.cast("double") * SCALE).cast("double"))).cast("long")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` (n, d), the index of its nearest entry in ``book`` (k, d), the lowest among equals, and its squared distance."""
    dims = np.argsort(-book.astype(np.float64).var(0), kind="stable")
    x, book = np.ascontiguousarray(x[:, dims]), np.ascontiguousarray(book[:, dims])
    n, d, k = len(x), x.shape[1], len(book)
    rows = np.arange(n)
    partial = np.zeros((n, k), dtype=np.int64)
    for j in range(min(FIRST, d)):
        partial += np.square(x[:, j, None] - book[None, :, j])
    guess = partial.argmin(1)
    best = partial[rows, guess] + np.square(x[:, FIRST:] - book[guess, FIRST:]).sum(1)
    where = guess.copy()
    for first in range(0, k, CHUNK):
        left = partial[:, first : first + CHUNK] <= best[:, None]  # entries already above the best complete distance are dropped
        row, entry = np.nonzero(left)
        so_far = partial[row, entry + first]
        entry = entry + first
        for j in range(FIRST, d):
            so_far = so_far + np.square(x[row, j] - book[entry, j])
            left = so_far <= best[row]
            if not left.all():
                row, entry, so_far = row[left], entry[left], so_far[left]
        # complete distances: the least of each row, then the lowest entry that has it
        lowest = best.copy()
        np.minimum.at(lowest, row, so_far)
        tied = so_far == lowest[row]
        better = np.where(lowest < best, k, where)
        np.minimum.at(better, row[tied], entry[tied])
        best, where = lowest, better
    return where, best


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _assigner(books, parts: int):
    """Per vector: its codes and its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column("x"))
                found = [nearest(p, b) for p, b in zip(np.split(x, parts, axis=1), books.value, strict=True)]
                codes = ["".join(f"{c:02x}" for c in row) for row in np.stack([c for c, _ in found], axis=1).tolist()]
                error = np.sum([e for _, e in found], axis=0)
                kept = [part.column(i) for i, name in enumerate(part.schema.names) if name != "x"]
                names = [name for name in part.schema.names if name != "x"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=[*names, "code", "error"])

    return run


def _adder(books, parts: int):
    """Per task: counts and sums of what each entry got."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(b) for b in books.value]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books.value]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column("x").slice(at, ROWS))
                for p, (piece, book) in enumerate(zip(np.split(x, parts, axis=1), books.value, strict=True)):
                    code, _ = nearest(piece, book)
                    np.add.at(sums[p], code, piece)
                    counts[p] += np.bincount(code, minlength=len(book))
        for p in range(parts):
            used = np.flatnonzero(counts[p])
            got = pa.array(list(sums[p][used]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, dtype=np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[p][used]), got], names=["part", "entry", "n", "sums"])

    return run


def train(x: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook (entries, dimensions of the part) for each part, from ``x`` (id, x: array<long>, of one length that ``parts`` divides).

    They start as the parts of the ``entries`` smallest ids.  An entry that gets nothing stays.
    """
    start = np.array([r["x"] for r in x.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()], dtype=np.int64)
    if not start.size:
        return []
    books = np.split(start, parts, axis=1)
    width = books[0].shape[1]
    context = x.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(books)
        got = x.select("x").mapInArrow(_adder(shared, parts), "part int, entry int, n long, sums array<long>")
        # sums of sums may leave a long at any size of table, so they are decimals
        total = got.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)])
        books = [b.copy() for b in books]
        for r in total.collect():  # at most one row an entry
            books[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        shared.unpersist()
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(x: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``x`` without its vectors, with ``code`` (two hex digits a part) and ``error`` (squared distances summed over parts)."""
    schema = T.StructType([f for f in x.schema if f.name != "x"] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books:
        return x.sparkSession.createDataFrame([], schema)
    return x.mapInArrow(_assigner(x.sparkSession.sparkContext.broadcast(books), len(books)), schema)


def _with_label_errors(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    sums = written(sums, "label-errors")
    key = F.col("label").eqNullSafe(F.col("of_label"))
    if sums.count() <= MOST_LABELS:
        sums = sums.withColumnRenamed("label", "of_label")
        return rows.join(F.broadcast(sums), key).drop("of_label")
    sums = sums.select(F.col("label").alias("of_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("of_slice"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("code", "error"), F.lit(SLICES)).cast("int"))
    return rows.join(sums, key & (F.col("slice") == F.col("of_slice"))).drop("of_label", "of_slice", "slice")


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of ``df``'s vectors (``id, label, code, error, label_error``) and the codebooks; ``entries`` of at most 256."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    x = usable(df, id_col, vector, _entry, [F.col(label).alias("label")])
    pad = F.array_repeat(F.lit(0).cast("long"), F.pmod(-F.size("x"), F.lit(parts)))
    x = written(x.withColumn("x", F.concat("x", pad)), "vectors")
    books = train(x, parts, entries, rounds)
    rows = written(encode(x, books), "codes")
    return _with_label_errors(rows), books
