"""Benchmark decontamination: passages of a benchmark found in training documents by FM-indexes of their shards.

A task cuts its documents, in the order in which they come, into shards of about ``SHARD_BYTES`` of text.  A shard's words are numbered
by their bytes, and an FM-index is built over them; the benchmark's windows are searched backwards through the ranks of
its wavelet tree, what occurs is located by sampled suffix positions, and occurrences that touch or overlap become one removal
span.  Documents don't move: no row is shuffled, a lost task is done again from its input alone, and copies of a document
are documents like others.  A shard with one very long document is indexed in stretches of ``STRETCH`` words that overlap by
what a window may straddle.

What is broadcast is a block of the benchmark: words numbered, four bytes a word, in items of at most ``MOST_WORDS`` words
together (an item is cut into stretches if it alone has more).  A larger benchmark takes several blocks, one after another
on the same rows, each adding to what the one before found.

Words are runs of digits, ASCII letters (in any case) and all that isn't ASCII.  A window is ``size`` consecutive words of an
item; an item of fewer words is one window.  Null and empty texts, and texts without words, have no words and no hits; items
without words have no windows.  Items that share an id are one item in ``items``, null ids are left out of ``items`` but their
windows hit.  Repeated rows each get their row; an empty table gives an empty one; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import written
from corpusmill.llm.fm_index import FmIndex

SIZE = 10
SHARD_BYTES, STRETCH = 6 << 20, 1 << 20
MOST_WORDS = 2_000_000

#: What a byte stands for: 0 between words, else itself in lower case.
LETTER = np.arange(256, dtype=np.uint8)
LETTER[0x41:0x5B] += 0x20
LETTER[np.r_[0x00:0x30, 0x3A:0x41, 0x5B:0x61, 0x7B:0x80]] = 0


class Words(NamedTuple):
    """Words of texts that stand one after another: ``ids`` into ``known``, where each begins and ends, and how many each text has."""

    ids: np.ndarray
    known: pa.Array
    begins: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    data = b"\n".join(texts) + b"\n"
    raw = LETTER[np.frombuffer(data, dtype=np.uint8)]
    inside = raw != 0
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    begins, ends = edge[::2], edge[1::2]
    sizes = ends - begins
    if sizes.sum() >= 2**31:
        raise ValueError("a shard of 2 GB of words")
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    after = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    upto = np.searchsorted(begins, after)
    return Words(coded.indices.to_numpy().astype(np.int64), coded.dictionary, begins, ends, np.diff(upto, prepend=0))


class Benchmark(NamedTuple):
    """A block of items: ``words`` as numbers into ``known``, windows as (first word, length), and each window's items (numbers into ``items``)."""

    known: pa.Array
    words: np.ndarray
    first: np.ndarray
    length: np.ndarray
    items: list[str]
    owner_first: np.ndarray
    owners: np.ndarray


def benchmark_of(rows: list[tuple[str | None, bytes]], size: int) -> Benchmark:
    """Distinct windows of the items (id, text)."""
    found = words_of([text for _, text in rows])
    names = sorted({name for name, _ in rows if name is not None})
    number = {name: i for i, name in enumerate(names)}
    begin = np.cumsum(found.counts) - found.counts
    windows = np.where(found.counts == 0, 0, np.maximum(found.counts - size + 1, 1))
    row = np.repeat(np.arange(len(rows)), windows)
    first = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    length = np.minimum(found.counts, size)[row]
    owner = np.array([number.get(name, -1) for name, _ in rows], dtype=np.int64)[row]
    padded = np.concatenate([found.ids, np.zeros(size, dtype=np.int64)])
    table = padded[first[:, None] + np.arange(size)] if len(first) else np.zeros((0, size), dtype=np.int64)
    table[np.arange(size) >= length[:, None]] = -1
    _, one, of = np.unique(table, axis=0, return_index=True, return_inverse=True)
    of = of.reshape(-1)
    pairs = np.unique(np.stack([of, owner], axis=1)[owner >= 0], axis=0)
    return Benchmark(found.known, found.ids.astype(np.int32), first[one].astype(np.int32), length[one].astype(np.int32), names, np.searchsorted(pairs[:, 0], np.arange(len(one) + 1)), pairs[:, 1])


def _numbers(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of range(first, first + count), one after another."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _occurrences(symbols: np.ndarray, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position) of everything of ``phrases`` in ``symbols``, through an index of each stretch of them."""
    which, where = [], []
    widest, n_symbols = phrases.shape[1], int(symbols.max()) + 1
    for at in range(0, max(1, len(symbols) - widest), STRETCH):
        part = symbols[at : at + STRETCH + widest]
        index = FmIndex(part if part[-1] == 0 else np.append(part, 0), n_symbols)
        found, low, high = index.search(phrases, lengths)
        suffix = _numbers(low, high - low)
        where.append(index.locate(suffix) + at)
        which.append(np.repeat(found, high - low))
    return np.concatenate(which), np.concatenate(where)


def _search(texts: list[bytes], bench: Benchmark, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Words]:
    """Hit words of a shard (a flag each, all texts one after another), and the (text, item) pairs that occur."""
    words = words_of(texts)
    hit = np.zeros(len(words.ids) + 1, dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    if not len(words.ids) or not len(bench.first):
        return hit[:-1] > 0, none, none, words.counts, words
    # a 0 ends each text
    end = np.cumsum(words.counts + 1) - 1
    symbols = np.zeros(len(words.ids) + len(texts), dtype=np.int64)
    place = np.arange(len(words.ids)) + np.repeat(np.arange(len(texts)), words.counts)
    symbols[place] = words.ids + 1
    # windows with a word that the shard lacks can't occur
    here = pc.index_in(bench.known, value_set=words.known).fill_null(-1).to_numpy().astype(np.int64) + 1
    as_here = here[bench.words]
    missing = np.concatenate([[0], np.cumsum(as_here == 0)])
    possible = np.flatnonzero(missing[bench.first + bench.length] == missing[bench.first])
    padded = np.concatenate([as_here, np.zeros(size, dtype=np.int64)])
    phrases = padded[bench.first[possible][:, None] + np.arange(size)]
    which, where = _occurrences(symbols, phrases, bench.length[possible].astype(np.int64)) if len(possible) else (none, none)
    text = np.searchsorted(end, where)
    window = possible[which]
    at = where - text
    np.add.at(hit, at, 1)
    np.add.at(hit, at + bench.length[window], -1)
    pair = np.unique(text * len(bench.first) + window)
    text, window = np.divmod(pair, len(bench.first))
    owners = bench.owner_first[window + 1] - bench.owner_first[window]
    item = bench.owners[_numbers(bench.owner_first[window], owners)]
    pair = np.unique(np.repeat(text, owners) * max(1, len(bench.items)) + item)
    text, item = np.divmod(pair, max(1, len(bench.items)))
    return np.cumsum(hit)[:-1] > 0, text, item, words.counts, words


def _spans(hit: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, up to) of the runs of hit words, which end where a text does."""
    text = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    new = np.append(True, text[1:] != text[:-1]) if len(text) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(hit & (new | ~np.append(False, hit[:-1])))
    last = np.flatnonzero(hit & np.append(new[1:] | ~hit[1:], True))
    return text[first], first - begin[text[first]], last + 1 - begin[text[first]]


FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>, clean string"


def _finder(shared, size: int, before: bool, clean: bool, shard_bytes: int):
    def shard(held: list[tuple], bench: Benchmark) -> pa.RecordBatch:
        texts = [text or b"" for _, text, *_ in held]
        hit, of, item, counts, words = _search(texts, bench, size)
        begin = np.cumsum(counts) - counts
        items: list[list[str]] = [[] for _ in held]
        for i, name in zip(of.tolist(), item.tolist(), strict=True):
            items[i].append(bench.items[name])
        if before:  # what earlier blocks of the benchmark found
            for i, (_, _, spans, found) in enumerate(held):
                for span in spans:
                    hit[begin[i] + span["start"] : begin[i] + span["end"]] = True
                items[i] = sorted({*items[i], *found})
        spans: list[list[dict]] = [[] for _ in held]
        for i, s, e in zip(*(x.tolist() for x in _spans(hit, counts)), strict=True):
            spans[i].append({"start": s, "end": e})
        rest = [None] * len(held)
        if clean:
            offset = np.cumsum([0, *[len(t) + 1 for t in texts]])
            for i, text in enumerate(texts):
                if held[i][1] is not None:
                    at, parts = 0, []
                    for span in spans[i]:
                        parts.append(text[at : words.begins[begin[i] + span["start"]] - offset[i]])
                        at = words.ends[begin[i] + span["end"] - 1] - offset[i]
                    rest[i] = b"".join([*parts, text[at:]]).decode("utf-8", "replace")
        columns = {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "items": pa.array(items, pa.list_(pa.string())), "clean": pa.array(rest, pa.string())}
        rows = pa.Table.from_batches([row for row, *_ in held]).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_pydict({"id": rows.column("id"), "text": rows.column("text"), **columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        held, n_bytes = [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            own = batch.select(["id", "text"])
            spans, items = (batch.column("spans"), batch.column("items")) if before else (None, None)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for i in range(batch.num_rows):
                if held and n_bytes + sizes[i] > shard_bytes:
                    yield shard(held, bench)
                    held, n_bytes = [], 0
                held.append((own.slice(i, 1), texts[i].as_py(), *((spans[i].as_py(), items[i].as_py()) if before else ())))
                n_bytes += sizes[i] + 1
        if held:
            yield shard(held, bench)

    return run


def word_array(text: Column) -> Column:
    """The words of a text, in lower case, as an array."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)


def _blocks(items: DataFrame, id_col: str, text_col: str, size: int, most: int) -> tuple[DataFrame, int]:
    """The items' words as texts ``(block, id, text)`` with at most about ``most`` words a block, and the number of blocks."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), word_array(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    # longer items are cut into stretches that overlap by what a window may straddle
    step = max(1, most // 4)
    cuts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)), F.lit(step))
    pieces = rows.select("id", F.explode(F.transform(cuts, lambda at: F.slice("w", at, step + size - 1))).alias("w"))
    pieces = written(pieces.select("id", F.size("w").alias("n"), F.array_join("w", " ").alias("text")), "benchmark")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-2 * total // most)) if total > most else 1
    return pieces.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")), blocks


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", *, size: int = SIZE, clean: bool = True, most_words: int = MOST_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``id, text, n_words, spans, items, clean`` of every row of ``docs``.

    ``spans``: the removal spans, [start, end) in words, in order and apart; ``items``: ids (strings, sorted) of the items with a window
    in the text; ``clean`` (null if not asked for): the text without its spans, from the first byte of a span's first word to the last of
    its last.
    """
    pieces, blocks = _blocks(items, item_id, item_text, size, most_words)
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], rows.schema["text"], *T._parse_datatype_string(FOUND)])
    for block in range(blocks):
        held = pieces.filter(F.col("block") == block).select("id", F.encode("text", "UTF-8").alias("text")).collect()  # at most about most_words words
        shared = context.broadcast(benchmark_of([(r["id"], bytes(r["text"])) for r in held], size))
        rows = rows.mapInArrow(_finder(shared, size, block > 0, clean and block == blocks - 1, shard_bytes), schema)
    return rows


def n_hit() -> Column:
    """Words inside a removal span."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
