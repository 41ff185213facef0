"""Byte-level BPE on length-bucketed padded numpy matrices.

A text is split by the vocabulary's pattern; every distinct match of a batch is one row of a matrix of token
ids, in a bucket of rows of like length.  In each round every row merges its leftmost pair of least rank (the
rank of the joined bytes), found in a hashed pair table; rows that have no pair left leave the matrix, and the
cells right of a merge move up.  Only the two pairs beside a merge are looked up again.  Rows of more than
``LONGEST`` bytes would take quadratic time in a matrix; they are merged by the same rule with a heap.

Memory: a batch of texts, the pair table (the vocabulary's size), and a bounded store of known matches.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import kept_on_worker

NONE = np.int32(2**31 - 1)
LONGEST = 512


class PairTable:
    """(left id, right id) to the rank of the joined bytes: open addressing over flat arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        self.bits = max(4, (len(pairs) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        keys, values = np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int32)
        slots, self.probes = self._slots(keys), 1
        while len(keys):
            free = self.keys[slots] == -1
            _, first = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            take = first[free[first]]
            self.keys[slots[take]], self.values[slots[take]] = keys[take], values[take]
            rest = np.ones(len(keys), dtype=bool)
            rest[take] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & (len(self.keys) - 1)
            self.probes += bool(len(keys))
        self.pairs = pairs

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is no such token or an id is negative (padding)."""
        shape = left.shape
        keys = ((left.astype(np.int64) << 32) | right).ravel()
        out = np.full(len(keys), NONE, dtype=np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self._slots(keys[todo])
        for _ in range(self.probes):
            found = self.keys[slots]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slots[hit]]
            go = ~hit & (found != -1)
            if not go.any():
                break
            todo, slots = todo[go], (slots[go] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The content of a rank file: a token in base 64 and its rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


class ByteBPE:
    """Encoder and decoder of one vocabulary; keeps at most ``LIMIT`` known matches."""

    LIMIT = 400_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.table = ranks, PairTable(ranks)
        # White space as the Unicode property: Python's own class also has U+001C to U+001F.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.tokens = {i: t for t, i in ranks.items()}
        self.known: dict[str, bytes] = {}

    def merge_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """The ids of byte strings of at most ``LONGEST`` bytes each."""
        out: list = [None] * len(rows)
        lengths = np.array([len(r) for r in rows])
        width = np.where(lengths <= 16, lengths, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for w in np.unique(width):
            bucket = np.flatnonzero(width == w)
            step = max(1, 400_000 // int(w))
            for at in range(0, len(bucket), step):
                self._merge_matrix([rows[i] for i in bucket[at : at + step]], bucket[at : at + step], int(w), out)
        return out

    def _merge_matrix(self, rows: list[bytes], index: np.ndarray, width: int, out: list) -> None:
        ids = np.full((len(rows), width + 1), -1, dtype=np.int32)  # one column of padding at least
        flat = self.byte_ids[np.frombuffer(b"".join(rows), dtype=np.uint8)]
        left = np.array([len(r) for r in rows])
        ids[:, :width][np.arange(width) < left[:, None]] = flat
        ranks = np.full((len(rows), width + 1), NONE, dtype=np.int32)
        ranks[:, :-1] = self.table.ranks(ids[:, :-1], ids[:, 1:])
        column = np.arange(width + 1)
        while len(index):
            pos = ranks.argmin(axis=1)
            row = np.arange(len(index))
            best = ranks[row, pos]
            done = best == NONE
            if done.any():
                for i, r in zip(index[done].tolist(), np.flatnonzero(done).tolist(), strict=True):
                    out[i] = ids[r, : left[r]].copy()
                go = ~done
                index, ids, ranks, left, pos, best = index[go], ids[go], ranks[go], left[go], pos[go], best[go]
                row = row[: len(index)]
                if not len(index):
                    break
            ids[row, pos] = best
            after = column[:-1] > pos[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            left -= 1
            ranks[row, pos] = self.table.ranks(ids[row, pos], ids[row, np.minimum(pos + 1, width)])
            some = pos > 0
            before = pos[some] - 1
            ranks[row[some], before] = self.table.ranks(ids[row[some], before], ids[row[some], pos[some]])
            most = int(left.max())
            if most + 1 < ids.shape[1]:  # compaction of the columns that all rows have left
                ids, ranks, column, width = ids[:, : most + 1].copy(), ranks[:, : most + 1].copy(), column[: most + 1], most

    def merge_long(self, data: bytes) -> np.ndarray:
        """The same merges in the same order with a heap of (rank, place) and a linked list."""
        ids = self.byte_ids[np.frombuffer(data, dtype=np.uint8)].tolist()
        n, pairs = len(ids), self.table.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := pairs.get((rank << 32) | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if (p := before[i]) >= 0 and (r := pairs.get((ids[p] << 32) | rank)) is not None:
                heapq.heappush(heap, (r, p, ids[p], rank))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that aren't known yet."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.LIMIT:
            self.known.clear()
            new = list(pieces)
        data = [p.encode("utf-8", "replace") for p in new]
        short = [i for i, d in enumerate(data) if len(d) <= LONGEST]
        for i, ids in zip(short, self.merge_rows([data[i] for i in short]), strict=True):
            self.known[new[i]] = ids.astype("<u4").tobytes()
        for p, d in zip(new, data, strict=True):
            if len(d) > LONGEST:
                self.known[p] = self.merge_long(d).astype("<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= 2 << 20):
                size += len(texts[end])
                end += 1
            if size > 4 << 20:  # one very long text: its matches in parts
                found, parts = self.pattern.finditer(texts[at]), []
                while some := [m[0] for m in itertools.islice(found, 500_000)]:
                    self.learn(set(some))
                    parts.append(b"".join(map(self.known.__getitem__, some)))
                out.append(b"".join(parts))
            else:
                split = [self.pattern.findall(t) for t in texts[at:end]]
                self.learn(set(itertools.chain.from_iterable(split)))
                out += [b"".join(map(self.known.__getitem__, s)) for s in split]
            at = end
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; an id that isn't in the vocabulary is an error."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _mapper(data: bytes, pattern: str, column: str, name: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_on_worker(("byte bpe", hashlib.sha256(data + pattern.encode()).digest()), lambda: ByteBPE(read_ranks(data), pattern))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                values = part.column(column).to_pylist()
                made = [bpe.decode(v or b"") for v in values] if decode else bpe.encode_batch([v or "" for v in values])
                yield part.append_column(name, pa.array(made, pa.binary()))

    return run


def encode(df: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col``: the ids of the whole text, little-endian unsigned 32-bit integers; null text: none.

    ``ranks``: the bytes of a rank file (one vocabulary, of fixed size, sent with the task).  Special tokens'
    strings are ordinary text.  A column of ``df`` named ``ids_col`` is replaced.
    """
    df = df.drop(ids_col)
    schema = T.StructType([*df.schema, T.StructField(ids_col, T.BinaryType())])
    return df.mapInArrow(_mapper(ranks, pattern, text_col, ids_col, False), schema)


def decode(df: DataFrame, ranks: bytes, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``: the bytes that ``ids_col`` stands for; null: none.  Replaces a column of that name."""
    df = df.drop(out_col)
    schema = T.StructType([*df.schema, T.StructField(out_col, T.BinaryType())])
    return df.mapInArrow(_mapper(ranks, pattern, ids_col, out_col, True), schema)


def n_tokens(ids_col: str = "ids"):
    """Column: the number of ids."""
    return (F.length(ids_col) / 4).cast("long")
