"""Packing of token sequences: bounded-space online best fit, then a merge of what is left open.

Each partition keeps at most ``open_windows`` open windows of ``size`` tokens.  A document is cut only where it
is longer than a window: full windows leave at once, the rest goes to the open window that it fits best
(least room left).  If it fits none and all windows are open, the fullest is emitted with its padding.
What stays open at the end of a partition is written with its ids; groups of such windows, from many partitions,
are then laid end to end and cut at ``size``, so one window a group is padded.

Memory: the open windows, and one batch of texts.  The merge takes groups of ``merge_windows`` windows, by
a hash, so it spreads over the cluster however many partitions there were.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import kept_on_worker, written

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("is_open", pa.bool_()), ("ids", pa.binary())])
DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, is_open boolean, ids binary"
MERGED = 1 << 61


class WordTokens:
    """Ids of whole texts, word by word: the vocabulary's splitting rule never joins across ASCII white space.

    Words of a batch are hashed together (64-bit polynomial sums over the bytes), and each distinct one that isn't
    known yet is given to the tokenizer once.  The hash only finds a word: every occurrence is compared, byte for
    byte, with the known word that it leads to, and one that differs is looked up by its bytes.  At most
    ``LIMIT`` words of ``LETTERS`` bytes in all are known before a batch.

    The strings of the vocabulary's added tokens, as they stand in a text, are their ids, as in the library by default; what
    is before and after one is encoded by itself.
    """

    LIMIT, LETTERS, PART = 2_000_000, 64 << 20, 1 << 20

    def __init__(self, tokenizer: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_buffer(tokenizer)
        self.tokenizer.encode_special_tokens = True  # of single words, which hold no added token
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that depend on what is around them aren't supported")
        self.added = {t.content.encode(): np.array([i], dtype="<u4") for i, t in added.items()}
        self.mark = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + b")") if added else None
        rng = np.random.Generator(np.random.PCG64(11))
        self.values = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(0, 2**62)) * 4 + 3
        self.base, self.inverse = np.uint64(base % 2**64), np.uint64(pow(base, -1, 2**64))
        self.space = np.zeros(256, dtype=bool)
        self.space[list(b" \t\n\r\x0b\x0c")] = True
        self.kind = np.zeros(256, dtype=np.uint8)  # 1: ASCII letters, 2: ASCII signs but the apostrophe
        self.kind[[i for i in range(128) if chr(i).isalpha()]] = 1
        self.kind[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = 2
        self.up = self.down = np.ones(1, dtype=np.uint64)
        self.forget()

    def forget(self) -> None:
        self.keys, self.starts, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.used = np.empty(1 << 16, dtype="<u4"), 0
        self.letters, self.begins, self.lengths = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
        self.others: dict[bytes, tuple[int, int]] = {}  # words whose hash is another's

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words in lower-case bytes; a word also ends between an ASCII letter and sign."""
        if len(self.up) < len(data) + 1:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), self.base)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), self.inverse)]), dtype=np.uint64)
        gap, kind = np.concatenate([[True], self.space[data], [True]]), self.kind[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = kind[1:] + kind[:-1] == 3
        starts, ends = np.flatnonzero((gap[:-1] | cut) & ~gap[1:]), np.flatnonzero(~gap[:-1] & (gap[1:] | cut))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[data] * self.up[: len(data)], dtype=np.uint64)])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(32)
        return starts, ends, h * np.uint64(0xD6E8FEB86659FD93) + (ends - starts).astype(np.uint64)

    def learn(self, words: list[bytes], keys: np.ndarray) -> None:
        """Encodes new words in long strings; a token's place in the string tells its word."""
        found, counts = [], []
        for at in range(0, len(words), 4000):
            part = [w.decode("utf-8", "replace") for w in words[at : at + 4000]]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.cumsum([0] + [len(w) + 1 for w in part[:-1]])
            where = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            found.append(np.array(e.ids, dtype="<u4"))
            counts.append(np.bincount(np.searchsorted(begins, where, "right") - 1, minlength=len(part)))
        new, counts = np.concatenate(found), np.concatenate(counts)
        starts = self.hold(new) + np.cumsum(counts) - counts
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        begins = len(self.letters) + np.cumsum(lengths) - lengths
        self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(words), dtype=np.uint8)])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.starts, self.counts, self.begins, self.lengths = (
            np.insert(old, at, x[order]) for old, x in ((self.keys, keys), (self.starts, starts), (self.counts, counts), (self.begins, begins), (self.lengths, lengths))
        )

    def hold(self, new: np.ndarray) -> int:
        """Stores ids; returns where they begin."""
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), dtype="<u4")])
        self.ids[self.used : self.used + len(new)] = new
        self.used += len(new)
        return self.used - len(new)

    def other(self, word: bytes) -> tuple[int, int]:
        """Place and number of the ids of a word that shares its hash with a known one."""
        if word not in self.others:
            ids = np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4")
            self.others[word] = self.hold(ids), len(ids)
        return self.others[word]

    def unlike(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Which words of ``data`` aren't, byte for byte, the known words in their slots."""
        n = np.minimum(ends - starts, self.lengths[slot])
        after = np.cumsum(n)
        place = np.arange(after[-1])
        differs = data[place + np.repeat(starts - after + n, n)] != self.letters[place + np.repeat(self.begins[slot] - after + n, n)]
        wrong = ends - starts != self.lengths[slot]
        if differs.any():
            wrong |= np.logical_or.reduceat(differs, after - n)
        return np.flatnonzero(wrong)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.mark is None or not any(map(self.mark.search, texts)):
            return self.encode_words(texts)
        cut = [self.mark.split(t) for t in texts]  # words and added tokens by turns
        found = iter(self.encode_words([w for parts in cut for w in parts[::2]]))
        return [np.concatenate([self.added[w] if i % 2 else next(found) for i, w in enumerate(parts)]) for parts in cut]

    def encode_words(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, in which added tokens' strings are words like others."""
        joined = b" ".join(texts).lower()
        data = np.frombuffer(joined, dtype=np.uint8)
        starts, ends, hashes = self.words(data)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(self.others) + len(keys) > self.LIMIT or len(self.letters) > self.LETTERS:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = first[~known]
            self.learn([joined[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], keys[~known])
            at = np.searchsorted(self.keys, keys)
        if not len(keys):
            return [np.empty(0, dtype="<u4") for _ in texts]
        slot = at[which]
        begins, counts = self.starts[slot], self.counts[slot]
        for i in self.unlike(data, starts, ends, slot).tolist():
            begins[i], counts[i] = self.other(joined[starts[i] : ends[i]])
        after = np.cumsum(counts)
        ids = self.ids[np.repeat(begins - after + counts, counts) + np.arange(after[-1])]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.concatenate([[0], after])[np.searchsorted(starts, text_ends, "left")]
        return [ids[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def encode_long(self, text: bytes) -> np.ndarray:
        """The ids of one very long text, part by part; parts end at white space (a longer word stays whole)."""
        found, at = [], 0
        while at < len(text):
            end = min(len(text), at + self.PART)
            while end < len(text) and not self.space[text[end]]:
                end += 1
            found += self.encode([text[at:end]])
            at = end
        return np.concatenate(found) if found else np.empty(0, dtype="<u4")


class Windows:
    """At most ``most`` open windows of ``size`` tokens, best fit; pieces are (doc, start, length, tokens, ids)."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.rooms: list[tuple[int, int]] = []  # (room, window), sorted
        self.held: dict[int, list[tuple]] = {}
        self.last = -1

    def full(self, piece: tuple) -> list[tuple]:
        self.last += 1
        return [(self.last, 0, piece)]

    def add(self, piece: tuple) -> list[tuple]:
        """Puts a piece shorter than a window; returns the pieces of windows that are emitted, as (window, offset, piece)."""
        out, length = [], piece[2]
        at = bisect.bisect_left(self.rooms, (length, -1))
        if at == len(self.rooms):
            if len(self.rooms) == self.most:
                out = self.emit(self.rooms.pop(0)[1])
            self.last += 1
            room, window = self.size, self.last
            self.held[window] = []
        else:
            room, window = self.rooms.pop(at)
        self.held[window].append((window, self.size - room, piece))
        if room == length:
            return out + self.emit(window)
        bisect.insort(self.rooms, (room - length, window))
        return out

    def emit(self, window: int) -> list[tuple]:
        return self.held.pop(window)

    def left(self) -> list[tuple]:
        return [x for _, w in self.rooms for x in self.held[w]]


def _rows(placed: list[tuple], base: int, is_open: bool) -> pa.RecordBatch:
    cols: list[list] = [[], [], [], [], [], [], [], []]
    for window, offset, (doc, start, length, tokens, ids) in placed:
        for c, v in zip(cols, (doc, start, length, tokens, base + window, offset, is_open, ids), strict=True):
            c.append(v)
    return pa.RecordBatch.from_pydict(dict(zip(SCHEMA.names, cols, strict=True)), schema=SCHEMA)


def _packer(tokenizer: bytes, end_id: int, size: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_on_worker(("word tokens", hashlib.sha256(tokenizer).digest()), lambda: WordTokens(tokenizer))
        end = np.array([end_id], dtype="<u4")
        windows, base = Windows(size, open_windows), TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts: list[bytes] = []
                total = 0
                while at + len(texts) < batch.num_rows and (not texts or total < words.PART):
                    texts.append((batch.column(1)[at + len(texts)].as_py() or "").encode("utf-8", "replace"))
                    total += len(texts[-1])
                found = words.encode(texts) if total < 2 * words.PART else [words.encode_long(t) for t in texts]
                placed: list[tuple] = []
                for i, ids in enumerate(found):
                    doc, n = batch.column(0)[at + i].as_py(), len(ids) + 1
                    ids = np.concatenate([ids, end]).tobytes()
                    cut = n // size * size
                    for s in range(0, cut, size):
                        placed += windows.full((doc, s, size, n, ids[4 * s : 4 * (s + size)]))
                    if n > cut:
                        placed += windows.add((doc, cut, n - cut, n, ids[4 * cut :]))
                at += len(texts)
                for s in range(0, len(placed), 2000):
                    yield _rows(placed[s : s + 2000], base, False)
        yield _rows(windows.left(), base, True)

    return run


def _merger(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, window, used = None, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["grp"] != group:
                    group, window, used = row["grp"], 0, 0
                start, ids = row["start"], row["ids"]
                while ids:
                    n = min(size - used, len(ids) // 4)
                    out.append((group, (window, used, (row["doc_id"], start, n, row["doc_tokens"], ids[: 4 * n]))))
                    start, ids, used = start + n, ids[4 * n :], used + n
                    if used == size:
                        window, used = window + 1, 0
            for g, part in itertools.groupby(out, key=lambda x: x[0]):
                yield _rows([x[1] for x in part], MERGED + (g << 32), False)

    return run


def pack(docs: DataFrame, tokenizer: bytes, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, size: int = 4096, open_windows: int = 64, merge_windows: int = 512) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens.

    ``tokenizer``: the bytes of a ``tokenizers`` file (one vocabulary, of fixed size, sent with the task).
    Returns ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (little-endian 32-bit integers); each
    id of a document, ``end_id`` included, is in exactly one piece.  A null or empty text is one piece of
    ``end_id``.  Repeated ids and rows are packed as often as they occur.  Other columns are not read.
    The input must be read again the same way if a task is lost (files, or a checkpoint).
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = written(base.mapInArrow(_packer(tokenizer, end_id, size, open_windows), DDL), "packed")
    left = first.filter("is_open")
    n_groups = max(1, -(-left.select("sequence_id").distinct().count() // merge_windows))
    dealt = left.withColumn("grp", F.pmod(F.xxhash64("sequence_id"), F.lit(n_groups)).cast("int"))
    dealt = dealt.repartition(n_groups, "grp").sortWithinPartitions("grp", "sequence_id", "offset")
    merged = written(dealt.mapInArrow(_merger(size), DDL), "packed-merged")
    return first.filter("not is_open").unionByName(merged).drop("is_open")
