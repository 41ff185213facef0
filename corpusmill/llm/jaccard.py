"""Jaccard join on word n-grams: MinHash bands propose, a Bayesian test prunes, exact sets decide.

Method (BayesLSH-Lite, Satuluri and Parthasarathy, 2012).  A document is the set of its 64-bit hashed
word 5-grams (fewer than five words: one gram of all words; no word: no set, and no link).  Documents with
equal sets (by 128 bits of hash) are one *class*, so copies never meet each other.

1.  Classes that share a MinHash band meet with their sketches of 128 bytes.  MinHash byte by MinHash byte, a pair is
    dropped as soon as the posterior probability (uniform prior) that its similarity reaches the threshold falls
    below the tolerance.  What a task returns is a spanning forest of the pairs that are left, and inside a task a class
    that is connected already isn't compared again.
2.  The components of these forests are small groups of like texts; a band that unlike texts share, or a chain of such
    bands, makes no group.  Only they fetch their texts.  Inside a group all pairs are pruned in the same way, block by
    block, and every pair that is left is verified on the whole sets.

Loss: with 40 bands of 6, a pair exactly at 0.8 shares no band with probability 5e-6, less above; the
Bayesian test adds less than 1e-5 at the default tolerance.  Nothing is reported below the threshold.

Scale: what is shuffled is 40 longs a class, sketches of the classes that share a band, then the sets of the documents
in groups.  Bands and groups are cut into blocks, so no task holds an unbounded one; a pair of rows never
becomes a row: tasks return link counts per class and spanning forests.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import block_pairs, components, without_documents, written
from corpusmill.llm.pairs import grouped, spread

NGRAM, THRESHOLD = 5, 0.8
BANDS, ROWS, SKETCH = 40, 6, 128
_MULT = 0x9E3779B97F4A7C15


class _WordHashes(dict):
    """Word (bytes) to 64-bit hash; forgets everything beyond ``LIMIT`` words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two xor-shift multiplications)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_set(text: str | None, n: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; words are runs without ASCII white space."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(n, len(h))
    grams = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        grams = grams * np.uint64(_MULT) + h[i : len(h) - width + 1 + i]
    return np.unique(mixed(grams))


def minima(sets: list[np.ndarray], n: int, seed: int = 1) -> np.ndarray:
    """``n`` MinHash values of each (non-empty) set."""
    rng = np.random.Generator(np.random.PCG64(seed))
    mult = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, n, dtype=np.uint64)
    out = np.empty((len(sets), n), dtype=np.uint64)
    start = 0
    while start < len(sets):
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= 60_000):
            total += len(sets[end])
            end += 1
        x = np.concatenate(sets[start:end])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[start : end - 1]], dtype=np.int64)]).astype(np.int64)
        for i in range(n):
            out[start:end, i] = np.minimum.reduceat(x * mult[i] + add[i], at)
        start = end
    return out


def least_matches(threshold: float, tolerance: float, n: int, step: int) -> list[int]:
    """Fewest matching bytes after step, 2 * step, ... comparisons for which P(similarity >= threshold) >= tolerance."""
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256  # bytes of different minima are equal by chance
    out = []
    for seen in range(step, n + 1, step):
        for m in range(seen + 1):
            like = m * np.log(p) + (seen - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() / like.sum() >= tolerance:
                break
        out.append(m)
    return out


def _signer(ngram: int, bands: int, rows: int, sketch: int):
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64()), ("fq", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [gram_set(t.as_py(), ngram, hashes) for t in part.column(2)]
                has = [i for i, s in enumerate(sets) if len(s)]
                fp: list = [None] * len(sets)
                fq: list = [None] * len(sets)
                keys: list = [None] * len(sets)
                marks: list = [None] * len(sets)
                if has:
                    low = minima([sets[i] for i in has], bands * rows)
                    joined = np.zeros((len(has), bands), dtype=np.uint64)
                    for r in range(rows):
                        joined = joined * np.uint64(_MULT) + mixed(low[:, r::rows])
                    joined = mixed(joined + np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)
                    bytes_ = mixed(low[:, :sketch]).astype(np.uint8)
                    for j, i in enumerate(has):
                        fp[i], fq[i] = struct.unpack("<qq", xxhash.xxh3_128_digest(sets[i].tobytes()))
                        keys[i], marks[i] = joined[j], bytes_[j].tobytes()
                cols = [part.column(0), part.column(1), pa.array(fp, pa.int64()), pa.array(fq, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return sign, "id long, th long, fp long, fq long, n int, keys array<long>, sketch binary"


def _adder(ngram: int):
    """Adds the gram set (as bytes) to rows whose last column is the text."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = pa.array([gram_set(t.as_py(), ngram, hashes).tobytes() for t in part.column("text")], pa.binary())
                cols = [part.column(n) for n in ("grp", "cls", "size", "n", "sketch")]
                yield pa.RecordBatch.from_arrays([*cols, sets], names=["grp", "cls", "size", "n", "sketch", "grams"])

    return add


def intersections(a: list[np.ndarray], b: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the common sets of the pairs (a[left[i]], b[right[i]]): exact, by products of 0/1 matrices if dense."""
    if len(left) <= 4 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(left.tolist(), right.tolist(), strict=True)], dtype=np.int64)
    both = [*a, *b]
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, col, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    common = count >= 2  # what one set alone has adds to no intersection
    keep = common[col]
    row, col = row[keep], (np.cumsum(common) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    width = 4096
    for c in range(0, int(common.sum()), width):
        s, e = np.searchsorted(col, [c, c + width])
        m = np.zeros((len(both), width), dtype=np.float32)
        m[row[s:e], col[s:e] - c] = 1
        total += m[: len(a)] @ m[len(a) :].T
    return np.rint(total[left, right]).astype(np.int64)


def _linker(threshold: float, tolerance: float, sketch: int, step: int = 32):
    """Spanning forests of the pairs of a band that the Bayesian test leaves; breadth first, so that each class found is compared from once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least = least_matches(threshold, tolerance, sketch, step)

    def work(t: pa.Table) -> dict[str, list]:
        cls, n = t.column("cls").to_numpy(), t.column("n").to_numpy()
        marks = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, sketch)
        open_ = np.arange(len(cls))  # not yet in a tree
        a, b = [], []
        while len(open_):
            queue, open_ = [int(open_[0])], open_[1:]
            while queue and len(open_):
                i = queue.pop()
                near = open_[np.minimum(n[open_], n[i]) >= threshold * np.maximum(n[open_], n[i]) - 1e-9]
                same = np.zeros(len(near), dtype=np.int64)
                for k, enough in enumerate(least):
                    same += (marks[near, k * step : (k + 1) * step] == marks[i, k * step : (k + 1) * step]).sum(axis=1)
                    go = same >= enough
                    near, same = near[go], same[go]
                    if not len(near):
                        break
                if len(near):
                    open_ = np.setdiff1d(open_, near, assume_unique=True)
                    queue += near.tolist()
                    a += [int(cls[i])] * len(near)
                    b += cls[near].tolist()
        return {"a": a, "b": b}

    return grouped(schema, ["key", "bi", "bj"], work), "a long, b long"


def _comparer(threshold: float, tolerance: float, sketch: int, step: int = 32):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.int64())])
    least = least_matches(threshold, tolerance, sketch, step)

    def work(t: pa.Table) -> dict[str, list]:
        block, cls, size, n = (t.column(c).to_numpy() for c in ("b", "cls", "size", "n"))
        bi, bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
        rows, cols = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        empty = {"a": [], "b": [], "w": []}
        if not len(rows) or not len(cols):
            return empty
        marks = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, sketch)
        left, right = [], []
        for at in range(0, len(rows), 128):  # bounded matrices
            sub = rows[at : at + 128]
            ok = np.minimum(n[sub][:, None], n[cols]) >= threshold * np.maximum(n[sub][:, None], n[cols]) - 1e-9
            ok &= sub[:, None] < cols if bi == bj else True
            x, y = np.nonzero(ok)
            x, y = sub[x], cols[y]
            same = np.zeros(len(x), dtype=np.int64)
            for k, enough in enumerate(least):
                same += (marks[x, k * step : (k + 1) * step] == marks[y, k * step : (k + 1) * step]).sum(axis=1)
                go = same >= enough
                x, y, same = x[go], y[go], same[go]
            left.append(x)
            right.append(y)
        x, y = np.concatenate(left), np.concatenate(right)
        if not len(x):
            return empty
        grams = [np.frombuffer(g, dtype=np.uint64) for g in t.column("grams").to_pylist()]
        row_of, col_of = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64)
        row_of[rows], col_of[cols] = np.arange(len(rows)), np.arange(len(cols))
        common = intersections([grams[i] for i in rows], [grams[i] for i in cols], row_of[x], col_of[y])
        go = common / (n[x].astype(np.int64) + n[y] - common) >= threshold
        x, y = x[go], y[go]
        weight = np.bincount(x, weights=size[y], minlength=t.num_rows) + np.bincount(y, weights=size[x], minlength=t.num_rows)
        linked = np.zeros((len(rows), len(cols)), dtype=bool)
        linked[row_of[x], col_of[y]] = True
        if bi == bj:
            linked |= linked.T
        edges = spread(t.num_rows, linked, rows, cols)
        some = np.flatnonzero(weight)
        return {"a": cls[some].tolist() + [int(cls[i]) for i, _ in edges], "b": [None] * len(some) + [int(cls[j]) for _, j in edges], "w": weight[some].astype(np.int64).tolist() + [0] * len(edges)}

    return grouped(schema, ["grp", "bi", "bj"], work), "a long, b long, w long"


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ngram: int = NGRAM, threshold: float = THRESHOLD, tolerance: float = 1e-6, bands: int = BANDS, rows: int = ROWS, block: int = 512) -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash``, ``class_id``, ``n_links``, ``component_id``, ``kept``.

    ``class_id``: the smallest id with the same gram set.  ``n_links``: other documents with Jaccard
    similarity >= ``threshold``, copies included.  ``component_id``: the smallest id reachable by links,
    itself included.  ``kept``: one document of each component.

    Nulls: a null or wordless text links with nothing and is kept, with its own id; a null id is larger than
    every other.  Rows that are equal in id and text are one document and get the same verdict; of different
    texts under one id, the one with the smaller hash is kept.  Other columns of ``docs`` are not read.
    """
    width = min(SKETCH, bands * rows)
    sign, schema = _signer(ngram, bands, rows, width)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    signed = written(base.mapInArrow(sign, schema), "jaccard-signed")
    first = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "th")).alias("first")
    sized = signed.filter("fp is not null").groupBy("fp", "fq").agg(F.count(F.lit(1)).alias("size"), first, *[F.first(c).alias(c) for c in ("n", "keys", "sketch")])
    classes = written(sized.withColumn("cls", F.monotonically_increasing_id()), "jaccard-classes")

    keys = classes.select("cls", F.explode(F.array_distinct("keys")).alias("key"))
    met = written(keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("met")).filter("met > 1"), "key"), "jaccard-bands")
    dealt = block_pairs(met.join(classes.select("cls", "n", "sketch"), "cls"), "key", "cls", 8 * block, "met")
    link, schema = _linker(threshold, tolerance, width)
    dealt = dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "cls")
    near = written(dealt.select("key", "bi", "bj", "cls", "n", "sketch").mapInArrow(link, schema), "jaccard-candidates")
    groups = components(near).select(F.col("node").alias("cls"), F.col("root").alias("grp"))

    near = classes.join(groups, "cls").select("grp", "cls", "size", "n", "sketch", F.col("first.id").alias("id"), F.col("first.th").alias("th"))
    near = near.alias("c").join(base.alias("d"), F.col("c.id").eqNullSafe(F.col("d.id")) & (F.col("c.th") == F.col("d.th"))).select("grp", "cls", "size", "n", "sketch", "text")
    near = near.mapInArrow(_adder(ngram), "grp long, cls long, size long, n int, sketch binary, grams binary")
    # Of rows that are equal in id and text, one stands for the class; they were counted in size.
    near = near.groupBy("grp", "cls").agg(*[F.first(c).alias(c) for c in ("size", "n", "sketch", "grams")])
    compare, schema = _comparer(threshold, tolerance, width)
    dealt = block_pairs(written(near, "jaccard-near"), "grp", "cls", block).repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj", "cls")
    found = written(dealt.select("grp", "bi", "bj", "b", "cls", "size", "n", "sketch", "grams").mapInArrow(compare, schema), "jaccard-links")

    linked = found.filter("w > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("w").alias("w"))
    roots = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "cls")
    classes = classes.select("fp", "fq", "cls", "size", "first").join(linked, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    classes = written(classes, "jaccard-verdicts")
    best = classes.groupBy("root").agg(F.min("first").alias("best"))
    classes = classes.join(best, "root").select("fp", "fq", F.col("first.id").alias("class_id"), (F.col("size") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.col("best.id").alias("component_id"), F.col("best.th").alias("best_th"))
    out = signed.select("id", "th", "fp", "fq").join(classes, ["fp", "fq"], "left")
    alone = F.col("fp").isNull()
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("th").alias("text_hash"),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("best_th")))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that :func:`jaccard_join` doesn't keep; columns and other rows as they were."""
    return without_documents(docs, jaccard_join(docs, id_col, text_col, **options).filter("not kept"), id_col, text_col)
