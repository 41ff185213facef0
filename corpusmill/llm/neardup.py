"""Near copies among embeddings by collision-counting projections.

Method (query-aware collision counting, Huang et al., 2015).  Every vector is projected on many random
lines.  For a query, each line that has sorted projections is asked for those within a window centred on
the query's own; a pair that lies in one another's window on at least ``least`` of the lines is verified by its
cosine in double precision.  ``least`` is calibrated: for a pair exactly at the threshold the binomial chance
of fewer collisions is at most ``miss``.

Counting collisions of every pair would be a cross join, so the lines are asked inside cells: the signs of
K further projections, in L tables, deal the vectors of one label to cells of about ``cell`` rows.  K follows
from the largest label and L from K, so that a pair at the threshold shares a cell of some table with
probability 1 - ``miss`` at every size.  A pair counts only in the first table whose cell it shares.

Equal vectors of a label (by 128 bits of hash) are one class and never meet.  Cells are cut into blocks (no task holds an unbounded
one); tasks return link counts and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import block_pairs, components, written
from corpusmill.llm.pairs import grouped, spread


def _normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def calibrated(threshold: float, lines: int, half_sigmas: float, miss: float) -> tuple[float, int]:
    """Half a window's width, and the collisions that a pair at ``threshold`` reaches but with probability ``miss``."""
    distance = math.sqrt(2 - 2 * threshold)
    p = 2 * _normal_cdf(half_sigmas) - 1
    below = 0.0
    for k in range(lines + 1):
        below += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if below > miss:
            return half_sigmas * distance, k
    return half_sigmas * distance, lines


def tables(threshold: float, largest: int, cell: int, miss: float) -> tuple[int, int]:
    """K signs a table and L tables for a largest group of ``largest`` vectors."""
    k = max(4, math.ceil(math.log2(max(2, largest / cell))))
    p = (1 - math.acos(threshold) / math.pi) ** k
    return k, max(1, math.ceil(math.log(miss) / math.log1p(-p)))


def _lines(seed: int, dim: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, n))


def _codes(unit: np.ndarray, k: int, n_tables: int, seed: int) -> np.ndarray:
    """Sign codes (rows x tables) of unit vectors."""
    bits = (unit @ _lines(seed, unit.shape[1], k * n_tables)) >= 0
    weights = np.uint64(1) << np.arange(k, dtype=np.uint64)
    return (bits.reshape(len(unit), n_tables, k) * weights).sum(axis=2).astype(np.int64)


def _units(vectors: list[bytes], dtype: str) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(b"".join(vectors), dtype=dtype).reshape(len(vectors), -1).astype(np.float64)
    norm = np.sqrt((v * v).sum(axis=1))
    return v, norm


def _celler(k: int, n_tables: int, seed: int, dtype: str):
    schema = pa.schema([("cls", pa.int64()), ("size", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary()), ("t", pa.int32()), ("code", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                dims = part.column("dim").to_numpy()
                for dim in np.unique(dims):
                    sub = part.filter(pa.array(dims == dim))
                    v, norm = _units(sub.column("vec").to_pylist(), dtype)
                    codes = _codes(v / norm[:, None], k, n_tables, seed)
                    rows = pa.array(np.repeat(np.arange(len(v)), n_tables))
                    cols = [sub.column(n).take(rows) for n in ("cls", "size", "label", "dim", "vec")]
                    cols += [pa.array(np.tile(np.arange(n_tables, dtype=np.int32), len(v))), pa.array(codes.ravel())]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run, "cls long, size long, label long, dim int, vec binary, t int, code long"


def collisions(queries: np.ndarray, points: np.ndarray, half: float) -> np.ndarray:
    """For each query and point, on how many lines (columns) the point lies in the window centred on the query.

    Each line is sorted once; a query's window is then a run of the sorted points, found by two searches, and a point
    lies in it if its rank does.
    """
    count = np.zeros((len(queries), len(points)), dtype=np.int16)
    rank = np.empty(len(points), dtype=np.int16)
    for j in range(queries.shape[1]):
        order = np.argsort(points[:, j], kind="stable")
        line = points[order, j]
        rank[order] = np.arange(len(points))
        low = np.searchsorted(line, queries[:, j] - half, "left").astype(np.int16)[:, None]
        run = (np.searchsorted(line, queries[:, j] + half, "right").astype(np.int16)[:, None] - low).view(np.uint16)
        count += (rank - low).view(np.uint16) < run  # one comparison: ranks below the window wrap around
    return count


def _comparer(threshold: float, k: int, n_tables: int, lines: int, half: float, least: int, seed: int, dtype: str):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.int64())])
    empty: dict[str, list] = {"a": [], "b": [], "w": []}

    def work(t: pa.Table) -> dict[str, list]:
        block, cls, size, label, dims, table = (t.column(c).to_numpy() for c in ("b", "cls", "size", "label", "dim", "t"))
        bi, bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
        out: dict[str, list] = {"a": [], "b": [], "w": []}
        vec = t.column("vec").to_pylist()
        for dim in np.unique(dims):
            here = dims == dim
            rows, cols = np.flatnonzero(here & (block == bi)), np.flatnonzero(here & (block == bj))
            if not len(rows) or not len(cols):
                continue
            va, na = _units([vec[i] for i in rows], dtype)
            vb, nb = (va, na) if bi == bj else _units([vec[i] for i in cols], dtype)
            ua, ub = va / na[:, None], vb / nb[:, None]
            line = _lines(seed + 1, int(dim), lines)
            ok = collisions(ua @ line, ub @ line, half) >= least
            ok &= (label[rows][:, None] == label[cols]) & (table[rows][:, None] == table[cols])
            if bi == bj:
                ok &= rows[:, None] < cols
            x, y = np.nonzero(ok)
            if not len(x):
                continue
            cos = np.einsum("ij,ij->i", va[x], vb[y]) / (na[x] * nb[y])
            x, y = x[cos >= threshold], y[cos >= threshold]
            ca, cb = _codes(ua, k, n_tables, seed), _codes(ub, k, n_tables, seed)
            met = (ca[x] == cb[y]) & (np.arange(n_tables) < table[rows][x][:, None])
            own = ~met.any(axis=1)
            x, y = x[own], y[own]
            linked = np.zeros((len(rows), len(cols)), dtype=bool)
            linked[x, y] = True
            gx, gy = rows[x], cols[y]
            weight = np.bincount(gx, weights=size[gy], minlength=t.num_rows) + np.bincount(gy, weights=size[gx], minlength=t.num_rows)
            some = np.flatnonzero(weight)
            edges = spread(t.num_rows, linked | linked.T if bi == bj else linked, rows, cols)
            out["a"] += cls[some].tolist() + [int(cls[i]) for i, _ in edges]
            out["b"] += [None] * len(some) + [int(cls[j]) for _, j in edges]
            out["w"] += weight[some].astype(np.int64).tolist() + [0] * len(edges)
        return out if out["a"] else empty

    return grouped(schema, ["grp", "bi", "bj"], work), "a long, b long, w long"


def _packer(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = [np.asarray(v, dtype=dtype).tobytes() for v in batch.column("embedding").to_pylist()]
            cols = [batch.column(n) for n in ("id", "fp", "fq", "label", "dim")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(vec, pa.binary())], names=["id", "fp", "fq", "label", "dim", "vec"])

    return run


def embedding_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", *, threshold: float = 0.98, lines: int = 24, half_sigmas: float = 1.5, miss: float = 1e-6, cell: int = 32, block: int = 256, seed: int = 20) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Only vectors with equal, non-null labels are compared.  Nulls, zero vectors and vectors with null or
    non-finite components link with nothing (``n_links`` 0, their own component, kept); vectors of different
    length don't link.  Equal vectors link with each other.  Rows with one id share ``component_id`` only if
    they are linked.  A null id is ignored as a smallest id.  Other columns are not read.
    """
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    v = F.col("embedding")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    usable = F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False))
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("embedding"))
    base = base.withColumn("fp", F.when(usable, F.xxhash64("label", "embedding"))).withColumn("fq", F.when(usable, F.xxhash64(F.lit(9), "label", "embedding")))
    packed = base.filter("fp is not null").select("id", "fp", "fq", "label", F.size("embedding").alias("dim"), "embedding").mapInArrow(_packer(dtype), "id long, fp long, fq long, label long, dim int, vec binary")
    classes = packed.groupBy("fp", "fq").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "embedding-classes")

    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    k, n_tables = tables(threshold, largest, cell, miss)
    half, least = calibrated(threshold, lines, half_sigmas, miss)
    cells, schema = _celler(k, n_tables, seed, dtype)
    dealt = classes.select("cls", "size", "label", "dim", "vec").mapInArrow(cells, schema).withColumn("grp", F.xxhash64("t", "label", "dim", "code")).drop("code")
    dealt = block_pairs(dealt, "grp", "cls", block).repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj", "cls")
    compare, schema = _comparer(threshold, k, n_tables, lines, half, least, seed, dtype)
    found = written(dealt.select("grp", "bi", "bj", "b", "cls", "size", "label", "dim", "t", "vec").mapInArrow(compare, schema), "embedding-links")

    weight = found.filter("w > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("w").alias("w"))
    roots = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "cls")
    classes = classes.select("fp", "fq", "cls", "size", "first").join(weight, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(smallest, "root").select("fp", "fq", "component_id", (F.col("size") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"))
    out = base.select("id", "fp", "fq").join(classes, ["fp", "fq"], "left")
    component = F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
