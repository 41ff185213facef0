"""Embedding whitening: principal components of exactly centred vectors, each scaled to unit variance.

Entries become integers, so that sums are exact.  The rows of a ``RowMatrix`` are the integers less their exact mean; its
``computeGramianMatrix`` (partial products a partition, added up in a tree) divided by n is the covariance.  Only this matrix,
d times d whatever the number of vectors, reaches the driver, where ``eigh`` takes it apart; the mean and the components are
broadcast (d * (k + 2) numbers) and ``mapInPandas`` projects every vector.  Nothing is shuffled but d sums a partition.

Vectors take part if they are not null, hold no null and no non-finite entry, and have the usual length (the most frequent
one, the shorter of equals); others have no row in the result.  A component without variance (an eigenvalue within rounding of 0,
as of equal vectors or a constant dimension) has null as its ``whitened``, and takes no part in ``identity_error``, which is null
if there is no other.  Repeated rows count as often as they occur; null ids and other columns play no role; an empty table gives an
empty one.  Integers end at 2**52 in either direction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import written

SCALE, SHIFT, LIMIT = 1024.0, 100_000, float(2**52)


def usable(df: DataFrame, id_col: str, vector: str, entry, extra: list[Column] | None = None) -> DataFrame:
    """``id`` and ``x`` (an array of ``entry(component)``), and ``extra``, of the vectors that can be used, all of one length."""
    good = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.filter(F.coalesce(good, F.lit(False)))
    usual = rows.groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), "length").first()  # one row a length
    rows = rows.filter(F.size(vector) == (usual["length"] if usual else 0))
    return rows.select(F.col(id_col).alias("id"), F.transform(vector, entry).alias("x"), *(extra or []))


def _entry(c: Column) -> Column:
    return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c.cast("double") * SCALE).cast("double"))).cast("long") + SHIFT


def gramian(vectors: DataFrame, column: str, n: int, d: int) -> np.ndarray:
    """The sum of the outer products of ``column`` (array<double>) by ``RowMatrix``, in the JVM."""
    rows = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector(F.col(column)).alias("v")), "v")
    return RowMatrix(rows, n, d).computeGramianMatrix().toArray()


@dataclass
class Whitening:
    """A fitted whitening: ``n`` vectors with ``sums`` (exact), eigenvalues falling, unit eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def __len__(self) -> int:
        return len(self.values)

    def scales(self) -> np.ndarray:
        """1 over the deviation of each component; NaN where there is no variance above rounding."""
        floor = max(self.trace, 0.0) * len(self.values) * np.finfo(np.float64).eps
        return np.array([1 / np.sqrt(e) if e > floor else np.nan for e in self.values])


def fit(x: DataFrame) -> Whitening | None:
    """Whitening of ``x`` (id, x: array<long>, all of one length); None without rows or entries."""
    sums = x.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    found = sorted(sums.collect())  # one row a dimension
    if not found:
        return None
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    cov = gramian(x.select(centred(F.col("x"), n, sums).alias("c")), "c", n, len(sums)) / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    vectors = vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(sums))])
    return Whitening(n, sums, values[::-1], vectors, float(np.trace(cov)))


def centred(x: Column, n: int, sums: list[int]) -> Column:
    """``x - sums / n`` as doubles: whole parts are taken off as integers, so the large common part costs no digits."""
    whole, rest = [s // n for s in sums], [(s % n) / n for s in sums]
    return F.zip_with(F.zip_with(x, F.lit(whole), lambda a, b: (a - b).cast("double")), F.lit(rest), lambda a, b: a - b)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Per row, the sum of (n * x - sums) squared, exactly."""
    whole, rest = np.array([s // n for s in sums], dtype=np.int64), [s % n for s in sums]
    near = x - whole
    most = int(np.abs(near).max(initial=0)) * n + n
    if most * most * max(1, len(sums)) < 2**63:
        off = near * n - np.array(rest, dtype=np.int64)
        return (off * off).sum(1).tolist()
    off = near.astype(object) * n - np.array(rest, dtype=object)
    return (off * off).sum(1).tolist()


def transform(x: DataFrame, model: Whitening, components: int | None = None) -> DataFrame:
    """``id, deviation`` (decimal(38,0); null beyond that) and ``whitened`` (array<double>, the first ``components``) of ``x``."""
    k = len(model) if components is None else min(components, len(model))
    shared = x.sparkSession.sparkContext.broadcast((model.n, model.sums, model.vectors[:, :k] * model.scales()[:k]))
    schema = T.StructType([x.schema["id"], T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Context, Decimal

        n, sums, axes = shared.value
        whole, rest = np.array([s // n for s in sums], dtype=np.int64), np.array([(s % n) / n for s in sums])
        exact = Context(prec=38)
        for frame in frames:
            if len(frame):
                rows = np.stack(frame["x"].to_numpy()).astype(np.int64)
                deviation = [Decimal(v) if v < 10**38 else None for v in _deviations(rows, n, sums)]
                deviation = [v if v is None else exact.create_decimal(v) for v in deviation]
                yield pd.DataFrame({"id": frame["id"], "deviation": deviation, "whitened": list(((rows - whole) - rest) @ axes)})

    return x.mapInPandas(run, schema)


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int | None = None) -> tuple[DataFrame, Whitening | None, float | None]:
    """Whitened vectors of ``df``: rows (``id, deviation, whitened``), the fitted whitening, and the identity error.

    The identity error is the largest absolute entry of the whitened vectors' covariance (again of centred rows by
    ``computeGramianMatrix``) less the identity.
    """
    x = written(usable(df, id_col, vector, _entry), "whitening-x")
    model = fit(x)
    if model is None:
        schema = T.StructType([x.schema["id"], T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
        return df.sparkSession.createDataFrame([], schema), None, None
    rows = written(transform(x, model, components), "whitened")
    k = len(model) if components is None else min(components, len(model))
    held = [i for i in range(k) if np.isfinite(model.scales()[i])]
    if not held:
        return rows, model, None
    means = rows.agg(*[F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in held]).first()
    off = F.array(*[F.col("whitened")[i] - F.lit(means[f"m{i}"]) for i in held])
    cov = gramian(rows.select(off.alias("c")), "c", model.n, len(held)) / model.n
    return rows, model, float(np.abs(cov - np.eye(len(held))).max())


def long_rows(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """A row a vector and component: ``id, component`` (from 1), ``n, deviation`` (long; null if none holds it), ``whitened, explained, identity_error``."""
    rows, model, error = whiten(df, id_col, vector, components)
    n, trace = (model.n, model.trace) if model else (0, 0.0)
    explained = [float(e / trace) if trace > 0 else 0.0 for e in (model.values[:components] if model else [])]
    rows = rows.select("id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.nanvl("whitened", F.lit(None).cast("double")).alias("whitened"),
        F.element_at(F.lit(explained or [0.0]), F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
