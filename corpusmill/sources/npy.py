"""Embedding caches in ``.npy`` files: a Spark data source that reads byte ranges, one a task, and a writer of parts.

    spark.dataSource.register(NpySource)
    spark.read.format("npy").load(path)          # file, at, pos, vector

``path``: a file, or a folder whose ``.npy`` files are one matrix in the order of their names.  ``at`` is the row in its file, ``pos``
in the matrix.  Files hold two-dimensional arrays of floats in row order; only their headers are read on the driver.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a task and of a batch, about.
SPLIT, BATCH = 64 << 20, 4 << 20


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def header(file) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and where the data begins, of an open file."""
    head = io.BytesIO(file.read_at(1 << 16, 0))
    version = np.lib.format.read_magic(head)
    shape, fortran, kind = np.lib.format.read_array_header_1_0(head) if version == (1, 0) else np.lib.format.read_array_header_2_0(head)
    if len(shape) != 2 or kind.kind != "f" or (fortran and min(shape) > 1):
        raise ValueError(f"not a matrix of floats in row order: {shape} {kind}")
    return shape, kind, head.tell()


def files_of(uri: str) -> list[str]:
    store, path = _store(uri)
    if store.get_file_info(path).type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(path))
    return sorted(f.path for f in found if f.path.endswith(".npy"))


def n_rows(uri: str) -> int:
    store, _ = _store(uri)
    total = 0
    for path in files_of(uri):
        with store.open_input_file(path) as f:
            total += header(f)[0][0]
    return total


@dataclass
class Rows(InputPartition):
    """Rows ``at`` to ``end`` of a file, which begin at ``pos`` of the matrix."""

    path: str
    at: int
    end: int
    pos: int


class NpyReader(DataSourceReader):
    def __init__(self, uri: str, split: int):
        self.uri, self.split = uri, split

    def partitions(self) -> list[InputPartition]:
        store, _ = _store(self.uri)
        out, pos = [], 0
        for path in files_of(self.uri):
            with store.open_input_file(path) as f:
                (n, d), kind, _ = header(f)
            step = max(1, self.split // max(1, d * kind.itemsize))
            out += [Rows(path, at, min(n, at + step), pos + at) for at in range(0, n, step)]
            pos += n
        return out or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.at == partition.end:
            return
        store, _ = _store(self.uri)
        with store.open_input_file(partition.path) as f:
            (_, d), kind, data = header(f)
            width = d * kind.itemsize
            step = max(1, BATCH // max(1, width))
            for at in range(partition.at, partition.end, step):
                n = min(step, partition.end - at)
                values = np.frombuffer(f.read_at(n * width, data + at * width), dtype=kind).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(values))
                where = np.arange(at, at + n)
                name = pa.array([partition.path.rsplit("/", 1)[-1]] * n)
                yield pa.RecordBatch.from_arrays([name, pa.array(where), pa.array(where - partition.at + partition.pos), vectors], names=["file", "at", "pos", "vector"])


class NpySource(DataSource):
    """``npy``; option ``split``: bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, at long, pos long, vector array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("split", SPLIT)))


def scan(spark: SparkSession, uri: str, expected: int | None = None, dense: bool = True) -> DataFrame:
    """``file, at, pos, vector`` of a cache for ``expected`` items.

    With ``dense`` off (nothing will be compared) a cache of another length is replaced by a zero for each item; with it on, that
    is an error.
    """
    spark.dataSource.register(NpySource)
    n = n_rows(uri)
    if expected is not None and n != expected:
        if dense:
            raise ValueError(f"{n} vectors for {expected} items")
        zeros = spark.range(expected).withColumnRenamed("id", "pos")
        return zeros.select(F.lit("").alias("file"), F.col("pos").alias("at"), "pos", F.array(F.lit(0.0).cast("float")).alias("vector"))
    return spark.read.format("npy").load(uri)


def write(rows: DataFrame, uri: str, key: str = "item", vector: str = "vector") -> DataFrame:
    """Writes ``rows(key, vector)``, whose vectors have one length, as parts of a matrix; returns ``file, at, key`` of what was written.

    A part is written under a draft's name and moved, so a task that is done again replaces its part by the same.  The result must
    be read once (written or collected), as reading it writes.
    """
    schema = rows.select(F.lit("").alias("file"), F.lit(0).cast("long").alias("at"), key).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(uri)
        context = TaskContext.get()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        values = table.column(vector).chunk(0).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(table.num_rows, -1)
        store.create_dir(base, recursive=True)
        name = f"part-{context.partitionId():06d}.npy"
        draft = f"{base}/.{name}-{context.taskAttemptId()}"
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(values))
        with store.open_output_stream(draft) as f:
            f.write(out.getvalue())
            f.write(values.tobytes())
        store.move(draft, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(np.arange(len(values))), table.column(key).chunk(0)], names=["file", "at", key])

    return rows.select(key, vector).mapInArrow(run, schema)
