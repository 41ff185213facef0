"""Progress events that tasks emit while a job runs, and the stream that follows them.

An event is a small file named by the digest of run, key, label and number, so a task that is done again adds nothing: the first
to arrive counts.  The folder is read as a table, or as a stream that takes every file once.
"""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.put_once import Folder

SCHEMA = "run string, key long, no int, label string, detail string, fields map<string,string>, ts double"


class Emitter:
    """What tasks call: ``emit(key, no, label, detail, **fields)``; ``no`` orders the events of a key.

    Progress never fails the work that it tells of: an event that can't be written is lost.
    """

    def __init__(self, folder: str, run: str):
        self.folder, self.run = Folder(folder), run

    def __call__(self, key: int, no: int, label: str, detail: str = "", **fields: object) -> None:
        name = hashlib.sha256(json.dumps([self.run, key, no, label]).encode()).hexdigest()
        row = {"run": self.run, "key": key, "no": no, "label": label, "detail": detail, "fields": {k: str(v) for k, v in fields.items()}, "ts": time.time()}
        try:
            self.folder.put(f"{name}.json", json.dumps(row).encode())
        except OSError:
            pass


def events(spark: SparkSession, folder: str) -> DataFrame:
    """All events of a folder so far."""
    return _typed(spark.read.schema(SCHEMA).json(folder))


def _typed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))


def follow(spark: SparkSession, folder: str, checkpoint: str, target: str, **trigger):
    """Streams a folder's events into Parquet files under ``target``, each once; ``trigger`` as of ``DataStreamWriter.trigger``. Returns the query."""
    rows = _typed(spark.readStream.schema(SCHEMA).json(folder))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
