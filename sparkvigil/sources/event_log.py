"""A log of events written exactly once by streams: .writeStream.format("event_log").option("path", ...).

A task writes its events under a name of its own and tells it in its commit
message; the driver then names the files of a batch in one manifest,
`manifests/<batch>.json`. Files of tasks that were lost or ran twice are in no
manifest, and a batch that comes again after a restart finds its manifest and adds
nothing. Readers take what the manifests name. Each event has a key of its own,
"<stream>/<batch>/<key>", for receivers that drop what they have seen.

The stream has the columns key and event (a JSON line); `stream` names it. A null
key or event is left out of the log.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

SCHEMA = "key string, event string"


@dataclass
class Part(WriterCommitMessage):
    """A file that a task has completed, "" for none, and its rows."""

    name: str
    rows: int


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        where, base = _place(self.path)
        name, rows, out = f"part-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.parquet", 0, None
        for b in batches:
            t = pa.Table.from_batches([b]).select(["key", "event"]).drop_null()
            if t.num_rows:
                if out is None:
                    where.create_dir(f"{base}/events", recursive=True)
                    out = pq.ParquetWriter(where.open_output_stream(f"{base}/events/{name}"), t.schema)
                out.write_table(t)
                rows += t.num_rows
        if out is None:
            return Part("", 0)
        out.close()
        return Part(name, rows)

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        where, base = _place(self.path)
        target = f"{base}/manifests/{batchId}.json"
        if where.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages, batchId)  # the batch was committed before a restart
            return
        where.create_dir(f"{base}/manifests", recursive=True)
        with where.open_output_stream(f"{target}.tmp") as f:
            f.write(json.dumps({"batch": batchId, "files": [m.name for m in messages if m and m.name], "rows": sum(m.rows for m in messages if m)}).encode())
        where.move(f"{target}.tmp", target)

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        where, base = _place(self.path)
        for m in messages:
            if m and m.name:
                where.delete_file(f"{base}/events/{m.name}")


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def streamWriter(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(EventLog)
    return spark


def logged(spark: SparkSession, path: str, stream: str = "stream") -> DataFrame:
    """(batch, key, event, idempotency_key) of the events that manifests name."""
    where, base = _place(path)
    if where.get_file_info(f"{base}/manifests").type == fs.FileType.NotFound:
        return spark.createDataFrame([], "batch long, key string, event string, idempotency_key string")
    named = spark.read.schema("batch long, files array<string>").json(f"{path}/manifests/*.json").select("batch", F.explode("files").alias("_file"))
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/events").withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.join(named, "_file").select("batch", "key", "event", F.concat_ws("/", F.lit(stream), F.col("batch").cast("string"), "key").alias("idempotency_key"))
