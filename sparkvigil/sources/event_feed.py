"""Cluster events as a data source, for batches and streams: spark.read or spark.readStream .format("event_feed").

Options: `path`, a folder of Parquet files with event_id, kind, event_ts
(seconds) and, where present, event_window_end_ts; `since`, after which events
count (strictly; none: all). Rows of a partition come in order of (event_ts,
event_id). The offset of a stream is the latest event_ts that it has read up to,
taken from the files' statistics, so a stream that starts again from its
checkpoint gives the events after it, each once. As with any feed that is asked for
what came since, an event that lands later with an earlier event_ts is not told.
Partitions are row groups whose statistics overlap the range that is asked for.
Events without event_ts are never told.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "event_id string, kind string, event_ts long, event_window_end_ts long"
_ARROW = pa.schema([("event_id", pa.string()), ("kind", pa.string()), ("event_ts", pa.int64()), ("event_window_end_ts", pa.int64())])
NONE = -(1 << 62)


@dataclass
class RowGroup(InputPartition):
    """One row group of a file and the range (since, until] of event_ts."""

    path: str
    group: int
    since: int
    until: int


def _files(path: str) -> Iterator[str]:
    where, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = where.get_file_info(base)
    if info.type == fs.FileType.File:
        yield base
    elif info.type == fs.FileType.Directory:
        yield from sorted(x.path for x in where.get_file_info(fs.FileSelector(base, recursive=True)) if x.path.endswith(".parquet"))


def _filesystem(path: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()


def _extent(meta: pq.FileMetaData, group: int, file: pq.ParquetFile) -> tuple[int, int] | None:
    """Least and greatest event_ts of a row group, from statistics or, without them, from the column; None if there is none."""
    at = meta.schema.to_arrow_schema().get_field_index("event_ts")
    stats = meta.row_group(group).column(at).statistics
    if stats is not None and stats.has_min_max:
        return stats.min, stats.max
    m = pc.min_max(file.read_row_group(group, columns=["event_ts"])["event_ts"])
    return None if m["min"].as_py() is None else (m["min"].as_py(), m["max"].as_py())


def row_groups(path: str, since: int, until: int | None) -> tuple[list[RowGroup], int]:
    """The row groups with events in (since, until], and the greatest event_ts there is (at least since)."""
    out, latest, where = [], since, _filesystem(path)
    for f in _files(path):
        with where.open_input_file(f) as raw, pq.ParquetFile(raw) as file:
            for g in range(file.metadata.num_row_groups):
                if extent := _extent(file.metadata, g, file):
                    latest = max(latest, extent[1])
                    if extent[1] > since and (until is None or extent[0] <= until):
                        out.append(RowGroup(f, g, since, until if until is not None else extent[1]))
    return out, latest


def read_group(path: str, part: RowGroup) -> Iterator[pa.RecordBatch]:
    with _filesystem(path).open_input_file(part.path) as raw, pq.ParquetFile(raw) as file:
        t = file.read_row_group(part.group, columns=[c for c in _ARROW.names if c in file.schema_arrow.names])
    t = t.filter((pc.field("event_ts") > part.since) & (pc.field("event_ts") <= part.until)).sort_by([("event_ts", "ascending"), ("event_id", "ascending")])
    columns = [t[f.name].cast(f.type) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in _ARROW]
    yield from pa.Table.from_arrays(columns, schema=_ARROW).combine_chunks().to_batches()


class _Batch(DataSourceReader):
    def __init__(self, path: str, since: int):
        self.path, self.since = path, since

    def partitions(self) -> list[RowGroup]:
        return row_groups(self.path, self.since, None)[0] or [RowGroup("", -1, 0, 0)]

    def read(self, part: RowGroup) -> Iterator[pa.RecordBatch]:
        if part.group >= 0:
            yield from read_group(self.path, part)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, since: int):
        self.path, self.since = path, since

    def initialOffset(self) -> dict:
        return {"event_ts": self.since}

    def latestOffset(self) -> dict:
        return {"event_ts": row_groups(self.path, self.since, None)[1]}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        return row_groups(self.path, start["event_ts"], end["event_ts"])[0] if end["event_ts"] > start["event_ts"] else []

    def read(self, part: RowGroup) -> Iterator[pa.RecordBatch]:
        yield from read_group(self.path, part)

    def commit(self, end: dict) -> None:
        """Nothing to release: files stay."""


class EventFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_feed"

    def schema(self) -> str:
        return SCHEMA

    def _since(self) -> int:
        return int(self.options.get("since", NONE))

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["path"], self._since())

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"], self._since())


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(EventFeed)
    return spark


__all__ = ["EventFeed", "registered", "row_groups"]
