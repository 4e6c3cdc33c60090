"""Intermediate tables that survive the loss of executors.

They go, as Parquet, to the shared folder that the session names in
spark.checkpoint.dir. Where that is unset, a local session (tests, notebooks)
gets a temporary folder of this machine; on a cluster that is an error, as
executors would write to disks that the others cannot read. A table that no
later step reads is deleted with `forgotten`.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """A new path under the session's shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="sparkvigil-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(own)
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get()
    return f"{root.rstrip('/')}/sparkvigil/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Runs `df` once and gives the written table, with its lineage cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Runs `df`, already partitioned by `key` into so many parts, into a table bucketed by it.

    Joins on the key then read the table where it lies: its rows are not shuffled again.
    """
    spark, name = df.sparkSession, f"sparkvigil_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    _paths[out], _tables[out] = path, name
    return out


def forgotten(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more, and has the JVM collect its garbage: only then does Spark delete shuffles that ended."""
    for t in tables:
        if t is not None and (name := _tables.pop(t, None)):
            t.sparkSession.sql(f"drop table if exists {name}")
        if t is not None and (path := _paths.pop(t, None)):
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where.getParent(), True)
    gc.collect()
    if tables and (spark := next((t.sparkSession for t in tables if t is not None), None)):
        spark._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = 250) -> None:
    """Arrow batches of at most so many rows in this session: a batch of whole texts is held by JVM and Python at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
