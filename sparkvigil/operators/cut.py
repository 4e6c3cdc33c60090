"""Cuts lineage between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a local session without one gets its own."""
    return f"{_root(spark).rstrip('/')}/sparkvigil/{uuid.uuid4().hex}"


def _root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="sparkvigil-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed once and written as Parquet in the shared folder, with its lineage cut."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_in_place(df: DataFrame) -> DataFrame:
    """The same for steps that read a frame partition by partition, in order: a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    root = _root(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return df.checkpoint()
