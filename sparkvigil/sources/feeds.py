"""Feeds in and out: event files, a service-graph endpoint, a verdict endpoint, lifecycle events and reports."""

from __future__ import annotations

import hashlib
import json
import logging
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parsers import _EVENT, event_problem

log = logging.getLogger(__name__)
_graphs: dict[str, tuple[float, str]] = {}


def deploy_events(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejected lines with a reason) of landed JSON lines, batch or stream; a line counts by its own fields alone."""
    j = lines.select("value", event_problem(F.col("value")).alias("reason"))
    good = j.where("reason is null").select(F.from_json("value", _EVENT).alias("j")).select("j.event.*", "j.emitted_at_ts")
    return good, j.where("reason is not null")


def service_graph(spark: SparkSession, url: str, ttl_s: float = 60.0, timeout_s: float = 5.0, now: Callable[[], float] = time.time) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a service graph served as JSON: one bounded document, kept for ttl_s; a malformed one is an error."""
    kept = _graphs.get(url)
    if kept is None or now() - kept[0] >= ttl_s:
        with urllib.request.urlopen(url, timeout=timeout_s) as r:
            kept = now(), r.read().decode()
        g = json.loads(kept[1])
        if not isinstance(g.get("nodes"), list) or not isinstance(g.get("edges"), list):
            raise ValueError(f"{url}: not a service graph")
        _graphs[url] = kept
    doc = spark.createDataFrame([(kept[1],)], "value string").select(F.from_json("value", "nodes array<struct<id:string,service_name:string,kind:string>>, edges array<struct<from:string,to:string,relationship:string>>").alias("j"))
    nodes = doc.select(F.explode("j.nodes").alias("n")).select("n.*")
    edges = doc.select(F.explode("j.edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.relationship")
    return nodes, edges


def post(requests: DataFrame, url: str, token: str | None = None, timeout_s: float = 5.0) -> DataFrame:
    """(group_id, outcome, status) of posting each row's `request`: accepted, client_error, server_error, network or invalid.

    Runs once for each evaluation of the result; write the result to keep it, or
    use `post_new`. Each request has an Idempotency-Key, the group and the digest of
    its body, by which a receiver knows what a repeated task sends again.
    """

    return _posted(requests.select("group_id", "request"), url, token, timeout_s)


def _posted(requests: DataFrame, url: str, token: str | None, timeout_s: float) -> DataFrame:
    """`post`, with the further columns of text that the rows have."""
    kept = [c for c in requests.columns if c != "request"]

    def send(group: str, body: str) -> tuple[str, int | None]:
        key = f"{group}-{hashlib.sha256((body or '').encode()).hexdigest()[:16]}"
        head = {"Content-Type": "application/json", "Idempotency-Key": key} | ({"Authorization": f"Bearer {token}"} if token else {})
        try:
            json.loads(body)
        except (TypeError, ValueError):
            return "invalid", None
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body.encode(), head, method="POST"), timeout=timeout_s) as r:
                return "accepted", r.status
        except urllib.error.HTTPError as e:
            return ("client_error" if e.code < 500 else "server_error"), e.code
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            return "network", None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [send(g, x) for g, x in zip(b.group_id, b.request, strict=True)]
            yield b[kept].assign(outcome=[o for o, _ in got], status=pd.array([s for _, s in got], dtype="Int64"))

    return requests.mapInPandas(run, ", ".join(f"{c} string" for c in kept) + ", outcome string, status long")


def post_new(requests: DataFrame, url: str, ledger: str, token: str | None = None, timeout_s: float = 5.0) -> DataFrame:
    """Posts what the ledger, a Parquet folder, does not know as settled, and adds the outcomes to it; gives those of this call.

    Settled are requests that were accepted or that the receiver refused as wrong
    (client_error, invalid); server errors and network failures are tried again by
    the next call. A request is told by group_id and its body's digest.
    """
    spark, digest = requests.sparkSession, F.sha2(F.coalesce("request", F.lit("")), 256)
    known = "group_id string, digest string, outcome string, status long, call string"
    call = uuid.uuid4().hex
    try:
        settled = spark.read.schema(known).parquet(ledger).where("outcome in ('accepted', 'client_error', 'invalid')").select("group_id", "digest").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        settled = spark.createDataFrame([], "group_id string, digest string")
    new = requests.select("group_id", "request", digest.alias("digest")).dropDuplicates(["group_id", "digest"]).join(settled, ["group_id", "digest"], "left_anti")
    _posted(new, url, token, timeout_s).withColumn("call", F.lit(call)).write.mode("append").parquet(ledger)
    return spark.read.schema(known).parquet(ledger).where(F.col("call") == call).drop("call", "digest")


def isolated(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body that gives each batch to every sink; a sink's failure is logged and does not stop the others."""

    def run(batch: DataFrame, epoch: int) -> None:
        for sink in sinks:
            try:
                sink(batch, epoch)
            except Exception:
                log.exception("sink %s failed in epoch %s", getattr(sink, "__name__", sink), epoch)

    return run


def lifecycle_event(kind: str, payload: F.Column, now: F.Column) -> F.Column:
    """One lifecycle event as a JSON line; absent fields are left out."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), now.alias("at"), payload.alias("payload")))


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines of a report or a substrate table, with null fields left out."""
    df.write.mode("overwrite").json(path)
