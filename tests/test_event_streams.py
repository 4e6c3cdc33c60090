"""The event feed, the exactly-once log and groups that close by watermark."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkvigil.operators import grouping
from sparkvigil.sources import event_feed, event_log
from sparkvigil.streaming import stateful as st

from .test_streaming import PROVIDER, streamed


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def events(spark, lo, hi):
    return spark.range(lo, hi).select(F.concat(F.lit("e"), "id").alias("event_id"), F.lit("env_change").alias("kind"), (F.col("id") * 3 % 1000 + F.when(F.col("id") >= 500, 1000).otherwise(0)).alias("event_ts"))


def test_feed_in_batches(spark, tmp_path):
    path = str(tmp_path / "events")
    events(spark, 0, 300).unionByName(spark.createDataFrame([("late", "x", None)], "event_id string, kind string, event_ts long")).repartition(3).write.option("parquet.block.size", 1024).parquet(path)
    event_feed.registered(spark)
    want = {(r.event_id, r.event_ts) for r in events(spark, 0, 300).where("event_ts > 400").collect()}
    got = spark.read.format("event_feed").option("since", 400).load(path).collect()
    assert {(r.event_id, r.event_ts) for r in got} == want and len(got) == len(want) and all(r.event_window_end_ts is None for r in got)
    assert spark.read.format("event_feed").load(path).count() == 300 and spark.read.format("event_feed").load(str(tmp_path / "none")).count() == 0


def run(spark, feed, log, checkpoint):
    rows = spark.readStream.format("event_feed").load(feed).select(F.col("event_id").alias("key"), F.to_json(F.struct("event_id", "kind", "event_ts")).alias("event"))
    q = rows.writeStream.format("event_log").option("path", log).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    q.stop()


def test_stopped_and_restarted_stream_gives_each_event_once(spark, tmp_path):
    feed, log, checkpoint = (str(tmp_path / x) for x in ("feed", "log", "checkpoint"))
    event_feed.registered(spark)
    event_log.registered(spark)
    assert event_log.logged(spark, log).count() == 0
    events(spark, 0, 400).repartition(2).write.parquet(feed)
    run(spark, feed, log, checkpoint)
    assert event_log.logged(spark, log).count() == 400
    events(spark, 500, 700).write.mode("append").parquet(feed)
    run(spark, feed, log, checkpoint)
    rows = event_log.logged(spark, log, "feed").collect()
    assert Counter(r.key for r in rows) == Counter(f"e{i}" for i in [*range(400), *range(500, 700)])
    assert len({r.idempotency_key for r in rows}) == 600 and all(json.loads(r.event)["event_id"] == r.key for r in rows)
    # the last batch's commit is lost, so the batch comes again: its manifest is there already
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run(spark, feed, log, checkpoint)
    assert event_log.logged(spark, log).count() == 600


def test_a_lost_task_leaves_nothing(spark, tmp_path):
    import pyarrow as pa

    w = event_log._Writer(str(tmp_path / "log"))
    batch = pa.RecordBatch.from_pydict({"key": ["a", None], "event": ["{}", "{}"]})

    class Task:
        partitionId = staticmethod(lambda: 0)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(event_log.TaskContext, "get", staticmethod(Task))
        first, again = w.write(iter([batch])), w.write(iter([batch]))
        assert w.write(iter([])).rows == 0
    w.commit([again, None], 7)  # the first attempt was lost after it wrote
    assert first.name != again.name and [(r.batch, r.key) for r in event_log.logged(spark, str(tmp_path / "log")).collect()] == [(7, "a")]
    w.commit([first], 7)
    assert event_log.logged(spark, str(tmp_path / "log")).count() == 1


@pytest.mark.parametrize("window, grace", [(300, 60), (40, 100)])
def test_groups_close_by_watermark(spark, tmp_path, window, grace):
    rows = [(f"d{i % 4}", None if i % 4 == 3 else "ev", 1000 + i * 7 + (i // 50) * 500, i, i % 23 == 5, ["A"] if i % 3 else []) for i in range(240)]
    end = [(f"z{j}", "ev", 10_000 + 1000 * j, 1000 + j, False, []) for j in range(3)]
    schema = "deploy_ref string, cluster_event_id string, ts long, seq long, terminal boolean, families array<string>"
    v = spark.createDataFrame(rows + end, schema)
    batch = grouping.assigned(v.where("deploy_ref like 'd%'").withColumns({"tick": F.col("seq"), "alpha": F.lit(0.1)}), window, grace)
    want = {(r.event_key, r.deploy_ref, r.window_start_ts): (r.n, r.f, r.l, r.t) for r in batch.groupBy("event_key", "deploy_ref", "window_start_ts").agg(F.count("*").alias("n"), F.sum((F.size("families") > 0).cast("int")).alias("f"), F.sum(F.col("late_arrival").cast("int")).alias("l"), F.max("ts").alias("t")).collect()}
    got = [r for r in streamed(spark, v, ["ts", "seq"], tmp_path, lambda d: st.closed_groups(d, window, grace)) if r.deploy_ref.startswith("d")]
    assert {(r.event_key, r.deploy_ref, r.window_start_ts): (r.n_verdicts, r.n_firing, r.n_late, r.last_ts) for r in got} == want and len(got) == len(want)
    assert {r.reason for r in got} == {"window_elapsed", "terminal_verdict"}
