"""Streams give what the batch operators give."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkvigil.operators import detectors, fleet, grouping, ingest
from sparkvigil.plans.views import calibrated, series
from sparkvigil.streaming import stateful as st

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, df, order, tmp_path, make):
    """Runs `make` over df as a stream of three files, one each trigger."""
    src = str(tmp_path / "in")
    rows = df.count()
    for i in range(3):
        part = df.withColumn("_r", F.row_number().over(Window.orderBy(*order))).where((F.col("_r") > i * rows // 3) & (F.col("_r") <= (i + 1) * rows // 3)).drop("_r")
        part.coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    q = make(stream).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("out").collect()


def test_counters(spark, sf_dir, tmp_path):
    s = series(spark, sf_dir).select("series", F.col("tick").alias("arrival"), F.col("sec").cast("double").alias("ts"), (F.col("value") * 2e7).alias("value"))
    want = {(r.series, r.arrival): (r.rate, r.elapsed, r.wrapped, r.reset) for r in ingest.counter_rate(s, ["series"], 60.0).collect()}
    got = {(r.series, r.arrival): (r.rate, r.elapsed, r.wrapped, r.reset) for r in streamed(spark, s, ["arrival", "series"], tmp_path, lambda d: st.stateful(d, ["series"], st.CounterRates))}
    assert got == want


def test_betting_and_mixture(spark, sf_dir, tmp_path):
    r = spark.createDataFrame(calibrated(spark, sf_dir).select("series", "tick", "x", "mean", "variance", "phi").toPandas())
    last = {}
    for row in streamed(spark, r, ["tick", "series"], tmp_path, lambda d: st.stateful(d, ["series"], st.Betting)):
        last[row.series] = max(last.get(row.series, (-1, 0)), (row.tick, row.log_m))
    for row in detectors.betting(r, ["series"], 0.05, "x").collect():
        assert abs(last[row.series][1] - row.log_m) < 1e-9


def test_mixture(spark, sf_dir, tmp_path):
    r = spark.createDataFrame(calibrated(spark, sf_dir).select("series", "tick", "x", "mean", "variance", "phi").toPandas())
    want = {(w.series, w.tick): (w.m, w.fired) for w in detectors.mixture(r, ["series"], 0.05, value="x").collect()}
    got = streamed(spark, r, ["tick", "series"], tmp_path, lambda d: st.stateful(d, ["series"], st.Mixture))
    assert len(got) == len(want)
    for g in got:
        m, fired = want[g.series, g.tick]
        assert abs(g.log_m - math.log(m)) < 1e-8 and g.fired == fired


def test_tiers_and_groups(spark, sf_dir, tmp_path):
    s = series(spark, sf_dir).withColumn("seed", (F.col("value") > 490).cast("string")).select("series", "tick", "seed")
    want = {(r.series, r.tick): (r.n_samples, r.confidence) for r in fleet.confidence_tiers(s, ["series"]).collect()}
    got = {(r.series, r.tick): (r.n_samples, r.confidence) for r in streamed(spark, s, ["tick", "series"], tmp_path, lambda d: st.stateful(d, ["series"], st.Tiers))}
    assert got == want


def test_groups(spark, sf_dir, tmp_path):
    s = series(spark, sf_dir)
    v = s.select(F.col("event_id").alias("seq"), F.col("series").cast("string").alias("deploy_ref"), F.lit("e").alias("cluster_event_id"), F.col("sec").alias("ts"), "tick", (F.col("value") > 300).alias("terminal"), F.array(F.lit("A")).alias("families"), F.lit(0.1).alias("alpha"))
    want = {r.seq: (r.window_start_ts, r.late_arrival) for r in grouping.assigned(v, 400000, 40000).collect()}
    d = v.withColumn("event_key", F.col("cluster_event_id")).select("event_key", "deploy_ref", "seq", "ts", "terminal")
    got = {r.seq: (r.window_start_ts, r.late_arrival) for r in streamed(spark, d, ["ts", "seq"], tmp_path, lambda x: st.stateful(x, ["event_key", "deploy_ref"], st.Groups, window_s=400000, grace_s=40000))}
    assert got == want


def test_windowed_counts(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    got = streamed(spark, e, ["ts"], tmp_path, lambda d: st.windowed_counts(d, "1 day", "1 hour"))
    want = {(r[0], r.event_type): r.n for r in e.groupBy(F.date_trunc("day", "ts"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[g.window.start, g.event_type] == g.n for g in got)
