"""Queries on tables as larger copies have them: keys past 2^20, samples of one second, wealth past the largest double."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkvigil.functions import scalar
from sparkvigil.operators import evaluators as ea
from sparkvigil.plans import catalog


def same(spark, path, name, *tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(path))
    want = c.sql(f"select {', '.join(df.columns)} from ({catalog.SQL[name]})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want) and want


def test_stream_keys_of_more_than_a_million_parts(spark, tmp_path):
    n = F.col("id") * 262_143 + F.when(F.col("id") > 9, (1 << 20) + 4095).otherwise(0)
    spark.range(40).select(n.alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    same(spark, tmp_path, "stream_keys", "part")
    with pytest.raises(Exception, match="trajectory out of range"):
        spark.range(1).select(scalar.stream_key(F.lit(1), F.lit(1), F.lit(1 << 20))).collect()


@pytest.mark.parametrize("name", ["bl_align_linear", "bl_align_hold"])
def test_aligned_samples_of_one_second(spark, tmp_path, name):
    """The last sample of a second counts before a grid point, the first after it."""
    rows = [(i, 86400 * (i // 3), i % 2, float(i * i)) for i in range(30)] + [(99, 50000, 2, 5.0), (98, 50000, 2, 7.0), (97, 50000, 2, 11.0)]
    e = spark.createDataFrame(rows, "event_id long, sec long, user_id long, value double").select("event_id", F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, 0, sec)").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value")
    e.write.parquet(f"{tmp_path}/events.parquet")
    same(spark, tmp_path, name, "events")


def test_log_wealth_of_the_safe_test_does_not_saturate(spark):
    """300 rows add 24.7 each: wealth is past the largest double, its logarithm goes on."""
    df = spark.range(300).select(F.lit(0).alias("cell"), F.col("id").alias("tick"), F.lit(11.0).alias("v"))
    got = ea.family_c_verdicts(df, ["cell"], ["v"], [F.lit(1.0)], {(0, 0): F.lit(1.0)}, 0.01, F.lit("safe_test"), F.lit(1.0), F.lit(0.5 * math.log(2)), 0.8)
    last = got.orderBy(F.desc("tick")).first()
    each = 0.5 * 100 - 0.25 * 100 - 0.5 * math.log(2)
    assert last.log_statistic == pytest.approx(300 * each) and last.statistic == pytest.approx(1.7976931348623157e308) and last.verdict == "fire"


def test_aligned_values_round_as_in_the_sql(spark, tmp_path):
    """66.6996875 is a double just below that tie."""
    rows = [(0, 0, 0, 1.0), (1, 34683, 1, 186.47), (2, 43931, 1, 56.42)]
    e = spark.createDataFrame(rows, "event_id long, sec long, user_id long, value double").select("event_id", F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, 0, sec)").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value")
    e.write.parquet(f"{tmp_path}/events.parquet")
    same(spark, tmp_path, "bl_align_linear", "events")


def test_binomial_tails_are_few(spark, tmp_path):
    """The tail is a fold of fifty terms: 400,000 parts share those of twelve remainders."""
    spark.range(400_000).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    df = catalog.QUERIES["fn_tails"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("aggregate(") > plan.index("Join")  # under the join, over the distinct remainders
    same(spark, tmp_path, "fn_tails", "part")
    got = spark.range(1).select(*(scalar.binomial_tail(F.lit(g).cast("bigint"), F.lit(k).cast("bigint"), F.lit(a)) for g, k, a in TAILS)).first()
    assert list(got) == [pytest.approx(sum(math.comb(g, i) * a**i * (1 - a) ** (g - i) for i in range(max(k, 0), g + 1)), rel=1e-9) for g, k, a in TAILS]


TAILS = [(50, 3, 0.05), (50, 0, 0.05), (50, 50, 0.3), (200, 90, 0.3), (5, -1, 0.5), (1, 1, 0.2)]
