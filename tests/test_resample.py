"""Draws of a table: the same for any partitioning, with the law's moments and exact ranks."""

import math

import pytest
from pyspark.sql import functions as F

from sparkvigil.operators import resample as rs


def test_weights_have_their_law(spark):
    w = spark.range(20_000).select(rs.poisson(rs.uniform(F.col("id"), F.lit(3), 1)).alias("w")).groupBy("w").count().collect()
    n = {r.w: r["count"] for r in w}
    assert all(abs(n.get(k, 0) / 20_000 - math.exp(-1) / math.factorial(k)) < 0.01 for k in range(5)) and abs(sum(k * c for k, c in n.items()) / 20_000 - 1) < 0.03


def test_same_draws_for_any_partitioning(spark):
    df = spark.range(900).select(F.when(F.col("id") % 9 > 0, "hot").alias("key"), "id", F.sin("id").alias("v"))
    df = df.unionByName(spark.createDataFrame([("hot", 5000, None), ("hot", None, 1.0), ("hot", 5001, float("nan")), ("one", 7000, 2.5)], "key string, id long, v double"))
    runs = [sorted(((r.key, r.draw, r.n, round(r["mean"], 9)) for r in rs.across_draws(df.repartition(p), ["key"], "id", "v", 30).collect()), key=str) for p in (1, 13)]
    assert runs[0] == runs[1] and {r[1] for r in runs[0] if r[0] == "hot"} == set(range(31))
    limits = {r.key: r for r in rs.nearest_rank(rs.across_draws(df, ["key"], "id", "v", 30), ["key"], {"low": 0.1, "high": 0.9, "least": 0.0}).collect()}
    for key in ("hot", None):
        means = sorted(r[3] for r in runs[0] if r[0] == key and r[1])
        got = limits[key]
        assert (got.n_draws, round(got.low, 9), round(got.high, 9), round(got.least, 9)) == (30, means[2], means[26], means[0])
        assert round(got.plain, 9) == next(r[3] for r in runs[0] if r[0] == key and not r[1])
    one = limits["one"]
    assert one.n_draws < 30 and one.low == one.high == one.plain == 2.5
    with pytest.raises(ValueError):
        rs.across_draws(df, ["key"], "id", "v", 0)
    assert not rs.nearest_rank(rs.across_draws(df.where("false"), ["key"], "id", "v", 3), ["key"], {"low": 0.1}).collect()


def test_counts_from_digits_in_even_tasks(spark, monkeypatch):
    """Counts from the digits are those of the uniform numbers; a table in one partition is many tasks."""
    d = spark.range(3000).select(rs.poisson(rs.uniform(F.col("id"), F.lit(2), 5)).alias("a"), rs.poisson_of(rs.digest(F.col("id"), F.lit(2), 5)).alias("b"))
    edge = spark.createDataFrame([(f"{x:08x}{tail}", x) for p in rs.cumulative() for x in (min((1 << 32) - 1, math.ceil(p * 2**32) + i) for i in (-1, 0, 1)) for tail in ("0" * 24, "f" * 24)], "h string, x long")
    d = d.unionByName(edge.select(rs.poisson(F.col("x") / 4294967296.0).alias("a"), rs.poisson_of(F.col("h")).alias("b")))
    assert d.where("a <> b or a is null or b is null").count() == 0
    monkeypatch.setattr(rs, "TASK", 1 << 10)
    df = spark.range(1000, numPartitions=1).select(F.lit("k").alias("key"), "id", F.lit(1.0).alias("v"))
    plan = rs.across_draws(df, ["key"], "id", "v", 20)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("md5") == 1
