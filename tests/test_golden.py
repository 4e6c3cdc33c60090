"""Hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from sparkvigil.functions import scalar
from sparkvigil.functions.windows import reflected_walk
from sparkvigil.operators import detectors, evidence, fleet, ingest


def one(spark, **cols):
    return spark.createDataFrame([tuple(float(v) for v in cols.values())], ", ".join(f"{c} double" for c in cols))


def value(df, col):
    return df.select(col.alias("v")).first().v


def test_energy_of_small_blocks(spark):
    ref = spark.createDataFrame([(1, float(x)) for x in (0, 1, 2, 4)], "k int, x double")
    blocks = [(0, 1, 2, 4), (1, 2, 3, 6), (0, 0, 1, 1), (2, 4, 6, 8)]
    live = spark.createDataFrame([(1, i, float(x)) for i, b in enumerate(blocks) for x in b], "k int, block long, x double")
    got = {r.block: r.energy for r in detectors.energy_statistic(live, ref, ["k"], "x").collect()}
    assert got == pytest.approx({0: 13 / 8, 1: 9 / 4, 2: 5 / 2, 3: 9 / 2})


def test_reflected_walk_hits_its_floor_and_holds_nan(spark):
    steps = [1.0, -5.0, float("nan"), 2.0, -0.5]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(steps)], "k int, tick int, z double")
    level, want = 0.0, []
    for x in steps:
        level = level if math.isnan(x) else max(-2.0, level + x)
        want.append(level)
    got = [r.w for r in reflected_walk(df, "z", ["k"], -2.0, "w").orderBy("tick").collect()]
    assert got == pytest.approx(want)


def test_scalars(spark):
    d = one(spark, x=0.25)
    assert value(d, scalar.logit(F.col("x"))) == pytest.approx(math.log(1 / 3))
    assert value(d, scalar.log_gamma(F.col("x"))) == pytest.approx(math.lgamma(0.25), abs=1e-9)
    assert value(d, scalar.normal_quantile(F.lit(0.975))) == pytest.approx(1.96, abs=5e-4)
    assert value(d, scalar.binomial_tail(F.lit(3).cast("bigint"), F.lit(2).cast("bigint"), F.lit(0.5))) == pytest.approx(0.5)
    assert value(d, scalar.wealth(F.lit(800.0))) == scalar.MAX_DOUBLE
    assert value(d, scalar.gaussian_mixture(F.lit(0.0), F.lit(3.0), F.lit(1.0), F.lit(1.0))) == pytest.approx(0.5)


def test_counter_rules(spark):
    rows = [(0, 100.0, 0.0), (1, 160.0, 10.0), (2, 160.0, 10.0), (3, 50.0, 20.0), (4, 4294967290.0, 30.0), (5, 4.0, 40.0), (6, 5.0, 100.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, arrival int, value double, ts double")
    out = {r.arrival: r for r in ingest.counter_rate(df, ["k"], 10.0).collect()}
    assert out[1].rate == 6 and out[2].nonpositive_elapsed and out[2].rate is None and out[3].reset and out[3].rate is None
    assert out[5].wrapped and out[5].rate == 1.0 and out[6].missed_scrape and out[6].slope_quality == "degraded" and out[4].slope_quality == "normal"


def test_e_bh_ties_and_none(spark):
    df = spark.createDataFrame([("a", i, e) for i, e in enumerate([40.0, 40.0, 1.0, 0.0])] + [("b", 0, 1.0)], "f string, idx int, e double")
    got = {(r.f, r.idx): (r.rank, r.selected) for r in fleet.e_bh(df, ["f"], 0.1).collect()}
    assert got[("a", 0)] == (1, True) and got[("a", 1)] == (2, True) and not got[("a", 2)][1] and not got[("b", 0)][1]


def test_refused_evidence(spark):
    df = spark.createDataFrame([("safe_t_e_value", 0.5, 50), ("safe_t_e_value", None, 50), ("nuisance_robust_bf_e_value", 0.1, 500), ("made_up", 0.0, 10)], "detector_id string, phi double, cal_len int")
    assert sorted((r.detector_id, r.admissible) for r in evidence.admissible(df).collect()) == [("made_up", False), ("nuisance_robust_bf_e_value", False), ("safe_t_e_value", False), ("safe_t_e_value", True)]


def test_lil_constant():
    c = detectors.lil_constant(0.05)
    assert 0 < c < 60 and detectors.lil_constant(0.01) > c


def test_schema_null_is_not_empty(spark):
    kind = "struct<signal_name:string,unit:string,semantic_type:string,granularity:string,quantile_list:array<double>,bucket_boundaries:array<double>,label_keys:array<string>,trace_span_names:array<string>,trace_attribute_keys:array<string>>"
    base = ("s", "ms", "gauge", "host", None, None, ["a"], None, None)
    df = spark.createDataFrame([(1, base, base), (2, base, (*base[:4], [], *base[5:])), (3, base, (*base[:6], ["b", "a"], None, None)), (4, base, (*base[:6], ["b"], None, None))], f"i int, b {kind}, o {kind}")
    got = {r.i: r.c for r in df.select("i", ingest.schema_continuity("b", "o").alias("c")).collect()}
    assert got == {1: "continuous", 2: "breaking", 3: "extended", 4: "breaking"}
