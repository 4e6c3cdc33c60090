"""Family A: silenced ticks hold the state, ignored signals, cells and their fallback."""

import pytest
from pyspark.sql import functions as F

from sparkvigil.operators import evaluators as ea

CELLS = "ordinal int, hour int, day int, tier string, confidence string"
PAR = "ordinal int, signal string, mean double, variance double, phi double"
ROW = "deploy string, tick long, x double, y double, hour int, day int, tier string, schema string, ignored array<string>, traffic_pct double"


def run(spark, rows, cells=None, par=None, **more):
    c = spark.createDataFrame(cells or [(0, 3, None, None, "pooled")], CELLS)
    p = spark.createDataFrame(par or [(0, "x", 0.0, 1.0, 0.0), (0, "y", 0.0, 1.0, 0.0)], PAR)
    out = ea.family_verdicts(spark.createDataFrame(rows, ROW), ["deploy"], {"x": F.col("x"), "y": F.col("y")}, c, p, **more)
    return {(r.deploy, r.tick, r.signal): r for r in out.collect()}


def row(tick, x=2.0, y=None, hour=3, day=None, tier=None, schema=None, ignored=None, traffic=100.0, deploy="d"):
    return (deploy, tick, x, y, hour, day, tier, schema, ignored, traffic)


def test_a_silenced_deployment_starts_with_its_first_open_tick(spark):
    got = run(spark, [row(t, schema="breaking" if t < 5 else "extended") for t in range(7)], bake={"x": (0, 0, 1)})
    for t in range(5):
        r = got["d", t, "x"]
        assert (r.verdict, r.reason, r.n, r.statistic, r.threshold, r.alpha_consumed) == ("suppressed", "schema_continuity_breaking", 0, 1.0, None, 0.0) and ("d", t, "y") in got
    assert got["d", 5, "x"].n == 1 and got["d", 5, "x"].reason == "at_initial_wealth" and got["d", 6, "x"].n == 2 and ("d", 6, "y") not in got


def test_ignored_signals_hold(spark):
    got = run(spark, [row(t, y=1.0, ignored=["x"] if t % 2 else None) for t in range(8)])
    assert [got["d", t, "x"].n for t in range(8)] == [1, 1, 2, 2, 3, 3, 4, 4] and got["d", 7, "y"].n == 8
    assert {got["d", t, "x"].reason for t in (1, 3, 5)} == {"ignore_threshold"}
    assert run(spark, [row(0, x=None, ignored=["x", "y"])]).keys() == {("d", 0, "x"), ("d", 0, "y")}  # also without a value


@pytest.mark.parametrize("hour, day, tier, want", [(3, 1, "gold", 0), (3, 2, "gold", 1), (3, None, "gold", 0), (3, 1, "silver", 2), (3, 1, None, 2), (4, 1, "silver", 3), (5, 1, "gold", None), (None, 1, "gold", None)])
def test_cells(spark, hour, day, tier, want):
    cells = spark.createDataFrame([(0, 3, 1, "gold", "p"), (1, 3, None, "gold", "p"), (2, 3, None, "aggregate", "p"), (3, 4, None, None, "p"), (4, 4, 1, "silver", "p")], CELLS)
    df = spark.createDataFrame([(hour, day, tier)], "hour int, day int, tier string")
    assert ea.cell_of(df, cells).first().ordinal == want


def test_fallback_classes_and_gates(spark):
    cells = [(0, 3, None, "gold", "strict"), (1, 3, None, "aggregate", "none")]
    fallback = spark.createDataFrame([("x", 1.0, 4.0, 0.0, "heavy_tail", 3.0)], "signal string, mean double, variance double, phi double, signal_class string, threshold double")
    rows = [row(t, x=100.0, deploy=d, tier=tier, traffic=1.0 if t == 6 else 100.0) for d, tier in (("weak", "silver"), ("strong", "gold")) for t in range(9)]
    got = run(spark, rows, cells, [(0, "y", 0.0, 1.0, 0.0)], fallback=fallback, least_traffic=5.0)
    assert {k[0] for k in got} == {"weak"}  # the strict cell has no x, and no fallback
    assert got["weak", 6, "x"].reason == "traffic_pct_below_gate" and got["weak", 1, "x"].reason == "bake_profile_not_met" and got["weak", 6, "x"].n == 7
    fired = [t for t in range(9) if got["weak", t, "x"].verdict == "fire"]
    assert fired and all(got["weak", t, "x"].alpha_spent > 0 for t in fired) and got["weak", 8, "x"].threshold == 3.0
    assert got["weak", 8, "x"].alpha_consumed == pytest.approx(9 * 4e-4 / 6 / 2)
    assert not run(spark, [row(0, hour=None)]) and not run(spark, [])
