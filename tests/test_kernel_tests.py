"""Kernel statistics in blocks against plain versions on the whole stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvigil.functions import walks
from sparkvigil.operators import kernel_tests as kt
from sparkvigil.operators import matrix as mx

DIMS, BASE = ["a", "b"], 20


@pytest.fixture(scope="module")
def stream():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (140, 2)), rng.normal(1.5, 1, (160, 2))])
    return {"hot": x, "b": rng.normal(0, 1, (35, 2)), None: rng.normal(0, 2, (30, 2)), "short": x[:12]}


@pytest.fixture(params=[1 << 18, 23], ids=["one block", "many blocks"])
def split(request, monkeypatch, spark, stream):
    monkeypatch.setattr(walks, "BLOCK_ROWS", request.param)
    rows = [(k, i, *map(float, v)) for k, x in stream.items() for i, v in enumerate(x)] + [("hot", 1000, None, 1.0), ("hot", -1, 2.0, float("nan")), ("gone", 0, None, None)]
    df = spark.createDataFrame(rows, "key string, t long, a double, b double").repartition(4)
    first, live = kt.split_baseline(df, ["key"], ["t"], DIMS, BASE)
    return live, kt.baseline_pool(first, ["key"], ["t"], DIMS, BASE)


def collected(df, column):
    out = {}
    for r in df.orderBy("t").collect():
        out.setdefault(r.key, []).append(r[column])
    return out


def test_sliding_discrepancy(split, stream):
    live, pool = split
    got = collected(kt.sliding_mmd(live, pool, ["key"], ["t"], DIMS, 6, 1.3), "u")
    assert set(got) == {"hot", "b", None}
    for k, u in got.items():
        x, base = stream[k][BASE:], stream[k][:BASE]
        assert u[:5] == [None] * 5 and u[5:] == pytest.approx([mx.mmd_u(x[i - 5 : i + 1], base, 1.3) for i in range(5, len(x))])


def test_embedding_bets(split, stream):
    live, pool = split
    out = kt.embedding_verdicts(live, pool, ["key"], ["t"], DIMS, 0.05)
    for k, w in collected(out, "wealth").items():
        assert w == pytest.approx(mx.emmd_wealth(stream[k][BASE:], stream[k][:BASE], 1.0).tolist())
    assert collected(out, "verdict")["b"][:9] == ["suppressed"] * 9 and all(sum(s) in (0.0, 0.05) for s in collected(out, "alpha_spent").values())


def test_feature_witness(split, stream):
    live, pool = split
    out = kt.feature_witness_verdicts(live, pool, ["key"], ["t"], DIMS, 0.05)
    for k, s in collected(out, "log_s").items():
        fm = mx.feature_map(mx.cell_seed(f"cell-{k}"), 256, 2, 1.0)
        assert s == pytest.approx(mx.witness_betting(stream[k][BASE:], mx.features(stream[k][:BASE], fm).mean(0), fm).tolist())
    alarmed = collected(out, "alarmed")["hot"]
    assert alarmed == sorted(alarmed) and alarmed[-1]


def test_gated_rows_hold_the_state(split, stream):
    live, pool = split
    gated = live.withColumn("why", F.when(F.col("t") % 5 == 0, "traffic_pct_below_gate"))
    for f, column in ((kt.kernel_witness_verdicts, "log_s"), (kt.feature_witness_verdicts, "log_s"), (kt.embedding_verdicts, "wealth")):
        out = f(gated, pool, ["key"], ["t"], DIMS, 0.05, why="why").where("key is not null")
        plain = collected(f(live.where("t % 5 <> 0"), pool, ["key"], ["t"], DIMS, 0.05).where("key is not null"), column)
        got = collected(out.where("why is null"), column)
        assert got.keys() == plain.keys() and all(got[k] == pytest.approx(plain[k]) for k in plain)
        assert {r.verdict for r in out.where("why is not null").collect()} == {"suppressed"}


def test_numbered(spark, monkeypatch):
    monkeypatch.setattr(walks, "BLOCK_ROWS", 11)
    df = spark.range(300).select(F.when(F.col("id") % 10 > 0, "hot").alias("key"), (F.col("id") * 7919 % 300).alias("t"))
    from pyspark.sql import Window

    want = {(r.key, r.t): r.n for r in df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("t"))).collect()}
    assert {(r.key, r.t): r["rank"] for r in walks.numbered(df, ["key"], ["t"]).collect()} == want
    assert not walks.numbered(df.where("false"), ["key"], ["t"]).collect()
