"""Row walks and composed jumps against plain loops, with keys of all sizes and small blocks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkvigil.functions import walks
from sparkvigil.operators import fleet, grouping, topology


def test_row_walk_keeps_other_columns_and_null_keys(spark):
    big = (1 << 60) + 1
    rows = [(k, i, v, big if i else None) for k in (None, 3) for i, v in enumerate([1.0, None, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "series long, tick long, value double, other long")
    out = walks.row_walk(df, ["series"], ["tick"], ["value"], lambda: 0, lambda n, v: (n + (v is not None), (n,)), "n long")
    assert sorted((r.series or 0, r.tick, r.n, r.other or 0) for r in out.collect()) == sorted((k or 0, i, n, big if i else 0) for k in (None, 3) for i, n in enumerate([0, 1, 1, 2, 3]))


def keyed(rows, r):
    """Rows as (key, tick), most of them of one key."""
    return [("hot" if r.random() < 0.8 else r.choice(["a", "b", None]), t) for t in rows]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(walks, "BLOCK_ROWS", 40)


@pytest.mark.parametrize("seed, cooldown", [(1, 0), (2, 7), (3, 60), (4, 900)])
def test_cooldown_in_blocks(spark, small_blocks, seed, cooldown):
    r = random.Random(seed)
    rows = keyed(sorted(r.sample(range(2000), 400)), r)
    want, last = [], {}
    for k, t in rows:
        if k not in last or t > last[k] + cooldown:
            last[k] = t
            want.append((k or "", t))
    df = spark.createDataFrame([*rows, ("hot", None)], "key string, tick long").repartition(3)
    assert sorted((x.key or "", x.tick) for x in fleet.cooled(df, ["key"], cooldown).collect()) == sorted(want)


@pytest.mark.parametrize("seed, window, threshold, cooldown", [(1, 150, 4, 150), (2, 20, 3, 5), (3, 10, 1, 30), (4, 40, 6, 0), (5, 30, 4, 400)])
def test_lifecycle_in_blocks(spark, small_blocks, seed, window, threshold, cooldown):
    r = random.Random(seed)
    rows = keyed(sorted(r.sample(range(-100, 1900), 500)), r)
    want, state = {}, defaultdict(lambda: ([], 0))
    for k, t in rows:
        alarms, until = state[k]
        alarms = [a for a in alarms if a > t - window] + [t]
        want[k, t] = t >= until and len(alarms) >= threshold
        state[k] = ([], t + cooldown) if want[k, t] else (alarms, until)
    out = fleet.lifecycle(spark.createDataFrame(rows, "key string, tick long").repartition(3), ["key"], window, threshold, cooldown)
    assert {(x.key, x.tick): x.record for x in out.collect()} == want and any(want.values())


@pytest.mark.parametrize("seed, window, grace, ends", [(1, 300, 60, 0.05), (2, 30, 60, 0.3), (3, 5, 0, 0.5), (4, 900, 900, 0.01), (5, 100, 10, 0.0)])
def test_groups_in_blocks(spark, small_blocks, seed, window, grace, ends):
    r = random.Random(seed)
    rows = [(k, t, i, r.random() < ends) for i, (k, t) in enumerate(keyed(sorted(r.choices(range(3000), k=500)), r))]
    want, state = {}, {}
    for k, t, seq, end in rows:
        first, at, closed = state.get(k, (None, None, None))
        if first is None and at is not None and t - at <= grace:
            want[seq] = (closed, True)
            continue
        if first is not None and t - first > window:
            first = None
        group = t if first is None else first
        want[seq] = (group, False)
        state[k] = (None, t, group) if end else (group, None, None)
    df = spark.createDataFrame([(k, "d", t, s, s, e, ["A"], 0.1) for k, t, s, e in rows] + [("hot", "d", None, 9999, 0, True, ["A"], 0.1), ("new", "d", 5, 10000, 0, None, ["A"], 0.1)], "cluster_event_id string, deploy_ref string, ts long, seq long, tick long, terminal boolean, families array<string>, alpha double")
    got = {x.seq: (x.window_start_ts, x.late_arrival) for x in grouping.assigned(df.repartition(3), window, grace).collect()}
    assert got.pop(9999) == (None, None) and got.pop(10000) == (5, False) and got == want


def test_a_hot_key_is_many_tasks(spark, small_blocks):
    df = spark.range(1000).select(F.lit("hot").alias("key"), F.col("id").alias("tick"))
    out = fleet.cooled(df, ["key"], 3)
    assert out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count() > 1 and out.count() == 250


def test_no_rows(spark):
    df = spark.createDataFrame([], "key string, tick long")
    assert not fleet.cooled(df, ["key"], 3).collect() and not fleet.lifecycle(df, ["key"]).collect()


def test_point_intervals_share_nothing(spark):
    cases = [((5, 5, 5, 5), 0.0), ((0, 10, 0, 10), 1.0), ((0, 10, 5, 15), 1 / 3), ((0, 10, 4, None), 1.0)]
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in c) for c, _ in cases], "a double, b double, c double, d double")
    assert [r.v for r in df.select(topology.overlap(*map(F.col, "abcd")).alias("v")).collect()] == pytest.approx([w for _, w in cases])


@pytest.mark.parametrize("window, threshold, cooldown", [(5, 2, 7), (3, 1, 0), (10, 6, 40), (0, 1, 5), (4, 0, 5)])
def test_smoothing_with_cooldown(spark, small_blocks, window, threshold, cooldown):
    from sparkvigil.operators import replay

    r = random.Random(window)
    rows = [(k, t, r.random() < 0.4) for k in ("hot", None) for t in range(0, 300 if k else 30, 1 if k else 3)]
    want = {}
    for k in ("hot", None):
        mine, until = [(t, f) for key, t, f in rows if key == k], -1
        for i, (t, f) in enumerate(mine):
            if window <= 0 or threshold <= 0:
                want[k, t] = f
                continue
            n = sum(x for _, x in mine[max(0, i + 1 - window) : i + 1])
            want[k, t] = t > until and n >= threshold
            until = t + cooldown if want[k, t] else until
    out = replay.likelihood_smoothed(spark.createDataFrame(rows, "key string, tick long, fire boolean"), ["key"], window, threshold, cooldown)
    assert {(x.key, x.tick): x.fire for x in out.collect()} == want
    with pytest.raises(ValueError):
        replay.likelihood_smoothed(out, ["key"], 2, 3, 1)


@pytest.mark.parametrize("rows", [2, 7, 1 << 18])
def test_lags_of_many_keys_together(spark, monkeypatch, rows):
    """As SQL's lag, with keys that are shorter than a block, or go over several; null keys are keys."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    monkeypatch.setattr(walks, "BLOCK_ROWS", rows)
    data = [(k, t, float(t * t + len(str(k)))) for k, n in (("a", 1), ("b", 30), (None, 9), ("c", 2), ("d", 3), ("e", 11)) for t in range(n)]
    df = spark.createDataFrame(data, "key string, tick long, v double").repartition(3)
    w = Window.partitionBy("key").orderBy("tick")
    want = df.withColumns({f"_l{i}": F.lag("v", i).over(w) for i in (1, 2, 3)})
    got = walks.lagged(df, ["key"], ["tick"], "v", 3)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert walks.lagged(df.where("false"), ["key"], ["tick"], "v", 3).count() == 0
