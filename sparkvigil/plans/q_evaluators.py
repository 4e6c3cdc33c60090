"""Queries of the evaluators: tick-wise verdicts with gates and reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import baselines as bl
from ..operators import detectors as dt
from ..operators import evaluators as ea
from ..operators import scoring as sc
from ..operators.ingest import gate
from .q_detectors import QUERIES as _Q
from .q_detectors import SQL as _S
from .registry import registry, rounded
from .views import CALIBRATED, SERIES, VECTORS, calibrated, series, table, vectors

QUERIES, SQL, query = registry()

_FOLD = _S["betting_e_process"].split("\nSELECT series, round(lm, 6)")[0]
assert "betting_e_process" in _Q


@query(f"""{_FOLD}, v AS (SELECT f.*, o.tick FROM f JOIN o USING (series, i)) SELECT series, tick, round(lm, 6) AS log_m,
CASE WHEN tick < 25 OR n < 8 THEN 'suppressed' WHEN series % 5 = 0 THEN 'suppressed' WHEN lm >= ln(20) THEN 'fire' WHEN lm > 0 THEN 'indeterminate' ELSE 'clean' END AS verdict,
CASE WHEN tick < 25 OR n < 8 THEN 'bake_profile_not_met' WHEN series % 5 = 0 THEN 'traffic_pct_below_gate' WHEN lm >= ln(20) THEN 'betting_wealth_exceeded_threshold' WHEN lm > 0 THEN 'accumulating' ELSE 'at_initial_wealth' END AS reason FROM v""")
def betting_verdicts(spark, sf):
    r = calibrated(spark, sf).withColumn("traffic_pct", F.when(F.col("series") % 5 == 0, 5.0).otherwise(50.0))
    out = ea.betting_verdicts(r, ["series"], 0.05, "x", bake=(25, 8, 30), least_traffic=10.0)
    return rounded(out, "log_m").select("series", "tick", "log_m", "verdict", "reason")


#: Twenty hours with a cell of the tier gold and one of all tiers each; four hours have none.
_CELLS = """cells AS (SELECT i AS ordinal, i // 2 AS hour, CASE WHEN i % 2 = 0 THEN 'gold' ELSE 'aggregate' END AS tier, CASE WHEN i % 2 = 1 AND i // 2 % 5 = 0 THEN 'aggregate' ELSE 'pooled' END AS confidence FROM range(40) t(i)),
par AS (SELECT ordinal, 'p99_latency' AS signal, 5.0::DOUBLE + ordinal % 3 AS mean, 2.0::DOUBLE + ordinal % 2 AS variance, 0.1::DOUBLE * (ordinal % 2) AS phi, true AS log, 1 / 0.05::DOUBLE AS threshold FROM cells
  UNION ALL SELECT ordinal, 'ttft', 200.0, 9000.0, 0.0, false, 20.0 FROM cells WHERE ordinal % 4 <> 1 UNION ALL SELECT ordinal, 'ttft', 250.0, 20000.0, 0.0, false, 5.0 FROM cells WHERE ordinal % 4 = 1 AND confidence = 'aggregate')"""
_FAMILY = f"""WITH RECURSIVE {SERIES}, {_CELLS},
w AS (SELECT series, tick, value, event_type, sec // 3600 % 24 AS hour, CASE series % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' ELSE 'aggregate' END AS tier, series % 11 = 0 AND tick BETWEEN 5 AND 8 AS silent, series % 7 = 0 AND tick % 6 = 2 AS ig FROM s),
c AS (SELECT w.*, coalesce(a.ordinal, b.ordinal) AS ordinal FROM w LEFT JOIN cells a ON a.hour = w.hour AND a.tier = w.tier LEFT JOIN cells b ON b.hour = w.hour AND b.tier = 'aggregate'),
e AS (SELECT series, tick, ordinal, silent, 'p99_latency' AS signal, CASE WHEN event_type <> 'error' THEN value END AS raw, false AS ig, true AS judged FROM c
  UNION ALL SELECT series, tick, ordinal, silent, 'ttft', value, ig, true FROM c UNION ALL SELECT series, tick, ordinal, silent, 'cost_req', NULL, false, false FROM c),
k AS (SELECT e.*, mean, variance, phi, threshold, CASE WHEN log THEN ln(greatest(raw, 1e-9)) ELSE raw END AS x, NOT silent AND NOT ig AS moves FROM e LEFT JOIN par USING (ordinal, signal) WHERE silent OR judged AND ordinal IS NOT NULL AND (ig OR mean IS NOT NULL AND raw IS NOT NULL)),
n AS (SELECT *, sum(moves::INT) OVER (PARTITION BY series, signal ORDER BY tick) AS i FROM k), o AS (SELECT * FROM n WHERE moves),
f(series, signal, i, lm, bet, n, mu, m2, lst) AS (SELECT series, signal, 0::HUGEINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM (SELECT DISTINCT series, signal FROM n)
UNION ALL SELECT series, signal, i, greatest(ln(1e-12::DOUBLE), lm + ln(greatest(1 + nb * z, 1e-320))), nb, n + 1, mu + (z - mu) / (n + 1), m2 + (z * z - m2) / (n + 1), c FROM (
  SELECT *, CASE WHEN abs(raw) <= 0.999999 THEN raw ELSE CASE WHEN m2 > 0 AND abs(1 + bet * mu) >= 1e-9 THEN greatest(-0.999999::DOUBLE, least(0.999999::DOUBLE, bet + mu / (1 + bet * mu) / greatest(m2, 1e-6))) ELSE 0 END END AS nb FROM (
  SELECT f.series, f.signal, o.i, f.lm, f.bet, f.n, f.mu, f.m2, o.x - o.mean AS c, greatest(-1::DOUBLE, least(1::DOUBLE, (o.x - o.mean - o.phi * f.lst) / (3 * sqrt(o.variance)))) AS z, CASE WHEN f.m2 > 0 THEN f.mu / f.m2 ELSE 0 END AS raw FROM f JOIN o ON o.series = f.series AND o.signal = f.signal AND o.i = f.i + 1)))"""


@query(f"""{_FAMILY}, v AS (SELECT n.*, lm, CASE WHEN silent THEN 'schema_continuity_breaking' WHEN ig THEN 'ignore_threshold' WHEN tick < 3 OR f.n < CASE n.signal WHEN 'ttft' THEN 5 ELSE 3 END THEN 'bake_profile_not_met' END AS why FROM n JOIN f ON f.series = n.series AND f.signal = n.signal AND f.i = n.i)
SELECT series, tick, signal, round(lm, 6) AS log_m, round(0.05::DOUBLE * i, 6) AS alpha_consumed, CASE WHEN moves THEN threshold END AS threshold, CASE WHEN why IS NOT NULL THEN 'suppressed' WHEN exp(lm) >= threshold THEN 'fire' WHEN lm > 0 THEN 'indeterminate' ELSE 'clean' END AS verdict,
coalesce(why, CASE WHEN exp(lm) >= threshold THEN 'betting_wealth_exceeded_threshold' WHEN lm > 0 THEN 'accumulating' ELSE 'at_initial_wealth' END) AS reason FROM v""")
def family_betting_verdicts(spark, sf):
    """Two judged signals and a listed one per series and tick, with cells by hour and tier, ignored signals and schema changes that hold the state."""
    k, tick = F.col("series"), F.col("tick")
    rows = series(spark, sf).select(
        "series", "tick", "value", "event_type", F.floor(F.col("sec") / 3600 % 24).cast("int").alias("hour"), F.lit(None).cast("int").alias("day"), F.when(k % 3 == 0, "gold").when(k % 3 == 1, "silver").alias("tier"),
        F.when((k % 11 == 0) & tick.between(5, 8), "breaking").alias("schema"), F.when((k % 7 == 0) & (tick % 6 == 2), F.array(F.lit("ttft"))).otherwise(F.array().cast("array<string>")).alias("ignored"),
    )
    i = F.col("ordinal")
    cells = spark.range(40).select(F.col("id").alias("ordinal"), F.floor(F.col("id") / 2).cast("int").alias("hour"), F.lit(None).cast("int").alias("day"), F.when(F.col("id") % 2 == 0, "gold").otherwise("aggregate").alias("tier"), F.when((F.col("id") % 2 == 1) & (F.floor(F.col("id") / 2) % 5 == 0), "aggregate").otherwise("pooled").alias("confidence"))
    told = lambda df, signal, mean, variance, phi, cls: df.select("ordinal", F.lit(signal).alias("signal"), mean.cast("double").alias("mean"), variance.cast("double").alias("variance"), phi.cast("double").alias("phi"), F.lit(cls).cast("string").alias("signal_class"))
    parameters = told(cells, "p99_latency", 5 + i % 3, 2 + i % 2, 0.1 * (i % 2), "heavy_tail").unionByName(told(cells.where(i % 4 != 1), "ttft", F.lit(200), F.lit(9000), F.lit(0), None))
    fallback = spark.createDataFrame([("ttft", 250.0, 20000.0, 0.0, 5.0)], "signal string, mean double, variance double, phi double, threshold double")
    signals = {"p99_latency": F.when(F.col("event_type") != "error", F.col("value")), "ttft": F.col("value")}
    out = ea.family_verdicts(rows, ["series"], signals, cells, parameters, fallback, 0.2, 2, listed=["p99_latency", "ttft", "cost_req"], bake={"ttft": (3, 5, 1)})
    return rounded(out, "log_m", "alpha_consumed").select("series", "tick", "signal", "log_m", "alpha_consumed", "threshold", "verdict", "reason")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'chi_square' WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 'safe_test' ELSE 'chi_square' END ELSE 'chi_square' END AS variant FROM orders""")
def hotelling_variants(spark, sf):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, "chi_square").when(k % 4 == 1, "safe_test")
    return table(spark, sf, "orders").select("o_orderkey", ea.hotelling_variant(raw, k % 3 == 0, k % 2 == 1).alias("variant"))


@query(f"""WITH {VECTORS}, c AS (SELECT cell, avg(v1) AS m1, avg(v2) AS m2, 1.0 AS one FROM v GROUP BY cell),
r AS (SELECT v.vec_id, CASE WHEN abs(m1) > 1e-12 THEN (v1 - m1) / m1 ELSE v1 - m1 END AS a, CASE WHEN abs(m2) > 1e-12 THEN (v2 - m2) / m2 ELSE v2 - m2 END AS b FROM v JOIN c USING (cell)),
s AS (SELECT vec_id, a * a / 100 + b * b / 400 AS t2 FROM r) SELECT vec_id, round(t2, 6) AS statistic, CASE WHEN vec_id % 10 = 3 THEN 'suppressed' WHEN t2 >= lim THEN 'fire' ELSE 'clean' END AS verdict,
CASE WHEN vec_id % 10 = 3 THEN 'bake_profile_not_met' WHEN t2 >= lim THEN 'statistic_exceeded_threshold' ELSE 'within_threshold' END AS reason
FROM s, (SELECT 6.0::DOUBLE AS lim) z""")
def hotelling_verdicts(spark, sf):
    v = vectors(spark, sf)
    c = v.groupBy("cell").agg(F.avg("v1").alias("m1"), F.avg("v2").alias("m2"))
    why = gate(F.lit(None).cast("string"), F.when(F.col("vec_id") % 10 == 3, 0).otherwise(9), F.lit(9), F.lit(0), F.lit(1.0))
    cov = {(0, 0): F.lit(100.0), (0, 1): F.lit(0.0), (1, 1): F.lit(400.0)}
    out = ea.hotelling_verdicts(v.join(c, "cell"), ["v1", "v2"], [F.col("m1"), F.col("m2")], cov, 0.01, True, why, F.lit(6.0))
    return rounded(out, "statistic").select("vec_id", "statistic", "verdict", "reason")


@query(f"""WITH {VECTORS}, c AS (SELECT cell, avg(v1) AS m1, avg(v2) AS m2 FROM v GROUP BY cell), r AS (SELECT v.vec_id, cell, CASE WHEN abs(m1) > 1e-12 THEN (v1 - m1) / m1 ELSE v1 - m1 END AS a, CASE WHEN abs(m2) > 1e-12 THEN (v2 - m2) / m2 ELSE v2 - m2 END AS b FROM v JOIN c USING (cell)),
t AS (SELECT *, a * a / 100 + b * b / 400 AS t2, a * a / 150 + b * b / 450 AS u2, vec_id % 10 = 3 AS held, cell % 2 = 0 AS safe FROM r), z AS (SELECT *, CASE WHEN held THEN 0 ELSE 0.5::DOUBLE * t2 - 0.5::DOUBLE * u2 - 0.5::DOUBLE * ln(150 * 450 / 40000.0::DOUBLE) END AS z FROM t WHERE safe),
zc AS (SELECT *, sum(z) OVER (PARTITION BY cell ORDER BY vec_id) AS cs FROM z), zl AS (SELECT *, cs + greatest(0, max(-690.7755278982137::DOUBLE - cs) OVER (PARTITION BY cell ORDER BY vec_id)) AS lm FROM zc),
zf AS (SELECT *, NOT held AND lm >= ln(1.25::DOUBLE) AS fire FROM zl)
SELECT vec_id, 'safe_test' AS variant, round(lm, 6) AS log_statistic, CASE WHEN held THEN 'suppressed' WHEN fire THEN 'fire' ELSE 'clean' END AS verdict, CASE WHEN held THEN 'bake_profile_not_met' WHEN fire THEN 'safe_hotelling_wealth_exceeded' ELSE 'below_threshold' END AS reason,
CASE WHEN fire AND sum(fire::INT) OVER (PARTITION BY cell ORDER BY vec_id) = 1 THEN 0.8 ELSE 0 END::DOUBLE AS alpha_spent FROM zf
UNION ALL SELECT vec_id, 'chi_square', round(ln(t2), 6), CASE WHEN held THEN 'suppressed' WHEN t2 >= 6 THEN 'fire' ELSE 'clean' END, CASE WHEN held THEN 'bake_profile_not_met' WHEN t2 >= 6 THEN 'statistic_exceeded_threshold' ELSE 'within_threshold' END, NULL FROM t WHERE NOT safe""")
def family_c_verdicts(spark, sf):
    """Cells of even labels run the safe test, the others, which lack its parameters or ask for it, chi-square; every tenth vector is behind a gate."""
    v = vectors(spark, sf)
    c = v.groupBy("cell").agg(F.avg("v1").alias("m1"), F.avg("v2").alias("m2"))
    why = gate(F.lit(None).cast("string"), F.when(F.col("vec_id") % 10 == 3, 0).otherwise(9), F.lit(9), F.lit(0), F.lit(1.0))
    cov = {(0, 0): F.lit(100.0), (0, 1): F.lit(0.0), (1, 1): F.lit(400.0)}
    even = F.col("cell") % 2 == 0
    asked = F.when(F.col("cell") % 3 > 0, "safe_test").when(even, "safe_test")
    shrink = F.when(even, 0.5 * F.log(F.lit(150 * 450 / 40000.0)))
    out = ea.family_c_verdicts(v.join(c, "cell"), ["cell"], ["v1", "v2"], [F.col("m1"), F.col("m2")], cov, 0.01, asked, F.when(even, 50.0), shrink, 0.8, True, why, F.lit(6.0), by="vec_id")
    return rounded(out, "log_statistic").select("vec_id", "variant", "log_statistic", "verdict", "reason", "alpha_spent")


@query(f"""WITH {SERIES}, c AS (SELECT series, abs(x) AS sc FROM s WHERE tick < 40), n AS (SELECT series, count(*) AS n FROM c GROUP BY series), q AS (SELECT series, tick, abs(x) AS sc FROM s WHERE tick >= 40),
p AS (SELECT q.series, q.tick, (1 + count(c.sc))::DOUBLE / (first(n.n) + 1) AS p FROM q JOIN n ON n.series = q.series LEFT JOIN c ON c.series = q.series AND c.sc >= q.sc GROUP BY q.series, q.tick)
SELECT series, tick, CASE WHEN series % 7 = 0 THEN 'suppressed' WHEN p < 0.05 THEN 'fire' ELSE 'clean' END AS verdict, CASE WHEN series % 7 = 0 THEN 'schema_continuity_breaking' WHEN p < 0.05 THEN 'conformal_p_below_alpha' ELSE 'conformal_p_above_alpha' END AS reason FROM p""")
def conformal_verdicts(spark, sf):
    s = series(spark, sf).select("series", "tick", F.abs("x").alias("score"))
    p = dt.conformal_p(s.where("tick >= 40"), s.where("tick < 40"), ["series"]).withColumn("n", F.lit(40))
    out = ea.conformal_verdicts(p, 0.05, schema=F.when(F.col("series") % 7 == 0, "breaking"))
    return out.select("series", "tick", "verdict", "reason")


@query(f"""WITH {SERIES}, m AS (SELECT series, count(*) AS n, avg(x) AS a, var_samp(x) AS v FROM s GROUP BY series)
SELECT series, CASE WHEN n >= 60 THEN round(a, 6) END AS mean, CASE WHEN n >= 60 THEN round(v, 6) END AS variance, CASE WHEN n >= 40 AND n < 60 THEN round(a - 3, 6) END AS delta FROM m""")
def ps_tier_gated(spark, sf):
    m = series(spark, sf).groupBy("series").agg(F.count("*").alias("n"), F.array(F.avg("x")).alias("a"), F.array(F.array(F.var_samp("x"))).alias("v"))
    tier = F.when(F.col("n") >= 60, "strict").when(F.col("n") >= 40, "warm_start").otherwise("cold")
    t = m.select("series", ea.tier_gated(tier, F.col("a"), F.col("v"), F.array(F.lit(3.0))).alias("t"))
    return t.select("series", F.round(F.col("t.mean")[0], 6).alias("mean"), F.round(F.col("t.covariance")[0][0], 6).alias("variance"), F.round(F.col("t.delta")[0], 6).alias("delta"))


@query("""SELECT p_partkey, NOT regexp_matches(lower(p_name), 'temp|therm|clock|freq|power|watt|util|ecc|throttle|fan|volt|current|error|retry|xid|health') AS exogenous FROM part""")
def exogenous_covariates(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ea.exogenous(F.col("p_name")).alias("exogenous"))


@query(f"""WITH {SERIES}, g AS (SELECT series % 4 AS factor, tick, x FROM s), a AS (SELECT factor, count(*) AS n, count(DISTINCT tick) AS d, min(tick) AS lo, max(tick) AS hi FROM g GROUP BY factor)
SELECT CAST(factor AS VARCHAR) AS factor, 'duplicate tick' AS problem FROM a WHERE n > d UNION ALL SELECT CAST(factor AS VARCHAR), 'length is not that of the grid' FROM a WHERE d <> 50 OR lo <> 0 OR hi <> 49""")
def telemetry_problems(spark, sf):
    s = series(spark, sf)
    return ea.telemetry_problems(s.select((F.col("series") % 4).cast("string").alias("factor"), "tick", F.col("x").alias("value")), 50)


@query("""WITH i AS (SELECT o_orderkey AS k, o_custkey % 40 AS card, o_orderkey % 11 AS run FROM orders),
c AS (SELECT *, CASE WHEN k % 101 = 0 THEN 'VOID' WHEN k % 13 = 0 THEN 'NON_FINITE' WHEN k % 17 = 0 THEN 'VACUOUS' ELSE 'OK' END AS guard, CASE k % 5 WHEN 0 THEN 'CLEARED' WHEN 1 THEN 'not-refuted' WHEN 2 THEN CASE WHEN card % 3 = 0 THEN 'FAIL' ELSE 'CLEARED' END WHEN 3 THEN 'other' END AS raw,
  CASE WHEN card % 4 = 1 THEN 'terminal_e_value' ELSE 'test_martingale' END AS cls, CASE WHEN k % 7 = 0 THEN 3.0 ELSE 0.5 END AS mean, CASE WHEN k % 3 = 0 THEN 'out' WHEN k % 19 = 0 THEN 'refused' ELSE 'in' END AS regime FROM i),
v AS (SELECT *, bool_or(guard = 'VOID') OVER (PARTITION BY card, run) AS voided FROM c),
o AS (SELECT *, CASE WHEN voided OR guard = 'NON_FINITE' THEN 'excluded' WHEN guard = 'VACUOUS' OR regime = 'refused' OR raw IS NULL OR raw = 'other' THEN 'missing' WHEN raw = 'FAIL' THEN 'REFUTED' WHEN cls = 'terminal_e_value' AND mean > 1 THEN 'REFUTED' ELSE 'CLEARED' END AS outcome FROM v)
SELECT card, CASE WHEN count(*) FILTER (regime = 'in') > 0 AND count(*) FILTER (regime = 'in') = count(*) FILTER (regime = 'in' AND voided) THEN 'VOID' WHEN count(*) FILTER (regime = 'in' AND outcome = 'REFUTED') > 0 THEN 'REFUTED'
  WHEN count(*) FILTER (regime = 'in' AND outcome IN ('CLEARED', 'REFUTED')) = 0 THEN 'MISSING' ELSE 'PASS' END AS status, count(*) FILTER (outcome = 'excluded') AS n_excluded, count(*) FILTER (outcome = 'missing') AS n_missing FROM o GROUP BY card""")
def ct_validity(spark, sf):
    k, card = F.col("o_orderkey"), F.col("o_custkey") % 40
    cells = table(spark, sf, "orders").select(
        card.alias("card"), (k % 11).alias("run"), F.when(card % 4 == 1, "terminal_e_value").otherwise("test_martingale").alias("cls"), F.when(k % 101 == 0, "VOID").when(k % 13 == 0, "NON_FINITE").when(k % 17 == 0, "VACUOUS").otherwise("OK").alias("guard"),
        F.when(k % 5 == 0, "CLEARED").when(k % 5 == 1, "not-refuted").when((k % 5 == 2) & (card % 3 == 0), "FAIL").when(k % 5 == 2, "CLEARED").when(k % 5 == 3, "other").alias("raw"), F.lit(True).alias("foreign"), F.when(k % 7 == 0, 3.0).otherwise(0.5).alias("mean"),
        F.lit(0.0).alias("lower"), F.lit(0.0).alias("increment_mean"), F.lit(0.0).alias("crossing_rate"), F.when(k % 3 == 0, "out").when(k % 19 == 0, "refused").otherwise("in").alias("regime"),
    )
    each, cards = sc.validity(cells)
    n = each.groupBy("card").agg(F.count(F.when(F.col("outcome") == "excluded", 1)).alias("n_excluded"), F.count(F.when(F.col("outcome") == "missing", 1)).alias("n_missing"))
    return cards.join(n, "card").select("card", "status", "n_excluded", "n_missing")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'T3' WHEN 1 THEN 'T1' WHEN 2 THEN 'T2' ELSE 'T1' END AS tier, CASE o_orderkey % 3 WHEN 0 THEN 'out' WHEN 1 THEN 'refused' ELSE 'in' END AS regime FROM orders""")
def ct_tier_and_regime(spark, sf):
    k = F.col("o_orderkey")
    study = F.when(k % 4 == 0, "gpu-real.v2").when(k % 4 == 1, "realignment").when(k % 4 == 2, "ClusterSynth-3")
    null_id = F.when(k % 3 == 0, "N4-p06").when(k % 3 == 1, "N4").otherwise("N3-p06")
    estimated = sc.phi_is_estimated(F.lit(None).cast("string"), F.lit("estimated"), null_id)
    where = sc.regime(sc.effective_phi(F.lit(None).cast("double"), null_id), estimated, F.lit(50), F.lit(0.8), F.lit(True), F.lit(20))
    return table(spark, sf, "orders").select("o_orderkey", sc.study_tier(study).alias("tier"), where["status"].alias("regime"))


@query(f"""WITH {CALIBRATED}, m AS (SELECT series, variance AS v, phi, series % 5 AS f FROM cal) SELECT series, CASE WHEN f = 0 AND series % 3 = 0 THEN 'ar_p' WHEN f = 1 AND series % 2 = 0 THEN 'seasonal' WHEN f = 2 THEN 'prewhitened' WHEN f = 3 THEN 'inflated' ELSE 'independent' END AS rung,
round(CASE WHEN f = 0 AND series % 3 = 0 THEN 0.25 WHEN f = 1 AND series % 2 = 0 THEN v / 2 * (1 - 0.25) WHEN f = 2 THEN greatest(v * (1 - least(phi * phi, 0.9999::DOUBLE)), 1e-12::DOUBLE) WHEN f = 3 THEN v * (1 + greatest(-0.99::DOUBLE, least(0.99::DOUBLE, phi))) / (1 - greatest(-0.99::DOUBLE, least(0.99::DOUBLE, phi))) ELSE v END, 6) AS variance FROM m""")
def bl_variance_ladder(spark, sf):
    c, k = calibrated(spark, sf).groupBy("series").agg(F.first("variance").alias("v"), F.first("phi").alias("phi")), F.col("series")
    at = bl.variance_ladder(F.col("v"), F.col("phi"), F.when(k % 3 == 0, 0.25), F.when(k % 2 == 0, 24).otherwise(0), F.col("v") / 2, F.lit(0.5), k % 5 == 0, k % 5 == 1, k % 5 == 2, k % 5 == 3)
    return c.select("series", at["rung"].alias("rung"), F.round(at["variance"], 6).alias("variance"))


@query("""WITH p AS (SELECT event_type, (event_id % 1000 + 1) / 1000.0::DOUBLE AS p FROM events) SELECT event_type, count(*) AS draws, round(ln(0.1) + 0.9::DOUBLE * avg(-ln(p)), 6) AS growth, ln(0.1) + 0.9::DOUBLE * avg(-ln(p)) > 0 AS positive FROM p GROUP BY event_type""")
def shape_growth_screen(spark, sf):
    p = table(spark, sf, "events").select("event_type", ((F.col("event_id") % 1000 + 1) / 1000.0).alias("p"))
    return rounded(dt.growth_screen(p, ["event_type"]), "growth").drop("mean_neg_log_p")


@query("SELECT p_partkey, ((p_partkey % 256) << 40) + ((p_partkey % 4096) << 20) + p_partkey AS stream FROM part")
def stream_keys(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", scalar.stream_key(k % 256, k % 4096, k, carry=True).alias("stream"))


__all__ = ["QUERIES", "SQL"]
