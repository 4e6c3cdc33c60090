"""Queries of scalar functions and the ingest contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import ingest
from .registry import registry, rounded
from .views import SERIES, series, table

QUERIES, SQL, query = registry()


@query("""
WITH t AS (SELECT event_id, value, CASE event_type WHEN 'view' THEN 'heavy_tail' WHEN 'click' THEN 'counts' WHEN 'error' THEN 'bounded_probability' ELSE 'gaussian_like' END AS cls FROM events),
u AS (SELECT *, CASE WHEN cls = 'bounded_probability' THEN value / 1000 ELSE value END AS y FROM t)
SELECT event_id, cls, round(CASE cls WHEN 'heavy_tail' THEN ln(greatest(1e-9, y)) WHEN 'counts' THEN 2 * sqrt(greatest(0, y) + 0.375)
  WHEN 'bounded_probability' THEN ln(greatest(1e-9, least(1 - 1e-9, y)) / (1 - greatest(1e-9, least(1 - 1e-9, y)))) ELSE y END, 6) AS transformed FROM u""")
def fn_class_transforms(spark, sf):
    e = table(spark, sf, "events")
    cls = F.when(F.col("event_type") == "view", "heavy_tail").when(F.col("event_type") == "click", "counts").when(F.col("event_type") == "error", "bounded_probability").otherwise("gaussian_like")
    y = F.when(cls == "bounded_probability", F.col("value") / 1000).otherwise(F.col("value"))
    return e.select("event_id", cls.alias("cls"), F.round(scalar.for_class(y, cls), 6).alias("transformed"))


@query("""
SELECT event_type AS signal, CASE event_type WHEN 'error' THEN 'counts' ELSE 'gaussian_like' END AS cls, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2
UNION ALL SELECT 'cost_req', 'heavy_tail', 0""")
def fn_signal_class(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("signal"), F.lit(1).alias("one"))
    more = spark.createDataFrame([("cost_req", 0)], "signal string, one int")
    both = e.unionByName(more)
    return both.groupBy("signal").agg(F.sum("one").alias("n")).select("signal", scalar.signal_class(F.col("signal"), F.when(F.col("signal") == "error", "counts")).alias("cls"), F.col("n").cast("bigint").alias("n"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS risk,
  (p_size % 3 <> 0) AND p_size * 0.3 < w AS active, (p_size % 3 <> 0) AND p_size * 0.3 >= w AND p_size * 0.3 < w + 2 AS grace,
  CASE WHEN p_size % 3 <> 0 THEN least(100.0, floor(p_size * 0.3::DOUBLE / w * 100 + 0.5)) ELSE 100.0 END AS pct,
  CASE WHEN n_rb > 0 THEN 'rollback' WHEN p_size >= 31 AND n_ex = 0 THEN 'proceed' WHEN n_ex > 0 THEN 'extend' ELSE 'baking' END AS decision
FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN 6 WHEN 1 THEN 8 WHEN 2 THEN 10 ELSE 4 END AS w, CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS n_rb, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END AS n_ex FROM part)""")
def fn_warmup_and_decision(spark, sf):
    p = table(spark, sf, "part")
    risk = F.when(F.col("p_size") % 4 == 0, "critical").when(F.col("p_size") % 4 == 1, "high").when(F.col("p_size") % 4 == 2, "medium").otherwise("low")
    change = F.when(F.col("p_size") % 3 != 0, "model_weights").otherwise("config")
    w = scalar.warmup_state(change, risk, F.col("p_size") * F.lit(0.3))
    d = scalar.decision(F.when(F.col("p_partkey") % 11 == 0, 1).otherwise(0), F.when(F.col("p_partkey") % 5 == 0, 2).otherwise(0), F.col("p_size"))
    return p.select("p_partkey", risk.alias("risk"), w["active"].alias("active"), w["grace"].alias("grace"), w["pct"].alias("pct"), d.alias("decision"))


@query("""
SELECT event_id, round(CASE WHEN l >= 709.782712893384 THEN 1.0 ELSE exp(l) / 1e30 END, 6) AS wealth, round(CASE WHEN up >= 709.782712893384 THEN 709.782712893384 ELSE greatest(-27.631021115928547, up) END, 6) AS advanced,
  round(CASE WHEN value > 400 THEN 0.0 WHEN value > 300 THEN greatest(-27.631021115928547, ln(value)) ELSE l END, 6) AS healed
FROM (SELECT event_id, value, (value - 100) / 10 AS l, (value - 100) / 10 - value / 3 AS up FROM events)""")
def fn_wealth(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", ((F.col("value") - 100) / 10).alias("l"))
    floor = -27.631021115928547
    lost = F.when(F.col("value") <= 300, F.col("l"))
    m = F.when(F.col("value") <= 400, F.col("value"))
    return e.select("event_id", F.round(F.when(F.col("l") >= scalar.LOG_MAX, 1.0).otherwise(scalar.wealth(F.col("l")) / 1e30), 6).alias("wealth"), F.round(scalar.advance(F.col("l"), -F.col("value") / 3, floor), 6).alias("advanced"), F.round(scalar.healed(lost, m, floor), 6).alias("healed"))


@query("""
WITH a AS (SELECT event_id, value / 500 AS q, 1 + event_id % 40 AS k FROM events WHERE value < 500 AND value > 0),
z AS (SELECT *, sqrt(-2 * ln(CASE WHEN q < 0.5 THEN q ELSE 1 - q END)) AS t FROM a),
y AS (SELECT *, (CASE WHEN q < 0.5 THEN -1 ELSE 1 END) * (t - (2.515517::DOUBLE + 0.802853::DOUBLE * t + 0.010328::DOUBLE * t * t) / (1 + 1.432788::DOUBLE * t + 0.189269::DOUBLE * t * t + 0.001308::DOUBLE * t * t * t)) AS zq FROM z)
SELECT event_id, round(zq, 6) AS normal_q, round(k * pow(1 - 2 / (9 * k::DOUBLE) + zq * sqrt(2 / (9 * k::DOUBLE)), 3), 5) AS chi2_q, round(k * pow(1 - 2 / (9 * k::DOUBLE) + 1.95996398454005::DOUBLE * sqrt(2 / (9 * k::DOUBLE)), 3), 6) AS chi2_975,
  round(lgamma(q * 20 + 0.1::DOUBLE), 6) AS log_gamma FROM y""")
def fn_quantiles(spark, sf):
    a = table(spark, sf, "events").where("value < 500 and value > 0").select("event_id", (F.col("value") / 500).alias("q"), (1 + F.col("event_id") % 40).cast("double").alias("k"))
    q, k = F.col("q"), F.col("k")
    return a.select("event_id", F.round(scalar.normal_quantile(q), 6).alias("normal_q"), F.round(scalar.chi_square_quantile(q, k), 5).alias("chi2_q"), F.round(scalar.chi_square_975(k), 6).alias("chi2_975"), F.round(scalar.log_gamma(q * 20 + 0.1), 6).alias("log_gamma"))


@query("""
SELECT p_partkey, round(CASE WHEN k <= 0 THEN 1.0 WHEN k > g THEN 0.0 ELSE least(1.0, list_sum(list_transform(range(k, g + 1), lambda i: exp(lgamma(g + 1) - lgamma(i + 1) - lgamma(g - i + 1) + i * ln(a) + (g - i) * ln(1 - a))))) END, 6) AS tail,
  round((p + 1.96::DOUBLE * 1.96 / (2 * g) + 1.96::DOUBLE * sqrt(p * (1 - p) / g + 1.96::DOUBLE * 1.96 / (4 * g * g))) / (1 + 1.96::DOUBLE * 1.96 / g), 6) AS wilson,
  round((1 + phi) / (1 - phi), 6) AS hac, round(0.1::DOUBLE * pow(greatest(p, 0.01::DOUBLE), -0.9::DOUBLE), 6) AS e_value
FROM (SELECT p_partkey, 50::BIGINT AS g, (p_size % 12)::BIGINT AS k, 0.05::DOUBLE AS a, p_size / 50.0::DOUBLE AS p, greatest(-0.99::DOUBLE, least(0.99::DOUBLE, p_size / 40.0::DOUBLE)) AS phi FROM part)""")
def fn_tails(spark, sf):
    p = table(spark, sf, "part").withColumn("k", (F.col("p_size") % 12).cast("bigint"))
    tails = p.select(F.col("k").alias("of")).distinct().withColumn("tail", F.round(scalar.binomial_tail(F.lit(50).cast("bigint"), F.col("of"), F.lit(0.05)), 6))  # twelve remainders
    share = F.col("p_size") / 50.0
    return p.join(F.broadcast(tails), F.col("k").eqNullSafe(F.col("of"))).select(
        "p_partkey", "tail", F.round(scalar.wilson_upper(F.col("p_size").cast("double"), F.lit(50.0)), 6).alias("wilson"),
        F.round(scalar.hac_inflation(F.col("p_size") / 40.0), 6).alias("hac"), F.round(scalar.e_calibrator(F.greatest(share, F.lit(0.01))), 6).alias("e_value"),
    )


@query("""
SELECT o_orderkey, CASE WHEN v = 'rollback' THEN CASE o_orderkey % 3 WHEN 0 THEN 'rollback' WHEN 1 THEN 'pause_and_alarm' ELSE 'human_confirmation_required' END WHEN v IN ('proceed', 'extend', 'baking') THEN v ELSE 'suppressed' END AS action
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'rollback' WHEN 'O' THEN 'proceed' ELSE 'held' END AS v FROM orders)""")
def fn_reversible_action(spark, sf):
    v = F.when(F.col("o_orderstatus") == "F", "rollback").when(F.col("o_orderstatus") == "O", "proceed").otherwise("held")
    r = F.when(F.col("o_orderkey") % 3 == 0, "reversible").when(F.col("o_orderkey") % 3 == 1, "forward_only").otherwise("conditional")
    return table(spark, sf, "orders").select("o_orderkey", scalar.reversible_action(v, r).alias("action"))


@query("""
SELECT p_partkey, lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((xor(h, c)) * 16777619) & 4294967295))), 8, '0') AS hash FROM part""")
def fn_fnv1a(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalar.fnv1a_hex(F.col("p_name")).alias("hash"))


@query(f"""
WITH {SERIES}, c AS (SELECT *, sum(value) OVER (PARTITION BY series ORDER BY tick) * 1e6 AS total FROM s),
m AS (SELECT series, tick, sec, total - floor(total / 4294967296) * 4294967296 AS v FROM c),
p AS (SELECT *, lag(v) OVER w AS pv, lag(sec) OVER w AS pt FROM m WINDOW w AS (PARTITION BY series ORDER BY tick)),
q AS (SELECT *, sec - pt AS dt FROM p WHERE pt IS NOT NULL)
SELECT series, tick AS arrival, CAST(dt AS DOUBLE) AS elapsed, round(CASE WHEN dt <= 0 THEN NULL WHEN v >= pv THEN (v - pv) / dt WHEN pv > 0.9 * 4294967295 THEN (4294967296 - pv + v) / dt END, 3) AS rate,
  CASE WHEN dt <= 0 OR dt > 90000 THEN 'degraded' ELSE 'normal' END AS slope_quality, dt > 0 AND v < pv AND pv > 0.9 * 4294967295 AS wrapped, dt > 0 AND v < pv AND NOT pv > 0.9 * 4294967295 AS reset
FROM q""")
def l0_counter_rate(spark, sf):
    from ..functions.windows import ordered, so_far

    s = series(spark, sf).withColumn("total", F.sum("value").over(so_far(ordered(["series"]))) * 1e6)
    c = s.select("series", F.col("tick").alias("arrival"), F.col("sec").cast("double").alias("ts"), (F.col("total") - F.floor(F.col("total") / 4294967296) * 4294967296).alias("value"))
    out = ingest.counter_rate(c, ["series"], 60000.0)
    return out.select("series", "arrival", "elapsed", F.round("rate", 3).alias("rate"), "slope_quality", "wrapped", "reset")


@query("""
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'observability_stack' WHEN p_size % 5 = 0 THEN 'breaking' WHEN p_size % 3 = 0 THEN 'breaking' WHEN p_size % 2 = 0 THEN 'extended' ELSE 'continuous' END AS continuity,
  CASE WHEN p_size % 7 = 0 THEN 5 WHEN p_size % 5 = 0 OR p_size % 3 = 0 THEN 4 ELSE 0 END AS n_suppressed FROM part""")
def l0_schema_continuity(spark, sf):
    p = table(spark, sf, "part")
    arr = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    numbers = F.lit(None).cast("array<double>")

    def schema(labels, unit):
        return F.struct(F.col("p_brand").alias("signal_name"), unit.alias("unit"), F.lit("counter").alias("semantic_type"), F.lit("host").alias("granularity"), numbers.alias("quantile_list"), numbers.alias("bucket_boundaries"), labels.alias("label_keys"), arr("a").alias("trace_span_names"), arr().alias("trace_attribute_keys"))

    seen = F.when(F.col("p_size") % 3 == 0, arr("host")).when(F.col("p_size") % 2 == 0, arr("zone", "host", "rack")).otherwise(arr("zone", "host"))
    d = p.select("p_partkey", "p_size", schema(arr("host", "zone"), F.lit("ms")).alias("b"), schema(seen, F.when(F.col("p_size") % 5 == 0, "s").otherwise("ms")).alias("o"))
    d = d.withColumn("continuity", ingest.schema_continuity("b", "o", F.col("p_size") % 7 == 0))
    return d.select("p_partkey", "continuity", F.size(ingest.families_suppressed(F.col("continuity"))).alias("n_suppressed"))


_TREND = """
f{i} AS (SELECT series, tick, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, min(value) OVER w AS lo, max(value) OVER w AS hi, regr_slope(value, tick) OVER w AS sl, value - lag(value, 2) OVER (PARTITION BY series ORDER BY tick) AS d2
  FROM s WINDOW w AS (PARTITION BY series ORDER BY tick ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)),
g{i} AS (SELECT *, CASE WHEN m <> 0 AND n > 1 THEN sl / abs(m) ELSE 0 END AS sn, CASE WHEN m <> 0 THEN sd / abs(m) ELSE 1 END AS cv FROM f{i})"""


@query(f"""WITH {SERIES},{_TREND.format(i=1, k=4)},{_TREND.format(i=2, k=9)},{_TREND.format(i=3, k=29)}
SELECT b.series, b.tick, b.n AS medium_n, round(b.m, 6) AS medium_mean, round(b.sn, 6) AS medium_slope_norm, round(b.cv, 6) AS medium_cv, b.lo AS medium_min, b.hi AS medium_max,
  round(CASE WHEN b.n >= 3 AND b.m <> 0 THEN b.d2 / 2 / abs(b.m) ELSE 0 END, 6) AS medium_roc, round(a.sn, 6) AS short_slope_norm, round(c.sn, 6) AS long_slope_norm,
  round(CASE WHEN b.n < 4 OR b.sn = 0 THEN 0 ELSE greatest(0, least(1, least(1, abs(b.sn) / 0.05::DOUBLE) + CASE WHEN b.cv < 0.04 AND abs(b.sn) > 0.002 THEN 0.2::DOUBLE ELSE greatest(0, 0.2::DOUBLE * (1 - b.cv / 0.1::DOUBLE)) END - CASE WHEN b.cv > 0.15 THEN least(0.5::DOUBLE, (b.cv - 0.15::DOUBLE) / 0.15::DOUBLE) ELSE 0 END)) END, 6) AS medium_strength
FROM g2 b JOIN g1 a USING (series, tick) JOIN g3 c USING (series, tick)""")
def tb_trend_features(spark, sf):
    t = ingest.trend_features(series(spark, sf), ["series"])
    cols = ("medium_mean", "medium_slope_norm", "medium_cv", "medium_roc", "short_slope_norm", "long_slope_norm", "medium_strength")
    return rounded(t, *cols).select("series", "tick", "medium_n", *cols, "medium_min", "medium_max")


@query("""
WITH cells AS (SELECT 'c' || o AS id, o, h, d, t FROM (VALUES (0, 3, NULL, 'gold'), (1, 3, 2, NULL), (2, 3, NULL, 'aggregate'), (3, 7, NULL, 'aggregate'), (4, 7, 1, 'gold'), (5, 9, NULL, NULL)) x(o, h, d, t)),
q AS (SELECT o_orderkey, (o_orderkey % 10)::INT AS hour, (o_custkey % 4)::INT AS day, CASE o_orderstatus WHEN 'F' THEN 'gold' WHEN 'O' THEN 'silver' END AS tier FROM orders),
j AS (SELECT q.*, id, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN tier IS NULL OR t IS NULL OR tier = t THEN 0 ELSE 1 END, o) AS rn FROM q LEFT JOIN cells ON h = hour AND (d IS NULL OR d = day) AND (tier IS NULL OR t IS NULL OR t = tier OR t = 'aggregate'))
SELECT o_orderkey, id AS cell FROM j WHERE rn = 1""")
def tb_match_cell(spark, sf):
    cells = spark.createDataFrame([(0, 3, None, "gold"), (1, 3, 2, None), (2, 3, None, "aggregate"), (3, 7, None, "aggregate"), (4, 7, 1, "gold"), (5, 9, None, None)], "ordinal int, hour int, day int, tier string").withColumn("id", F.concat(F.lit("c"), "ordinal"))
    q = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).cast("int").alias("hour"), (F.col("o_custkey") % 4).cast("int").alias("day"), F.when(F.col("o_orderstatus") == "F", "gold").when(F.col("o_orderstatus") == "O", "silver").alias("tier"))
    return ingest.match_cell(q, cells, ["o_orderkey"]).select("o_orderkey", F.col("cell_id").alias("cell"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'schema_continuity_breaking' WHEN o_orderkey % 9 < 3 OR o_orderkey % 8 < 3 OR o_orderkey % 5 > 1 THEN 'bake_profile_not_met' WHEN o_totalprice < 100000 THEN 'traffic_pct_below_gate' END AS reason FROM orders""")
def tb_gates(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    return o.select("o_orderkey", ingest.gate(F.when(k % 13 == 0, "breaking"), k % 9, k % 8, k % 5, F.col("o_totalprice"), least_traffic=100000.0).alias("reason"))


@query("SELECT max(p_size) AS min_ticks, max(p_size % 7) AS min_observations, min(p_size % 3) AS max_days FROM part")
def tb_bake_profile(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_size").alias("min_ticks"), (F.col("p_size") % 7).alias("min_observations"), (F.col("p_size") % 3).alias("max_days"))
    return ingest.bake_profile(p)


_ALIGN = f"""WITH {SERIES}, lo AS (SELECT min(sec) AS t0 FROM s), g AS (SELECT k.series, i, t0 + i * 43200 AS t FROM (SELECT DISTINCT series FROM s) k, lo, range(60) r(i)),
a AS (SELECT g.series, g.i, g.t, max(s.sec * 1000000 + s.tick) AS pk FROM g LEFT JOIN s ON s.series = g.series AND s.sec <= g.t GROUP BY ALL),
b AS (SELECT g.series, g.i, min(s.sec * 1000000 + s.tick) AS nk FROM g LEFT JOIN s ON s.series = g.series AND s.sec > g.t GROUP BY ALL),
j AS (SELECT a.series, a.i, a.t, p.sec AS pt, p.value AS pv, n.sec AS nt, n.value AS nv FROM a JOIN b USING (series, i) LEFT JOIN s p ON p.series = a.series AND p.sec * 1000000 + p.tick = pk LEFT JOIN s n ON n.series = a.series AND n.sec * 1000000 + n.tick = nk)"""


@query(_ALIGN + " SELECT series, CAST(i AS INT) AS i, round(CASE WHEN pt IS NOT NULL THEN CASE WHEN t - pt <= 86400 THEN pv END WHEN nt - t <= 86400 THEN nv END, 6) AS v FROM j")
def bl_align_hold(spark, sf):
    return _aligned(spark, sf, "hold")


@query(_ALIGN + " SELECT series, CAST(i AS INT) AS i, round(CASE WHEN pt = t THEN pv WHEN pt IS NOT NULL AND nt IS NOT NULL THEN CASE WHEN t - pt > 86400 AND nt - t > 86400 THEN NULL ELSE pv + (t - pt)::DOUBLE / (nt - pt) * (nv - pv) END WHEN pt IS NOT NULL THEN CASE WHEN t - pt <= 86400 THEN pv END WHEN nt - t <= 86400 THEN nv END, 6) AS v FROM j")
def bl_align_linear(spark, sf):
    return _aligned(spark, sf, "linear")


def _aligned(spark, sf, method):
    s = series(spark, sf)
    t0 = s.agg(F.min("sec")).first()[0]  # one number: the grid's start
    samples = s.select("series", F.col("sec").cast("double").alias("t"), F.col("value").alias("v"), "tick")
    out = ingest.align_to_grid(samples, ["series"], float(t0), 43200.0, 60, method, 86400.0, by="tick")
    v = F.when(~F.isnan("v"), F.col("v"))
    return out.select("series", "i", (F.round(v * 1e6) / 1e6).alias("v"))  # as the SQL rounds: the product, not the shortest decimal text
