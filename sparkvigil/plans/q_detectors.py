"""Queries of sequential detectors and closed-form evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import WEALTH_FLOOR
from ..operators import baselines as bl
from ..operators import detectors as dt
from ..operators import evidence as ev
from .q_baselines import _BLOCKS
from .registry import registry, rounded
from .views import CALIBRATED, SERIES, VECTORS, calibrated, series, table, vectors

QUERIES, SQL, query = registry()
FLOOR = repr(WEALTH_FLOOR)

_MIX = f"""{CALIBRATED}, q0 AS (SELECT *, (x - mean) - phi * lag(x - mean, 1, 0) OVER w AS white, row_number() OVER w AS t FROM r WINDOW w AS (PARTITION BY series ORDER BY tick)),
q1 AS (SELECT *, sum(white) OVER (PARTITION BY series ORDER BY tick) AS sm FROM q0),
mix AS (SELECT *, exp(least(120, sm * sm / (2 * (variance * t + variance)) + 0.5::DOUBLE * ln(variance / (variance * t + variance)))) AS m FROM q1)"""


@query(f"WITH {_MIX} SELECT series, tick, round(ln(m), 6) AS log_m, m >= 20 AS fire_now, max(m) OVER (PARTITION BY series ORDER BY tick) >= 20 AS fired FROM mix")
def mixture_supermartingale(spark, sf):
    out = dt.mixture(calibrated(spark, sf), ["series"], 0.05, value="x")
    return out.select("series", "tick", F.round(F.log("m"), 6).alias("log_m"), "fire_now", "fired")


@query(f"""WITH {_MIX}, e AS (SELECT series % 16 AS shard, avg(ms) AS e FROM (SELECT series, arg_max(m, tick) AS ms FROM mix GROUP BY series) GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY e DESC, shard) AS rank, count(*) OVER () AS n FROM e), z AS (SELECT *, coalesce(max(CASE WHEN rank * e >= n / 0.5::DOUBLE THEN rank END) OVER (), 0) AS k FROM k)
SELECT shard, round(ln(e), 6) AS log_e, rank, k, rank <= k AS selected FROM z""")
def mixture_fleet_ebh(spark, sf):
    """Flagship: mixture evidence of each series, averaged by shard, and e-BH over the fleet."""
    from ..operators.fleet import e_bh

    out = dt.mixture(calibrated(spark, sf), ["series"], 0.05, value="x")
    last = out.groupBy("series").agg(F.max_by("m", "tick").alias("m"))
    e = last.groupBy((F.col("series") % 16).alias("shard")).agg(F.avg("m").alias("e")).withColumn("fleet", F.lit("all"))
    return e_bh(e, ["fleet"], 0.5, "e", "shard").select("shard", F.round(F.log("e"), 6).alias("log_e"), "rank", "k", "selected")


@query(f"""WITH {SERIES}, b AS (SELECT series, tick, value / 500 AS y FROM s WHERE value < 500), p AS (SELECT series, avg(y) AS p FROM b WHERE tick < 20 GROUP BY series),
q AS (SELECT series, tick, p, greatest(1, 0.5::DOUBLE + 5 * p) AS a, greatest(1, 0.5::DOUBLE + 5 * (1 - p)) AS bb, sum(y - p) OVER w AS sm, row_number() OVER w AS t FROM b JOIN p USING (series) WHERE tick >= 20 WINDOW w AS (PARTITION BY series ORDER BY tick)),
k AS (SELECT *, greatest(1e-9::DOUBLE, least(t - 1e-9::DOUBLE, sm + t * p)) AS k FROM q)
SELECT series, tick, round((least(120, lgamma(a + k) + lgamma(bb + t - k) - lgamma(a + bb + t) - lgamma(a) - lgamma(bb) + lgamma(a + bb) - k * ln(p) - (t - k) * ln(1 - p))), 5) AS log_m FROM k""")
def beta_mixture_supermartingale(spark, sf):
    b = series(spark, sf).where("value < 500").withColumn("y", F.col("value") / 500)
    p = b.where("tick < 20").groupBy("series").agg(F.avg("y").alias("p"))
    out = dt.beta_mixture(b.where("tick >= 20").join(p, "series"), ["series"], 0.05, value="y")
    return out.select("series", "tick", F.round(F.log("m"), 5).alias("log_m"))


def _walk(src: str, step: str, floor: str, key: str = "series", by: str = "tick") -> str:
    return f"""wc AS (SELECT *, sum({step}) OVER (PARTITION BY {key} ORDER BY {by}) AS c_ FROM {src}), wl AS (SELECT *, c_ + greatest(0, max({floor} - c_) OVER (PARTITION BY {key} ORDER BY {by})) AS walk FROM wc)"""


@query(f"WITH {CALIBRATED}, z AS (SELECT *, 0.5::DOUBLE * ln(variance / (2 * variance)) + (x - mean) * (x - mean) * variance / (2 * variance * (2 * variance)) AS z FROM r), {_walk('z', 'z', '0')} SELECT series, tick, round(walk, 6) AS cusum FROM wl")
def page_cusum(spark, sf):
    r = calibrated(spark, sf).withColumn("c", F.col("x") - F.col("mean"))
    return rounded(dt.cusum(r, ["series"], "c", "variance", "variance"), "cusum").select("series", "tick", "cusum")


@query(f"""WITH {CALIBRATED}, z AS (SELECT series, tick, sum((x - mean) / sqrt(variance)) OVER w AS sm, sum((x - mean) * (x - mean) / variance) OVER w AS v FROM r WINDOW w AS (PARTITION BY series ORDER BY tick)),
b AS (SELECT *, sqrt(v) * 0.85::DOUBLE * sqrt((ln(1 + ln(greatest(v, 1))) - 2 * ln(0.05::DOUBLE)) / greatest(v, 1)) AS th FROM z)
SELECT series, tick, round(abs(sm), 6) AS statistic, round(th, 6) AS threshold, bool_or(abs(sm) >= th) OVER (PARTITION BY series ORDER BY tick) AS fired FROM b""")
def self_normalized_bound(spark, sf):
    r = calibrated(spark, sf).withColumn("z", (F.col("x") - F.col("mean")) / F.sqrt("variance"))
    out = dt.self_normalized(r, ["series"], "z")
    return out.select("series", "tick", F.round(F.abs("s"), 6).alias("statistic"), F.round("threshold", 6).alias("threshold"), "fired")


@query(f"""WITH RECURSIVE {CALIBRATED}, o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY tick) AS i FROM r),
f(series, i, lm, bet, n, mu, m2, lst, fb) AS (SELECT series, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM (SELECT DISTINCT series FROM o)
UNION ALL SELECT series, i, greatest({FLOOR}::DOUBLE, lm + ln(greatest(1 + nb * z, 1e-320))), nb, n + 1, mu + (z - mu) / (n + 1), m2 + (z * z - m2) / (n + 1), c, fb + fell FROM (
  SELECT *, CASE WHEN fell = 0 THEN raw ELSE CASE WHEN m2 > 0 AND abs(1 + bet * mu) >= 1e-9 THEN greatest(-0.999999::DOUBLE, least(0.999999::DOUBLE, bet + mu / (1 + bet * mu) / greatest(m2, 1e-6))) ELSE 0 END END AS nb FROM (
  SELECT *, CASE WHEN abs(raw) <= 0.999999 THEN 0 ELSE 1 END AS fell FROM (
  SELECT f.series, o.i, f.lm, f.bet, f.n, f.mu, f.m2, f.fb, o.x - o.mean AS c, greatest(-1::DOUBLE, least(1::DOUBLE, (o.x - o.mean - o.phi * f.lst) / (3 * sqrt(o.variance)))) AS z, CASE WHEN f.m2 > 0 THEN f.mu / f.m2 ELSE 0 END AS raw FROM f JOIN o ON o.series = f.series AND o.i = f.i + 1))))
SELECT series, round(lm, 6) AS log_m, round(bet, 6) AS bet, CAST(n AS BIGINT) AS n, CAST(fb AS BIGINT) AS fallbacks, CASE WHEN lm >= ln(20) THEN 'fire' WHEN lm > 0 THEN 'indeterminate' ELSE 'clean' END AS verdict
FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY i DESC) AS rn FROM f) WHERE rn = 1""")
def betting_e_process(spark, sf):
    out = dt.betting(calibrated(spark, sf), ["series"], 0.05, "x")
    return rounded(out, "log_m", "bet").withColumns({c: F.col(c).cast("bigint") for c in ("n", "fallbacks")})


_ACF = ", ".join(f"abs(CASE WHEN den > 0 THEN list_sum(list_transform(range(1, 30 - {k} + 1), lambda i: (a[i] - m) * (a[i + {k}] - m))) / den ELSE 0 END)" for k in range(3, 7))
_PEAK = f"""{SERIES}, a0 AS (SELECT series, tick, list(x) OVER (PARTITION BY series ORDER BY tick ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS a FROM s),
a1 AS (SELECT *, list_avg(a) AS m FROM a0 WHERE len(a) = 30), a2 AS (SELECT *, list_sum(list_transform(a, lambda v: (v - m) * (v - m))) AS den FROM a1),
a3 AS (SELECT series, tick, [{_ACF}] AS l FROM a2), pk AS (SELECT series, tick, list_max(l) AS peak, 2 + list_position(l, list_max(l)) AS lag FROM a3)"""


@query(f"WITH {_PEAK} SELECT series, tick, round(peak, 6) AS peak, CAST(lag AS INT) AS lag, peak >= 0.35 AS fire FROM pk")
def spectral_peak_acf(spark, sf):
    out = dt.spectral_peak(series(spark, sf), ["series"], 30, 3, 6, "x").where("peak is not null")
    return rounded(out.withColumn("fire", F.col("peak") >= 0.35), "peak").select("series", "tick", "peak", "lag", "fire")


@query(f"WITH {_PEAK}, n AS (SELECT series, count(*) AS n, list_sort(list(peak)) AS l FROM pk GROUP BY series) SELECT series, n, round(CASE WHEN n >= 10 THEN l[least(n, CAST(floor(0.9 * n) AS BIGINT) + 1)] ELSE 0.9 END, 6) AS quantile FROM n")
def spectral_null_quantile(spark, sf):
    pk = dt.spectral_peak(series(spark, sf), ["series"], 30, 3, 6, "x").where("peak is not null")
    w = Window.partitionBy("series").orderBy("peak", "tick")
    r = pk.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("series")))
    at = F.least(F.col("n"), F.floor(F.lit(0.9) * F.col("n")) + 1)
    q = r.groupBy("series").agg(F.first("n").alias("n"), F.max(F.when(F.col("i") == at, F.col("peak"))).alias("q"))
    return q.select("series", "n", F.round(F.when(F.col("n") >= 10, F.col("q")).otherwise(0.9), 6).alias("quantile"))


@query(f"""WITH {_PEAK}, i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY tick) AS i FROM pk), z AS (SELECT *, 5.0::DOUBLE * (peak - 0.2::DOUBLE) / 0.1::DOUBLE * 1.0 - 12.5::DOUBLE AS z FROM i WHERE i % 10 = 0),
{_walk('z', 'z', repr(-690.7755278982137))} SELECT series, tick, round(walk, 6) AS log_m FROM wl""")
def spectral_e_detector(spark, sf):
    pk = dt.spectral_peak(series(spark, sf), ["series"], 30, 3, 6, "x").withColumns({"mu": F.lit(0.2), "sd": F.lit(0.1)})
    return rounded(dt.spectral_e_detector(pk, ["series"], 10, "mu", "sd", 0.5, 0.05), "log_m").select("series", "tick", "log_m")


_DFT = " + ".join(f"0.1::DOUBLE * pow(exp(-(pow(sum(y * cos(-2 * pi() * {k} * (tick % 30) / 30)), 2) + pow(sum(y * sin(-2 * pi() * {k} * (tick % 30) / 30)), 2)) / 30 / first(variance)), -0.9::DOUBLE)" for k in (1, 2, 3))


@query(f"WITH {CALIBRATED}, y AS (SELECT series, tick - 20 AS tick, x - mean AS y, variance FROM r), z AS (SELECT series, tick // 30 AS block, ({_DFT}) / 3 AS e FROM y GROUP BY 1, 2 HAVING count(*) = 30), {_walk('z', 'ln(e)', FLOOR, by='block')} SELECT series, block, round(ln(e), 5) AS log_e, round(walk, 5) AS log_m FROM wl")
def spectral_bet(spark, sf):
    r = calibrated(spark, sf).select("series", (F.col("tick") - 20).alias("tick"), (F.col("x") - F.col("mean")).alias("y"), F.sqrt("variance").alias("sd"))
    out = dt.spectral_bet(r, ["series"], "sd", value="y")
    return out.select("series", "block", F.round(F.log("e"), 5).alias("log_e"), F.round("log_m", 5).alias("log_m"))


@query(f"""WITH {SERIES}, c AS (SELECT series, abs(x) AS sc FROM s WHERE tick < 40), q AS (SELECT series, tick, abs(x) AS sc FROM s WHERE tick >= 40)
SELECT q.series, q.tick, round((1 + count(c.sc))::DOUBLE / (40 + 1), 6) AS p, (1 + count(c.sc))::DOUBLE / 41 < 0.05 AS fire FROM q LEFT JOIN c ON c.series = q.series AND c.sc >= q.sc GROUP BY q.series, q.tick""")
def conformal_p_value(spark, sf):
    s = series(spark, sf).select("series", "tick", F.abs("x").alias("score"))
    out = dt.conformal_p(s.where("tick >= 40"), s.where("tick < 40"), ["series"])
    return out.select("series", "tick", F.round("p", 6).alias("p"), (F.col("p") < 0.05).alias("fire"))


@query(f"""WITH {SERIES}, c AS (SELECT series, abs(x) AS sc, 1 + tick % 3 AS w FROM s WHERE tick < 40), t AS (SELECT series, sum(w) AS tw FROM c GROUP BY series),
q AS (SELECT s.series, s.tick, coalesce(sum(c.w), 0) AS above, first(tw) AS tw FROM s JOIN t USING (series) LEFT JOIN c ON c.series = s.series AND c.sc >= abs(s.x) WHERE s.tick >= 40 GROUP BY s.series, s.tick),
e AS (SELECT series, tick, 1 + CASE WHEN above < 0.05 * tw THEN 1 ELSE 0 END - 0.05::DOUBLE AS e FROM q)
SELECT series, tick, round(e, 6) AS e, round(exp(sum(ln(e)) OVER (PARTITION BY series ORDER BY tick)), 6) AS m FROM e""")
def conformal_weighted_e_process(spark, sf):
    s = series(spark, sf).select("series", "tick", F.abs("x").alias("score"))
    cal = s.where("tick < 40").withColumn("w", 1 + F.col("tick") % 3)
    live = s.where("tick >= 40").select("*", F.lit(0).cast("bigint").alias("w"), F.lit(1).alias("live"))
    both = live.unionByName(cal.withColumn("live", F.lit(0)))
    up = Window.partitionBy("series").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    r = both.withColumn("above", F.sum("w").over(up)).withColumn("total", F.sum("w").over(Window.partitionBy("series"))).where("live = 1")
    out = dt.hedged_wealth(r, ["series"], F.col("above") < 0.05 * F.col("total"), 0.05)
    return rounded(out, "e", "m").select("series", "tick", "e", "m")


@query("""WITH c AS (SELECT event_type, value FROM events WHERE event_id % 2 = 0), m AS (SELECT event_type, median(value) AS md FROM c GROUP BY 1), d AS (SELECT c.event_type, abs(value - md) AS dv FROM c JOIN m USING (event_type)), g AS (SELECT event_type, median(dv) AS mad, list_sort(list(dv)) AS l FROM d GROUP BY 1),
q AS (SELECT event_id, abs(value - md) AS dv, mad, l FROM events JOIN m USING (event_type) JOIN g USING (event_type) WHERE event_id % 2 = 1)
SELECT event_id, round(dv / mad, 6) AS score, round(0.1::DOUBLE * pow((1 + len(list_filter(l, lambda v: v / mad >= dv / mad)))::DOUBLE / (len(l) + 1), -0.9::DOUBLE), 6) AS e FROM q""")
def point_tail_bet(spark, sf):
    from ..functions.scalar import e_calibrator

    e = table(spark, sf, "events")
    cal = bl.tail_bet_calibration(e.where("event_id % 2 = 0"), ["event_type"])
    ref = cal.groupBy("event_type").agg(F.first("median").alias("md"), F.first("mad").alias("mad"))
    live = e.where("event_id % 2 = 1").join(ref, "event_type").withColumn("score", F.abs(F.col("value") - F.col("md")) / F.col("mad"))
    out = dt.conformal_p(live.select("event_type", "event_id", "score"), cal, ["event_type"])
    return out.select("event_id", F.round("score", 6).alias("score"), F.round(e_calibrator(F.col("p")), 6).alias("e"))


@query(f"""WITH {_BLOCKS}, c AS (SELECT 1 AS g, * FROM blocks WHERE series % 2 = 0), q AS (SELECT * FROM blocks WHERE series % 2 = 1), m AS (SELECT median(kurtosis) AS mk, median(abs_skew) AS ms FROM c),
l AS (SELECT list(abs(kurtosis - mk)) AS lk, list(abs(abs_skew - ms)) AS ls FROM c, m),
z AS (SELECT series, block, (0.1::DOUBLE * pow((1 + len(list_filter(lk, lambda v: v >= abs(kurtosis - mk))))::DOUBLE / (len(lk) + 1), -0.9::DOUBLE) + 0.1::DOUBLE * pow((1 + len(list_filter(ls, lambda v: v >= abs(abs_skew - ms))))::DOUBLE / (len(ls) + 1), -0.9::DOUBLE)) / 2 AS e FROM q, m, l),
{_walk('z', 'ln(e)', FLOOR, by='block')} SELECT series, block, round(e, 5) AS e, round(walk, 5) AS log_m FROM wl""")
def shape_block_bet(spark, sf):
    b = bl.block_moments(series(spark, sf), ["series"], 10, "x").withColumn("g", F.lit(1))
    out = _shape(b)
    return rounded(out, "e", "log_m", digits=5).select("series", "block", "e", "log_m")


def _shape(b):
    """Calibration pooled over all even series; wealth of each odd one."""
    cal, live = b.where("series % 2 = 0"), b.where("series % 2 = 1")
    from ..functions.scalar import e_calibrator
    from ..functions.windows import reflected_walk

    out = live
    for f in ("kurtosis", "abs_skew"):
        med = cal.groupBy("g").agg(F.median(f).alias("m"))
        dev = cal.join(med, "g").select("g", F.abs(F.col(f) - F.col("m")).alias("score"))
        out = dt.conformal_p(out.join(med, "g").withColumn("score", F.abs(F.col(f) - F.col("m"))).drop("m"), dev, ["g"]).withColumn(f"e_{f}", e_calibrator(F.col("p"))).drop("p", "score")
    out = out.withColumn("e", (F.col("e_kurtosis") + F.col("e_abs_skew")) / 2).withColumn("z", F.log("e"))
    return reflected_walk(out, "z", ["series"], WEALTH_FLOOR, "log_m", "block")


@query(f"""WITH {SERIES}, k AS (SELECT series, tick // 15 AS block, avg(pow(x, 2)) AS a, avg(pow(x, 4)) AS b FROM s GROUP BY 1, 2 HAVING count(*) = 15) SELECT series, block, round(b / (a * a), 6) AS score FROM k""")
def shape_kurtosis_score(spark, sf):
    return rounded(dt.kurtosis_score(series(spark, sf), ["series"], 15, "x"), "score")


_ENERGY = f"""{SERIES}, r AS (SELECT series, x FROM s WHERE tick < 20), nr AS (SELECT series, count(*) AS m FROM r GROUP BY 1), l AS (SELECT series, (tick - 20) // 5 AS block, x FROM s WHERE tick >= 20),
ll AS (SELECT a.series, a.block, sum(abs(a.x - b.x)) AS ll FROM l a JOIN l b USING (series, block) GROUP BY 1, 2), nl AS (SELECT series, block, count(*) AS n FROM l GROUP BY 1, 2),
lr AS (SELECT l.series, l.block, sum(abs(l.x - r.x)) AS lr FROM l JOIN r USING (series) GROUP BY 1, 2),
en AS (SELECT series, block, 2 * lr / (n * m) - ll / (n * n) AS energy FROM lr JOIN ll USING (series, block) JOIN nl USING (series, block) JOIN nr USING (series) WHERE n = 5)"""


def _energy(spark, sf):
    s = series(spark, sf)
    live = s.where("tick >= 20").withColumn("block", F.floor((F.col("tick") - 20) / 5))
    whole = live.withColumn("n", F.count("*").over(Window.partitionBy("series", "block"))).where("n = 5")
    return dt.energy_statistic(whole, s.where("tick < 20"), ["series"], "x")


@query(f"WITH {_ENERGY} SELECT series, block, round(energy, 6) AS energy FROM en")
def shape_ecdf_energy(spark, sf):
    return rounded(_energy(spark, sf), "energy")


@query(f"""WITH {_ENERGY}, c AS (SELECT series, round(energy, 9) AS t FROM en WHERE block < 4), q AS (SELECT series, block, round(energy, 9) AS t FROM en WHERE block >= 4),
p AS (SELECT q.series, q.block, (1 + count(c.t))::DOUBLE / (1 + (SELECT count(*) FROM c z WHERE z.series = q.series)) AS p FROM q LEFT JOIN c ON c.series = q.series AND c.t >= q.t GROUP BY q.series, q.block), z AS (SELECT *, 0.1::DOUBLE * pow(p, -0.9::DOUBLE) AS e FROM p),
{_walk('z', 'ln(e)', FLOOR, by='block')} SELECT series, block, round(p, 6) AS p, round(walk, 6) AS log_m FROM wl""")
def shape_ecdf_wealth(spark, sf):
    en = _energy(spark, sf).withColumn("energy", F.round("energy", 9))
    out = dt.energy_wealth(en.where("block >= 4"), en.where("block < 4"), ["series"])
    return rounded(out, "p", "log_m").select("series", "block", "p", "log_m")


_WHITE = f"""{SERIES}, d AS (SELECT *, lag(x) OVER (PARTITION BY series ORDER BY tick) AS p, tick < 20 AS c, tick BETWEEN 20 AND 39 AS t FROM s),
d1 AS (SELECT *, avg(CASE WHEN c THEN x END) OVER (PARTITION BY series) AS m FROM d WHERE c OR t),
ph0 AS (SELECT series, sum(CASE WHEN c AND tick > 0 THEN (x - m) * (p - m) END) / sum(CASE WHEN c THEN (x - m) * (x - m) END) AS q FROM d1 GROUP BY series), ph AS (SELECT series, greatest(-0.95, least(0.95, q + (1 + 3 * q) / 20)) AS phi FROM ph0),
w AS (SELECT d1.*, phi, x - phi * p AS w FROM d1 JOIN ph USING (series)),
mo AS (SELECT series, first(phi) AS phi, count(CASE WHEN c AND tick > 0 THEN 1 END) AS n1, count(CASE WHEN t THEN 1 END) AS n2, avg(CASE WHEN c AND tick > 0 THEN w END) AS m1, avg(CASE WHEN t THEN w END) AS m2, var_samp(CASE WHEN c AND tick > 0 THEN w END) AS v1, var_samp(CASE WHEN t THEN w END) AS v2,
  regr_slope(CASE WHEN t THEN w END, CASE WHEN t THEN tick - 20 END) AS sl, regr_sxx(CASE WHEN t THEN w END, CASE WHEN t THEN tick - 20 END) AS sxx, avg(CASE WHEN c THEN x END) AS cm, avg(CASE WHEN t THEN x END) AS tm, var_samp(CASE WHEN c THEN x END) AS cv FROM w GROUP BY series)"""


@query(f"""WITH {_WHITE}, k AS (SELECT *, n1 + n2 - 2 AS nu, 1 + (n1 * n2)::DOUBLE / (n1 + n2) * 25 AS r FROM mo), l AS (SELECT *, pow(m2 - m1, 2) / (greatest(((n1 - 1) * v1 + (n2 - 1) * v2) / nu, 1e-12) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) / nu AS q FROM k)
SELECT series, round(phi, 6) AS phi, round(pow(r, -0.5::DOUBLE) * pow((1 + q) / (1 + q / r), (nu + 1) / 2.0::DOUBLE), 6) AS e FROM l""")
def safe_t_e_value(spark, sf):
    m = ev.whitened(series(spark, sf), ["series"], (0, 20), (20, 20), "x")
    return m.select("series", F.round("phi", 6).alias("phi"), F.round(ev.safe_t(m), 6).alias("e"))


@query(f"""WITH {_WHITE}, k AS (SELECT series, greatest(v2, 1e-9) / greatest(v1, 1e-9) AS f, abs(sl) / sqrt(greatest(v1, 1e-9) / greatest(sxx, 1e-9)) AS t, greatest(0, (cm - tm) / sqrt(greatest(cv, 1e-9))) AS c FROM mo)
SELECT series, round(f, 6) AS f_ratio, round(t, 6) AS trend_t, round(c, 6) AS collapse_sigma, f > 2 OR t > 4 OR c > 6 AS has_signature FROM k""")
def distributional_signature(spark, sf):
    m = ev.signature(ev.whitened(series(spark, sf), ["series"], (0, 20), (20, 20), "x"))
    return rounded(m, "f_ratio", "trend_t", "collapse_sigma").select("series", "f_ratio", "trend_t", "collapse_sigma", "has_signature")


@query("SELECT event_type, round(avg(greatest(value - 50, 0)), 6) AS e, count(*) AS n FROM events GROUP BY event_type")
def group_average_e_value(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.greatest(F.col("value") - 50, F.lit(0.0)).alias("e"))
    return rounded(ev.group_average(e, ["event_type"]), "e")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'sequential_mmd' WHEN 1 THEN 'sequential_mmd_betting_e_process' WHEN 2 THEN 'mSPRT_' WHEN 3 THEN 'collective' END AS prefix,
  CASE o_orderkey % 5 WHEN 0 THEN 'classical_epoch' WHEN 1 THEN 'ville_anytime_valid' WHEN 2 THEN 'ville_anytime_valid' WHEN 3 THEN 'heuristic' END AS validity FROM orders""")
def detector_guarantees(spark, sf):
    k = F.col("o_orderkey") % 5
    name = F.when(k == 0, "sequential_mmd").when(k == 1, "sequential_mmd_betting_e_process").when(k == 2, "mSPRT_ttft").when(k == 3, "collective_stall").otherwise("nothing_known")
    return ev.guaranteed(table(spark, sf, "orders").select("o_orderkey", name.alias("detector_id"))).select("o_orderkey", "prefix", "validity")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 100 <= 95 AND o_orderkey % 7 <> 0 WHEN 2 THEN true ELSE false END AS admissible FROM orders""")
def detector_admissibility(spark, sf):
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, "safe_t_e_value").when(k % 4 == 1, "betting_e_process").when(k % 4 == 2, "universal_inference_e_value").otherwise("unknown")
    o = table(spark, sf, "orders").select("o_orderkey", name.alias("detector_id"), F.when(k % 7 != 0, (k % 100) / 100.0).alias("phi"), F.lit(500).alias("cal_len"))
    return ev.admissible(o).select("o_orderkey", "admissible")


_HOT = f"""{VECTORS}, g AS (SELECT cell, avg(v1) AS a1, avg(v2) AS a2, covar_samp(v1, v1) + 1 AS c11, covar_samp(v1, v2) AS c12, covar_samp(v2, v2) + 1 AS c22 FROM v GROUP BY cell),
h AS (SELECT v.vec_id, v.cell, v1 - a1 AS x, v2 - a2 AS y, c11, c12, c22 FROM v JOIN g USING (cell)), t2 AS (SELECT *, (c22 * x * x - 2 * c12 * x * y + c11 * y * y) / (c11 * c22 - c12 * c12) AS t2 FROM h)"""


def _hot(spark, sf):
    v = vectors(spark, sf)
    g = v.groupBy("cell").agg(F.avg("v1").alias("a1"), F.avg("v2").alias("a2"), (F.covar_samp("v1", "v1") + 1).alias("c11"), F.covar_samp("v1", "v2").alias("c12"), (F.covar_samp("v2", "v2") + 1).alias("c22"))
    j = v.join(g, "cell").withColumn("x", F.col("v1") - F.col("a1")).withColumn("y", F.col("v2") - F.col("a2"))
    return j, {(0, 0): F.col("c11"), (0, 1): F.col("c12"), (1, 1): F.col("c22")}


@query(f"WITH {_HOT} SELECT vec_id, round(t2, 6) AS t2, t2 > 0.05 AS fire FROM t2")
def hotelling_t2(spark, sf):
    j, c = _hot(spark, sf)
    t2 = dt.hotelling(j, ["x", "y"], c)
    return j.select("vec_id", F.round(t2, 6).alias("t2"), (t2 > 0.05).alias("fire"))


@query(f"""WITH {_HOT}, u AS (SELECT *, (c22 + 0.5) * (c11 + 0.5) - c12 * c12 AS dt, c11 * c22 - c12 * c12 AS d0 FROM t2),
z AS (SELECT vec_id, cell, 0.5::DOUBLE * t2 - 0.5::DOUBLE * ((c22 + 0.5) * x * x - 2 * c12 * x * y + (c11 + 0.5) * y * y) / dt - 0.5::DOUBLE * ln(dt / d0) AS z FROM u),
{_walk('z', 'z', repr(-690.7755278982137), key='cell', by='vec_id')} SELECT vec_id, cell, round(walk, 6) AS log_m FROM wl""")
def safe_hotelling(spark, sf):
    from ..functions.windows import TINY_FLOOR, reflected_walk

    j, c = _hot(spark, sf)
    d0, d1 = F.col("c11") * F.col("c22") - F.col("c12") * F.col("c12"), (F.col("c11") + 0.5) * (F.col("c22") + 0.5) - F.col("c12") * F.col("c12")
    z = 0.5 * dt.hotelling(j, ["x", "y"], c) - 0.5 * dt.hotelling(j, ["x", "y"], c, 0.5) - 0.5 * F.log(d1 / d0)
    return rounded(reflected_walk(j.withColumn("z", z), "z", ["cell"], TINY_FLOOR, "log_m", "vec_id"), "log_m").select("vec_id", "cell", "log_m")


@query(f"""WITH {VECTORS} SELECT a.vec_id, b.vec_id AS other, round(exp(-(pow(a.v1 - b.v1, 2) + pow(a.v2 - b.v2, 2) + pow(a.v3 - b.v3, 2)) / (2 * 0.25::DOUBLE)), 6) AS k FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def rbf_kernel(spark, sf):
    v = vectors(spark, sf).select("vec_id", F.array("v1", "v2", "v3").alias("a"))
    n = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("a").alias("b"))
    d2 = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return v.join(n, "vec_id").select("vec_id", "other", F.round(F.exp(-d2 / (2 * 0.25)), 6).alias("k"))
