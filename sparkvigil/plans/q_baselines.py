"""Queries of baselines and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines as bl
from .registry import registry, rounded
from .views import CALIBRATED, SERIES, VECTORS, calibrated, series, table, vectors

QUERIES, SQL, query = registry()

_CLEAN = """
m{k} AS (SELECT bin, median(value) AS m FROM {src} GROUP BY bin),
d{k} AS (SELECT x.bin, greatest(median(abs(value - m)) * 1.4826::DOUBLE, 1e-12::DOUBLE) AS sc, first(m) AS m FROM {src} x JOIN m{k} USING (bin) GROUP BY x.bin),
c{k} AS (SELECT x.bin, count(CASE WHEN abs(value - m) / sc <= 3 THEN 1 END) AS n, avg(CASE WHEN abs(value - m) / sc <= 3 THEN value END) AS mean, var_pop(CASE WHEN abs(value - m) / sc <= 3 THEN value END) AS v FROM {src} x JOIN d{k} USING (bin) GROUP BY x.bin)"""


@query(f"""WITH b AS (SELECT event_type AS bin, value FROM events),{_CLEAN.format(k=1, src='b')}
SELECT bin AS event_type, n, round(mean, 6) AS mean, round(greatest(v, 1e-6 * mean * mean, 1e-12), 6) AS variance FROM c1""")
def bl_clean_null(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value")
    return rounded(bl.clean_null(e, ["event_type"]), "mean", "variance")


_SEASONAL = f"""{SERIES}, b AS (SELECT CAST((sec // 3600) % 24 AS INT) AS bin, value FROM s),
w0 AS (SELECT CAST((bin + k + 24) % 24 AS INT) AS bin, value FROM b, range(-1, 2) r(k)), al AS (SELECT 1 AS bin, value FROM b),
{_CLEAN.format(k=1, src='b')}, {_CLEAN.format(k=2, src='w0')}, {_CLEAN.format(k=3, src='al')},
base AS (SELECT CAST(h AS INT) AS bin, CASE WHEN o.n >= 420 THEN 'strict' WHEN o.n >= 400 OR w.n >= 400 THEN 'pooled' ELSE 'aggregate' END AS confidence,
  CASE WHEN o.n >= 400 THEN o.n WHEN w.n >= 400 THEN w.n ELSE a.n END AS n, CASE WHEN o.n >= 400 THEN o.mean WHEN w.n >= 400 THEN w.mean ELSE a.mean END AS mean,
  CASE WHEN o.n >= 400 THEN o.v WHEN w.n >= 400 THEN w.v ELSE a.v END AS v FROM range(24) r(h) LEFT JOIN c1 o ON o.bin = h LEFT JOIN c2 w ON w.bin = h CROSS JOIN c3 a)"""


def _seasonal(spark, sf):
    b = series(spark, sf).withColumn("bin", (F.floor(F.col("sec") / 3600) % 24).cast("int"))
    return b, bl.seasonal_baseline(b, 24, min_strict=420, min_pooled=400, radius=1, cyclic=True)


@query(f"WITH {_SEASONAL} SELECT bin, n, round(mean, 6) AS mean, round(greatest(v, 1e-6 * mean * mean, 1e-12), 6) AS variance, confidence FROM base")
def bl_seasonal_baseline(spark, sf):
    return rounded(_seasonal(spark, sf)[1], "mean", "variance")


@query(f"WITH {_SEASONAL} SELECT s.event_id, round(s.value - base.mean, 6) AS residual FROM s JOIN base ON base.bin = (sec // 3600) % 24")
def bl_seasonal_residual(spark, sf):
    b, base = _seasonal(spark, sf)
    return rounded(bl.seasonal_residual(b, base), "residual").select("event_id", "residual")


_ACOV = f"""{SERIES}, c AS (SELECT series, tick, x - avg(x) OVER (PARTITION BY series) AS d FROM s), n AS (SELECT series, count(*) AS n FROM s GROUP BY series),
g AS (SELECT n.series, n.n, k AS lag, coalesce(sum(a.d * b.d), 0) / n.n AS acov FROM n CROSS JOIN range(25) r(k) LEFT JOIN c a ON a.series = n.series LEFT JOIN c b ON b.series = a.series AND b.tick = a.tick - k GROUP BY n.series, n.n, k)"""


@query(f"WITH {_ACOV} SELECT series, n, CAST(lag AS INT) AS lag, round(acov, 6) AS acov FROM g WHERE lag <= 8")
def bl_autocovariance(spark, sf):
    return rounded(bl.autocovariances(series(spark, sf), ["series"], 8, "x"), "acov")


@query(f"WITH {CALIBRATED} SELECT series, n, round(mean, 6) AS mean, round(variance, 6) AS variance, round(phi, 6) AS phi, round(greatest(variance * (1 - least(phi * phi, 0.9999::DOUBLE)), 1e-12::DOUBLE), 6) AS innovation_variance FROM cal")
def bl_ar1(spark, sf):
    s = series(spark, sf).where("tick < 20")
    return rounded(bl.ar1(s, ["series"], "x"), "mean", "variance", "phi", "innovation_variance")


@query(f"""WITH {_ACOV}, w AS (SELECT series, n, max(CASE WHEN lag = 0 THEN acov END) AS g0, max(CASE WHEN lag = 1 THEN acov END) AS g1, max(CASE WHEN lag = 2 THEN acov END) AS g2, max(CASE WHEN lag = 3 THEN acov END) AS g3 FROM g GROUP BY series, n),
a AS (SELECT *, g1 / g0 AS k1, g0 * (1 - (g1 / g0) * (g1 / g0)) AS v1 FROM w),
b AS (SELECT *, (g2 - k1 * g1) / v1 AS k2 FROM a), b2 AS (SELECT *, k1 - k2 * k1 AS p21, v1 * (1 - k2 * k2) AS v2 FROM b),
c2 AS (SELECT *, (g3 - p21 * g2 - k2 * g1) / v2 AS k3 FROM b2), d AS (SELECT *, p21 - k3 * k2 AS p31, k2 - k3 * p21 AS p32, v2 * (1 - k3 * k3) AS v3 FROM c2),
e AS (SELECT *, n * ln(v1) + 2 AS i1, n * ln(v2) + 4 AS i2, n * ln(v3) + 6 AS i3 FROM d),
f AS (SELECT *, CASE WHEN i1 <= i2 AND i1 <= i3 THEN 1 WHEN i2 <= i3 THEN 2 ELSE 3 END AS p FROM e)
SELECT series, n, p, round(CASE p WHEN 1 THEN k1 WHEN 2 THEN p21 ELSE p31 END, 6) AS phi1, round(CASE p WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END, 6) AS innovation_variance FROM f""")
def bl_ar_p(spark, sf):
    out = bl.ar_p(series(spark, sf), ["series"], 3, "x")
    return out.select("series", "n", "p", F.round(F.col("phi")[0], 6).alias("phi1"), F.round("innovation_variance", 6).alias("innovation_variance"))


@query(f"WITH {CALIBRATED}, l AS (SELECT *, lag(x - mean, 1, 0) OVER w AS l1, lag(x - mean, 2, 0) OVER w AS l2 FROM r WINDOW w AS (PARTITION BY series ORDER BY tick)) SELECT series, tick, round(x - phi * l1 - 0.1::DOUBLE * l2, 6) AS white FROM l")
def bl_prewhiten(spark, sf):
    r = calibrated(spark, sf)
    return r.select("series", "tick", F.round(bl.prewhitened(r, ["series"], F.col("mean"), [F.col("phi"), F.lit(0.1)], "x"), 6).alias("white"))


@query(f"""WITH {_ACOV}, a AS (SELECT *, acov / first(acov) OVER w AS acf FROM g WINDOW w AS (PARTITION BY series ORDER BY lag)),
b AS (SELECT *, lag(acf) OVER w AS pa, lead(acf) OVER w AS na FROM a WINDOW w AS (PARTITION BY series ORDER BY lag)),
h AS (SELECT series, arg_min(acf, lag) AS acf, min(lag) AS period FROM b WHERE lag BETWEEN 10 AND greatest(11, least(n // 3, n - 2)) AND n >= 30 AND acf > pa AND acf > na AND acf >= 0.1 GROUP BY series)
SELECT k.series, CAST(coalesce(period, 0) AS INT) AS period, round(coalesce(acf, 0), 6) AS acf FROM (SELECT DISTINCT series FROM s) k LEFT JOIN h USING (series)""")
def bl_dominant_period(spark, sf):
    return rounded(bl.dominant_period(series(spark, sf), ["series"], 24, "x", min_acf=0.1), "acf")


@query(f"WITH {SERIES}, p AS (SELECT *, tick % 7 AS phase, x - avg(x) OVER (PARTITION BY series) AS d FROM s) SELECT series, tick, phase, round(avg(d) OVER (PARTITION BY series, phase), 6) AS seasonal, round(x - avg(d) OVER (PARTITION BY series, phase), 6) AS deseasonalized FROM p")
def bl_deseasonalize(spark, sf):
    out = bl.deseasonalized(series(spark, sf), ["series"], 7, "x")
    return rounded(out, "seasonal", "deseasonalized").select("series", "tick", "phase", "seasonal", "deseasonalized")


@query(f"""WITH {VECTORS}, c AS (SELECT cell, v1 - avg(v1) OVER w AS a, v2 - avg(v2) OVER w AS b FROM v WINDOW w AS (PARTITION BY cell)),
g AS (SELECT cell, count(*) AS n, avg(a * a) AS saa, avg(a * b) AS sab, avg(b * b) AS sbb, sum(a * a * a * a) AS qaa, sum(a * a * b * b) AS qab, sum(b * b * b * b) AS qbb FROM c GROUP BY cell),
h AS (SELECT *, (saa + sbb) / 2 AS mu, (qaa - n * saa * saa + 2 * (qab - n * sab * sab) + qbb - n * sbb * sbb) / (n * n) AS b2 FROM g),
i AS (SELECT *, pow(saa - mu, 2) + 2 * sab * sab + pow(sbb - mu, 2) AS d2 FROM h), j AS (SELECT *, CASE WHEN d2 > 0 THEN least(b2, d2) / d2 ELSE 0 END AS l FROM i)
SELECT cell, n, round(l, 6) AS lambda, round(l * mu + (1 - l) * saa, 6) AS cov_v1_v1, round((1 - l) * sab, 6) AS cov_v1_v2, round(l * mu + (1 - l) * sbb, 6) AS cov_v2_v2 FROM j""")
def bl_ledoit_wolf(spark, sf):
    return rounded(bl.shrunk_covariance(vectors(spark, sf), ["cell"], ["v1", "v2"]), "lambda", "cov_v1_v1", "cov_v1_v2", "cov_v2_v2")


@query("""WITH c AS (SELECT event_type, value, sum(user_id) OVER (PARTITION BY event_type ORDER BY value) AS c, sum(user_id) OVER (PARTITION BY event_type) AS t FROM events)
SELECT event_type, coalesce(min(CASE WHEN c >= 0.9 * t THEN value END), max(value)) AS quantile FROM c GROUP BY event_type""")
def bl_weighted_quantile(spark, sf):
    return bl.weighted_quantile(table(spark, sf, "events"), ["event_type"], 0.9, "value", "user_id")


@query("SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY value DESC) AS BIGINT) AS weight_above, CAST(sum(user_id) OVER (PARTITION BY event_type) AS BIGINT) AS total_weight FROM events")
def bl_heldout_weights(spark, sf):
    return bl.heldout_weights(table(spark, sf, "events"), ["event_type"], "value", "user_id").select("event_id", "weight_above", "total_weight")


_BLOCKS = f"""{SERIES}, k0 AS (SELECT series, tick // 10 AS block, count(*) AS n, avg(x) AS m, avg(x * x) AS r2, avg(x * x * x) AS r3, avg(x * x * x * x) AS r4 FROM s GROUP BY 1, 2 HAVING count(*) = 10),
blocks AS (SELECT series, block, (r4 - 4 * m * r3 + 6 * m * m * r2 - 3 * m * m * m * m) / ((r2 - m * m) * (r2 - m * m)) AS kurtosis, abs(r3 - 3 * m * r2 + 2 * m * m * m) / pow(r2 - m * m, 1.5) AS abs_skew FROM k0)"""


@query(f"WITH {_BLOCKS} SELECT series, block, round(kurtosis, 5) AS kurtosis, round(abs_skew, 5) AS abs_skew FROM blocks")
def bl_block_moments(spark, sf):
    return rounded(bl.block_moments(series(spark, sf), ["series"], 10, "x"), "kurtosis", "abs_skew", digits=5).select("series", "block", "kurtosis", "abs_skew")


@query("""WITH m AS (SELECT event_type, median(value) AS md FROM events GROUP BY 1), d AS (SELECT e.*, md, abs(value - md) AS dv FROM events e JOIN m USING (event_type)), g AS (SELECT event_type, median(dv) AS mad FROM d GROUP BY 1)
SELECT event_id, round(md, 6) AS median, round(mad, 6) AS mad, round(dv / mad, 6) AS score FROM d JOIN g USING (event_type)""")
def bl_tail_bet_calibration(spark, sf):
    out = bl.tail_bet_calibration(table(spark, sf, "events"), ["event_type"])
    return rounded(out, "median", "mad", "score").select("event_id", "median", "mad", "score")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'beta' ELSE 'gaussian' END AS distribution, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END AS variance,
  CASE WHEN o_orderkey % 2 = 0 THEN round(greatest(1, 0.5::DOUBLE + 5 * p), 5) END AS alpha, CASE WHEN o_orderkey % 2 = 0 THEN round(greatest(1, 0.5::DOUBLE + 5 * (1 - p)), 5) END AS beta
FROM (SELECT *, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, o_totalprice / 393216)) AS p FROM orders)""")
def bl_mixture_prior(spark, sf):
    o = table(spark, sf, "orders")
    prior = bl.mixture_prior(F.when(F.col("o_orderkey") % 2 == 0, "bounded_probability").otherwise("counts"), F.col("o_totalprice") / 393216, F.col("o_totalprice"))
    return o.select("o_orderkey", prior.alias("p")).select("o_orderkey", "p.distribution", "p.variance", F.round("p.alpha", 5).alias("alpha"), F.round("p.beta", 5).alias("beta"))


@query(f"WITH {VECTORS} SELECT cell, count(*) AS n, round(avg(v1), 6) AS m1, round(covar_samp(v1, v1), 6) AS c11, round(covar_samp(v1, v2), 6) AS c12, round(covar_samp(v2, v2), 6) AS c22 FROM v GROUP BY cell")
def ps_welford(spark, sf):
    from ..operators.fleet import welford

    w = welford(vectors(spark, sf), ["cell"], ["v1", "v2"])
    return w.select("cell", "n", F.round(F.col("mean")[0], 6).alias("m1"), F.round(F.col("cov")[0][0], 6).alias("c11"), F.round(F.col("cov")[0][1], 6).alias("c12"), F.round(F.col("cov")[1][1], 6).alias("c22"))
