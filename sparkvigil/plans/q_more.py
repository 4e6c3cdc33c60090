"""Queries of certification, resampling, substrates, residualisation and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import certify as ct
from ..operators import covariates as cv
from ..operators import evidence as ev
from ..operators import replay as rp
from ..operators import resample as rs
from ..operators.cut import shared_folder
from ..sources import accelerators as ac
from ..sources.event_feed import registered
from .q_detectors import _HOT, _MIX, _PEAK, _hot
from .q_detectors import SQL as _DETECTOR_SQL
from .q_fleet import _NB
from .registry import registry, rounded
from .views import SERIES, VECTORS, epoch, series, table, vectors

QUERIES, SQL, query = registry()
BETTING = _DETECTOR_SQL["betting_e_process"]


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'NON_FINITE' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'VOID' WHEN o_orderkey % 7 = 0 THEN 'VACUOUS' ELSE 'OK' END ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'OK' ELSE 'VOID' END END AS guard FROM orders""")
def ct_guards(spark, sf):
    k = F.col("o_orderkey")
    present = F.when(k % 5 == 0, F.array(F.lit("mean_e"))).otherwise(F.array(F.lit("increment_estimator")))
    cls = F.when(k % 3 == 0, "test_martingale").otherwise("terminal_e_value")
    return table(spark, sf, "orders").select("o_orderkey", ct.guard(cls, present, F.when(k % 11 == 0, 1).otherwise(0), F.when(k % 7 == 0, 0.0).otherwise(1.0)).alias("guard"))


@query("""WITH c AS (SELECT o_custkey AS d, sum((o_totalprice >= 100000)::INT) AS np FROM orders GROUP BY 1)
SELECT d, CAST(np AS BIGINT) AS n_powered, CASE d % 6 WHEN 0 THEN 'NOT_EXECUTABLE' WHEN 1 THEN 'REFUSE' WHEN 2 THEN 'NOT_EXECUTABLE' ELSE CASE WHEN np = 0 THEN 'ADVISORY' WHEN d % 4 = 0 THEN 'ADVISORY' ELSE 'USE' END END AS verdict FROM c""")
def ct_verdicts(spark, sf):
    cells = table(spark, sf, "orders").select(F.col("o_custkey").alias("d"), (F.col("o_totalprice") / 1000000).alias("detection_rate"))
    p, k = ct.powered(cells, "d"), F.col("d")
    s2 = F.when(k % 6 == 0, "VOID").when(k % 6 == 1, "REFUTED").when(k % 6 == 2, "MISSING").otherwise("PASS")
    return p.select("d", "n_powered", ct.verdict(s2, F.lit("PASS"), F.col("n_powered"), F.when(k % 4 == 0, "UNPRICED").otherwise("PASS")).alias("verdict"))


@query("""WITH c AS (SELECT o_custkey AS d, o_orderpriority AS fault_class, o_totalprice / 500000 AS r, o_orderstatus = 'F' AS can FROM orders)
SELECT a.d, b.fault_class, coalesce(max(CASE WHEN can THEN r END) >= 0.5, false) AS covered FROM (SELECT DISTINCT d FROM c) a CROSS JOIN (SELECT DISTINCT fault_class FROM c) b LEFT JOIN c ON c.d = a.d AND c.fault_class = b.fault_class GROUP BY 1, 2""")
def ct_coverage(spark, sf):
    cells = table(spark, sf, "orders").select(F.col("o_custkey").alias("d"), F.col("o_orderpriority").alias("fault_class"), (F.col("o_totalprice") / 500000).alias("detection_rate"), (F.col("o_orderstatus") == "F").alias("canonical"))
    return ct.coverage(cells, cells.select("fault_class").distinct(), "d").select("d", "fault_class", "covered")


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def ct_superseded(spark, sf):
    o = table(spark, sf, "orders").withColumn("run", F.col("o_orderkey"))
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return rp.last_kept(o, ["o_custkey", "o_orderpriority"]).join(gone, "o_custkey", "left_anti").select("o_orderkey")


@query("""WITH c AS (SELECT event_type AS family, user_id % 8 AS seed, sum((value > 150)::INT) AS n FROM events GROUP BY 1, 2) SELECT family, round(avg(n), 6) AS mean, CAST(ceil(12.5 + 1.96 * sqrt(12.5)) AS BIGINT) AS bound, CAST(sum((n <= ceil(12.5 + 1.96 * sqrt(12.5)))::INT) AS BIGINT) AS passes FROM c GROUP BY family""")
def rs_across_seeds(spark, sf):
    c = table(spark, sf, "events").groupBy(F.col("event_type").alias("family"), (F.col("user_id") % 8).alias("seed")).agg(F.sum((F.col("value") > 150).cast("int")).alias("n"))
    return rounded(ct.across_seeds(c, F.lit(0.05), 250), "mean").select("family", "mean", "bound", "passes")


_POST = _NB.replace("k * 30 AS lo", "k * 30 AS lo0").replace("+ 9 AS hi FROM (SELECT", "+ 9 AS hi0 FROM (SELECT").replace("wi AS (", "wj AS (", 1).replace("h AS (SELECT wi", "wi AS (SELECT dataset, greatest(lo0, 10) AS lo, hi0 AS hi FROM wj WHERE hi0 >= 10),\nh AS (SELECT wi", 1).replace("value > 150 AS fire FROM s)", "value > 150 AS fire FROM s WHERE tick >= 10)", 1).replace("/ 9)) END", "/ greatest(1, hi - lo))) END")


@query(f"WITH {_POST} SELECT d.dataset, coalesce(nw, 0) AS n_windows, round(greatest(0, CASE WHEN nw IS NULL THEN 100 - coalesce(n, 0) * 0.22::DOUBLE ELSE 100 * (gain - coalesce(n, 0) * 0.22::DOUBLE) / (nw / (1 + exp(-5))) END), 6) AS score FROM (SELECT DISTINCT series AS dataset FROM s) d LEFT JOIN g USING (dataset) LEFT JOIN ou USING (dataset)")
def nb_post_probation_score(spark, sf):
    s = series(spark, sf)
    f = s.select(F.col("series").alias("dataset"), "tick", (F.col("value") > 150).alias("fire"))
    d = f.select("dataset").distinct()
    w = d.where("dataset % 6 <> 0").select("dataset", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("dataset", ((F.col("dataset") % 7) * 4 + F.col("k") * 30).alias("start")).withColumn("end", F.col("start") + 9)
    post = w.where("`end` >= 10").select("dataset", F.greatest("start", F.lit(10)).alias("start"), "end")
    return rounded(rp.replay_score(f.where("tick >= 10"), post, d), "score").select("dataset", "n_windows", "score")


@query("""SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 5 = 0 THEN 2.5 ELSE 7.5 END, 6) AS variance FROM orders""")
def src_substrate_variance(spark, sf):
    k = F.col("o_orderkey")
    v = ct.substrate_variance(F.when(k % 3 == 0, F.col("o_totalprice")).when(k % 3 == 1, 0.0), F.when(k % 5 == 0, 2.5).otherwise(0.0), F.lit(7.5))
    return table(spark, sf, "orders").select("o_orderkey", F.round(v, 6).alias("variance"))


@query(f"""WITH {SERIES}, de AS (SELECT series, tick, x, x - (avg(x) OVER (PARTITION BY series, tick % 7) - avg(x) OVER (PARTITION BY series)) AS y FROM s),
c0 AS (SELECT series, tick, x - avg(x) OVER (PARTITION BY series) AS a, y - avg(y) OVER (PARTITION BY series) AS b FROM de), c1 AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM c0 WINDOW w AS (PARTITION BY series ORDER BY tick)),
g AS (SELECT series, count(*) AS n, sum(a * pa) / sum(a * a) AS qa, sum(b * pb) / sum(b * b) AS qb, sum(a * a) / (count(*) - 1) AS va, sum(b * b) / (count(*) - 1) AS vb FROM c1 GROUP BY series),
p AS (SELECT *, greatest(-0.95, least(0.95, qa + (1 + 3 * qa) / n)) AS fa, greatest(-0.95, least(0.95, qb + (1 + 3 * qb) / n)) AS fb FROM g)
SELECT series, round(fa, 6) AS phi, round(va * (1 - fa * fa), 6) AS innovation_variance, round(fb, 6) AS seasonal_phi, round(vb * (1 - fb * fb), 6) AS seasonal_variance FROM p""")
def bl_substrate(spark, sf):
    out = ct.substrate(series(spark, sf), ["series"], 7, "x")
    cols = ("phi", "innovation_variance", "seasonal_phi", "seasonal_variance")
    return rounded(out, *cols).select("series", *cols)


_COV = f"""{SERIES}, y AS (SELECT series, tick, x, sin(tick * 0.3::DOUBLE) AS c FROM s),
g AS (SELECT series, count(*) AS n, sum(c) AS sc, sum(c * c) AS scc, sum(x) AS sy, sum(c * x) AS scy FROM y GROUP BY series HAVING count(*) >= 16), a AS (SELECT *, n * (1 + 1e-8) AS a0, scc + 1e-8 * scc AS a1 FROM g),
b AS (SELECT series, n, (a1 * sy - sc * scy) / (a0 * a1 - sc * sc) AS ic, (a0 * scy - sc * sy) / (a0 * a1 - sc * sc) AS be FROM a), u AS (SELECT y.*, n, ic, be, x - ic - be * c AS u FROM y JOIN b USING (series)),
d AS (SELECT *, u - avg(u) OVER (PARTITION BY series) AS d FROM u), e AS (SELECT *, lag(d) OVER (PARTITION BY series ORDER BY tick) AS l FROM d), f AS (SELECT series, first(n) AS n, first(ic) AS ic, first(be) AS be, sum(d * d) / count(*) AS g0, sum(d * l) / count(*) AS g1 FROM e GROUP BY series),
fit AS (SELECT series, ic, be, CASE WHEN n * ln(g0 * (1 - (g1 / g0) * (g1 / g0))) + 2 < n * ln(g0) THEN g1 / g0 ELSE 0 END AS phi, CASE WHEN n * ln(g0 * (1 - (g1 / g0) * (g1 / g0))) + 2 < n * ln(g0) THEN g0 * (1 - (g1 / g0) * (g1 / g0)) ELSE g0 END AS s2 FROM f)"""


def _cov(spark, sf):
    y = series(spark, sf).withColumn("c", F.sin(F.col("tick") * 0.3))
    return y, ct.covariate_fit(y, ["series"], "c", "x")


#: Two covariates and an intercept by Cramer's rule, orders 0 to 2.
_COVS = f"""{SERIES}, y AS (SELECT series, tick, x, sin(tick * 0.3::DOUBLE) AS c, (tick % 7)::DOUBLE AS w FROM s),
g AS (SELECT series, count(*) AS n, count(*) * (1 + 1e-8::DOUBLE) AS a00, sum(c) AS a01, sum(w) AS a02, sum(c * c) * (1 + 1e-8::DOUBLE) AS a11, sum(c * w) AS a12, sum(w * w) * (1 + 1e-8::DOUBLE) AS a22, sum(x) AS b0, sum(c * x) AS b1, sum(w * x) AS b2 FROM y GROUP BY series HAVING count(*) >= 16),
q AS (SELECT *, a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02) AS det FROM g),
co AS (SELECT series, n, (b0 * (a11 * a22 - a12 * a12) - a01 * (b1 * a22 - a12 * b2) + a02 * (b1 * a12 - a11 * b2)) / det AS k0, (a00 * (b1 * a22 - a12 * b2) - b0 * (a01 * a22 - a12 * a02) + a02 * (a01 * b2 - b1 * a02)) / det AS k1, (a00 * (a11 * b2 - b1 * a12) - a01 * (a01 * b2 - b1 * a02) + b0 * (a01 * a12 - a11 * a02)) / det AS k2 FROM q),
u AS (SELECT y.series, tick, n, x - k0 - k1 * c - k2 * w AS u FROM y JOIN co USING (series)), d AS (SELECT *, u - avg(u) OVER (PARTITION BY series) AS d FROM u), l AS (SELECT *, lag(d) OVER w AS d1, lag(d, 2) OVER w AS d2, lag(u) OVER w AS u1, lag(u, 2) OVER w AS u2, lag(u, 3) OVER w AS u3 FROM d WINDOW w AS (PARTITION BY series ORDER BY tick)),
ga AS (SELECT series, count(*) AS n, sum(d * d) / count(*) AS g0, sum(d * d1) / count(*) AS g1, sum(d * d2) / count(*) AS g2 FROM l GROUP BY series), pk AS (SELECT *, g1 / g0 AS k1, g0 * (1 - (g1 / g0) * (g1 / g0)) AS s1 FROM ga), pl AS (SELECT *, (g2 - k1 * g1) / s1 AS k2 FROM pk),
pm AS (SELECT *, s1 * (1 - k2 * k2) AS s2, n * ln(g0) AS i0, n * ln(s1) + 2 AS i1, CASE WHEN abs(k2) <= 1 THEN n * ln(s1 * (1 - k2 * k2)) + 4 ELSE 1e300 END AS i2 FROM pl),
ar AS (SELECT series, CASE WHEN i2 < least(i0, i1) THEN 2 WHEN i1 < i0 THEN 1 ELSE 0 END AS p, k1, k2, g0, s1, s2 FROM pm), fit AS (SELECT series, p, CASE p WHEN 2 THEN k1 - k2 * k1 WHEN 1 THEN k1 ELSE 0 END AS f1, CASE p WHEN 2 THEN k2 ELSE 0 END AS f2, CASE p WHEN 2 THEN s2 WHEN 1 THEN s1 ELSE g0 END AS v FROM ar),
e AS (SELECT l.series, l.tick, p, f1, f2, v, CASE WHEN p = 0 THEN u WHEN p = 1 THEN u - f1 * u1 ELSE u - f1 * u1 - f2 * u2 END AS e FROM l JOIN fit USING (series)),
r AS (SELECT series, avg(e) AS m, count(*) AS n, sqrt(avg(e * e)) AS rmse FROM e WHERE e IS NOT NULL GROUP BY series), t AS (SELECT e.series, r.n, rmse, e - m AS z, lag(e - m) OVER (PARTITION BY e.series ORDER BY tick) AS z1 FROM e JOIN r USING (series) WHERE e IS NOT NULL),
wh AS (SELECT series, first(n) AS n, first(rmse) AS rmse, sum(z * z1) / sum(z * z) AS rho FROM t GROUP BY series)"""


def _covs(spark, sf):
    y = series(spark, sf).withColumns({"c": F.sin(F.col("tick") * 0.3), "w": (F.col("tick") % 7).cast("double")})
    return y, cv.fitted(y, ["series"], ["c", "w"], "x", max_order=2)


@query(f"WITH {_COVS} SELECT series, round(k0, 6) AS intercept, round(co.k1, 6) AS beta1, round(co.k2, 6) AS beta2, p AS ar_order, round(f1, 6) AS phi1, round(v, 6) AS sigma2, round(rho, 6) AS residual_lag1_rho, abs(rho) < greatest(0.1::DOUBLE, 2 / sqrt(wh.n)) AS white, round(rmse, 6) AS one_step_rmse FROM co JOIN fit USING (series) JOIN wh USING (series)")
def bl_covariates_fit(spark, sf):
    """Two covariates, an autoregression of the order of least AIC, and whiteness of its one-step residual."""
    f = _covs(spark, sf)[1].select("series", F.col("coef")[0].alias("intercept"), F.col("coef")[1].alias("beta1"), F.col("coef")[2].alias("beta2"), "ar_order", F.coalesce(F.get("phi", F.lit(0)), F.lit(0.0)).alias("phi1"), "sigma2", "residual_lag1_rho", "white", "one_step_rmse")
    return rounded(f, "intercept", "beta1", "beta2", "phi1", "sigma2", "residual_lag1_rho", "one_step_rmse")


@query(f"WITH {_COVS} SELECT series, tick, round(e, 6) AS residual, round(e / sqrt(v), 6) AS standardized FROM e")
def bl_covariates_one_step(spark, sf):
    y, fit = _covs(spark, sf)
    return rounded(cv.one_step(y, fit, ["series"], ["c", "w"], "x", max_order=2), "residual", "standardized").select("series", "tick", "residual", "standardized")


_WEIGHT = "CASE " + " ".join(f"WHEN u < {p!r}::DOUBLE THEN {k}" for k, p in enumerate(rs.cumulative())) + f" ELSE {rs.MOST} END"


@query(f"""WITH e AS (SELECT event_type, event_id, value FROM events WHERE value IS NOT NULL), d AS (SELECT *, unnest(range(1, 41)) AS draw FROM e),
u AS (SELECT *, ('0x' || substr(md5('7:' || event_id || ':' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d), w AS (SELECT *, {_WEIGHT} AS w FROM u),
g AS (SELECT event_type, draw, sum(w * value) / sum(w) AS mean FROM w GROUP BY event_type, draw HAVING sum(w) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY mean, draw) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM g)
SELECT event_type, max(n) AS n_draws, round(max(CASE WHEN i = greatest(1, ceil(round(0.05::DOUBLE * n, 9))) THEN mean END), 6) AS low, round(max(CASE WHEN i = greatest(1, ceil(round(0.95::DOUBLE * n, 9))) THEN mean END), 6) AS high, round((SELECT avg(value) FROM e WHERE e.event_type = r.event_type), 6) AS plain FROM r GROUP BY event_type""")
def replicated_limits(spark, sf):
    """Mean value of each kind of event in forty draws of the table, and its limits at 5 % and 95 %."""
    d = rs.across_draws(table(spark, sf, "events"), ["event_type"], "event_id", "value", 40, 7)
    return rounded(rs.nearest_rank(d, ["event_type"], {"low": 0.05, "high": 0.95}), "low", "high", "plain")


@query("""WITH c AS (SELECT s_nationkey AS n, s_suppkey AS k FROM supplier), e AS (SELECT DISTINCT n, least('c' || k, 'c' || (k + 1)) AS src, greatest('c' || k, 'c' || (k + 1)) AS dst FROM c)
SELECT 'slice-' || n AS source, CASE n % 3 WHEN 0 THEN 'v4' WHEN 1 THEN 'v5e' ELSE 'v5p' END AS tpu_version, n % 5 < 3 AS partial, (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM e WHERE e.n = g.n UNION SELECT dst FROM e WHERE e.n = g.n)) AS n_nodes, (SELECT count(*) FROM e WHERE e.n = g.n) AS n_edges FROM (SELECT DISTINCT n FROM c) g""")
def source_tpu_topology(spark, sf):
    """A chip mesh for each nation's suppliers, written as a document and read again."""
    k = F.col("s_suppkey")
    chip = F.struct(F.concat(F.lit("c"), k).alias("chip"), F.array(F.concat(F.lit("c"), k + 1), F.concat(F.lit("c"), k)).alias("ici_peers"))
    n = F.col("s_nationkey")
    doc = F.to_json(F.struct(F.when(n % 3 == 0, "v4").when(n % 3 == 1, "v5e").otherwise("v5p").alias("tpu_version"), F.array(F.lit(4), F.lit(8), (n % 5 + 1).cast("int")).alias("slice_shape"), F.col("chips")))
    body = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_list(chip).alias("chips")).select(F.concat(F.lit("slice-"), n).alias("source"), doc.alias("value"))
    shots, nodes, edges = ac.tpu_topology(body)
    count = lambda df, name: df.groupBy("source").agg(F.count("*").alias(name))
    return shots.select("source", "tpu_version", "partial").join(count(nodes, "n_nodes"), "source").join(count(edges, "n_edges"), "source")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS kind, date_diff('second', TIMESTAMP '1970-01-01', ts) AS event_ts FROM events WHERE date_diff('second', TIMESTAMP '1970-01-01', ts) > 1705000000")
def source_event_feed(spark, sf):
    """Cluster events after a point in time, landed as files and read through the event feed."""
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("kind"), epoch("ts").alias("event_ts"))
    landed = f"{shared_folder(spark)}/event-feed"
    e.write.parquet(landed)
    return registered(spark).read.format("event_feed").option("since", 1705000000).load(landed).select("event_id", "kind", "event_ts")


@query(f"WITH {_COV} SELECT series, round(ic, 6) AS intercept, round(be, 6) AS beta, round(phi, 6) AS phi, round(s2, 6) AS sigma2 FROM fit")
def bl_covariate_fit(spark, sf):
    cols = ("intercept", "beta", "phi", "sigma2")
    return rounded(_cov(spark, sf)[1], *cols).select("series", *cols)


@query(f"WITH {_COV} SELECT u.series, u.tick, round((u - phi * lag(u) OVER (PARTITION BY u.series ORDER BY tick)) / sqrt(s2), 6) AS standardized FROM u JOIN fit USING (series)")
def bl_covariate_residuals(spark, sf):
    y, fit = _cov(spark, sf)
    return rounded(ct.covariate_residuals(y, fit, ["series"], "c", "x"), "standardized").select("series", "tick", "standardized")


_LONG = """s AS (SELECT user_id % 10 AS series, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS tick, ln(greatest(value, 1e-9)) AS x FROM events),
d AS (SELECT *, lag(x) OVER (PARTITION BY series ORDER BY tick) AS p, avg(CASE WHEN tick < 120 THEN x END) OVER (PARTITION BY series) AS m FROM s),
f0 AS (SELECT series, sum(CASE WHEN tick BETWEEN 1 AND 119 THEN (x - m) * (p - m) END) / sum(CASE WHEN tick < 120 THEN (x - m) * (x - m) END) AS q FROM d GROUP BY series), f AS (SELECT series, greatest(-0.95, least(0.95, q + (1 + 3 * q) / 120)) AS phi FROM f0),
w AS (SELECT d.series, tick, x - phi * p AS w FROM d JOIN f USING (series) WHERE tick BETWEEN 1 AND 159),
g AS (SELECT series, count(CASE WHEN tick < 120 THEN 1 END) AS n1, count(CASE WHEN tick >= 120 THEN 1 END) AS n2, avg(CASE WHEN tick < 120 THEN w END) AS m1, avg(CASE WHEN tick >= 120 THEN w END) AS m2, greatest(var_samp(CASE WHEN tick < 120 THEN w END), 1e-9) AS s2 FROM w GROUP BY series),
h AS (SELECT *, n2 * (m2 - m1) AS st FROM g)"""


@query(f"""WITH {_LONG} SELECT series, round(-0.5::DOUBLE * ln(1 + n1 * 25) + 25 * st * st / (2 * s2 * (1 + n2 * 25)) - 0.5::DOUBLE * ln(1 + n2 * 25) - 25 * st * st / (2 * s2 * (1 + (n1 + n2) * 25)) + 0.5::DOUBLE * ln(1 + (n1 + n2) * 25), 6) AS log_bf FROM h""")
def nuisance_bayes_factor(spark, sf):
    e = table(spark, sf, "events")
    key = (F.col("user_id") % 10).alias("series")
    s = e.select(key, "ts", "event_id", F.log(F.greatest("value", F.lit(1e-9))).alias("x")).withColumn("tick", (F.row_number().over(Window.partitionBy("series").orderBy("ts", "event_id")) - 1).cast("bigint"))
    m = ev.whitened(s, ["series"], (0, 120), (120, 40), "x")
    return m.select("series", F.round(F.log(ct.bayes_factor(m)), 6).alias("log_bf"))


@query("""SELECT o_orderkey, o_orderkey % 2 = 0 AND f < 0.5 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS by_construction, (o_orderkey % 2 <> 0)::INT + (f >= 0.5)::INT + (o_orderkey % 3 = 0)::INT + (o_orderkey % 5 = 0)::INT AS n_unmet FROM (SELECT *, o_totalprice / 500000 AS f FROM orders)""")
def fleet_guarantee_conditions(spark, sf):
    k = F.col("o_orderkey")
    g = ct.fleet_guarantee(k % 2 == 0, F.col("o_totalprice") / 500000, k % 3 != 0, k % 5 != 0)
    return table(spark, sf, "orders").select("o_orderkey", g.alias("g")).select("o_orderkey", "g.by_construction", F.size("g.unmet").alias("n_unmet"))


@query(f"WITH {_HOT} SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'suppressed' WHEN t2 > 5.991 THEN 'fire' ELSE 'clean' END AS verdict FROM t2")
def hotelling_chi_square_verdict(spark, sf):
    from ..operators.detectors import hotelling

    j, c = _hot(spark, sf)
    t2 = hotelling(j, ["x", "y"], c)
    return j.select("vec_id", F.when((F.col("vec_id") % 3 == 0) | t2.isNull(), "suppressed").when(t2 > 5.991, "fire").otherwise("clean").alias("verdict"))


@query(f"WITH {VECTORS}, m AS (SELECT cell, avg(v1) AS m1, avg(v2) AS m2 FROM v GROUP BY cell) SELECT vec_id, round(CASE WHEN abs(m1) > 1e-12 THEN (v1 - m1) / m1 ELSE v1 - m1 END, 4) AS d1, round(CASE WHEN abs(m2) > 1e-12 THEN (v2 - m2) / m2 ELSE v2 - m2 END, 4) AS d2 FROM v JOIN m USING (cell)")
def fn_relative_deviation(spark, sf):
    v = vectors(spark, sf)
    j = v.join(v.groupBy("cell").agg(F.avg("v1").alias("m1"), F.avg("v2").alias("m2")), "cell")
    rel = F.zip_with(F.array("v1", "v2"), F.array("m1", "m2"), lambda x, m: F.when(F.abs(m) > 1e-12, (x - m) / m).otherwise(x - m))
    return j.select("vec_id", rel.alias("r")).select("vec_id", F.round(F.col("r")[0], 4).alias("d1"), F.round(F.col("r")[1], 4).alias("d2"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN lower(c_mktsegment) ELSE 'aggregate' END AS tier FROM customer")
def fn_tenant_tier(spark, sf):
    tiers = spark.createDataFrame([("BUILDING", "building"), ("MACHINERY", "machinery")], "c_mktsegment string, tier string")
    return table(spark, sf, "customer").join(tiers, "c_mktsegment", "left").select("c_custkey", F.coalesce("tier", F.lit("aggregate")).alias("tier"))


@query("SELECT event_id, len(list_filter([10.0, 50.0, 100.0, 200.0, 400.0], lambda v: v < value))::INT AS first_ge FROM events")
def fn_find_first_ge(spark, sf):
    cut = F.array(*[F.lit(x) for x in (10.0, 50.0, 100.0, 200.0, 400.0)])
    return table(spark, sf, "events").select("event_id", F.size(F.filter(cut, lambda v: v < F.col("value"))).alias("first_ge"))


@query("SELECT s_suppkey, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def bl_factor_membership(spark, sf):
    """Factors (nations) of each shard; a reference without a factor would be an error, found by the anti-join."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    lost = s.join(n, s.s_nationkey == n.n_nationkey, "left_anti")
    if not lost.isEmpty():
        raise ValueError("a shard references an unknown factor")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "n_nationkey", "n_regionkey")


@query("SELECT event_id, date_diff('second', TIMESTAMP '1970-01-01', ts) AS event_ts FROM events WHERE event_type = 'error' AND date_diff('second', TIMESTAMP '1970-01-01', ts) > (SELECT min(date_diff('second', TIMESTAMP '1970-01-01', ts)) + 1000000 FROM events)")
def src_events_since(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", epoch("ts").alias("event_ts"))
    since = e.agg(F.min("event_ts")).first()[0] + 1000000  # one number: where the reader left off
    return e.where((F.col("event_type") == "error") & (F.col("event_ts") > since)).select("event_id", "event_ts")


@query(f"""WITH {SERIES}, k AS (SELECT series, tick // 15 AS block, avg(pow(x, 4)) / (avg(pow(x, 2)) * avg(pow(x, 2))) AS sc FROM s GROUP BY 1, 2 HAVING count(*) = 15), e AS (SELECT series, block, 1 + CASE WHEN sc > 2.5 OR sc < 1.1 THEN 1 ELSE 0 END - 0.05::DOUBLE AS e FROM k)
SELECT series, block, round(exp(sum(ln(e)) OVER (PARTITION BY series ORDER BY block)), 6) AS m FROM e""")
def shape_kurtosis_e_process(spark, sf):
    from ..operators.detectors import hedged_wealth, kurtosis_score

    k = kurtosis_score(series(spark, sf), ["series"], 15, "x")
    out = hedged_wealth(k, ["series"], (F.col("score") > 2.5) | (F.col("score") < 1.1), 0.05, "block")
    return rounded(out, "m").select("series", "block", "m")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'firmware_push' WHEN 1 THEN 'config_change' END AS kind FROM events""")
def fn_event_kind(spark, sf):
    from ..sources.parsers import EVENT_CLASSES

    c = F.when(F.col("event_id") % 3 == 0, "firmware_push").when(F.col("event_id") % 3 == 1, "config_change").otherwise("party")
    return table(spark, sf, "events").select("event_id", F.when(c.isin(*EVENT_CLASSES), c).alias("kind"))


@query("""WITH c AS (SELECT user_id, event_type AS cat, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, CASE WHEN cat IN ('view', 'click') THEN 'family_A_page_cusum' ELSE 'family_A_betting' END AS family, CAST(sum(n) AS BIGINT) AS n FROM c WHERE cat <> 'error' GROUP BY 1, 2""")
def rs_counts_by_family(spark, sf):
    """Firing counts held as a map of categories, added up by detector family."""
    m = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"))
    c = m.select("user_id", F.explode("counts").alias("cat", "n")).where("cat <> 'error'")
    return c.groupBy("user_id", F.when(F.col("cat").isin("view", "click"), "family_A_page_cusum").otherwise("family_A_betting").alias("family")).agg(F.sum("n").alias("n"))


_WEALTH = ", o AS (SELECT *" + BETTING.split("\nSELECT series, round(lm, 6)")[0].split(", o AS (SELECT *", 1)[1]
_PEAKS = _PEAK.removeprefix(SERIES)
_FAM = f"""{_MIX}{_WEALTH}{_PEAKS},
fr0 AS (SELECT 'mixture' AS family, series, tick, m >= 20 AS fire FROM mix UNION ALL SELECT 'betting', series, tick, lm >= ln(20) FROM f JOIN o USING (series, i) UNION ALL SELECT 'spectral', series, tick, peak >= 0.35 FROM pk),
fr AS (SELECT family || series AS dataset, family, tick, CAST(sum(fire::INT) OVER (PARTITION BY family, series ORDER BY tick ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) >= 2 AS fire, series FROM fr0),
wi AS (SELECT dataset, 25 + (series % 7) * 4 AS lo, 34 + (series % 7) * 4 AS hi FROM (SELECT DISTINCT dataset, series FROM fr) z WHERE series % 6 <> 0),
{_NB[_NB.index("h AS (SELECT wi"):]},
sc AS (SELECT family, d.dataset, greatest(0, CASE WHEN nw IS NULL THEN 100 - coalesce(n, 0) * 0.22::DOUBLE ELSE 100 * (gain - coalesce(n, 0) * 0.22::DOUBLE) / (nw / (1 + exp(-5))) END) AS score FROM (SELECT DISTINCT family, dataset FROM fr) d LEFT JOIN g USING (dataset) LEFT JOIN ou USING (dataset))"""


@query(f"WITH RECURSIVE {_FAM} SELECT family, count(*) AS n, round(avg(score), 4) AS score, avg(score) >= CASE family WHEN 'spectral' THEN 40 ELSE 50 END AS accepted FROM sc GROUP BY family")
def nb_family_replay(spark, sf):
    """Replay of labelled series by three families: calibrate on a prefix, detect after it, smooth, score each series, average by family, compare with the family's floor."""
    from ..operators import detectors as dt
    from ..operators.evaluators import betting_walk
    from .views import calibrated

    r = calibrated(spark, sf)
    part = lambda df, name, fire: df.select(F.lit(name).alias("family"), "series", "tick", fire.alias("fire"))
    mix = part(dt.mixture(r, ["series"], 0.05, value="x"), "mixture", F.col("fire_now"))
    bet = part(betting_walk(r, ["series"], "x"), "betting", F.col("log_m") >= F.log(F.lit(20.0)))
    spectral = part(dt.spectral_peak(series(spark, sf), ["series"], 30, 3, 6, "x").where("peak is not null"), "spectral", F.col("peak") >= 0.35)
    f = rp.smoothed(mix.unionByName(bet).unionByName(spectral), ["family", "series"], 3, 2).select(F.concat("family", "series").alias("dataset"), "family", "series", "tick", F.col("smooth").alias("fire"))
    d = f.select("dataset", "family", "series").distinct()
    w = d.where("series % 6 <> 0").select("dataset", (25 + (F.col("series") % 7) * 4).alias("start")).withColumn("end", F.col("start") + 9)
    s = rp.replay_score(f, w, d).join(d, "dataset")
    g = s.groupBy("family").agg(F.count("*").alias("n"), F.avg("score").alias("a"))
    return g.select("family", "n", F.round("a", 4).alias("score"), (F.col("a") >= F.coalesce(*[F.when(F.col("family") == k, v) for k, v in rp.FLOORS.items()])).alias("accepted"))


@query(f"""WITH {SERIES}, w AS (SELECT series, tick, count(*) OVER z AS n, avg(x * x) OVER z AS a, avg(x * x * x * x) OVER z AS b FROM s WINDOW z AS (PARTITION BY series ORDER BY tick ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT series, tick - 19 AS start, round(b / (a * a), 6) AS score FROM w WHERE n = 20 AND (tick - 19) % 3 = 0""")
def bl_sliding_kurtosis(spark, sf):
    from ..operators.baselines import sliding_scores

    return rounded(sliding_scores(series(spark, sf), ["series"], 20, 3, "x"), "score")


@query(f"""WITH {VECTORS}, c AS (SELECT cell, count(*) AS n, avg(v1) AS m, covar_samp(v1, v2) AS k FROM v GROUP BY cell), a AS (SELECT count(*) AS n, avg(v1) AS m, covar_samp(v1, v2) AS k FROM v)
SELECT cell, CASE WHEN c.n < 48 THEN a.n ELSE c.n END AS n, round(CASE WHEN c.n < 48 THEN a.m ELSE c.m END, 6) AS m1, round(CASE WHEN c.n < 48 THEN a.k ELSE c.k END, 6) AS c12, CASE WHEN c.n >= 52 THEN 'strict' WHEN c.n >= 48 THEN 'pooled' ELSE 'aggregate' END AS confidence FROM c, a""")
def bl_multivariate_tiers(spark, sf):
    from ..operators.baselines import tiered_cells
    from ..operators.fleet import welford

    v = vectors(spark, sf)
    out = tiered_cells(welford(v, ["cell"], ["v1", "v2"]), welford(v.withColumn("all", F.lit(1)), ["all"], ["v1", "v2"]), 52, 48)
    return out.select("cell", "n", F.round(F.col("mean")[0], 6).alias("m1"), F.round(F.col("cov")[0][1], 6).alias("c12"), "confidence")


@query(f"""WITH {SERIES}, e AS (SELECT series % 16 AS shard, sec // 86400 AS tick, greatest(avg(x) - 3, 1e-12) AS m FROM s GROUP BY 1, 2), a AS (SELECT tick, sum(ln(m)) AS l FROM e GROUP BY tick) SELECT tick, round(l, 6) AS log_fleet_e FROM a""")
def fleet_merge_wealth(spark, sf):
    """Fleet evidence of shards' wealth: logarithms floored at 1e-12, then the product."""
    from ..operators.fleet import combine_product

    s = series(spark, sf)
    e = s.groupBy((F.col("series") % 16).alias("shard"), F.floor(F.col("sec") / 86400).alias("tick")).agg(F.log(F.greatest(F.avg("x") - 3, F.lit(1e-12))).alias("log_e"))
    return rounded(combine_product(e, ["tick"]).select("tick", "log_fleet_e"), "log_fleet_e")


@query()
def guarantee_manifest(spark, sf):
    return ct.manifest(spark.createDataFrame(ev.GUARANTEES, "prefix string, family string, validity string, alpha_policy string"))


__all__ = ["QUERIES", "SQL"]
