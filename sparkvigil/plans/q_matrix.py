"""Queries of matrix and iterative estimators: SQL cannot express them, tests hold them against plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernel_tests as kt
from ..operators import matrix as mx
from ..operators import robust as rb
from .registry import registry, rounded
from .views import VECTORS, series, table, vectors

QUERIES, SQL, query = registry()


def _fleet(spark, sf):
    """Daily means of eight shards; ticks that every shard has."""
    s = series(spark, sf)
    d = s.groupBy((F.col("series") % 8).alias("shard"), F.floor(F.col("sec") / 86400).alias("day")).agg(F.avg("x").alias("value"))
    full = d.groupBy("day").agg(F.count("*").alias("n")).where("n = 8").select("day", F.row_number().over(_by("day")).alias("tick"))
    return d.join(full, "day").select(F.lit("all").alias("fleet"), "shard", (F.col("tick") - 1).alias("tick"), "value", (F.col("shard") % 4).alias("rack"), F.floor(F.col("shard") / 4).alias("zone"))


def _by(by):
    from pyspark.sql import Window

    return Window.orderBy(by)  # one row a day


@query()
def universal_inference(spark, sf):
    return rounded(mx.universal_inference_e(series(spark, sf), ["series"], (0, 20), (20, 20), "x"), "e")


@query()
def sequential_universal_inference(spark, sf):
    return rounded(mx.sequential_ui_process(series(spark, sf), ["series"], "x"), "log_e")


@query()
def multi_factor_residuals(spark, sf):
    return rounded(mx.deflated(_fleet(spark, sf), "fleet", 6, 2)[0], "residual")


@query()
def factor_energies(spark, sf):
    """Shares of the energy that robust factors take, one after the other."""
    return rounded(mx.deflated(_fleet(spark, sf), "fleet", 6, 2)[1], "share")


@query()
def crossed_domain_residuals(spark, sf):
    return rounded(mx.crossed(_fleet(spark, sf), "fleet", 6, ("rack", "zone")), "residual")


@query()
def localize_faults(spark, sf):
    return rounded(mx.localised(_fleet(spark, sf), "fleet", 6, 6, 0.5, ("rack", "zone"), "zone"), "e")


@query()
def robust_covariance(spark, sf):
    out = rb.cell_covariances(vectors(spark, sf), "cell", ["vec_id"], _DIMS)
    return out.select("cell", "n", "method", F.round("outliers", 6).alias("outliers"), F.round(F.col("cov")[0][0], 6).alias("c11"))


def _kernel(spark, sf):
    """Each cell's later vectors and the pool of its first 20."""
    first, live = kt.split_baseline(vectors(spark, sf), ["cell"], ["vec_id"], _DIMS, 20)
    return live, kt.baseline_pool(first, ["cell"], ["vec_id"], _DIMS, 20)


_DIMS = ["v1", "v2", "v3"]
_NUMBERED = f"{VECTORS}, nv AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY vec_id) AS rn FROM v), b AS (SELECT * FROM nv WHERE rn <= 20), l AS (SELECT *, rn - 20 AS i FROM nv WHERE rn > 20)"
_RBF = "exp(-(({a}.v1 - {b}.v1) * ({a}.v1 - {b}.v1) + ({a}.v2 - {b}.v2) * ({a}.v2 - {b}.v2) + ({a}.v3 - {b}.v3) * ({a}.v3 - {b}.v3)) / 2)"
_K = lambda a, b: _RBF.format(a=a, b=b)
_YY = f"yy AS (SELECT x.cell, sum({_K('x', 'y')}) FILTER (x.rn <> y.rn) / 380 AS off, sum({_K('x', 'y')}) / 400 AS norm FROM b x JOIN b y ON x.cell = y.cell GROUP BY x.cell)"
_CROSS = f"xy AS (SELECT l.cell, l.i, l.vec_id, avg({_K('l', 'b')}) AS k FROM l JOIN b ON l.cell = b.cell GROUP BY l.cell, l.i, l.vec_id)"


@query()
def witness_betting(spark, sf):
    """Log-wealth of the witness in random-feature space."""
    live, pool = _kernel(spark, sf)
    return rounded(kt.feature_witness_verdicts(live, pool, ["cell"], ["vec_id"], _DIMS, 0.05), "log_s").select("cell", "vec_id", "log_s")


@query(f"""WITH {_NUMBERED}, {_YY}, {_CROSS}, xx AS (SELECT a.cell, a.i, sum({_K('x', 'y')}) / 12 AS s FROM l a JOIN l x ON x.cell = a.cell AND x.i BETWEEN a.i - 3 AND a.i JOIN l y ON y.cell = a.cell AND y.i BETWEEN a.i - 3 AND a.i AND y.i <> x.i GROUP BY a.cell, a.i)
SELECT xy.cell, xy.vec_id, round(CASE WHEN xy.i >= 4 THEN s - 2 * avg(k) OVER (PARTITION BY xy.cell ORDER BY xy.i ROWS 3 PRECEDING) + off END, 6) AS u FROM xy JOIN yy USING (cell) LEFT JOIN xx ON xx.cell = xy.cell AND xx.i = xy.i""")
def sliding_mmd(spark, sf):
    """Unbiased discrepancy of each cell's last four vectors from its first twenty."""
    live, pool = _kernel(spark, sf)
    return rounded(kt.sliding_mmd(live, pool, ["cell"], ["vec_id"], _DIMS, 4), "u").select("cell", "vec_id", "u")


@query(f"""WITH RECURSIVE {_NUMBERED}, {_YY}, {_CROSS}, d0 AS (SELECT xy.cell, xy.vec_id, CASE WHEN xy.vec_id % 9 = 4 THEN 'traffic_pct_below_gate' END AS why, sqrt(greatest(0, 1 - 2 * k + norm)) AS d FROM xy JOIN yy USING (cell)),
o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY vec_id) AS i FROM d0 WHERE why IS NULL), m AS (SELECT *, avg(d) OVER w AS mu, avg(d * d) OVER w AS m2 FROM o WINDOW w AS (PARTITION BY cell ORDER BY i)),
f(cell, i, wealth, bet) AS (SELECT cell, 0::BIGINT, 1::DOUBLE, 0::DOUBLE FROM (SELECT DISTINCT cell FROM d0) UNION ALL
SELECT cell, i, CASE WHEN i >= 10 THEN greatest(1e-12::DOUBLE, wealth * greatest(0::DOUBLE, 1 + nb * z)) ELSE wealth END, CASE WHEN i >= 10 THEN nb ELSE bet END FROM (
  SELECT f.cell, m.i, f.wealth, f.bet, greatest(-1::DOUBLE, least(1::DOUBLE, (m.d - m.mu) / (3 * sqrt(greatest(m.m2 - m.mu * m.mu, 1e-12))))) AS z, CASE WHEN abs(m.mu / m.m2) <= 0.999999 THEN m.mu / m.m2 ELSE greatest(-0.999999::DOUBLE, least(0.999999::DOUBLE, f.bet + m.mu / (1 + f.bet * m.mu) / greatest(m.m2, 1e-6))) END AS nb FROM f JOIN m ON m.cell = f.cell AND m.i = f.i + 1)),
t AS (SELECT d0.*, coalesce(max(o.i) OVER (PARTITION BY d0.cell ORDER BY d0.vec_id), 0) AS i FROM d0 LEFT JOIN o USING (cell, vec_id))
SELECT t.cell, t.vec_id, round(t.d, 6) AS distance, round(wealth, 6) AS wealth, CASE WHEN why IS NOT NULL OR t.i < 10 THEN 'suppressed' WHEN wealth >= 1.25 THEN 'fire' ELSE 'clean' END AS verdict,
coalesce(why, CASE WHEN t.i < 10 THEN 'emmd_warming_moments' WHEN wealth >= 1.25 THEN 'emmd_wealth_exceeded' ELSE 'below_threshold' END) AS reason FROM t JOIN f ON f.cell = t.cell AND f.i = t.i""")
def embedding_verdicts(spark, sf):
    """Bets on the distance to the mean embedding of a cell's first vectors; every ninth vector is behind a gate."""
    live, pool = _kernel(spark, sf)
    gated = live.withColumn("why", F.when(F.col("vec_id") % 9 == 4, "traffic_pct_below_gate"))
    out = kt.embedding_verdicts(gated, pool, ["cell"], ["vec_id"], _DIMS, 0.8, why="why")
    return rounded(out, "distance", "wealth").select("cell", "vec_id", "distance", "wealth", "verdict", "reason")


@query(f"""WITH RECURSIVE {_NUMBERED}, {_CROSS}, q AS (SELECT l.cell, l.i, avg(v1) OVER w AS v1, avg(v2) OVER w AS v2, avg(v3) OVER w AS v3 FROM l WINDOW w AS (PARTITION BY cell ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT xy.cell, xy.i, xy.vec_id, k - CASE WHEN xy.i > 1 THEN {_K('l', 'q')} ELSE 0 END AS f FROM xy JOIN l ON l.cell = xy.cell AND l.i = xy.i JOIN q ON q.cell = xy.cell AND q.i = xy.i),
s(cell, i, vec_id, w, ls, lam, h, top) AS (SELECT cell, 0::BIGINT, NULL::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE FROM (SELECT DISTINCT cell FROM g) UNION ALL
SELECT cell, i, vec_id, f0, ls + ln(greatest(d, 1e-12)), greatest(-0.5::DOUBLE, least(0.5::DOUBLE, lam - 2 / (2 - ln(3::DOUBLE)) * z / (h + z * z))), h + z * z, greatest(top, abs(f)) FROM (SELECT *, -f / d AS z FROM (SELECT *, 1 + lam * f AS d FROM (
  SELECT s.cell, g.i, g.vec_id, g.f AS f0, s.ls, s.lam, s.h, s.top, CASE WHEN g.i > 11 AND s.top > 0 THEN g.f / s.top ELSE g.f END AS f FROM s JOIN g ON g.cell = s.cell AND g.i = s.i + 1))))
SELECT cell, vec_id, round(w, 6) AS witness, round(ls, 6) AS log_s, CASE WHEN ls >= -ln(0.5::DOUBLE) THEN 'fire' ELSE 'clean' END AS verdict, bool_or(ls >= -ln(0.5::DOUBLE)) OVER (PARTITION BY cell ORDER BY i) AS alarmed FROM s WHERE i > 0""")
def kernel_witness_verdicts(spark, sf):
    """Betting e-process on the kernel witness with its running maximum."""
    live, pool = _kernel(spark, sf)
    return rounded(kt.kernel_witness_verdicts(live, pool, ["cell"], ["vec_id"], _DIMS, 0.5), "witness", "log_s").select("cell", "vec_id", "witness", "log_s", "verdict", "alarmed")


@query()
def seeded_normals(spark, sf):
    """Bit-exact generator: the uniforms of each part's seed."""
    import pandas as pd

    def run(batches):
        for p in batches:
            u = [mx.mulberry32(int(k), 2) for k in p.p_partkey]
            yield pd.DataFrame({"p_partkey": p.p_partkey, "u1": [float(x[0]) for x in u], "u2": [float(x[1]) for x in u]})

    return table(spark, sf, "part").select("p_partkey").mapInPandas(run, "p_partkey long, u1 double, u2 double")


@query()
def mmd_and_embedding_bets(spark, sf):
    """Of each cell: the discrepancy of its last twenty vectors (all later ones, where fewer: none), and the final wealth of bets on the distance."""
    live, pool = _kernel(spark, sf)
    last = F.struct("vec_id", "x")
    u = kt.sliding_mmd(live, pool, ["cell"], ["vec_id"], _DIMS, 20).withColumn("x", F.col("u")).groupBy("cell").agg(F.max(last).alias("l")).select("cell", F.col("l.x").alias("u"))
    w = kt.embedding_verdicts(live, pool, ["cell"], ["vec_id"], _DIMS, 0.05).withColumn("x", F.col("wealth")).groupBy("cell").agg(F.max(last).alias("l")).select("cell", F.col("l.x").alias("wealth"))
    return rounded(u.join(w, "cell"), "u", "wealth")


@query()
def instrumented_residuals(spark, sf):
    """Factors: the mean of each rack, as if measured."""
    f = _fleet(spark, sf)
    factors = f.groupBy(F.concat(F.lit("rack"), "rack").alias("factor"), "tick").agg(F.avg("value").alias("value"))
    members = f.select("shard", F.concat(F.lit("rack"), "rack").alias("factor")).distinct()
    return rounded(mx.instrumented_residuals(f, factors, members, "fleet", 6), "residual")


@query()
def null_battery(spark, sf):
    """Mean and largest e-value of two constructions under every null law (input: seeded draws, not a table)."""
    from ..operators import evidence as ev

    x = mx.null_trajectories(spark, 2000, 300, seed=11)
    keys = ["law", "trajectory"]
    u = mx.universal_inference_e(x, keys, (0, 40), (40, 260)).withColumnRenamed("e", "ui")
    m = ev.whitened(x, keys, (0, 40), (40, 260))
    both = u.join(m.select(*keys, ev.safe_t(m).alias("t")), keys)
    return rounded(both.groupBy("law").agg(F.count("*").alias("n"), F.avg("ui").alias("mean_ui"), F.max("ui").alias("max_ui"), F.avg("t").alias("mean_safe_t")), "mean_ui", "max_ui", "mean_safe_t")
