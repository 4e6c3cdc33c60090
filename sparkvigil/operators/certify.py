"""Certification rules over measured cells, resampler summaries and fleet guarantees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import baselines as bl

#: Measured fields that speak for each evidence class. Fixed values.
INSTRUMENTS = {"test_martingale": ("increment_estimator",), "terminal_e_value": ("exceedance", "mean_e"), "e_process": ("stopped_mean", "crossing_rate")}
INERT_BELOW = 0.10


def guard(cls: Column, present: Column, non_finite: Column, sd: Column) -> Column:
    """NON_FINITE wealth or estimator; VOID if only other classes' instruments are there; VACUOUS if the estimator never moved; else OK."""
    own = F.coalesce(*[F.when(cls == c, F.array(*map(F.lit, names))) for c, names in INSTRUMENTS.items()], F.array().cast("array<string>"))
    every = F.array(*[F.lit(x) for names in INSTRUMENTS.values() for x in names])
    mine, foreign = F.size(F.array_intersect(own, present)), F.size(F.array_intersect(F.array_except(every, own), present))
    moving = (cls == "test_martingale") & F.array_contains(present, "increment_estimator")
    return (
        F.when(non_finite > 0, "NON_FINITE").when((mine == 0) & (foreign > 0), "VOID")
        .when(moving & (sd.isNull() | F.isnan(sd) | (F.abs(sd) == float("inf"))), "NON_FINITE").when(moving & (sd == 0), "VACUOUS").otherwise("OK")
    )


def verdict(s2: Column, s3: Column, n_powered: Column, s4: Column) -> Column:
    """USE, ADVISORY, REFUSE or NOT_EXECUTABLE from validity, power and budget, in that order; an unknown validity is an error."""
    return (
        F.when(s2 == "VOID", "NOT_EXECUTABLE").when(s2 == "REFUTED", "REFUSE").when((s2 == "MISSING") | (s3 == "MISSING"), "NOT_EXECUTABLE")
        .when(s2.isNull() | (s2 != "PASS"), F.raise_error(F.concat(F.lit("unknown validity "), F.coalesce(s2, F.lit("null")))).cast("string"))
        .when(n_powered == 0, "ADVISORY").when(s4.isin("REFUSE", "UNPRICED"), "ADVISORY").otherwise("USE")
    )


def powered(cells: DataFrame, key: str) -> DataFrame:
    """Cells with a detection rate of at least the inertness floor, and all, by detector."""
    return cells.groupBy(key).agg(F.sum((F.col("detection_rate") >= INERT_BELOW).cast("bigint")).alias("n_powered"), F.count("*").alias("n_cells"), F.min("detection_rate").alias("worst"))


def coverage(cells: DataFrame, classes: DataFrame, key: str, floor: float = 0.5) -> DataFrame:
    """For each detector and fault class, whether its detection at the canonical severity reaches the floor; classes without a cell are not covered."""
    d = cells.select(key).distinct().crossJoin(F.broadcast(classes))  # a handful of classes
    best = cells.where("canonical").groupBy(key, "fault_class").agg(F.max("detection_rate").alias("rate"))
    return d.join(best, [key, "fault_class"], "left").withColumn("covered", F.coalesce(F.col("rate") >= floor, F.lit(False)))


def across_seeds(counts: DataFrame, alpha: Column, windows: int) -> DataFrame:
    """Mean count of each family, its Poisson upper bound, and the share of seeds within it."""
    mean = alpha * windows
    bound = F.ceil(mean + 1.96 * F.sqrt(mean))
    c = counts.withColumn("bound", bound)
    return c.groupBy("family").agg(F.avg("n").alias("mean"), F.first("bound").alias("bound"), F.sum((F.col("n") <= F.col("bound")).cast("bigint")).alias("passes"), F.avg((F.col("n") <= F.col("bound")).cast("double")).alias("pass_rate"))


def fleet_guarantee(valid: Column, fault_fraction: Column, coupled: Column, scalar: Column, breakdown: float = 0.5) -> Column:
    """STRUCT<by_construction, under_breakdown, unmet>: selection error is bounded only if all four conditions hold."""
    under = fault_fraction < breakdown
    unmet = F.array_compact(F.array(F.when(~valid, "e-value"), F.when(~under, "fault fraction"), F.when(~coupled, "coupling"), F.when(~scalar, "scalar common mode")))
    return F.struct((valid & under & coupled & scalar).alias("by_construction"), under.alias("under_breakdown"), unmet.alias("unmet"))


def substrate_variance(seasonal: Column, ar_p: Column, ar1: Column) -> Column:
    """Seasonal, else AR(p), else AR(1) innovation variance; zero counts as missing."""
    some = lambda c: F.when(c != 0, c)
    return F.coalesce(some(seasonal), some(ar_p), ar1)


def substrate(df: DataFrame, keys: list[str], period: int, value: str = "value") -> DataFrame:
    """Fitted substrate of each series: AR(1) of the values and of the values without their seasonal means."""
    plain = bl.ar1(df, keys, value)
    d = bl.deseasonalized(df, keys, period, value)
    seasonal = bl.ar1(d, keys, "deseasonalized").select(*keys, F.col("phi").alias("seasonal_phi"), F.col("innovation_variance").alias("seasonal_variance"))
    return plain.join(seasonal, keys)


def covariate_fit(df: DataFrame, keys: list[str], covariate: str, value: str = "value", by: str = "tick", ridge: float = 1e-8) -> DataFrame:
    """Intercept and slope by ridge normal equations, then an AR(1) of the residuals if it lowers the AIC, for each series of 16 rows or more."""
    c, y = F.col(covariate), F.col(value)
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(c).alias("sc"), F.sum(c * c).alias("scc"), F.sum(y).alias("sy"), F.sum(c * y).alias("scy")).where("n >= 16")
    a00, a11 = F.col("n") * (1 + ridge), F.col("scc") + ridge * F.greatest(F.col("scc") / F.col("n"), F.lit(1e-12)) * F.col("n")
    det = a00 * a11 - F.col("sc") * F.col("sc")
    g = g.select(*keys, "n", ((a11 * F.col("sy") - F.col("sc") * F.col("scy")) / det).alias("intercept"), ((a00 * F.col("scy") - F.col("sc") * F.col("sy")) / det).alias("beta"))
    u = df.join(g, keys).withColumn("u", y - F.col("intercept") - F.col("beta") * c)
    w = Window.partitionBy(*keys)
    u = u.withColumn("_d", F.col("u") - F.avg("u").over(w)).withColumn("_l", F.lag("_d").over(w.orderBy(by)))
    s = u.groupBy(*keys).agg(F.first("n").alias("n"), F.first("intercept").alias("intercept"), F.first("beta").alias("beta"), (F.sum(F.col("_d") * F.col("_d")) / F.count("*")).alias("g0"), (F.sum(F.col("_d") * F.col("_l")) / F.count("*")).alias("g1"))
    k = F.col("g1") / F.col("g0")
    v = F.col("g0") * (1 - k * k)
    better = (F.abs(k) <= 1) & (F.col("n") * F.log(F.greatest(v, F.lit(1e-18))) + 2 < F.col("n") * F.log(F.greatest("g0", F.lit(1e-18))))
    return s.select(*keys, "n", "intercept", "beta", F.when(better, k).otherwise(0.0).alias("phi"), F.when(better, v).otherwise(F.col("g0")).alias("sigma2"))


def covariate_residuals(df: DataFrame, fit: DataFrame, keys: list[str], covariate: str, value: str = "value", by: str = "tick") -> DataFrame:
    """One-step standardised innovations of a frozen fit."""
    d = df.join(fit.drop("n"), keys).withColumn("_u", F.col(value) - F.col("intercept") - F.col("beta") * F.col(covariate))
    return d.withColumn("standardized", (F.col("_u") - F.col("phi") * F.lag("_u").over(Window.partitionBy(*keys).orderBy(by))) / F.sqrt("sigma2")).drop("_u")


def bayes_factor(m: DataFrame, tau: float = 25.0) -> Column:
    """Mean-shift Bayes factor with the calibration variance plugged in (withdrawn as evidence: its null mean exceeds one; the guarded path refuses it)."""
    s2 = F.greatest("v1", F.lit(1e-9))

    def marginal(total: Column, n: Column) -> Column:
        return tau * total * total / (2 * s2 * (1 + n * tau)) - 0.5 * F.log(1 + n * tau)

    st = F.col("n2") * (F.col("m2") - F.col("m1"))
    return F.exp(marginal(F.lit(0.0), F.col("n1")) + marginal(st, F.col("n2")) - marginal(st, F.col("n1") + F.col("n2")))


def manifest(rows: DataFrame) -> DataFrame:
    """One JSON document of the guarantee rows, sorted by prefix: a bounded registry."""
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("prefix", "family", "validity", "alpha_policy")))).alias("manifest"))
