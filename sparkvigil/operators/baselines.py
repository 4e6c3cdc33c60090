"""Baselines and calibration as group-by and window plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hac_inflation
from ..functions.windows import lagged, ordered


def clean_null(df: DataFrame, keys: list[str], value: str = "value", z_cut: float = 3.0, var_floor: float = 1e-6) -> DataFrame:
    """Trimmed count, mean and population variance after dropping values beyond z_cut scaled median deviations; everything is used if all are dropped."""
    med = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    dev = df.join(med, keys).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    mad = dev.groupBy(*keys).agg(F.first("_m").alias("_m"), F.greatest(F.median("_d") * 1.4826, F.lit(1e-12)).alias("_s"))
    near = F.abs(F.col(value) - F.col("_m")) / F.col("_s") <= z_cut
    x = F.when(near, F.col(value))
    out = df.join(mad, keys).groupBy(*keys).agg(F.count(x).alias("n"), F.coalesce(F.avg(x), F.avg(value)).alias("mean"), F.coalesce(F.var_pop(x), F.var_pop(value)).alias("_v"))
    return out.select(*keys, "n", "mean", F.greatest("_v", var_floor * F.col("mean") * F.col("mean"), F.lit(1e-12)).alias("variance"))


def seasonal_baseline(df: DataFrame, n_bins: int, value: str = "value", bin_col: str = "bin", min_strict: int = 60, min_pooled: int = 20, radius: int = 0, cyclic: bool = False) -> DataFrame:
    """Clean null of each context bin: strict or pooled by its trimmed count, then pooled with neighbours, then the aggregate."""
    one = df.select(F.col(bin_col).alias("bin"), F.col(value).alias("value"))
    own = clean_null(one, ["bin"])
    shifted = one.withColumn("to", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("to", F.col("bin") - F.col("to"))
    shifted = shifted.withColumn("to", F.pmod("to", F.lit(n_bins))) if cyclic else shifted.where(f"`to` between 0 and {n_bins - 1}")
    wide = clean_null(shifted.select(F.col("to").alias("bin"), "value"), ["bin"])
    whole = clean_null(one.withColumn("all", F.lit(1)), ["all"])
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    as_struct = lambda d, c: d.select(*[k for k in ("bin",) if k in d.columns], F.struct("n", "mean", "variance").alias(c))
    all3 = bins.join(as_struct(own, "o"), "bin", "left").join(as_struct(wide, "w"), "bin", "left").crossJoin(F.broadcast(as_struct(whole, "a")))  # the aggregate is one row
    use_own, use_wide = F.coalesce(F.col("o.n") >= min_pooled, F.lit(False)), F.coalesce(F.col("w.n") >= min_pooled, F.lit(False)) & F.lit(radius > 0)
    pick = F.when(use_own, F.col("o")).when(use_wide, F.col("w")).otherwise(F.col("a"))
    kind = F.when(F.coalesce(F.col("o.n") >= min_strict, F.lit(False)), "strict").when(use_own | use_wide, "pooled").otherwise("aggregate")
    return all3.select("bin", pick.alias("p"), kind.alias("confidence")).select("bin", "p.n", "p.mean", "p.variance", "confidence")


def seasonal_residual(df: DataFrame, baseline: DataFrame, value: str = "value") -> DataFrame:
    return df.join(baseline.select("bin", F.col("mean").alias("_b")), "bin").withColumn("residual", F.col(value) - F.col("_b")).drop("_b")


def autocovariances(df: DataFrame, keys: list[str], lags: int, value: str = "value", by: str = "tick") -> DataFrame:
    """Autocovariance at each lag 0..lags around the series mean, divided by the full length; lags from the length on are 0."""
    w = ordered(keys, by)
    c = df.withColumn("_x", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    c = c.select(*keys, "_x", *[F.lag("_x", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    g = c.groupBy(*keys).agg(F.count("*").alias("n"), *[(F.coalesce(F.sum(F.col("_x") * F.col(f"_l{k}" if k else "_x")), F.lit(0.0)) / F.count("*")).alias(f"g{k}") for k in range(lags + 1)])
    return g.select(*keys, "n", F.posexplode(F.array(*[f"g{k}" for k in range(lags + 1)])).alias("lag", "acov"))


def ar1(df: DataFrame, keys: list[str], value: str = "value", by: str = "tick", corrected: bool = True) -> DataFrame:
    """n, mean, variance (sample), phi and innovation variance of each series.

    phi is corrected for small samples by (1 + 3 phi) / n and kept in +-0.95;
    it is 0 below three values or without variance.
    """
    w = ordered(keys, by)
    c = df.withColumn("_m", F.avg(value).over(Window.partitionBy(*keys))).withColumn("_x", F.col(value) - F.col("_m"))
    c = c.withColumn("_p", F.lag("_x").over(w))
    g = c.groupBy(*keys).agg(F.count("*").alias("n"), F.first("_m").alias("mean"), F.coalesce(F.sum(F.col("_x") * F.col("_p")), F.lit(0.0)).alias("_a"), F.sum(F.col("_x") * F.col("_x")).alias("_b"))
    raw = F.col("_a") / F.col("_b")
    phi = raw + (1 + 3 * raw) / F.col("n") if corrected else raw
    phi = F.when((F.col("n") < 3) | (F.col("_b") < 1e-12), 0.0).otherwise(F.greatest(F.lit(-0.95), F.least(F.lit(0.95), phi)))
    g = g.withColumn("phi", phi).withColumn("variance", F.greatest(F.col("_b") / F.greatest(F.col("n") - 1, F.lit(1)), F.lit(1e-12)))
    return g.select(*keys, "n", "mean", "variance", "phi", F.greatest(F.col("variance") * (1 - F.least(F.col("phi") * F.col("phi"), F.lit(0.9999))), F.lit(1e-12)).alias("innovation_variance"))


def ar1_of_prefix(df: DataFrame, keys: list[str], cal_len: int, value: str = "value", by: str = "tick") -> DataFrame:
    """Rows from tick cal_len on with mean, variance and phi of the ticks before it (see ar1).

    All of it is windows of one partitioning and one order: a single exchange
    and sort, no join of a series with itself.
    """
    whole, w = Window.partitionBy(*keys), ordered(keys, by)
    early = F.col(by) < cal_len
    d = df.withColumn("mean", F.avg(F.when(early, F.col(value))).over(whole)).withColumn("_d", F.when(early, F.col(value) - F.col("mean")))
    d = d.withColumn("_p", F.lag("_d").over(w))
    d = d.withColumns({"_n": F.count("_d").over(whole), "_a": F.coalesce(F.sum(F.col("_d") * F.col("_p")).over(whole), F.lit(0.0)), "_b": F.sum(F.col("_d") * F.col("_d")).over(whole)})
    raw = F.col("_a") / F.col("_b")
    phi = F.when((F.col("_n") < 3) | (F.col("_b") < 1e-12), 0.0).otherwise(F.greatest(F.lit(-0.95), F.least(F.lit(0.95), raw + (1 + 3 * raw) / F.col("_n"))))
    d = d.withColumn("variance", F.greatest(F.col("_b") / F.greatest(F.col("_n") - 1, F.lit(1)), F.lit(1e-12))).withColumn("phi", phi)
    return d.where(~early).drop("_d", "_p", "_n", "_a", "_b")


def levinson(gamma: list[Column]) -> tuple[list[Column], Column, list[Column]]:
    """Yule-Walker by Levinson and Durbin, unrolled for a small order: coefficients, innovation variance, reflections."""
    phi: list[Column] = []
    var, reflections = gamma[0], []
    for m in range(1, len(gamma)):
        num = gamma[m]
        for i in range(1, m):
            num = num - phi[i - 1] * gamma[m - i]
        k = F.when(var > 0, num / var).otherwise(0.0)
        phi = [phi[i] - k * phi[m - 2 - i] for i in range(m - 1)] + [k]
        var = F.greatest(var * (1 - k * k), F.lit(0.0))
        reflections.append(k)
    return phi, var, reflections


def ar_p(df: DataFrame, keys: list[str], max_order: int, value: str = "value", by: str = "tick", criterion: str = "aic") -> DataFrame:
    """Order with the least AIC or BIC among 1..max_order, with its coefficients and innovation variance.

    Levels are added one select at a time, so no expression repeats the recursion below it.
    """
    w = ordered(keys, by)
    c = df.withColumn("_x", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    c = c.select(*keys, "_x", *[F.lag("_x", k).over(w).alias(f"_l{k}") for k in range(1, max_order + 1)])
    g = c.groupBy(*keys).agg(F.count("*").alias("n"), *[(F.coalesce(F.sum(F.col("_x") * F.col(f"_l{k}" if k else "_x")), F.lit(0.0)) / F.count("*")).alias(f"g{k}") for k in range(max_order + 1)])
    g = g.withColumn("v0", F.col("g0"))
    n, fits = F.col("n"), []
    for m in range(1, max_order + 1):
        num = F.col(f"g{m}")
        for i in range(1, m):
            num = num - F.col(f"p{m - 1}_{i}") * F.col(f"g{m - i}")
        g = g.withColumn(f"k{m}", F.when(F.col(f"v{m - 1}") > 0, num / F.col(f"v{m - 1}")).otherwise(0.0))
        g = g.withColumns({f"p{m}_{i}": F.col(f"p{m - 1}_{i}") - F.col(f"k{m}") * F.col(f"p{m - 1}_{m - i}") for i in range(1, m)} | {f"p{m}_{m}": F.col(f"k{m}"), f"v{m}": F.greatest(F.col(f"v{m - 1}") * (1 - F.col(f"k{m}") * F.col(f"k{m}")), F.lit(0.0))})
        cost = n * F.log(F.col(f"v{m}")) + (2 * m if criterion == "aic" else F.log(n) * m)
        usable = (F.col(f"v{m}") > 0) & (m <= F.greatest(F.lit(1), F.least(F.lit(30), F.floor(n / 10)))) & (n >= 4)
        fits.append(F.when(usable, F.struct(cost.alias("ic"), F.lit(m).alias("p"), F.array(*[f"p{m}_{i}" for i in range(1, m + 1)]).alias("phi"), F.col(f"v{m}").alias("var"))))
    best = F.array_min(F.array_compact(F.array(*fits)))
    g = g.withColumn("b", best)
    return g.select(*keys, "n", F.coalesce("b.p", F.lit(0)).alias("p"), F.coalesce("b.phi", F.array().cast("array<double>")).alias("phi"), F.coalesce("b.var", "g0").alias("innovation_variance"), F.col("b.ic").alias("ic"))


def prewhitened(df: DataFrame, keys: list[str], mean: Column, phi: list[Column], value: str = "value", by: str = "tick") -> Column:
    """mean plus the one-step residual; deviations before the start count as 0."""
    w = ordered(keys, by)
    out = F.col(value)
    for i, p in enumerate(phi, 1):
        out = out - p * lagged(F.col(value) - mean, i, w)
    return out


def dominant_period(df: DataFrame, keys: list[str], max_lag: int, value: str = "value", by: str = "tick", min_period: int = 10, min_acf: float = 0.25) -> DataFrame:
    """Smallest local maximum of the autocorrelation of at least min_acf in min_period..n/3, or 0."""
    g = autocovariances(df, keys, max_lag, value, by)
    w = Window.partitionBy(*keys).orderBy("lag")
    a = g.withColumn("acf", F.col("acov") / F.first("acov").over(w)).withColumn("_p", F.lag("acf").over(w)).withColumn("_n", F.lead("acf").over(w))
    top = F.greatest(F.lit(min_period + 1), F.least(F.floor(F.col("n") / 3), F.col("n") - 2))
    peak = (F.col("lag").between(min_period, top)) & (F.col("n") >= 3 * min_period) & (F.col("acf") > F.col("_p")) & (F.col("acf") > F.col("_n")) & (F.col("acf") >= min_acf)
    hit = F.when(peak, F.struct("lag", "acf"))
    return a.groupBy(*keys).agg(F.min(hit).alias("h")).select(*keys, F.coalesce("h.lag", F.lit(0)).alias("period"), F.coalesce("h.acf", F.lit(0.0)).alias("acf"))


def deseasonalized(df: DataFrame, keys: list[str], period: int, value: str = "value", start: int = 0) -> DataFrame:
    """Phase, the phase's mean deviation from the series mean, and the value without it."""
    p = df.withColumn("phase", F.pmod(F.col("tick") + start, F.lit(period)))
    mean = F.avg(value).over(Window.partitionBy(*keys))
    p = p.withColumn("_d", F.col(value) - mean)
    return p.withColumn("seasonal", F.avg("_d").over(Window.partitionBy(*keys, "phase"))).withColumn("deseasonalized", F.col(value) - F.col("seasonal")).drop("_d")


def shrunk_covariance(df: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """Ledoit-Wolf shrinkage of centred columns to a scaled identity: intensity and shrunk covariances, from one aggregate.

    The spread of outer products needs sums of products of four, which are algebraic, so partial aggregation works.
    """
    pairs = [(a, b) for i, a in enumerate(dims) for b in dims[i:]]
    mean = Window.partitionBy(*keys)
    c = df.select(*keys, *[(F.col(d) - F.avg(d).over(mean)).alias(d) for d in dims])
    g = c.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in pairs], *[F.sum(F.col(a) * F.col(a) * F.col(b) * F.col(b)).alias(f"q_{a}_{b}") for a, b in pairs])
    n, p = F.col("n"), len(dims)
    twice = lambda a, b: 1 if a == b else 2
    mu = sum(F.col(f"s_{a}_{a}") for a in dims) / p
    g = g.withColumn("mu", mu)
    d2 = sum(twice(a, b) * F.pow(F.col(f"s_{a}_{b}") - (F.col("mu") if a == b else 0), F.lit(2)) for a, b in pairs)
    b2 = sum(twice(a, b) * (F.col(f"q_{a}_{b}") - n * F.col(f"s_{a}_{b}") * F.col(f"s_{a}_{b}")) for a, b in pairs) / (n * n)
    g = g.withColumn("lambda", F.when(d2 > 0, F.least(b2, d2) / d2).otherwise(0.0))
    return g.select(*keys, "n", "lambda", *[(F.col("lambda") * (F.col("mu") if a == b else F.lit(0.0)) + (1 - F.col("lambda")) * F.col(f"s_{a}_{b}")).alias(f"cov_{a}_{b}") for a, b in pairs])


def weighted_quantile(df: DataFrame, keys: list[str], q: float, score: str = "score", weight: str = "weight") -> DataFrame:
    """Smallest score at which the weight so far reaches q of all, else the largest score."""
    w = Window.partitionBy(*keys).orderBy(score).rangeBetween(Window.unboundedPreceding, 0)
    c = df.withColumn("_c", F.sum(weight).over(w)).withColumn("_t", F.sum(weight).over(Window.partitionBy(*keys)))
    return c.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_c") >= q * F.col("_t"), F.col(score))), F.max(score)).alias("quantile"))


def heldout_weights(df: DataFrame, keys: list[str], score: str = "score", weight: str = "weight") -> DataFrame:
    """Weight of the scores at or above each score, sorted: the table a weighted conformal e-value reads."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn("weight_above", F.sum(weight).over(w)).withColumn("total_weight", F.sum(weight).over(Window.partitionBy(*keys)))


def block_moments(df: DataFrame, keys: list[str], size: int, value: str = "value") -> DataFrame:
    """Kurtosis and absolute skewness of disjoint whole blocks of a series."""
    b = df.withColumn("block", F.floor(F.col("tick") / size))
    m = b.groupBy(*keys, "block").agg(F.count("*").alias("n"), F.avg(value).alias("m"), *[F.avg(F.pow(F.col(value), F.lit(float(k)))).alias(f"r{k}") for k in (2, 3, 4)]).where(F.col("n") == size)
    mean = F.col("m")
    m2 = F.col("r2") - mean * mean
    m3 = F.col("r3") - 3 * mean * F.col("r2") + 2 * mean * mean * mean
    m4 = F.col("r4") - 4 * mean * F.col("r3") + 6 * mean * mean * F.col("r2") - 3 * mean * mean * mean * mean
    return m.select(*keys, "block", m2.alias("m2"), (m4 / (m2 * m2)).alias("kurtosis"), (F.abs(m3) / F.pow(m2, F.lit(1.5))).alias("abs_skew"))


def tail_bet_calibration(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Median, median absolute deviation and each row's score in units of it."""
    med = df.groupBy(*keys).agg(F.median(value).alias("median"))
    dev = df.join(med, keys).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    mad = dev.groupBy(*keys).agg(F.median("_d").alias("mad"))
    return dev.join(mad, keys).withColumn("score", F.col("_d") / F.col("mad")).drop("_d")


def mixture_prior(cls: Column, mean: Column, variance: Column) -> Column:
    """STRUCT<distribution, variance, alpha, beta>: prior of the mixture by signal class, with five pseudo-observations of a probability."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), mean))
    none = F.lit(None).cast("double")
    beta = F.struct(F.lit("beta").alias("distribution"), none.alias("variance"), F.greatest(F.lit(1.0), 0.5 + 5 * p).alias("alpha"), F.greatest(F.lit(1.0), 0.5 + 5 * (1 - p)).alias("beta"))
    gauss = F.struct(F.lit("gaussian").alias("distribution"), variance.alias("variance"), none.alias("alpha"), none.alias("beta"))
    return F.when(cls == "bounded_probability", beta).when(variance > 0, gauss)


def sliding_scores(df: DataFrame, keys: list[str], size: int, stride: int = 1, value: str = "value", by: str = "tick") -> DataFrame:
    """Uncentred kurtosis of every full window of `size` ticks that starts at a multiple of the stride: calibration scores of a shape detector.

    Windows share their rows' running sums, so a row is not copied for each window it is in.
    """
    w = ordered(keys, by).rowsBetween(1 - size, 0)
    d = df.withColumn("_n", F.count(value).over(w)).withColumn("_2", F.avg(F.pow(F.col(value), F.lit(2.0))).over(w)).withColumn("_4", F.avg(F.pow(F.col(value), F.lit(4.0))).over(w))
    d = d.where((F.col("_n") == size) & ((F.col(by) - (size - 1)) % stride == 0) & (F.col("_2") > 0))
    return d.select(*keys, (F.col(by) - (size - 1)).alias("start"), (F.col("_4") / (F.col("_2") * F.col("_2"))).alias("score"))


def tiered_cells(cells: DataFrame, whole: DataFrame, min_strict: int, min_pooled: int) -> DataFrame:
    """Confidence of each cell by its raw count, with the pooled estimate for cells that have too few rows. `whole` has one row."""
    w = whole.select(*[F.col(c).alias(f"_{c}") for c in ("mean", "cov", "n")])
    few = F.col("n") < min_pooled
    j = cells.crossJoin(F.broadcast(w))
    kind = F.when(F.col("n") >= min_strict, "strict").when(~few, "pooled").otherwise("aggregate")
    keep = [c for c in cells.columns if c not in ("n", "mean", "cov")]
    return j.select(*keep, F.when(few, F.col("_n")).otherwise(F.col("n")).alias("n"), F.when(few, F.col("_mean")).otherwise(F.col("mean")).alias("mean"), F.when(few, F.col("_cov")).otherwise(F.col("cov")).alias("cov"), kind.alias("confidence"))


def variance_ladder(iid: Column, phi: Column, ar_p: Column, period: Column, deseasoned: Column, deseasoned_phi: Column, use_ar_p: Column, use_seasonal: Column, use_prewhitening: Column, use_hac: Column) -> Column:
    """STRUCT<variance, rung> of a series: the first rung that is asked for and fits, of autoregression, season, prewhitening, inflation for autocorrelation, and independence.

    Prewhitening and inflation exclude each other: both is an error.
    """
    innovation = lambda v, f: F.greatest(v * (1 - F.least(f * f, F.lit(0.9999))), F.lit(1e-12))
    both = use_prewhitening & use_hac
    iid = F.when(both, F.raise_error(F.lit("prewhitening and inflation exclude each other")).cast("double")).otherwise(iid)
    rung = lambda v, name: F.struct(v.alias("variance"), F.lit(name).alias("rung"))
    return (
        F.when(~both & use_ar_p & (F.coalesce(ar_p, F.lit(0.0)) > 1e-12), rung(ar_p, "ar_p")).when(~both & use_seasonal & (F.coalesce(period, F.lit(0)) > 0), rung(innovation(deseasoned, deseasoned_phi), "seasonal"))
        .when(~both & use_prewhitening, rung(innovation(iid, phi), "prewhitened")).when(~both & use_hac, rung(iid * hac_inflation(phi), "inflated")).otherwise(rung(iid, "independent"))
    )
