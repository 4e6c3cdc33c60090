"""Sequential detectors over ordered series: window plans where the recurrence has a closed form, folds where it has not."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.windows import TINY_FLOOR, WEALTH_FLOOR, lagged, ordered, reflected_walk, so_far, sticky

BET_CLIP = 1 - 1e-6


def mixture(df: DataFrame, keys: list[str], alpha: float, mean: str = "mean", variance: str = "variance", phi: str = "phi", value: str = "value", by: str = "tick") -> DataFrame:
    """Gaussian mixture supermartingale of the whitened running sum, prior variance = variance; the fire flag stays on once set."""
    w = ordered(keys, by)
    df = df.withColumn("_c", F.col(value) - F.col(mean))
    df = df.withColumn("s", F.sum(F.col("_c") - F.col(phi) * lagged("_c", 1, w)).over(so_far(w))).withColumn("t", F.row_number().over(w).cast("double"))
    df = df.withColumn("m", scalar.gaussian_mixture(F.col("s"), F.col("t"), F.col(variance), F.col(variance)))
    df = df.withColumn("fire_now", F.col("m") >= 1 / alpha)
    return df.withColumn("fired", sticky(F.col("fire_now"), w)).drop("_c")


def beta_mixture(df: DataFrame, keys: list[str], alpha: float, p: str = "p", value: str = "value", by: str = "tick") -> DataFrame:
    """Beta mixture supermartingale of a probability series around its baseline p."""
    w = ordered(keys, by)
    a, b = F.greatest(F.lit(1.0), 0.5 + 5 * F.col(p)), F.greatest(F.lit(1.0), 0.5 + 5 * (1 - F.col(p)))
    df = df.withColumn("s", F.sum(F.col(value) - F.col(p)).over(so_far(w))).withColumn("t", F.row_number().over(w).cast("double"))
    df = df.withColumn("m", scalar.beta_mixture(F.col("s"), F.col("t"), F.col(p), a, b))
    return df.withColumn("fired", sticky(F.col("m") >= 1 / alpha, w))


def cusum(df: DataFrame, keys: list[str], x: str, variance: str, prior: str, by: str = "tick") -> DataFrame:
    """Likelihood-ratio increments reflected at zero."""
    v, t = F.col(variance), F.col(prior)
    z = F.when(v <= 0, F.when(t <= 0, 0.0).otherwise(F.col(x) * F.col(x) / (2 * t))).otherwise(0.5 * F.log(v / (v + t)) + F.col(x) * F.col(x) * t / (2 * v * (v + t)))
    return reflected_walk(df.withColumn("_z", z), "_z", keys, 0.0, "cusum", by).drop("_z")


def self_normalized(df: DataFrame, keys: list[str], z: str, a: float = 0.85, c: float | None = None, alpha: float = 0.05, by: str = "tick") -> DataFrame:
    """|S| against sqrt(V) times the law-of-iterated-logarithm bound (deprecated: kept for comparison, refused by the guarded path)."""
    c = -2 * math.log(alpha) if c is None else c
    w = ordered(keys, by)
    df = df.withColumn("s", F.sum(z).over(so_far(w))).withColumn("v", F.sum(F.col(z) * F.col(z)).over(so_far(w)))
    t = F.greatest(F.col("v"), F.lit(1.0))
    df = df.withColumn("threshold", F.sqrt("v") * scalar.lil_bound(t, a, c))
    return df.withColumn("fired", sticky(F.abs("s") >= F.col("threshold"), w))


def lil_constant(alpha: float, a: float = 0.85) -> float:
    """Smallest constant whose error bound, minimised over the epochs' ratio, is at most alpha (a scalar of the plan, found on the driver)."""

    def error(c: float, eta: float) -> float:
        g = 2 / eta * (a - math.sqrt(2 * (eta - 1) / c)) ** 2
        return math.inf if g <= 1 else 4 * math.exp(-g * c) * (1 + 1 / ((g - 1) * math.log(eta)))

    def best(c: float) -> float:
        lo, hi = 1.0, 2 * a * a
        for _ in range(60):  # largest ratio with a positive margin
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if math.sqrt(mid / 2) + math.sqrt(2 * (mid - 1) / c) < a else (lo, mid)
        top, lo = (lo + hi) / 2, 1.0
        for _ in range(200):
            x, y = lo + (top - lo) / 3, top - (top - lo) / 3
            lo, top = (lo, y) if error(c, x) < error(c, y) else (x, top)
        return error(c, (lo + top) / 2)

    lo, hi = 0.0, 1.0
    while best(hi) > alpha:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if mid > 0 and best(mid) <= alpha else (mid, hi)
    return hi


_BET = "struct<log_m:double,bet:double,n:double,mean:double,second:double,last:double,fallbacks:double>"


def betting_fold(xs: Column, mean: Column, variance: Column, phi: Column) -> Column:
    """State after an array of values in order: log-wealth, bet, count, moments, last deviation, fallbacks.

    The bet is mean over second moment of the past if it fits the clip, else a
    Newton step from the bet before; that makes the recursion a real fold. NaN
    values hold the whole state.
    """
    scale = 3 * F.sqrt(F.greatest(variance, F.lit(0.0)))

    def bind(value: Column, acc: Column, use) -> Column:
        """use(acc, value) with the value computed once."""
        return F.aggregate(F.array(value), acc, use)

    def step(acc: Column, x: Column) -> Column:
        c = x - mean
        z = F.when(scale > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (c - phi * acc["last"]) / scale))).otherwise(0.0)
        mu, m2, prev = acc["mean"], acc["second"], acc["bet"]
        raw = F.when(m2 > 0, mu / m2).otherwise(0.0)
        inner = 1 + prev * mu
        newton = F.when((m2 > 0) & (F.abs(inner) >= 1e-9), F.greatest(F.lit(-BET_CLIP), F.least(F.lit(BET_CLIP), prev + mu / inner / F.greatest(m2, F.lit(1e-6))))).otherwise(0.0)
        fits = F.abs(raw) <= BET_CLIP
        now = F.struct(c.alias("c"), z.alias("z"), F.when(fits, raw).otherwise(newton).alias("bet"), fits.alias("fits"))

        def after(a: Column, v: Column) -> Column:
            n = a["n"] + 1
            gain = F.log(F.greatest(F.lit(0.0), 1 + v["bet"] * v["z"]))
            log_m = F.greatest(F.lit(WEALTH_FLOOR), a["log_m"] + F.coalesce(gain, F.lit(float("-inf"))))
            return F.struct(
                log_m.alias("log_m"), v["bet"].alias("bet"), n.alias("n"), (a["mean"] + (v["z"] - a["mean"]) / n).alias("mean"), (a["second"] + (v["z"] * v["z"] - a["second"]) / n).alias("second"),
                v["c"].alias("last"), (a["fallbacks"] + F.when(v["fits"], 0.0).otherwise(1.0)).alias("fallbacks"),
            ).cast(_BET)

        return F.when(x.isNull() | F.isnan(x), acc).otherwise(bind(now, acc, after))

    start = F.struct(*[F.lit(0.0).alias(c) for c in ("log_m", "bet", "n", "mean", "second", "last", "fallbacks")]).cast(_BET)
    return F.aggregate(xs, start, step)


def betting(df: DataFrame, keys: list[str], alpha: float, value: str = "value", by: str = "tick") -> DataFrame:
    """Final wealth and verdict of each series; needs constant columns mean, variance and phi."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(by, value))).alias("_s"), F.first("mean").alias("mean"), F.first("variance").alias("variance"), F.first("phi").alias("phi"))
    g = g.withColumn("state", betting_fold(F.transform("_s", lambda e: e[value]), F.col("mean"), F.col("variance"), F.col("phi")))
    m = scalar.wealth(F.col("state.log_m"))
    return g.select(*keys, "state.log_m", "state.bet", "state.n", "state.fallbacks", F.when(m >= 1 / alpha, "fire").when(m > 1, "indeterminate").otherwise("clean").alias("verdict"))


def autocorrelation(xs: Column, lag: Column) -> Column:
    """Correlation of an array with itself moved by a lag, around its mean; 0 without variance."""
    n = F.size(xs)
    mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n
    num = F.aggregate(F.zip_with(F.slice(xs, 1, n - lag), F.slice(xs, lag + 1, n - lag), lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, x: a + x)
    den = F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(den > 0, num / den).otherwise(0.0)


def spectral_peak(df: DataFrame, keys: list[str], size: int = 60, lo: int = 3, hi: int = 10, value: str = "value", by: str = "tick") -> DataFrame:
    """Largest |autocorrelation| over the lags in each trailing window, and the first lag that has it; null until the window is full.

    Each lag is one windowed pass over centred products: the window's sums make
    the correlation, so no array is built for a row.
    """
    w = ordered(keys, by)
    f = w.rowsBetween(1 - size, 0)
    df = df.withColumn("_n", F.count(value).over(f)).withColumn("_m", F.avg(value).over(f)).withColumn("_d", F.var_pop(value).over(f) * size)
    acf = []
    for k in range(lo, hi + 1):
        inner, head, tail = w.rowsBetween(1 - size + k, 0), w.rowsBetween(1 - size, -k), w.rowsBetween(1 - size + k, 0)
        df = df.withColumn("_p", F.col(value) * F.lag(value, k).over(w))
        cross = F.sum("_p").over(inner) - F.col("_m") * (F.sum(value).over(head) + F.sum(value).over(tail)) + (size - k) * F.col("_m") * F.col("_m")
        df = df.withColumn(f"_a{k}", F.abs(F.when(F.col("_d") > 0, cross / F.col("_d")).otherwise(0.0)))
        acf.append(F.struct(F.col(f"_a{k}").alias("v"), F.lit(-k).alias("k")))
    best = F.array_max(F.array(*acf))
    df = df.withColumn("peak", F.when(F.col("_n") == size, best["v"])).withColumn("lag", F.when(F.col("_n") == size, -best["k"]))
    return df.drop("_n", "_m", "_d", "_p", *[f"_a{k}" for k in range(lo, hi + 1)])


def spectral_e_detector(df: DataFrame, keys: list[str], size: int, mean: str, std: str, delta: float, alpha: float, bound: float = 1.0, by: str = "tick") -> DataFrame:
    """Wealth of normal-shift bets on the peaks of disjoint windows (every size-th full window), priced by an inflation bound."""
    w = ordered(keys, by)
    full = df.where("peak is not null").withColumn("_i", F.row_number().over(w)).where(F.col("_i") % size == 0)
    r = delta / F.col(std)
    z = r * (F.col("peak") - F.col(mean)) / F.col(std) - 0.5 * r * r
    out = reflected_walk(full.withColumn("_z", z), "_z", keys, TINY_FLOOR, "log_m", by).drop("_z", "_i")
    return out.withColumn("m", scalar.wealth(F.col("log_m"))).withColumn("fire", F.col("m") >= bound / alpha)


def spectral_bet(df: DataFrame, keys: list[str], sigma: str, size: int = 30, bins: tuple = (1, 2, 3), kappa: float = 0.1, value: str = "value") -> DataFrame:
    """Mean e-value of each whole block's first Fourier bins, exponential under the null, and the wealth over blocks."""
    b = df.withColumn("block", F.floor(F.col("tick") / size)).withColumn("_t", F.pmod("tick", F.lit(size)))
    angle = lambda k: F.col("_t") * (-2 * math.pi * k / size)
    g = b.groupBy(*keys, "block").agg(F.count("*").alias("n"), F.first(sigma).alias("_s"), *[F.sum(F.col(value) * f(angle(k))).alias(f"{c}{k}") for k in bins for c, f in (("re", F.cos), ("im", F.sin))]).where(F.col("n") == size)
    es = [scalar.e_calibrator(F.exp(-(F.col(f"re{k}") * F.col(f"re{k}") + F.col(f"im{k}") * F.col(f"im{k}")) / size / (F.col("_s") * F.col("_s"))), kappa) for k in bins]
    g = g.select(*keys, "block", (sum(es) / len(bins)).alias("e")).withColumn("_z", F.log("e"))
    return reflected_walk(g, "_z", keys, WEALTH_FLOOR, "log_m", "block").drop("_z")


def conformal_p(df: DataFrame, cal: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """(1 + calibration scores at or above) / (n + 1), ranks by a merged sort instead of a pair for each two rows."""
    both = df.withColumn("_cal", F.lit(0)).unionByName(cal.select(*keys, score).withColumn("_cal", F.lit(1)), allowMissingColumns=True)
    at_or_above = Window.partitionBy(*keys).orderBy(F.desc(score)).rangeBetween(Window.unboundedPreceding, 0)
    ranked = both.withColumn("_g", F.sum("_cal").over(at_or_above)).withColumn("_n", F.sum("_cal").over(Window.partitionBy(*keys))).where("_cal = 0")
    return ranked.withColumn("p", (1 + F.col("_g")) / (F.col("_n") + 1)).drop("_cal", "_g", "_n")


def hedged_wealth(df: DataFrame, keys: list[str], hit: Column, alpha: float, by: str = "tick") -> DataFrame:
    """Plain product of 1 + hit - alpha: no floor, so the sum of logarithms is exact."""
    w = so_far(ordered(keys, by))
    df = df.withColumn("e", 1 + hit.cast("double") - alpha)
    return df.withColumn("m", F.exp(F.sum(F.log("e")).over(w))).withColumn("fire", F.col("m") >= 1 / alpha)


def shape_bet(blocks: DataFrame, cal: DataFrame, keys: list[str], kappa: float = 0.1) -> DataFrame:
    """Mean e-value of kurtosis and |skewness| of each block against calibration blocks, and the wealth; a degenerate feature bets nothing."""
    out = blocks
    for f in ("kurtosis", "abs_skew"):
        ok = F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) != float("inf"))
        med = cal.where(ok).groupBy(*keys).agg(F.median(f).alias(f"_m_{f}"))
        dev = cal.where(ok).join(med, keys).select(*keys, F.abs(F.col(f) - F.col(f"_m_{f}")).alias("score"))
        out = out.join(med, keys).withColumn("score", F.when(ok, F.abs(F.col(f) - F.col(f"_m_{f}"))))
        out = conformal_p(out, dev, keys).withColumn(f"e_{f}", F.when(F.col("score").isNull(), 1.0).otherwise(scalar.e_calibrator(F.col("p"), kappa))).drop("p", "score", f"_m_{f}")
    out = out.withColumn("e", (F.col("e_kurtosis") + F.col("e_abs_skew")) / 2).withColumn("_z", F.log("e"))
    return reflected_walk(out, "_z", keys, WEALTH_FLOOR, "log_m", "block").drop("_z")


def kurtosis_score(df: DataFrame, keys: list[str], size: int, value: str = "value") -> DataFrame:
    """Uncentred fourth moment over the squared second, of whole disjoint blocks."""
    b = df.withColumn("block", F.floor(F.col("tick") / size))
    g = b.groupBy(*keys, "block").agg(F.count("*").alias("n"), F.avg(F.pow(F.col(value), F.lit(2.0))).alias("_2"), F.avg(F.pow(F.col(value), F.lit(4.0))).alias("_4")).where(F.col("n") == size)
    return g.select(*keys, "block", F.when(F.col("_2") > 0, F.col("_4") / (F.col("_2") * F.col("_2"))).alias("score"))


def energy_statistic(live: DataFrame, ref: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Energy statistic of each block against a reference sample: twice the mean |x - a| less the mean |x - x'|.

    Mean distances come from ranks: with rows merged in order, a sum over pairs
    is a running sum, so nothing is joined pairwise.
    """
    r = ref.select(*keys, F.col(value).alias("x"))
    whole = Window.partitionBy(*keys)
    lv = live.select(*keys, "block", F.col(value).alias("x"))
    block = Window.partitionBy(*keys, "block")
    ranked = lv.withColumn("i", F.row_number().over(block.orderBy("x"))).withColumn("n", F.count("*").over(block))
    within = ranked.groupBy(*keys, "block").agg(F.first("n").alias("n"), (2 * F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("x"))).alias("ll"))
    both = r.select(*keys, F.lit(None).cast("bigint").alias("block"), "x", F.lit(1).alias("c")).unionByName(lv.select(*keys, "block", "x", F.lit(0).alias("c")))
    upto = whole.orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"below": F.sum("c").over(upto), "below_sum": F.sum(F.col("c") * F.col("x")).over(upto), "m": F.sum("c").over(whole), "all_sum": F.sum(F.col("c") * F.col("x")).over(whole)}).where("c = 0")
    cross = both.groupBy(*keys, "block").agg(F.first("m").alias("m"), F.sum(F.col("x") * (2 * F.col("below") - F.col("m")) + F.col("all_sum") - 2 * F.col("below_sum")).alias("lr"))
    n = F.col("n")
    return cross.join(within, [*keys, "block"]).select(*keys, "block", (2 * F.col("lr") / (n * F.col("m")) - F.col("ll") / (n * n)).alias("energy"))


def energy_wealth(live: DataFrame, cal: DataFrame, keys: list[str], kappa: float = 0.1, alpha: float = 0.01) -> DataFrame:
    """Rank p-value of each block's energy among the calibration blocks', its e-value, the wealth, and whether it has crossed 1 / alpha."""
    p = conformal_p(live.withColumn("score", F.col("energy")), cal.select(*keys, F.col("energy").alias("score")), keys).drop("score")
    e = p.withColumn("e", scalar.e_calibrator(F.col("p"), kappa)).withColumn("_z", F.log("e"))
    out = reflected_walk(e, "_z", keys, WEALTH_FLOOR, "log_m", "block").drop("_z")
    return out.withColumn("crossed", sticky(F.col("log_m") >= -math.log(alpha), ordered(keys, "block")))


def growth_screen(df: DataFrame, keys: list[str], kappa: float = 0.1, p: str = "p") -> DataFrame:
    """Mean logarithm of the e-values that p-values of null draws give, ln kappa + (1 - kappa) * mean(-ln p), and whether it is positive: such evidence grows under the null."""
    g = df.groupBy(*keys).agg(F.count("*").alias("draws"), F.avg(-F.log(p)).alias("mean_neg_log_p"))
    return g.withColumn("growth", math.log(kappa) + (1 - kappa) * F.col("mean_neg_log_p")).withColumn("positive", F.col("growth") > 0)


def hotelling(df: DataFrame, dims: list[str], cov: dict[tuple[int, int], Column], ridge: float | Column = 0.0) -> Column:
    """r' S^-1 r of up to three dimensions by Cholesky's factors, unrolled; null if S is not positive definite."""
    p = len(dims)
    low: dict[tuple[int, int], Column] = {}
    ok = F.lit(True)
    for i in range(p):
        for j in range(i + 1):
            v = cov[min(i, j), max(i, j)] + (ridge if i == j else 0.0)
            for k in range(j):
                v = v - low[i, k] * low[j, k]
            if i == j:
                ok = ok & (v > 0)
                low[i, i] = F.sqrt(v)
            else:
                low[i, j] = v / low[j, j]
    y: list[Column] = []
    for i in range(p):
        v = F.col(dims[i])
        for k in range(i):
            v = v - low[i, k] * y[k]
        y.append(v / low[i, i])
    return F.when(ok, sum(v * v for v in y))
