"""Detector evaluators: tick-wise verdicts with gates, thresholds and reasons, and the checks of what they are fed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.walks import row_walk
from ..functions.windows import TINY_FLOOR, ordered, reflected_walk, so_far
from .detectors import BET_CLIP, WEALTH_FLOOR, hotelling
from .ingest import families_suppressed, gate, match_cell

#: Names of responses of the system under test, which are no exogenous covariates. Fixed values.
RESPONSES = "temp therm clock freq power watt util ecc throttle fan volt current error retry xid health".split()
#: The version of substrate files that can be read. Fixed value.
SUBSTRATE_VERSION = "phase-e-slice10-v1"


def _bet(s: tuple, x: float, mean: float, var: float, phi: float) -> tuple:
    """State (log-wealth, bet, count, mean, second moment, last deviation) after a value; NaN holds it."""
    log_m, prev, n, mu, m2, last = s
    if x is not None and not math.isnan(x):
        scale, c = 3 * math.sqrt(max(var, 0.0)), x - mean
        z = max(-1.0, min(1.0, (c - phi * last) / scale)) if scale > 0 else 0.0
        bet = mu / m2 if m2 > 0 else 0.0
        if abs(bet) > BET_CLIP:
            inner = 1 + prev * mu
            bet = max(-BET_CLIP, min(BET_CLIP, prev + mu / inner / max(m2, 1e-6))) if abs(inner) >= 1e-9 else 0.0
        growth, n = 1 + bet * z, n + 1
        log_m = max(WEALTH_FLOOR, log_m + math.log(growth)) if growth > 0 else WEALTH_FLOOR
        s = (log_m, bet, n, mu + (z - mu) / n, m2 + (z * z - m2) / n, c)
    return s, s[:3]


def betting_walk(df: DataFrame, keys: list[str], value: str = "value", by: str = "tick") -> DataFrame:
    """Adds log_m, bet and n after each tick to rows with columns mean, variance and phi."""
    return row_walk(df, keys, [by], [value, "mean", "variance", "phi"], lambda: (0.0, 0.0, 0, 0.0, 0.0, 0.0), _bet, "log_m double, bet double, n long")


def betting_verdicts(df: DataFrame, keys: list[str], alpha: float | Column, value: str = "value", by: str = "tick", bake: tuple = (3, 3, 1), least_traffic: float = 0.0, threshold: Column | None = None) -> DataFrame:
    """Verdict, statistic, threshold and reason of each tick of the betting e-process.

    The state moves before any gate speaks. Rows may have columns schema,
    ticks_since_deploy, deploy_age_days and traffic_pct; without them a series
    starts at its deployment, under full traffic. `threshold` takes the place of
    1 / alpha where it is not null.
    """
    out = betting_walk(df, keys, value, by)
    has = lambda c, other: F.col(c) if c in df.columns else other
    limit = F.coalesce(*([threshold] if threshold is not None else []), 1 / (alpha if isinstance(alpha, Column) else F.lit(alpha)))
    why = gate(has("schema", F.lit(None).cast("string")), has("ticks_since_deploy", F.col(by)), F.col("n"), has("deploy_age_days", F.lit(0)), has("traffic_pct", F.lit(100.0)), bake, least_traffic)
    m = scalar.wealth(F.col("log_m"))
    out = out.withColumns({"statistic": m, "threshold": limit, "_why": why})
    fire, rising = F.col("statistic") >= F.col("threshold"), F.col("statistic") > 1
    reason = F.coalesce("_why", F.when(fire, "betting_wealth_exceeded_threshold").when(rising, "accumulating").otherwise("at_initial_wealth"))
    verdict = F.when(F.col("_why").isNotNull(), "suppressed").when(fire, "fire").when(rising, "indeterminate").otherwise("clean")
    return out.withColumns({"verdict": verdict, "reason": reason}).drop("_why")


def cell_of(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds `ordinal` and `confidence` of the cell that each row (hour, day, tier) takes, null where there is none; a null tier is `aggregate`.

    Cells (ordinal, hour, day, tier, confidence) are tried in their order: the first with the
    row's hour, its day and its tier, a missing day or tier on either side fitting
    any; without one, the first that fits the tier `aggregate`. The distinct
    contexts of the rows are looked up once, and rows join them by equality.
    """
    tier = F.coalesce("tier", F.lit("aggregate"))
    contexts = df.select("hour", "day", tier.alias("tier")).distinct()
    found = match_cell(contexts, cells.select("ordinal", "hour", "day", "tier", "confidence"), ["hour", "day", "tier"])
    found = found.select(*(F.col(c).alias(f"_{c}") for c in ("hour", "day", "tier")), F.col("cell_ordinal").alias("ordinal"), F.col("cell_confidence").alias("confidence"))
    same = F.col("hour").eqNullSafe(F.col("_hour")) & F.col("day").eqNullSafe(F.col("_day")) & (tier == F.col("_tier"))
    return df.join(found, same, "left").drop("_hour", "_day", "_tier")


def _spend(s: tuple, x: float, mean: float, var: float, phi: float, alpha: float) -> tuple:
    bets, spent = s
    now, told = _bet(bets, x, mean, var, phi)
    spent += alpha if now[2] > bets[2] else 0.0
    return (now, spent), (*told, spent)


def family_verdicts(
    df: DataFrame, keys: list[str], signals: dict[str, Column], cells: DataFrame, parameters: DataFrame, fallback: DataFrame | None = None, family_alpha: float = 4e-4, corrections: int = 6, by: str = "tick", listed: list[str] | None = None, classes: dict[str, str] | None = None, bake: dict[str, tuple] | None = None, least_traffic: float = 0.0
) -> DataFrame:
    """Betting verdicts of the signals of a wide frame: one state for each key and signal.

    Rows have hour, day, tier and may have schema (continuity class), ignored
    (signals not to be judged), ticks_since_deploy, deploy_age_days, traffic_pct.
    `cells` (see cell_of) give a row's cell, `parameters` (ordinal, signal, mean,
    variance, phi and, where present, signal_class, alpha, threshold) what to
    expect in it; where a cell of confidence aggregate or none has none for a
    signal, `fallback` (signal and the same) does. Values take the transform of the parameters'
    signal_class, else that of `classes`, else none. alpha defaults to half of the
    signal's share of the family's, the threshold to 1 / alpha.

    In this order: a schema change that silences the family gives every `listed`
    signal (all, if not said) a suppressed verdict; a row without a cell has no
    verdicts; an ignored signal is suppressed with reason ignore_threshold, with or
    without a value; a signal without value, parameters, mean or variance has no
    verdict. Suppression of the first two kinds holds the state: wealth, count and
    alpha stay; the gates of bake profile and traffic speak after the state moved.
    """
    has = lambda c, other: F.col(c) if c in df.columns else other
    every = list(dict.fromkeys([*signals, *(listed or [])]))
    none = F.lit(None).cast("double")
    each = [F.struct(F.lit(s).alias("signal"), (signals[s].cast("double") if s in signals else none).alias("_raw"), F.lit(s in signals).alias("_judged"), F.lit(listed is None or s in listed).alias("_listed")) for s in every]
    rows = cell_of(df, cells).withColumn("_s", F.explode(F.array(*each))).select("*", "_s.*").drop("_s")
    names = [c for c in ("mean", "variance", "phi", "signal_class", "alpha", "threshold") if c in parameters.columns or fallback is not None and c in fallback.columns]
    packed = lambda p, name: p.select(*(c for c in ("ordinal", "signal") if c in p.columns), F.struct(*(F.col(c) if c in p.columns else F.lit(None).cast("string" if c == "signal_class" else "double").alias(c) for c in names)).alias(name))
    rows = rows.join(packed(parameters, "_own"), ["ordinal", "signal"], "left")
    told = F.col("_own")
    if fallback is not None:
        rows = rows.join(packed(fallback, "_all"), "signal", "left")
        told = F.coalesce("_own", F.when(F.col("confidence").isin("aggregate", "none"), F.col("_all")))
    rows = rows.withColumn("_told", told).withColumns({f"_{c}": F.col(f"_told.{c}") for c in names}).drop("_own", "_all")
    own = lambda c, kind, *other: F.coalesce(*([F.col(f"_{c}")] if c in names else []), *other, F.lit(None).cast(kind))
    schema = has("schema", F.lit(None).cast("string"))
    silent = F.coalesce(F.array_contains(families_suppressed(schema), "A"), F.lit(False))
    ignored = F.coalesce(F.array_contains(has("ignored", F.array().cast("array<string>")), F.col("signal")), F.lit(False))
    known = F.col("_told").isNotNull() & own("mean", "double").isNotNull() & own("variance", "double").isNotNull() & F.col("_raw").isNotNull()
    declared = [F.create_map(*(F.lit(x) for kv in classes.items() for x in kv))[F.col("signal")]] if classes else []
    rows = rows.withColumns({"_silent": silent, "_ignored": ignored}).where(F.when(F.col("_silent"), F.col("_listed")).otherwise(F.col("_judged") & F.col("ordinal").isNotNull() & (F.col("_ignored") | known)))
    moves = ~F.col("_silent") & ~F.col("_ignored")
    alpha = own("alpha", "double", F.lit(family_alpha / corrections / 2))
    rows = rows.withColumns({"_x": F.when(moves, scalar.for_class(F.col("_raw"), own("signal_class", "string", *declared, F.lit("gaussian_like")))), "_m": own("mean", "double"), "_v": own("variance", "double"), "_f": own("phi", "double", F.lit(0.0)), "_a": alpha})
    out = row_walk(rows, [*keys, "signal"], [by], ["_x", "_m", "_v", "_f", "_a"], lambda: ((0.0, 0.0, 0, 0.0, 0.0, 0.0), 0.0), _spend, "log_m double, bet double, n long, alpha_consumed double")
    baked = bake or {}
    ticks, seen, days = (F.coalesce(*([F.create_map(*(x for s, b in baked.items() for x in (F.lit(s), F.lit(b[i]))))[F.col("signal")]] if baked else []), F.lit((3, 3, 1)[i])) for i in range(3))
    unbaked = (has("ticks_since_deploy", F.col(by)) < ticks) | (F.col("n") < seen) | (has("deploy_age_days", F.lit(0)) > days)
    why = (
        F.when(F.col("_silent"), F.when(schema == "observability_stack", "observability_stack_deploy").otherwise("schema_continuity_breaking")).when(F.col("_ignored"), "ignore_threshold")
        .when(unbaked, "bake_profile_not_met").when(has("traffic_pct", F.lit(100.0)) < least_traffic, "traffic_pct_below_gate")
    )
    limit = F.when(moves, own("threshold", "double", 1 / F.col("_a")))
    out = out.withColumns({"statistic": scalar.wealth(F.col("log_m")), "threshold": limit, "_why": why})
    fire, rising = F.col("statistic") >= F.col("threshold"), F.col("statistic") > 1
    verdict = F.when(F.col("_why").isNotNull(), "suppressed").when(fire, "fire").when(rising, "indeterminate").otherwise("clean")
    reason = F.coalesce("_why", F.when(fire, "betting_wealth_exceeded_threshold").when(rising, "accumulating").otherwise("at_initial_wealth"))
    out = out.withColumns({"verdict": verdict, "reason": reason, "alpha_spent": F.when(verdict == "fire", F.col("_a")).otherwise(0.0)})
    return out.drop("bet", "_why", "_x", "_m", "_v", "_f", "_a", "_silent", "_ignored", "_raw", "_judged", "_listed", "_told", *(f"_{c}" for c in names))


def relative_deviation(x: Column, mean: Column) -> Column:
    """(x - mean) / mean, or x - mean where the mean is as good as 0."""
    return F.when(F.abs(mean) > 1e-12, (x - mean) / mean).otherwise(x - mean)


def hotelling_variant(raw: Column, has_params: Column, has_state: Column) -> Column:
    """The test that runs: the safe one only with its parameters and its state, else chi-square; an unknown name is an error."""
    return (
        F.when(raw.isNull() | (raw == "chi_square"), "chi_square").when(raw == "safe_test", F.when(has_params & has_state, "safe_test").otherwise("chi_square"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown Hotelling variant "), raw)).cast("string"))
    )


def hotelling_verdicts(df: DataFrame, dims: list[str], means: list[Column], cov: dict[tuple[int, int], Column], alpha: float, with_kernel: bool | Column, why: Column | None = None, threshold: Column | None = None) -> DataFrame:
    """Chi-square verdict on the relative deviations of a vector of signals.

    Rows that lack a signal have no verdict. Where a kernel test shares the
    family's alpha, half of it is left. `why` is the reason of a gate, `threshold`
    takes the place of the chi-square quantile where it is not null.
    """
    p = len(dims)
    share = F.when(with_kernel if isinstance(with_kernel, Column) else F.lit(with_kernel), alpha / 2).otherwise(alpha)
    limit = F.coalesce(*([threshold] if threshold is not None else []), scalar.chi_square_quantile(1 - share, F.lit(float(p))))
    rows = df.where(" and ".join(f"`{d}` is not null" for d in dims))
    rows = rows.withColumns({f"_r{i}": relative_deviation(F.col(d), m) for i, (d, m) in enumerate(zip(dims, means, strict=True))})
    rows = rows.withColumns({"statistic": hotelling(rows, [f"_r{i}" for i in range(p)], cov), "threshold": limit, "_why": why if why is not None else F.lit(None).cast("string")})
    reason = F.coalesce("_why", F.when(F.col("statistic").isNull(), "covariance_singular").when(F.col("statistic") >= F.col("threshold"), "statistic_exceeded_threshold").otherwise("within_threshold"))
    verdict = F.when(F.col("_why").isNotNull() | F.col("statistic").isNull(), "suppressed").when(F.col("statistic") >= F.col("threshold"), "fire").otherwise("clean")
    return rows.withColumns({"verdict": verdict, "reason": reason}).drop("_why", *[f"_r{i}" for i in range(p)])


def family_c_verdicts(
    df: DataFrame, keys: list[str], dims: list[str], means: list[Column], cov: dict[tuple[int, int], Column], alpha: float, variant: Column, tau_squared: Column, log_det_shrink: Column, safe_alpha: float, with_kernel: bool | Column = False, why: Column | None = None, threshold: Column | None = None, safe_threshold: Column | None = None, by: str = "tick"
) -> DataFrame:
    """Hotelling verdicts by the variant that each row's cell declares: variant, statistic, log_statistic, threshold, verdict, reason, alpha_spent.

    `safe_test` needs the cell's tau_squared and log_det_shrink, half the logarithm
    of det(S + tau_squared) / det(S), else chi-square runs (hotelling_variant). The
    safe test keeps one log-wealth for each of `keys`: a row adds
    (r' S^-1 r - r' (S + tau_squared)^-1 r) / 2 - log_det_shrink, down to the floor.
    Rows behind a gate, with a singular matrix or with a value that is not finite
    hold it. Wealth saturates as a statistic, not as its logarithm. The first fire of
    a key spends safe_alpha; rows that lack a signal have no verdict.
    """
    p = len(dims)
    rows = df.withColumn("variant", hotelling_variant(variant, tau_squared.isNotNull() & log_det_shrink.isNotNull(), F.lit(True)))
    chi = hotelling_verdicts(rows.where("variant = 'chi_square'"), dims, means, cov, alpha, with_kernel, why, threshold).withColumn("log_statistic", F.log("statistic"))
    r = rows.where("variant = 'safe_test'").where(" and ".join(f"`{d}` is not null" for d in dims))
    r = r.withColumns({f"_r{i}": relative_deviation(F.col(d), m) for i, (d, m) in enumerate(zip(dims, means, strict=True))})
    own = [f"_r{i}" for i in range(p)]
    r = r.withColumns({"_t": hotelling(r, own, cov), "_u": hotelling(r, own, cov, tau_squared), "_why": why if why is not None else F.lit(None).cast("string")})
    stop = F.coalesce("_why", F.when(F.col("_t").isNull(), "covariance_singular").when(F.col("_u").isNull(), "covariance_plus_tau_singular"))
    z = F.when(F.col("_stop").isNull(), 0.5 * F.col("_t") - 0.5 * F.col("_u") - log_det_shrink).otherwise(float("nan"))
    r = reflected_walk(r.withColumn("_stop", stop).withColumn("_z", z), "_z", keys, TINY_FLOOR, "_log_m", by)
    limit = F.coalesce(*([safe_threshold] if safe_threshold is not None else []), F.lit(1 / safe_alpha))
    r = r.withColumns({"statistic": scalar.wealth(F.col("_log_m")), "log_statistic": F.col("_log_m"), "threshold": limit})
    r = r.withColumn("_fire", F.col("_stop").isNull() & (F.col("statistic") >= F.col("threshold")))
    nth = F.sum(F.col("_fire").cast("int")).over(so_far(ordered(keys, by)))
    r = r.withColumns({
        "verdict": F.when(F.col("_stop").isNotNull(), "suppressed").when(F.col("_fire"), "fire").otherwise("clean"), "reason": F.coalesce("_stop", F.when(F.col("_fire"), "safe_hotelling_wealth_exceeded").otherwise("below_threshold")),
        "alpha_spent": F.when(F.col("_fire") & (nth == 1), safe_alpha).otherwise(0.0),
    })
    return chi.unionByName(r.drop("_t", "_u", "_why", "_stop", "_z", "_log_m", "_fire", *own), allowMissingColumns=True)


def conformal_verdicts(df: DataFrame, alpha: float, score: str = "score", n: str = "n", p: str = "p", schema: Column | None = None, why: Column | None = None) -> DataFrame:
    """Verdict of conformal p-values: silent under a changed schema, with fewer than 1 / alpha - 1 calibration scores, behind a gate, or without a score."""
    schema = schema if schema is not None else F.lit(None).cast("string")
    reasons = [
        F.when(schema == "observability_stack", "observability_stack_deploy").when(schema == "breaking", "schema_continuity_breaking"),
        F.when(F.col(n) + 1 < math.ceil(1 / alpha), "calibration_underpowered"),
        *([why] if why is not None else []),
        F.when(F.col(score).isNull(), "covariance_singular"),
    ]
    silent = F.coalesce(*reasons)
    verdict = F.when(silent.isNotNull(), "suppressed").when(F.col(p) < alpha, "fire").otherwise("clean")
    return df.withColumns({"verdict": verdict, "reason": F.coalesce(silent, F.when(F.col(p) < alpha, "conformal_p_below_alpha").otherwise("conformal_p_above_alpha"))})


def tier_gated(confidence: Column, mean: Column, cov: Column, baseline: Column) -> Column:
    """STRUCT<mean, covariance, delta> of a shard's residual: mean and covariance at the strict tier, the difference from the baseline's mean at the warm start if both have as many entries, else nulls."""
    strict = (confidence == "strict") & mean.isNotNull() & cov.isNotNull()
    warm = (confidence == "warm_start") & mean.isNotNull() & baseline.isNotNull() & (F.size(mean) == F.size(baseline))
    return F.struct(F.when(strict, mean).alias("mean"), F.when(strict, cov).alias("covariance"), F.when(warm, F.zip_with(mean, baseline, lambda a, b: a - b)).alias("delta"))


def exogenous(name: Column) -> Column:
    """Whether a covariate's name speaks of none of the system's own responses."""
    return ~F.lower(name).rlike("|".join(RESPONSES))


def telemetry_problems(df: DataFrame, ticks: int) -> DataFrame:
    """(factor, problem) of factor telemetry (factor, tick, value): other ticks than 0 .. ticks - 1, ticks that come twice, values that are not finite."""
    g = df.groupBy("factor").agg(F.count("*").alias("n"), F.count_distinct("tick").alias("d"), F.min("tick").alias("lo"), F.max("tick").alias("hi"), F.sum((F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).cast("int")).alias("bad"))
    found = F.array_compact(F.array(F.when(F.col("n") > F.col("d"), "duplicate tick"), F.when((F.col("d") != ticks) | (F.col("lo") != 0) | (F.col("hi") != ticks - 1), "length is not that of the grid"), F.when(F.col("bad") > 0, "value is not finite")))
    return g.select("factor", F.explode(found).alias("problem"))


def substrate(spark: SparkSession, path: str) -> DataFrame:
    """The calibration substrate of a JSON file as one row; another version, or a file without baseline, ar1, source or generated_at, is an error."""
    schema = (
        "version string, source string, generated_at string, baseline struct<mean:double,sigma_squared:double>, ar1 struct<phi:double,sigma_squared_innovation:double>, "
        "ar_p struct<phi:array<double>,sigma_squared_innovation:double>, seasonal struct<period:int,seasonal_means:array<double>,ar1_phi_deseasoned:double,sigma_squared_innovation_deseasoned:double>, "
        "spectral struct<min_peak_lag:int,max_peak_lag:int,bootstrap_null_quantile:double>"
    )
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    fine = (F.col("version") == SUBSTRATE_VERSION) & F.col("baseline").isNotNull() & F.col("ar1").isNotNull() & F.col("source").isNotNull() & F.col("generated_at").isNotNull()
    return df.withColumn("version", F.when(fine, F.col("version")).otherwise(F.raise_error(F.concat(F.lit("not a substrate of version "), F.lit(SUBSTRATE_VERSION))).cast("string")))


def substrate_parameters(df: DataFrame) -> DataFrame:
    """What detectors take from a substrate: variance and phi of the finest model it has, priors and thresholds, and spectral lags and quantile."""
    var = F.coalesce(F.nullif(F.col("seasonal.sigma_squared_innovation_deseasoned"), F.lit(0.0)), F.nullif(F.col("ar_p.sigma_squared_innovation"), F.lit(0.0)), F.col("ar1.sigma_squared_innovation"))
    quantile = F.coalesce(F.col("spectral.bootstrap_null_quantile"), F.lit(0.9))
    return df.select(
        F.col("baseline.mean").alias("mean"), var.alias("variance"), (var / 2).alias("tau_squared"), (1.5 * F.sqrt(var)).alias("delta_min"), F.lit("heavy_tail").alias("signal_class"), F.lit(1000.0).alias("betting_threshold"),
        F.coalesce(F.col("seasonal.ar1_phi_deseasoned"), F.col("ar1.phi")).alias("phi"), F.col("ar1.phi").alias("spectral_phi"), F.col("ar_p.phi").alias("phi_array"), F.col("seasonal.period").alias("period"), F.col("seasonal.seasonal_means").alias("seasonal_means"),
        F.coalesce(F.col("spectral.min_peak_lag"), F.lit(3)).alias("min_peak_lag"), F.coalesce(F.col("spectral.max_peak_lag"), F.lit(10)).alias("max_peak_lag"), quantile.alias("null_quantile"),
    )
