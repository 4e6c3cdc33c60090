"""Closed-form e-values of a calibration and a test window, and the registry of their guarantees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import ordered

#: Evidence that may or may not enter false-discovery control: id, valid under an estimated baseline, largest autocorrelation (none: any), least calibration. Fixed values.
ENVELOPES = (
    ("safe_t_e_value", True, 0.95, 3), ("universal_inference_e_value", True, None, 6), ("sequential_ui_e_process", True, None, 3), ("nuisance_robust_bf_e_value", False, None, 100),
    ("betting_e_process", False, None, None), ("mixture_supermartingale", False, None, None), ("shape_kurtosis_e_value", False, None, 200),
)
#: What each family of detector ids guarantees: prefix, family, class of validity, how alpha is spent. Fixed values.
GUARANTEES = (
    ("mSPRT_", "A", "ville_anytime_valid", "ville_spend"), ("page_cusum_", "A", "ville_anytime_valid", "ville_spend"), ("betting_e_process_", "A", "ville_anytime_valid", "ville_spend"),
    ("hotelling_t2_joint_vector", "C", "classical_epoch", "classical_epoch_alpha"), ("hotelling_t2_safe", "C", "ville_anytime_valid", "ville_spend"),
    ("sequential_mmd_betting_e_process", "C", "ville_anytime_valid", "ville_spend"), ("sequential_mmd_e_process", "C", "ville_anytime_valid", "ville_spend"), ("sequential_mmd", "C", "classical_epoch", "none"),
    ("spectral_peak_acf_", "D", "classical_epoch", "classical_epoch_alpha"), ("spectral_e_detector_", "D", "bounded_priced", "priced_spend_requires_c_bound"),
    ("mahalanobis_conformal_baseline", "E", "exact_finite_sample", "classical_epoch_alpha"),
)
#: Ids of the structural rules, which guarantee nothing. Fixed values.
STRUCTURAL_RULES = (
    "kv_saturation", "hbm_elevation", "hbm_spill_roll", "mfu_collapse", "slowbleed", "collective", "capacity", "gpu_eff", "compound_lat", "tok_econ", "behavioral", "eval_quality_drop", "refusal_spike",
    "output_len_drift", "tool_call_degradation", "quality_warning",
)


def whitened(df: DataFrame, keys: list[str], cal: tuple[int, int], test: tuple[int, int], value: str = "value", by: str = "tick") -> DataFrame:
    """One row for each series: moments of the whitened calibration and test windows [start, start + length).

    phi is estimated in the calibration window alone.
    """
    w = ordered(keys, by)
    d = df.withColumn("_p", F.lag(value).over(w)).withColumn("_c", F.col(by).between(cal[0], cal[0] + cal[1] - 1)).withColumn("_t", F.col(by).between(test[0], test[0] + test[1] - 1))
    d = d.where("_c or _t").withColumn("_m", F.avg(F.when(F.col("_c"), F.col(value))).over(Window.partitionBy(*keys)))
    x, p = F.col(value) - F.col("_m"), F.col("_p") - F.col("_m")
    inner = F.col("_c") & (F.col(by) > cal[0])
    whole = Window.partitionBy(*keys)
    d = d.withColumns({"_a": F.sum(F.when(inner, x * p)).over(whole), "_b": F.sum(F.when(F.col("_c"), x * x)).over(whole), "_n": F.count(F.when(F.col("_c"), 1)).over(whole)})
    raw = F.col("_a") / F.col("_b")
    d = d.withColumn("phi", F.when((F.col("_n") < 3) | (F.col("_b") < 1e-12), 0.0).otherwise(F.greatest(F.lit(-0.95), F.least(F.lit(0.95), raw + (1 + 3 * raw) / F.col("_n")))))
    d = d.withColumn("_w", F.col(value) - F.col("phi") * F.col("_p"))
    c, t = F.when(inner, F.col("_w")), F.when(F.col("_t"), F.col("_w"))
    k = F.when(F.col("_t"), (F.col(by) - test[0]).cast("double"))
    return d.groupBy(*keys).agg(
        F.first("phi").alias("phi"), F.count(c).alias("n1"), F.count(t).alias("n2"), F.avg(c).alias("m1"), F.avg(t).alias("m2"), F.var_samp(c).alias("v1"), F.var_samp(t).alias("v2"),
        F.coalesce(F.regr_slope(t, k), F.lit(0.0)).alias("slope"), F.regr_sxx(t, k).alias("sxx"), F.avg(F.when(F.col("_c"), F.col(value))).alias("cal_mean"), F.avg(F.when(F.col("_t"), F.col(value))).alias("test_mean"), F.var_samp(F.when(F.col("_c"), F.col(value))).alias("cal_var"),
    )


def safe_t(m: DataFrame, prior: float = 25.0) -> Column:
    """Two-sample t e-value with the variance integrated out."""
    n1, n2 = F.col("n1"), F.col("n2")
    nu = n1 + n2 - 2
    pooled = F.greatest(((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / nu, F.lit(1e-12))
    t2 = F.pow(F.col("m2") - F.col("m1"), F.lit(2)) / (pooled * (1 / n1 + 1 / n2)) / nu
    r = 1 + n1 * n2 / (n1 + n2) * prior
    return F.pow(r, F.lit(-0.5)) * F.pow((1 + t2) / (1 + t2 / r), (nu + 1) / 2)


def signature(m: DataFrame) -> DataFrame:
    """Variance ratio, trend and collapse of the test window, and whether any passes its bound."""
    v1, v2 = F.greatest("v1", F.lit(1e-9)), F.greatest("v2", F.lit(1e-9))
    trend = F.abs("slope") / F.sqrt(v1 / F.greatest("sxx", F.lit(1e-9)))
    fall = F.greatest(F.lit(0.0), (F.col("cal_mean") - F.col("test_mean")) / F.sqrt(F.greatest("cal_var", F.lit(1e-9))))
    out = m.withColumn("f_ratio", v2 / v1).withColumn("trend_t", trend).withColumn("collapse_sigma", fall)
    return out.withColumn("has_signature", (F.col("f_ratio") > 2) | (F.col("trend_t") > 4) | (F.col("collapse_sigma") > 6))


def group_average(df: DataFrame, keys: list[str], e: str = "e") -> DataFrame:
    """Mean of e-values, from logarithms around their largest."""
    top = Window.partitionBy(*keys)
    d = df.withColumn("_l", F.log(e)).withColumn("_m", F.max("_l").over(top))
    mean = F.exp(F.first("_m", True) + F.log(F.sum(F.coalesce(F.exp(F.col("_l") - F.col("_m")), F.lit(0.0)))) - F.log(F.count("*")))
    return d.groupBy(*keys).agg(F.coalesce(mean, F.lit(0.0)).alias("e"), F.count("*").alias("n"))


def guaranteed(df: DataFrame, detector: str = "detector_id") -> DataFrame:
    """Family, validity class and alpha policy of each row's detector id, by its longest known prefix."""
    known = [*GUARANTEES, *((r, "B", "heuristic", "none") for r in STRUCTURAL_RULES)]
    rows = df.sparkSession.createDataFrame(known, "prefix string, family string, validity string, alpha_policy string")
    ids = df.select(detector).distinct()  # the registry's ids, not the rows
    w = Window.partitionBy(detector).orderBy(F.desc(F.length("prefix")))
    best = ids.join(F.broadcast(rows), F.col(detector).startswith(F.col("prefix"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return df.join(best, detector, "left")


def admissible(df: DataFrame, detector: str = "detector_id", phi: str = "phi", cal_len: str = "cal_len", true_baseline: Column | None = None) -> DataFrame:
    """Adds `admissible`: a known envelope that is valid under an estimated baseline (or a baseline asserted true), a measured autocorrelation within its reach, calibration enough.

    Unknown detectors and unmeasured autocorrelations are refused where a limit exists.
    """
    rows = df.sparkSession.createDataFrame(ENVELOPES, f"{detector} string, valid_estimated boolean, max_phi double, min_calibration int")
    j = df.join(F.broadcast(rows), detector, "left")  # seven rows
    valid = F.col("valid_estimated") if true_baseline is None else F.col("valid_estimated") | true_baseline
    reach = F.col("max_phi").isNull() | F.coalesce(F.abs(phi) <= F.col("max_phi"), F.lit(False))
    long_enough = F.col("min_calibration").isNull() | (F.col(cal_len) >= F.col("min_calibration"))
    return j.withColumn("admissible", F.coalesce(valid & reach & long_enough, F.lit(False)))
