"""Replay of labelled series: annotation windows, smoothing, scores; and certification rules over measured cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.walks import anchored
from ..functions.windows import ordered
from .fleet import Cooldown

#: Weights of true positives, false positives and misses. Fixed values.
PROFILES = {"standard": (1.0, -0.22, -1.0), "reward_low_fp": (1.0, -0.46, -1.0), "reward_low_fn": (2.0, -0.22, -2.0)}


#: Least mean score that a family must reach. Fixed values.
FLOORS = {"mixture": 50, "betting": 50, "spectral": 40}


def normal_timestamp(t: Column) -> Column:
    """Date and time with a blank between, without zone mark and fraction."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "T", " "), "Z$", ""), r"\.\d+$", "")


def annotation_windows(labels: DataFrame, series: DataFrame) -> DataFrame:
    """Tick windows of labelled timestamp windows; of equal timestamps the last tick counts, and windows without a match go."""
    at = series.groupBy("dataset", normal_timestamp(F.col("timestamp")).alias("k")).agg(F.max("tick").alias("tick"))
    a, b = at.select("dataset", F.col("k").alias("ks"), F.col("tick").alias("start")), at.select("dataset", F.col("k").alias("ke"), F.col("tick").alias("end"))
    lab = labels.withColumn("ks", normal_timestamp(F.col("start_ts"))).withColumn("ke", normal_timestamp(F.col("end_ts")))
    return lab.join(a, ["dataset", "ks"]).join(b, ["dataset", "ke"]).select("dataset", "start", "end")


def smoothed(df: DataFrame, keys: list[str], window: int, threshold: int) -> DataFrame:
    """Whether at least `threshold` of the last `window` ticks fired."""
    w = ordered(keys).rowsBetween(1 - window, 0)
    return df.withColumn("smooth", F.sum(F.col("fire").cast("int")).over(w) >= threshold)


def likelihood_smoothed(df: DataFrame, keys: list[str], window: int, threshold: int, cooldown: int) -> DataFrame:
    """Firings after smoothing and a cooldown: `fire` is true where at least `threshold` of the last `window` ticks fired and more than `cooldown` ticks have passed since the last such emission.

    With a window or a threshold of 0 or less the firings stay as they are.
    """
    if window <= 0 or threshold <= 0:
        return df
    if threshold > window:
        raise ValueError(f"threshold {threshold} exceeds the window of {window}")
    s = smoothed(df, keys, window, threshold)
    emitted = anchored(s.where("smooth"), keys, ["tick"], ["tick"], Cooldown("tick", cooldown)).withColumn("fire", F.col("kept")).drop("kept", "smooth")
    return emitted.unionByName(s.where("smooth is null or not smooth").withColumn("fire", F.lit(False)).drop("smooth"))


def replay_score(firings: DataFrame, windows: DataFrame, datasets: DataFrame, profile: str = "standard") -> DataFrame:
    """Score of each dataset: the first firing of each window by a sigmoid of its place, misses, firings outside all windows, over a perfect run; at least 0.

    Windows of a dataset must not overlap (a firing is claimed once); firings
    find theirs as the last that began, in one pass over both.
    """
    tp, fp, fn = PROFILES[profile]
    sig = lambda r: 1 / (1 + F.exp(-5.0 * r))
    f = firings.where("fire").select("dataset", "tick")
    w = windows.select("dataset", F.col("start").alias("lo"), F.col("end").alias("hi"))
    marked = w.select("dataset", F.col("lo").alias("tick"), F.struct("lo", "hi").alias("own"), F.lit(0).alias("kind")).unionByName(f.select("dataset", "tick", F.lit(None).cast("struct<lo:bigint,hi:bigint>").alias("own"), F.lit(1).alias("kind")))
    upto = Window.partitionBy("dataset").orderBy("tick", "kind").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("now", F.last("own", ignorenulls=True).over(upto)).withColumn("inside", (F.col("kind") == 1) & F.coalesce(F.col("tick") <= F.col("now.hi"), F.lit(False)))
    hits = marked.where("now is not null and (kind = 0 or inside)").groupBy("dataset", "now.lo", "now.hi").agg(F.min(F.when(F.col("kind") == 1, F.col("tick"))).alias("first"))
    rel = (F.col("hi") - F.col("first")) / F.greatest(F.lit(1), F.col("hi") - F.col("lo"))
    per = hits.groupBy("dataset").agg(F.sum(F.when(F.col("first").isNull(), fn).otherwise(tp * sig(rel))).alias("gain"), F.count("*").alias("n_windows"))
    out = marked.where("kind = 1 and not inside").groupBy("dataset").agg(F.count("*").alias("n_outside"))
    j = datasets.select("dataset").join(per, "dataset", "left").join(out, "dataset", "left").na.fill(0, ["n_outside", "n_windows"]).na.fill(0.0, ["gain"])
    perfect = F.col("n_windows") * (tp * sig(F.lit(1.0)))
    raw = F.col("gain") + F.col("n_outside") * fp
    return j.select("dataset", "n_windows", "n_outside", F.greatest(F.lit(0.0), F.when(F.col("n_windows") == 0, 100 + F.col("n_outside") * fp).otherwise(100 * raw / perfect)).alias("score"))


def resampler_cube(counts: DataFrame) -> DataFrame:
    """Counts by family and mode with every combination present."""
    f, m = counts.select("family").distinct(), counts.select("mode").distinct()  # a handful of each
    return f.crossJoin(F.broadcast(m)).join(counts.groupBy("family", "mode").agg(F.sum("n").alias("n")), ["family", "mode"], "left").na.fill(0, ["n"])


def resampler_acceptance(counts: DataFrame, alpha: Column, windows: int, margin: float = 1.2) -> DataFrame:
    """Mean count of each family over its seeds, and whether it stays under margin * alpha * windows."""
    g = counts.groupBy("family").agg(F.avg("n").alias("mean"), F.count("*").alias("seeds"))
    return g.withColumn("limit", margin * alpha * windows).withColumn("accepted", F.col("mean") <= F.col("limit"))


def unpaired(validity: DataFrame, power: DataFrame, keys: list[str]) -> DataFrame:
    """Validity cells without a power cell."""
    return validity.join(power.select(*keys).distinct(), keys, "left_anti")


#: Null families: whether an id must carry, may carry or must not carry -p (autocorrelation) and -m (calibration length), where phi comes from, and which parameters are known. Fixed values.
NULLS = {
    1: ("no", "no", "oracle", "oracle"),
    2: ("no", "must", "iid-by-construction", "estimated-moments"),
    3: ("must", "may", "oracle", "oracle-phi"),
    4: ("must", "may", "estimated", "estimated-phi"),
    5: ("no", "no", "iid-by-construction", "moment-matched"),
    6: ("no", "no", "iid-by-construction", "moment-matched"),
    7: ("no", "no", "oracle", "oracle"),
}


def null_parameters(null_id: Column) -> Column:
    """STRUCT<phi, phi_source, params> of a null's id, N<1-7>[-p<digits>][-m<digits>] (p06 is 0.6, p095 is 0.95); null for any other id."""
    part = lambda i: F.regexp_extract(null_id, r"^N([1-7])(?:-p(\d{2,3}))?(?:-m(\d+))?$", i)
    fits = {"no": lambda c: c == "", "must": lambda c: c != "", "may": lambda c: F.lit(True)}
    digits = F.regexp_replace(part(2), "^0+", "")
    phi = F.when(digits == "", 0.0).otherwise(F.concat(F.lit("0."), digits).cast("double"))
    known = [F.when((part(1) == str(n)) & fits[p](part(2)) & fits[m](part(3)), F.struct(phi.alias("phi"), F.lit(source).alias("phi_source"), F.lit(params).alias("params"))) for n, (p, m, source, params) in NULLS.items()]
    return F.coalesce(*known)


def null_phi(null_id: Column) -> Column:
    """Autocorrelation that a null's id names; null for an id of another form."""
    return null_parameters(null_id)["phi"]


def injected(df: DataFrame, kind: str, sigma: Column, at: int, size: float = 3.0, period: int = 10, value: str = "value", seed: int = 0) -> Column:
    """A fault in a series from tick `at`: step, unison (the same step in every series), drift, oscillation, point, or shape.

    A shape change replaces values by sigma times a mixture of two normal laws
    `size` apart, of mean 0 and variance 1 (size up to 2).
    """
    t = F.col("tick") - at
    on = t >= 0
    if kind == "shape":
        spread = math.sqrt(max(0.0, 1 - size * size / 4))
        mixed = F.when(F.rand(seed) < 0.5, size / 2).otherwise(-size / 2) + spread * F.randn(seed + 1)
        return F.when(on, sigma * mixed).otherwise(F.col(value))
    step = sigma * size
    extra = {"step": step, "unison": step, "drift": step * t / 100.0, "oscillation": step * F.sin(2 * math.pi * t / period), "point": F.when(t == 0, step).otherwise(0.0)}[kind]
    return F.col(value) + F.when(on, extra).otherwise(0.0)


def last_kept(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not superseded: the newest run of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("run"))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
