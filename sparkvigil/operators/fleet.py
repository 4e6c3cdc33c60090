"""Evidence over a fleet: combination, e-BH selection, trackers, lifecycles, common-mode residuals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.walks import Jumps, anchored
from ..functions.windows import ordered, so_far


def combine_product(df: DataFrame, keys: list[str], log_e: str = "log_e") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(log_e).alias("log_fleet_e"), F.count("*").alias("n"))


def combine_average(df: DataFrame, keys: list[str], log_e: str = "log_e") -> DataFrame:
    """Logarithm of the mean e-value, shifted by the largest: two partial aggregates."""
    top = df.groupBy(*keys).agg(F.max(log_e).alias("_m"))
    d = df.join(top, keys)
    return d.groupBy(*keys).agg((F.first("_m") + F.log(F.sum(F.exp(F.col(log_e) - F.col("_m")))) - F.log(F.count("*"))).alias("log_fleet_e"), F.count("*").alias("n"))


def track(df: DataFrame, keys: list[str], log_threshold: float, by: str = "tick") -> DataFrame:
    """Running maximum from 0, sticky fire and the 0-based index of the first."""
    w = ordered(keys, by)
    d = df.withColumn("log_max", F.greatest(F.lit(0.0), F.max("log_fleet_e").over(so_far(w)))).withColumn("_i", F.row_number().over(w) - 1)
    d = d.withColumn("fired", F.col("log_max") >= log_threshold)
    return d.withColumn("first_fire", F.min(F.when(F.col("fired"), F.col("_i"))).over(so_far(w))).drop("_i")


def e_bh(df: DataFrame, keys: list[str], q: float, e: str = "e", idx: str = "idx", log: bool = False) -> DataFrame:
    """Adds rank, k (the number selected) and selected: the largest k with k * e(k) >= n / q, e descending, ties by idx."""
    return e_bh_of(df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))), keys, q, e, idx, log)


def e_bh_of(df: DataFrame, keys: list[str], q: float, e: str, idx: str, log: bool = False) -> DataFrame:
    """e-BH over rows that know the number of hypotheses, _n."""
    w = Window.partitionBy(*keys).orderBy(F.desc(e), idx)
    whole = Window.partitionBy(*keys)
    d = df.withColumn("rank", F.row_number().over(w))
    passes = F.log("rank") + F.col(e) >= F.log(F.col("_n") / q) if log else F.col("rank") * F.col(e) >= F.col("_n") / q
    d = d.withColumn("k", F.coalesce(F.max(F.when(passes, F.col("rank"))).over(whole), F.lit(0)))
    return d.withColumn("selected", F.col("rank") <= F.col("k")).drop("_n")


def e_bh_boosted(df: DataFrame, keys: list[str], q: float, survival: Column, null_mean: float = 1.0, e: str = "e", idx: str = "idx") -> DataFrame:
    """e-BH after conditional calibration: an e-value becomes its own threshold where threshold times null survival is at most the null mean.

    Asked at its own observed value, a unit's leave-in selection is the plain one
    plus itself, so one plain pass gives all thresholds.
    """
    plain = e_bh(df, keys, q, e, idx)
    size = F.count("*").over(Window.partitionBy(*keys))
    r = F.col("k") + F.when(F.col("selected"), 0).otherwise(1)
    thr = size / (q * r)
    boosted = plain.withColumn("boosted", F.when(thr * survival <= null_mean, thr * (1 + 1e-9)).otherwise(0.0)).drop("rank", "k", "selected")
    return e_bh(boosted, keys, q, "boosted", idx)


def confidence_tiers(df: DataFrame, keys: list[str], seed: str = "seed", by: str = "tick", warm: int = 20, strict: int = 60) -> DataFrame:
    """Samples since the last change of seed, and none / warm_start / strict; the first sample of a new seed is `none`."""
    w = ordered(keys, by)
    d = df.withColumn("_new", (F.lag(seed).over(w) != F.col(seed)).cast("int"))
    d = d.withColumn("epoch", F.sum(F.coalesce("_new", F.lit(0))).over(so_far(w)))
    n = F.row_number().over(ordered([*keys, "epoch"], by))
    return d.withColumn("n_samples", n).withColumn("confidence", F.when(F.col("n_samples") >= strict, "strict").when(F.col("n_samples") >= warm, "warm_start").otherwise("none")).drop("_new")


def welford(df: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """Mean vector and sample covariance matrix (null below two samples)."""
    mean = F.array(*[F.avg(d) for d in dims])
    cov = F.array(*[F.array(*[F.covar_samp(a, b) for b in dims]) for a in dims])
    return df.groupBy(*keys).agg(F.count("*").alias("n"), mean.alias("mean"), F.when(F.count("*") > 1, cov).alias("cov"))


class _Alarms(Jumps):
    """Anchors are the ticks that re-record: state (tick, fired ticks since). `dense` marks ticks that end `threshold` fires within the window."""

    added = "record boolean"

    def __init__(self, by: str, threshold: int, cooldown: int):
        self.by, self.threshold, self.cooldown = by, threshold, cooldown

    @staticmethod
    def _dense_from(rows: dict[str, np.ndarray]) -> np.ndarray:
        """The next dense row from each row on, and a last entry for none."""
        n = len(rows["_dense"])
        at = np.where(rows["_dense"].astype(bool), np.arange(n), n)
        return np.append(np.minimum.accumulate(at[::-1])[::-1], n)

    def enter(self, state: tuple | None, rows: dict[str, np.ndarray]) -> int:
        t, n = rows[self.by], len(rows[self.by])
        low = np.searchsorted(t, 0) if state is None else max(self.threshold - 1 - state[1], np.searchsorted(t, state[0] + self.cooldown))
        return int(self._dense_from(rows)[min(low, n)])

    def after(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        t, n = rows[self.by], len(rows[self.by])
        low = np.maximum(np.arange(n) + self.threshold, np.searchsorted(t, t + self.cooldown))
        return self._dense_from(rows)[np.minimum(np.maximum(low, np.arange(n) + 1), n)]

    def leave(self, rows: dict[str, np.ndarray], at: np.ndarray) -> list[tuple]:
        n = len(rows[self.by])
        return [(int(x), n - 1 - int(i)) for x, i in zip(rows[self.by][at], at, strict=True)]

    def passed(self, state: tuple | None, rows: dict[str, np.ndarray]) -> tuple | None:
        return state and (state[0], state[1] + len(rows[self.by]))

    def reach(self, rows: dict[str, np.ndarray]) -> int:
        t, n = rows[self.by], len(rows[self.by])
        low = max(self.threshold - 1, np.searchsorted(t, t[0] + self.cooldown), np.searchsorted(t, 0))
        return int(self._dense_from(rows)[min(low, n)]) + 1

    def told(self, state: tuple | None, rows: dict[str, np.ndarray], anchors: np.ndarray) -> dict[str, np.ndarray]:
        return {"record": anchors}


class Cooldown(Jumps):
    """Anchors are the kept ticks: state (tick,)."""

    added = "kept boolean"

    def __init__(self, by: str, cooldown: int):
        self.by, self.cooldown = by, cooldown

    def enter(self, state: tuple | None, rows: dict[str, np.ndarray]) -> int:
        return 0 if state is None else int(np.searchsorted(rows[self.by], state[0] + self.cooldown, "right"))

    def after(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return np.searchsorted(rows[self.by], rows[self.by] + self.cooldown, "right")

    def leave(self, rows: dict[str, np.ndarray], at: np.ndarray) -> list[tuple]:
        return [(int(x),) for x in rows[self.by][at]]

    def reach(self, rows: dict[str, np.ndarray]) -> int:
        return int(np.searchsorted(rows[self.by], rows[self.by][0] + self.cooldown, "right")) + 1

    def told(self, state: tuple | None, rows: dict[str, np.ndarray], anchors: np.ndarray) -> dict[str, np.ndarray]:
        return {"kept": anchors}


def lifecycle(fires: DataFrame, keys: list[str], window: int = 150, threshold: int = 4, cooldown: int = 150, by: str = "tick") -> DataFrame:
    """Adds `record` to rows of fired ticks: `threshold` alarms within the window and past the cooldown; a trigger clears the alarms.

    Whether a tick ends `threshold` fires within the window is read off in time
    slots as wide as the window, each with the slot before it; the rest is a chain
    of triggers (functions/walks.py). Fires without a tick get no `record`.
    """
    slot = F.floor(F.col(by) / window)
    wide = fires.withColumn("_s", F.explode(F.array(slot, slot + 1))).withColumn("_then", F.lag(by, threshold - 1).over(Window.partitionBy(*keys, "_s").orderBy(by)) if threshold > 1 else F.col(by))
    wide = wide.where((F.col("_s") == slot) | F.col(by).isNull()).withColumn("_dense", F.coalesce(F.col("_then") > F.col(by) - window, F.lit(False)).cast("int")).drop("_s", "_then")
    return anchored(wide, keys, [by], [by, "_dense"], _Alarms(by, threshold, cooldown)).drop("_dense")


def cooled(fires: DataFrame, keys: list[str], cooldown: int, by: str = "tick") -> DataFrame:
    """Greedy thinning of fired ticks: one within `cooldown` of the last kept one goes, and so does one without a tick."""
    return anchored(fires, keys, [by], [by], Cooldown(by, cooldown)).where("kept").drop("kept")


def e_bh_selected(df: DataFrame, keys: list[str], q: float, e: str = "e", idx: str = "idx") -> DataFrame:
    """The rows that e-BH selects, with their rank.

    No e-value below 1 / q can be among k with k * e >= n / q and k <= n, so only
    the others are ranked; the fleet's size is a partial count.
    """
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return e_bh_of(df.where(F.col(e) >= 1 / q).join(n, keys), keys, q, e, idx).where("selected").drop("selected", "k")


def shard_levels(df: DataFrame, keys: list[str], cal_len: int, value: str = "value") -> DataFrame:
    """Exact median of each shard's first `cal_len` ticks."""
    return df.where(F.col("tick") < cal_len).groupBy(*keys).agg(F.median(value).alias("level"))


def _middle(a: Column) -> Column:
    """Median of a sorted array."""
    return (F.element_at(a, ((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, (F.size(a) / 2).cast("int") + 1)) / 2


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def biweight(df: DataFrame, xs: str, out: str, c: float = 4.685, rounds: int = 50) -> DataFrame:
    """Adds Tukey's biweight location of an array column: fixed scale of 1.4826 median deviations, up to `rounds` reweightings until it moves under 1e-9 scales."""
    df = df.withColumn("_m", _middle(F.array_sort(xs))).withColumn("_s", _middle(F.array_sort(F.transform(xs, lambda x: F.abs(x - F.col("_m"))))) * 1.4826)

    def again(acc: Column, _: Column) -> Column:
        def weigh(p: Column, x: Column) -> Column:
            w = F.pow(F.greatest(F.lit(0.0), 1 - F.pow((x - acc["loc"]) / (c * F.col("_s")), F.lit(2))), F.lit(2))
            return F.struct((p["w"] + w).alias("w"), (p["wx"] + w * x).alias("wx"))

        def moved(a: Column, t: Column) -> Column:
            loc = F.when(t["w"] > 0, t["wx"] / t["w"]).otherwise(a["loc"])
            return F.struct(loc.alias("loc"), (F.abs(loc - a["loc"]) <= 1e-9 * F.col("_s")).alias("done"))

        sums = F.aggregate(F.col(xs), F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wx")), weigh)
        return F.when(acc["done"], acc).otherwise(F.aggregate(F.array(sums), acc, moved))

    start = F.struct(F.col("_m").alias("loc"), (F.col("_s") <= 0).alias("done"))
    return df.withColumn(out, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, again)["loc"]).drop("_m", "_s")


def common_mode_residuals(df: DataFrame, fleet: list[str], cal_len: int, shard: str = "shard", value: str = "value") -> DataFrame:
    """Values less the shard's level and less the tick's robust location over the fleet's shards.

    One tick of one fleet is one array; fleets wider than a task are not a row of this operator.
    """
    lev = shard_levels(df, [*fleet, shard], cal_len, value)
    d = df.join(lev, [*fleet, shard]).withColumn("_d", F.col(value) - F.col("level"))
    loc = biweight(d.groupBy(*fleet, "tick").agg(F.collect_list("_d").alias("_x")), "_x", "location").drop("_x")
    return d.join(loc, [*fleet, "tick"]).withColumn("residual", F.col("_d") - F.col("location")).drop("_d")


def rollup_by_event(df: DataFrame, event: str = "cluster_event_id") -> DataFrame:
    """Distinct groups and deploys of each cluster event, and when it was first seen; events without an id are left out."""
    return df.where(F.coalesce(F.col(event), F.lit("")) != "").groupBy(event).agg(F.count_distinct("group_id").alias("n_groups"), F.count_distinct("deploy_id").alias("n_deploys"), F.min("ts").alias("first_seen"))
