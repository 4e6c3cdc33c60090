"""Ingest contract: counters to rates, schema continuity, grid alignment, rolling trend features, cells and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.windows import ordered

UINT32 = 4294967296.0


def counter_rate(df: DataFrame, keys: list[str], expected_seconds: float, jitter: float = 0.5, wrap_ratio: float = 0.9, semantic: Column | None = None, width: Column | None = None) -> DataFrame:
    """Rates of consecutive samples, in order of `arrival`: columns value and ts in seconds.

    No time passed: null, degraded, whatever the type. A gap over the expected
    interval and its jitter is degraded. Gauges pass. A counter that fell has
    wrapped if it is 32 bits wide and was near its end, else it was reset.
    """
    semantic = F.lit("counter") if semantic is None else semantic
    width = F.lit(32) if width is None else width
    w = ordered(keys, "arrival")
    df = df.withColumn("_v", F.lag("value").over(w)).withColumn("_t", F.lag("ts").over(w)).where(F.col("_t").isNotNull())
    v, p, dt = F.col("value"), F.col("_v"), F.col("ts") - F.col("_t")
    stuck, gauge, fell = dt <= 0, semantic != "counter", v < p
    wraps = ~stuck & ~gauge & fell & (width == 32) & (p > wrap_ratio * (UINT32 - 1))
    resets = ~stuck & ~gauge & fell & ~wraps
    rate = F.when(stuck | resets, None).when(gauge, v).when(wraps, (UINT32 - p + v) / dt).otherwise((v - p) / dt)
    missed = ~stuck & (dt > expected_seconds * (1 + jitter))
    return df.select(
        *keys, "arrival", rate.alias("rate"), dt.alias("elapsed"), F.when(stuck | missed, "degraded").otherwise("normal").alias("slope_quality"), missed.alias("missed_scrape"),
        wraps.alias("wrapped"), resets.alias("reset"), stuck.alias("nonpositive_elapsed"),
    )


def _same_set(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.array_sort(a) == F.array_sort(b))


def _keeps_all(base: Column, seen: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(base, empty), F.coalesce(seen, empty))) == 0


def schema_continuity(base: str, seen: str, stack_deploy: Column | None = None) -> Column:
    """continuous, extended, breaking or observability_stack, for two STRUCTs of a signal's schema.

    Identity fields, quantiles and bucket bounds must be equal (null is not the
    empty list); labels, span names and attributes may only grow.
    """
    f = lambda s, c: F.col(f"{s}.{c}")
    lists = ("quantile_list", "bucket_boundaries")
    sets = ("label_keys", "trace_span_names", "trace_attribute_keys")
    same_id = F.lit(True)
    for c in ("signal_name", "unit", "semantic_type", "granularity"):
        same_id = same_id & f(base, c).eqNullSafe(f(seen, c))
    for c in lists:
        same_id = same_id & _same_set(f(base, c), f(seen, c))
    grown, equal = F.lit(True), same_id
    for c in sets:
        grown = grown & _keeps_all(f(base, c), f(seen, c))
        equal = equal & _same_set(f(base, c), f(seen, c))
    out = F.when(equal, "continuous").when(~(same_id & grown), "breaking").otherwise("extended")
    return F.when(stack_deploy, "observability_stack").otherwise(out) if stack_deploy is not None else out


def families_suppressed(continuity: Column) -> Column:
    """Detector families that a schema change silences."""
    none = F.array().cast("array<string>")
    return F.when(continuity == "breaking", F.array(*map(F.lit, "ACDE"))).when(continuity == "observability_stack", F.array(*map(F.lit, "ABCDE"))).otherwise(none)


def trend_features(df: DataFrame, keys: list[str], value: str = "value", by: str | list[str] = "tick", windows: tuple = (("short", 5), ("medium", 10), ("long", 30))) -> DataFrame:
    """Count, mean, deviation, normed slope, variation, rate of change and strength over trailing windows: one sort for all frames."""
    w = ordered(keys, by)
    df = df.withColumn("_i", F.row_number().over(w).cast("double"))
    for name, size in windows:
        f = w.rowsBetween(1 - size, 0)
        n, mean = F.count(value).over(f), F.avg(value).over(f)
        level = F.abs(mean)
        slope = F.when(n > 1, F.regr_slope(F.col(value), F.col("_i")).over(f)).otherwise(0.0)
        df = df.withColumns({f"{name}_n": n, f"{name}_mean": mean, f"{name}_std": F.stddev_pop(value).over(f), f"{name}_min": F.min(value).over(f), f"{name}_max": F.max(value).over(f), f"{name}_slope_norm": F.when(mean != 0, slope / level).otherwise(0.0), f"{name}_roc": F.when((n >= 3) & (mean != 0), (F.col(value) - F.lag(value, 2).over(w)) / 2 / level).otherwise(0.0)})
        cv = F.when(F.col(f"{name}_mean") != 0, F.col(f"{name}_std") / F.abs(f"{name}_mean")).otherwise(1.0)
        s = F.col(f"{name}_slope_norm")
        df = df.withColumn(f"{name}_cv", cv).withColumn(f"{name}_stable", (F.col(f"{name}_cv") < 0.04) & (F.abs(s) > 0.002))
        df = df.withColumn(f"{name}_strength", F.when(s == 0, 0.0).otherwise(scalar.trend_strength(F.abs(s), F.col(f"{name}_cv"), F.col(f"{name}_stable"), F.col(f"{name}_n"))))
    return df.drop("_i")


def match_cell(df: DataFrame, cells: DataFrame, id_cols: list[str]) -> DataFrame:
    """First cell by `ordinal` with the row's hour, and its day and tier where both sides have them; then the aggregate tier.

    cells: hour, day, tier, ordinal and payload. The hour is an equi-join key, the rest a residual.
    """
    c = cells.select(*[F.col(x).alias(f"cell_{x}") for x in cells.columns])
    agrees = lambda a, b: F.col(a).isNull() | F.col(b).isNull() | (F.col(a) == F.col(b))
    own = agrees("tier", "cell_tier")
    fallback = F.col("cell_tier").isNull() | (F.col("cell_tier") == "aggregate")
    joined = df.join(c, (F.col("hour") == F.col("cell_hour")) & agrees("day", "cell_day") & (own | fallback), "left").withColumn("_rank", F.when(own, 0).otherwise(1))
    first = F.row_number().over(Window.partitionBy(*id_cols).orderBy("_rank", "cell_ordinal"))
    return joined.withColumn("_n", first).where("_n = 1").drop("_n", "_rank")


def gate(schema: Column, ticks: Column, observations: Column, age_days: Column, traffic: Column, bake: tuple = (3, 3, 1), least_traffic: float = 0.0) -> Column:
    """Reason for which a detector stays silent, in the order schema, bake profile, traffic; null if it may speak."""
    baked = (ticks >= bake[0]) & (observations >= bake[1]) & (age_days <= bake[2])
    return (
        F.when(schema == "observability_stack", "observability_stack_deploy").when(schema == "breaking", "schema_continuity_breaking")
        .when(~baked, "bake_profile_not_met").when(traffic < least_traffic, "traffic_pct_below_gate")
    )


def bake_profile(df: DataFrame) -> DataFrame:
    """Strictest profile of a set of signals: most ticks, most observations, fewest days; (3, 3, 1) for none."""
    return df.agg(F.coalesce(F.max("min_ticks"), F.lit(3)).alias("min_ticks"), F.coalesce(F.max("min_observations"), F.lit(3)).alias("min_observations"), F.coalesce(F.min("max_days"), F.lit(1)).alias("max_days"))


def align_to_grid(samples: DataFrame, keys: list[str], t0: float, dt: float, ticks: int, method: str = "hold", max_gap: float | None = None, by: str | None = None) -> DataFrame:
    """Values of (t, v) samples on the grid t0 + i * dt: the last at or before (else the next), or linear between both.

    A value further than max_gap is NaN; a linear one only if both its ends are. Of
    samples of one time, in order of `by`, the last counts before a grid point and
    the first after it.
    """
    grid = samples.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))).alias("i")).withColumn("t", t0 + F.col("i") * dt)
    nth = F.col(by) if by else F.lit(0)
    both = samples.select(*keys, F.lit(None).cast("int").alias("i"), "t", "v", F.lit(0).alias("side"), nth.alias("nth")).unionByName(grid.select(*keys, "i", "t", F.lit(None).cast("double").alias("v"), F.lit(1).alias("side"), F.lit(0).alias("nth")))
    point = F.when(F.col("side") == 0, F.struct("t", "v"))
    back = Window.partitionBy(*keys).orderBy("t", "side", "nth").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("t", "side", "nth").rowsBetween(0, Window.unboundedFollowing)
    df = both.withColumn("p", F.last(point, True).over(back)).withColumn("n", F.first(point, True).over(ahead)).where("side = 1")
    gap = float("inf") if max_gap is None else max_gap
    far = lambda c: F.abs(F.col(f"{c}.t") - F.col("t")) > gap
    nearest = F.coalesce("p", "n")
    held = F.when(nearest.isNotNull() & (F.abs(nearest["t"] - F.col("t")) <= gap), nearest["v"]).otherwise(float("nan"))
    if method == "linear":
        between = F.col("p").isNotNull() & F.col("n").isNotNull() & (F.col("n.t") > F.col("p.t"))
        line = F.col("p.v") + (F.col("t") - F.col("p.t")) / (F.col("n.t") - F.col("p.t")) * (F.col("n.v") - F.col("p.v"))
        held = F.when(between & far("p") & far("n"), float("nan")).when(between, line).otherwise(held)
    return df.select(*keys, "i", held.alias("v"))
