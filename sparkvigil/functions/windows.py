"""Window building blocks: ordered frames, reflected walks, predictable moments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

WEALTH_FLOOR, TINY_FLOOR = math.log(1e-12), math.log(1e-300)


def ordered(keys: list[str], by: str | list[str] = "tick") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([by] if isinstance(by, str) else by))


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(w: WindowSpec) -> WindowSpec:
    """All rows before this one: a predictable plug-in reads nothing newer."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def reflected_walk(df: DataFrame, step: str, keys: list[str], floor: float, out: str, by: str | list[str] = "tick") -> DataFrame:
    """L(t) = max(floor, L(t-1) + step), L(0) = 0 >= floor, as two window aggregates.

    With C the running sum this is C + max(0, max over s <= t of floor - C(s)).
    A NaN or null step holds the walk.
    """
    w = so_far(ordered(keys, by))
    clean = F.when(F.isnan(step) | F.col(step).isNull(), 0.0).otherwise(F.col(step))
    df = df.withColumn("_c", F.sum(clean).over(w))
    return df.withColumn(out, F.col("_c") + F.greatest(F.lit(0.0), F.max(floor - F.col("_c")).over(w))).drop("_c")


def lagged(col: Column | str, n: int, w: WindowSpec, missing: float = 0.0) -> Column:
    return F.coalesce(F.lag(col, n).over(w), F.lit(missing))


def sticky(fire: Column, w: WindowSpec) -> Column:
    """Whether it has fired by now."""
    return F.max(fire.cast("int")).over(so_far(w)) == 1
