"""Replication of a statistic across draws of a table, and its nearest-rank limits.

A row's weight in a draw is a Poisson count of mean 1 that a counter-based
generator gives from the row's own id, the draw and the seed: it needs no state, no
order, and is the same however the table is partitioned. A digest for each row and
draw is most of the work, and a small file would be one task: rows are dealt
evenly to tasks of about `TASK` digests. Draws are summed where the rows are, so a
sum for each key and draw is all that moves then.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counts beyond this have probability under 1e-9.
MOST = 12
#: Digests of a task.
TASK = 1 << 21


def digest(row: Column, draw: Column, seed: int) -> Column:
    """MD5 of (seed, row, draw) as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), draw.cast("string")).cast("binary"))


def uniform(row: Column, draw: Column, seed: int) -> Column:
    """A number in [0, 1) for each (row, draw): the first 32 bits of an MD5 digest."""
    return F.conv(F.substring(digest(row, draw, seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def cumulative() -> list[float]:
    """P(count <= k) of the Poisson law of mean 1, k from 0 to MOST - 1."""
    out, p, total = [], math.exp(-1.0), 0.0
    for k in range(MOST):
        total += p
        out.append(total)
        p /= k + 1
    return out


def poisson(u: Column) -> Column:
    """The count at a uniform number."""
    out = None
    for k, p in enumerate(cumulative()):
        out = F.when(u < p, k) if out is None else out.when(u < p, k)
    return out.otherwise(MOST)


def poisson_of(hexadecimal: Column) -> Column:
    """poisson(uniform(...)) from the digest: digits are compared as text, and the first eight decide."""
    out = F.lit(MOST)
    for k, p in reversed(list(enumerate(cumulative()))):
        least = math.ceil(p * 4294967296.0)  # u < p is the same as 32 bits < least
        out = F.when(hexadecimal < f"{least:08x}", k).otherwise(out) if least < 1 << 32 else F.lit(k)
    return out


def across_draws(df: DataFrame, keys: list[str], row: str, value: str, draws: int, seed: int = 0) -> DataFrame:
    """(keys, draw, n, mean) of each draw; draw 0 is the table itself, every row once.

    Rows without a value, or without an id to draw by, take no part. A key whose
    rows all have weight 0 in a draw has no row for it.
    """
    if draws < 1:
        raise ValueError(f"{draws} draws")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(row).isNotNull()).select(*keys, F.col(row).alias("_row"), F.col(value).cast("double").alias("_x"))
    tasks = -(-rows.count() * draws // TASK)
    each = rows.repartition(max(1, tasks)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    each = each.withColumn("_h", F.when(F.col("draw") > 0, digest(F.col("_row"), F.col("draw"), seed)))  # a column of its own, computed once a row
    each = each.withColumn("_w", F.when(F.col("draw") == 0, 1).otherwise(poisson_of(F.col("_h"))))
    g = each.groupBy(*keys, "draw").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_x")).alias("_s")).where("n > 0")
    return g.select(*keys, "draw", "n", (F.col("_s") / F.col("n")).alias("mean"))


def nearest_rank(draws: DataFrame, keys: list[str], shares: dict[str, float], value: str = "mean") -> DataFrame:
    """One row for each key: n_draws, the plain value (draw 0), and by name the value of rank ceil(share * draws), 1 at least."""
    real = draws.where("draw > 0")
    w = Window.partitionBy(*keys)
    ranked = real.withColumns({"_i": F.row_number().over(w.orderBy(value, "draw")), "_n": F.count("*").over(w)})  # as many rows as draws
    pick = [F.max(F.when(F.col("_i") == F.greatest(F.lit(1), F.ceil(F.round(F.lit(p) * F.col("_n"), 9))), F.col(value))).alias(name) for name, p in shares.items()]
    limits = ranked.groupBy(*keys).agg(F.max("_n").alias("n_draws"), *pick)
    plain = draws.where("draw = 0").select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("plain"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return limits.join(plain, same).drop(*(f"_{k}" for k in keys))
