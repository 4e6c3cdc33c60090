"""Kernel statistics of a key's stream against its baseline, in even blocks of rows.

What costs much (kernels, random features, running means of vectors) is computed
in blocks of a key's ordered rows, each from what the blocks before it leave
(functions/walks.py); only a number for each row then goes through the recursion
of bets, one state a key. A baseline is bounded: the first `base` rows of the key,
or given rows. Rows that lack a component take no part. A key without a baseline
of the asked size has no statistics.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.walks import Carry, numbered, row_walk, scanned
from .matrix import cell_seed, feature_map, features, gram

ONS_STEP = 2 / (2 - math.log(3))
FACTOR_FLOOR = 1e-12


def _whole(df: DataFrame, dims: list[str]) -> DataFrame:
    return df.where(" and ".join(f"`{d}` is not null and not isnan(`{d}`)" for d in dims))


def _stack(rows: dict[str, np.ndarray], dims: list[str]) -> np.ndarray:
    return np.column_stack([rows[d].astype(float) for d in dims])


def split_baseline(df: DataFrame, keys: list[str], by: list[str], dims: list[str], base: int) -> tuple[DataFrame, DataFrame]:
    """(first `base` rows of each key, the rows after them)."""
    r = numbered(_whole(df, dims), keys, by)
    return r.where(F.col("rank") <= base).drop("rank"), r.where(F.col("rank") > base).drop("rank")


def baseline_pool(rows: DataFrame, keys: list[str], by: list[str], dims: list[str], base: int) -> DataFrame:
    """(keys, told): the bounded baseline of each key that has all `base` rows, flattened."""
    items = F.array_sort(F.collect_list(F.struct(*by, F.array(*(F.col(d).cast("double") for d in dims)).alias("x"))))
    return rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.flatten(F.transform(items, lambda i: i["x"])).alias("told")).where(F.col("_n") == base).drop("_n")


def pool_features(pool: DataFrame, keys: list[str], p: int, n_features: int, width: float) -> DataFrame:
    """The mean features of a key's baseline instead of its rows."""

    def run(batches):
        for b in batches:
            told = [features(np.array(t, float).reshape(-1, p), _map(tuple(k), p, n_features, width)).mean(0).tolist() for k, t in zip(b[keys].itertuples(index=False, name=None), b["told"], strict=True)]
            yield b.assign(told=told)

    return pool.mapInPandas(run, pool.schema)


def _map(key: tuple, p: int, n_features: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    return feature_map(cell_seed("cell-" + "-".join(map(str, key))), n_features, p, width)


class _FeatureWitness(Carry):
    """phi(x) . (mean of the baseline - mean of the rows so far)."""

    added = "witness double"

    def __init__(self, dims: list[str], n_features: int, width: float):
        self.dims, self.shape = dims, (len(dims), n_features, width)

    def of(self, key: tuple, rows: dict[str, np.ndarray]) -> np.ndarray:
        return np.append(features(_stack(rows, self.dims), _map(key, *self.shape)).sum(0), len(rows[self.dims[0]]))

    def finish(self, key: tuple, before: np.ndarray | None, told: np.ndarray | None, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if told is None:
            return {"witness": np.full(len(rows[self.dims[0]]), np.nan)}
        phi = features(_stack(rows, self.dims), _map(key, *self.shape))
        held = before if before is not None else np.zeros(phi.shape[1] + 1)
        past = held[:-1] + np.vstack([np.zeros(phi.shape[1]), np.cumsum(phi, axis=0)[:-1]])
        n = held[-1] + np.arange(len(phi))
        return {"witness": (phi * (told - past / np.maximum(n, 1)[:, None])).sum(1)}


class _KernelWitness(Carry):
    """Mean kernel to the baseline less the kernel to the mean of the rows so far."""

    added = "witness double"

    def __init__(self, dims: list[str], width: float):
        self.dims, self.width = dims, width

    def of(self, key: tuple, rows: dict[str, np.ndarray]) -> np.ndarray:
        return np.append(_stack(rows, self.dims).sum(0), len(rows[self.dims[0]]))

    def finish(self, key: tuple, before: np.ndarray | None, told: np.ndarray | None, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x = _stack(rows, self.dims)
        if told is None:
            return {"witness": np.full(len(x), np.nan)}
        held = before if before is not None else np.zeros(x.shape[1] + 1)
        n = held[-1] + np.arange(len(x))
        mean = (held[:-1] + np.vstack([np.zeros(x.shape[1]), np.cumsum(x, axis=0)[:-1]])) / np.maximum(n, 1)[:, None]
        own = np.exp(-((x - mean) ** 2).sum(1) / (2 * self.width**2))
        return {"witness": gram(x, told.reshape(-1, x.shape[1]), self.width).mean(1) - np.where(n > 0, own, 0.0)}


class _Distance(Carry):
    """Distance of a row to the baseline's mean embedding; nothing is carried."""

    added = "distance double"

    def __init__(self, dims: list[str], width: float):
        self.dims, self.width = dims, width

    def of(self, key: tuple, rows: dict[str, np.ndarray]) -> np.ndarray:
        return np.zeros(0)

    def finish(self, key: tuple, before: np.ndarray | None, told: np.ndarray | None, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x = _stack(rows, self.dims)
        if told is None:
            return {"distance": np.full(len(x), np.nan)}
        base = told.reshape(-1, x.shape[1])
        return {"distance": np.sqrt(np.maximum(0, 1 - 2 * gram(x, base, self.width).mean(1) + gram(base, base, self.width).mean()))}


class _Sliding(Carry):
    """Unbiased discrepancy of the last `window` rows from the baseline; blocks leave their last window - 1 rows."""

    added = "u double"

    def __init__(self, dims: list[str], window: int, width: float):
        self.dims, self.window, self.width = dims, window, width

    def of(self, key: tuple, rows: dict[str, np.ndarray]) -> np.ndarray:
        return _stack(rows, self.dims)[max(0, len(rows[self.dims[0]]) - self.window + 1) :].ravel()

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.append(a, b)[-(self.window - 1) * len(self.dims) :] if self.window > 1 else b

    def finish(self, key: tuple, before: np.ndarray | None, told: np.ndarray | None, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x, w, p = _stack(rows, self.dims), self.window, len(self.dims)
        if told is None or w < 2 or len(told) < 2 * p:
            return {"u": np.full(len(x), np.nan)}
        base, n = told.reshape(-1, p), len(x)
        full = np.vstack([before.reshape(-1, p), x]) if before is not None else x
        cross = np.append(0, np.cumsum(gram(full, base, self.width).mean(1)))
        pairs, at = np.zeros(len(full)), np.arange(len(full))
        for lag in range(1, min(w, len(full))):  # pairs `lag` apart that lie inside the window that ends at each row
            k = np.append(0, np.cumsum(np.exp(-((full[lag:] - full[:-lag]) ** 2).sum(1) / (2 * self.width**2))))
            pairs += k[np.maximum(at - lag + 1, 0)] - k[np.maximum(at - w + 1, 0)]
        yy = gram(base, base, self.width)
        u = 2 * pairs / (w * (w - 1)) - 2 * (cross[at + 1] - cross[np.maximum(at + 1 - w, 0)]) / w + (yy.sum() - np.trace(yy)) / (len(base) * (len(base) - 1))
        return {"u": np.where(at >= w - 1, u, np.nan)[len(full) - n :]}


def sliding_mmd(live: DataFrame, pool: DataFrame, keys: list[str], by: list[str], dims: list[str], window: int, width: float = 1.0) -> DataFrame:
    """Adds u, the unbiased discrepancy of the window of rows that ends at each row; null before it is full."""
    out = scanned(_whole(live, dims), keys, by, dims, _Sliding(dims, window, width), pool)
    return out.withColumn("u", F.nanvl("u", F.lit(None).cast("double")))


def _held(df: DataFrame, why: str | None) -> Column:
    return F.col(why).isNotNull() if why else F.lit(False)


def _embedding_bet(s: tuple, d: float, warm: int) -> tuple:
    """State (wealth, bet, count, mean, second moment). The moments take in a tick before its bet, as published for this variant."""
    m, bet, n, mean, second = s
    n += 1
    mean, second = mean + (d - mean) / n, second + (d * d - second) / n
    if n >= warm:
        z = max(-1.0, min(1.0, (d - mean) / (3 * math.sqrt(max(second - mean * mean, 1e-12)))))
        raw = mean / second if second > 0 else 0.0
        if abs(raw) > 1 - 1e-6:
            inner = 1 + bet * mean
            raw = max(1e-6 - 1, min(1 - 1e-6, bet + mean / inner / max(second, 1e-6))) if abs(inner) >= 1e-9 else 0.0
        bet, m = raw, max(1e-12, m * max(0.0, 1 + raw * z))
    return m, bet, n, mean, second


def embedding_verdicts(live: DataFrame, pool: DataFrame, keys: list[str], by: list[str], dims: list[str], alpha: float, warm: int = 10, width: float = 1.0, why: str | None = None) -> DataFrame:
    """Verdicts of bets on the distance to the baseline's mean embedding: distance, wealth, verdict, reason, alpha_spent.

    Rows with a reason in the column `why` are suppressed and hold the state; the
    first `warm` - 1 ticks only warm the moments. The first fire spends alpha.
    """
    rows = scanned(_whole(live, dims), keys, by, dims, _Distance(dims, width), pool).where("not isnan(distance)")
    rows = rows.withColumn("_d", F.when(~_held(rows, why), F.col("distance")))

    def step(s: tuple, d: float | None) -> tuple:
        bets, fired = s
        if d is None:
            return s, (bets[0], bets[2], None, 0.0)
        bets = _embedding_bet(bets, d, warm)
        fire = bets[2] >= warm and bets[0] >= 1 / alpha
        return (bets, fired or fire), (bets[0], bets[2], fire, alpha if fire and not fired else 0.0)

    out = row_walk(rows, keys, by, ["_d"], lambda: ((1.0, 0.0, 0, 0.0, 0.0), False), step, "wealth double, n long, _fire boolean, alpha_spent double")
    reason = F.coalesce(F.col(why) if why else F.lit(None).cast("string"), F.when(F.col("n") < warm, "emmd_warming_moments").when(F.col("_fire"), "emmd_wealth_exceeded").otherwise("below_threshold"))
    verdict = F.when(_held(out, why) | (F.col("n") < warm), "suppressed").when(F.col("_fire"), "fire").otherwise("clean")
    return out.withColumns({"verdict": verdict, "reason": reason}).drop("_d", "_fire", "n")


def _newton_bet(log_s: float, lam: float, hess: float, f: float, clip: float) -> tuple[float, float, float]:
    d = 1 + lam * f
    log_s += math.log(max(d, FACTOR_FLOOR))
    if abs(d) >= 1e-12:
        z = -f / d
        hess += z * z
        lam = max(-clip, min(clip, lam - ONS_STEP * z / hess))
    return log_s, lam, hess


def _betting(rows: DataFrame, keys: list[str], by: list[str], alpha: float, clip: float, why: str | None, running_max: bool) -> DataFrame:
    rows = rows.where("not isnan(witness)")
    rows = rows.withColumn("_f", F.when(~_held(rows, why), F.col("witness")))
    limit = -math.log(alpha)

    def step(s: tuple, f: float | None) -> tuple:
        log_s, lam, hess, top, n, fired = s
        if f is None:
            return s, (log_s, None, fired, 0.0)
        if running_max and n > 10 and top > 0:
            f /= top
        log_s, lam, hess = _newton_bet(log_s, lam, hess, f, clip)
        fire = log_s >= limit
        return (log_s, lam, hess, max(top, abs(f)), n + 1, fired or fire), (log_s, fire, fired or fire, alpha if fire and not fired else 0.0)

    out = row_walk(rows, keys, by, ["_f"], lambda: (0.0, 0.0, 1.0, 0.0, 0, False), step, "log_s double, _fire boolean, alarmed boolean, alpha_spent double")
    reason = F.coalesce(F.col(why) if why else F.lit(None).cast("string"), F.when(F.col("_fire"), "family_c_betting_wealth_exceeded").otherwise("below_threshold"))
    return out.withColumns({"verdict": F.when(_held(out, why), "suppressed").when(F.col("_fire"), "fire").otherwise("clean"), "reason": reason}).drop("_f", "_fire")


def feature_witness_verdicts(live: DataFrame, pool: DataFrame, keys: list[str], by: list[str], dims: list[str], alpha: float, n_features: int = 256, width: float = 1.0, clip: float = 0.5, why: str | None = None) -> DataFrame:
    """Betting e-process on the witness in random-feature space: witness, log_s, verdict, reason, sticky alarmed, alpha_spent at the first fire."""
    told = pool_features(pool, keys, len(dims), n_features, width)
    live = _whole(live, dims)
    if why:  # rows behind a gate leave no trace in the running mean
        return _around(live, why, lambda d: scanned(d, keys, by, dims, _FeatureWitness(dims, n_features, width), told), keys, by, alpha, clip, False)
    return _betting(scanned(live, keys, by, dims, _FeatureWitness(dims, n_features, width), told), keys, by, alpha, clip, None, False)


def kernel_witness_verdicts(live: DataFrame, pool: DataFrame, keys: list[str], by: list[str], dims: list[str], alpha: float, width: float = 1.0, clip: float = 0.5, why: str | None = None) -> DataFrame:
    """The same on the kernel witness, divided by the largest so far from the twelfth tick on."""
    live = _whole(live, dims)
    if why:
        return _around(live, why, lambda d: scanned(d, keys, by, dims, _KernelWitness(dims, width), pool), keys, by, alpha, clip, True)
    return _betting(scanned(live, keys, by, dims, _KernelWitness(dims, width), pool), keys, by, alpha, clip, None, True)


def _around(live: DataFrame, why: str, witness, keys: list[str], by: list[str], alpha: float, clip: float, running_max: bool) -> DataFrame:
    """Verdicts with gated rows: they get a verdict, but no witness."""
    seen = witness(live.where(F.col(why).isNull()))
    gated = live.where(F.col(why).isNotNull()).join(seen.where("not isnan(witness)").select(*keys).distinct(), keys, "left_semi").withColumn("witness", F.lit(0.0))
    return _betting(seen.unionByName(gated), keys, by, alpha, clip, why, running_max).withColumn("witness", F.when(F.col(why).isNull(), F.col("witness")))
