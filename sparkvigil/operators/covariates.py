"""Residuals of series after several exogenous covariates, with autoregressive errors.

One aggregate gives the cross products of a series' covariates and values; its
normal equations are solved for all series of a batch at once. Autocovariances of
the regression residual come from lags that ordered blocks pass on to each other
(functions/walks.py), so a series of any length is many tasks, and the order of the
autoregression is the one of least AIC. The fit also tells whether the one-step
residual is white. Each of these steps is read several times by those after it, so
each is computed once and cut.

Rows without a value or a covariate take no part. Series of fewer than 16 rows
have no fit; where the covariates are collinear, the fit has a problem and no
coefficients. Covariates whose names speak of the system's own responses are an
error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.walks import lagged
from .cut import cut
from .evaluators import RESPONSES

LEAST = 16
TINY = 1e-18


def _whole(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in columns))


def _checked(covariates: list[str]) -> None:
    if own := [c for c in covariates if re.search("|".join(RESPONSES), c, re.I)]:
        raise ValueError(f"responses of the system are no exogenous covariates: {', '.join(own)}")


def solved(gram: np.ndarray, cross: np.ndarray, n: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients of each series (NaN where the equations are not positive definite), the diagonal raised by `ridge` of each regressor's mean square."""
    k = gram.shape[1]
    diagonal = np.einsum("sii->si", gram)
    a = gram + (ridge * np.maximum(diagonal / n[:, None], 1e-12) * n[:, None])[:, :, None] * np.eye(k)
    out = np.full(cross.shape, np.nan)
    for s in range(len(a)):
        try:
            np.linalg.cholesky(a[s])
        except np.linalg.LinAlgError:
            continue
        out[s] = np.linalg.solve(a[s], cross[s])
    return out


def autoregression(gamma: np.ndarray, n: int) -> tuple[list[float], float]:
    """(coefficients, innovation variance) of the order of least AIC; orders past a partial autocorrelation beyond 1 are not tried."""
    var, phi = float(gamma[0]), np.zeros(0)
    best = (n * np.log(max(var, TINY)), [], max(var, TINY))
    for m in range(1, len(gamma)):
        if var <= 0:
            break
        part = (gamma[m] - phi @ gamma[m - 1 : 0 : -1]) / var if m > 1 else gamma[1] / var
        if abs(part) > 1:
            break
        phi = np.append(phi - part * phi[::-1], part)
        var *= 1 - part * part
        aic = n * np.log(max(var, TINY)) + 2 * m
        if aic < best[0]:
            best = (aic, phi.tolist(), max(var, TINY))
    return best[1], best[2]


def _regression(df: DataFrame, keys: list[str], covariates: list[str], value: str, ridge: float) -> DataFrame:
    """(keys, n, coef): intercept and slopes of each series with enough rows."""
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in covariates)]
    k = len(x)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("_a"), F.array(*(F.sum(c * F.col(value)) for c in x)).alias("_b")).where(F.col("n") >= LEAST)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column("_a").flatten().to_numpy().reshape(b.num_rows, -1)
            gram = np.zeros((b.num_rows, k, k))
            for m, (i, j) in enumerate(pairs):
                gram[:, i, j] = gram[:, j, i] = flat[:, m]
            coef = solved(gram, b.column("_b").flatten().to_numpy().reshape(b.num_rows, k), b.column("n").to_numpy().astype(float), ridge)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*keys, "n")), pa.array([None if np.isnan(c).any() else c.tolist() for c in coef], pa.list_(pa.float64()))], names=[*keys, "n", "coef"])

    kinds = dict(df.dtypes)
    return sums.mapInArrow(solve, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", n long, coef array<double>")


def _joined(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return df.alias("a").join(other.alias("b"), same).select("a.*", *(F.col(f"b.{c}") for c in other.columns if c not in keys))


def _residual(covariates: list[str], value: str, coef: str = "coef"):
    fitted = F.col(coef)[0]
    for i, c in enumerate(covariates):
        fitted = fitted + F.col(coef)[i + 1] * F.col(c)
    return F.col(value) - fitted


def _innovation(phi, u, lags: list):
    """u less its prediction from the lags, null before there are as many as coefficients."""
    out = u
    for i, lag in enumerate(lags):
        out = out - F.when(F.size(phi) > i, F.get(phi, F.lit(i)) * lag).otherwise(0.0)
    return out


def fitted(df: DataFrame, keys: list[str], covariates: list[str], value: str = "value", by: str = "tick", max_order: int = 5, ridge: float = 1e-8, rho_max: float | None = None) -> DataFrame:
    """One row for each series: n, coef (intercept, slopes), phi, ar_order, sigma2, residual_lag1_rho, rho_max, white, one_step_rmse, problem."""
    _checked(covariates)
    rows = cut(_whole(df, [*covariates, value]).select(*keys, by, value, *covariates))
    base = cut(_regression(rows, keys, covariates, value, ridge))
    u = cut(_joined(rows, base.where("coef is not null"), keys).select(*keys, by, _residual(covariates, value).alias("_u")))
    lags = cut(lagged(u, keys, [by], "_u", max_order + 1))
    mean = lags.groupBy(*keys).agg(F.avg("_u").alias("_m"))
    both = _joined(lags, mean, keys)
    d = [F.col(c) - F.col("_m") for c in ("_u", *(f"_l{i}" for i in range(1, max_order + 1)))]
    gamma = both.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.coalesce(F.sum(d[0] * x), F.lit(0.0)) / F.count("*") for x in d)).alias("gamma"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [autoregression(np.array(g)[: 1 + min(max_order, n // 4)], n) for g, n in zip(b.column("gamma").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array([p for p, _ in got], pa.list_(pa.float64())), pa.array([s for _, s in got], pa.float64())], names=[*keys, "phi", "sigma2"])

    kinds = dict(df.dtypes)
    chosen = cut(gamma.mapInArrow(choose, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", phi array<double>, sigma2 double"))
    e = _joined(lags, chosen, keys)
    lag = [F.col(f"_l{i}") for i in range(1, max_order + 2)]
    e = e.withColumns({"_e": _innovation(F.col("phi"), F.col("_u"), lag[:-1]), "_p": _innovation(F.col("phi"), lag[0], lag[1:])})
    m = F.sum("_e") / F.count("_e")
    s = e.where("_e is not null").groupBy(*keys).agg(
        F.count("*").alias("_n"), F.sum(F.col("_e") * F.col("_e")).alias("_ss"), m.alias("_mean"), F.sum(F.col("_e") * F.col("_p")).alias("_sp"), F.sum(F.when(F.col("_p").isNotNull(), F.col("_e") + F.col("_p"))).alias("_both"), F.count("_p").alias("_np")
    )
    spread = F.col("_ss") - F.col("_n") * F.col("_mean") * F.col("_mean")
    rho = F.when((F.col("_n") >= 3) & (spread > 0), (F.col("_sp") - F.col("_mean") * F.col("_both") + F.col("_np") * F.col("_mean") * F.col("_mean")) / spread).otherwise(0.0)
    limit = F.lit(rho_max) if rho_max is not None else F.greatest(F.lit(0.1), 2 / F.sqrt("_n"))
    s = s.select(*keys, rho.alias("residual_lag1_rho"), limit.cast("double").alias("rho_max"), F.sqrt(F.col("_ss") / F.col("_n")).alias("one_step_rmse")).withColumn("white", F.abs("residual_lag1_rho") < F.col("rho_max"))
    good = _joined(_joined(base.where("coef is not null"), chosen, keys), s, keys).withColumns({"ar_order": F.size("phi"), "problem": F.lit(None).cast("string")})
    return good.unionByName(base.where("coef is null").withColumn("problem", F.lit("covariates are collinear")), allowMissingColumns=True)


def one_step(df: DataFrame, fit: DataFrame, keys: list[str], covariates: list[str], value: str = "value", by: str = "tick", max_order: int = 5) -> DataFrame:
    """Adds residual and standardized, a frozen fit's one-step innovations, to rows of series with a fit; null for the first ar_order rows of a series."""
    _checked(covariates)
    rows = cut(_joined(_whole(df, [*covariates, value]), fit.where("problem is null").select(*keys, "coef", "phi", "sigma2"), keys).withColumn("_u", _residual(covariates, value)))
    lags = lagged(rows, keys, [by], "_u", max_order)
    lag = [F.col(f"_l{i}") for i in range(1, max_order + 1)]
    out = lags.withColumn("residual", _innovation(F.col("phi"), F.col("_u"), lag))
    return out.withColumn("standardized", F.col("residual") / F.sqrt("sigma2")).drop("_u", "coef", "phi", "sigma2", *(f"_l{i}" for i in range(1, max_order + 1)))
