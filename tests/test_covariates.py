"""Fits with several covariates against plain loops, in one block and in many."""

import numpy as np
import pytest

from sparkvigil.functions import walks
from sparkvigil.operators import covariates as cv


def plain(x, y, max_order, ridge=1e-8):
    n, k = len(y), x.shape[1] + 1
    a = np.column_stack([np.ones(n), x])
    g = a.T @ a
    coef = np.linalg.solve(g + np.diag(ridge * np.maximum(np.diag(g) / n, 1e-12) * n), a.T @ y)
    u = y - a @ coef
    d = u - u.mean()
    gamma = [float(d[i:] @ d[: n - i]) / n for i in range(min(max_order, n // 4) + 1)]
    best = (n * np.log(gamma[0]), [], gamma[0])
    for p in range(1, len(gamma)):
        r = np.array([[gamma[abs(i - j)] for j in range(p)] for i in range(p)])
        phi = np.linalg.solve(r, gamma[1 : p + 1])
        if abs(phi[-1]) > 1:
            break
        var = gamma[0] - phi @ gamma[1 : p + 1]
        if (aic := n * np.log(var) + 2 * p) < best[0]:
            best = (aic, phi.tolist(), var)
    p = len(best[1])
    e = np.array([u[t] - sum(f * u[t - 1 - i] for i, f in enumerate(best[1])) for t in range(p, n)])
    z = e - e.mean()
    rho = (z[1:] @ z[:-1]) / (z @ z)
    return coef, best[1], best[2], rho, np.sqrt((e * e).mean()), e, abs(rho) < max(0.1, 2 / np.sqrt(len(e)))


@pytest.mark.parametrize("rows", [1 << 18, 19])
def test_fits(spark, monkeypatch, rows):
    monkeypatch.setattr(walks, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(2)
    data, want = [], {}
    for key, n, phi in (("hot", 300, [0.5, 0.3]), ("white", 40, []), (None, 25, [0.7]), ("short", 10, []), ("collinear", 30, [])):
        x = rng.normal(0, 1, (n, 3))
        if key == "collinear":
            x[:, 2] = 0
            x[:, 1] = x[:, 0]
        e = rng.normal(0, 1, n)
        for t in range(n):
            e[t] += sum(f * e[t - 1 - i] for i, f in enumerate(phi) if t > i)
        y = 3 + x @ np.array([1.0, -2.0, 0.5]) + e
        data += [(key, t, float(y[t]), *map(float, x[t])) for t in range(n)]
        if n >= 16 and key != "collinear":
            want[key] = plain(x, y, 4)
    data += [("hot", 1000, None, 1.0, 1.0, 1.0), ("hot", 1001, 1.0, float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame(data, "key string, tick long, value double, calendar double, planned double, batch double").repartition(4)
    names = ["calendar", "planned", "batch"]
    fit = cv.fitted(df, ["key"], names, max_order=4, ridge=0.0 if rows < 100 else 1e-8).persist()
    got = {r.key: r for r in fit.collect()}
    assert set(got) == {*want, "collinear"} or rows > 100 and set(got) >= set(want)
    if rows < 100:
        assert got["collinear"].problem and got["collinear"].coef is None
    for key, (coef, phi, var, rho, rmse, _, white) in want.items():
        r = got[key]
        assert r.coef == pytest.approx(coef.tolist(), abs=1e-6) and r.phi == pytest.approx(phi, abs=1e-6) and r.ar_order == len(phi) and r.sigma2 == pytest.approx(var)
        assert r.residual_lag1_rho == pytest.approx(rho, abs=1e-6) and r.one_step_rmse == pytest.approx(rmse) and r.white == white
    one = {}
    for r in cv.one_step(df, fit, ["key"], names, max_order=4).orderBy("tick").collect():
        one.setdefault(r.key, []).append(r.residual)
    for key, (_, phi, *_, e, _) in want.items():
        assert one[key][: len(phi)] == [None] * len(phi) and one[key][len(phi) :] == pytest.approx(e.tolist(), abs=1e-5)
    assert len(want["hot"][1]) >= 1


def test_responses_are_refused(spark):
    with pytest.raises(ValueError, match="gpu_temp"):
        cv.fitted(spark.createDataFrame([], "key string, tick long, value double, gpu_temp double"), ["key"], ["gpu_temp"])
