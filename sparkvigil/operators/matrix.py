"""Matrix and iterative estimators, as Arrow-backed grouped maps with numpy kernels.

The group of each is one series, one cell or one fleet's window (shards x
ticks): sizes that a user sets, and a bound of these operators. Spark spreads
the groups; inside one, arrays replace loops over values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

PHI_GRID = np.arange(-0.98, 0.9991, 0.02)
TUKEY, TINY = 4.685, 1e-12


# random numbers that must agree bit for bit


def mulberry32(seed: int, n: int) -> np.ndarray:
    """First n numbers of the 32-bit generator of that name, in [0, 1)."""
    with np.errstate(over="ignore"):
        s = np.uint32(seed) + np.arange(1, n + 1, dtype=np.uint32) * np.uint32(0x6D2B79F5)
        t = (s ^ (s >> np.uint32(15))) * (s | np.uint32(1))
        t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
        return (t ^ (t >> np.uint32(14))) / 4294967296.0


def normals(u: np.ndarray) -> np.ndarray:
    """Box and Muller's pairs from consecutive uniforms."""
    r, a = np.sqrt(-2 * np.log(np.maximum(u[0::2], 1e-300))), 2 * np.pi * u[1::2]
    return np.stack([r * np.cos(a), r * np.sin(a)], axis=1).ravel()


def cell_seed(text: str) -> int:
    """31-hash of a cell's name, as an unsigned 32-bit number."""
    h = 0
    for c in text.encode("utf-16-le")[::2]:
        h = (h * 31 + c) & 0xFFFFFFFF
    return h


# universal inference


#: Series, and ticks of series, that are fitted at once.
TOGETHER, TICKS = 512, 1 << 14


def _sums(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For each series (row): n, sums of x, of the value before, of both squares and of the product over lo <= i < hi."""
    a, p = x[:, lo:hi], x[:, lo - 1 : hi - 1]
    return np.array([np.full(len(x), a.shape[1]), a.sum(1), p.sum(1), (a * a).sum(1), (p * p).sum(1), (a * p).sum(1)])[:, :, None]


def _profile(parts: list[np.ndarray], phi: np.ndarray, common: bool):
    """Log-likelihood of AR(1) segments at each phi with the means and the variance at their best; also means and variance."""
    pooled = sum(parts)

    def mean(s):
        d = s[0] * (1 - phi)
        return np.where(np.abs(d) > 0, (s[1] - phi * s[2]) / np.where(d == 0, 1, d), s[1] / s[0])

    means = [mean(pooled)] * len(parts) if common else [mean(s) for s in parts]
    rss = 0.0
    for s, m in zip(parts, means, strict=True):
        c = m * (1 - phi)
        rss = rss + s[3] - 2 * phi * s[5] + phi * phi * s[4] - 2 * c * (s[1] - phi * s[2]) + s[0] * c * c
    n = pooled[0]
    var = np.maximum(np.maximum(rss, 0) / n, TINY)
    return -0.5 * n * np.log(2 * np.pi * var) - np.maximum(rss, 0) / (2 * var), means, var


def _fit(parts: list[np.ndarray], common: bool):
    """Of each series phi, means, variance and log-likelihood at their best, as columns."""
    ll, _, _ = _profile(parts, PHI_GRID[None, :], common)
    lo = PHI_GRID[ll.argmax(1)] - 0.02
    hi = lo + 0.04
    for _ in range(40):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        pair, _, _ = _profile(parts, np.stack([a, b], axis=1), common)
        left = pair[:, 0] > pair[:, 1]
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    phi = np.concatenate([np.broadcast_to(PHI_GRID, ll.shape), ((lo + hi) / 2)[:, None]], axis=1)
    ll, means, var = _profile(parts, phi, common)
    k = ll.argmax(1)[:, None]
    at = lambda v: np.take_along_axis(v, k, axis=1)
    return at(phi), [at(m) for m in means], at(var), at(ll)


def universal_inference(x: np.ndarray, cal: tuple[int, int], test: tuple[int, int]) -> float:
    """Split likelihood ratio of a mean shift: alternative fitted on the first halves, null at its best on the second."""
    return float(universal_inferences(np.asarray(x, float)[None, :], cal, test)[0])


def universal_inferences(x: np.ndarray, cal: tuple[int, int], test: tuple[int, int]) -> np.ndarray:
    """The same for each row of x."""
    (a, n), (b, m) = cal, test
    h, g = n // 2, m // 2
    phi, means, var, _ = _fit([_sums(x, a + 1, a + h), _sums(x, b, b + g)], common=False)
    ev = [_sums(x, a + h, a + n), _sums(x, b + g, b + m)]
    null = _fit(ev, common=True)[3]
    alt = 0.0
    for s, mu in zip(ev, means, strict=True):
        c = mu * (1 - phi)
        rss = s[3] - 2 * phi * s[5] + phi * phi * s[4] - 2 * c * (s[1] - phi * s[2]) + s[0] * c * c
        alt = alt - 0.5 * s[0] * np.log(2 * np.pi * var) - rss / (2 * var)
    return np.exp(alt - null)[:, 0]


def sequential_ui(x: np.ndarray, change: int = 1, clip: float = 0.95) -> np.ndarray:
    """Log e-process of a mean shift at `change`: predictable fits from prefix sums of each regime, null profiled over phi at every tick."""
    num, *sums = _predictable(x, change, clip)
    return num - _null_at_best(*sums)


def _predictable(x: np.ndarray, change: int, clip: float = 0.95) -> tuple[np.ndarray, ...]:
    """The logarithm of the numerator at each tick, and what the null needs: ticks, sums of x and of the value before, of their squares and of their product."""
    t = len(x)
    s = np.arange(1, t)
    z = lambda v: np.concatenate([[0.0], np.cumsum(v)])
    p1, p2 = z(x), z(x * x)
    cross = np.concatenate([[0.0, 0.0], np.cumsum(x[1:] * x[:-1])])  # cross[k]: products with s < k
    c = min(change, t)
    pre_n, post_n = np.minimum(s, c), np.maximum(s - c, 0)
    mu0 = p1[np.minimum(s, c)] / np.maximum(pre_n, 1)
    mu1 = np.where(post_n > 0, (p1[s] - p1[np.minimum(c, s)]) / np.maximum(post_n, 1), mu0)

    def moments(lo, hi, my, mp):
        """Sums over lo <= i < hi of products and squares of x[i] - my and x[i - 1] - mp."""
        n = np.maximum(hi - lo, 0)
        hi = lo + n
        sx, sp = p1[hi] - p1[lo], p1[np.maximum(hi - 1, 0)] - p1[np.maximum(lo - 1, 0)]
        xx, pp, xp = p2[hi] - p2[lo], p2[np.maximum(hi - 1, 0)] - p2[np.maximum(lo - 1, 0)], cross[hi] - cross[lo]
        return xp - my * sp - mp * sx + n * my * mp, xx - 2 * my * sx + n * my * my, pp - 2 * mp * sp + n * mp * mp

    one = np.ones_like(s)
    parts = [moments(one, np.minimum(s, c), mu0, mu0), moments(np.full_like(s, max(c, 1)), np.minimum(s, c + 1) if c >= 1 else one * 0, mu1, mu0), moments(np.full_like(s, max(c + 1, 1)), s, mu1, mu1)]
    xy, yy, pp = (sum(v) for v in zip(*parts, strict=True))
    phi = np.clip(xy / (1 + pp), -clip, clip)
    var = np.maximum((1 + yy - 2 * phi * xy + phi * phi * pp) / np.maximum(s, 1), 1e-9)
    mx, mp = np.where(s >= c, mu1, mu0), np.where(s - 1 >= c, mu1, mu0)
    e = x[1:] - mx - phi * (x[:-1] - mp)
    num = np.cumsum(-0.5 * np.log(2 * np.pi * var) - e * e / (2 * var))
    a1, a0 = np.cumsum(x[1:]), np.cumsum(x[:-1])
    b1, b0, b = np.cumsum(x[1:] ** 2), np.cumsum(x[:-1] ** 2), np.cumsum(x[1:] * x[:-1])
    return num, s, a1, a0, b1, b0, b


def _null_at_best(s, a1, a0, b1, b0, b) -> np.ndarray:
    """The null's log-likelihood at its best phi; ticks stand alone, so those of many series may come together."""

    def null(f):
        d, d2 = a1 - f * a0, b1 - 2 * f * b + f * f * b0
        v = np.maximum(d2 - d * d / s, TINY * s) / s
        return np.where(s < 2, 0.0, -0.5 * s * np.log(2 * np.pi * v) - s / 2)

    grid = -0.999 + 1.998 * np.arange(81) / 80
    best, at = np.full(len(s), -np.inf), np.zeros(len(s))
    for f in grid:
        ll = null(f)
        at, best = np.where(ll > best, f, at), np.maximum(best, ll)
    lo, hi = np.maximum(-0.999, at - 0.025), np.minimum(0.999, at + 0.025)
    for _ in range(60):
        u, v = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = null(u) >= null(v)
        lo, hi = np.where(left, lo, u), np.where(left, v, hi)
    return np.maximum(best, null((lo + hi) / 2))


# robust fits over a fleet's matrix


def location(x: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Tukey location of each column: fixed median scale, all columns at once."""
    m = np.median(x, axis=0)
    s = 1.4826 * np.median(np.abs(x - m), axis=0)
    live = s > 0
    for _ in range(rounds):
        w = np.clip(1 - ((x - m) / (TUKEY * np.where(live, s, 1))) ** 2, 0, None) ** 2
        total = w.sum(0)
        new = np.where(live & (total > 0), (w * x).sum(0) / np.where(total > 0, total, 1), m)
        moved, m = np.abs(new - m), new
        if not (moved > 1e-9 * np.maximum(s, TINY)).any():
            break
    return m


def slopes(f: np.ndarray, y: np.ndarray, rounds: int = 40, tol: float = 1e-9) -> np.ndarray:
    """Robust slope through the origin of each row of y on f: median ratio, then reweighting with a scale of its own each round."""
    on = np.abs(f) > 1e-9
    b = np.median(y[:, on] / f[on], axis=1) if on.any() else np.zeros(len(y))
    live = np.ones(len(y), bool)
    for _ in range(rounds):
        r = y - b[:, None] * f
        s = np.maximum(1.4826 * np.median(np.abs(r), axis=1), 1e-9)[:, None]
        w = np.clip(1 - (r / (TUKEY * s)) ** 2, 0, None) ** 2
        num, den = (w * f * y).sum(1), (w * f * f).sum(1)
        live &= den >= 1e-9
        new = np.where(live, num / np.where(den >= 1e-9, den, 1), b)
        moved, b = np.abs(new - b), new
        live &= moved >= tol
        if not live.any():
            break
    return b


def centred(x: np.ndarray, cal: int) -> np.ndarray:
    return x - np.median(x[:, :cal], axis=1, keepdims=True)


def one_factor(d: np.ndarray, passes: int = 6) -> tuple[np.ndarray, float]:
    """The matrix without its strongest robust factor, and that factor's energy."""
    load = np.ones(len(d))
    for i in range(passes):
        f = location(d) if i == 0 else slopes(load, d.T)
        load = slopes(f, d)
    part = np.outer(load, f)
    return d - part, float((part * part).sum())


def multi_factor(x: np.ndarray, cal: int, factors: int = 1) -> tuple[np.ndarray, list[float]]:
    """Residuals after so many robust factors, and each one's share of the energy."""
    d = centred(x, cal)
    total, shares = max(float((d * d).sum()), TINY), []
    for _ in range(factors):
        d, e = one_factor(d)
        shares.append(e / total)
    return d, shares


def crossed_domains(x: np.ndarray, cal: int, domains: np.ndarray, sweeps: int = 4, small: int = 5) -> np.ndarray:
    """Residuals after backfitting the factor of each domain of each partition (columns of `domains`; negative: none).

    Loadings come from the reference window alone, so a fault there is not
    absorbed. Domains of 2 to `small` members are done once at the end, each
    member by the factor of the others, all from the same state.
    """
    r = centred(x, cal)

    def usable(f):
        ref = (f[:cal] ** 2).sum()
        return ref > TINY and ref >= 1e-6 * (f**2).sum()

    groups = [[np.flatnonzero(col == g) for g in dict.fromkeys(col[col >= 0].tolist())] for col in domains.T]
    for _ in range(sweeps):
        for part in groups:
            for g in part:
                if len(g) > small and usable(f := location(r[g])):
                    r[g] -= np.outer(slopes(f[:cal], r[g][:, :cal]), f)
    for part in groups:
        for g in part:
            if 2 <= len(g) <= small:
                took = []
                for i in g:
                    f = location(r[g[g != i]])
                    if usable(f):
                        took.append((i, slopes(f[:cal], r[i : i + 1, :cal])[0] * f))
                for i, v in took:
                    r[i] -= v
    return r


def instrumented(x: np.ndarray, cal: int, factors: np.ndarray, members: list[list[int]], ridge: float = 0.0) -> np.ndarray:
    """Residuals after each shard's own factors, loaded by ridge regression on the calibration window; a singular fit removes the level only."""
    f, r = centred(factors, cal), centred(x, cal)
    for i, idx in enumerate(members):
        if idx:
            a = f[idx]
            gram = a[:, :cal] @ a[:, :cal].T + ridge * np.eye(len(idx))
            if np.linalg.matrix_rank(gram) == len(idx):
                r[i] -= np.linalg.solve(gram, a[:, :cal] @ r[i, :cal]) @ a
    return r


# covariance


def ledoit_wolf(z: np.ndarray) -> tuple[np.ndarray, float]:
    n, p = z.shape
    s = z.T @ z / n
    target = np.trace(s) / p * np.eye(p)
    d2 = ((s - target) ** 2).sum()
    b2 = (((z**2).sum(1) ** 2).sum() - n * (s**2).sum()) / (n * n)
    lam = min(b2, d2) / d2 if d2 > 0 else 0.0
    return lam * target + (1 - lam) * s, float(lam)


def _wilson_hilferty(z: float, k: float) -> float:
    return k * (1 - 2 / (9 * k) + z * np.sqrt(2 / (9 * k))) ** 3


def consistency(alpha: float, p: int) -> float:
    """Factor that makes the covariance of the alpha central share right for a normal law."""
    from statistics import NormalDist

    q = _wilson_hilferty(NormalDist().inv_cdf(alpha), p)
    k = p + 2
    cdf = NormalDist().cdf(((q / k) ** (1 / 3) - (1 - 2 / (9 * k))) / np.sqrt(2 / (9 * k)))
    return alpha / cdf if cdf > 0 else 1.0


# kernels and random features


def feature_map(seed: int, features: int, dims: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Random Fourier frequencies and phases of a Gaussian kernel."""
    count = features * dims + features * dims % 2
    u = mulberry32(seed, count + features)
    return normals(u[:count])[: features * dims].reshape(features, dims) / width, u[count:] * 2 * np.pi


def features(x: np.ndarray, fm: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.sqrt(2 / len(fm[1])) * np.cos(x @ fm[0].T + fm[1])


def feature_mean(cov: np.ndarray, fm: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Mean of the features under a normal law around zero: E cos(z + b) = exp(-v / 2) cos b for z of variance v."""
    return np.sqrt(2 / len(fm[1])) * np.exp(-0.5 * np.einsum("ij,jk,ik->i", fm[0], cov, fm[0])) * np.cos(fm[1])


def gram(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-np.maximum(d, 0) / (2 * width * width))


def mmd_u(window: np.ndarray, base: np.ndarray, width: float) -> float:
    """Unbiased squared maximum mean discrepancy."""
    b, m = len(window), len(base)
    xx, yy = gram(window, window, width), gram(base, base, width)
    return float((xx.sum() - np.trace(xx)) / (b * (b - 1)) - 2 * gram(window, base, width).mean() + (yy.sum() - np.trace(yy)) / (m * (m - 1)))


def witness_betting(x: np.ndarray, base_mean: np.ndarray, fm, clip: float = 0.5) -> np.ndarray:
    """Log-wealth of Newton-step bets on the witness between the baseline and the stream so far, in feature space."""
    phi = features(x, fm)
    past = np.vstack([np.zeros(phi.shape[1]), np.cumsum(phi, axis=0)[:-1]]) / np.maximum(np.arange(len(x)), 1)[:, None]
    f = (phi * (base_mean - past)).sum(1)
    lam, hess, log_s, out = 0.0, 1.0, 0.0, []
    for v in f.tolist():
        log_s += np.log(max(1 + lam * v, 1e-12))
        d = 1 + lam * v
        if abs(d) >= 1e-12:
            z = -v / d
            hess += z * z
            lam = min(clip, max(-clip, lam - 2 / (2 - np.log(3)) * z / hess))
        out.append(log_s)
    return np.array(out)


def pool(mean: np.ndarray, cov: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Seeded draws of a normal law around zero with that covariance."""
    p = len(mean)
    w = normals(mulberry32(seed, size * p + size * p % 2))[: size * p].reshape(size, p)
    try:
        return w @ np.linalg.cholesky(cov).T
    except np.linalg.LinAlgError:
        return w


# as Spark operators


def _gathered(df: DataFrame, keys: list[str], by: str, value: str) -> DataFrame:
    """A row for each series: its keys and `rows`, an array of (by, value) in order."""
    from pyspark.sql import functions as F

    pair = F.struct(F.col(by).alias("by"), F.col(value).cast("double").alias("value"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("rows"))


def universal_inference_e(df: DataFrame, keys: list[str], cal: tuple[int, int], test: tuple[int, int], value: str = "value", by: str = "tick") -> DataFrame:
    """One e-value for each series; series shorter than both windows have none. Series of a batch are fitted together."""
    from pyspark.sql import functions as F

    need = max(cal[0] + cal[1], test[0] + test[1])

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, need)
            on = np.flatnonzero(np.isfinite(x).all(1))
            e = [universal_inferences(x[on[i : i + TOGETHER]], cal, test) for i in range(0, len(on), TOGETHER)]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(on)) for k in keys), pa.array(np.concatenate([np.zeros(0), *e]))], names=[*keys, "e"])

    types = dict(df.dtypes)
    long = _gathered(df, keys, by, value).where(F.size("rows") >= need).select(*keys, F.slice("rows", 1, need)["value"].alias("x"))
    return long.mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", e double")


def sequential_ui_process(df: DataFrame, keys: list[str], value: str = "value", by: str = "tick", change: int = 1) -> DataFrame:
    """log_e of each tick after the first, of series of three ticks at least. Ticks of many series go through the null's search together."""
    from pyspark.sql import functions as F

    def told(b: pa.RecordBatch, rows: list[int], first: np.ndarray, x: np.ndarray, times: pa.Array) -> pa.RecordBatch:
        got = [_predictable(x[first[i] : first[i + 1]], change) for i in rows]
        num, *sums = (np.concatenate(v) for v in zip(*got, strict=True))
        size = np.array([len(g[0]) for g in got])
        at = pa.array(np.arange(len(num)) + np.repeat(first[rows] + 1 - (np.cumsum(size) - size), size))
        return pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(np.repeat(rows, size))) for k in keys), times.take(at), pa.array(num - _null_at_best(*sums))], names=[*keys, by, "log_e"])

    def run(batches):
        for b in batches:
            flat = b.column("rows").flatten()
            first = np.append(0, np.cumsum(b.column("rows").value_lengths().to_numpy()))
            x, times, held, ticks = flat.field("value").to_numpy(zero_copy_only=False), flat.field("by"), [], 0
            for i in range(b.num_rows):
                held.append(i)
                ticks += int(first[i + 1] - first[i])
                if ticks >= TICKS or i == b.num_rows - 1:
                    yield told(b, held, first, x, times)
                    held, ticks = [], 0

    types = dict(df.dtypes)
    return _gathered(df, keys, by, value).where(F.size("rows") >= 3).mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in [*keys, by]) + ", log_e double")


def _matrix(pdf: pd.DataFrame, rows: str = "shard", value: str = "r") -> pd.DataFrame:
    m = pdf.pivot(index=rows, columns="tick", values=value)
    if m.isna().any().any():
        raise ValueError("a shard lacks ticks")
    return m


def _centred(df: DataFrame, fleet: str, cal: int, value: str) -> DataFrame:
    from pyspark.sql import functions as F

    level = df.where(F.col("tick") < cal).groupBy(fleet, "shard").agg(F.median(value).alias("_m"))
    n = df.groupBy(fleet).agg(F.count_distinct("tick").alias("_t"))
    short = df.groupBy(fleet, "shard").agg(F.count("*").alias("_n")).join(n, fleet).select(fleet, "shard", F.when(F.col("_n") != F.col("_t"), F.raise_error(F.lit("a shard lacks ticks")).cast("double")).otherwise(0.0).alias("_0"))
    return df.join(level, [fleet, "shard"]).join(short, [fleet, "shard"]).withColumn("r", F.col(value) - F.col("_m") + F.col("_0")).drop("_m", "_0", value)


def _factor(df: DataFrame, keys: list[str], block: int, load: bool) -> DataFrame:
    """(keys, tick, f): the members' common value of each tick, their location or, with a column `load`, the slope on it; `block` ticks of a group at once."""
    from pyspark.sql import functions as F

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf)
        x = m.to_numpy(float)
        f = slopes(pdf.drop_duplicates("shard").set_index("shard").loc[m.index, "load"].to_numpy(float), x.T) if load else location(x)
        return pd.DataFrame({**{k: key[i] for i, k in enumerate(keys)}, "tick": m.columns.to_numpy(), "f": f})

    types = dict(df.dtypes)
    return df.withColumn("_b", F.floor(F.col("tick") / block)).groupBy(*keys, "_b").applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in [*keys, "tick"]) + ", f double")


def _loadings(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """(keys, shard, load): slope of each shard's values r on f over the ticks given; shards of a group are dealt into buckets."""
    from pyspark.sql import functions as F

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf)
        f = pdf.drop_duplicates("tick").set_index("tick").loc[m.columns, "f"].to_numpy(float)
        return pd.DataFrame({**{k: key[i] for i, k in enumerate(keys)}, "shard": m.index.to_numpy(), "load": slopes(f, m.to_numpy(float))})

    types = dict(df.dtypes)
    return df.withColumn("_b", F.pmod(F.xxhash64("shard"), F.lit(buckets))).groupBy(*keys, "_b").applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in [*keys, "shard"]) + ", load double")


def deflated(df: DataFrame, fleet: str, cal: int, factors: int = 1, value: str = "value", passes: int = 6, block: int = 16, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """(fleet, shard, tick, residual) after so many robust factors, and (fleet, factor, share): each one's share of the energy.

    Factors are fitted by turns: all ticks given the shards' loadings, all shards
    given the ticks' values. A task sees some ticks of all shards, or some shards
    at all ticks, never a fleet's whole window; the vectors between the turns are
    checkpointed.
    """
    from pyspark.sql import functions as F

    from .cut import cut

    d = cut(_centred(df.select(fleet, "shard", "tick", value), fleet, cal, value))
    total = cut(d.groupBy(fleet).agg(F.greatest(F.sum(F.col("r") * F.col("r")), F.lit(TINY)).alias("total")))
    shares = None
    for k in range(factors):
        load = None
        for _ in range(passes):
            f = _factor(d if load is None else d.join(load, [fleet, "shard"]), [fleet], block, load is not None)
            f = cut(f)
            load = cut(_loadings(d.join(f, [fleet, "tick"]), [fleet], buckets))
        part = d.join(f, [fleet, "tick"]).join(load, [fleet, "shard"]).withColumn("part", F.col("load") * F.col("f"))
        part = cut(part.select(fleet, "shard", "tick", (F.col("r") - F.col("part")).alias("r"), "part"))
        share = part.groupBy(fleet).agg(F.sum(F.col("part") * F.col("part")).alias("e")).join(total, fleet).select(fleet, F.lit(k + 1).alias("factor"), (F.col("e") / F.col("total")).alias("share"))
        shares = share if shares is None else shares.unionByName(share)
        d = part.drop("part")
    if shares is None:
        shares = total.select(fleet, F.lit(0).alias("factor"), F.lit(0.0).alias("share")).limit(0)
    return d.withColumnRenamed("r", "residual"), shares


def crossed(df: DataFrame, fleet: str, cal: int, domain_cols: tuple, value: str = "value", sweeps: int = 4, small: int = 5, block: int = 16, buckets: int = 64) -> DataFrame:
    """(fleet, shard, tick, residual) after backfitting the factor of each domain of each partition of the shards (null or negative: none).

    As in `crossed_domains`, by domain and ticks, then by shards; domains of 2
    to `small` members are small groups of their own, each member by the factor
    of the others.
    """
    from pyspark.sql import functions as F

    from .cut import cut

    r = cut(_centred(df.select(fleet, "shard", "tick", value, *domain_cols), fleet, cal, value))
    shards = r.where("tick = 0").select(fleet, "shard", *domain_cols)
    size = {c: cut(shards.where(F.col(c) >= 0).groupBy(fleet, F.col(c).alias("dom")).agg(F.count("*").alias("size"))) for c in domain_cols}
    past = F.col("tick") < cal

    def members(c: str, which: str) -> DataFrame:
        return r.withColumn("dom", F.col(c)).join(size[c].where(which).select(fleet, "dom"), [fleet, "dom"])

    for _ in range(sweeps):
        for c in domain_cols:
            if size[c].where(f"size > {small}").isEmpty():
                continue
            rows = members(c, f"size > {small}")
            f = cut(_factor(rows, [fleet, "dom"], block, False))
            fits = f.groupBy(fleet, "dom").agg(F.sum(F.when(past, F.col("f") * F.col("f"))).alias("ref"), F.sum(F.col("f") * F.col("f")).alias("all")).where(f"ref > {TINY} and ref >= 1e-6 * all").select(fleet, "dom")
            f = f.join(fits, [fleet, "dom"])
            load = _loadings(rows.where(past).join(f, [fleet, "dom", "tick"]), [fleet, "dom"], buckets)
            part = f.join(load, [fleet, "dom"]).select(fleet, "shard", "tick", (F.col("load") * F.col("f")).alias("part"))
            r = cut(r.join(part, [fleet, "shard", "tick"], "left").withColumn("r", F.col("r") - F.coalesce("part", F.lit(0.0))).drop("part"))

    def by_others(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf)
        x = m.to_numpy(float)
        y = x.copy()
        for i in range(len(x)):
            f = location(np.delete(x, i, axis=0))
            ref = (f[:cal] ** 2).sum()
            if ref > TINY and ref >= 1e-6 * (f**2).sum():
                y[i] -= slopes(f[:cal], x[i : i + 1, :cal])[0] * f
        return pd.DataFrame({fleet: key[0], "shard": np.repeat(m.index.to_numpy(), x.shape[1]), "tick": np.tile(m.columns.to_numpy(), x.shape[0]), "new": y.ravel()})

    types = dict(r.dtypes)
    for c in domain_cols:
        new = members(c, f"size between 2 and {small}").select(fleet, "dom", "shard", "tick", "r").groupBy(fleet, "dom").applyInPandas(by_others, f"{fleet} {types[fleet]}, shard {types['shard']}, tick {types['tick']}, new double")
        r = cut(r.join(new, [fleet, "shard", "tick"], "left").withColumn("r", F.coalesce("new", "r")).drop("new"))
    return r.select(fleet, "shard", "tick", F.col("r").alias("residual"))


def localised(df: DataFrame, fleet: str, cal: int, test: int, q: float, domain_cols: tuple, group: str, value: str = "value") -> DataFrame:
    """Common-mode removal, one e-value a shard, e-BH inside each group: shards selected as faulty."""
    from pyspark.sql import functions as F

    from .fleet import e_bh

    r = crossed(df, fleet, cal, domain_cols, value)
    e = universal_inference_e(r, [fleet, "shard"], (0, cal), (cal, test), "residual")
    g = df.select(fleet, "shard", F.col(group).alias("_g")).distinct()
    return e_bh(e.join(g, [fleet, "shard"]), [fleet, "_g"], q, "e", "shard").drop("_g")


def emmd_wealth(x: np.ndarray, base: np.ndarray, width: float, warm: int = 10) -> np.ndarray:
    """Wealth of bets on the distance to a baseline's mean embedding.

    The moments take in a tick before its bet is placed: the bet is not
    predictable, as published for this variant, and its evidence is refused by
    the guarded path.
    """
    norm = gram(base, base, width).mean()
    d = np.sqrt(np.maximum(0, 1 - 2 * gram(x, base, width).mean(1) + norm))
    n = np.arange(1, len(d) + 1)
    mean, second = np.cumsum(d) / n, np.cumsum(d * d) / n
    z = np.clip((d - mean) / (3 * np.sqrt(np.maximum(second - mean * mean, TINY))), -1, 1)
    m, bet, out = 1.0, 0.0, []
    for i in range(len(d)):
        if n[i] >= warm:
            raw = mean[i] / second[i] if second[i] > 0 else 0.0
            if abs(raw) > 1 - 1e-6:
                inner = 1 + bet * mean[i]
                raw = min(1 - 1e-6, max(1e-6 - 1, bet + mean[i] / inner / max(second[i], 1e-6))) if abs(inner) >= 1e-9 else 0.0
            bet = raw
            m = max(1e-12, m * max(0.0, 1 + bet * z[i]))
        out.append(m)
    return np.array(out)


def instrumented_residuals(df: DataFrame, factors: DataFrame, members: DataFrame, fleet: str, cal: int, ridge: float = 0.0, value: str = "value") -> DataFrame:
    """Residuals of each fleet's window after its shards' instrumented factors: factors (factor, tick, value), members (shard, factor)."""
    from pyspark.sql import functions as F

    f = factors.groupBy("factor").agg(F.array_sort(F.collect_list(F.struct("tick", "value"))).alias("signal"))
    per = members.join(f, "factor").groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("factor", F.col("signal.value").alias("values")))).alias("signals"))
    joined = df.select(fleet, "shard", "tick", F.col(value).alias("value")).join(per, "shard", "left")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        x = pdf["value"].to_numpy(float)[None, :]
        held = pdf["signals"].iloc[0]
        sig = np.array([np.asarray(s["values"], float) for s in held]) if held is not None and len(held) else np.zeros((0, x.shape[1]))
        r = instrumented(x, cal, sig, [list(range(len(sig)))], ridge)[0] if len(sig) else centred(x, cal)[0]
        return pd.DataFrame({fleet: key[0], "shard": key[1], "tick": pdf["tick"], "residual": r})

    types = dict(df.dtypes)
    return joined.groupBy(fleet, "shard").applyInPandas(run, f"{fleet} {types[fleet]}, shard {types['shard']}, tick {types['tick']}, residual double")


#: Null laws of the validity battery: innovations, autocorrelation.
NULL_LAWS = {"iid": ("normal", 0.0), "ar1-0.3": ("normal", 0.3), "ar1-0.6": ("normal", 0.6), "ar1-0.9": ("normal", 0.9), "lognormal": ("lognormal", 0.0), "t3": ("t3", 0.0), "ar1-0.6-t3": ("t3", 0.6)}


def null_series(law: str, ticks: int, seed: int) -> np.ndarray:
    """One trajectory of a null law with unit innovations, stationary from its first tick."""
    kind, phi = NULL_LAWS[law]
    rng = np.random.default_rng([seed, sorted(NULL_LAWS).index(law)])
    e = {"normal": lambda n: rng.normal(0, 1, n), "lognormal": lambda n: rng.lognormal(0, 0.75, n), "t3": lambda n: rng.standard_t(3, n)}[kind](ticks + 200)
    x = np.empty(len(e))
    x[0] = e[0]
    for t in range(1, len(e)):
        x[t] = phi * x[t - 1] + e[t]
    return x[200:]


def null_trajectories(spark, n: int, ticks: int, seed: int = 0) -> DataFrame:
    """(law, trajectory, tick, value) of n trajectories of every null law, drawn in the tasks."""
    laws = list(NULL_LAWS)

    def run(batches):
        for b in batches:
            for i in b["id"]:
                law, k = laws[int(i) % len(laws)], int(i) // len(laws)
                yield pd.DataFrame({"law": law, "trajectory": k, "tick": np.arange(ticks), "value": null_series(law, ticks, seed + k)})

    return spark.range(n * len(laws)).mapInPandas(run, "law string, trajectory long, tick long, value double")
