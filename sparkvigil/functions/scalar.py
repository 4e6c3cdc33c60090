"""Scalar functions as Column expressions: transforms, thresholds, quantiles, wealth and verdict rules.

All of them stay inside whole-stage code generation: no Python runs on rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_MAX = math.log(1.7976931348623157e308)
MAX_DOUBLE = 1.7976931348623157e308

#: Default class of each known signal. Fixed values.
SIGNAL_CLASSES = {
    "p99_latency": "gaussian_like", "ttft": "gaussian_like", "tool_success_rate": "bounded_probability", "eval_score": "bounded_probability",
    "downstream_err": "bounded_probability", "cost_req": "heavy_tail", "tokens_turn": "heavy_tail",
}
#: Warm-up window in hours by risk level, and the changes that start one. Fixed values.
WARMUP_HOURS = {"critical": 6, "high": 8, "medium": 10, "low": 4}
WARMUP_CHANGES = ("model_weights", "all")
WARMUP_GRACE_HOURS = 2
WARMUP_SUPPRESSED = ("tokens", "tok_econ", "cost", "kv_low", "hbm_spill", "mfu_delta", "mem_pressure")
#: Coefficients of Abramowitz & Stegun 26.2.23, of Lanczos' gamma (g = 7), and of the normal quantile by Beasley, Springer and Moro. Fixed values.
NORMAL_C, NORMAL_D = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def logit(x: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), x))
    return F.log(p / (1 - p))


def floored_log(x: Column) -> Column:
    return F.log(F.greatest(F.lit(1e-9), x))


def anscombe(x: Column) -> Column:
    return 2 * F.sqrt(F.greatest(F.lit(0.0), x) + 0.375)


def for_class(x: Column, cls: Column) -> Column:
    """Variance-stabilising transform of a signal class; an unknown class is left as it is."""
    return F.when(cls == "bounded_probability", logit(x)).when(cls == "heavy_tail", floored_log(x)).when(cls == "counts", anscombe(x)).otherwise(x)


def signal_class(signal: Column, override: Column | None = None) -> Column:
    """Override, else the default of the signal, else gaussian_like."""
    default = F.element_at(F.create_map(*[F.lit(x) for kv in SIGNAL_CLASSES.items() for x in kv]), signal)
    known = (override, default) if override is not None else (default,)
    return F.coalesce(*known, F.lit("gaussian_like"))


def trend_strength(slope_norm: Column, cv: Column, stable: Column, n: Column, direction: int = 1) -> Column:
    """Score in 0..1 from slope, stability bonus and noise penalty; 0 below four points or against the direction."""
    raw = slope_norm * direction
    bonus = F.when(stable, 0.2).otherwise(F.greatest(F.lit(0.0), 0.2 * (1 - cv / 0.10)))
    noise = F.when(cv > 0.15, F.least(F.lit(0.5), (cv - 0.15) / 0.15)).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(F.lit(1.0), raw / 0.05) + bonus - noise))
    return F.when((n < 4) | (raw <= 0), 0.0).otherwise(score)


def effective_threshold(base: Column, discount: Column, strength: Column, n: Column, roc: Column, roc_bypass: float | None = None) -> Column:
    plain = n < 4
    if roc_bypass is not None:
        plain = plain | (F.abs(roc) >= roc_bypass)
    return F.when(plain, base).otherwise(base - discount * strength)


def warmup_state(change: Column, risk: Column, hours: Column) -> Column:
    """STRUCT<active, grace, pct, hours_remaining> of the warm-up after a change; pct is rounded half up."""
    window = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WARMUP_HOURS.items() for x in kv]), F.coalesce(risk, F.lit("medium"))), F.lit(6))
    on = F.coalesce(change.isin(*WARMUP_CHANGES), F.lit(False))
    active = on & (hours < window)
    return F.struct(
        active.alias("active"), (on & ~(hours < window) & (hours < window + WARMUP_GRACE_HOURS)).alias("grace"),
        F.when(on, F.least(F.lit(100.0), F.floor(hours / window * 100 + 0.5).cast("double"))).otherwise(100.0).alias("pct"),
        F.when(on, F.greatest(F.lit(0.0), window - hours)).alias("hours_remaining"),
    )


def decision(n_rollback: Column, n_extend: Column, tick: Column, total: int = 32) -> Column:
    return F.when(n_rollback > 0, "rollback").when((tick >= total - 1) & (n_extend == 0), "proceed").when(n_extend > 0, "extend").otherwise("baking")


def wealth(log_m: Column) -> Column:
    """exp that saturates at the largest double."""
    return F.when(log_m >= LOG_MAX, MAX_DOUBLE).otherwise(F.exp(log_m))


def advance(log_m: Column, step: Column, floor: float) -> Column:
    """Log-wealth after a step: NaN holds, +infinity saturates, the floor holds from below."""
    up = log_m + step
    return F.when(F.isnan(step), log_m).when(up >= LOG_MAX, LOG_MAX).otherwise(F.greatest(F.lit(floor), up))


def healed(log_m: Column, m: Column, floor: float) -> Column:
    """Log-wealth restored from wealth where it was lost (null or NaN)."""
    fine = log_m.isNotNull() & ~F.isnan(log_m)
    return F.when(fine, log_m).when(m.isNull() | F.isnan(m), 0.0).when(m <= 0, floor).otherwise(F.greatest(F.lit(floor), F.log(m)))


def normal_quantile(p: Column) -> Column:
    t = F.sqrt(-2 * F.log(F.when(p < 0.5, p).otherwise(1 - p)))
    num = NORMAL_C[0] + NORMAL_C[1] * t + NORMAL_C[2] * t * t
    den = 1 + NORMAL_D[0] * t + NORMAL_D[1] * t * t + NORMAL_D[2] * t * t * t
    z = t - num / den
    return F.when(p <= 0, float("-inf")).when(p >= 1, float("inf")).when(p < 0.5, -z).otherwise(z)


def chi_square_quantile(q: Column, k: Column) -> Column:
    """Wilson and Hilferty's cube of a shifted normal quantile."""
    root = 1 - 2 / (9 * k) + normal_quantile(q) * F.sqrt(2 / (9 * k))
    return k * root * root * root


def chi_square_975(p: Column) -> Column:
    root = 1 - 2 / (9 * p) + 1.95996398454005 * F.sqrt(2 / (9 * p))
    return p * root * root * root


def log_gamma(x: Column) -> Column:
    """Lanczos' series for x >= 0.5, the reflection below."""

    def series(y: Column) -> Column:
        a = F.lit(LANCZOS[0])
        for i, c in enumerate(LANCZOS[1:], 1):
            a = a + c / (y + i)
        t = y + 7.5
        return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(a)

    return F.when(x < 0.5, F.log(math.pi / F.sin(math.pi * x)) - series(-x)).otherwise(series(x - 1))


def binomial_tail(g: Column, k: Column, alpha: Column) -> Column:
    """P(X >= k) of Binomial(g, alpha): the first term from logarithms of factorials, each next one by the logarithm of its ratio."""
    fact = lambda n: log_gamma(n.cast("double") + 1)
    first = F.greatest(k, F.lit(0))
    term = fact(g) - fact(first) - fact(g - first) + first * F.log(alpha) + (g - first) * F.log1p(-alpha)
    odds = F.log(alpha) - F.log1p(-alpha)
    start = F.struct(term.alias("log"), F.lit(0.0).alias("sum"), g.cast("double").alias("g"), odds.alias("odds"))
    step = lambda s, i: F.struct((s["log"] + F.log((s["g"] - i) / (i + 1.0)) + s["odds"]).alias("log"), (s["sum"] + F.exp(s["log"])).alias("sum"), s["g"].alias("g"), s["odds"].alias("odds"))
    total = F.aggregate(F.sequence(first, g), start, step, lambda s: s["sum"])
    return F.when(k <= 0, 1.0).when(k > g, 0.0).otherwise(F.least(F.lit(1.0), total))


def wilson_upper(successes: Column, trials: Column, z: float = 1.96) -> Column:
    p = successes / trials
    half = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    return F.when(trials == 0, 1.0).otherwise((p + z * z / (2 * trials) + half) / (1 + z * z / trials))


def hac_inflation(phi: Column) -> Column:
    p = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), phi))
    return (1 + p) / (1 - p)


def e_calibrator(p: Column, kappa: float = 0.1) -> Column:
    return kappa * F.pow(p, F.lit(kappa - 1))


def lil_bound(t: Column, a: float, c: float, t_min: float = 1.0) -> Column:
    return a * F.sqrt((F.log(1 + F.log(t / t_min)) + c) / t)


def gaussian_mixture(s: Column, t: Column, var: Column, prior: Column) -> Column:
    """Mixture supermartingale of a running sum, its logarithm capped at 120."""
    denom = var * t + prior
    return F.exp(F.least(F.lit(120.0), s * s / (2 * denom) + 0.5 * F.log(prior / denom)))


def beta_mixture(s: Column, t: Column, p: Column, a: Column, b: Column) -> Column:
    k = F.greatest(F.lit(1e-9), F.least(t - 1e-9, s + t * p))
    post = log_gamma(a + k) + log_gamma(b + t - k) - log_gamma(a + b + t)
    prior = log_gamma(a) + log_gamma(b) - log_gamma(a + b)
    h0 = k * F.log(p) + (t - k) * F.log(1 - p)
    return F.when((t == 0) | (p <= 0) | (p >= 1), 1.0).otherwise(F.exp(F.least(F.lit(120.0), post - prior - h0)))


def reversible_action(verdict: Column, reversibility: Column) -> Column:
    back = F.when(reversibility == "reversible", "rollback").when(reversibility == "forward_only", "pause_and_alarm").when(reversibility == "conditional", "human_confirmation_required")
    return F.when(verdict == "rollback", back).when(verdict.isin("proceed", "extend", "baking"), verdict).otherwise("suppressed")


def stream_key(cell: Column, draw: Column, trajectory: Column, carry: bool = False) -> Column:
    """Key of an independent random stream: cell below 2^8, draw below 2^12 and trajectory below 2^20 side by side; others are an error, or with `carry` run over into the next field."""
    if carry:
        return F.shiftleft(cell.cast("bigint"), 40) + F.shiftleft(draw.cast("bigint"), 20) + trajectory.cast("bigint")

    def below(c: Column, bits: int, name: str) -> Column:
        fine = (c >= 0) & (c < 1 << bits)
        return F.when(fine, c.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit(f"{name} out of range: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("bigint"))

    return F.shiftleft(below(cell, 8, "cell"), 40) + F.shiftleft(below(draw, 12, "draw"), 20) + below(trajectory, 20, "trajectory")


def fnv1a_hex(text: Column) -> Column:
    """FNV-1a of 32 bits over the characters, as eight hex digits."""
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("bigint"))) * 16777619).bitwiseAND(F.lit(4294967295))
    h = F.aggregate(F.split(text, ""), F.lit(2166136261).cast("bigint"), step)
    return F.lower(F.lpad(F.hex(h), 8, "0"))
