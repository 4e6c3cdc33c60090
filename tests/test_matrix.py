"""Matrix kernels against plain loops, and their statistical guarantees on seeded draws."""

import math

import numpy as np
import pytest

from sparkvigil.operators import matrix as mx


def test_generator_matches_its_definition():
    a, out = 12345, []
    for _ in range(50):
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        out.append(((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296)
    assert mx.mulberry32(12345, 50).tolist() == out


def sequential_plain(x, c, clip=0.95):
    num, out = 0.0, []
    for s in range(1, len(x)):
        pre, post = x[: min(s, c)], x[c:s]
        mu0 = pre.mean() if len(pre) else 0.0
        mu1 = post.mean() if len(post) else mu0
        m = np.where(np.arange(len(x)) >= c, mu1, mu0)
        y = x - m
        phi = np.clip((y[1:s] * y[: s - 1]).sum() / (1 + (y[: s - 1] ** 2).sum()), -clip, clip)
        var = max((1 + ((y[1:s] - phi * y[: s - 1]) ** 2).sum()) / s, 1e-9)
        e = y[s] - phi * y[s - 1]
        num += -0.5 * math.log(2 * math.pi * var) - e * e / (2 * var)
        best = 0.0
        if s >= 2:
            best = -math.inf
            for f in np.linspace(-0.999, 0.999, 4001):
                d = x[1 : s + 1] - f * x[:s]
                v = max(((d - d.mean()) ** 2).sum(), 1e-12 * s) / s
                best = max(best, -0.5 * s * math.log(2 * math.pi * v) - s / 2)
        out.append(num - best)
    return np.array(out)


@pytest.mark.parametrize("change", [1, 5])
def test_sequential_ui(change):
    x = np.random.default_rng(2).normal(0, 1, 25)
    gap = np.abs(mx.sequential_ui(x, change) - sequential_plain(x, change))
    assert np.delete(gap, 1).max() < 1e-4  # two innovations: a phi exists that makes both equal, and the likelihood has no bound


def test_universal_inference_is_an_e_value():
    rng = np.random.default_rng(0)
    null = [mx.universal_inference(rng.normal(0, 1, 60), (0, 30), (30, 30)) for _ in range(300)]
    shifted = []
    for _ in range(50):
        x = rng.normal(0, 1, 60)
        x[30:] += 3
        shifted.append(mx.universal_inference(x, (0, 30), (30, 30)))
    assert np.mean(null) <= 1.0 and np.median(shifted) > 100


def test_location_and_slopes_resist_outliers():
    rng = np.random.default_rng(1)
    x = rng.normal(5, 1, (200, 3))
    x[:20] = 1000
    assert np.abs(mx.location(x) - 5).max() < 0.3
    f = rng.normal(0, 1, 300)
    y = np.outer([2.0, -1.0], f) + rng.normal(0, 0.1, (2, 300))
    y[:, :30] += 50
    assert np.abs(mx.slopes(f, y) - [2, -1]).max() < 0.05


def test_common_mode_goes_and_fault_stays():
    rng = np.random.default_rng(3)
    f, load = rng.normal(0, 2, 120), rng.uniform(0.5, 1.5, 20)
    x = np.outer(load, f) + rng.normal(0, 0.1, (20, 120))
    x[4, 60:] += 6
    r, shares = mx.multi_factor(x, 60, 1)
    assert shares[0] > 0.8 and np.abs(r[:, :60]).mean() < 0.3 and r[4, 60:].mean() > 5
    z = rng.normal(0, 2, (4, 120))
    dom = np.stack([np.arange(40) // 10, np.arange(40) % 4], axis=1)
    y = z[dom[:, 0]] + rng.normal(0, 2, (4, 120))[dom[:, 1]] + rng.normal(0, 0.2, (40, 120))
    y[7, 80:] += 8
    r = mx.crossed_domains(y, 80, dom)
    assert np.abs(np.delete(r, 7, 0)).mean() < 0.5 and r[7, 80:].mean() > 6


def test_small_domains_use_the_others():
    rng = np.random.default_rng(4)
    f = rng.normal(0, 2, 100)
    x = np.outer(np.ones(3), f) + rng.normal(0, 0.1, (3, 100))
    x[0, 60:] += 9
    r = mx.crossed_domains(x, 60, np.zeros((3, 1), int))
    assert r[0, 60:].mean() > 8


def test_instrumented():
    rng = np.random.default_rng(5)
    f = rng.normal(0, 1, (2, 80))
    x = np.stack([3 * f[0], 2 * f[1] - f[0], rng.normal(0, 1, 80)]) + rng.normal(0, 0.01, (3, 80))
    r = mx.instrumented(x, 40, f, [[0], [0, 1], []])
    assert np.abs(r[:2]).max() < 0.1 and np.abs(r[2]).max() > 1
    same = mx.instrumented(x, 40, np.stack([f[0], f[0]]), [[0, 1], [], []])
    assert np.abs(same[0]).max() > 1  # singular: the level only


def test_features_approximate_the_kernel():
    x = np.random.default_rng(7).normal(0, 1, (30, 3))
    fm = mx.feature_map(9, 4096, 3, 1.5)
    assert np.abs(mx.features(x, fm) @ mx.features(x, fm).T - mx.gram(x, x, 1.5)).max() < 0.12
    a, b = np.random.default_rng(8).normal(0, 1, (60, 2)), np.random.default_rng(9).normal(2, 1, (60, 2))
    assert mx.mmd_u(a, b, 1.0) > 0.2 > abs(mx.mmd_u(a[:30], a[30:], 1.0))


def test_witness_betting_grows_under_a_shift():
    rng = np.random.default_rng(10)
    fm = mx.feature_map(1, 256, 2, 1.0)
    base = mx.features(rng.normal(0, 1, (300, 2)), fm).mean(0)
    quiet, loud = mx.witness_betting(rng.normal(0, 1, (200, 2)), base, fm), mx.witness_betting(rng.normal(3, 0.3, (200, 2)), base, fm)
    assert quiet[-1] < math.log(20) and loud.min() < quiet.max() + 50


def test_pool_has_its_covariance():
    c = np.array([[2.0, 0.3], [0.3, 0.5]])
    assert np.abs(np.cov(mx.pool(np.zeros(2), c, 20000, 3).T) - c).max() < 0.08


def test_null_battery_is_whole(spark, monkeypatch):
    from sparkvigil.plans import q_matrix

    sizes, draw = [], mx.null_trajectories
    monkeypatch.setattr(mx, "null_trajectories", lambda s, n, ticks, seed: sizes.append((n, ticks)) or draw(s, 2, ticks, seed))
    rows = q_matrix.null_battery(spark, "").collect()
    assert sizes == [(2000, 300)] and {(r.law, r.n) for r in rows} == {(law, 2) for law in mx.NULL_LAWS}


def test_distributed_fleet_residuals(spark):
    rng = np.random.default_rng(3)
    n, t, cal = 14, 24, 12
    rack, zone = np.arange(n) // 7, np.where(np.arange(n) == 3, -1, np.arange(n) % 5)
    x = rng.normal(size=(n, t)) + np.outer(rng.normal(1, 0.2, n), rng.normal(size=t).cumsum()) + 2 * rng.normal(size=(2, t)).cumsum(1)[rack]
    rows = [("f", int(i), int(k), float(x[i, k]), int(rack[i]), int(zone[i])) for i in range(n) for k in range(t)]
    df = spark.createDataFrame(rows, "fleet string, shard long, tick long, value double, rack int, zone int")
    as_matrix = lambda d: d.toPandas().pivot(index="shard", columns="tick", values="residual").to_numpy()
    want, shares = mx.multi_factor(x, cal, 2)
    got, energy = mx.deflated(df, "fleet", cal, 2, passes=6, block=5, buckets=3)
    assert np.abs(as_matrix(got) - want).max() < 1e-6
    assert np.allclose([r.share for r in energy.orderBy("factor").collect()], shares, atol=1e-8)
    want = mx.crossed_domains(x, cal, np.stack([rack, zone], axis=1))
    assert np.abs(as_matrix(mx.crossed(df, "fleet", cal, ("rack", "zone"), block=7, buckets=2)) - want).max() < 1e-6
    with pytest.raises(Exception, match="lacks ticks"):
        mx.crossed(df.where("not (shard = 2 and tick = 5)"), "fleet", cal, ("rack",)).count()


def test_mean_of_features():
    fm, cov = mx.feature_map(5, 32, 2, 1.0), np.array([[1.0, 0.3], [0.3, 0.5]])
    x = np.random.default_rng(0).multivariate_normal([0, 0], cov, 200_000)
    assert np.abs(mx.features(x, fm).mean(0) - mx.feature_mean(cov, fm)).max() < 0.003


def test_series_are_fitted_together(spark, monkeypatch):
    """Equal to one series after the other, with short, gappy and null-keyed ones; one call of the kernel for all series of a batch."""
    monkeypatch.setattr(mx, "TICKS", 90)
    rng = np.random.default_rng(5)
    data = {k: rng.normal(0, 1, n) + 2 * (np.arange(n) >= 20) for k, n in ((0, 45), (1, 40), (2, 39), (3, 2), (None, 60), (4, 3), (5, 41))}
    rows = [(k, t, None if (k, t) == (5, 7) else float(v)) for k, x in data.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series long, tick long, value double").repartition(5, "tick")
    e = {r.series: r.e for r in mx.universal_inference_e(df, ["series"], (0, 20), (20, 20)).collect()}
    assert e.keys() == {0, 1, None} and all(v == pytest.approx(mx.universal_inference(data[k], (0, 20), (20, 20))) for k, v in e.items())
    got = {}
    for r in mx.sequential_ui_process(df.where("series is null or series <> 5"), ["series"]).orderBy("tick").collect():
        got.setdefault(r.series, []).append((r.tick, r.log_e))
    assert got.keys() == {0, 1, 2, 4, None}
    for k, told in got.items():
        assert [t for t, _ in told] == list(range(1, len(data[k]))) and [v for _, v in told] == pytest.approx(mx.sequential_ui(data[k]).tolist())
    import time

    x = rng.normal(0, 1, (2000, 40))
    began = time.process_time()
    mx.universal_inferences(x, (0, 20), (20, 20))
    together = time.process_time() - began
    began = time.process_time()
    for row in x[:200]:
        mx.universal_inference(row, (0, 20), (20, 20))
    assert together < 10 * (time.process_time() - began) / 2
