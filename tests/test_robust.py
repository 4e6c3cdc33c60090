"""Robust covariances of cells in blocks against the same fit in one task."""

import numpy as np
import pytest

from sparkvigil.operators import robust


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(12)
    hot = rng.multivariate_normal([100, -50], [[1, 0.5], [0.5, 2]], 300)
    hot[:40] += 30
    tied = rng.integers(0, 3, (120, 2)).astype(float)
    line = np.column_stack([np.arange(80.0), 2 * np.arange(80.0)])
    return {1: hot, 2: tied, 3: line, 4: rng.normal(0, 1, (40, 2)), 5: rng.normal(0, 1, (6, 2))}


def frame(spark, cells):
    rows = [(k, i, *map(float, v)) for k, x in cells.items() for i, v in enumerate(x)] + [(1, 5000, None, 1.0), (1, 5001, float("inf"), 1.0), (7, 0, float("nan"), 1.0)]
    return spark.createDataFrame(rows, "cell int, t long, a double, b double").repartition(5)


def test_plain_fit():
    rng = np.random.default_rng(6)
    true = np.array([[1.0, 0.5], [0.5, 2.0]])
    x = rng.multivariate_normal([0, 0], true, 400)
    x[:60] += 30
    m, c, method, out = robust.fit(x)
    assert method == "mcd" and np.abs(m).max() < 0.3 and np.abs(c - true).max() < 0.6 and out > 0.1
    assert robust.fit(rng.normal(0, 1, (6, 3)))[2] == "ledoit_wolf" and robust.fit(np.ones((50, 2)))[2] == "ledoit_wolf"


def test_blocks_fit_as_one_task_does(spark, cells, monkeypatch):
    monkeypatch.setattr(robust, "STEPS", 2)
    df = frame(spark, cells)
    want = {k: robust.fit(x - x.mean(0), starts=4) for k, x in cells.items()}
    for whole, block in ((10_000, 4096), (50, 64)):
        got = {r.cell: r for r in robust.cell_covariances(df, "cell", ["t"], ["a", "b"], starts=4, whole=whole, block=block).collect()}
        assert set(got) == set(cells)
        for k, (m, c, method, out) in want.items():
            assert got[k].method == method and got[k].n == len(cells[k]) and got[k].outliers == pytest.approx(out, abs=1e-12), k
            assert np.array(got[k].mean) == pytest.approx(m + cells[k].mean(0), abs=1e-7) and np.array(got[k].cov) == pytest.approx(c, abs=1e-7)
    assert got[1].method == "mcd" and got[1].outliers > 0.1 and got[3].method == "ledoit_wolf"


def test_no_rows(spark, cells):
    assert not robust.cell_covariances(frame(spark, cells).where("false"), "cell", ["t"], ["a", "b"]).collect()
