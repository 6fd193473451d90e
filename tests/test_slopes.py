"""Order statistics of slopes against all pairs."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.core import cut
from seriesmith.operators import slopes as sl
from seriesmith.operators import trend as tr

DAY = 86400.0


def all_slopes(strat, t, y, w, unit):
    out = []
    for a in range(len(t)):
        later = (strat == strat[a]) & (t > t[a])
        out.append(np.repeat((y[later] - y[a]) / ((t[later] - t[a]) * unit), w[later] * w[a]))
    return np.sort(np.concatenate(out)) + 0.0


CASES = {
    "plain": lambda r, n: (np.zeros(n, int), np.arange(n), r.normal(size=n), np.ones(n, int)),
    "strata and equal times": lambda r, n: (r.integers(0, 3, n), r.integers(0, n // 3, n), r.normal(size=n), np.ones(n, int)),
    "ties": lambda r, n: (np.zeros(n, int), r.permutation(n), r.integers(0, 4, n).astype(float), np.ones(n, int)),
    "a line with steps": lambda r, n: (np.zeros(n, int), np.arange(n), 0.1 * np.arange(n) + 0.1 * r.integers(0, 2, n), np.ones(n, int)),
    "copies": lambda r, n: (r.integers(0, 2, n), r.integers(0, n, n), np.round(r.normal(size=n), 1), r.integers(1, 40, n)),
    "an outlier": lambda r, n: (np.zeros(n, int), np.arange(n) * 7, np.r_[1e12, r.normal(size=n - 1)], np.ones(n, int)),
    "far from zero": lambda r, n: (np.zeros(n, int), np.arange(n) + 20000, 1e6 + 1e-3 * r.normal(size=n), np.ones(n, int)),
}


@pytest.mark.parametrize("listed", [40, sl.LIST_PAIRS])
@pytest.mark.parametrize("case", CASES)
def test_selection_against_all_pairs(case, listed, monkeypatch):
    monkeypatch.setattr(sl, "LIST_PAIRS", listed)
    monkeypatch.setattr(sl, "SAMPLE", 500)
    s, t, y, w = CASES[case](np.random.default_rng(4), 150)
    _, first = np.unique(np.stack([s, t, y]), axis=1, return_index=True)  # equal rows are one point
    s, t, y, w = s[first], t[first], y[first], w[first]
    want = all_slopes(s, t, y, w, DAY)
    points = sl.Points(s, t, y, w, DAY)
    assert points.n_pairs == len(want)
    ranks = np.unique(np.r_[0, 1, np.linspace(0, len(want) - 1, 23).astype(int), len(want) - 2, len(want) - 1])
    got = sl.select(points, ranks)
    np.testing.assert_allclose(got, want[ranks], rtol=1e-9, atol=1e-12 * np.abs(want).max())
    for v in (0.0, want[len(want) // 3], 1e-9):
        under, up_to = points.count(v)
        near = sl.ROUNDING * 8 * (points.top[0] + abs(v) * DAY * points.top[1]) / DAY
        assert (want < v - near).sum() <= under <= (want <= v).sum() and (want < v).sum() <= up_to <= (want <= v + near).sum()


def test_every_rank_of_a_series():
    r = np.random.default_rng(2)
    s, t, y = r.integers(0, 2, 90), r.integers(0, 60, 90), np.round(r.normal(size=90), 2)
    want = all_slopes(s, t, y, np.ones(90, int), 1.0)
    assert sl.select(sl.Points(s, t, y, np.ones(90, int), 1.0), np.arange(len(want))).tolist() == want.tolist()


def test_no_pairs_and_flat_values():
    one = np.zeros(1)
    assert np.isnan(sl.select(sl.Points(one, one, one, np.ones(1, int), 1.0), np.array([0]))).all()
    flat = sl.Points(np.zeros(5), np.arange(5), np.full(5, 3.0), np.ones(5, int), 1.0)
    assert sl.select(flat, np.array([0, 9])).tolist() == [0.0, 0.0] and flat.n_pairs == 10


def test_short_and_long_series_agree(spark):
    """Long series are counted by all tasks; NULL keys and copies are series and weights like others."""
    r = np.random.default_rng(8)
    rows = [(site, "s" + str(i % 2), int(t), float(v)) for site, n in (("a", 300), (None, 200), ("short", 30)) for i, (t, v) in enumerate(zip(r.integers(0, n, n), np.round(r.normal(size=n), 2) + 0.01 * np.arange(n), strict=True))]
    rows += [rows[5]] * 50 + [("flat", "s0", i, 1.0) for i in range(60)] + [("a", "s0", 5, None)]
    df = spark.createDataFrame(rows, "site string, _strat string, _t long, _y double")
    want = {}
    for site in ("a", None, "short", "flat"):
        mine = [x for x in rows if x[0] == site and x[3] is not None]
        want[site] = all_slopes(np.array([x[1] for x in mine]), np.array([x[2] for x in mine]), np.array([x[3] for x in mine]), np.ones(len(mine), int), DAY)
    asked = [(site, int(k)) for site, v in want.items() for k in {0, len(v) // 4, len(v) // 2, len(v) - 1}]
    ranks = spark.createDataFrame(asked, "site string, k long")
    for local, limit in ((50, sl.LIST_PAIRS), (50, 400), (100_000, sl.LIST_PAIRS)):
        got = {(x.site, x.k): x.slope for x in tr.slope_ranks(df, ["site"], "_strat", "_t", "_y", ranks, DAY, local, limit).collect()}
        assert set(got) == set(asked)
        for (site, k), v in got.items():
            assert v == pytest.approx(want[site][k], rel=1e-10, abs=1e-17), (local, site, k)


def test_falling_and_rising_pairs_of_an_outlier(spark, monkeypatch):
    """Value blocks follow ranks: one outlier does not leave the rest in one block."""
    r = np.random.default_rng(3)
    rows = [("a", "s", int(i), float(v)) for i, v in enumerate(np.r_[1e15, r.normal(size=400)])]
    df = spark.createDataFrame(rows, "site string, _strat string, _t long, _y double")
    monkeypatch.setattr(tr, "VALUE_BLOCK", 8)
    ties = cut(tr.tie_statistics(df, ["site"], "_strat", "_t", "_y", 1e-6))
    assert len(ties.first().splits) > 20
    got = tr.pair_counts(df, ["site"], "_strat", "_t", "_y", 1e-6, ties).first()
    y = np.array([x[3] for x in rows])
    falling = sum(int((y[i + 1:] < y[i]).sum()) for i in range(len(y)))
    assert (got.falling, got.rising) == (falling, len(y) * (len(y) - 1) // 2 - falling)


def test_a_series_of_many_points_ends(spark):
    n = 60_000
    df = spark.range(n).select(F.lit("a").alias("site"), F.lit("s").alias("_strat"), F.col("id").alias("_t"), (F.randn(1) + F.col("id") * 1e-5).alias("_y"))
    ranks = spark.createDataFrame([("a", n * (n - 1) // 4)], "site string, k long")
    began = time.time()
    got = tr.slope_ranks(df, ["site"], "_strat", "_t", "_y", ranks, 1.0).first().slope
    assert got == pytest.approx(1e-5, abs=1e-6) and time.time() - began < 120
