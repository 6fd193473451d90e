"""Hand cases for ordinary but awkward input: corrected profiles, short and gappy series, ties, impossible dates."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.functions import arrays as ar
from seriesmith.operators import aggregate as ag
from seriesmith.operators import calibrate as ca
from seriesmith.operators import clean as cl
from seriesmith.operators import joins as jn
from seriesmith.operators import profile as pf
from seriesmith.operators import trend as tr
from seriesmith.sources import catalog as cat

D0 = dt.date(2001, 1, 1)


def series(spark, values, site="a"):
    rows = [(site, D0 + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "site string, date date, value double")


@pytest.mark.parametrize("method", ["3pw", "pw"])
def test_short_series_has_no_results(spark, method):
    nine = [float(i % 4) for i in range(9)]
    r = tr.mann_kendall(series(spark, nine), ["site"], method=method, by_season=False).first()
    assert r.reason and r.p is None and r.ss is None and r.slope is None and r.ci is None


def test_series_short_in_one_variant_only(spark):
    """Ten values: a prewhitened variant loses its first row and is too short, so the whole fit is rejected."""
    ten = [0.0, 0.1, 0.3, 0.2, 5.0, 5.1, 5.3, 5.2, 9.9, 10.0]
    parts = tr.fit_parts(series(spark, ten), ["site"], "date", "value", by_season=False)
    sizes = {r.variant: r.n for r in parts[1].collect()}
    r = tr.mann_kendall(series(spark, ten), ["site"], by_season=False).first()
    if min(sizes.values()) < 10:
        assert r.reason and r.p is None and r.ss is None and r.slope is None and r.ci is None
    else:
        assert r.reason is None and r.p is not None


def test_decision_needs_both_variants(spark):
    stats = spark.createDataFrame([("a", "pw", None, "too few values: 9"), ("a", "tfpw_y", 0.001, None), ("b", "pw", 0.01, None), ("b", "tfpw_y", 0.001, None)],
                                  "site string, variant string, p double, reason string")
    got = {r.site: (r.p, r.ss) for r in tr.decide_3pw(stats, ["site"]).collect()}
    assert got == {"a": (None, None), "b": (0.01, 95)}


def test_nan_and_infinite_values_are_missing(spark):
    values = [float(i) + (i % 3) for i in range(20)]
    odd = [float("nan") if i % 5 == 1 else float("inf") if i == 7 else v for i, v in enumerate(values)]
    gaps = [None if i % 5 == 1 or i == 7 else v for i, v in enumerate(values)]
    a = tr.mann_kendall(series(spark, odd), ["site"], by_season=False).first()
    b = tr.mann_kendall(series(spark, gaps), ["site"], by_season=False).first()
    assert a.n == b.n < 20 and (a.p, a.ss, a.slope) == pytest.approx((b.p, b.ss, b.slope))


GATES = [100.0 * (i + 1) for i in range(8)]


def profiles(spark, rows):
    full = [(i, "s", t, GATES, GATES, [x * 1.0 for x in beta], corrected, kind, state) for i, (t, beta, corrected, kind, state) in enumerate(rows)]
    return spark.createDataFrame(full, "id long, day string, time timestamp, range array<double>, height array<double>, beta_raw array<double>, "
                                 "range_corrected boolean, instrument string, window double")


def test_preprocess_takes_corrected_profiles_and_types(spark):
    t = [dt.datetime(2020, 1, 1, 0, 0, 30 * i) for i in range(2)] + [dt.datetime(2020, 1, 1, 0, 1 + i) for i in range(3)]
    beta = [1.0] * 8
    rows = [(t[0], beta, True, "other", 99.0), (t[1], beta, False, "other", 99.0), (t[2], beta, None, "CL31", 99.0), (t[3], beta, True, None, None), (t[4], beta, False, "other", 10.0)]
    one = F.lit(1.0)
    out = cl.preprocess(profiles(spark, rows), ["id"], ["day", "id"], "id", one, one, one, instrument="instrument", status="window", status_limit=80.0, noise_min=0.0).collect()
    got = {r.id: r for r in out}
    assert set(got) == {0, 1, 2, 3} and all(r.range_corrected for r in out)
    squared = [(g / 1000) ** 2 for g in GATES]
    assert got[0].beta_raw == pytest.approx(beta) and got[3].beta_raw == pytest.approx(beta)
    assert got[1].beta_raw == pytest.approx(squared) and got[2].beta_raw == pytest.approx(squared)


def test_smoothing_without_a_time_step(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [(t, [1.0] * 8, True, "x", None)]
    for several in (rows, rows * 3):  # one profile, and equal times
        out = pf.gaussian_smooth(profiles(spark, several), ["day"]).collect()
        assert len(out) == len(several) and all(r.beta_smooth == pytest.approx([1.0] * 8) for r in out)


def test_trim_top_keeps_gates_with_zero_and_missing(spark):
    rows = [(1, "d", [1.0, 0.0, 0.0, None]), (2, "d", [1.0, None, 0.0, None])]
    df = spark.createDataFrame(rows, "id long, day string, beta_raw array<double>")
    assert {len(r.beta_raw) for r in cl.trim_top(df, ["day"]).collect()} == {2}


def test_nearest_takes_the_larger_label_on_a_tie(spark):
    grid = spark.createDataFrame([(lat, lon) for lat in (10.0, 11.0, 40.25) for lon in (0.0, 350.0)], "lat double, lon double")
    sites = spark.createDataFrame([("tie", 10.5, 355.0 - 180.0 + 180.0 - 360.0), ("far", 89.0, 10.0), ("near", 39.9, 1.0)], "site string, lat double, lon double")
    got = {r.site: (r.lat, r.lon) for r in jn.nearest_cell(grid, sites).collect()}
    assert got == {"tie": (11.0, 350.0), "far": (40.25, 0.0), "near": (40.25, 0.0)}
    rising, falling = F.array(*map(F.lit, (10.0, 20.0))), F.array(*map(F.lit, (20.0, 10.0)))
    pick = lambda a, *tie: spark.range(1).select(ar.nearest_index(a, F.lit(15.0), *tie)).first()[0]
    assert (pick(rising), pick(rising, "larger"), pick(falling, "larger")) == (0, 1, 0)


def test_granule_with_impossible_date_is_rejected(spark):
    names = ["CER_SYN_Terra-Aqua_Edition4A_407406.20200230.hdf", "CER_SYN_Terra-Aqua_Edition4A_407406.20200229.hdf", "other.hdf", None]
    good, bad = cat.parse_granules(spark.createDataFrame([(n,) for n in names], "file string"))
    assert good.count() == 1 and bad.count() == 3


def test_last_candidate_needs_an_order(spark):
    df = spark.createDataFrame([("a", D0, 3.0, 1), ("a", D0, 2.0, 2), ("a", D0, -1.0, 3)], "site string, date date, lidar_ratio double, k int")
    assert ca.prepare_candidates(df, ["site"], order="k").first().lidar_ratio == 2.0
    with pytest.raises(TypeError):
        ca.prepare_candidates(df, ["site"])


def test_exact_quantiles(spark):
    """Ties, outliers, one value, NULLs: the same as numpy's linear interpolation, whatever the number of bins."""
    rng = np.random.default_rng(3)
    groups = {"ties": rng.integers(0, 5, 301).astype(float), "outlier": np.append(rng.normal(size=200), 1e12), "one": np.array([3.5]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("ties", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = (0.0, 0.02, 0.25, 0.5, 0.98, 1.0)
    for accuracy in (20, 10_000):
        got = {r.g: r.quantiles for r in ag.exact_quantiles(df, ["g"], "v", probs, accuracy=accuracy).collect()}
        assert set(got) == set(groups)
        for g, xs in groups.items():
            assert got[g] == pytest.approx(np.quantile(xs, probs).tolist(), rel=1e-12)
    w = {r.g: r.v for r in ag.winsor_mean(df, ["g"], "v").collect()}
    lo, hi = np.quantile(groups["outlier"], (0.02, 0.98))
    assert w["outlier"] == pytest.approx(np.clip(groups["outlier"], lo, hi).mean()) and w["none"] is None


def test_quantiles_with_odd_values_and_keys(spark):
    """NaN and infinite values are missing, a range that overflows is fine, a NULL key is a group of its own."""
    nan, inf = float("nan"), float("inf")
    rows = [("n", x) for x in (1.0, nan, 2.0, inf, -inf, 4.0, None)] + [(None, x) for x in (5.0, 6.0, nan)] + [("wide", x) for x in (-1.7e308, 0.0, 1.7e308)] + [("void", nan)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.quantiles for r in ag.exact_quantiles(df, ["g"], "v", (0.0, 0.5, 1.0)).collect()}
    assert got == {"n": [1.0, 2.0, 4.0], None: [5.0, 5.5, 6.0], "wide": [-1.7e308, 0.0, 1.7e308]}
    means = {r.g: r.v for r in ag.winsor_mean(df, ["g"], "v", 0.0, 1.0).collect()}
    assert means == {"n": pytest.approx(7 / 3), None: 5.5, "wide": 0.0, "void": None}


def test_quantiles_of_many_values(spark):
    """Far more values than the sketch keeps, half of them one value."""
    df = spark.range(300_000).select(F.lit(1).alias("g"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.rand(3) - 0.3).alias("v")).cache()
    probs = (0.001, 0.1, 0.37, 0.5, 0.9995)
    want = np.quantile(df.toPandas().v, probs)
    assert ag.exact_quantiles(df, ["g"], "v", probs).first().quantiles == pytest.approx(want.tolist(), rel=1e-12)


@pytest.mark.parametrize("n_days", [1, 4, 31, 365])
def test_sliding_climatology(n_days):
    rng = np.random.default_rng(n_days)
    doy, v = rng.integers(1, 366, 700), np.round(rng.normal(size=700), 1)
    got = ag._sliding_means(doy, v, n_days, 0.02, 0.98)
    for d in range(1, 366):
        near = (doy - d + (n_days - 1) // 2) % 365 < n_days
        if not near.any():
            assert np.isnan(got[d - 1])
            continue
        lo, hi = np.quantile(v[near], (0.02, 0.98))
        assert got[d - 1] == pytest.approx(np.clip(v[near], lo, hi).mean(), abs=1e-12)


def test_climatology_of_null_keys(spark):
    rows = [(s, D0 + dt.timedelta(days=i), x) for s in ("a", None) for i, x in enumerate([1.0, 3.0, float("nan"), 5.0])]
    df = spark.createDataFrame(rows, "site string, date date, value double").withColumn("instrument", F.lit("x"))
    got = ag.doy_climatology(df, ["site"], n_days=1).collect()
    assert sorted((r.site or "", r.value) for r in got) == [("", 1.0), ("", 3.0), ("", 5.0), ("a", 1.0), ("a", 3.0), ("a", 5.0)]
    shared = ag.shared_climatology(df.where("value = value and not isnan(value)"), ["site"]).collect()
    assert {r.site for r in shared} == {"a", None} and len(shared) == 2 * 2 * len({r.doy for r in shared})


def test_rolling_quantile_against_every_window(spark):
    """Widths, gaps, equal values, NULL and NaN: each row against a plain cut of its window; NULL keys are segments too."""
    rng = np.random.default_rng(9)
    rows = []
    for key in ("a", None):
        days = sorted({int(x) for x in np.r_[rng.integers(0, 900, 60), rng.integers(2500, 4000, 90), rng.integers(5200, 5230, 4), np.arange(8000, 11000, 60)]})
        for d in days:
            v = None if rng.random() < 0.1 else float("nan") if rng.random() < 0.03 else float(np.round(rng.normal(20, 3)))
            rows.append((key, D0 + dt.timedelta(days=d), v))
    df = spark.createDataFrame(rows, "k string, date date, lidar_ratio double")
    got = {(r.k, r.date): (r.rolling, r.label) for r in ca.rolling_quantile(df, ["k"], window_min=20).collect()}
    assert len(got) == len(rows) and {x[1] for x in got.values()} == {None, *(n for _, n in ca.WINDOWS)}
    day = 86400 * 1_000_000
    for key, d, _ in rows:
        want = (None, None)
        for years, name in ca.WINDOWS:
            half = int(years * ca.YEAR_US / 2)
            near = [v for k, x, v in rows if k == key and v is not None and v == v and -half < (x - d).days * day <= half]
            if len(near) >= 20:
                want = (pytest.approx(np.quantile(near, ca.QUANTILE)), name)
                break
        assert got[key, d] == want
