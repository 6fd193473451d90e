import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.functions import arrays as ar
from seriesmith.functions import calendar as cal
from seriesmith.functions import scalar as fn
from seriesmith.operators import aggregate as ag
from seriesmith.operators import calibrate as ca
from seriesmith.operators import clean as cl
from seriesmith.operators import columns as mc
from seriesmith.operators import compare as cp
from seriesmith.operators import joins as jn
from seriesmith.operators import profile as pf
from seriesmith.operators import response as rs
from seriesmith.operators import setops as so
from seriesmith.sources import catalog as cat
from seriesmith.sources import tables as tb


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def day(s):
    return F.lit(s).cast("date")


def test_calendar(spark):
    assert [one(spark, cal.noleap_doy(day(d))) for d in ("2004-02-28", "2004-03-01", "2004-12-31", "2003-12-31")] == [59, 60, 365, 365]
    assert one(spark, cal.is_leap_day(day("2004-02-29")))
    week = lambda d: str(one(spark, cal.bin_label(day(d), "week")))
    assert (week("2001-01-01"), week("2001-01-02")) == ("2001-01-01", "2001-01-08")
    q = lambda d: str(one(spark, cal.bin_label(day(d), "season")))
    assert (q("2001-12-05"), q("2001-01-15")) == ("2001-12-01", "2000-12-01")


def test_three_day_bins_with_hole(spark):
    days = [2, 3, 4, 5, 11]
    df = spark.createDataFrame([("a", dt.date(2001, 1, d), 1.0 * d) for d in days], "site string, date date, value double")
    got = ag.calendar_bins(df, ["site"], "3day").orderBy("bin").collect()
    assert [(str(r.bin), r.value) for r in got] == [("2001-01-02", 3.0), ("2001-01-05", 5.0), ("2001-01-08", None), ("2001-01-11", 11.0)]


def test_min_fraction(spark):
    df = spark.createDataFrame([(g, v) for g, vs in ((1, [1.0, None, None, None]), (2, [1.0, 3.0, None, None])) for v in vs], "g int, v double")
    assert [tuple(r) for r in df.groupBy("g").agg(ag.mean_min_frac("v")).orderBy("g").collect()] == [(1, None), (2, 2.0)]


def test_doy_circle_and_shared_climatology(spark):
    df = spark.createDataFrame([("a", dt.date(2001, 1, 1), 5.0)], "site string, date date, value double")
    assert sorted(r.doy for r in ag.doy_climatology(df, ["site"]).collect()) == [*range(1, 17), *range(351, 366)]
    rows = [("a", i, dt.date(2001, 1, 1) + dt.timedelta(days=d), float(d % 7) + (10 if i == "x" else 0)) for i in "xy" for d in range(0, 700, 2)]
    c = ag.shared_climatology(spark.createDataFrame(rows, "site string, instrument string, date date, value double"), ["site"])
    m = c.where("instrument = 'x'").agg(F.avg("shared")).first()[0]
    assert m == pytest.approx(0, abs=1e-9)


def test_reconstruct_daily_is_identity(spark):
    rows = [("a", dt.date(2001, 1, 1) + dt.timedelta(days=d), float(d % 11)) for d in range(800)]
    d = spark.createDataFrame(rows, "site string, date date, value double")
    clim = ag.doy_climatology(d, ["site"])
    a = ag.anomaly(d, clim, ["site"]).select("site", F.col("date").alias("bin"), "anomaly", F.col("value").alias("was"))
    r = ag.reconstruct(a, clim, ["site"], True)
    assert r.where(F.abs(F.col("value") - F.col("was")) > 1e-9).count() == 0 and r.count() == 800


def test_negative_run(spark):
    def start(n):
        b = F.array(*[F.lit(-1.0 if 5 <= i < 5 + n else 1.0) for i in range(30)])
        return one(spark, pf.first_negative_gate(b))

    assert start(5) is None and start(6) == 10


def test_peaks(spark):
    mk = lambda at: F.array(*[F.lit(1.0 if i in at else 0.0) for i in range(40)])
    assert one(spark, pf.local_maxima(mk([20]))) == [20]
    assert one(spark, pf.local_maxima(mk([20, 21]))) == []
    assert one(spark, pf.local_maxima(mk([0]))) == []


def test_range_correction_round_trip(spark):
    b, r = F.array(F.lit(1.0), F.lit(-2.0)), F.array(F.lit(500.0), F.lit(1500.0))
    assert one(spark, pf.range_uncorrect(pf.range_correct(b, r), r)) == pytest.approx([1.0, -2.0])
    with pytest.raises(Exception, match="already range-corrected"):
        one(spark, pf.range_correct(b, r, F.lit(True)))


def test_overlap(spark):
    h = lambda dz: F.array(F.lit(0.0), F.lit(dz))
    c = F.array(F.lit(0.5), F.lit(0.5))
    assert one(spark, mc.overlap_cover(h(0.0), c, F.lit(1000.0))) == pytest.approx(0.5)
    assert one(spark, mc.overlap_cover(h(1e9), c, F.lit(1000.0))) == pytest.approx(0.75)
    df = spark.createDataFrame([(1, 4, 0.0), (1, 5, 1.0)], "k int, layer int, obs double")
    assert mc.non_obscured_layers(df, ["k"], ["obs"]).first().obs_non_obscured is None


def test_trapezoid_and_median(spark):
    y = F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0))
    x = F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))
    assert one(spark, ar.nan_trapz(y, x)) == 4.0
    assert one(spark, ar.nan_trapz(F.slice(y, 1, 2), F.slice(x, 1, 2))) is None
    assert one(spark, ar.array_median(F.array(F.lit(3.0), F.lit(1.0), F.lit(None), F.lit(2.0), F.lit(10.0)))) == 2.5


def test_gaussian_against_numpy(spark):
    rng = np.random.default_rng(3)
    n, g, step, sig = 1100, 8, 15.0, 30.0
    x = rng.normal(size=(n, g))
    t0 = dt.datetime(2020, 1, 1)
    rows = [("f", t0 + dt.timedelta(seconds=step * i), x[i].tolist(), [10.0 * (j + 1) for j in range(g)]) for i in range(n)]
    df = spark.createDataFrame(rows, "file string, time timestamp, beta_raw array<double>, range array<double>")
    got = pf.gaussian_smooth(df, ["file"], sig, 10.0, 1e9).orderBy("time").collect()
    r = np.array([10.0 * (j + 1) for j in range(g)]) / 1000
    u = x / r**2

    def conv(a, s, axis):
        k = np.arange(-int(4 * s + 0.5), int(4 * s + 0.5) + 1)
        w = np.exp(-(k**2) / (2 * s * s))
        w /= w.sum()
        m = a.shape[axis]
        out = np.zeros_like(a)
        for kk, ww in zip(k, w, strict=True):
            j = np.mod(np.arange(m) + kk, 2 * m)
            out += ww * np.take(a, np.where(j < m, j, 2 * m - 1 - j), axis=axis)
        return out

    want = conv(conv(u, 1.0, 1), sig / step, 0) * r**2
    np.testing.assert_allclose(np.array([row.beta_smooth for row in got]), want, rtol=1e-9, atol=1e-12)


def test_bad_days(spark):
    cfg = {"A": {"X": ["2001-01-01", "2001-01-03/2001-01-04"]}}
    df = spark.createDataFrame([(json.dumps(cfg),)], "config string")
    assert sorted(str(r.date) for r in cl.bad_day_table(df).collect()) == ["2001-01-01", "2001-01-03", "2001-01-04"]
    for bad in ("2001-01-04/2001-01-03", "soon"):
        b = spark.createDataFrame([(json.dumps({"a": {"x": [bad]}}),)], "config string")
        with pytest.raises(Exception, match="invalid bad-day entry"):
            cl.bad_day_table(b).collect()


def test_quality_gate(spark):
    df = spark.createDataFrame([(1, 1, 90.0), (2, 0, 64.9), (3, None, None), (4, 0, 70.0)], "k int, qc_flag int, window_transmission double")
    assert sorted(r.k for r in cat.quality_gate(df, {"qc_flag": 0, "window_transmission": 65.0}).collect()) == [3, 4]


def test_overlap_exclusion(spark):
    d = lambda i: dt.date(2001, 1, 1) + dt.timedelta(days=i)
    rows = [("a", "x", d(i), 1.0) for i in (0, 3, 6, 30)] + [("a", "y", d(i), 1.0) for i in (8, 9, 32)]
    k = jn.overlap_exclusion(spark.createDataFrame(rows, "site string, instrument string, date date, value double"), ["site"], "instrument", 2)
    assert sorted((r.instrument, r.date) for r in k.collect()) == [("x", d(0)), ("x", d(3)), ("x", d(6)), ("x", d(30)), ("y", d(9))]


def test_calibration_statuses(spark):
    d = lambda i: dt.date(2001, 1, 1) + dt.timedelta(days=i)
    rows = [("a", d(5 * i), 18.8) for i in range(40)] + [("b", d(0), 10.0), ("b", d(9), 20.0)]
    rows += [("d", d(i), 10.0) for i in range(40)] + [("d", d(100 + i), 30.0) for i in range(40)]
    c = spark.createDataFrame(rows, "site string, date date, lidar_ratio double")
    t = spark.createDataFrame([(s, d(i)) for s in "abcd" for i in (0, 2, 120)], "site string, date date")
    bp = spark.createDataFrame([("d", d(100))], "site string, breakpoint date")
    f = {(r.site, r.date): r for r in ca.calibration_factors(c, t, bp, ["site"], F.lit(18.8), order="lidar_ratio").collect()}
    assert f["a", d(0)].factor_status == "rolling_two_year" and f["a", d(2)].factor_status == "interpolated"
    assert f["a", d(0)].autocalibration_factor == pytest.approx(0.78)
    assert f["b", d(2)].factor_status == "candidate_median_fallback" and f["b", d(2)].rolling_median_lidar_ratio == 15.0
    assert f["c", d(0)].factor_status == "default_no_candidates" and f["c", d(0)].autocalibration_factor == 1.0
    assert (f["d", d(2)].rolling_median_lidar_ratio, f["d", d(120)].rolling_median_lidar_ratio) == (10.0, 30.0)


def test_quasibinomial_against_numpy(spark):
    rng = np.random.default_rng(2)
    n = 300
    t = np.arange(n) / 36.5
    temp = 0.3 * t + rng.normal(size=n)
    doy = (np.arange(n) * 3) % 365 + 1
    w = rng.integers(1, 9, n).astype(float)
    y = 1 / (1 + np.exp(-(0.2 + 0.3 * temp + rng.normal(size=n) * 0.5)))
    df = spark.createDataFrame(
        [("a", float(a), float(b), int(c), float(e), float(f)) for a, b, c, e, f in zip(t, temp, doy, w, y, strict=True)],
        "site string, time double, temperature double, doy int, n_samples double, y double")
    got = rs.fit_response(df, ["site"], 2).first()
    c = np.polyfit(t, temp, 1)
    tt = c[0] * t + c[1]
    a = 2 * np.pi * doy / 365.25
    x = np.column_stack([np.ones(n), tt, temp - tt, np.sin(a), np.cos(a)])
    yc, b = np.clip(y, 0.01, 0.99), np.zeros(5)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ b))
        v = mu * (1 - mu)
        b = np.linalg.solve((x * (w * v)[:, None]).T @ x, (x * (w * v)[:, None]).T @ (x @ b + (yc - mu) / v))
    mu = 1 / (1 + np.exp(-x @ b))
    v = mu * (1 - mu)
    scale = (w * (yc - mu) ** 2 / v).sum() / (n - 5)
    np.testing.assert_allclose(got.coef, b, rtol=1e-7, atol=1e-9)
    assert got.dispersion == pytest.approx(scale, rel=1e-7)
    np.testing.assert_allclose(got.se, np.sqrt(scale * np.diag(np.linalg.inv((x * (w * v)[:, None]).T @ x))), rtol=1e-6)
    assert got.mme_trend == pytest.approx((b[1] * v).mean(), rel=1e-7)


def test_bootstrap_multiplicities():
    per = [rs.multiplicities(200, 7, i, 20) for i in range(50)]
    assert all(m.sum() == 200 for m in per) and 60 < np.mean([(m > 0).sum() for m in per]) < 180
    assert (rs.multiplicities(200, 7, 3, 20) == per[3]).all() and not (rs.multiplicities(200, 8, 3, 20) == per[3]).all()
    # runs of neighbours: a drawn row's successor is drawn about as often
    assert np.mean([np.abs(np.diff(m)).mean() for m in per]) < 0.35


def test_bootstrap_refits(spark):
    """With every row drawn once a replicate is the plain fit; a pooled fit of one instrument is its own fit."""
    rng = np.random.default_rng(4)
    t = np.arange(200) / 36.5
    temp = 0.3 * t + rng.normal(size=200)
    y = 1 / (1 + np.exp(-(0.2 + 0.3 * temp + rng.normal(size=200) * 0.5)))
    rows = [("a", "x", float(a), float(b), i % 365 + 1, 2.0, float(c)) for i, (a, b, c) in enumerate(zip(t, temp, y, strict=True))]
    df = spark.createDataFrame(rows, "site string, instrument string, time double, temperature double, doy int, n_samples double, y double")
    fit = rs.fit_response(df, ["site"], 4).first()
    basis = np.array(df.select(fn.fourier_basis("doy", 4).alias("b")).toPandas()["b"].tolist())
    data = {"time": t, "temperature": temp, "y": np.clip(y, 0.01, 0.99), "n": np.full(200, 2.0), "basis": basis}
    one = rs._fit_replicate(np.ones(200, int), data, 4, False, 100, 1e-9)
    assert one == pytest.approx([fit.coef[1], fit.coef[2], fit.mme_trend, fit.mme_anom], rel=1e-6)
    b = rs.block_bootstrap(df, ["site"], terms=4, replicates=120).toPandas()
    assert sorted(b.replicate) == list(range(120)) and abs(b.slope_anom.mean() - fit.coef[2]) < 0.1
    m = rs.meta_response(df, ["site"], terms=4, replicates=60, min_replicates=10).first()
    assert m.mme_anom == pytest.approx(fit.mme_anom, rel=1e-9) and m.n_replicates == 60 and m.mme_anom_lower < m.mme_anom < m.mme_anom_upper


def test_separable_series_is_flagged(spark):
    """A fit that can't come to rest has no coefficients and does not disturb the others."""
    rng = np.random.default_rng(5)
    rows = [("flat", [1.0, 1.0], float(rng.uniform(0.2, 0.8)), 3.0) for _ in range(30)] + [("good", [1.0, float(i)], float(rng.uniform(0.2, 0.8)), 3.0) for i in range(30)]
    f = {r.site: r for r in rs.quasibinomial(spark.createDataFrame(rows, "site string, x array<double>, y double, n_samples double"), ["site"], 2).collect()}
    assert f["flat"].coef is None and not f["flat"].converged and f["good"].converged and len(f["good"].coef) == 2
    few = {r.site: r for r in rs.quasibinomial(spark.createDataFrame(rows[30:], "site string, x array<double>, y double, n_samples double"), ["site"], 2, max_rounds=1).collect()}
    assert few["good"].coef is None and not few["good"].converged


def test_bootstrap_p(spark):
    df = spark.createDataFrame([("a", v, w) for v, w in ((1.0, 1.0), (2.0, -1.0), (3.0, 2.0), (4.0, -2.0))], "site string, v double, w double")
    r = rs.bootstrap_ci(df, ["site"], ["v", "w"]).first()
    assert (r.v_p, r.w_p) == (0.0, 1.0)


def test_error_line(spark):
    """Published straight-line data with errors in both axes: the known best slope and intercept."""
    x = [0.0, 0.9, 1.8, 2.6, 3.3, 4.4, 5.2, 6.1, 6.5, 7.4]
    y = [5.9, 5.4, 4.4, 4.6, 3.5, 3.7, 2.8, 2.8, 2.4, 1.5]
    wx = [1000, 1000, 500, 800, 200, 80, 60, 20, 1.8, 1]
    wy = [1, 1.8, 4, 8, 20, 20, 70, 70, 100, 500]
    df = spark.createDataFrame([("p", a, b, c**-0.5, d**-0.5) for a, b, c, d in zip(x, y, wx, wy, strict=True)], "k string, x double, y double, sx double, sy double")
    r = cp.xy_error_line(df, ["k"], "x", "y", "sx", "sy").first()
    assert r.slope == pytest.approx(-0.480533407, abs=1e-6) and r.intercept == pytest.approx(5.47991022, abs=1e-5)
    assert r.residual_variance == pytest.approx(11.8663531941 / 8, rel=1e-6) and r.converged
    few = cp.xy_error_line(df, ["k"], "x", "y", "sx", "sy", max_rounds=1).first()
    assert not few.converged and few.slope is None and few.intercept_sd is None and few.n == 10


def test_monte_carlo_and_interp(spark):
    xp, fp = F.array(*[F.lit(v) for v in (0.0, 1.0, 3.0)]), F.array(*[F.lit(v) for v in (10.0, 20.0, 0.0)])
    got = [one(spark, fn.interp(F.lit(v), xp, fp)) for v in (-1.0, 0.5, 1.0, 2.0, 9.0)]
    assert got == pytest.approx(list(np.interp([-1, 0.5, 1, 2, 9], [0, 1, 3], [10, 20, 0])))
    q = spark.createDataFrame([("s1", "d", [0.0, 1.0]), ("s2", "d", [2.0, 4.0])], "site string, dataset string, quantiles array<double>")
    m = cp.mean_distribution(q, ["site", "dataset"], ["dataset"], 25_000, seed=1).first()
    assert m["mean"] == pytest.approx(1.75, abs=0.02) and m.n_draws == 25_000 and m.n_sites == 2


def test_monte_carlo_does_not_hang_on_partitions_or_blocks(spark, monkeypatch):
    rows = [(f"s{i}", d, [float(i), i + 1.5, i + 2.0]) for i in range(7) for d in ("d", None)] + [("void", "d", None)]
    q = spark.createDataFrame(rows, "site string, dataset string, quantiles array<double>")
    fit = lambda x, **o: {r.dataset: r[1:] for r in cp.mean_distribution(x, ["site", "dataset"], ["dataset"], 3000, **o).collect()}
    one = fit(q, seed=3)
    assert set(one) == {"d", None} and all(r[2:4] == (7, 3000) for r in one.values())
    monkeypatch.setattr(cp, "SITE_BLOCK", 2)
    monkeypatch.setattr(cp, "DRAW_CHUNK", 1 << 16)
    for k, v in fit(q.repartition(5), seed=3).items():
        assert v == pytest.approx(one[k], rel=1e-12)
    even = fit(q, stratified=True)["d"]
    u = (np.arange(3000) + 0.5) / 3000
    m = np.mean([np.interp(u, [0, 0.5, 1], r[2]) for r in rows[:14:2]], axis=0)
    assert even[0] == pytest.approx(m.mean()) and even[4:] == pytest.approx(np.quantile(m, cp.INTERVALS["proper"]).tolist())


def test_discover_files(spark, tmp_path):
    for n in ("s1/x_20010102.nc", "s1/x_20011399.nc", "s2/readme.txt"):
        p = tmp_path / n
        p.parent.mkdir(exist_ok=True)
        p.write_text("x")
    d = cat.discover(spark, str(tmp_path), "*.nc")
    assert set(d.columns) == {"path", "length", "modificationTime"}
    assert [str(r.d) for r in d.select(cat.date_from_name("path").alias("d")).where("d is not null").collect()] == ["2001-01-02"]


def test_guards(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "site string, lat double, lon double")
    with pytest.raises(ValueError, match="altitude, country"):
        tb.read_sites(df, ["country", "altitude"])
    with pytest.raises(Exception, match="unknown site: z"):
        tb.site_coordinates(df, spark.createDataFrame([("z",)], "site string")).collect()
    with pytest.raises(Exception, match="duplicated key: a"):
        so.require_unique(df.union(df), ["site"]).collect()
    with pytest.raises(ValueError, match="duplicated columns"):
        cl.harmonise_names(spark.createDataFrame([(1, 2, 3)], "time int, backscatter int, beta_raw int"))


def test_positions_of_a_hot_series(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("k"), F.pmod(F.xxhash64("id"), F.lit(100000)).alias("t"), "id")
    got = so.series_positions(df, ["k"], ["t", "id"])
    want = sorted((r.k, r.t, r.id) for r in df.collect())
    pos = {}
    for k, t, i in want:
        pos[k] = pos.get(k, 0) + 1
    ranked = sorted((r.k, r.pos, r.t, r.id) for r in got.collect())
    assert [(k, t, i) for k, _, t, i in ranked] == want
    assert [p for k, p, *_ in ranked if k == "hot"] == list(range(1, pos["hot"] + 1))


def test_running_mean_short_series(spark):
    rows = [("a", dt.date(2001, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(5)] + [("b", dt.date(2001, 1, 1), 1.0)]
    r = ag.running_mean(spark.createDataFrame(rows, "site string, date date, value double"), ["site"]).orderBy("date").collect()
    assert [x.running for x in r] == [1.0, 1.5, 2.0, 2.5, 3.0]


def test_regression_by_factors(spark, monkeypatch):
    """Blocks of few rows, NULL keys and a nearly collinear column give numpy's weighted fit; a singular one gives NULL."""
    rng = np.random.default_rng(11)
    rows = []
    for key, wobble in (("a", 1.0), (None, 1.0), ("near", 1e-6), ("singular", 0.0)):
        for i in range(200):
            t = i / 200
            x = [1.0, t, t + wobble * rng.normal()]
            rows.append((key, x, float(1 / (1 + np.exp(-(0.3 + 0.8 * t + 0.1 * rng.normal())))), float(rng.integers(5, 20))))
    df = spark.createDataFrame(rows, "k string, x array<double>, y double, n_samples double").repartition(5)
    monkeypatch.setattr(rs, "BLOCK_ROWS", 7)
    got = {r.k: r for r in rs.quasibinomial(df, ["k"], 3).collect()}
    assert set(got) == {"a", None, "near", "singular"} and got["singular"].coef is None and not got["singular"].converged
    for key in ("a", None, "near"):
        mine = [r for r in rows if r[0] == key]
        x, y, n = (np.array([r[i] for r in mine]) for i in (1, 2, 3))
        b = np.zeros(3)
        for _ in range(50):
            mu = 1 / (1 + np.exp(-(x @ b)))
            w = np.sqrt(n * mu * (1 - mu))
            b = np.linalg.lstsq(w[:, None] * x, w * (x @ b + (y - mu) / (mu * (1 - mu))), rcond=1e-15)[0]
        assert got[key].converged and got[key].rows == 200
        assert x @ np.array(got[key].coef) == pytest.approx(x @ b, abs=1e-7)
