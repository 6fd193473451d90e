import datetime as dt
import math

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.core import cut
from seriesmith.operators import trend as tr

DAY = 86400.0


def make(spark, n=120, seed=1, ar=0.6, slope=0.01, gaps=True, ties=False):
    rng = np.random.default_rng(seed)
    rows = []
    for site in ("a", "b"):
        for inst in ("x", "y"):
            e, y = 0.0, []
            for i in range(n):
                e = ar * e + rng.normal()
                y.append(e + slope * i)
            for i, v in enumerate(y):
                v = round(v) * 1.0 if ties else v
                rows.append((site, inst, dt.date(2001, 1, 1) + dt.timedelta(days=3 * i), None if gaps and i % 17 == 5 else float(v)))
    df = spark.createDataFrame(rows, "site string, instrument string, date date, value double")
    return df, rows


def test_monotone(spark):
    rows = [("a", dt.date(2001, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "site string, date date, value double")
    d, _ = tr.prepare(df, ["site"], "date", "value")
    r = tr.mk_series(d, ["site"], "_strat", "_t", "_y", 1e-6).first()
    assert (r.s, r.n, r.n_pairs) == (45, 10, 45) and r["var"] == 125.0
    assert r.z == pytest.approx(44 / math.sqrt(125))
    lo, hi = tr.ci_index(F.lit(45), F.lit(125.0), F.lit(1.6448536269514722))
    assert spark.range(1).select(lo, hi).first()[:] == (12, 32)


def test_too_short(spark):
    rows = [("a", dt.date(2001, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(9)]
    d, _ = tr.prepare(spark.createDataFrame(rows, "site string, date date, value double"), ["site"], "date", "value")
    r = tr.mk_test(tr.mk_series(d, ["site"], "_strat", "_t", "_y", 1e-6)).first()
    assert r.p is None and "too few" in r.reason


@pytest.mark.parametrize("ties", [False, True])
def test_statistics_against_pairs(spark, ties):
    df, rows = make(spark, ties=ties)
    # equal times: add copies of some rows with other values
    extra = [(s, i, d, v + 1) for s, i, d, v in rows if v is not None and d.day % 5 == 0]
    df = df.unionByName(spark.createDataFrame(extra, df.schema))
    d, unit = tr.prepare(df, ["site"], "date", "value", "instrument", True, True)
    d = cut(d)
    st = tr.mk_series(d, ["site"], "_strat", "_t", "_y", 1e-6)
    got = {r.site: r for r in tr.sen_slope(d, ["site"], "_strat", "_t", "_y", st, unit, (90.0,)).collect()}
    raw = d.collect()
    for site, r in got.items():
        k = [x for x in raw if x.site == site]
        s, var, sl = brute.kendall([x._t * DAY for x in k], np.array([np.nan if x._y is None else x._y for x in k]), [x._strat for x in k], 1e-6)
        assert (r.s, r.n_pairs) == (s, sl.size)
        assert r["var"] == pytest.approx(var, rel=1e-12)
        assert r.slope == pytest.approx(np.median(sl) * tr.SECONDS_PER_YEAR, rel=1e-12)
        c = 1.6448536269514722 * math.sqrt(var)
        assert r.ci[0].lower == pytest.approx(sl[max(int(np.round((sl.size - c) / 2)) - 1, 0)] * tr.SECONDS_PER_YEAR, rel=1e-12)
        assert r.ci[0].upper == pytest.approx(sl[min(int(np.round((sl.size + c) / 2)), sl.size - 1)] * tr.SECONDS_PER_YEAR, rel=1e-12)


def test_blocks_and_value_blocks_do_not_matter(spark, monkeypatch):
    df, _ = make(spark, ar=0.3)
    d, unit = tr.prepare(df, ["site"], "date", "value", "instrument", False, False)
    d = cut(d)
    st = cut(tr.mk_series(d, ["site"], "_strat", "_t", "_y", 1e-6))
    ranks = st.select("site", F.explode(F.array(F.lit(0), F.lit(7), F.floor(F.col("n_pairs") / 2), F.col("n_pairs") - 1)).alias("k"))
    one = sorted(tr.slope_ranks(d, ["site"], "_strat", "_t", "_y", ranks, unit, 10_000).collect())
    many = sorted(tr.slope_ranks(d, ["site"], "_strat", "_t", "_y", ranks, unit, 17).collect())
    assert len(one) == len(many) == 8 and [r[:2] for r in one] == [r[:2] for r in many]
    assert [r.slope for r in many] == pytest.approx([r.slope for r in one], rel=1e-11)
    monkeypatch.setattr(tr, "VALUE_BLOCK", 5)
    again = tr.mk_series(d, ["site"], "_strat", "_t", "_y", 1e-6)
    assert sorted(again.select("site", "s").collect()) == sorted(st.select("site", "s").collect())


def test_reversal_and_partitions(spark):
    df, _ = make(spark)
    d, _ = tr.prepare(df, ["site"], "date", "value", "instrument", True, False)
    s = lambda x: {tuple(r[:2]): r.s for r in tr.pair_counts(x, ["site"], "_strat", "_t", "_y", 1e-6).collect()}
    fwd, rev = s(d), s(d.withColumn("_t", -F.col("_t")))
    assert fwd == {k: -v for k, v in rev.items()}
    assert fwd == s(d.repartition(13))


def test_variants_and_3pw(spark):
    df, rows = make(spark, n=60, seed=5)
    base, unit = tr.prepare(df, ["site"], "date", "value", "instrument")
    v = tr.prewhitening_variants(cut(base), ["site"], "_inst", "_t", "_y", unit, iterate=True).collect()
    names = ("pw", "pw_cor", "tfpw_y", "tfpw_ws", "vctfpw")
    series = {}
    for site in ("a", "b"):
        for inst in ("x", "y"):
            k = sorted((x for x in v if x.site == site and x._inst == inst), key=lambda x: x._t)
            t = [x._t * DAY for x in k]
            y = np.array([np.nan if x._y is None else x._y for x in k])
            want = brute.variants(t, y)
            for n in names:
                got = np.array([np.nan if x[n] is None else x[n] for x in k])
                np.testing.assert_allclose(got, want[n], rtol=1e-8, atol=1e-8, err_msg=f"{site} {inst} {n}")
            series[site, inst] = (t, want)
    fit = {r.site: r for r in tr.mann_kendall(cut(df), ["site"], "date", "value", "instrument", by_season=False).collect()}
    for site, r in fit.items():
        ps = {}
        for n in ("pw", "tfpw_y", "vctfpw"):
            t = [x for i in ("x", "y") for x in series[site, i][0]]
            y = np.concatenate([series[site, i][1][n] for i in ("x", "y")])
            st = [i for i in ("x", "y") for _ in series[site, i][0]]
            s, var, sl = brute.kendall(t, y, st, 1e-6)
            ps[n] = brute.p_value(s, var)
        assert r.p == pytest.approx(max(ps["pw"], ps["tfpw_y"]), abs=1e-12)
        assert r.slope == pytest.approx(np.median(sl) * tr.SECONDS_PER_YEAR, rel=1e-9)
        both = [ps["pw"] <= 0.05, ps["tfpw_y"] <= 0.05]
        assert r.ss == {(True, True): 95, (False, True): -1, (True, False): -2, (False, False): 0}[tuple(both)]


def test_quantile_function_is_monotone(spark):
    df, _ = make(spark, n=60)
    d, unit = tr.prepare(df, ["site"], "date", "value", "instrument", True, False)
    d = cut(d)
    st = cut(tr.mk_series(d, ["site"], "_strat", "_t", "_y", 1e-6))
    q = tr.quantile_function(d, ["site"], "_strat", "_t", "_y", st, 51, unit).orderBy("site", "probability_level").collect()
    for site in ("a", "b"):
        v = [r.quantile_value_per_year for r in q if r.site == site]
        assert len(v) == 103 and all(a <= b + 1e-9 for a, b in zip(v, v[1:], strict=False))
