"""Trend statistics on daily series of the orders table (3-day bins)."""

from pyspark.sql import functions as F

from ..core import cut, r6
from ..functions.scalar import normal_ppf
from ..operators import aggregate as ag
from ..operators import trend as tr
from . import trend_sql as ts
from .inputs import OFF, ORD, R, orders_series, with_
from .q_functions import SEASON, cdf_sql
from .registry import query

RES = 1e-6

# 3-day bins per site and instrument: daily mean, min fraction, empty bins as NULL rows
BINS = """dd AS (SELECT site, instrument, date, avg(value) AS value FROM o GROUP BY ALL),
og AS (SELECT site, instrument, min(date) AS origin FROM dd GROUP BY ALL),
bb AS (SELECT site, instrument, origin + CAST(((date - origin) // 3) * 3 AS INTEGER) AS bin, CASE WHEN count(value) >= 0.5 * count(*) THEN avg(value) END AS value FROM dd JOIN og USING (site, instrument) GROUP BY ALL),
rg AS (SELECT site, instrument, unnest(range(min(bin), max(bin) + 1, INTERVAL 3 DAY)) AS bin FROM bb GROUP BY site, instrument),
b3 AS (SELECT rg.site, rg.instrument, CAST(rg.bin AS DATE) AS date, bb.value FROM rg LEFT JOIN bb ON rg.site = bb.site AND rg.instrument = bb.instrument AND rg.bin = bb.bin)"""
# one series per site, strata = instrument and season
SER = BINS + f""",
sr AS (SELECT site, instrument || '|' || {SEASON} AS st, instrument AS inst, date - DATE '1970-01-01' AS t, date, value AS y FROM b3)"""


def binned(spark, sf, freq="3day"):
    daily = orders_series(spark, sf).groupBy("site", "instrument", "date").agg(F.avg("value").alias("value"))
    return ag.calendar_bins(daily, ["site", "instrument"], freq).withColumnRenamed("bin", "date")


def series(spark, sf):
    return tr.prepare(binned(spark, sf), ["site"], "date", "value", "instrument", True, True)


@query("jn_pairs_self", with_(ORD, SER, ts.stats("k", "sr", "site")) + """SELECT site, st AS stratum, CAST(count(*) AS BIGINT) AS n_pairs,
 CAST(sum(sg) AS BIGINT) AS s, CAST(sum(CASE WHEN sg > 0 THEN 1 ELSE 0 END) + sum(CASE WHEN sg < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_untied FROM k_p GROUP BY site, st""")
def jn_pairs_self(spark, sf):
    """Comparable pairs per stratum with S; untied pairs from S of values and of negated ranks (no pair is formed)."""
    d, _ = series(spark, sf)
    st = tr.mk_strata(d, ["site"], "_strat", "_t", "_y", RES)
    # pairs tied in value but not in time: pairs with equal value minus pairs equal in both
    obs = d.where("_y is not null").withColumn("_q", F.rint(F.col("_y") / RES))
    c2 = F.expr("sum(cast(c * (c - 1) / 2 as bigint))")
    same_v = obs.groupBy("site", "_strat", "_q").agg(F.count(F.lit(1)).alias("c")).groupBy("site", "_strat").agg(c2.alias("tv"))
    same_vt = obs.groupBy("site", "_strat", "_q", "_t").agg(F.count(F.lit(1)).alias("c")).groupBy("site", "_strat").agg(c2.alias("tvt"))
    out = st.join(same_v, ["site", "_strat"]).join(same_vt, ["site", "_strat"])
    return out.where("n_pairs > 0").select("site", F.col("_strat").alias("stratum"), "n_pairs", "s", (F.col("n_pairs") - F.col("tv") + F.col("tvt")).alias("n_untied"))


@query("ag_tie_counts", with_(ORD, "sr AS (SELECT site, instrument AS st, date - DATE '1970-01-01' AS t, value AS y FROM o)",
       "vt AS (SELECT site, st, round_even(y / 1000e0, 0) q, CAST(count(*) AS BIGINT) c FROM sr GROUP BY ALL)",
       "tt AS (SELECT site, st, t, CAST(count(*) AS BIGINT) c FROM sr GROUP BY ALL)",
       "a AS (SELECT site, st, CAST(sum(c) AS BIGINT) n, CAST(sum(c*(c-1)*(2*c+5)) AS DOUBLE) v5, CAST(sum(c*(c-1)) AS DOUBLE) v2 FROM vt GROUP BY ALL)",
       "b AS (SELECT site, st, CAST(sum(c*(c-1)*(2*c+5)) AS DOUBLE) t5, CAST(sum(c*(c-1)) AS DOUBLE) t2 FROM tt GROUP BY ALL)") +
       "SELECT site, st AS instrument, n, v5, v2, t5, t2 FROM a JOIN b USING (site, st)")
def ag_tie_counts(spark, sf):
    """Tie sums of raw (unbinned) values on a coarse resolution grid and of equal dates."""
    d, _ = tr.prepare(orders_series(spark, sf), ["site"], "date", "value", "instrument", True, False)
    t = tr.tie_statistics(d, ["site"], "_strat", "_t", "_y", 1000.0)
    return t.select("site", F.col("_strat").alias("instrument"), "n", "v5", "v2", "t5", "t2")


@query("tr_strata", with_(ORD, SER) + "SELECT site, st AS stratum, CAST(count(y) AS BIGINT) AS n FROM sr GROUP BY ALL")
def tr_strata(spark, sf):
    d, _ = series(spark, sf)
    return d.groupBy("site", F.col("_strat").alias("stratum")).agg(F.count("_y").alias("n"))


@query("tr_mk_s", with_(ORD, SER, ts.stats("k", "sr", "site")) + "SELECT site, st AS stratum, CAST(sum(sg) AS BIGINT) AS s FROM k_p GROUP BY ALL")
def tr_mk_s(spark, sf):
    d, _ = series(spark, sf)
    return tr.pair_counts(d, ["site"], "_strat", "_t", "_y", RES).select("site", F.col("_strat").alias("stratum"), "s")


@query("tr_mk_var", with_(ORD, "sr AS (SELECT site, instrument AS st, date - DATE '1970-01-01' AS t, value AS y FROM o)",
                          ts.stats("k", "sr", "site", res="1000e0")) + f"SELECT site, st AS instrument, {R('var', 4)} AS var FROM k_v")
def tr_mk_var(spark, sf):
    """Variance with many ties: raw orders, coarse value grid, several orders per date."""
    d, _ = tr.prepare(orders_series(spark, sf), ["site"], "date", "value", "instrument", True, False)
    t = tr.tie_statistics(d, ["site"], "_strat", "_t", "_y", 1000.0)
    var = tr.kendall_variance(*[F.col(c) for c in ("n", "v5", "v3", "v2", "t5", "t3", "t2")])
    return t.select("site", F.col("_strat").alias("instrument"), r6(var, 4).alias("var"))


@query("tr_mk_stratified", with_(ORD, SER, ts.stats("k", "sr", "site")) + f"SELECT site, n, s, {R('var', 4)} AS var, n_pairs FROM k")
def tr_mk_stratified(spark, sf):
    d, _ = series(spark, sf)
    return tr.mk_series(d, ["site"], "_strat", "_t", "_y", RES).select("site", "n", "s", r6("var", 4).alias("var"), "n_pairs")


@query("tr_mk_test", with_(ORD, SER, ts.stats("k", "sr", "site")) + f"""SELECT site, n, {R('z')} AS z, {R('2e0 * (1e0 - ' + cdf_sql('abs(z)') + ')')} AS p,
 CAST(CASE WHEN 2e0 * (1e0 - {cdf_sql('abs(z)')}) <= 0.05e0 THEN 95 ELSE 0 END AS BIGINT) AS ss FROM k""")
def tr_mk_test(spark, sf):
    d, _ = series(spark, sf)
    st = tr.mk_test(tr.mk_series(d, ["site"], "_strat", "_t", "_y", RES))
    return st.select("site", "n", r6("z").alias("z"), r6("p").alias("p"), F.col("ss").cast("bigint").alias("ss"))


@query("tr_sen_slope", with_(ORD, SER, ts.stats("k", "sr", "site")) +
       f"SELECT site, CAST(count(*) AS BIGINT) AS n_pairs, {R('median(dy / dt) * ' + ts.YEAR, 4)} AS slope FROM k_p GROUP BY site")
def tr_sen_slope(spark, sf):
    d = cut(series(spark, sf)[0])
    st = tr.mk_series(d, ["site"], "_strat", "_t", "_y", RES)
    return tr.sen_slope(d, ["site"], "_strat", "_t", "_y", st).select("site", "n_pairs", r6("slope", 4).alias("slope"))


def _z(a):
    return -normal_ppf((1.0 - a / 100.0) / 2.0)


def ci_sql(stats: str, rank: str, keys: str, alphas) -> str:
    parts = []
    for a in alphas:
        for side, k in zip(("lower", "upper"), ts.bounds(_z(a)), strict=True):
            parts.append(f"SELECT {keys}, CAST({a!r} AS DOUBLE) AS alpha, '{side}' AS side, {k} AS rn FROM {stats}")
    pick = lambda s: R(f"max(CASE WHEN side = '{s}' THEN slope END) * " + ts.YEAR, 3)
    return (f"SELECT {keys}, alpha, {pick('lower')} AS lower, {pick('upper')} AS upper FROM (" + " UNION ALL ".join(parts)
            + f") w JOIN {rank} USING ({keys}, rn) GROUP BY {keys}, alpha")


@query("tr_sen_ci", with_(ORD, SER, ts.stats("k", "sr", "site"), ts.ranked("r", "k_p", "site")) + ci_sql("k", "r", "site", tr.SIGMA_LEVELS))
def tr_sen_ci(spark, sf):
    d = cut(series(spark, sf)[0])
    st = tr.mk_series(d, ["site"], "_strat", "_t", "_y", RES)
    out = tr.sen_slope(d, ["site"], "_strat", "_t", "_y", st, alphas=tr.SIGMA_LEVELS)
    return out.select("site", F.inline("ci")).select("site", "alpha", r6("lower", 3).alias("lower"), r6("upper", 3).alias("upper"))


@query("win_lag_autocorr", with_(ORD, SER, "l AS (SELECT site, inst, y, lag(y) OVER (PARTITION BY site, inst ORDER BY t) ly FROM sr)") +
       f"SELECT site, inst AS instrument, {R('corr(y, ly)')} AS r, CAST(count(y) AS BIGINT) AS n FROM l GROUP BY site, inst")
def win_lag_autocorr(spark, sf):
    d, _ = series(spark, sf)
    return tr.lag_autocorrelation(d, ["site", "_inst"], "_t", "_y").select("site", F.col("_inst").alias("instrument"), r6("r").alias("r"), "n")


# Series with real autocorrelation for the prewhitening checks: an accumulated 20-bin mean of the binned values.
SMOOTH = SER + """,
sm AS (SELECT site, inst, t, st, CASE WHEN y IS NOT NULL THEN avg(y) OVER (PARTITION BY site, inst ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS y FROM sr)"""
Z95 = normal_ppf(0.975)


def variants_sql(src: str, keys: str = "site", p: str = "") -> str:
    """CTEs up to {p}pv: the prewhitened variants of source rows ({keys}, inst, st, t, y)."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ak = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{p}l1 AS (SELECT *, t - min(t) OVER (PARTITION BY {keys}, inst) AS rt, lag(y) OVER w AS ly FROM {src} WINDOW w AS (PARTITION BY {keys}, inst ORDER BY t)),
{p}l2 AS (SELECT *, CAST(rt AS DOUBLE) * 86400e0 AS tr, lag(CAST(rt AS DOUBLE) * 86400e0) OVER (PARTITION BY {keys}, inst ORDER BY t) AS ltr FROM {p}l1),
{p}f1 AS (SELECT {keys}, inst, CASE WHEN isnan(corr(y, ly)) THEN NULL ELSE corr(y, ly) END AS r1, count(y) AS n, var_samp(y) AS vy FROM {p}l2 GROUP BY ALL),
{p}f2 AS (SELECT *, coalesce(n >= 5 AND abs(r1) >= {Z95!r} / sqrt(n) AND r1 < 0.999e0, false) AS use FROM {p}f1),
{p}gp AS (SELECT {ak}, a.inst, median((b.y - a.y) / ((b.t - a.t) * 86400e0)) AS b0 FROM {src} a JOIN {src} b ON {on} AND a.inst = b.inst AND a.t < b.t
 WHERE a.y IS NOT NULL AND b.y IS NOT NULL GROUP BY ALL),
{p}l3 AS (SELECT l.*, r1, n, vy, use, b0, y - b0 * tr AS dt, ly - b0 * ltr AS ldt FROM {p}l2 l JOIN {p}f2 USING ({keys}, inst) LEFT JOIN {p}gp USING ({keys}, inst)),
{p}f3 AS (SELECT {keys}, inst, CASE WHEN isnan(corr(dt, ldt)) THEN NULL ELSE corr(dt, ldt) END AS r2 FROM {p}l3 GROUP BY ALL),
{p}l4 AS (SELECT l.*, r2, CASE WHEN coalesce(n >= 5 AND abs(r2) >= {Z95!r} / sqrt(n), false) THEN dt - r2 * ldt ELSE dt END AS a FROM {p}l3 l JOIN {p}f3 USING ({keys}, inst)),
{p}f4 AS (SELECT {keys}, inst, var_samp(a) AS va FROM {p}l4 GROUP BY ALL),
{p}pv AS (SELECT {keys}, inst, st, t, y, CASE WHEN use THEN y - r1 * ly ELSE y END AS pw, CASE WHEN use THEN (y - r1 * ly) / (1e0 - r1) ELSE y END AS pw_cor,
 CASE WHEN use THEN a + b0 * tr ELSE y END AS tfpw_y,
 CASE WHEN use THEN a * (CASE WHEN va <> 0 THEN vy / va ELSE 1e0 END) + (CASE WHEN r2 >= 0 AND r2 < 1 THEN b0 / sqrt((1e0 + r2) / (1e0 - r2)) ELSE b0 END) * tr ELSE y END AS vctfpw
 FROM {p}l4 JOIN {p}f4 USING ({keys}, inst))"""


VARIANTS = SMOOTH + ",\n" + variants_sql("sm")


def smoothed(spark, sf):
    from pyspark.sql import Window as W

    d, unit = series(spark, sf)
    w = W.partitionBy("site", "_inst").orderBy("_t").rowsBetween(-3, 0)
    return d.withColumn("_y", F.when(F.col("_y").isNotNull(), F.avg("_y").over(w))), unit


def smoothed_table(spark, sf):
    """The same series with a date column, as input of the whole estimator."""
    d, _ = smoothed(spark, sf)
    return cut(d.select("site", F.col("_inst").alias("instrument"), F.expr("date_add(date'1970-01-01', cast(_t as int))").alias("date"), F.col("_y").alias("value")))


@query("win_prewhiten", with_(ORD, VARIANTS) + f"SELECT site, inst AS instrument, t, {R('pw', 4)} AS pw FROM pv")
def win_prewhiten(spark, sf):
    d, _ = smoothed(spark, sf)
    return tr.prewhiten(d, ["site", "_inst"], "_t", "_y").select("site", F.col("_inst").alias("instrument"), F.col("_t").alias("t"), r6("pw", 4).alias("pw"))


@query("tr_prewhiten_variants", with_(ORD, VARIANTS) +
       f"SELECT site, inst AS instrument, t, {R('pw', 3)} AS pw, {R('pw_cor', 3)} AS pw_cor, {R('tfpw_y', 3)} AS tfpw_y, {R('vctfpw', 3)} AS vctfpw FROM pv")
def tr_prewhiten_variants(spark, sf):
    d, unit = smoothed(spark, sf)
    v = tr.prewhitening_variants(cut(d), ["site"], "_inst", "_t", "_y", unit)
    return v.select("site", F.col("_inst").alias("instrument"), F.col("_t").alias("t"), *[r6(c, 3).alias(c) for c in ("pw", "pw_cor", "tfpw_y", "vctfpw")])


P = "greatest(0e0, 2e0 * (1e0 - {c}))"


def fit_sql(src: str, keys: str = "site") -> str:
    """CTEs of the whole 3PW estimator on {src}: k_pw, k_tfpw_y, k_vctfpw, decision d4, median slope sl."""
    st = ",\n".join(ts.stats(f"k_{n}", "pv", keys, y=n) for n in ("pw", "tfpw_y", "vctfpw"))
    return f"""{variants_sql(src, keys)},
{st},
d3 AS (SELECT {keys}, a.n AS n1, b.n AS n2, {P.format(c=cdf_sql('abs(a.z)'))} AS p1, {P.format(c=cdf_sql('abs(b.z)'))} AS p2 FROM k_pw a JOIN k_tfpw_y b USING ({keys})),
d4 AS (SELECT {keys}, greatest(p1, p2) AS p, CAST(CASE WHEN p1 <= 0.05e0 AND p2 <= 0.05e0 THEN 95 WHEN p2 <= 0.05e0 THEN -1 WHEN p1 <= 0.05e0 THEN -2 ELSE 0 END AS BIGINT) AS ss FROM d3),
r AS (SELECT {keys}, dy / dt AS slope, row_number() OVER (PARTITION BY {keys} ORDER BY dy / dt) - 1 AS rn FROM k_vctfpw_p),
sl AS (SELECT {keys}, median(dy / dt) AS slope FROM k_vctfpw_p GROUP BY {keys})"""


FIT = SMOOTH + ",\n" + fit_sql("sm")


@query("tr_3pw_decide", with_(ORD, FIT) + f"SELECT site, {R('p')} AS p, ss FROM d4")
def tr_3pw_decide(spark, sf):
    _, stats, _, _ = tr.fit_parts(smoothed_table(spark, sf), ["site"], "date", "value", "instrument")
    return tr.decide_3pw(stats, ["site"]).select("site", r6("p").alias("p"), F.col("ss").cast("bigint").alias("ss"))


@query("tr_fit", with_(ORD, FIT, "ci AS (" + ci_sql("k_vctfpw", "r", "site", (90.0,)) + ")") +
       f"""SELECT site, n, {R('p')} AS p, ss, {R('slope * ' + ts.YEAR, 3)} AS slope, lower, upper
 FROM d4 JOIN k_vctfpw USING (site) JOIN sl USING (site) JOIN ci USING (site)""")
def tr_fit(spark, sf):
    out = tr.mann_kendall(smoothed_table(spark, sf), ["site"], "date", "value", "instrument")
    return out.select("site", "n", r6("p").alias("p"), F.col("ss").cast("bigint").alias("ss"), r6("slope", 3).alias("slope"),
                      r6(F.col("ci")[0]["lower"], 3).alias("lower"), r6(F.col("ci")[0]["upper"], 3).alias("upper"))


@query("tr_tfpw_ws")
def tr_tfpw_ws(spark, sf):
    """Iterative variant; no SQL form (checked against brute force in the tests)."""
    d, unit = smoothed(spark, sf)
    v = tr.prewhitening_variants(d, ["site"], "_inst", "_t", "_y", unit, iterate=True)
    return v.select("site", F.col("_inst").alias("instrument"), F.col("_t").alias("t"), r6("tfpw_ws", 3).alias("tfpw_ws"))


QF_POINTS = 20001
_eps = 1e-6
_grid = [min(100.0 - _eps, _eps + (100.0 - 2 * _eps) / (QF_POINTS - 1) * i) for i in range(QF_POINTS)]
GRID_SQL = "gd AS (SELECT unnest([" + ", ".join(f"{a!r}" for a in _grid) + "]::DOUBLE[]) AS alpha, unnest([" + ", ".join(
    f"{-normal_ppf((1.0 - a / 100.0) / 2.0)!r}" for a in _grid) + "]::DOUBLE[]) AS z)"
QF = f"""SELECT k.site, (100e0 - alpha) / 200e0 AS pl, CAST(greatest(round_even((n_pairs - gd.z * sqrt(var)) / 2e0, 0) - 1, 0) AS BIGINT) AS rn FROM k, gd
 UNION ALL SELECT k.site, (100e0 + alpha) / 200e0, CAST(least(round_even((n_pairs + gd.z * sqrt(var)) / 2e0, 0), n_pairs - 1) AS BIGINT) FROM k, gd
 UNION ALL SELECT site, 0.5e0, (n_pairs - 1) // 2 FROM k UNION ALL SELECT site, 0.5e0, n_pairs // 2 FROM k"""
QF_SQL = with_(ORD, SER, ts.stats("k", "sr", "site"), ts.ranked("r", "k_p", "site"), GRID_SQL, f"w AS ({QF})")


def _quantiles(spark, sf):
    d = cut(series(spark, sf)[0])
    st = cut(tr.mk_series(d, ["site"], "_strat", "_t", "_y", RES))
    return tr.quantile_function(d, ["site"], "_strat", "_t", "_y", st, QF_POINTS), st


@query("tr_quantile_function", QF_SQL + f"SELECT site, {R('pl', 6)} AS probability_level, {R('avg(slope) * ' + ts.YEAR + f' + {OFF}', 3)} AS quantile_value_per_year FROM w JOIN r USING (site, rn) GROUP BY site, pl")
def tr_quantile_function(spark, sf):
    q, _ = _quantiles(spark, sf)
    return q.select("site", r6("probability_level", 6).alias("probability_level"), r6(F.col("quantile_value_per_year") + OFF, 3).alias("quantile_value_per_year"))


@query("snk_distribution", QF_SQL + f"SELECT 'orders' AS dataset, site, '_all' AS suffix, 'raw' AS series_key, {R('pl', 6)} AS probability_level, {R('avg(slope) * ' + ts.YEAR + f' + {OFF}', 3)} AS quantile_value_per_year, CAST(max(k.n_pairs) AS BIGINT) AS n_slopes, CAST(max(k.n) AS BIGINT) AS n_samples, {R('max(k.var)', 3)} AS kendall_variance FROM w JOIN r USING (site, rn) JOIN k USING (site) GROUP BY site, pl")
def snk_distribution(spark, sf):
    """Distribution table written by dataset and site and read back."""
    from ..sources import sinks

    q, st = _quantiles(spark, sf)
    out = sinks.distribution_table(q, st, ["site"], "orders", "_all", "raw")
    back = sinks.write_and_read(out, "distribution", ["dataset", "suffix"])
    return back.select("dataset", "site", "suffix", "series_key", r6("probability_level", 6).alias("probability_level"),
                       r6(F.col("quantile_value_per_year") + OFF, 3).alias("quantile_value_per_year"), "n_slopes", "n_samples", r6("kendall_variance", 3).alias("kendall_variance"))


@query("src_slope_distribution", QF_SQL + f"SELECT site, {R('pl', 6)} AS probability_level, {R('avg(slope) * ' + ts.YEAR + f' + {OFF}', 3)} AS quantile_value_per_year FROM w JOIN r USING (site, rn) WHERE site = '1-URGENT' GROUP BY site, pl")
def src_slope_distribution(spark, sf):
    from ..sources import sinks

    q, st = _quantiles(spark, sf)
    path = sinks.write_table(sinks.distribution_table(q, st, ["site"], "orders", "_all", "raw"), "distribution", ["dataset", "suffix", "site"])
    got = sinks.load_distribution(spark, path, "orders", "1-URGENT", "_all")
    return got.select("site", r6("probability_level", 6).alias("probability_level"), r6(F.col("quantile_value_per_year") + OFF, 3).alias("quantile_value_per_year"))


# --- whole trend products: one job for all series ---------------------------------------------------

KEYED = SER + """,
sq AS (SELECT 'orders' AS dataset, 'all' AS condition, * FROM sr)"""
TREND = fit_sql("sq", "dataset, condition, site")
WIDE = ", ".join(f"max(CASE WHEN alpha = {a!r} THEN lower END) AS lower_{i + 1}s, max(CASE WHEN alpha = {a!r} THEN upper END) AS upper_{i + 1}s"
                 for i, a in enumerate(tr.SIGMA_LEVELS))
SITE_SQL = with_(ORD, KEYED, TREND, "ci0 AS (" + ci_sql("k_vctfpw", "r", "dataset, condition, site", tr.SIGMA_LEVELS) + ")",
                 f"ci AS (SELECT dataset, condition, site, {WIDE} FROM ci0 GROUP BY ALL)",
                 "nd AS (SELECT dataset, condition, site, CAST(count(DISTINCT CASE WHEN y IS NOT NULL THEN t END) AS BIGINT) AS n_days FROM sq GROUP BY ALL)",
                 f"""tt AS (SELECT dataset, condition, site, n_days, {R('p')} AS p, ss, {R('slope * ' + ts.YEAR, 3)} AS slope, {R('(upper_1s - lower_1s) / 2', 2)} AS std,
 lower_1s, upper_1s, lower_2s, upper_2s, lower_3s, upper_3s FROM d4 JOIN sl USING (dataset, condition, site) JOIN ci USING (dataset, condition, site) JOIN nd USING (dataset, condition, site))""")


def site_trends(spark, sf):
    d = cut(binned(spark, sf).select(F.lit("orders").alias("dataset"), F.lit("all").alias("condition"), "site", "instrument", "date", "value"))
    return tr.trend_table(d, ["dataset", "condition", "site"])


def _round_trends(t):
    ends = [f"{e}_{i}s" for i in (1, 2, 3) for e in ("lower", "upper")]
    return t.withColumns({"p": r6("p"), "ss": F.col("ss").cast("bigint"), "slope": r6("slope", 3), "std": r6(F.round("std", 3), 2),
                          **{e: r6(e, 3) for e in ends}}).drop("reason", "n")


@query("tr_site_trends", SITE_SQL + "SELECT * REPLACE (round(std, 1) AS std) FROM tt")
def tr_site_trends(spark, sf):
    return _round_trends(site_trends(spark, sf)).withColumn("std", F.round("std", 1))


@query("tr_relative", SITE_SQL.rstrip() + """,
cm AS (SELECT site, avg(value) AS clim FROM dd GROUP BY site)
SELECT dataset, condition, site, """ + f"{R('slope / clim', 5)} AS slope_rel, {R('std / abs(clim)', 4)} AS std_rel, {R('lower_2s / clim', 5)} AS lower_2s_rel, {R('upper_2s / clim', 5)} AS upper_2s_rel FROM tt JOIN cm USING (site)")
def tr_relative(spark, sf):
    clim = ag.climatology_summaries(orders_series(spark, sf).groupBy("site", "instrument", "date").agg(F.avg("value").alias("value")), ["site"])
    t = _round_trends(site_trends(spark, sf))
    rel = tr.relative(t, clim.where("kind = 'mean'").select("site", "value"), ["site"], ["slope", "lower_2s", "upper_2s"], ["std"])
    return rel.select("dataset", "condition", "site", r6("slope_rel", 5).alias("slope_rel"), r6("std_rel", 4).alias("std_rel"),
                      r6("lower_2s_rel", 5).alias("lower_2s_rel"), r6("upper_2s_rel", 5).alias("upper_2s_rel"))


SEGS = SER + f""",
sg AS (SELECT sr.site, 'month' AS kind, CAST(month(date) AS VARCHAR) AS segment, inst, inst AS st, t, y FROM sr UNION ALL
 SELECT sr.site, 'season' AS kind, {SEASON} AS segment, inst, inst AS st, t, y FROM sr),
sg2 AS (SELECT sg.* FROM sg JOIN (SELECT site, kind, segment FROM sg WHERE y IS NOT NULL GROUP BY ALL HAVING count(DISTINCT t) > 10) USING (site, kind, segment))"""
SEG_SQL = with_(ORD, SEGS, fit_sql("sg2", "site, kind, segment"), "ci0 AS (" + ci_sql("k_vctfpw", "r", "site, kind, segment", tr.SIGMA_LEVELS) + ")",
                f"ci AS (SELECT site, kind, segment, {WIDE} FROM ci0 GROUP BY ALL)",
                f"""tt AS (SELECT site, kind, segment, n, {R('p')} AS p, ss, {R('slope * ' + ts.YEAR, 3)} AS slope, lower_1s, upper_1s, lower_2s, upper_2s, lower_3s, upper_3s
 FROM d4 JOIN k_vctfpw USING (site, kind, segment) JOIN sl USING (site, kind, segment) JOIN ci USING (site, kind, segment))""")


def segment_trends(spark, sf):
    ends = [r6(F.col("ci")[i][e], 3).alias(f"{e}_{i + 1}s") for i in range(3) for e in ("lower", "upper")]
    return tr.segment_trends(cut(binned(spark, sf)), ["site"]).select(
        "site", "kind", "segment", "n", r6("p").alias("p"), F.col("ss").cast("bigint").alias("ss"), r6("slope", 3).alias("slope"), *ends)


@query("tr_segment_trends", SEG_SQL + "SELECT * FROM tt")
def tr_segment_trends(spark, sf):
    return segment_trends(spark, sf)


@query("tr_output_assemble", SEG_SQL.rstrip() + """,
gg AS (SELECT * FROM (SELECT DISTINCT site FROM o), (SELECT 'month' AS kind, CAST(unnest(range(1, 13)) AS VARCHAR) AS segment UNION ALL SELECT 'season', unnest(['DJF', 'MAM', 'JJA', 'SON'])))
SELECT gg.site, gg.kind, gg.segment, n, p, ss, slope, lower_1s, upper_1s, lower_2s, upper_2s, lower_3s, upper_3s FROM gg LEFT JOIN tt USING (site, kind, segment)""")
def tr_output_assemble(spark, sf):
    """Full grid of sites and segments with the results where they exist."""
    grid = tr.segment_grid(orders_series(spark, sf).select("site").distinct())
    return grid.join(segment_trends(spark, sf), ["site", "kind", "segment"], "left")
