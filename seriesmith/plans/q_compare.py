"""Comparison and uncertainty queries on OLS segment trends of the orders table (cheap stand-ins for trend tables)."""

from pyspark.sql import functions as F

from ..core import cut, r6
from ..functions import calendar as cal
from ..operators import aggregate as ag
from ..operators import compare as cp
from ..operators import joins as jn
from .inputs import ORD, R, SITES, orders_series, sites, table, with_
from .q_functions import SEASON
from .registry import query

# one "trend" per dataset (instrument), site and season: OLS slope per year with standard-error bounds
TR = f"""tb AS (SELECT instrument AS dataset, site, {SEASON} AS season, regr_slope(value, (date - DATE '1995-01-01') / 365.25e0) AS slope, stddev_samp(value) / sqrt(count(*)) / 2e0 AS se FROM o GROUP BY ALL),
tr AS (SELECT dataset, site, season, slope, slope - se AS lower_1s, slope + se * 1.1e0 AS upper_1s, slope - 2 * se AS lower_2s, slope + 2.1e0 * se AS upper_2s FROM tb)"""


def trends(spark, sf):
    x = F.datediff("date", F.lit("1995-01-01").cast("date")) / 365.25
    t = orders_series(spark, sf).groupBy(F.col("instrument").alias("dataset"), "site", cal.season("date").alias("season")).agg(
        F.regr_slope("value", x).alias("slope"), (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1))) / 2.0).alias("se"))
    s, e = F.col("slope"), F.col("se")
    return t.select("dataset", "site", "season", "slope", (s - e).alias("lower_1s"), (s + e * 1.1).alias("upper_1s"), (s - e * 2).alias("lower_2s"), (s + e * 2.1).alias("upper_2s"))


SIG = "CASE WHEN slope > 0 THEN lower_{i}s > 0 WHEN slope < 0 THEN upper_{i}s < 0 ELSE false END"


@query("ag_significance_counts", with_(ORD, TR) + f"""SELECT dataset, CAST(count(slope) AS BIGINT) AS n, {R('avg(slope)', 4)} AS mean, CAST(count(*) FILTER (WHERE slope > 0) AS BIGINT) AS positive, CAST(count(*) FILTER (WHERE slope < 0) AS BIGINT) AS negative,
 CAST(count(*) FILTER (WHERE {SIG.format(i=1)}) AS BIGINT) AS significant_68, CAST(count(*) FILTER (WHERE {SIG.format(i=2)}) AS BIGINT) AS significant_95 FROM tr GROUP BY dataset""")
def ag_significance_counts(spark, sf):
    return cp.significance_counts(trends(spark, sf), ["dataset"]).withColumn("mean", r6("mean", 4))


@query("un_ci_significance", with_(ORD, TR) + f"SELECT dataset, site, season, {SIG.format(i=1)} AS sig_68, {SIG.format(i=2)} AS sig_95 FROM tr")
def un_ci_significance(spark, sf):
    f = lambda i: cp.un_significant(F.col("slope"), F.col(f"lower_{i}s"), F.col(f"upper_{i}s"))
    return trends(spark, sf).select("dataset", "site", "season", f(1).alias("sig_68"), f(2).alias("sig_95"))


@query("ag_season_diagnostics", with_(ORD, TR) + f"SELECT coalesce(dataset, 'all') AS dataset, season, CAST(count(slope) AS BIGINT) AS n, {R('avg(slope)', 3)} AS mean, {R('stddev_pop(slope)', 3)} AS std, {R('avg(upper_1s - lower_1s)', 3)} AS mean_w1, {R('avg(upper_2s - lower_2s)', 3)} AS mean_w2 FROM tr GROUP BY GROUPING SETS ((dataset, season), (season))")
def ag_season_diagnostics(spark, sf):
    t = trends(spark, sf).withColumn("w1", F.col("upper_1s") - F.col("lower_1s")).withColumn("w2", F.col("upper_2s") - F.col("lower_2s"))
    d = cp.season_diagnostics(t, widths=["w1", "w2"])
    return d.select("dataset", "season", "n", *[r6(c, 3).alias(c) for c in ("mean", "std", "mean_w1", "mean_w2")])


PAIRS = """pr AS (SELECT a.dataset AS x_set, b.dataset AS y_set, a.slope / 1e3 AS x, b.slope / 1e3 AS y, (a.upper_1s - a.lower_1s) / 2e3 AS sx, (b.upper_1s - b.lower_1s) / 2e3 AS sy
 FROM tr a JOIN tr b USING (site, season) WHERE a.dataset < b.dataset)"""


def _pairs(spark, sf):
    t = trends(spark, sf).select("dataset", "site", "season", (F.col("slope") / 1e3).alias("v"), ((F.col("upper_1s") - F.col("lower_1s")) / 2e3).alias("s"))
    p = jn.dataset_pairs(t, ["site", "season"], "dataset", "v", extra=["s"])
    return p.select("x_set", "y_set", F.col("x_v").alias("x"), F.col("y_v").alias("y"), F.col("x_s").alias("sx"), F.col("y_s").alias("sy"))


@query("ag_pair_stats", with_(ORD, TR, PAIRS) + f"""SELECT x_set, y_set, CAST(count(*) AS BIGINT) AS n, {R('sqrt(avg((y - x) * (y - x)))')} AS rmse, {R('corr(x, y)')} AS r, {R('sum((y - x) * (y - x) / (sx * sx + sy * sy))', 5)} AS chi2, {R('avg(y - x)')} AS bias,
 {R('corr(x, y) * corr(x, y)')} AS r2, {R('sum((y - x) * (y - x) / (sx * sx + sy * sy)) / (count(*) - 2)', 5)} AS chi2_reduced, {R('stddev_pop(y - x) / sqrt(count(*))')} AS bias_error,
 {R('2 * covar_samp(x, y) / (var_samp(x) + var_samp(y) + pow(avg(x) - avg(y), 2))')} AS concordance FROM pr GROUP BY ALL""")
def ag_pair_stats(spark, sf):
    s = cp.pair_stats(_pairs(spark, sf), ["x_set", "y_set"], "x", "y", "sx", "sy")
    return s.select("x_set", "y_set", "n", *[r6(c).alias(c) for c in ("rmse", "r", "bias", "r2", "bias_error", "concordance")],
                    r6("chi2", 5).alias("chi2"), r6("chi2_reduced", 5).alias("chi2_reduced"))


@query("un_xy_error_line")
def un_xy_error_line(spark, sf):
    """Iterative fit; no SQL form (checked against numpy in the tests)."""
    out = cp.xy_error_line(_pairs(spark, sf), ["x_set", "y_set"], "x", "y", "sx", "sy")
    return out.select("x_set", "y_set", "n", *[r6(c, 5).alias(c) for c in ("slope", "intercept", "slope_sd", "intercept_sd")], "converged")


# quantile function per site: percentiles of the order values
LEV = [i / 20 for i in range(21)]
QF = f"qf AS (SELECT site, instrument AS dataset, unnest({LEV!r}::DOUBLE[]) AS p, unnest(quantile_cont(value, {LEV!r})) AS q FROM o GROUP BY site, instrument)"


def _qf(spark, sf):
    o = orders_series(spark, sf).withColumnRenamed("instrument", "dataset")
    a = ag.exact_quantiles(o, ["site", "dataset"], "value", LEV).withColumnRenamed("quantiles", "_q")
    return a.select("site", "dataset", F.inline(F.arrays_zip(F.array(*[F.lit(x) for x in LEV]).alias("p"), F.col("_q").alias("q")))).toDF("site", "dataset", "p", "q")


def resample_sql(n: int) -> str:
    return f"""rs AS (SELECT site, dataset, i, i / {n - 1}e0 AS u FROM (SELECT DISTINCT site, dataset FROM qf), (SELECT unnest(range(0, {n})) AS i)),
ra AS (SELECT rs.*, a.p AS p0, a.q AS q0, b.p AS p1, b.q AS q1 FROM rs ASOF JOIN qf a ON rs.site = a.site AND rs.dataset = a.dataset AND rs.u >= a.p LEFT JOIN qf b ON b.site = rs.site AND b.dataset = rs.dataset AND abs(b.p - a.p - 0.05e0) < 1e-9),
rq AS (SELECT site, dataset, i, CASE WHEN q1 IS NULL THEN q0 ELSE q0 + (q1 - q0) * (u - p0) / (p1 - p0) END AS v FROM ra)"""


@query("un_quantile_resample", with_(ORD, QF, resample_sql(31)) + f"SELECT site, dataset, i AS point, {R('v', 4)} AS value FROM rq")
def un_quantile_resample(spark, sf):
    q = cp.quantile_arrays(_qf(spark, sf), ["site", "dataset"], "p", "q", 31)
    return q.select("site", "dataset", F.posexplode("quantiles").alias("point", "v")).select("site", "dataset", "point", r6("v", 4).alias("value"))


DRAWS = 1_000_000
ENDS = ("q68_low", "q68_high", "q95_low", "q95_high")
MC = f"""dr AS (SELECT site, dataset, (unnest(range(0, {DRAWS})) + 0.5e0) / {DRAWS}e0 * 30 AS pos, unnest(range(0, {DRAWS})) AS draw FROM (SELECT DISTINCT site, dataset FROM qf)),
dl AS (SELECT dr.site, dr.dataset, draw, a.v + (b.v - a.v) * (pos - floor(pos)) AS v FROM dr JOIN rq a ON a.site = dr.site AND a.dataset = dr.dataset AND a.i = least(floor(pos), 29) JOIN rq b ON b.site = dr.site AND b.dataset = dr.dataset AND b.i = least(floor(pos), 29) + 1),
dm AS (SELECT dataset, draw, avg(v) AS m FROM dl GROUP BY ALL)"""


@query("un_mc_mean", with_(ORD, QF, resample_sql(31), MC) + f"SELECT dataset, {R('avg(m)', 3)} AS mean, {R('stddev_samp(m)', 3)} AS std, (SELECT count(DISTINCT site) FROM qf WHERE qf.dataset = dm.dataset) AS n_sites, CAST(count(*) AS BIGINT) AS n_draws, {', '.join(R(f'quantile_cont(m, {q})', 3) + ' AS ' + n for n, q in zip(ENDS, (0.16, 0.84, 0.025, 0.975), strict=True))} FROM dm GROUP BY dataset")
def un_mc_mean(spark, sf):
    """Evenly spaced draws (the deterministic mode), so that SQL can repeat them."""
    q = cp.quantile_arrays(_qf(spark, sf), ["site", "dataset"], "p", "q", 31)
    m = cp.mean_distribution(q, ["site", "dataset"], ["dataset"], DRAWS, stratified=True)
    return m.select("dataset", r6("mean", 3).alias("mean"), r6("std", 3).alias("std"), "n_sites", "n_draws", *[r6(c, 3).alias(c) for c in ENDS])


@query("un_mc_mean_random")
def un_mc_mean_random(spark, sf):
    """Random draws keyed by site, dataset and chunk of draws: the same for any partitioning."""
    q = cp.quantile_arrays(_qf(spark, sf), ["site", "dataset"], "p", "q", 201)
    return cp.mean_distribution(q, ["site", "dataset"], ["dataset"], DRAWS, seed=7)


KDE = """st AS (SELECT site, min(value) AS lo, max(value) AS hi, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2e0) AS h FROM o GROUP BY site)"""


@query("un_kde", with_(ORD, KDE) + f"SELECT site, {R('lo + (hi - lo) * g / 511e0', 3)} AS x, {R('1e6 * sum(exp(-0.5e0 * pow((lo + (hi - lo) * g / 511e0 - value) / h, 2))) / (any_value(n) * any_value(h) * 2.5066282746310002e0)')} AS density FROM o JOIN st USING (site), (SELECT unnest(range(0, 512)) AS g) GROUP BY site, g, lo, hi")
def un_kde(spark, sf):
    k = cp.kernel_density(orders_series(spark, sf), ["site"], "value")
    return k.select("site", r6("x", 3).alias("x"), r6(F.col("density") * 1e6).alias("density"))


@query("un_histogram", with_(ORD, "st AS (SELECT site, min(value) AS lo, max(value) AS hi, count(*) AS n FROM o GROUP BY site)",
       "b AS (SELECT site, least(200, CAST(floor(200 * (value - lo) / (hi - lo)) AS INTEGER) + 1) AS bin, n, (hi - lo) / 200 AS w FROM o JOIN st USING (site))") + f"SELECT site, bin, CAST(count(*) AS BIGINT) AS count, {R('1e6 * count(*) / (n * w)')} AS density FROM b GROUP BY site, bin, n, w")
def un_histogram(spark, sf):
    h = cp.histogram(orders_series(spark, sf), ["site"], "value")
    return h.select("site", "bin", "count", r6(F.col("density") * 1e6).alias("density"))


@query("un_drift_effect", with_(ORD, TR, "dl AS (SELECT dataset, site, season, CAST(unnest([-20, 0, 20]) AS DOUBLE) AS drift, slope, lower_1s, upper_1s FROM tr)",
       "dt AS (SELECT dataset, site, season, drift, slope * (1 + drift / 100) AS trend, lower_1s, upper_1s FROM dl)") +
       f"SELECT a.dataset, a.site, a.season, a.drift, {R('(a.trend - b.trend) * 1000', 3)} AS effect, {R('(a.upper_1s - a.lower_1s) * 1000', 3)} AS width FROM dt a JOIN dt b ON a.dataset = b.dataset AND a.site = b.site AND a.season = b.season AND b.drift = 0 WHERE a.drift <> 0")
def un_drift_effect(spark, sf):
    t = trends(spark, sf).withColumn("drift", F.explode(F.array(F.lit(-20.0), F.lit(0.0), F.lit(20.0)))).withColumn("trend", F.col("slope") * (F.col("drift") / 100 + 1))
    d = cp.drift_effect(t, ["dataset", "site", "season"], lower="lower_1s", upper="upper_1s")
    return d.select("dataset", "site", "season", "drift", r6("effect", 3).alias("effect"), r6("width", 3).alias("width"))


@query("un_inset_filter", with_(SITES) + "SELECT site FROM st WHERE lat BETWEEN 35 AND 70 AND lon BETWEEN -10 AND 40")
def un_inset_filter(spark, sf):
    return cp.inset(sites(spark, sf), (35, 70), (-10, 40)).select("site")
