"""Response regression on daily fractions (orders) against a daily covariate."""

from pyspark.sql import functions as F

from ..core import r6
from ..functions import calendar as cal
from ..operators import response as rs
from .inputs import R, table, with_
from .q_functions import NOLEAP, PI
from .registry import query

RG = f"""rg0 AS (SELECT o_orderpriority AS site, o_orderstatus AS instrument, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 6e5 AS y, avg(o_custkey % 30) + any_value(month(o_orderdate)) AS temperature, CAST(count(*) AS DOUBLE) AS n_samples FROM orders GROUP BY ALL),
rg AS (SELECT *, (date - DATE '1995-01-01') / 365.25e0 AS time, {NOLEAP} AS doy FROM rg0)"""


def regression(spark, sf):
    o = table(spark, sf, "orders")
    d = o.groupBy(F.col("o_orderpriority").alias("site"), F.col("o_orderstatus").alias("instrument"), F.to_date("o_orderdate").alias("date")).agg(
        (F.avg("o_totalprice") / 6e5).alias("y"), F.avg(F.pmod("o_custkey", F.lit(30))).alias("_t"), F.count(F.lit(1)).cast("double").alias("n_samples"))
    return d.select("site", "instrument", "date", "y", (F.col("_t") + F.month("date")).alias("temperature"), "n_samples",
                    (F.datediff("date", F.lit("1995-01-01").cast("date")) / 365.25).alias("time"), cal.noleap_doy("date").alias("doy"))


LT = "lt AS (SELECT rg.*, s * time + i AS t_trend, temperature - (s * time + i) AS t_anom FROM rg JOIN (SELECT site, regr_slope(temperature, time) AS s, regr_intercept(temperature, time) AS i FROM rg GROUP BY site) USING (site))"


@query("rg_linear_trend", with_(RG, LT) + f"SELECT site, instrument, date, {R('t_trend')} AS t_trend, {R('t_anom')} AS t_anom FROM lt")
def rg_linear_trend(spark, sf):
    d = rs.linear_trend(regression(spark, sf), ["site"])
    return d.select("site", "instrument", "date", r6("t_trend").alias("t_trend"), r6("t_anom").alias("t_anom"))


W = f"(doy * (2e0 * {PI} / 365.25e0))"
DES = f"ds AS (SELECT *, [1e0, t_trend, t_anom, sin({W}), cos({W}), t_trend * sin({W}), t_trend * cos({W}), t_anom * sin({W}), t_anom * cos({W})] AS x FROM lt)"


@query("rg_design", with_(RG, LT, DES) + f"SELECT site, instrument, date, i AS col, {R('x[i + 1]')} AS v FROM ds, (SELECT unnest(range(0, 9)) AS i)")
def rg_design(spark, sf):
    d = rs.linear_trend(regression(spark, sf), ["site"]).withColumn("x", rs.design(2, True))
    return d.select("site", "instrument", "date", F.posexplode("x").alias("col", "v")).select("site", "instrument", "date", "col", r6("v").alias("v"))


@query("rg_quasibinomial")
def rg_quasibinomial(spark, sf):
    """Iterative weighted fit; no SQL form (checked against numpy in the tests)."""
    f = rs.fit_response(regression(spark, sf), ["site"], 12)
    return f.select("site", F.col("rows").cast("bigint").alias("rows"), r6("dispersion").alias("dispersion"), "converged", *[r6(F.col("coef")[i]).alias(f"b{i}") for i in range(15)],
                    *[r6(F.col("se")[i]).alias(f"se{i}") for i in range(15)])


COEF = "cf AS (SELECT site, [0.1e0, regr_slope(y, t_trend), regr_slope(y, t_anom), 0.2e0, -0.1e0, 0.01e0, 0.02e0, 0.03e0, 0.04e0] AS c FROM lt GROUP BY site)"


@query("rg_mme", with_(RG, LT, DES, COEF, "ee AS (SELECT ds.site, c, x, 1e0 / (1e0 + exp(-list_sum(list_transform(range(1, 10), lambda i: c[i] * x[i])))) AS p FROM ds JOIN cf USING (site))") +
       f"SELECT site, {R('avg((c[2] + c[6] * x[4] + c[7] * x[5]) * p * (1 - p))', 8)} AS mme_trend, {R('avg((c[3] + c[8] * x[4] + c[9] * x[5]) * p * (1 - p))', 8)} AS mme_anom FROM ee GROUP BY site")
def rg_mme(spark, sf):
    """Effects for given coefficients (simple slopes and fixed seasonal terms)."""
    d = rs.linear_trend(regression(spark, sf), ["site"]).withColumn("x", rs.design(2, True))
    c = [F.lit(v) for v in (0.2, -0.1, 0.01, 0.02, 0.03, 0.04)]
    coef = d.groupBy("site").agg(F.regr_slope("y", "t_trend").alias("a"), F.regr_slope("y", "t_anom").alias("b"))
    coef = coef.select("site", F.array(F.lit(0.1), "a", "b", *c).alias("coef"))
    m = rs.mean_marginal_effects(d, coef, ["site"], 2, True)
    return m.select("site", r6("mme_trend", 8).alias("mme_trend"), r6("mme_anom", 8).alias("mme_anom"))


@query("rg_block_bootstrap")
def rg_block_bootstrap(spark, sf):
    """1000 replicates of every site's whole series (keyed hashes: repeatable, no SQL form)."""
    b = rs.block_bootstrap(regression(spark, sf), ["site"])
    return b.select("site", "replicate", *[r6(c, 8).alias(c) for c in ("slope_trend", "slope_anom", "mme_trend", "mme_anom")])


@query("rg_bootstrap_ci", with_(RG, "sp AS (SELECT site, avg(y) AS m FROM rg GROUP BY site), rp AS (SELECT site, y - 0.93e0 * m AS v, CASE WHEN n_samples > 1 THEN temperature - 20 END AS w FROM rg JOIN sp USING (site))") +
       f"""SELECT site, {R('quantile_cont(v, 0.025)')} AS v_lower, {R('quantile_cont(v, 0.975)')} AS v_upper, {R('avg(v)')} AS v_mean, {R('least(1, 2 * least(avg(CASE WHEN v <= 0 THEN 1e0 ELSE 0e0 END), avg(CASE WHEN v >= 0 THEN 1e0 ELSE 0e0 END)))')} AS v_p,
 {R('quantile_cont(w, 0.025)')} AS w_lower, {R('quantile_cont(w, 0.975)')} AS w_upper, {R('avg(w)')} AS w_mean, {R('least(1, 2 * least(avg(CASE WHEN w <= 0 THEN 1e0 WHEN w > 0 THEN 0e0 END), avg(CASE WHEN w >= 0 THEN 1e0 WHEN w < 0 THEN 0e0 END)))')} AS w_p,
 CAST(count(v) AS BIGINT) AS n_valid, CAST(count(*) AS BIGINT) AS n_replicates FROM rp GROUP BY site""")
def rg_bootstrap_ci(spark, sf):
    """Interval statistics with each site's daily rows standing in for replicates."""
    d = regression(spark, sf)
    reps = d.join(d.groupBy("site").agg(F.avg("y").alias("m")), "site").select(
        "site", (F.col("y") - F.col("m") * 0.93).alias("v"), F.when(F.col("n_samples") > 1, F.col("temperature") - 20).alias("w"))
    c = rs.bootstrap_ci(reps, ["site"], ["v", "w"])
    return c.select("site", *[r6(x).alias(x) for x in c.columns if x[:2] in ("v_", "w_")], "n_valid", "n_replicates")


@query("rg_meta_instruments")
def rg_meta_instruments(spark, sf):
    """Per-instrument fits pooled by site, 10000 replicates shared by sample size (at least 100 each)."""
    m = rs.meta_response(regression(spark, sf), ["site"])
    return m.select("site", *[r6(c, 8).alias(c) for c in ("mme_trend", "mme_anom", "mme_trend_lower", "mme_trend_upper", "mme_anom_lower", "mme_anom_upper", "mme_trend_p", "mme_anom_p")], "n_replicates")
