"""Daily means, bins, climatologies, anomalies and reconstruction."""

from pyspark.sql import functions as F

from ..core import cut, r6
from ..functions import calendar as cal
from ..functions.solar import solar_zenith
from ..operators import aggregate as ag
from ..operators import compare as cp
from .inputs import EV, GRID, OFF, ORD, R, event_samples, grid, orders_series, with_
from .q_functions import NOLEAP, SEASON, zenith_sql
from .q_joins import DAILY, DS, daily, datasets
from .registry import query

ZEN = zenith_sql("time", "48e0", "(event_id % 40 - 20)")
CONDS = f"""ez AS (SELECT *, {ZEN} AS z FROM e),
ec AS (SELECT site, instrument, date, 'all' AS condition, value FROM ez UNION ALL SELECT site, instrument, date, 'daytime', value FROM ez WHERE z <= 85 UNION ALL SELECT site, instrument, date, 'nighttime', value FROM ez WHERE z > 90)"""


def _zenith():
    return solar_zenith(F.col("time"), F.lit(48.0), (F.pmod("event_id", F.lit(40)) - 20).cast("double"))


@query("ag_daily_conditions", with_(EV, CONDS) + f"SELECT site, instrument, condition, date, {R('avg(value)')} AS value, CAST(count(value) AS BIGINT) AS n_samples FROM ec GROUP BY ALL HAVING count(value) >= 1")
def ag_daily_conditions(spark, sf):
    d = ag.daily_conditions(event_samples(spark, sf), ["site", "instrument"], zenith=_zenith(), min_samples=1)
    return d.select("site", "instrument", "condition", "date", r6("value").alias("value"), "n_samples")


@query("ag_daily_min_samples", with_(EV, CONDS) + f"SELECT site, instrument, condition, date, {R('avg(value)')} AS value FROM ec GROUP BY ALL HAVING count(value) >= 12")
def ag_daily_min_samples(spark, sf):
    d = ag.daily_conditions(event_samples(spark, sf), ["site", "instrument"], zenith=_zenith(), min_samples=12)
    return d.select("site", "instrument", "condition", "date", r6("value").alias("value"))


@query("ag_daily_all_only", with_(ORD) + f"SELECT site, date, {R('avg(value)', 4)} AS value FROM o GROUP BY ALL HAVING count(*) >= 2")
def ag_daily_all_only(spark, sf):
    d = ag.daily_conditions(orders_series(spark, sf), ["site"], time="date", conditions=["all"], min_samples=2)
    return d.select("site", "date", r6("value", 4).alias("value"))


@query("ag_mean_min_frac", with_(ORD) + f"SELECT site, instrument, date_trunc('month', date)::DATE AS month, {R('CASE WHEN count(CASE WHEN value > 200000 THEN 1 END) >= 0.6 * count(*) THEN avg(CASE WHEN value > 200000 THEN value END) END', 4)} AS value FROM o GROUP BY ALL")
def ag_mean_min_frac(spark, sf):
    o = orders_series(spark, sf)
    v = F.when(F.col("value") > 200000, F.col("value"))
    return o.groupBy("site", "instrument", F.trunc("date", "month").alias("month")).agg(r6(ag.mean_min_frac(v, 0.6), 4).alias("value"))


HOLES = "dh AS (SELECT site, date, CASE WHEN month(date) % 2 = 0 THEN value END AS value FROM dz)"
DZ = "dz AS (SELECT site, date, avg(value) AS value FROM o GROUP BY ALL)"
BIN = {
    "2day": ("og + CAST(((date - og) // 2) * 2 AS INTEGER)", "2 DAY"), "3day": ("og + CAST(((date - og) // 3) * 3 AS INTEGER)", "3 DAY"),
    "week": ("date + CAST((8 - isodow(date)) % 7 AS INTEGER)", "7 DAY"), "month": ("date_trunc('month', date)::DATE", "1 MONTH"),
    "season": ("(date_trunc('quarter', date + INTERVAL 1 MONTH) - INTERVAL 1 MONTH)::DATE", "3 MONTH"), "year": ("date_trunc('year', date)::DATE", "1 YEAR"),
}


def bins_sql(src: str) -> str:
    parts = []
    for f, (lab, step) in BIN.items():
        parts.append(f"""(WITH q AS (SELECT *, min(date) OVER (PARTITION BY site) AS og FROM {src}), b AS (SELECT site, {lab} AS bin, CASE WHEN count(value) >= 0.5 * count(*) THEN avg(value) END AS value FROM q GROUP BY ALL),
 r AS (SELECT site, CAST(unnest(generate_series(min(bin)::TIMESTAMP, max(bin)::TIMESTAMP, INTERVAL {step})) AS DATE) AS bin FROM b GROUP BY site)
 SELECT '{f}' AS freq, r.site, r.bin, {R(f'b.value + {OFF}', 4)} AS value FROM r LEFT JOIN b ON b.site = r.site AND b.bin = r.bin)""")
    return " UNION ALL ".join(parts)


def _holes(spark, sf):
    d = orders_series(spark, sf).groupBy("site", "date").agg(F.avg("value").alias("value"))
    return d.withColumn("value", F.when(F.month("date") % 2 == 0, F.col("value")))


def _all_bins(d, value="value"):
    out = None
    for f in cal.FREQUENCIES:
        b = ag.calendar_bins(d, ["site"], f, value=value).select(F.lit(f).alias("freq"), "site", "bin", r6(F.col(value) + OFF, 4).alias("value"))
        out = b if out is None else out.unionByName(b)
    return out


@query("ag_calendar_bins", with_(ORD, DZ, HOLES) + bins_sql("dh"))
def ag_calendar_bins(spark, sf):
    return _all_bins(cut(_holes(spark, sf)))


CLM = f"cq AS (SELECT site, {NOLEAP} AS doy, avg(value) AS clim FROM dz WHERE NOT (month(date) = 2 AND day(date) = 29) GROUP BY ALL)"
ANOM = f"an AS (SELECT site, date, value - clim AS value FROM (SELECT *, {NOLEAP} AS doy FROM dz WHERE NOT (month(date) = 2 AND day(date) = 29)) JOIN cq USING (site, doy))"


def _anom(spark, sf):
    d = ag.drop_leap_days(orders_series(spark, sf).groupBy("site", "date").agg(F.avg("value").alias("value")))
    clim = d.groupBy("site", cal.noleap_doy("date").alias("doy")).agg(F.avg("value").alias("value"))
    return ag.anomaly(d, clim, ["site"]), clim


@query("ag_anomaly_bins", with_(ORD, DZ, CLM, ANOM) + bins_sql("an"))
def ag_anomaly_bins(spark, sf):
    a, _ = _anom(spark, sf)
    return _all_bins(cut(a.select("site", "date", "anomaly")), "anomaly")


@query("ag_3h_bins", with_(EV) + f"SELECT site, time_bucket(INTERVAL 3 HOUR, time) + INTERVAL 90 MINUTE AS time, {R('avg(value)')} AS value FROM e GROUP BY ALL")
def ag_3h_bins(spark, sf):
    b = ag.subdaily_bins(event_samples(spark, sf), ["site"])
    return b.select("site", F.col("time").cast("timestamp_ntz").alias("time"), r6("value").alias("value"))


@query("ag_valid_days", with_(ORD) + "SELECT site, CAST(count(DISTINCT CASE WHEN value > 250000 THEN date END) AS BIGINT) AS valid_days FROM o GROUP BY site")
def ag_valid_days(spark, sf):
    o = orders_series(spark, sf).withColumn("value", F.when(F.col("value") > 250000, F.col("value")))
    return ag.valid_days(o, ["site"])


@query("ag_winsor_mean", with_(ORD, "qs AS (SELECT site, instrument, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM o GROUP BY ALL)") + f"SELECT site, instrument, {R('avg(greatest(lo, least(hi, value)))', 4)} AS value FROM o JOIN qs USING (site, instrument) GROUP BY ALL")
def ag_winsor_mean(spark, sf):
    w = ag.winsor_mean(orders_series(spark, sf), ["site", "instrument"])
    return w.select("site", "instrument", r6("value", 4).alias("value"))


def doy_clim_sql(src: str, keys: str, value: str = "value") -> str:
    return f"""dw AS (SELECT {keys}, (({NOLEAP} - 1 + j + 365) % 365) + 1 AS doy, {value} AS value FROM {src}, (SELECT unnest(range(-15, 16)) AS j)),
dq AS (SELECT {keys}, doy, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM dw GROUP BY ALL),
dc AS (SELECT {keys}, doy, avg(greatest(lo, least(hi, value))) AS value FROM dw JOIN dq USING ({keys}, doy) GROUP BY ALL)"""


REF = "rf AS (SELECT * FROM dd WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND NOT (month(date) = 2 AND day(date) = 29))"


def _ref(spark, sf):
    return ag.drop_leap_days(ag.reference_period(daily(spark, sf), "1996-01-01", "2000-12-31"))


@query("ag_doy_climatology", with_(ORD, DAILY, REF, doy_clim_sql("rf", "site, instrument")) + f"SELECT site, instrument, doy, {R(f'value + {OFF}', 4)} AS value FROM dc")
def ag_doy_climatology(spark, sf):
    return ag.doy_climatology(_ref(spark, sf), ["site", "instrument"]).select("site", "instrument", "doy", r6(F.col("value") + OFF, 4).alias("value"))


@query("ag_clim_summaries", with_(ORD, DAILY) + f"""SELECT site, 'mean' AS kind, 'all' AS segment, {R('avg(value)', 4)} AS value FROM dd GROUP BY site UNION ALL
 SELECT site, 'month', CAST(month(date) AS VARCHAR), {R('avg(value)', 4)} FROM dd GROUP BY site, month(date) UNION ALL SELECT site, 'season', {SEASON}, {R('avg(value)', 4)} FROM dd GROUP BY site, {SEASON}""")
def ag_clim_summaries(spark, sf):
    return ag.climatology_summaries(daily(spark, sf), ["site"]).select("site", "kind", "segment", r6("value", 4).alias("value"))


@query("ag_baseline", with_(ORD, DAILY, REF) + f"SELECT site, instrument, {R('avg(value)', 4)} AS baseline FROM rf GROUP BY ALL")
def ag_baseline(spark, sf):
    return ag.baseline(_ref(spark, sf), ["site", "instrument"]).select("site", "instrument", r6("baseline", 4).alias("baseline"))


DEM = "dm AS (SELECT site, instrument, date, value - avg(value) OVER (PARTITION BY site, instrument) AS dv FROM rf)"


@query("win_demean", with_(ORD, DAILY, REF, DEM) + f"SELECT site, instrument, date, {R('dv', 4)} AS value FROM dm")
def win_demean(spark, sf):
    from pyspark.sql import Window as W

    d = _ref(spark, sf)
    return d.select("site", "instrument", "date", r6(F.col("value") - F.avg("value").over(W.partitionBy("site", "instrument")), 4).alias("value"))


@query("ag_shared_climatology", with_(ORD, DAILY, REF, DEM, doy_clim_sql("dm", "site", "dv"), "sh AS (SELECT site, doy, value - avg(value) OVER (PARTITION BY site) AS shared FROM dc)",
       "bs AS (SELECT site, instrument, avg(value) AS b FROM rf GROUP BY ALL UNION ALL SELECT site, 'site', avg(value) FROM rf GROUP BY ALL)") +
       f"SELECT site, instrument, doy, {R(f'shared + {OFF}', 4)} AS shared, {R(f'shared + b + {OFF}', 4)} AS value FROM sh JOIN bs USING (site)")
def ag_shared_climatology(spark, sf):
    c = ag.shared_climatology(cut(_ref(spark, sf)), ["site"])
    return c.select("site", "instrument", "doy", r6(F.col("shared") + OFF, 4).alias("shared"), r6(F.col("value") + OFF, 4).alias("value"))


MON = "mb AS (SELECT site, date_trunc('month', date)::DATE AS date, avg(value) AS anomaly FROM an GROUP BY ALL), gm AS (SELECT site, avg(clim) AS g FROM cq GROUP BY site)"


@query("ag_reconstruct", with_(ORD, DZ, CLM, ANOM, MON) + f"SELECT site, date AS bin, {R('clim + anomaly', 4)} AS seasonal, {R('g + anomaly', 4)} AS deseasonalized FROM (SELECT *, {NOLEAP} AS doy FROM mb) JOIN cq USING (site, doy) JOIN gm USING (site)")
def ag_reconstruct(spark, sf):
    a, clim = _anom(spark, sf)
    b = ag.calendar_bins(a, ["site"], "month", value="anomaly", fill=False)
    s = ag.reconstruct(b, clim, ["site"], True).select("site", "bin", r6("value", 4).alias("seasonal"))
    d = ag.reconstruct(b, clim, ["site"], False).select("site", "bin", r6("value", 4).alias("deseasonalized"))
    return s.join(d, ["site", "bin"])


@query("ag_year_season", with_(ORD, DZ, CLM, ANOM, f"sc AS (SELECT site, {SEASON} AS season, avg(clim) AS c FROM (SELECT site, DATE '2001-01-01' + CAST(doy - 1 AS INTEGER) AS date, clim FROM cq) GROUP BY ALL)") +
       f"SELECT site, year(date) AS year, season, {R('any_value(c) + CASE WHEN count(value) >= 0.5 * count(*) THEN avg(value) END', 4)} AS value FROM (SELECT *, {SEASON} AS season FROM an) JOIN sc USING (site, season) GROUP BY site, year(date), season")
def ag_year_season(spark, sf):
    a, clim = _anom(spark, sf)
    return ag.year_season(a, clim, ["site"]).select("site", "year", "season", r6("value", 4).alias("value"))


@query("ag_coverage", with_(ORD) + """SELECT site, CAST(count(*) AS BIGINT) AS n, min(date) AS first, max(date) AS last, greatest(min(date), DATE '1995-06-01') AS start, least(max(date), DATE '2000-12-31') AS "end",
 least(max(date), DATE '2000-12-31') - greatest(min(date), DATE '1995-06-01') >= 365 * 5 AS enough FROM o WHERE value > 300000 GROUP BY site""")
def ag_coverage(spark, sf):
    o = orders_series(spark, sf).withColumn("value", F.when(F.col("value") > 300000, F.col("value")))
    return ag.coverage(o, ["site"], first="1995-06-01", last="2000-12-31", min_years=5)


@query("ag_availability_matrix", with_(ORD, "dv AS (SELECT site, instrument, date_trunc('month', date)::DATE AS m, count(DISTINCT date) AS n FROM o WHERE year(date) = 1999 GROUP BY ALL)") +
       "SELECT site, instrument, " + ", ".join(f"coalesce(max(CASE WHEN month(m) = {i} THEN round(least(100e0, 100e0 * n / day(last_day(m))), 4) END), 0e0) AS m{i:02d}" for i in range(1, 13)) + " FROM dv GROUP BY ALL")
def ag_availability_matrix(spark, sf):
    return cp.availability_matrix(orders_series(spark, sf), ["site", "instrument"], 1999)


@query("ag_site_means", with_(ORD, DS, "lc AS (SELECT *, CASE WHEN site < '3' THEN 'mid' ELSE 'high' END AS lat_class FROM (SELECT dataset, site, avg(v) AS v FROM ds GROUP BY ALL))") +
       f"SELECT dataset, coalesce(lat_class, 'all') AS lat_class, {R('avg(v)', 4)} AS value FROM lc GROUP BY GROUPING SETS ((dataset), (dataset, lat_class))")
def ag_site_means(spark, sf):
    d = datasets(spark, sf).groupBy("dataset", "site").agg(F.avg("v").alias("v")).withColumn("lat_class", F.when(F.col("site") < "3", "mid").otherwise("high"))
    return cp.site_means(d, "dataset", "lat_class", "v").select("dataset", "lat_class", r6("value", 4).alias("value"))


@query("ag_bias_matrix", with_(ORD, DS, "pm AS (SELECT a.dataset AS x_set, b.dataset AS y_set, a.v - b.v AS d FROM ds a JOIN ds b USING (site, month) WHERE a.dataset < b.dataset)") + f"SELECT x_set, y_set, CAST(count(*) AS BIGINT) AS n, {R('avg(d)', 4)} AS bias FROM pm GROUP BY ALL")
def ag_bias_matrix(spark, sf):
    return cp.bias_matrix(datasets(spark, sf), ["site", "month"], "dataset", "v").select("x_set", "y_set", "n", r6("bias", 4).alias("bias"))


@query("ag_flux_difference", with_(GRID) + f"SELECT lat, lon, {R('avg(obs_cld_amount) - avg(adj_cld_amount)', 4)} AS value FROM gr GROUP BY lat, lon HAVING avg(obs_cld_amount) - avg(adj_cld_amount) > 0")
def ag_flux_difference(spark, sf):
    return cp.flux_difference(grid(spark, sf), ["lat", "lon"], "obs_cld_amount", "adj_cld_amount").select("lat", "lon", r6("value", 4).alias("value"))


RUNW = """rw AS (SELECT *, count(*) OVER (PARTITION BY site, instrument) AS n, row_number() OVER (PARTITION BY site, instrument ORDER BY date) AS i FROM rs),
r2 AS (SELECT a.site, a.instrument, a.date, a.n, count(b.value) AS c, avg(b.value) AS m FROM rw a JOIN rw b ON a.site = b.site AND a.instrument = b.instrument
 AND b.i BETWEEN a.i - least(365, a.n) // 2 AND a.i + (least(365, a.n) - 1) // 2 WHERE a.n >= 2 GROUP BY ALL)"""


@query("win_running_mean", with_(ORD, DAILY, "rs AS (SELECT site, instrument, date, CASE WHEN value > 200000 THEN value END AS value FROM dd)", RUNW) +
       f"SELECT site, instrument, date, {R('CASE WHEN c >= greatest(1, floor(least(365, n) * 0.5)) THEN m + ' + str(OFF) + ' END', 3)} AS running FROM r2")
def win_running_mean(spark, sf):
    d = daily(spark, sf)
    d = d.withColumn("value", F.when(F.col("value") > 200000, F.col("value")))
    return ag.running_mean(cut(d), ["site", "instrument"]).select("site", "instrument", "date", r6(F.col("running") + OFF, 3).alias("running"))
