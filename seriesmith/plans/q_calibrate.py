"""Calibration factors: daily candidates from large orders, targets from all order dates."""

from pyspark.sql import functions as F

from ..core import r6
from ..operators import calibrate as ca
from .inputs import OFF, ORD, R, orders_series, with_
from .registry import query

# candidates: all orders, with a ratio (value / 1e4) only above 150 000 and for some instruments and dates; the largest key of a date wins
CAND = "cd AS (SELECT site, instrument, date, arg_max(value / 1e4, k) AS lr FROM o WHERE value > 150000 AND NOT (instrument = 'P' AND site >= '3') AND NOT (site < '2' AND date < DATE '1996-03-05') GROUP BY ALL)"
BP = "bp AS (SELECT DISTINCT site, instrument, date_trunc('year', date)::DATE + 60 AS bp FROM o WHERE year(date) % 3 = 0 AND instrument = 'F')"
KEYS = ["site", "instrument"]


def _candidates(spark, sf):
    o = orders_series(spark, sf)
    none = (F.col("instrument") == "P") & (F.col("site") >= "3") | (F.col("site") < "2") & (F.col("date") < F.lit("1996-03-05").cast("date"))
    return o.withColumn("lidar_ratio", F.when((F.col("value") > 150000) & ~none, F.col("value") / 1e4))


def _breakpoints(spark, sf):
    o = orders_series(spark, sf).where((F.pmod(F.year("date"), F.lit(3)) == 0) & (F.col("instrument") == "F"))
    return o.select("site", "instrument", F.date_add(F.trunc("date", "year"), 60).alias("breakpoint")).distinct()


@query("cal_prepare", with_(ORD, CAND) + f"SELECT site, instrument, date, {R('lr')} AS lidar_ratio FROM cd")
def cal_prepare(spark, sf):
    return ca.prepare_candidates(_candidates(spark, sf), KEYS, order="k").select(*KEYS, "date", r6("lidar_ratio").alias("lidar_ratio"))


SEG = """cs AS (SELECT cd.*, (SELECT count(*) FROM bp WHERE bp.site = cd.site AND bp.instrument = cd.instrument AND bp.bp <= cd.date) AS seg FROM cd),
qq AS (SELECT a.site, a.instrument, a.seg, a.date, any_value(a.lr) AS lr,
 CASE WHEN count(*) FILTER (WHERE abs(b.date - a.date) * 86400 < 31557600 AND b.date - a.date <= 365) >= 30 THEN quantile_cont(b.lr, 0.4) FILTER (WHERE b.date - a.date BETWEEN -365 AND 365) END AS q2,
 CASE WHEN count(*) FILTER (WHERE b.date - a.date BETWEEN -547 AND 547) >= 30 THEN quantile_cont(b.lr, 0.4) FILTER (WHERE b.date - a.date BETWEEN -547 AND 547) END AS q3,
 CASE WHEN count(*) FILTER (WHERE b.date - a.date BETWEEN -730 AND 730) >= 30 THEN quantile_cont(b.lr, 0.4) FILTER (WHERE b.date - a.date BETWEEN -730 AND 730) END AS q4
 FROM cs a JOIN cs b ON a.site = b.site AND a.instrument = b.instrument AND a.seg = b.seg AND b.date BETWEEN a.date - 731 AND a.date + 731 GROUP BY a.site, a.instrument, a.seg, a.date),
rl AS (SELECT *, coalesce(q2, q3, q4) AS rolling, CASE WHEN q2 IS NOT NULL THEN 'rolling_two_year' WHEN q3 IS NOT NULL THEN 'rolling_three_year' WHEN q4 IS NOT NULL THEN 'rolling_four_year' END AS label FROM qq)"""


@query("win_range_quantile", with_(ORD, CAND, BP, SEG) + f"SELECT site, instrument, CAST(seg AS INTEGER) AS segment, date, {R('rolling')} AS rolling, label FROM rl")
def win_range_quantile(spark, sf):
    c = ca.segment_of(ca.prepare_candidates(_candidates(spark, sf), KEYS, order="k"), _breakpoints(spark, sf), KEYS)
    return ca.rolling_quantile(c, [*KEYS, "segment"]).select(*KEYS, "segment", "date", r6("rolling").alias("rolling"), "label")


INTERP = """lf AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN date END) OVER (PARTITION BY {k} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pd,
 min(CASE WHEN v IS NOT NULL THEN date END) OVER (PARTITION BY {k} ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nd FROM {src}),
it AS (SELECT lf.*, CASE WHEN lf.pd IS NULL THEN n.v WHEN lf.nd IS NULL THEN p.v WHEN lf.nd = lf.pd THEN p.v ELSE p.v + (n.v - p.v) * (lf.date - lf.pd) / (lf.nd - lf.pd) END AS iv
 FROM lf LEFT JOIN {src} p ON {jp} AND p.date = lf.pd LEFT JOIN {src} n ON {jn} AND n.date = lf.nd)"""


def interp_sql(src: str, keys: list[str]) -> str:
    j = lambda a: " AND ".join(f"{a}.{k} = lf.{k}" for k in keys)
    return INTERP.format(src=src, k=", ".join(keys), jp=j("p"), jn=j("n"))


DV = "dv AS (SELECT site, instrument, date, avg(CASE WHEN k % 4 = 0 THEN value END) AS v FROM o GROUP BY ALL)"


@query("win_time_interpolate", with_(ORD, DV, interp_sql("dv", KEYS)) + f"SELECT site, instrument, date, {R(f'iv + {OFF}', 4)} AS value, CASE WHEN v IS NOT NULL THEN 'valid' WHEN iv IS NOT NULL THEN 'interpolated' ELSE 'missing' END AS status FROM it")
def win_time_interpolate(spark, sf):
    d = orders_series(spark, sf).groupBy(*KEYS, "date").agg(F.avg(F.when(F.pmod("k", F.lit(4)) == 0, F.col("value"))).alias("v"))
    return ca.time_interpolate(d, KEYS, "date", "v").select(*KEYS, "date", r6(F.col("interpolated") + OFF, 4).alias("value"), "status")


FACT = """tg AS (SELECT DISTINCT site, instrument, date FROM o),
ts AS (SELECT tg.*, (SELECT count(*) FROM bp WHERE bp.site = tg.site AND bp.instrument = tg.instrument AND bp.bp <= tg.date) AS seg FROM tg),
bo AS (SELECT coalesce(ts.site, rl.site) AS site, coalesce(ts.instrument, rl.instrument) AS instrument, coalesce(ts.seg, rl.seg) AS seg, coalesce(ts.date, rl.date) AS date, ts.date IS NOT NULL AS tgt, lr, rolling AS v, label
 FROM ts FULL JOIN rl ON ts.site = rl.site AND ts.instrument = rl.instrument AND ts.seg = rl.seg AND ts.date = rl.date),
sg AS (SELECT site, instrument, seg, count(*) AS n, count(rolling) AS nr, median(lr) AS med FROM rl GROUP BY ALL),
tn AS (SELECT site, instrument, CAST(count(*) AS INTEGER) AS tot FROM cd GROUP BY ALL)"""


@query("cal_factors", with_(ORD, CAND, BP, SEG, FACT, interp_sql("bo", ["site", "instrument", "seg"]),
       "fx AS (SELECT it.site, it.instrument, it.date, it.lr, it.v, it.label, n, coalesce(n < 3 OR nr = 0, false) AS few, CASE WHEN n IS NULL THEN NULL WHEN n < 3 OR nr = 0 THEN med ELSE iv END AS ratio, coalesce(tot, 0) AS tot FROM it LEFT JOIN sg USING (site, instrument, seg) LEFT JOIN tn USING (site, instrument) WHERE tgt)") +
       f"""SELECT site, instrument, date, {R('coalesce(ratio / 18.8e0 * 0.78e0, 1e0)')} AS factor, CASE WHEN n IS NULL THEN 'default_no_candidates' WHEN few THEN 'candidate_median_fallback' WHEN v IS NOT NULL THEN label ELSE 'interpolated' END AS factor_status,
 {R('lr')} AS candidate, tot AS n_candidates FROM fx""")
def cal_factors(spark, sf):
    f = ca.calibration_factors(_candidates(spark, sf), orders_series(spark, sf), _breakpoints(spark, sf), KEYS, F.lit(18.8), order="k")
    return f.select(*KEYS, "date", r6("autocalibration_factor").alias("factor"), "factor_status", r6("candidate_lidar_ratio").alias("candidate"),
                    F.col("n_valid_candidate_lidar_ratios").alias("n_candidates"))
