"""Alignments as joins, set operations and sorts."""

from pyspark.sql import functions as F

from ..core import r6
from ..functions.solar import solar_zenith
from ..operators import aggregate as ag
from ..operators import joins as jn
from ..operators import setops as so
from ..operators import trend as tr
from ..sources import tables as tb
from .inputs import EV, GRID, OFF, ORD, R, SITES, event_samples, grid, orders_series, sites, table, with_
from .q_functions import HAV, NOLEAP, SEASON, zenith_sql
from .registry import query

DAILY = "dd AS (SELECT site, instrument, date, avg(value) AS value FROM o GROUP BY ALL)"
NOLEAP_D = NOLEAP


def daily(spark, sf):
    return orders_series(spark, sf).groupBy("site", "instrument", "date").agg(F.avg("value").alias("value"))


CELLS = """lats AS (SELECT DISTINCT lat FROM gr), lons AS (SELECT DISTINCT lon FROM gr),
sc AS (SELECT st.*, (SELECT arg_min(lat, struct_pack(a := abs(lat - st.lat), b := -lat)) FROM lats) AS cell_lat,
 (SELECT arg_min(lon, struct_pack(a := abs(lon - ((st.lon + 360) % 360)), b := -lon)) FROM lons) AS cell_lon FROM st)"""


@query("jn_nearest_cell", with_(GRID, SITES, CELLS) + f"SELECT site, k, layer, {R(HAV.format(a1='sc.lat', a2='sc.lon', b1='gr.lat', b2='gr.lon') + ' / 1000', 3)} AS distance_km FROM gr JOIN sc ON gr.lat = sc.cell_lat AND gr.lon = sc.cell_lon")
def jn_nearest_cell(spark, sf):
    out = jn.nearest_cell(grid(spark, sf), sites(spark, sf))
    return out.select("site", "k", "layer", r6("distance_km", 3).alias("distance_km"))


CLIM = f"cl AS (SELECT site, instrument, {NOLEAP} AS doy, avg(value) AS clim FROM dd WHERE NOT (month(date) = 2 AND day(date) = 29) GROUP BY ALL)"


@query("jn_climatology", with_(ORD, DAILY, CLIM) + f"SELECT site, instrument, date, {R(f'value - clim + {OFF}', 4)} AS anomaly FROM (SELECT *, {NOLEAP} AS doy FROM dd WHERE NOT (month(date) = 2 AND day(date) = 29)) JOIN cl USING (site, instrument, doy)")
def jn_climatology(spark, sf):
    from ..functions import calendar as cal

    d = daily(spark, sf)
    clim = ag.drop_leap_days(d).groupBy("site", "instrument", cal.noleap_doy("date").alias("doy")).agg(F.avg("value").alias("value"))
    return ag.anomaly(d, clim, ["site", "instrument"]).select("site", "instrument", "date", r6(F.col("anomaly") + OFF, 4).alias("anomaly"))


GAP = "gp AS (SELECT site, date, instrument, avg(CASE WHEN k % 3 <> 0 THEN value END) AS v1, avg(CASE WHEN k % 2 = 0 THEN value END) AS v2 FROM o GROUP BY ALL)"


@query("jn_priority_gap_fill", with_(ORD, GAP, "pr AS (SELECT *, CASE instrument WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS p FROM gp)") +
       f"SELECT site, date, {R('arg_min(v1, struct_pack(a := p, b := instrument)) FILTER (WHERE v1 IS NOT NULL)', 4)} AS v1, {R('arg_min(v2, struct_pack(a := p, b := instrument)) FILTER (WHERE v2 IS NOT NULL)', 4)} AS v2 FROM pr GROUP BY ALL")
def jn_priority_gap_fill(spark, sf):
    g = orders_series(spark, sf).groupBy("site", "date", "instrument").agg(
        F.avg(F.when(F.pmod("k", F.lit(3)) != 0, F.col("value"))).alias("v1"), F.avg(F.when(F.pmod("k", F.lit(2)) == 0, F.col("value"))).alias("v2"))
    p = F.when(F.col("instrument") == "P", 0).when(F.col("instrument") == "F", 1).otherwise(2)
    out = jn.priority_gap_fill(g, ["site", "date"], "instrument", p, ["v1", "v2"])
    return out.select("site", "date", r6("v1", 4).alias("v1"), r6("v2", 4).alias("v2"))


RANKS = """iv AS (SELECT site, instrument, count(DISTINCT date) AS nd, min(date) AS fd FROM dd GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY nd DESC, fd, instrument) AS rank FROM iv),
d1 AS (SELECT dd.*, rank FROM dd JOIN rk USING (site, instrument)),
x1 AS (SELECT * FROM d1 WHERE rank = 1),
x2 AS (SELECT * FROM d1 WHERE rank = 2 AND NOT EXISTS (SELECT 1 FROM x1 WHERE x1.site = d1.site AND abs(x1.date - d1.date) <= 2)),
x3 AS (SELECT * FROM d1 WHERE rank = 3 AND NOT EXISTS (SELECT 1 FROM x1 WHERE x1.site = d1.site AND abs(x1.date - d1.date) <= 2) AND NOT EXISTS (SELECT 1 FROM x2 WHERE x2.site = d1.site AND abs(x2.date - d1.date) <= 2))"""


@query("jn_overlap_exclusion", with_(ORD, DAILY, RANKS) + "SELECT site, instrument, date FROM x1 UNION ALL SELECT site, instrument, date FROM x2 UNION ALL SELECT site, instrument, date FROM x3")
def jn_overlap_exclusion(spark, sf):
    return jn.overlap_exclusion(daily(spark, sf), ["site"], "instrument", jn.OVERLAP_WINDOW["3day"]).select("site", "instrument", "date")


@query("jn_combine_series", with_(ORD, DAILY, RANKS) + """SELECT site, date, instrument, CAST(row_number() OVER (PARTITION BY site ORDER BY date, instrument) AS BIGINT) AS pos
 FROM (SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3)""")
def jn_combine_series(spark, sf):
    """Kept instrument series as one labelled series in time order."""
    kept = jn.overlap_exclusion(daily(spark, sf), ["site"], "instrument", 2)
    return so.series_positions(kept, ["site"], ["date", "instrument"]).select("site", "date", "instrument", F.col("pos").cast("bigint"))


@query("jn_zenith_align", with_(EV, "za AS (SELECT site, time, max(event_id % 100) + 0e0 AS z FROM e WHERE event_id % 4 <> 0 GROUP BY ALL)") + "SELECT event_id, CASE WHEN z > 50 THEN value END AS value FROM e LEFT JOIN za USING (site, time)")
def jn_zenith_align(spark, sf):
    e = event_samples(spark, sf)
    z = e.where(F.pmod("event_id", F.lit(4)) != 0).select("site", "time", F.pmod("event_id", F.lit(100)).cast("double").alias("z"))
    return jn.mask_by_zenith(e, z, ["site", "time"], F.col("z") > 50).select("event_id", "value")


BPS = "bp AS (SELECT DISTINCT site, instrument, date_trunc('year', date)::DATE + 45 AS bp FROM o WHERE k % 7 = 0)"


@query("jn_segment_asof", with_(ORD, BPS) + "SELECT k, (SELECT CAST(count(*) AS BIGINT) FROM bp WHERE bp.site = o.site AND bp.instrument = o.instrument AND bp.bp <= o.date) AS segment FROM o")
def jn_segment_asof(spark, sf):
    o = orders_series(spark, sf)
    b = o.where(F.pmod("k", F.lit(7)) == 0).select("site", "instrument", F.date_add(F.trunc("date", "year"), 45).alias("breakpoint")).distinct()
    return jn.segment_of(o, b, ["site", "instrument"]).select("k", F.col("segment").cast("bigint").alias("segment"))


@query("jn_reference_semi", with_(ORD, "rf AS (SELECT site FROM o WHERE instrument = 'P' AND value > 250000 GROUP BY site HAVING count(*) >= 35)") + "SELECT k FROM o WHERE site IN (SELECT site FROM rf)")
def jn_reference_semi(spark, sf):
    o = orders_series(spark, sf)
    ref = ag.coverage(o.where((F.col("instrument") == "P") & (F.col("value") > 250000)), ["site"], first="1995-01-01", min_periods=35)
    return o.join(ref.where("enough"), "site", "left_semi").select("k")


@query("jn_doy_window", with_(ORD, DAILY, "kk AS (SELECT unnest(range(-15, 16)) AS j)") + f"SELECT site, instrument, (({NOLEAP} - 1 + j + 365) % 365) + 1 AS doy, CAST(count(*) AS BIGINT) AS n FROM dd, kk GROUP BY ALL")
def jn_doy_window(spark, sf):
    w = ag.doy_window(daily(spark, sf))
    return w.groupBy("site", "instrument", "doy").agg(F.count(F.lit(1)).alias("n"))


SEGT = f"""sx AS (SELECT site, 'month' AS kind, CAST(month(date) AS VARCHAR) AS segment, date, value FROM dd UNION ALL SELECT site, 'season', {SEASON}, date, value FROM dd),
sv AS (SELECT site, kind, segment, regr_slope(value, (date - DATE '1995-01-01') / 365.25e0) AS slope, stddev_samp(value) AS std, avg(value) AS clim FROM sx GROUP BY ALL)"""


@query("jn_relative", with_(ORD, DAILY, SEGT) + f"SELECT site, kind, segment, {R('slope / clim')} AS slope_rel, {R('std / abs(clim)')} AS std_rel FROM sv")
def jn_relative(spark, sf):
    d = daily(spark, sf)
    seg = d.select("*", F.inline(tr.segment_array()))
    x = F.datediff("date", F.lit("1995-01-01").cast("date")) / 365.25
    t = seg.groupBy("site", "kind", "segment").agg(F.regr_slope("value", x).alias("slope"), F.stddev_samp("value").alias("std"))
    clim = ag.climatology_summaries(d, ["site"])
    rel = tr.relative(t, clim, ["site", "kind", "segment"], ["slope"], ["std"])
    return rel.select("site", "kind", "segment", r6("slope_rel").alias("slope_rel"), r6("std_rel").alias("std_rel"))


DS = f"ds AS (SELECT instrument AS dataset, site, date_trunc('month', date)::DATE AS month, avg(value) AS v FROM o GROUP BY ALL)"


@query("jn_dataset_pairs", with_(ORD, DS) + f"SELECT a.site, a.month, a.dataset AS x_set, b.dataset AS y_set, {R(f'a.v + {OFF}', 4)} AS x_v, {R(f'b.v + {OFF}', 4)} AS y_v FROM ds a JOIN ds b ON a.site = b.site AND a.month = b.month AND a.dataset < b.dataset")
def jn_dataset_pairs(spark, sf):
    ds = datasets(spark, sf)
    p = jn.dataset_pairs(ds, ["site", "month"], "dataset", "v")
    return p.select("site", "month", "x_set", "y_set", r6(F.col("x_v") + OFF, 4).alias("x_v"), r6(F.col("y_v") + OFF, 4).alias("y_v"))


def datasets(spark, sf):
    return orders_series(spark, sf).groupBy(F.col("instrument").alias("dataset"), "site", F.trunc("date", "month").alias("month")).agg(F.avg("value").alias("v"))


@query("jn_site_time_cross", with_(SITES, "tg AS (SELECT unnest(range(TIMESTAMP '2020-06-21', TIMESTAMP '2020-06-22 00:30:00', INTERVAL 1 HOUR)) AS t)") +
       f"SELECT site, t AS time, {R(zenith_sql('t', 'lat', 'lon'), 5)} AS zenith FROM st, tg")
def jn_site_time_cross(spark, sf):
    g = jn.site_time_grid(sites(spark, sf), "2020-06-21", "2020-06-22", "interval 1 hour")
    return g.select("site", F.col("time").cast("timestamp_ntz").alias("time"), r6(solar_zenith("time", "lat", "lon"), 5).alias("zenith"))


@query("jn_missing_sites", with_(SITES) + "SELECT DISTINCT 'Supplier#' || lpad(CAST(l_suppkey * 2 AS VARCHAR), 9, '0') AS site FROM lineitem WHERE 'Supplier#' || lpad(CAST(l_suppkey * 2 AS VARCHAR), 9, '0') NOT IN (SELECT site FROM st)")
def jn_missing_sites(spark, sf):
    want = table(spark, sf, "lineitem").select(F.concat(F.lit("Supplier#"), F.lpad((F.col("l_suppkey") * 2).cast("string"), 9, "0")).alias("site"))
    return so.missing(want, sites(spark, sf), "site")


@query("set_difference_sites", with_(SITES) + "SELECT c_name AS site FROM customer EXCEPT SELECT 'Customer#' || substr(site, 10) FROM st")
def set_difference_sites(spark, sf):
    conf = table(spark, sf, "customer").select(F.col("c_name").alias("site"))
    known = sites(spark, sf).select(F.concat(F.lit("Customer#"), F.substring("site", 10, 9)).alias("site"))
    return so.missing(conf, known, "site")


@query("so_time_sort", with_(ORD) + "SELECT site, k, CAST(row_number() OVER (PARTITION BY site ORDER BY date, k) AS BIGINT) AS pos FROM o")
def so_time_sort(spark, sf):
    """Position in time order within each site, from a range-partitioned sort (a hot site spans many tasks)."""
    return so.series_positions(orders_series(spark, sf), ["site"], ["date", "k"]).select("site", "k", "pos")


@query("so_rank_list", with_(ORD, f"sm AS (SELECT site, {SEASON} AS season, avg(value) AS m FROM o GROUP BY ALL)") + "SELECT site, string_agg(season, ' > ' ORDER BY m DESC) AS ranking FROM sm GROUP BY site")
def so_rank_list(spark, sf):
    from ..functions import calendar as cal

    m = orders_series(spark, sf).groupBy("site", cal.season("date").alias("season")).agg(F.avg("value").alias("m"))
    return so.rank_line(m, ["site"], "season", "m", descending=True)


@query("set_union_instruments", with_(ORD, EV) + f"SELECT site, instrument, CAST(count(*) AS BIGINT) AS n, CAST(count(event_id) AS BIGINT) AS n_events FROM (SELECT site, instrument, value, NULL AS event_id FROM o UNION ALL SELECT site, instrument, value, event_id FROM e) GROUP BY ALL")
def set_union_instruments(spark, sf):
    u = so.union_series(orders_series(spark, sf).drop("date"), event_samples(spark, sf).drop("time", "props"))
    return u.groupBy("site", "instrument").agg(F.count(F.lit(1)).alias("n"), F.count("event_id").alias("n_events"))


@query("set_union_times", with_(ORD) + "SELECT site, date FROM o WHERE k % 2 = 0 UNION SELECT site, date + 1 FROM o WHERE k % 3 = 0")
def set_union_times(spark, sf):
    o = orders_series(spark, sf)
    return so.union_index(o.where(F.pmod("k", F.lit(2)) == 0).select("site", "date"), o.where(F.pmod("k", F.lit(3)) == 0).select("site", F.date_add("date", 1).alias("date")))


@query("set_duplicate_guard", with_(ORD) + "SELECT site, instrument, date, CAST(count(*) AS BIGINT) AS copies FROM o GROUP BY ALL HAVING count(*) > 1")
def set_duplicate_guard(spark, sf):
    return so.duplicates(orders_series(spark, sf), ["site", "instrument", "date"])
