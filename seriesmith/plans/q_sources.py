"""Scans, catalogues and sinks. Paths, sites and grids are derived from the driver's tables."""

from pyspark.sql import functions as F

from ..core import r6
from ..sources import catalog as cat
from ..sources import sinks
from ..sources import tables as tb
from .inputs import EV, GRID, LIST, ORD, PF, R, SITES, event_samples, grid, listing, orders_series, profiles, sites, table, with_
from .registry import query

# network's site dimension for the catalogue: s1..s4 known, s5 unknown
NET = "net AS (SELECT DISTINCT 's' || substr(o_orderpriority, 1, 1) AS site, 'Name ' || substr(o_orderpriority, 1, 1) AS name FROM orders WHERE o_orderpriority < '5')"
PARSED = r"""pp AS (SELECT *, regexp_extract(path, '/([^/]+)/\d{4}/\d{2}/\d{2}/([^/_]+)_(\d{8})_(\d)\.nc$', 1) AS site,
 regexp_extract(path, '/([^/]+)/\d{4}/\d{2}/\d{2}/([^/_]+)_(\d{8})_(\d)\.nc$', 2) AS instrument,
 CAST(try_strptime(regexp_extract(path, '/([^/]+)/\d{4}/\d{2}/\d{2}/([^/_]+)_(\d{8})_(\d)\.nc$', 3), '%Y%m%d') AS DATE) AS date,
 regexp_extract(path, '/([^/]+)/\d{4}/\d{2}/\d{2}/([^/_]+)_(\d{8})_(\d)\.nc$', 4) AS version FROM fl),
pq AS (SELECT * FROM pp WHERE date IS NOT NULL)"""


def _net(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderpriority") < "5")
    one = F.substring("o_orderpriority", 1, 1)
    return o.select(F.concat(F.lit("s"), one).alias("site"), F.concat(F.lit("Name "), one).alias("name")).distinct()


@query("src_sites", with_(SITES) + "SELECT site, name, country, lat, lon FROM st")
def src_sites(spark, sf):
    return tb.read_sites(sites(spark, sf), ["name", "country"])


@query("src_site_coords", with_(SITES) + "SELECT site, lat, lon FROM st WHERE country IN ('C1', 'C2', 'C3', 'C4', 'C5', 'C6', 'C7')")
def src_site_coords(spark, sf):
    s = sites(spark, sf)
    return tb.site_coordinates(s, s.where(F.col("country").isin(*[f"C{i}" for i in range(1, 8)])))


@query("src_file_catalog", with_(LIST, PARSED) + "SELECT k, path, site, instrument, date, version FROM pq")
def src_file_catalog(spark, sf):
    return cat.parse_daily(listing(spark, sf)).select("k", "path", "site", "instrument", "date", "version")


@query("src_catalog_expand", with_(LIST, PARSED, NET) + """SELECT k, site, name, instrument, date, CASE WHEN name IS NULL THEN 'unknown site' END AS reason
 FROM pq LEFT JOIN net USING (site)""")
def src_catalog_expand(spark, sf):
    good, rejected = cat.expand_sites(cat.parse_daily(listing(spark, sf)), _net(spark, sf))
    both = good.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)
    return both.select("k", "site", "name", "instrument", "date", "reason")


@query("src_catalog_dir_dates", with_(LIST) + r"""SELECT DISTINCT regexp_extract(path, '^/lvl0/([^/]+)/', 1) AS site,
 CAST(strptime(regexp_extract(path, '/(\d{4}/\d{2}/\d{2})/', 1), '%Y/%m/%d') AS DATE) AS date FROM fl""")
def src_catalog_dir_dates(spark, sf):
    fl = listing(spark, sf).withColumn("site", F.regexp_extract("path", "^/lvl0/([^/]+)/", 1))
    return cat.directory_dates(fl, ["site"])


@query("src_catalog_sorted", with_(LIST, PARSED) + "SELECT path, date, CAST(row_number() OVER (PARTITION BY site, date ORDER BY path, k) AS BIGINT) AS pos FROM pq")
def src_catalog_sorted(spark, sf):
    """The catalogue in time order by range partitions; positions within a site's day show the order."""
    c = cat.parse_daily(listing(spark, sf)).select("site", "date", "path", "k")
    return cat.in_order(c, ["site", "date"], ["path", "k"]).select("path", "date", "pos")


CER = "cf AS (SELECT CASE WHEN k % 50 = 0 THEN 'bad_' || k ELSE 'CER_SYN1deg-1Hour_Terra-Aqua_Edition4A_40' || CAST(k % 8 AS VARCHAR) || '.' || strftime(date, '%Y%m%d') || '.hdf' END AS file, k FROM o)"


def _granule_listing(spark, sf):
    o = orders_series(spark, sf)
    good = F.concat(F.lit("CER_SYN1deg-1Hour_Terra-Aqua_Edition4A_40"), F.pmod("k", F.lit(8)).cast("string"), F.lit("."), F.date_format("date", "yyyyMMdd"), F.lit(".hdf"))
    return o.select(F.when(F.pmod("k", F.lit(50)) == 0, F.concat(F.lit("bad_"), F.col("k").cast("string"))).otherwise(good).alias("file"), "k")


@query("src_file_catalog_ceres", with_(ORD, CER) + r"""SELECT k, nullif(regexp_extract(file, '^CER_([^_]+)_([^_]+)_(Edition[^_]+)_(\d+)\.(\d{8})\.hdf$', 1), '') AS product,
 nullif(regexp_extract(file, '^CER_([^_]+)_([^_]+)_(Edition[^_]+)_(\d+)\.(\d{8})\.hdf$', 4), '') AS granule,
 CAST(try_strptime(regexp_extract(file, '\.(\d{8})\.hdf$', 1), '%Y%m%d') AS DATE) AS time, k % 50 = 0 AS rejected FROM cf""")
def src_file_catalog_ceres(spark, sf):
    good, bad = cat.parse_granules(_granule_listing(spark, sf))
    g = good.select("k", "product", "granule", "time", F.lit(False).alias("rejected"))
    return g.unionByName(bad.select("k", F.lit(True).alias("rejected")), allowMissingColumns=True)


def _first(order: str, keys: str = "site, date") -> str:
    return f"SELECT {keys}, arg_min(path, struct_pack(a := {order}, b := path)) AS path FROM pq GROUP BY {keys}"


@query("src_catalog_prefer_resolution", with_(LIST, PARSED) + _first("CASE version WHEN '1' THEN 0 WHEN '0' THEN 1 ELSE 2 END"))
def src_catalog_prefer_resolution(spark, sf):
    """Fine-resolution product first, then the standard one."""
    f = cat.parse_daily(listing(spark, sf))
    return cat.prefer(f, ["site", "date"], [cat.rank_of("version", ["1", "0"])], ["path"])


@query("src_catalog_prefer_version", with_(LIST, PARSED) + _first("CASE WHEN version = '2' THEN 0 WHEN instrument = 'F' THEN 1 ELSE 2 END"))
def src_catalog_prefer_version(spark, sf):
    """Corrected file, then new-style name, then old-style name."""
    f = cat.parse_daily(listing(spark, sf))
    order = F.when(F.col("version") == "2", 0).when(F.col("instrument") == "F", 1).otherwise(2)
    return cat.prefer(f, ["site", "date"], [order], ["path"])


@query("src_catalog_prefer_instrument", with_(LIST, PARSED) + _first("CASE instrument WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"))
def src_catalog_prefer_instrument(spark, sf):
    f = cat.parse_daily(listing(spark, sf))
    return cat.prefer(f, ["site", "date"], [cat.rank_of("instrument", ["P", "O"])], ["path"])


@query("src_catalog_first_per_date", with_(LIST, PARSED) + "SELECT site, date, min(path) AS path FROM pq GROUP BY ALL")
def src_catalog_first_per_date(spark, sf):
    return cat.prefer(cat.parse_daily(listing(spark, sf)), ["site", "date"], [], ["path"])


@query("so_first_by_priority", with_(LIST, PARSED) + _first("CASE instrument WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END", "site"))
def so_first_by_priority(spark, sf):
    f = cat.parse_daily(listing(spark, sf))
    return cat.prefer(f, ["site"], [cat.rank_of("instrument", ["O", "F"])], ["path"])


@query("src_product_dirs", "SELECT p_partkey, '/' || p_type || '.P' || p_size || '_R0' AS dir, 'P' || p_size || '_R0' AS version FROM part WHERE p_type LIKE 'ECON%'")
def src_product_dirs(spark, sf):
    p = table(spark, sf, "part").withColumn("path", F.concat(F.lit("/"), "p_type", F.lit(".P"), F.col("p_size").cast("string"), F.lit("_R0/x.hdf")))
    f = cat.product_files(p, "ECON")
    return f.select("p_partkey", F.concat(F.lit("/"), "product_dir").alias("dir"), F.col("product_version").alias("version"))


@query("src_fractional_hours", "SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) + CAST(round_even((l_quantity / 3e0) * 3.6e9, 0) AS BIGINT) AS us FROM lineitem")
def src_fractional_hours(spark, sf):
    t = tb.fractional_hours(F.to_date("l_shipdate"), F.col("l_quantity") / 3.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.unix_micros(t).alias("us"))


@query("src_hour_index", with_(GRID) + "SELECT k, layer, epoch_us(CAST(day AS TIMESTAMP)) + ((CAST(hour_index AS BIGINT) - 1) * 3600 + 1800) * 1000000 AS us FROM gr")
def src_hour_index(spark, sf):
    return grid(spark, sf).select("k", "layer", F.unix_micros(tb.hour_index_time("day", "hour_index")).alias("us"))


@query("src_fill_scale_rename", with_(GRID) + f"""SELECT k, layer, CASE layer WHEN 1 THEN 'high' WHEN 2 THEN 'mid_high' WHEN 3 THEN 'mid_low' WHEN 4 THEN 'low' WHEN 5 THEN 'total' ELSE 'unknown' END AS layer_name,
 {R('nullif(obs_cld_amount, -999e0) / 100')} AS obs_cloud_cover, {R('nullif(adj_cld_amount, -999e0) / 100')} AS adj_cloud_cover FROM gr""")
def src_fill_scale_rename(spark, sf):
    d = tb.decode_grid(grid(spark, sf), r"^(obs|adj)_", ["k"])
    return d.select("k", "layer", "layer_name", r6("obs_cloud_cover").alias("obs_cloud_cover"), r6("adj_cloud_cover").alias("adj_cloud_cover"))


@query("src_multi_file", f"SELECT p_partkey, {R('p_retailprice / 9.80665e0')} AS surface_altitude FROM part")
def src_multi_file(spark, sf):
    d = tb.multi_file(spark, f"{sf}/part*.parquet", "p_retailprice")
    return d.select("p_partkey", r6("surface_altitude").alias("surface_altitude"))


GROUPS = "gs AS (SELECT site, instrument, date, value FROM o UNION ALL SELECT CASE WHEN k % 2 = 0 THEN site ELSE 'only' || site END, 'super', date, value FROM o)"


def _groups(spark, sf):
    o = orders_series(spark, sf)
    sup = o.withColumn("site", F.when(F.pmod("k", F.lit(2)) == 0, F.col("site")).otherwise(F.concat(F.lit("only"), "site"))).withColumn("instrument", F.lit("super"))
    return o.unionByName(sup).select("site", "instrument", "date", "value")


@query("src_group_scan", with_(ORD, GROUPS) + f"""SELECT site, instrument, CAST(count(*) AS BIGINT) AS n, {R('avg(value)', 4)} AS value FROM gs
 WHERE instrument <> 'super' OR site NOT IN (SELECT site FROM gs WHERE instrument <> 'super') GROUP BY ALL""")
def src_group_scan(spark, sf):
    d = tb.drop_synthetic(_groups(spark, sf), ["site"])
    return d.groupBy("site", "instrument").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), 4).alias("value"))


@query("src_group_scan_named", with_(ORD, GROUPS) + f"SELECT site, date, {R('avg(value)', 4)} AS value FROM gs WHERE instrument = 'super' GROUP BY ALL")
def src_group_scan_named(spark, sf):
    """One named group of a partitioned product: the filter prunes the other groups' files."""
    path = sinks.write_table(_groups(spark, sf), "groups", ["instrument"])
    d = spark.read.parquet(path).where(F.col("instrument") == "super")
    return d.groupBy("site", "date").agg(r6(F.avg("value"), 4).alias("value"))


@query("src_candidate_path", "SELECT o_orderkey, o_totalprice FROM orders")
def src_candidate_path(spark, sf):
    d = tb.first_existing(spark, [f"{sf}/orders_daily.parquet", f"{sf}/orders_3day.parquet", f"{sf}/orders.parquet", f"{sf}/lineitem.parquet"])
    return d.select("o_orderkey", "o_totalprice")


@query("snk_partitioned", with_(ORD) + f"SELECT site, instrument, CAST(count(*) AS BIGINT) AS n, {R('sum(value)', 2)} AS total FROM o GROUP BY ALL")
def snk_partitioned(spark, sf):
    back = sinks.write_and_read(orders_series(spark, sf).withColumn("product", F.lit("raw")), "series", ["product", "site", "instrument"])
    return back.groupBy("site", "instrument").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 2).alias("total"))


@query("snk_level1_product", with_(PF) + f"SELECT id, site, fog_flag, CAST(n AS BIGINT) AS gates, {R('list_sum(b)')} AS total, 'net-a' AS data_source FROM p")
def snk_level1_product(spark, sf):
    d = sinks.level1_product(profiles(spark, sf).withColumn("scratch_only", F.lit(1)), "net-a")
    back = sinks.write_and_read(d, "level1", ["site"])
    return back.select("id", "site", "fog_flag", F.size("beta_raw").cast("bigint").alias("gates"), r6(F.aggregate("beta_raw", F.lit(0.0), lambda a, x: a + x)).alias("total"), "data_source")


@query("snk_segmented_compaction", with_(EV, "u AS (SELECT * FROM e UNION ALL SELECT * FROM e)") + f"""SELECT site, instrument, year(time) AS year, CAST(count(*) AS BIGINT) AS n, {R('sum(value)', 2)} AS total
 FROM (SELECT site, instrument, time, arg_min(value, event_id) AS value FROM u GROUP BY ALL) WHERE NOT (site = 'click' AND day(time) IN (3, 4)) GROUP BY ALL""")
def snk_segmented_compaction(spark, sf):
    e = event_samples(spark, sf).select("site", "instrument", "time", "value", "event_id")
    bad = e.where((F.col("site") == "click") & F.dayofmonth("time").isin(3, 4)).select("site", "instrument", F.to_date("time").alias("date")).distinct()
    out = sinks.compact_segments([e, e], bad, ["site", "instrument"], order="event_id").withColumn("year", F.year("time"))
    back = sinks.write_and_read(out, "compact", ["site", "instrument", "year"])
    return back.groupBy("site", "instrument", "year").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 2).alias("total"))


@query("snk_catalog", with_(LIST, PARSED) + "SELECT site, instrument, CAST(count(*) AS BIGINT) AS n, min(date) AS first, max(date) AS last FROM pq GROUP BY ALL")
def snk_catalog(spark, sf):
    back = sinks.write_and_read(cat.parse_daily(listing(spark, sf)), "catalog")
    return back.groupBy("site", "instrument").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("cat_upsert", with_(LIST) + """SELECT path, arg_max(length, struct_pack(a := gen, b := k)) AS length, max(gen) = 1 AS is_new FROM
 (SELECT path, length, k, 0 AS gen FROM fl WHERE k % 3 <> 0 UNION ALL SELECT path, length + 1, k, 1 FROM fl WHERE k % 2 = 0) GROUP BY path""")
def cat_upsert(spark, sf):
    fl = listing(spark, sf)
    old = fl.where(F.pmod("k", F.lit(3)) != 0)
    new = fl.where(F.pmod("k", F.lit(2)) == 0).select("path", (F.col("length") + 1).alias("length"), "k", F.lit(True).alias("is_new"))
    out = cat.upsert(old, new, "path", "k")
    return out.select("path", "length", F.coalesce("is_new", F.lit(False)).alias("is_new"))


@query("win_latest_per_key", with_(LIST) + "SELECT path, max(k) AS k, arg_max(length, k) AS length FROM fl GROUP BY path")
def win_latest_per_key(spark, sf):
    fl = listing(spark, sf)
    return cat.upsert(None, fl, "path", "k").select("path", "k", "length")


@query("cat_incremental", with_(LIST, SITES, "sg AS (SELECT sha256(string_agg(site, chr(10) ORDER BY site)) AS signature FROM (SELECT DISTINCT site FROM st))") +
       "SELECT k, path, signature FROM fl, sg WHERE path NOT IN (SELECT path FROM fl WHERE k % 5 < 2)")
def cat_incremental(spark, sf):
    fl = listing(spark, sf)
    sig = cat.site_signature(sites(spark, sf)).scalar()
    done = fl.where(F.pmod("k", F.lit(5)) < 3).select("path", F.when(F.pmod("k", F.lit(5)) < 2, sig).otherwise(F.lit("other set")).alias("signature"))
    return cat.pending(fl, done, sig).select("k", "path", sig.alias("signature"))


@query("cat_quality_gate", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (coalesce(CASE WHEN l_linenumber <> 3 THEN l_tax END > 0.06, false) OR coalesce(CASE WHEN l_linenumber <> 2 THEN l_quantity END < 10, false))""")
def cat_quality_gate(spark, sf):
    d = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("qc_tax"),
        F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("window_transmission"))
    return cat.quality_gate(d, {"qc_tax": 0.06, "window_transmission": 10.0, "absent_state": 1.0}).select("l_orderkey", "l_linenumber")


@query("pipe_grid_to_sites", with_(GRID, SITES, """lats AS (SELECT DISTINCT lat FROM gr), lons AS (SELECT DISTINCT lon FROM gr)""",
 """sc AS (SELECT st.site, (SELECT arg_min(lat, struct_pack(a := abs(lat - st.lat), b := -lat)) FROM lats) AS cell_lat,
 (SELECT arg_min(lon, struct_pack(a := abs(lon - ((st.lon + 360) % 360)), b := -lon)) FROM lons) AS cell_lon FROM st)""") +
 f"""SELECT site, k, layer, epoch_us(CAST(day AS TIMESTAMP)) + ((CAST(hour_index AS BIGINT) - 1) * 3600 + 1800) * 1000000 AS us, {R('nullif(obs_cld_amount, -999e0) / 100', 5)} AS obs_cloud_cover
 FROM gr JOIN sc ON gr.lat = sc.cell_lat AND gr.lon = sc.cell_lon""")
def pipe_grid_to_sites(spark, sf):
    from ..operators import joins as jn

    g = tb.decode_grid(grid(spark, sf), r"^obs_", ["k", "lat", "lon", "day", "hour_index"])
    g = g.withColumn("time", tb.hour_index_time("day", "hour_index")).withColumn("obs_cloud_cover", F.col("obs_cloud_cover").cast("float"))
    out = jn.nearest_cell(g, sites(spark, sf))
    back = sinks.write_and_read(out.withColumn("date", F.to_date("time")), "sat-sites", [])
    return back.select("site", "k", "layer", F.unix_micros("time").alias("us"), r6(F.col("obs_cloud_cover").cast("double"), 5).alias("obs_cloud_cover"))
