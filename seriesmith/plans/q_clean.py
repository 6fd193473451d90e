"""Projections, filters and cleaning."""

from pyspark.sql import functions as F

from ..core import r6
from ..operators import aggregate as ag
from ..operators import clean as cl
from ..operators import profile as pf
from .inputs import EV, ORD, PF, R, SITES, event_samples, orders_series, profiles, sites, table, with_
from .q_profile import BOUNDS, CHAIN, DIFF, PEAKS, PRODUCT, QUAL, U, gates
from .registry import query


@query("prj_km_to_m", with_(PF) + f"SELECT id, i - 1 AS gate, {R('CASE WHEN id % 2 = 0 THEN r / 1000 * 1000 ELSE r END')} AS v FROM g")
def prj_km_to_m(spark, sf):
    p = profiles(spark, sf).withColumn("units", F.when(F.pmod("id", F.lit(2)) == 0, "km").otherwise("m"))
    p = p.withColumn("range", F.transform("range", lambda r: F.when(F.col("units") == "km", r / 1000.0).otherwise(r)))
    return gates(p.withColumn("x", cl.km_to_m("range", "units")), "x")


ANG = "an AS (SELECT day, median(CASE WHEN id % 3 = 0 THEN 20 ELSE 80 + id % 7 END) AS m FROM p GROUP BY day)"


@query("prj_tilt", with_(PF, ANG) + f"SELECT id, i - 1 AS gate, {R('r * sin(radians(CASE WHEN m < 45 THEN 90 - m ELSE m END))')} AS v FROM g JOIN an USING (day)")
def prj_tilt(spark, sf):
    e = F.when(F.pmod("id", F.lit(3)) == 0, F.lit(20)).otherwise(F.lit(80) + F.pmod("id", F.lit(7))).cast("double")
    return gates(cl.tilt_heights(profiles(spark, sf).withColumn("elev", e), ["day"], elevation="elev"), "height")


@query("prj_altitude", with_(PF) + f"SELECT id, {R('coalesce(a.m, 0)')} AS altitude FROM p JOIN (SELECT day, median(CASE WHEN label % 2 = 0 THEN id * 1.5e0 END) AS m FROM p GROUP BY day) a USING (day)")
def prj_altitude(spark, sf):
    lab = F.datediff("day", F.lit("2020-01-01").cast("date"))
    p = profiles(spark, sf).withColumn("alt", F.when(F.pmod(lab, F.lit(2)) == 0, F.col("id") * 1.5))
    return cl.set_altitude(p, ["day"], ["station_altitude", "alt"]).select("id", r6("altitude").alias("altitude"))


@query("prj_height_range", with_(PF) + f"SELECT id, i - 1 AS gate, {R('CASE WHEN id % 2 = 0 THEN r * 0.9e0 + 5 ELSE h END')} AS height, {R('r')} AS rng FROM g")
def prj_height_range(spark, sf):
    even = F.pmod("id", F.lit(2)) == 0
    p = profiles(spark, sf).withColumn("height", F.when(~even, F.col("height"))).withColumn("range", F.when(even, F.col("range")))
    p = cl.fix_height_range(p, F.lit(0.9))
    z = F.zip_with("height", "range", lambda h, r: F.struct(h.alias("h"), r.alias("r")))
    return p.select("id", F.posexplode(z).alias("gate", "s")).select("id", "gate", r6("s.h").alias("height"), r6("s.r").alias("rng"))


# Labels for the resolution check, drawn by key.
LABELS = ["Lufft CHM15k Nimbus", "vaisala cl31 v2", "CL51", "chm15kx-160", "LD40 ceilometer", "no name", "CT75 old", "POLLYXT 1", "cl61d"]
LAB_SQL = "lb AS (SELECT c_custkey AS k, [" + ", ".join(f"'{x}'" for x in LABELS) + "][1 + c_custkey % 9] AS label, c_acctbal AS v, c_nationkey AS nat FROM customer)"
INST_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(label), '{a.lower()}')" for a in (n, *al)) + f" THEN '{n}'" for n, al, *_ in cl.INSTRUMENTS) + f" ELSE '{cl.GENERIC}' END"


def _labels(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), F.get(F.array(*[F.lit(x) for x in LABELS]), F.pmod("c_custkey", F.lit(9)).cast("int")).alias("label"),
        F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("nat"))


@query("prj_instrument_resolve", with_(LAB_SQL) + f"SELECT k, {INST_SQL} AS instrument FROM lb")
def prj_instrument_resolve(spark, sf):
    return _labels(spark, sf).select("k", cl.resolve_instrument("label").alias("instrument"))


CATALOG = "ic AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {s!r}::DOUBLE, {c!r}::DOUBLE)" for n, _, s, c, _ in cl.INSTRUMENTS) + ") t(instrument, scaling, network))"


@query("prj_calibrate", with_(PF, LAB_SQL, CATALOG, f"pi AS (SELECT k AS id, {INST_SQL} AS instrument FROM lb)") +
       f"SELECT id, i - 1 AS gate, {R('b * 1e6 * coalesce(scaling, 1e0) * 1.1e0 * coalesce(network, 1e0)', 4)} AS v FROM g LEFT JOIN pi USING (id) LEFT JOIN ic USING (instrument)")
def prj_calibrate(spark, sf):
    inst = _labels(spark, sf).select(F.col("k").alias("id"), cl.resolve_instrument("label").alias("name"))
    cat = F.broadcast(cl.instruments(spark).select("name", "scaling", "network_calibration"))  # eleven fixed rows
    p = profiles(spark, sf).join(inst, "id", "left").join(cat, "name", "left").withColumn("beta_raw", F.transform("beta_raw", lambda x: x * 1e6))
    one = F.lit(1.0)
    return gates(cl.calibrate(p, F.coalesce("scaling", one), F.lit(1.1), F.coalesce("network_calibration", one)), "beta_raw", n=4)


NETWORKS = ["cloudnet", "knmi", "fmi", "ceda", "niwa", "arm", "metno", "meteoswiss"]
STATIONS = ["palaiseau", "chilbolton", "cabauw", "other"]
NET_SQL = f"nw AS (SELECT *, {NETWORKS!r}[1 + k % 8] AS network, {STATIONS!r}[1 + (k // 8) % 4] AS station, {INST_SQL} AS instrument FROM lb)"


def _networks(spark, sf):
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    return _labels(spark, sf).withColumns({
        "network": pick(NETWORKS, F.pmod("k", F.lit(8))), "station": pick(STATIONS, F.pmod(F.floor(F.col("k") / 8), F.lit(4))),
        "instrument": cl.resolve_instrument("label")})


@query("prj_calibration_overrides", with_(LAB_SQL, NET_SQL, CATALOG, "cf AS (SELECT nw.*, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 1e-8 ELSE 1 + v / 1e4 END AS factor, coalesce(scaling, 1e0) AS sc FROM nw LEFT JOIN ic USING (instrument))") +
       f"""SELECT k, {R('CASE WHEN factor IS NULL THEN 1e0 WHEN factor < 1e-4 THEN factor / sc WHEN station = ' + chr(39) + 'palaiseau' + chr(39) + ' AND instrument = ' + chr(39) + 'CL31' + chr(39) + ' THEN 1.45e0 ELSE factor END')} AS divide_by,
 CASE WHEN network IN ('fmi', 'ceda', 'niwa', 'cloudnet') OR (network = 'knmi' AND instrument = 'CT75k') THEN 1e0 ELSE sc END AS scaling, CASE WHEN network = 'niwa' THEN 1e0 ELSE 1.2e0 END AS calibration FROM cf""")
def prj_calibration_overrides(spark, sf):
    cat = F.broadcast(cl.instruments(spark).select(F.col("name").alias("instrument"), "scaling"))  # eleven fixed rows
    d = _networks(spark, sf).join(cat, "instrument", "left").withColumn("sc", F.coalesce("scaling", F.lit(1.0)))
    m = F.pmod("k", F.lit(5))
    f = F.when(m == 1, F.lit(1e-8)).when(m != 0, F.col("v") / 1e4 + 1)
    return d.select("k", r6(cl.undo_factor(f, F.col("sc"), F.col("station"), F.col("instrument"))).alias("divide_by"),
                    cl.scaling_override(F.col("network"), F.col("instrument"), F.col("sc")).alias("scaling"),
                    cl.calibration_override(F.col("network"), F.lit(1.2)).alias("calibration"))


@query("prj_range_corrected_rules", with_(LAB_SQL, NET_SQL, "nr AS (SELECT *, make_date(2005 + nat, 6, 1) AS d, v AS mr FROM nw)") + """SELECT k, CASE WHEN network <> 'cloudnet' THEN true WHEN station = 'palaiseau' AND mr < 8000 THEN true
 WHEN station = 'chilbolton' AND d < DATE '2014-12-11' THEN false WHEN station = 'cabauw' AND d < DATE '2012-01-01' THEN false ELSE true END AS corrected FROM nr""")
def prj_range_corrected_rules(spark, sf):
    d = _networks(spark, sf)
    start = F.make_date(F.col("nat") + 2005, F.lit(6), F.lit(1)).cast("timestamp")
    return d.select("k", cl.range_corrected_rule(F.col("network"), F.col("station"), start, F.col("v")).alias("corrected"))


@query("prj_source_rename", "SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS gates FROM embeddings")
def prj_source_rename(spark, sf):
    src = table(spark, sf, "embeddings").select("vec_id", F.col("vec_id").alias("time"), F.col("embedding").alias("beta_att"))
    d = cl.harmonise_names(src, ["time", "beta_raw"])
    return d.select(F.col("vec_id").alias("id"), F.size("beta_raw").cast("bigint").alias("gates"))


@query("flt_status_mask", with_(PF) + f"SELECT id, {R('CASE WHEN NOT (coalesce(CASE WHEN id % 4 <> 0 THEN 70 + id % 30 END < 80, false) OR 100 - id % 25 < 80) THEN list_sum(b) END')} AS total FROM p")
def flt_status_mask(spark, sf):
    p = profiles(spark, sf).withColumn("state_laser", F.when(F.pmod("id", F.lit(4)) != 0, F.pmod("id", F.lit(30)) + 70)).withColumn(
        "state_optics", F.lit(100) - F.pmod("id", F.lit(25)))
    p = p.withColumn("b", cl.status_mask("beta_raw", ["state_laser", "state_optics"]))
    return p.select("id", r6(F.aggregate("b", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("flt_dedup_time", with_(EV) + "SELECT site, instrument, date_trunc('hour', time) AS time, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM e GROUP BY ALL")
def flt_dedup_time(spark, sf):
    e = event_samples(spark, sf).select("site", "instrument", F.date_trunc("hour", "time").alias("time"), "event_id", "value")
    return cl.dedup_time(e, ["site", "instrument", "time"], "event_id").select("site", "instrument", F.col("time").cast("timestamp_ntz").alias("time"), "event_id", "value")


@query("flt_empty_profiles", with_(PF) + "SELECT DISTINCT id FROM g WHERE b > 0.3e0")
def flt_empty_profiles(spark, sf):
    p = profiles(spark, sf).withColumn("beta_raw", F.transform("beta_raw", lambda x: F.when(x > 0.3, x)))
    return cl.drop_empty_profiles(p).select("id")


@query("flt_trim_top", with_(PF, "tp AS (SELECT day, max(CASE WHEN abs(b) > 0.3e0 THEN i ELSE 0 END) AS top FROM g GROUP BY day)") + f"SELECT id, i - 1 AS gate, {R('CASE WHEN abs(b) > 0.3e0 THEN b END')} AS v FROM g JOIN tp USING (day) WHERE i <= top")
def flt_trim_top(spark, sf):
    p = profiles(spark, sf).withColumn("beta_raw", F.transform("beta_raw", lambda x: F.when(F.abs(x) > 0.3, x)))
    return gates(cl.trim_top(p, ["day"]), "beta_raw")


@query("flt_sunbeam", with_(PF) + "SELECT id FROM g GROUP BY id, n HAVING count(DISTINCT CASE WHEN r > 100 AND b > 0.1e0 AND i - 1 < (n // 20) * 20 THEN (i - 1) // (n // 20) END) < 10")
def flt_sunbeam(spark, sf):
    p = profiles(spark, sf).withColumn("beta_raw", F.transform("beta_raw", lambda x: F.when(x > 0.1, x)))
    return p.where(cl.sunbeam_ok("beta_raw", "range", 100.0, 20, 10)).select("id")


@query("flt_leap_day", with_(ORD) + "SELECT k, date FROM o WHERE NOT (month(date) = 2 AND day(date) = 29)")
def flt_leap_day(spark, sf):
    return ag.drop_leap_days(orders_series(spark, sf)).select("k", "date")


# one JSON config per event: {site: {instrument: [day or range]}} from the event's own fields
BADCFG = """cfg AS (SELECT site, instrument, CAST(date AS DATE) AS s, CAST(date AS DATE) + CAST(event_id % 3 AS INTEGER) AS e FROM e WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 96),
bd AS (SELECT DISTINCT site, instrument, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS date FROM cfg)"""


def bad_days(spark, sf):
    e = event_samples(spark, sf).where(F.get_json_object("props", "$.k").cast("bigint") > 96)
    s, n = F.to_date("time"), F.pmod("event_id", F.lit(3)).cast("int")
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    entry = F.when(n == 0, iso(s)).otherwise(F.concat(iso(s), F.lit("/"), iso(F.date_add(s, n))))
    cfg = F.to_json(F.create_map(F.upper("site"), F.create_map("instrument", F.array(entry))))
    return cl.bad_day_table(e.select(cfg.alias("config")))


@query("flt_bad_days", with_(EV, BADCFG) + "SELECT event_id, value FROM e WHERE NOT EXISTS (SELECT 1 FROM bd WHERE bd.site = e.site AND bd.instrument = e.instrument AND bd.date = e.date)")
def flt_bad_days(spark, sf):
    return cl.mask_bad_days(event_samples(spark, sf), bad_days(spark, sf), "time").select("event_id", "value")


@query("set_union_days", with_(EV, BADCFG, "b2 AS (SELECT DISTINCT site, instrument, date FROM e WHERE value > 90)") + "SELECT * FROM bd UNION SELECT * FROM b2")
def set_union_days(spark, sf):
    other = event_samples(spark, sf).where("value > 90").select("site", "instrument", F.to_date("time").alias("date"))
    return bad_days(spark, sf).unionByName(other).distinct()


@query("flt_day_clip", with_(EV) + "SELECT event_id FROM e WHERE time >= date_trunc('day', time + INTERVAL 30 MINUTE) AND time <= date_trunc('day', time + INTERVAL 30 MINUTE) + INTERVAL 1 DAY")
def flt_day_clip(spark, sf):
    e = event_samples(spark, sf).withColumn("day", F.to_date(F.col("time") + F.expr("interval 30 minutes")))
    return cl.day_clip(e).select("event_id")


@query("flt_reference_period", with_(ORD) + "SELECT k FROM o WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def flt_reference_period(spark, sf):
    return ag.reference_period(orders_series(spark, sf), "1996-01-01", "2000-12-31").select("k")


COV = "cv AS (SELECT site, greatest(min(date), DATE '1995-06-01') AS s, least(max(date), DATE '2000-12-31') AS e FROM o WHERE value > 100000 GROUP BY site)"


@query("flt_coverage_window", with_(ORD, COV) + "SELECT k, CASE WHEN date BETWEEN s AND e THEN value END AS value FROM o JOIN cv USING (site)")
def flt_coverage_window(spark, sf):
    o = orders_series(spark, sf)
    ref = ag.coverage(o.withColumn("value", F.when(F.col("value") > 100000, F.col("value"))), ["site"], first="1995-06-01", last="2000-12-31", min_years=5)
    return cl.coverage_mask(o, ref, ["site"]).select("k", "value")


GRAN = "gn AS (SELECT DISTINCT o_orderpriority AS site, CASE WHEN o_orderpriority < '4' THEN '3day' ELSE 'monthly' END AS freq FROM orders WHERE o_orderpriority < '5')"
FREQ = "fq AS (SELECT site, '3day' AS freq, k FROM o UNION ALL SELECT site, 'monthly', k FROM o)"


@query("flt_site_granularity", with_(ORD, GRAN, FREQ) + "SELECT site, freq, k FROM fq JOIN gn USING (site, freq)")
def flt_site_granularity(spark, sf):
    o = orders_series(spark, sf).select("site", "k")
    gran = o.where("site < '5'").select("site", F.when(F.col("site") < "4", "3day").otherwise("monthly").alias("freq")).distinct()
    both = o.select("*", F.explode(F.array(F.lit("3day"), F.lit("monthly"))).alias("freq"))
    return cl.choose_granularity(both, gran).select("site", "freq", "k")


@query("flt_min_days_gate", with_(ORD, "a AS (SELECT site, instrument FROM o GROUP BY ALL HAVING count(DISTINCT CASE WHEN value > 150000 THEN date END) >= 480)",
       "b AS (SELECT o.* FROM o JOIN a USING (site, instrument))", "c AS (SELECT site FROM b GROUP BY site HAVING count(DISTINCT CASE WHEN value > 150000 THEN date END) >= 900)") + "SELECT k FROM b JOIN c USING (site)")
def flt_min_days_gate(spark, sf):
    o = orders_series(spark, sf).withColumn("value", F.when(F.col("value") > 150000, F.col("value")))
    return cl.min_days_gate(o, ["site"], per_instrument=480, per_site=900).select("k")


@query("prj_require", with_(LAB_SQL, NET_SQL) + f"SELECT k, CASE WHEN v < 0 THEN 'no raw data' WHEN instrument = '{cl.GENERIC}' THEN 'unknown instrument' END AS reason FROM nw")
def prj_require(spark, sf):
    d = _networks(spark, sf).withColumn("beta_raw", F.when(F.col("v") >= 0, F.array("v")))
    good, bad = cl.split_valid(d)
    return good.select("k", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("k", "reason"))


@query("prj_series_identity", with_(ORD) + "SELECT k, site, instrument FROM o")
def prj_series_identity(spark, sf):
    o = orders_series(spark, sf).withColumn("path", F.concat(F.lit("/"), "site", F.lit("/"), "instrument"))
    o = o.withColumn("site", F.when(F.pmod("k", F.lit(2)) == 0, F.col("site"))).drop("instrument")
    return cl.series_identity(o).select("k", "site", "instrument")


@query("prj_extract_1d", with_(PF) + "SELECT id, site, day, fog_flag FROM p")
def prj_extract_1d(spark, sf):
    return cl.extract_1d(profiles(spark, sf)).select("id", "site", "day", "fog_flag")


@query("prj_flag_to_cover", f"SELECT event_type AS site, {R('avg(CASE WHEN value > 20 THEN 1e0 ELSE 0e0 END)')} AS low_cloud_cover, {R('avg(CASE WHEN value > 50 THEN 1e0 ELSE 0e0 END)')} AS fog_cover FROM events GROUP BY ALL")
def prj_flag_to_cover(spark, sf):
    e = event_samples(spark, sf)
    f = lambda t: r6(F.avg((F.col("value") > t).cast("double")))
    a = e.groupBy("site").agg(f(20).alias("low_cloud_flag"), f(50).alias("fog_flag"), f(5).alias("upper_level_cloud_cover_obs"))
    return cl.flags_to_covers(a)


@query("prj_latitude_class", with_(SITES) + "SELECT site, CASE WHEN abs(lat) <= 66 THEN 'mid' ELSE 'high' END AS lat_class FROM st")
def prj_latitude_class(spark, sf):
    return sites(spark, sf).select("site", cl.latitude_class("lat").alias("lat_class"))


@query("prj_lat_bins", with_(SITES) + "SELECT site, CASE WHEN lat >= 35 AND lat < 45 THEN '35-45' WHEN lat >= 45 AND lat < 55 THEN '45-55' WHEN lat >= 55 AND lat < 65 THEN '55-65' WHEN lat >= 65 AND lat < 75 THEN '65-75' ELSE 'other' END AS lat_bin FROM st")
def prj_lat_bins(spark, sf):
    return sites(spark, sf).select("site", cl.latitude_bin("lat").alias("lat_bin"))


@query("prj_class_map", with_(SITES) + "SELECT site, CASE country WHEN 'C1' THEN 'maritime' WHEN 'C2' THEN 'continental' ELSE 'polar' END AS climate FROM st")
def prj_class_map(spark, sf):
    return sites(spark, sf).select("site", cl.map_class("country", {"C1": "maritime", "C2": "continental"}, "polar").alias("climate"))


PRE = """e1 AS (SELECT *, count(*) FILTER (WHERE abs(b) > 0.02e0) OVER (PARTITION BY id) AS c FROM g),
e2 AS (SELECT id, day, fog_flag, n, i, r, h, b * CASE WHEN id % 3 = 0 THEN 1e0 ELSE pow(r / 1000, 2) END * 1.2e0 AS b FROM e1 WHERE c > 0),
pfog AS (SELECT id, abs(sum(b)) > 0.005e0 AS fog FROM e2 WHERE i <= 20 GROUP BY id)"""


@query("pipe_preprocess", with_(PF, PRE, U.replace("FROM g", "FROM e2").replace("id, site,", "id,"), CHAIN) +
       f"SELECT f2.id, i - 1 AS gate, fog AS fog_flag, {R('z * pow(r / 1000, 2)', 8)} AS v FROM f2 JOIN pfog USING (id)")
def pipe_preprocess(spark, sf):
    """The ordered level-1 chain: a third of the profiles is corrected already, a third not, a third has no flag."""
    third = F.pmod("id", F.lit(3))
    p = profiles(spark, sf).withColumn("range_corrected", F.when(third == 0, F.lit(True)).when(third == 1, F.lit(False)))
    out = cl.preprocess(p, ["id"], ["day"], order="id", scaling=F.lit(1.0), calibration=F.lit(1.2), network=F.lit(1.0), fog_limit=0.005,
                        noise_min=0.2, keep_above=20.0)
    return gates(out, "beta", ["fog_flag"], 8)


SENS = " UNION ALL ".join(f"SELECT id * 3 + {j} AS id, {f!r} AS factor, day, n, fog_flag, i, r, h, b * CAST({f!r} AS DOUBLE) AS b FROM g0" for j, f in enumerate((0.8, 1.0, 1.2)))
MASK3 = "mk AS (SELECT g.id, g.i, g.h, g.day, g.fog_flag, g.factor, EXISTS (SELECT 1 FROM lr WHERE lr.ok AND lr.id = g.id AND g.i BETWEEN lr.base AND lr.top) AS m FROM g)"


@query("pipe_cloud_sensitivity", with_(PF.replace("g AS (SELECT id, site", "g0 AS (SELECT id, site"), f"g AS ({SENS})", DIFF, PEAKS, BOUNDS, QUAL, MASK3,
       PRODUCT.replace("FROM mk GROUP BY id", "FROM mk GROUP BY id, factor").replace("SELECT id, any_value", "SELECT id, factor, any_value")) +
       f"""SELECT CAST(factor AS DOUBLE) AS factor, {R('avg(CASE WHEN asl IS NOT NULL THEN 1e0 ELSE 0e0 END)')} AS cloud_cover,
 {R('avg(CASE WHEN f AND NOT low THEN NULL WHEN low THEN 1e0 ELSE 0e0 END)')} AS low_cloud_cover FROM cp GROUP BY factor""")
def pipe_cloud_sensitivity(spark, sf):
    """Layers found again with the backscatter scaled by 0.8 and 1.2 (all profiles, every factor)."""
    p = profiles(spark, sf).withColumn("beta", F.col("beta_raw"))
    out = cl.with_calibration_factors(p, "beta", [0.8, 1.0, 1.2])
    out = pf.find_layers(out, "beta", "height", 0.05, 4.0, 40.0, 30.0, 60.0, 0.002, 100.0)
    out = out.withColumn("mask", pf.layer_mask(F.col("layers"), F.col("beta")))
    c = pf.cloud_product(out, low_m=250.0)
    return c.groupBy("factor").agg(r6(F.avg("cloud_flag")).alias("cloud_cover"), r6(F.avg("low_cloud_flag")).alias("low_cloud_cover"))
