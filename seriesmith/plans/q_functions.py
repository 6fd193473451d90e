"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from ..core import r6
from ..functions import calendar as cal
from ..functions import scalar as fn
from ..functions import solar
from ..functions.solar import solar_zenith
from ..operators import aggregate as ag
from .inputs import EV, ORD, R, SITES, event_samples, orders_series, sites, table, with_
from .registry import query

NOLEAP = "(dayofyear(date) - CASE WHEN dayofyear(make_date(year(date), 12, 31)) = 366 AND month(date) > 2 THEN 1 ELSE 0 END)"
SEASON = "CASE WHEN month(date) IN (12,1,2) THEN 'DJF' WHEN month(date) IN (3,4,5) THEN 'MAM' WHEN month(date) IN (6,7,8) THEN 'JJA' ELSE 'SON' END"
PI = "3.141592653589793e0"


@query("fn_noleap_doy", with_(ORD) + f"SELECT k, date, {NOLEAP} AS doy FROM o")
def fn_noleap_doy(spark, sf):
    return orders_series(spark, sf).select("k", "date", cal.noleap_doy("date").alias("doy"))


@query("fn_season", with_(ORD) + f"SELECT k, {SEASON} AS season FROM o")
def fn_season(spark, sf):
    return orders_series(spark, sf).select("k", cal.season("date").alias("season"))


@query("fn_month", with_(ORD) + "SELECT k, month(date) AS month FROM o")
def fn_month(spark, sf):
    return orders_series(spark, sf).select("k", F.month("date").alias("month"))


def zenith_sql(t: str, lat: str, lon: str) -> str:
    n = lambda x: f"CAST({x!r} AS DOUBLE)"
    days = f"((epoch_us({t}::TIMESTAMP) / 1e6 - {solar.EPOCH}) / 86400e0)"
    c = f"({days} / 36525e0)"
    poly = lambda p: "(" + " + ".join([n(p[0]), *[" * ".join([c] * k) + f" * {n(x)}" for k, x in enumerate(p[1:], 1)]]) + ")"
    m, node = f"radians({poly(solar.ANOMALY)})", f"radians({poly(solar.NODE)})"
    centre = f"(sin({m}) * {poly(solar.CENTRE[0])} + sin({m} * 2) * {poly(solar.CENTRE[1])} + sin({m} * 3) * {poly(solar.CENTRE[2])})"
    ap = f"radians({poly(solar.LONGITUDE)} + {centre} + {n(solar.ABERRATION)} + sin({node}) * {n(solar.NUTATION)})"
    tilt = f"radians({poly(solar.OBLIQUITY)} + cos({node}) * {n(solar.NUTATION_OBLIQUITY)})"
    side = f"radians({n(solar.SIDEREAL[0])} + {days} * {n(solar.SIDEREAL[1])} + sin({node}) * {n(solar.NUTATION)} * cos({tilt}) + {lon})"
    ra, de = f"atan2(cos({tilt}) * sin({ap}), cos({ap}))", f"asin(sin({tilt}) * sin({ap}))"
    return (f"degrees(acos(greatest(-1e0, least(1e0, sin(radians({lat})) * sin({de}) + "
            f"cos(radians({lat})) * cos({de}) * cos({side} - {ra})))))")


@query("fn_solar_zenith", f"""SELECT event_id, {R(zenith_sql('ts', '(CAST(user_id % 140 AS DOUBLE) - 70e0)', '(CAST(user_id % 360 AS DOUBLE) - 180e0)'), 5)} AS zenith FROM events""")
def fn_solar_zenith(spark, sf):
    e = table(spark, sf, "events").withColumn("time", F.col("ts").cast("timestamp"))
    lat = F.pmod("user_id", F.lit(140)).cast("double") - 70.0
    lon = F.pmod("user_id", F.lit(360)).cast("double") - 180.0
    return e.select("event_id", r6(solar_zenith("time", lat, lon), 5).alias("zenith"))


HAV = ("2e0 * 6371000e0 * asin(sqrt(least(1e0, pow(sin(radians({b1} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({b1})) "
       "* pow(sin((radians({b2}) - radians({a2})) / 2), 2))))")


@query("fn_haversine", with_(SITES) + f"SELECT site, {R(HAV.format(a1='lat', a2='lon', b1='52e0', b2='5e0'), 2)} AS distance_m FROM st")
def fn_haversine(spark, sf):
    return sites(spark, sf).select("site", r6(fn.haversine_m("lat", "lon", F.lit(52.0), F.lit(5.0)), 2).alias("distance_m"))


@query("fn_fourier_basis", with_(ORD, f"b AS (SELECT k, {NOLEAP} * (2e0 * {PI} / 365.25e0) AS x FROM o)") +
       f"""SELECT k, t.i AS term, {R('CASE t.i WHEN 0 THEN sin(x) WHEN 1 THEN cos(x) WHEN 2 THEN sin(x * 2) WHEN 3 THEN cos(x * 2) ELSE sin(x * 3) END')} AS value
       FROM b, (SELECT unnest([0, 1, 2, 3, 4]) AS i) t""")
def fn_fourier_basis(spark, sf):
    o = orders_series(spark, sf).withColumn("doy", cal.noleap_doy("date"))
    return o.select("k", F.posexplode(fn.fourier_basis("doy", 5)).alias("term", "value")).select("k", "term", r6("value").alias("value"))


@query("fn_quantize", with_(ORD) + "SELECT k, CAST(round_even(value / 250e0, 0) AS DOUBLE) AS q FROM o")
def fn_quantize(spark, sf):
    return orders_series(spark, sf).select("k", fn.quantize("value", 250.0).alias("q"))


@query("fn_clip", with_(ORD) + "SELECT k, CASE WHEN k % 11 = 0 THEN NULL ELSE greatest(100000e0, least(300000e0, value)) END AS v FROM o")
def fn_clip(spark, sf):
    v = F.when(F.pmod("k", F.lit(11)) != 0, F.col("value"))
    return orders_series(spark, sf).select("k", fn.clip(v, 100000.0, 300000.0).alias("v"))


ERF = "(sign({x}) * list_sum(list_transform(range(0, 140), lambda n: exp((2 * n + 1) * ln(greatest(abs({x}), 1e-300)) - lgamma(n + 1.5e0) - pow({x}, 2)))))"


def cdf_sql(z: str) -> str:
    x = f"(greatest(-6e0, least(6e0, ({z}) / sqrt(2e0))))"
    return "(0.5e0 * (1e0 + " + ERF.format(x=x) + "))"


@query("fn_normal_cdf_ppf", with_(ORD, "s AS (SELECT site, avg(value) AS m, stddev_samp(value) AS sd FROM o GROUP BY site)",
                                  "z AS (SELECT k, (value - m) / sd AS z FROM o JOIN s USING (site))") +
       f"SELECT k, {R(cdf_sql('z'))} AS cdf, z > CAST({fn.normal_ppf(0.95)!r} AS DOUBLE) AS beyond FROM z")
def fn_normal_cdf_ppf(spark, sf):
    o = orders_series(spark, sf)
    s = o.groupBy("site").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    z = o.join(s, "site").select("k", ((F.col("value") - F.col("m")) / F.col("sd")).alias("z"))
    return z.select("k", r6(fn.normal_cdf("z")).alias("cdf"), (F.col("z") > fn.normal_ppf(0.95)).alias("beyond"))


@query("fn_normalize_key", "SELECT p_partkey, lower(trim(' ' || p_type || ' ')) AS key, replace(replace(lower(trim(p_name || '-X ')), ' ', ''), '-', '') AS instrument_key FROM part")
def fn_normalize_key(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey",
        fn.normalize_key(F.concat(F.lit(" "), "p_type", F.lit(" "))).alias("key"),
        fn.normalize_instrument_id(F.concat("p_name", F.lit("-X "))).alias("instrument_key"),
    )


@query("fn_path_parts", with_(ORD) + "SELECT k, nullif(split_part('/' || site || '/' || instrument, '/', 2), '') AS site, "
       "nullif(split_part('/' || site || '/' || instrument, '/', 3), '') AS instrument FROM o")
def fn_path_parts(spark, sf):
    o = orders_series(spark, sf).withColumn("path", F.concat(F.lit("/"), "site", F.lit("/"), "instrument"))
    return o.select("k", fn.path_part("path", 1).alias("site"), fn.path_part("path", 2).alias("instrument"))


@query("fn_flag_comment", """WITH c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Boolean flag indicating presence of ' WHEN 1 THEN 'Boolean flag ' ELSE 'The flag of ' END || p_name AS c FROM part)
SELECT p_partkey, CASE WHEN contains(c, 'presence of') THEN replace(c, 'Boolean flag indicating presence of ', 'Fraction of samples with ')
 WHEN contains(c, 'Boolean flag ') THEN replace(c, 'Boolean flag ', 'Fraction of samples ') ELSE replace(c, ' flag', ' fraction') END AS comment FROM c""")
def fn_flag_comment(spark, sf):
    m = F.pmod("p_partkey", F.lit(3))
    c = F.concat(
        F.when(m == 0, "Boolean flag indicating presence of ").when(m == 1, "Boolean flag ").otherwise("The flag of "), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", fn.flag_comment_to_fraction(c).alias("comment"))


@query("fn_interp", with_(ORD, "q AS (SELECT site, quantile_cont(value, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9]) AS xp FROM o GROUP BY site)",
                          "l AS (SELECT *, [0e0, 0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0] AS fp FROM q)",
                          "b AS (SELECT o.k, o.value AS x, xp, fp, len(list_filter(xp, lambda a: a <= o.value)) AS i FROM o JOIN l USING (site))") +
       f"""SELECT k, {R('CASE WHEN x <= xp[1] THEN fp[1] WHEN x >= xp[6] THEN fp[6] ELSE fp[i] + (fp[i + 1] - fp[i]) * (x - xp[i]) / (xp[i + 1] - xp[i]) END')} AS p FROM b""")
def fn_interp(spark, sf):
    o = orders_series(spark, sf)
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9]
    tab = ag.exact_quantiles(o, ["site"], "value", ps).withColumnRenamed("quantiles", "xp").withColumn("fp", F.array(*[F.lit(p) for p in ps]))
    return o.join(tab, "site").select("k", r6(fn.interp("value", "xp", "fp")).alias("p"))


@query("fn_unit_scale", f"SELECT l_orderkey AS k, l_linenumber AS n, {R('l_discount * 1000')} AS pp_per_decade FROM lineitem")
def fn_unit_scale(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
        r6(fn.percent_points_per_decade("l_discount")).alias("pp_per_decade"))
