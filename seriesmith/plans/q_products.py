"""Level-3 and level-4 products as single calls, on orders (years, one condition) and events (a month, three conditions)."""

from pyspark.sql import functions as F

from ..core import cut, r6
from ..functions.solar import solar_zenith
from ..operators import products as pr
from ..operators import trend as tr
from . import trend_sql as ts
from .inputs import EV, OFF, ORD, R, event_samples, orders_series, with_
from .q_aggregate import CONDS, doy_clim_sql
from .q_functions import NOLEAP, SEASON
from .q_trend import WIDE, ci_sql, fit_sql
from .registry import query

LEAP = "(month(date) = 2 AND day(date) = 29)"
KEYS = "site, instrument, condition"
STEP = {"3day": ("og + CAST(((date - og) // 3) * 3 AS INTEGER)", "3 DAY"), "month": ("date_trunc('month', date)::DATE", "1 MONTH")}


def level3_sql(samples: str, first: str, last: str, least: int, per_instrument: int, per_site: int) -> str:
    """CTEs from {samples} (keys, date, value) to daily rows da, climatology cl, anomalies an, grand means gd and bins b_3day, b_month."""
    ref = f"date BETWEEN DATE '{first}' AND DATE '{last}'"
    out = f"""dl AS (SELECT {KEYS}, date, avg(value) AS value FROM {samples} WHERE NOT {LEAP} GROUP BY ALL HAVING count(value) >= {least}),
gi AS (SELECT site, instrument FROM dl WHERE condition = 'all' GROUP BY ALL HAVING count(DISTINCT date) >= {per_instrument}),
gs AS (SELECT site FROM dl JOIN gi USING (site, instrument) WHERE condition = 'all' GROUP BY ALL HAVING count(DISTINCT date) >= {per_site}),
da AS (SELECT dl.* FROM dl JOIN gi USING (site, instrument) JOIN gs USING (site)),
bs AS (SELECT {KEYS}, avg(value) AS b FROM da WHERE {ref} GROUP BY ALL),
dm AS (SELECT site, condition, date, value - b AS dv FROM da JOIN bs USING ({KEYS}) WHERE {ref}),
{doy_clim_sql("dm", "site, condition", "dv")},
sh AS (SELECT site, condition, doy, value - avg(value) OVER (PARTITION BY site, condition) AS shared FROM dc),
cl AS (SELECT site, instrument, condition, doy, shared + b AS clim FROM sh JOIN bs USING (site, condition)),
an AS (SELECT {KEYS}, date, value - clim AS anomaly FROM (SELECT *, {NOLEAP} AS doy FROM da) JOIN cl USING ({KEYS}, doy)),
gd AS (SELECT {KEYS}, avg(clim) AS g FROM cl GROUP BY ALL),
ao AS (SELECT *, min(date) OVER (PARTITION BY {KEYS}) AS og FROM an)"""
    for f, (label, step) in STEP.items():
        out += f""",
c_{f} AS (SELECT {KEYS}, {label} AS date, CASE WHEN count(anomaly) >= 0.5 * count(*) THEN avg(anomaly) END AS anomaly FROM ao GROUP BY ALL),
e_{f} AS (SELECT {KEYS}, CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL {step})) AS DATE) AS date FROM c_{f} GROUP BY {KEYS}),
b_{f} AS (SELECT '{f}' AS freq, {KEYS}, date, anomaly, clim + anomaly AS seasonal, g + anomaly AS deseasonalized
 FROM (SELECT *, {NOLEAP} AS doy FROM e_{f} LEFT JOIN c_{f} USING ({KEYS}, date)) LEFT JOIN cl USING ({KEYS}, doy) JOIN gd USING ({KEYS}))"""
    return out


def _show(n: int) -> str:
    cols = ", ".join(f"{R(f'{c} + {OFF}', n)} AS {c}" for c in ("anomaly", "seasonal", "deseasonalized"))
    return f"SELECT freq, {KEYS}, date AS bin, {cols} FROM (SELECT * FROM b_3day UNION ALL SELECT * FROM b_month)"


def _shown(bins, n):
    return bins.select("freq", "site", "instrument", "condition", "bin", *[r6(F.col(c) + OFF, n).alias(c) for c in ("anomaly", "seasonal", "deseasonalized")])


# multi-year daily values
YEARS = ("1996-01-01", "2000-12-31")
ORDERS_3 = "oc AS (SELECT site, instrument, 'all' AS condition, date, value FROM o),\n" + level3_sql("oc", *YEARS, 1, 300, 900)


def orders_level3(spark, sf):
    return pr.level3(orders_series(spark, sf), *YEARS, time="date", min_samples=1, per_instrument=300, per_site=900)


@query("pipe_level3", with_(ORD, ORDERS_3) + _show(4))
def pipe_level3(spark, sf):
    """Daily orders: gates, shared climatology of the reference years, anomalies, 3-day and monthly bins."""
    return _shown(orders_level3(spark, sf).bins, 4)


MONTH = ("2024-01-01", "2024-01-31")


@query("pipe_level3_conditions", with_(EV, CONDS, level3_sql("ec", *MONTH, 2, 5, 10)) + _show(5))
def pipe_level3_conditions(spark, sf):
    """Event samples: all, daytime and nighttime days by the sun's zenith angle."""
    zenith = solar_zenith(F.col("time"), F.lit(48.0), (F.pmod("event_id", F.lit(40)) - 20).cast("double"))
    return _shown(pr.level3(event_samples(spark, sf), *MONTH, zenith=zenith, min_samples=2, per_instrument=5, per_site=10).bins, 5)


NEAR = "EXISTS (SELECT 1 FROM {x} WHERE {x}.site = d1.site AND {x}.condition = d1.condition AND {x}.value IS NOT NULL AND abs({x}.date - d1.date) <= 2)"
LEVEL4 = f"""cv AS (SELECT site, greatest(min(date), DATE '{YEARS[0]}') AS s, least(max(date), DATE '{YEARS[1]}') AS e FROM da GROUP BY site),
mb AS (SELECT {KEYS}, date, CASE WHEN date BETWEEN s AND e THEN deseasonalized END AS value FROM b_3day JOIN cv USING (site)),
iv AS (SELECT {KEYS}, count(DISTINCT date) FILTER (WHERE value IS NOT NULL) AS nd, min(date) FILTER (WHERE value IS NOT NULL) AS fd FROM mb GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY site, condition ORDER BY nd DESC, fd, instrument) AS rank FROM iv),
d1 AS (SELECT mb.*, rank FROM mb JOIN rk USING ({KEYS})),
x1 AS (SELECT * FROM d1 WHERE rank = 1),
x2 AS (SELECT * FROM d1 WHERE rank = 2 AND NOT {NEAR.format(x='x1')}),
x3 AS (SELECT * FROM d1 WHERE rank = 3 AND NOT {NEAR.format(x='x1')} AND NOT {NEAR.format(x='x2')}),
kp AS (SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3),
sq AS (SELECT site, condition, instrument || '|' || {SEASON} AS st, instrument AS inst, date - DATE '1970-01-01' AS t, date, value AS y FROM kp)"""
KEY4 = "site, condition"
TREND4 = fit_sql("sq", KEY4).replace(" / 1e-6", " / 1e-12")
SHOW4 = f"""SELECT site, condition, n_days, {R('p')} AS p, ss, {R('slope * ' + ts.YEAR, 3)} AS slope, {R('slope * ' + ts.YEAR + ' / m', 6)} AS slope_rel,
 lower_1s, upper_1s, lower_2s, upper_2s, lower_3s, upper_3s FROM d4 JOIN sl USING ({KEY4}) JOIN ci USING ({KEY4}) JOIN nd USING ({KEY4}) JOIN mv USING ({KEY4})"""


@query("pipe_level4", with_(ORD, ORDERS_3, LEVEL4, TREND4, "ci0 AS (" + ci_sql("k_vctfpw", "r", KEY4, tr.SIGMA_LEVELS) + ")", f"ci AS (SELECT {KEY4}, {WIDE} FROM ci0 GROUP BY ALL)",
                            f"nd AS (SELECT {KEY4}, CAST(count(DISTINCT CASE WHEN y IS NOT NULL THEN t END) AS BIGINT) AS n_days FROM sq GROUP BY ALL)",
                            f"mv AS (SELECT {KEY4}, avg(y) AS m FROM sq GROUP BY ALL)") + SHOW4)
def pipe_level4(spark, sf):
    """Trends of the orders' deseasonalised 3-day bins, overlap-free and inside the reference's span."""
    three = orders_level3(spark, sf)
    bins = cut(three.bins.where("freq = '3day'").select("site", "condition", "instrument", "freq", F.col("bin").alias("date"), F.col("deseasonalized").alias("value")))
    gran = bins.select("site", "freq").distinct()
    t = pr.level4(bins, gran, three.daily.select("site", "date", "value"), first=YEARS[0], last=YEARS[1]).trends
    ends = [f"{e}_{i}s" for i in (1, 2, 3) for e in ("lower", "upper")]
    return t.select("site", "condition", "n_days", r6("p").alias("p"), F.col("ss").cast("bigint").alias("ss"), r6("slope", 3).alias("slope"),
                    r6("slope_rel", 6).alias("slope_rel"), *[r6(e, 3).alias(e) for e in ends])
