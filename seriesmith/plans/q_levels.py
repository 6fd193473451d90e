"""Level-1 and level-2 products as single calls, on embedding vectors (profiles and model columns) and lineitem (layers)."""

from pyspark.sql import functions as F

from ..core import r6
from ..operators import clean as cl
from ..operators import levels as lv
from ..sources import tables as tb
from .inputs import GRID, PF, R, grid, profiles, with_
from .q_clean import INST_SQL
from .q_columns import COLS, IDS, PRESS, SLABS, columns, overlap_sql
from .q_profile import BOUNDS, CHAIN, DIFF, MASK, PEAKS, PRODUCT, QUAL, SMOOTH, gates
from .registry import query

# Source files by day: label, network and station of each; half of them are of a smoothed type.
FILE_LABELS = ["cl61d 2", "LD40 ceilometer", "no name", "POLLYXT 1"]
FILE_NETS = ["fmi", "niwa", "cloudnet"]
NET_CAL = "CASE WHEN network = 'niwa' THEN 1e0 ELSE 1.2e0 * CASE instrument WHEN 'LD40' THEN 2.45e0 ELSE 1e0 END END"
RAW = f"""s0 AS (SELECT *, {FILE_LABELS!r}[1 + label % 4] AS lab, {FILE_NETS!r}[1 + label % 3] AS network FROM p0),
s1 AS (SELECT *, {INST_SQL.replace('label', 'lab')} AS instrument, arg_min(id, id) OVER (PARTITION BY day, id // 4) = id AS first,
 coalesce(50 + id % 9 >= 51, true) AS fine FROM s0),
s2 AS (SELECT day, median(CASE WHEN label % 2 = 0 THEN 10e0 + id % 7 END) AS alt, cos(radians(median(CAST(id % 5 AS DOUBLE)))) AS vf, median(0.5e0 + id % 3) AS rec
 FROM s1 WHERE first GROUP BY day),
p AS (SELECT s1.*, coalesce(alt, 0e0) AS alt, vf, rec FROM s1 JOIN s2 USING (day) WHERE first AND fine AND instrument <> '{cl.GENERIC}'),
g AS (SELECT id, site, label, day, n, instrument, i, 10e0 * i AS r, 10e0 * i * vf + alt AS h, rec, {NET_CAL} AS cal,
 b[i] * {NET_CAL} AS b FROM p, LATERAL (SELECT unnest(range(1, n + 1)) AS i)),
lfog AS (SELECT id, abs(sum(b)) > 0.005e0 AS fog FROM g WHERE i <= 20 GROUP BY id)"""
# the smoothed types are screened by the smoothed signal, noise comes from the raw one
LEVEL1_U = """u AS (SELECT sc.id, sc.day, sc.n, sc.i, sc.r, g.b, instrument IN ('CL61') AS smoothed, sc.x AS raw, CASE WHEN instrument = 'CL61' THEN CASE WHEN sc.x > 1e-6 THEN sc.x ELSE sm.v END ELSE sc.x END AS x
 FROM sc JOIN sm USING (day, row, i) JOIN g ON g.id = sc.id AND g.i = sc.i)"""
CHAIN1 = CHAIN.replace("stddev_pop(x)", "stddev_pop(raw)")
# kernels of the defaults: 60 s by the file's median step, 10 m on 10 m gates, strong values from 1e-6
SMOOTH1 = SMOOTH.replace("least(x, 5e0)", "least(x, 1e-6)").replace("(lead(id) OVER (PARTITION BY day ORDER BY id) - id) * 15e0", "(lead(id // 4) OVER (PARTITION BY day ORDER BY id) - id // 4) * 60e0").replace("300e0", "60e0")


def _source(spark, sf):
    """Profiles under their source names, four repeated times each, in km, with file values in scalar columns."""
    lab = F.datediff("day", F.lit("2020-01-01").cast("date"))
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.pmod(lab, F.lit(len(xs))))
    p = profiles(spark, sf)
    return p.select(
        "id", "site", "day", F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + F.floor(F.col("id") / 4) * 60).alias("time"),
        F.col("beta_raw").alias("backscatter"), F.transform("range", lambda r: r / 1000.0).alias("range"), F.lit("km").alias("range_units"),
        pick(FILE_LABELS).alias("label"), pick(FILE_NETS).alias("network"), F.when(F.pmod(lab, F.lit(2)) == 0, F.pmod("id", F.lit(7)) + 10.0).alias("alt"),
        F.pmod("id", F.lit(5)).cast("double").alias("tilt_angle"), (F.pmod("id", F.lit(3)) + 0.5).alias("scaling"),
        (F.pmod("id", F.lit(9)) + 50.0).alias("laser"))


@query("pipe_level1", with_(PF.split(",\np AS")[0], RAW, SMOOTH1, LEVEL1_U, CHAIN1) +
       f"""SELECT f2.id, f2.i - 1 AS gate, instrument, fog AS fog_flag, {R('g.h')} AS height, {R('g.rec')} AS recorded_scaling, {R('g.cal')} AS factor,
 {R('CASE WHEN smoothed THEN CASE WHEN z IS NOT NULL AND g.b >= 0 THEN g.b END ELSE z * pow(f2.r / 1000, 2) END', 6)} AS v
 FROM f2 JOIN lfog USING (id) JOIN g ON g.id = f2.id AND g.i = f2.i""")
def pipe_level1(spark, sf):
    """The whole level-1 chain: names, km, repeated times, instruments, altitude, tilt, networks, status, smoothing."""
    out = lv.level1(_source(spark, sf), ["day"], "id", calibration=1.2, status="laser", status_limit=51.0, fog_limit=0.005, noise_min=0.2, keep_above=20.0)
    z = F.zip_with("height", "beta", lambda h, b: F.struct(h.alias("h"), b.alias("b")))
    d = out.select("id", "instrument", "fog_flag", "recorded_scaling", "calibration_factor", F.posexplode(z).alias("gate", "s"))
    return d.select("id", "gate", "instrument", "fog_flag", r6("s.h").alias("height"), r6("recorded_scaling").alias("recorded_scaling"),
                    r6("calibration_factor").alias("factor"), r6("s.b", 6).alias("v"))


L2 = """t2 AS (SELECT cp.*, p.day, TIMESTAMP '2020-01-01' + to_seconds(CAST(label * 86400 + (cp.id * 15 // 60) * 60 AS BIGINT)) AS time FROM cp JOIN p ON p.id = cp.id),
u2 AS (SELECT * FROM t2 WHERE time BETWEEN CAST(day AS TIMESTAMP) AND CAST(day AS TIMESTAMP) + INTERVAL 1 DAY QUALIFY row_number() OVER (PARTITION BY day, time ORDER BY id) = 1)"""


@query("pipe_level2_profiles", with_(PF, DIFF, PEAKS, BOUNDS, QUAL, MASK, PRODUCT, L2) + """SELECT id, day, CAST(asl AS DOUBLE) AS base_asl, CAST(agl AS DOUBLE) AS base_agl, CASE WHEN asl IS NOT NULL THEN 1e0 ELSE 0e0 END AS cloud_flag,
 CASE WHEN f AND NOT low THEN NULL WHEN low THEN 1e0 ELSE 0e0 END AS low_cloud_flag, CASE WHEN low OR f THEN 1e0 ELSE 0e0 END AS low_cloud_and_fog_flag, CASE WHEN f AND NOT low THEN 1e0 ELSE 0e0 END AS fog_flag FROM u2""")
def pipe_level2_profiles(spark, sf):
    p = profiles(spark, sf).withColumn("time", F.date_trunc("minute", "time")).withColumnRenamed("beta_raw", "beta")
    setting = dict(amplitude=0.05, factor=4.0, below_m=40.0, above_m=30.0, max_width=60.0, min_gradient=0.002, min_alt=100.0)
    out = lv.level2_profiles(p, ["day"], "id", low_m=250.0, layers=setting)
    return out.select("id", "day", F.col("cloud_base_height_asl").alias("base_asl"), F.col("cloud_base_height_agl").alias("base_agl"),
                      "cloud_flag", "low_cloud_flag", "low_cloud_and_fog_flag", "fog_flag")


OUT2 = ("base", "base_liquid", "base_liquid_mixed", "base_ice", "base_agl", "base_liquid_agl")
LOWS = ("low_liquid", "low_liquid_mixed", "low_ice", "low_all", "low_pressure")


@query("pipe_level2_columns", with_(
    COLS, PRESS, *SLABS, overlap_sql("tt", "cc", order="i DESC"), overlap_sql("ab", "cc", where="p < 68000e0", order="i DESC"),
    """bs AS (SELECT id, any_value(zs) AS zs, min(CASE WHEN cc > 0.01e0 AND w + ic > 1e-6 THEN h END) AS base, min(CASE WHEN liq > 0 AND w + ic > 1e-6 THEN h END) AS base_liquid,
 min(CASE WHEN lm > 0.01e0 AND w + ic > 1e-6 THEN h END) AS base_liquid_mixed, min(CASE WHEN ice > 0.01e0 AND w + ic > 1e-6 THEN h END) AS base_ice,
 arg_min(i, struct_pack(a := abs(h - zs), b := i)) AS s FROM ph GROUP BY id)""",
    "fg AS (SELECT bs.id, ph.liq > 0.1e0 AS fog FROM bs JOIN ph ON ph.id = bs.id AND ph.i = bs.s)", IDS) +
    f"""SELECT id, CAST(fog AS INTEGER)::DOUBLE AS fog_cover, base, base_liquid, base_liquid_mixed, base_ice, base - zs AS base_agl, base_liquid - zs AS base_liquid_agl,
 {', '.join(f"{R(f'coalesce(s{k}.v, 0e0)')} AS {n}" for k, n in enumerate(LOWS, 1))},
 {R('CASE WHEN coalesce(ab.v, 0e0) < 0.999e0 THEN greatest(0e0, least(1e0, (coalesce(tt.v, 0e0) - coalesce(ab.v, 0e0)) / (1e0 - coalesce(ab.v, 0e0)))) END', 5)} AS low_non_obscured
 FROM ids JOIN bs USING (id) JOIN fg USING (id) {' '.join(f'LEFT JOIN {t} USING (id)' for t in ('s1', 's2', 's3', 's4', 's5', 'tt', 'ab'))}""")
def pipe_level2_columns(spark, sf):
    """Fog starts at a liquid cover of 0.1 here. Under nearly full cover (0.999) the quotient is all rounding, so it is left out."""
    d = lv.level2_columns(columns(spark, sf), dense=0.1, full=0.999)
    return d.select("id", "fog_cover", *OUT2, *[r6(c).alias(c) for c in LOWS], r6("low_non_obscured", 5).alias("low_non_obscured"))


LAYERS = ", ".join(f"max(CASE WHEN layer = {n} THEN {v}_cld_amount / 100 END) AS {v}_{t}" for v in ("obs", "adj") for n, t in ((4, "low"), (5, "total")))


@query("pipe_level2_layers", with_(GRID, "gl AS (SELECT k, layer, avg(nullif(obs_cld_amount, -999e0)) AS obs_cld_amount, avg(nullif(adj_cld_amount, -999e0)) AS adj_cld_amount FROM gr GROUP BY ALL)",
       f"pv AS (SELECT k, {LAYERS} FROM gl GROUP BY k)") + "SELECT k, " + ", ".join(
    f"{R(v + '_low')} AS {v}_low, {R(v + '_total')} AS {v}_total, {R(f'CASE WHEN 1 - {v}_total + {v}_low > 0 THEN greatest(0e0, least(1e0, {v}_low / (1 - {v}_total + {v}_low))) END')} AS {v}_non_obscured"
    for v in ("obs", "adj")) + " FROM pv")
def pipe_level2_layers(spark, sf):
    """Rows of the same key and layer are averaged first: the product refuses conflicting ones."""
    g = tb.decode_grid(grid(spark, sf), r"^(obs|adj)_", ["k"])
    g = g.groupBy("k", "layer").agg(F.avg("obs_cloud_cover").alias("obs"), F.avg("adj_cloud_cover").alias("adj"))
    out = lv.level2_layers(g, ["k"], ["obs", "adj"])
    return out.select("k", *[r6(f"{v}_{t}").alias(f"{v}_{t}") for v in ("obs", "adj") for t in ("low", "total", "non_obscured")])
