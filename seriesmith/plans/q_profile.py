"""Profile operators on the embedding vectors (64 gates of 10 m; thresholds scaled to their values)."""

from pyspark.sql import functions as F

from ..core import r6
from ..functions import arrays as ar
from ..operators import clean as cl
from ..operators import profile as pf
from .inputs import PF, R, profiles, with_
from .registry import query

U = "u AS (SELECT id, site, day, n, fog_flag, i, r, h, b, b / pow(r / 1000, 2) AS x FROM g)"


def gates(df, col, extra=(), n=6):
    return df.select("id", *extra, F.posexplode(col).alias("gate", "v")).select("id", *extra, "gate", r6("v", n).alias("v"))


@query("pf_range_correct", with_(PF) + f"SELECT id, i - 1 AS gate, {R('b * pow(r / 1000, 2)', 9)} AS v FROM g")
def pf_range_correct(spark, sf):
    p = profiles(spark, sf).withColumn("x", pf.range_correct(F.col("beta_raw"), F.col("range"), F.lit(False)))
    return gates(p, "x", n=9)


@query("pf_range_uncorrect", with_(PF) + f"SELECT id, i - 1 AS gate, {R('b / CASE WHEN r <= 500 THEN pow(r / 1000, 2) ELSE 1e0 END', 4)} AS v FROM g")
def pf_range_uncorrect(spark, sf):
    p = profiles(spark, sf).withColumn("x", pf.range_uncorrect(F.col("beta_raw"), F.col("range"), 500.0, F.col("range_corrected")))
    return gates(p, "x", n=4)


@query("pf_noise_level", with_(PF, U) + f"SELECT id, {R('stddev_pop(x)')} AS noise, {R('CASE WHEN stddev_pop(x) < 0.3e0 THEN stddev_pop(x) ELSE 0.3e0 END')} AS used FROM u WHERE i > n - round_even(n * 0.1e0, 0) GROUP BY id")
def pf_noise_level(spark, sf):
    p = profiles(spark, sf).withColumn("x", pf.noise_level(pf.range_uncorrect(F.col("beta_raw"), F.col("range"))))
    return p.select("id", r6("x").alias("noise"), r6(pf.used_noise(F.col("x"), 0.3)).alias("used"))


# run lengths in long form: the start of each run of negatives among gates [2, 60)
RUN = """nr AS (SELECT *, (b < 0 AND i - 1 >= 2 AND i - 1 < 60) AS neg FROM g),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY id, neg ORDER BY i) AS grp FROM nr),
rl AS (SELECT *, row_number() OVER (PARTITION BY id, neg, grp ORDER BY i) AS run FROM isl),
fs AS (SELECT id, min(CASE WHEN neg AND run > 3 THEN i - 1 END) AS start FROM rl GROUP BY id)"""


@query("pf_negative_runs", with_(PF, RUN) + f"SELECT g.id, i - 1 AS gate, start IS NOT NULL AS flagged, {R('CASE WHEN start IS NULL OR i - 1 < start OR b > 0.15e0 THEN b END')} AS v FROM g JOIN fs USING (id)")
def pf_negative_runs(spark, sf):
    p = profiles(spark, sf).withColumn("s", pf.first_negative_gate(F.col("beta_raw"), 3, 2, 58))
    p = p.withColumn("x", pf.mask_negative_runs(F.col("beta_raw"), F.col("s"), 0.15)).withColumn("flagged", F.col("s").isNotNull())
    return gates(p, "x", ["flagged"])


@query("win_run_length", with_(PF, RUN) + "SELECT id, i - 1 AS gate, CASE WHEN neg THEN run ELSE 0 END AS run FROM rl")
def win_run_length(spark, sf):
    """Consecutive-true counter along the gates."""
    neg = F.transform("beta_raw", lambda x, i: (x < 0) & (i >= 2) & (i < 60))
    return profiles(spark, sf).select("id", F.posexplode(ar.run_lengths(neg)).alias("gate", "run")).withColumn("run", F.col("run").cast("bigint"))


@query("pf_fog_above_peak", with_(PF, "pk AS (SELECT id, arg_max(i, struct_pack(a := b, b := -i)) AS peak FROM g GROUP BY id)") +
       f"SELECT g.id, i - 1 AS gate, {R('CASE WHEN NOT (fog_flag AND i > peak AND b < 0.05e0) THEN b END')} AS v FROM g JOIN pk USING (id)")
def pf_fog_above_peak(spark, sf):
    return gates(profiles(spark, sf).withColumn("x", pf.mask_fog_above_peak(F.col("beta_raw"), F.col("fog_flag"), 0.05)), "x")


@query("pf_snr_screen", with_(PF, "ns AS (SELECT id, stddev_pop(b) AS s FROM g WHERE i > n - 6 GROUP BY id)") +
       f"SELECT g.id, i - 1 AS gate, {R('CASE WHEN b / s >= 1.5e0 THEN b END')} AS v FROM g JOIN ns USING (id)")
def pf_snr_screen(spark, sf):
    p = profiles(spark, sf).withColumn("s", pf.noise_level(F.col("beta_raw")))
    return gates(p.withColumn("x", pf.snr_screen(F.col("beta_raw"), F.col("s"), 1.5)), "x")


CHAIN = """rl0 AS (SELECT *, (x < 0 AND i - 1 >= 5 AND i - 1 < 100) AS neg FROM u),
il0 AS (SELECT *, i - row_number() OVER (PARTITION BY id, neg ORDER BY i) AS grp FROM rl0),
rn0 AS (SELECT *, row_number() OVER (PARTITION BY id, neg, grp ORDER BY i) AS run FROM il0),
st0 AS (SELECT id, min(CASE WHEN neg AND run > 5 THEN i - 1 END) AS start FROM rn0 GROUP BY id),
nz0 AS (SELECT id, stddev_pop(x) AS noise FROM u WHERE i > n - 6 GROUP BY id),
f1 AS (SELECT u.*, noise, start, CASE WHEN start IS NULL OR i - 1 < start OR x > 2e1 THEN x END AS y FROM u JOIN st0 USING (id) JOIN nz0 USING (id)),
f2 AS (SELECT *, CASE WHEN y / CASE WHEN noise < 0.2e0 THEN noise ELSE 0.2e0 END >= 5 THEN y END AS z FROM f1)"""


@query("pf_filter_chain", with_(PF, U, CHAIN) + f"SELECT id, i - 1 AS gate, start IS NOT NULL AS flagged, {R('z * pow(r / 1000, 2)', 8)} AS v FROM f2")
def pf_filter_chain(spark, sf):
    p = pf.filter_chain(profiles(spark, sf), noise_min=0.2, keep_above=20.0)
    return gates(p.withColumnRenamed("cleaned_negative_profile_flag", "flagged"), "beta", ["flagged"], 8)


@query("pf_fog_sum", with_(PF) + "SELECT id, abs(sum(b)) > 0.3e0 AS fog FROM g WHERE i <= 20 GROUP BY id")
def pf_fog_sum(spark, sf):
    return profiles(spark, sf).select("id", pf.fog_by_sum(F.col("beta_raw"), 20, 0.3).alias("fog"))


@query("pf_fog_attenuation", with_(PF) + "SELECT id, max(CASE WHEN i <= 2 THEN b END) > 0.05e0 AND max(CASE WHEN r = 250 THEN b END) < 0.02e0 AS fog FROM g GROUP BY id")
def pf_fog_attenuation(spark, sf):
    return profiles(spark, sf).select("id", pf.fog_by_attenuation(F.col("beta_raw"), F.col("range"), 250.0, 0.02, 0.05).alias("fog"))


@query("pf_gate_spacing", with_(PF, "d AS (SELECT id, b - lag(b) OVER (PARTITION BY id ORDER BY i) AS d FROM (SELECT id, i, h + i * i + abs(b) AS b FROM g))") +
       f"SELECT id, {R('median(d)')} AS spacing, CAST(round_even(200e0 / median(d), 0) AS BIGINT) AS win_below FROM d WHERE d IS NOT NULL GROUP BY id")
def pf_gate_spacing(spark, sf):
    """Median spacing of an uneven height grid (heights stretched by gate number and value)."""
    h = F.zip_with("height", "beta_raw", lambda h, b: F.struct(h.alias("h"), b.alias("b")))
    p = profiles(spark, sf).withColumn("hh", F.transform(h, lambda s, i: s["h"] + (i + 1) * (i + 1) + F.abs(s["b"])))
    p = p.withColumn("s", pf.gate_spacing(F.col("hh")))
    return p.select("id", r6("s").alias("spacing"), F.rint(F.lit(200.0) / F.col("s")).cast("bigint").alias("win_below"))


DIFF = "df AS (SELECT *, coalesce(lead(b) OVER (PARTITION BY id ORDER BY i) - b, 0e0) AS d FROM g)"


@query("pf_first_diff", with_(PF, DIFF) + f"SELECT id, i - 1 AS gate, {R('d')} AS v FROM df")
def pf_first_diff(spark, sf):
    return gates(profiles(spark, sf).withColumn("x", pf.first_diff(F.col("beta_raw"))), "x")


PEAKS = """pk AS (SELECT id, i FROM (SELECT id, i, n, b, max(b) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS lm,
 max(b) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS rm FROM g) WHERE b > 0.05e0 AND b > lm AND b > rm)"""
# windows of 40 m and 30 m on 10 m gates: 4 below, 3 above
BOUNDS = """wb AS (SELECT pk.id, pk.i AS p, min(df.d) FILTER (WHERE df.i >= pk.i) AS mn, max(df.d) FILTER (WHERE df.i < pk.i) AS mx FROM pk JOIN df ON df.id = pk.id AND df.i >= pk.i - 4 AND df.i < pk.i + 3 GROUP BY ALL),
ly AS (SELECT wb.id, wb.p, min(CASE WHEN df.i < wb.p AND df.d > mx / 4e0 THEN df.i END) AS base, max(CASE WHEN df.i >= wb.p AND df.d < mn / 4e0 THEN df.i + 1 END) AS top
 FROM wb JOIN df ON df.id = wb.id AND df.i >= wb.p - 4 AND df.i < wb.p + 3 GROUP BY ALL),
lz AS (SELECT * FROM ly WHERE base IS NOT NULL AND top IS NOT NULL)"""
QUAL = """lq AS (SELECT lz.*, (SELECT count(*) FROM g WHERE g.id = lz.id AND g.i BETWEEN lz.base AND lz.top AND g.b <> 0) AS pts, bp.b AS bp, bp.h AS hp, bt.b AS bt, bt.h AS ht, bb.h AS hb
 FROM lz JOIN g bp ON bp.id = lz.id AND bp.i = lz.p JOIN g bt ON bt.id = lz.id AND bt.i = least(lz.top, 64) JOIN g bb ON bb.id = lz.id AND bb.i = lz.base),
lr AS (SELECT *, (pts >= 3 AND ht - hb < 60 AND coalesce((bp - bt) / nullif(ht - hp, 0), 0) > 0.002e0 AND hp - 15 >= 100) AS ok FROM lq)"""


def _layers(spark, sf):
    p = profiles(spark, sf)
    z, d = F.col("beta_raw"), pf.first_diff(F.col("beta_raw"))
    p = p.withColumn("pk", pf.local_maxima(z, 4, 0.05)).withColumn("d", d)
    return p.withColumn("ly", pf.layer_bounds(z, F.col("d"), F.col("pk"), F.lit(4), F.lit(3), 4.0))


@query("pf_local_maxima", with_(PF, PEAKS) + "SELECT id, i - 1 AS gate FROM pk")
def pf_local_maxima(spark, sf):
    return profiles(spark, sf).select("id", F.explode(pf.local_maxima(F.col("beta_raw"), 4, 0.05)).alias("gate"))


@query("pf_layer_bounds", with_(PF, DIFF, PEAKS, BOUNDS) + "SELECT id, p - 1 AS peak, base - 1 AS base, top - 1 AS top FROM lz")
def pf_layer_bounds(spark, sf):
    return _layers(spark, sf).select("id", F.inline("ly")).select("id", "peak", "base", "top")


@query("pf_layer_qualify", with_(PF, DIFF, PEAKS, BOUNDS, QUAL) + "SELECT id, p - 1 AS peak, ok FROM lr")
def pf_layer_qualify(spark, sf):
    q = F.transform("ly", lambda s: F.struct(s["peak"].alias("peak"), pf.layer_qualifies(s, F.col("beta_raw"), F.col("height"), 3, 60.0, 0.002, 100.0).alias("ok")))
    return _layers(spark, sf).select("id", F.inline(q))


@query("pf_layer_contrast", with_(PF, DIFF, PEAKS, BOUNDS, """ct AS (SELECT lz.id, lz.p, bp.b AS bp, (SELECT max(i) FROM g WHERE g.id = lz.id AND g.h <= bp.h - 55) AS li, (SELECT min(i) FROM g WHERE g.id = lz.id AND g.h >= bp.h + 55) AS hi
 FROM lz JOIN g bp ON bp.id = lz.id AND bp.i = lz.p)""") + """SELECT ct.id, p - 1 AS peak, li IS NOT NULL AND hi IS NOT NULL AND coalesce(CASE WHEN greatest(a.b, c.b, 0) <= 0 THEN bp > 0 ELSE bp >= 3 * greatest(a.b, c.b, 0) END, false) AS ok
 FROM ct LEFT JOIN g a ON a.id = ct.id AND a.i = li LEFT JOIN g c ON c.id = ct.id AND c.i = hi""")
def pf_layer_contrast(spark, sf):
    q = F.transform("ly", lambda s: F.struct(s["peak"].alias("peak"), pf.layer_contrast(s, F.col("beta_raw"), F.col("height"), 3.0, 55.0).alias("ok")))
    return _layers(spark, sf).select("id", F.inline(q))


MASK = "mk AS (SELECT g.id, g.i, g.h, g.day, g.fog_flag, EXISTS (SELECT 1 FROM lr WHERE lr.ok AND lr.id = g.id AND g.i BETWEEN lr.base AND lr.top) AS m FROM g)"


def _masked(spark, sf):
    p = profiles(spark, sf).withColumn("beta", F.col("beta_raw"))
    p = pf.find_layers(p, "beta", "height", 0.05, 4.0, 40.0, 30.0, 60.0, 0.002, 100.0)
    return p.withColumn("mask", pf.layer_mask(F.col("layers"), F.col("beta")))


@query("pf_layer_mask", with_(PF, DIFF, PEAKS, BOUNDS, QUAL, MASK) + "SELECT id, i - 1 AS gate, m AS masked FROM mk")
def pf_layer_mask(spark, sf):
    return _masked(spark, sf).select("id", F.posexplode("mask").alias("gate", "masked"))


PRODUCT = """cb AS (SELECT id, any_value(fog_flag) AS f, min(CASE WHEN m THEN h END) AS asl FROM mk GROUP BY id),
cp AS (SELECT *, asl - 5 AS agl, coalesce(asl - 5 < 250, false) AS low FROM cb)"""


@query("pf_cloud_product", with_(PF, DIFF, PEAKS, BOUNDS, QUAL, MASK, PRODUCT) + """SELECT id, CAST(asl AS DOUBLE) AS cloud_base_height_asl, CAST(agl AS DOUBLE) AS cloud_base_height_agl, CASE WHEN asl IS NOT NULL THEN 1e0 ELSE 0e0 END AS cloud_flag,
 CASE WHEN f AND NOT low THEN NULL WHEN low THEN 1e0 ELSE 0e0 END AS low_cloud_flag, CASE WHEN low OR f THEN 1e0 ELSE 0e0 END AS low_cloud_and_fog_flag, CASE WHEN f AND NOT low THEN 1e0 ELSE 0e0 END AS fog_flag FROM cp""")
def pf_cloud_product(spark, sf):
    c = pf.cloud_product(_masked(spark, sf), low_m=250.0)
    return c.select("id", "cloud_base_height_asl", "cloud_base_height_agl", "cloud_flag", "low_cloud_flag", "low_cloud_and_fog_flag", "fog_flag")


@query("pf_nan_trapz", with_(PF, "q AS (SELECT *, lag(b) OVER w AS pb, lag(r) OVER w AS pr FROM g WHERE i % 5 <> 0 AND b > -0.2e0 WINDOW w AS (PARTITION BY id ORDER BY i))") +
       f"SELECT id, {R('CASE WHEN count(*) >= 2 THEN sum((b + pb) * (r - pr) / 2) END')} AS v FROM q GROUP BY id")
def pf_nan_trapz(spark, sf):
    y = F.transform("beta_raw", lambda x, i: F.when((F.pmod(i + 1, F.lit(5)) != 0) & (x > -0.2), x))
    return profiles(spark, sf).select("id", r6(ar.nan_trapz(y, F.col("range"))).alias("v"))


# lidar-ratio candidates, scaled: peak window 100-500 m, amplitude 0.1, contrast 1.2 at 55 m
CAND = "cpk AS (SELECT id, max(b) AS pb, arg_max(r, struct_pack(a := b, b := -r)) AS pr FROM g WHERE r >= 100 AND r <= 500 AND b >= 0.1e0 GROUP BY id)"


@query("pf_candidate_peak", with_(PF, CAND) + f"SELECT id, {R('pb')} AS peak, pr AS peak_range FROM cpk")
def pf_candidate_peak(spark, sf):
    p = profiles(spark, sf).withColumn("pk", pf.candidate_peak(F.col("beta_raw"), F.col("range"), 100.0, 500.0, 0.1))
    return p.where("pk is not null").select("id", r6("pk.beta").alias("peak"), F.col("pk.range").alias("peak_range"))


CONTR = """cc AS (SELECT cpk.*, (SELECT arg_min(b, struct_pack(a := abs(r - (pr + 55)), b := -i)) FROM g WHERE g.id = cpk.id) AS up, (SELECT arg_min(b, struct_pack(a := abs(r - (pr - 55)), b := -i)) FROM g WHERE g.id = cpk.id) AS dn FROM cpk)"""


@query("pf_peak_contrast_nearest", with_(PF, CAND, CONTR) + "SELECT id, pb >= 1.2e0 * up AND pb >= 1.2e0 * dn AS ok FROM cc")
def pf_peak_contrast_nearest(spark, sf):
    p = profiles(spark, sf).withColumn("pk", pf.candidate_peak(F.col("beta_raw"), F.col("range"), 100.0, 500.0, 0.1)).where("pk is not null")
    return p.select("id", pf.contrast_nearest(F.col("pk"), F.col("beta_raw"), F.col("range"), 55.0, 1.2).alias("ok"))


OVER = """og AS (SELECT id, i, b < 0 AS neg, i - row_number() OVER (PARTITION BY id, b < 0 ORDER BY i) AS grp FROM g),
os AS (SELECT id, coalesce(max(c) FILTER (WHERE neg), 0) >= 5 AS bad FROM (SELECT id, neg, grp, count(*) AS c FROM og GROUP BY ALL) GROUP BY id)"""


@query("pf_oversaturation", with_(PF, OVER) + "SELECT id, bad FROM os")
def pf_oversaturation(spark, sf):
    return profiles(spark, sf).select("id", pf.oversaturated(F.col("beta_raw"), F.col("range"), 45.0).alias("bad"))


RATIO = """ti AS (SELECT g.id, pr, sum((g.b + q.b) * (g.r - q.r) / 2) AS tot, sum(CASE WHEN g.r < pr - 55 THEN (g.b + q.b) * (g.r - q.r) / 2 END) AS aer
 FROM cpk JOIN g USING (id) JOIN g q ON q.id = g.id AND q.i = g.i - 1 WHERE g.r <= least(pr + 55, 450) GROUP BY ALL),
ra AS (SELECT id, pr, CASE WHEN aer / nullif(tot, 0) < 0.5e0 THEN 1e0 / (2e0 * nullif(tot, 0)) END AS ratio FROM ti)"""


@query("pf_integral_ratio", with_(PF, CAND, RATIO) + f"SELECT id, {R('ratio', 7)} AS ratio FROM ra")
def pf_integral_ratio(spark, sf):
    p = profiles(spark, sf).withColumn("pk", pf.candidate_peak(F.col("beta_raw"), F.col("range"), 100.0, 500.0, 0.1)).where("pk is not null")
    return p.select("id", r6(pf.integral_ratio(F.col("pk"), F.col("beta_raw"), F.col("range"), 55.0, 450.0, 0.5), 7).alias("ratio"))


NIGHT = """nt AS (SELECT p.id, p.site, p.day, CASE WHEN coalesce(pb >= 1.2e0 * up AND pb >= 1.2e0 * dn, false) AND NOT bad AND p.id % 9 <> 0 THEN ratio END AS ratio, CASE WHEN p.id % 9 <> 0 THEN cc.pr END AS pr
 FROM p LEFT JOIN cc ON cc.id = p.id LEFT JOIN os ON os.id = p.id LEFT JOIN ra ON ra.id = p.id),
cw AS (SELECT *, list(ratio) OVER (PARTITION BY site, day ORDER BY id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, list(ratio) OVER (PARTITION BY site, day ORDER BY id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS c FROM nt),
cx AS (SELECT *, list_filter(list_concat(coalesce(a, []), coalesce(c, [])), lambda v: v IS NOT NULL) AS nb FROM cw),
cz AS (SELECT id, site, day, pr, CASE WHEN len(nb) >= 2 AND abs(ratio - list_median(nb)) <= 0.8e0 * list_median(nb) THEN ratio END AS ratio FROM cx)"""


def _night(p):
    return F.when(F.pmod("id", F.lit(9)) != 0, F.lit(100.0)).otherwise(F.lit(50.0))


@query("win_consistency", with_(PF, CAND, CONTR, OVER, RATIO, NIGHT) + f"SELECT id, {R('ratio', 7)} AS ratio FROM cz")
def win_consistency(spark, sf):
    p = profiles(spark, sf)
    b = F.when(_night(p) > 96, F.col("beta_raw"))
    p = p.withColumn("b", b).withColumn("pk", pf.candidate_peak(F.col("b"), F.col("range"), 100.0, 500.0, 0.1))
    ok = F.col("pk").isNotNull() & pf.contrast_nearest(F.col("pk"), F.col("b"), F.col("range"), 55.0, 1.2) & ~pf.oversaturated(F.col("b"), F.col("range"), 45.0)
    p = p.withColumn("ratio", F.when(ok, pf.integral_ratio(F.col("pk"), F.col("b"), F.col("range"), 55.0, 450.0, 0.5)))
    c = pf.consistent(p.select("id", "site", "day", "time", "ratio"), ["site", "day"], "time", "ratio", 0.8, 2)
    return c.select("id", r6("ratio", 7).alias("ratio"))


@query("pf_ratio_daily", with_(PF, CAND, CONTR, OVER, RATIO, NIGHT) + f"""SELECT site, day, {R('CASE WHEN count(*) >= 5 THEN median(ratio) END', 7)} AS lidar_ratio, {R('CASE WHEN count(*) >= 5 THEN median(CASE WHEN ratio IS NOT NULL THEN pr END) END', 7)} AS peak_range,
 CAST(count(ratio) AS BIGINT) AS n_valid FROM cz GROUP BY site, day""")
def pf_ratio_daily(spark, sf):
    p = profiles(spark, sf)
    d = pf.daily_lidar_ratio(p, ["site", "day"], _night(p), lo=100.0, hi=500.0, amplitude=0.1, distance=55.0, factor=1.2, depth=45.0, upper=450.0,
                             max_aerosol=0.5, threshold=0.8, min_neighbors=2, min_samples=5)
    return d.select("site", "day", r6("lidar_ratio", 7).alias("lidar_ratio"), r6("peak_range", 7).alias("peak_range"), "n_valid")


# Gaussian over time (files of 15 s steps, sigma 15 s -> radius 4) and height (sigma 10 m on 10 m gates -> radius 4)
SMOOTH = """su AS (SELECT id, day, i, n, r, b / pow(r / 1000, 2) AS x FROM g),
sc AS (SELECT *, least(x, 5e0) AS c, row_number() OVER (PARTITION BY day, i ORDER BY id) - 1 AS row FROM su),
nn AS (SELECT day, count(DISTINCT id) AS nr, median(st) AS dt FROM (SELECT day, id, (lead(id) OVER (PARTITION BY day ORDER BY id) - id) * 15e0 AS st FROM p) GROUP BY day),
ks AS (SELECT unnest(range(-4, 5)) AS k),
hs AS (SELECT a.id, a.day, a.i, a.row, sum(c.c * exp(-(k * k) / 2e0)) / (SELECT sum(exp(-(k * k) / 2e0)) FROM ks) AS v FROM sc a, ks JOIN sc c ON c.id = a.id AND c.i = 1 + CASE WHEN (a.i - 1 + k + 2 * a.n) % (2 * a.n) < a.n THEN (a.i - 1 + k + 2 * a.n) % (2 * a.n) ELSE 2 * a.n - 1 - (a.i - 1 + k + 2 * a.n) % (2 * a.n) END GROUP BY a.id, a.day, a.i, a.row),
kt AS (SELECT day, nr, unnest(range(-CAST(floor(4 * sg + 0.5e0) AS BIGINT), CAST(floor(4 * sg + 0.5e0) AS BIGINT) + 1)) AS k, sg FROM (SELECT *, 300e0 / dt AS sg FROM nn)),
rows_ AS (SELECT DISTINCT day, row FROM sc),
ws AS (SELECT w.day, w.row, kt.k, exp(-(k * k) / (2e0 * sg * sg)) AS wt, CASE WHEN (w.row + k + 2 * nr * 100) % (2 * nr) < nr THEN (w.row + k + 2 * nr * 100) % (2 * nr) ELSE 2 * nr - 1 - (w.row + k + 2 * nr * 100) % (2 * nr) END AS src FROM rows_ w JOIN kt USING (day)),
sm AS (SELECT ws.day, ws.row, hs.i, sum(hs.v * wt) / sum(wt) AS v FROM ws JOIN hs ON hs.day = ws.day AND hs.row = ws.src GROUP BY ALL)"""


@query("pf_gauss_smooth", with_(PF, SMOOTH) + f"SELECT sc.id, sc.i - 1 AS gate, {R('CASE WHEN x > 5 THEN x ELSE sm.v END * pow(r / 1000, 2)', 7)} AS v FROM sc JOIN sm USING (day, row, i)")
def pf_gauss_smooth(spark, sf):
    s = pf.gaussian_smooth(profiles(spark, sf), ["day"], 300.0, 10.0, 5.0)
    return gates(s, "beta_smooth", n=7)


@query("win_median_step", with_(PF, "d AS (SELECT day, id, (lead(id) OVER (PARTITION BY day ORDER BY id) - id) * 15e0 AS st FROM p)") + "SELECT day, median(st) AS step_s FROM d GROUP BY day")
def win_median_step(spark, sf):
    return pf.median_step(profiles(spark, sf), ["day"])
