"""Model columns: embedding vectors as 64 levels (cover and condensates from the values), layers from lineitem."""

from pyspark.sql import functions as F

from ..core import r6
from ..operators import columns as mc
from .inputs import GRID, R, grid, table, with_
from .registry import query

# level i (1-based): height 20 + 60 i; cover |v| * 3 clipped; water and ice contents from the value
COLS = """ml AS (SELECT vec_id AS id, i, 20e0 + 60e0 * i AS h, least(abs(CAST(embedding[i] AS DOUBLE)) * 3, 1e0) * (i % 3) / 2e0 AS cc,
 greatest(CAST(embedding[i] AS DOUBLE), 0e0) * 1e-4 AS w, abs(CAST(embedding[i] AS DOUBLE)) * 5e-5 * (i % 4) / 3e0 AS ic,
 CAST(vec_id % 160 AS DOUBLE) - 80e0 AS lat, 60e0 + CAST(vec_id % 3 AS DOUBLE) * 40e0 AS zs, 11e0 + CAST(vec_id % 5 AS DOUBLE) / 10e0 AS lnsp
 FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)),
mp AS (SELECT *, CASE WHEN w + ic > 0 THEN w / (w + ic) END AS f FROM ml),
ph AS (SELECT *, CASE WHEN f > 0.9e0 THEN cc ELSE 0e0 END AS liq, CASE WHEN f <= 0.9e0 AND f > 0.1e0 THEN cc ELSE 0e0 END AS mixed, CASE WHEN f <= 0.1e0 THEN cc ELSE 0e0 END AS ice,
 CASE WHEN f > 0.1e0 THEN cc ELSE 0e0 END AS lm FROM mp)"""


def columns(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    lvl = lambda f: F.transform("v", lambda x, i: f(x, i + 1))
    return e.select(
        "id",
        lvl(lambda x, i: F.lit(20.0) + i * 60.0).alias("height"),
        lvl(lambda x, i: F.least(F.abs(x) * 3, F.lit(1.0)) * F.pmod(i, F.lit(3)) / 2.0).alias("cc"),
        lvl(lambda x, i: F.greatest(x, F.lit(0.0)) * 1e-4).alias("clwc"),
        lvl(lambda x, i: F.abs(x) * 5e-5 * F.pmod(i, F.lit(4)) / 3.0).alias("ciwc"),
        (F.pmod("id", F.lit(160)).cast("double") - 80.0).alias("lat"),
        (F.pmod("id", F.lit(3)).cast("double") * 40.0 + 60.0).alias("surface"),
        (F.pmod("id", F.lit(5)).cast("double") / 10.0 + 11.0).alias("lnsp"),
        lvl(lambda x, i: (F.lit(65) - i) * 20.0).alias("_a"),
        lvl(lambda x, i: (F.lit(65) - i) / 64.0).alias("_b"),
    ).withColumn("a", F.array_append("_a", F.lit(0.0))).withColumn("b", F.array_append("_b", F.lit(0.0)))


PRESS = """pr AS (SELECT *, ((65 - i) * 20e0 + (65 - i) / 64e0 * exp(lnsp) + (64 - i) * 20e0 + (64 - i) / 64e0 * exp(lnsp)) / 2e0 AS p FROM ph)"""


@query("pf_layer_pressure", with_(COLS, PRESS) + f"SELECT id, i - 1 AS level, {R('p', 4)} AS p FROM pr")
def pf_layer_pressure(spark, sf):
    c = columns(spark, sf).select("id", F.posexplode(mc.layer_pressure(F.col("lnsp"), F.col("a"), F.col("b"))).alias("level", "p"))
    return c.select("id", "level", r6("p", 4).alias("p"))


def _phases(spark, sf):
    c = columns(spark, sf)
    return c.withColumn("phase", mc.phase_covers(F.col("cc"), mc.liquid_fraction(F.col("clwc"), F.col("ciwc")))).withColumn(
        "pressure", mc.layer_pressure(F.col("lnsp"), F.col("a"), F.col("b"))).withColumn("z0", mc.decorrelation_length(F.col("lat")))


@query("pf_phase_split", with_(COLS) + f"SELECT id, i - 1 AS level, {R('liq')} AS liquid, {R('mixed')} AS mixed, {R('ice')} AS ice, {R('lm')} AS liquid_mixed FROM ph")
def pf_phase_split(spark, sf):
    p = _phases(spark, sf)
    z = F.arrays_zip(*[F.col(f"phase.{n}").alias(n) for n in ("liquid", "mixed", "ice", "liquid_mixed")])
    return p.select("id", F.posexplode(z).alias("level", "s")).select("id", "level", *[r6(f"s.{n}").alias(n) for n in ("liquid", "mixed", "ice", "liquid_mixed")])


@query("pf_fog_column", with_(COLS, "fc AS (SELECT id, i, h, zs, least(cc * 2, 1e0) AS l FROM ph WHERE i % 3 <> 0)",
       "f0 AS (SELECT id, arg_min(i, struct_pack(a := abs(h - zs), b := i)) AS s FROM fc GROUP BY id)",
       "f1 AS (SELECT fc.*, s, (SELECT l > 0.3e0 FROM fc z WHERE z.id = fc.id AND z.i = f0.s) AS dense FROM fc JOIN f0 USING (id))",
       "f2 AS (SELECT id, min(i) AS stop FROM f1 WHERE i >= s AND NOT l > 0.05e0 GROUP BY id)") +
       "SELECT f1.id, f1.i, dense AND f1.i >= s AND f1.i < coalesce(stop, 1000) AS fog FROM f1 LEFT JOIN f2 USING (id)")
def pf_fog_column(spark, sf):
    """Fog from the surface level up on the levels that carry cover; dense start scaled to 0.3."""
    c = columns(spark, sf)
    keep = lambda a: F.filter(a, lambda x, i: F.pmod(i + 1, F.lit(3)) != 0)
    liquid = keep(F.transform("cc", lambda x: F.least(x * 2, F.lit(1.0))))
    fog = mc.fog_column(keep(F.col("height")), F.col("surface"), liquid, 0.3)
    lv = F.filter(F.transform("cc", lambda x, i: i + 1), lambda i: F.pmod(i, F.lit(3)) != 0)
    return c.select("id", F.inline(F.zip_with(lv, fog, lambda i, f: F.struct(i.alias("i"), f.alias("fog")))))


@query("pf_conditional_base", with_(COLS) + """SELECT id, min(CASE WHEN cc > 0.01e0 AND w + ic > 1e-6 THEN h END) AS base_total, min(CASE WHEN liq > 0 AND w + ic > 1e-6 THEN h END) AS base_liquid,
 min(CASE WHEN ice > 0.01e0 AND w + ic > 1e-6 THEN h END) AS base_ice, min(CASE WHEN cc > 0.01e0 AND w + ic > 1e-6 THEN h END) - any_value(zs) AS base_total_agl FROM ph GROUP BY id""")
def pf_conditional_base(spark, sf):
    p = _phases(spark, sf)
    cond = F.zip_with("clwc", "ciwc", lambda w, i: w + i)
    b = lambda c, m=mc.MIN_COVER: mc.conditional_base(F.col("height"), c, cond, m)
    return p.select("id", b(F.col("cc")).alias("base_total"), b(F.col("phase.liquid"), 0.0).alias("base_liquid"), b(F.col("phase.ice")).alias("base_ice"),
                    (b(F.col("cc")) - F.col("surface")).alias("base_total_agl"))


def overlap_sql(name: str, cover: str, src: str = "pr", where: str = "true", order: str = "i") -> str:
    """Overlap fold as a list reduction over (height, cover) structs of the cloudy levels."""
    return f"""{name} AS (SELECT id, coalesce(list_reduce(list(struct_pack(h := h, c := {cover}, z := (0.75e0 + 2.149e0 * pow(cos(radians(lat)), 2)) * 1e3) ORDER BY {order}),
 lambda a, s: struct_pack(h := s.h, c := exp(-abs(s.h - a.h) / s.z) * greatest(a.c, s.c) + (1e0 - exp(-abs(s.h - a.h) / s.z)) * (a.c + s.c - a.c * s.c), z := s.z)).c, 0e0) AS v
 FROM {src} WHERE {cover} > 0 AND {where} GROUP BY id)"""


IDS = "ids AS (SELECT vec_id AS id FROM embeddings)"


@query("pf_overlap", with_(COLS, PRESS, overlap_sql("up", "cc"), overlap_sql("dn", "cc", order="i DESC"), IDS) +
       f"SELECT id, {R('coalesce(up.v, 0e0)')} AS bottom_up, {R('coalesce(dn.v, 0e0)')} AS top_down FROM ids LEFT JOIN up USING (id) LEFT JOIN dn USING (id)")
def pf_overlap(spark, sf):
    p = _phases(spark, sf)
    up = mc.overlap_cover(F.col("height"), F.col("cc"), F.col("z0"))
    dn = mc.overlap_cover(F.col("height"), F.col("cc"), F.col("z0"), True)
    return p.select("id", r6(up).alias("bottom_up"), r6(dn).alias("top_down"))


SLABS = [overlap_sql("s1", "liq", where="h <= zs + 2000"), overlap_sql("s2", "lm", where="h <= zs + 2000"), overlap_sql("s3", "ice", where="h <= zs + 2000"),
         overlap_sql("s4", "cc", where="h <= zs + 2000"), overlap_sql("s5", "cc", where="p >= 68000e0", order="i DESC")]


@query("pf_slab_covers", with_(COLS, PRESS, *SLABS, IDS) + f"""SELECT id, {R('coalesce(s1.v, 0e0)')} AS low_liquid, {R('coalesce(s2.v, 0e0)')} AS low_liquid_mixed, {R('coalesce(s3.v, 0e0)')} AS low_ice, {R('coalesce(s4.v, 0e0)')} AS low_all,
 {R('coalesce(s5.v, 0e0)')} AS low_pressure FROM ids LEFT JOIN s1 USING (id) LEFT JOIN s2 USING (id) LEFT JOIN s3 USING (id) LEFT JOIN s4 USING (id) LEFT JOIN s5 USING (id)""")
def pf_slab_covers(spark, sf):
    s = mc.slab_covers(_phases(spark, sf), "surface")
    return s.select("id", *[r6(c).alias(c) for c in ("low_liquid", "low_liquid_mixed", "low_ice", "low_all", "low_pressure")])


@query("pf_non_obscured_model", with_(COLS, PRESS, "pz AS (SELECT * REPLACE (cc * 0.05e0 AS cc) FROM pr)", overlap_sql("tt", "cc", "pz", order="i DESC"), overlap_sql("ab", "cc", "pz", "h > zs + 2000", "i DESC"), IDS) +
       f"""SELECT id, {R('CASE WHEN coalesce(ab.v, 0e0) < 1 THEN greatest(0e0, least(1e0, (coalesce(tt.v, 0e0) - coalesce(ab.v, 0e0)) / (1e0 - coalesce(ab.v, 0e0)))) END', 5)} AS v
 FROM ids LEFT JOIN tt USING (id) LEFT JOIN ab USING (id)""")
def pf_non_obscured_model(spark, sf):
    """Thin covers (5 %), so that the sky above the slab is never quite full."""
    p = _phases(spark, sf).withColumn("cc", F.transform("cc", lambda x: x * 0.05))
    h, z, top = F.col("height"), F.col("z0"), F.col("surface") + mc.LOW_TOP_M
    above = mc.masked_cover(F.col("cc"), h, lambda x: x > top)
    p = p.withColumn("tt", mc.overlap_cover(h, F.col("cc"), z, True)).withColumn("ab", mc.overlap_cover(h, above, z, True))
    return p.select("id", r6(mc.non_obscured(F.col("tt"), F.col("ab")), 5).alias("v"))


@query("pf_non_obscured_layers", with_(GRID, "pv AS (SELECT k, max(CASE WHEN layer = 4 THEN obs_cld_amount / 100 END) AS l, max(CASE WHEN layer = 5 THEN obs_cld_amount / 100 END) AS t, max(CASE WHEN layer = 4 THEN adj_cld_amount / 100 END) AS l2, max(CASE WHEN layer = 5 THEN adj_cld_amount / 100 END) AS t2 FROM (SELECT k, layer, nullif(obs_cld_amount, -999e0) AS obs_cld_amount, nullif(adj_cld_amount, -999e0) AS adj_cld_amount FROM gr) GROUP BY k)") +
       f"""SELECT k, {R('CASE WHEN 1 - t + l > 0 THEN greatest(0e0, least(1e0, l / (1 - t + l))) END')} AS obs_non_obscured, {R('CASE WHEN 1 - t2 + l2 > 0 THEN greatest(0e0, least(1e0, l2 / (1 - t2 + l2))) END')} AS adj_non_obscured FROM pv""")
def pf_non_obscured_layers(spark, sf):
    from ..sources import tables as tb

    g = tb.decode_grid(grid(spark, sf), r"^(obs|adj)_", ["k"]).withColumnsRenamed({"obs_cloud_cover": "obs", "adj_cloud_cover": "adj"})
    out = mc.non_obscured_layers(g, ["k"], ["obs", "adj"])
    return out.select("k", r6("obs_non_obscured").alias("obs_non_obscured"), r6("adj_non_obscured").alias("adj_non_obscured"))
