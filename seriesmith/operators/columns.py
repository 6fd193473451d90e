"""Model-level columns (arrays over levels) and satellite layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions.scalar import clip

# Thresholds on cover and condensate, slab limits.
LIQUID_FRACTION = 0.9
ICE_FRACTION = 0.1
FOG_COVER = 0.9
FOG_CONTINUE = 0.05
MIN_COVER = 0.01
MIN_CONDENSATE = 1e-6
LOW_TOP_M = 2000.0
LOW_PRESSURE_PA = 68000.0


def layer_pressure(lnsp: Column, a: Column, b: Column) -> Column:
    """Full-level pressure: mean of adjacent half levels a + b exp(lnsp)."""
    half = ar.let(F.exp(lnsp), lambda ps: F.zip_with(a, b, lambda x, y: x + y * ps))
    n = F.size(a)
    return ar.let(half, lambda h: F.zip_with(F.slice(h, F.lit(1), n - 1), F.slice(h, F.lit(2), n - 1), lambda x, y: (x + y) / 2.0))


def liquid_fraction(clwc: Column, ciwc: Column) -> Column:
    return F.zip_with(clwc, ciwc, lambda w, i: F.when(w + i > 0, w / (w + i)))


def phase_covers(cover: Column, fraction: Column) -> Column:
    """Struct of covers per phase: liquid > 0.9, mixed (0.1, 0.9], ice <= 0.1; NULL cover is 0."""
    def part(cond):
        return F.zip_with(cover, fraction, lambda c, f: F.when(F.coalesce(cond(f), F.lit(False)), F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0)))

    return F.struct(
        part(lambda f: f > LIQUID_FRACTION).alias("liquid"),
        part(lambda f: (f <= LIQUID_FRACTION) & (f > ICE_FRACTION)).alias("mixed"),
        part(lambda f: f <= ICE_FRACTION).alias("ice"),
        part(lambda f: f > ICE_FRACTION).alias("liquid_mixed"))


def fog_column(height: Column, surface: Column, liquid: Column, dense: float = FOG_COVER) -> Column:
    """Levels of fog: from the level nearest the surface upwards while cover stays, if it starts dense enough.

    Levels are ordered bottom to top.
    """
    def run(c):
        start = F.get(c["l"], c["i"]) > dense
        state = F.aggregate(
            F.slice(c["l"], c["i"] + 1, F.size(c["l"])),
            F.struct(F.coalesce(start, F.lit(False)).alias("on"), F.lit(0).alias("n")),
            lambda a, x: F.struct((a["on"] & (x > FOG_CONTINUE)).alias("on"), (a["n"] + (a["on"] & (x > FOG_CONTINUE)).cast("int")).alias("n")),
            lambda a: a["n"])
        return ar.let(ar.pack(n=state, i=c["i"], l=c["l"]), lambda s: F.transform(s["l"], lambda _, j: (j >= s["i"]) & (j < s["i"] + s["n"])))

    return ar.let(ar.pack(l=liquid, i=ar.nearest_index(height, surface)), run)


def conditional_base(height: Column, cover: Column, condensate: Column, min_cover: float = MIN_COVER, min_condensate: float = MIN_CONDENSATE) -> Column:
    """Lowest height with enough cover and condensate."""
    ok = F.zip_with(cover, condensate, lambda c, w: (c > min_cover) & (w > min_condensate))
    return F.array_min(F.zip_with(height, ok, lambda h, k: F.when(k, h)))


def decorrelation_length(lat: Column) -> Column:
    return (F.lit(0.75) + F.pow(F.cos(F.radians(lat)), F.lit(2.0)) * 2.149) * 1e3


def overlap_cover(height: Column, cover: Column, z0: Column, top_down: bool = False) -> Column:
    """Exponential-random overlap of the cloudy levels, bottom-up or top-down."""
    lv = F.filter(F.zip_with(height, cover, lambda h, c: F.struct(h.alias("h"), c.alias("c"))), lambda s: s["c"] > 0)
    if top_down:
        lv = F.reverse(lv)

    def fold(p):
        def step(a, s):
            al = F.exp(-F.abs(s["h"] - a["h"]) / p["z"])
            both = al * F.greatest(a["c"], s["c"]) + (F.lit(1.0) - al) * (a["c"] + s["c"] - a["c"] * s["c"])
            return F.struct(s["h"].alias("h"), F.coalesce(both, s["c"]).alias("c"))

        return F.aggregate(
            p["v"], F.struct(F.lit(None).cast("double").alias("h"), F.lit(None).cast("double").alias("c")), step,
            lambda a: F.coalesce(a["c"], F.lit(0.0)))

    return ar.let(ar.pack(v=lv, z=z0), fold)


def masked_cover(cover: Column, by: Column, keep) -> Column:
    """Cover with the levels outside a condition set to 0."""
    return F.zip_with(cover, by, lambda c, x: F.when(keep(x), c).otherwise(F.lit(0.0)))


def slab_covers(df: DataFrame, surface: str, phases: str = "phase", height: str = "height", cover: str = "cc", pressure: str = "pressure", z0: str = "z0") -> DataFrame:
    """Low covers by height (per phase) and by pressure (top-down)."""
    top = F.col(surface) + LOW_TOP_M
    h, z = F.col(height), F.col(z0)

    def low(c: Column) -> Column:
        return ar.let(top, lambda t: overlap_cover(h, masked_cover(c, h, lambda x: x <= t), z))

    p = F.col(phases)
    return df.withColumns({
        "low_liquid": low(p["liquid"]), "low_liquid_mixed": low(p["liquid_mixed"]), "low_ice": low(p["ice"]), "low_all": low(F.col(cover)),
        "low_pressure": overlap_cover(h, masked_cover(F.col(cover), F.col(pressure), lambda x: x >= LOW_PRESSURE_PA), z, True)})


def non_obscured(total: Column, above: Column, full: float = 1.0) -> Column:
    """Low cover seen from above: (total - above) / (1 - above), NULL from the cover above that counts as full."""
    return F.when(above < full, clip(F.try_divide(total - above, F.lit(1.0) - above), 0.0, 1.0))


def non_obscured_layers(df: DataFrame, keys: list[str], values: list[str], layer: str = "layer", low: int = 4, total: int = 5) -> DataFrame:
    """low / (1 - total + low) per key from the two layers of long rows."""
    aggs = []
    for v in values:
        aggs += [F.max(F.when(F.col(layer) == low, F.col(v))).alias(f"_l_{v}"), F.max(F.when(F.col(layer) == total, F.col(v))).alias(f"_t_{v}")]
    g = df.groupBy(*keys).agg(*aggs)
    out = {}
    for v in values:
        den = F.lit(1.0) - F.col(f"_t_{v}") + F.col(f"_l_{v}")
        out[f"{v}_non_obscured"] = F.when(den > 0, clip(F.col(f"_l_{v}") / den, 0.0, 1.0))
    return g.withColumns(out).drop(*[f"_{k}_{v}" for v in values for k in "lt"])
