"""Level-1 and level-2 products as single calls: raw profiles to screened ones, profiles, model columns and layers to cloud covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import cut, same
from . import clean as cl
from . import columns as mc
from . import profile as pf

# Columns that may hold the altitude, and the angle from the vertical, of a file.
ALTITUDES = ("alt", "station_altitude", "altitude")
TILTS = ("tilt_angle", "azimuth")


def _factor(name: str, field: int, key: Column, default: float) -> Column:
    """A number of the instrument catalogue by type, as a literal map of eleven entries."""
    pairs = [x for row in cl.INSTRUMENTS for x in (F.lit(row[0]), F.lit(row[field]))]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default)).alias(name)


def file_values(df: DataFrame, keys: Sequence[str], time: str = "time", rng: str = "range", scaling: str = "scaling", elevation: str = "elev") -> DataFrame:
    """Per file, in one aggregate over scalar columns: altitude, vertical factor, recorded scaling, start and longest range.

    The altitude is the median of the first column that the table has, 0 without any value. The vertical factor is the cosine
    of the median tilt, else the sine of the median elevation, else 1. The recorded scaling is the file's median, or NULL.
    """
    alt = next((c for c in ALTITUDES if c in df.columns), None)
    tilt = next((c for c in TILTS if c in df.columns), None)
    middle = lambda c: F.percentile(c, 0.5)
    if tilt:
        factor = F.cos(F.radians(middle(tilt)))
    elif elevation in df.columns:
        factor = F.sin(F.radians(middle(elevation)))
    else:
        factor = F.lit(None).cast("double")
    return df.groupBy(*keys).agg(
        F.coalesce(middle(alt) if alt else F.lit(None).cast("double"), F.lit(0.0)).alias("altitude"),
        F.coalesce(factor, F.lit(1.0)).alias("vertical_factor"),
        (middle(scaling) if scaling in df.columns else F.lit(None).cast("double")).alias("recorded_scaling"),
        F.min(time).alias("file_start"), F.max(F.array_max(rng)).alias("max_range"))


def level1(
    df: DataFrame, file_keys: Sequence[str], order: str, label: str = "label", network: str = "network", site: str = "site", time: str = "time",
    units: str = "range_units", calibration: float = 1.0, undo_recorded: bool = False, status: str | None = None, status_limit: float = 80.0,
    **screening,
) -> DataFrame:
    """Source rows to level-1 profiles: the whole ordered chain in one call.

    Names, units, first row per time, instrument type, altitude, tilt, the missing one of height and range, networks that
    arrive scaled, calibrated or uncorrected, the status mask, then ``clean.preprocess`` (``screening`` goes there). Rows
    without a known instrument or raw data are left out (``clean.split_valid`` lists them). ``undo_recorded`` divides by the
    recorded scaling of files whose network calibrates by itself; the file's median is kept as ``recorded_scaling`` either
    way. File values come from one aggregate that carries no profile; profiles are checkpointed twice, before the top gates are
    counted and before smoothing; a NULL file key is a file of its own.
    """
    keys = list(file_keys)
    d = cl.harmonise_names(df, (time, "beta_raw"))
    d = cl.dedup_time(d, [*keys, time], order)
    if units in d.columns:
        d = d.withColumn("range", cl.km_to_m("range", units)).drop(units)
    values = file_values(d, keys, time)
    d = d.drop(*[c for c in (*ALTITUDES, "scaling") if c in d.columns])
    d = d.alias("a").join(values.alias("b"), same("a", "b", keys)).select("a.*", *[f"b.{c}" for c in values.columns if c not in keys])
    if "height" not in d.columns:
        d = d.withColumn("height", F.lit(None).cast("array<double>"))
    d = cl.fix_height_range(d, F.col("vertical_factor")).withColumn("instrument", cl.resolve_instrument(label))
    d, _ = cl.split_valid(d)
    kind, net = F.col("instrument"), F.col(network)
    rule = cl.range_corrected_rule(net, F.col(site), F.col("file_start"), F.col("max_range"))
    d = d.withColumn("range_corrected", F.coalesce(F.col("range_corrected"), rule) if "range_corrected" in d.columns else rule)
    base = _factor("scaling", 2, kind, 1.0)
    own = cl.undo_factor(F.col("recorded_scaling"), base, F.col(site), kind) if undo_recorded else F.lit(1.0)
    d = d.withColumns({
        "_scaling": cl.scaling_override(net, kind, base), "_own": cl.calibration_override(net, F.lit(calibration)) / own,
        "_net": cl.calibration_override(net, _factor("network_calibration", 3, kind, 1.0))})
    d = cut(d.withColumn("calibration_factor", F.col("_scaling") * F.col("_own") * F.col("_net")))  # written once, read by every gate count
    out = cl.preprocess(d, [order], keys, order, F.col("_scaling"), F.col("_own"), F.col("_net"), instrument="instrument",
                        status=status, status_limit=status_limit if status else None, **screening)
    return out.drop("_scaling", "_own", "_net", "vertical_factor", "file_start", "max_range")


def level2_profiles(
    df: DataFrame, file_keys: Sequence[str], order: str, time: str = "time", day: str = "day", beta: str = "beta", low_m: float = 2000.0,
    layers: dict | None = None,
) -> DataFrame:
    """Level-1 profiles to time series of cloud flags and base heights: layers, mask, flags, first row per time, the file's own day.

    ``layers`` are settings of ``profile.find_layers``. Every step but the removal of repeated times works inside the row.
    """
    d = pf.find_layers(df, beta, "height", **(layers or {}))
    d = pf.cloud_product(d.withColumn("mask", pf.layer_mask(F.col("layers"), F.col(beta))), low_m=low_m)
    d = cl.extract_1d(d)  # flags only: profiles are not shuffled
    return cl.day_clip(cl.dedup_time(d, [*file_keys, time], order), time, day)


def level2_columns(
    df: DataFrame, surface: str = "surface", height: str = "height", cover: str = "cc", liquid: str = "clwc", ice: str = "ciwc", lnsp: str = "lnsp",
    a: str = "a", b: str = "b", lat: str = "lat", dense: float = mc.FOG_COVER, full: float = 1.0,
) -> DataFrame:
    """Model-level columns to single-level covers and bases, all inside the row.

    Pressure, phases, bases (total, liquid, liquid and mixed, ice; above sea and above ground), fog cover, low covers by height
    and by pressure, and the low cover that is not obscured by what lies above. Levels are ordered bottom to top. A missing
    cover counts as none; without a base the base is NULL. Under a cover of ``full`` or more the low cover seen from above is NULL.
    """
    zero = F.transform(cover, lambda c: F.coalesce(c, F.lit(0.0)))
    d = df.withColumn("_c", zero).withColumns({
        "_phase": mc.phase_covers(F.col("_c"), mc.liquid_fraction(F.col(liquid), F.col(ice))),
        "_p": mc.layer_pressure(F.col(lnsp), F.col(a), F.col(b)), "_z0": mc.decorrelation_length(F.col(lat)),
        "_w": F.zip_with(liquid, ice, lambda w, i: w + i)})
    h, w, c = F.col(height), F.col("_w"), F.col("_c")
    bases = {
        "base": mc.conditional_base(h, c, w), "base_liquid": mc.conditional_base(h, F.col("_phase.liquid"), w, 0.0),
        "base_liquid_mixed": mc.conditional_base(h, F.col("_phase.liquid_mixed"), w), "base_ice": mc.conditional_base(h, F.col("_phase.ice"), w)}
    d = d.withColumns(bases).withColumns({f"{n}_agl": F.col(n) - F.col(surface) for n in ("base", "base_liquid")})
    d = d.withColumn("fog_cover", F.exists(mc.fog_column(h, F.col(surface), F.col("_phase.liquid"), dense), lambda x: x).cast("double"))
    d = mc.slab_covers(d, surface, "_phase", height, "_c", "_p", "_z0")
    above = mc.masked_cover(c, F.col("_p"), lambda p: p < mc.LOW_PRESSURE_PA)
    d = d.withColumns({"_total": mc.overlap_cover(h, c, F.col("_z0"), True), "_above": mc.overlap_cover(h, above, F.col("_z0"), True)})
    d = d.withColumn("low_non_obscured", mc.non_obscured(F.col("_total"), F.col("_above"), full))
    return cl.extract_1d(d).drop("_phase", "_z0", "_total", "_above")


def level2_layers(df: DataFrame, keys: Sequence[str], values: Sequence[str], layer: str = "layer", low: int = 4, total: int = 5) -> DataFrame:
    """Satellite layers to low, total and non-obscured low cover of each variant, one row per key in one aggregate.

    Two rows of a key and one of the two layers mean conflicting source products: an error that names the key. Keys without
    either layer have NULL covers.
    """
    keys = list(keys)
    pick = lambda v, n: F.max(F.when(F.col(layer) == n, F.col(v)))
    aggs = [x for v in values for x in (pick(v, low).alias(f"{v}_low"), pick(v, total).alias(f"{v}_total"))]
    counts = [F.count_if(F.col(layer) == n) for n in (low, total)]
    g = df.groupBy(*keys).agg(*aggs, F.greatest(*counts).alias("_n"))
    clash = F.raise_error(F.concat(F.lit("conflicting source products at "), F.to_json(F.struct(*keys)))).cast("double")
    out = {}
    for v in values:
        lo, to = F.col(f"{v}_low"), F.col(f"{v}_total")
        den = F.lit(1.0) - to + lo
        out[f"{v}_low"] = F.when(F.col("_n") > 1, clash).otherwise(lo)
        out[f"{v}_non_obscured"] = F.when(den > 0, mc.clip(lo / den, 0.0, 1.0))
    return g.withColumns(out).drop("_n")
