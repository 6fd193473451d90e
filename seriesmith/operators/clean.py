"""Harmonising and cleaning of profiles and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import cut, require_columns, same
from ..functions import arrays as ar

# Instrument types in search order with other names, scaling, network calibration and lidar ratio.
INSTRUMENTS = (
    ("CL61", ("CL61d",), 1.0, 1.0, 18.8),
    ("CHM15kx", (), 1e-11, 1.0, 18.2),
    ("CHM15k", ("CHM15x", "CHM15kx"), 1e-11, 1.0, 18.2),
    ("CL51", (), 1e-7, 1.2, 18.8),
    ("CL31", (), 1e-8, 1.45, 18.8),
    ("CT25k", (), 1e-7, 1.2, 18.8),
    ("CT75k", ("CT75",), 1e-7, 2.45, 18.8),
    ("LD40", (), 1.0, 2.45, None),
    ("PollyXT", (), 1.0, 1.0, None),
    ("DA10", (), 1.0, 1.0, None),
    ("EZLidar", (), 1.0, 1.0, None),
)
GENERIC = "Unknown ceilometer"
SMOOTHED_TYPES = ("CL61", "CHM15k", "CHM15kx", "CL51", "CL31")

# Networks whose data arrive scaled or calibrated.
SCALED_NETWORKS = ("fmi", "ceda", "niwa", "cloudnet")
CALIBRATED_NETWORKS = ("niwa",)


def instruments(spark: SparkSession) -> DataFrame:
    """The catalogue of instrument types (a fixed table of eleven rows)."""
    rows = [(n, list(a), s, 1.0, c, lr, i) for i, (n, a, s, c, lr) in enumerate(INSTRUMENTS)]
    return spark.createDataFrame(
        rows, "name string, aliases array<string>, scaling double, calibration double, network_calibration double, sc_ratio double, rank int")


def resolve_instrument(label: Column | str) -> Column:
    """First type whose name or alias occurs in a label, ignoring case."""
    low = F.lower(F.col(label) if isinstance(label, str) else label)
    out = F.lit(GENERIC)
    for name, aliases, *_ in reversed(INSTRUMENTS):
        hit = F.lit(False)
        for a in (name, *aliases):
            hit = hit | F.contains(low, F.lit(a.lower()))
        out = F.when(hit, name).otherwise(out)
    return out


def km_to_m(values: str, units: str) -> Column:
    return F.when(F.col(units) == "km", F.transform(values, lambda x: x * 1000.0)).otherwise(F.col(values))


def angle_factor(df: DataFrame, keys: Sequence[str], tilt: str | None = None, elevation: str | None = None) -> DataFrame:
    """Vertical factor per file: cos of the median tilt, or sin of the median elevation (below 45 it is a zenith angle)."""
    if tilt is not None:
        f = F.cos(F.radians(F.percentile(tilt, 0.5)))
    else:
        med = F.percentile(elevation, 0.5)
        f = F.sin(F.radians(F.when(med < 45, F.lit(90.0) - med).otherwise(med)))
    return df.groupBy(*keys).agg(F.coalesce(f, F.lit(1.0)).alias("vertical_factor"))


def tilt_heights(df: DataFrame, keys: Sequence[str], rng: str = "range", tilt: str | None = None, elevation: str | None = None) -> DataFrame:
    f = angle_factor(df, keys, tilt, elevation)
    return df.join(f, list(keys)).withColumn("height", F.transform(rng, lambda r: r * F.col("vertical_factor"))).drop("vertical_factor")


def set_altitude(df: DataFrame, keys: Sequence[str], aliases: Sequence[str]) -> DataFrame:
    """Altitude per file: median of the first alias that exists and has values, else 0."""
    have = [c for c in aliases if c in df.columns]
    med = df.groupBy(*keys).agg(F.coalesce(*[F.percentile(c, 0.5) for c in have], F.lit(0.0)).alias("altitude"))
    return df.drop("altitude").join(med, list(keys))


def fix_height_range(df: DataFrame, factor: Column | None = None) -> DataFrame:
    """Derive the missing one of height and range."""
    f = factor if factor is not None else F.lit(1.0)
    h = F.coalesce(F.col("height"), F.transform("range", lambda r: r * f + F.col("altitude")))
    r = F.coalesce(F.col("range"), F.transform("height", lambda h: h - F.col("altitude")))
    return df.withColumns({"height": h, "range": r})


def calibrate(df: DataFrame, scaling: Column, calibration: Column, network: Column, beta: str = "beta_raw") -> DataFrame:
    """beta x scaling x calibration x network factor."""
    return df.withColumn(beta, F.transform(beta, lambda x: x * scaling * calibration * network))


def undo_factor(factor: Column, scaling: Column, site: Column, instrument: Column) -> Column:
    """Factor by which already calibrated network data are divided."""
    return (
        F.when(factor.isNull(), 1.0).when(factor < 1e-4, factor / scaling)
        .when((site == "palaiseau") & (instrument == "CL31"), 1.45).otherwise(factor))


def scaling_override(network: Column, instrument: Column, scaling: Column) -> Column:
    scaled = network.isin(*SCALED_NETWORKS) | ((network == "knmi") & (instrument == "CT75k"))
    return F.when(scaled, 1.0).otherwise(scaling)


def calibration_override(network: Column, calibration: Column) -> Column:
    return F.when(network.isin(*CALIBRATED_NETWORKS), 1.0).otherwise(calibration)


def range_corrected_rule(network: Column, site: Column, start: Column, max_range: Column) -> Column:
    """Whether a file's data are already range-corrected."""
    early = ((site == "chilbolton") & (start < F.lit("2014-12-11").cast("timestamp"))) | (
        (site == "cabauw") & (start < F.lit("2012-01-01").cast("timestamp")))
    short = (site == "palaiseau") & (max_range < 8e3)
    return F.when(network == "cloudnet", F.when(short, True).otherwise(~early)).otherwise(F.lit(True))


RENAMES = {"backscatter": "beta_raw", "beta_att": "beta_raw"}


def harmonise_names(df: DataFrame, required: Sequence[str] = ("time", "beta_raw")) -> DataFrame:
    """Common names; a table without time or backscatter, or with two of them, is refused."""
    low = [RENAMES.get(c, c) for c in df.columns]
    dup = sorted({c for c in low if low.count(c) > 1})
    if dup:
        raise ValueError(f"duplicated columns after renaming: {', '.join(dup)}")
    return require_columns(df.toDF(*low), required, "source file")


def status_mask(beta: str, states: Sequence[str], limit: float = 80.0) -> Column:
    """NULL profile when a state is below its limit; missing states do not mask."""
    bad = F.lit(False)
    for s in states:
        bad = bad | F.coalesce(F.col(s) < limit, F.lit(False))
    return F.when(~bad, F.col(beta))


def dedup_time(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row per key (a grouped aggregate, so copies collapse before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def drop_empty_profiles(df: DataFrame, beta: str = "beta_raw") -> DataFrame:
    return df.where(F.exists(beta, lambda x: x.isNotNull()))


def trim_top(df: DataFrame, keys: Sequence[str], beta: str = "beta_raw", arrays: Sequence[str] = ("range", "height")) -> DataFrame:
    """Cut gates above the highest one that is neither zero in all profiles of the day nor missing in all."""
    def highest(ok):
        return F.max(F.coalesce(F.array_max(F.transform(F.col(beta), lambda x, i: F.when(ok(x), i + 1))), F.lit(0)))

    # zero in some profiles and missing in others: neither all zero nor all missing
    used = df.groupBy(*keys).agg(highest(lambda x: x.isNotNull() & (x != 0)).alias("_used"))
    gates = df.select(*keys, F.posexplode(beta).alias("_i", "_x"))
    part = gates.groupBy(*keys, "_i").agg(F.count_if(F.col("_x").isNull()).alias("_null"), F.count_if(F.col("_x") == 0).alias("_zero"))
    part = part.where("_null > 0 and _zero > 0").groupBy(*keys).agg((F.max("_i") + 1).alias("_mixed"))
    top = used.alias("a").join(part.alias("b"), same("a", "b", keys), "left").select("a.*", F.greatest("_used", F.coalesce("_mixed", F.lit(0))).alias("_top"))
    head = lambda c: F.slice(c, F.lit(1), F.col("_top"))
    cols = [beta, *[a for a in arrays if a in df.columns]]
    met = df.alias("a").join(top.alias("b"), same("a", "b", keys)).select("a.*", "_top")
    return met.withColumns({c: head(c) for c in cols}).drop("_top")


def sunbeam_ok(beta: str = "beta_raw", rng: str = "range", above: float = 10000.0, bins: int = 20, limit: int = 15) -> Column:
    """False for profiles with data in too many of the equal bins above 10 km (all gates are binned)."""
    def ok(c):
        n = F.size(c["b"])
        n_bins = F.least(F.lit(bins), n)
        size = F.floor(n / n_bins).cast("int")
        pts = F.zip_with(c["b"], c["r"], lambda b, r: b.isNotNull() & (r > above))
        bins_hit = F.filter(
            F.transform(pts, lambda x, i: F.when(x & (i < size * n_bins), F.floor(i / size).cast("int"))), lambda b: b.isNotNull())
        return (F.coalesce(F.array_max(c["r"]), F.lit(0.0)) <= above) | (F.size(F.array_distinct(bins_hit)) < limit)

    return ar.let(ar.pack(b=F.col(beta), r=F.col(rng)), ok)


# --- bad days -------------------------------------------------------------------------------------------

BAD_DAY_SCHEMA = "map<string, map<string, array<string>>>"


def bad_day_table(configs: DataFrame, column: str = "config") -> DataFrame:
    """JSON {site: {instrument: [day | "start/end"]}} -> distinct (site, instrument, date), keys lower-cased.

    A range whose end is before its start is an error, as is an unreadable entry.
    """
    m = configs.select(F.from_json(column, BAD_DAY_SCHEMA).alias("m"))
    e = m.select(F.explode("m").alias("site", "im")).select("site", F.explode("im").alias("instrument", "days"))
    e = e.select(F.lower(F.trim("site")).alias("site"), F.lower(F.trim("instrument")).alias("instrument"), F.explode("days").alias("d"))
    start = F.to_date(F.try_to_timestamp(F.split_part("d", F.lit("/"), F.lit(1)), F.lit("yyyy-MM-dd")))
    end = F.coalesce(F.to_date(F.try_to_timestamp(F.nullif(F.split_part("d", F.lit("/"), F.lit(2)), F.lit("")), F.lit("yyyy-MM-dd"))), start)
    bad = F.raise_error(F.concat(F.lit("invalid bad-day entry: "), F.col("d"))).cast("date")
    ok = start.isNotNull() & (end >= start)
    seq = F.sequence(F.when(ok, start).otherwise(bad), F.when(ok, end).otherwise(bad), F.expr("interval 1 day"))
    return e.select("site", "instrument", F.explode(seq).alias("date")).distinct()


def mask_bad_days(df: DataFrame, bad: DataFrame, time: str = "date") -> DataFrame:
    b = bad.select(F.col("site").alias("_s"), F.col("instrument").alias("_i"), F.col("date").alias("_d"))
    on = (F.lower("site") == F.col("_s")) & (F.lower("instrument") == F.col("_i")) & (F.to_date(time) == F.col("_d"))
    return df.join(b, on, "left_anti")


def day_clip(df: DataFrame, time: str = "time", day: str = "day") -> DataFrame:
    """Keep the file's calendar day, both midnights included."""
    d = F.col(day).cast("timestamp")
    return df.where(F.col(time).between(d, d + F.expr("interval 1 day")))


def coverage_mask(df: DataFrame, coverage: DataFrame, keys: Sequence[str], date: str = "date", value: str = "value") -> DataFrame:
    """NULL outside the reference's effective window."""
    c = coverage.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = df.alias("a").join(c.alias("b"), same("a", "b", keys)).select("a.*", "_s", "_e")
    return met.withColumn(value, F.when(F.col(date).between(F.col("_s"), F.col("_e")), F.col(value))).drop("_s", "_e")


# Frequencies that series come in.
GRANULARITIES = ("daily", "3day", "weekly", "monthly")


def choose_granularity(df: DataFrame, granularity: DataFrame, frequencies: Sequence[str] = GRANULARITIES, strict: bool = False) -> DataFrame:
    """Rows of the frequency configured for their site; sites without configuration are skipped.

    An unsupported frequency is an error; ``strict``, so is a configured site without rows. The configuration has a row per
    site; only what is wrong with it reaches the driver.
    """
    wrong = granularity.where(F.col("freq").isNull() | ~F.col("freq").isin(*frequencies)).select("site", "freq").first()
    if wrong:
        raise ValueError(f"unsupported frequency {wrong['freq']!r} of site {wrong['site']!r}")
    if strict:
        unknown = granularity.select("site").join(df.select("site").distinct(), "site", "left_anti").first()
        if unknown:
            raise ValueError(f"unknown site {unknown['site']!r}")
    return df.join(granularity.select("site", "freq"), ["site", "freq"])


def min_days_gate(df: DataFrame, site: Sequence[str], instrument: str = "instrument", date: str = "date", value: str = "value",
                  per_instrument: int = 365, per_site: int = 5 * 365) -> DataFrame:
    """Drop instruments, then sites, with too few valid days."""
    site = list(site)
    ok = F.when(F.col(value).isNotNull(), F.col(date))
    inst = df.groupBy(*site, instrument).agg(F.countDistinct(ok).alias("_n")).where(F.col("_n") >= per_instrument).drop("_n")
    df = df.join(inst, [*site, instrument], "left_semi")
    good = df.groupBy(*site).agg(F.countDistinct(ok).alias("_n")).where(F.col("_n") >= per_site).drop("_n")
    return df.join(good, site, "left_semi")


def extract_1d(df: DataFrame) -> DataFrame:
    """Keep the columns that live on time alone."""
    return df.select(*[f.name for f in df.schema.fields if f.dataType.typeName() != "array"])


# Quality-control variables that are not aggregated.
QC_ONLY = ("upper_level_cloud_cover_obs", "upper_level_cloud_cover_adj")


def flags_to_covers(df: DataFrame) -> DataFrame:
    """Names of averaged flags (flag -> cover); quality-control-only variables go."""
    df = df.drop(*[c for c in QC_ONLY if c in df.columns])
    return df.withColumnsRenamed({c: c[: -len("_flag")] + "_cover" for c in df.columns if c.endswith("_flag")})


def series_identity(df: DataFrame, path: str = "path") -> DataFrame:
    """Site and instrument from their columns, else from the path; neither is an error."""
    def part(name: str, i: int) -> Column:
        err = F.raise_error(F.concat(F.lit(f"no {name} for "), F.coalesce(F.col(path), F.lit("?")))).cast("string")
        p = F.nullif(F.split_part(F.col(path), F.lit("/"), F.lit(i)), F.lit(""))
        return F.coalesce(F.col(name) if name in df.columns else F.lit(None).cast("string"), p, err)

    return df.withColumns({"site": part("site", 2), "instrument": part("instrument", 3)})


def split_valid(df: DataFrame, beta: str = "beta_raw", instrument: str = "instrument") -> tuple[DataFrame, DataFrame]:
    """Rows that have raw data and a resolved instrument, and the rejected rows with a reason."""
    reason = F.when(F.col(beta).isNull(), "no raw data").when(F.col(instrument) == GENERIC, "unknown instrument")
    d = df.withColumn("reason", reason)
    return d.where(F.col("reason").isNull()).drop("reason"), d.where(F.col("reason").isNotNull())


def latitude_class(lat: Column | str) -> Column:
    lat = F.col(lat) if isinstance(lat, str) else lat
    return F.when(F.abs(lat) <= 66, "mid").otherwise("high")


# Edges of the half-open latitude bins.
LAT_EDGES = (35, 45, 55, 65, 75)


def latitude_bin(lat: Column | str) -> Column:
    lat = F.col(lat) if isinstance(lat, str) else lat
    out = F.lit("other")
    for lo, hi in zip(LAT_EDGES, LAT_EDGES[1:], strict=False):
        out = F.when((lat >= lo) & (lat < hi), f"{lo}-{hi}").otherwise(out)
    return out


def map_class(key: Column | str, classes: dict[str, str], default: str | None = None) -> Column:
    """Static class per key from a short literal map."""
    key = F.col(key) if isinstance(key, str) else key
    lits = [x for k, v in classes.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*lits)[key], F.lit(default).cast("string"))


# --- composed chains ------------------------------------------------------------------------------------


def preprocess(
    df: DataFrame, profile_keys: Sequence[str], file_keys: Sequence[str], order: str, scaling: Column, calibration: Column, network: Column,
    instrument: str | None = None, status: str | None = None, status_limit: float | None = None, fog_limit: float = 1e-3, noise_min: float = 1e-9,
    keep_above: float = 8e-6, sunbeam_above: float = 10000.0,
) -> DataFrame:
    """Raw profiles -> screened, calibrated, range-corrected profiles with fog flags.

    First row per profile time, profiles with a bad status, empty profiles and empty top gates removed, range correction
    of the profiles that are not corrected yet (a NULL flag counts as not corrected), calibration, sunbeam screening,
    fog flags, then noise filtering: on the smoothed signal for the instrument types that are smoothed (by the
    ``instrument`` column), on the signal itself for all others.
    """
    from . import profile as pf

    d = dedup_time(df, list(profile_keys), order) if order not in profile_keys else df
    if status is not None and status_limit is not None:
        d = d.withColumn("beta_raw", status_mask("beta_raw", [status], status_limit))
    d = drop_empty_profiles(d.where(F.col("beta_raw").isNotNull()))
    d = trim_top(d, file_keys)
    done = F.coalesce(F.col("range_corrected"), F.lit(False))
    d = d.withColumn("beta_raw", F.when(done, F.col("beta_raw")).otherwise(pf.range_correct(F.col("beta_raw"), F.col("range")))).withColumn(
        "range_corrected", F.lit(True))
    d = calibrate(d, scaling, calibration, network)
    d = d.where(sunbeam_ok(above=sunbeam_above))
    d = d.withColumn("fog_flag", pf.fog_by_sum(F.col("beta_raw"), limit=fog_limit))
    if instrument is None:
        return pf.filter_chain(d, noise_min=noise_min, keep_above=keep_above)
    d = cut(d)  # smoothing reads the profiles several times: written once
    named = F.coalesce(F.col(instrument).isin(*SMOOTHED_TYPES), F.lit(False))
    smooth = pf.gaussian_smooth(d.where(named), file_keys)
    smooth = pf.filter_chain(smooth, screen="beta_smooth", noise_min=noise_min, keep_above=keep_above).drop("beta_smooth")
    return smooth.unionByName(pf.filter_chain(d.where(~named), noise_min=noise_min, keep_above=keep_above), allowMissingColumns=True)


def with_calibration_factors(df: DataFrame, beta: str, factors: Sequence[float]) -> DataFrame:
    """Each profile once per factor of a short fixed list, its backscatter scaled."""
    d = df.withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    return d.withColumn(beta, F.transform(beta, lambda x: x * F.col("factor")))
