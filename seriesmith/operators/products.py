"""Whole products as one call: level 3 (daily means to reconstructed bins) and level 4 (bins to trends)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import cut, same
from . import aggregate as ag
from . import clean as cl
from . import joins as jn
from . import trend as tr


@dataclass
class Level3:
    """Tables of one run; all but ``daily`` and ``anomaly``, which are written once, are evaluated when read."""

    daily: DataFrame
    climatology: DataFrame
    anomaly: DataFrame
    bins: DataFrame
    running: DataFrame
    seasons: DataFrame


def _by(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], how: str = "inner") -> DataFrame:
    """``a`` with some columns of ``b``, by null-safe keys."""
    return a.alias("a").join(b.select(*keys, *columns).alias("b"), same("a", "b", keys), how).select("a.*", *[F.col(f"b.{c}") for c in columns])


def level3(
    samples: DataFrame, first: str, last: str, site: str = "site", instrument: str = "instrument", time: str = "time", value: str = "value",
    zenith: Column | None = None, freqs: Sequence[str] = ("3day", "month"), min_samples: int = 720, per_instrument: int = 365, per_site: int = 5 * 365,
    n_days: int = 31, window: int = 365, min_frac: float = 0.5,
) -> Level3:
    """Samples to daily conditions, gates, a climatology shared by a site's instruments, anomalies, bins and reconstructions.

    29 February goes first. Days need ``min_samples`` samples of their condition; instruments and sites too few valid days of
    the condition ``all`` go. The climatology is that of the reference period; an empty period is an error. ``bins`` has the
    mean anomaly of every bin, with its seasonal and its deseasonalised value; ``running`` the running mean of the
    deseasonalised days; ``seasons`` the mean by year and season. One aggregate reads the samples, all else the daily table.
    """
    keys = [site, instrument]
    full = [*keys, "condition"]
    use = ag.drop_leap_days(samples, time)
    every = ag.daily_conditions(use, keys, time, value, zenith, min_samples=min_samples).withColumnRenamed("value", value)
    every = cut(every)
    good = cl.min_days_gate(every.where("condition = 'all'"), [site], instrument, "date", value, per_instrument, per_site).select(*keys).distinct()
    daily = cut(every.alias("a").join(good.alias("b"), same("a", "b", keys), "left_semi"))
    reference = ag.reference_period(daily, first, last, required=True)
    clim = cut(ag.shared_climatology(reference, [site, "condition"], instrument, "date", value, n_days))
    own = clim.where(F.col(instrument) != "site")
    day = daily.withColumn("doy", ag.cal.noleap_doy("date"))
    anomaly = cut(_by(day, own.withColumnRenamed(value, "_clim"), [*full, "doy"], ["_clim"]).select(
        *full, "date", "doy", F.col(value), (F.col(value) - F.col("_clim")).alias("anomaly")))
    grand = own.groupBy(*full).agg(F.avg(value).alias("_grand"))
    parts = []
    for f in freqs:
        b = ag.calendar_bins(anomaly, full, f, value="anomaly", min_frac=min_frac).withColumn("doy", ag.cal.noleap_doy("bin"))
        b = _by(_by(b, grand, full, ["_grand"]), own.withColumnRenamed(value, "_clim"), [*full, "doy"], ["_clim"], "left")
        parts.append(b.select(F.lit(f).alias("freq"), *full, "bin", "anomaly", (F.col("_clim") + F.col("anomaly")).alias("seasonal"),
                              (F.col("_grand") + F.col("anomaly")).alias("deseasonalized")))
    bins = parts[0]
    for b in parts[1:]:
        bins = bins.unionByName(b)
    level = _by(anomaly, grand, full, ["_grand"]).select(*full, "date", (F.col("_grand") + F.col("anomaly")).alias(value))
    running = ag.running_mean(level, full, "date", value, window, min_frac)
    seasons = ag.year_season(anomaly, own.select(*full, "doy", value), full, "date", "anomaly", value, min_frac)
    return Level3(daily, clim, anomaly, bins, running, seasons)


@dataclass
class Level4:
    trends: DataFrame
    distribution: DataFrame
    segments: DataFrame


def level4(
    bins: DataFrame, granularity: DataFrame, reference: DataFrame, keys: Sequence[str] = ("site", "condition"), instrument: str = "instrument",
    date: str = "date", value: str = "value", first: str = "2000-03-01", last: str = "2025-12-31", n_points: int = 2001,
    sigma_levels: Sequence[float] = tr.SIGMA_LEVELS, resolution: float = 1e-12, min_days: int = 10, windows: dict[str, int] | None = None,
) -> Level4:
    """Deseasonalised bins to trends: configured frequency, coverage of the reference, overlap exclusion, fits, relative values.

    ``bins`` has keys, instrument, freq, date and value; ``granularity`` the frequency of each site (an unsupported one, or a
    site of it that has no bins, is an error); ``reference`` the series whose span bounds each site (site, date, value). Bins of
    lower-ranked instruments near valid ones of higher rank go, within the window of the frequency. ``trends`` has one row
    per key with bounds at the sigma levels, absolute and relative to the mean of what was fitted; ``distribution`` the
    quantile function of the slope; ``segments`` the trends of months and seasons.
    """
    keys = list(keys)
    site = keys[:1]
    windows = windows or jn.OVERLAP_WINDOW
    chosen = cl.choose_granularity(bins, granularity, tuple(windows), strict=True)
    span = ag.coverage(reference, site, date, value, first, last, min_years=0)
    masked = cut(cl.coverage_mask(chosen, span, site, date, value))
    kept = None
    for freq, window in windows.items():
        part = jn.overlap_exclusion(masked.where(F.col("freq") == freq), keys, instrument, window, date, value)
        kept = part if kept is None else kept.unionByName(part)
    kept = cut(kept.drop("rank", "freq"))
    mean = kept.groupBy(*keys).agg(F.avg(value).alias(value))
    fit = tr.trend_table(kept, keys, date, value, instrument, sigma_levels, by_season=True, resolution=resolution)
    bounds = [f"{end}_{i}s" for i in range(1, len(sigma_levels) + 1) for end in ("lower", "upper")]
    trends = tr.relative(fit, mean, keys, ["slope", *bounds], ["std"], value)
    long, stats, variant, unit = tr.fit_parts(kept, keys, date, value, instrument, resolution=resolution)
    last_fit = F.col("variant") == variant
    distribution = tr.quantile_function(long.where(last_fit), keys, "_strat", "_t", "_x", stats.where(last_fit).drop("variant"), n_points, unit)
    segments = tr.segment_trends(kept, keys, date, value, instrument, min_days, sigma_levels, resolution=resolution)
    return Level4(trends, distribution, segments)
