"""Daily means, calendar bins, climatologies and reconstruction.

After the daily aggregation every series has at most one row per day, so the
windows below run over groups whose size is bounded by the calendar; the
sample-level step is a plain grouped aggregate with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import require_rows, same
from ..functions import calendar as cal

DAY_ZENITH = 85.0
NIGHT_ZENITH = 90.0
CONDITIONS = ("all", "daytime", "nighttime")


def daily_conditions(
    samples: DataFrame,
    keys: Sequence[str],
    time: str = "time",
    value: str = "value",
    zenith: Column | None = None,
    conditions: Sequence[str] = CONDITIONS,
    min_samples: int = 720,
) -> DataFrame:
    """Daily means of all, daytime and nighttime samples in one pass over the samples.

    One grouped aggregate with conditional means; the rows of the conditions
    are split off afterwards, on daily rows. A day stays only with
    ``min_samples`` valid samples of its condition.
    """
    v = F.col(value)
    masks = {"all": F.lit(True)}
    if zenith is not None:
        masks |= {"daytime": zenith <= DAY_ZENITH, "nighttime": zenith > NIGHT_ZENITH}
    use = [c for c in conditions if c in masks]
    aggs = []
    for c in use:
        w = F.when(masks[c], v)
        aggs += [F.avg(w).alias(f"_m_{c}"), F.count(w).alias(f"_n_{c}")]
    day = samples.groupBy(*keys, F.to_date(time).alias("date")).agg(*aggs)
    parts = F.array(*[
        F.struct(F.lit(c).alias("condition"), F.col(f"_m_{c}").alias("value"), F.col(f"_n_{c}").alias("n_samples")) for c in use
    ])
    return day.select(*keys, "date", F.inline(parts)).where(F.col("n_samples") >= min_samples)


def mean_min_frac(v: Column | str, p: float = 0.5) -> Column:
    """Mean of a group, NULL unless at least the fraction p of its rows has a value."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(F.count(v) >= F.count(F.lit(1)) * p, F.avg(v))


def calendar_bins(
    daily: DataFrame, keys: Sequence[str], freq: str, date: str = "date", value: str = "value",
    min_frac: float | None = 0.5, fill: bool = True,
) -> DataFrame:
    """Means per calendar bin; bins without rows appear with a NULL value when ``fill``."""
    if freq in cal.MINOR_BINS:
        origin = daily.groupBy(*keys).agg(F.min(date).alias("_origin"))
        daily = daily.join(origin, list(keys))
        label = cal.bin_label(date, freq, "_origin")
    else:
        label = cal.bin_label(date, freq)
    agg = mean_min_frac(value, min_frac) if min_frac is not None else F.avg(value)
    binned = daily.groupBy(*keys, label.alias("bin")).agg(agg.alias(value))
    if not fill:
        return binned
    w = W.partitionBy(*keys).orderBy("bin")
    # each bin emits itself and the empty bins up to the next one: no join with a full grid
    nxt = F.lead("bin").over(w)
    step = F.when(nxt.isNotNull(), F.expr("_seq")).otherwise(F.array("bin"))
    seq = cal.bin_sequence(F.col("bin"), F.col("_next"), freq)
    return (
        binned.withColumn("_next", F.coalesce(nxt, F.col("bin")))
        .withColumn("_seq", seq)
        .select(*keys, value, "bin", F.explode(
            F.when(F.size("_seq") > 1, F.slice("_seq", F.lit(1), F.size("_seq") - 1)).otherwise(F.col("_seq"))).alias("_b"))
        .select(*keys, F.col("_b").alias("bin"), F.when(F.col("_b") == F.col("bin"), F.col(value)).alias(value))
    )


def valid_days(df: DataFrame, keys: Sequence[str], date: str = "date", value: str = "value") -> DataFrame:
    """Distinct days with a value per group."""
    return df.groupBy(*keys).agg(F.countDistinct(F.when(F.col(value).isNotNull(), F.col(date))).alias("valid_days"))


def finite(c: Column) -> Column:
    """NaN and infinite values are missing."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Exact quantiles (linear interpolation) of groups of any size: keys and ``quantiles``, in the order of ``probs``.

    Two scans. The first builds a mergeable sketch per group, whose ranks are off by 1/``accuracy`` at most, and so a
    bracket of values around each wanted rank. The second counts, map-side combined, the values of each bracket one by one
    and those between brackets as a whole; a running count then meets the exact ranks. Nobody collects a group.
    NULL, NaN and infinite values don't count; a NULL key is a key; a group without values has no row.
    """
    keys = list(keys)
    v = df.select(*keys, finite(F.col(value).cast("double")).alias("_v")).where("_v is not null")
    probs = [float(p) for p in probs]
    wide = 2.0 / accuracy
    ends = [min(1.0, max(0.0, p + side * wide)) for p in probs for side in (-1, 1)]
    st = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_e"))
    at = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    want = [F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), F.least(F.floor(x).cast("long") + side, F.col("_n") - 1).alias("k"), (x - F.floor(x)).alias("f"))
            for i, x in enumerate(at) for side in (0, 1)]
    brackets = [F.struct(F.col("_e")[2 * i].alias("lo"), F.col("_e")[2 * i + 1].alias("hi")) for i in range(len(probs))]
    st = st.select(*keys, F.array_distinct(F.array(*brackets)).alias("_br"), F.array(*want).alias("_want"))
    met = v.alias("a").join(st.alias("b"), same("a", "b", keys)).select(*[F.col(f"a.{k}") for k in keys], "_v", "_br", "_want")
    inside = F.expr("exists(_br, b -> _v >= b.lo and _v <= b.hi)")
    met = met.select(*keys, "_want", "_v", F.when(inside, F.col("_v")).alias("_own"), F.expr("size(filter(_br, b -> b.hi < _v))").alias("_after"))
    rows = met.groupBy(*keys, "_own", "_after").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.first("_want").alias("_want"))
    up_to = F.sum("_c").over(W.partitionBy(*keys).orderBy("_min").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_to", up_to).select(*keys, "_min", "_max", "_own", "_c", "_to", F.inline(F.expr("filter(_want, w -> w.k < _to and w.k >= _to - _c)")))
    # between brackets only the neighbours of a bracket are asked for, by the sketch's bound
    x = F.when(F.col("_own").isNotNull() | (F.col("k") == F.col("_to") - F.col("_c")), F.col("_min")).when(F.col("k") == F.col("_to") - 1, F.col("_max")).otherwise(
        F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
    low, high = (F.max(F.when(F.col("side") == s, F.col("_x"))) for s in (0, 1))
    one = rows.withColumn("_x", x).groupBy(*keys, "i").agg((low + (high - low) * F.max("f")).alias("q"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("quantiles"))


def winsor_mean(df: DataFrame, keys: Sequence[str], value: str = "value", lower: float = 0.02, upper: float = 0.98) -> DataFrame:
    """Mean after clipping to two exact quantiles of the group (linear interpolation); groups may have any size."""
    keys = list(keys)
    q = exact_quantiles(df, keys, value, (lower, upper))
    v = finite(F.col(value).cast("double"))
    clipped = F.when(v.isNotNull(), F.greatest(F.col("quantiles")[0], F.least(F.col("quantiles")[1], v)))
    met = df.alias("a").join(q.alias("b"), same("a", "b", keys), "left").select(*[F.col(f"a.{k}") for k in keys], F.col(f"a.{value}").alias(value), "quantiles")
    return met.groupBy(*keys).agg(F.avg(clipped).alias(value))


def doy_window(daily: DataFrame, n_days: int = 31, date: str = "date", doy: str = "doy") -> DataFrame:
    """Each day once for every day of year whose circular window holds it."""
    lo, hi = -(n_days // 2), (n_days - 1) // 2
    k = F.explode(F.sequence(F.lit(lo), F.lit(hi)))
    return daily.withColumn("_k", k).withColumn(doy, F.pmod(cal.noleap_doy(date) - 1 + F.col("_k"), F.lit(365)) + 1).drop("_k")


def reference_period(df: DataFrame, first: str, last: str, date: str = "date", required: bool = False) -> DataFrame:
    """Rows of the period; none at all is an error where they are ``required``."""
    out = df.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return require_rows(out, f"the reference period {first} to {last}") if required else out


def drop_leap_days(df: DataFrame, date: str = "date") -> DataFrame:
    return df.where(~cal.is_leap_day(date))


def _sliding_means(doy: np.ndarray, v: np.ndarray, n_days: int, lower: float, upper: float) -> np.ndarray:
    """Winsorised mean of the circular window around each of 365 days: one sorted list, one day enters and one leaves."""
    order = np.lexsort((v, doy))
    v, at = v[order], np.searchsorted(doy[order], np.arange(1, 367))
    day = lambda d: v[at[(d - 1) % 365] : at[(d - 1) % 365 + 1]]
    back, ahead = (n_days - 1) // 2, n_days // 2
    now = np.sort(np.concatenate([v[:0], *(day(d) for d in range(1 - back, 1 + ahead))]))  # the last day enters below
    out = np.full(365, np.nan)
    for d in range(1, 366):
        come = day(d + ahead)
        now = np.insert(now, np.searchsorted(now, come), come)
        if len(now):
            at_q = (len(now) - 1) * np.array([lower, upper])
            i = np.floor(at_q).astype(int)
            low, high = now[i] + (now[np.minimum(i + 1, len(now) - 1)] - now[i]) * (at_q - i)
            a, b = np.searchsorted(now, low), np.searchsorted(now, high, "right")
            out[d - 1] = (a * low + now[a:b].sum() + (len(now) - b) * high) / len(now)
        gone = day(d - back)
        now = np.delete(now, np.searchsorted(now, gone) + np.arange(len(gone)) - np.searchsorted(gone, gone))
    return out


def doy_climatology(
    daily: DataFrame, keys: Sequence[str], date: str = "date", value: str = "value", n_days: int = 31,
    lower: float = 0.02, upper: float = 0.98,
) -> DataFrame:
    """365 winsorised means per series over a circular day-of-year window of up to 365 days.

    A series has a row per day, so the calendar bounds it and one task takes it whole. NULL, NaN and infinite values don't
    count; days of year whose window has no value have no row.
    """
    if not 1 <= n_days <= 365:
        raise ValueError("the window must have 1 to 365 days")
    keys = list(keys)
    rows = daily.select(*keys, cal.noleap_doy(date).cast("int").alias("doy"), finite(F.col(value).cast("double")).alias(value)).where(F.col(value).isNotNull())
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("doy", T.IntegerType()), T.StructField(value, T.DoubleType())])

    def run(t: pa.Table) -> pa.Table:
        mean = _sliding_means(t.column("doy").to_numpy(), t.column(value).to_numpy(), n_days, lower, upper)
        has = np.flatnonzero(~np.isnan(mean))
        own = t.select(keys).take(np.zeros(len(has), np.int64))
        return pa.table({**{k: own.column(k) for k in keys}, "doy": pa.array(has + 1, pa.int32()), value: mean[has]})

    return rows.groupBy(*keys).applyInArrow(run, schema)


def shared_climatology(
    daily: DataFrame, site: Sequence[str], instrument: str = "instrument", date: str = "date", value: str = "value", n_days: int = 31
) -> DataFrame:
    """Day-of-year climatology pooled over demeaned instruments, centred on zero, plus baselines.

    Returns one row per site, instrument and day of year; the site's own
    climatology (shared + pooled mean) has instrument ``site``.
    """
    site = list(site)
    of = lambda a, names: [F.col(f"{a}.{k}") for k in names]
    base = daily.groupBy(*site, instrument).agg(F.avg(value).alias("baseline"))
    dem = daily.alias("a").join(base.alias("b"), same("a", "b", [*site, instrument])).select(
        *of("a", site), F.col(f"a.{date}").alias(date), (F.col(f"a.{value}") - F.col("baseline")).alias(value))
    clim = doy_climatology(dem, site, date, value, n_days)
    centred = clim.withColumn("shared", F.col(value) - F.avg(value).over(W.partitionBy(*site))).drop(value)
    pooled = daily.groupBy(*site).agg(F.avg(value).alias("baseline")).withColumn(instrument, F.lit("site"))
    levels = base.unionByName(pooled)
    return centred.alias("a").join(levels.alias("b"), same("a", "b", site)).select(
        *of("a", site), instrument, "doy", "shared", (F.col("shared") + F.col("baseline")).alias(value))


def climatology_summaries(df: DataFrame, keys: Sequence[str], date: str = "date", value: str = "value") -> DataFrame:
    """Grand, month and season means by grouping sets: one pass, rows labelled by kind."""
    keys = list(keys)
    d = df.select(*keys, F.month(date).alias("month"), cal.season(date).alias("season"), F.col(value).alias("_v"))
    g = d.groupingSets([[*map(F.col, keys)], [*map(F.col, keys), F.col("month")], [*map(F.col, keys), F.col("season")]],
                       *map(F.col, keys), F.col("month"), F.col("season"))
    out = g.agg(F.avg("_v").alias(value), F.grouping("month").alias("_gm"), F.grouping("season").alias("_gs"))
    kind = F.when(F.col("_gm") == 0, "month").when(F.col("_gs") == 0, "season").otherwise("mean")
    return out.select(*keys, kind.alias("kind"), F.coalesce(F.col("month").cast("string"), "season", F.lit("all")).alias("segment"), value)


def baseline(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("baseline"))


def anomaly(daily: DataFrame, clim: DataFrame, keys: Sequence[str], date: str = "date", value: str = "value") -> DataFrame:
    """Value minus the climatology of its no-leap day of year (29 February removed)."""
    d = drop_leap_days(daily, date).withColumn("doy", cal.noleap_doy(date))
    c = clim.select(*keys, "doy", F.col(value).alias("_clim"))
    return d.join(c, [*keys, "doy"]).withColumn("anomaly", F.col(value) - F.col("_clim")).drop("_clim")


def reconstruct(
    binned: DataFrame, clim: DataFrame, keys: Sequence[str], include_seasonal: bool, label: str = "bin",
    anom: str = "anomaly", value: str = "value",
) -> DataFrame:
    """grand mean [+ climatology of the label's day - grand mean] + anomaly."""
    keys = list(keys)
    grand = clim.groupBy(*keys).agg(F.avg(value).alias("_grand"))
    out = binned.join(grand, keys)
    if not include_seasonal:
        return out.withColumn(value, F.col("_grand") + F.col(anom)).drop("_grand")
    c = clim.select(*keys, F.col("doy").alias("_doy"), F.col(value).alias("_clim"))
    return (
        out.withColumn("_doy", cal.noleap_doy(label)).join(c, [*keys, "_doy"])
        .withColumn(value, F.col("_grand") + (F.col("_clim") - F.col("_grand")) + F.col(anom)).drop("_grand", "_clim", "_doy")
    )


def year_season(
    anoms: DataFrame, clim: DataFrame, keys: Sequence[str], date: str = "date", anom: str = "anomaly", value: str = "value",
    min_frac: float = 0.5, season_year: bool = False,
) -> DataFrame:
    """Mean by (year, season) plus the season's climatology.

    December counts to its own calendar year unless ``season_year``.
    """
    keys = list(keys)
    year = F.year(F.add_months(F.col(date), 1)) if season_year else F.year(date)
    b = anoms.groupBy(*keys, year.alias("year"), cal.season(date).alias("season")).agg(mean_min_frac(anom, min_frac).alias(anom))
    day = F.date_add(F.lit("2001-01-01").cast("date"), F.col("doy") - 1)
    sc = clim.groupBy(*keys, cal.season(day).alias("season")).agg(F.avg(value).alias("_clim"))
    return b.join(sc, [*keys, "season"]).withColumn(value, F.col("_clim") + F.col(anom)).drop("_clim")


def coverage(
    df: DataFrame, keys: Sequence[str], date: str = "date", value: str = "value", first: str = "2000-03-01", last: str = "2025-12-31",
    min_years: float | None = None, min_periods: int | None = None,
) -> DataFrame:
    """Count, span and effective window per series, and whether it is long enough."""
    if (min_years is None) == (min_periods is None):
        raise ValueError("give exactly one of min_years and min_periods")
    a = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(date).alias("first"), F.max(date).alias("last"))
    a = a.withColumn("start", F.greatest("first", F.lit(first).cast("date"))).withColumn("end", F.least("last", F.lit(last).cast("date")))
    if min_years is not None:
        ok = F.datediff("end", "start") >= 365 * min_years
    else:
        ok = F.col("n") >= min_periods
    return a.withColumn("enough", ok)


def subdaily_bins(samples: DataFrame, keys: Sequence[str], time: str = "time", value: str = "value", hours: int = 3) -> DataFrame:
    """Means of fixed windows of some hours, labelled at the window centre."""
    w = F.window(time, f"{hours} hours")
    return samples.groupBy(*keys, w.alias("_w")).agg(F.avg(value).alias(value)).select(
        *keys, (F.col("_w.start") + F.make_dt_interval(hours=F.lit(0), mins=F.lit(hours * 30))).alias("time"), value)


def running_mean(
    daily: DataFrame, keys: Sequence[str], date: str = "date", value: str = "value", window: int = 365, min_frac: float = 0.5
) -> DataFrame:
    """Centred running mean over rows.

    Series shorter than ``window`` use their own length as the window and
    series of a single row are dropped.
    """
    keys = list(keys)
    part = W.partitionBy(*keys)
    seq = part.orderBy(date)
    d = daily.withColumn("_n", F.count(F.lit(1)).over(part)).where(F.col("_n") >= 2)
    need = F.greatest(F.lit(1), F.floor(F.least(F.lit(window), F.col("_n")) * min_frac))

    full = seq.rowsBetween(-(window // 2), (window - 1) // 2)
    long = d.where(F.col("_n") >= window).withColumn("running", F.when(F.count(value).over(full) >= need, F.avg(value).over(full)))

    # the frame depends on the series length: differences of running totals, looked up by row number
    upto = seq.rowsBetween(W.unboundedPreceding, 0)
    short = (
        d.where(F.col("_n") < window)
        .withColumn("_i", F.row_number().over(seq))
        .withColumn("_s", F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(upto))
        .withColumn("_c", F.count(value).over(upto))
    )
    hi = F.least(F.col("_n"), F.col("_i") + F.floor((F.col("_n") - 1) / 2))
    lo = F.col("_i") - F.floor(F.col("_n") / 2) - 1
    tot = short.select(*keys, F.col("_i").cast("bigint").alias("_j"), F.col("_s").alias("_ts"), F.col("_c").alias("_tc"))
    low = tot.select(*keys, F.col("_j").alias("_l"), F.col("_ts").alias("_ls"), F.col("_tc").alias("_lc"))
    short = (
        short.withColumn("_j", hi).withColumn("_l", lo)
        .join(tot, [*keys, "_j"]).join(low, [*keys, "_l"], "left")
        .withColumn("_s", F.col("_ts") - F.coalesce("_ls", F.lit(0.0))).withColumn("_c", F.col("_tc") - F.coalesce("_lc", F.lit(0)))
        .withColumn("running", F.when((F.col("_c") >= need) & (F.col("_c") > 0), F.col("_s") / F.col("_c")))
    )
    cols = [*daily.columns, "running"]
    return long.select(*cols).unionByName(short.select(*cols))
