"""Calibration factors from daily lidar-ratio candidates.

Candidates are daily, so a series is bounded by the calendar; the windows
below run per site, instrument and calibration segment.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import cut
from .joins import segment_of

# Windows in years with their labels, quantile, counts and the multiple-scattering factor.
WINDOWS = ((2.0, "rolling_two_year"), (3.0, "rolling_three_year"), (4.0, "rolling_four_year"))
QUANTILE = 0.4
WINDOW_MIN = 30
MIN_CANDIDATES = 3
SCATTERING = 0.78
YEAR_US = int(365.25 * 86400 * 1_000_000)


def prepare_candidates(df: DataFrame, keys: Sequence[str], date: str = "date", ratio: str = "lidar_ratio", *, order: str) -> DataFrame:
    """One positive candidate per date; of several the last one by ``order`` wins."""
    ok = df.where(F.col(date).isNotNull() & (F.col(ratio) > 0))
    return ok.groupBy(*keys, date).agg(F.max_by(ratio, F.col(order)).alias(ratio))


def prepare_targets(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    return df.where(F.col(date).isNotNull()).select(*keys, date).distinct()


def _window_quantiles(t: np.ndarray, v: np.ndarray, at: np.ndarray, half: int, q: float, least: int) -> np.ndarray:
    """Quantile of the values with times in (x - half, x + half] for each x of ``at``; NaN under ``least`` values.

    Times are sorted. The window's values stay in order: the next x lets some in and some out.
    """
    first, stop = np.searchsorted(t, at - half, "right").tolist(), np.searchsorted(t, at + half, "right").tolist()
    out, now, a, b = np.full(len(at), np.nan), [], 0, 0
    values = v.tolist()
    for i, (x, y) in enumerate(zip(first, stop, strict=True)):
        if y - x < max(least, 1):
            continue
        if x >= b:
            now = sorted(values[x:y])
        else:
            for come in values[b:y]:
                insort(now, come)
            for gone in values[a:x]:
                del now[bisect_left(now, gone)]
        a, b = x, y
        pos = (len(now) - 1) * q
        k = int(pos)
        out[i] = now[k] + (now[min(k + 1, len(now) - 1)] - now[k]) * (pos - k)
    return out


def rolling_quantile(
    df: DataFrame, keys: Sequence[str], date: str = "date", value: str = "lidar_ratio", window_min: int = WINDOW_MIN, q: float = QUANTILE
) -> DataFrame:
    """Centred time-window quantile; the first of 2, 3 and 4 years with enough values gives the result and the label.

    The frame of width w around t is (t - w/2, t + w/2]. A segment's daily rows (bounded by the calendar) meet in one task,
    which runs once over them per width, and over the wider ones only for rows that lack values. NULL and NaN values don't
    count; rows without a date get NULL.
    """
    keys = list(keys)
    schema = T.StructType([*df.schema, T.StructField("rolling", T.DoubleType()), T.StructField("label", T.StringType())])

    def run(t: pa.Table) -> pa.Table:
        us = t.column("_us").to_numpy()
        dated = np.flatnonzero(~np.isnan(us)) if us.dtype.kind == "f" else np.arange(len(us))
        order = dated[np.argsort(us[dated], kind="stable")]
        at = us[order].astype(np.int64)
        v = t.column(value).cast(pa.float64()).to_numpy()[order]
        has = ~np.isnan(v)
        rolling, label, open_ = np.full(len(us), np.nan), np.full(len(us), None, object), np.arange(len(at))
        for years, name in WINDOWS:
            got = _window_quantiles(at[has], v[has], at[open_], int(years * YEAR_US / 2), q, window_min)
            met = ~np.isnan(got)
            rolling[order[open_[met]]], label[order[open_[met]]] = got[met], name
            open_ = open_[~met]
        return t.drop_columns(["_us"]).append_column("rolling", pa.array(rolling, from_pandas=True)).append_column("label", pa.array(label, pa.string()))

    return df.withColumn("_us", F.unix_micros(F.col(date).cast("timestamp"))).groupBy(*keys).applyInArrow(run, schema)


def interpolate(df: DataFrame, keys: Sequence[str], date: str, value: str) -> Column:
    """Linear in time between valid neighbours, flat outside (as a window expression)."""
    w = W.partitionBy(*keys).orderBy(date)
    back, fwd = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*keys).orderBy(F.desc(date)).rowsBetween(W.unboundedPreceding, 0)
    has = F.when(F.col(value).isNotNull(), F.struct(F.col(date).alias("d"), F.col(value).alias("v")))
    p, n = F.last(has, ignorenulls=True).over(back), F.last(has, ignorenulls=True).over(fwd)
    span, at = F.datediff(n["d"], p["d"]), F.datediff(F.col(date), p["d"])
    return F.when(p.isNull(), n["v"]).when(n.isNull(), p["v"]).when(span == 0, p["v"]).otherwise(p["v"] + (n["v"] - p["v"]) * at / span)


def time_interpolate(df: DataFrame, keys: Sequence[str], date: str, value: str, out: str = "interpolated") -> DataFrame:
    """Append the interpolated value and whether the row's own value or a neighbour gave it."""
    status = F.when(F.col(value).isNotNull(), "valid").when(F.col(out).isNotNull(), "interpolated").otherwise("missing")
    return df.withColumn(out, interpolate(df, keys, date, value)).withColumn("status", status)


def calibration_factors(
    candidates: DataFrame, targets: DataFrame, breakpoints: DataFrame, keys: Sequence[str], sc_ratio: Column, window_min: int = WINDOW_MIN,
    min_candidates: int = MIN_CANDIDATES, scattering: float = SCATTERING, *, order: str,
) -> DataFrame:
    """Factor and status of every target date, never across a breakpoint.

    ``sc_ratio`` is a column of the keys giving the instrument's own ratio.
    """
    keys = list(keys)
    g = [*keys, "segment"]
    cand = prepare_candidates(candidates, keys, order=order)
    total = cand.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n_valid_candidate_lidar_ratios"))
    cand = segment_of(cand, breakpoints, keys)
    roll = cut(rolling_quantile(cand, g, window_min=window_min))  # daily rows, read twice below
    seg = roll.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.count("rolling").alias("_nr"), F.percentile("lidar_ratio", 0.5).alias("_med"))
    tgt = segment_of(prepare_targets(targets, keys), breakpoints, keys).withColumn("_t", F.lit(True))
    both = roll.join(tgt, [*g, "date"], "full")
    both = both.withColumn("_i", interpolate(both, g, "date", "rolling")).where("_t").join(seg, g, "left").join(total, keys, "left")
    few = (F.col("_n") < min_candidates) | (F.col("_nr") == 0)
    ratio = F.when(F.col("_n").isNull(), F.lit(None)).when(few, F.col("_med")).otherwise(F.col("_i"))
    status = (
        F.when(F.col("_sc") <= 0, "default_invalid_instrument_ratio").when(F.col("_n").isNull(), "default_no_candidates")
        .when(few, "candidate_median_fallback").when(F.col("rolling").isNotNull(), F.col("label")).otherwise("interpolated"))
    out = both.withColumn("_sc", sc_ratio).withColumn("rolling_median_lidar_ratio", F.when(F.col("_sc") > 0, ratio)).withColumn("factor_status", status)
    factor = F.coalesce(F.col("rolling_median_lidar_ratio") / F.col("_sc") * scattering, F.lit(1.0))
    return out.select(
        *keys, "date", factor.alias("autocalibration_factor"), "factor_status",
        F.when(F.col("_sc") > 0, F.col("lidar_ratio")).alias("candidate_lidar_ratio"), "rolling_median_lidar_ratio",
        F.col("_sc").alias("instrument_sc_lidar_ratio"),
        F.when(F.col("_sc") > 0, F.coalesce("n_valid_candidate_lidar_ratios", F.lit(0))).otherwise(F.lit(0)).alias("n_valid_candidate_lidar_ratios"))
