"""Label alignments as joins: nearest cell, priority fill, overlap exclusion, as-of segments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import cut, same
from ..functions.scalar import haversine_m

# Days on either side in which a lower-ranked instrument is dropped.
OVERLAP_WINDOW = {"daily": 0, "3day": 2, "weekly": 3, "monthly": 13}


def _axis(grid: DataFrame, col: str) -> tuple[DataFrame, Column]:
    """Coordinates by whole degree (one row and one short list per degree), and the ends of all lists as one array.

    There are at most 541 degrees; a list holds what the grid's resolution puts into one degree. The nearest
    coordinate of any place is in the list of its own degree or an end of another list.
    """
    per = cut(grid.select(col).where(F.col(col).isNotNull()).groupBy(F.floor(col).alias("_deg")).agg(F.collect_set(col).alias("_own")))
    ends = per.agg(F.flatten(F.collect_list(F.array(F.array_min("_own"), F.array_max("_own")))).alias("e")).scalar()
    return per, ends


def _nearest(axis: Column, x: Column) -> Column:
    """Entry of an array nearest to x (the larger one on a tie)."""
    below = F.array_max(F.filter(axis, lambda v: v <= x))
    above = F.array_min(F.filter(axis, lambda v: v >= x))
    return F.when(below.isNull() | (above - x <= x - below), above).otherwise(below)


def _snap(sites: DataFrame, grid: DataFrame, col: str, x: str, out: str) -> DataFrame:
    per, ends = _axis(grid, col)
    s = sites.withColumns({"_deg": F.floor(x), "_ends": ends}).join(per, "_deg", "left")
    s = s.withColumn("_own", F.concat(F.coalesce("_own", F.array().cast("array<double>")), "_ends"))
    return s.withColumn(out, _nearest(F.col("_own"), F.col(x))).drop("_deg", "_own", "_ends")


def nearest_cell(grid: DataFrame, sites: DataFrame) -> DataFrame:
    """Grid rows of the cell nearest to each site (latitude and 0-360 longitude independently), with the distance.

    Each site picks its cell from the two axes, then one equi-join fetches the
    rows; sites and grid are never multiplied.
    """
    s = sites.select("site", F.col("lat").alias("_slat"), F.col("lon").alias("_slon"), F.pmod("lon", F.lit(360.0)).alias("_x"))
    s = _snap(_snap(s, grid, "lat", "_slat", "_cl"), grid, "lon", "_x", "_cn").drop("_x")
    j = grid.join(s, (F.col("lat") == F.col("_cl")) & (F.col("lon") == F.col("_cn")))
    dist = haversine_m("_slat", "_slon", "lat", "lon") / 1000.0
    return j.withColumn("distance_km", dist).drop("_slat", "_slon", "_cl", "_cn")


def priority_gap_fill(
    df: DataFrame, keys: Sequence[str], instrument: str, priority: Column, values: Sequence[str]
) -> DataFrame:
    """Per key and variable the value of the best-ranked instrument that has one (ties by name)."""
    order = F.struct(priority.alias("p"), F.col(instrument).alias("i"))
    aggs = [F.min_by(v, F.when(F.col(v).isNotNull(), order)).alias(v) for v in values]
    return df.groupBy(*keys).agg(*aggs)


def overlap_exclusion(
    df: DataFrame, site: Sequence[str], instrument: str, window: int, date: str = "date", value: str = "value"
) -> DataFrame:
    """Drop samples of lower-ranked instruments within +-window days of a valid kept day of a higher rank; adds the rank.

    Ranks: most valid days, then earliest first day, then name. The valid days of a site's instruments (bounded by the
    calendar) meet in one row each; days blocked for an instrument come back as a bit set, which its samples look up: no
    round per rank and no day is exploded. Rows without a date stay; NULL sites and instruments are sites and instruments.
    """
    site = list(site)
    own = [*site, instrument]
    day = F.when(F.col(value).isNotNull(), F.datediff(F.col(date).cast("date"), F.lit("1970-01-01").cast("date")))
    days = df.groupBy(*own).agg(F.sort_array(F.collect_set(day)).alias("_days"))
    fields = [days.schema[k] for k in own]
    extra = [T.StructField("rank", T.IntegerType()), T.StructField("_base", T.LongType()), T.StructField("_bits", T.ArrayType(T.LongType()))]

    def block(t: pa.Table) -> pa.Table:
        names, valid = t.column(instrument).to_pylist(), [np.array(d, np.int64) for d in t.column("_days").to_pylist()]
        order = sorted(range(len(names)), key=lambda i: (-len(valid[i]), valid[i][0] if len(valid[i]) else 0, names[i] is not None, names[i] or ""))
        every = np.concatenate(valid)
        base = int(every.min(initial=0)) - window if len(every) else 0
        size = int(every.max()) + window + 1 - base if len(every) else 0
        size += -size % 64
        blocked, rank, bits = np.zeros(size, bool), [0] * len(names), [[]] * len(names)
        for r, i in enumerate(order, 1):
            rank[i], bits[i] = r, np.packbits(blocked, bitorder="little").view(np.int64).tolist()
            kept = valid[i][~blocked[valid[i] - base]] - base
            edge = np.zeros(size + 1, np.int64)
            np.add.at(edge, kept - window, 1)
            np.add.at(edge, kept + window + 1, -1)
            blocked |= np.cumsum(edge)[:-1] > 0
        return t.select(own).append_column("rank", pa.array(rank, pa.int32())).append_column("_base", pa.array([base] * len(rank), pa.int64())).append_column(
            "_bits", pa.array(bits, pa.list_(pa.int64())))

    marks = days.groupBy(*site).applyInArrow(block, T.StructType([*fields, *extra]))
    met = df.alias("a").join(marks.alias("b"), same("a", "b", own)).select("a.*", "rank", "_base", "_bits")
    at = F.datediff(F.col(date).cast("date"), F.lit("1970-01-01").cast("date")) - F.col("_base")
    word = F.get("_bits", F.floor(at / 64).cast("int"))
    hit = F.expr("shiftright(_word, cast(pmod(_at, 64) as int)) & 1")
    met = met.withColumns({"_word": word, "_at": at}).where(F.coalesce(hit, F.lit(0).cast("long")) == 0)
    return met.drop("_base", "_bits", "_word", "_at")


def mask_by_zenith(samples: DataFrame, zenith: DataFrame, keys: Sequence[str], keep: Column, value: str = "value", angle: str = "z") -> DataFrame:
    """Samples with their value kept where ``keep``, a condition on the angle, holds; NULL elsewhere and without an angle.

    ``zenith`` may hold a place and time more than once (grids overlap): the largest angle counts.
    """
    keys = list(keys)
    one = zenith.groupBy(*keys).agg(F.max(angle).alias(angle))
    met = samples.alias("a").join(one.alias("b"), same("a", "b", keys), "left").select("a.*", angle)
    return met.withColumn(value, F.when(keep, F.col(value))).drop(angle)


def segment_of(df: DataFrame, breakpoints: DataFrame, keys: Sequence[str], date: str = "date", bp: str = "breakpoint") -> DataFrame:
    """Number of breakpoints at or before each date: a breakpoint opens a new segment.

    Breakpoints are manual configuration, a short list per series, held as an array.
    """
    b = breakpoints.groupBy(*keys).agg(F.array_sort(F.collect_set(bp)).alias("_bps"))
    n = F.size(F.filter("_bps", lambda x: x <= F.col(date)))
    return df.join(b, list(keys), "left").withColumn("segment", F.when(F.col("_bps").isNull(), F.lit(0)).otherwise(n)).drop("_bps")


def site_time_grid(sites: DataFrame, first: str, last: str, step: str) -> DataFrame:
    """Every site at every step: each site row emits its own time axis."""
    t = F.sequence(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"), F.expr(step))
    return sites.select("*", F.explode(t).alias("time"))


def dataset_pairs(df: DataFrame, keys: Sequence[str], dataset: str, value: str, pairs: Sequence[tuple[str, str]] | None = None,
                  extra: Sequence[str] = ()) -> DataFrame:
    """Rows of two datasets side by side on the same keys, both present.

    All datasets of a key are folded into one map (the list of datasets is
    fixed and short), and the listed pairs are read from it.
    """
    cols = [value, *extra]
    m = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(dataset), F.struct(*cols)))).alias("_m"))
    if pairs is None:
        names = F.array_sort(F.map_keys("_m"))
        pr = F.flatten(F.transform(names, lambda a: F.transform(F.filter(names, lambda b: b > a), lambda b: F.struct(a.alias("x_set"), b.alias("y_set")))))
    else:
        pr = F.array(*[F.struct(F.lit(a).alias("x_set"), F.lit(b).alias("y_set")) for a, b in pairs])
    out = m.select(*keys, "_m", F.inline(pr)).select(
        *keys, "x_set", "y_set", F.col("_m")[F.col("x_set")].alias("_x"), F.col("_m")[F.col("y_set")].alias("_y"))
    out = out.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    sel = [F.col("_x")[c].alias(f"x_{c}") for c in cols] + [F.col("_y")[c].alias(f"y_{c}") for c in cols]
    return out.select(*keys, "x_set", "y_set", *sel)
