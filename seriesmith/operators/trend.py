"""Mann-Kendall tests and Sen slopes for all series at once, without emitting pairs.

Kendall's S is counted by splitting time dyadically: every pair of different
times is separated at exactly one bit of the time index, and at that bit the
earlier row is a "left" and the later one a "right" row. Within a group of
equal higher bits, a running count of left rows by value gives the pairs. A row
is emitted once per bit (about 12 for days of a decade), never once per
partner.

Order statistics of the pairwise slopes are in ``slopes``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import MISSING, cut, same
from ..functions import calendar as cal
from ..functions.scalar import SECONDS_PER_YEAR, normal_ppf, quantize, two_sided_p
from .slopes import slope_ranks

#: Distinct values of a stratum that one running count covers, on average.
VALUE_BLOCK = 1 << 14
SIGMA_LEVELS = (68.27, 95.45, 99.73)
MIN_SAMPLES = 10
MIN_DENOMINATOR = 1e-3


def ticks(df: DataFrame, time: str) -> tuple[Column, float]:
    """Integer time index of a DATE or TIMESTAMP column and its unit in seconds."""
    if isinstance(df.schema[time].dataType, T.DateType):
        return F.datediff(F.col(time), F.lit("1970-01-01").cast("date")).cast("bigint"), 86400.0
    return F.col(time).cast("timestamp").cast("bigint"), 1.0


def stratum(instrument: Column | None = None, season: Column | None = None) -> Column:
    """Label of the stratum; pairs are only compared inside one."""
    parts = [F.coalesce(c.cast("string"), F.lit(MISSING)) for c in (instrument, season) if c is not None]
    return F.concat_ws("|", *parts) if parts else F.lit("all")


def tie_statistics(df: DataFrame, keys: Sequence[str], strat: str, t: str, y: str, resolution: float, weight: str | None = None) -> DataFrame:
    """Counts, spans and tie sums per stratum: equal values (v*) and equal times (t*), and values at which to split it.

    The splits are a hash sample of the distinct values: blocks by rank, however the values are spread.
    """
    obs = df.where(F.col(y).isNotNull())
    marks = F.array(
        F.struct(F.lit("v").alias("_k"), quantize(y, resolution).alias("_x_")),
        F.struct(F.lit("t").alias("_k"), F.col(t).cast("double").alias("_x_")),
    )
    c = F.col("_c").cast("double")
    groups = obs.select(*keys, strat, *([F.col(weight).alias("_w")] if weight else []), F.inline(marks)).groupBy(*keys, strat, "_k", "_x_").agg((F.sum("_w") if weight else F.count(F.lit(1))).alias("_c"))
    aggs = []
    for kind in ("v", "t"):
        is_k = F.col("_k") == kind
        aggs += [
            F.sum(F.when(is_k, c * (c - 1) * (c * 2 + 5))).alias(f"{kind}5"),
            F.sum(F.when(is_k, c * (c - 1) * (c - 2))).alias(f"{kind}3"),
            F.sum(F.when(is_k, c * (c - 1))).alias(f"{kind}2"),
            F.min(F.when(is_k, F.col("_x_"))).alias(f"{kind}min"),
            F.max(F.when(is_k, F.col("_x_"))).alias(f"{kind}max"),
        ]
    split = (F.col("_k") == "v") & (F.pmod(F.xxhash64("_x_"), F.lit(VALUE_BLOCK)) == 0)
    return groups.groupBy(*keys, strat).agg(
        F.sum(F.when(F.col("_k") == "v", F.col("_c"))).alias("n"), F.sort_array(F.collect_list(F.when(split, F.col("_x_")))).alias("splits"), *aggs)


#: How many of the sorted ``splits`` are under ``_q`` (binary search).
BLOCK_OF = """if(size(splits) = 0, 0, aggregate(sequence(length(bin(size(splits))) - 1, 0, -1), 0,
    (a, b) -> if(a + shiftleft(1, b) <= size(splits) and get(splits, a + shiftleft(1, b) - 1) < _q, a + shiftleft(1, b), a)))"""


def kendall_variance(n: Column, v5: Column, v3: Column, v2: Column, t5: Column, t3: Column, t2: Column) -> Column:
    """Variance of S with ties in value and in time; 0 below two values."""
    n = n.cast("double")
    out = (n * (n - 1) * (n * 2 + 5) - v5 - t5) / 18.0 + v2 * t2 / (n * (n - 1) * 2.0)
    third = F.when(n > 2, v3 * t3 / (n * (n - 1) * (n - 2) * 9.0)).otherwise(F.lit(0.0))
    return F.when(n >= 2, out + third).otherwise(F.lit(0.0))


def pair_counts(df: DataFrame, keys: Sequence[str], strat: str, t: str, y: str, resolution: float,
                ties: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """Rising and falling pairs per stratum and their difference, Kendall's S, by dyadic splits of time (see the module text)."""
    keys = list(keys)
    ties = ties if ties is not None else tie_statistics(df, keys, strat, t, y, resolution, weight)
    group_keys = [*keys, strat]
    span = ties.where("n >= 2").select(*group_keys, "splits", "tmin", "tmax")
    rows = df.where(F.col(y).isNotNull()).select(
        *group_keys, F.col(t).alias("_t"), quantize(y, resolution).alias("_q"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"))
    rows = rows.alias("r").join(span.alias("p"), same("r", "p", group_keys)).select(*[F.col(f"r.{k}") for k in group_keys], "_t", "_q", "_w", "splits", "tmin", "tmax")
    rows = (
        rows.select(
            *group_keys, "_q", "_w", (F.col("_t") - F.col("tmin").cast("bigint")).alias("_d"), F.expr(BLOCK_OF).alias("_vb"),
            F.length(F.bin((F.col("tmax") - F.col("tmin")).cast("bigint"))).alias("_bits"),
        )
        .withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)))
        .withColumn("_right", F.expr("shiftright(_d, _b) & 1"))
        .withColumn("_p", F.expr("shiftright(_d, _b + 1)"))
    )
    group = [*group_keys, "_b", "_p"]
    vals = rows.groupBy(*group, "_vb", "_q").agg(
        F.sum((1 - F.col("_right")) * F.col("_w")).alias("_l"), F.sum(F.col("_right") * F.col("_w")).alias("_r"))

    def counted(x: DataFrame, part: list[str], order: str, up: Column, down: Column) -> DataFrame:
        """Adds the pairs of a right row with left rows under and over it in the same part."""
        w = W.partitionBy(*part)
        under = F.coalesce(F.sum("_l").over(w.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        x = x.withColumns({"_under": under, "_all": F.sum("_l").over(w)})
        return x.withColumns({"_up": up + F.col("_r") * F.col("_under"), "_down": down + F.col("_r") * (F.col("_all") - F.col("_under") - F.col("_l"))})

    inside = counted(vals, [*group, "_vb"], "_q", F.lit(0), F.lit(0))
    blocks = inside.groupBy(*group, "_vb").agg(*[F.sum(c).alias(c) for c in ("_l", "_r", "_up", "_down")])
    blocks = counted(blocks, group, "_vb", F.col("_up"), F.col("_down"))
    return blocks.groupBy(*group_keys).agg((F.sum("_up") - F.sum("_down")).alias("s"), F.sum("_up").alias("rising"), F.sum("_down").alias("falling"))


def mk_strata(df: DataFrame, keys: Sequence[str], strat: str, t: str, y: str, resolution: float) -> DataFrame:
    """n, S, variance and number of comparable pairs per stratum."""
    keys = list(keys)
    ties = tie_statistics(df, keys, strat, t, y, resolution)
    s = pair_counts(df, keys, strat, t, y, resolution, ties)
    var = kendall_variance(*[F.col(c) for c in ("n", "v5", "v3", "v2", "t5", "t3", "t2")])
    n = F.col("n").cast("double")
    on = same("a", "b", [*keys, strat])
    return ties.alias("a").join(s.alias("b"), on, "left").select(
        *[F.col(f"a.{k}") for k in (*keys, strat)], "n", F.coalesce("s", F.lit(0)).alias("s"), var.alias("var"),
        ((n * (n - 1) - F.col("t2")) / 2).cast("bigint").alias("n_pairs"))


def mk_series(df: DataFrame, keys: Sequence[str], strat: str, t: str, y: str, resolution: float) -> DataFrame:
    """The same summed over the strata of a series, with the normal score."""
    out = mk_strata(df, keys, strat, t, y, resolution).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("var").alias("var"), F.sum("n_pairs").alias("n_pairs"))
    return out.withColumn("z", z_score("s", "var"))


def z_score(s: str, var: str) -> Column:
    sc = F.col(s).cast("double")
    return F.when((sc == 0) | (F.col(var) <= 0), F.lit(0.0)).otherwise((sc - F.signum(sc)) / F.sqrt(F.col(var)))


def mk_test(stats: DataFrame, alpha: float = 95.0, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """p value and significance flag; too short series carry a reason instead."""
    ok = F.col("n") >= min_samples
    p = two_sided_p("z")
    return (
        stats.withColumn("p", F.when(ok, p))
        .withColumn("ss", F.when(ok, F.when(F.col("p") <= 1.0 - alpha / 100.0, F.lit(int(alpha))).otherwise(F.lit(0))))
        .withColumn("reason", F.when(~ok, F.concat(F.lit("too few values: "), F.col("n").cast("string"))))
    )


# --- slope estimates -------------------------------------------------------------------------------


def ci_index(n_pairs: Column, var: Column, z: Column) -> tuple[Column, Column]:
    """Ranks of the lower and upper confidence bound (halves to even; the upper one is not shifted)."""
    n = n_pairs.cast("double")
    c = z * F.sqrt(F.greatest(var, F.lit(0.0)))
    lower = F.greatest(F.rint((n - c) / 2.0) - 1, F.lit(0.0))
    upper = F.least(F.rint((n + c) / 2.0), n - 1)
    return lower.cast("bigint"), upper.cast("bigint")


def _median_ranks(n: str = "n_pairs") -> list[tuple[str, Column]]:
    return [("med_lo", F.floor((F.col(n) - 1) / 2).cast("bigint")), ("med_hi", F.floor(F.col(n) / 2).cast("bigint"))]


def _pick(stats: DataFrame, df: DataFrame, keys: list[str], strat: str, t: str, y: str, unit: float,
          wanted: list[tuple[str, Column]]) -> DataFrame:
    """Append the slopes at several named ranks of each series as columns."""
    st = stats.where("n_pairs > 0")
    tags = F.array(*[F.struct(F.lit(n).alias("tag"), c.alias("k")) for n, c in wanted])
    tagged = cut(st.select(*keys, F.inline(tags)))
    vals = slope_ranks(df, keys, strat, t, y, tagged, unit)
    wide = tagged.join(vals, [*keys, "k"]).groupBy(*keys).agg(*[
        F.max(F.when(F.col("tag") == n, F.col("slope"))).alias(n) for n, _ in wanted])
    return stats.join(wide, keys, "left")


def sen_slope(
    df: DataFrame, keys: Sequence[str], strat: str, t: str, y: str, stats: DataFrame, unit: float = 86400.0,
    alphas: Sequence[float] = (), scale: float = SECONDS_PER_YEAR,
) -> DataFrame:
    """Median slope per year and confidence bounds at several levels, added to the test statistics."""
    keys = list(keys)
    wanted = _median_ranks()
    for i, a in enumerate(alphas):
        lo, hi = ci_index(F.col("n_pairs"), F.col("var"), F.lit(-normal_ppf((1.0 - a / 100.0) / 2.0)))
        wanted += [(f"_lo{i}", lo), (f"_hi{i}", hi)]
    out = _pick(stats, df, keys, strat, t, y, unit, wanted)
    out = out.withColumn("slope", (F.col("med_lo") + F.col("med_hi")) / 2.0 * scale).drop("med_lo", "med_hi")
    ci = [F.struct(F.lit(float(a)).alias("alpha"), (F.col(f"_lo{i}") * scale).alias("lower"), (F.col(f"_hi{i}") * scale).alias("upper"))
          for i, a in enumerate(alphas)]
    if ci:
        out = out.withColumn("ci", F.array(*ci))
    return out.drop(*[f"_{e}{i}" for i in range(len(alphas)) for e in ("lo", "hi")])


def quantile_function(
    df: DataFrame, keys: Sequence[str], strat: str, t: str, y: str, stats: DataFrame, n_points: int = 2001, unit: float = 86400.0
) -> DataFrame:
    """Quantile function of the slope estimate: bounds at evenly spaced confidence levels, and the median."""
    keys = list(keys)
    eps = 1e-6
    step = (100.0 - 2 * eps) / (n_points - 1)
    zs = [-normal_ppf((1.0 - min(100.0 - eps, eps + step * i) / 100.0) / 2.0) for i in range(n_points)]
    alpha = [min(100.0 - eps, eps + step * i) for i in range(n_points)]
    grid = df.sparkSession.createDataFrame(
        pd.DataFrame({"_alpha": alpha, "_z": zs}))
    table = grid.agg(F.collect_list(F.struct("_alpha", "_z")).alias("_grid"))
    # the grid has a fixed number of rows, so it travels as one array literal per series
    st = stats.where("n_pairs > 0").withColumn("_grid", table.scalar())
    st = st.select(*keys, "n_pairs", "var", F.inline("_grid"))
    lo, hi = ci_index(F.col("n_pairs"), F.col("var"), F.col("_z"))
    side = F.array(
        F.struct(((100.0 - F.col("_alpha")) / 200.0).alias("probability_level"), lo.alias("k")),
        F.struct(((100.0 + F.col("_alpha")) / 200.0).alias("probability_level"), hi.alias("k")))
    wanted = st.select(*keys, F.inline(side))
    med = stats.where("n_pairs > 0").select(*keys, F.lit(0.5).alias("probability_level"), F.explode(F.array(*[c for _, c in _median_ranks()])).alias("k"))
    asked = cut(wanted.unionByName(med))
    vals = slope_ranks(df, keys, strat, t, y, asked, unit)
    return asked.join(vals, [*keys, "k"]).groupBy(*keys, "probability_level").agg(
        (F.avg("slope") * SECONDS_PER_YEAR).alias("quantile_value_per_year"))


# --- autocorrelation and prewhitening ---------------------------------------------------------------


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def lag_autocorrelation(df: DataFrame, keys: Sequence[str], t: str, y: str, lag: int = 1) -> DataFrame:
    """Pearson correlation of rows ``lag`` positions apart, both present; NULL if constant."""
    w = W.partitionBy(*keys).orderBy(t)
    return df.withColumn("_l", F.lag(y, lag).over(w)).groupBy(*keys).agg(
        _finite(F.corr(y, "_l")).alias("r"), F.count(y).alias("n"))


def _significant(r: Column, n: Column, alpha: float) -> Column:
    z = normal_ppf(1.0 - (1.0 - alpha / 100.0) / 2.0)
    return F.coalesce((n >= 5) & (F.abs(r) >= F.lit(z) / F.sqrt(n.cast("double"))), F.lit(False))


def prewhiten(df: DataFrame, keys: Sequence[str], t: str, y: str, alpha: float = 95.0) -> DataFrame:
    """x_t - r1 x_(t-1) where the lag-1 autocorrelation is significant, else x; first row NULL then."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy(t)
    d = df.withColumn("_l", F.lag(y).over(w))
    r = d.groupBy(*keys).agg(_finite(F.corr(y, "_l")).alias("r1"), F.count(y).alias("_n"))
    r = r.withColumn("significant", _significant(F.col("r1"), F.col("_n"), alpha)).drop("_n")
    return d.join(r, keys).withColumn("pw", F.when(F.col("significant"), F.col(y) - F.col("r1") * F.col("_l")).otherwise(F.col(y))).drop("_l")


def group_slope(df: DataFrame, keys: Sequence[str], t: str, y: str, unit: float, name: str) -> DataFrame:
    """Median pairwise slope per second of each group, without strata."""
    keys = list(keys)
    d = df.withColumn("_all", F.lit("all"))
    n = d.where(F.col(y).isNotNull()).groupBy(*keys, t).agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(
        F.expr("cast((pow(sum(_c), 2) - sum(pow(_c, 2))) / 2 as bigint)").alias("n_pairs"))
    out = _pick(n, d, keys, "_all", t, y, unit, _median_ranks())
    return out.select(*keys, ((F.col("med_lo") + F.col("med_hi")) / 2.0).alias(name))


def prewhitening_variants(
    df: DataFrame, keys: Sequence[str], instrument: str, t: str, y: str, unit: float, alpha: float = 95.0, iterate: bool = False
) -> DataFrame:
    """Append pw, pw_cor, tfpw_y, vctfpw (and tfpw_ws when ``iterate``) computed per instrument.

    Each group keeps its raw values when its autocorrelation is not
    significant or too close to one. Rows must be densified: lags go by row.
    """
    keys = list(keys)
    g = [*keys, instrument]
    w = W.partitionBy(*g)
    d = (
        df.withColumn("_tr", (F.col(t) - F.min(t).over(w)) * F.lit(unit))
        .withColumn("_ly", F.lag(y).over(w.orderBy(t))).withColumn("_ltr", F.lag("_tr").over(w.orderBy(t)))
    )
    first = d.groupBy(*g).agg(_finite(F.corr(y, "_ly")).alias("_r1"), F.count(y).alias("_n"), F.var_samp(y).alias("_vy"))
    usable = _significant(F.col("_r1"), F.col("_n"), alpha) & (F.col("_r1") < 1.0 - MIN_DENOMINATOR)
    # one row per group, read by every later step
    first = cut(first.withColumn("_use", usable).join(group_slope(df, g, t, y, unit, "_b0"), g, "left"))
    d = d.join(first, g).withColumn("_dt", F.col(y) - F.col("_b0") * F.col("_tr")).withColumn(
        "_ldt", F.col("_ly") - F.col("_b0") * F.col("_ltr"))
    second = d.groupBy(*g).agg(_finite(F.corr("_dt", "_ldt")).alias("_r2"))
    d = d.join(second, g).withColumn(
        "_a", F.when(_significant(F.col("_r2"), F.col("_n"), alpha), F.col("_dt") - F.col("_r2") * F.col("_ldt")).otherwise(F.col("_dt")))
    third = d.groupBy(*g).agg(F.var_samp("_a").alias("_va"))
    d = d.join(third, g)
    scale = F.when(F.col("_va") != 0, F.col("_vy") / F.col("_va")).otherwise(F.lit(1.0))
    r2 = F.col("_r2")
    b_vc = F.when((r2 >= 0) & (r2 < 1), F.col("_b0") / F.sqrt((r2 + 1.0) / (F.lit(1.0) - r2))).otherwise(F.col("_b0"))
    raw = F.col(y)
    pw = raw - F.col("_r1") * F.col("_ly")

    def pick(c: Column) -> Column:
        return F.when(F.col("_use"), c).otherwise(raw)

    out = d.withColumns({
        "pw": pick(pw),
        "pw_cor": pick(pw / (F.lit(1.0) - F.col("_r1"))),
        "tfpw_y": pick(F.col("_a") + F.col("_b0") * F.col("_tr")),
        "vctfpw": pick(F.col("_a") * scale + b_vc * F.col("_tr")),
    })
    if iterate:
        out = _iterate_ws(out, g, t, y, unit, alpha)
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in df.columns])


def _iterate_ws(d: DataFrame, g: list[str], t: str, y: str, unit: float, alpha: float) -> DataFrame:
    """Slope and autocorrelation in turn until both settle; at most 11 rounds.

    The driver only sees whether any group is still moving; the state table
    has one row per group and is checkpointed each round.
    """
    n = F.col("_n")

    def autocorr(x: DataFrame, slope: str, name: str) -> DataFrame:
        a = x.withColumn("_e", F.col(y) - F.col(slope) * F.col("_tr")).withColumn("_le", F.col("_ly") - F.col(slope) * F.col("_ltr"))
        r = a.groupBy(*g).agg(_finite(F.corr("_e", "_le")).alias(name), F.max("_n").alias("_n"))
        return r.withColumn("_ss", _significant(F.col(name), n, alpha)).drop("_n")

    def whitened(r: str) -> Column:
        return F.when(F.col("_ltr").isNull(), F.col(y)).otherwise((F.col(y) - F.col(r) * F.col("_ly")) / (F.lit(1.0) - F.col(r)))

    def slope_of(x: DataFrame, r: str, name: str) -> DataFrame:
        return group_slope(x.withColumn("_x", whitened(r)).select(*g, t, "_x"), g, t, "_x", unit, name)

    d = cut(d)
    live = d.where("_use")
    base = live.select(*g, t, y, "_ly", "_tr", "_ltr", "_n", "_r1")
    b0 = group_slope(live, g, t, "pw_cor", unit, "_b0w")
    state = live.groupBy(*g).agg(F.max("_r1").alias("_cprev")).join(b0, g)
    state = state.join(autocorr(base.join(b0, g), "_b0w", "_ak"), g)
    start_ok = F.col("_ss") & (F.col("_ak") < 1.0 - MIN_DENOMINATOR)
    state = cut(state.withColumn("_kind", F.when(start_ok, "ws").when(F.col("_ss"), "ar").otherwise("detrend")).withColumn("_bd", F.col("_b0w")).withColumn("_akx", F.col("_ak")))
    b1 = slope_of(base.join(state.where("_kind = 'ws'").select(*g, "_ak"), g), "_ak", "_b1w")
    state = state.join(b1, g, "left").withColumn("_loops", F.lit(0))
    moving = (F.col("_kind") == "ws") & (F.abs(F.col("_ak") - F.col("_cprev")) > 1e-4) & (
        F.abs(F.col("_b1w") - F.col("_b0w")) > 1e-4 / 86400.0)
    state = cut(state.withColumn("_go", F.coalesce(moving, F.lit(False))))
    for _ in range(11):
        active = state.where("_go")
        if active.isEmpty():
            break
        nxt = autocorr(base.join(active.select(*g, "_b1w"), g), "_b1w", "_ak2").withColumnRenamed("_ss", "_ss2")
        step = active.join(nxt, g)
        good = F.coalesce((F.col("_ak2") > 0) & F.col("_ss2") & (F.col("_ak2") < 1.0 - MIN_DENOMINATOR), F.lit(False))
        step = cut(step.withColumn("_good", good))
        b2 = slope_of(base.join(step.where("_good").select(*g, "_ak2"), g), "_ak2", "_b2w")
        step = step.join(b2, g, "left").select(
            *g, F.col("_ak").alias("_cprev"), F.col("_b1w").alias("_b0w"), F.col("_ak2").alias("_ak"), F.col("_ss2").alias("_ss"),
            "_kind", "_bd", F.when(F.col("_good"), F.col("_ak2")).otherwise(F.col("_akx")).alias("_akx"),
            F.when(F.col("_good"), F.col("_b2w")).otherwise(F.col("_b1w")).alias("_b1w"), (F.col("_loops") + 1).alias("_loops"),
            F.col("_good").alias("_go0"))
        step = step.withColumn("_go", F.col("_go0") & F.coalesce(moving, F.lit(False))).drop("_go0")
        state = cut(state.where("not _go").unionByName(step))
    fin = state.select(*g, "_kind", "_bd", "_akx")
    e = F.col(y) - F.col("_bd") * F.col("_tr")
    le = F.col("_ly") - F.col("_bd") * F.col("_ltr")
    ws = F.when(F.col("_kind") == "ws", whitened("_akx")).when(F.col("_kind") == "ar", e - F.col("_akx") * le).otherwise(e)
    return d.join(fin, g, "left").withColumn("tfpw_ws", F.when(F.col("_use"), ws).otherwise(F.col(y)))


# --- whole estimator --------------------------------------------------------------------------------


def prepare(
    df: DataFrame, keys: Sequence[str], time: str, value: str, instrument: str | None = None, by_instrument: bool = False, by_season: bool = False
) -> tuple[DataFrame, float]:
    """Series in the estimator's form: keys, _inst, _strat, _t, _y."""
    t, unit = ticks(df, time)
    inst = F.coalesce(F.col(instrument).cast("string"), F.lit(MISSING)) if instrument else F.lit(MISSING)
    strat = stratum(inst if by_instrument else None, cal.season(time) if by_season else None)
    y = F.col(value).cast("double")  # NaN and infinite values are missing
    y = F.when(~F.isnan(y) & (F.abs(y) < float("inf")), y)
    return df.select(*keys, inst.alias("_inst"), strat.alias("_strat"), t.alias("_t"), y.alias("_y")), unit


def fit_parts(
    df: DataFrame, keys: Sequence[str], time: str, value: str, instrument: str | None = None, by_instrument: bool = True,
    by_season: bool = True, method: str = "3pw", resolution: float = 1e-6, alpha_mk: float = 95.0, alpha_ak: float = 95.0,
) -> tuple[DataFrame, DataFrame, str, float]:
    """Prewhitened series in long form, their tests, the variant that gives the slope, and the time unit."""
    if method not in ("pw", "tfpw_y", "tfpw_ws", "vctfpw", "3pw"):
        raise ValueError(f"unsupported method {method!r}")
    keys = list(keys)
    base, unit = prepare(df, keys, time, value, instrument, by_instrument, by_season)
    var = prewhitening_variants(base, keys, "_inst", "_t", "_y", unit, alpha_ak, method == "tfpw_ws")
    names = ["pw", "tfpw_y", "vctfpw"] if method == "3pw" else [method]
    # series-sized tables that several later jobs read: written once
    long = cut(var.select(*keys, "_strat", "_t", F.inline(F.array(*[
        F.struct(F.lit(n).alias("variant"), F.col(n).alias("_x")) for n in names]))))
    stats = cut(mk_test(mk_series(long, [*keys, "variant"], "_strat", "_t", "_x", resolution), alpha_mk))
    return long, stats, names[-1], unit


def mann_kendall(
    df: DataFrame, keys: Sequence[str], time: str = "date", value: str = "value", instrument: str | None = None,
    by_instrument: bool = True, by_season: bool = True, method: str = "3pw", resolution: float = 1e-6, alpha_mk: float = 95.0,
    alphas: Sequence[float] = (90.0,), alpha_ak: float = 95.0,
) -> DataFrame:
    """Trend of every series at once: p value, significance, slope per year and confidence bounds.

    ``df`` holds densified rows (empty bins as NULL values). Series with fewer
    than 10 values get NULLs and a reason.
    """
    keys = list(keys)
    long, stats, last, unit = fit_parts(df, keys, time, value, instrument, by_instrument, by_season, method, resolution, alpha_mk, alpha_ak)
    final = sen_slope(
        long.where(F.col("variant") == last), keys, "_strat", "_t", "_x", stats.where(F.col("variant") == last).drop("variant"),
        unit, alphas)
    if method == "3pw":
        final = final.drop("p", "ss").join(decide_3pw(stats, keys, alpha_mk), keys).withColumn("reason", F.coalesce("reason", "_why"))
    # a rejected fit has no results at all
    out = ["p", "ss", "slope", "ci"]
    return final.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in out}).select(*keys, "n", *out, "reason")


def decide_3pw(stats: DataFrame, keys: Sequence[str], alpha: float = 95.0) -> DataFrame:
    """Combine the pw and tfpw_y tests: larger p; flag alpha both, -1 only tfpw_y, -2 only pw, else 0.

    If one variant of the series is too short, p and flag are NULL and ``_why`` tells the reason.
    """
    lim = 1.0 - alpha / 100.0
    d = stats.groupBy(*keys).agg(
        F.max(F.when(F.col("variant") == "pw", F.col("p"))).alias("_p1"), F.max(F.when(F.col("variant") == "tfpw_y", F.col("p"))).alias("_p2"), F.min("reason").alias("_why"))
    a, b = F.col("_p1") <= lim, F.col("_p2") <= lim
    ss = F.when(a & b, int(alpha)).when(~a & b, -1).when(a & ~b, -2).otherwise(0)
    whole = F.col("_why").isNull()
    return d.withColumn("p", F.when(whole, F.greatest("_p1", "_p2"))).withColumn("ss", F.when(whole, ss)).drop("_p1", "_p2")


def trend_table(
    df: DataFrame, keys: Sequence[str], time: str = "date", value: str = "value", instrument: str | None = "instrument",
    sigma_levels: Sequence[float] = SIGMA_LEVELS, **options,
) -> DataFrame:
    """Site trends as one wide row per series: sample days, p, slope, 1-sigma half width and bounds."""
    keys = list(keys)
    fit = mann_kendall(df, keys, time, value, instrument, alphas=sigma_levels, **options)
    days = df.groupBy(*keys).agg(F.countDistinct(F.when(F.col(value).isNotNull(), F.to_date(time))).alias("n_days"))
    ends = {}
    for i in range(len(sigma_levels)):
        ends[f"lower_{i + 1}s"] = F.col("ci")[i]["lower"]
        ends[f"upper_{i + 1}s"] = F.col("ci")[i]["upper"]
    out = fit.withColumns(ends).withColumn("std", (F.col("upper_1s") - F.col("lower_1s")) / 2.0).drop("ci")
    return days.join(out, keys, "left")


def segment_array(date: str = "date") -> Column:
    return F.array(
        F.struct(F.lit("month").alias("kind"), F.month(date).cast("string").alias("segment")),
        F.struct(F.lit("season").alias("kind"), cal.season(date).alias("segment")))


def segment_trends(
    df: DataFrame, keys: Sequence[str], date: str = "date", value: str = "value", instrument: str | None = "instrument",
    min_days: int = 10, alphas: Sequence[float] = SIGMA_LEVELS, **options,
) -> DataFrame:
    """Trends of every month and season of every series in one job; segments need more than ``min_days`` days."""
    keys = list(keys)
    seg = [*keys, "kind", "segment"]
    d = df.select("*", F.inline(segment_array(date)))
    enough = d.groupBy(*seg).agg(F.countDistinct(F.when(F.col(value).isNotNull(), F.col(date))).alias("_n")).where(F.col("_n") > min_days).drop("_n")
    return mann_kendall(cut(d.join(enough, seg, "left_semi")), seg, date, value, instrument, by_season=False, alphas=alphas, **options)


def segment_grid(sites: DataFrame) -> DataFrame:
    """Every site with the 12 months and 4 seasons (a fixed list per row)."""
    segs = [("month", str(m)) for m in range(1, 13)] + [("season", s) for s in ("DJF", "MAM", "JJA", "SON")]
    return sites.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("segment")) for k, s in segs])))


def relative(
    trends: DataFrame, clim: DataFrame, keys: Sequence[str], signed: Sequence[str], unsigned: Sequence[str] = (), value: str = "value"
) -> DataFrame:
    """Trend, bounds (signed) and widths (by the absolute value) divided by the climatology of the same keys."""
    c = clim.select(*keys, F.col(value).alias("_clim"))
    cols = {f"{n}_rel": F.try_divide(F.col(n), F.col("_clim")) for n in signed}
    cols |= {f"{n}_rel": F.try_divide(F.col(n), F.abs("_clim")) for n in unsigned}
    return trends.join(c, list(keys), "left").withColumns(cols).drop("_clim")
