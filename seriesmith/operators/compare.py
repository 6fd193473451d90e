"""Comparison of datasets, uncertainty of means, densities and lines with errors in both axes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import cut, same
from ..functions import scalar as fn
from .joins import dataset_pairs


def availability_matrix(df: DataFrame, keys: Sequence[str], year: int, date: str = "date") -> DataFrame:
    """Percent of days with data per month of a year, one column per month."""
    d = df.where(F.year(date) == year).groupBy(*keys, F.trunc(date, "month").alias("_m")).agg(F.countDistinct(date).alias("_n"))
    pct = F.round(F.least(F.lit(100.0), F.col("_n") * 100.0 / F.dayofmonth(F.last_day("_m"))), 4)
    p = d.withColumn("_i", F.month("_m")).withColumn("_p", pct)
    return p.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("_i") == i, F.col("_p"))), F.lit(0.0)).alias(f"m{i:02d}") for i in range(1, 13)])


def site_means(df: DataFrame, dataset: str, cls: str, value: str) -> DataFrame:
    """Mean over sites per dataset, overall and per class, by grouping sets."""
    c, d = F.col(cls), F.col(dataset)
    g = df.groupingSets([[d], [d, c]], d, c).agg(F.avg(value).alias("value"))
    return g.withColumn(cls, F.coalesce(c, F.lit("all")))


def bias_matrix(df: DataFrame, keys: Sequence[str], dataset: str, value: str) -> DataFrame:
    """Mean difference of every dataset pair over their common keys."""
    p = dataset_pairs(df, keys, dataset, value)
    return p.groupBy("x_set", "y_set").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(f"x_{value}") - F.col(f"y_{value}")).alias("bias"))


def flux_difference(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.avg(a) - F.avg(b)).alias("value")).where("value > 0")


def significance_counts(df: DataFrame, keys: Sequence[str], slope: str = "slope") -> DataFrame:
    """Sites per dataset by sign and by whether the 1- and 2-sigma intervals exclude zero."""
    s = F.col(slope)
    sig = lambda i: un_significant(s, F.col(f"lower_{i}s"), F.col(f"upper_{i}s"))
    return df.groupBy(*keys).agg(
        F.count(s).alias("n"), F.avg(s).alias("mean"), F.count_if(s > 0).alias("positive"), F.count_if(s < 0).alias("negative"),
        F.count_if(sig(1)).alias("significant_68"), F.count_if(sig(2)).alias("significant_95"))


def un_significant(trend: Column, lower: Column, upper: Column) -> Column:
    """The interval excludes zero on the side of the trend's sign."""
    return F.when(trend > 0, lower > 0).when(trend < 0, upper < 0).otherwise(F.lit(False))


def season_diagnostics(df: DataFrame, dataset: str = "dataset", season: str = "season", value: str = "slope", widths: Sequence[str] = ()) -> DataFrame:
    """n, mean, population std and mean interval widths per (dataset, season) and per season over all datasets."""
    d, s = F.col(dataset), F.col(season)
    g = df.groupingSets([[d, s], [s]], d, s).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), *[F.avg(w).alias(f"mean_{w}") for w in widths])
    return g.withColumn(dataset, F.coalesce(d, F.lit("all")))


def pair_stats(pairs: DataFrame, keys: Sequence[str], x: str, y: str, sx: str, sy: str, floor: float | None = None) -> DataFrame:
    """Agreement of two datasets in one grouped pass: errors, correlation, chi-square, bias, concordance."""
    s2 = lambda c: F.pow(F.greatest(F.col(c), F.lit(floor)) if floor is not None else F.col(c), F.lit(2.0))
    res = F.col(y) - F.col(x)
    g = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(res * res)).alias("rmse"), F.corr(x, y).alias("r"),
        F.sum(F.try_divide(res * res, s2(sx) + s2(sy))).alias("chi2"), F.avg(res).alias("bias"), F.stddev_pop(res).alias("_sd"),
        F.sum(s2(sx) + s2(sy)).alias("_s2"), F.covar_samp(x, y).alias("_cov"), F.var_samp(x).alias("_vx"), F.var_samp(y).alias("_vy"),
        (F.avg(x) - F.avg(y)).alias("_dm"))
    n = F.col("n").cast("double")
    return g.withColumns({
        "r2": F.col("r") * F.col("r"), "chi2_reduced": F.try_divide(F.col("chi2"), n - 2),
        "bias_error": F.sqrt("_s2") / n if floor is not None else F.col("_sd") / F.sqrt(n),
        "concordance": F.try_divide(F.col("_cov") * 2.0, F.col("_vx") + F.col("_vy") + F.col("_dm") * F.col("_dm")),
    }).drop("_sd", "_s2", "_cov", "_vx", "_vy", "_dm")


def quantile_arrays(df: DataFrame, keys: Sequence[str], p: str, q: str, n_points: int) -> DataFrame:
    """Quantile functions resampled to an even probability grid, one array per key (size fixed by ``n_points``)."""
    t = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(p).alias("p"), F.col(q).alias("q")))).alias("_t"))
    t = t.withColumn("_p", F.transform("_t", lambda s: s["p"])).withColumn("_q", F.transform("_t", lambda s: s["q"]))
    grid = F.transform(F.sequence(F.lit(0), F.lit(n_points - 1)), lambda i: i / F.lit(float(n_points - 1)))
    return t.select(*keys, F.transform(grid, lambda g: fn.interp(g, F.col("_p"), F.col("_q"))).alias("quantiles"))


# Quantile levels of the reported intervals, proper and as published.
INTERVALS = {"proper": (0.16, 0.84, 0.025, 0.975), "published": (0.16, 0.68, 0.05, 0.95)}


#: Draws that a task makes at a time, for up to so many sites.
DRAW_CHUNK = 1 << 16
SITE_BLOCK = 1024


def mean_distribution(
    q: DataFrame, keys: Sequence[str], dataset: Sequence[str], n_draws: int, seed: int = 0, quantiles: str = "quantiles", stratified: bool = False,
    intervals: str = "proper",
) -> DataFrame:
    """Distribution of the mean over sites by Monte Carlo: mean, std and exact interval ends over ``n_draws`` draws.

    ``q`` has one quantile array (even levels) per site, its ``keys`` including ``dataset``. A task takes the arrays of up to
    SITE_BLOCK sites and a chunk of draws, inverts all sites at once and sends only their sums: a number per draw and
    block of sites, never one per site. The numbers hang on the site, the chunk and the seed alone, not on partitions.
    ``stratified`` takes the evenly spaced levels instead of random ones. Sites without an array don't count.
    """
    keys, dataset = list(keys), list(dataset)
    kinds = T.StructType([q.schema[k] for k in dataset])
    own = q.where(F.col(quantiles).isNotNull() & (F.size(quantiles) > 1)).select(
        *dataset, F.xxhash64(F.lit(seed), *[F.col(k).cast("string") for k in keys]).alias("_h"), F.col(quantiles).alias("_q"))
    own = own.withColumn("_s", F.pmod(F.xxhash64("_h"), F.lit(1 << 30)))
    blocks = own.groupBy(*dataset).agg(F.ceil(F.count(F.lit(1)) / SITE_BLOCK).alias("_nb"))
    of = lambda a, names: [F.col(f"{a}.{k}") for k in names]
    own = own.alias("a").join(blocks.alias("b"), same("a", "b", dataset)).select(*of("a", dataset), "_h", "_q", F.pmod("_s", F.col("_nb")).alias("_block"))
    packed = own.groupBy(*dataset, "_block").agg(F.sort_array(F.collect_list(F.struct("_h", "_q"))).alias("_sites"))
    chunks = packed.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit((n_draws - 1) // DRAW_CHUNK)))).repartition(*dataset, "_block", "_c")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for c, sites in zip(batch.column("_c").to_pylist(), batch.column("_sites").to_pylist(), strict=True):
                at = np.arange(c * DRAW_CHUNK, min((c + 1) * DRAW_CHUNK, n_draws))
                total = np.zeros(len(at))
                for s in sites:
                    fp = np.array(s["_q"], np.float64)
                    u = (at + 0.5) / n_draws if stratified else np.random.Generator(np.random.Philox(key=np.array([s["_h"] % (1 << 64), c], np.uint64))).random(len(at))
                    i = np.minimum((u * (len(fp) - 1)).astype(np.int64), len(fp) - 2)
                    total += fp[i] + (fp[i + 1] - fp[i]) * (u * (len(fp) - 1) - i)
                sums.append(total.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in dataset], batch.column("_c"), pa.array([len(s) for s in batch.column("_sites").to_pylist()], pa.int64()), pa.array(sums, pa.binary())],
                names=[*dataset, "c", "n", "sums"])

    parts = chunks.select(*dataset, "_c", "_sites").mapInArrow(draw, T.StructType([
        *kinds, T.StructField("c", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.BinaryType())]))

    def fold(t: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(b) for b in t.column("sums").to_pylist()[1:]), np.frombuffer(t.column("sums")[0].as_py()))
        row = t.slice(0, 1)
        return pa.table({**{k: row.column(k) for k in (*dataset, "c")}, "n": [sum(t.column("n").to_pylist())], "sums": pa.array([total.tobytes()], pa.binary())})

    parts = parts.groupBy(*dataset, "c").applyInArrow(fold, parts.schema)  # the blocks of sites of one chunk
    levels, names = INTERVALS[intervals], ("q68_low", "q68_high", "q95_low", "q95_high")

    def summary(t: pa.Table) -> pa.Table:
        # one number per draw, whatever the number of sites
        total, sites = np.zeros(n_draws), 0
        for c, n, sums in zip(t.column("c").to_pylist(), t.column("n").to_pylist(), t.column("sums").to_pylist(), strict=True):
            total[c * DRAW_CHUNK : (c + 1) * DRAW_CHUNK] += np.frombuffer(sums)
            sites += n if c == 0 else 0
        m = total / sites
        row = {"mean": m.mean(), "std": m.std(ddof=1) if n_draws > 1 else None, "n_sites": sites, "n_draws": n_draws, **dict(zip(names, np.quantile(m, levels).tolist(), strict=True))}
        own_key = t.select(dataset).take(np.zeros(1, np.int64))
        return pa.table({**{k: own_key.column(k) for k in dataset}, **{k: [v] for k, v in row.items()}})

    out = T.StructType([*kinds, *[T.StructField(n, T.LongType() if n.startswith("n_") else T.DoubleType()) for n in ("mean", "std", "n_sites", "n_draws", *names)]])
    return parts.groupBy(*dataset).applyInArrow(summary, out)


def kernel_density(df: DataFrame, keys: Sequence[str], value: str, points: int = 512) -> DataFrame:
    """Gaussian density (Scott bandwidth) on an even grid over the data's range.

    Equal samples are merged into weights; a task sums the kernels of its samples on the grid and sends one row of
    sums per key and batch.
    """
    keys = list(keys)
    st = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd"))
    st = st.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).where("_h > 0")
    w = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
    part = w.join(st.drop("_sd"), keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, own in pdf.groupby(keys, sort=False, dropna=False):
                lo, hi, h = (float(own[c].iloc[0]) for c in ("_lo", "_hi", "_h"))
                grid = lo + (hi - lo) * np.arange(points) / (points - 1)
                total = np.zeros(points)
                for i in range(0, len(own), 1024):
                    v, wt = own["_v"].to_numpy()[i : i + 1024], own["_w"].to_numpy()[i : i + 1024]
                    total += wt @ np.exp(-0.5 * ((grid[None, :] - v[:, None]) / h) ** 2)
                yield pd.DataFrame({**{k: [own[k].iloc[0]] * points for k in keys}, "_g": np.arange(points), "x": grid,
                                    "_s": total / (float(own["_n"].iloc[0]) * h * 2.5066282746310002)})

    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_g", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("_s", T.DoubleType())])
    return part.mapInPandas(run, schema).groupBy(*keys, "_g").agg(F.max("x").alias("x"), F.sum("_s").alias("density")).drop("_g")


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 200) -> DataFrame:
    """Density histogram with equal bins between the extremes (the top edge belongs to the last bin)."""
    keys = list(keys)
    st = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n")).where("_hi > _lo")
    b = F.least(F.lit(bins), F.width_bucket(value, F.col("_lo"), F.col("_hi"), F.lit(bins)))
    c = df.where(F.col(value).isNotNull()).join(st, keys).groupBy(*keys, b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.max("_n").alias("_n"), ((F.max("_hi") - F.max("_lo")) / bins).alias("_w"))
    return c.select(*keys, "bin", "count", (F.col("count") / (F.col("_n") * F.col("_w"))).alias("density"))


def xy_error_line(
    pairs: DataFrame, keys: Sequence[str], x: str, y: str, sx: str, sy: str, floor: float | None = None, max_rounds: int = 50, tol: float = 1e-11
) -> DataFrame:
    """Straight line with errors in both axes: slope, intercept and their deviations per pair of datasets.

    York's fixed point, from the OLS slope. A round is one grouped aggregate
    of weighted sums of the centred points, so any number of points fits; the
    state is one row per key. ``converged`` tells whether the slope came to rest within ``max_rounds``; without it the
    results are NULL.
    """
    keys = list(keys)
    f = lambda c: F.greatest(F.col(c), F.lit(floor)) if floor is not None else F.col(c)
    d = pairs.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.pow(f(sx), F.lit(2.0)).alias("_vx"), F.pow(f(sy), F.lit(2.0)).alias("_vy"))
    d = d.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    mean = d.groupBy(*keys).agg(
        F.avg("_x").alias("_cx"), F.avg("_y").alias("_cy"), F.regr_slope("_y", "_x").alias("b"), F.count(F.lit(1)).alias("n"))
    mean = cut(mean.where("n >= 2 and b is not null"))
    d = cut(d.join(mean.select(*keys, "_cx", "_cy"), keys).select(
        *keys, (F.col("_x") - F.col("_cx")).alias("_x"), (F.col("_y") - F.col("_cy")).alias("_y"), "_vx", "_vy"))
    xc, yc = F.col("_x"), F.col("_y")
    w = F.lit(1.0) / (F.col("_vy") + F.col("b") * F.col("b") * F.col("_vx"))

    def sums(name: str, c: Column) -> list[Column]:
        terms = {"": F.lit(1.0), "x": xc, "y": yc, "xx": xc * xc, "xy": xc * yc, "yy": yc * yc}
        return [F.sum(c * v).alias(f"_{name}{k}") for k, v in terms.items()]

    def moment(p: str, u: str, v: str) -> Column:
        """Sum of p (u - mu)(v - mv) from the plain sums."""
        c = lambda k: F.col(f"_{p}{k}")
        m = {"x": F.col("_mx"), "y": F.col("_my")}
        return c("".join(sorted(u + v))) - m[u] * c(v) - m[v] * c(u) + m[u] * m[v] * c("")

    state = mean.select(*keys, "b", F.col("b").alias("_prev"))
    for i in range(max_rounds):
        r = d.join(state, keys)
        g = r.groupBy(*keys).agg(*sums("w", w)[:3], *sums("a", w * w * F.col("_vy")), *sums("c", w * w * F.col("b") * F.col("_vx")), F.max("b").alias("_b"), F.max("_prev").alias("_prev"))
        g = g.withColumn("_mx", F.col("_wx") / F.col("_w")).withColumn("_my", F.col("_wy") / F.col("_w"))
        nxt = (moment("a", "x", "y") + moment("c", "y", "y")) / (moment("a", "x", "x") + moment("c", "x", "y"))
        g = g.withColumn("_n", nxt)
        new, bend = F.col("_n"), F.col("_n") - F.col("_b") * 2 + F.col("_prev")
        if i % 3 == 2:  # extrapolate from three iterates; the plain step converges slowly on scattered points
            new = F.coalesce(new - F.try_divide(F.pow(new - F.col("_b"), F.lit(2.0)), bend), new)
        state = cut(g.select(*keys, new.alias("b"), F.col("_b").alias("_prev"), F.abs(F.col("_n") - F.col("_b")).alias("_step"), "_mx", "_my", F.col("_w").alias("_sw")))
        if (state.agg(F.max(F.col("_step") / F.greatest(F.abs("b"), F.lit(1e-300)))).first()[0] or 0.0) < tol:
            break
    r = d.join(state, keys)
    adj = F.col("_mx") + w * (F.col("_vy") * (xc - F.col("_mx")) + F.col("b") * F.col("_vx") * (yc - F.col("_my")))
    res = yc - F.col("_my") - F.col("b") * (xc - F.col("_mx"))
    s = r.withColumn("_a", adj).withColumn("_w", w).groupBy(*keys).agg(
        (F.sum(F.col("_w") * F.col("_a")) / F.sum("_w")).alias("_am"), F.sum(F.col("_w") * F.col("_a") * F.col("_a")).alias("_aa"),
        F.sum("_w").alias("_sw2"), F.sum(F.col("_w") * res * res).alias("_res"))
    out = mean.drop("b").join(state.drop("_prev"), keys).join(s, keys)
    rest = F.coalesce(F.col("_step") < 1e3 * tol * F.greatest(F.abs("b"), F.lit(1e-300)), F.lit(False))
    scale = F.try_divide(F.col("_res"), F.when(F.col("n") > 2, F.col("n") - 2))
    sxx = F.col("_aa") - F.col("_sw2") * F.col("_am") * F.col("_am")
    fit = {
        "slope": F.col("b"), "intercept": F.col("_my") + F.col("_cy") - F.col("b") * (F.col("_mx") + F.col("_cx")),
        "slope_sd": F.sqrt(F.try_divide(scale, sxx)),
        "intercept_sd": F.sqrt(scale * (F.lit(1.0) / F.col("_sw2") + F.pow(F.col("_am") + F.col("_cx"), F.lit(2.0)) / sxx)),
        "residual_variance": scale}
    return out.select(*keys, "n", *[F.when(rest, c).alias(k) for k, c in fit.items()], rest.alias("converged"))


def drift_effect(df: DataFrame, keys: Sequence[str], drift: str = "drift", trend: str = "trend", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Trend minus the zero-drift trend (x1000), the 1-sigma width and their ratio, per drift level."""
    keys = list(keys)
    base = df.where(F.col(drift) == 0).select(*keys, F.col(trend).alias("_b"))
    d = df.where(F.col(drift) != 0).join(base, keys)
    return d.select(*keys, drift, ((F.col(trend) - F.col("_b")) * 1000.0).alias("effect"), ((F.col(upper) - F.col(lower)) * 1000.0).alias("width"))


def inset(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    return df.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))
