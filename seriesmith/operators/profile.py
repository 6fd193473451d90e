"""Profile operators: one row per profile, arrays over gates, evaluated inside the row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import same
from ..functions import arrays as ar

_d = F.lit


def _guard(flag: Column | None, want: bool, value: Column, message: str) -> Column:
    if flag is None:
        return value
    ok = flag if want else ~flag
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("array<double>"))


def range_correct(beta: Column, rng: Column, corrected: Column | None = None) -> Column:
    """beta x (range in km)^2; an already corrected profile is an error."""
    v = F.zip_with(beta, rng, lambda b, r: b * F.pow(r / 1000.0, _d(2.0)))
    return _guard(corrected, False, v, "profile is already range-corrected")


def range_uncorrect(beta: Column, rng: Column, max_range: float | None = None, corrected: Column | None = None) -> Column:
    """The inverse; above ``max_range`` the factor is one."""
    def f(b, r):
        sq = F.pow(r / 1000.0, _d(2.0))
        if max_range is not None:
            sq = F.when(r <= max_range, sq).otherwise(_d(1.0))
        return F.try_divide(b, sq)

    return _guard(corrected, True, F.zip_with(beta, rng, f), "profile is not range-corrected")


def noise_level(beta: Column, fraction: float = 0.1) -> Column:
    """Population standard deviation of the top gates of an uncorrected profile."""
    n = F.greatest(F.rint(F.size(beta) * fraction).cast("int"), _d(1))
    return F.sqrt(ar.var_pop(F.slice(beta, -n, n)))


def used_noise(noise: Column, noise_min: float = 1e-9, mode: str = "cap", force: bool = False) -> Column:
    """Noise for the ratio test: capped at (or, as an option, floored by) the minimum; NULL gives the minimum."""
    m = _d(noise_min)
    if force:
        return m
    if mode == "cap":
        return F.when(noise < m, noise).otherwise(m)
    return F.when(noise > m, noise).otherwise(m)


def first_negative_gate(beta: Column, min_run: int = 5, skip: int = 5, max_gates: int = 95) -> Column:
    """Index where the removal starts, NULL if it never does (a scalar state instead of a mask array)."""
    end = F.aggregate(
        F.transform(beta, lambda x, i: F.struct(i.alias("i"), F.coalesce((x < 0) & (i >= skip) & (i < skip + max_gates), F.lit(False)).alias("neg"))),
        F.struct(_d(0).alias("run"), _d(None).cast("int").alias("at")),
        lambda a, x: F.struct(
            F.when(x["neg"], a["run"] + 1).otherwise(_d(0)).alias("run"),
            F.coalesce(a["at"], F.when(x["neg"] & (a["run"] + 1 > min_run), x["i"])).alias("at"),
        ),
        lambda a: a["at"],
    )
    return end


def mask_negative_runs(beta: Column, start: Column, keep_above: float = 8e-6) -> Column:
    """NULL from the start gate up, except strong values."""
    return ar.let(ar.pack(s=start), lambda a: F.transform(beta, lambda x, i: F.when(a["s"].isNull() | (i < a["s"]) | (x > keep_above), x)))


def mask_fog_above_peak(beta: Column, fog: Column, threshold: float = 2e-6) -> Column:
    """In fog profiles NULL the weak gates above the strongest one."""
    weak = lambda x: F.coalesce(x < threshold, F.lit(False))
    return ar.let(
        ar.pack(b=beta, p=F.array_position(beta, F.array_max(beta)) - 1, f=F.coalesce(fog, F.lit(False))),
        lambda a: F.transform(a["b"], lambda x, i: F.when(~(a["f"] & (i > a["p"]) & weak(x)), x)))


def snr_screen(beta: Column, noise: Column, snr: float = 5.0) -> Column:
    return ar.let(noise, lambda n: F.transform(beta, lambda x: F.when(F.try_divide(x, n) >= snr, x)))


def filter_chain(
    df: DataFrame, beta: str = "beta_raw", screen: str = "beta_raw", rng: str = "range", negatives: bool = True, fog: bool = False,
    snr: bool = True, force_noise: bool = False, noise_min: float = 1e-9, keep_above: float = 8e-6, fog_threshold: float = 2e-6,
    snr_threshold: float = 5.0,
) -> DataFrame:
    """Noise, negative runs, fog and signal-to-noise screening on uncorrected data, corrected again at the end.

    When a smoothed variable is screened, its NULLs are applied to the raw
    profile and raw negatives go too.
    """
    r = F.col(rng)
    d = df.withColumn("_u", range_uncorrect(F.col(screen), r)).withColumn("background_noise", noise_level(range_uncorrect(F.col(beta), r)))
    start = F.lit(None).cast("int")
    flag = F.lit(None).cast("boolean")
    if negatives:
        d = d.withColumn("_start", first_negative_gate(F.col("_u")))
        start, flag = F.col("_start"), F.col("_start").isNotNull()
        d = d.withColumn("_u", mask_negative_runs(F.col("_u"), start, keep_above))
    if fog:
        d = d.withColumn("_u", mask_fog_above_peak(F.col("_u"), F.col("fog_flag"), fog_threshold))
    if snr:
        d = d.withColumn("_n", used_noise(F.col("background_noise"), noise_min, force=force_noise))
        d = d.withColumn("_u", snr_screen(F.col("_u"), F.col("_n"), snr_threshold))
    out = range_correct(F.col("_u"), r)
    if screen == beta:
        d = d.withColumn("beta", out)
    else:
        d = d.withColumn(screen, out).withColumn(
            "beta", F.zip_with(F.col(beta), F.col(screen), lambda b, s: F.when(s.isNotNull() & (b >= 0), b)))
    return d.withColumn("cleaned_negative_profile_flag", flag).drop("_u", "_n", "_start")


def fog_by_sum(beta: Column, gates: int = 20, limit: float = 1e-3) -> Column:
    return F.abs(ar.array_sum(F.slice(beta, 1, gates))) > limit


def fog_by_attenuation(beta: Column, rng: Column, at: float = 250.0, low: float = 3e-7, high: float = 1e-5) -> Column:
    z = F.transform(beta, lambda x: F.coalesce(x, _d(0.0)))
    near = F.get(z, ar.nearest_index(rng, _d(at)))
    return (F.array_max(F.slice(z, 1, 2)) > high) & (near < low)


def gate_spacing(height: Column) -> Column:
    return ar.array_median(ar.diffs(height))


def first_diff(beta: Column) -> Column:
    """next - current, 0 at the top and where either is missing."""
    return ar.let(beta, lambda b: F.transform(b, lambda x, i: F.coalesce(F.get(b, i + 1) - x, _d(0.0))))


def local_maxima(beta: Column, order: int = 4, amplitude: float = 2e-5) -> Column:
    """0-based gates strictly above all neighbours within +-order gates (clipped at the ends) and above the amplitude."""
    none = F.array().cast("array<int>")

    def peaks(z):
        n = F.size(z)
        left = lambda i: F.slice(z, F.greatest(i - order, _d(0)) + 1, F.least(i, _d(order)))
        right = lambda i: F.slice(z, i + 2, F.least(n - 1 - i, _d(order)))
        inner = F.when(n > 2, F.sequence(_d(1), n - 2)).otherwise(none)
        found = F.filter(
            inner, lambda i: (F.get(z, i) > amplitude) & (F.get(z, i) > F.array_max(left(i))) & (F.get(z, i) > F.array_max(right(i))))
        return F.when(n >= 2 * order + 1, found).otherwise(none)

    return ar.let(F.transform(beta, lambda x: F.coalesce(x, _d(0.0))), peaks)


def layer_bounds(beta: Column, diff: Column, peaks: Column, win_below: Column, win_above: Column, factor: float = 4.0) -> Column:
    """Base and top gate of the layer around each peak; peaks without both are left out."""
    def one(c, p):
        start, end = F.greatest(p - c["wb"], _d(0)), F.least(p + c["wa"], F.size(c["d"]))
        below = F.when(p > start, F.slice(c["d"], start + 1, p - start))
        above = F.when(end > p, F.slice(c["d"], p + 1, end - p))
        lo = ar.let(ar.pack(v=below, t=F.array_max(below) / factor, s=start), lambda w: F.array_min(
            F.transform(w["v"], lambda d, j: F.when(d > w["t"], j + w["s"]))))
        hi = ar.let(ar.pack(v=above, t=F.array_min(above) / factor), lambda w: F.array_max(
            F.transform(w["v"], lambda d, j: F.when(d < w["t"], j + p + 1))))
        return F.struct(p.alias("peak"), lo.alias("base"), hi.alias("top"))

    found = ar.let(ar.pack(d=diff, wb=win_below, wa=win_above), lambda c: F.transform(peaks, lambda p: one(c, p)))
    return F.filter(found, lambda s: s["base"].isNotNull() & s["top"].isNotNull())


def layer_qualifies(
    layer: Column, beta: Column, height: Column, min_points: int = 3, max_width: float = 300.0, min_gradient: float = 1e-7, min_alt: float = 100.0
) -> Column:
    """Enough non-zero gates, not too thick, a sharp top and a peak above the lowest heights."""
    top = F.least(layer["top"], F.size(beta) - 1)
    width = F.get(height, top) - F.get(height, layer["base"])
    pts = F.size(F.filter(F.slice(beta, layer["base"] + 1, layer["top"] - layer["base"] + 1), lambda x: F.coalesce(x, _d(0.0)) != 0))
    grad = F.try_divide(
        F.coalesce(F.get(beta, layer["peak"]), _d(0.0)) - F.coalesce(F.get(beta, top), _d(0.0)), F.get(height, top) - F.get(height, layer["peak"]))
    tall = F.get(height, layer["peak"]) - F.get(height, _d(0)) >= min_alt
    return (pts >= min_points) & (width < max_width) & (F.coalesce(grad, _d(0.0)) > min_gradient) & tall


def layer_contrast(layer: Column, beta: Column, height: Column, factor: float, distance: float) -> Column:
    """Peak against the nearest gates at a distance on both sides (floored at zero); a missing side fails."""
    hp = F.get(height, layer["peak"])
    lo = F.array_max(F.transform(height, lambda h, i: F.when(h <= hp - distance, i)))
    hi = F.array_min(F.transform(height, lambda h, i: F.when(h >= hp + distance, i)))
    val = lambda i: F.greatest(F.coalesce(F.get(beta, i), _d(0.0)), _d(0.0))
    ref = F.greatest(val(lo), val(hi))
    peak = F.get(beta, layer["peak"])
    return lo.isNotNull() & hi.isNotNull() & F.when(ref <= 0, peak > 0).otherwise(peak >= ref * factor)


def find_layers(
    df: DataFrame, beta: str = "beta", height: str = "height", amplitude: float = 2e-5, factor: float = 4.0, below_m: float = 200.0,
    above_m: float = 150.0, max_width: float = 300.0, min_gradient: float = 1e-7, min_alt: float = 100.0,
    contrast: tuple[float, float] | None = None,
) -> DataFrame:
    """Append ``layers``: array of (peak, base, top) of the qualified layers of each profile."""
    step = gate_spacing(F.col(height))
    z = F.transform(beta, lambda x: F.coalesce(x, _d(0.0)))

    def keep(c, s):
        ok = layer_qualifies(s, c["z"], c["h"], 3, max_width, min_gradient, min_alt)
        return ok & layer_contrast(s, c["z"], c["h"], *contrast) if contrast else ok

    def layers(c):
        win = lambda m: F.rint(_d(m) / c["st"]).cast("int")
        found = layer_bounds(c["z"], c["d"], local_maxima(c["z"], 4, amplitude), win(below_m), win(above_m), factor)
        return F.filter(found, lambda s: keep(c, s))

    return df.withColumn("layers", ar.let(ar.pack(z=z, d=first_diff(F.col(beta)), h=F.col(height), st=step), layers))


def layer_mask(layers: Column, beta: Column) -> Column:
    """True at every gate of any layer, its top included."""
    return ar.let(layers, lambda ly: F.transform(ar.indices(beta), lambda i: F.exists(ly, lambda s: (i >= s["base"]) & (i <= s["top"]))))


def cloud_product(df: DataFrame, mask: str = "mask", height: str = "height", altitude: str = "altitude", fog: str = "fog_flag", low_m: float = 2000.0) -> DataFrame:
    """Base height and the cloud, low-cloud and fog flags; fog with a low base is no fog, low is unknown in fog."""
    pos = F.array_position(mask, F.lit(True))
    asl = F.when(pos > 0, F.get(F.col(height), (pos - 1).cast("int")))
    d = df.withColumn("cloud_base_height_asl", asl).withColumn("cloud_base_height_agl", F.col("cloud_base_height_asl") - F.col(altitude))
    low = F.coalesce(F.col("cloud_base_height_agl") < low_m, F.lit(False))
    fogged = F.coalesce(F.col(fog), F.lit(False)) & ~low
    num = lambda c: c.cast("int").cast("double")
    return d.withColumns({
        "cloud_flag": num(pos > 0), "low_cloud_flag": F.when(~fogged, num(low)), "low_cloud_and_fog_flag": num(low | fogged), "fog_flag": num(fogged)})


# --- two-dimensional smoothing ----------------------------------------------------------------------------


def _reflected(at: np.ndarray, n: int) -> np.ndarray:
    """Places reflected about the edges (edge place repeated), for any distance."""
    m = np.mod(at, 2 * n)
    return np.where(m < n, m, 2 * n - 1 - m)


def _kernel(sigma: float) -> list[tuple[int, float]]:
    """Offsets within four sigma and their weights, which add up to 1; no width leaves values as they are."""
    radius = int(4.0 * sigma + 0.5)
    taps = [(k, float(np.exp(-(k * k) / (2.0 * sigma * sigma))) if k else 1.0) for k in range(-radius, radius + 1)]
    total = sum(w for _, w in taps)
    return [(k, w / total) for k, w in taps]


def smooth_gates(x: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Gaussian along the gates of a block of profiles (rows), each with its own width in gates; NaN if a gate in reach is NaN.

    The kernel is a band of weights over shifted copies of the block: one array product per offset, for all profiles of a width.
    """
    out = np.full(x.shape, np.nan)
    gates = np.arange(x.shape[1])
    for s in np.unique(sigma[~np.isnan(sigma)]):
        rows = sigma == s
        part = x[rows]
        out[rows] = sum(w * part[:, _reflected(gates + k, len(gates))] for k, w in _kernel(s))
    return out


def median_step(df: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    """Median time step of each file in seconds."""
    w = W.partitionBy(*keys).orderBy(time)
    step = (F.unix_micros(F.lead(time).over(w)) - F.unix_micros(time)) / 1e6
    return df.select(*keys, step.alias("_s")).groupBy(*keys).agg(F.percentile("_s", 0.5).alias("step_s"))


SMOOTH_BLOCK = 512


def _smooth_block(keys: list[str]):
    """Both directions of the kernel for one stretch of profiles with its halo."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, blk = int(pdf["_n"].iloc[0]), int(pdf["_blk"].iloc[0])
        pdf = pdf.sort_values("_row")
        have = pdf["_row"].to_numpy()
        x = smooth_gates(np.vstack(pdf["_h"].to_numpy()).astype(float), pdf["_sr"].to_numpy(float))
        to = np.arange(blk * SMOOTH_BLOCK, min(n, (blk + 1) * SMOOTH_BLOCK))
        sm = sum(w * x[np.searchsorted(have, _reflected(to + k, n))] for k, w in _kernel(float(pdf["_st"].iloc[0])))
        out = {c: [pdf[c].iloc[0]] * to.size for c in keys}
        return pd.DataFrame({**out, "_row": to, "_sm": list(sm)})

    return run


def gaussian_smooth(
    df: DataFrame, keys: Sequence[str], sigma_s: float = 60.0, sigma_m: float = 10.0, strong: float = 1e-6, beta: str = "beta_raw",
    rng: str = "range", time: str = "time",
) -> DataFrame:
    """Append ``beta_smooth``: separable Gaussian over time and height of the uncorrected profile.

    Strong values are clamped before and restored after. The time direction
    runs on stretches of 512 profiles with a halo of the kernel's reach, so a
    task never holds more than that, however many profiles a file has.
    """
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy(time)
    step = (F.unix_micros(F.lead(time).over(w)) - F.unix_micros(time)) / 1e6
    steps = df.select(*keys, step.alias("_s")).groupBy(*keys).agg(F.percentile("_s", 0.5).alias("_dt"), F.count(F.lit(1)).cast("int").alias("_n"))
    d = df.withColumn("_u", range_uncorrect(F.col(beta), F.col(rng))).withColumn("_row", F.row_number().over(w) - 1)
    d = d.alias("a").join(steps.alias("b"), same("a", "b", keys)).select("a.*", "_dt", "_n")
    clamp = F.transform("_u", lambda x: F.when(x > strong, _d(strong)).otherwise(x))
    sr = _d(sigma_m) / ar.array_median(ar.diffs(F.col(rng)))
    # a file of one profile, or of equal times, has no time step: it is not smoothed in time
    st = F.when(F.col("_dt") > 0, _d(sigma_s) / F.col("_dt")).otherwise(_d(0.0))
    radius = F.floor(st * 4.0 + 0.5)
    first = F.greatest(_d(0), F.floor((F.col("_row") - radius) / SMOOTH_BLOCK))
    last = F.least(F.floor((F.col("_n") - 1) / SMOOTH_BLOCK), F.floor((F.col("_row") + radius) / SMOOTH_BLOCK))
    sent = d.select(*keys, "_row", "_n", st.alias("_st"), sr.alias("_sr"), clamp.alias("_h"), F.explode(F.sequence(first, last)).alias("_blk"))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_row", T.IntegerType()), T.StructField("_sm", T.ArrayType(T.DoubleType()))])
    back = sent.groupBy(*keys, "_blk").applyInPandas(_smooth_block(keys), schema)
    out = d.alias("a").join(back.alias("b"), same("a", "b", [*keys, "_row"])).select("a.*", "_sm")
    restored = F.zip_with("_sm", "_u", lambda s, u: F.when(u > strong, u).otherwise(F.when(~F.isnan(s), s)))
    return out.withColumn("beta_smooth", range_correct(restored, F.col(rng))).drop("_u", "_row", "_dt", "_n", "_sm")


# --- lidar-ratio candidates -----------------------------------------------------------------------------


def candidate_peak(beta: Column, rng: Column, lo: float = 1000.0, hi: float = 2000.0, amplitude: float = 1e-4) -> Column:
    """Strongest gate (value, range) in the height window above the amplitude, NULL if none; the lowest on a tie."""
    pts = F.filter(
        F.zip_with(beta, rng, lambda b, r: F.struct(b.alias("beta"), (-r).alias("neg"))),
        lambda s: (s["beta"] >= amplitude) & (-s["neg"] >= lo) & (-s["neg"] <= hi))
    return ar.let(F.array_max(pts), lambda p: F.when(p.isNotNull(), F.struct(p["beta"].alias("beta"), (-p["neg"]).alias("range"))))


def contrast_nearest(peak: Column, beta: Column, rng: Column, distance: float = 300.0, factor: float = 20.0) -> Column:
    def ok(c, t):
        return F.coalesce(c["p"]["beta"] >= F.get(c["b"], ar.nearest_index(c["r"], t, "larger")) * factor, F.lit(False))

    return ar.let(ar.pack(p=peak, b=beta, r=rng), lambda c: ok(c, c["p"]["range"] + distance) & ok(c, c["p"]["range"] - distance))


def oversaturated(beta: Column, rng: Column, depth: float = 100.0) -> Column:
    """A run of negative gates as deep as ``depth`` metres."""
    k = F.ceil(_d(depth) / ar.array_median(ar.diffs(rng)))
    return ar.longest_true_run(F.transform(beta, lambda x: F.coalesce(x < 0, F.lit(False)))) >= k


def integral_ratio(
    peak: Column, beta: Column, rng: Column, distance: float = 300.0, upper: float = 2400.0, max_aerosol: float = 0.05
) -> Column:
    """1 / (2 x integral up to just above the peak), NULL if aerosol below holds too much of it."""
    def ratio(c):
        part = lambda lim: F.zip_with(c["b"], c["r"], lambda b, r: F.when((r <= c["top"]) & lim(r), b))
        total = ar.nan_trapz(part(lambda r: F.lit(True)), c["r"])
        aerosol = ar.nan_trapz(part(lambda r: r < c["low"]), c["r"])
        return ar.let(ar.pack(t=total, a=aerosol), lambda v: F.when(
            F.try_divide(v["a"], v["t"]) < max_aerosol, F.try_divide(_d(1.0), v["t"] * 2.0)))

    return ar.let(peak, lambda p: ar.let(
        ar.pack(b=beta, r=rng, top=F.least(p["range"] + distance, _d(upper)), low=p["range"] - distance), ratio))


def consistent(df: DataFrame, keys: Sequence[str], time: str, ratio: str, threshold: float = 0.05, min_neighbors: int = 3) -> DataFrame:
    """NULL ratios that differ from the median of rows -3..+2 by more than 5 % or have too few neighbours.

    The window runs inside one instrument day, so its size is bounded.
    """
    w = W.partitionBy(*keys).orderBy(time)
    nb = F.concat(F.collect_list(ratio).over(w.rowsBetween(-3, -1)), F.collect_list(ratio).over(w.rowsBetween(1, 2)))
    d = df.withColumn("_nb", nb)
    med = ar.array_median(F.col("_nb"))
    ok = (F.size("_nb") >= min_neighbors) & (F.abs(F.col(ratio) - med) <= med * threshold)
    return d.withColumn(ratio, F.when(F.coalesce(ok, F.lit(False)), F.col(ratio))).drop("_nb")


def daily_lidar_ratio(
    df: DataFrame, keys: Sequence[str], zenith: Column | None = None, beta: str = "beta_raw", rng: str = "range", time: str = "time",
    lo: float = 1000.0, hi: float = 2000.0, amplitude: float = 1e-4, distance: float = 300.0, factor: float = 20.0, depth: float = 100.0,
    upper: float = 2400.0, max_aerosol: float = 0.05, threshold: float = 0.05, min_neighbors: int = 3, min_samples: int = 30,
    night_zenith: float = 96.0, count: str = "profiles",
) -> DataFrame:
    """Daily candidate lidar ratio and peak range per key (site, instrument, day)."""
    keys = list(keys)
    b, r = F.col(beta), F.col(rng)
    if zenith is not None:
        b = F.when(F.coalesce(zenith > night_zenith, F.lit(False)), b)
    d = df.select(*keys, time, b.alias("_b"), r.alias("_r"))
    d = d.withColumn("_pk", candidate_peak(F.col("_b"), F.col("_r"), lo, hi, amplitude))
    ok = F.col("_pk").isNotNull() & contrast_nearest(F.col("_pk"), F.col("_b"), F.col("_r"), distance, factor) & ~oversaturated(F.col("_b"), F.col("_r"), depth)
    d = d.withColumn("_ratio", F.when(ok, integral_ratio(F.col("_pk"), F.col("_b"), F.col("_r"), distance, upper, max_aerosol)))
    d = consistent(d.select(*keys, time, "_ratio", F.col("_pk.range").alias("_pr")), keys, time, "_ratio", threshold, min_neighbors)
    n = F.count(F.lit(1)) if count == "profiles" else F.count("_ratio")
    return d.groupBy(*keys).agg(
        F.when(n >= min_samples, F.percentile("_ratio", 0.5)).alias("lidar_ratio"),
        F.when(n >= min_samples, F.percentile(F.when(F.col("_ratio").isNotNull(), F.col("_pr")), 0.5)).alias("peak_range"), F.count("_ratio").alias("n_valid"))
