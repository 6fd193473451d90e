"""Weighted logistic response regression for many series and bootstrap replicates at once.

Every reweighting round factors blocks of rows where they lie; only the small
triangular factors of a series meet, so a hot series is no hot task. Bootstrap replicates are refitted in chunks from a
series' daily rows, as row multiplicities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import cut, same
from ..functions.arrays import let
from ..functions.scalar import clip, fourier_basis

CLIP = (0.01, 0.99)


def linear_trend(df: DataFrame, keys: Sequence[str], time: str = "time", temperature: str = "temperature") -> DataFrame:
    """Append the linear trend part of the temperature and the anomaly from it."""
    c = df.groupBy(*keys).agg(F.regr_slope(temperature, time).alias("_s"), F.regr_intercept(temperature, time).alias("_i"))
    d = df.join(c, list(keys)).withColumn("t_trend", F.col("_s") * F.col(time) + F.col("_i"))
    return d.withColumn("t_anom", F.col(temperature) - F.col("t_trend")).drop("_s", "_i")


def design(terms: int, interactions: bool = False, doy: str = "doy") -> Column:
    """[1, trend, anomaly, seasonal basis(, trend x basis, anomaly x basis)] as one array."""
    def build(b):
        base = F.concat(F.array(F.lit(1.0), F.col("t_trend"), F.col("t_anom")), b)
        if not interactions:
            return base
        return F.concat(base, F.transform(b, lambda x: x * F.col("t_trend")), F.transform(b, lambda x: x * F.col("t_anom")))

    return let(fourier_basis(doy, terms), build)


def n_columns(terms: int, interactions: bool = False) -> int:
    return 3 + terms * (3 if interactions else 1)


def _dot(x: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(x, b, lambda u, v: u * v), F.lit(0.0), lambda a, v: a + v)


#: Rows of a series that are factored at a time.
BLOCK_ROWS = 4096
#: Largest condition number of a triangular factor (its square is that of the normal equations).
MAX_CONDITION = 1e12


def _packed(d: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Rows of each series as matrices of design, y, n and multiplicity; packed where they lie, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            rest = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_n", "_m")]
            full = np.column_stack([x, *rest])
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[order])) + 1
            parts = [q for part in np.split(order, cuts) for q in np.split(part, range(BLOCK_ROWS, len(part), BLOCK_ROWS))]
            own = batch.select(keys).take(pa.array([q[0] for q in parts]))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([full[q].tobytes() for q in parts], pa.binary())], names=[*keys, "_data"])

    return cut(d.mapInArrow(run, T.StructType([*[d.schema[k] for k in keys], T.StructField("_data", T.BinaryType())])))


def _factor(a: np.ndarray) -> np.ndarray:
    """Triangular factor of a tall matrix, or the matrix itself where it is not tall."""
    return np.linalg.qr(a, mode="r") if len(a) > a.shape[1] else a


def _round(blocks: DataFrame, keys: list[str], p: int) -> DataFrame:
    """One reweighting round: each task factors its blocks, the factors of a series are stacked, factored again and solved."""
    fields = [blocks.schema[k] for k in keys]
    first = "_c" not in blocks.columns

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the blocks of one series in a batch leave one factor
            code = batch.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if batch.num_rows else np.zeros(0, int)
            some = int(code.max(initial=-1)) + 1
            rows, chis, factors = np.zeros(some), np.zeros(some), [np.zeros((0, p + 1)) for _ in range(some)]
            coefs = [None] * batch.num_rows if first else batch.column("_c").to_pylist()
            for k, data, c in zip(code, batch.column("_data").to_pylist(), coefs, strict=True):
                m = np.frombuffer(data).reshape(-1, p + 3)
                x, y, n, w = m[:, :p], m[:, p], m[:, p + 1], m[:, p + 2]
                if c is None:
                    mu = (y + 0.5) / 2.0
                    eta = np.log(mu / (1.0 - mu))
                else:
                    eta = x @ np.array(c)
                    mu = 1.0 / (1.0 + np.exp(-eta))
                v = mu * (1.0 - mu)
                with np.errstate(all="ignore"):
                    part = np.sqrt(w * n * v)[:, None] * np.column_stack([x, eta + (y - mu) / v])
                    chis[k] += (w * n * (y - mu) ** 2 / v).sum()
                rows[k] += w.sum()
                if factors[k] is not None:
                    factors[k] = _factor(np.vstack([factors[k], part])) if np.isfinite(part).all() else None
            own = batch.select(keys).take(pa.array(np.unique(code, return_index=True)[1]))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(rows), pa.array(chis), pa.array([b"" if f is None else f.tobytes() for f in factors], pa.binary())],
                                             names=[*keys, "rows", "_chi", "_r"])

    def solve(t: pa.Table) -> pa.Table:
        rows, chi = sum(t.column("rows").to_pylist()), sum(t.column("_chi").to_pylist())
        parts = t.column("_r").to_pylist()
        coef = var = None
        if rows >= p and all(parts):
            r = np.zeros((0, p + 1))
            for b in parts:
                r = _factor(np.vstack([r, np.frombuffer(b).reshape(-1, p + 1)]))
            if len(r) >= p and np.linalg.cond(r[:p, :p]) < MAX_CONDITION:
                inverse = np.linalg.inv(r[:p, :p])
                coef, var = (inverse @ r[:p, p]).tolist(), (inverse * inverse).sum(1).tolist()
        own = t.select(keys).take(np.zeros(1, np.int64))
        kind = pa.list_(pa.float64())
        return pa.table({**{k: own.column(k) for k in keys}, "rows": [rows], "_chi": [chi], "coef": pa.array([coef], kind), "var": pa.array([var], kind)})

    vector = T.ArrayType(T.DoubleType())
    number = [T.StructField(c, T.DoubleType()) for c in ("rows", "_chi")]
    parts = blocks.mapInArrow(share, T.StructType([*fields, *number, T.StructField("_r", T.BinaryType())]))
    return parts.groupBy(*keys).applyInArrow(solve, T.StructType([*fields, *number, T.StructField("coef", vector), T.StructField("var", vector)]))


def quasibinomial(
    df: DataFrame, keys: Sequence[str], p: int, x: str = "x", y: str = "y", n: str = "n_samples", weight: str | None = None,
    max_rounds: int = 100, tol: float = 1e-9,
) -> DataFrame:
    """Logit regression with weights ``n`` per key: coefficients, standard errors, dispersion, rows.

    ``weight`` is a row multiplicity. Groups with fewer rows than columns, singular ones and those that still move
    after ``max_rounds`` give NULL coefficients and are not ``converged``. A group that has come to rest is not fitted
    again; the driver only learns how many still move. A round sends one triangular factor of p + 1 columns per block of
    rows, whatever their number; least squares by factors keep nearly collinear seasons that normal equations would lose.
    """
    keys = list(keys)
    m = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = df.select(*keys, F.col(x).alias("_x"), clip(y, *CLIP).alias("_y"), F.col(n).cast("double").alias("_n"), m.alias("_m"))
    d = d.where(F.col("_y").isNotNull() & F.col("_n").isNotNull() & F.col("_m").isNotNull() & F.col("_x").isNotNull() & ~F.exists("_x", F.isnull))
    blocks = _packed(d, keys, p)
    own = [F.col(f"a.{k}") for k in keys]
    moving = cut(_round(blocks, keys, p))
    done = [moving.where(F.col("coef").isNull()).withColumn("converged", F.lit(False))]
    moving = moving.where(F.col("coef").isNotNull())
    for _ in range(max_rounds):
        prev = moving.select(*keys, F.col("coef").alias("_c"))
        met = blocks.alias("a").join(prev.alias("b"), same("a", "b", keys)).select(*own, "_data", "_c")
        nxt = _round(met, keys, p)
        nxt = nxt.alias("a").join(prev.alias("b"), same("a", "b", keys)).select(*own, "rows", "_chi", "coef", "var", "_c")
        step = F.array_max(F.zip_with("coef", "_c", lambda a, b: F.abs(a - b) / F.greatest(F.lit(1.0), F.abs(a))))
        nxt = cut(nxt.withColumn("converged", F.coalesce(step < tol, F.lit(False))).drop("_c"))
        done.append(nxt.where("converged or coef is null"))
        moving = nxt.where("not converged and coef is not null").drop("converged")
        if moving.isEmpty():
            break
    cur = moving.withColumn("converged", F.lit(False)).withColumn("coef", F.lit(None).cast("array<double>")).withColumn("var", F.lit(None).cast("array<double>"))
    for part in done:
        cur = cur.unionByName(part)
    scale = F.when(F.col("converged"), F.col("_chi") / F.when(F.col("rows") > p, F.col("rows") - p))
    return cur.withColumn("dispersion", scale).withColumn("se", F.transform("var", lambda v: F.sqrt(v * F.col("dispersion")))).drop("_chi", "var")


def mean_marginal_effects(
    df: DataFrame, coef: DataFrame, keys: Sequence[str], terms: int, interactions: bool = False, x: str = "x", weight: str | None = None
) -> DataFrame:
    """Mean of slope x p(1-p) for the trend and the anomaly part."""
    m = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = df.join(coef.select(*keys, "coef"), list(keys)).withColumn("_e", _dot(F.col(x), F.col("coef")))
    pr = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_e")))

    def slope(i: int, block: int) -> Column:
        b = F.col("coef")[i]
        if interactions:
            b = b + _dot(F.slice(x, 4, terms), F.slice("coef", 4 + terms * block, terms))
        return b

    d = d.withColumn("_v", pr * (F.lit(1.0) - pr)).withColumn("_a", slope(1, 1)).withColumn("_b", slope(2, 2)).withColumn("_m", m)
    return d.groupBy(*keys).agg(
        (F.sum(F.col("_m") * F.col("_a") * F.col("_v")) / F.sum("_m")).alias("mme_trend"),
        (F.sum(F.col("_m") * F.col("_b") * F.col("_v")) / F.sum("_m")).alias("mme_anom"))


def _uniform(key: int, replicate: int, n: int, seed: int) -> np.ndarray:
    """Uniform [0, 1) numbers of the positions of one replicate, from a hash of series, replicate and position."""
    h = np.arange(n, dtype=np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + replicate * 0xD1B54A32D192ED03 + seed * 0x8CB92BA72F3D8DD7) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15), (29, 0xD6E8FEB86659FD93)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(12)).astype(float) / float(1 << 52)


def multiplicities(n: int, key: int, replicate: int, block: int = 60, seed: int = 0) -> np.ndarray:
    """How often each row is drawn in one replicate of the stationary bootstrap.

    Positions open a new block with probability 1/block (the geometric block length); a block is a circular run of
    rows from a random start. All randomness is a hash of series, replicate and position, so results do not depend on
    partitioning.
    """
    opens = _uniform(key, replicate, n, 2 * seed) < 1.0 / block
    opens[:1] = True
    at = np.flatnonzero(opens)
    start = np.floor(_uniform(key, replicate, n, 2 * seed + 1)[at] * n).astype(int)
    which = np.cumsum(opens) - 1
    return np.bincount((start[which] + np.arange(n) - at[which]) % n, minlength=n)


def _fit_replicate(m: np.ndarray, d: dict[str, np.ndarray], terms: int, interactions: bool, max_rounds: int, tol: float) -> list[float | None]:
    """Trend split, regression and effects of one replicate: slopes and marginal effects, or all None."""
    use = m > 0
    w, t, x, y, ns, basis = m[use].astype(float), d["time"][use], d["temperature"][use], d["y"][use], d["n"][use], d["basis"][use]
    ct, cx = np.average(t, weights=w), np.average(x, weights=w)
    spread = (w * (t - ct) ** 2).sum()
    if not spread > 0:
        return [None] * 4
    trend = cx + (w * (t - ct) * (x - cx)).sum() / spread * (t - ct)
    anom = x - trend
    cols = [np.ones_like(t), trend, anom, *basis.T]
    if interactions:
        cols += [*(basis.T * trend), *(basis.T * anom)]
    a = np.column_stack(cols)
    if w.sum() < a.shape[1]:
        return [None] * 4
    mu = (y + 0.5) / 2.0
    eta, coef = np.log(mu / (1.0 - mu)), None
    for _ in range(max_rounds + 1):
        v = mu * (1.0 - mu)
        g = w * ns * v
        normal = (a * g[:, None]).T @ a
        if not np.isfinite(normal).all() or np.linalg.cond(normal) >= 1e14:
            return [None] * 4
        new = np.linalg.solve(normal, (a * g[:, None]).T @ (eta + (y - mu) / v))
        rest = coef is not None and np.abs(new - coef).max() < tol
        coef = new
        eta = a @ coef
        mu = 1.0 / (1.0 + np.exp(-eta))
        if rest:
            break
    else:
        return [None] * 4
    v = mu * (1.0 - mu)
    effects = []
    for i, k in ((1, 1), (2, 2)):
        slope = coef[i] + (basis @ coef[3 + terms * k : 3 + terms * (k + 1)] if interactions else 0.0)
        effects.append(float((w * slope * v).sum() / w.sum()))
    return [float(coef[1]), float(coef[2]), *effects]


CHUNK = 50


def block_bootstrap(
    df: DataFrame, keys: Sequence[str], terms: int = 12, interactions: bool = False, replicates: int | str = 1000, block: int = 60,
    seed: int = 0, max_rounds: int = 100, tol: float = 1e-9,
) -> DataFrame:
    """Refits of trend split and regression per replicate: slopes and mean marginal effects; failed ones are NULL.

    ``replicates`` is a number or the name of a column with each series' own number. A series' daily rows (bounded by
    the calendar) become one row of arrays; a task refits a chunk of its replicates, so neither replicates nor
    resampled rows are shuffled. A replicate that does not come to rest in ``max_rounds`` counts as failed.
    """
    keys = list(keys)
    b = F.max(replicates) if isinstance(replicates, str) else F.max(F.lit(replicates))
    d = df.where(F.col("y").isNotNull() & F.col("n_samples").isNotNull() & F.col("temperature").isNotNull() & F.col("time").isNotNull())
    row = F.struct(F.col("time").cast("double").alias("t"), F.col("temperature").cast("double").alias("x"), clip("y", *CLIP).alias("y"),
                   F.col("n_samples").cast("double").alias("n"), fourier_basis("doy", terms).alias("basis"))
    one = d.select(*keys, *([replicates] if isinstance(replicates, str) else []), row.alias("_row")).groupBy(*keys).agg(
        F.sort_array(F.collect_list("_row")).alias("_rows"), b.cast("int").alias("_b"))
    chunks = one.withColumn("_key", F.xxhash64(*keys)).withColumn("_first", F.explode(F.sequence(F.lit(0), F.col("_b") - 1, F.lit(CHUNK))))
    chunks = chunks.repartition(*keys, "_first")
    names = ("slope_trend", "slope_anom", "mme_trend", "mme_anom")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                rows = r["_rows"]
                data = {k: np.array([x[c] for x in rows], float) for k, c in (("time", "t"), ("temperature", "x"), ("y", "y"), ("n", "n"))}
                data["basis"] = np.array([np.asarray(x["basis"], float) for x in rows]).reshape(len(rows), terms)
                reps = range(int(r["_first"]), min(int(r["_first"]) + CHUNK, int(r["_b"])))
                got = [_fit_replicate(multiplicities(len(rows), int(r["_key"]), i, block, seed), data, terms, interactions, max_rounds, tol) for i in reps]
                out = pd.DataFrame(got, columns=list(names), dtype=object)
                for k in reversed(keys):
                    out.insert(0, k, [r[k]] * len(out))
                out.insert(len(keys), "replicate", list(reps))
                yield out

    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("replicate", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    return chunks.mapInPandas(run, schema)


def bootstrap_ci(reps: DataFrame, keys: Sequence[str], values: Sequence[str], alpha: float = 0.05, min_valid: float = 0.0) -> DataFrame:
    """Percentile interval, two-sided p and mean of each replicate statistic (a series has a fixed number of replicates).

    NULL if fewer than the share ``min_valid`` of the replicates is valid.
    """
    aggs = []
    for v in values:
        x = F.col(v)
        low, high = F.avg(F.when(x.isNotNull(), (x <= 0).cast("double"))), F.avg(F.when(x.isNotNull(), (x >= 0).cast("double")))
        aggs += [
            F.percentile(x, alpha / 2).alias(f"{v}_lower"), F.percentile(x, 1 - alpha / 2).alias(f"{v}_upper"), F.avg(x).alias(f"{v}_mean"),
            F.least(F.lit(1.0), F.least(low, high) * 2.0).alias(f"{v}_p")]
    out = reps.groupBy(*keys).agg(*aggs, F.count(values[0]).alias("n_valid"), F.count(F.lit(1)).alias("n_replicates"))
    enough = F.col("n_valid") >= F.lit(min_valid) * F.col("n_replicates")
    return out.withColumns({c: F.when(enough, F.col(c)) for v in values for c in (f"{v}_lower", f"{v}_upper", f"{v}_mean", f"{v}_p")})


def fit_response(df: DataFrame, keys: Sequence[str], terms: int = 12, interactions: bool = False) -> DataFrame:
    """Trend split, regression and marginal effects of every series (columns time, temperature, doy, n_samples, y)."""
    d = cut(linear_trend(df, keys).withColumn("x", design(terms, interactions)))
    fit = quasibinomial(d, keys, n_columns(terms, interactions))
    return fit.join(mean_marginal_effects(d, fit.where(F.col("coef").isNotNull()), keys, terms, interactions), list(keys), "left")


def predict(df: DataFrame, coef: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Predicted fraction from each row's own series' coefficients; unknown series give NULL."""
    d = df.join(coef.select(*keys, "coef"), list(keys), "left")
    return d.withColumn("predicted", F.lit(1.0) / (F.lit(1.0) + F.exp(-_dot(F.col(x), F.col("coef"))))).drop("coef")


def meta_response(
    df: DataFrame, site: Sequence[str], instrument: str = "instrument", terms: int = 2, replicates: int = 10_000, min_replicates: int = 100,
    alpha: float = 0.05, block: int = 60, seed: int = 0,
) -> DataFrame:
    """Instruments fitted apart, effects weighted by sample share, replicates (in the same shares) pooled per site."""
    site = list(site)
    keys = [*site, instrument]
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    tot = n.groupBy(*site).agg(F.sum("_n").alias("_tot"))
    share = n.join(tot, site).withColumn("_b", F.greatest(F.lit(min_replicates), F.rint(F.lit(float(replicates)) * F.col("_n") / F.col("_tot"))).cast("int"))
    fit = fit_response(df, keys, terms).join(share, keys)
    point = fit.groupBy(*site).agg(
        (F.sum(F.col("mme_trend") * F.col("_n")) / F.sum("_n")).alias("mme_trend"), (F.sum(F.col("mme_anom") * F.col("_n")) / F.sum("_n")).alias("mme_anom"))
    with_b = df.join(share.select(*keys, "_b"), keys)
    reps = block_bootstrap(with_b, keys, terms, replicates="_b", block=block, seed=seed)
    ci = bootstrap_ci(reps, site, ["mme_trend", "mme_anom"], alpha, min_valid=0.5).withColumnsRenamed({"mme_trend_mean": "boot_trend", "mme_anom_mean": "boot_anom"})
    return point.join(ci, site)
