"""Order statistics of all pairwise slopes of a series, without forming the pairs.

The slope of two points is under v exactly if y - v t falls from the earlier to the later one. So the number of slopes
under a trial value is a number of inversions, counted in n log n, and a wanted rank gets a bracket of two trial values
with known counts. Trial values are taken from slopes of random pairs, later evenly from the bracket. Values of y - v t
that differ by rounding only count as equal: a trial that meets many equal slopes is itself the answer for their ranks.

* A series of up to ``local_rows`` points is one group of a cogrouped Arrow function. When few enough pairs are left in a
  bracket they are listed: they are the inversions between the orders of its two ends.
* Longer series never meet in one task. Every round they are counted for a few trial values by ``pair_counts`` (dyadic
  splits, split by value as well), until the brackets are short enough to be listed by a join, or of the rounding's width.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import cut, same

#: Points of a series that one task takes (24 bytes each), and pairs that it lists at a time.
LOCAL_ROWS = 1 << 19
LIST_PAIRS = 1 << 21
SAMPLE = 1 << 17
ROUNDING = 2.0**-50


def inversions(p: np.ndarray, weight: np.ndarray | None = None, visit: Callable | None = None) -> int:
    """Weighted number of pairs i < j with p[i] > p[j], by merging; ``visit`` gets the pairs of each merge as two index arrays."""
    n, m, total, size = len(p), int(p.max(initial=0)) + 1, 0, 1
    cur = np.arange(n)  # places, sorted by block and value
    while size < n:
        block = cur // (2 * size)
        right = (cur // size) & 1 == 1
        key = block * m + p[cur]
        left, keys = cur[~right], key[~right]
        after = np.searchsorted(keys, key[right], "right")
        stop = np.searchsorted(keys, (block[right] + 1) * m)
        if visit is None:
            below = np.concatenate([[0], np.cumsum(weight[left])])
            total += int((weight[cur[right]] * (below[stop] - below[after])).sum())
        else:
            count = stop - after
            first = np.repeat(after - np.cumsum(count) + count, count)
            visit(left[first + np.arange(count.sum())], np.repeat(cur[right], count))
        cur = cur[np.argsort(key, kind="stable")]
        size *= 2
    return total


class Points:
    """Weighted points of one series, ordered by stratum, time and value; only pairs inside a stratum count."""

    def __init__(self, strat: np.ndarray, t: np.ndarray, y: np.ndarray, w: np.ndarray, unit: float):
        order = np.lexsort((y, t, strat))
        self.s, self.y, self.w, self.unit = strat[order], y[order], w[order].astype(np.int64), unit
        t = t[order]
        first = np.searchsorted(self.s, self.s)
        self.t = (t - t[first]).astype(np.float64)
        self.ticks, self.first = t, first
        # trial values meet the distance from the stratum's median value: less rounding where values are far from zero
        _, start, size = np.unique(self.s, return_index=True, return_counts=True)
        middle = self.y[np.lexsort((self.y, self.s))][start + size // 2]
        self.off = self.y - np.repeat(middle, size)
        self.top = float(np.abs(self.off).max(initial=0)), float(self.t.max(initial=0))
        self.moment = np.concatenate([[True], (np.diff(self.s) != 0) | (np.diff(t) != 0)])
        self.n_pairs = (self._squares(np.diff(self.s) != 0) - self._squares(self.moment[1:])) // 2

    def _squares(self, cut_: np.ndarray, order: np.ndarray | slice = slice(None)) -> int:
        runs = np.add.reduceat(self.w[order], np.flatnonzero(np.concatenate([[True], cut_])))
        return int((runs * runs).sum())

    def classes(self, v: float) -> np.ndarray:
        """Rank of each point by stratum and y - v t; values within rounding share one."""
        r = self.off - v * self.unit * self.t
        order = np.lexsort((r, self.s))
        eps = ROUNDING * (self.top[0] + abs(v) * self.unit * self.top[1])
        new = (np.diff(self.s[order]) != 0) | (np.diff(r[order]) > eps)
        p = np.empty(len(r), np.int64)
        p[order] = np.concatenate([[0], np.cumsum(new)])
        return p

    def count(self, v: float) -> tuple[int, int]:
        """Slopes under v, and up to v."""
        p = self.classes(v)
        under = inversions(p, self.w)
        order = np.lexsort((self.ticks, p))
        apart = np.diff(p[order]) != 0
        equal = self._squares(apart, order) - self._squares(apart | (np.diff(self.ticks[order]) != 0), order)
        return under, under + equal // 2

    def between(self, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """Slopes strictly between two trial values, and their weights."""
        p, q = self.classes(low), self.classes(high)
        order = np.lexsort((q, p))
        slopes, weights = [], []

        def take(i, j):
            i, j = order[i], order[j]
            slopes.append((self.y[j] - self.y[i]) / ((self.ticks[j] - self.ticks[i]) * self.unit) + 0.0)
            weights.append(self.w[i] * self.w[j])

        inversions(q[order], visit=take)
        return np.concatenate(slopes), np.concatenate(weights)

    def sample(self, rng: np.random.Generator) -> np.ndarray:
        size = np.bincount(self.s - self.s[0]).astype(np.float64)
        s = rng.choice(len(size), SAMPLE, p=size**2 / (size**2).sum())
        first, size = np.searchsorted(self.s, s + self.s[0]), size[s].astype(np.int64)
        i, j = (first + (rng.random(SAMPLE) * size).astype(np.int64) for _ in range(2))
        dt = self.ticks[j] - self.ticks[i]
        i, j, dt = i[dt != 0], j[dt != 0], dt[dt != 0]
        return np.sort((self.y[j] - self.y[i]) / (dt * self.unit) + 0.0)


def located(v: np.ndarray, under: np.ndarray, up_to: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank the last trial value with at most as many slopes under it, and whether it is the answer."""
    at = np.searchsorted(under, ranks, "right") - 1
    return at, up_to[at] > ranks


def trial_values(low: float, high: float, places: np.ndarray, count: int, sample: np.ndarray) -> np.ndarray:
    """New trial values for ranks at the given places of a bracket with ``count`` slopes."""
    inside = sample[np.searchsorted(sample, low, "right") : np.searchsorted(sample, high)]
    many = min(64, 2 * (count // LIST_PAIRS) + 2)
    q = np.unique(places) / count if len(places) <= 4 else np.linspace(places.min(), places.max(), many) / count
    if len(inside) < 16:
        return np.linspace(low, high, 18)[1:-1]
    spread = np.sqrt(len(inside) * q * (1 - q)) + 1
    at = np.concatenate([q * len(inside) + f * spread for f in (-2, -0.5, 0.5, 2)])
    return np.unique(inside[np.clip(at, 0, len(inside) - 1).astype(np.int64)])


def select(points: Points, ranks: np.ndarray) -> np.ndarray:
    """Slopes of the given 0-based ranks (each under the number of pairs)."""
    out = np.full(len(ranks), np.nan)
    n, spread = points.n_pairs, float(np.ptp(points.y)) if len(points.y) else 0.0
    if not n or not spread:
        return np.where(ranks < n, 0.0, out)
    edge = 1.01 * spread / points.unit  # no slope is steeper: times differ by a tick at least
    known = {-edge: (0, 0), edge: (n, n)}
    rng, todo = np.random.default_rng(1), np.flatnonzero((ranks >= 0) & (ranks < n))
    while todo.size:
        v = np.array(sorted(known))
        under, up_to = np.array([known[x] for x in v]).T
        at, met = located(v, under, up_to, ranks[todo])
        out[todo[met]] = v[at[met]]
        todo, at = todo[~met], at[~met]
        sample, left = None, []
        for i in np.unique(at):
            mine = todo[at == i]
            low, high, count = v[i], v[i + 1], int(under[i + 1] - up_to[i])
            if count <= LIST_PAIRS or high - low <= 4 * np.spacing(max(abs(low), abs(high))):
                if count > LIST_PAIRS:  # as many slopes within rounding
                    out[mine] = (low + high) / 2
                    continue
                slopes, weight = points.between(low, high)
                order = np.argsort(slopes)
                out[mine] = slopes[order][np.minimum(np.searchsorted(np.cumsum(weight[order]), ranks[mine] - up_to[i], "right"), len(slopes) - 1)]
                continue
            sample = points.sample(rng) if sample is None else sample
            for x in trial_values(low, high, ranks[mine] - up_to[i], count, sample):
                if x not in known:
                    known[x] = points.count(x)
            left.append(mine)
        todo = np.concatenate(left) if left else todo[:0]
    return out


def weighted_points(df: DataFrame, keys: Sequence[str], strat: str, t: str, y: str) -> DataFrame:
    """Equal rows merged: a group of copies is one point with a weight."""
    return df.where(F.col(y).isNotNull()).groupBy(*keys, F.col(strat).alias("_strat"), F.col(t).cast("bigint").alias("_t"), F.col(y).alias("_y")).agg(
        F.count(F.lit(1)).alias("_w"))


def local_ranks(points: DataFrame, ranks: DataFrame, keys: Sequence[str], unit: float) -> DataFrame:
    """Each series in one task: its points meet the ranks asked of it."""
    keys = list(keys)
    fresh = [F.col(k).alias(k) for k in keys]  # both sides may come from one table
    asked = ranks.groupBy(*keys).agg(F.collect_set("k").alias("_ks")).select(*fresh, "_ks")
    schema = T.StructType([*[asked.schema[k] for k in keys], T.StructField("k", T.LongType()), T.StructField("slope", T.DoubleType())])

    def run(pts: pa.Table, ask: pa.Table) -> pa.Table:
        if not len(ask):
            return pa.table({c: pa.array([], ask.schema.field(c).type) for c in keys} | {"k": pa.array([], pa.int64()), "slope": pa.array([], pa.float64())})
        want = np.array(ask.column("_ks")[0].as_py(), np.int64)
        col = lambda c: pts.column(c).to_numpy()
        strata = np.unique(col("_strat").astype(str), return_inverse=True)[1] if len(pts) else np.zeros(0, np.int64)
        found = select(Points(strata, col("_t"), col("_y"), col("_w"), unit), want)
        same_key = ask.select(keys).take(np.zeros(len(want), np.int64))
        return pa.table({**{c: same_key.column(c) for c in keys}, "k": want, "slope": pa.array(found, pa.float64())})

    return points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, schema)


# --- series of any length -----------------------------------------------------------------------


def _pair_sample(points: DataFrame, keys: list[str], unit: float, wanted: int = 20_000) -> DataFrame:
    """Slopes of about ``wanted`` random pairs per series: strangers that a hash puts into the same small bucket."""
    sizes = points.groupBy(*keys, "_strat").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.groupBy(*keys).agg(F.sum(F.col("_n").cast("double") ** 2).alias("_all"))
    rate = F.col("_n").cast("double") ** 2 / F.col("_all") * wanted * 2 / F.col("_n")
    sizes = sizes.alias("a").join(total.alias("b"), same("a", "b", keys)).select(*[F.col(f"a.{k}") for k in keys], "_strat", "_n", rate.alias("_rate"))
    on = same("p", "s", [*keys, "_strat"])
    met = points.alias("p").join(sizes.alias("s"), on).select(*[F.col(f"p.{k}") for k in keys], "p._strat", "_t", "_y", "_rate", F.pmod(
        F.xxhash64("_t", "_y"), F.greatest(F.lit(1), F.floor(F.col("_n") / 2))).alias("_b"))
    met = met.where(F.pmod(F.xxhash64("_b", F.lit(3)), F.lit(1 << 30)) < F.col("_rate") * (1 << 30))
    ends = met.groupBy(*keys, "_strat", "_b").agg(F.min(F.struct("_t", "_y")).alias("a"), F.max(F.struct("_t", "_y")).alias("b"))
    slope = (F.col("b._y") - F.col("a._y")) / ((F.col("b._t") - F.col("a._t")) * F.lit(unit))
    return ends.where("b._t > a._t").groupBy(*keys).agg(F.sort_array(F.collect_list(slope)).alias("_sample"))


def _next_trials(unit: float, listed: int):
    """Per series: answers found so far, the brackets of the other ranks, and the next trial values."""

    def run(batches):
        for pdf in batches:
            trials, values, left, brackets = [], [], [], []
            for row in pdf.to_dict("records"):
                known = sorted(zip(row["_known_v"], row["_known_u"], row["_known_e"], strict=True))
                v, under, up_to = (np.array(c) for c in zip(*known, strict=True))
                ranks, found, new, where = np.array(row["_left"], np.int64), [(f["k"], f["slope"]) for f in row["_found"]], [], []
                at, met = located(v, under, up_to, ranks)
                narrow = row["_spread"] * ROUNDING / max(row["_span"], 1) / unit
                for k, i, hit in zip(ranks.tolist(), at, met, strict=True):
                    low, high = float(v[i]), float(v[min(i + 1, len(v) - 1)])
                    if hit or high - low <= 16 * np.spacing(max(abs(low), abs(high))) + narrow:
                        found.append((k, low if hit else (low + high) / 2))
                        continue
                    count = int(under[i + 1] - up_to[i])
                    where.append({"k": k, "low": low, "high": high, "below": int(up_to[i]), "listed": count <= listed})
                    if len(new) < 48:  # further ranks wait for a later round
                        new.extend(trial_values(low, high, np.array([k - up_to[i]]), count, np.array(row["_sample"])).tolist())
                trials.append(sorted(set(new) - set(v.tolist())))
                values.append([{"k": k, "slope": s} for k, s in found])
                left.append([w["k"] for w in where])
                brackets.append(where)
            yield pdf.assign(_trials=trials, _found=values, _left=left, _brackets=brackets)

    return run


def _listed(points: DataFrame, brackets: DataFrame, keys: list[str], unit: float, limit: int) -> DataFrame | None:
    """Ranks whose brackets hold few slopes, from the pairs themselves: keys, k, slope.

    Between the two ends of a bracket a point is overtaken only by points within a known distance in y - low t, so pairs
    meet by cells of that width. Brackets whose cells hold too many pairs (many equal values) are left to further rounds.
    """
    ks = [F.col(f"a.{k}") for k in keys]
    ends = [*keys, "low", "high"]
    one = brackets.where("listed").select(*ends, "_span", "_top").distinct()
    rows = points.alias("a").join(one.alias("b"), same("a", "b", keys)).select(*ks, "_strat", "_t", "_y", "_w", "low", "high", "_span", "_top")
    place = lambda v: F.col("_y") - F.col(v) * unit * F.col("_t")
    step = lambda v: F.lit(ROUNDING) * (F.col("_top") + F.abs(F.col(v)) * unit * F.col("_span"))
    rows = rows.withColumns({"p": F.rint(place("low") / step("low")), "q": F.rint(place("high") / step("high")),
                             "c": F.floor((place("low") + F.col("_top")) / (1.001 * (F.col("high") - F.col("low")) * unit * F.col("_span") + 4 * step("low"))).cast("double")})
    rows = cut(rows.select(*ends, "_strat", "_t", "_y", "_w", "p", "q", "c"))
    cells = rows.groupBy(*ends, "_strat", "c").agg(F.count(F.lit(1)).cast("double").alias("n"))
    few = cut(cells.groupBy(*ends).agg(F.sum(2 * F.col("n") * F.col("n")).alias("met")).where(F.col("met") <= 64 * limit))
    if few.isEmpty():
        return None
    rows = rows.alias("a").join(few.alias("b"), same("a", "b", ends), "left_semi")
    near = [*ends, "_strat", "c"]
    early = rows.withColumn("c", F.explode(F.array("c", F.col("c") + 1)))
    met = early.alias("a").join(rows.alias("b"), same("a", "b", near) & (F.col("a._t") < F.col("b._t")) & (F.col("a.p") < F.col("b.p")) & (F.col("a.q") > F.col("b.q")))
    slope = (F.col("b._y") - F.col("a._y")) / ((F.col("b._t") - F.col("a._t")) * F.lit(unit))
    met = met.select(*[F.col(f"a.{c}") for c in ends], slope.alias("slope"), (F.col("a._w") * F.col("b._w")).alias("w")).groupBy(*ends, "slope").agg(F.sum("w").alias("w"))
    up_to = F.sum("w").over(W.partitionBy(*ends).orderBy("slope").rowsBetween(W.unboundedPreceding, 0))
    met = met.withColumn("upto", up_to)
    want = brackets.where("listed").select(*ends, "k", (F.col("k") - F.col("below")).alias("r"))
    hit = same("a", "b", ends) & (F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("w"))
    return cut(met.alias("a").join(want.alias("b"), hit).select(*ks, "k", "slope"))


def long_ranks(points: DataFrame, ranks: DataFrame, keys: Sequence[str], unit: float, limit: int = LIST_PAIRS) -> DataFrame:
    """The same by counting rounds over all tasks; brackets of up to ``limit`` slopes are listed."""
    from .trend import pair_counts

    keys = list(keys)
    ks = [F.col(f"a.{k}") for k in keys]
    on = same("a", "b", keys)
    fixed = ("_spread", "_span", "_top", "_sample")
    strata = points.groupBy(*keys, "_strat").agg(F.percentile_approx("_y", 0.5).alias("_y0"), F.min("_t").alias("_t0"))
    points = cut(points.alias("a").join(strata.alias("b"), same("a", "b", [*keys, "_strat"])).select(
        *ks, "a._strat", (F.col("_t") - F.col("_t0")).alias("_t"), (F.col("_y") - F.col("_y0")).alias("_y"), "_w"))
    span = points.groupBy(*keys).agg((F.max("_y") - F.min("_y")).alias("_spread"), F.max("_t").cast("double").alias("_span"), F.max(F.abs("_y")).alias("_top"))
    total = points.groupBy(*keys, "_strat", "_t").agg(F.sum("_w").alias("_c")).groupBy(*keys, "_strat").agg(
        ((F.pow(F.sum("_c"), F.lit(2)) - F.sum(F.pow("_c", F.lit(2)))) / 2).cast("bigint").alias("_n")).groupBy(*keys).agg(F.sum("_n").alias("_n"))
    state = span.alias("a").join(total.alias("b"), on).select(*ks, "_spread", "_span", "_top", "_n")
    state = state.alias("a").join(ranks.groupBy(*keys).agg(F.collect_set("k").alias("_left")).alias("b"), on).select(*ks, "_spread", "_span", "_top", "_n", "_left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    flat = F.col("_spread") == 0
    state = cut(state.alias("a").join(_pair_sample(points, keys, unit).alias("b"), on, "left").select(
        *ks, "_spread", "_span", "_top", F.coalesce("_sample", none("double")).alias("_sample"), F.when(flat, none("bigint")).otherwise(F.col("_left")).alias("_left"),
        F.array(-1.01 * F.col("_spread") / unit, 1.01 * F.col("_spread") / unit).alias("_known_v"),
        F.array(F.lit(0).cast("bigint"), "_n").alias("_known_u"), F.array(F.lit(0).cast("bigint"), "_n").alias("_known_e"),
        F.when(flat, F.transform("_left", lambda k: F.struct(k.alias("k"), F.lit(0.0).alias("slope")))).otherwise(none("struct<k:bigint,slope:double>")).alias("_found"),
        none("double").alias("_trials"), none("struct<k:bigint,low:double,high:double,below:bigint,listed:boolean>").alias("_brackets")))
    n = F.element_at("_known_u", 2)  # the second known value is the steepest slope: all pairs are under it
    while True:
        state = cut(state.mapInPandas(_next_trials(unit, limit), state.schema))
        open_ = state.where(F.size("_left") > 0)
        if open_.isEmpty():
            return state.select(*keys, F.inline("_found"))
        brackets = cut(open_.select(*keys, "_span", "_top", F.inline("_brackets")))
        got = _listed(points, brackets, keys, unit, limit) if not brackets.where("listed").isEmpty() else None
        if got is not None:
            got = got.groupBy(*keys).agg(F.collect_list(F.struct("k", "slope")).alias("_got"))
            state = state.alias("a").join(got.alias("b"), on, "left").select(
                *ks, *[F.col(f"a.{c}") for c in fixed], F.array_except("_left", F.coalesce("_got.k", none("bigint"))).alias("_left"), "_known_v", "_known_u", "_known_e",
                F.concat("_found", F.coalesce("_got", none("struct<k:bigint,slope:double>"))).alias("_found"), "_trials", "_brackets")
            state = cut(state)
            open_ = state.where(F.size("_left") > 0)
        trial = cut(open_.select(*keys, "_span", "_top", F.explode("_trials").alias("_v")))
        if trial.isEmpty():
            continue
        rows = points.alias("a").join(trial.alias("b"), on).select(*ks, "_strat", "_t", "_y", "_w", "_v", "_span", "_top")
        slope = F.col("_v") * unit
        eps = F.lit(ROUNDING) * (F.col("_top") + F.abs(slope) * F.col("_span"))
        rows = rows.select(*keys, "_strat", "_v", "_t", F.rint((F.col("_y") - slope * F.col("_t")) / eps).alias("_r"), "_w")  # whole multiples of the rounding
        counted = pair_counts(rows, [*keys, "_v"], "_strat", "_t", "_r", 1.0, weight="_w").groupBy(*keys, "_v").agg(
            F.sum("falling").alias("u"), F.sum("rising").alias("up"))
        counted = counted.groupBy(*keys).agg(F.collect_list(F.struct("_v", "u", "up")).alias("_new"))
        state = state.alias("a").join(counted.alias("b"), on, "left").select(
            *ks, *[F.col(f"a.{c}") for c in fixed], "_left",
            F.concat("_known_v", F.coalesce(F.col("_new._v"), none("double"))).alias("_known_v"),
            F.concat("_known_u", F.coalesce(F.col("_new.u"), none("bigint"))).alias("_known_u"),
            F.concat("_known_e", F.transform(F.coalesce(F.col("_new.up"), none("bigint")), lambda x: n - x)).alias("_known_e"), "_found", "_trials", "_brackets")


def slope_ranks(df: DataFrame, keys: Sequence[str], strat: str, t: str, y: str, ranks: DataFrame, unit: float = 86400.0, local_rows: int = LOCAL_ROWS,
                limit: int = LIST_PAIRS) -> DataFrame:
    """Values of the wanted 0-based ranks ``k`` of the pairwise slopes (per second) of each series.

    ``ranks`` has the keys and a bigint column ``k`` that is below the series' number of comparable pairs. Slopes of equal
    times don't count; NULL values don't either; NULL keys are keys like others.
    """
    keys = list(keys)
    wanted = ranks.select(*keys, F.col("k").cast("bigint").alias("k"))
    points = weighted_points(df, keys, strat, t, y)
    long = cut(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > local_rows))
    if long.isEmpty():
        return local_ranks(points, wanted, keys, unit)
    points = cut(points)
    part = lambda d, how: d.alias("a").join(long.alias("b"), same("a", "b", keys), how)
    short = local_ranks(part(points, "left_anti"), part(wanted, "left_anti"), keys, unit)
    return short.unionByName(long_ranks(part(points, "left_semi"), part(wanted, "left_semi"), keys, unit, limit))
