"""Array (profile) primitives built on higher-order functions; row-local, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind a value once and use it many times inside lambdas.

    The optimizer inlines columns into lambda bodies, where they would be
    evaluated per element; a one-element array keeps the value outside.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pack(**cols: Column) -> Column:
    return F.named_struct(*[x for n, c in cols.items() for x in (F.lit(n), c)])


def indices(a: Column) -> Column:
    """0-based index array (empty for an empty array)."""
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def array_median(a: Column) -> Column:
    """Median of the non-null entries (mean of the middle two), NULL if none."""
    def mid(v):
        n = F.size(v)
        return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2.0)

    return let(F.array_sort(F.filter(a, lambda x: x.isNotNull())), mid)


def diffs(a: Column) -> Column:
    """next - current, one entry shorter."""
    return F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: y - x)


def nearest_index(a: Column, target: Column, tie: str = "first") -> Column:
    """0-based index of the entry nearest to a value; on a tie the first one, or the larger value (``tie="larger"``)."""
    if tie not in ("first", "larger"):
        raise ValueError(f"unknown tie rule {tie!r}")
    key = (lambda x, i: -x) if tie == "larger" else (lambda x, i: i)
    return let(target, lambda t: F.array_min(F.transform(a, lambda x, i: F.struct(F.abs(x - t).alias("d"), key(x, i).alias("k"), i.alias("i"))))["i"])


def var_pop(a: Column) -> Column:
    """Population variance of the non-null entries (two passes over the array)."""
    v = F.filter(a, lambda x: x.isNotNull())
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)

    def spread(m):
        return F.aggregate(m["v"], F.lit(0.0), lambda s, x: s + (x - m["m"]) * (x - m["m"])) / F.size(m["v"])

    return let(v, lambda v: F.when(F.size(v) > 0, let(pack(v=v, m=mean(v)), spread)))


def longest_true_run(flags: Column) -> Column:
    return F.aggregate(
        flags,
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda a, x: F.struct(
            F.when(x, a["run"] + 1).otherwise(F.lit(0)).alias("run"),
            F.greatest(a["best"], F.when(x, a["run"] + 1).otherwise(F.lit(0))).alias("best"),
        ),
        lambda a: a["best"],
    )


def run_lengths(flags: Column) -> Column:
    """How many true entries in a row end at each place (0 at a false or NULL one), linear in the length.

    Each false place opens a stretch 0, 1, 2 ... up to the next one; the first stretch opens before the array.
    """
    def stretches(f):
        stops = F.filter(indices(f), lambda i: ~F.coalesce(F.get(f, i), F.lit(False)))
        ends = F.zip_with(F.concat(F.array(F.lit(-1)), stops), F.concat(stops, F.array(F.size(f))), lambda a, b: F.sequence(F.lit(0), b - a - 1))
        return F.slice(F.flatten(ends), F.lit(2), F.size(f))

    return let(flags, stretches)


def nan_trapz(y: Column, x: Column) -> Column:
    """Trapezoid rule over the points where both coordinates exist; NULL below two points."""
    pts = F.filter(F.zip_with(y, x, lambda a, b: F.struct(a.alias("y"), b.alias("x"))), lambda p: p["y"].isNotNull() & p["x"].isNotNull())
    return F.aggregate(
        pts,
        F.struct(
            F.lit(None).cast("double").alias("py"), F.lit(None).cast("double").alias("px"),
            F.lit(0.0).alias("s"), F.lit(0).alias("n"),
        ),
        lambda a, p: F.struct(
            p["y"].alias("py"), p["x"].alias("px"),
            (a["s"] + F.coalesce((p["y"] + a["py"]) * (p["x"] - a["px"]) / 2.0, F.lit(0.0))).alias("s"),
            (a["n"] + 1).alias("n"),
        ),
        lambda a: F.when(a["n"] >= 2, a["s"]),
    )
