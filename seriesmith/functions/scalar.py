"""Scalar column functions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

SECONDS_PER_YEAR = 31557600.0
EARTH_RADIUS_M = 6371000.0


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quantize(v: Column | str, resolution: float) -> Column:
    """Nearest step of the resolution grid, halves to even."""
    return F.rint(_c(v) / F.lit(float(resolution)))


def clip(v: Column | str, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (least/greatest alone would skip it)."""
    v = _c(v)
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def normal_ppf(p: float) -> float:
    """Quantile of the standard normal at a constant, evaluated while planning."""
    return NormalDist().inv_cdf(p)


def erf(x: Column, terms: int = 140) -> Column:
    """Error function from its all-positive series exp(-x^2) * sum x^(2n+1)/Gamma(n+3/2)."""
    def series(a):
        s = F.aggregate(
            F.sequence(F.lit(1), F.lit(terms)),
            F.struct((a * 1.1283791670955126).alias("t"), (a * 1.1283791670955126).alias("s")),
            lambda acc, n: F.struct(
                (acc["t"] * a * a / (n + F.lit(0.5))).alias("t"),
                (acc["s"] + acc["t"] * a * a / (n + F.lit(0.5))).alias("s"),
            ),
            lambda acc: acc["s"],
        )
        return F.exp(-a * a) * s

    return F.signum(x) * let(F.least(F.abs(x), F.lit(6.0)), series)


def normal_cdf(z: Column | str) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(_c(z) / F.lit(2.0**0.5)))


def two_sided_p(z: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(_c(z)))))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres between two points in degrees."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp, dl = p2 - p1, F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def fourier_basis(doy: Column | str, terms: int) -> Column:
    """[sin, cos] pairs of the annual harmonics 1..terms//2, plus one more sine if terms is odd."""
    base = _c(doy) * F.lit(2.0 * 3.141592653589793 / 365.25)
    out = []
    for k in range(1, terms // 2 + 1):
        out += [F.sin(base * k), F.cos(base * k)]
    if terms % 2:
        out.append(F.sin(base * (terms // 2 + 1)))
    return F.array(*out)


def normalize_key(v: Column | str) -> Column:
    return F.lower(F.trim(_c(v)))


def normalize_instrument_id(v: Column | str) -> Column:
    return F.translate(F.lower(F.trim(_c(v))), " -", "")


def path_part(path: Column | str, i: int) -> Column:
    """i-th (1-based) component of a /site/instrument path, NULL if absent."""
    return F.nullif(F.split_part(_c(path), F.lit("/"), F.lit(i + 1)), F.lit(""))


# Wording of flag comments and of the fractions they become.
FLAG_WORDING = (
    ("Boolean flag indicating presence of ", "Fraction of samples with "),
    ("Boolean flag indicating profiles that were ", "Fraction of samples that were "),
    ("Boolean flag indicating ", "Fraction of samples indicating "),
    ("Boolean flag ", "Fraction of samples "),
)


def flag_comment_to_fraction(c: Column | str) -> Column:
    """Comment of an averaged flag: the first known wording wins, else the word itself changes."""
    c = _c(c)
    out = F.replace(F.replace(c, F.lit(" flag"), F.lit(" fraction")), F.lit(" Flag"), F.lit(" Fraction"))
    for old, new in reversed(FLAG_WORDING):
        out = F.when(F.contains(c, F.lit(old)), F.replace(c, F.lit(old), F.lit(new))).otherwise(out)
    return out


def interp(x: Column | str, xp: Column | str, fp: Column | str) -> Column:
    """Piecewise-linear lookup in a sorted table held as two arrays; flat outside.

    The bracket is found by bisection, so a lookup costs log2(size) steps.
    """
    x, xp, fp = _c(x), _c(xp), _c(fp)
    n = F.size(xp)
    lo = F.aggregate(
        F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int")),
        F.struct(F.lit(0).alias("lo"), (n - 1).alias("hi")),
        lambda a, _: F.struct(
            F.when(F.get(xp, F.floor((a["lo"] + a["hi"]) / 2).cast("int")) <= x, F.floor((a["lo"] + a["hi"]) / 2).cast("int"))
            .otherwise(a["lo"]).alias("lo"),
            F.when(F.get(xp, F.floor((a["lo"] + a["hi"]) / 2).cast("int")) <= x, a["hi"])
            .otherwise(F.floor((a["lo"] + a["hi"]) / 2).cast("int")).alias("hi"),
        ),
        lambda a: a["lo"],
    )
    x0, x1, y0, y1 = F.get(xp, lo), F.get(xp, lo + 1), F.get(fp, lo), F.get(fp, lo + 1)
    return (
        F.when(x <= F.get(xp, F.lit(0)), F.get(fp, F.lit(0)))
        .when(x >= F.get(xp, n - 1), F.get(fp, n - 1))
        .otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    )


def percent_points_per_decade(v: Column | str) -> Column:
    return _c(v) * 1000.0
