"""Calendar expressions: no-leap day of year, seasons and bin labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINOR_BINS = {"2day": 2, "3day": 3}
FREQUENCIES = ("2day", "3day", "week", "month", "season", "year")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_leap_year(d: Column | str) -> Column:
    return F.dayofyear(F.make_date(F.year(_c(d)), F.lit(12), F.lit(31))) == 366


def noleap_doy(d: Column | str) -> Column:
    """Day of year 1..365; days after February move down by one in leap years."""
    d = _c(d)
    late = is_leap_year(d) & (F.month(d) > 2)
    return F.dayofyear(d) - F.when(late, F.lit(1)).otherwise(F.lit(0))


def is_leap_day(d: Column | str) -> Column:
    d = _c(d)
    return (F.month(d) == 2) & (F.dayofmonth(d) == 29)


def season(d: Column | str) -> Column:
    m = F.month(_c(d))
    return (
        F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").when(m.isin(9, 10, 11), "SON")
    )


def bin_label(d: Column | str, freq: str, origin: Column | str | None = None) -> Column:
    """Label of the calendar bin a day falls in.

    Multi-day bins start at ``origin`` (the first day of the series); weeks end
    on the Monday that labels them; quarters start in December.
    """
    d = _c(d)
    if freq in MINOR_BINS:
        n = MINOR_BINS[freq]
        o = _c(origin)
        return F.date_add(o, (F.floor(F.datediff(d, o) / n) * n).cast("int"))
    if freq == "week":
        return F.date_add(d, F.pmod(F.lit(9) - F.dayofweek(d), F.lit(7)))
    if freq == "month":
        return F.trunc(d, "month")
    if freq == "season":
        return F.add_months(F.trunc(F.add_months(d, 1), "quarter"), -1)
    if freq == "year":
        return F.trunc(d, "year")
    raise ValueError(f"unknown bin frequency {freq!r}")


def bin_sequence(first: Column, last: Column, freq: str) -> Column:
    """All bin labels between two labels, for filling empty bins."""
    step = {
        "2day": "interval 2 days", "3day": "interval 3 days", "week": "interval 7 days",
        "month": "interval 1 month", "season": "interval 3 months", "year": "interval 1 year",
    }[freq]
    return F.sequence(first, last, F.expr(step))
