"""Solar zenith angle as a column expression.

The sun's place is the published low-accuracy theory (mean longitude and anomaly, equation of the centre, aberration and the
main nutation term); its stated error is 0.01 degree in longitude over centuries around 2000, with some 0.002 degree more for
parallax, which is left out. The hour angle comes from sidereal time, so no table of the equation of time is needed.
Geometric angle: refraction is left out as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Polynomials in Julian centuries from 2000 January 1.5, in degrees.
LONGITUDE = (280.46646, 36000.76983, 0.0003032)
ANOMALY = (357.52911, 35999.05029, -0.0001537)
CENTRE = ((1.914602, -0.004817, -0.000014), (0.019993, -0.000101), (0.000289,))
NODE = (125.04, -1934.136)
OBLIQUITY = (23.439291, -0.0130042)
# Aberration, nutation in longitude and in obliquity, in degrees; sidereal degrees at the epoch and per day.
ABERRATION, NUTATION, NUTATION_OBLIQUITY = -0.00569, -0.00478, 0.00256
SIDEREAL = (280.46061837, 360.98564736629)
EPOCH = 946728000  # seconds from 1970 to 2000 January 1, 12:00 UTC


def _poly(c: tuple[float, ...], t: Column) -> Column:
    out = F.lit(c[0])
    for k, x in enumerate(c[1:], 1):
        term = t
        for _ in range(k - 1):
            term = term * t
        out = out + term * x
    return out


def solar_zenith(time: Column | str, lat: Column | str, lon: Column | str) -> Column:
    """Zenith angle in degrees from a UTC timestamp and degrees north/east."""
    at, lat, lon = (F.col(c) if isinstance(c, str) else c for c in (time, lat, lon))
    days = (F.unix_micros(at.cast("timestamp")) / 1e6 - EPOCH) / 86400.0
    t = days / 36525.0
    m, node = F.radians(_poly(ANOMALY, t)), F.radians(_poly(NODE, t))
    centre = F.sin(m) * _poly(CENTRE[0], t) + F.sin(m * 2) * _poly(CENTRE[1], t) + F.sin(m * 3) * _poly(CENTRE[2], t)
    apparent = F.radians(_poly(LONGITUDE, t) + centre + ABERRATION + F.sin(node) * NUTATION)
    tilt = F.radians(_poly(OBLIQUITY, t) + F.cos(node) * NUTATION_OBLIQUITY)
    ascension = F.atan2(F.cos(tilt) * F.sin(apparent), F.cos(apparent))
    decl = F.asin(F.sin(tilt) * F.sin(apparent))
    sidereal = F.radians(F.lit(SIDEREAL[0]) + days * SIDEREAL[1] + F.sin(node) * NUTATION * F.cos(tilt) + lon)
    phi = F.radians(lat)
    cosz = F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(sidereal - ascension)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosz))))
