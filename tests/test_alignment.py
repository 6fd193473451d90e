"""Solar positions against published ones, overlap exclusion and run lengths against plain versions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.functions import arrays as ar
from seriesmith.functions.solar import solar_zenith
from seriesmith.operators import joins as jn

# Published apparent places of the sun. UTC time, declination and equation of time (degrees) where published.
EQUINOXES = ["2000-03-20 07:35:00", "2000-09-22 17:28:00", "2020-03-20 03:50:00", "2020-09-22 13:31:00"]
SOLSTICES = {"2000-06-21 01:48:00": 23.438, "2000-12-21 13:37:00": -23.438, "2020-06-20 21:44:00": 23.4366, "2020-12-21 10:02:00": -23.4366}
OCTOBER = ("1992-10-13 00:00:00", -7.78507, 3.427351)
# A published worked example of a full ephemeris: time, place, zenith angle with parallax and without refraction.
EXAMPLE = ("2003-10-17 19:30:30", 39.742476, -105.1786, 90 - 39.872046)


def zenith(spark, rows):
    df = spark.createDataFrame(rows, "t string, lat double, lon double")
    return [r.z for r in df.select(solar_zenith(F.to_timestamp("t"), "lat", "lon").alias("z")).collect()]


def test_zenith_of_the_published_example(spark):
    t, lat, lon, want = EXAMPLE
    assert zenith(spark, [(t, lat, lon)])[0] == pytest.approx(want, abs=0.01)


def test_declination_at_equinoxes_and_solstices(spark):
    """From the poles the sun stands at 90 degrees less, or plus, its declination, whatever the hour."""
    rows = [(t, lat, 0.0) for t in [*EQUINOXES, *SOLSTICES] for lat in (90.0, -90.0)]
    want = [90 - lat / 90 * d for d in [0.0] * len(EQUINOXES) + list(SOLSTICES.values()) for lat in (90.0, -90.0)]
    assert zenith(spark, rows) == pytest.approx(want, abs=0.01)


def test_thresholds_of_day_and_night(spark):
    """Where the published place of the sun gives 85, 90 and 96 degrees, so does the series, to 0.01 degree."""
    t, decl, equation = OCTOBER
    d = math.radians(decl)
    rows, want = [], []
    for lat in (0.0, 40.0, -35.0, 60.0):
        for z in (85.0, 90.0, 96.0):
            hour = math.degrees(math.acos((math.cos(math.radians(z)) - math.sin(math.radians(lat)) * math.sin(d)) / (math.cos(math.radians(lat)) * math.cos(d))))
            for side in (-1, 1):
                rows.append((t, lat, (180 - equation + side * hour + 180) % 360 - 180))  # at 0 h UTC the hour angle is lon - 180 + equation of time
                want.append(z)
    assert zenith(spark, rows) == pytest.approx(want, abs=0.01)


def test_run_lengths(spark):
    cases = [[True] * 5, [False, True, True, False, False, True], [None, True, None, True], [], [False], [True] * 2000]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, f array<boolean>")
    got = {r.i: list(r.x) for r in df.select("i", ar.run_lengths(F.col("f")).alias("x")).collect()}
    for i, c in enumerate(cases):
        run, want = 0, []
        for x in c:
            run = run + 1 if x else 0
            want.append(run)
        assert got[i] == want
    assert spark.createDataFrame([(None,)], "f array<boolean>").select(ar.run_lengths(F.col("f"))).first()[0] is None


@pytest.mark.parametrize("window", [0, 2, 13])
def test_overlap_exclusion_against_rounds(spark, window):
    rng = np.random.default_rng(window)
    rows = []
    for site in ("a", "b", None):
        for inst, n in (("x", 60), ("y", 60), ("z", 40), (None, 30)):
            for d in rng.choice(300, n, replace=False):
                rows.append((site, inst, dt.date(1969, 10, 1) + dt.timedelta(days=int(d)), None if rng.random() < 0.2 else float(d)))
    rows += [("a", "void", dt.date(1970, 1, 5), None), ("a", "x", None, 1.0), rows[0], ("alone", "x", dt.date(1970, 1, 1), None)]
    df = spark.createDataFrame(rows, "site string, instrument string, date date, value double")
    got = sorted(map(repr, (tuple(r) for r in jn.overlap_exclusion(df, ["site"], "instrument", window).collect())))
    want = []
    for site in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == site]
        valid = {i: sorted({r[2] for r in mine if r[1] == i and r[2] and r[3] is not None}) for i in {r[1] for r in mine}}
        order = sorted(valid, key=lambda i: (-len(valid[i]), valid[i][0] if valid[i] else dt.date.min, i is not None, i or ""))
        taken = []
        for rank, i in enumerate(order, 1):
            keep = [r for r in mine if r[1] == i and not (r[2] and any(abs((r[2] - t).days) <= window for t in taken))]
            want += [(*r, rank) for r in keep]
            taken += [r[2] for r in keep if r[2] and r[3] is not None]
    assert got == sorted(map(repr, want))
