"""Level-3 and level-4 products as one call, and the guards on their inputs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.operators import aggregate as ag
from seriesmith.operators import clean as cl
from seriesmith.operators import joins as jn
from seriesmith.operators import products as pr
from seriesmith.sources import catalog as cat

D0 = dt.date(2001, 1, 1)


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(1)
    rows = []
    for site, inst, days in (("a", "x", 1100), ("a", "y", 1100), ("b", "x", 1100), ("few", "x", 90)):
        for d in range(0, days):
            date = D0 + dt.timedelta(days=d)
            season = 10 * np.sin(2 * np.pi * (date.timetuple().tm_yday) / 365)
            rows.append((site, inst, dt.datetime.combine(date, dt.time(12)), float(50 + (5 if inst == "y" else 0) + season + 0.01 * d + 0.1 * rng.normal())))
    return spark.createDataFrame(rows, "site string, instrument string, time timestamp, value double").cache()


def three(samples):
    return pr.level3(samples, "2001-01-01", "2003-12-31", min_samples=1, per_instrument=300, per_site=600, freqs=("3day", "month"))


def test_level3_chain(spark, samples):
    out = three(samples)
    sites = {r.site for r in out.daily.select("site").distinct().collect()}
    assert sites == {"a", "b"}  # too few days
    assert out.daily.where("month(date) = 2 and dayofmonth(date) = 29").isEmpty()
    # by hand: daily minus the instrument's climatology, then means of bins
    clim = {(r.site, r.instrument, r.doy): r.value for r in out.climatology.collect()}
    assert {k[1] for k in clim} == {"x", "y", "site"}
    for r in out.anomaly.limit(200).collect():
        assert r.anomaly == pytest.approx(r.value - clim[r.site, r.instrument, r.doy])
    month = {(r.site, r.instrument, r.bin): r for r in out.bins.where("freq = 'month'").collect()}
    days = [r for r in out.anomaly.collect() if (r.site, r.instrument, r.date.year, r.date.month) == ("a", "y", 2002, 5)]
    got = month["a", "y", dt.date(2002, 5, 1)]
    assert got.anomaly == pytest.approx(np.mean([r.anomaly for r in days]))
    grand = np.mean([v for (s, i, _), v in clim.items() if (s, i) == ("a", "y")])
    assert got.deseasonalized == pytest.approx(grand + got.anomaly) and got.seasonal == pytest.approx(clim["a", "y", 121] + got.anomaly)
    assert out.running.count() == out.anomaly.count() and out.seasons.count() > 0


def test_level4_finds_the_trend(spark, samples):
    out = three(samples)
    bins = out.bins.where("freq = '3day'").select("site", "condition", "instrument", "freq", F.col("bin").alias("date"), F.col("deseasonalized").alias("value"))
    gran = spark.createDataFrame([("a", "3day"), ("b", "3day")], "site string, freq string")
    got = pr.level4(bins, gran, out.daily.select("site", "date", "value"), first="2001-01-01", last="2003-12-31", n_points=11)
    rows = {r.site: r for r in got.trends.collect()}
    assert set(rows) == {"a", "b"}
    for r in rows.values():
        assert r.ss == 95 and r.slope == pytest.approx(3.65, abs=0.4) and r.lower_2s < r.slope < r.upper_2s
        assert r.slope_rel == pytest.approx(r.slope / 55, rel=0.2)
    assert got.distribution.groupBy("site").count().collect() and {r.kind for r in got.segments.select("kind").distinct().collect()} == {"month", "season"}
    with pytest.raises(ValueError, match="unsupported frequency"):
        pr.level4(bins, gran.withColumn("freq", F.lit("hourly")), out.daily)
    with pytest.raises(ValueError, match="unknown site 'nowhere'"):
        pr.level4(bins, spark.createDataFrame([("nowhere", "3day")], gran.schema), out.daily)


def test_guards(spark, samples):
    with pytest.raises(ValueError, match="reference period 1901"):
        pr.level3(samples, "1901-01-01", "1902-01-01", min_samples=1, per_instrument=300, per_site=600)
    daily = samples.select("site", F.to_date("time").alias("date"), "value")
    assert ag.reference_period(daily, "1901-01-01", "1902-01-01").isEmpty()  # without the demand it is just empty
    with pytest.raises(ValueError, match="no rows in the catalogue"):
        cat.in_order(spark.createDataFrame([], "site string, path string"), ["site"], ["path"])
    with pytest.raises(ValueError, match="unsupported frequency None"):
        cl.choose_granularity(daily.withColumn("freq", F.lit("3day")), spark.createDataFrame([("a", None)], "site string, freq string"))


def test_mask_by_zenith(spark):
    s = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), (None, 1, 3.0), ("b", 1, 4.0)], "site string, t int, value double")
    z = spark.createDataFrame([("a", 1, 60.0), ("a", 1, 95.0), ("a", 2, 60.0), (None, 1, 99.0)], "site string, t int, z double")
    got = {(r.site, r.t): r.value for r in jn.mask_by_zenith(s, z, ["site", "t"], F.col("z") > 90).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): None, (None, 1): 3.0, ("b", 1): None}
