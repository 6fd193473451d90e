"""Level-1 and level-2 products as one call, against values worked out by hand."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.operators import levels as lv
from seriesmith.operators import profile as pf
from seriesmith.plans import q_levels
from seriesmith.plans.q_columns import columns

T0 = dt.datetime(2015, 3, 1)
SCHEMA = ("file string, site string, network string, label string, k long, time timestamp, backscatter array<double>, range array<double>, range_units string, "
          "alt double, tilt_angle double, scaling double, laser double")


def source(spark, rows):
    base = dict(file="f", site="x", network="arm", label="LD40", k=0, time=T0, backscatter=[1.0] * 30, range=[0.03 * (i + 1) for i in range(30)],
                range_units="km", alt=100.0, tilt_angle=60.0, scaling=2.0, laser=100.0)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], SCHEMA)


def test_level1_chain(spark):
    rows = [
        dict(k=1), dict(k=2, backscatter=[9.0] * 30),  # the same time again: the first row stays
        dict(k=3, time=T0 + dt.timedelta(seconds=30), laser=10.0),  # bad status
        dict(k=4, time=T0 + dt.timedelta(seconds=60), backscatter=[None] * 30),  # empty
        dict(k=5, time=T0 + dt.timedelta(seconds=90), alt=120.0, scaling=6.0),
        dict(file="g", k=6, label="nothing known"),
        dict(file=None, k=7, network="niwa", alt=None, tilt_angle=None),
    ]
    out = lv.level1(source(spark, rows), ["file"], "k", calibration=3.0, status="laser", noise_min=1e-12, keep_above=8e-6)
    got = {r.k: r for r in out.collect()}
    assert set(got) == {1, 5, 7}
    one = got[1]
    # median altitude 100 of 100, 100, 100, 120; 30 m gates seen under 60 degrees
    assert one.altitude == 100.0 and one.height[0] == pytest.approx(100.0 + 30.0 * 0.5) and one.range[1] == pytest.approx(60.0)
    assert one.instrument == "LD40" and one.recorded_scaling == 2.0 and one.calibration_factor == pytest.approx(3.0 * 2.45)
    assert one.beta_raw[0] == pytest.approx(3.0 * 2.45) and one.range_corrected
    # the null file is a file of its own, its network arrives calibrated
    assert got[7].calibration_factor == 1.0 and got[7].altitude == 0.0 and got[7].height[0] == pytest.approx(30.0)


def test_level1_undoes_the_recorded_scaling_and_uncorrected_networks(spark):
    rows = [dict(k=1, network="cloudnet", site="chilbolton", time=dt.datetime(2014, 1, 1)), dict(file="g", k=2, network="cloudnet", site="chilbolton")]
    got = {r.k: r for r in lv.level1(source(spark, rows), ["file"], "k", undo_recorded=True, noise_min=1e-12).collect()}
    assert got[1].calibration_factor == pytest.approx(2.45 / 2.0)
    # before December 2014 this station's data are not corrected: (0.03 km) squared at the first gate
    assert got[1].beta_raw[0] == pytest.approx(2.45 / 2.0 * 0.03**2) and got[2].beta_raw[0] == pytest.approx(2.45 / 2.0)


def test_level1_of_nothing(spark):
    assert lv.level1(source(spark, []), ["file"], "k").count() == 0


def test_level2_profiles_keep_the_day_and_the_first_of_a_time(spark):
    x = np.zeros(60)
    x[28:33] = [1e-5, 6e-5, 9e-5, 6e-5, 1e-5]
    h = [float(10 * (i + 1) + 50) for i in range(60)]
    day = dt.date(2020, 1, 1)
    rows = [("f", day, dt.datetime(2020, 1, 1, 5), 1, x.tolist(), h), ("f", day, dt.datetime(2020, 1, 1, 5), 2, (x * 0).tolist(), h),
            ("f", day, dt.datetime(2020, 1, 2, 0), 3, (x * 0).tolist(), h), ("f", day, dt.datetime(2020, 1, 2, 1), 4, x.tolist(), h)]
    d = spark.createDataFrame(rows, "file string, day date, time timestamp, k long, beta array<double>, height array<double>")
    out = lv.level2_profiles(d.withColumns({"altitude": F.lit(50.0), "fog_flag": F.lit(True)}), ["file"], "k")
    got = {r.k: r for r in out.collect()}
    assert set(got) == {1, 3}  # both midnights belong to the day, 01:00 of the next does not
    assert got[1].cloud_flag == 1 and got[1].low_cloud_flag == 1 and got[1].fog_flag == 0  # a low base is no fog
    assert got[1].cloud_base_height_agl == got[1].cloud_base_height_asl - 50
    assert got[3].cloud_flag == 0 and got[3].fog_flag == 1 and got[3].low_cloud_flag is None and got[3].cloud_base_height_asl is None
    assert "beta" not in out.columns and "mask" not in out.columns


def test_level2_columns_fog_and_bases(spark):
    n = 4
    row = ([10.0, 500.0, 1500.0, 6000.0], [1.0, 0.0, None, 0.5], [1e-4, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1e-4], 0.0, float(np.log(1e5)), [0.0] * (n + 1), [1.0, 0.95, 0.85, 0.5, 0.1], 60.0)
    d = spark.createDataFrame([row], "height array<double>, cc array<double>, clwc array<double>, ciwc array<double>, surface double, lnsp double, a array<double>, b array<double>, lat double")
    r = lv.level2_columns(d).first()
    assert (r.base, r.base_liquid, r.base_ice, r.base_agl, r.fog_cover) == (10.0, 10.0, 6000.0, 10.0, 1.0)
    assert r.low_all == 1.0 and r.low_ice == 0.0 and r.low_pressure == pytest.approx(1.0) and r.low_non_obscured == pytest.approx(1.0)


def test_level2_columns_leave_nearly_full_covers_out(spark, tmp_path):
    """Cover 0.3 at 80 m under 0.9, 0.9995 and 1 at 3560 m: the query has no quotient from 0.999 on, the operator only at 1."""
    rows = []
    for k, above in ((4, 0.9), (9, 0.9995), (14, 1.0)):  # ids whose surface pressure (893 hPa) makes the lowest level a low one
        v = [0.0] * 64
        v[0], v[58] = 0.2, above / 3 if above < 1 else 0.5
        rows.append((k, v))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    z0 = (0.75 + 2.149 * np.cos(np.radians([-76.0, -71.0])) ** 2) * 1e3
    want = 0.3 * (1 - np.exp(-3480.0 / z0))
    got = {r.id: r.low_non_obscured for r in q_levels.pipe_level2_columns(spark, str(tmp_path)).collect()}
    assert got == {4: pytest.approx(want[0], abs=1e-5), 9: None, 14: None}
    own = {r.id: r.low_non_obscured for r in lv.level2_columns(columns(spark, str(tmp_path)), dense=0.1).collect()}
    assert own == {4: pytest.approx(want[0], abs=1e-6), 9: pytest.approx(want[1], abs=1e-6), 14: None}


def test_level2_layers(spark):
    rows = [(1, 4, 0.2), (1, 5, 0.6), (1, 3, 0.9), (2, 4, 0.3), (None, 4, 0.5), (None, 5, 1.0), (3, 4, 0.0), (3, 5, 1.0)]
    d = spark.createDataFrame(rows, "k long, layer int, obs double")
    got = {r.k: r for r in lv.level2_layers(d, ["k"], ["obs"]).collect()}
    assert got[1].obs_non_obscured == pytest.approx(0.2 / 0.6) and got[None].obs_non_obscured == pytest.approx(1.0)
    assert got[2].obs_total is None and got[2].obs_non_obscured is None and got[3].obs_non_obscured is None
    with pytest.raises(Exception, match="conflicting source products"):
        lv.level2_layers(d.union(d.limit(1)), ["k"], ["obs"]).collect()


def test_smoothing_of_long_profiles():
    """1,500 gates against a full convolution; a missing gate takes out what it reaches and no more."""
    x = np.random.default_rng(5).normal(size=(512, 1500))
    x[3, 700] = np.nan
    got = pf.smooth_gates(x, np.where(np.arange(512) % 2, 2.0, 0.5))
    w = np.exp(-(np.arange(-8, 9) ** 2) / 8.0)
    want = np.convolve(np.pad(x[1], 8, mode="symmetric"), w / w.sum(), "valid")
    np.testing.assert_allclose(got[1], want, atol=1e-12)
    assert np.isnan(got[3]).sum() == 17 and not np.isnan(np.delete(got, 3, 0)).any()
