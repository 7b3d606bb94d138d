"""Golden frames (the reference's unit tests, with the formula's value where its test is wrong)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gustframe.operators.frames import with_precipitation_type
from gustframe.operators.scores import frame_features

SCHEMA = "station_id string, obs_ts timestamp_ntz, temperature_c double, wind_speed_ms double, precipitation_mm double, relative_humidity double"


def _score(spark, rows):
    t0 = dt.datetime(2023, 1, 1, 8, 0)
    data = [("108", t0 + dt.timedelta(hours=i), *[float(x) for x in r]) for i, r in enumerate(rows)]
    df = with_precipitation_type(spark.createDataFrame(data, SCHEMA)).withColumn("window_start", F.lit(t0))
    return frame_features(df, keys=("station_id", "window_start")).first()


def test_mild_frame_formula_value(spark):
    r = _score(spark, [(18, 3.2, 0, 55), (19.5, 3.8, 0, 53), (21, 4.2, 0, 50)])
    assert r.baseline_comfort_score == pytest.approx(99.4)
    assert r.label_bucket == "excellent"


def test_cold_frame(spark):
    r = _score(spark, [(-5, 2, 0, 40)] * 3)
    assert r.penalty_temperature == pytest.approx(37.5)
    assert r.baseline_comfort_score == pytest.approx(62.5)
    assert r.label_bucket == "good"


def test_rain_and_snow_caps(spark):
    # two rain rows + one snow row at T 12 (type forced to snow for the third row)
    t0 = dt.datetime(2023, 1, 1, 8, 0)
    data = [("108", t0 + dt.timedelta(hours=i), 12.0, 0.0, 1.0, 50.0) for i in range(3)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("window_start", F.lit(t0))
    df = df.withColumn("precipitation_type", F.when(F.col("obs_ts") == F.lit(t0 + dt.timedelta(hours=2)), "snow")
                       .otherwise("rain"))
    r = frame_features(df, keys=("station_id", "window_start")).first()
    assert r.penalty_precipitation == pytest.approx(35.0)
    assert r.baseline_comfort_score == pytest.approx(65.0)
    assert r.label_bucket == "good"


def test_precipitation_type_boundaries(spark):
    rows = [(2.0, 1.0), (0.0, 1.0), (2.1, 1.0), (None, 1.0), (-3.0, 0.0)]
    df = spark.createDataFrame(rows, "temperature_c double, precipitation_mm double")
    got = [r.precipitation_type for r in with_precipitation_type(df).collect()]
    assert got == ["snow", "snow", "rain", "rain", "none"]
