"""Spark-side fixture plumbing shared by the catalog modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gustframe.operators.frames import tumbling, with_precipitation_type
from gustframe.operators.scores import frame_features
from gustframe.sources import tables as T

FRAME_SCHEMA = (
    "station_id string, window_start timestamp, window_end timestamp, n_obs bigint, "
    "temp_median_3h double, temp_range_3h double, wind_peak_3h double, precip_total_3h double, "
    "precip_type_dominant string, humidity_avg_3h double, rain_total double, snow_total double, "
    "penalty_temperature double, penalty_precipitation double, penalty_wind double, "
    "penalty_humidity double, baseline_comfort_score double, label_bucket string, target_period string"
)


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Observation view + PRJ3 precipitation type."""
    return with_precipitation_type(T.observations(spark, sf))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Observations tagged with their tumbling 3-hour frame."""
    return tumbling(obs(spark, sf))


def frame_table(spark: SparkSession, sf: str) -> DataFrame:
    return frame_features(frames(spark, sf))
