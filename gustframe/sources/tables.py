"""Given parquet tables and the observation/prediction/metric views Spark derives from them.

The views are plain projections of ``events`` (no shuffle), so they scale with
the table and Catalyst prunes the columns each query needs down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def observations_from_events(events: DataFrame, *carried: str) -> DataFrame:
    """Station observations: 10 stations, wall-clock NTZ timestamps; ``carried`` event columns go along."""
    return _obs_with_raw(events, *carried).select("station_id", "obs_ts", "temperature_c", "wind_speed_ms",
                                        "precipitation_mm", "relative_humidity", "event_id", *carried)


def _obs_with_raw(events: DataFrame, *carried: str) -> DataFrame:
    """Observation columns plus the event columns the wide view needs (one projection)."""
    eid = F.col("event_id")
    return events.select(
        (F.lit(100) + F.col("user_id") % 10).cast("string").alias("station_id"),
        F.col("ts").alias("obs_ts"), eid.alias("event_id"), "event_type", "user_id", *carried,
        (_k() / 2 - 12.5).alias("temperature_c"),
        (F.col("value") / 16.0).alias("wind_speed_ms"),
        F.when(F.col("event_type") == "error", (eid % 32) / 4.0).otherwise(F.lit(0.0)).alias("precipitation_mm"),
        F.when((F.col("event_type") == "signup") & (eid % 7 == 0), F.lit(None).cast("double"))
        .otherwise((15 + (eid * 37) % 85).cast("double")).alias("relative_humidity"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations_from_events(table(spark, sf_dir, "events"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model predictions paired with actuals: model_name = event_type."""
    eid = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model_name"),
        eid.alias("event_id"),
        F.col("ts").alias("eval_ts"),
        F.col("value").alias("actual"),
        (F.col("value") + ((eid * 7) % 23 - 11) / 2.0).alias("prediction"),
        ((112 + eid % 16) / 128.0).alias("confidence"),
        (60 + eid % 41).cast("double").alias("data_quality"),
        (20 + F.col("user_id")).cast("double").alias("latency_ms"),
    )


def system_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-sample host metrics; error_count / prediction_count are per sample."""
    eid = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("string").alias("host"),
        eid.alias("event_id"),
        F.col("ts").alias("metric_ts"),
        _k().alias("cpu_usage"),
        ((eid * 53) % 100).cast("double").alias("memory_usage"),
        ((eid * 29) % 100).cast("double").alias("disk_usage"),
        (F.col("value") * 16).alias("prediction_latency"),
        F.lit(1).alias("prediction_count"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("error_count"),
    )



def max_value(df: DataFrame, col: str):
    """One scalar (e.g. ``as_of = max(ts)``) fetched to the driver as a literal."""
    return df.agg(F.max(col).alias("m")).first()["m"]


def observations_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide station rows (13 nullable measures) derived from ``events``."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    et = F.col("event_type")
    o = _obs_with_raw(ev)
    return o.select(
        "station_id", F.col("obs_ts"), "event_id",
        F.col("temperature_c").alias("temperature"), F.col("relative_humidity").alias("humidity"),
        F.when(eid % 11 == 0, F.lit(None)).otherwise(1000 + eid % 40).cast("double").alias("pressure"),
        F.col("wind_speed_ms").alias("wind_speed"),
        F.when(eid % 13 == 0, F.lit(None)).otherwise((eid * 7) % 360).cast("double").alias("wind_direction"),
        F.col("precipitation_mm").alias("precipitation_1h"),
        F.when(et == "click", F.lit(None)).otherwise(F.col("user_id") % 20).cast("double").alias("visibility"),
        F.when(et.isin("click", "view") & (eid % 3 == 0), F.lit(None)).otherwise(eid % 11).cast("double")
        .alias("cloud_cover"),
        (F.col("temperature_c") - 5).alias("dew_point"),
        (F.col("wind_speed_ms") * 1.5).alias("wind_gust"),
    )
