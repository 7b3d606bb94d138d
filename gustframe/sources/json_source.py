"""JSON observation payloads (SRC4): ``{"observations": [{...}, ...]}`` per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBS_JSON_SCHEMA = ("observations ARRAY<STRUCT<timestamp STRING, temperature_c DOUBLE, wind_speed_ms DOUBLE, "
                   "precipitation_mm DOUBLE, relative_humidity DOUBLE, condition_code STRING, "
                   "precipitation_type STRING>>")


def read_observations_json(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Missing precipitation -> 0, missing type -> 'none'; malformed input fails (FAILFAST)."""
    df = spark.read.schema(OBS_JSON_SCHEMA).option("multiLine", "true").option("mode", mode).json(path)
    o = df.select(F.col("_metadata.file_path").alias("file_path"),
                  F.explode("observations").alias("o")).select("file_path", "o.*")
    return o.select(
        "file_path",
        F.col("timestamp").try_cast("timestamp_ntz").alias("obs_ts"),
        "temperature_c", "wind_speed_ms",
        F.coalesce("precipitation_mm", F.lit(0.0)).alias("precipitation_mm"),
        "relative_humidity", "condition_code",
        F.coalesce("precipitation_type", F.lit("none")).alias("precipitation_type"),
    )
