"""Catalog: the raw-text parsers run over whole tables rendered as landed text (SRC2, SRC3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gustframe.sources import tables as T
from gustframe.sources.text import (land_lines, lines_from_observations, parse_header_text, parse_positional_text,
                                    read_split_lines)
from gustframe.plans.registry import register

PARSED_SCHEMA = """station_id string, event_id bigint, obs_ts timestamp, temperature_c double, wind_speed_ms double,
precipitation_mm double, relative_humidity double, precipitation_type string"""

PARSED_SQL = """
SELECT station_id, event_id, date_trunc('minute', obs_ts) AS obs_ts, temperature_c, wind_speed_ms, precipitation_mm,
  relative_humidity, CASE WHEN NOT coalesce(precipitation_mm > 0, false) THEN 'none'
    WHEN temperature_c <= 2.0 THEN 'snow' ELSE 'rain' END AS precipitation_type
FROM $observations"""


@register("SRC2_header_text_parse", PARSED_SCHEMA, PARSED_SQL,
          ids=("SRC2", "STR1", "STR2", "DTM1", "PRJ2", "PRJ3"))
def q_header_parse(spark, sf):
    lines = lines_from_observations(T.observations(spark, sf), "compact")
    p = parse_header_text(lines)
    return p.select("station_id", F.col("line_no").alias("event_id"), "obs_ts", "temperature_c", "wind_speed_ms",
                    "precipitation_mm", "relative_humidity", "precipitation_type")


@register("SRC3_positional_text_parse", PARSED_SCHEMA, PARSED_SQL, ids=("SRC3", "STR1", "STR5"))
def q_positional_parse(spark, sf):
    lines = lines_from_observations(T.observations(spark, sf), "positional")
    p = parse_positional_text(lines)
    return p.select("station_id", F.col("line_no").alias("event_id"), "obs_ts", "temperature_c", "wind_speed_ms",
                    "precipitation_mm", "relative_humidity", "precipitation_type")


LANDED_SCHEMA = """station_id string, obs_ts timestamp, temperature_c double, wind_speed_ms double, precipitation_mm double,
relative_humidity double, precipitation_type string"""


@register("SRC1_2_landed_files", LANDED_SCHEMA, f"SELECT * EXCLUDE (event_id) FROM ({PARSED_SQL})", ids=("SRC1", "SRC2", "STR2"))
def q_landed_files(spark, sf):
    """The observations as landed text, one file per station and month, read back in ranges of lines and parsed: such a
    file grows with the table."""
    from gustframe.session import checkpoint_dir
    lines = lines_from_observations(T.observations(spark, sf), "compact")
    month = F.regexp_replace("file_path", r"/\d{2}/0000\.txt$", "/01/0000.txt")
    # a month's file has one header, before its lines
    lines = lines.withColumn("file_path", month).dropDuplicates(["file_path", "line_no", "value"])
    root = f"{checkpoint_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    land_lines(lines, root)
    return parse_header_text(read_split_lines(spark, root)).select(
        "station_id", "obs_ts", "temperature_c", "wind_speed_ms", "precipitation_mm", "relative_humidity", "precipitation_type")
