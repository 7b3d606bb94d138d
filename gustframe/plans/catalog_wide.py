"""Catalog: wide-row core features and quality (PRJ4, DQ11, DQ12, ARR1, PRJ7, FLT3),
importance ranking (SRT6), frame confidence (FTR9), anomaly share (FTR10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustframe.operators import rowquality as RQ
from gustframe.operators.frames import tumbling
from gustframe.plans.registry import register
from gustframe.sources import tables as T


def _core(spark, sf):
    as_of = T.max_value(T.table(spark, sf, "events"), "ts")
    return RQ.core_features(T.observations_wide(spark, sf), as_of), as_of


CORE_SCHEMA = """station_id string, obs_ts timestamp, event_id bigint, data_quality double, temperature_c double,
relative_humidity_pct double, precipitation_mm_1h double, wind_speed_ms double, pressure_hpa double,
visibility_km double, wind_direction_deg double, cloud_cover_tenths double, feature_completeness double,
feature_reliability double, conditions_text string, severity_level int, feature_count int, passes_quality boolean"""


@register("PRJ4_DQ11_12_core_features", CORE_SCHEMA, """
SELECT * EXCLUDE (weather_conditions), array_to_string(weather_conditions, ', ') AS conditions_text,
  len(weather_conditions) AS severity_level FROM $core_rows""",
          ids=("PRJ4", "DQ11", "DQ12", "ARR1", "PRJ7", "FLT3", "DTM9", "STR4"))
def q_core(spark, sf):
    c, _ = _core(spark, sf)
    return c.withColumn("conditions_text", F.array_join("weather_conditions", ", "))


@register("SRT6_importance_ranking", "feature string, importance double, coverage double, rank int", """
SELECT feature, importance, coverage, CAST(rank() OVER (ORDER BY importance DESC) AS INTEGER) AS rank FROM (
  SELECT 'temperature_c' AS feature, 1.0 AS importance, count(temperature_c) / count(*) AS coverage FROM $core_rows
  UNION ALL SELECT 'precipitation_mm_1h', 0.95, count(precipitation_mm_1h) / count(*) FROM $core_rows
  UNION ALL SELECT 'relative_humidity_pct', 0.85, count(relative_humidity_pct) / count(*) FROM $core_rows
  UNION ALL SELECT 'wind_speed_ms', 0.80, count(wind_speed_ms) / count(*) FROM $core_rows
  UNION ALL SELECT 'visibility_km', 0.70, count(visibility_km) / count(*) FROM $core_rows
  UNION ALL SELECT 'pressure_hpa', 0.60, count(pressure_hpa) / count(*) FROM $core_rows
  UNION ALL SELECT 'wind_direction_deg', 0.50, count(wind_direction_deg) / count(*) FROM $core_rows
  UNION ALL SELECT 'cloud_cover_tenths', 0.45, count(cloud_cover_tenths) / count(*) FROM $core_rows)""",
          ids=("SRT6",))
def q_ranking(spark, sf):
    c, _ = _core(spark, sf)
    return RQ.importance_ranking(c)


@register("FTR9_frame_confidence", "station_id string, window_start timestamp, feature_confidence double", """
SELECT station_id, window_start,
  greatest(0, least(1, 1.0 * (q / 100.0) * (c / 100.0) * (CASE WHEN age <= 1 THEN 1.0 WHEN age <= 3 THEN 0.8
    WHEN age <= 6 THEN 0.6 ELSE 0.3 END))) AS feature_confidence
FROM (SELECT station_id, time_bucket(INTERVAL 3 HOUR, obs_ts, TIMESTAMP '1970-01-01') AS window_start,
        avg(data_quality) AS q, avg(feature_completeness) AS c,
        (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(obs_ts))) / 3.6e9 AS age
      FROM $core_rows GROUP BY ALL)""", ids=("FTR9", "DTM9"))
def q_confidence(spark, sf):
    c, as_of = _core(spark, sf)
    return RQ.frame_confidence(tumbling(c), as_of)


@register("FTR10_tail_anomaly_share", "station_id string, n_rows bigint, flagged bigint, anomaly_score double", """
WITH m AS (SELECT station_id, median(temperature_c) AS med FROM $observations GROUP BY station_id),
d AS (SELECT o.station_id, abs(o.temperature_c - m.med) AS dist FROM $observations o JOIN m USING (station_id)),
c AS (SELECT station_id, quantile_cont(dist, 0.9) AS cut FROM d GROUP BY station_id)
SELECT station_id, count(*) AS n_rows, count(*) FILTER (WHERE dist > cut) AS flagged,
  1 - count(*) FILTER (WHERE dist > cut) / count(*) AS anomaly_score
FROM d JOIN c USING (station_id) GROUP BY station_id""", ids=("JN3",))
def q_anomaly(spark, sf):
    return RQ.tail_anomaly_score(T.observations(spark, sf))


@register("FTR10_isolation_forest", "station_id string, n_rows bigint, flagged bigint, anomaly_score double", None, ids=("FTR10",))
def q_isolation_forest(spark, sf):
    from gustframe.operators.isolation import anomaly_share
    return anomaly_share(T.observations(spark, sf))
