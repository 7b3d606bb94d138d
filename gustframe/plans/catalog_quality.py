"""Catalog: data-quality checks, summary grade, score and gate (DQ1-DQ10)."""

from __future__ import annotations

from gustframe.operators.quality import MEASURES, RANGES, dq_checks, dq_summary
from gustframe.plans.registry import register, sql_view
from gustframe.sources import tables as T


def _dq_sql() -> str:
    aggs = ["count(*) AS n", "count(*) FILTER (WHERE obs_ts IS NULL) AS ts_null",
            "count(*) - count(DISTINCT obs_ts) AS dup",
            "count(*) FILTER (WHERE precipitation_mm > 0 AND relative_humidity < 60) AS incons"]
    for c in MEASURES:
        lo, hi = RANGES[c]
        aggs += [f"count(*) FILTER (WHERE {c} IS NULL) AS {c}__null",
                 f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS {c}__oor",
                 f"count({c}) AS {c}__nn",
                 f"count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) AS {c}__text",
                 f"quantile_cont({c}, 0.25) AS {c}__q1", f"quantile_cont({c}, 0.75) AS {c}__q3"]
    outs = [f"count(*) FILTER (WHERE o.{c} < b.{c}__q1 - 1.5 * (b.{c}__q3 - b.{c}__q1) "
            f"OR o.{c} > b.{c}__q3 + 1.5 * (b.{c}__q3 - b.{c}__q1)) AS {c}__out" for c in MEASURES]
    rows = [
        "SELECT station_id, 'basic_structure' AS name, CASE WHEN n = 0 THEN 'critical' ELSE 'info' END AS severity, n >= 1 AS passed, n AS issue_count, NULL AS ratio FROM w",
        "SELECT station_id, 'timestamp_format', CASE WHEN ts_null > 0 THEN 'error' ELSE 'info' END, ts_null = 0, ts_null, NULL FROM w",
    ]
    for c in MEASURES:
        rows.append(f"SELECT station_id, '{c}_numeric', CASE WHEN {c}__text > 0 THEN 'warning' ELSE 'info' END, {c}__text = 0, {c}__text, NULL FROM w")
    for c in MEASURES:
        rows.append(f"SELECT station_id, '{c}_range', CASE WHEN {c}__oor > 0 THEN 'warning' ELSE 'info' END, {c}__oor = 0, {c}__oor, NULL FROM w")
    rows.append("SELECT station_id, 'temporal_continuity', CASE WHEN n_gaps > 0 AND irregular_count > 0 THEN 'warning' ELSE 'info' END, n_gaps = 0 OR irregular_count = 0, irregular_count, NULL FROM w")
    rows.append("SELECT station_id, 'missing_obs_ts', CASE WHEN ts_null > 0 THEN 'critical' ELSE 'info' END, ts_null = 0, ts_null, ts_null / n * 100 FROM w")
    rows.append("SELECT station_id, 'missing_temperature_c', CASE WHEN temperature_c__null > 0 THEN 'critical' ELSE 'info' END, temperature_c__null = 0, temperature_c__null, temperature_c__null / n * 100 FROM w")
    for c in ("wind_speed_ms", "precipitation_mm"):
        rows.append(f"SELECT station_id, 'missing_{c}', CASE WHEN {c}__null / n * 100 > 20 THEN 'warning' ELSE 'info' END, {c}__null / n * 100 <= 20, {c}__null, {c}__null / n * 100 FROM w")
    rows.append("SELECT station_id, 'missing_relative_humidity', 'info', true, relative_humidity__null, relative_humidity__null / n * 100 FROM w")
    for c in MEASURES:
        r = f"({c}__out * 100.0 / {c}__nn)"
        rows.append(f"SELECT station_id, 'outliers_{c}', CASE WHEN {c}__nn < 4 THEN 'info' WHEN {r} > 10 THEN 'warning' ELSE 'info' END, "
                    f"{c}__nn < 4 OR {r} <= 10, CASE WHEN {c}__nn < 4 THEN 0 ELSE {c}__out END, CASE WHEN {c}__nn >= 4 THEN {r} END FROM w")
    rows.append("SELECT station_id, 'humidity_precipitation_consistency', CASE WHEN incons > 0 THEN 'warning' ELSE 'info' END, incons = 0, incons, incons / n * 100 FROM w")
    rows.append("SELECT station_id, 'duplicate_timestamps', CASE WHEN dup > 0 THEN 'error' ELSE 'info' END, dup = 0, dup, NULL FROM w")
    return f"""
WITH b AS (SELECT station_id, {', '.join(aggs)} FROM $observations GROUP BY station_id),
o2 AS (SELECT o.station_id, {', '.join(outs)} FROM $observations o JOIN b USING (station_id) GROUP BY o.station_id),
g AS (SELECT station_id, count(gap) AS n_gaps,
        count(*) FILTER (WHERE gap < 1 - 10 / 60.0 OR gap > 1 + 10 / 60.0) AS irregular_count
      FROM (SELECT station_id, (epoch_us(obs_ts) - epoch_us(lag(obs_ts) OVER (PARTITION BY station_id ORDER BY obs_ts, event_id))) / 3.6e9 AS gap
            FROM $observations) GROUP BY station_id),
w AS (SELECT * FROM b JOIN o2 USING (station_id) JOIN g USING (station_id))
""" + "\nUNION ALL\n".join(rows)


sql_view("dq_checks", _dq_sql())

DQ_SCHEMA = "station_id string, name string, severity string, passed boolean, issue_count bigint, ratio double"


@register("DQ1_8_quality_checks", DQ_SCHEMA, "SELECT * FROM $dq_checks",
          ids=("DQ1", "DQ2", "DQ3", "DQ4", "DQ5", "DQ6", "DQ7", "DQ8", "AGG9", "SET3", "JN3", "JN8"))
def q_dq_checks(spark, sf):
    return dq_checks(T.observations(spark, sf))


SUMMARY_SCHEMA = """station_id string, total_checks bigint, passed_checks bigint, failed_checks bigint,
info_count bigint, warning_count bigint, error_count bigint, critical_count bigint,
overall_quality string, quality_score double, validation_passed boolean"""

SUMMARY_SQL = """
SELECT *, CASE WHEN critical_count > 0 THEN 'critical' WHEN error_count > 0 THEN 'poor'
               WHEN warning_count > total_checks * 0.3 THEN 'fair' ELSE 'good' END AS overall_quality,
  CASE WHEN critical_count > 0 THEN 0 WHEN error_count > 0 THEN greatest(0, 40 - 10 * error_count)
       ELSE passed_checks / total_checks * 100 END AS quality_score,
  critical_count = 0 AND error_count = 0 AS validation_passed
FROM (SELECT station_id, count(*) AS total_checks, count(*) FILTER (WHERE passed) AS passed_checks,
        count(*) FILTER (WHERE NOT passed) AS failed_checks,
        count(*) FILTER (WHERE severity = 'info') AS info_count,
        count(*) FILTER (WHERE severity = 'warning') AS warning_count,
        count(*) FILTER (WHERE severity = 'error') AS error_count,
        count(*) FILTER (WHERE severity = 'critical') AS critical_count
      FROM $dq_checks GROUP BY station_id)"""


@register("DQ9_10_quality_summary", SUMMARY_SCHEMA, SUMMARY_SQL, ids=("DQ9", "DQ10", "AGG20"))
def q_dq_summary(spark, sf):
    return dq_summary(dq_checks(T.observations(spark, sf)))


@register("FTR8_DQ10_window_features", """station_id string, window_start timestamp, window_end timestamp, n_obs bigint,
temp_median_3h double, temp_range_3h double, wind_peak_3h double, precip_total_3h double, precip_type_dominant string,
humidity_avg_3h double, baseline_comfort_score double, label_bucket string, target_period string, quality_score double,
validation_passed boolean, data_version string""", f"""
SELECT f.station_id, f.window_start, f.window_end, f.n_obs, f.temp_median_3h, f.temp_range_3h, f.wind_peak_3h,
  f.precip_total_3h, f.precip_type_dominant, f.humidity_avg_3h, f.baseline_comfort_score, f.label_bucket, f.target_period,
  s.quality_score, s.validation_passed, 'v1' AS data_version
FROM $frame_table f JOIN ({SUMMARY_SQL}) s USING (station_id)""", ids=("FTR8", "DQ10", "PIP1"))
def q_window_features(spark, sf):
    from gustframe.plans import common as X
    from pyspark.sql import functions as F
    summary = dq_summary(dq_checks(T.observations(spark, sf))).select("station_id", "quality_score", "validation_passed")
    f = X.frame_table(spark, sf).join(summary, on="station_id", how="inner")
    return f.withColumn("data_version", F.lit("v1"))
