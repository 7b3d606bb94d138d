"""DuckDB text of the fixture views, used only by the oracle side of the catalog.

``$name`` placeholders in oracle SQL expand to these subqueries.
"""

from gustframe.plans.registry import sql_view

K = "json_extract_string(props, '$.k')"

sql_view("observations", f"""
SELECT CAST(100 + user_id % 10 AS VARCHAR) AS station_id, ts AS obs_ts,
  CAST({K} AS DOUBLE) / 2 - CAST(12.5 AS DOUBLE) AS temperature_c,
  value / CAST(16 AS DOUBLE) AS wind_speed_ms,
  CASE WHEN event_type = 'error' THEN (event_id % 32) / CAST(4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS precipitation_mm,
  CASE WHEN event_type = 'signup' AND event_id % 7 = 0 THEN NULL
       ELSE CAST(15 + (event_id * 37) % 85 AS DOUBLE) END AS relative_humidity,
  event_id FROM events""")

sql_view("predictions", """
SELECT event_type AS model_name, event_id, ts AS eval_ts, value AS actual,
  value + ((event_id * 7) % 23 - 11) / CAST(2 AS DOUBLE) AS prediction,
  (112 + event_id % 16) / CAST(128 AS DOUBLE) AS confidence,
  CAST(60 + event_id % 41 AS DOUBLE) AS data_quality, CAST(20 + user_id AS DOUBLE) AS latency_ms FROM events""")

sql_view("system_metrics", f"""
SELECT CAST(user_id % 10 AS VARCHAR) AS host, event_id, ts AS metric_ts,
  CAST({K} AS DOUBLE) AS cpu_usage, CAST((event_id * 53) % 100 AS DOUBLE) AS memory_usage,
  CAST((event_id * 29) % 100 AS DOUBLE) AS disk_usage, value * 16 AS prediction_latency,
  1 AS prediction_count, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error_count FROM events""")

# observations + precipitation type (PRJ3)
sql_view("obs", """
SELECT *, CASE WHEN NOT coalesce(precipitation_mm > 0, false) THEN 'none'
               WHEN temperature_c IS NOT NULL AND temperature_c <= 2.0 THEN 'snow' ELSE 'rain' END
          AS precipitation_type
FROM $observations""")

# tumbling 3-hour frames (epoch aligned, as Spark's window())
sql_view("frames3h", """
SELECT *, time_bucket(INTERVAL 3 HOUR, obs_ts, TIMESTAMP '1970-01-01') AS window_start,
       time_bucket(INTERVAL 3 HOUR, obs_ts, TIMESTAMP '1970-01-01') + INTERVAL 3 HOUR AS window_end
FROM $obs""")

# one row per frame: AGG1 + AGG2 + AGG4 + SCR1 (the flagship table)
sql_view("frame_table", """
SELECT a.*, d.precip_type_dominant, p.*,
  greatest(0, 100 - (penalty_temperature + penalty_precipitation + penalty_wind + penalty_humidity))
    AS baseline_comfort_score,
  CASE WHEN greatest(0, 100 - (penalty_temperature + penalty_precipitation + penalty_wind + penalty_humidity)) >= 80 THEN 'excellent'
       WHEN greatest(0, 100 - (penalty_temperature + penalty_precipitation + penalty_wind + penalty_humidity)) >= 60 THEN 'good'
       WHEN greatest(0, 100 - (penalty_temperature + penalty_precipitation + penalty_wind + penalty_humidity)) >= 50 THEN 'uncomfortable'
       ELSE 'harsh' END AS label_bucket,
  CASE WHEN hour(a.window_end) BETWEEN 14 AND 19 THEN 'evening' ELSE 'morning' END AS target_period
FROM (
  SELECT station_id, window_start, window_end, count(*) AS n_obs,
    median(temperature_c) AS temp_median_3h, max(temperature_c) - min(temperature_c) AS temp_range_3h,
    max(wind_speed_ms) AS wind_peak_3h, coalesce(sum(precipitation_mm), 0) AS precip_total_3h,
    avg(relative_humidity) AS humidity_avg_3h,
    coalesce(sum(CASE WHEN precipitation_mm > 0 AND precipitation_type <> 'snow' THEN precipitation_mm END), 0) AS rain_total,
    coalesce(sum(CASE WHEN precipitation_mm > 0 AND precipitation_type = 'snow' THEN precipitation_mm END), 0) AS snow_total
  FROM $frames3h GROUP BY ALL) a
JOIN (
  SELECT station_id, window_start, first(precipitation_type ORDER BY c DESC, precipitation_type) AS precip_type_dominant
  FROM (SELECT station_id, window_start, precipitation_type, count(*) AS c FROM $frames3h GROUP BY ALL)
  GROUP BY ALL) d USING (station_id, window_start),
LATERAL (SELECT
  CASE WHEN a.temp_median_3h BETWEEN 10 AND 25 THEN 0
       WHEN a.temp_median_3h < 10 THEN least(40, (10 - a.temp_median_3h) * 2.5)
       ELSE least(40, (a.temp_median_3h - 25) * 1.8) END AS penalty_temperature,
  least(45, a.rain_total * 10) + least(50, a.snow_total * 15) AS penalty_precipitation,
  CASE WHEN a.wind_peak_3h <= 4 THEN 0 ELSE least(25, (a.wind_peak_3h - 4) * 3) END AS penalty_wind,
  CASE WHEN a.humidity_avg_3h IS NULL THEN 0 WHEN a.humidity_avg_3h BETWEEN 30 AND 70 THEN 0
       ELSE least(15, abs(a.humidity_avg_3h - 50) * 0.4) END AS penalty_humidity) p""")


def scr1_sql(med: str, rain: str, snow: str, peak: str, hum: str) -> dict[str, str]:
    """SCR1 penalty / score / label expressions over named aggregate columns."""
    pt = (f"CASE WHEN {med} BETWEEN 10 AND 25 THEN 0 WHEN {med} < 10 THEN least(40, (10 - {med}) * 2.5) "
          f"ELSE least(40, ({med} - 25) * 1.8) END")
    pp = f"(least(45, {rain} * 10) + least(50, {snow} * 15))"
    pw = f"CASE WHEN {peak} <= 4 THEN 0 ELSE least(25, ({peak} - 4) * 3) END"
    ph = (f"CASE WHEN {hum} IS NULL THEN 0 WHEN {hum} BETWEEN 30 AND 70 THEN 0 "
          f"ELSE least(15, abs({hum} - 50) * 0.4) END")
    score = f"greatest(0, 100 - ({pt} + {pp} + {pw} + {ph}))"
    label = (f"CASE WHEN {score} >= 80 THEN 'excellent' WHEN {score} >= 60 THEN 'good' "
             f"WHEN {score} >= 50 THEN 'uncomfortable' ELSE 'harsh' END")
    return {"penalty_temperature": pt, "penalty_precipitation": pp, "penalty_wind": pw,
            "penalty_humidity": ph, "score": score, "label": label}


FRAME_AGG_SQL = """count(*) AS n_obs, median(temperature_c) AS med_t,
  max(wind_speed_ms) AS peak_w, avg(relative_humidity) AS mean_h,
  coalesce(sum(CASE WHEN precipitation_mm > 0 AND precipitation_type <> 'snow' THEN precipitation_mm END), 0) AS rain,
  coalesce(sum(CASE WHEN precipitation_mm > 0 AND precipitation_type = 'snow' THEN precipitation_mm END), 0) AS snow"""

# DDP1 dedup (first per station-minute) + same-day lag of time and temperature
sql_view("obs_dedup_lag", """
SELECT *, lag(obs_ts) OVER w AS prev_ts, lag(temperature_c) OVER w AS prev_t
FROM (SELECT *, CAST(obs_ts AS DATE) AS obs_date FROM $obs
      QUALIFY row_number() OVER (PARTITION BY station_id, date_trunc('minute', obs_ts) ORDER BY obs_ts, event_id) = 1)
WINDOW w AS (PARTITION BY station_id, obs_date ORDER BY obs_ts, event_id)""")

# WIN1 membership: each row in the sets [s, s+3h) with s on the hour grid of its day
sql_view("set_members", """
SELECT l.*, date_trunc('hour', l.obs_ts) - to_hours(t.i) AS window_start
FROM $obs_dedup_lag l
JOIN (SELECT station_id, obs_date, date_trunc('hour', min(obs_ts)) AS first_h, max(obs_ts) AS last_ts
      FROM $obs_dedup_lag GROUP BY ALL) b USING (station_id, obs_date)
CROSS JOIN range(0, 3) t(i)
WHERE date_trunc('hour', l.obs_ts) - to_hours(t.i) >= b.first_h
  AND date_trunc('hour', l.obs_ts) - to_hours(t.i) < b.last_ts""")

_S = scr1_sql("med_t", "rain", "snow", "peak_w", "mean_h")
sql_view("training_sets", f"""
SELECT station_id, obs_date, window_start, n_obs, completeness, reasonableness, consistency, gap_consistency,
  (completeness + reasonableness + consistency + gap_consistency) / 4 AS quality_score,
  {_S['score']} AS baseline_comfort_score, {_S['label']} AS label_bucket,
  (completeness + reasonableness + consistency + gap_consistency) / 4 >= 0.6 AS passed_gate
FROM (
  SELECT *, 1 - missing / (n_obs * 5) AS completeness, greatest(0, 1 - 0.1 * extreme) AS reasonableness,
    1 - jumps / pairs AS consistency, 1 - least(1, coalesce(gap_std, 0) / 2) AS gap_consistency
  FROM (
    SELECT station_id, obs_date, window_start, {FRAME_AGG_SQL},
      sum(CASE WHEN temperature_c = 0 THEN 1 ELSE 0 END + CASE WHEN relative_humidity IS NULL THEN 1 ELSE 0 END
          + CASE WHEN wind_speed_ms < 0 THEN 1 ELSE 0 END + CASE WHEN precipitation_mm < 0 THEN 1 ELSE 0 END) AS missing,
      sum(CASE WHEN abs(temperature_c) > 50 THEN 1 ELSE 0 END + CASE WHEN wind_speed_ms > 50 THEN 1 ELSE 0 END
          + CASE WHEN precipitation_mm > 100 THEN 1 ELSE 0 END) AS extreme,
      count(*) FILTER (WHERE prev_ts >= window_start) AS pairs,
      count(*) FILTER (WHERE prev_ts >= window_start AND abs(temperature_c - prev_t) > 10) AS jumps,
      stddev_pop((epoch_us(obs_ts) - epoch_us(prev_ts)) / 3.6e9) FILTER (WHERE prev_ts >= window_start) AS gap_std
    FROM $set_members GROUP BY ALL HAVING count(*) >= 3))""")

# AGG13 + AGG14 per (model, evaluation day)
sql_view("model_metrics", """
SELECT *, sqrt(mse) AS rmse, mape * 100 AS mape_pct FROM (
  SELECT model_name, date_trunc('day', eval_ts) AS eval_day, count(*) AS sample_count,
    avg(abs(prediction - actual)) AS mae, avg((prediction - actual) * (prediction - actual)) AS mse,
    1 - sum((prediction - actual) * (prediction - actual)) / (var_pop(actual) * count(*)) AS r2,
    avg(CASE WHEN actual <> 0 THEN abs((prediction - actual) / actual) END) AS mape,
    avg(confidence) AS prediction_confidence, avg(data_quality) AS data_quality_score,
    avg(latency_ms) AS prediction_latency_ms
  FROM $predictions GROUP BY ALL)""")

sql_view("observations_wide", """
SELECT station_id, obs_ts, event_id, temperature_c AS temperature, relative_humidity AS humidity,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(1000 + event_id % 40 AS DOUBLE) END AS pressure,
  wind_speed_ms AS wind_speed,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST((event_id * 7) % 360 AS DOUBLE) END AS wind_direction,
  precipitation_mm AS precipitation_1h,
  CASE WHEN event_type = 'click' THEN NULL ELSE CAST(user_id % 20 AS DOUBLE) END AS visibility,
  CASE WHEN event_type IN ('click', 'view') AND event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 11 AS DOUBLE) END AS cloud_cover,
  temperature_c - 5 AS dew_point, wind_speed_ms * 1.5 AS wind_gust
FROM (SELECT o.*, e.event_type, e.user_id FROM $observations o JOIN events e USING (event_id))""")

sql_view("core_rows", """
SELECT *, (CAST(temperature_c IS NOT NULL AS INT) + CAST(relative_humidity_pct IS NOT NULL AS INT)
    + CAST(precipitation_mm_1h IS NOT NULL AS INT) + CAST(wind_speed_ms IS NOT NULL AS INT)
    + CAST(pressure_hpa IS NOT NULL AS INT) + CAST(visibility_km IS NOT NULL AS INT)) / 6 * 100.0 AS feature_completeness,
  greatest(0, least(100, 100.0 * (CASE WHEN temperature_c > 35 AND relative_humidity_pct > 90 THEN 0.9 ELSE 1.0 END)
    * (CASE WHEN precipitation_mm_1h > 0 AND relative_humidity_pct < 50 THEN 0.8 ELSE 1.0 END))) AS feature_reliability,
  list_filter([CASE WHEN temperature_c < 0 THEN 'freezing' WHEN temperature_c > 30 THEN 'hot' END,
    CASE WHEN precipitation_mm_1h > 10 THEN 'heavy_rain' WHEN precipitation_mm_1h > 0 THEN 'light_rain' END,
    CASE WHEN wind_speed_ms > 10 THEN 'windy' END], lambda x: x IS NOT NULL) AS weather_conditions,
  CAST(temperature_c IS NOT NULL AS INT) + CAST(relative_humidity_pct IS NOT NULL AS INT)
    + CAST(precipitation_mm_1h IS NOT NULL AS INT) + CAST(wind_speed_ms IS NOT NULL AS INT)
    + CAST(pressure_hpa IS NOT NULL AS INT) + CAST(visibility_km IS NOT NULL AS INT)
    + CAST(wind_direction_deg IS NOT NULL AS INT) + CAST(cloud_cover_tenths IS NOT NULL AS INT) AS feature_count,
  data_quality > 50 AS passes_quality
FROM (
  SELECT station_id, obs_ts, event_id,
    greatest(0, least(100, 100.0 * (CASE WHEN r < 0.5 THEN 0.3 WHEN r < 0.7 THEN 0.6 WHEN r < 0.9 THEN 0.8 ELSE 1.0 END)
      * (CASE WHEN temperature IS NOT NULL AND (temperature < -50 OR temperature > 60) THEN 0.8 ELSE 1.0 END)
      * (CASE WHEN humidity IS NOT NULL AND (humidity < 0 OR humidity > 100) THEN 0.8 ELSE 1.0 END)
      * (CASE WHEN wind_speed IS NOT NULL AND (wind_speed < 0 OR wind_speed > 100) THEN 0.8 ELSE 1.0 END)
      * (CASE WHEN (epoch_us(as_of) - epoch_us(obs_ts)) / 3.6e9 > 2 THEN 0.9 ELSE 1.0 END))) AS data_quality,
    temperature AS temperature_c, humidity AS relative_humidity_pct, precipitation_1h AS precipitation_mm_1h,
    wind_speed AS wind_speed_ms, pressure AS pressure_hpa, visibility AS visibility_km,
    wind_direction AS wind_direction_deg, cloud_cover AS cloud_cover_tenths
  FROM (SELECT *, (CAST(temperature IS NOT NULL AS INT) + CAST(humidity IS NOT NULL AS INT)
          + CAST(precipitation_1h IS NOT NULL AS INT) + CAST(wind_speed IS NOT NULL AS INT)
          + CAST(pressure IS NOT NULL AS INT) + CAST(visibility IS NOT NULL AS INT)
          + CAST(wind_direction IS NOT NULL AS INT) + CAST(cloud_cover IS NOT NULL AS INT)) / 8 AS r
        FROM $observations_wide, (SELECT max(ts) AS as_of FROM events) m))""")
