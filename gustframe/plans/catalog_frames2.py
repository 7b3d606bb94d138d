"""Catalog: frame statistics (FTR7), alternate penalties (SCR2), comfort probability (SCR5),
null report (AGG8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustframe.operators import scores as S
from gustframe.plans import common as X
from gustframe.plans.registry import register
from gustframe.sources import tables as T

FTR7_SCHEMA = """station_id string, window_start timestamp, n_obs bigint, temp_stability double,
comfort_temp_score double, wind_variability double, precip_intensity int, weather_severity int,
temp_skewness double, wind_kurtosis double, data_completeness double, hour_of_day int, day_of_week int,
month_of_year int, is_weekend int, is_rush_hour int, season int"""

FTR7_SQL = """
SELECT station_id, window_start, n_obs, 1 / (sd_t + 1e-6) AS temp_stability,
  greatest(0, least(100, 100 * exp(-((med_t - 20) * (med_t - 20)) / 200.0))) AS comfort_temp_score,
  sd_w / (mean_w + 1e-6) AS wind_variability,
  CASE WHEN max_p = 0 THEN 0 WHEN max_p <= 1 THEN 1 WHEN max_p <= 5 THEN 2 ELSE 3 END AS precip_intensity,
  least(100, (CASE WHEN med_t < 0 OR med_t > 35 THEN 30 WHEN med_t < 5 OR med_t > 30 THEN 15 ELSE 0 END)
    + (CASE WHEN max_w > 15 THEN 25 WHEN max_w > 10 THEN 10 ELSE 0 END)
    + (CASE WHEN sum_p > 10 THEN 20 WHEN sum_p > 5 THEN 10 ELSE 0 END)) AS weather_severity,
  CASE WHEN nn_t > 2 THEN CASE WHEN m2_t = 0 THEN NULL ELSE m3_t / pow(m2_t, 1.5) END ELSE 0 END AS temp_skewness,
  CASE WHEN nn_w > 2 THEN CASE WHEN m2_w = 0 THEN NULL ELSE m4_w / (m2_w * m2_w) - 3 END ELSE 0 END AS wind_kurtosis,
  cells / (n_obs * 4) AS data_completeness,
  hour(first_ts) AS hour_of_day, isodow(first_ts) - 1 AS day_of_week, month(first_ts) AS month_of_year,
  CASE WHEN isodow(first_ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour(first_ts) IN (7, 8, 9, 18, 19, 20) THEN 1 ELSE 0 END AS is_rush_hour,
  CASE WHEN month(first_ts) BETWEEN 3 AND 5 THEN 0 WHEN month(first_ts) BETWEEN 6 AND 8 THEN 1
       WHEN month(first_ts) BETWEEN 9 AND 11 THEN 2 ELSE 3 END AS season
FROM (
  SELECT f.station_id, f.window_start, count(*) AS n_obs, stddev_samp(temperature_c) AS sd_t,
    median(temperature_c) AS med_t, stddev_samp(wind_speed_ms) AS sd_w, avg(wind_speed_ms) AS mean_w,
    max(wind_speed_ms) AS max_w, max(precipitation_mm) AS max_p, sum(precipitation_mm) AS sum_p,
    count(temperature_c) AS nn_t, count(wind_speed_ms) AS nn_w,
    avg(pow(temperature_c - mt, 2)) AS m2_t, avg(pow(temperature_c - mt, 3)) AS m3_t,
    avg(pow(wind_speed_ms - mw, 2)) AS m2_w, avg(pow(wind_speed_ms - mw, 4)) AS m4_w,
    count(temperature_c) + count(wind_speed_ms) + count(precipitation_mm) + count(relative_humidity) AS cells,
    min({'t': obs_ts, 'e': event_id}).t AS first_ts
  FROM $frames3h f JOIN (SELECT station_id, window_start, avg(temperature_c) AS mt, avg(wind_speed_ms) AS mw
                         FROM $frames3h GROUP BY ALL) a USING (station_id, window_start)
  GROUP BY ALL)"""


@register("FTR7_frame_statistics", FTR7_SCHEMA, FTR7_SQL,
          ids=("FTR7", "AGG5", "AGG6", "AGG7", "DTM5", "DTM6", "MTH4", "MTH5"))
def q_frame_stats(spark, sf):
    return S.frame_statistics(X.frames(spark, sf))


SCR2_SCHEMA = """station_id string, window_start timestamp, temp_comfort_penalty double,
precip_comfort_penalty double, wind_comfort_penalty double, humidity_comfort_penalty double,
predicted_comfort_score double, comfort_probability double"""

SCR2_SQL = """
SELECT station_id, window_start, pt AS temp_comfort_penalty, pp AS precip_comfort_penalty,
  pw AS wind_comfort_penalty, ph AS humidity_comfort_penalty,
  greatest(0, 100 - (pt + pp + pw + ph)) AS predicted_comfort_score,
  greatest(0, least(1, ft * fp * fw)) AS comfort_probability
FROM (
  SELECT station_id, window_start,
    CASE WHEN temp_median_3h < 10 THEN least(40, (10 - temp_median_3h) * 2.0)
         WHEN temp_median_3h > 25 THEN least(40, (temp_median_3h - 25) * 1.5) ELSE 0 END AS pt,
    CASE WHEN precip_total_3h <= 0 THEN 0 WHEN precip_total_3h <= 1 THEN 10 WHEN precip_total_3h <= 5 THEN 20 ELSE 35 END AS pp,
    CASE WHEN wind_peak_3h > 4 THEN least(25, (wind_peak_3h - 4) * 3.0) ELSE 0 END AS pw,
    CASE WHEN humidity_avg_3h < 30 THEN least(15, (30 - humidity_avg_3h) * 0.3)
         WHEN humidity_avg_3h > 70 THEN least(15, (humidity_avg_3h - 70) * 0.5) ELSE 0 END AS ph,
    CASE WHEN mean_t IS NULL THEN 1.0 WHEN mean_t BETWEEN 15 AND 25 THEN 1.0
         WHEN (mean_t >= 10 AND mean_t < 15) OR (mean_t > 25 AND mean_t <= 30) THEN 0.7
         WHEN (mean_t >= 5 AND mean_t < 10) OR (mean_t > 30 AND mean_t <= 35) THEN 0.4 ELSE 0.1 END AS ft,
    CASE WHEN sum_p IS NULL THEN 1.0 WHEN sum_p = 0 THEN 1.0 WHEN sum_p <= 1 THEN 0.8 WHEN sum_p <= 5 THEN 0.5 ELSE 0.2 END AS fp,
    CASE WHEN wind_peak_3h IS NULL THEN 1.0 WHEN wind_peak_3h <= 3 THEN 1.0 WHEN wind_peak_3h <= 7 THEN 0.8
         WHEN wind_peak_3h <= 12 THEN 0.5 ELSE 0.2 END AS fw
  FROM (SELECT station_id, window_start, median(temperature_c) AS temp_median_3h,
          coalesce(sum(precipitation_mm), 0) AS precip_total_3h, sum(precipitation_mm) AS sum_p,
          max(wind_speed_ms) AS wind_peak_3h, avg(relative_humidity) AS humidity_avg_3h, avg(temperature_c) AS mean_t
        FROM $frames3h GROUP BY ALL))"""


@register("SCR2_5_alternate_scores", SCR2_SCHEMA, SCR2_SQL, ids=("SCR2", "SCR5", "PIP1"))
def q_alt_scores(spark, sf):
    fr = X.frames(spark, sf)
    agg = fr.groupBy("station_id", "window_start").agg(
        F.median("temperature_c").alias("temp_median_3h"),
        F.coalesce(F.sum("precipitation_mm"), F.lit(0.0)).alias("precip_total_3h"),
        F.max("wind_speed_ms").alias("wind_peak_3h"), F.avg("relative_humidity").alias("humidity_avg_3h"),
        *S.comfort_probability_aggs())
    # PIP1: the feature steps run as one DataFrame.transform chain over the same aggregate
    return agg.transform(S.alternate_penalties).transform(S.comfort_probability)


@register("AGG8_null_report", """station_id string, row_count bigint, null_obs_ts bigint, null_temperature_c bigint,
null_wind_speed_ms bigint, null_precipitation_mm bigint, null_relative_humidity bigint, unsorted_count bigint,
valid boolean""", """
SELECT station_id, count(*) AS row_count, count(*) FILTER (WHERE obs_ts IS NULL) AS null_obs_ts,
  count(*) FILTER (WHERE temperature_c IS NULL) AS null_temperature_c,
  count(*) FILTER (WHERE wind_speed_ms IS NULL) AS null_wind_speed_ms,
  count(*) FILTER (WHERE precipitation_mm IS NULL) AS null_precipitation_mm,
  count(*) FILTER (WHERE relative_humidity IS NULL) AS null_relative_humidity,
  count(*) FILTER (WHERE obs_ts < prev_ts) AS unsorted_count,
  count(*) FILTER (WHERE obs_ts IS NULL OR temperature_c IS NULL OR wind_speed_ms IS NULL OR precipitation_mm IS NULL
                   OR relative_humidity IS NULL) = 0 AND count(*) FILTER (WHERE obs_ts < prev_ts) = 0 AS valid
FROM (SELECT *, lag(obs_ts) OVER (PARTITION BY station_id ORDER BY event_id) AS prev_ts FROM $observations)
GROUP BY station_id""", ids=("AGG8",))
def q_null_report(spark, sf):
    return S.null_report(T.observations(spark, sf))
