"""Catalog: row-level operators (features, scores, calendar functions, cleaning)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustframe.functions import comfort as C
from gustframe.functions import timefn as D
from gustframe.functions.features_row import temporal_columns, with_row_features
from gustframe.functions.mathfn import default_if_falsy, finite_or_zero
from gustframe.operators import clean as CL
from gustframe.plans import common as X
from gustframe.plans.registry import register
from gustframe.sources import tables as T

ROW_FEATURE_SCHEMA = """event_id bigint, station_id string, obs_ts timestamp,
comfort_heat_index double, comfort_wind_chill double, comfort_apparent_temperature double,
comfort_discomfort_index double, comfort_humidity_comfort double, comfort_temperature_comfort double,
comfort_walking_comfort double, comfort_waiting_comfort double, comfort_clothing_index double,
weather_temperature_normalized double, weather_humidity_normalized double,
weather_wind_speed_normalized double, weather_precipitation_log double,
weather_temperature_category int, weather_humidity_category int, weather_wind_category int,
weather_precipitation_category int, weather_weather_severity_score double,
weather_is_extreme_weather boolean, weather_is_pleasant_weather boolean,
interaction_temp_humidity_interaction double, interaction_heat_index_diff double,
interaction_wind_temp_interaction double, interaction_wind_cooling_effect double,
interaction_precipitation_temp_interaction double, interaction_snow_probability double,
interaction_weather_stress_index double, interaction_outdoor_activity_index double,
feature_quality_score double"""

# DuckDB: shared row-feature expressions over columns T, H (defaulted), HR (raw), W, P
ROW_FEATURE_SQL = """
SELECT event_id, station_id, obs_ts,
  CASE WHEN T < 27 OR H < 40 THEN T ELSE
    -8.78469475556 + 1.61139411*T + 2.33854883889*H - 0.14611605*T*H - 0.012308094*T*T
    - 0.0164248277778*H*H + 0.002211732*T*T*H + 0.00072546*T*H*H - 0.000003582*T*T*H*H END
    AS comfort_heat_index,
  CASE WHEN T > 10 OR W < 1.34 THEN T ELSE
    13.12 + 0.6215*T - 11.37*pow(W*3.6, 0.16) + 0.3965*T*pow(W*3.6, 0.16) END AS comfort_wind_chill,
  CASE WHEN T >= 27 AND H >= 40 THEN comfort_heat_index
       WHEN T <= 10 AND W >= 1.34 THEN comfort_wind_chill
       ELSE T + 0.33*(H/100*6.105*exp(17.27*T/(237.7+T))) - 0.7*W - 4.0 END AS comfort_apparent_temperature,
  0.81*T + 0.01*H*(0.99*T - 14.3) + 46.3 AS comfort_discomfort_index,
  CASE WHEN H BETWEEN 40 AND 60 THEN 1.0 WHEN H < 40 THEN greatest(0, 1 - (40-H)/40)
       ELSE greatest(0, 1 - (H-60)/40) END AS comfort_humidity_comfort,
  CASE WHEN T BETWEEN 18 AND 24 THEN 1.0 WHEN T < 18 THEN greatest(0, 1 - (18-T)/20)
       ELSE greatest(0, 1 - (T-24)/20) END AS comfort_temperature_comfort,
  greatest(0, least(1, 0.8 - (CASE WHEN T < 0 THEN 0.3 WHEN T > 30 THEN 0.2 ELSE 0 END)
      - (CASE WHEN P > 0 THEN least(0.4, P*0.1) ELSE 0 END)
      + (CASE WHEN W > 5 THEN -0.1 WHEN W > 1 AND W < 3 AND T > 25 THEN 0.1 ELSE 0 END)))
    AS comfort_walking_comfort,
  greatest(0, least(1, 0.7 - (CASE WHEN T < 5 THEN 0.4 WHEN T > 28 THEN 0.3 ELSE 0 END)
      - (CASE WHEN P > 0 THEN least(0.5, P*0.15) ELSE 0 END)
      - (CASE WHEN W > 3 THEN least(0.2, W*0.05) ELSE 0 END))) AS comfort_waiting_comfort,
  CASE WHEN W > 5 THEN greatest(0, cl - 0.1) ELSE cl END AS comfort_clothing_index,
  greatest(0, least(1, (T + 20)/60)) AS weather_temperature_normalized,
  greatest(0, least(1, H/100)) AS weather_humidity_normalized,
  greatest(0, least(1, W/30)) AS weather_wind_speed_normalized,
  ln(1 + P) AS weather_precipitation_log,
  CASE WHEN T < 0 THEN 0 WHEN T < 10 THEN 1 WHEN T < 28 THEN 2 WHEN T < 35 THEN 3 ELSE 4 END AS weather_temperature_category,
  CASE WHEN H < 30 THEN 0 WHEN H < 70 THEN 1 ELSE 2 END AS weather_humidity_category,
  CASE WHEN W < 1 THEN 0 WHEN W < 3 THEN 1 WHEN W < 8 THEN 2 ELSE 3 END AS weather_wind_category,
  CASE WHEN P = 0 THEN 0 WHEN P < 1 THEN 1 WHEN P < 10 THEN 2 ELSE 3 END AS weather_precipitation_category,
  sev AS weather_weather_severity_score,
  sev > 0.7 AS weather_is_extreme_weather,
  sev BETWEEN 0.2 AND 0.4 AS weather_is_pleasant_weather,
  T*H/100 AS interaction_temp_humidity_interaction,
  comfort_heat_index - T AS interaction_heat_index_diff,
  W*abs(T - 20) AS interaction_wind_temp_interaction,
  W*greatest(0, T - 25) AS interaction_wind_cooling_effect,
  P*abs(T - 15) AS interaction_precipitation_temp_interaction,
  CASE WHEN P = 0 THEN 0 WHEN T <= 0 THEN 0.9 WHEN T <= 2 THEN 0.7 WHEN T <= 4 THEN 0.3 ELSE 0 END
    AS interaction_snow_probability,
  0.3*(abs(T-20)/20) + 0.2*(abs(H-50)/50) + 0.2*least(1, W/10) + 0.3*least(1, P/10) AS interaction_weather_stress_index,
  greatest(0, least(1, ((comfort_temperature_comfort + comfort_humidity_comfort)/2)
      * (CASE WHEN P > 0 THEN 0.5 ELSE 1 END) * (CASE WHEN W > 5 THEN 0.8 ELSE 1 END)))
    AS interaction_outdoor_activity_index,
  greatest(0, least(1, 1 - (CASE WHEN HR IS NULL THEN 0.2 ELSE 0 END) - (CASE WHEN T = 0 THEN 0.1 ELSE 0 END)
      - (CASE WHEN abs(T) > 40 THEN 0.1 ELSE 0 END) - (CASE WHEN W > 30 THEN 0.1 ELSE 0 END)
      - (CASE WHEN sev > 0.8 THEN 0.1 ELSE 0 END))) AS feature_quality_score
FROM (
  SELECT *, least(1.0, (CASE WHEN T < -10 OR T > 35 THEN 0.4::DOUBLE WHEN T < 0 OR T > 30 THEN 0.2::DOUBLE ELSE 0::DOUBLE END)
       + (CASE WHEN H < 20 OR H > 80 THEN 0.2::DOUBLE ELSE 0::DOUBLE END)
       + (CASE WHEN W > 10 THEN 0.3::DOUBLE WHEN W > 5 THEN 0.1::DOUBLE ELSE 0::DOUBLE END)
       + (CASE WHEN P > 10 THEN 0.4::DOUBLE WHEN P > 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END)) AS sev,
    CASE WHEN A < 0 THEN 0.0 WHEN A < 10 THEN 0.2 WHEN A < 20 THEN 0.5 WHEN A < 25 THEN 0.7 ELSE 1.0 END AS cl
  FROM (
    SELECT *, CASE WHEN T >= 27 AND H >= 40 THEN
        -8.78469475556 + 1.61139411*T + 2.33854883889*H - 0.14611605*T*H - 0.012308094*T*T
        - 0.0164248277778*H*H + 0.002211732*T*T*H + 0.00072546*T*H*H - 0.000003582*T*T*H*H
      WHEN T <= 10 AND W >= 1.34 THEN 13.12 + 0.6215*T - 11.37*pow(W*3.6, 0.16) + 0.3965*T*pow(W*3.6, 0.16)
      ELSE T + 0.33*(H/100*6.105*exp(17.27*T/(237.7+T))) - 0.7*W - 4.0 END AS A
    FROM (
      SELECT event_id, station_id, obs_ts, temperature_c AS T, relative_humidity AS HR,
        CASE WHEN relative_humidity IS NULL OR relative_humidity = 0 THEN 50 ELSE relative_humidity END AS H,
        wind_speed_ms AS W, precipitation_mm AS P
      FROM $observations)))"""


@register("FTR1_3_4_6_row_features", ROW_FEATURE_SCHEMA, ROW_FEATURE_SQL,
          ids=("FTR1", "FTR3", "FTR4", "FTR6", "PRJ5", "CND1", "MTH1", "MTH2", "MTH4", "MTH5"))
def row_features(spark, sf):
    o = T.observations(spark, sf)
    return with_row_features(o.select("event_id", "station_id", "obs_ts", "temperature_c",
                                      "relative_humidity", "wind_speed_ms", "precipitation_mm"))


TEMPORAL_SCHEMA = """event_id bigint, obs_ts timestamp, temporal_hour_sin double, temporal_hour_cos double,
temporal_day_of_week int, temporal_day_of_year_sin double, temporal_day_of_year_cos double,
temporal_month int, temporal_is_morning_commute boolean, temporal_is_evening_commute boolean,
temporal_is_rush_hour boolean, temporal_is_weekend boolean, temporal_is_holiday boolean,
temporal_commute_weight double, temporal_time_of_day_weight double"""

TEMPORAL_SQL = """
SELECT event_id, obs_ts,
  sin(2*pi()*hour(obs_ts)/24) AS temporal_hour_sin, cos(2*pi()*hour(obs_ts)/24) AS temporal_hour_cos,
  isodow(obs_ts) - 1 AS temporal_day_of_week,
  sin(2*pi()*dayofyear(obs_ts)/365) AS temporal_day_of_year_sin,
  cos(2*pi()*dayofyear(obs_ts)/365) AS temporal_day_of_year_cos,
  month(obs_ts) AS temporal_month,
  hour(obs_ts) BETWEEN 7 AND 9 AS temporal_is_morning_commute,
  hour(obs_ts) BETWEEN 17 AND 19 AS temporal_is_evening_commute,
  hour(obs_ts) BETWEEN 7 AND 9 OR hour(obs_ts) BETWEEN 17 AND 19 AS temporal_is_rush_hour,
  isodow(obs_ts) >= 6 AS temporal_is_weekend,
  strftime(obs_ts, '%m-%d') IN ('01-01','02-11','02-12','02-13','03-01','05-05','06-06','08-15','10-03','10-09','12-25')
    AS temporal_is_holiday,
  CASE WHEN hour(obs_ts) BETWEEN 7 AND 9 OR hour(obs_ts) BETWEEN 17 AND 19 THEN 1.5 ELSE 1.0 END AS temporal_commute_weight,
  CASE WHEN hour(obs_ts) BETWEEN 7 AND 9 OR hour(obs_ts) BETWEEN 17 AND 19 THEN 1.5
       WHEN hour(obs_ts) BETWEEN 6 AND 10 OR hour(obs_ts) BETWEEN 16 AND 20 THEN 1.2 ELSE 1.0 END
    AS temporal_time_of_day_weight
FROM $observations"""


@register("FTR2_temporal_features", TEMPORAL_SCHEMA, TEMPORAL_SQL,
          ids=("FTR2", "DTM5", "DTM6", "DTM7", "DTM8"))
def temporal_features(spark, sf):
    o = T.observations(spark, sf)
    return o.select("event_id", "obs_ts", *temporal_columns("obs_ts"))


ROW_SCORE_SCHEMA = """event_id bigint, batch_score double, batch_label string, weak_label double,
weak_label_step double, report_band string"""

ROW_SCORE_SQL = """
SELECT event_id, s AS batch_score,
  CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 70 THEN 'good' WHEN s >= 60 THEN 'moderate'
       WHEN s >= 50 THEN 'uncomfortable' ELSE 'harsh' END AS batch_label,
  greatest(0, least(1, 0.35*ts + 0.25*hs + 0.2*ws + 0.2*ps)) AS weak_label,
  greatest(0, least(1, 0.3*ts + 0.2*hs + 0.2*ws + 0.3*ps)) AS weak_label_step,
  CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 60 THEN 'good' WHEN s >= 40 THEN 'uncomfortable'
       ELSE 'harsh' END AS report_band
FROM (
  SELECT event_id,
    greatest(0, least(100, 70 + greatest(0, least(40, 40 - 2*abs(T - 18)))
        + greatest(0, least(30, 30 - 0.3*abs(HR - 60))) - least(20, 10*P))) AS s,
    CASE WHEN T BETWEEN 18 AND 24 THEN 1.0 WHEN T BETWEEN 10 AND 30 THEN 0.7 - 0.02*abs(T-21)
         ELSE greatest(0.1, 0.5 - 0.03*abs(T-21)) END AS ts,
    CASE WHEN H BETWEEN 40 AND 60 THEN 1.0 WHEN H BETWEEN 30 AND 80 THEN 0.8 - 0.01*abs(H-50)
         ELSE greatest(0.1, 0.6 - 0.02*abs(H-50)) END AS hs,
    CASE WHEN W <= 5 THEN 1 - 0.1*W WHEN W <= 10 THEN 0.5 - 0.05*(W-5)
         ELSE greatest(0.1, 0.25 - 0.02*(W-10)) END AS ws,
    CASE WHEN P = 0 THEN 1.0 WHEN P <= 1 THEN 0.8 WHEN P <= 5 THEN 0.5 ELSE 0.2 END AS ps
  FROM (SELECT event_id, temperature_c AS T, relative_humidity AS HR,
          CASE WHEN relative_humidity IS NULL OR relative_humidity = 0 THEN 50 ELSE relative_humidity END AS H,
          wind_speed_ms AS W, precipitation_mm AS P FROM $observations))"""


@register("SCR3_4_6_row_scores", ROW_SCORE_SCHEMA, ROW_SCORE_SQL, ids=("SCR3", "SCR4", "SCR6"))
def row_scores(spark, sf):
    o = T.observations(spark, sf)
    t, h, w, p = "temperature_c", "relative_humidity", "wind_speed_ms", "precipitation_mm"
    s = C.batch_prediction_score(t, h, p)
    return o.select(
        "event_id", s.alias("batch_score"),
        C.label_bands(s, C.BANDS_BATCH).alias("batch_label"),
        C.weak_label_score(t, h, w, p).alias("weak_label"),
        C.weak_label_score(t, h, w, p, weights=(0.3, 0.2, 0.2, 0.3)).alias("weak_label_step"),
        C.label_bands(s, C.BANDS_REPORT).alias("report_band"))


CALENDAR_SCHEMA = """event_id bigint, hour_start timestamp, minute_start timestamp, request_hour timestamp,
season int, rush_set boolean, rush_ranges boolean, compact_text string, parsed_compact timestamp,
parsed_hourly timestamp, parsed_iso timestamp, bad_parse timestamp, age_hours double,
freshness double, period_text string, target_period string, in_service_window boolean"""

CALENDAR_SQL = """
SELECT event_id, date_trunc('hour', ts) AS hour_start, date_trunc('minute', ts) AS minute_start,
  CASE WHEN minute(ts) < 10 THEN date_trunc('hour', ts) - INTERVAL 1 HOUR ELSE date_trunc('hour', ts) END
    AS request_hour,
  CASE WHEN month(ts) BETWEEN 3 AND 5 THEN 0 WHEN month(ts) BETWEEN 6 AND 8 THEN 1
       WHEN month(ts) BETWEEN 9 AND 11 THEN 2 ELSE 3 END AS season,
  hour(ts) IN (7, 8, 9, 18, 19, 20) AS rush_set,
  hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19 AS rush_ranges,
  strftime(ts, '%Y%m%d%H%M') AS compact_text,
  date_trunc('minute', ts) AS parsed_compact,
  date_trunc('hour', ts) AS parsed_hourly,
  date_trunc('second', ts) AS parsed_iso,
  CAST(NULL AS TIMESTAMP) AS bad_parse,
  (epoch_us(m.as_of) - epoch_us(ts)) / 3.6e9 AS age_hours,
  CASE WHEN (epoch_us(m.as_of) - epoch_us(ts)) / 3.6e9 <= 1 THEN 1.0
       WHEN (epoch_us(m.as_of) - epoch_us(ts)) / 3.6e9 <= 3 THEN 0.8
       WHEN (epoch_us(m.as_of) - epoch_us(ts)) / 3.6e9 <= 6 THEN 0.6 ELSE 0.3 END AS freshness,
  strftime(ts, '%H:%M') || '-' || strftime(ts + INTERVAL 3 HOUR, '%H:%M') AS period_text,
  CASE WHEN hour(ts) BETWEEN 14 AND 19 THEN 'evening' ELSE 'morning' END AS target_period,
  (hour(ts) >= 6 AND hour(ts) < 9) OR hour(ts) BETWEEN 14 AND 18 AS in_service_window
FROM events, (SELECT max(ts) AS as_of FROM events) m"""


@register("DTM1_9_calendar_parts", CALENDAR_SCHEMA, CALENDAR_SQL,
          ids=("DTM1", "DTM2", "DTM3", "DTM4", "DTM6", "DTM9", "DTM10", "STR3", "FLT5"))
def calendar_parts(spark, sf):
    ev = T.table(spark, sf, "events")
    as_of = T.max_value(ev, "ts")
    ts = F.col("ts")
    compact = F.date_format(ts, "yyyyMMddHHmm")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return ev.select(
        "event_id", D.trunc_ntz("hour", ts).alias("hour_start"),
        D.trunc_ntz("minute", ts).alias("minute_start"),
        D.previous_hour_rule(ts).alias("request_hour"),
        D.season_code(ts).alias("season"),
        D.is_rush_hour_set(ts).alias("rush_set"), D.is_rush_hour_ranges(ts).alias("rush_ranges"),
        compact.alias("compact_text"),
        D.parse_compact(compact).alias("parsed_compact"),
        D.parse_compact(F.substring(compact, 1, 10)).alias("parsed_hourly"),
        D.parse_iso(iso).alias("parsed_iso"),
        D.parse_compact(F.concat(F.lit("x"), F.substring(compact, 2, 11))).alias("bad_parse"),
        D.hours_between(F.lit(as_of), ts).alias("age_hours"),
        D.freshness_factor(ts, F.lit(as_of)).alias("freshness"),
        F.concat(F.date_format(ts, "HH:mm"), F.lit("-"),
                 F.date_format(ts + F.expr("INTERVAL 3 HOURS"), "HH:mm")).alias("period_text"),
        D.commute_period(ts).alias("target_period"),
        D.in_service_window(ts).alias("in_service_window"),
    )


# raw tokens with sentinels, derived from events (both engines build identical text)
RAW_TOKENS_SQL = """
SELECT event_id,
  CASE event_id % 50 WHEN 0 THEN '-999.0' WHEN 1 THEN '-' WHEN 2 THEN '' WHEN 3 THEN '.'
       WHEN 4 THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS ta_raw,
  CASE event_id % 40 WHEN 5 THEN '-9' WHEN 6 THEN ' ' WHEN 7 THEN '-999' ELSE CAST(user_id % 30 AS VARCHAR) END AS ws_raw,
  CASE event_id % 30 WHEN 8 THEN '-1' WHEN 9 THEN '-999.0' ELSE CAST(event_id % 7 AS VARCHAR) END AS rn_raw,
  CAST(user_id % 5 AS VARCHAR) AS rn_alt,
  CASE event_id % 20 WHEN 10 THEN '-5' WHEN 11 THEN '-' ELSE CAST(15 + (event_id * 37) % 85 AS VARCHAR) END AS hm_raw
FROM events"""

CLEAN_SCHEMA = """event_id bigint, temperature_c double, temperature_missing boolean, wind_speed_ms double,
precipitation_mm double, relative_humidity double, humidity_or_default double, finite_ratio double"""

CLEAN_SQL = """
WITH r AS (""" + RAW_TOKENS_SQL + """),
c AS (
  SELECT event_id,
    CASE WHEN trim(ta_raw) IN ('', '-', '.') THEN NULL WHEN TRY_CAST(trim(ta_raw) AS DOUBLE) <= -900 THEN NULL
         ELSE TRY_CAST(trim(ta_raw) AS DOUBLE) END AS t,
    CASE WHEN trim(ws_raw) IN ('', '-', '.') THEN NULL WHEN TRY_CAST(trim(ws_raw) AS DOUBLE) <= -900 THEN NULL
         ELSE TRY_CAST(trim(ws_raw) AS DOUBLE) END AS w,
    coalesce(
      CASE WHEN trim(rn_raw) IN ('', '-', '.') THEN NULL WHEN TRY_CAST(trim(rn_raw) AS DOUBLE) <= -900 THEN NULL
           ELSE TRY_CAST(trim(rn_raw) AS DOUBLE) END,
      CASE WHEN trim(rn_alt) IN ('', '-', '.') THEN NULL WHEN TRY_CAST(trim(rn_alt) AS DOUBLE) <= -900 THEN NULL
           ELSE TRY_CAST(trim(rn_alt) AS DOUBLE) END) AS p,
    CASE WHEN trim(hm_raw) IN ('', '-', '.') THEN NULL WHEN TRY_CAST(trim(hm_raw) AS DOUBLE) <= -900 THEN NULL
         ELSE TRY_CAST(trim(hm_raw) AS DOUBLE) END AS h
  FROM r)
SELECT event_id, coalesce(t, 0) AS temperature_c, t IS NULL AS temperature_missing,
  coalesce(w, 0) AS wind_speed_ms, CASE WHEN p IS NULL OR p < 0 THEN 0 ELSE p END AS precipitation_mm,
  CASE WHEN h < 0 THEN NULL ELSE h END AS relative_humidity,
  CASE WHEN (CASE WHEN h < 0 THEN NULL ELSE h END) IS NULL OR h = 0 THEN 50 ELSE h END AS humidity_or_default,
  CASE WHEN coalesce(w, 0) = 0 THEN 0 ELSE coalesce(t, 0) / coalesce(w, 0) END AS finite_ratio
FROM c"""


@register("PRJ2_sentinel_cleaning", CLEAN_SCHEMA, CLEAN_SQL,
          ids=("PRJ2", "STR1", "STR5", "CND1", "INF1"))
def sentinel_cleaning(spark, sf):
    ev = T.table(spark, sf, "events")
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    raw = ev.select(
        eid,
        F.when(eid % 50 == 0, "-999.0").when(eid % 50 == 1, "-").when(eid % 50 == 2, "")
        .when(eid % 50 == 3, ".").when(eid % 50 == 4, "n/a").otherwise(k).alias("ta_raw"),
        F.when(eid % 40 == 5, "-9").when(eid % 40 == 6, " ").when(eid % 40 == 7, "-999")
        .otherwise((F.col("user_id") % 30).cast("string")).alias("ws_raw"),
        F.when(eid % 30 == 8, "-1").when(eid % 30 == 9, "-999.0")
        .otherwise((eid % 7).cast("string")).alias("rn_raw"),
        (F.col("user_id") % 5).cast("string").alias("rn_alt"),
        F.when(eid % 20 == 10, "-5").when(eid % 20 == 11, "-")
        .otherwise((15 + (eid * 37) % 85).cast("string")).alias("hm_raw"),
    )
    c = CL.clean_measures(raw, ["ta_raw"], ["ws_raw"], ["rn_raw", "rn_alt"], ["hm_raw"])
    # INF1: a ratio that is +-inf/NaN for zero wind is mapped to 0 (try_divide -> NULL -> 0)
    ratio = finite_or_zero(F.try_divide(F.col("temperature_c"), F.col("wind_speed_ms")))
    return c.select("event_id", "temperature_c", "temperature_missing", "wind_speed_ms",
                    "precipitation_mm", "relative_humidity",
                    default_if_falsy("relative_humidity").alias("humidity_or_default"),
                    ratio.alias("finite_ratio"))
