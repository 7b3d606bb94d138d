"""Catalog: dataset statistics and small operators (AGG12, AGG15, AGG21-23, JN1/JN2, PRJ1,
PRJ8, FLT1, SRC6, MTH3, JSN1, MAP1, ARR2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustframe.functions.timefn import trunc_ntz
from gustframe.operators import clean as CL
from gustframe.operators import stats as ST
from gustframe.operators.frames import lookback, tumbling, with_precipitation_type
from gustframe.operators.scores import (alternate_penalties, comfort_probability, comfort_probability_aggs,
                                        frame_features)
from gustframe.plans import common as X
from gustframe.plans.catalog_wide import _core
from gustframe.plans.catalog_windows import training_sets
from gustframe.plans.registry import register
from gustframe.sources import tables as T


@register("AGG12_bootstrap_quality", """station_id string, total_samples bigint, score_std double, temp_range double,
humidity_range double, wind_range double, diversity_score double, overall_quality double""", """
WITH s AS (SELECT * FROM $training_sets WHERE passed_gate),
a AS (SELECT station_id, count(*) AS total_samples, stddev_pop(baseline_comfort_score / 100.0) AS score_std FROM s GROUP BY station_id),
r AS (SELECT station_id, max(temperature_c) - min(temperature_c) AS temp_range,
        coalesce(max(relative_humidity) FILTER (WHERE relative_humidity <> 0) - min(relative_humidity) FILTER (WHERE relative_humidity <> 0), 0) AS humidity_range,
        max(wind_speed_ms) - min(wind_speed_ms) AS wind_range
      FROM $set_members m WHERE EXISTS (SELECT 1 FROM s WHERE s.station_id = m.station_id AND s.obs_date = m.obs_date AND s.window_start = m.window_start)
      GROUP BY station_id)
SELECT *, ((temp_range > 20)::INT + (humidity_range > 30)::INT + (wind_range > 5)::INT) / 3 AS diversity_score,
  (least(1, total_samples / 100.0) + ((temp_range > 20)::INT + (humidity_range > 30)::INT + (wind_range > 5)::INT) / 3
   + least(1, score_std / 0.2)) / 3 AS overall_quality
FROM a JOIN r USING (station_id)""", ids=("AGG12",))
def q_bootstrap(spark, sf):
    sets = training_sets(spark, sf, extra_aggs=ST.set_range_aggregates()).where("passed_gate")
    return ST.bootstrap_quality(sets)


@register("AGG15_inference_metrics", """model_name string, prediction_count bigint, prediction_mean double,
prediction_std double, prediction_min double, prediction_max double, inference_rmse double, inference_mae double,
inference_r2 double""", """
SELECT model_name, count(*) AS prediction_count, avg(prediction) AS prediction_mean, stddev_pop(prediction) AS prediction_std,
  min(prediction) AS prediction_min, max(prediction) AS prediction_max,
  sqrt(avg((prediction - actual) * (prediction - actual))) AS inference_rmse, avg(abs(prediction - actual)) AS inference_mae,
  1 - sum((prediction - actual) * (prediction - actual)) / (var_pop(actual) * count(*)) AS inference_r2
FROM $predictions GROUP BY model_name""", ids=("AGG15",))
def q_inference(spark, sf):
    return ST.inference_metrics(T.predictions(spark, sf), ["model_name"])


@register("AGG21_evaluation_data_stats", """station_id string, total_records bigint, start_ts timestamp, end_ts timestamp,
data_quality_avg double, data_quality_std double, feature_completeness_avg double""", """
SELECT station_id, count(*) AS total_records, min(obs_ts) AS start_ts, max(obs_ts) AS end_ts,
  avg(data_quality) AS data_quality_avg, stddev_samp(data_quality) AS data_quality_std,
  avg(feature_completeness) AS feature_completeness_avg FROM $core_rows GROUP BY station_id""", ids=("AGG21",))
def q_eval_stats(spark, sf):
    c, _ = _core(spark, sf)
    return ST.evaluation_data_stats(c)


@register("AGG22_feedback_metrics", """station_id string, mean_absolute_error double, std_error double, max_error double,
min_error double, feedback_count bigint, accuracy_score double""", """
WITH p AS (
  SELECT station_id, window_start, greatest(0, least(1, ft * fp * fw)) AS prob FROM (
    SELECT station_id, window_start,
      CASE WHEN mean_t IS NULL THEN 1.0 WHEN mean_t BETWEEN 15 AND 25 THEN 1.0
           WHEN (mean_t >= 10 AND mean_t < 15) OR (mean_t > 25 AND mean_t <= 30) THEN 0.7
           WHEN (mean_t >= 5 AND mean_t < 10) OR (mean_t > 30 AND mean_t <= 35) THEN 0.4 ELSE 0.1 END AS ft,
      CASE WHEN sum_p IS NULL THEN 1.0 WHEN sum_p = 0 THEN 1.0 WHEN sum_p <= 1 THEN 0.8 WHEN sum_p <= 5 THEN 0.5 ELSE 0.2 END AS fp,
      CASE WHEN max_w IS NULL THEN 1.0 WHEN max_w <= 3 THEN 1.0 WHEN max_w <= 7 THEN 0.8 WHEN max_w <= 12 THEN 0.5 ELSE 0.2 END AS fw
    FROM (SELECT station_id, window_start, avg(temperature_c) AS mean_t, sum(precipitation_mm) AS sum_p,
            max(wind_speed_ms) AS max_w FROM $frames3h GROUP BY ALL))),
e AS (SELECT f.station_id, f.window_start, abs(f.baseline_comfort_score / 100.0 - p.prob) AS err,
        row_number() OVER (PARTITION BY f.station_id ORDER BY f.window_start DESC) AS rk
      FROM $frame_table f JOIN p USING (station_id, window_start))
SELECT station_id, avg(err) AS mean_absolute_error, stddev_pop(err) AS std_error, max(err) AS max_error,
  min(err) AS min_error, count(*) AS feedback_count, greatest(0, 1 - avg(err)) AS accuracy_score
FROM e WHERE rk <= 50 GROUP BY station_id""", ids=("AGG22", "WIN9", "SCR5"))
def q_feedback(spark, sf):
    ft = frame_features(X.frames(spark, sf), more=comfort_probability_aggs())
    return ST.feedback_metrics(comfort_probability(ft))


@register("AGG23_collection_completeness", """station_id string, obs_date date, total_observations bigint,
raw_data_saved bigint, ml_datasets_saved bigint, raw_data_completeness double, ml_data_completeness double,
overall double""", """
SELECT station_id, CAST(obs_ts AS DATE) AS obs_date, count(*) AS total_observations,
  count(*) FILTER (WHERE temperature_c IS NOT NULL AND relative_humidity_pct IS NOT NULL) AS raw_data_saved,
  count(*) FILTER (WHERE passes_quality) AS ml_datasets_saved,
  count(*) FILTER (WHERE temperature_c IS NOT NULL AND relative_humidity_pct IS NOT NULL) / count(*) AS raw_data_completeness,
  count(*) FILTER (WHERE passes_quality) / count(*) AS ml_data_completeness,
  count(*) FILTER (WHERE temperature_c IS NOT NULL AND relative_humidity_pct IS NOT NULL) / count(*) * 0.4
    + count(*) FILTER (WHERE passes_quality) / count(*) * 0.4 + 0.95 * 0.2 AS overall
FROM $core_rows GROUP BY ALL""", ids=("AGG23",))
def q_collection(spark, sf):
    c, _ = _core(spark, sf)
    return ST.collection_completeness(c)


@register("JN1_JN2_next_frame_pairs", """station_id string, window_start timestamp, predicted_score double,
actual_score double, abs_error double""", """
SELECT a.station_id, a.window_start, a.baseline_comfort_score AS predicted_score, b.baseline_comfort_score AS actual_score,
  abs(a.baseline_comfort_score - b.baseline_comfort_score) AS abs_error
FROM $frame_table a JOIN $frame_table b ON a.station_id = b.station_id AND b.window_start = a.window_start + INTERVAL 3 HOUR""",
          ids=("JN1", "JN2"))
def q_pairs(spark, sf):
    ft = X.frame_table(spark, sf).select("station_id", "window_start", "baseline_comfort_score")
    nxt = ft.select("station_id", (F.col("window_start") - F.expr("INTERVAL 3 HOURS")).alias("window_start"),
                    F.col("baseline_comfort_score").alias("actual_score"))
    j = ft.join(nxt, ["station_id", "window_start"], "inner")
    return j.select("station_id", "window_start", F.col("baseline_comfort_score").alias("predicted_score"),
                    "actual_score", F.abs(F.col("baseline_comfort_score") - F.col("actual_score")).alias("abs_error"))


@register("PRJ1_normalized_observations", """station_id string, obs_ts timestamp, event_id bigint, source string,
ingested_at timestamp, precipitation_type string""", """
SELECT station_id, obs_ts, event_id, 'asos' AS source, (SELECT max(ts) FROM events) AS ingested_at,
  coalesce(precipitation_type, 'unknown') AS precipitation_type FROM $obs""", ids=("PRJ1", "SRT1"))
def q_normalized(spark, sf):
    as_of = T.max_value(T.table(spark, sf, "events"), "ts")
    n = CL.normalize_observations(X.obs(spark, sf), ingested_at=as_of)
    return n.select("station_id", "obs_ts", "event_id", "source", "ingested_at", "precipitation_type")


@register("PRJ8_revalidation_ranges", """station_id string, n_frames bigint, temperature_out bigint, wind_out bigint,
precipitation_out bigint, humidity_out bigint""", """
SELECT station_id, count(*) AS n_frames,
  count(*) FILTER (WHERE temp_median_3h < -50 OR temp_median_3h > 60) AS temperature_out,
  count(*) FILTER (WHERE wind_peak_3h < 0 OR wind_peak_3h > 100) AS wind_out,
  count(*) FILTER (WHERE precip_total_3h < 0 OR precip_total_3h > 1000) AS precipitation_out,
  count(*) FILTER (WHERE humidity_avg_3h < 0 OR humidity_avg_3h > 100) AS humidity_out
FROM $frame_table GROUP BY station_id""", ids=("PRJ8", "DQ3"))
def q_revalidate(spark, sf):
    r = CL.revalidation_view(X.frame_table(spark, sf))
    c = lambda col, lo, hi: F.count_if((F.col(col) < lo) | (F.col(col) > hi))
    return r.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_frames"), c("temperature_c", -50, 60).alias("temperature_out"),
        c("wind_speed_ms", 0, 100).alias("wind_out"), c("precipitation_mm", 0, 1000).alias("precipitation_out"),
        c("relative_humidity", 0, 100).alias("humidity_out"))


@register("FLT1_lookback_frame", """station_id string, n_obs bigint, temp_median_3h double, wind_peak_3h double,
precip_total_3h double, baseline_comfort_score double, label_bucket string""", """
WITH w AS (SELECT * FROM $obs WHERE obs_ts BETWEEN (SELECT max(ts) FROM events) - INTERVAL 2 HOUR AND (SELECT max(ts) FROM events))
SELECT station_id, n_obs, med_t AS temp_median_3h, peak_w AS wind_peak_3h, tot_p AS precip_total_3h,
  greatest(0, 100 - ((CASE WHEN med_t BETWEEN 10 AND 25 THEN 0 WHEN med_t < 10 THEN least(40, (10 - med_t) * 2.5) ELSE least(40, (med_t - 25) * 1.8) END)
    + (least(45, rain * 10) + least(50, snow * 15)) + (CASE WHEN peak_w <= 4 THEN 0 ELSE least(25, (peak_w - 4) * 3) END)
    + (CASE WHEN mean_h IS NULL THEN 0 WHEN mean_h BETWEEN 30 AND 70 THEN 0 ELSE least(15, abs(mean_h - 50) * 0.4) END))) AS baseline_comfort_score,
  CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 60 THEN 'good' WHEN s >= 50 THEN 'uncomfortable' ELSE 'harsh' END AS label_bucket
FROM (SELECT *, greatest(0, 100 - ((CASE WHEN med_t BETWEEN 10 AND 25 THEN 0 WHEN med_t < 10 THEN least(40, (10 - med_t) * 2.5) ELSE least(40, (med_t - 25) * 1.8) END)
    + (least(45, rain * 10) + least(50, snow * 15)) + (CASE WHEN peak_w <= 4 THEN 0 ELSE least(25, (peak_w - 4) * 3) END)
    + (CASE WHEN mean_h IS NULL THEN 0 WHEN mean_h BETWEEN 30 AND 70 THEN 0 ELSE least(15, abs(mean_h - 50) * 0.4) END))) AS s
  FROM (SELECT station_id, count(*) AS n_obs, median(temperature_c) AS med_t, max(wind_speed_ms) AS peak_w,
          coalesce(sum(precipitation_mm), 0) AS tot_p, avg(relative_humidity) AS mean_h,
          coalesce(sum(CASE WHEN precipitation_mm > 0 AND precipitation_type <> 'snow' THEN precipitation_mm END), 0) AS rain,
          coalesce(sum(CASE WHEN precipitation_mm > 0 AND precipitation_type = 'snow' THEN precipitation_mm END), 0) AS snow
        FROM w GROUP BY station_id))""", ids=("FLT1", "WIN2"))
def q_lookback(spark, sf):
    as_of = T.max_value(T.table(spark, sf, "events"), "ts")
    w = lookback(X.obs(spark, sf), as_of, hours=3)
    f = frame_features(w, keys=("station_id",))
    return f.select("station_id", "n_obs", "temp_median_3h", "wind_peak_3h", "precip_total_3h",
                    "baseline_comfort_score", "label_bucket")


@register("SRC6_event_time_range_scan", "station_id string, n_rows bigint, first_ts timestamp, last_ts timestamp", """
SELECT CAST(100 + user_id % 10 AS VARCHAR) AS station_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts
FROM events WHERE ts BETWEEN (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND (SELECT max(ts) FROM events)
GROUP BY ALL""", ids=("SRC6", "FLT2"))
def q_range_scan(spark, sf):
    ev = T.table(spark, sf, "events")
    as_of = T.max_value(ev, "ts")
    # literal bounds: the predicate is pushed into the parquet scan (row-group pruning)
    lo = F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    d = ev.where(F.col("ts").between(lo, F.lit(as_of).cast("timestamp_ntz")))
    return d.groupBy((F.lit(100) + F.col("user_id") % 10).cast("string").alias("station_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@register("MTH3_dynamic_minmax", "event_id bigint, temperature_c_norm double, wind_speed_ms_norm double", """
SELECT event_id,
  CASE WHEN mx_t = mn_t THEN 0.5 ELSE (temperature_c - mn_t) / (mx_t - mn_t) END AS temperature_c_norm,
  CASE WHEN mx_w = mn_w THEN 0.5 ELSE (wind_speed_ms - mn_w) / (mx_w - mn_w) END AS wind_speed_ms_norm
FROM $frames3h JOIN (SELECT station_id, window_start, min(temperature_c) AS mn_t, max(temperature_c) AS mx_t,
  min(wind_speed_ms) AS mn_w, max(wind_speed_ms) AS mx_w FROM $frames3h GROUP BY ALL) USING (station_id, window_start)""",
          ids=("MTH3", "JN3"))
def q_minmax(spark, sf):
    d = ST.dynamic_minmax(X.frames(spark, sf), ["station_id", "window_start"], ["temperature_c", "wind_speed_ms"])
    return d.select("event_id", "temperature_c_norm", "wind_speed_ms_norm")


@register("JSN1_MAP1_ARR2_nested", """station_id string, window_start timestamp, has_snow boolean, n_types int,
details_json string, detail_key string, detail_value double""", """
SELECT station_id, window_start, has_snow, n_types,
  json_object('station_id', station_id, 'k_max', k_max)::VARCHAR AS details_json, k AS detail_key, v AS detail_value FROM (
  SELECT station_id, window_start, bool_or(precipitation_type = 'snow') AS has_snow,
    CAST(count(DISTINCT precipitation_type) AS INTEGER) AS n_types,
    max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS k_max,
    max(temperature_c) AS tmax, min(temperature_c) AS tmin
  FROM $frames3h JOIN (SELECT event_id, props FROM events) e USING (event_id) GROUP BY station_id, window_start) g,
  (VALUES ('detail_tmax'), ('detail_tmin')) t(k), LATERAL (SELECT CASE WHEN k = 'detail_tmax' THEN tmax ELSE tmin END AS v)""",
          ids=("JSN1", "MAP1", "ARR2"))
def q_nested(spark, sf):
    ev = T.table(spark, sf, "events")
    fr = tumbling(with_precipitation_type(T.observations_from_events(ev, "props")))
    parsed = fr.withColumn("p", F.from_json("props", "k INT"))
    g = parsed.groupBy("station_id", "window_start").agg(
        F.collect_set("precipitation_type").alias("types"), F.max("p.k").alias("k_max"),
        F.max("temperature_c").alias("tmax"), F.min("temperature_c").alias("tmin"))
    details = F.transform_keys(F.create_map(F.lit("tmax"), F.col("tmax"), F.lit("tmin"), F.col("tmin")),
                               lambda k, v: F.concat(F.lit("detail_"), k))
    g = g.select("station_id", "window_start", F.array_contains("types", "snow").alias("has_snow"),
                 F.size("types").alias("n_types"),
                 F.to_json(F.struct("station_id", "k_max")).alias("details_json"), details.alias("details"))
    return g.select("*", F.explode("details").alias("detail_key", "detail_value")).drop("details")


@register("FTR11_pattern_index", "station_id string, window_start timestamp, pattern_index double, n_obs bigint",
          None, ids=("FTR11",))
def q_pattern(spark, sf):
    from gustframe.operators.pattern import pattern_index
    return pattern_index(X.frames(spark, sf))


@register("ML12_training_table", """station_id string, window_start timestamp, baseline_comfort_score double,
source string""", """
WITH u AS (
  SELECT station_id, window_start, baseline_comfort_score, 'v1' AS source, 1 AS ord FROM $frame_table
  UNION ALL
  SELECT station_id, window_start, baseline_comfort_score, 'v2', 2 FROM $frame_table WHERE n_obs >= 3)
SELECT station_id, window_start, baseline_comfort_score, source FROM u
WHERE window_start >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY
QUALIFY row_number() OVER (PARTITION BY station_id, window_start ORDER BY ord DESC) = 1""",
          ids=("ML12", "SET1", "FLT2", "DDP2", "SRT1"))
def q_training_table(spark, sf):
    ft = X.frame_table(spark, sf)
    v1 = ft.select("station_id", "window_start", "baseline_comfort_score").withColumn("source", F.lit("v1")) \
        .withColumn("ord", F.lit(1))
    v2 = ft.where(F.col("n_obs") >= 3).select("station_id", "window_start", "baseline_comfort_score") \
        .withColumn("source", F.lit("v2")).withColumn("ord", F.lit(2))
    u = v1.unionByName(v2)
    as_of = T.max_value(T.table(spark, sf, "events"), "ts")
    u = CL.lookback_cutoff(u, "window_start", as_of, days=14)
    d = CL.dedup_keep_last(u, ["station_id", "window_start"], ["ord"])
    return d.select("station_id", "window_start", "baseline_comfort_score", "source")


@register("DQ17_readiness_7d", "station_id string, sets_7d bigint, quality_7d double, ready boolean", """
SELECT station_id, count(*) AS sets_7d, avg(quality_score) AS quality_7d, count(*) >= 50 AND avg(quality_score) >= 0.6 AS ready
FROM $training_sets WHERE passed_gate AND window_start >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY
GROUP BY station_id""", ids=("DQ17", "FLT2"))
def q_readiness(spark, sf):
    as_of = T.max_value(T.table(spark, sf, "events"), "ts")
    s = CL.lookback_cutoff(training_sets(spark, sf).where("passed_gate"), "window_start", as_of, days=7)
    g = s.groupBy("station_id").agg(F.count(F.lit(1)).alias("sets_7d"), F.avg("quality_score").alias("quality_7d"))
    return g.withColumn("ready", (F.col("sets_7d") >= 50) & (F.col("quality_7d") >= 0.6))


@register("FLT5_JN6_request_scores", """station_id string, target_ts timestamp, target_period string,
in_service_window boolean, window_start timestamp, window_end timestamp, baseline_comfort_score double,
label_bucket string""", """
WITH r AS (SELECT DISTINCT station_id, date_trunc('hour', obs_ts) + INTERVAL 30 MINUTE AS target_ts FROM $observations)
SELECT r.station_id, r.target_ts,
  CASE WHEN hour(r.target_ts) BETWEEN 14 AND 19 THEN 'evening' ELSE 'morning' END AS target_period,
  (hour(r.target_ts) >= 6 AND hour(r.target_ts) < 9) OR hour(r.target_ts) BETWEEN 14 AND 18 AS in_service_window,
  f.window_start, f.window_end, f.baseline_comfort_score, f.label_bucket
FROM r ASOF LEFT JOIN $frame_table f ON r.station_id = f.station_id AND r.target_ts >= f.window_end""",
          ids=("FLT5", "JN6", "SCR1"))
def q_request_scores(spark, sf):
    from gustframe.plans.flows import score_requests
    o = T.observations(spark, sf)
    req = o.select("station_id", (trunc_ntz("hour", "obs_ts") + F.expr("INTERVAL 30 MINUTES"))
                   .alias("target_ts")).distinct()
    return score_requests(X.frame_table(spark, sf), req)
