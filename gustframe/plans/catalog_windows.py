"""Catalog: sliding sets, trends, continuity, last-N, dedup, as-of and split operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustframe.functions.timefn import trunc_ntz
from gustframe.operators import clean as CL
from gustframe.operators import windows as WN
from gustframe.operators.frames import sliding_sets
from gustframe.operators.scores import baseline_score, frame_aggregates
from gustframe.operators.sequence import global_index
from gustframe.plans import common as X
from gustframe.plans.registry import register
from gustframe.sources import tables as T

SETS_SCHEMA = """station_id string, obs_date date, window_start timestamp, n_obs bigint,
completeness double, reasonableness double, consistency double, gap_consistency double,
quality_score double, baseline_comfort_score double, label_bucket string, passed_gate boolean"""


def set_members(spark, sf):
    """WIN1 membership rows of deduplicated observations (with same-day lag)."""
    o = CL.dedup_first_per_minute(X.obs(spark, sf))
    return sliding_sets(WN.with_day_lag(o))


def training_sets(spark, sf, min_obs: int = 3, members=None, extra_aggs=()):
    """WIN1 sets of deduplicated observations with DQ13 quality and the SCR1 score."""
    m = members if members is not None else set_members(spark, sf)
    g = m.groupBy("station_id", "obs_date", "window_start").agg(
        *frame_aggregates(), *WN.set_quality_aggregates(), *extra_aggs)
    g = g.where(F.col("n_obs") >= min_obs)
    g = baseline_score(g.select("*", *WN.set_quality_columns()))
    return g.withColumn("passed_gate", F.col("quality_score") >= 0.6)


@register("WIN1_DQ13_training_sets", SETS_SCHEMA, "SELECT * FROM $training_sets",
          ids=("WIN1", "DDP1", "DQ13", "WIN4", "WIN5", "FLT3", "SCR1", "AGG3"))
def q_training_sets(spark, sf):
    return training_sets(spark, sf)


TREND_SCHEMA = """station_id string, window_start timestamp, n_obs bigint, temp_trend double,
temp_volatility double, humidity_trend double, wind_trend double, pressure_tendency double,
weather_stability double"""

TREND_SQL = """
SELECT station_id, window_start, n_obs,
  CASE WHEN n_obs < 2 THEN 0 ELSE coalesce(st, 0) END AS temp_trend,
  CASE WHEN n_obs < 2 THEN 0 ELSE sdt END AS temp_volatility,
  CASE WHEN n_obs < 2 THEN 0 ELSE coalesce(sh, 0) END AS humidity_trend,
  CASE WHEN n_obs < 2 THEN 0 ELSE coalesce(sw, 0) END AS wind_trend,
  CASE WHEN n_obs < 3 THEN 0 ELSE greatest(-1, least(1, -((t_last - t_first3) * 0.1 + (h_last - h_first3) * 0.05))) END
    AS pressure_tendency,
  CASE WHEN n_obs < 2 THEN 0.5 ELSE ((1 - least(1, sdt / 10)) + (1 - least(1, sdw / 5)) + (1 - least(1, sdp / 5))) / 3 END
    AS weather_stability
FROM (
  SELECT station_id, window_start, count(*) AS n_obs,
    regr_slope(temperature_c, i) AS st, regr_slope(h, i) AS sh, regr_slope(wind_speed_ms, i) AS sw,
    stddev_pop(temperature_c) AS sdt, stddev_pop(wind_speed_ms) AS sdw, stddev_pop(precipitation_mm) AS sdp,
    arg_max(temperature_c, i) FILTER (WHERE i > n - 3) AS t_last,
    arg_min(temperature_c, i) FILTER (WHERE i > n - 3) AS t_first3,
    arg_max(h, i) FILTER (WHERE i > n - 3) AS h_last,
    arg_min(h, i) FILTER (WHERE i > n - 3) AS h_first3
  FROM (SELECT *, CAST(row_number() OVER w AS DOUBLE) AS i, count(*) OVER (PARTITION BY station_id, window_start) AS n,
          CASE WHEN relative_humidity IS NULL OR relative_humidity = 0 THEN 50 ELSE relative_humidity END AS h
        FROM $frames3h WINDOW w AS (PARTITION BY station_id, window_start ORDER BY obs_ts, event_id))
  GROUP BY ALL)"""


@register("FTR5_frame_trends", TREND_SCHEMA, TREND_SQL, ids=("FTR5", "WIN6", "WIN7"))
def q_frame_trends(spark, sf):
    return WN.frame_trends(X.frames(spark, sf))


CONT_SCHEMA = """station_id string, n_rows bigint, n_gaps bigint, irregular_count bigint,
max_gap_hours double, min_gap_hours double, passed boolean, severity string"""

CONT_SQL = """
SELECT station_id, count(*) AS n_rows, count(gap) AS n_gaps,
  count(*) FILTER (WHERE gap < 1 - 10 / 60.0 OR gap > 1 + 10 / 60.0) AS irregular_count,
  max(gap) AS max_gap_hours, min(gap) AS min_gap_hours,
  count(*) FILTER (WHERE gap < 1 - 10 / 60.0 OR gap > 1 + 10 / 60.0) = 0 AS passed,
  CASE WHEN count(gap) = 0 THEN 'info'
       WHEN count(*) FILTER (WHERE gap < 1 - 10 / 60.0 OR gap > 1 + 10 / 60.0) > 0 THEN 'warning' ELSE 'info' END AS severity
FROM (SELECT station_id, (epoch_us(obs_ts) - epoch_us(lag(obs_ts) OVER (PARTITION BY station_id ORDER BY obs_ts, event_id))) / 3.6e9 AS gap
      FROM $observations)
GROUP BY station_id"""


@register("WIN3_DQ4_continuity", CONT_SCHEMA, CONT_SQL, ids=("WIN3", "DQ4"))
def q_continuity(spark, sf):
    c = WN.continuity(T.observations(spark, sf))
    return (c.withColumn("passed", F.col("irregular_count") == 0)
            .withColumn("severity", F.when(F.col("n_gaps") == 0, "info")
                        .when(F.col("irregular_count") > 0, "warning").otherwise("info")))


CHANGE_SCHEMA = """station_id string, n_rows bigint, temperature_c_change_pct double, temperature_c_std double,
wind_speed_ms_change_pct double, wind_speed_ms_std double, precipitation_mm_change_pct double,
precipitation_mm_std double"""

CHANGE_SQL = """
SELECT station_id, count(*) AS n_rows,
  (arg_min(temperature_c, rk) - arg_max(temperature_c, rk)) / abs(arg_max(temperature_c, rk) + 1e-6) * 100 AS temperature_c_change_pct,
  stddev_pop(temperature_c) AS temperature_c_std,
  (arg_min(wind_speed_ms, rk) - arg_max(wind_speed_ms, rk)) / abs(arg_max(wind_speed_ms, rk) + 1e-6) * 100 AS wind_speed_ms_change_pct,
  stddev_pop(wind_speed_ms) AS wind_speed_ms_std,
  (arg_min(precipitation_mm, rk) - arg_max(precipitation_mm, rk)) / abs(arg_max(precipitation_mm, rk) + 1e-6) * 100 AS precipitation_mm_change_pct,
  stddev_pop(precipitation_mm) AS precipitation_mm_std
FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY obs_ts DESC, event_id DESC) AS rk FROM $observations)
WHERE rk <= 24 GROUP BY station_id"""


@register("WIN8_recent_change", CHANGE_SCHEMA, CHANGE_SQL, ids=("WIN8", "WIN9", "SRT3"))
def q_recent_change(spark, sf):
    o = T.observations(spark, sf)
    last = WN.last_n(o, ["station_id"], ["obs_ts", "event_id"], 24)
    return WN.first_last_change(last, ["station_id"],
                                ["temperature_c", "wind_speed_ms", "precipitation_mm"])


LASTN_SCHEMA = "model_name string, event_id bigint, eval_ts timestamp, recency_rank bigint"
LASTN_SQL = """
SELECT model_name, event_id, eval_ts, rk AS recency_rank
FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY eval_ts DESC, event_id DESC) AS rk FROM $predictions)
WHERE rk <= 100"""


@register("WIN9_last_100_predictions", LASTN_SCHEMA, LASTN_SQL, ids=("WIN9", "SRT3"))
def q_last_n(spark, sf):
    p = T.predictions(spark, sf)
    return WN.last_n(p, ["model_name"], ["eval_ts", "event_id"], 100).select("model_name", "event_id", "eval_ts",
                                                                  "recency_rank")


LATEST_SCHEMA = """station_id string, obs_ts timestamp, event_id bigint, temperature_c double,
wind_speed_ms double, precipitation_mm double, relative_humidity double"""
LATEST_SQL = """
SELECT station_id, obs_ts, event_id, temperature_c, wind_speed_ms, precipitation_mm, relative_humidity
FROM $observations QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY obs_ts DESC, event_id DESC) = 1"""


@register("SRT2_latest_per_station", LATEST_SCHEMA, LATEST_SQL, ids=("SRT2",))
def q_latest(spark, sf):
    o = T.observations(spark, sf)
    cols = ["obs_ts", "event_id", "temperature_c", "wind_speed_ms", "precipitation_mm", "relative_humidity"]
    g = o.groupBy("station_id").agg(F.max_by(F.struct(*cols), F.struct("obs_ts", "event_id")).alias("r"))
    return g.select("station_id", "r.*")


TOPK_SCHEMA = "station_id string, window_start timestamp, n_obs bigint, baseline_comfort_score double"
TOPK_SQL = """
SELECT station_id, window_start, n_obs, baseline_comfort_score FROM $frame_table
WHERE n_obs >= 3 ORDER BY baseline_comfort_score DESC, station_id, window_start LIMIT 10"""


@register("SRT4_top10_frames", TOPK_SCHEMA, TOPK_SQL, ids=("SRT4",))
def q_topk(spark, sf):
    f = X.frame_table(spark, sf).where(F.col("n_obs") >= 3)
    return (f.orderBy(F.col("baseline_comfort_score").desc(), "station_id", "window_start")
            .limit(10).select("station_id", "window_start", "n_obs", "baseline_comfort_score"))


SORT_SCHEMA = "position bigint, station_id string, obs_ts timestamp, event_id bigint"
SORT_SQL = """
SELECT row_number() OVER (ORDER BY obs_ts, event_id) AS position, station_id, obs_ts, event_id FROM $observations"""


@register("SRT1_time_order", SORT_SCHEMA, SORT_SQL, ids=("SRT1",))
def q_sorted(spark, sf):
    o = T.observations(spark, sf)
    d = global_index(o, ["obs_ts", "event_id"], index_col="position")
    return d.select("position", "station_id", "obs_ts", "event_id")


DEDUP_SCHEMA = "station_id string, minute_ts timestamp, event_id bigint, obs_ts timestamp"


@register("DDP1_dedup_first_per_minute", DEDUP_SCHEMA, """
SELECT station_id, date_trunc('minute', obs_ts) AS minute_ts, event_id, obs_ts FROM $observations
QUALIFY row_number() OVER (PARTITION BY station_id, date_trunc('minute', obs_ts) ORDER BY obs_ts, event_id) = 1""",
          ids=("DDP1", "DTM3"))
def q_dedup_first(spark, sf):
    d = CL.dedup_first_per_minute(T.observations(spark, sf))
    return d.select("station_id", trunc_ntz("minute", "obs_ts").alias("minute_ts"), "event_id", "obs_ts")


@register("DDP2_dedup_keep_last", DEDUP_SCHEMA, """
SELECT station_id, date_trunc('minute', obs_ts) AS minute_ts, event_id, obs_ts FROM $observations
QUALIFY row_number() OVER (PARTITION BY station_id, date_trunc('minute', obs_ts) ORDER BY obs_ts DESC, event_id DESC) = 1""",
          ids=("DDP2",))
def q_dedup_last(spark, sf):
    o = T.observations(spark, sf).withColumn("minute_ts", trunc_ntz("minute", "obs_ts"))
    d = CL.dedup_keep_last(o, ["station_id", "minute_ts"], ["obs_ts", "event_id"])
    return d.select("station_id", "minute_ts", "event_id", "obs_ts")


@register("DDP3_duplicate_count", "station_id string, duplicate_count bigint", """
SELECT station_id, count(*) - count(DISTINCT date_trunc('minute', obs_ts)) AS duplicate_count
FROM $observations GROUP BY station_id""", ids=("DDP3", "DQ8"))
def q_dup_count(spark, sf):
    o = T.observations(spark, sf).withColumn("minute_ts", trunc_ntz("minute", "obs_ts"))
    return CL.duplicate_count(o, "minute_ts", ["station_id"])


ASOF_SCHEMA = """station_id string, target_ts timestamp, obs_ts timestamp, event_id bigint,
temperature_c double"""
ASOF_SQL = """
WITH r AS (SELECT DISTINCT station_id, date_trunc('hour', obs_ts) + INTERVAL 30 MINUTE AS target_ts FROM $observations)
SELECT r.station_id, r.target_ts,
  max({'t': o.obs_ts, 'e': o.event_id}).t AS obs_ts,
  max({'t': o.obs_ts, 'e': o.event_id}).e AS event_id,
  arg_max(o.temperature_c, {'t': o.obs_ts, 'e': o.event_id}) AS temperature_c
FROM r LEFT JOIN $observations o ON o.station_id = r.station_id AND o.obs_ts <= r.target_ts
  AND o.obs_ts > r.target_ts - INTERVAL 3 HOUR
GROUP BY r.station_id, r.target_ts"""


@register("JN6_as_of_latest", ASOF_SCHEMA, ASOF_SQL, ids=("JN6",))
def q_as_of(spark, sf):
    o = T.observations(spark, sf)
    req = o.select("station_id", (trunc_ntz("hour", "obs_ts") + F.expr("INTERVAL 30 MINUTES"))
                   .alias("target_ts")).distinct()
    return WN.as_of_lookup(req, o, value_cols=["temperature_c"])


SPLIT_SCHEMA = "station_id string, obs_date date, window_start timestamp, is_test boolean, fold int"
SPLIT_SQL = """
SELECT station_id, obs_date, window_start,
  row_number() OVER o > count(*) OVER () - floor(count(*) OVER () / 4) AS is_test,
  ntile(5) OVER o AS fold
FROM $training_sets WINDOW o AS (ORDER BY window_start, station_id)"""


@register("WIN14_15_time_split_folds", SPLIT_SCHEMA, SPLIT_SQL, ids=("WIN14", "WIN15", "ML3"))
def q_splits(spark, sf):
    s = training_sets(spark, sf).select("station_id", "obs_date", "window_start")
    order = ["window_start", "station_id"]
    return WN.split_and_folds(s, order, n_splits=3, k=5)


CAP_SCHEMA = "station_id string, window_start timestamp, attempt_no int"
CAP_SQL = """
SELECT station_id, window_start, attempt_no FROM (
  SELECT station_id, window_start,
    row_number() OVER (PARTITION BY station_id, CAST(window_start AS DATE) ORDER BY window_start) AS attempt_no
  FROM $frame_table WHERE n_obs >= 3) WHERE attempt_no <= 3"""


@register("WIN13_daily_attempt_cap", CAP_SCHEMA, CAP_SQL, ids=("WIN13",))
def q_daily_cap(spark, sf):
    f = X.frame_table(spark, sf).where(F.col("n_obs") >= 3)
    return WN.per_day_cap(f, ["station_id"], "window_start", ["window_start"]) \
        .select("station_id", "window_start", "attempt_no")
