"""Catalog: sink-shaped queries (SNK2b, SNK8) and set operations (SET1, SET2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustframe.functions.timefn import trunc_ntz
from gustframe.plans import common as X
from gustframe.sources import sinks as SK
from gustframe.sources import tables as T
from gustframe.plans.registry import register


@register("SNK2b_label_dataset", "station_id string, window_start timestamp, baseline_comfort_score double, label_bucket string, event_date date", """
SELECT station_id, window_start, baseline_comfort_score, label_bucket, CAST(window_start AS DATE) AS event_date
FROM $frame_table""", ids=("SNK2b",))
def q_labels(spark, sf):
    return SK.label_dataset(X.frame_table(spark, sf))


@register("SNK8_serving_snapshot", "model_name string, eval_ts timestamp, event_id bigint, prediction double", """
SELECT model_name, eval_ts, event_id, prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name, date_trunc('hour', eval_ts) ORDER BY eval_ts DESC, event_id DESC) AS rk FROM $predictions) p
WHERE rk = 1 AND eval_ts >= (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND""", ids=("SNK8",))
def q_snapshot(spark, sf):
    p = T.predictions(spark, sf).select("model_name", "eval_ts", "event_id", "prediction")
    return SK.latest_per_key(p, ["model_name", trunc_ntz("hour", "eval_ts")], "eval_ts",
                             T.max_value(T.table(spark, sf, "events"), "ts"), tie=("event_id",))


@register("SET1_2_union_feature_files", "station_id string, window_start timestamp, n_obs bigint, baseline_comfort_score double, source string", """
SELECT station_id, window_start, n_obs, baseline_comfort_score, 'primary' AS source FROM $frame_table
WHERE CAST(station_id AS INTEGER) % 2 = 0
UNION ALL
SELECT station_id, window_start, n_obs, NULL, 'fallback' FROM $frame_table WHERE CAST(station_id AS INTEGER) % 2 = 1""",
          ids=("SET1", "SET2"))
def q_union(spark, sf):
    ft = X.frame_table(spark, sf)
    even = ft.where(F.col("station_id").cast("int") % 2 == 0).select(
        "station_id", "window_start", "n_obs", "baseline_comfort_score").withColumn("source", F.lit("primary"))
    odd = ft.where(F.col("station_id").cast("int") % 2 == 1).select(
        "station_id", "window_start", "n_obs").withColumn("source", F.lit("fallback"))
    return even.unionByName(odd, allowMissingColumns=True)


def _folder(spark, name):
    import uuid
    from gustframe.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("SNK1_overlapping_loads", "station_id string, obs_date date, n_rows bigint, temperature_sum double", """
SELECT station_id, CAST(obs_ts AS DATE) AS obs_date, count(*) AS n_rows,
  sum(temperature_c + CASE WHEN hour(obs_ts) >= 12 THEN 1 ELSE 0 END) AS temperature_sum
FROM $observations GROUP BY ALL""", ids=("SNK1",))
def q_overlapping_loads(spark, sf):
    """All observations, then a load that holds the afternoons again, one degree warmer; read back."""
    obs = T.observations(spark, sf).select("station_id", "obs_ts", "event_id", "temperature_c")
    base = _folder(spark, "normalized")
    SK.write_normalized(obs, base, load_id="all")
    SK.write_normalized(obs.where(F.hour("obs_ts") >= 12).withColumn("temperature_c", F.col("temperature_c") + 1), base, load_id="noon")
    return (SK.read_normalized(spark, base).groupBy(F.col("station_id").cast("string").alias("station_id"), "obs_date")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("temperature_c").alias("temperature_sum")))


@register("SNK2_SRC5_feature_versions", "station_id string, window_start timestamp, n_obs bigint, baseline_comfort_score double", """
SELECT station_id, window_start, n_obs, baseline_comfort_score FROM $frame_table""", ids=("SNK2", "SRC5"))
def q_feature_versions(spark, sf):
    """The frame table written as two loads of version v1 (the second again holds half of it) beside a version v2."""
    ft = X.frame_table(spark, sf).select("station_id", "window_start", "n_obs", "baseline_comfort_score")
    base = _folder(spark, "features")
    SK.write_features(ft, base, "comfort", "v1", load_id="a")
    SK.write_features(ft.where(F.col("station_id").cast("int") % 2 == 0), base, "comfort", "v1", load_id="b")
    SK.write_features(ft.limit(10), base, "comfort", "v2")
    return SK.read_features(spark, base, "comfort", "v1").select("station_id", "window_start", "n_obs", "baseline_comfort_score")
