"""Catalog: training statistics, gates and feature selection (AGG10/11, AGG24/25, JN4,
FSL1-FSL3, DQ14-DQ17, ML13)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from gustframe.operators import selection as SE
from gustframe.plans import common as X
from gustframe.plans.catalog_windows import training_sets
from gustframe.plans.registry import register
from gustframe.sources import tables as T

FEATURES = ("temp_median_3h", "temp_range_3h", "wind_peak_3h", "precip_total_3h", "humidity_avg_3h",
            "rain_total", "n_obs_d")
TARGET = "baseline_comfort_score"
EXPECTED_HOURS = 30 * 24


def _feature_table(spark, sf):
    return X.frame_table(spark, sf).withColumn("n_obs_d", F.col("n_obs").cast("double"))


def _feature_sql_source():
    return "(SELECT *, CAST(n_obs AS DOUBLE) AS n_obs_d FROM $frame_table)"


def _stats_sql():
    rows = []
    for f in FEATURES:
        rows.append(f"""SELECT '{f}' AS feature, var_samp({f}) AS variance, avg({f}) AS mean,
  count({f}) / count(*) AS completeness, count(DISTINCT {f}) / count({f}) AS unique_ratio,
  corr({f}, {TARGET}) AS target_corr FROM {_feature_sql_source()}""")
    base = "\nUNION ALL\n".join(rows)
    return f"""
SELECT *, 0.3 * (CASE WHEN mean = 0 THEN 0 ELSE least(1, variance / (mean + 1e-6)) END) + 0.3 * completeness
  + 0.2 * (CASE WHEN unique_ratio < 0.5 THEN least(1, 2 * unique_ratio) ELSE 1 END) + 0.2 * coalesce(abs(target_corr), 0.5)
  AS importance,
  0.7 * coalesce(abs(target_corr), 0) + 0.3 * (variance / (variance + 1)) AS training_score
FROM ({base})"""


STATS_SCHEMA = """feature string, variance double, mean double, completeness double, unique_ratio double,
target_corr double, importance double, training_score double"""


@register("FSL1_3_feature_scores", STATS_SCHEMA, _stats_sql(),
          ids=("FSL1", "FSL3", "AGG24", "AGG25", "PRJ6"))
def q_feature_scores(spark, sf):
    return SE.feature_stats(_feature_table(spark, sf), FEATURES, TARGET)


def _pairs_sql():
    rows = [f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM {_feature_sql_source()}"
            for a, b in combinations(FEATURES, 2)]
    return "\nUNION ALL\n".join(rows)


@register("JN4_AGG25_correlation_pairs", "feature_a string, feature_b string, corr double", _pairs_sql(),
          ids=("JN4", "AGG25"))
def q_pairs(spark, sf):
    return SE.correlation_pairs(_feature_table(spark, sf), FEATURES)


@register("FSL2_redundancy_selection", "feature string, importance double", f"""
WITH s AS ({_stats_sql()}), p AS ({_pairs_sql()}),
d AS (SELECT DISTINCT CASE WHEN sa.importance < sb.importance THEN p.feature_a ELSE p.feature_b END AS feature
      FROM p JOIN s sa ON sa.feature = p.feature_a JOIN s sb ON sb.feature = p.feature_b WHERE abs(p.corr) > 0.8)
SELECT feature, importance FROM s WHERE feature NOT IN (SELECT feature FROM d) AND importance > 0.1""",
          ids=("FSL2", "JN8"))
def q_redundancy(spark, sf):
    st, pairs = SE.profile(_feature_table(spark, sf), FEATURES, TARGET)
    return SE.redundancy_drop(st, pairs).select("feature", "importance")


@register("FSL3_training_selection", "feature string, training_score double", f"""
SELECT feature, training_score FROM ({_stats_sql()}) WHERE training_score >= 0.01
ORDER BY training_score DESC, feature LIMIT 50""", ids=("FSL3", "SRT4"))
def q_training_selection(spark, sf):
    st = SE.feature_stats(_feature_table(spark, sf), FEATURES, TARGET)
    return SE.training_selection(st).select("feature", "training_score")


TS_SCHEMA = """station_id string, total_sets bigint, total_observations bigint, first_set timestamp,
last_set timestamp, avg_quality double, min_score double, max_score double, mean_score double,
std_score double, duration_days double, completeness double, valid boolean, issues_text string,
ready_for_training boolean, gate_passed boolean"""

TS_SQL = f"""
SELECT *, total_sets >= 100 AS valid,
  array_to_string(list_filter([CASE WHEN total_sets < 100 THEN 'not enough samples' END,
    CASE WHEN avg_quality < 0.7 THEN 'low quality' END, CASE WHEN std_score < 0.1 THEN 'no score variance' END,
    CASE WHEN completeness < 0.5 THEN 'low completeness' END], lambda x: x IS NOT NULL), ', ') AS issues_text,
  total_sets >= 50 AND avg_quality >= 0.6 AS ready_for_training,
  std_score > 0 AND max_score - min_score > 0 AND avg_quality >= 0.6 AS gate_passed
FROM (SELECT station_id, count(*) AS total_sets, sum(n_obs) AS total_observations,
        min(window_start) AS first_set, max(window_start) AS last_set, avg(quality_score) AS avg_quality,
        min(baseline_comfort_score) AS min_score, max(baseline_comfort_score) AS max_score,
        avg(baseline_comfort_score) AS mean_score, stddev_pop(baseline_comfort_score) AS std_score,
        (epoch_us(max(window_start)) - epoch_us(min(window_start))) / 8.64e10 AS duration_days,
        least(1, count(*) * 3.0 / {EXPECTED_HOURS}) AS completeness
      FROM $training_sets WHERE passed_gate GROUP BY station_id)"""


@register("AGG10_11_DQ14_17_training_stats", TS_SCHEMA, TS_SQL,
          ids=("AGG10", "AGG11", "DQ14", "DQ17", "ML12"))
def q_training_stats(spark, sf):
    s = training_sets(spark, sf).where("passed_gate")
    g = s.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("total_sets"), F.sum("n_obs").alias("total_observations"),
        F.min("window_start").alias("first_set"), F.max("window_start").alias("last_set"),
        F.avg("quality_score").alias("avg_quality"), F.min(TARGET).alias("min_score"),
        F.max(TARGET).alias("max_score"), F.avg(TARGET).alias("mean_score"),
        F.stddev_pop(TARGET).alias("std_score"))
    dur = (F.unix_micros(F.col("last_set").cast("timestamp")) - F.unix_micros(F.col("first_set").cast("timestamp"))) / 8.64e10
    g = g.withColumn("duration_days", dur).withColumn(
        "completeness", F.least(F.lit(1.0), F.col("total_sets") * 3.0 / EXPECTED_HOURS))
    issues = F.filter(F.array(
        F.when(F.col("total_sets") < 100, F.lit("not enough samples")),
        F.when(F.col("avg_quality") < 0.7, F.lit("low quality")),
        F.when(F.col("std_score") < 0.1, F.lit("no score variance")),
        F.when(F.col("completeness") < 0.5, F.lit("low completeness"))), lambda x: x.isNotNull())
    return g.select("*", (F.col("total_sets") >= 100).alias("valid"),
                    F.array_join(issues, ", ").alias("issues_text"),
                    ((F.col("total_sets") >= 50) & (F.col("avg_quality") >= 0.6)).alias("ready_for_training"),
                    ((F.col("std_score") > 0) & (F.col("max_score") - F.col("min_score") > 0)
                     & (F.col("avg_quality") >= 0.6)).alias("gate_passed"))


@register("DQ15_16_daily_alerts", """station_id string, sets_24h bigint, quality_24h double, completeness_24h double, volume_alert boolean,
quality_alert boolean, completeness_alert boolean, event_grade string""", """
WITH s AS (SELECT * FROM $training_sets WHERE window_start >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR)
SELECT station_id, count(*) AS sets_24h, avg(quality_score) AS quality_24h, count(*) < 12 AS volume_alert,
  least(1, count(*) * 3.0 / 24) AS completeness_24h, least(1, count(*) * 3.0 / 24) < 0.5 AS completeness_alert,
  avg(quality_score) < 0.6 AS quality_alert,
  CASE WHEN avg(quality_score) * 100 >= 80 THEN 'info' WHEN avg(quality_score) * 100 >= 60 THEN 'warning' ELSE 'error' END AS event_grade
FROM s GROUP BY station_id""", ids=("DQ15", "DQ16", "FLT2"))
def q_daily_alerts(spark, sf):
    as_of = T.max_value(T.table(spark, sf, "events"), "ts")
    s = training_sets(spark, sf).where(F.col("window_start") >= F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS"))
    g = s.groupBy("station_id").agg(F.count(F.lit(1)).alias("sets_24h"), F.avg("quality_score").alias("quality_24h"))
    q = F.col("quality_24h") * 100
    share = F.least(F.lit(1.0), F.col("sets_24h") * 3.0 / 24)
    return g.select("*", share.alias("completeness_24h"), (F.col("sets_24h") < 12).alias("volume_alert"),
                    (F.col("quality_24h") < 0.6).alias("quality_alert"), (share < 0.5).alias("completeness_alert"),
                    F.when(q >= 80, "info").when(q >= 60, "warning").otherwise("error").alias("event_grade"))


@register("ML1_13_model_comparison", "model_name string, rmse double, mae double, r2 double, train_rows bigint, cv_rmse_mean double, cv_rmse_std double, passed boolean",
          None, ids=("ML1", "ML3", "ML4", "ML5", "ML6", "ML7", "ML8", "ML9", "ML10", "ML11", "ML13", "UDF4"),
          bench=False)
def q_models(spark, sf):
    from gustframe.operators import training as TR
    from gustframe.operators.windows import time_split
    ft = _feature_table(spark, sf).where(F.col("n_obs") >= 3)
    ft = time_split(ft, ["window_start", "station_id"], n_splits=3)
    metrics, _ = TR.compare_models(spark, ft, list(FEATURES), TARGET)
    return TR.gate(TR.with_cross_validation(spark, metrics, ft, list(FEATURES), TARGET, ["window_start", "station_id"]))


def _fold_sql():
    long = "\nUNION ALL\n".join(f"SELECT '{f}' AS feature, fold, {f} AS x, {TARGET} AS y FROM t" for f in FEATURES)
    return f"""
WITH t AS (SELECT *, ntile(5) OVER (ORDER BY window_start, station_id) AS fold FROM {_feature_sql_source()}
           WHERE n_obs >= 3 AND {TARGET} IS NOT NULL),
l AS ({long}),
rest AS (SELECT k.fold AS left_out, l.* FROM (SELECT DISTINCT fold FROM l) k JOIN l ON l.fold <> k.fold),
mid AS (SELECT left_out, feature, coalesce(median(x), 0) AS mid FROM rest GROUP BY left_out, feature),
fit AS (SELECT left_out, feature, any_value(mid) AS mid, avg(coalesce(x, mid)) AS mx, avg(y) AS my, count(*) AS n,
               covar_pop(y, coalesce(x, mid)) AS xy, var_pop(coalesce(x, mid)) AS xx
        FROM rest JOIN mid USING (left_out, feature) GROUP BY left_out, feature),
line AS (SELECT *, 'linear' AS model_name, CASE WHEN xx > 1e-10 THEN xy / xx ELSE 0 END AS slope FROM fit
         UNION ALL SELECT *, 'ridge', CASE WHEN xx > 1e-10 THEN xy / xx * n / (n + 1) ELSE 0 END FROM fit)
SELECT l.feature, model_name, l.fold, sqrt(avg((y - my - slope * (coalesce(x, mid) - mx)) ** 2)) AS rmse
FROM l JOIN line ON line.left_out = l.fold AND line.feature = l.feature GROUP BY l.feature, model_name, l.fold"""


@register("ML9_fold_errors", "feature string, model_name string, fold int, rmse double", _fold_sql(), ids=("ML9", "ML5", "ML6"))
def q_fold_errors(spark, sf):
    from gustframe.operators import training as TR
    from gustframe.operators.windows import contiguous_folds
    ft = TR.prepare(_feature_table(spark, sf).where(F.col("n_obs") >= 3), TARGET)
    return TR.univariate_fold_errors(spark, contiguous_folds(ft, ["window_start", "station_id"], 5), FEATURES, TARGET)
