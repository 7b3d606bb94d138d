"""Catalog: model evaluation and history operators (AGG13-AGG16, EVL1-EVL14, SRT5, SRC9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustframe.functions.timefn import trunc_ntz
from gustframe.operators import evaluate as EV
from gustframe.plans.registry import register
from gustframe.sources import tables as T

PRODUCTION = "view"
MM_SCHEMA = """model_name string, eval_day timestamp, sample_count bigint, mae double, mse double,
rmse double, r2 double, mape double, mape_pct double, prediction_confidence double,
data_quality_score double, prediction_latency_ms double"""


def model_metrics(spark, sf):
    p = T.predictions(spark, sf).withColumn("eval_day", trunc_ntz("day", "eval_ts"))
    return EV.regression_metrics(p, ["model_name", "eval_day"])


@register("EVL1_AGG13_14_model_metrics", MM_SCHEMA, "SELECT * FROM $model_metrics",
          ids=("EVL1", "AGG13", "AGG14", "JN1"))
def q_model_metrics(spark, sf):
    return model_metrics(spark, sf)


@register("EVL2_4_verdicts", """model_name string, eval_day timestamp, issues_text string, n_issues int,
is_valid boolean, confidence_score double""", """
SELECT model_name, eval_day, array_to_string(issues, ', ') AS issues_text, len(issues) AS n_issues,
  len(issues) = 0 AS is_valid,
  greatest(0, least(1, 0.25 * least(1, r2 / 0.7) + 0.2 * greatest(0, 1 - mae / 0.5)
    + 0.2 * greatest(0, 1 - mape_pct / 15) + 0.2 * prediction_confidence / 0.8
    + 0.15 * data_quality_score / 100)) AS confidence_score
FROM (SELECT *, list_filter([CASE WHEN r2 < 0.7 THEN 'r2 below limit' END,
    CASE WHEN mae > 0.5 THEN 'mae above limit' END, CASE WHEN mape_pct > 15 THEN 'mape above limit' END,
    CASE WHEN prediction_confidence < 0.8 THEN 'low confidence' END,
    CASE WHEN prediction_latency_ms > 1000 THEN 'latency above limit' END], lambda x: x IS NOT NULL) AS issues
  FROM $model_metrics)""", ids=("EVL2", "EVL4", "ARR1", "STR4"))
def q_verdicts(spark, sf):
    m = EV.confidence_score(EV.accuracy_issues(model_metrics(spark, sf)))
    return m.select("model_name", "eval_day", F.array_join("issues", ", ").alias("issues_text"),
                    F.size("issues").alias("n_issues"), "is_valid", "confidence_score")


RECENT_SQL = """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY eval_day DESC) AS rk,
             count(*) OVER (PARTITION BY model_name) AS history_rows FROM $model_metrics),
g AS (SELECT model_name, any_value(history_rows) AS history_rows, stddev_pop(r2) AS r2_std_recent,
        avg(r2) FILTER (WHERE rk > 3) AS r2_early_mean, avg(r2) FILTER (WHERE rk <= 3) AS r2_late_mean,
        regr_slope(r2, 7 - rk) AS r2_slope, regr_slope(mae, 7 - rk) AS mae_slope,
        arg_max(r2, eval_day) AS r2_latest, arg_max(mae, eval_day) AS mae_latest,
        arg_max(data_quality_score, eval_day) AS dq_latest, arg_max(prediction_latency_ms, eval_day) AS latency_latest,
        arg_max(prediction_confidence, eval_day) AS confidence_latest, arg_max(sample_count, eval_day) AS samples_latest
      FROM h WHERE rk <= 7 GROUP BY model_name)
SELECT model_name, history_rows, r2_std_recent, r2_slope, mae_slope,
  (r2_early_mean - r2_late_mean) / abs(r2_early_mean) AS r2_drop,
  history_rows < 24 OR (r2_std_recent <= 0.05 AND coalesce((r2_early_mean - r2_late_mean) / abs(r2_early_mean), 0) <= 0.1) AS is_stable,
  CASE WHEN r2_slope < -0.01 THEN 'declining' WHEN r2_slope > 0.01 THEN 'improving' ELSE 'stable' END AS r2_trend,
  CASE WHEN mae_slope < -0.01 THEN 'improving' WHEN mae_slope > 0.01 THEN 'declining' ELSE 'stable' END AS mae_trend,
  array_to_string(list_filter([CASE WHEN r2_latest < 0.7 THEN 'accuracy below limit' END,
    CASE WHEN mae_latest > 0.5 THEN 'error above limit' END, CASE WHEN r2_slope < -0.01 THEN 'declining trend' END,
    CASE WHEN dq_latest < 70 THEN 'low data quality' END], lambda x: x IS NOT NULL), ', ') AS retrain_reasons,
  len(list_filter([CASE WHEN r2_latest < 0.7 THEN 'a' END, CASE WHEN mae_latest > 0.5 THEN 'b' END,
    CASE WHEN r2_slope < -0.01 THEN 'c' END, CASE WHEN dq_latest < 70 THEN 'd' END], lambda x: x IS NOT NULL)) > 0 AS needs_retraining,
  array_to_string(list_filter([CASE WHEN latency_latest > 500 THEN 'optimise latency' END,
    CASE WHEN dq_latest < 80 THEN 'improve feature quality' END, CASE WHEN confidence_latest < 0.9 THEN 'review confidence' END,
    CASE WHEN samples_latest < 24 THEN 'collect more samples' END], lambda x: x IS NOT NULL), ', ') AS recommendations
FROM g"""


@register("EVL3_5_6_stability_trends", """model_name string, history_rows bigint, r2_std_recent double,
r2_slope double, mae_slope double, r2_drop double, is_stable boolean, r2_trend string, mae_trend string,
retrain_reasons string, needs_retraining boolean, recommendations string""", RECENT_SQL,
          ids=("EVL3", "EVL5", "EVL6", "WIN12", "WIN6"))
def q_recent(spark, sf):
    g = EV.recent_window_stats(model_metrics(spark, sf))
    return g.select("model_name", "history_rows", "r2_std_recent", "r2_slope", "mae_slope", "r2_drop",
                    "is_stable", "r2_trend", "mae_trend",
                    F.array_join("retrain_reasons", ", ").alias("retrain_reasons"), "needs_retraining",
                    F.array_join("recommendations", ", ").alias("recommendations"))


@register("EVL7_baseline_comparison", """model_name string, cur_r2 double, base_r2 double, r2_change_pct double,
cur_mae double, base_mae double, mae_change_pct double, cur_rmse double, base_rmse double, rmse_change_pct double,
status string""", """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY eval_day DESC) AS rk FROM $model_metrics),
c AS (SELECT model_name, r2 AS cur_r2, mae AS cur_mae, rmse AS cur_rmse FROM h WHERE rk = 1),
b AS (SELECT model_name, avg(r2) AS base_r2, avg(mae) AS base_mae, avg(rmse) AS base_rmse FROM h WHERE rk BETWEEN 2 AND 8 GROUP BY model_name HAVING count(*) >= 7)
SELECT c.*, base_r2, base_mae, base_rmse, (cur_r2 - base_r2) / base_r2 * 100 AS r2_change_pct,
  (cur_mae - base_mae) / base_mae * 100 AS mae_change_pct, (cur_rmse - base_rmse) / base_rmse * 100 AS rmse_change_pct,
  CASE WHEN b.model_name IS NULL THEN 'insufficient_baseline_data' ELSE 'compared' END AS status
FROM c LEFT JOIN b ON b.model_name = c.model_name""",
          ids=("EVL7", "JN7"))
def q_baseline(spark, sf):
    return EV.baseline_comparison(model_metrics(spark, sf))


@register("EVL8_degradation_vs_production", """model_name string, eval_day timestamp, rmse double,
prod_rmse double, degradation double, degraded boolean""", f"""
SELECT m.model_name, m.eval_day, m.rmse, p.rmse AS prod_rmse, (m.rmse - p.rmse) / p.rmse AS degradation,
  coalesce((m.rmse - p.rmse) / p.rmse > 0.15, false) OR m.rmse > 8.0 AS degraded
FROM $model_metrics m LEFT JOIN (SELECT eval_day, rmse FROM $model_metrics WHERE model_name = '{PRODUCTION}') p USING (eval_day)""",
          ids=("EVL8", "JN7"))
def q_degradation(spark, sf):
    return EV.degradation_vs_production(model_metrics(spark, sf), PRODUCTION)


def _trend_sql():
    cols = []
    for c in ("rmse", "mae", "r2"):
        cols += [f"avg({c}) AS {c}_mean", f"stddev_samp({c}) AS {c}_std", f"min({c}) AS {c}_min", f"max({c}) AS {c}_max"]
    return f"""
SELECT *, rmse_recent_mean > 1.1 * rmse_mean AS degrading_alert FROM (
  SELECT model_name, {', '.join(cols)}, avg(rmse) FILTER (WHERE rk <= 5) AS rmse_recent_mean
  FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY eval_day DESC) AS rk FROM $model_metrics)
  GROUP BY model_name)"""


@register("AGG16_EVL9_run_trends", """model_name string, rmse_mean double, rmse_std double, rmse_min double,
rmse_max double, mae_mean double, mae_std double, mae_min double, mae_max double, r2_mean double, r2_std double,
r2_min double, r2_max double, rmse_recent_mean double, degrading_alert boolean""", _trend_sql(),
          ids=("AGG16", "EVL9"))
def q_run_trends(spark, sf):
    return EV.run_trend_stats(model_metrics(spark, sf))


@register("EVL11_promotion_readiness", "model_name string, r2 double, mae double, prod_r2 double, issues_text string, ready boolean", f"""
WITH l AS (SELECT * FROM $model_metrics QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY eval_day DESC) = 1)
SELECT model_name, r2, mae, prod_r2, array_to_string(iss, ', ') AS issues_text, len(iss) = 0 AS ready FROM (
  SELECT l.*, p.prod_r2, list_filter([CASE WHEN r2 < 0.7 THEN 'r2 below limit' END, CASE WHEN mae > 0.5 THEN 'mae above limit' END,
     CASE WHEN r2 < 0.95 * p.prod_r2 THEN 'worse than production' END], lambda x: x IS NOT NULL) AS iss
  FROM l, (SELECT r2 AS prod_r2 FROM l WHERE model_name = '{PRODUCTION}') p)""", ids=("EVL11",))
def q_promotion(spark, sf):
    r = EV.promotion_readiness(model_metrics(spark, sf), PRODUCTION)
    return r.select("model_name", "r2", "mae", "prod_r2", F.array_join("issues", ", ").alias("issues_text"), "ready")


@register("EVL12_stage_retention", "model_name string, eval_day timestamp, recent_rank int", """
SELECT model_name, eval_day, rk AS recent_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY eval_day DESC) AS rk FROM $model_metrics) WHERE rk <= 5""",
          ids=("EVL12", "WIN9"))
def q_retention(spark, sf):
    h = EV.history_positions(model_metrics(spark, sf))
    return h.where(F.col("recent_rank") <= 5).select("model_name", "eval_day", "recent_rank")


@register("EVL13_canary_rollback", "model_name string, rollback_step int, max_degradation double", """
SELECT model_name, min(step) FILTER (WHERE degradation > 0.1) AS rollback_step, max(degradation) AS max_degradation
FROM (SELECT model_name, row_number() OVER w AS step,
        greatest(0, first(r2) OVER w - r2) / first(r2) OVER w AS degradation
      FROM $model_metrics WINDOW w AS (PARTITION BY model_name ORDER BY eval_day))
GROUP BY model_name""", ids=("EVL13",))
def q_canary(spark, sf):
    return EV.canary_rollback(model_metrics(spark, sf))


@register("EVL14_run_retention", "model_name string, eval_day timestamp, stage string, to_delete boolean", f"""
SELECT model_name, eval_day, stage, eval_day < (SELECT max(eval_ts) FROM events) - INTERVAL 30 DAY
  AND coalesce(stage, '') NOT IN ('Production', 'Staging') AS to_delete
FROM (SELECT *, CASE model_name WHEN '{PRODUCTION}' THEN 'Production' WHEN 'click' THEN 'Staging' END AS stage
      FROM $model_metrics), (SELECT max(ts) AS eval_ts FROM events) e""".replace("(SELECT max(eval_ts) FROM events)", "e.eval_ts"),
          ids=("EVL14", "FLT2"))
def q_run_retention(spark, sf):
    m = model_metrics(spark, sf)
    as_of = T.max_value(T.table(spark, sf, "events"), "ts")
    stage = F.when(F.col("model_name") == PRODUCTION, "Production").when(F.col("model_name") == "click", "Staging")
    cut = F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")
    return m.select("model_name", "eval_day", stage.alias("stage"),
                    ((F.col("eval_day") < cut) & ~F.coalesce(stage, F.lit("")).isin("Production", "Staging")).alias("to_delete"))


@register("SRT5_best_model_per_day", "eval_day timestamp, best_model string, best_rmse double", """
SELECT eval_day, model_name AS best_model, rmse AS best_rmse FROM $model_metrics
QUALIFY row_number() OVER (PARTITION BY eval_day ORDER BY rmse, model_name) = 1""",
          ids=("SRT5", "ML10"))
def q_best(spark, sf):
    m = model_metrics(spark, sf)
    best = m.groupBy("eval_day").agg(F.min(F.struct("rmse", "model_name")).alias("b"))
    return best.select("eval_day", F.col("b.model_name").alias("best_model"), F.col("b.rmse").alias("best_rmse"))


@register("SRC9_metric_history", "model_name string, eval_day timestamp, rmse double, r2 double", f"""
SELECT model_name, eval_day, rmse, r2 FROM $model_metrics WHERE model_name = '{PRODUCTION}'
ORDER BY eval_day DESC LIMIT 10""", ids=("SRC9",))
def q_history(spark, sf):
    m = model_metrics(spark, sf).where(F.col("model_name") == PRODUCTION)
    return m.orderBy(F.col("eval_day").desc()).limit(10).select("model_name", "eval_day", "rmse", "r2")


# Registered models: those that predict, and a candidate that has not predicted yet.
CANDIDATE = "candidate"


@register("EVL10_health_grade", "model_name string, model_present boolean, failed_checks int, health string", f"""
SELECT model_name, model_present, f AS failed_checks, CASE WHEN f >= 2 THEN 'critical' WHEN f = 1 THEN 'warning' ELSE 'healthy' END AS health
FROM (SELECT model_name, last_day IS NOT NULL AS model_present,
   CAST(last_day IS NULL AS INT) + CAST(NOT coalesce(last_day >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR, false) AS INT)
   + CAST(NOT coalesce(rmse_last < 0.2, false) AS INT) + CAST(NOT coalesce(dq_last / 100 >= 0.8, false) AS INT) AS f
  FROM (SELECT DISTINCT event_type AS model_name FROM events UNION SELECT '{CANDIDATE}') r
  LEFT JOIN (SELECT model_name, max(eval_day) AS last_day, arg_max(rmse, eval_day) AS rmse_last,
               arg_max(data_quality_score, eval_day) AS dq_last FROM $model_metrics GROUP BY model_name) USING (model_name))""",
          ids=("EVL10",))
def q_health(spark, sf):
    as_of = T.max_value(T.table(spark, sf, "events"), "ts")
    registered = spark.createDataFrame([(CANDIDATE,)], "model_name string")
    return EV.health_grade(model_metrics(spark, sf), as_of, registered)
