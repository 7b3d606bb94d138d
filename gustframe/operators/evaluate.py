"""Evaluation operators: regression metrics (AGG13/14, EVL1), verdicts (EVL2-EVL5,
EVL10, EVL11), trends and baselines (EVL6-EVL9, AGG16, WIN12), retention (EVL12, EVL14),
canary rule (EVL13), best model (SRT5).

Metric histories are aggregates (one row per model and evaluation day), so the
windows over a model's history are small by construction.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustframe.functions.mathfn import clamp

# Evaluation limits.
LIMITS = {"min_r2": 0.7, "max_mae": 0.5, "max_mape_pct": 15.0, "min_confidence": 0.8,
          "max_latency_ms": 1000.0, "stability_std": 0.05, "stability_drop": 0.10}


def regression_metrics(pred: DataFrame, keys: Sequence[str], y: str = "actual",
                       yhat: str = "prediction") -> DataFrame:
    """AGG13 + AGG14: MAE, MSE, RMSE, R2, MAPE (fraction over y != 0), metadata means."""
    e = F.col(yhat) - F.col(y)
    n = F.count(F.lit(1))
    ss_tot = F.var_pop(y) * n
    g = pred.groupBy(*keys).agg(
        n.alias("sample_count"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        (1 - F.try_divide(F.sum(e * e), ss_tot)).alias("r2"),
        F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y)))).alias("mape"),
        F.avg("confidence").alias("prediction_confidence"),
        F.avg("data_quality").alias("data_quality_score"),
        F.avg("latency_ms").alias("prediction_latency_ms"),
    )
    return g.withColumn("rmse", F.sqrt("mse")).withColumn("mape_pct", F.col("mape") * 100)


def accuracy_issues(m: DataFrame) -> DataFrame:
    """EVL2: limit checks -> ARRAY of issue texts (ARR1 style) and a validity flag."""
    L = LIMITS
    issues = F.filter(F.array(
        F.when(F.col("r2") < L["min_r2"], F.lit("r2 below limit")),
        F.when(F.col("mae") > L["max_mae"], F.lit("mae above limit")),
        F.when(F.col("mape_pct") > L["max_mape_pct"], F.lit("mape above limit")),
        F.when(F.col("prediction_confidence") < L["min_confidence"], F.lit("low confidence")),
        F.when(F.col("prediction_latency_ms") > L["max_latency_ms"], F.lit("latency above limit")),
    ), lambda x: x.isNotNull())
    return m.withColumn("issues", issues).withColumn("is_valid", F.size("issues") == 0)


def confidence_score(m: DataFrame) -> DataFrame:
    """EVL4: weighted confidence, clamped 0..1."""
    s = (0.25 * F.least(F.lit(1.0), F.col("r2") / 0.7)
         + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("mae") / 0.5)
         + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("mape_pct") / 15)
         + 0.2 * F.col("prediction_confidence") / 0.8
         + 0.15 * F.col("data_quality_score") / 100)
    return m.withColumn("confidence_score", clamp(s))


def history_positions(m: DataFrame, key: str = "model_name", ts: str = "eval_day") -> DataFrame:
    """Rank rows of each model's history: 1 = newest."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc())
    return m.withColumn("recent_rank", F.row_number().over(w))


def recent_window_stats(m: DataFrame, key: str = "model_name", ts: str = "eval_day",
                        last: int = 7) -> DataFrame:
    """WIN12 / EVL3 / EVL5 / EVL6: stats over the newest ``last`` rows per model."""
    h = history_positions(m, key, ts)
    n_hist = F.count(F.lit(1)).over(Window.partitionBy(key))
    h = h.withColumn("history_rows", n_hist).where(F.col("recent_rank") <= last)
    idx = (F.lit(last) - F.col("recent_rank")).cast("double")     # 0 = oldest of the last N
    g = h.groupBy(key).agg(
        F.first("history_rows").alias("history_rows"),
        F.stddev_pop("r2").alias("r2_std_recent"),
        F.avg(F.when(F.col("recent_rank") > 3, F.col("r2"))).alias("r2_early_mean"),
        F.avg(F.when(F.col("recent_rank") <= 3, F.col("r2"))).alias("r2_late_mean"),
        F.regr_slope("r2", idx).alias("r2_slope"),
        F.regr_slope("mae", idx).alias("mae_slope"),
        F.max_by("r2", F.col(ts)).alias("r2_latest"),
        F.max_by("mae", F.col(ts)).alias("mae_latest"),
        F.max_by("data_quality_score", F.col(ts)).alias("dq_latest"),
        F.max_by("prediction_latency_ms", F.col(ts)).alias("latency_latest"),
        F.max_by("prediction_confidence", F.col(ts)).alias("confidence_latest"),
        F.max_by("sample_count", F.col(ts)).alias("samples_latest"),
    )
    drop = F.try_divide(F.col("r2_early_mean") - F.col("r2_late_mean"), F.abs(F.col("r2_early_mean")))
    g = g.withColumn("r2_drop", drop)
    g = g.withColumn("is_stable", (F.col("history_rows") < 24)
                     | ((F.col("r2_std_recent") <= LIMITS["stability_std"])
                        & (F.coalesce(F.col("r2_drop"), F.lit(0.0)) <= LIMITS["stability_drop"])))
    trend = lambda s, up_good: (F.when(s < -0.01, "declining" if up_good else "improving")
                                .when(s > 0.01, "improving" if up_good else "declining").otherwise("stable"))
    g = g.withColumn("r2_trend", trend(F.col("r2_slope"), True)) \
         .withColumn("mae_trend", trend(F.col("mae_slope"), False))
    retrain = F.filter(F.array(
        F.when(F.col("r2_latest") < LIMITS["min_r2"], F.lit("accuracy below limit")),
        F.when(F.col("mae_latest") > LIMITS["max_mae"], F.lit("error above limit")),
        F.when(F.col("r2_slope") < -0.01, F.lit("declining trend")),
        F.when(F.col("dq_latest") < 70, F.lit("low data quality")),
    ), lambda x: x.isNotNull())
    recs = F.filter(F.array(
        F.when(F.col("latency_latest") > 500, F.lit("optimise latency")),
        F.when(F.col("dq_latest") < 80, F.lit("improve feature quality")),
        F.when(F.col("confidence_latest") < 0.9, F.lit("review confidence")),
        F.when(F.col("samples_latest") < 24, F.lit("collect more samples")),
    ), lambda x: x.isNotNull())
    return (g.withColumn("retrain_reasons", retrain).withColumn("needs_retraining", F.size(retrain) > 0)
            .withColumn("recommendations", recs))


def baseline_comparison(m: DataFrame, key: str = "model_name", ts: str = "eval_day",
                        last: int = 7) -> DataFrame:
    """EVL7 / JN7: latest row vs mean of the previous ``last`` rows, % change. A model with fewer
    previous rows keeps its row, with status ``insufficient_baseline_data`` and no baseline."""
    h = history_positions(m, key, ts)
    cur = h.where(F.col("recent_rank") == 1).select(key, *[F.col(c).alias(f"cur_{c}") for c in ("r2", "mae", "rmse")])
    base = (h.where((F.col("recent_rank") > 1) & (F.col("recent_rank") <= last + 1))
            .groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"base_{c}") for c in ("r2", "mae", "rmse")])
            .where(F.col("_n") >= last))
    j = cur.join(base, on=key, how="left")
    j = j.withColumn("status", F.when(F.col("_n").isNull(), "insufficient_baseline_data").otherwise("compared"))
    for c in ("r2", "mae", "rmse"):
        j = j.withColumn(f"{c}_change_pct",
                         F.try_divide(F.col(f"cur_{c}") - F.col(f"base_{c}"), F.col(f"base_{c}")) * 100)
    return j.drop("_n")


def degradation_vs_production(m: DataFrame, production: str, key: str = "model_name",
                              ts: str = "eval_day", rel: float = 0.15, rmse_limit: float = 8.0) -> DataFrame:
    """EVL8 / JN7: each model vs the production model on the same day; on a day without a production
    row only the RMSE limit decides."""
    prod = m.where(F.col(key) == production).select(ts, F.col("rmse").alias("prod_rmse"))
    j = m.join(prod, on=ts, how="left")
    d = (F.col("rmse") - F.col("prod_rmse")) / F.col("prod_rmse")
    return j.select(key, ts, "rmse", "prod_rmse", d.alias("degradation"),
                    (F.coalesce(d > rel, F.lit(False)) | (F.col("rmse") > rmse_limit)).alias("degraded"))


def health_grade(m: DataFrame, as_of, registered: DataFrame | None = None, key: str = "model_name", ts: str = "eval_day",
                 max_age_hours: int = 24, max_rmse: float = 0.2, min_quality: float = 0.8) -> DataFrame:
    """EVL10: present, evaluated within ``max_age_hours``, RMSE and data quality of the latest row; a model
    of ``registered`` without any row fails every check. Two failures are critical, one is a warning."""
    g = m.groupBy(key).agg(F.max(ts).alias("_last"), F.max_by("rmse", ts).alias("_rmse"),
                           F.max_by("data_quality_score", ts).alias("_quality"))
    if registered is not None:
        g = registered.select(key).distinct().join(g, on=key, how="full")
    cut = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(max_age_hours))
    passed = [F.col("_last").isNotNull(), F.col("_last") >= cut, F.col("_rmse") < max_rmse,
              F.col("_quality") / 100 >= min_quality]
    failed = sum((1 - F.coalesce(p, F.lit(False)).cast("int") for p in passed[1:]),
                 1 - passed[0].cast("int"))
    return g.select(key, passed[0].alias("model_present"), failed.alias("failed_checks"),
                    F.when(failed >= 2, "critical").when(failed == 1, "warning").otherwise("healthy").alias("health"))


def run_trend_stats(m: DataFrame, key: str = "model_name", ts: str = "eval_day", newest: int = 5) -> DataFrame:
    """AGG16 / EVL9: sample std, mean/min/max; alert when newest-5 mean rmse > 1.1 x overall mean."""
    h = history_positions(m, key, ts)
    aggs = []
    for c in ("rmse", "mae", "r2"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    aggs.append(F.avg(F.when(F.col("recent_rank") <= newest, F.col("rmse"))).alias("rmse_recent_mean"))
    g = h.groupBy(key).agg(*aggs)
    return g.withColumn("degrading_alert", F.col("rmse_recent_mean") > 1.1 * F.col("rmse_mean"))


def promotion_readiness(m: DataFrame, production: str, key: str = "model_name",
                        ts: str = "eval_day") -> DataFrame:
    """EVL11: latest row per model vs production's latest r2."""
    h = history_positions(m, key, ts).where(F.col("recent_rank") == 1)
    # production's latest r2 is one scalar: fetch it as a literal instead of joining
    prod_r2 = h.where(F.col(key) == production).agg(F.max("r2").alias("v")).first()["v"]
    j = h.withColumn("prod_r2", F.lit(prod_r2).cast("double"))
    issues = F.filter(F.array(
        F.when(F.col("r2") < LIMITS["min_r2"], F.lit("r2 below limit")),
        F.when(F.col("mae") > LIMITS["max_mae"], F.lit("mae above limit")),
        F.when(F.col("r2") < 0.95 * F.col("prod_r2"), F.lit("worse than production")),
    ), lambda x: x.isNotNull())
    return j.select(key, "r2", "mae", "prod_r2", issues.alias("issues"),
                    (F.size(issues) == 0).alias("ready"))


def canary_rollback(m: DataFrame, key: str = "model_name", ts: str = "eval_day",
                    limit: float = 0.1) -> DataFrame:
    """EVL13: degradation per step vs the first step; first step breaching ``limit``."""
    w = Window.partitionBy(key).orderBy(ts)
    d = m.withColumn("step", F.row_number().over(w)).withColumn("base_r2", F.first("r2").over(w))
    d = d.withColumn("degradation", F.greatest(F.lit(0.0), F.col("base_r2") - F.col("r2")) / F.col("base_r2"))
    return d.groupBy(key).agg(F.min(F.when(F.col("degradation") > limit, F.col("step"))).alias("rollback_step"),
                              F.max("degradation").alias("max_degradation"))
