"""Dataset-level statistics: bootstrap quality (AGG12), inference metrics (AGG15),
evaluation-data stats (AGG21), feedback metrics (AGG22), collection completeness (AGG23),
dynamic min-max (MTH3)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.operators.windows import last_n


SET_RANGE_AGGS = ("temperature_c", "relative_humidity", "wind_speed_ms")


def set_range_aggregates():
    """Per-set min/max of T, truthy H and W (added to the set aggregation for AGG12)."""
    H = F.col("relative_humidity")
    hv = F.when(H != 0, H)
    return [F.min("temperature_c").alias("_t_min"), F.max("temperature_c").alias("_t_max"),
            F.min(hv).alias("_h_min"), F.max(hv).alias("_h_max"),
            F.min("wind_speed_ms").alias("_w_min"), F.max("wind_speed_ms").alias("_w_max")]


def bootstrap_quality(sets: DataFrame, key: str = "station_id", min_samples: int = 100) -> DataFrame:
    """AGG12: mean of (sample sufficiency, weather diversity, target spread).

    ``sets`` carries the per-set min/max columns of ``set_range_aggregates``: the range
    over all member observations is max(per-set max) - min(per-set min), so no second
    pass over the members is needed.
    """
    d = sets.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.stddev_pop(F.col("baseline_comfort_score") / 100.0).alias("score_std"),
        (F.max("_t_max") - F.min("_t_min")).alias("temp_range"),
        F.coalesce(F.max("_h_max") - F.min("_h_min"), F.lit(0.0)).alias("humidity_range"),
        (F.max("_w_max") - F.min("_w_min")).alias("wind_range"))
    div = ((F.col("temp_range") > 20).cast("int") + (F.col("humidity_range") > 30).cast("int")
           + (F.col("wind_range") > 5).cast("int")) / 3
    sample = F.least(F.lit(1.0), F.col("total_samples") / float(min_samples))
    target = F.least(F.lit(1.0), F.col("score_std") / 0.2)
    return d.select("*", div.alias("diversity_score"), ((sample + div + target) / 3).alias("overall_quality"))


def inference_metrics(pred: DataFrame, keys: Sequence[str], yhat: str = "prediction",
                      y: str | None = "actual") -> DataFrame:
    """AGG15: count, mean, pop-std, min, max of predictions (+ RMSE/MAE/R2 with actuals)."""
    aggs = [F.count(F.lit(1)).alias("prediction_count"), F.avg(yhat).alias("prediction_mean"),
            F.stddev_pop(yhat).alias("prediction_std"), F.min(yhat).alias("prediction_min"),
            F.max(yhat).alias("prediction_max")]
    if y is not None:
        e = F.col(yhat) - F.col(y)
        aggs += [F.sqrt(F.avg(e * e)).alias("inference_rmse"), F.avg(F.abs(e)).alias("inference_mae"),
                 (1 - F.sum(e * e) / (F.var_pop(y) * F.count(F.lit(1)))).alias("inference_r2")]
    return pred.groupBy(*keys).agg(*aggs)


def evaluation_data_stats(rows: DataFrame, key: str = "station_id", ts: str = "obs_ts") -> DataFrame:
    """AGG21: count, time range, mean/sample-std quality, mean completeness."""
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_records"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"),
        F.avg("data_quality").alias("data_quality_avg"), F.stddev_samp("data_quality").alias("data_quality_std"),
        F.avg("feature_completeness").alias("feature_completeness_avg"))


def feedback_metrics(frames: DataFrame, key: str = "station_id", ts: str = "window_start",
                     last: int = 50) -> DataFrame:
    """AGG22: error = |actual score / 100 - predicted probability| over the newest ``last``
    frames per key; MAE, pop-std, max, min, count, 1 - MAE."""
    d = frames.withColumn("_err", F.abs(F.col("baseline_comfort_score") / 100.0 - F.col("comfort_probability")))
    d = last_n(d, [key], [ts], last)
    g = d.groupBy(key).agg(F.avg("_err").alias("mean_absolute_error"), F.stddev_pop("_err").alias("std_error"),
                           F.max("_err").alias("max_error"), F.min("_err").alias("min_error"),
                           F.count(F.lit(1)).alias("feedback_count"))
    return g.withColumn("accuracy_score", F.greatest(F.lit(0.0), 1.0 - F.col("mean_absolute_error")))


def collection_completeness(core: DataFrame, keys=("station_id",), ts: str = "obs_ts",
                            placeholder: float = 0.95) -> DataFrame:
    """AGG23: raw and ML completeness per (key, day); overall = .4 raw + .4 ml + .2 x placeholder."""
    d = core.withColumn("obs_date", F.to_date(ts))
    g = d.groupBy(*keys, "obs_date").agg(
        F.count(F.lit(1)).alias("total_observations"),
        F.count_if(F.col("temperature_c").isNotNull() & F.col("relative_humidity_pct").isNotNull()).alias("raw_data_saved"),
        F.count_if("passes_quality").alias("ml_datasets_saved"))
    raw = F.col("raw_data_saved") / F.col("total_observations")
    ml = F.col("ml_datasets_saved") / F.col("total_observations")
    return g.select("*", raw.alias("raw_data_completeness"), ml.alias("ml_data_completeness"),
                    (raw * 0.4 + ml * 0.4 + placeholder * 0.2).alias("overall"))


def dynamic_minmax(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """MTH3: per-group min-max normalisation; a constant column gives 0.5.
    Bounds are one aggregate row per group joined back (no window over the group)."""
    b = df.groupBy(*keys).agg(*[x for c in cols for x in (F.min(c).alias(f"_mn_{c}"), F.max(c).alias(f"_mx_{c}"))])
    d = df.join(b, on=list(keys), how="inner")
    for c in cols:
        mn, mx = F.col(f"_mn_{c}"), F.col(f"_mx_{c}")
        d = d.withColumn(f"{c}_norm", F.when(mx == mn, 0.5).otherwise((F.col(c) - mn) / (mx - mn)))
    return d.drop(*[x for c in cols for x in (f"_mn_{c}", f"_mx_{c}")])
