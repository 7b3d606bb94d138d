"""Monitoring operators: rule evaluation (FLT6, JN5), sustained breach (WIN10),
cool-down suppression (WIN11), summaries (AGG17, AGG18), log analytics (AGG19), text (MON2).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustframe.operators.sequence import sequence_chain, sequence_streak

# The five default alert rules
# (name, metric, threshold, operator, duration in samples, cooldown minutes, severity).
DEFAULT_RULES = (
    ("high_cpu_usage", "cpu_usage", 80.0, ">=", 5, 30, "WARNING"),
    ("high_memory_usage", "memory_usage", 85.0, ">=", 3, 30, "WARNING"),
    ("disk_space_low", "disk_usage", 90.0, ">=", 1, 60, "ERROR"),
    ("high_error_rate", "error_rate", 5.0, ">=", 2, 15, "ERROR"),
    ("prediction_latency_high", "prediction_latency", 2000.0, ">=", 3, 20, "WARNING"),
)
RULE_SCHEMA = ("rule_name string, metric string, threshold double, operator string, "
               "duration_samples int, cooldown_minutes int, severity string")
METRICS = ("cpu_usage", "memory_usage", "disk_usage", "error_rate", "prediction_latency")


def alert_rules(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    """UDF2: rules are rows; custom rules are more rows."""
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def rule_predicate(value: Column, op: Column, threshold: Column) -> Column:
    """FLT6: operator chosen by data."""
    return (F.when(op == ">", value > threshold).when(op == ">=", value >= threshold)
            .when(op == "<", value < threshold).when(op == "<=", value <= threshold)
            .when(op == "==", value == threshold).otherwise(F.lit(False)))


def unpivot_metrics(metrics: DataFrame, keys: Sequence[str], metric_cols: Sequence[str] = METRICS) -> DataFrame:
    """JN5 step 1: one row per (sample, metric) via ``stack``-style unpivot."""
    d = metrics
    if "error_rate" in metric_cols and "error_rate" not in d.columns:
        d = d.withColumn("error_rate", 100.0 * F.try_divide(F.col("error_count"), F.col("prediction_count")))
    return d.unpivot(list(keys), list(metric_cols), "metric", "value")


def evaluate_rules(metrics: DataFrame, rules: DataFrame, key: str = "host", ts: str = "metric_ts",
                   order: Sequence[str] = ("metric_ts", "event_id")) -> DataFrame:
    """JN5 + FLT6 + WIN10: breach and sustained-breach flags per (rule, host, sample).

    ``rules`` is a literal table of a handful of rows, so it is broadcast.
    Sustained = the last ``duration`` samples of the host all breach, computed as a
    breach streak (position - position of the last non-breach sample) from the
    segmented scan rather than a window over the whole host.
    """
    long = unpivot_metrics(metrics, [key, *order] if ts in order else [key, ts, *order])
    j = long.join(F.broadcast(rules), on="metric", how="inner")
    j = j.withColumn("breach", F.coalesce(rule_predicate(F.col("value"), F.col("operator"),
                                                         F.col("threshold")), F.lit(False)))
    part = ["rule_name", key]
    d = sequence_streak(j, part, list(order), "breach")
    return d.withColumn("sustained", F.col("streak") >= F.col("duration_samples"))


def apply_cooldown(sustained: DataFrame, key: str = "host", ts: str = "metric_ts",
                   order_tie: str = "event_id") -> DataFrame:
    """WIN11: a sustained breach fires unless the rule fired on the host < cooldown ago.

    One exact, group-free path for keys of every size (``sequence_chain``); the
    candidates (sustained breaches only) are materialised once.
    """
    part = ["rule_name", key]
    c = (sustained.where("sustained")
         .select(*part, F.col(order_tie).alias("_id"), (F.col("cooldown_minutes").cast("long") * 60_000_000).alias("_pause"),
                 F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
         .where(f"_t is not null and rule_name is not null and `{key}` is not null")).checkpoint(eager=True)
    # cool-down <= 0 suppresses nothing: every sustained breach fires
    fired = sequence_chain(c.where("_pause > 0"), part, "_t", "_id", "_pause").unionByName(c.where("_pause <= 0").select(*part, "_t"))
    return fired.select(*part, F.timestamp_micros("_t").cast("timestamp_ntz").alias("fired_ts"))


def alert_message(rule: Column, metric: Column, value: Column, threshold: Column) -> Column:
    """MON2: templated alert text."""
    return F.format_string("%s: %s is %.2f (threshold %.2f)", rule, metric, value, threshold)


def metrics_summary(metrics: DataFrame, as_of, hours: float = 24.0, key: str = "host",
                    ts: str = "metric_ts") -> DataFrame:
    """AGG17: per-host resource avg/max/min over the last ``hours``; latency only where > 0."""
    cut = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                                  F.lit(hours * 3600.0))
    d = metrics.where(F.col(ts) >= cut)
    aggs = [F.count(F.lit(1)).alias("n_samples")]
    for c in ("cpu_usage", "memory_usage", "disk_usage"):
        aggs += [F.avg(c).alias(f"{c}_avg"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min")]
    lat = F.when(F.col("prediction_latency") > 0, F.col("prediction_latency"))
    aggs += [F.avg(lat).alias("latency_avg"), F.max(lat).alias("latency_max"),
             F.sum("prediction_count").cast("bigint").alias("total_predictions"),
             F.sum("error_count").cast("bigint").alias("total_errors")]
    return d.groupBy(key).agg(*aggs)


def error_rate(metrics: DataFrame, as_of, key: str = "host", ts: str = "metric_ts",
               hours: float = 1.0) -> DataFrame:
    """AGG18: 100 * sum(errors) / sum(predictions) over the last hour, 0 when none."""
    cut = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                                  F.lit(hours * 3600.0))
    d = metrics.where(F.col(ts) >= cut)
    g = d.groupBy(key).agg(F.sum("error_count").alias("_e"), F.sum("prediction_count").alias("_p"))
    return g.select(key, F.when(F.col("_p") > 0, 100.0 * F.col("_e") / F.col("_p"))
                    .otherwise(0.0).alias("error_rate"))


def monitoring_report(metrics: DataFrame, firings: DataFrame, as_of, key: str = "host", ts: str = "metric_ts",
                      hours: float = 24.0, max_error_rate: float = 5.0) -> DataFrame:
    """MON5: one row per host ever seen, with its firings of the last ``hours`` and its error rate of the last
    hour. A host without samples in that hour is silent: its rate is null and its status a warning."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))
    fired = firings.where(F.col("fired_ts") >= since).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rate = error_rate(metrics, as_of, key, ts).withColumn("_seen", F.lit(True))
    j = metrics.select(key).distinct().join(rate, on=key, how="left").join(fired, on=key, how="left")
    n, silent = F.coalesce("_n", F.lit(0)), F.col("_seen").isNull()
    return j.select(key, n.alias("n_firings"), "error_rate", silent.alias("silent"),
                    F.when((n > 0) | silent | (F.col("error_rate") > max_error_rate), "warning")
                    .otherwise("healthy").alias("status"))
