"""Catalog: monitoring operators (MON1-MON6, AGG17-AGG19, WIN10, WIN11, JN5, FLT6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustframe.operators import monitor as MO
from gustframe.plans.registry import register, sql_view
from gustframe.sources import tables as T

_RULE_ROWS = ", ".join(f"('{r[0]}', '{r[1]}', CAST({r[2]} AS DOUBLE), '{r[3]}', {r[4]}, {r[5]}, '{r[6]}')"
                       for r in MO.DEFAULT_RULES)

sql_view("rule_eval", f"""
WITH m AS (SELECT host, event_id, metric_ts, cpu_usage, memory_usage, disk_usage,
             100.0 * error_count / prediction_count AS error_rate, prediction_latency FROM $system_metrics),
u AS (SELECT host, event_id, metric_ts, 'cpu_usage' AS metric, cpu_usage AS value FROM m
      UNION ALL SELECT host, event_id, metric_ts, 'memory_usage', memory_usage FROM m
      UNION ALL SELECT host, event_id, metric_ts, 'disk_usage', disk_usage FROM m
      UNION ALL SELECT host, event_id, metric_ts, 'error_rate', error_rate FROM m
      UNION ALL SELECT host, event_id, metric_ts, 'prediction_latency', prediction_latency FROM m),
r AS (SELECT * FROM (VALUES {_RULE_ROWS}) t(rule_name, metric, threshold, operator, duration_samples, cooldown_minutes, severity)),
j AS (SELECT u.*, r.rule_name, r.threshold, r.operator, r.duration_samples, r.cooldown_minutes, r.severity,
        coalesce(CASE r.operator WHEN '>' THEN u.value > r.threshold WHEN '>=' THEN u.value >= r.threshold
                 WHEN '<' THEN u.value < r.threshold WHEN '<=' THEN u.value <= r.threshold
                 WHEN '==' THEN u.value = r.threshold ELSE false END, false) AS breach
      FROM u JOIN r USING (metric)),
k AS (SELECT *, row_number() OVER (PARTITION BY rule_name, host ORDER BY metric_ts, event_id) AS i FROM j)
SELECT *, i - coalesce(max(CASE WHEN NOT breach THEN i END) OVER (PARTITION BY rule_name, host ORDER BY metric_ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS streak,
       i - coalesce(max(CASE WHEN NOT breach THEN i END) OVER (PARTITION BY rule_name, host ORDER BY metric_ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) >= duration_samples AS sustained
FROM k""")

sql_view("firings", """
WITH RECURSIVE c AS (SELECT rule_name, host, metric_ts AS t, cooldown_minutes FROM $rule_eval WHERE sustained),
f AS (
  SELECT rule_name, host, min(t) AS t, any_value(cooldown_minutes) AS cd FROM c GROUP BY rule_name, host
  UNION ALL
  SELECT f.rule_name, f.host,
    (SELECT min(c.t) FROM c WHERE c.rule_name = f.rule_name AND c.host = f.host AND c.t >= f.t + to_minutes(f.cd)),
    f.cd
  FROM f WHERE f.t IS NOT NULL)
SELECT rule_name, host, t AS fired_ts FROM f WHERE t IS NOT NULL""")


def _rule_eval(spark, sf):
    return MO.evaluate_rules(T.system_metrics(spark, sf), MO.alert_rules(spark))


@register("MON1_WIN10_sustained_breach", """rule_name string, host string, event_id bigint, metric_ts timestamp,
value double, breach boolean, streak bigint, sustained boolean, message string""", """
SELECT rule_name, host, event_id, metric_ts, value, breach, streak, sustained,
  CASE WHEN sustained THEN printf('%s: %s is %.2f (threshold %.2f)', rule_name, metric, value, threshold) END AS message
FROM $rule_eval""",
          ids=("MON1", "MON2", "WIN10", "JN5", "FLT6", "UDF2", "UDF3"))
def q_breach(spark, sf):
    return _rule_eval(spark, sf).select("rule_name", "host", "event_id", "metric_ts", "value", "breach",
                                        "streak", "sustained", F.when(F.col("sustained"), MO.alert_message(
                                            F.col("rule_name"), F.col("metric"), F.col("value"), F.col("threshold"))).alias("message"))


@register("MON1_WIN11_alert_firings", "rule_name string, host string, fired_ts timestamp, message string", """
SELECT f.rule_name, f.host, f.fired_ts,
  printf('%s on host %s at %s', f.rule_name, f.host, strftime(f.fired_ts, '%Y-%m-%d %H:%M:%S')) AS message
FROM $firings f""", ids=("MON1", "WIN11", "STR3"))
def q_firings(spark, sf):
    f = MO.apply_cooldown(_rule_eval(spark, sf))
    return f.select("rule_name", "host", "fired_ts",
                    F.format_string("%s on host %s at %s", "rule_name", "host",
                                    F.date_format("fired_ts", "yyyy-MM-dd HH:mm:ss")).alias("message"))


def _summary_sql():
    cols = ["count(*) AS n_samples"]
    for c in ("cpu_usage", "memory_usage", "disk_usage"):
        cols += [f"avg({c}) AS {c}_avg", f"max({c}) AS {c}_max", f"min({c}) AS {c}_min"]
    cols += ["avg(prediction_latency) FILTER (WHERE prediction_latency > 0) AS latency_avg",
             "max(prediction_latency) FILTER (WHERE prediction_latency > 0) AS latency_max",
             "sum(prediction_count) AS total_predictions", "sum(error_count) AS total_errors"]
    return f"""SELECT host, {', '.join(cols)} FROM $system_metrics
WHERE metric_ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY host"""


@register("AGG17_MON3_metrics_summary", """host string, n_samples bigint, cpu_usage_avg double, cpu_usage_max double,
cpu_usage_min double, memory_usage_avg double, memory_usage_max double, memory_usage_min double,
disk_usage_avg double, disk_usage_max double, disk_usage_min double, latency_avg double, latency_max double,
total_predictions bigint, total_errors bigint""", _summary_sql(), ids=("AGG17", "MON3", "FLT2"))
def q_summary(spark, sf):
    m = T.system_metrics(spark, sf)
    return MO.metrics_summary(m, T.max_value(T.table(spark, sf, "events"), "ts"))


@register("AGG18_MON3_error_rate", "host string, error_rate double", """
SELECT host, CASE WHEN sum(prediction_count) > 0 THEN 100.0 * sum(error_count) / sum(prediction_count) ELSE 0 END AS error_rate
FROM $system_metrics WHERE metric_ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY host""",
          ids=("AGG18", "MON3"))
def q_error_rate(spark, sf):
    m = T.system_metrics(spark, sf)
    return MO.error_rate(m, T.max_value(T.table(spark, sf, "events"), "ts"))


LOG_SQL = """
SELECT level, module, count(*) AS n_logs, CAST(grouping(level, module) AS INTEGER) AS grouping_level FROM (
  SELECT CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
         'module_' || CAST(user_id % 7 AS VARCHAR) AS module FROM events)
GROUP BY GROUPING SETS ((level), (module), ())"""


@register("AGG19_MON4_log_analytics", "level string, module string, n_logs bigint, grouping_level int", LOG_SQL,
          ids=("AGG19", "MON4"))
def q_logs(spark, sf):
    ev = T.table(spark, sf, "events")
    logs = ev.select(
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING")
        .otherwise("INFO").alias("level"),
        F.concat(F.lit("module_"), (F.col("user_id") % 7).cast("string")).alias("module"))
    g = logs.groupingSets([["level"], ["module"], []], "level", "module")
    return g.agg(F.count(F.lit(1)).alias("n_logs"), F.grouping_id("level", "module").alias("grouping_level"))


@register("AGG19_recent_errors", "event_id bigint, ts timestamp, recency_rank bigint", """
SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS recency_rank FROM events
WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50""", ids=("AGG19", "WIN9"))
def q_recent_errors(spark, sf):
    ev = T.table(spark, sf, "events").where(F.col("event_type") == "error")
    top = ev.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50)
    # the top-50 is the feature; rank it after the limit (50 rows)
    from pyspark.sql import Window
    return top.select("event_id", "ts", F.row_number().over(
        Window.orderBy(F.col("ts").desc(), F.col("event_id").desc())).alias("recency_rank"))


@register("MON6_prediction_histogram", "model_name string, bin int, n bigint, mean_prediction double, mean_actual double", """
SELECT model_name, CAST(least(greatest(floor(prediction / 50), 0), 10) AS INTEGER) AS bin, count(*) AS n,
  avg(prediction) AS mean_prediction, avg(actual) AS mean_actual
FROM $predictions GROUP BY ALL""", ids=("MON6",))
def q_hist(spark, sf):
    p = T.predictions(spark, sf)
    b = F.least(F.greatest(F.floor(F.col("prediction") / 50), F.lit(0)), F.lit(10)).cast("int")
    return p.groupBy("model_name", b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction"), F.avg("actual").alias("mean_actual"))


@register("MON5_monitoring_report", "host string, n_firings bigint, error_rate double, silent boolean, status string", """
SELECT h.host, coalesce(f.n, 0) AS n_firings, e.error_rate, e.host IS NULL AS silent,
  CASE WHEN coalesce(f.n, 0) > 0 OR e.host IS NULL OR e.error_rate > 5 THEN 'warning' ELSE 'healthy' END AS status
FROM (SELECT DISTINCT host FROM $system_metrics) h LEFT JOIN (SELECT host, CASE WHEN sum(prediction_count) > 0 THEN 100.0 * sum(error_count) / sum(prediction_count) ELSE 0 END AS error_rate
      FROM $system_metrics WHERE metric_ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY host) e ON e.host = h.host
LEFT JOIN (SELECT host, count(*) AS n FROM $firings WHERE fired_ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR
           GROUP BY host) f ON f.host = h.host""", ids=("MON5", "SET3"))
def q_report(spark, sf):
    m = T.system_metrics(spark, sf)
    return MO.monitoring_report(m, MO.apply_cooldown(_rule_eval(spark, sf)), T.max_value(T.table(spark, sf, "events"), "ts"))
