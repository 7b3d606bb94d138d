"""Data-quality checks DQ1-DQ10 as one aggregate pass per scope, stacked to rows.

Each check emits ``(scope..., name, severity, passed, issue_count, ratio)``.
All counts, gaps (DQ4) and repeated timestamps (DQ8) come from a single ``groupBy(scope)``
over the rows with their previous timestamp (partial aggregation, so a hot scope costs one
partial row per map task). IQR bounds and the outliers beyond them (DQ6) come from one table of
value counts, so no task holds the values of a scope.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustframe.operators.quantiles import quantiles, value_counts
from gustframe.operators.sequence import sequence_lag
from gustframe.operators.windows import gap_columns

MEASURES = ("temperature_c", "wind_speed_ms", "precipitation_mm", "relative_humidity")
# Valid ranges per measure (DQ3).
RANGES = {"temperature_c": (-50.0, 60.0), "wind_speed_ms": (0.0, 100.0),
          "precipitation_mm": (0.0, 1000.0), "relative_humidity": (0.0, 100.0)}
REQUIRED = ("obs_ts",) + MEASURES


def _check(name: str, severity: Column, passed: Column, count: Column, ratio: Column | None = None) -> Column:
    return F.struct(F.lit(name).alias("name"), severity.alias("severity"), passed.alias("passed"),
                    count.cast("bigint").alias("issue_count"),
                    (ratio if ratio is not None else F.lit(None)).cast("double").alias("ratio"))


def dq_checks(obs: DataFrame, scope: Sequence[str] = ("station_id",), ts: str = "obs_ts",
              order: Sequence[str] = ("obs_ts", "event_id")) -> DataFrame:
    """DQ1-DQ8 per scope (DQ1's missing-column check happens at plan time)."""
    missing = [c for c in REQUIRED if c not in obs.columns]
    if missing:
        raise ValueError(f"DQ1 missing required columns: {missing}")
    scope = list(scope)
    typed = obs
    for c in MEASURES:      # text measures: values that are no number count in DQ2 and are missing for the other checks
        if dict(obs.dtypes)[c] == "string":
            typed = typed.withColumn(f"{c}__raw", F.col(c)).withColumn(c, F.col(c).try_cast("double"))
    obs = typed
    rows = sequence_lag(obs, scope, list(order), [ts])
    n = F.count(F.lit(1))
    repeated = F.col(ts).isNull() | F.coalesce(F.col("prev_" + ts) == F.col(ts), F.lit(False))
    aggs = [n.alias("n"), F.count_if(F.col(ts).isNull()).alias("ts_null"),
            F.count_if(repeated).alias("dup"),
            F.count_if((F.col("precipitation_mm") > 0) & (F.col("relative_humidity") < 60)).alias("incons")]
    for c in MEASURES:
        lo, hi = RANGES[c]
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__null"),
                 F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"{c}__oor"),
                 F.count(c).alias(f"{c}__nn"),
                 F.count_if(F.col(f"{c}__raw").isNotNull() & F.col(c).isNull() if f"{c}__raw" in obs.columns
                            else F.lit(False)).alias(f"{c}__text")]
    gaps = gap_columns(ts)
    base = rows.groupBy(*scope).agg(*aggs, gaps["n_gaps"], gaps["irregular_count"])
    # DQ6: values outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR], counted on the value table
    counts = value_counts(obs, scope, MEASURES)
    q1, q3 = F.col("q")[0], F.col("q")[1]
    edges = quantiles(counts, scope, (0.25, 0.75)).select(*scope, "name", (q1 - 1.5 * (q3 - q1)).alias("_low"), (q3 + 1.5 * (q3 - q1)).alias("_high"))
    beyond = F.when((F.col("value") < F.col("_low")) | (F.col("value") > F.col("_high")), F.col("n")).otherwise(0)
    outl = counts.join(edges, on=[*scope, "name"]).groupBy(*scope).agg(
        *[F.sum(F.when(F.col("name") == c, beyond).otherwise(0)).alias(f"{c}__out") for c in MEASURES])
    w = base.join(outl, on=scope, how="left").fillna(0, [f"{c}__out" for c in MEASURES])

    nn = F.col("n")
    info, warn, err, crit = (F.lit(s) for s in ("info", "warning", "error", "critical"))
    checks = [
        _check("basic_structure", F.when(nn == 0, crit).otherwise(info), nn >= 1, nn),
        _check("timestamp_format", F.when(F.col("ts_null") > 0, err).otherwise(info),
               F.col("ts_null") == 0, F.col("ts_null")),
    ]
    for c in MEASURES:
        text = F.col(f"{c}__text")
        checks.append(_check(f"{c}_numeric", F.when(text > 0, warn).otherwise(info), text == 0, text))
    for c in MEASURES:
        oor = F.col(f"{c}__oor")
        checks.append(_check(f"{c}_range", F.when(oor > 0, warn).otherwise(info), oor == 0, oor))
    gaps, irr = F.col("n_gaps"), F.col("irregular_count")
    checks.append(_check("temporal_continuity", F.when((gaps > 0) & (irr > 0), warn).otherwise(info),
                         (gaps == 0) | (irr == 0), irr))
    for c in ("obs_ts", "temperature_c"):
        cnt = F.col("ts_null") if c == "obs_ts" else F.col(f"{c}__null")
        checks.append(_check(f"missing_{c}", F.when(cnt > 0, crit).otherwise(info), cnt == 0, cnt,
                             cnt / nn * 100))
    for c in ("wind_speed_ms", "precipitation_mm"):
        cnt = F.col(f"{c}__null")
        ratio = cnt / nn * 100
        checks.append(_check(f"missing_{c}", F.when(ratio > 20, warn).otherwise(info), ratio <= 20,
                             cnt, ratio))
    cnt = F.col("relative_humidity__null")
    checks.append(_check("missing_relative_humidity", info, F.lit(True), cnt, cnt / nn * 100))
    for c in MEASURES:
        outc, nnc = F.col(f"{c}__out"), F.col(f"{c}__nn")
        ratio = F.try_divide(outc * 100.0, nnc)
        checks.append(_check(f"outliers_{c}",
                             F.when(nnc < 4, info).when(ratio > 10, warn).otherwise(info),
                             (nnc < 4) | (ratio <= 10), F.when(nnc < 4, F.lit(0)).otherwise(outc),
                             F.when(nnc >= 4, ratio)))
    inc = F.col("incons")
    checks.append(_check("humidity_precipitation_consistency", F.when(inc > 0, warn).otherwise(info),
                         inc == 0, inc, inc / nn * 100))
    dup = F.col("dup")
    checks.append(_check("duplicate_timestamps", F.when(dup > 0, err).otherwise(info), dup == 0, dup))
    return w.select(*scope, F.explode(F.array(*checks)).alias("c")).select(*scope, "c.*")


def dq_structure(obs: DataFrame) -> DataFrame:
    """DQ1 for the whole input, one row even where it is empty (then critical)."""
    n = F.count(F.lit(1))
    return obs.agg(n.alias("n")).select(_check(
        "basic_structure", F.when(F.col("n") == 0, "critical").otherwise("info"), F.col("n") >= 1, F.col("n")).alias("c")).select("c.*")


def dq_summary(checks: DataFrame, scope: Sequence[str] = ("station_id",)) -> DataFrame:
    """DQ9 grade + DQ10 score and gate per scope."""
    sev = F.col("severity")
    g = checks.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("passed").alias("passed_checks"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
        F.count_if(sev == "info").alias("info_count"),
        F.count_if(sev == "warning").alias("warning_count"),
        F.count_if(sev == "error").alias("error_count"),
        F.count_if(sev == "critical").alias("critical_count"),
    )
    grade = (F.when(F.col("critical_count") > 0, "critical").when(F.col("error_count") > 0, "poor")
             .when(F.col("warning_count") > F.col("total_checks") * 0.3, "fair").otherwise("good"))
    score = (F.when(F.col("critical_count") > 0, 0.0)
             .when(F.col("error_count") > 0, F.greatest(F.lit(0.0), 40.0 - 10.0 * F.col("error_count")))
             .otherwise(F.col("passed_checks") / F.col("total_checks") * 100))
    return g.select("*", grade.alias("overall_quality"), score.alias("quality_score"),
                    ((F.col("critical_count") == 0) & (F.col("error_count") == 0)).alias("validation_passed"))
