"""End-to-end flows that chain the operators like the reference's entry points.

* ``ingest_flow``   -- landed text -> observations -> dedup -> quality checks -> frames ->
                       features; writes normalized rows, quality reports and features.
* ``training_flow`` -- feature table -> time split -> model comparison -> cross-validation -> gate -> saved model.

Every step is a DataFrame transformation; the only driver-side values are the run
parameters, scalar metrics and paths. Validation failures do not stop feature output:
they travel as columns (quality score and gate per station).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustframe.operators.clean import dedup_first_per_minute
from gustframe.operators.frames import tumbling
from gustframe.operators.quality import dq_checks, dq_summary
from gustframe.operators.scores import frame_features
from gustframe.sources import sinks as SK
from gustframe.sources.text import parse_header_text, read_raw_lines


@dataclass
class IngestResult:
    observations: DataFrame
    checks: DataFrame
    summary: DataFrame
    features: DataFrame


def ingest_flow(spark: SparkSession, raw_root: str, out_root: str | None = None, version: str = "v1",
                start=None, end=None, load_id: str | None = None) -> IngestResult:
    """``load_id`` names this load in the sinks (default: its time range); the same id again replaces it."""
    load_id = load_id or ("full" if start is None and end is None else re.sub(r"[^0-9A-Za-z]+", "-", f"{start}_{end}"))
    lines = read_raw_lines(spark, raw_root)
    obs = parse_header_text(lines, start=start, end=end)
    obs = dedup_first_per_minute(obs, order=("obs_ts", "file_path", "line_no"))
    obs = obs.withColumn("event_id", F.col("line_no"))
    checks = dq_checks(obs, order=("obs_ts", "file_path", "line_no"))
    summary = dq_summary(checks)
    feats = frame_features(tumbling(obs)).join(
        summary.select("station_id", F.col("quality_score").alias("station_quality_score"),
                       "validation_passed"), on="station_id", how="left")
    if out_root:
        SK.write_normalized(obs.drop("file_path", "line_no", "event_id"), f"{out_root}/normalized", load_id=load_id)
        SK.write_quality_reports(summary, f"{out_root}/quality", load_id=load_id)
        SK.write_features(feats, f"{out_root}/features", "comfort", version, load_id=load_id)
    return IngestResult(obs, checks, summary, feats)


def training_flow(spark: SparkSession, features: DataFrame, feature_cols, target: str = "baseline_comfort_score",
                  model_path: str | None = None, families=None):
    from gustframe.operators import training as TR
    from gustframe.operators.windows import time_split
    d = time_split(features, ["window_start", "station_id"], n_splits=3)
    metrics, fitted = TR.compare_models(spark, d, list(feature_cols), target, families=families)
    gated = TR.gate(TR.with_cross_validation(spark, metrics, features, list(feature_cols), target, ["window_start", "station_id"]))
    # a family that failed has no rmse and never passes; the best of those that pass is taken
    best = gated.where("passed").orderBy(F.asc_nulls_last("rmse"), "model_name").first()
    if model_path and best is not None:
        TR.save_model(fitted[best["model_name"]], model_path)
    return gated, (best["model_name"] if best is not None else None)


def score_requests(frames: DataFrame, requests: DataFrame, key: str = "station_id",
                   target: str = "target_ts") -> DataFrame:
    """Online-score entry as a batch: each request gets the latest completed frame
    (``window_end <= target``) of its station -- a linear as-of, no pairs -- plus the
    commute period and serving-window flags of its target time (FLT5)."""
    from gustframe.functions.timefn import commute_period, in_service_window
    from gustframe.operators.sequence import sequence_asof
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    f = frames.withColumn("_ws", micros("window_start"))
    cols = ["window_start", "window_end", "baseline_comfort_score", "label_bucket"]
    j = sequence_asof(requests, f, [key], micros(target), micros("window_end"), "_ws", cols)
    return j.select(*requests.columns, commute_period(target).alias("target_period"),
                    in_service_window(target).alias("in_service_window"),
                    *[F.col(f"_asof.{c}").alias(c) for c in cols])
