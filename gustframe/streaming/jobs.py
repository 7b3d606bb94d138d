"""Structured Streaming versions of the hourly batch work (STM1-STM5, STM8, STM9); keyed state is in ``state.py``.

Watermarks need a zoned TIMESTAMP, so event time is cast from the NTZ wall clock
under the UTC session zone and cast back on output. Rows later than the
watermark are dropped by Spark; the batch versions of the same operators are the
reference results in the tests.
"""

from __future__ import annotations

from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gustframe.operators.frames import with_precipitation_type
from gustframe.operators.scores import baseline_score, frame_aggregates


def landing_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet",
                   max_files_per_trigger: int = 100) -> DataFrame:
    """STM1: new files under a landing folder become micro-batches."""
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(path))


def _event_time(df: DataFrame, ts: str, out: str = "_et") -> DataFrame:
    return df.withColumn(out, F.col(ts).cast("timestamp"))


def stream_frame_features(obs: DataFrame, ts: str = "obs_ts", hours: int = 3, slide_hours: int | None = None,
                          watermark: str = "1 hour") -> DataFrame:
    """STM2: tumbling (or sliding) frame features with a watermark; append mode."""
    d = with_precipitation_type(obs) if "precipitation_type" not in obs.columns else obs
    d = _event_time(d, ts).withWatermark("_et", watermark)
    w = F.window("_et", f"{hours} hours", f"{slide_hours} hours" if slide_hours else None)
    g = d.groupBy("station_id", w.alias("w")).agg(*frame_aggregates())
    g = g.select("station_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                 F.col("w.end").cast("timestamp_ntz").alias("window_end"), *[c for c in g.columns
                                                                             if c not in ("station_id", "w")])
    return baseline_score(g)


def stream_hourly_metrics(metrics: DataFrame, ts: str = "metric_ts", watermark: str = "1 hour") -> DataFrame:
    """STM3: tumbling hourly host metrics."""
    d = _event_time(metrics, ts).withWatermark("_et", watermark)
    g = d.groupBy("host", F.window("_et", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg("cpu_usage").alias("cpu_avg"),
        F.max("cpu_usage").alias("cpu_max"), F.sum("error_count").alias("errors"),
        F.sum("prediction_count").alias("predictions"))
    return g.select("host", F.col("w.start").cast("timestamp_ntz").alias("hour_start"),
                    *[c for c in g.columns if c not in ("host", "w")])


def stream_dedup_minute(obs: DataFrame, ts: str = "obs_ts", watermark: str = "10 minutes",
                        order: tuple[str, ...] = ("obs_ts", "event_id")) -> DataFrame:
    """STM4: the earliest row of each (station, minute), as DDP1 keeps it, whatever the order of arrival. The state of a
    minute is one row; it is emitted when the watermark passes the minute's end."""
    d = _event_time(obs, ts).withWatermark("_et", watermark)
    row = F.min_by(F.struct(*obs.columns), F.struct(*order)).alias("_r")
    return d.groupBy("station_id", F.window("_et", "1 minute").alias("w")).agg(row).select(
        "_r.*", F.col("w.start").cast("timestamp_ntz").alias("minute_ts"))


def idempotent_sink(base: str, partition_by=("station_id",)) -> Callable[[DataFrame, int], None]:
    """STM9: ``foreachBatch`` writer; a micro-batch owns ``epoch_id=<n>``, so a replay overwrites itself only."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        (batch.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by)
         .parquet(f"{base}/epoch_id={epoch_id}"))
    return write


def run_available_now(stream: DataFrame, checkpoint: str, sink: Callable | None = None,
                      output_mode: str = "append", query_name: str | None = None):
    """Run a streaming query over everything available, then stop (tests, backfills)."""
    w = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    if sink is not None:
        w = w.foreachBatch(sink)
    else:
        w = w.format("memory").queryName(query_name or "gustframe_out")
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# ---- triggers (STM8) ------------------------------------------------------------------

def retraining_trigger_sink(trigger_path: str, min_new: int = 50, min_quality: float = 0.8,
                            daily_cap: int = 3) -> Callable[[DataFrame, int], None]:
    """STM8: per micro-batch of training sets, append a trigger row when at least
    ``min_new`` sets with quality >= ``min_quality`` arrived, at most ``daily_cap`` per day."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        good = batch.where(F.col("quality_score") >= min_quality)
        stats = good.agg(F.count(F.lit(1)).alias("n"), F.max("window_start").alias("day_ts")).first()
        if stats["n"] < min_new:
            return
        day = stats["day_ts"].date()
        try:
            others = spark.read.parquet(trigger_path).where(F.col("epoch_id") != int(epoch_id))
            done = others.where(F.col("trigger_date") == F.lit(day)).count()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":      # only "no trigger table yet" means none
                raise
            done = 0
        if done >= daily_cap:
            return
        row = spark.createDataFrame([(day, int(stats["n"]))], "trigger_date date, new_sets long")
        row.write.mode("overwrite").parquet(f"{trigger_path}/epoch_id={int(epoch_id)}")   # a replay replaces its own row
    return write
