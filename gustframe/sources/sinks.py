"""Sinks (SNK1-SNK8): partitioned Parquet / JSON writes with a manifest of loads.

A load writes below ``load_id=<its id>/attempt=<new>``, then which stations and hours it holds to ``_covers``, and then commits
one record, a file that appears whole or not at all, to ``_commits``. Readers go by the records: of a load only the newest
committed attempt counts, and of each station and hour only the newest load that holds it. So a half-written load is invisible,
a rerun replaces its load, and overlapping loads give no row twice. Nothing is collected to the driver.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT, COVER = "load_id string, attempt string, seq long", "station string, hour timestamp_ntz, attempt string"


def _load(df: DataFrame, base: str, load_id: str, by: tuple, fmt: str, station: str | None = None, ts: str | None = None) -> None:
    """Write one attempt of a load (rows rebalanced on the partition columns, large ones split) and commit it."""
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    folder = f"{base}/load_id={load_id}/attempt={attempt}"
    (df.hint("rebalance", *by).write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy(*by).save(folder))
    if ts:
        _units(df, station, ts).distinct().write.parquet(f"{base}/_covers/attempt={attempt}")
    record = spark.createDataFrame([(load_id, attempt, time.time_ns())], COMMIT)
    record.coalesce(1).write.json(f"{base}/_commits/{attempt}")


def _units(df: DataFrame, station: str | None, ts: str) -> DataFrame:
    own = F.col(station).cast("string") if station else F.lit(None).cast("string")
    return df.select(own.alias("station"), F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour"))


def committed(spark: SparkSession, base: str) -> DataFrame:
    """load_id, attempt and seq of the newest committed attempt of each load; no rows before the first commit."""
    try:
        records = spark.read.schema(COMMIT).json(f"{base}/_commits/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)
    newest = records.groupBy("load_id").agg(F.max(F.struct("seq", "attempt")).alias("r"))
    return newest.select("load_id", "r.attempt", "r.seq")


def read_loads(spark: SparkSession, base: str, station: str | None, ts: str) -> DataFrame:
    """The rows of a Parquet sink: for each station and hour those of the newest committed load that holds them.

    Superseded attempts are pruned as partitions. Only the units that a newer load holds as well are joined out, so a
    sink without overlaps is read without a join of its rows.
    """
    live = committed(spark, base)
    covers = spark.read.schema(COVER).parquet(f"{base}/_covers").join(live, "attempt")
    newest = (covers.groupBy(F.col("station").alias("_station"), F.col("hour").alias("_hour"))
              .agg(F.max(F.struct("seq", "attempt")).alias("_r"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    older = (covers.select("station", "hour", F.col("attempt").alias("_attempt"))
             .join(newest, F.col("station").eqNullSafe(F.col("_station")) & (F.col("hour") == F.col("_hour")))
             .where(F.col("_attempt") != F.col("_r.attempt")).select("_attempt", "_station", "_hour"))
    rows = spark.read.parquet(base).join(live.select(F.col("attempt").alias("_live")), F.col("attempt") == F.col("_live"), "left_semi")
    own = F.col(station).cast("string") if station else F.lit(None).cast("string")
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz")
    same = (F.col("attempt") == F.col("_attempt")) & own.eqNullSafe(F.col("_station")) & (hour == F.col("_hour"))
    return rows.join(older, same, "left_anti").drop("load_id", "attempt")


def write_normalized(obs: DataFrame, base: str, source: str = "asos", load_id: str = "full") -> None:
    """SNK1: ``load_id / attempt / source / station_id / obs_date`` partitions."""
    d = obs.withColumn("source", F.lit(source)).withColumn("obs_date", F.to_date("obs_ts"))
    _load(d, base, load_id, ("source", "station_id", "obs_date"), "parquet", "station_id", "obs_ts")


def read_normalized(spark: SparkSession, base: str) -> DataFrame:
    """The committed rows of SNK1, each station and hour from its newest load."""
    return read_loads(spark, base, "station_id", "obs_ts")


def write_features(features: DataFrame, base: str, feature_set: str, version: str,
                   ts: str = "window_start", load_id: str = "full") -> None:
    """SNK2: ``<set>/<version>`` folders with ``load_id / attempt / feature_set / version / event_date`` partitions."""
    d = (features.withColumn("feature_set", F.lit(feature_set)).withColumn("version", F.lit(version))
         .withColumn("event_date", F.to_date(ts)))
    station = "station_id" if "station_id" in features.columns else None
    _load(d, f"{base}/{feature_set}/{version}", load_id, ("feature_set", "version", "event_date"), "parquet", station, ts)


def read_features(spark: SparkSession, base: str, feature_set: str, version: str, ts: str = "window_start") -> DataFrame:
    """SRC5: committed feature rows of one version, each station and hour of ``ts`` from its newest load; none where there
    are no such."""
    folder = f"{base}/{feature_set}/{version}"
    try:
        station = "station_id" if "station_id" in spark.read.parquet(folder).columns else None
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "feature_set string, version string, event_date date")
    return read_loads(spark, folder, station, ts)


def label_dataset(frames: DataFrame) -> DataFrame:
    """SNK2b: baseline score + bucket per frame as the training target."""
    return frames.select("station_id", "window_start", "baseline_comfort_score", "label_bucket",
                         F.to_date("window_start").alias("event_date"))


def write_quality_reports(checks: DataFrame, base: str, scope=("station_id",), load_id: str = "full") -> None:
    """SNK3: JSON quality reports of one load, a partition per scope; earlier loads' reports stay."""
    _load(checks, base, load_id, tuple(scope), "json")


def append_rows(df: DataFrame, base: str, partition_by=()) -> None:
    """SNK4 / SNK5 / SNK6: append predictions, metrics or log rows."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(base)


def latest_per_key(df: DataFrame, keys, ts: str, as_of, ttl_seconds: int = 3600, tie=()) -> DataFrame:
    """SNK8: the serving snapshot -- latest row per key, valid for ``ttl_seconds``. Of rows with the same
    time the greatest in ``tie`` wins."""
    cols = df.columns
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(ts, *tie)).alias("_r")).select("_r.*")
    fresh = F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(float(ttl_seconds)))
    return g.where(fresh)


def latest_file(spark: SparkSession, prefix: str, pattern: str = "*") -> DataFrame:
    """SRC8: newest object under a prefix by modification time (path + time only)."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", pattern).load(prefix).select("path", "modificationTime"))
    return listing.agg(F.max_by("path", "modificationTime").alias("path"),
                       F.max("modificationTime").alias("modificationTime"))


def recent_quality_reports(spark: SparkSession, base: str, as_of, n: int = 10, hours: float = 24.0,
                           score: str = "feature_quality_score", rows: str = "row_count") -> DataFrame:
    """SRC7: mean score and total row count over the newest ``n`` report files of the ``hours`` before ``as_of``
    (a timestamp; files are dated by their modification time). Reports without a score count for neither, and those of
    attempts that were not committed or were run again do not count."""
    live = committed(spark, base).select("attempt")
    r = spark.read.json(base).select(score, rows, "attempt", F.col("_metadata.file_path").alias("_file"),
                                     F.col("_metadata.file_modification_time").alias("_mtime")).join(live, "attempt", "left_semi")
    r = r.where(F.col("_mtime") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0)))
    files = r.groupBy("_file").agg(F.max("_mtime").alias("_mtime")).orderBy(F.col("_mtime").desc(), F.col("_file").desc()).limit(n)
    scored = r.join(files.select("_file"), on="_file", how="left_semi").where(F.col(score).isNotNull())
    return scored.agg(F.avg(score).alias("avg_quality"), F.coalesce(F.sum(rows), F.lit(0)).cast("bigint").alias("rows"))
