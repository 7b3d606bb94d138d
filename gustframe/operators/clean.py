"""Cleaning, normalisation, filters and dedup (PRJ1-PRJ8, FLT1-FLT6, DDP1-DDP3)."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, BooleanType

from gustframe.functions.timefn import trunc_ntz

SENTINEL_THRESHOLD = -900.0


def coerce_measure(col) -> Column:
    """STR5 + PRJ2: text -> double; blank, '-', '.', unparsable or <= -900 -> NULL."""
    s = F.trim(F.col(col) if isinstance(col, str) else col)
    v = s.try_cast("double")
    return F.when(s.isin("", "-", ".") | s.isNull(), F.lit(None).cast("double")) \
        .when(v <= SENTINEL_THRESHOLD, F.lit(None).cast("double")).otherwise(v)


def first_present(*cols) -> Column:
    """First non-NULL coerced value among alias columns (the key list)."""
    return F.coalesce(*[coerce_measure(c) for c in cols])


def clean_measures(df: DataFrame, temperature: Sequence[str], wind: Sequence[str],
                   precipitation: Sequence[str], humidity: Sequence[str]) -> DataFrame:
    """PRJ2: sentinel cleaning with the documented defaults.

    wind NULL -> 0; precipitation NULL or < 0 -> 0; humidity < 0 -> NULL;
    temperature NULL -> 0 (plus a ``temperature_missing`` flag, §8 #5).
    """
    t = first_present(*temperature)
    w = first_present(*wind)
    p = first_present(*precipitation)
    h = first_present(*humidity)
    return df.select(
        "*",
        F.coalesce(t, F.lit(0.0)).alias("temperature_c"),
        t.isNull().alias("temperature_missing"),
        F.coalesce(w, F.lit(0.0)).alias("wind_speed_ms"),
        F.when(p.isNull() | (p < 0), F.lit(0.0)).otherwise(p).alias("precipitation_mm"),
        F.when(h < 0, F.lit(None).cast("double")).otherwise(h).alias("relative_humidity"),
    )


def normalize_observations(df: DataFrame, station_id=None, source: str = "asos",
                           ingested_at=None) -> DataFrame:
    """PRJ1: add station/source/ingest time, default the precipitation type to 'unknown'."""
    out = df
    if station_id is not None:
        out = out.withColumn("station_id", F.lit(station_id))
    out = out.withColumn("source", F.lit(source))
    out = out.withColumn("ingested_at", F.lit(ingested_at).cast("timestamp_ntz")
                         if ingested_at is not None else F.current_timestamp().cast("timestamp_ntz"))
    if "precipitation_type" in out.columns:
        out = out.withColumn("precipitation_type", F.coalesce("precipitation_type", F.lit("unknown")))
    else:
        out = out.withColumn("precipitation_type", F.lit("unknown"))
    return out


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """PRJ6: int/double/bool columns (plan-time, from the schema)."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (NumericType, BooleanType)) and f.name not in ex]


# Unit suffixes of measurement columns (PRJ7).
MEASURE_SUFFIXES = ("_c", "_pct", "_mm_1h", "_ms", "_hpa", "_km", "_deg", "_tenths")


def suffix_columns(df: DataFrame, suffixes: Sequence[str] = MEASURE_SUFFIXES) -> list[str]:
    """PRJ7: columns whose names end with one of the unit suffixes."""
    return [c for c in df.columns if c.endswith(tuple(suffixes))]


# Frame-feature -> observation column names for re-validation (PRJ8).
REVALIDATION_RENAMES = {
    "temp_median_3h": "temperature_c",
    "wind_peak_3h": "wind_speed_ms",
    "precip_total_3h": "precipitation_mm",
    "humidity_avg_3h": "relative_humidity",
    "event_time": "timestamp",
}


def revalidation_view(df: DataFrame) -> DataFrame:
    """PRJ8: rename frame features so observation validators can run on them."""
    return df.withColumnsRenamed({k: v for k, v in REVALIDATION_RENAMES.items() if k in df.columns})


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """JN8 (plan time): required columns absent from the frame."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    miss = missing_columns(df, required)
    if miss:
        raise ValueError(f"missing required columns: {miss}")
    return df


def lookback_cutoff(df: DataFrame, ts: str, as_of, days: float) -> DataFrame:
    """FLT2: keep ``ts >= as_of - days`` (as_of is a parameter, never the wall clock)."""
    cut = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(float(days) * 86400.0))
    return df.where(F.col(ts) >= cut)


def dedup_first_per_minute(df: DataFrame, keys=("station_id",), ts: str = "obs_ts",
                           order: Sequence[str] = ("obs_ts", "event_id")) -> DataFrame:
    """DDP1: one row per (key, minute), keeping the earliest (then first in file order).

    Implemented as ``max_by``-style aggregation (``min_by`` on the order struct), which
    partially aggregates before the shuffle, so a hot minute costs one row per map task.
    """
    minute = trunc_ntz("minute", ts)
    cols = [c for c in df.columns]
    g = (df.withColumn("_minute", minute)
         .groupBy(*keys, "_minute")
         .agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")))
    return g.select("_r.*")


def dedup_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """DDP2: ``drop_duplicates(keep='last')`` -- the row latest in ``order`` per key."""
    cols = df.columns
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return g.select("_r.*")


def duplicate_count(df: DataFrame, ts: str, scope: Sequence[str] = ()) -> DataFrame:
    """DDP3: rows after the first with the same timestamp, per scope."""
    g = df.groupBy(*scope) if scope else df.groupBy()
    return g.agg((F.count(F.lit(1)) - F.count_distinct(ts)).alias("duplicate_count"))
