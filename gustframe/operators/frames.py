"""Frames: tumbling 3-hour windows (WIN2), sliding 3 h / 1 h sets (WIN1), lookback (FLT1).

The frame key ``(station_id, window_start)`` replaces the reference's "one
small frame" -- every station and every window are computed in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustframe.functions.timefn import trunc_ntz

FRAME_KEY = ("station_id", "window_start")


def with_precipitation_type(df: DataFrame, t: str = "temperature_c", p: str = "precipitation_mm",
                            out: str = "precipitation_type") -> DataFrame:
    """PRJ3: none unless P > 0; snow when T <= 2.0; otherwise rain (also for NULL T)."""
    T, P = F.col(t), F.col(p)
    kind = (F.when(~(P > 0) | P.isNull(), "none")
            .when(T.isNotNull() & (T <= 2.0), "snow").otherwise("rain"))
    return df.withColumn(out, kind)


def tumbling(df: DataFrame, ts: str = "obs_ts", hours: int = 3) -> DataFrame:
    """WIN2: assign each row to its ``hours``-wide tumbling frame (epoch aligned).

    A tumbling ``window()`` is a projection (no Expand), so this adds no shuffle.
    """
    w = F.window(ts, f"{hours} hours")
    return df.withColumn("window_start", w.start).withColumn("window_end", w.end)


def lookback(df: DataFrame, end, hours: int = 3, ts: str = "obs_ts") -> DataFrame:
    """FLT1: closed window ``[end - (hours-1) h, end]`` for a given run time ``end``."""
    end_c = F.lit(end).cast("timestamp_ntz") if not isinstance(end, Column) else end
    start = end_c - F.make_dt_interval(F.lit(0), F.lit(hours - 1))
    return df.where(F.col(ts).between(start, end_c))


def sliding_sets(df: DataFrame, key: str = "station_id", ts: str = "obs_ts",
                 hours: int = 3, step_hours: int = 1) -> DataFrame:
    """WIN1 membership: one output row per (observation, sliding set it belongs to).

    Per station-day, sets start at the first observation floored to the hour and
    advance by ``step_hours`` while ``start < last ts of the day``; a set holds the
    rows with ``start <= ts < start + hours`` of the same day. Each row fans out to
    at most ``hours / step_hours`` sets; day bounds come from an aggregate joined
    back (one row per station-day), not from a window over the day.
    """
    d = df.withColumn("obs_date", F.to_date(ts))
    bounds = (d.groupBy(key, "obs_date")
              .agg(trunc_ntz("hour", F.min(ts)).alias("_day_first"), F.max(ts).alias("_day_last")))
    d = d.join(bounds, on=[key, "obs_date"], how="inner")
    hour = trunc_ntz("hour", ts)
    n_back = -(-hours // step_hours)
    starts = F.array(*[hour - F.make_dt_interval(F.lit(0), F.lit(i * step_hours))
                       for i in range(n_back)])
    d = d.withColumn("window_start", F.explode(starts))
    d = d.where((F.col("window_start") >= F.col("_day_first"))
                & (F.col("window_start") < F.col("_day_last"))
                & (F.col(ts) < F.col("window_start") + F.make_dt_interval(F.lit(0), F.lit(hours)))
                # sets advance on the step grid anchored at the day's first hour
                & (((F.unix_micros(F.col("window_start").cast("timestamp"))
                     - F.unix_micros(F.col("_day_first").cast("timestamp")))
                    % F.lit(step_hours * 3_600_000_000)) == 0))
    d = d.withColumn("window_end", F.col("window_start") + F.make_dt_interval(F.lit(0), F.lit(hours)))
    return d.drop("_day_first", "_day_last")
