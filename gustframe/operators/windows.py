"""Order-dependent frame operators: set quality (DQ13/WIN4/WIN5), trends (WIN6-WIN8,
FTR5), continuity (WIN3), last-N caps (WIN9), as-of lookup (JN6), splits and folds
(WIN14, WIN15), per-day caps (WIN13).

Row positions come from ``sequence_index`` / ``sequence_lag`` (segmented scans, so no
task ever holds a whole station); everything else is a grouped aggregate.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustframe.functions.mathfn import clamp, default_if_falsy
from gustframe.functions.timefn import hours_between
from gustframe.operators.sequence import global_index, sequence_asof, sequence_index, sequence_lag


def _hours(n) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


# ---- WIN1 sets with their quality (DQ13) ---------------------------------------

def set_quality_aggregates(ts: str = "obs_ts") -> list[Column]:
    """DQ13 inputs per set; pairs (WIN4/WIN5) are rows whose previous row is in the set."""
    T, H, W, P = (F.col(c) for c in ("temperature_c", "relative_humidity", "wind_speed_ms",
                                       "precipitation_mm"))
    in_pair = F.col("prev_obs_ts").isNotNull() & (F.col("prev_obs_ts") >= F.col("window_start"))
    gap_h = hours_between(F.col(ts), F.col("prev_obs_ts"))
    missing = (F.when(T == 0.0, 1).otherwise(0) + F.when(H.isNull(), 1).otherwise(0)
               + F.when(W < 0, 1).otherwise(0) + F.when(P < 0, 1).otherwise(0))
    extreme = (F.when(F.abs(T) > 50, 1).otherwise(0) + F.when(W > 50, 1).otherwise(0)
               + F.when(P > 100, 1).otherwise(0))
    return [
        F.sum(missing).alias("_missing"),
        F.sum(extreme).alias("_extreme"),
        F.count_if(in_pair).alias("_pairs"),
        F.count_if(in_pair & (F.abs(T - F.col("prev_temperature_c")) > 10)).alias("_jumps"),
        F.stddev_pop(F.when(in_pair, gap_h)).alias("_gap_std"),
    ]


def set_quality_columns() -> list[Column]:
    n = F.col("n_obs")
    completeness = 1.0 - F.col("_missing") / (n * 5)
    reasonableness = F.greatest(F.lit(0.0), 1.0 - 0.1 * F.col("_extreme"))
    consistency = 1.0 - F.try_divide(F.col("_jumps"), F.col("_pairs"))
    gap_consistency = 1.0 - F.least(F.lit(1.0), F.coalesce(F.col("_gap_std"), F.lit(0.0)) / 2.0)
    quality = F.when(n > 1, (completeness + reasonableness + consistency + gap_consistency) / 4) \
        .otherwise((completeness + reasonableness) / 2)
    return [completeness.alias("completeness"), reasonableness.alias("reasonableness"),
            F.when(n > 1, consistency).alias("consistency"),
            F.when(n > 1, gap_consistency).alias("gap_consistency"),
            quality.alias("quality_score")]


def with_day_lag(obs: DataFrame, key: str = "station_id", ts: str = "obs_ts",
                 order: Sequence[str] = ("obs_ts", "event_id")) -> DataFrame:
    """Previous observation of the same station-day."""
    d = obs.withColumn("obs_date", F.to_date(ts))
    return sequence_lag(d, [key, "obs_date"], list(order), [ts, "temperature_c"])


# ---- WIN3 continuity ------------------------------------------------------------

def gap_columns(ts: str = "obs_ts", expected_h: float = 1.0, tolerance_min: float = 10.0) -> dict[str, Column]:
    """WIN3 / DQ4 aggregates over rows with ``prev_<ts>``: gaps, irregular outside 60 +- 10 minutes."""
    gap = hours_between(F.col(ts), F.col("prev_" + ts))
    lo, hi = expected_h - tolerance_min / 60.0, expected_h + tolerance_min / 60.0
    found = {"n_rows": F.count(F.lit(1)), "n_gaps": F.count(gap), "irregular_count": F.count_if((gap < lo) | (gap > hi)),
             "max_gap_hours": F.max(gap), "min_gap_hours": F.min(gap)}
    return {k: v.alias(k) for k, v in found.items()}


def continuity(obs: DataFrame, scope: Sequence[str] = ("station_id",), ts: str = "obs_ts",
               order: Sequence[str] = ("obs_ts", "event_id"),
               expected_h: float = 1.0, tolerance_min: float = 10.0) -> DataFrame:
    """WIN3 / DQ4: consecutive gaps per scope."""
    d = sequence_lag(obs, list(scope), list(order), [ts])
    return d.groupBy(*scope).agg(*gap_columns(ts, expected_h, tolerance_min).values())


# ---- FTR5 trends over a frame ----------------------------------------------------

def frame_trends(frames: DataFrame, keys: Sequence[str] = ("station_id", "window_start"),
                 order: Sequence[str] = ("obs_ts", "event_id")) -> DataFrame:
    """FTR5: WIN6 slopes (T, H, W over row index), pop-std T, WIN7 tendency, stability."""
    d = sequence_index(frames, list(keys), list(order), index_col="_i", size_col="_n")
    T = F.col("temperature_c")
    H = default_if_falsy("relative_humidity")
    W, P = F.col("wind_speed_ms"), F.col("precipitation_mm")
    i, n = F.col("_i").cast("double"), F.col("_n")
    last3 = F.col("_i") > n - 3
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.regr_slope(T, i).alias("_st"), F.regr_slope(H, i).alias("_sh"),
        F.regr_slope(W, i).alias("_sw"),
        F.stddev_pop(T).alias("_sdt"), F.stddev_pop(W).alias("_sdw"), F.stddev_pop(P).alias("_sdp"),
        F.max_by(T, F.when(last3, i)).alias("_t_last"), F.min_by(T, F.when(last3, i)).alias("_t_first3"),
        F.max_by(H, F.when(last3, i)).alias("_h_last"), F.min_by(H, F.when(last3, i)).alias("_h_first3"),
    )
    n = F.col("n_obs")
    small = n < 2
    tend = clamp(-((F.col("_t_last") - F.col("_t_first3")) * 0.1
                   + (F.col("_h_last") - F.col("_h_first3")) * 0.05), -1.0, 1.0)
    stab = ((1.0 - F.least(F.lit(1.0), F.col("_sdt") / 10)) + (1.0 - F.least(F.lit(1.0), F.col("_sdw") / 5))
            + (1.0 - F.least(F.lit(1.0), F.col("_sdp") / 5))) / 3
    return g.select(
        *keys, "n_obs",
        F.when(small, 0.0).otherwise(F.coalesce("_st", F.lit(0.0))).alias("temp_trend"),
        F.when(small, 0.0).otherwise(F.col("_sdt")).alias("temp_volatility"),
        F.when(small, 0.0).otherwise(F.coalesce("_sh", F.lit(0.0))).alias("humidity_trend"),
        F.when(small, 0.0).otherwise(F.coalesce("_sw", F.lit(0.0))).alias("wind_trend"),
        F.when(n < 3, 0.0).otherwise(tend).alias("pressure_tendency"),
        F.when(small, 0.5).otherwise(stab).alias("weather_stability"),
    )


# ---- WIN8 / WIN9 last-N -----------------------------------------------------------

def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
           rank_col: str = "recency_rank") -> DataFrame:
    """WIN9 / SRT3: the newest ``n`` rows per key (rank 1 = newest).

    ``row_number() <= n`` lets Spark insert a partial ``WindowGroupLimit`` before the
    shuffle: every map task keeps only its newest ``n`` rows per key, so a hot key ships
    ``n x tasks`` rows, not all of its rows.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(rank_col, F.row_number().over(w).cast("bigint")).where(F.col(rank_col) <= n)


def first_last_change(df: DataFrame, keys: Sequence[str], value_cols: Sequence[str],
                      rank_col: str = "recency_rank") -> DataFrame:
    """WIN8: % change first->last and pop-std over rows already cut by ``last_n``."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for v in value_cols:
        first = F.max_by(v, rank_col)   # highest rank = oldest row
        last = F.min_by(v, rank_col)
        aggs += [((last - first) / F.abs(first + 1e-6) * 100).alias(f"{v}_change_pct"),
                 F.stddev_pop(v).alias(f"{v}_std")]
    return df.groupBy(*keys).agg(*aggs)


# ---- JN6 as-of lookup ---------------------------------------------------------------

def as_of_lookup(requests: DataFrame, obs: DataFrame, key: str = "station_id",
                 target: str = "target_ts", ts: str = "obs_ts",
                 order: Sequence[str] = ("obs_ts", "event_id"), lookback_h: int = 3,
                 value_cols: Sequence[str] = ()) -> DataFrame:
    """JN6: latest observation with ``target - lookback < ts <= target`` per request.

    Requests and observations form one time-ordered sequence per station
    (``sequence_asof``): each request takes the last observation before it, then the
    lookback bound is applied. Linear in rows, no request x observation pairs, so a
    station-hour holding a third of the data costs one pass, not a product.
    """
    keep = list(order) + [c for c in value_cols if c not in order]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    j = sequence_asof(requests, obs, [key], micros(target), micros(ts), order[-1], keep)
    hit = F.col(f"_asof.{ts}") > F.col(target) - _hours(lookback_h)
    return j.select(*requests.columns, *[F.when(hit, F.col(f"_asof.{c}")).alias(c) for c in keep])


# ---- WIN14 / WIN15 splits and folds -------------------------------------------------

def _in_test(i: Column, n: Column, n_splits: int) -> Column:
    return i > n - F.floor(n / (n_splits + 1))


def _fold(i: Column, n: Column, k: int) -> Column:
    """``ntile(k)`` of position ``i``: the first n % k folds are one row longer."""
    q = F.floor(n / k)
    r = n - q * k
    big = r * (q + 1)
    return F.when(i <= big, F.floor((i - 1) / (q + 1)) + 1).otherwise(r + F.floor((i - big - 1) / q) + 1).cast("int")


def _positioned(df: DataFrame, order: Sequence[str], columns: dict) -> DataFrame:
    d = global_index(df, list(order), index_col="_i", size_col="_n")
    return d.withColumns({k: f(F.col("_i"), F.col("_n")) for k, f in columns.items()}).drop("_i", "_n")


def time_split(df: DataFrame, order: Sequence[str], n_splits: int) -> DataFrame:
    """WIN14: contiguous time split; test = the last floor(n / (k + 1)) rows."""
    return _positioned(df, order, {"is_test": lambda i, n: _in_test(i, n, n_splits)})


def contiguous_folds(df: DataFrame, order: Sequence[str], k: int, fold_col: str = "fold") -> DataFrame:
    """WIN15: ``ntile(k)`` over the time order, from a global position, so no single-partition window."""
    return _positioned(df, order, {fold_col: lambda i, n: _fold(i, n, k)})


def split_and_folds(df: DataFrame, order: Sequence[str], n_splits: int, k: int, fold_col: str = "fold") -> DataFrame:
    """WIN14 and WIN15 from one global position."""
    return _positioned(df, order, {"is_test": lambda i, n: _in_test(i, n, n_splits), fold_col: lambda i, n: _fold(i, n, k)})


def per_day_cap(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str],
                cap: int = 3) -> DataFrame:
    """WIN13: at most ``cap`` rows per (key, day) in time order."""
    d = df.withColumn("_day", F.to_date(ts))
    w = Window.partitionBy(*keys, "_day").orderBy(*order)
    return d.withColumn("attempt_no", F.row_number().over(w)) \
        .where(F.col("attempt_no") <= cap).drop("_day")
