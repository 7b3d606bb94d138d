"""Frame scores (SCR1, SCR2, SCR5) and the frame feature table (AGG1, AGG2, AGG4, FTR8).

All frame statistics of one key are computed in **one** ``groupBy`` so the
frame key is shuffled once; every aggregate is partial-aggregation friendly
(exact median and mode keep a value->count map per group, whose size is the
number of distinct readings, not the number of rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustframe.functions import comfort as C
from gustframe.functions.timefn import commute_period


def frame_aggregates(t="temperature_c", w="wind_speed_ms", p="precipitation_mm",
                     h="relative_humidity", kind="precipitation_type") -> list[Column]:
    """AGG1 + AGG2 + AGG4 aggregate expressions of one frame."""
    T, W, P, H, K = F.col(t), F.col(w), F.col(p), F.col(h), F.col(kind)
    return [
        F.count(F.lit(1)).alias("n_obs"),
        F.median(T).alias("temp_median_3h"),
        (F.max(T) - F.min(T)).alias("temp_range_3h"),
        F.max(W).alias("wind_peak_3h"),
        F.coalesce(F.sum(P), F.lit(0.0)).alias("precip_total_3h"),
        F.mode(K, True).alias("precip_type_dominant"),
        F.avg(H).alias("humidity_avg_3h"),
        F.coalesce(F.sum(F.when((P > 0) & (K != "snow"), P)), F.lit(0.0)).alias("rain_total"),
        F.coalesce(F.sum(F.when((P > 0) & (K == "snow"), P)), F.lit(0.0)).alias("snow_total"),
    ]


def baseline_penalties(median_t="temp_median_3h", rain="rain_total", snow="snow_total",
                       peak_w="wind_peak_3h", mean_h="humidity_avg_3h") -> list[Column]:
    """SCR1 penalties from frame aggregates."""
    m, r, s, wp, hm = (F.col(c) for c in (median_t, rain, snow, peak_w, mean_h))
    pt = (F.when(m.between(10, 25), 0.0)
          .when(m < 10, F.least(F.lit(40.0), (10 - m) * 2.5))
          .otherwise(F.least(F.lit(40.0), (m - 25) * 1.8)))
    pp = F.least(F.lit(45.0), r * 10.0) + F.least(F.lit(50.0), s * 15.0)
    pw = F.when(wp <= 4, 0.0).otherwise(F.least(F.lit(25.0), (wp - 4) * 3.0))
    ph = (F.when(hm.isNull(), 0.0).when(hm.between(30, 70), 0.0)
          .otherwise(F.least(F.lit(15.0), F.abs(hm - 50) * 0.4)))
    return [pt.alias("penalty_temperature"), pp.alias("penalty_precipitation"),
            pw.alias("penalty_wind"), ph.alias("penalty_humidity")]


def baseline_score(frames: DataFrame) -> DataFrame:
    """SCR1 on an aggregated frame table: four penalties, score and label bucket."""
    d = frames.select("*", *baseline_penalties())
    total = (F.col("penalty_temperature") + F.col("penalty_precipitation")
             + F.col("penalty_wind") + F.col("penalty_humidity"))
    score = F.greatest(F.lit(0.0), 100.0 - total)
    return (d.withColumn("baseline_comfort_score", score)
            .withColumn("label_bucket", C.label_bands("baseline_comfort_score", C.BANDS_BASELINE)))


def alternate_penalties(frames: DataFrame) -> DataFrame:
    """SCR2: the alternate penalty set over the same frame aggregates."""
    m, tot, wp, hm = (F.col(c) for c in ("temp_median_3h", "precip_total_3h", "wind_peak_3h",
                                          "humidity_avg_3h"))
    pt = (F.when(m < 10, F.least(F.lit(40.0), (10 - m) * 2.0))
          .when(m > 25, F.least(F.lit(40.0), (m - 25) * 1.5)).otherwise(0.0))
    pp = F.when(tot <= 0, 0.0).when(tot <= 1, 10.0).when(tot <= 5, 20.0).otherwise(35.0)
    pw = F.when(wp > 4, F.least(F.lit(25.0), (wp - 4) * 3.0)).otherwise(0.0)
    ph = (F.when(hm < 30, F.least(F.lit(15.0), (30 - hm) * 0.3))
          .when(hm > 70, F.least(F.lit(15.0), (hm - 70) * 0.5)).otherwise(0.0))
    d = frames.select("*", pt.alias("temp_comfort_penalty"), pp.alias("precip_comfort_penalty"),
                      pw.alias("wind_comfort_penalty"), ph.alias("humidity_comfort_penalty"))
    total = (F.col("temp_comfort_penalty") + F.col("precip_comfort_penalty")
             + F.col("wind_comfort_penalty") + F.col("humidity_comfort_penalty"))
    return d.withColumn("predicted_comfort_score", F.greatest(F.lit(0.0), 100.0 - total))


def comfort_probability_aggs(t="temperature_c", p="precipitation_mm", w="wind_speed_ms") -> list[Column]:
    """SCR5 inputs: mean T, total P, peak W (NULL when the column is all-NULL)."""
    return [F.avg(t).alias("_cp_t"), F.sum(p).alias("_cp_p"), F.max(w).alias("_cp_w")]


def comfort_probability(d: DataFrame) -> DataFrame:
    """SCR5: product of band factors; an all-NULL input skips its factor."""
    t, p, w = F.col("_cp_t"), F.col("_cp_p"), F.col("_cp_w")
    ft = (F.when(t.isNull(), 1.0).when(t.between(15, 25), 1.0)
          .when(((t >= 10) & (t < 15)) | ((t > 25) & (t <= 30)), 0.7)
          .when(((t >= 5) & (t < 10)) | ((t > 30) & (t <= 35)), 0.4).otherwise(0.1))
    fp = (F.when(p.isNull(), 1.0).when(p == 0, 1.0).when(p <= 1, 0.8)
          .when(p <= 5, 0.5).otherwise(0.2))
    fw = (F.when(w.isNull(), 1.0).when(w <= 3, 1.0).when(w <= 7, 0.8)
          .when(w <= 12, 0.5).otherwise(0.2))
    prob = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ft * fp * fw))
    return d.withColumn("comfort_probability", prob).drop("_cp_t", "_cp_p", "_cp_w")


def frame_features(obs: DataFrame, keys=("station_id", "window_start"), min_obs: int = 1,
                   frame_hours: int = 3, more=()) -> DataFrame:
    """FTR8: frame aggregates + dominant type + baseline score, one row per frame; ``more`` aggregates ride along.

    ``obs`` must carry ``precipitation_type`` (PRJ3) and the frame columns. The shuffle
    key is (station, window_start) only; ``window_end`` is derived after the aggregate.
    """
    agg = obs.groupBy(*keys).agg(*frame_aggregates(), *more)
    if min_obs > 1:
        agg = agg.where(F.col("n_obs") >= min_obs)
    out = baseline_score(agg)
    if "window_start" in keys and "window_end" not in keys and "window_end" in obs.columns:
        out = out.withColumn("window_end", F.col("window_start") + F.make_dt_interval(F.lit(0), F.lit(frame_hours)))
    if "window_end" in out.columns:
        out = out.withColumn("target_period", commute_period("window_end"))
    return out


def frame_statistics(frames: DataFrame, keys=("station_id", "window_start"),
                     order=("obs_ts", "event_id")) -> DataFrame:
    """FTR7: AGG5 dispersion, comfort temperature score, severity points, AGG6 shape,
    AGG7 completeness, and the temporal parts of the frame's first row -- one groupBy."""
    from gustframe.functions import timefn as D
    T, W, P, H = (F.col(c) for c in ("temperature_c", "wind_speed_ms", "precipitation_mm",
                                      "relative_humidity"))
    first_ts = F.min_by(F.col(order[0]), F.struct(*order))
    g = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.stddev_samp(T).alias("_sd_t"), F.median(T).alias("_med_t"),
        F.stddev_samp(W).alias("_sd_w"), F.avg(W).alias("_mean_w"), F.max(W).alias("_max_w"),
        F.max(P).alias("_max_p"), F.sum(P).alias("_sum_p"),
        F.count(T).alias("_nn_t"), F.count(W).alias("_nn_w"),
        F.skewness(T).alias("_skew_t"), F.kurtosis(W).alias("_kurt_w"),
        (F.count(T) + F.count(W) + F.count(P) + F.count(H)).alias("_cells"),
        first_ts.alias("_first_ts"),
    )
    m = F.col("_med_t")
    sev = (F.when((m < 0) | (m > 35), 30).when((m < 5) | (m > 30), 15).otherwise(0)
           + F.when(F.col("_max_w") > 15, 25).when(F.col("_max_w") > 10, 10).otherwise(0)
           + F.when(F.col("_sum_p") > 10, 20).when(F.col("_sum_p") > 5, 10).otherwise(0))
    mp = F.col("_max_p")
    ft = F.col("_first_ts")
    return g.select(
        *keys, "n_obs",
        (1.0 / (F.col("_sd_t") + 1e-6)).alias("temp_stability"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * F.exp(-((m - 20) * (m - 20)) / 200.0)))
        .alias("comfort_temp_score"),
        (F.col("_sd_w") / (F.col("_mean_w") + 1e-6)).alias("wind_variability"),
        F.when(mp == 0, 0).when(mp <= 1, 1).when(mp <= 5, 2).otherwise(3).alias("precip_intensity"),
        F.least(F.lit(100), sev).alias("weather_severity"),
        F.when(F.col("_nn_t") > 2, F.col("_skew_t")).otherwise(0.0).alias("temp_skewness"),
        F.when(F.col("_nn_w") > 2, F.col("_kurt_w")).otherwise(0.0).alias("wind_kurtosis"),
        (F.col("_cells") / (F.col("n_obs") * 4)).alias("data_completeness"),
        F.hour(ft).alias("hour_of_day"), D.weekday_mon0(ft).alias("day_of_week"),
        F.month(ft).alias("month_of_year"), D.is_weekend(ft).cast("int").alias("is_weekend"),
        D.is_rush_hour_set(ft).cast("int").alias("is_rush_hour"), D.season_code(ft).alias("season"),
    )


def null_report(obs: DataFrame, key: str = "station_id", ts: str = "obs_ts",
                stored_order: str = "event_id", columns=("temperature_c", "wind_speed_ms",
                                                         "precipitation_mm", "relative_humidity")) -> DataFrame:
    """AGG8: rows, null counts, and unsorted timestamps in stored order."""
    from gustframe.operators.sequence import sequence_lag
    d = sequence_lag(obs, [key], [stored_order], [ts])
    aggs = [F.count(F.lit(1)).alias("row_count"), F.count_if(F.col(ts).isNull()).alias(f"null_{ts}")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]
    aggs.append(F.count_if(F.col(ts) < F.col("prev_" + ts)).alias("unsorted_count"))
    g = d.groupBy(key).agg(*aggs)
    nulls = sum((F.col(f"null_{c}") for c in (ts,) + tuple(columns)), F.lit(0))
    return g.withColumn("valid", (nulls == 0) & (F.col("unsorted_count") == 0))
