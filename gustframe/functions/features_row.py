"""Per-row feature groups (FTR1-FTR4, FTR6) as column lists with prefixed names (PRJ5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustframe.functions import comfort as C
from gustframe.functions import timefn as D


def row_feature_columns(t="temperature_c", h="relative_humidity", w="wind_speed_ms",
                        p="precipitation_mm") -> list[Column]:
    """FTR1 + FTR3 + FTR4 + FTR6 for one observation row (flattened, prefixed)."""
    return (C.comfort_group(t, h, w, p) + C.weather_group(t, h, w, p)
            + C.interaction_group(t, h, w, p)
            + [C.feature_quality(t, h, w, p).alias("feature_quality_score")])


def with_row_features(df: DataFrame, t="temperature_c", h="relative_humidity", w="wind_speed_ms",
                      p="precipitation_mm") -> DataFrame:
    """Same columns as ``row_feature_columns`` but shared sub-results (defaulted
    humidity, heat index, apparent temperature, severity) are computed once in an
    earlier projection, keeping the generated code small."""
    from gustframe.functions.mathfn import default_if_falsy
    d = df.withColumn("_H", default_if_falsy(h))
    d = d.withColumn("_sev", C.weather_severity(t, "_H", w, p))
    d = d.withColumn("_app", C.apparent_temperature(t, "_H", w))
    d = d.withColumn("_hi", C.heat_index(t, "_H"))
    d = d.withColumn("_tc", C.temperature_comfort(t)).withColumn("_hc", C.humidity_comfort("_H"))
    T_, W_, P_ = F.col(t), F.col(w), F.col(p)
    sev, app, hi = F.col("_sev"), F.col("_app"), F.col("_hi")
    from gustframe.functions.mathfn import bins, clamp, minmax_fixed
    outdoor = F.col("_tc") + F.col("_hc")
    outdoor = outdoor / 2
    outdoor = F.when(P_ > 0, outdoor * 0.5).otherwise(outdoor)
    outdoor = clamp(F.when(W_ > 5, outdoor * 0.8).otherwise(outdoor))
    cols = [
        hi.alias("comfort_heat_index"), C.wind_chill(t, w).alias("comfort_wind_chill"),
        app.alias("comfort_apparent_temperature"), C.discomfort_index(t, "_H").alias("comfort_discomfort_index"),
        F.col("_hc").alias("comfort_humidity_comfort"), F.col("_tc").alias("comfort_temperature_comfort"),
        C.walking_comfort(t, w, p).alias("comfort_walking_comfort"),
        C.waiting_comfort(t, w, p).alias("comfort_waiting_comfort"),
        C.clothing_index(app, w).alias("comfort_clothing_index"),
        minmax_fixed(t, -20, 40).alias("weather_temperature_normalized"),
        minmax_fixed("_H", 0, 100).alias("weather_humidity_normalized"),
        minmax_fixed(w, 0, 30).alias("weather_wind_speed_normalized"),
        F.log1p(P_).alias("weather_precipitation_log"),
        bins(t, (0, 10, 28, 35)).alias("weather_temperature_category"),
        bins("_H", (30, 70)).alias("weather_humidity_category"),
        bins(w, (1, 3, 8)).alias("weather_wind_category"),
        F.when(P_ == 0, 0).when(P_ < 1, 1).when(P_ < 10, 2).otherwise(3).alias("weather_precipitation_category"),
        sev.alias("weather_weather_severity_score"), (sev > 0.7).alias("weather_is_extreme_weather"),
        sev.between(0.2, 0.4).alias("weather_is_pleasant_weather"),
        (T_ * F.col("_H") / 100).alias("interaction_temp_humidity_interaction"),
        (hi - T_).alias("interaction_heat_index_diff"),
        (W_ * F.abs(T_ - 20)).alias("interaction_wind_temp_interaction"),
        (W_ * F.greatest(F.lit(0.0), T_ - 25)).alias("interaction_wind_cooling_effect"),
        (P_ * F.abs(T_ - 15)).alias("interaction_precipitation_temp_interaction"),
        C.snow_probability(t, p).alias("interaction_snow_probability"),
        C.weather_stress(t, "_H", w, p).alias("interaction_weather_stress_index"),
        outdoor.alias("interaction_outdoor_activity_index"),
        clamp(F.lit(1.0) - F.when(F.col(h).isNull(), 0.2).otherwise(0.0) - F.when(T_ == 0.0, 0.1).otherwise(0.0)
              - F.when(F.abs(T_) > 40, 0.1).otherwise(0.0) - F.when(W_ > 30, 0.1).otherwise(0.0)
              - F.when(sev > 0.8, 0.1).otherwise(0.0)).alias("feature_quality_score"),
    ]
    return d.select(*df.columns, *cols)


def temporal_columns(ts="obs_ts", prefix="temporal_") -> list[Column]:
    """FTR2: cyclic encodings, calendar parts, commute flags and weights."""
    hr = F.hour(ts)
    morning = hr.between(7, 9)
    evening = hr.between(17, 19)
    rush = morning | evening
    weight = (F.when(rush, 1.5).when(hr.between(6, 10) | hr.between(16, 20), 1.2).otherwise(1.0))
    doy = F.dayofyear(ts)
    return [
        D.cyclic(hr, 24, "sin").alias(prefix + "hour_sin"),
        D.cyclic(hr, 24, "cos").alias(prefix + "hour_cos"),
        D.weekday_mon0(ts).alias(prefix + "day_of_week"),
        D.cyclic(doy, 365, "sin").alias(prefix + "day_of_year_sin"),
        D.cyclic(doy, 365, "cos").alias(prefix + "day_of_year_cos"),
        F.month(ts).alias(prefix + "month"),
        morning.alias(prefix + "is_morning_commute"),
        evening.alias(prefix + "is_evening_commute"),
        rush.alias(prefix + "is_rush_hour"),
        D.is_weekend(ts).alias(prefix + "is_weekend"),
        D.is_holiday(ts).alias(prefix + "is_holiday"),
        F.when(rush, 1.5).otherwise(1.0).alias(prefix + "commute_weight"),
        weight.alias(prefix + "time_of_day_weight"),
    ]
