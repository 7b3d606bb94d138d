"""Wide station rows: core-feature projection (PRJ4), row quality (DQ11), completeness and
reliability (DQ12), condition list (ARR1), suffix feature count (PRJ7), static importance
ranking (SRT6), frame confidence (FTR9), tail-rule anomaly score (FTR10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustframe.functions.timefn import hours_between

# Core measures in importance order and their standard names.
CORE_FEATURES = ("temperature", "humidity", "precipitation_1h", "wind_speed", "pressure", "visibility",
                 "wind_direction", "cloud_cover")
CORE_RENAMES = {"temperature": "temperature_c", "humidity": "relative_humidity_pct",
                "precipitation_1h": "precipitation_mm_1h", "wind_speed": "wind_speed_ms",
                "pressure": "pressure_hpa", "visibility": "visibility_km",
                "wind_direction": "wind_direction_deg", "cloud_cover": "cloud_cover_tenths"}
COMPLETENESS_FIELDS = ("temperature_c", "relative_humidity_pct", "precipitation_mm_1h", "wind_speed_ms",
                       "pressure_hpa", "visibility_km")
# Domain importance of the standard measures (SRT6).
STATIC_IMPORTANCE = {"temperature_c": 1.0, "precipitation_mm_1h": 0.95, "relative_humidity_pct": 0.85,
                     "wind_speed_ms": 0.80, "visibility_km": 0.70, "pressure_hpa": 0.60,
                     "wind_direction_deg": 0.50, "cloud_cover_tenths": 0.45}


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c))


def row_quality(wide: DataFrame, as_of) -> Column:
    """DQ11: 0..100 row quality (completeness band x range factors x age factor)."""
    ratio = sum((_present(c).cast("int") for c in CORE_FEATURES), F.lit(0)) / len(CORE_FEATURES)
    band = F.when(ratio < 0.5, 0.3).when(ratio < 0.7, 0.6).when(ratio < 0.9, 0.8).otherwise(1.0)
    t, h, w = F.col("temperature"), F.col("humidity"), F.col("wind_speed")
    ft = F.when(t.isNotNull() & ((t < -50) | (t > 60)), 0.8).otherwise(1.0)
    fh = F.when(h.isNotNull() & ((h < 0) | (h > 100)), 0.8).otherwise(1.0)
    fw = F.when(w.isNotNull() & ((w < 0) | (w > 100)), 0.8).otherwise(1.0)
    fa = F.when(hours_between(F.lit(as_of).cast("timestamp_ntz"), F.col("obs_ts")) > 2, 0.9).otherwise(1.0)
    q = F.lit(100.0) * band * ft * fh * fw * fa
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), q))


def core_features(wide: DataFrame, as_of, min_quality: float = 50.0) -> DataFrame:
    """PRJ4 + DQ11 + DQ12 + ARR1 + PRJ7 on each wide row."""
    d = wide.withColumn("data_quality", row_quality(wide, as_of))
    renamed = [F.when(_present(src), F.col(src).cast("double")).alias(dst) for src, dst in CORE_RENAMES.items()]
    d = d.select("station_id", "obs_ts", "event_id", "data_quality", *renamed)
    comp = sum((F.col(c).isNotNull().cast("int") for c in COMPLETENESS_FIELDS), F.lit(0)) / len(COMPLETENESS_FIELDS) * 100.0
    t, h, p, w = (F.col(c) for c in ("temperature_c", "relative_humidity_pct", "precipitation_mm_1h", "wind_speed_ms"))
    rel = (F.lit(100.0) * F.when((t > 35) & (h > 90), 0.9).otherwise(1.0)
           * F.when((p > 0) & (h < 50), 0.8).otherwise(1.0))
    conditions = F.filter(F.array(
        F.when(t < 0, F.lit("freezing")).when(t > 30, F.lit("hot")),
        F.when(p > 10, F.lit("heavy_rain")).when(p > 0, F.lit("light_rain")),
        F.when(w > 10, F.lit("windy"))), lambda x: x.isNotNull())
    count = sum((F.col(c).isNotNull().cast("int") for c in CORE_RENAMES.values()), F.lit(0))
    return d.select("*", comp.alias("feature_completeness"),
                    F.greatest(F.lit(0.0), F.least(F.lit(100.0), rel)).alias("feature_reliability"),
                    conditions.alias("weather_conditions"), F.size(conditions).alias("severity_level"),
                    count.alias("feature_count"),
                    (F.col("data_quality") > min_quality).alias("passes_quality"))


def importance_ranking(core: DataFrame) -> DataFrame:
    """SRT6: the standard measures ranked by static importance, with observed coverage."""
    names = list(STATIC_IMPORTANCE)
    cov = core.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in names])
    long = cov.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(STATIC_IMPORTANCE[c]).alias("importance"),
                 (F.col(c) / F.col("_n")).alias("coverage")) for c in names])).alias("s")).select("s.*")
    # eight literal rows: a global rank window is fine here
    return long.withColumn("rank", F.rank().over(Window.orderBy(F.col("importance").desc())))


def frame_confidence(core: DataFrame, as_of, keys=("station_id", "window_start")) -> DataFrame:
    """FTR9: mean quality/100 x mean completeness/100 x freshness band of the newest row."""
    g = core.groupBy(*keys).agg(F.avg("data_quality").alias("_q"), F.avg("feature_completeness").alias("_c"),
                                F.max("obs_ts").alias("_latest"))
    age = hours_between(F.lit(as_of).cast("timestamp_ntz"), F.col("_latest"))
    band = F.when(age <= 1, 1.0).when(age <= 3, 0.8).when(age <= 6, 0.6).otherwise(0.3)
    conf = F.lit(1.0) * (F.col("_q") / 100.0) * (F.col("_c") / 100.0) * band
    return g.select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("feature_confidence"))


def tail_anomaly_score(obs: DataFrame, key: str = "station_id", value: str = "temperature_c",
                       contamination: float = 0.1) -> DataFrame:
    """A plain tail rule beside FTR10's forest (``isolation.py``): flag rows whose distance from the key's median is above the
    key's (1 - contamination) quantile of distances; score = share not flagged.
    Two exact percentile aggregates per key, each joined back (one row per key)."""
    med = obs.groupBy(key).agg(F.median(value).alias("_med"))
    d = obs.join(med, key).withColumn("_dist", F.abs(F.col(value) - F.col("_med")))
    cut = d.groupBy(key).agg(F.percentile("_dist", 1.0 - contamination).alias("_cut"))
    d = d.join(cut, key)
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"),
                              F.count_if(F.col("_dist") > F.col("_cut")).alias("flagged"),
                              (1 - F.count_if(F.col("_dist") > F.col("_cut")) / F.count(F.lit(1))).alias("anomaly_score"))
