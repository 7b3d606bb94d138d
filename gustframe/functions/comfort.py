"""Comfort, weather, interaction and quality formulas on one observation row.

Inputs are column names (or columns) for temperature T, humidity H, wind W and
precipitation P. Humidity defaults through CND1 (``H or 50``) where the
feature groups do so. All expressions are built-ins, so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustframe.functions.mathfn import _c, bins, clamp, default_if_falsy, minmax_fixed

# Heat index regression coefficients (Rothfusz form).
HEAT_INDEX_COEF = (-8.78469475556, 1.61139411, 2.33854883889, -0.14611605, -0.012308094,
                   -0.0164248277778, 0.002211732, 0.00072546, -0.000003582)


def heat_index(t, h) -> Column:
    T, H = _c(t), _c(h)
    c = HEAT_INDEX_COEF
    hi = (F.lit(c[0]) + c[1] * T + c[2] * H + c[3] * T * H + c[4] * T * T + c[5] * H * H
          + c[6] * T * T * H + c[7] * T * H * H + c[8] * T * T * H * H)
    return F.when((T < 27) | (H < 40), T).otherwise(hi)


def wind_chill(t, w) -> Column:
    T, W = _c(t), _c(w)
    v16 = F.pow(W * 3.6, F.lit(0.16))
    wc = F.lit(13.12) + 0.6215 * T - 11.37 * v16 + 0.3965 * T * v16
    return F.when((T > 10) | (W < 1.34), T).otherwise(wc)


def apparent_temperature(t, h, w) -> Column:
    T, H, W = _c(t), _c(h), _c(w)
    general = T + 0.33 * (H / 100 * 6.105 * F.exp(17.27 * T / (237.7 + T))) - 0.7 * W - 4.0
    return (F.when((T >= 27) & (H >= 40), heat_index(T, H))
            .when((T <= 10) & (W >= 1.34), wind_chill(T, W))
            .otherwise(general))


def discomfort_index(t, h) -> Column:
    T, H = _c(t), _c(h)
    return 0.81 * T + 0.01 * H * (0.99 * T - 14.3) + 46.3


def humidity_comfort(h) -> Column:
    H = _c(h)
    return (F.when(H.between(40, 60), 1.0)
            .when(H < 40, F.greatest(F.lit(0.0), 1 - (40 - H) / 40))
            .otherwise(F.greatest(F.lit(0.0), 1 - (H - 60) / 40)))


def temperature_comfort(t) -> Column:
    T = _c(t)
    return (F.when(T.between(18, 24), 1.0)
            .when(T < 18, F.greatest(F.lit(0.0), 1 - (18 - T) / 20))
            .otherwise(F.greatest(F.lit(0.0), 1 - (T - 24) / 20)))


def walking_comfort(t, w, p) -> Column:
    T, W, P = _c(t), _c(w), _c(p)
    s = (F.lit(0.8)
         - F.when(T < 0, 0.3).when(T > 30, 0.2).otherwise(0.0)
         - F.when(P > 0, F.least(F.lit(0.4), P * 0.1)).otherwise(0.0)
         + F.when(W > 5, -0.1).when((W > 1) & (W < 3) & (T > 25), 0.1).otherwise(0.0))
    return clamp(s)


def waiting_comfort(t, w, p) -> Column:
    T, W, P = _c(t), _c(w), _c(p)
    s = (F.lit(0.7)
         - F.when(T < 5, 0.4).when(T > 28, 0.3).otherwise(0.0)
         - F.when(P > 0, F.least(F.lit(0.5), P * 0.15)).otherwise(0.0)
         - F.when(W > 3, F.least(F.lit(0.2), W * 0.05)).otherwise(0.0))
    return clamp(s)


def clothing_index(apparent, w) -> Column:
    A, W = _c(apparent), _c(w)
    base = (F.when(A < 0, 0.0).when(A < 10, 0.2).when(A < 20, 0.5)
            .when(A < 25, 0.7).otherwise(1.0))
    return F.when(W > 5, F.greatest(F.lit(0.0), base - 0.1)).otherwise(base)


def weather_severity(t, h, w, p) -> Column:
    T, H, W, P = _c(t), _c(h), _c(w), _c(p)
    s = (F.when((T < -10) | (T > 35), 0.4).when((T < 0) | (T > 30), 0.2).otherwise(0.0)
         + F.when((H < 20) | (H > 80), 0.2).otherwise(0.0)
         + F.when(W > 10, 0.3).when(W > 5, 0.1).otherwise(0.0)
         + F.when(P > 10, 0.4).when(P > 0, 0.1).otherwise(0.0))
    return F.least(F.lit(1.0), s)


def snow_probability(t, p) -> Column:
    T, P = _c(t), _c(p)
    return (F.when(P == 0, 0.0).when(T <= 0, 0.9).when(T <= 2, 0.7)
            .when(T <= 4, 0.3).otherwise(0.0))


def weather_stress(t, h, w, p) -> Column:
    T, H, W, P = _c(t), _c(h), _c(w), _c(p)
    return (0.3 * (F.abs(T - 20) / 20) + 0.2 * (F.abs(H - 50) / 50)
            + 0.2 * F.least(F.lit(1.0), W / 10) + 0.3 * F.least(F.lit(1.0), P / 10))


def outdoor_activity(t, h, w, p) -> Column:
    W, P = _c(w), _c(p)
    base = (temperature_comfort(t) + humidity_comfort(h)) / 2
    base = F.when(P > 0, base * 0.5).otherwise(base)
    base = F.when(W > 5, base * 0.8).otherwise(base)
    return clamp(base)


def comfort_group(t="temperature_c", h="relative_humidity", w="wind_speed_ms",
                  p="precipitation_mm", prefix="comfort_") -> list[Column]:
    """FTR1: nine comfort features of one row (humidity via CND1)."""
    H = default_if_falsy(h)
    app = apparent_temperature(t, H, w)
    return [
        heat_index(t, H).alias(prefix + "heat_index"),
        wind_chill(t, w).alias(prefix + "wind_chill"),
        app.alias(prefix + "apparent_temperature"),
        discomfort_index(t, H).alias(prefix + "discomfort_index"),
        humidity_comfort(H).alias(prefix + "humidity_comfort"),
        temperature_comfort(t).alias(prefix + "temperature_comfort"),
        walking_comfort(t, w, p).alias(prefix + "walking_comfort"),
        waiting_comfort(t, w, p).alias(prefix + "waiting_comfort"),
        clothing_index(app, w).alias(prefix + "clothing_index"),
    ]


def weather_group(t="temperature_c", h="relative_humidity", w="wind_speed_ms",
                  p="precipitation_mm", prefix="weather_") -> list[Column]:
    """FTR3: normalised values, log precipitation, category codes, severity flags."""
    H = default_if_falsy(h)
    sev = weather_severity(t, H, w, p)
    P = _c(p)
    return [
        minmax_fixed(t, -20, 40).alias(prefix + "temperature_normalized"),
        minmax_fixed(H, 0, 100).alias(prefix + "humidity_normalized"),
        minmax_fixed(w, 0, 30).alias(prefix + "wind_speed_normalized"),
        F.log1p(P).alias(prefix + "precipitation_log"),
        bins(t, (0, 10, 28, 35)).alias(prefix + "temperature_category"),
        bins(H, (30, 70)).alias(prefix + "humidity_category"),
        bins(w, (1, 3, 8)).alias(prefix + "wind_category"),
        F.when(P == 0, 0).when(P < 1, 1).when(P < 10, 2).otherwise(3).alias(prefix + "precipitation_category"),
        sev.alias(prefix + "weather_severity_score"),
        (sev > 0.7).alias(prefix + "is_extreme_weather"),
        sev.between(0.2, 0.4).alias(prefix + "is_pleasant_weather"),
    ]


def interaction_group(t="temperature_c", h="relative_humidity", w="wind_speed_ms",
                      p="precipitation_mm", prefix="interaction_") -> list[Column]:
    """FTR4: eight interaction features."""
    T, W, P = _c(t), _c(w), _c(p)
    H = default_if_falsy(h)
    return [
        (T * H / 100).alias(prefix + "temp_humidity_interaction"),
        (heat_index(T, H) - T).alias(prefix + "heat_index_diff"),
        (W * F.abs(T - 20)).alias(prefix + "wind_temp_interaction"),
        (W * F.greatest(F.lit(0.0), T - 25)).alias(prefix + "wind_cooling_effect"),
        (P * F.abs(T - 15)).alias(prefix + "precipitation_temp_interaction"),
        snow_probability(T, P).alias(prefix + "snow_probability"),
        weather_stress(T, H, W, P).alias(prefix + "weather_stress_index"),
        outdoor_activity(T, H, W, P).alias(prefix + "outdoor_activity_index"),
    ]


def feature_quality(t="temperature_c", h="relative_humidity", w="wind_speed_ms",
                    p="precipitation_mm") -> Column:
    """FTR6: 1 - penalties for missing humidity, 0 degC, extremes, severe weather."""
    T, W = _c(t), _c(w)
    sev = weather_severity(t, default_if_falsy(h), w, p)
    q = (F.lit(1.0)
         - F.when(_c(h).isNull(), 0.2).otherwise(0.0)
         - F.when(T == 0.0, 0.1).otherwise(0.0)
         - F.when(F.abs(T) > 40, 0.1).otherwise(0.0)
         - F.when(W > 30, 0.1).otherwise(0.0)
         - F.when(sev > 0.8, 0.1).otherwise(0.0))
    return clamp(q)


# ---- scores on one row -------------------------------------------------------

def batch_prediction_score(t, h, p) -> Column:
    """SCR3: 70 + temperature and humidity bonuses - precipitation, clamped 0..100."""
    T, H, P = _c(t), _c(h), _c(p)
    s = (F.lit(70.0) + clamp(40 - 2 * F.abs(T - 18), 0, 40)
         + clamp(30 - 0.3 * F.abs(H - 60), 0, 30) - F.least(F.lit(20.0), 10 * P))
    return clamp(s, 0, 100)


def weak_label_score(t, h, w, p, weights=(0.35, 0.25, 0.20, 0.20)) -> Column:
    """SCR4: 0..1 weighted band score (without the reference's random noise)."""
    T, H, W, P = _c(t), default_if_falsy(h), _c(w), _c(p)
    ts = (F.when(T.between(18, 24), 1.0)
          .when(T.between(10, 30), 0.7 - 0.02 * F.abs(T - 21))
          .otherwise(F.greatest(F.lit(0.1), 0.5 - 0.03 * F.abs(T - 21))))
    hs = (F.when(H.between(40, 60), 1.0)
          .when(H.between(30, 80), 0.8 - 0.01 * F.abs(H - 50))
          .otherwise(F.greatest(F.lit(0.1), 0.6 - 0.02 * F.abs(H - 50))))
    ws = (F.when(W <= 5, 1 - 0.1 * W).when(W <= 10, 0.5 - 0.05 * (W - 5))
          .otherwise(F.greatest(F.lit(0.1), 0.25 - 0.02 * (W - 10))))
    ps = F.when(P == 0, 1.0).when(P <= 1, 0.8).when(P <= 5, 0.5).otherwise(0.2)
    a, b, c, d = weights
    return clamp(a * ts + b * hs + c * ws + d * ps)


def label_bands(score, bands=((80, "excellent"), (60, "good"), (50, "uncomfortable")),
                default="harsh") -> Column:
    """SCR6 / label bucket: first band whose lower bound the score reaches."""
    s = _c(score)
    expr = None
    for lo, name in bands:
        expr = F.when(s >= lo, name) if expr is None else expr.when(s >= lo, name)
    return expr.otherwise(default)


# The three band sets used by different reports.
BANDS_BASELINE = ((80, "excellent"), (60, "good"), (50, "uncomfortable"))       # default harsh
BANDS_REPORT = ((80, "excellent"), (60, "good"), (40, "uncomfortable"))         # default harsh
BANDS_BATCH = ((80, "excellent"), (70, "good"), (60, "moderate"), (50, "uncomfortable"))  # default harsh
