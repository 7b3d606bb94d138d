"""Time functions on wall-clock ``TIMESTAMP_NTZ`` columns (DTM1-DTM10).

The session zone is pinned to UTC by ``session.configure`` so that
``date_trunc`` (which returns a zoned TIMESTAMP) round-trips to the same
wall clock when cast back to NTZ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month-day holidays treated as non-working days (DTM7).
HOLIDAYS_MM_DD = ("01-01", "02-11", "02-12", "02-13", "03-01", "05-05", "06-06", "08-15",
                  "10-03", "10-09", "12-25")

# Rush hours, two variants used by different feature groups (DTM6).
RUSH_HOURS_SET = (7, 8, 9, 18, 19, 20)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trunc_ntz(unit: str, col) -> Column:
    """DTM3: floor to ``unit`` (hour, minute, day, ...) keeping TIMESTAMP_NTZ."""
    return F.date_trunc(unit, _c(col)).cast("timestamp_ntz")


def add_hours(col, hours) -> Column:
    return _c(col) + F.make_dt_interval(F.lit(0), F.lit(hours) if not isinstance(hours, Column) else hours)


def parse_compact(col) -> Column:
    """DTM1: ``yyyyMMddHHmm`` or ``yyyyMMddHH`` text to NTZ; malformed -> NULL."""
    s = F.trim(_c(col))
    return F.coalesce(
        F.when(F.length(s) == 12, F.try_to_timestamp(s, F.lit("yyyyMMddHHmm"))),
        F.when(F.length(s) == 10, F.try_to_timestamp(s, F.lit("yyyyMMddHH"))),
    ).cast("timestamp_ntz")


def parse_iso(col) -> Column:
    """DTM2: ISO-8601 text to NTZ wall clock; malformed -> NULL."""
    return _c(col).try_cast("timestamp_ntz")


def previous_hour_rule(col) -> Column:
    """DTM4: the hour to request -- floor to hour, one hour earlier when minute < 10."""
    h = trunc_ntz("hour", col)
    return F.when(F.minute(_c(col)) < 10, h - F.expr("INTERVAL 1 HOUR")).otherwise(h)


def hours_between(later, earlier) -> Column:
    """Difference in hours of two NTZ columns (micros precision)."""
    return (F.unix_micros(_c(later).cast("timestamp")) - F.unix_micros(_c(earlier).cast("timestamp"))) / 3.6e9


def weekday_mon0(col) -> Column:
    """DTM5: Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(col))


def is_weekend(col) -> Column:
    return weekday_mon0(col) >= 5


def season_code(col) -> Column:
    """DTM6: 0 spring (3-5), 1 summer (6-8), 2 autumn (9-11), 3 winter (12-2)."""
    m = F.month(_c(col))
    return (F.when(m.between(3, 5), 0).when(m.between(6, 8), 1)
            .when(m.between(9, 11), 2).otherwise(3))


def is_rush_hour_set(col) -> Column:
    return F.hour(_c(col)).isin(*RUSH_HOURS_SET)


def is_rush_hour_ranges(col) -> Column:
    h = F.hour(_c(col))
    return h.between(7, 9) | h.between(17, 19)


def is_holiday(col) -> Column:
    """DTM7: fixed month-day holiday list."""
    return F.date_format(_c(col), "MM-dd").isin(*HOLIDAYS_MM_DD)


def cyclic(col, period: float, fn: str = "sin") -> Column:
    """DTM8: sin/cos of 2*pi*value/period."""
    arg = F.lit(2 * 3.141592653589793) * _c(col) / F.lit(float(period))
    return F.sin(arg) if fn == "sin" else F.cos(arg)


def freshness_factor(obs_ts, as_of) -> Column:
    """DTM9: age bands in hours: <=1 -> 1.0, <=3 -> 0.8, <=6 -> 0.6, else 0.3."""
    age = hours_between(as_of, obs_ts)
    return (F.when(age <= 1, 1.0).when(age <= 3, 0.8).when(age <= 6, 0.6).otherwise(0.3))


def commute_period(col) -> Column:
    """FLT5 period choice: 6-10 morning, 14-19 evening, otherwise morning."""
    h = F.hour(_c(col))
    return F.when(h.between(14, 19), "evening").otherwise("morning")


def in_service_window(col) -> Column:
    """FLT5 serving predicate: morning 6 <= h < 9, evening 14 <= h <= 18."""
    h = F.hour(_c(col))
    return ((h >= 6) & (h < 9)) | h.between(14, 18)


def station_wall_clock(col, zone: str = "Asia/Seoul") -> Column:
    """DTM10: zone-aware instants become the station's wall clock (NTZ); NTZ input is
    already wall clock and is returned unchanged (the reference only relabels it)."""
    c = _c(col)
    return F.from_utc_timestamp(c.cast("timestamp"), zone).cast("timestamp_ntz")
