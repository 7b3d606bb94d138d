"""Math helpers (MTH1-MTH5, CND1, INF1) as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    if isinstance(col, Column):
        return col
    if isinstance(col, str):
        return F.col(col)
    return F.lit(col)


def clamp(x, lo=0.0, hi=1.0) -> Column:
    """MTH1: max(lo, min(hi, x)); NULL-skipping like the Python NaN outcome."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


def minmax_fixed(x, lo: float, hi: float) -> Column:
    """MTH2: (x - lo) / (hi - lo) clamped to 0..1 for a fixed range."""
    return clamp((_c(x) - F.lit(lo)) / F.lit(float(hi - lo)))


def default_if_falsy(x, default: float = 50.0) -> Column:
    """CND1: ``x or default`` -- NULL and 0 both become the default."""
    c = _c(x)
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def finite_or_zero(x) -> Column:
    """INF1: +-inf and NaN -> 0."""
    c = _c(x)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def bins(x, edges, codes=None, lower_inclusive=False) -> Column:
    """MTH5: ``x < e0 -> 0, x < e1 -> 1, ...`` (or ``<=`` when ``lower_inclusive``)."""
    c = _c(x)
    codes = list(codes) if codes is not None else list(range(len(edges) + 1))
    expr = None
    for edge, code in zip(edges, codes):
        cond = (c <= F.lit(edge)) if lower_inclusive else (c < F.lit(edge))
        expr = F.when(cond, code) if expr is None else expr.when(cond, code)
    return expr.otherwise(codes[len(edges)])


def safe_div(num, den) -> Column:
    """Division that yields NULL for a zero denominator (ANSI-safe)."""
    return F.try_divide(_c(num), _c(den))
