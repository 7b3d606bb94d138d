"""Exact quantiles by counting: no task holds the values of a key.

Values become a (key, name, value, count) table, which partial aggregation shrinks before its shuffle; a segmented running
sum over (key, name, value) gives every value its range of ranks, and the values at the wanted ranks are selected from it. A
key with very many distinct values takes as many ranges as it needs.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.operators.sequence import sequence_sum


def value_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, name, value, n (rows with it) and upto (rows of the key and name with this value or less); nulls are left
    out, NaN is the largest value."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "name", "value")
    counts = long.where("value is not null").groupBy(*keys, "name", "value").agg(F.count(F.lit(1)).alias("n"))
    return sequence_sum(counts, [*keys, "name"], ["value"], "n", out="upto")


def quantiles(counts: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """keys, name, n and ``q``: the values at ``probabilities``, with linear interpolation between neighbours, as
    Spark's ``percentile`` gives them, from a table of ``value_counts``."""
    by = [*keys, "name"]
    totals = counts.groupBy(*by).agg(F.max("upto").alias("rows"))
    d = counts.join(totals, on=by)
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1          # ranks of the value, from 0
    picks = []
    for i, p in enumerate(probabilities):
        at = (F.col("rows") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when(rank.between(first, last), F.col("value"))).alias(f"_{side}{i}"))
    g = d.groupBy(*by).agg(F.max("rows").alias("n"), *picks)
    found = []
    for i, p in enumerate(probabilities):
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        found.append(F.when((F.floor(at) == F.ceil(at)) | (low == high), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    return g.select(*by, "n", F.array(*found).alias("q"))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median of each column over all rows, NaN counted as missing; a column without values has none."""
    plain = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c)).alias(c) for c in columns])
    return {r["name"]: r["q"][0] for r in quantiles(value_counts(plain, [], columns), [], [0.5]).collect()}     # a row per column
