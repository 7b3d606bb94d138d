"""Feature pipeline chain (PIP1, UDF1): ``DataFrame -> DataFrame`` steps with declared outputs.

A step is ``(name, fn, promised_columns)``. Steps run through ``DataFrame.transform``;
promised columns are checked at plan time (no job); the run report (row count and
all-NULL output columns) is ONE aggregate over the result.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = tuple[str, Callable[[DataFrame], DataFrame], Sequence[str]]


def run_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    out = df
    for name, fn, promised in steps:
        out = out.transform(fn)
        missing = [c for c in promised if c not in out.columns]
        if missing:
            raise ValueError(f"step {name!r} did not produce {missing}")
    return out


def run_report(out: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count, input emptiness and the list of all-NULL columns, in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.count(c).alias(c) for c in columns]
    g = out.agg(*aggs)
    all_null = F.filter(F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return g.select("rows", (F.col("rows") == 0).alias("empty_input"), all_null.alias("all_null_columns"))
