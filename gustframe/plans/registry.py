"""Query registry with a declared output schema.

Every registered query declares its output columns and types once. The Spark
result and the DuckDB oracle are both projected through that declaration:
doubles rounded to 6 digits (and -0.0 folded to 0.0), integer widths fixed,
so the two engines can be compared value by value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from string import Template
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6
SCALE = float(10 ** DIGITS)  # round(x * 1e6 + JITTER) / 1e6: same bits in Spark and DuckDB
# Values built from binary fractions (k/16, k/128 ...) often sit exactly on a
# 6-digit half; a fixed shift moves the rounding boundary off those ties so a
# last-bit difference between two engines cannot flip the rounded digit.
JITTER = 0.0137

_SPARK_TYPES = {
    "double": "double", "bigint": "bigint", "int": "int", "string": "string",
    "boolean": "boolean", "timestamp": "timestamp_ntz", "date": "date",
    "array<string>": "array<string>", "array<double>": "array<double>",
    "array<bigint>": "array<bigint>",
}
_DUCK_TYPES = {
    "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE",
    "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]", "array<bigint>": "BIGINT[]",
}


def parse_schema(schema: str) -> list[tuple[str, str]]:
    out = []
    for part in schema.split(","):
        part = part.strip()
        if not part:
            continue
        name, typ = part.split(None, 1)
        typ = typ.strip().lower()
        if typ not in _SPARK_TYPES:
            raise ValueError(f"unsupported type {typ!r} for {name}")
        out.append((name, typ))
    return out


def normalize(df: DataFrame, schema: str) -> DataFrame:
    cols = []
    for name, typ in parse_schema(schema):
        c = F.col(name)
        if typ == "double":
            # "+ 0.0" turns -0.0 into 0.0 (IEEE) without repeating the expression
            c = F.round(c.cast("double") * SCALE + JITTER, 0) / SCALE + F.lit(0.0)
        elif typ == "array<double>":
            c = F.transform(c.cast("array<double>"),
                            lambda x: F.when(F.round(x * SCALE + JITTER, 0) == 0, F.lit(0.0))
                            .otherwise(F.round(x * SCALE + JITTER, 0) / SCALE))
        elif typ == "date":   # dates travel as ISO text: engines map DATE to different pandas types
            c = F.date_format(c.cast("date"), "yyyy-MM-dd")
        else:
            c = c.cast(_SPARK_TYPES[typ])
        cols.append(c.alias(name))
    return df.select(*cols)


def wrap_sql(inner: str, schema: str) -> str:
    cols = []
    for name, typ in parse_schema(schema):
        q = f'"{name}"'
        if typ == "double":
            r = f"(ROUND(CAST(q.{q} AS DOUBLE) * {SCALE!r} + {JITTER!r}) / {SCALE!r})"
            cols.append(f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END AS {q}")
        elif typ == "array<double>":
            r = f"(ROUND(x * {SCALE!r} + {JITTER!r}) / {SCALE!r})"
            cols.append(f"list_transform(CAST(q.{q} AS DOUBLE[]), lambda x: CASE WHEN {r} = 0 "
                        f"THEN CAST(0 AS DOUBLE) ELSE {r} END) AS {q}")
        elif typ == "date":
            cols.append(f"strftime(CAST(q.{q} AS DATE), '%Y-%m-%d') AS {q}")
        else:
            cols.append(f"CAST(q.{q} AS {_DUCK_TYPES[typ]}) AS {q}")
    return "SELECT " + ", ".join(cols) + f" FROM (\n{inner}\n) AS q"


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    schema: str
    sql: str | None = None          # DuckDB text; $view placeholders expanded by ``expand``
    ids: tuple[str, ...] = field(default_factory=tuple)
    bench: bool = True


REGISTRY: dict[str, Query] = {}
SQL_VIEWS: dict[str, str] = {}


def register(name: str, schema: str, sql: str | None = None, ids: tuple[str, ...] = (),
             bench: bool = True):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, schema, sql, tuple(ids), bench)
        return fn
    return deco


def sql_view(name: str, text: str) -> None:
    SQL_VIEWS[name] = text


_DEC = re.compile(r"(?<![\w.])(\d+\.\d+(?:[eE][-+]?\d+)?|\d+[eE][-+]?\d+)(?![\w.])")


def double_literals(sql: str) -> str:
    """Make DuckDB read ``0.7`` as DOUBLE (it defaults to DECIMAL), as Spark does
    for Python floats, so both engines do the same IEEE arithmetic."""
    parts = sql.split("'")
    for i in range(0, len(parts), 2):  # outside single-quoted strings
        parts[i] = _DEC.sub(lambda m: f"CAST({m.group(1)} AS DOUBLE)", parts[i])
    return "'".join(parts)


def expand(sql: str) -> str:
    # views may reference earlier views; expand until stable
    prev = None
    while prev != sql:
        prev = sql
        sql = Template(sql).safe_substitute({k: f"(\n{v}\n)" for k, v in SQL_VIEWS.items()})
    return sql


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    q = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from gustframe.session import configure
        configure(spark)
        return normalize(q.build(spark, sf_dir), q.schema)

    run.__name__ = f"query_{name}"
    return run


def oracle(name: str) -> str | None:
    q = REGISTRY[name]
    if q.sql is None:
        return None
    return wrap_sql(double_literals(expand(q.sql)), q.schema)
