"""Import every catalog module so that their ``register`` calls run."""

from gustframe.plans import views  # noqa: F401  (DuckDB view text)
from gustframe.plans import catalog_frames, catalog_rows, catalog_windows, catalog_quality, catalog_eval, catalog_monitor, catalog_select, catalog_io, catalog_frames2, catalog_wide, catalog_stats, catalog_text  # noqa: F401
from gustframe.plans.registry import REGISTRY, oracle, spark_query


def queries():
    return {name: spark_query(name) for name in REGISTRY}


def oracle_sql():
    out = {}
    for name in REGISTRY:
        sql = oracle(name)
        if sql is not None:
            out[name] = sql
    return out
