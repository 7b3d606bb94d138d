"""Plan guards: no cartesian products, nested-loop joins or row-at-a-time Python in any
catalog query, and the row-level scans read only the columns they need."""

import pytest

from gustframe.plans import catalog

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_forbidden_operators(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op}"


def test_scan_prunes_columns(spark):
    plan = catalog.queries()["FTR8_comfort_frames"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # the frame query needs ts, user_id, event_type, value, props, event_id -- all six here, so
    # check a narrow query instead
    plan = catalog.queries()["SRC6_event_time_range_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan


def test_top_n_is_limited_before_the_shuffle(spark):
    plan = catalog.queries()["WIN9_last_100_predictions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


_SPARK_TYPE_NAMES = {"double": "double", "bigint": "bigint", "int": "int", "string": "string",
                     "boolean": "boolean", "timestamp": "timestamp_ntz", "date": "string",
                     "array<string>": "array<string>", "array<double>": "array<double>",
                     "array<bigint>": "array<bigint>"}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_declared_schema_is_the_output_schema(spark, name):
    from gustframe.plans.registry import REGISTRY, parse_schema
    if name.startswith("ML1_"):
        pytest.skip("fits models while building the plan; covered by test_training")
    df = catalog.queries()[name](spark, SF)
    got = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(n, _SPARK_TYPE_NAMES[t]) for n, t in parse_schema(REGISTRY[name].schema)]
    assert got == want
