"""Feature scores and correlations where a column does not vary, has one value or none."""

import math

from gustframe.operators import selection as SE

SCHEMA = "a double, b double, c double, d double, y double"


def _rows(constant):
    # a varies, b is constant over many partitions, c has one value, d has none; 0.1 has no exact binary form
    return [(float(i % 5), 0.1, 2.0 if i == 3 else None, None, constant if constant is not None else float(i % 7)) for i in range(60)]


def test_scores_with_a_constant_target(spark):
    df = spark.createDataFrame(_rows(0.0), SCHEMA).repartition(7)
    got = {r.feature: r for r in SE.feature_stats(df, ["a", "b", "c", "d"], "y").collect()}
    assert all(math.isnan(got[f].target_corr) for f in "abc") and got["d"].target_corr is None
    assert got["a"].unique_ratio == 5 / 60 and math.isnan(got["d"].unique_ratio) and got["d"].completeness == 0.0
    # NaN is the largest number: as in SQL, a score that is not known stays in the selection
    chosen = {r.feature for r in SE.training_selection(SE.feature_stats(df, ["a", "b"], "y")).collect()}
    assert chosen == {"a", "b"}
    stats, pairs = SE.profile(df, ["a", "b"], "y")
    assert [r.feature for r in SE.redundancy_drop(stats, pairs).collect()] == ["a"]


def test_pairs_with_a_constant_column(spark):
    df = spark.createDataFrame(_rows(None), SCHEMA).repartition(7)
    got = {(r.feature_a, r.feature_b): r.corr for r in SE.correlation_pairs(df, ["a", "b", "c", "d", "y"]).collect()}
    assert all(math.isnan(got[p]) for p in [("a", "b"), ("a", "c"), ("b", "y"), ("c", "y")])
    assert all(v is None for p, v in got.items() if "d" in p)
    want = df.corr("a", "y")
    assert abs(got["a", "y"] - want) < 1e-12


def test_scores_of_no_rows(spark):
    got = SE.feature_stats(spark.createDataFrame([], SCHEMA), ["a", "b"], "y").collect()
    assert {r.feature for r in got} == {"a", "b"} and all(r.target_corr is None and r.variance is None for r in got)
