"""Exact quantiles by counting and isolation forests against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustframe.operators import isolation
from gustframe.operators.quantiles import medians, quantiles, value_counts
from gustframe.operators.sequence import sequence_sum


def _rows(n=900):
    rnd = random.Random(2)
    return [(rnd.choice(["hot", "hot", "hot", "a", None]), i, rnd.choice([None, 1.5, 2.0, rnd.gauss(10, 4)]), float(i % 7) if i % 5 else None)
            for i in range(n)] + [("empty", n, None, None), ("one", n + 1, 3.25, 1.0)]


def test_quantiles_equal_percentile(spark):
    df = spark.createDataFrame(_rows(), "k string, id int, x double, y double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.name): (r.n, r.q) for r in quantiles(value_counts(df, ["k"], ["x", "y"]).where("k is not null"), ["k"], probabilities).collect()}
    for c in "xy":
        want = df.where("k is not null").groupBy("k").agg(F.count(c).alias("n"), F.percentile(c, F.array(*map(F.lit, probabilities))).alias("q")).collect()
        for r in want:
            assert (r.k, c) not in got if r.n == 0 else (got[r.k, c][0] == r.n and np.allclose(got[r.k, c][1], r.q, rtol=0, atol=1e-12))
    exact = medians(df, ["x", "y"])
    for c in "xy":
        assert exact[c] == pytest.approx(df.agg(F.median(c)).first()[0], abs=1e-12)


def test_running_sums_equal_a_window(spark):
    rows = [(k or "none", i) for k, i, _, _ in _rows(400)]
    df = spark.createDataFrame(rows, "k string, id int")
    got = {r.id: r.upto for r in sequence_sum(df.withColumn("v", F.col("id") % 11), ["k"], ["id"], "v").collect()}
    total = {}
    for k, i in sorted(rows, key=lambda r: r[1]):
        total[k] = total.get(k, 0) + i % 11
        assert got[i] == total[k]


class _Node:
    """A tree as nodes, grown and walked recursively."""

    def __init__(self, values, depth, limit, rng):
        self.size, self.depth, self.cut = len(values), depth, None
        low, high = min(values), max(values)
        if depth < limit and low < high:
            self.cut = low + (high - low) * rng.random()
            self.cut = self.cut if self.cut < high else low
            self.left = _Node([v for v in values if v <= self.cut], depth + 1, limit, rng)
            self.right = _Node([v for v in values if v > self.cut], depth + 1, limit, rng)

    def path(self, v):
        if self.cut is None:
            return self.depth + isolation.expected_path(self.size)
        return (self.left if v <= self.cut else self.right).path(v)


def _plain_share(pooled, values, seed):
    rng = np.random.default_rng(seed)
    size, paths = min(isolation.SAMPLE, len(pooled)), np.zeros(len(values))
    for _ in range(isolation.TREES):
        own = rng.choice(np.array(pooled), size, replace=False).tolist()
        tree = _Node(own, 0, math.ceil(math.log2(max(size, 2))), rng)
        paths += [tree.path(v) for v in values]
    scores = -np.exp2(-paths / isolation.TREES / max(isolation.expected_path(size), 1e-12))
    return int((scores < np.percentile(scores, 100 * isolation.CONTAMINATION)).sum())


def test_forest_equals_plain_trees(spark):
    rnd = random.Random(9)
    rows = [("s", i, round(rnd.gauss(15, 5), 1)) for i in range(1500)] + [("t", i, float(i % 4)) for i in range(40)]
    rows += [("one", 0, 4.0), ("none", 0, None), ("none", 1, float("nan")), ("same", 0, 2.0), ("same", 1, 2.0), ("s", 5000, 80.0), ("s", 5001, None)]
    df = spark.createDataFrame(rows, "k string, id int, v double")
    pooled = {}
    for r in isolation.pool(df, ["k"], "v", ["id"]).orderBy("k", "_n").collect():
        pooled.setdefault(r.k, []).append(r._value)
    assert {k: len(v) for k, v in pooled.items()} == {"s": isolation.POOL, "t": 40, "one": 1, "same": 2}
    got = {r.k: r for r in isolation.anomaly_share(df, ["k"], "v", ["id"]).collect()}
    for k in ("s", "t", "same"):
        values = [v for key, _, v in rows if key == k and v is not None]
        flagged = _plain_share(pooled[k], values, isolation.key_seed((k,)))
        assert (got[k].n_rows, got[k].flagged) == (len(values), flagged)
        assert got[k].anomaly_score == pytest.approx(1 - flagged / len(values))
    assert (got["one"].n_rows, got["one"].anomaly_score) == (1, 0.5)
    assert (got["none"].n_rows, got["none"].anomaly_score) == (0, 0.0)
    assert 0.05 < got["s"].flagged / got["s"].n_rows <= 0.1


def test_distinct_sketches_of_days_merge(spark):
    from gustframe.operators.selection import SKETCH_BITS, day_sketches, distinct_counts, feature_stats, merged_distinct
    df = spark.range(60_000).select(
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, CAST(id % 480 AS INT))").alias("ts"),
        (F.col("id") % 9000).cast("double").alias("many"), (F.col("id") % 7).alias("few"),
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("id") * 0.5).alias("x"))
    features = ["many", "few", "x"]
    exact = {r.feature: r.n_distinct for r in distinct_counts(df, features).collect()}
    assert exact == {"many": 9000, "few": 7, "x": 40_000}
    days = day_sketches(df, features, "ts").cache()
    assert days.count() == 20 * 3
    merged = {r.feature: r.n_distinct for r in merged_distinct(days).collect()}
    halves = merged_distinct(days.where("day <= '2024-01-10'").unionByName(days.where("day > '2024-01-10'")))
    one_pass = merged_distinct(day_sketches(df.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")), features, "ts"))
    for other in (halves, one_pass):
        assert {r.feature: r.n_distinct for r in other.collect()} == merged
    for f in features:
        assert abs(merged[f] / exact[f] - 1) < 4 * 1.04 / 2 ** (SKETCH_BITS / 2)
    near = {r.feature: r for r in feature_stats(df, features, "x", merged_distinct(days)).collect()}
    for r in feature_stats(df, features, "x").collect():
        assert abs(near[r.feature].unique_ratio - r.unique_ratio) <= 0.07 * r.unique_ratio and near[r.feature].variance == r.variance
    days.unpersist()
