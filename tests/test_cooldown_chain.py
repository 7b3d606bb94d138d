"""Cool-down chains over ranges: rows that come twice, hot keys over many ranges, pauses longer than a range."""

from collections import Counter

from pyspark.sql import functions as F

from gustframe.operators.sequence import sequence_chain


def test_chain_over_ranges_equals_greedy(spark):
    rows = [("hot", 7 * i + i % 5, i, 40) for i in range(3000)] + [("hot", 7 * i + i % 5, i, 40) for i in range(0, 3000, 3)]
    rows += [("long", i * 3, i, 100_000) for i in range(2000)] + [("some", i * i, i, 30 + 50 * (i % 2)) for i in range(60)]
    want, free = [], {}
    for k, t, i, pause in sorted(rows):
        if t >= free.get(k, t):
            want.append((k, t))
            free[k] = t + pause
    got = sequence_chain(spark.createDataFrame(rows, "k string, t long, i long, pause long"), "k", "t", "i", "pause").collect()
    assert Counter((r.k, r.t) for r in got) == Counter(want)


def test_rows_that_come_twice_fire_once(spark):
    from gustframe.operators.monitor import apply_cooldown
    rows = [("r", "h", i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", 30, True) for i in range(120)] * 2
    df = spark.createDataFrame(rows, "rule_name string, host string, event_id long, metric_ts string, cooldown_minutes int, "
                               "sustained boolean").withColumn("metric_ts", F.to_timestamp_ntz(F.col("metric_ts")))
    assert sorted(r.fired_ts.hour * 60 + r.fired_ts.minute for r in apply_cooldown(df).collect()) == [0, 30, 60, 90]
