"""Segmented scans equal plain key-wide windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from gustframe.operators.sequence import sequence_index, sequence_lag


def test_lag_and_index_match_windows(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("abc"), rnd.randint(0, 500), i, float(rnd.randint(0, 9))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v double")
    w = Window.partitionBy("k").orderBy("t", "id")
    ref = df.select("k", "id", F.lag("v").over(w).alias("pv"), F.row_number().over(w).alias("rn"))
    got = sequence_lag(df, ["k"], ["t", "id"], ["v"])
    got = sequence_index(got, ["k"], ["t", "id"], index_col="rn2", size_col="n")
    j = ref.join(got, on=["k", "id"]).collect()
    assert len(j) == 400
    for r in j:
        assert r.pv == r.prev_v and r.rn == r.rn2


def test_streak_matches_plain_window(spark):
    from gustframe.operators.sequence import sequence_streak
    rnd = random.Random(11)
    rows = [(rnd.choice("xy"), rnd.randint(0, 300), i, rnd.random() < 0.7) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, id int, f boolean")
    w = Window.partitionBy("k").orderBy("t", "id")
    ref = df.withColumn("i", F.row_number().over(w)).withColumn(
        "nf", F.max(F.when(~F.col("f"), F.col("i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ref = ref.select("k", "id", (F.col("i") - F.coalesce("nf", F.lit(0))).alias("want"))
    got = sequence_streak(df, ["k"], ["t", "id"], "f")
    bad = got.join(ref, ["k", "id"]).where(F.col("streak") != F.col("want")).count()
    assert bad == 0 and got.count() == 500


def test_asof_matches_brute_force_both_directions(spark):
    from gustframe.operators.sequence import sequence_asof
    rnd = random.Random(5)
    right = [(rnd.choice("ab"), rnd.randint(0, 1000), i) for i in range(300)]
    left = [(rnd.choice("ab"), rnd.randint(-50, 1100), 1000 + i) for i in range(200)]
    R = spark.createDataFrame(right, "k string, t long, id long")
    L = spark.createDataFrame(left, "k string, x long, lid long")
    back = sequence_asof(L, R, ["k"], F.col("x"), F.col("t"), "id", ["id", "t"])
    got = {r.lid: (r._asof.id if r._asof else None) for r in back.collect()}
    for k, x, lid in left:
        cands = [(t, i) for kk, t, i in right if kk == k and t <= x]
        assert got[lid] == (max(cands)[1] if cands else None)
    R2 = R.withColumn("nid", -F.col("id"))
    fwd = sequence_asof(L, R2, ["k"], -F.col("x"), -F.col("t"), "nid", ["id", "t"])
    got = {r.lid: (r._asof.id if r._asof else None) for r in fwd.collect()}
    for k, x, lid in left:
        cands = [(t, i) for kk, t, i in right if kk == k and t >= x]
        assert got[lid] == (min(cands)[1] if cands else None)


def test_cooldown_equals_brute_force(spark):
    import datetime as dt
    from gustframe.operators.monitor import apply_cooldown
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for h in ("h1", "h2"):
        for i in range(400):
            rows.append(("r", h, len(rows), t0 + dt.timedelta(minutes=rnd.randint(0, 3000)), 30, rnd.random() < 0.6))
    df = spark.createDataFrame(rows, "rule_name string, host string, event_id long, metric_ts timestamp_ntz, "
                                     "cooldown_minutes int, sustained boolean")
    a = apply_cooldown(df)
    # brute force greedy
    want = set()
    for h in ("h1", "h2"):
        cands = sorted((r[3], r[2]) for r in rows if r[1] == h and r[5])
        last = None
        for t, _ in cands:
            if last is None or t >= last + dt.timedelta(minutes=30):
                last = t
                want.add((h, t))
    got = {(r.host, r.fired_ts) for r in a.collect()}
    assert got == want


def test_hot_key_and_equal_timestamps(spark):
    """One key holding most rows, many rows sharing one timestamp: positions and lag stay
    exact, and the global index spreads the hot timestamp over several range partitions."""
    from gustframe.operators.sequence import global_index
    rows = [("hot", 100, i) for i in range(600)] + [("hot", t, 1000 + t) for t in range(50)] + \
           [("cold", t, 5000 + t) for t in range(40)]
    df = spark.createDataFrame(rows, "k string, t int, id int")
    w = Window.partitionBy("k").orderBy("t", "id")
    ref = df.select("k", "id", F.row_number().over(w).alias("rn"), F.lag("id").over(w).alias("pid"))
    got = sequence_index(df, ["k"], ["t", "id"], index_col="rn2")
    got = sequence_lag(got, ["k"], ["t", "id"], ["id"])
    j = ref.join(got, ["k", "id"])
    assert j.where((F.col("rn") != F.col("rn2")) | ~F.col("pid").eqNullSafe(F.col("prev_id"))).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")      # many batches in a range
    try:
        got = sequence_index(df, ["k"], ["t", "id"], index_col="rn2")
        got = sequence_lag(got, ["k"], ["t", "id"], ["id"])
        from gustframe.operators.sequence import sequence_streak
        got = sequence_streak(got.withColumn("f", F.col("id") % 9 != 4), ["k"], ["t", "id"], "f")
        miss = F.max(F.when(F.col("id") % 9 == 4, F.col("rn2"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
        got = got.withColumn("run", F.col("rn2") - F.coalesce(miss, F.lit(0)))
        j = ref.join(got, ["k", "id"])
        bad = (F.col("rn") != F.col("rn2")) | ~F.col("pid").eqNullSafe(F.col("prev_id")) | (F.col("run") != F.col("streak"))
        assert j.count() == 690 and j.where(bad).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    g = global_index(df, ["t", "id"], index_col="pos")
    gref = df.select("id", F.row_number().over(Window.orderBy("t", "id")).alias("want"))
    assert g.join(gref, "id").where(F.col("pos") != F.col("want")).count() == 0
    parts = df.repartitionByRange(8, "t", "id").where(F.col("t") == 100) \
        .select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
