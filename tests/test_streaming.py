"""Streaming runs (availableNow) give the batch result."""

import datetime as dt
import time

from pyspark.sql import functions as F

from gustframe.plans import common as X
from gustframe.sources import tables as T
from gustframe.streaming.jobs import landing_stream, run_available_now, stream_dedup_minute, stream_frame_features

SF = "/root/testdata/sf0.001"


def test_stream_frames_equal_batch(spark, tmp_path):
    obs = T.observations(spark, SF)
    land = str(tmp_path / "landing")
    obs.repartition(4, "station_id").write.parquet(land)
    s = landing_stream(spark, land, obs.schema, max_files_per_trigger=2)
    run_available_now(stream_frame_features(s), str(tmp_path / "ckpt"), query_name="stm2_frames")
    got = spark.table("stm2_frames").select("station_id", "window_start", "n_obs", "baseline_comfort_score")
    # with availableNow the watermark closes every window except those within the last hour
    want = X.frame_table(spark, SF).select("station_id", "window_start", "n_obs", "baseline_comfort_score")
    assert got.subtract(want).count() == 0
    assert got.count() >= want.count() - 10


def _land_shuffled(df, path, files, seed):
    """Land ``df`` in ``files`` files with its rows in any order."""
    order = df.withColumn("_f", F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(files)))
    for i in range(files):
        order.where(F.col("_f") == i).drop("_f").orderBy(F.rand(seed)).coalesce(1).write.mode("append").parquet(path)


def _days_shuffled(df, path, ts, days_per_file=2):
    """Files of a few days, rows in any order inside: out of order within the watermark, in order beyond it."""
    first = df.agg(F.min(F.to_date(ts))).first()[0]
    d = df.withColumn("_f", F.floor(F.datediff(F.to_date(ts), F.lit(first)) / days_per_file))
    for (i,) in d.select("_f").distinct().orderBy("_f").collect():
        d.where(F.col("_f") == i).drop("_f").orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(path)


def test_stream_dedup_keeps_the_rows_of_the_batch(spark, tmp_path):
    from gustframe.operators.clean import dedup_first_per_minute
    obs = T.observations(spark, SF)
    twice = obs.unionByName(obs.withColumns({"event_id": F.col("event_id") + 1_000_000,
                                             "obs_ts": F.date_trunc("minute", "obs_ts").cast("timestamp_ntz"),
                                             "temperature_c": F.col("temperature_c") + 1}))
    land = str(tmp_path / "landing2")
    _land_shuffled(twice, land, 3, 8)
    end = twice.limit(1).withColumns({"station_id": F.lit("end"), "obs_ts": F.lit("2199-01-01").cast("timestamp_ntz")})
    end.select(*twice.columns).coalesce(1).write.mode("append").parquet(land)             # closes every minute
    s = landing_stream(spark, land, twice.schema, max_files_per_trigger=1)
    run_available_now(stream_dedup_minute(s, watermark="900 days"), str(tmp_path / "ckpt2"), query_name="stm4_dedup")
    want = dedup_first_per_minute(twice).select("station_id", "event_id", "obs_ts", "temperature_c")
    got = spark.table("stm4_dedup").select("station_id", "event_id", "obs_ts", "temperature_c")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _write_by_day(df, path, ts):
    """Land one file set per day, oldest first (arrival order = time order)."""
    days = [r[0] for r in df.select(F.to_date(ts)).distinct().orderBy(1).collect()]
    for i, d in enumerate(days):
        df.where(F.to_date(ts) == F.lit(d)).coalesce(1).write.mode("append").parquet(path)


def _rule_rows(spark, metrics):
    from gustframe.operators import monitor as MO
    rules = MO.alert_rules(spark)
    long = MO.unpivot_metrics(metrics, ["host", "metric_ts", "event_id"]).join(F.broadcast(rules), "metric")
    return rules, long.withColumn("breach", F.coalesce(MO.rule_predicate(F.col("value"), F.col("operator"), F.col("threshold")), F.lit(False)))


def test_stream_alerts_of_shuffled_files_equal_batch(spark, tmp_path):
    from gustframe.operators import monitor as MO
    from gustframe.streaming.state import stream_alerts
    m = T.system_metrics(spark, SF)
    rules, long = _rule_rows(spark, m)
    land = str(tmp_path / "rules_landing")
    _days_shuffled(long, land, "metric_ts", 20)
    s = landing_stream(spark, land, long.schema, max_files_per_trigger=1)
    run_available_now(stream_alerts(s, "1 hour", idle_ms=400 * 86_400_000), str(tmp_path / "ckpt_alerts"), query_name="stm6_alerts")
    got, newest = spark.table("stm6_alerts"), m.agg(F.max("metric_ts")).first()[0]
    want = MO.apply_cooldown(MO.evaluate_rules(m, rules))
    closed = want.where(F.col("fired_ts") < F.lit(newest - dt.timedelta(hours=1, seconds=1)))
    assert got.exceptAll(want).count() == 0 and closed.exceptAll(got).count() == 0 and closed.count() > 20


def _samples(spark, rows):
    d = spark.createDataFrame([("r", h, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), b) for i, (h, m, b) in enumerate(rows)],
                              "rule_name string, host string, event_id long, metric_ts timestamp_ntz, breach boolean")
    return d.withColumns({"duration_samples": F.lit(2), "cooldown_minutes": F.lit(10)})


def test_stream_alerts_over_late_files_and_silent_keys(spark, tmp_path):
    """Three files whose times overlap; host b stays silent for long and is forgotten, with its streak."""
    from gustframe.streaming.state import stream_alerts
    files = [[("a", 5, True), ("a", 1, True), ("b", 2, True)],
             [("a", 3, False), ("a", 4, True), ("a", 20, True)],
             [("a", 19, True), ("a", 18, False), ("a", 900, False)],
             [("b", 905, True), ("a", 3000, False)], [("b", 3001, True), ("a", 6000, False)]]
    land, schema = str(tmp_path / "late"), None
    for i, rows in enumerate(files):
        df = _samples(spark, rows)
        schema = df.schema
        df.coalesce(1).write.mode("append").parquet(land)
        time.sleep(0.05)
    s = landing_stream(spark, land, schema, max_files_per_trigger=1)
    run_available_now(stream_alerts(s, "30 minutes", idle_ms=600 * 60_000), str(tmp_path / "ckpt_late"), query_name="stm6_late")
    base = dt.datetime(2024, 1, 1)
    got = sorted((r.host, (r.fired_ts - base).seconds // 60) for r in spark.table("stm6_late").collect())
    # a: minutes 1 T, 3 F, 4 T, 5 T (fires), 18 F, 19 T, 20 T (fires); b: 2 T, forgotten, 905 T, forgotten, 3001 T
    assert got == [("a", 5), ("a", 20)]


def test_stream_history_trends(spark, tmp_path):
    from gustframe.operators.windows import first_last_change, last_n
    from gustframe.streaming.state import stream_history_trends
    obs = T.observations(spark, SF)
    land = str(tmp_path / "hist_landing")
    _days_shuffled(obs, land, "obs_ts", 20)
    s = landing_stream(spark, land, obs.schema, max_files_per_trigger=1)
    run_available_now(stream_history_trends(s), str(tmp_path / "ckpt_hist"), output_mode="update",
                      query_name="stm7_hist")
    got = spark.table("stm7_hist")
    # the last emitted row per station reflects the whole history
    final = got.groupBy("station_id").agg(F.last("change_pct").alias("c"), F.last("n_rows").alias("n"))
    want = first_last_change(last_n(obs, ["station_id"], ["obs_ts", "event_id"], 24),
                             ["station_id"], ["temperature_c"])
    j = final.join(want, "station_id").collect()
    assert len(j) == want.count()
    for r in j:
        assert r.n == r.n_rows
        assert abs(r.c - r.temperature_c_change_pct) < 1e-6


def test_retraining_trigger_and_idempotent_sink(spark, tmp_path):
    from gustframe.plans.catalog_windows import training_sets
    from gustframe.streaming.jobs import idempotent_sink, retraining_trigger_sink
    sets = training_sets(spark, "/root/testdata/sf0.01")
    land = str(tmp_path / "sets_landing")
    _write_by_day(sets, land, "window_start")
    trig = str(tmp_path / "triggers")
    s = landing_stream(spark, land, sets.schema, max_files_per_trigger=3)
    run_available_now(s, str(tmp_path / "ckpt_trig"), sink=retraining_trigger_sink(trig, min_new=50, min_quality=0.8))
    t = spark.read.parquet(trig)
    assert t.count() > 0
    assert t.groupBy("trigger_date").count().where("count > 3").count() == 0
    # STM9: replaying the same batches into the idempotent sink leaves one copy
    out = str(tmp_path / "sink")
    for ck in ("a", "b"):
        s2 = landing_stream(spark, land, sets.schema, max_files_per_trigger=100)
        run_available_now(s2, str(tmp_path / f"ckpt_{ck}"), sink=idempotent_sink(out))
    assert spark.read.parquet(out).count() == sets.count()


def test_stream_hourly_metrics_and_core_rows(spark, tmp_path):
    from gustframe.streaming.jobs import stream_hourly_metrics
    from gustframe.operators.rowquality import core_features
    m = T.system_metrics(spark, SF)
    land = str(tmp_path / "metrics_landing")
    m.write.parquet(land)
    s = landing_stream(spark, land, m.schema)
    run_available_now(stream_hourly_metrics(s, watermark="0 seconds"), str(tmp_path / "ckpt_m"),
                      query_name="stm3_hourly")
    got = spark.table("stm3_hourly")
    want = m.groupBy("host", F.date_trunc("hour", "metric_ts").cast("timestamp_ntz").alias("hour_start")).count()
    assert got.select("host", "hour_start", F.col("n_samples").alias("count")).subtract(want).count() == 0
    # STM5: stateless per-record quality on a stream equals the batch projection
    wide = T.observations_wide(spark, SF)
    land2 = str(tmp_path / "wide_landing")
    wide.write.parquet(land2)
    as_of = T.max_value(wide, "obs_ts")
    s2 = landing_stream(spark, land2, wide.schema)
    run_available_now(core_features(s2, as_of).drop("weather_conditions"), str(tmp_path / "ckpt_w"),
                      query_name="stm5_core")
    assert spark.table("stm5_core").subtract(core_features(wide, as_of).drop("weather_conditions")).count() == 0


def test_stream_sliding_frames_equal_batch(spark, tmp_path):
    from gustframe.operators.scores import frame_aggregates
    from gustframe.operators.frames import with_precipitation_type
    obs = T.observations(spark, SF)
    land = str(tmp_path / "landing_sliding")
    obs.write.parquet(land)
    s = landing_stream(spark, land, obs.schema)
    run_available_now(stream_frame_features(s, slide_hours=1), str(tmp_path / "ckpt_sl"), query_name="stm2_sliding")
    got = spark.table("stm2_sliding").select("station_id", "window_start", "n_obs", "baseline_comfort_score")
    w = F.window("obs_ts", "3 hours", "1 hour")
    want = (with_precipitation_type(obs).groupBy("station_id", w.alias("w")).agg(*frame_aggregates())
            .select("station_id", F.col("w.start").alias("window_start"), "n_obs"))
    assert got.select("station_id", "window_start", "n_obs").subtract(want).count() == 0
    assert got.count() >= want.count() - 30


def test_sinks_keep_every_epoch_and_replays_change_nothing(spark, tmp_path):
    from gustframe.streaming.jobs import idempotent_sink, retraining_trigger_sink
    obs = T.observations(spark, SF)
    sink = idempotent_sink(str(tmp_path / "epochs"))
    first, second = obs.where("event_id % 2 = 0"), obs.where("event_id % 2 = 1")
    for batch, epoch in ((first, 0), (second, 1), (second, 1)):
        sink(batch, epoch)
    assert spark.read.parquet(str(tmp_path / "epochs")).count() == obs.count()
    sets = obs.select(F.col("obs_ts").alias("window_start"), F.lit(0.9).alias("quality_score"))
    trigger = retraining_trigger_sink(str(tmp_path / "trig"))
    for epoch in (7, 7, 8):
        trigger(sets, epoch)
    assert spark.read.parquet(str(tmp_path / "trig")).count() == 2
