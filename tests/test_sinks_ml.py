"""Sinks, listings, random split and the pattern index."""

import datetime as dt
import os
import time

import numpy as np
from pyspark.sql import functions as F

from gustframe.operators import training as TR
from gustframe.plans import common as X
from gustframe.sources import sinks as SK
from gustframe.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_normalized_sink_partitions_and_rerun(spark, tmp_path):
    obs = X.obs(spark, SF)
    base = str(tmp_path / "normalized")
    SK.write_normalized(obs, base)
    SK.write_normalized(obs, base)            # rerun replaces the same partitions
    back = SK.read_normalized(spark, base)
    assert back.count() == obs.count()
    assert set(back.columns) >= {"source", "station_id", "obs_date"}
    one = back.where((F.col("station_id") == "103") & (F.col("source") == "asos"))
    assert one.count() == obs.where(F.col("station_id") == "103").count()


def test_quality_reports_and_recent_scan(spark, tmp_path):
    from gustframe.operators.quality import dq_checks, dq_summary
    rep = dq_summary(dq_checks(T.observations(spark, SF)))
    base = str(tmp_path / "reports")
    SK.write_quality_reports(rep, base)
    now = dt.datetime.now(dt.timezone.utc) + dt.timedelta(minutes=1)
    recent = lambda as_of, n: SK.recent_quality_reports(spark, base, as_of, n, score="quality_score", rows="total_checks").first()
    files = spark.read.json(base).select(F.col("_metadata.file_path")).distinct().count()
    checks = rep.agg(F.sum("total_checks")).first()[0]
    r = recent(now, files)
    assert r["rows"] == checks and 0 <= r["avg_quality"] <= 100
    assert 0 < recent(now, 3)["rows"] < checks
    late = recent(now + dt.timedelta(hours=25), files)                # all reports are older than a day
    assert late["rows"] == 0 and late["avg_quality"] is None


def test_latest_file_listing(spark, tmp_path):
    for i, name in enumerate(["a.bin", "b.bin", "c.bin"]):
        p = tmp_path / "models" / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
        os.utime(p, (1_700_000_000 + i * 100, 1_700_000_000 + i * 100))
    r = SK.latest_file(spark, str(tmp_path / "models")).first()
    assert r["path"].endswith("c.bin")


def test_serving_snapshot_freshness(spark):
    p = T.predictions(spark, SF)
    as_of = T.max_value(p, "eval_ts")
    snap = SK.latest_per_key(p, ["model_name"], "eval_ts", as_of, ttl_seconds=3600)
    assert snap.count() <= 5
    assert snap.where(F.col("eval_ts") > F.lit(as_of)).count() == 0


def test_random_split_is_a_partition_and_stable(spark):
    ft = T.predictions(spark, SF)
    split = TR.random_split(ft, "event_id")
    n, test = ft.count(), split.where("is_test").count()
    assert 0.15 * n < test < 0.25 * n and split.where("is_test is null").count() == 0
    again = TR.random_split(ft.repartition(7), "event_id").where("is_test")
    assert again.join(split.where("is_test"), "event_id", "left_anti").count() == 0 and again.count() == test


def test_pattern_index_centered(spark):
    from gustframe.operators.pattern import pattern_index
    pi = pattern_index(X.frames(spark, SF)).toPandas()
    assert len(pi) == X.frame_table(spark, SF).count()
    assert np.isfinite(pi["pattern_index"]).all()


def test_append_sinks_and_pipeline_report(spark, tmp_path):
    from gustframe.operators.pipeline import run_report, run_steps
    from gustframe.operators.scores import alternate_penalties
    p = T.predictions(spark, SF)
    base = str(tmp_path / "preds")
    SK.append_rows(p, base, partition_by=("model_name",))
    SK.append_rows(p, base, partition_by=("model_name",))
    assert spark.read.parquet(base).count() == 2 * p.count()
    ft = X.frame_table(spark, SF)
    out = run_steps(ft, [("alt", alternate_penalties, ["predicted_comfort_score"])])
    rep = run_report(out, ["predicted_comfort_score", "humidity_avg_3h"]).first()
    assert rep["rows"] == ft.count() and not rep["empty_input"]
    import pytest
    with pytest.raises(ValueError):
        run_steps(ft, [("bad", lambda d: d, ["not_there"])])


def test_station_wall_clock(spark):
    from gustframe.functions.timefn import station_wall_clock
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0),)], "t timestamp")
    r = df.select(station_wall_clock("t").alias("w")).first()["w"]
    assert r == dt.datetime(2024, 1, 1, 9, 0)


def test_two_loads_of_one_day_keep_all_rows(spark, tmp_path):
    obs = T.observations(spark, "/root/testdata/sf0.001")
    base = str(tmp_path / "loads")
    morning, rest = obs.where(F.hour("obs_ts") < 12), obs.where(F.hour("obs_ts") >= 12)
    SK.write_normalized(morning, base, load_id="am")
    SK.write_normalized(rest, base, load_id="pm")
    SK.write_normalized(rest, base, load_id="pm")            # the same load again replaces itself only
    assert SK.read_normalized(spark, base).count() == obs.count()


def test_overlapping_loads_give_each_hour_from_the_newest(spark, tmp_path):
    obs = T.observations(spark, SF).select("station_id", "obs_ts", "event_id", F.lit("first").alias("v"))
    base = str(tmp_path / "overlap")
    again = obs.where((F.hour("obs_ts") >= 6) & (F.col("station_id") != "103")).withColumn("v", F.lit("second"))
    SK.write_normalized(obs, base, load_id="a")
    SK.write_normalized(again, base, load_id="b")
    want = {r.event_id: "second" if r.obs_ts.hour >= 6 and r.station_id != "103" else "first" for r in obs.collect()}
    got = [(r.event_id, r.v) for r in SK.read_normalized(spark, base).collect()]
    assert len(got) == len(want) and dict(got) == want
    SK.write_normalized(obs.where("station_id = '104'").withColumn("v", F.lit("third")), base, load_id="b")    # replaces b
    got = dict((r.event_id, r.v) for r in SK.read_normalized(spark, base).collect())
    assert got == {r.event_id: "third" if r.station_id == "104" else "first" for r in obs.collect()}


def test_a_load_without_its_record_is_not_seen(spark, tmp_path):
    import shutil
    obs = T.observations(spark, SF).select("station_id", "obs_ts", "event_id")
    base = tmp_path / "half"
    SK.write_normalized(obs, str(base), load_id="a")
    record = next((base / "_commits").iterdir())
    SK.write_normalized(obs.limit(10), str(base), load_id="a")              # its record is lost: it ended before the commit
    late = next(p for p in (base / "_commits").iterdir() if p != record)
    shutil.rmtree(late)
    assert SK.read_normalized(spark, str(base)).count() == obs.count()
    SK.write_normalized(obs.limit(0), str(base), load_id="a")               # a load without rows replaces the one before
    assert SK.read_normalized(spark, str(base)).count() == 0


def test_ridge_has_the_closed_form_of_population_scaling(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    x = rng.normal(3, 2, 30)
    y = 1.5 * x + rng.normal(0, 1, 30)
    df = spark.createDataFrame([(float(a), float(b), i % 5 == 0) for i, (a, b) in enumerate(zip(x, y))],
                               "x double, y double, is_test boolean")
    metrics, _ = TR.compare_models(spark, df, ["x"], "y", families=("ridge",))
    train, test = np.arange(30) % 5 != 0, np.arange(30) % 5 == 0
    z = (x - x[train].mean()) / x[train].std()
    w = (z[train] * (y[train] - y[train].mean())).sum() / ((z[train] ** 2).sum() + 1.0)
    rmse = np.sqrt((((y[train].mean() + w * z[test]) - y[test]) ** 2).mean())
    assert abs(metrics.first().rmse - rmse) < 1e-6
    cv = TR.cross_validate(df.withColumn("fold", F.col("is_test").cast("int")), ["x"], "y")
    assert cv["folds"] == 2 and cv["cv_rmse_mean"] > 0


def test_snapshot_ties_go_to_the_greatest_id(spark):
    t = dt.datetime(2024, 1, 1, 12)
    p = spark.createDataFrame([("a", t, i, float(i)) for i in (3, 9, 5)], "m string, t timestamp_ntz, event_id long, v double")
    assert SK.latest_per_key(p, ["m"], "t", t, tie=("event_id",)).first().event_id == 9


def test_text_measures_and_empty_input(spark):
    from gustframe.operators.quality import dq_checks, dq_structure
    rows = [("s", dt.datetime(2024, 1, 1, h), v, 1.0, 0.0, 50.0, h) for h, v in enumerate(["1.5", "wet", None, "2"])]
    obs = spark.createDataFrame(rows, "station_id string, obs_ts timestamp_ntz, temperature_c string, wind_speed_ms double,"
                                      " precipitation_mm double, relative_humidity double, event_id long")
    got = {r["name"]: r for r in dq_checks(obs).collect()}
    assert got["temperature_c_numeric"].issue_count == 1 and got["temperature_c_numeric"].severity == "warning"
    assert got["wind_speed_ms_numeric"].passed and got["missing_temperature_c"].issue_count == 2
    empty = dq_structure(obs.limit(0)).first()
    assert empty.severity == "critical" and not empty.passed and dq_structure(obs).first().passed


def test_silent_host_and_short_history_stay(spark):
    from gustframe.operators import evaluate as EV
    from gustframe.operators import monitor as MO
    as_of = dt.datetime(2024, 1, 2)
    m = spark.createDataFrame([("up", dt.datetime(2024, 1, 1, 23, 30), 0, 4), ("gone", dt.datetime(2024, 1, 1, 3), 1, 1)],
                              "host string, metric_ts timestamp_ntz, error_count int, prediction_count int")
    fired = spark.createDataFrame([("up", dt.datetime(2023, 12, 1))], "host string, fired_ts timestamp_ntz")
    got = {r.host: r for r in MO.monitoring_report(m, fired, as_of).collect()}
    assert got["gone"].silent and got["gone"].status == "warning"
    assert got["up"].n_firings == 0 and got["up"].status == "healthy" and not got["up"].silent
    day = lambda i: dt.datetime(2024, 1, 1 + i)
    h = spark.createDataFrame([("old", day(i), 0.5, 1.0, 2.0) for i in range(8)] + [("new", day(8), 0.4, 1.0, 3.0)],
                              "model_name string, eval_day timestamp_ntz, r2 double, mae double, rmse double")
    got = {r.model_name: r for r in EV.baseline_comparison(h).collect()}
    assert got["old"].status == "compared" and got["old"].r2_change_pct == 0
    assert got["new"].status == "insufficient_baseline_data" and got["new"].base_r2 is None
    alone = EV.degradation_vs_production(h, "old").where("model_name = 'new'").first()
    assert alone.degradation is None and not alone.degraded


def test_feature_loads_metric_and_log_rows(spark, tmp_path):
    ft = X.frame_table(spark, SF).select("station_id", "window_start", "baseline_comfort_score")
    base, n = str(tmp_path / "features"), ft.count()
    early = F.dayofmonth("window_start") <= 15
    SK.write_features(ft.where(early), base, "comfort", "v1", load_id="a")
    SK.write_features(ft.where(~early), base, "comfort", "v1", load_id="b")
    SK.write_features(ft.where(~early), base, "comfort", "v1", load_id="b")
    assert SK.read_features(spark, base, "comfort", "v1").count() == n
    assert SK.read_features(spark, base, "comfort", "v2").count() == 0
    logs = spark.createDataFrame([("ERROR", "m1"), ("INFO", "m2")], "level string, module string")
    for name, rows, by in (("metrics", ft, ()), ("logs", logs, ("level",))):
        SK.append_rows(rows, str(tmp_path / name), partition_by=by)
        SK.append_rows(rows, str(tmp_path / name), partition_by=by)
        assert spark.read.parquet(str(tmp_path / name)).count() == 2 * rows.count()
    some = ft.withColumn("target", F.when(F.col("station_id") == "103", F.lit(None)).otherwise(1.0))
    assert TR.prepare(some, "target").count() == ft.where("station_id <> '103'").count()
