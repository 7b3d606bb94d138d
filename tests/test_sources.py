"""Raw text, JSON and sink round trips on small files written to a temp folder."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from gustframe.operators.scores import frame_features
from gustframe.sources.json_source import read_observations_json
from gustframe.sources.text import parse_header_text, parse_positional_text, read_raw_lines, skipped_files

SAMPLE = ("# three hours of one harbour station\n"
          "stn stnNm tm ta hm ws wd rn\n"
          "431 Quay 202402171300 21.5 44 1.9 75 0.0\n"
          "431 Quay 202402171400 22.75 41 2.4 90 0.0\n"
          "431 Quay 202402171500 22.0 46 2.1 105 0.4\n")

COMMENT = (
    "# YYMMDDHHMI STN  WD   WS GST  GST  GST     PA     PS PT    PR    TA    TD    HM    PV     RN     RN     RN     RN\n"
    "#        KST  ID  16  m/s  WD   WS   TM    hPa    hPa  -   hPa     C     C     %   hPa     mm    DAY    JUN    INT\n"
    "202403120600 431   9  2.3  -9 -9.0   -9  987.6 1003.1 -9  -9.0   7.4   3.1  74.0   7.6   -9.0   12.5   12.5   -9.0\n")


def _land(root, station, ts, text):
    d = os.path.join(root, "raw_data", "asos", station, ts.strftime("%Y"), ts.strftime("%m"), ts.strftime("%d"))
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, ts.strftime("%H%M") + ".txt"), "w") as fh:
        fh.write(text)


def test_plain_header_parse_and_score(spark, tmp_path):
    _land(str(tmp_path), "431", dt.datetime(2024, 2, 17, 15, 0), SAMPLE)
    lines = read_raw_lines(spark, str(tmp_path / "raw_data"))
    obs = parse_header_text(lines).orderBy("obs_ts").collect()
    assert [o.temperature_c for o in obs] == [21.5, 22.75, 22.0]
    assert obs[-1].precipitation_mm == 0.4 and obs[-1].precipitation_type == "rain"
    assert obs[0].station_id == "431"
    df = parse_header_text(lines).withColumn("window_start", F.lit(dt.datetime(2024, 2, 17, 12)))
    r = frame_features(df, keys=("station_id", "window_start")).first()
    assert abs(r.baseline_comfort_score - 96.0) < 1e-9          # 100 less 10 points a millimetre of rain; nothing else counts


def test_comment_header_duplicate_rn(spark, tmp_path):
    _land(str(tmp_path), "431", dt.datetime(2024, 3, 12, 6, 0), COMMENT)
    obs = parse_header_text(read_raw_lines(spark, str(tmp_path / "raw_data"))).collect()
    assert len(obs) == 1
    o = obs[0]
    assert o.temperature_c == 7.4 and o.relative_humidity == 74.0 and o.wind_speed_ms == 2.3
    # the first RN column wins; -9.0 is above the -900 sentinel, so it is kept, and a
    # negative amount becomes 0 (the reference's parser test expects exactly this)
    assert o.precipitation_mm == 0.0 and o.precipitation_type == "none"


def test_fallback_header_and_bad_lines(spark, tmp_path):
    text = "108 Seoul 202301010800 1.5 60 2.0 100 1.0\n\nbadline\n108 Seoul 2023XX010900 1 2 3 4 5\n"
    _land(str(tmp_path), "108", dt.datetime(2023, 1, 1, 8, 0), text)
    obs = parse_header_text(read_raw_lines(spark, str(tmp_path / "raw_data"))).collect()
    assert len(obs) == 1 and obs[0].precipitation_type == "snow"


def test_positional_parse(spark, tmp_path):
    _land(str(tmp_path), "431", dt.datetime(2024, 3, 12, 6, 0), COMMENT)
    lines = read_raw_lines(spark, str(tmp_path / "raw_data"))
    o15 = parse_positional_text(lines).collect()[0]
    o14 = parse_positional_text(lines, rain_index=14).collect()[0]
    assert o15.temperature_c == 7.4 and o15.relative_humidity == 74.0
    assert o15.precipitation_mm == 0.0          # index 15 is RN = -9.0 -> missing -> 0
    assert o14.precipitation_mm == 7.6         # index 14 (PV) in the older reading


def test_json_observations(spark, tmp_path):
    payload = {"observations": [
        {"timestamp": "2024-01-01T08:00:00", "temperature_c": 3.0, "wind_speed_ms": 1.0,
         "precipitation_mm": 0.0, "relative_humidity": 70, "condition_code": "clear"},
        {"timestamp": "2024-01-01T09:00:00", "temperature_c": 4.0, "wind_speed_ms": 2.0}]}
    p = tmp_path / "obs.json"
    p.write_text(json.dumps(payload))
    rows = read_observations_json(spark, str(p)).orderBy("obs_ts").collect()
    assert len(rows) == 2
    assert rows[1].precipitation_mm == 0.0 and rows[1].precipitation_type == "none"


def test_sink_dynamic_overwrite_is_idempotent(spark, tmp_path):
    from gustframe.plans import common as X
    from gustframe.sources.sinks import read_features, write_features
    ft = X.frame_table(spark, "/root/testdata/sf0.001")
    base = str(tmp_path / "features")
    write_features(ft, base, "comfort", "v1")
    write_features(ft, base, "comfort", "v1")
    back = read_features(spark, base, "comfort", "v1")
    assert back.count() == ft.count()


def test_hand_fixtures_through_the_pipeline(spark, tmp_path):
    """Blank/short lines, bad timestamps, duplicate minutes in two files, T exactly 0.0
    and 2.0, humidity 0, all-NULL humidity, one-row frame."""
    from gustframe.functions.features_row import with_row_features
    from gustframe.operators.clean import dedup_first_per_minute
    from gustframe.operators.frames import tumbling
    hdr = "# STN YYMMDDHHMI TA HM WS RN\n"
    a = hdr + "\n108 202401010800 0.0 0 1.0 1.0\n108 202401010810 2.0 -9.0 1.0 2.0\nshort\n108 2024XX010900 1 1 1 1\n"
    b = hdr + "108 202401010810 5.0 50 1.0 0.0\n108 202401011500 20.0 -9.0 2.0 0.0\n"
    _land(str(tmp_path), "108", dt.datetime(2024, 1, 1, 8, 0), a)
    _land(str(tmp_path), "108", dt.datetime(2024, 1, 1, 9, 0), b)
    obs = parse_header_text(read_raw_lines(spark, str(tmp_path / "raw_data")))
    assert obs.count() == 4                                   # bad/short/blank lines skipped
    d = dedup_first_per_minute(obs, order=("obs_ts", "file_path", "line_no"))
    rows = {r.obs_ts.strftime("%H%M"): r for r in d.collect()}
    assert set(rows) == {"0800", "0810", "1500"}
    assert rows["0810"].temperature_c == 2.0                  # first file wins for the duplicate minute
    assert rows["0800"].precipitation_type == "snow" and rows["0810"].precipitation_type == "snow"
    assert rows["0810"].relative_humidity is None             # -9.0 -> NULL (negative humidity)
    feats = {r.obs_ts.strftime("%H%M"): r for r in with_row_features(d).collect()}
    assert feats["0800"].comfort_humidity_comfort == 1.0      # humidity 0 -> default 50 (CND1)
    assert feats["0800"].feature_quality_score < 1.0          # 0.0 degC is suspicious
    frames = frame_features(tumbling(d)).collect()
    one = [f for f in frames if f.n_obs == 1][0]              # the 15:00 frame holds one row
    assert one.humidity_avg_3h is None and one.penalty_humidity == 0.0


def test_ingest_and_training_flows(spark, tmp_path):
    from gustframe.plans.flows import ingest_flow, training_flow
    from gustframe.sources import tables as T
    from gustframe.sources.text import lines_from_observations
    # land a day of rendered observations as text files, one per station-day
    obs = T.observations(spark, "/root/testdata/sf0.01").where(F.to_date("obs_ts") <= F.lit("2024-01-10"))
    lines = lines_from_observations(obs).orderBy("file_path", "line_no").collect()
    files = {}
    for r in lines:
        files.setdefault(r.file_path, []).append(r.value)
    for path, vals in files.items():
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text("\n".join(vals) + "\n")
    res = ingest_flow(spark, str(tmp_path / "raw_data"), str(tmp_path / "out"))
    n = res.features.count()
    assert n > 0 and res.summary.count() == 10
    back = spark.read.parquet(str(tmp_path / "out" / "features"))
    assert back.count() == n
    feats = res.features.where(F.col("n_obs") >= 3)
    metrics, best = training_flow(spark, feats, ["temp_median_3h", "wind_peak_3h", "precip_total_3h",
                                                 "humidity_avg_3h", "temp_range_3h"],
                                  model_path=str(tmp_path / "model"), families=("linear", "ridge"))
    rows = metrics.collect()
    passed = [(r.rmse, r.model_name) for r in rows if r.passed]
    assert len(rows) == 2 and best == (min(passed)[1] if passed else None)


def test_station_and_day_prefix(spark, tmp_path):
    for station in ("431", "108"):
        for day in (16, 17):
            _land(str(tmp_path), station, dt.datetime(2024, 2, day, 15, 0), SAMPLE)
    root = str(tmp_path / "raw_data")
    one = read_raw_lines(spark, root, stations=["431"], days=[dt.date(2024, 2, 17)])
    assert len(one.inputFiles()) == 1 and {r.path_station for r in one.collect()} == {"431"}
    assert len(read_raw_lines(spark, root, days=[dt.date(2024, 2, 17)]).inputFiles()) == 2
    assert len(read_raw_lines(spark, root, stations=["431", "108"]).inputFiles()) == 4
    none = read_raw_lines(spark, root, stations=["999"], days=[dt.date(2024, 2, 17)])
    assert none.columns == one.columns and none.count() == 0
    assert skipped_files(spark, one, root, stations=["431"], days=[dt.date(2024, 2, 17)]).count() == 0
    assert skipped_files(spark, one, root).count() == 3


def _land_file(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


LANDED = {
    "asos/108/2024/01/02/0300.txt": "#START\n# YYMMDDHHMI STN TA HM WS RN RN\n202401020300 108 3.5 40 2.0 0.5 0.7\n\n202401020400 108 -9 41 -9.0 - 1\n",
    "asos/109/2024/01/02/0300.txt": "tm stn ta ws rn hm\r\n202401020300 109 1.0 2.5 0.0 50\r\n",
    "asos/110/2024/01/02/0300.txt": "110 name 202401020300 7.0 60 1.5 90 0.2 8\n",
    "asos/111/2024/01/02/0300.txt": "# nothing here\n\n",
    "asos/112/2024/01/02/0300.txt": "",
}


def test_whole_files_parse_as_their_lines(spark, tmp_path):
    from gustframe.sources.text import parse_files, parse_header_text, read_raw_files, read_raw_lines
    for name, text in LANDED.items():
        _land_file(tmp_path, name, text)
    files = parse_files(read_raw_files(spark, str(tmp_path)))
    lines = parse_header_text(read_raw_lines(spark, str(tmp_path)))
    assert files.columns == lines.columns
    assert sorted(map(str, files.collect())) == sorted(map(str, lines.collect())) and files.count() == 4
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_stream_of_landed_files_equals_batch(spark, tmp_path):
    from gustframe.sources.text import parse_files, read_raw_files, stream_raw_files
    from gustframe.streaming.jobs import run_available_now
    for name, text in LANDED.items():
        _land_file(tmp_path / "in", name, text)
    run_available_now(parse_files(stream_raw_files(spark, str(tmp_path / "in"), max_files_per_trigger=2)), str(tmp_path / "ckpt"),
                      query_name="stm1_text")
    want = parse_files(read_raw_files(spark, str(tmp_path / "in")))
    assert sorted(map(str, spark.table("stm1_text").collect())) == sorted(map(str, want.collect()))


def test_files_read_in_ranges_equal_whole_files(spark, tmp_path):
    """Headers hold for all ranges of a file; the first header counts, a data line as header is skipped once."""
    from gustframe.sources.text import parse_files, parse_header_text, read_raw_files, read_split_lines
    rows = "".join(f"431 20240217{h:02d}{m:02d} {h}.5 44 1.9 0.{m % 10}\r\n" for h in range(24) for m in range(60))
    _land(str(tmp_path), "431", dt.datetime(2024, 2, 17, 0, 0), "\n# STN YYMMDDHHMI TA HM WS RN\n" + rows + "# STN YYMMDDHHMI HM TA WS RN\n" + rows)
    _land(str(tmp_path), "432", dt.datetime(2024, 2, 17, 0, 0), "stn tm ta hm ws rn\n" + rows + "stn tm ta hm ws rn\n")
    _land(str(tmp_path), "433", dt.datetime(2024, 2, 17, 0, 0), COMMENT)
    key = "spark.sql.files.maxPartitionBytes"
    size = spark.conf.get(key)
    spark.conf.set(key, "20000b")
    try:
        lines = read_split_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        got = parse_header_text(lines).drop("line_no")
        assert sorted(map(str, got.collect())) == sorted(map(str, parse_files(read_raw_files(spark, str(tmp_path))).drop("line_no").collect()))
    finally:
        spark.conf.set(key, size)


def test_landed_query_holds_no_whole_file(spark):
    """SRC1_2: a month's file grows with the table, so no row holds its text or its lines."""
    from gustframe.plans import catalog
    plan = catalog.queries()["SRC1_2_landed_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "text" in plan and "Generate" not in plan
