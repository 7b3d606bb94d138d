"""Spark ML model comparison on the frame table (rows/property checks)."""

import math

import numpy as np
from pyspark.sql import functions as F

from gustframe.operators import training as TR
from gustframe.operators.windows import time_split
from gustframe.plans.catalog_select import FEATURES, TARGET, _feature_table


def test_compare_models_and_persist(spark, tmp_path):
    ft = _feature_table(spark, "/root/testdata/sf0.01").where(F.col("n_obs") >= 3)
    ft = time_split(ft, ["window_start", "station_id"], n_splits=3)
    n = ft.count()
    assert ft.where("is_test").count() == n // 4
    metrics, fitted = TR.compare_models(spark, ft, list(FEATURES), TARGET,
                                        families=("linear", "ridge", "random_forest"))
    rows = {r.model_name: r for r in metrics.collect()}
    assert set(rows) == {"linear", "ridge", "random_forest"}
    for r in rows.values():
        assert math.isfinite(r.rmse) and r.rmse >= 0
    best = min(rows.values(), key=lambda r: r.rmse).model_name
    path = str(tmp_path / "model")
    TR.save_model(fitted[best], path)
    again = TR.load_model(path).transform(ft.limit(5)).select("prediction").count()
    assert again == 5


def _series(spark, noise):
    """60 hours of one station; ``noise(i)`` is added to a straight line."""
    rows = [(i, float(i % 12), 3.0 * (i % 12) + noise(i), i >= 48) for i in range(60)]
    return (spark.createDataFrame(rows, "i int, x double, y double, is_test boolean").coalesce(1)
            .withColumn("station_id", F.lit("s")).withColumn("window_start", F.timestamp_seconds(F.col("i") * 3600).cast("timestamp_ntz")))


def test_gate_rejects_a_model_that_varies_over_the_folds(spark):
    passed = {}
    for name, noise in (("even", lambda i: 0.5 * (-1) ** i), ("uneven", lambda i: 9.0 * (-1) ** i if i < 12 else 0.5 * (-1) ** i)):
        df = _series(spark, noise)
        metrics, _ = TR.compare_models(spark, df, ["x"], "y", families=("ridge",))
        assert TR.gate(metrics).first().passed
        row = TR.gate(TR.with_cross_validation(spark, metrics, df, ["x"], "y", ["window_start", "station_id"])).first()
        assert row.cv_rmse_mean > 0
        passed[name] = row.passed
    assert passed == {"even": True, "uneven": False}


def test_boosting_is_compared_and_cross_validated(spark):
    df = _series(spark, lambda i: 0.1 * (-1) ** i)
    metrics, fitted = TR.compare_models(spark, df, ["x"], "y", families=("gradient_boosting",))
    row = TR.with_cross_validation(spark, metrics, df, ["x"], "y", ["window_start", "station_id"], folds=2).first()
    assert set(fitted) == {"gradient_boosting"} and row.r2 > 0.9 and row.cv_rmse_mean < 1 and row.error is None


def test_folds_from_moments_equal_the_refits(spark):
    """RMSE of each fold from one table of moments, with missing values, a constant and a repeated feature."""
    rows = [(i, i % 4, None if i % 7 == 3 else float(i % 12), float("nan") if i % 5 == 1 else 1000.0 + (i * i) % 17, 3.0, float(2 * i % 9),
             None if i == 30 else 3.0 * (i % 12) + 0.2 * ((i * i) % 17) + (-1) ** i) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, fold int, a double, b double, same double, c double, y double").withColumn("twice", F.col("c") * 2)
    features = ["a", "b", "same", "c"]
    moments = TR.fold_moments(df, features, "y")
    d = df.where("y is not null").toPandas()
    for name, alpha in TR.LINEAR.items():
        got = TR.fold_errors(moments, alpha)
        for k in range(4):
            train, test = d[d.fold != k], d[d.fold == k]
            x, own = train[features].fillna(train[features].median()), test[features].fillna(train[features].median())
            scale = x.std(ddof=0).replace(0, 1)
            a, y = ((x - x.mean()) / scale).to_numpy(), train.y.to_numpy()
            w = np.linalg.pinv(a.T @ a + (alpha or 0) * np.eye(4)) @ (a.T @ (y - y.mean()))
            error = test.y - y.mean() - ((own - x.mean()) / scale).to_numpy() @ w
            assert math.isclose(got[k], (error ** 2).mean() ** 0.5, rel_tol=1e-11)
        refit = TR.cross_validate(df, features, "y", family=name)                # Spark's own solver, exact to about 1e-8
        assert all(math.isclose(v, refit[k], rel_tol=1e-6) for k, v in TR._spread(list(got.values())).items())
    twice = TR.fold_errors(TR.fold_moments(df, ["a", "b", "same", "c", "twice"], "y"))
    assert all(math.isclose(twice[k], e, rel_tol=1e-8) for k, e in TR.fold_errors(moments).items())
    assert TR.fold_errors(TR.fold_moments(df.where("fold = 0"), ["a"], "y")) == {}


def test_features_are_filled_with_medians_and_scaled_by_the_population(spark, tmp_path):
    from pyspark.ml import Pipeline
    x = [1.0, 2.0, None, 10.0, float("nan"), 4.0, 5.0]
    rows = [(i, a, 3.0, None if i % 2 else float(i * i), None) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, x double, same double, z double, none double")
    model = Pipeline(stages=TR.feature_pipeline(df, ["x", "same", "z", "none"])).fit(df)
    got = np.array([r.features_scaled.toArray() for r in model.transform(df).orderBy("i").collect()])
    filled = np.array([4.0 if a is None or a != a else a for a in x])
    z = np.array([10.0 if i % 2 else i * i for i in range(7)])           # the median of 0, 4, 16, 36
    want = np.stack([(filled - filled.mean()) / filled.std(), np.zeros(7), (z - z.mean()) / z.std(), np.zeros(7)], axis=1)
    assert np.abs(got - want).max() < 1e-12


def test_flow_takes_the_best_family_that_passes(spark, monkeypatch):
    from gustframe.plans import flows
    rows = [("broken", None, None, None, False), ("loose", 0.4, 0.1, 0.9, False), ("good", 1.0, 0.1, 0.2, True), ("worse", 2.0, 0.1, 0.2, True)]
    table = spark.createDataFrame(rows, "model_name string, rmse double, mae double, r2 double, passed boolean")
    saved = []
    monkeypatch.setattr(TR, "compare_models", lambda *a, **k: (table, {r[0]: r[0] for r in rows}))
    monkeypatch.setattr(TR, "with_cross_validation", lambda *a, **k: table)
    monkeypatch.setattr(TR, "gate", lambda m: m)
    monkeypatch.setattr(TR, "save_model", lambda m, path: saved.append(m))
    df = _series(spark, lambda i: 0.0)
    assert flows.training_flow(spark, df, ["x"], "y", "somewhere")[1] == "good" and saved == ["good"]
    table = table.where("not passed")
    assert flows.training_flow(spark, df, ["x"], "y", "somewhere")[1] is None and saved == ["good"]


def test_boosting_runs_in_as_many_partitions_as_its_rows_ask_for(spark):
    from gustframe.operators import training as TR
    d = spark.range(100).repartition(48)
    assert TR._dealt(d, 100, "gradient_boosting").rdd.getNumPartitions() == 1
    assert TR._dealt(d, 2 * TR.ROWS_PER_TASK + 1, "gradient_boosting").rdd.getNumPartitions() == 3
    assert TR._dealt(d, 100, "random_forest").rdd.getNumPartitions() == 48


def test_gate_takes_folds_without_any_error(spark):
    from gustframe.operators import training as TR
    rows = [("a", 1.0, 0.9, 0.0, 0.0), ("b", 1.0, 0.9, 1.0, 0.1)]
    got = TR.gate(spark.createDataFrame(rows, "model_name string, rmse double, r2 double, cv_rmse_mean double, cv_rmse_std double"))
    assert {r.model_name: r.passed for r in got.collect()} == {"a": False, "b": True}
