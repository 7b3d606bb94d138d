"""Model operators on Spark ML (ML1, ML4-ML11, UDF4, SNK7).

Fits run on the cluster (Spark ML estimators); the driver only loops over the
handful of estimator families and holds their scalar metrics.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustframe.operators.moments import fold_errors, fold_moments
from gustframe.operators.quantiles import medians

#: Families whose folds come from moments, with their penalty.
LINEAR = {"linear": None, "ridge": 1.0}
#: Rows of one task of a boosting fit.
ROWS_PER_TASK = 20_000


def prepare(df: DataFrame, target: str) -> DataFrame:
    """ML1 / FLT4: rows with a target (features are median-imputed inside the pipeline)."""
    return df.where(F.col(target).isNotNull())


def estimators(n_rows: int, y_std_pop: float, alpha: float = 1.0, enhanced: bool = False) -> dict:
    """UDF4: model family table name -> estimator (features in ``features_scaled``).

    Ridge: Spark's loss is 1/(2n)·RSS + λ/2·||w||² with the penalty scaled by the
    label's std, so sklearn's α maps to ``regParam = α · std_pop(y) / n``.
    """
    reg = alpha * y_std_pop / max(n_rows, 1)
    common = dict(featuresCol="features_scaled", labelCol="label")
    return {
        "linear": LinearRegression(solver="normal", **common),
        "ridge": LinearRegression(solver="normal", regParam=reg, elasticNetParam=0.0,
                                  standardization=False, **common),
        "random_forest": RandomForestRegressor(numTrees=200 if enhanced else 100,
                                               maxDepth=10 if enhanced else 5,
                                               minInstancesPerNode=2 if enhanced else 1, seed=42, **common),
        "gradient_boosting": GBTRegressor(maxIter=200 if enhanced else 100, stepSize=0.1,
                                          maxDepth=6 if enhanced else 3,
                                          subsamplingRate=0.8 if enhanced else 1.0, seed=42, **common),
    }


def _dealt(train: DataFrame, rows: int, family: str) -> DataFrame:
    """The rows in as many partitions as their number asks for. Boosting runs hundreds of short jobs one after the other, each
    with a task per partition, and ordered tables come in as many partitions as a shuffle has, however few their rows. Forests
    draw their rows by partition, and take them as they are."""
    return train.coalesce(max(1, -(-rows // ROWS_PER_TASK))) if family == "gradient_boosting" else train


def _number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def feature_pipeline(train: DataFrame, features: Sequence[str]) -> list:
    """ML1 + ML4: missing values (null, NaN) become the training rows' exact median, 0 for a feature without any value; then
    mean 0 and population standard deviation 1 (a constant feature becomes 0). The stages are SQL with these numbers in it,
    so a saved pipeline holds them."""
    features = list(features)
    middle = medians(train, features)
    filled = {f: f"coalesce(nanvl(CAST(`{f}` AS DOUBLE), CAST(NULL AS DOUBLE)), {_number(middle.get(f) or 0.0)})" for f in features}
    stats = train.agg(*[F.avg(F.expr(e)).alias(f"m{i}") for i, e in enumerate(filled.values())],
                      *[F.stddev_pop(F.expr(e)).alias(f"s{i}") for i, e in enumerate(filled.values())]).first()
    scaled = [f"(`{f}__imp` - {_number(stats[f'm{i}'] or 0.0)}) / {_number(stats[f's{i}'] or 1.0)} AS `{f}__scaled`"
              for i, f in enumerate(features)]
    return [SQLTransformer(statement="SELECT *, " + ", ".join(f"{e} AS `{f}__imp`" for f, e in filled.items()) + " FROM __THIS__"),
            SQLTransformer(statement="SELECT *, " + ", ".join(scaled) + " FROM __THIS__"),
            VectorAssembler(inputCols=[f"{f}__scaled" for f in features], outputCol="features_scaled")]


def compare_models(spark: SparkSession, df: DataFrame, features: Sequence[str], target: str,
                   split_col: str = "is_test", families: Sequence[str] | None = None) -> tuple[DataFrame, dict]:
    """ML9 + ML10: fit each family on the training rows, evaluate on the test rows,
    return a metrics table and the fitted pipelines. A family that fails keeps its row,
    with the reason in ``error``."""
    d = prepare(df, target).withColumn("label", F.col(target).cast("double")).persist()
    try:
        train, test = d.where(~F.col(split_col)), d.where(F.col(split_col))
        stats = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
        est = estimators(stats["n"], stats["s"] or 0.0)
        rows, fitted = [], {}
        stages = feature_pipeline(train, features)
        for name in (families or est.keys()):
            try:
                model = Pipeline(stages=stages + [est[name]]).fit(_dealt(train, stats["n"], name))
            except Exception as e:  # noqa: BLE001 -- one family's failure must not hide the others
                rows.append((name, None, None, None, stats["n"], str(e)[:500]))
                continue
            pred = model.transform(test)
            ev = lambda m: RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName=m).evaluate(pred)
            rows.append((name, float(ev("rmse")), float(ev("mae")), float(ev("r2")), stats["n"], None))
            fitted[name] = model
    finally:
        d.unpersist()
    metrics = spark.createDataFrame(rows, "model_name string, rmse double, mae double, r2 double, train_rows bigint, error string")
    return metrics, fitted


def fold_stages(df: DataFrame, features: Sequence[str], target: str, fold_col: str = "fold") -> dict:
    """fold -> feature stages, rows and target deviation of all other folds; the same for every family."""
    d = prepare(df, target)
    out = {}
    for (fold,) in sorted(d.select(fold_col).distinct().collect()):
        train = d.where(F.col(fold_col) != fold)
        stats = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(F.col(target).cast("double")).alias("s")).first()
        out[fold] = (feature_pipeline(train, features), stats["n"], stats["s"] or 0.0)
    return out


def cross_validate(df: DataFrame, features: Sequence[str], target: str, fold_col: str = "fold",
                   family: str = "ridge", stages: dict | None = None) -> dict:
    """ML9: fit on all folds but one, RMSE on that one; mean and population std over the folds.

    ``fold_col`` comes from ``windows.contiguous_folds``, so a fold is a stretch of time. ``stages`` are those of
    ``fold_stages``, where they are known.
    """
    d = prepare(df, target).withColumn("label", F.col(target).cast("double"))
    errors = []
    for fold, (own, n, deviation) in (stages or fold_stages(df, features, target, fold_col)).items():
        train, test = d.where(F.col(fold_col) != fold), d.where(F.col(fold_col) == fold)
        pred = Pipeline(stages=own + [estimators(n, deviation)[family]]).fit(_dealt(train, n, family)).transform(test)
        errors.append(RegressionEvaluator(labelCol="label", metricName="rmse").evaluate(pred))
    return _spread(errors)


def _spread(errors: list[float]) -> dict:
    mean = sum(errors) / len(errors) if errors else None
    std = (sum((e - mean) ** 2 for e in errors) / len(errors)) ** 0.5 if errors else None
    return {"cv_rmse_mean": mean, "cv_rmse_std": std, "folds": len(errors)}


def univariate_fold_errors(spark: SparkSession, df: DataFrame, features: Sequence[str], target: str, fold_col: str = "fold") -> DataFrame:
    """ML9: feature, model_name, fold and rmse of the linear and the ridge model of each single feature; all of them come
    from one table of moments."""
    moments = fold_moments(df, features, target, fold_col)
    rows = [(f, name, k, e) for f in features for name, alpha in LINEAR.items() for k, e in fold_errors(moments, alpha, [f]).items()]
    return spark.createDataFrame(rows, "feature string, model_name string, fold int, rmse double")


def with_cross_validation(spark: SparkSession, metrics: DataFrame, df: DataFrame, features: Sequence[str], target: str,
                          order: Sequence[str], folds: int = 5) -> DataFrame:
    """ML9: cv_rmse_mean and cv_rmse_std of each family of ``metrics`` over contiguous folds of all rows: linear and ridge from
    one table of moments by fold, the others by a fit per fold. They are null
    (which does not pass the gate) for a family whose fit failed, then with the reason in ``error``."""
    from gustframe.operators.windows import contiguous_folds
    d = contiguous_folds(prepare(df, target), list(order), folds).persist()
    rows, stages, moments = [], None, None
    try:
        for name in [r.model_name for r in metrics.where("rmse is not null").select("model_name").collect()]:
            try:
                if name in LINEAR:
                    moments = moments or fold_moments(d, features, target)
                    cv = _spread(list(fold_errors(moments, LINEAR[name]).values()))
                else:
                    stages = stages or fold_stages(d, features, target)
                    cv = cross_validate(d, features, target, family=name, stages=stages)
                rows.append((name, cv["cv_rmse_mean"], cv["cv_rmse_std"], None))
            except Exception as e:  # noqa: BLE001 -- one family's failure must not hide the others
                rows.append((name, None, None, str(e)[:500]))
    finally:
        d.unpersist()
    cv = spark.createDataFrame(rows, "model_name string, cv_rmse_mean double, cv_rmse_std double, cv_error string")
    return (metrics.join(cv, "model_name", "left")
            .withColumn("error", F.coalesce("error", "cv_error")).drop("cv_error"))


def random_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """ML2: ``is_test`` for a share of the rows by a hash of their key, the same on every run."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000)) < int(test_share * 10_000))


def save_model(model: PipelineModel, path: str) -> None:
    """SNK7: Spark ML persistence (model + imputer + scaler + feature order)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def gate(metrics: DataFrame, max_rmse: float = 15.0, min_r2: float = 0.5) -> DataFrame:
    """ML13: a trained model passes when rmse <= 15 and R2 >= 0.5 and, where it was cross-validated,
    its RMSE varies by less than a fifth over the folds. A failed fit does not pass."""
    ok = (F.col("rmse") <= max_rmse) & (F.col("r2") >= min_r2)
    if "cv_rmse_mean" in metrics.columns:
        ok = ok & (F.try_divide("cv_rmse_std", "cv_rmse_mean") < 0.2)
    return metrics.withColumn("passed", F.coalesce(ok, F.lit(False)))
