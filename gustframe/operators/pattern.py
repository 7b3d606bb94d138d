"""FTR11 pattern index: first principal component of (T, H, W), per frame's first row.

The covariance is a distributed aggregate inside Spark ML's PCA; the driver only
receives the 3 loadings (to fix their sign: largest absolute loading positive).
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.functions.mathfn import default_if_falsy


def pattern_index(frames: DataFrame, keys=("station_id", "window_start"),
                  order=("obs_ts", "event_id")) -> DataFrame:
    d = frames.withColumn("_h", default_if_falsy("relative_humidity"))
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=["temperature_c", "_h", "wind_speed_ms"], outputCol="_x", handleInvalid="skip"),
        StandardScaler(inputCol="_x", outputCol="_xc", withMean=True, withStd=False),
        PCA(k=1, inputCol="_xc", outputCol="_pc")]).fit(d)
    loadings = pipe.stages[-1].pc.toArray()[:, 0]
    sign = 1.0 if loadings[abs(loadings).argmax()] >= 0 else -1.0
    p = pipe.transform(d).withColumn("_v", vector_to_array("_pc")[0] * sign)
    return p.groupBy(*keys).agg(F.min_by("_v", F.struct(*order)).alias("pattern_index"),
                                F.count(F.lit(1)).alias("n_obs"))
