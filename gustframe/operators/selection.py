"""Feature statistics and selection (AGG24, AGG25, JN4, FSL1-FSL3).

Moments and correlations of all features come from ONE aggregate pass over the feature table, then an explode to long
format; distinct values come from one unpivot and one ``groupBy(feature, value)``, which partial aggregation shrinks, instead
of a ``count_distinct`` per feature that expands every row. Where an estimate is enough, sketches of each day are stored and
united (``day_sketches``, ``merged_distinct``), so a new day costs its own rows only. The pair table has k(k-1)/2 rows --
bounded by the schema, not by the data.
"""

from __future__ import annotations

from itertools import combinations
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct sketch are 2**SKETCH_BITS: a relative standard error of about 1.04 / sqrt(2**SKETCH_BITS).
SKETCH_BITS = 12


def _long(df: DataFrame, features: Sequence[str], *keys) -> DataFrame:
    """keys, feature and value (as double, one zero) of every non-null value."""
    d = df.select(*keys, *[(F.col(f).cast("double") + 0.0).alias(f) for f in features])
    return d.unpivot([c for c in d.columns if c not in features], list(features), "feature", "value").where("value is not null")


def distinct_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """AGG24, exact: feature, n_distinct."""
    return _long(df, features).groupBy("feature", "value").count().groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))


def day_sketches(df: DataFrame, features: Sequence[str], ts: str, bits: int = SKETCH_BITS) -> DataFrame:
    """AGG24, approximate: day, feature and a mergeable sketch of the feature's distinct values on that day."""
    return _long(df, features, F.to_date(ts).alias("day")).groupBy("day", "feature").agg(
        F.hll_sketch_agg(F.col("value").cast("string"), F.lit(bits)).alias("sketch"))


def merged_distinct(sketches: DataFrame) -> DataFrame:
    """feature, n_distinct (an estimate) over all days of ``day_sketches``, of one run or of many."""
    return sketches.groupBy("feature").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def _corr(a: str, b: str) -> Column:
    """Pearson correlation over the rows that have both values. As in SQL it is NaN where one of them does not vary (there
    ``corr`` divides by zero, or by what rounding left of it, so least and greatest value decide), null without such rows."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(varies, F.coalesce(r, F.lit(float("nan")))).when(F.count(x) > 0, F.lit(float("nan")))


def _moments(df: DataFrame, features: Sequence[str], target: str, pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_n")]
    for f in features:
        aggs += [F.var_samp(f).alias(f"{f}__var"), F.avg(f).alias(f"{f}__mean"), F.count(f).alias(f"{f}__nn"),
                 _corr(f, target).alias(f"{f}__corr")]
    return df.agg(*aggs, *[_corr(a, b).alias(f"{a}__{b}") for a, b in pairs])


def _share(part: Column, whole: Column) -> Column:
    """part / whole; NaN of nothing, as in SQL."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(F.try_divide(part, whole))


def _stats(wide: DataFrame, features: Sequence[str], distinct: DataFrame) -> DataFrame:
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"{f}__var").alias("variance"), F.col(f"{f}__mean").alias("mean"),
                     _share(F.col(f"{f}__nn"), F.col("_n")).alias("completeness"), F.col(f"{f}__nn").alias("_nn"),
                     F.col(f"{f}__corr").alias("target_corr")) for f in features]
    long = wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*").join(distinct, "feature", "left")     # a row per feature
    long = long.select("feature", "variance", "mean", "completeness",
                       _share(F.coalesce("n_distinct", F.lit(0)), F.col("_nn")).alias("unique_ratio"), "target_corr")
    v, m, u, c = F.col("variance"), F.col("mean"), F.col("unique_ratio"), F.col("target_corr")
    var_term = F.when(m == 0, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(v, m + 1e-6)))
    uniq = F.when(u < 0.5, F.least(F.lit(1.0), 2 * u)).otherwise(1.0)
    imp = 0.3 * var_term + 0.3 * F.col("completeness") + 0.2 * uniq + 0.2 * F.coalesce(F.abs(c), F.lit(0.5))
    train = 0.7 * F.coalesce(F.abs(c), F.lit(0.0)) + 0.3 * F.try_divide(v, v + 1)
    return long.withColumn("importance", imp).withColumn("training_score", train)


def _pairs(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    rows = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"{a}__{b}").alias("corr")) for a, b in pairs]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def feature_stats(df: DataFrame, features: Sequence[str], target: str, distinct: DataFrame | None = None) -> DataFrame:
    """AGG24 + AGG25 + FSL1 + FSL3 per feature, long format. ``distinct`` (feature, n_distinct) is exact by default;
    ``merged_distinct`` of stored sketches is the approximate option."""
    return _stats(_moments(df, features, target), features, distinct_counts(df, features) if distinct is None else distinct)


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """JN4 + AGG25: Pearson correlation of every feature pair i < j (pairwise complete)."""
    pairs = list(combinations(features, 2))
    return _pairs(df.agg(*[_corr(a, b).alias(f"{a}__{b}") for a, b in pairs]), pairs)


def profile(df: DataFrame, features: Sequence[str], target: str) -> tuple[DataFrame, DataFrame]:
    """Feature scores and pair correlations; both long tables are projections of one wide aggregate, so the plan
    shares its exchange."""
    pairs = list(combinations(features, 2))
    wide = _moments(df, features, target, pairs)
    return _stats(wide, features, distinct_counts(df, features)), _pairs(wide, pairs)


def redundancy_drop(stats: DataFrame, pairs: DataFrame, threshold: float = 0.8,
                    min_score: float = 0.1) -> DataFrame:
    """FSL2: in pairs with |corr| > threshold the lower-importance member goes (ties: the
    second); keep features scoring above ``min_score``. Returns kept features."""
    imp = stats.select("feature", "importance")
    p = (pairs.where(F.abs("corr") > threshold)
         .join(imp.withColumnsRenamed({"feature": "feature_a", "importance": "imp_a"}), "feature_a")
         .join(imp.withColumnsRenamed({"feature": "feature_b", "importance": "imp_b"}), "feature_b"))
    dropped = p.select(F.when(F.col("imp_a") < F.col("imp_b"), F.col("feature_a"))
                       .otherwise(F.col("feature_b")).alias("feature")).distinct()
    return stats.join(dropped, on="feature", how="left_anti").where(F.col("importance") > min_score)


def training_selection(stats: DataFrame, min_score: float = 0.01, top: int = 50) -> DataFrame:
    """FSL3: training score >= min_score, best ``top`` (the top-k is the feature)."""
    return (stats.where(F.col("training_score") >= min_score)
            .orderBy(F.col("training_score").desc(), "feature").limit(top))
