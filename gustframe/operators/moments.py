"""Linear models of cross-validation folds from sufficient statistics (ML9 for ML5 and ML6).

One aggregate gives the second moments of every fold over (filled features, missing flags, 1, target). Those of all other
folds are a subtraction, filling with a median and scaling are a linear map of them, a fit is a solve of p equations,
and the squared error on the fold is a quadratic form in its moments: no row is read again and nothing is refitted.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.operators.quantiles import quantiles, value_counts

#: Variances below this share of the mean square of the shifted values, and eigenvalues below it, are nought.
NOUGHT = 1e-10


@dataclass(frozen=True)
class FoldMoments:
    """For each fold: ``second``, the sums of products of (shifted features with 0 where missing, missing flags, 1, shifted
    target), and ``filling``, the other folds' median of each feature, shifted alike."""

    features: tuple[str, ...]
    second: dict
    filling: dict


def fold_moments(df: DataFrame, features: Sequence[str], target: str, fold_col: str = "fold") -> FoldMoments:
    """Moments of ``df`` by fold, from rows with a target. Nulls and NaN are missing; a feature without a value in the
    other folds is filled with 0. Values are shifted by their mean over all rows, so that sums of squares do not cancel."""
    features, p = tuple(features), len(features)
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    d = df.where(F.col(target).isNotNull()).select(F.col(fold_col).alias("fold"), *[number(f).alias(f"x{i}") for i, f in enumerate(features)],
                                                   F.col(target).cast("double").alias("y"))
    names = [f"x{i}" for i in range(p)]
    means = d.agg(*[F.avg(c) for c in [*names, "y"]], F.collect_set("fold")).first()
    folds, shift = sorted(means[p + 1]), np.array([m or 0.0 for m in means[:p + 1]])
    z = [F.coalesce(F.col(c) - F.lit(float(s)), F.lit(0.0)) for c, s in zip(names, shift)]
    z += [F.col(c).isNull().cast("double") for c in names] + [F.lit(1.0), F.col("y") - F.lit(float(shift[p]))]
    rows, columns = np.triu_indices(len(z))
    sums = d.groupBy("fold").agg(F.array(*[F.sum(z[i] * z[j]) for i, j in zip(rows, columns)]).alias("s"))
    second = {}
    for r in sums.collect():                                                                   # a row per fold
        second[r.fold] = np.zeros((len(z), len(z)))
        second[r.fold][rows, columns] = second[r.fold][columns, rows] = r.s
    filling = {k: np.array([-s for s in shift[:p]]) for k in folds}
    others = d.withColumn("left_out", F.explode(F.array_except(F.array(*map(F.lit, folds)), F.array("fold"))))
    for r in quantiles(value_counts(others, ["left_out"], names), ["left_out"], [0.5]).collect():
        filling[r.left_out][names.index(r["name"])] += r.q[0]
    return FoldMoments(features, second, filling)


def fold_errors(moments: FoldMoments, ridge: float | None = None, features: Sequence[str] | None = None) -> dict:
    """fold -> RMSE on it of the linear model fitted on all other folds: ordinary least squares (of least norm), or with the
    penalty ``ridge`` on the scaled coefficients. ``features``: those of the model, all by default."""
    chosen = [moments.features.index(f) for f in (features or moments.features)]
    p, q = len(moments.features), len(chosen)
    total, errors = sum(moments.second.values()), {}
    for fold, own in moments.second.items():
        rest = total - own
        n = rest[2 * p, 2 * p]
        if n <= 0.5:
            continue                                                                           # a single fold: nothing to learn from
        scale = np.zeros((q + 2, 2 * p + 2))
        for row, i in enumerate(chosen):
            scale[row, [i, p + i]] = 1, moments.filling[fold][i]
        scale[q, 2 * p], scale[q + 1, 2 * p + 1] = 1, 1
        scale[:, 2 * p] -= np.where(np.arange(q + 2) == q, 0, scale @ rest[:, 2 * p] / n)     # means of the rest become 0
        variance = np.einsum("ij,jk,ik->i", scale[:q], rest, scale[:q]) / n
        square = np.array([own[i, i] + rest[i, i] for i in chosen]) / total[2 * p, 2 * p]
        varies = variance > NOUGHT * np.maximum(square, 1e-300)
        scale[:q] = np.where(varies[:, None], scale[:q] / np.sqrt(np.where(varies, variance, 1))[:, None], 0)
        known = scale @ rest @ scale.T
        a, b = known[:q, :q], known[:q, q + 1]
        w = np.linalg.solve(a + ridge * np.eye(q), b) if ridge else np.linalg.pinv(a, rcond=NOUGHT, hermitian=True) @ b
        line = np.concatenate([-w, [0], [1]]) @ scale
        errors[fold] = float(np.sqrt(max(line @ own @ line, 0) / own[2 * p, 2 * p]))
    return errors
