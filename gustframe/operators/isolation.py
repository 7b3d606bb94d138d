"""FTR10: isolation forest over one measure, per key, for keys of every size.

1. A seeded sample of at most POOL rows per key (``row_number`` over a hash: map tasks keep POOL rows per key).
2. One grouped pass grows TREES isolation trees, each on SAMPLE rows of the pool. A tree over one measure cuts the line
   into intervals of equal path length, so the forest is kept as two arrays: interval ends and scores.
3. Every row is scored: distinct values are counted and meet the intervals in a linear as-of scan; no model is sent to
   tasks and no key is held by one.
4. The contamination cut is the exact quantile of the scores of all rows, by counting.
"""

from __future__ import annotations

import math
import zlib
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustframe.operators.quantiles import quantiles
from gustframe.operators.sequence import sequence_asof, sequence_sum

# The forest's settings.
TREES, SAMPLE, CONTAMINATION, SEED = 100, 256, 0.1, 42
#: Rows of a key from which its trees draw their samples.
POOL = 1024


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` values: the rest of a path below a leaf of n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(values: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, depths) of one tree over sorted ``values``: a value above exactly i cuts has path length depths[i]."""
    limit = math.ceil(math.log2(max(len(values), 2)))
    cuts: list[float] = []
    depths: list[float] = []
    work: list = [(0, len(values), 0)]
    while work:                                     # left before right, so cuts and depths come in order
        item = work.pop()
        if isinstance(item, float):
            cuts.append(item)
            continue
        a, b, depth = item
        low, high = values[a], values[b - 1]
        if depth >= limit or low == high:
            depths.append(depth + expected_path(b - a))
            continue
        cut = float(low + (high - low) * rng.random())
        cut = cut if cut < high else float(low)
        middle = a + int(np.searchsorted(values[a:b], cut, side="right"))
        work += [(middle, b, depth + 1), cut, (a, middle, depth + 1)]
    return np.array(cuts), np.array(depths)


def forest(values: np.ndarray, seed: int, trees: int = TREES, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(ends, scores): a value belongs to the first end at or above it (the last is infinite); scores lie in (-1, 0),
    lower for values that are isolated sooner."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(values))
    grown = [grow_tree(np.sort(rng.choice(values, size, replace=False)), rng) for _ in range(trees)]
    ends = np.append(np.unique(np.concatenate([c for c, _ in grown])), np.inf)
    total = np.zeros(len(ends))
    for cuts, depths in grown:
        total += depths[np.searchsorted(cuts, ends, side="left")]
    return ends, -np.exp2(-total / trees / max(expected_path(size), 1e-12))


def key_seed(key: tuple, seed: int = SEED) -> int:
    return zlib.crc32("|".join(map(str, key)).encode()) ^ seed


def pool(obs: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], rows: int = POOL, seed: int = SEED) -> DataFrame:
    """At most ``rows`` rows per key: those that come first by a hash of ``order``, which names a row."""
    first = Window.partitionBy(*keys).orderBy("_rank", *order)
    d = obs.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, *order, F.col(value).cast("double").alias("_value"))
    return (d.withColumn("_rank", F.xxhash64(*order, F.lit(seed))).withColumn("_n", F.row_number().over(first))
            .where(F.col("_n") <= rows).select(*keys, "_n", "_value"))


def fit_forests(pooled: DataFrame, keys: Sequence[str], seed: int = SEED) -> DataFrame:
    """One row per key: its forest as arrays ``ends`` and ``scores``."""
    keys = list(keys)
    schema = ", ".join(f"`{k}` {pooled.schema[k].dataType.simpleString()}" for k in keys) + ", ends array<double>, scores array<double>"

    def grow(group):
        ends, scores = forest(group.sort_values("_n")["_value"].to_numpy(), key_seed(tuple(group[keys].iloc[0]), seed))
        return group[keys].head(1).assign(ends=[ends], scores=[scores])
    return pooled.groupBy(*keys).applyInPandas(grow, schema)


def scored_values(obs: DataFrame, forests: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, n (rows with it) and score of every distinct value of every key."""
    keys = list(keys)
    v = F.col(value).cast("double")
    counts = obs.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    steps = (forests.select(*keys, F.explode(F.arrays_zip("ends", "scores")).alias("s"))
             .select(*keys, F.col("s.ends").alias("end"), F.col("s.scores").alias("score"), F.lit(0).alias("tie")))
    j = sequence_asof(counts, steps, keys, -F.col("value"), -F.col("end"), "tie", ["score"], time_type="double")
    return j.select(*keys, "value", "n", F.col("_asof.score").alias("score"))


def anomaly_share(obs: DataFrame, keys: Sequence[str] = ("station_id",), value: str = "temperature_c",
                  order: Sequence[str] = ("obs_ts", "event_id"), contamination: float = CONTAMINATION, seed: int = SEED) -> DataFrame:
    """FTR10: keys, n_rows (with a value), flagged and anomaly_score, the share of rows that are not flagged. A key with one
    value has 0.5, one without any 0."""
    keys = list(keys)
    scores = scored_values(obs, fit_forests(pool(obs, keys, value, order, seed=seed), keys, seed), keys, value)
    by_score = scores.groupBy(*keys, F.lit("score").alias("name"), F.col("score").alias("value")).agg(F.sum("n").alias("n"))
    counts = sequence_sum(by_score, [*keys, "name"], ["value"], "n", out="upto")
    cut = quantiles(counts, keys, [contamination]).select(*keys, "name", F.col("q")[0].alias("_cut"))
    flagged = counts.join(cut, on=[*keys, "name"]).groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value") < F.col("_cut"), F.col("n")).otherwise(0)).alias("flagged"))
    n, bad = F.coalesce("n_rows", F.lit(0)), F.coalesce("flagged", F.lit(0))
    share = F.when(n == 0, 0.0).when(n == 1, 0.5).otherwise(1 - bad / n)
    return obs.select(*keys).distinct().join(flagged, on=keys, how="left").select(
        *keys, n.cast("long").alias("n_rows"), F.when(n > 1, bad).otherwise(0).cast("long").alias("flagged"), share.alias("anomaly_score"))
