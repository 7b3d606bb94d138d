"""Language identification: a bidirectional gated recurrent network labels every byte of every text, and a
document's probabilities are the mean over its positions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustframe.llm import gru
from gustframe.llm.common import LETTER, byte_slices, held_out, prepare, stored, utf8, widened

UNKNOWN = "und"
#: Bounds of the training sample: windows of WINDOW characters, one a document, PER_LABEL of each language.
PER_LABEL, WINDOW = 500, 64
UNITS, STEPS = 8, 128
SLICE = 4 << 20


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    weights: dict


def training_windows(docs: DataFrame, per_label: int = PER_LABEL, window: int = WINDOW) -> DataFrame:
    """lang, piece, copies: for each non-null language ``per_label`` documents at most, in the order of a hash of id and
    text (ties: of the window), and from each a window at a hashed place; equal windows of one hash are one row
    with their number. Texts without a letter are left out.

    Hashes are counted in bins of a twelfth of an octave first, so only the rows up to the bin that fills a language's
    sample (about a tenth more than it) are sorted, and no task reads all rows of a language.
    """
    seed = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("window"))
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select(
        "lang", seed.alias("seed"), F.floor(12 * F.log2(seed.cast("double") + F.lit(2.0 ** 63 + 1))).cast("int").alias("bin"),
        F.substring(F.col("text"), F.pmod(seed, F.greatest(F.length("text") - window, F.lit(0)) + 1).cast("int") + 1,
                    F.lit(window)).alias("piece"))
    upto = lambda order, n: F.coalesce(
        F.sum(n).over(Window.partitionBy("lang").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = rows.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    last = stored(bins.withColumn("before", upto(["bin"], "n")).where(F.col("before") < per_label)
                  .groupBy("lang").agg(F.max("bin").alias("last")), "language-bins")       # one row per output of the network
    first = rows.join(F.broadcast(last), "lang").where("bin <= last").groupBy("lang", "seed", "piece").agg(F.count(F.lit(1)).alias("n"))
    return (first.withColumn("before", upto(["seed", "piece"], "n")).where(F.col("before") < per_label)
            .select("lang", "piece", F.least(F.col("n"), per_label - F.col("before")).alias("copies")))


def train(docs: DataFrame, per_label: int = PER_LABEL, units: int = UNITS, rounds: int = 400, seed: int = 5) -> LanguageModel:
    """Fit on a bounded sample of the labelled rows of ``docs`` (doc_id, text, lang).

    Without a labelled row the model knows no language and every text is ``und``.
    """
    rows = sorted((r.lang, r.piece) for r in training_windows(docs, per_label).collect() for _ in range(r.copies))
    labels = tuple(sorted({r[0] for r in rows}))
    if not labels:
        return LanguageModel((), {})
    pieces = [piece.encode()[:WINDOW] for _, piece in rows]
    x, n = gru.cut([p or b" " for p in pieces], WINDOW)
    y = np.array([labels.index(lang) for lang, _ in rows])
    return LanguageModel(labels, gru.train(x, y, len(labels), units, rounds=rounds, seed=seed))


def _scored(model: LanguageModel, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = gru.Reader(model.weights) if model.labels else None
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for a, b in byte_slices(texts, SLICE):
                best, score = [UNKNOWN] * (b - a), np.zeros(b - a)
                if reader is not None:
                    x, rows = gru.cut(texts[a:b], STEPS)
                    total = np.zeros((b - a, len(model.labels)))
                    np.add.at(total, np.repeat(np.arange(b - a), rows), reader.sums(x))
                    total /= np.maximum(1, [[len(t)] for t in texts[a:b]])
                    best = [model.labels[i] for i in total.argmax(axis=1)]
                    score = np.clip(np.round(total.max(axis=1), 4), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in keys), pa.array(best), pa.array(score)],
                    [*keys, "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score for every row.

    Null texts, texts without a letter, and all texts when the model knows no language: ``und`` with
    score 0. Else the language of the highest mean probability over all bytes (ties: the first by
    name) and that mean. Only the text is read; repeated rows get equal results.
    """
    prepare(docs.sparkSession)
    letters = F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False))
    rows = docs.select(*keep, F.when(letters, F.col(text_col)).alias("__own")).select(*keep, utf8("__own").alias("__text"), F.col("__own").isNotNull().alias("__known"))
    scored = rows.mapInArrow(_scored(model, [*keep, "__known"]),
                             widened(docs, keep, "__known boolean, lang_pred string, score double"))
    return scored.select(*keep, F.when(F.col("__known"), F.col("lang_pred")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
                         F.when(F.col("__known"), F.col("score")).otherwise(F.lit(0.0)).alias("score"))


def by_language(docs: DataFrame) -> DataFrame:
    """Train on the four fifths of ``docs`` that are not held out, and label all rows."""
    prepare(docs.sparkSession)
    held = held_out(5, 0)
    model = train(docs.where(~held))
    return identify(docs.withColumn("held_out", held), model, keep=("doc_id", "held_out"))
