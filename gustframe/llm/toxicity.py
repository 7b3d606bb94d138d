"""Toxicity: a convolutional text classifier over hashed word embeddings, trained on all labelled rows.

A word's embedding is the sum of three rows of hashed tables (the word, its first 4 and first 5
bytes). Filters of several widths run over the words of a text, each keeps its largest answer, and a logistic layer
reads these. Four in five labelled rows make the weights: a share of them is fitted first, then in each round workers go over
all of them and their changes are averaged. Thresholds are calibrated by language on the other labelled rows.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.llm.common import byte_slices, held_out, prepare, stored, utf8
from gustframe.llm.wordhash import ASCII_NO_WORD, WordHasher

BUCKETS, PREFIXES = 1 << 15, (4, 5)
DIM, FILTERS, WIDTHS = 12, 12, (1, 2, 3)
#: Rows and bytes of text that the starting fit holds; workers of a round go over as many each, or more beyond MOST_WORKERS.
HELD_ROWS, HELD_BYTES, MOST_WORKERS = 8000, 32 << 20, 256
#: Bits (a power of two) of the map that tells texts with a label.
MOST_BITS = 26
#: Rounds over all rows after the starting fit, and words of one step (one text at least).
ROUNDS, STEP_WORDS = 2, 1 << 18
#: Parts in which the numbers of a network travel.
PARTS = 16
SLICE = 2 << 20
F32 = np.float32


class TextCnn:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hasher = WordHasher(ASCII_NO_WORD, PREFIXES)
        self.table = rng.normal(0, 0.1, (len(PREFIXES) + 1, BUCKETS, DIM)).astype(F32)
        self.filters = [rng.normal(0, 1 / np.sqrt(DIM * w), (w * DIM, FILTERS)).astype(F32) for w in WIDTHS]
        self.shift = np.zeros((len(WIDTHS), FILTERS), F32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(F32)
        self.bias = np.zeros(1, F32)
        self.sums = [np.full_like(p, 1e-6) for p in self.dense()]
        self.table_sums = np.full(self.table.shape[:2], 1e-6, F32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "hasher"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, hasher=WordHasher(ASCII_NO_WORD, PREFIXES))

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, self.shift, self.out, self.bias]

    def numbers(self) -> np.ndarray:
        """All weights and sums of squares in one row."""
        return np.concatenate([x.ravel() for x in (self.table, self.table_sums, *self.dense(), *self.sums)])

    def take(self, numbers: np.ndarray) -> None:
        at = 0
        for x in (self.table, self.table_sums, *self.dense(), *self.sums):
            x[...] = numbers[at:at + x.size].reshape(x.shape)
            at += x.size

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows (word, prefixes) of all words, and the number of words of each text."""
        hashes, counts = self.hasher.words(texts)
        return (hashes & np.uint64(BUCKETS - 1)).astype(np.int32), counts

    def _laid_out(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings with zeros behind every text, and each text's first and last place."""
        pad = max(WIDTHS) - 1
        starts = np.concatenate([[0], np.cumsum(counts + pad)[:-1]])
        place = np.arange(len(rows)) + np.repeat(np.arange(len(counts)) * pad, counts)
        x = np.zeros((int((counts + pad).sum()) + pad, DIM), F32)
        own = self.table[0].take(rows[:, 0], axis=0)
        for k in range(1, len(self.table)):
            own += self.table[k].take(rows[:, k], axis=0)
        x[place] = own
        return x, starts, starts + counts

    def pooled(self, rows: np.ndarray, counts: np.ndarray, where: bool = False):
        """Largest answer of every filter in each text (0 without words); with ``where`` also its place."""
        x, starts, ends = self._laid_out(rows, counts)
        n = len(x) - max(WIDTHS) + 1
        some = np.flatnonzero(counts)
        best = np.zeros((len(counts), len(WIDTHS), FILTERS), F32)
        at = np.zeros(best.shape, np.int64)
        for j, w in enumerate(WIDTHS):
            wide = x[:n] if w == 1 else np.concatenate([x[k:n + k] for k in range(w)], axis=1)
            answer = wide @ self.filters[j]
            if where:
                for i in some:
                    part = answer[starts[i]:ends[i]]
                    at[i, j] = part.argmax(axis=0) + starts[i]
                    best[i, j] = part.max(axis=0)
            elif len(some):
                cuts = np.stack([starts[some], ends[some]], axis=1).ravel()
                best[some, j] = np.maximum.reduceat(answer, cuts, axis=0)[::2]
        best = np.maximum(best + self.shift, 0)
        best[counts == 0] = 0
        return (best, at, x) if where else best

    def scores(self, texts: list[bytes]) -> np.ndarray:
        rows, counts = self.words(texts)
        logit = self.pooled(rows, counts).reshape(len(counts), -1) @ self.out + self.bias
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def _step(self, rows: np.ndarray, n: np.ndarray, labels: np.ndarray, weight: np.ndarray, step: float) -> None:
        """One Adagrad step on the cross-entropy of a few texts; only each filter's largest place learns."""
        best, at, x = self.pooled(rows, n, where=True)
        flat = best.reshape(len(n), -1)
        p = 1 / (1 + np.exp(-(flat @ self.out + self.bias)))
        err = ((p - labels) * weight / len(n)).astype(F32)
        grads = [np.zeros_like(f) for f in self.filters]
        d_best = (err[:, None] * self.out).reshape(best.shape) * (best > 0)
        d_x = np.zeros_like(x)
        for j, w in enumerate(WIDTHS):
            for k in range(w):
                part = slice(k * DIM, (k + 1) * DIM)
                seen = x[at[:, j] + k]                              # (texts, filters, DIM)
                grads[j][part] += np.einsum("tf,tfd->df", d_best[:, j], seen)
                np.add.at(d_x, at[:, j] + k, d_best[:, j][..., None] * self.filters[j][part].T)
        grads += [d_best.sum(axis=0), flat.T @ err, err.sum(keepdims=True)]
        starts = np.concatenate([[0], np.cumsum(n + max(WIDTHS) - 1)[:-1]])
        place = np.arange(len(rows)) + np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        d_own = d_x[place]
        moved = np.flatnonzero(d_own.any(axis=1))
        for k in range(len(self.table)):
            at_row = rows[moved, k]
            np.add.at(self.table_sums[k], at_row, (d_own[moved] ** 2).mean(axis=1))
            np.subtract.at(self.table[k], at_row, step * d_own[moved] / np.sqrt(self.table_sums[k][at_row])[:, None])
        for q, g, s in zip(self.dense(), grads, self.sums):
            s += g * g
            q -= step * g / np.sqrt(s)

    def learn(self, rows: np.ndarray, counts: np.ndarray, order: np.ndarray, labels: np.ndarray, weight: np.ndarray,
              step: float, batch: int = 32) -> None:
        """Steps of ``batch`` texts (fewer where they are long) over the texts in ``order``."""
        ends = np.cumsum(counts)
        size = np.cumsum(counts[order])
        i = 0
        while i < len(order):
            room = np.searchsorted(size, (size[i - 1] if i else 0) + STEP_WORDS, "right")
            pick = order[i:min(i + batch, max(room, i + 1))]
            self._step(np.concatenate([rows[ends[p] - counts[p]:ends[p]] for p in pick]), counts[pick], labels[pick],
                       weight[pick], step)
            i += len(pick)

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 900, batch: int = 32, rate: float = 0.05,
            seed: int = 3, weights: tuple[float, float] | None = None) -> None:
        """Adagrad on the cross-entropy over several epochs; the classes weigh the same, or ``weights``."""
        epochs = max(1, steps * batch // len(texts))
        rng = np.random.default_rng(seed)
        rows, counts = self.words(texts)
        weight = np.where(labels > 0, *(weights or class_weights(int((labels == 0).sum()), int(labels.sum())))[::-1])
        for epoch in range(epochs):
            self.learn(rows, counts, rng.permutation(len(texts)), labels, weight, rate * (1 - 0.8 * epoch / epochs), batch)


def class_weights(zeros: int, ones: int) -> tuple[float, float]:
    """Weights of a row of class 0 and of class 1 with which both classes weigh the same."""
    return tuple(0.5 / max(1, n) * (zeros + ones) for n in (zeros, ones))


@dataclass(frozen=True)
class ToxicityModel:
    net: TextCnn
    thresholds: dict[str, float]
    threshold: float


def best_threshold(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | int = 1) -> float:
    """The cut with the best F1 (midway between neighbouring scores; of equal ones the one next to 0.5). A row stands
    for ``counts`` rows."""
    order = np.argsort(-scores, kind="stable")
    s, n = scores[order], np.broadcast_to(counts, scores.shape)[order]
    y = labels[order] * n
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.cumsum(n) + y.sum())
    whole = np.append(s[1:] < s[:-1], True)          # equal scores fall on one side
    f1 = np.where(whole, f1, -1)
    cuts = (s + np.append(s[1:], 0)) / 2
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(cuts[top[np.abs(cuts[top] - 0.5).argmin()]])


def _worker(net, weights: tuple[float, float], rate: float | None):
    """Arrow function: the numbers of the network (a broadcast) after one worker's rows, in parts. With ``rate`` the worker
    goes over its rows once as they come; without, it fits in several epochs what it holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = own or copy.deepcopy(net.value)
            texts, y = batch.column("__text").to_pylist(), batch.column("toxic").to_numpy()
            if rate is None:
                for row in zip(y.tolist(), batch.column("doc_id").to_pylist(), texts):
                    if not held or (len(held) < HELD_ROWS and size + len(row[2]) <= HELD_BYTES):
                        held.append(row)
                        size += len(row[2])
                continue
            weight = np.where(y > 0, weights[1], weights[0])
            for a, b in byte_slices(texts, SLICE):
                rows, counts = own.words(texts[a:b])
                own.learn(rows, counts, np.arange(b - a), y[a:b], weight[a:b], rate)
        if own is None:
            return
        if held:
            held.sort()
            own.fit([r[2] for r in held], np.array([r[0] for r in held]), weights=weights)
        of = TaskContext.get().partitionId()
        for part, x in enumerate(np.array_split(own.numbers(), PARTS)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([of], pa.int64()), pa.array([x.tobytes()])],
                                             ["part", "worker", "numbers"])
    return run


def _averaged(net):
    """Arrow function over (part, worker, numbers) in order: each part with the mean change of every number over
    the workers that changed it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part, change, by = None, None, None, None

        def result() -> pa.RecordBatch:
            mean = (before[part] + change / np.maximum(by, 1)).astype(F32)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([mean.tobytes()])], ["part", "numbers"])

        for batch in batches:
            for row in batch.to_pylist():
                if before is None:
                    before = [x.astype(np.float64) for x in np.array_split(net.value.numbers(), PARTS)]
                if row["part"] != part:
                    if part is not None:
                        yield result()
                    part = row["part"]
                    change, by = np.zeros(len(before[part])), np.zeros(len(before[part]), np.int64)
                own = np.frombuffer(row["numbers"], F32) - before[part]
                change += own
                by += own != 0
        if part is not None:
            yield result()
    return run


def _round(rows: DataFrame, net: TextCnn, weights: tuple[float, float], rate: float | None) -> None:
    """Let each task of ``rows`` learn as a worker from ``net``, and set it to the mean of what they learnt."""
    shared = rows.sparkSession.sparkContext.broadcast(net)
    parts = (rows.mapInArrow(_worker(shared, weights, rate), "part int, worker long, numbers binary")
             .repartition("part").sortWithinPartitions("part", "worker")
             .mapInArrow(_averaged(shared), "part int, numbers binary").collect())
    if parts:
        net.take(np.concatenate([np.frombuffer(r.numbers, F32) for r in sorted(parts)]))
    shared.unpersist()


def _threshold(table: pa.Table) -> pa.Table:
    """The threshold of one language from the counts of its scores, if both classes are there."""
    score, y, n = (table.column(c).to_numpy() for c in ("score", "toxic", "n"))
    found = [best_threshold(score, y, n)] if len(set(y)) == 2 else []
    return pa.table({"lang": table.column("lang").slice(0, len(found)), "threshold": pa.array(found, pa.float64())})


def _calibrated(rows: DataFrame, net: TextCnn) -> tuple[dict[str, float], float]:
    """Thresholds by language and the common one from all ``rows``: scores have five digits, so their counts are a small table."""
    shared = rows.sparkSession.sparkContext.broadcast(net)
    scored = rows.select("lang", "toxic", "__text").mapInArrow(
        lambda batches: _scored(shared.value, ("lang", "toxic"))(batches), "lang string, toxic int, score double")
    counts = stored(scored.groupBy("lang", "score", "toxic").agg(F.count(F.lit(1)).alias("n")), "toxic-scores")
    common = counts.groupBy("score", "toxic").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string"))
    found = (counts.where("lang <> ''").unionByName(common).groupBy("lang")
             .applyInArrow(_threshold, "lang string, threshold double").collect())
    by_lang = {r.lang: r.threshold for r in sorted(found, key=lambda r: r.lang or "")}
    return by_lang, by_lang.pop(None, 0.5)


def _of_ids(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` that may have a doc_id of ``marks``, by a bitmap of hashes that is bounded and broadcast:
    most texts without a label are never shuffled."""
    bits = 1 << min(MOST_BITS, max(15, (16 * marks.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    maps = (marks.select(place.alias("at")).groupBy(F.expr("at div 32768").alias("__map"))
            .agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("__bits")))
    found = docs.withColumn("__at", place).withColumn("__map", F.expr("__at div 32768")).join(F.broadcast(maps), "__map")
    one = "cast(conv(hex(substring(__bits, cast((__at % 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
    return found.where(F.expr(f"shiftright({one}, cast(__at % 8 as int)) % 2 = 1")).select(*docs.columns)


def train(docs: DataFrame, labels: DataFrame, held_rows: int = HELD_ROWS, rounds: int = ROUNDS) -> ToxicityModel:
    """Fit on all ``labels`` (doc_id, toxic) rows of ``docs`` with a text, whatever its length. One in five of them
    calibrates the thresholds, the others make the weights. Up to ``held_rows`` rows are fitted by one worker; of
    more, one share makes the starting weights, and in each of ``rounds`` rounds workers go over all rows. Without labelled
    rows the weights stay as they start."""
    marks = stored(labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
                   .where("toxic in (0, 1) and doc_id is not null"), "toxic-labels")
    texts = docs.where("text is not null").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), utf8("text").alias("__text"))
    rows = (_of_ids(texts, marks).join(marks.hint("merge"), "doc_id")
            .withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0)
            .withColumn("place", F.xxhash64("doc_id", "__text")))
    rows = stored(rows.sortWithinPartitions("place", "doc_id"), "toxic-rows")
    fitted, net = rows.where("not calibrates"), TextCnn()
    total = {r.toxic: (r.n, r.size) for r in fitted.groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("__text")).alias("size")).collect()}
    n, size = (sum(x[i] for x in total.values()) for i in (0, 1))
    if n:
        shares = max(-(-n // held_rows), -(-size // HELD_BYTES), 1)
        weights = class_weights(*(total.get(y, (0, 0))[0] for y in (0, 1)))
        first = fitted.where(F.pmod("place", F.lit(shares)) == 0) if shares > 1 else fitted
        _round(first.repartition(1).sortWithinPartitions("place", "doc_id"), net, weights, None)
        for r in range(rounds if shares > 1 else 0):
            _round(fitted.coalesce(min(shares, MOST_WORKERS)), net, weights, 0.02 / (r + 1))
    by_lang, threshold = _calibrated(rows.where("calibrates"), net)
    return ToxicityModel(net, by_lang, threshold)


def _scored(net: TextCnn, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for a, b in byte_slices(texts, SLICE):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in keep), pa.array(np.round(net.scores(texts[a:b]), 5))],
                    [*keep, "score"])
    return run


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", lang_col: str = "lang",
          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score, predicted (score >= 0.5) and flagged (score >= the threshold of the row's language).

    Only the text makes the score. Null and empty texts have no words: all filters answer 0. A null or
    unknown language takes the common threshold. Repeated rows get equal results.
    """
    spark = prepare(docs.sparkSession)
    net = spark.sparkContext.broadcast(model.net)
    own = (*keep, "__lang")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, F.col(lang_col).cast("string").alias("__lang"), utf8(text_col).alias("__text"))
    found = rows.mapInArrow(lambda batches: _scored(net.value, own)(batches), f"{fields}, __lang string, score double")
    cut = F.lit(model.threshold)
    if model.thresholds:
        by_lang = F.create_map(*[F.lit(x) for pair in model.thresholds.items() for x in pair])
        cut = F.coalesce(F.element_at(by_lang, F.coalesce("__lang", F.lit(""))), cut)
    return found.select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        (F.col("score") >= cut).alias("flagged"))


def by_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels of the four fifths of ``docs`` that are not held out, and score all rows."""
    prepare(docs.sparkSession)
    held = held_out(5, 0)
    model = train(docs.where(~held), labels.where(~held))
    return score(docs.withColumn("held_out", held), model, keep=("doc_id", "held_out"))
