"""Quality classifier by positive-unlabelled learning: a small network on the form of a text, trained in numpy on
the non-negative unbiased risk of trusted positives, unlabelled texts and an estimated class prior."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.llm.common import byte_slices, first_by_hash, held_out, prepare, texts_of, utf8
from gustframe.llm.wordhash import ASCII_SPACE, WordHasher, mix

#: Bounds of the training sample.
POSITIVES, UNLABELLED = 4000, 8000
HIDDEN = 24
SEGMENT = 512
SLICE = 4 << 20
CLASSES = ("upper", "lower", "digit", "space", "line", "stop", "mark", "sign", "frame", "other", "beyond")


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.int64)
    for name, members in (("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", b"abcdefghijklmnopqrstuvwxyz"),
                          ("digit", b"0123456789"), ("space", b" \t"), ("line", b"\r\n"), ("stop", b".,;:"), ("mark", b"!?"),
                          ("sign", b"#$%&*@"), ("frame", b"|<>{}[]/\\_=+~^")):
        table[list(members)] = CLASSES.index(name)
    table[128:] = CLASSES.index("beyond")
    return table


CLASS_OF = _class_table()
N_FEATURES = 3 * len(CLASSES) + 8


class Features:
    """Numbers that describe whole texts: byte classes (mean, and extremes over segments) and repetition of words."""

    def __init__(self):
        self.hasher = WordHasher(ASCII_SPACE)

    def of(self, texts: list[bytes]) -> np.ndarray:
        n, k = len(texts), len(CLASSES)
        out = np.zeros((n, N_FEATURES))
        sizes = np.fromiter(map(len, texts), np.int64, n)
        buffer = CLASS_OF[np.frombuffer(b"".join(texts), np.uint8)]
        segments = np.maximum(1, -(-sizes // SEGMENT))
        first = np.concatenate([[0], np.cumsum(segments)[:-1]])
        start = np.cumsum(sizes) - sizes
        place = np.arange(len(buffer)) - np.repeat(start, sizes)
        segment = np.repeat(first, sizes) + place // SEGMENT
        counts = np.bincount(segment * k + buffer, minlength=int(segments.sum()) * k).reshape(-1, k).astype(float)
        share = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
        out[:, :k] = np.add.reduceat(counts, first, axis=0) / np.maximum(1, sizes)[:, None] if n else 0
        out[:, k:2 * k] = np.maximum.reduceat(share, first, axis=0) if n else 0
        out[:, 2 * k:3 * k] = np.minimum.reduceat(share, first, axis=0) if n else 0
        words, number = self.hasher.words(texts)
        ends = np.cumsum(number)
        for i, (end, m) in enumerate(zip(ends.tolist(), number.tolist())):
            w = words[end - m:end]
            row = out[i, 3 * k:]
            row[0], row[1] = np.log1p(sizes[i]), np.log1p(m)
            row[2] = sizes[i] / (m + 1)
            if m > 1:
                row[3] = (w[1:] == w[:-1]).mean()
                two = mix(w[1:] * np.uint64(3) + w[:-1])
                row[4] = 1 - len(np.unique(two)) / len(two)
                row[5] = 1 - len(np.unique(w)) / m
            if m > 4:
                five = mix(((w[4:] * np.uint64(3) + w[3:-1]) * np.uint64(5) + w[2:-2]) * np.uint64(7) + w[1:-3] * np.uint64(11) + w[:-4])
                row[6] = 1 - len(np.unique(five)) / len(five)
            row[7] = m > 0
        return out


@dataclass(frozen=True)
class QualityModel:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((np.clip((x - self.mean) / self.scale, -6, 6)) @ a + b) @ c + d


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 3000, batch: int = 256,
          rate: float = 0.005, decay: float = 1e-4, seed: int = 11) -> tuple:
    """Weights that minimise prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the sigmoid loss.

    Where the estimate of the negative risk falls below 0 the step climbs that part instead, so it cannot
    be overfitted.
    """
    rng = np.random.default_rng(seed)
    k = positive.shape[1]
    layers = [rng.normal(0, 1 / np.sqrt(k), (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    first, second = ([np.zeros_like(p) for p in layers] for _ in range(2))
    for r in range(rounds):
        p = positive[rng.integers(0, len(positive), batch)]
        u = unlabelled[rng.integers(0, len(unlabelled), 2 * batch)]
        x = np.concatenate([p, u])
        h = np.tanh(x @ layers[0] + layers[1])
        s = 1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -30, 30)))
        slope = s * (1 - s)
        is_p = np.arange(len(x)) < batch
        negative = s[~is_p].mean() - prior * s[is_p].mean()              # loss of "negative" is s, of "positive" 1 - s
        d_negative = np.where(is_p, -prior / batch, 0.5 / batch) * slope
        d_positive = np.where(is_p, -prior / batch, 0.0) * slope
        err = d_positive + d_negative if negative >= 0 else -d_negative
        back = np.outer(err, layers[2]) * (1 - h * h)
        grads = [x.T @ back + decay * layers[0], back.sum(axis=0), h.T @ err + decay * layers[2], err.sum(keepdims=True)]
        for i, g in enumerate(grads):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.001 * (g * g - second[i])
            layers[i] = layers[i] - rate * min(1.0, 2 * (rounds - r) / rounds) * (first[i] / (1 - 0.9 ** (r + 1))) / (
                np.sqrt(second[i] / (1 - 0.999 ** (r + 1))) + 1e-8)
    return tuple(layers)


def _features(keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for a, b in byte_slices(texts, SLICE):
                x = features.of(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in keep), lists], [*keep, "features"])
    return run


def with_features(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, utf8(text_col).alias("__text")).mapInArrow(_features(keep), f"{fields}, features array<double>")


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES,
          unlabelled: int = UNLABELLED) -> QualityModel | None:
    """Fit on at most ``positives`` rows with quality 1 and ``unlabelled`` rows of any kind, each the first in the
    order of a hash of the id. ``prior``: the share of good texts; by default estimated as that among
    all ``labels`` rows. None without positives or texts."""
    marks = labels.where("quality is not null").select("doc_id", "quality")
    if prior is None:
        prior = marks.agg(F.avg("quality")).first()[0]
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    trusted = ids.join(marks.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    web, good = (texts_of(docs, first_by_hash(x, n, "quality")) for x, n in ((ids, unlabelled), (trusted, positives)))
    x_u, x_p = (np.array([r.features for r in with_features(x, ("doc_id",)).select("features").collect()]) for x in (web, good))
    if not len(x_u) or not len(x_p):
        return None
    prior = float(min(max(prior, 0.01), 0.99))
    mean, scale = x_u.mean(axis=0), x_u.std(axis=0) + 1e-6
    scaled = [np.clip((x - mean) / scale, -6, 6) for x in (x_p, x_u)]
    return QualityModel(prior, mean, scale, nn_pu(*scaled, prior))


def _scored(model: QualityModel | None, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for a, b in byte_slices(texts, SLICE):
                logit = model.logits(features.of(texts[a:b])) if model else np.zeros(b - a)
                own = np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 5)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in keep), pa.array(own)], [*keep, "score"])
    return run


def score(docs: DataFrame, model: QualityModel | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score and predicted (score >= 0.5) for every row; only the text makes the score.

    Null and empty texts are scored like any other (all shares 0). Without a model every score is 0.5.
    Repeated rows get equal results.
    """
    prepare(docs.sparkSession)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, utf8(text_col).alias("__text"))
    return rows.mapInArrow(_scored(model, keep), f"{fields}, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def by_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the two thirds of ``docs`` that are not held out, and score all rows."""
    prepare(docs.sparkSession)
    held = held_out(3, 1)
    model = train(docs.where(~held), labels.where(~held))
    return score(docs.withColumn("held_out", held), model, keep=("doc_id", "held_out"))
