"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all benchmark items, and one
scan of every text; hits are mapped back to places in the original text.

The automaton's letters are words: the vocabulary of the benchmark is numbered, a text becomes one
character per word (an unknown word is the character 0), and the automaton reads that string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.llm.common import byte_slices, prepare, utf8, widened
from gustframe.llm.wordhash import ASCII_NO_WORD, WordHasher

WINDOW = 10
#: Characters of benchmark text in one automaton (about 150 MB of memory); larger benchmarks are scanned part after part.
PART_CHARS = 1 << 20
#: All benchmark text goes to every task, so its size is checked.
MOST_CHARS = 256 << 20
SLICE = 8 << 20
WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Windows:
    """Automaton over the windows of some items: (item id as string, text bytes)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.hasher = WordHasher(ASCII_NO_WORD)
        words, counts = self.hasher.words([t for _, t in items])
        self.vocabulary = np.unique(words)
        line = self.letters(words)
        owners: dict[str, set[str]] = {}
        at = 0
        for (item, _), n in zip(items, counts.tolist()):
            size = min(window, n)
            for i in range(at, at + n - size + 1 if n else at):
                owners.setdefault(line[i:i + size], set()).add(item)
            at += n
        self.automaton = ahocorasick.Automaton()
        for key, found in owners.items():
            self.automaton.add_word(key, (len(key), tuple(found)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def letters(self, words: np.ndarray) -> str:
        """One character per word: its number in the vocabulary plus 1 (surrogates are jumped over), 0 if unknown."""
        if not len(self.vocabulary):
            return "\0" * len(words)
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        code = np.where(self.vocabulary[at] == words, at + 1, 0)
        code += np.where(code >= 0xD800, 0x800, 0)
        return code.astype("<u4").tobytes().decode("utf-32-le")

    def scan(self, line: str) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of all occurrences (merged, in order), and the items they belong to."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        for last, (size, found) in self.automaton.iter(line):
            start = last - size + 1
            while ranges and ranges[-1][1] >= start:
                start = min(start, ranges.pop()[0])
            ranges.append((start, last + 1))
            items.update(found)
        return ranges, items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(parts: list[list[tuple[str, bytes]]], window: int, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Windows] | None = None
        plain = WordHasher(ASCII_NO_WORD)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for a, b in byte_slices(texts, SLICE):
                words, counts = plain.words(texts[a:b])
                ends = np.cumsum(counts)
                ranges: list[list] = [[] for _ in range(b - a)]
                items: list[set] = [set() for _ in range(b - a)]
                for k, part in enumerate(parts):
                    if held is None or held[0] != k:
                        held = k, Windows(part, window)
                    if held[1].empty:
                        continue
                    line = held[1].letters(words)
                    for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist())):
                        got, found = held[1].scan(line[end - n:end])
                        if got:
                            ranges[i] = merge(ranges[i] + got)
                            items[i] |= found
                digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
                passages = []
                for i, got in enumerate(ranges):
                    at = [m.span() for m in WORD.finditer(texts[a + i].decode("utf-8", "replace"))] if got else []
                    passages.append([{"start": at[x][0], "end": at[y - 1][1]} for x, y in got])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in keep), pa.array(counts), pa.array([sum(y - x for x, y in r) for r in ranges], pa.int64()),
                     pa.array([len(x) for x in items], pa.int64()), pa.array(digests),
                     pa.array(passages, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    [*keep, "n_words", "n_hit", "n_items", "items_sha256", "passages"])
    return run


def benchmark_parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[list[tuple[str, bytes]]]:
    """The items, gathered in parts of PART_CHARS; more than MOST_CHARS in all is an error, never a cut."""
    total = benchmark.agg(F.sum(F.length(text_col))).first()[0] or 0
    if total > MOST_CHARS:
        raise ValueError(f"the benchmark has {total} characters, more than {MOST_CHARS}: scan it in several calls")
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), utf8(text_col).alias("text"))
    parts: list[list[tuple[str, bytes]]] = [[]]
    held = 0
    for row in sorted((r.item, bytes(r.text)) for r in items.distinct().toLocalIterator()):
        if held and held + len(row[1]) > PART_CHARS:
            parts.append([])
            held = 0
        parts[-1].append(row)
        held += len(row[1])
    return parts


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words, n_hit, n_items, items_sha256, contaminated and passages for every row of ``docs``.

    Words are runs of digits, letters A-Z (lower-cased) and characters beyond ASCII. A window is
    ``window`` consecutive words of an item; an item with fewer, but some, is one window. A word of a
    text inside any occurrence of a window is hit. passages: the hit words' places in the original
    text (code points, end exclusive), neighbours joined. Null and empty texts have no words; items
    without words match nothing; repeated items count once per id; a null item id reads as "".
    """
    spark = prepare(docs.sparkSession)
    parts = benchmark_parts(benchmark)
    shipped = spark.sparkContext.broadcast(parts)
    run = lambda batches: _scan(shipped.value, window, keep)(batches)
    found = docs.select(*keep, utf8(text_col).alias("__text")).mapInArrow(
        run, widened(docs, keep, "n_words long, n_hit long, n_items long, items_sha256 string, "
                                 "passages array<struct<start:int,end:int>>"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)
