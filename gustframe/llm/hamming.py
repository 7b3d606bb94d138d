"""Exact top-k search of binary codes by incremental multi-index hashing.

A code is cut into segments of about log2(codes) bits, each with an index of its own. For one query the radius r grows
from 0: all segment values within r bits are looked up, so that afterwards every code within segments * (r + 1) - 1 bits has
been seen; the search ends when the k-th verified distance lies within. Codes are dealt into blocks (a task each); queries
are sent to all blocks in sets of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustframe.llm.common import prepare, stored

K = 10
#: Bounds of a segment's bits.
LEAST_BITS, MOST_BITS = 4, 16
#: Distinct codes of a block, and distinct query codes that are sent out at once (8 MB at 64 bits).
BLOCK_CODES, QUERY_CODES = 1 << 15, 1 << 20
#: Queries that a task works on at a time.
QUERIES_AT_ONCE = 128

_MASKS: dict[tuple[int, int], np.ndarray] = {}


def masks(width: int, r: int) -> np.ndarray:
    """All values of ``width`` bits with r bits set."""
    if (width, r) not in _MASKS:
        _MASKS[width, r] = np.array([sum(1 << b for b in c) for c in combinations(range(width), r)], np.int64)
    return _MASKS[width, r]


def segment_widths(bits: int, codes: int) -> list[int]:
    """Bits of each segment: as many values as codes, so that a lookup finds about one code."""
    width = min(MOST_BITS, max(LEAST_BITS, codes.bit_length() - 1))
    count = -(-bits // width)
    return [bits // count + (i < bits % count) for i in range(count)]


def segments_of(codes: np.ndarray, widths: list[int]) -> np.ndarray:
    """(codes, segments): the value of each segment, from the lowest bit upward."""
    bits = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1, bitorder="little")
    ends = np.cumsum(widths)
    return np.stack([bits[:, e - w:e].astype(np.int64) @ (1 << np.arange(w)) for e, w in zip(ends, widths)], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class CodeIndex:
    """Multi-index over distinct codes (n, words) of 64-bit words of which ``bits`` count; ``held[i]`` rows have the
    i-th code."""

    def __init__(self, codes: np.ndarray, held: np.ndarray, bits: int | None = None):
        self.codes, self.held = codes, held
        self.widths = segment_widths(bits or codes.shape[1] * 64, len(codes))
        self.segments = len(self.widths)
        self.parts = segments_of(codes, self.widths)
        self.order = [np.argsort(self.parts[:, s], kind="stable") for s in range(self.segments)]
        self.starts = [np.searchsorted(self.parts[o, s], np.arange((1 << w) + 1)) for s, (o, w) in enumerate(zip(self.order, self.widths))]

    def _ring(self, queries: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) pairs whose nearest segment differs in exactly r bits, each once."""
        own = segments_of(queries, self.widths)
        found = [(np.zeros(0, np.int64),) * 2]
        for s, width in enumerate(self.widths):
            if r > width:
                continue
            value = own[:, s][:, None] ^ masks(width, r)[None, :]
            low, high = self.starts[s][value], self.starts[s][value + 1]
            count = (high - low).ravel()
            hit = np.flatnonzero(count)
            n = count[hit]
            q = np.repeat(hit // value.shape[1], n)
            at = np.repeat(low.ravel()[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            c = self.order[s][at]
            apart = np.bitwise_count(own[q] ^ self.parts[c]).astype(np.int64)
            first = (apart[:, :s] > r).all(axis=1) & (apart[:, s + 1:] >= r).all(axis=1)
            found.append((q[first], c[first]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _kth(self, q: np.ndarray, d: np.ndarray, c: np.ndarray, queries: int, k: int) -> np.ndarray:
        """Distance by which k rows are reached for each query; a large number where they are not."""
        out = np.full(queries, 1 << 30)
        order = np.lexsort((d, q))
        q, d, n = q[order], d[order], self.held[c[order]]
        total = np.cumsum(n)
        start = np.searchsorted(q, np.arange(queries))
        end = np.searchsorted(q, np.arange(queries), side="right")
        base = np.where(start > 0, total[np.maximum(start - 1, 0)], 0) if len(total) else np.zeros(queries, np.int64)
        at = np.searchsorted(total, base + k)
        done = at < end
        out[done] = d[at[done]]
        return out

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance) of all codes within the distance at which k rows are reached. ``rings`` then holds, for
        each query, the radius at which its search ended; only that of the widest segment has seen every code."""
        got = [(np.zeros(0, np.int64),) * 3]
        active = np.arange(len(queries))
        self.rings = np.zeros(len(queries), np.int64)
        r = 0
        while len(active) and r <= max(self.widths):
            a, c = self._ring(queries[active], r)
            got.append((active[a], c, distances(queries[active[a]], self.codes[c])))
            q, c, d = (np.concatenate(x) for x in zip(*got))
            kth = self._kth(q, d, c, len(queries), k)
            near = d <= kth[q]
            got = [(q[near], c[near], d[near])]
            self.rings[active] = r
            active = active[kth[active] > self.segments * (r + 1) - 1]
            r += 1
        return tuple(np.concatenate(x) for x in zip(*got))


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, code: the signs of a vector (1: above 0, NaN too; null elements: 0) in 64-bit words, the first element lowest.

    Rows with a null or empty vector are left out.
    """
    word = lambda w: F.aggregate(
        F.slice(F.transform(F.col(vector_col), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int")))
                            .otherwise(F.lit(0).cast("long"))), w * 64 + 1, 64),
        F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    words = F.transform(F.sequence(F.lit(0), F.floor((F.size(vector_col) - 1) / 64).cast("int")), word)
    return vectors.where(F.size(vector_col) > 0).select(F.col(id_col).cast("long").alias("id"), words.alias("code"))


def _block(queries, k: int, words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), None) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.combine_chunks()
        codes = pa.concat_arrays(table.column("code").chunks).flatten().to_numpy().reshape(-1, words).view(np.uint64)
        lists = pa.concat_arrays(table.column("ids").chunks)
        ids, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        held = np.diff(ends, prepend=0)
        index = CodeIndex(np.ascontiguousarray(codes), held, bits)
        wanted = queries.value
        for i in range(0, len(wanted), QUERIES_AT_ONCE):
            part = wanted[i:i + QUERIES_AT_ONCE]
            q, c, d = index.search(part, k)
            n = held[c]
            q, d, row = np.repeat(q, n), np.repeat(d, n), np.repeat(ends[c] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own = ids[row]
            order = np.lexsort((own, d, q))
            q, d, own = q[order], d[order], own[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            q, d, own = q[rank < k], d[rank < k], own[rank < k]
            lists_out = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * words, pa.int32()),
                                                 pa.array(part[q].view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([lists_out, pa.array(own), pa.array(d)], ["code", "neighbour", "distance"])
    return run


def top_k(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, rank, neighbour and distance: the ``k`` nearest rows by Hamming distance of the sign codes, for every
    row for which ``is_query`` (a condition on id_col) holds; ties go to the least id, the row's own id is no neighbour.

    Equal codes are one entry that keeps its k + 1 least ids, which is all that a result can name. Null
    ids, null and empty vectors, and vectors of another length than the most frequent one (of equally frequent ones the
    shorter) are neither found nor asked; repeated rows count once, and an id with several vectors has each of them. Other
    columns are not read, whatever their names. An empty table gives no rows. The driver holds QUERY_CODES query codes at
    a time; each block returns at most k + 1 rows for each of them.
    """
    spark = prepare(vectors.sparkSession)
    lengths = (vectors.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("rows"))
               .orderBy(F.desc("rows"), "d").first())
    bits = lengths.d if lengths else 1
    words = -(-bits // 64)
    rows = stored(sign_codes(vectors.where(F.size(vector_col) == bits), id_col, vector_col).where("id is not null").distinct(), "codes")
    least = Window.partitionBy("code").orderBy("id")
    entries = stored(rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
                     .groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "code-entries")
    asked = rows.where(is_query(F.col("id")))
    codes = asked.select("code").distinct()
    sets = max(1, -(-codes.count() // QUERY_CODES))
    codes = stored(codes.withColumn("set", F.pmod(F.xxhash64("code"), F.lit(sets)).cast("int")), "query-codes")
    blocks = entries.repartition(max(1, -(-entries.count() // BLOCK_CODES)), "code")
    if sets > 1:
        blocks = stored(blocks, "code-blocks")
    found = None
    for s in range(sets):
        own = np.array([r.code for r in codes.where(F.col("set") == s).select("code").collect()], np.int64).reshape(-1, words)
        shipped = spark.sparkContext.broadcast(np.ascontiguousarray(own).view(np.uint64))
        part = blocks.mapInArrow(lambda b, q=shipped: _block(q, k + 1, words, bits)(b), "code array<long>, neighbour long, distance long")
        found = part if found is None else found.union(part)
    near = Window.partitionBy("code").orderBy("distance", "neighbour")
    merged = stored(found.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1).drop("n"), "code-neighbours")
    own = Window.partitionBy("id").orderBy("distance", "neighbour")
    return (asked.join(merged, "code").where("neighbour <> id").withColumn("rank", F.row_number().over(own).cast("long"))
            .where(F.col("rank") <= k).select(F.col("id").alias(id_col), "rank", "neighbour", "distance"))
