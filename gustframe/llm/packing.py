"""Best-fit packing of token pieces into sequences, with certified bin counts.

Pieces are dealt by hash into groups of about PART rows; each group is packed by best-fit decreasing, and dual-feasible
functions bound its bin count from below. While the whole table has more sequences than its own bound, groups with room
give up the documents of their roomiest bins; these are dealt into fewer groups and packed again, and the new packing is
taken if it needs fewer sequences. A round handles at most a quarter of the round before, or one group's rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.llm.binpack import best_fit_decreasing, lower_bound
from gustframe.llm.common import byte_slices, prepare, stored, utf8
from gustframe.llm.encoding import LowerWordBpe, encoder_of

TOKENIZER = "word_bpe_49k.json"
CAPACITY, END_ID = 2048, 0
#: Rows of a group, which one task packs.
PART = 1 << 15
#: The next round takes 1 / FEWER of the rows at most.
FEWER = 4
SLICE = 4 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(LowerWordBpe, tokenizer)
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("doc_id")
            for a, b in byte_slices(texts, SLICE):
                rows: list[int] = []
                places: list[int] = []
                sizes: list[int] = []
                crcs: list[int] = []
                for i, own in enumerate(encoder.encode([t.decode("utf-8", "replace") for t in texts[a:b]]), a):
                    ids = np.append(np.frombuffer(own, encoder.kind), [end_id]).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        part = ids[start:start + capacity]
                        rows.append(i)
                        places.append(start)
                        sizes.append(len(part))
                        crcs.append(zlib.crc32(part))
                starts = np.array(places, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(rows)), batch.column("row").take(pa.array(rows)), pa.array((starts // capacity).astype(np.int32)),
                     pa.array(starts), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "row", "piece", "start", "length", "ids_crc32"])
    return run


def pieces_of(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a number of the document's row), piece, start, length and ids_crc32 of every piece of every text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), utf8(text_col).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, capacity, end_id),
                           "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def _packed(capacity: int, first: int):
    """One group: bins by best fit, the room of each piece's bin, and whether the bound equals the number of bins."""
    def run(key, group):
        lengths = group.column("length").to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        filled = np.bincount(bins, lengths, used).astype(np.int64)
        certified = used == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        for name, column in (("sequence_id", pa.array(((first + key[0].as_py()) << 32) + bins)), ("offset", pa.array(offsets)),
                             ("room", pa.array(capacity - filled[bins])), ("certified", pa.array(np.full(len(bins), certified)))):
            group = group.append_column(name, column)
        return group.drop_columns(["deal"])
    return run


def _pack(rows: DataFrame, groups: int, first: int, capacity: int) -> DataFrame:
    """``rows`` dealt into ``groups`` groups, which count from ``first``, and packed; written and read again."""
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("row", "piece", F.lit(first)), F.lit(groups)))
    out = dealt.groupBy("deal").applyInArrow(_packed(capacity, first), f"row long, {PIECE}, sequence_id long, offset long, room long, certified boolean")
    return stored(out, "packing")


def _by_room(packed: DataFrame) -> list[tuple[int, int, int]]:
    """(room, bins, pieces) by falling room: at most capacity + 1 rows."""
    rows = packed.groupBy("room").agg(F.sum((F.col("offset") == 0).cast("long")).alias("bins"), F.count("*").alias("pieces")).collect()
    return sorted(((r.room, r.bins, r.pieces) for r in rows), reverse=True)


def pack(pieces: DataFrame, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """``pieces`` (row, doc_id, piece, start, length from 1 to ``capacity``, ids_crc32) with sequence_id, offset and
    certified: whether the bound of its group's bin count, or of the whole table's, is reached."""
    prepare(pieces.sparkSession)
    columns = ["row", *(f.split()[0] for f in PIECE.split(", "))]
    pieces = stored(pieces.select(*columns), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = sum(counts.values())
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[list(counts)] = list(counts.values())
    least = lower_bound(histogram, capacity)
    groups = max(1, -(-rows // part))
    active, settled, first = _pack(pieces, groups, 0, capacity), [], 0
    rooms = _by_room(active)
    total = sum(b for _, b, _ in rooms)
    while total > least and groups > 1:
        budget, theta, moved, bins = max(part, rows // FEWER), capacity, 0, 0
        for room, b, p in rooms:                                    # the roomiest bins that the budget allows, one room at least
            if room == 0 or moved and moved + p > budget:
                break
            theta, moved, bins = room, moved + p, bins + b
        first, rows = first + groups, moved
        groups = max(1, -(-moved // part))
        if bins < 2:
            break
        again = _pack(active.where(F.col("room") >= theta).select(*columns), groups, first, capacity)
        after = _by_room(again)
        if (now := sum(b for _, b, _ in after)) < bins:
            settled.append(active.where(F.col("room") < theta))
            active, rooms, total = again, after, total - bins + now
    whole = reduce(DataFrame.unionByName, settled, active)
    return whole.select(*columns, "sequence_id", "offset", (F.col("certified") | F.lit(total == least)).alias("certified"))


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and certified of every piece of ``docs``.

    Only documents of more than ``capacity`` ids are cut. Null and empty texts are the end id alone; a long text has many
    pieces; repeated rows and ids are documents of their own; other columns are not read, whatever their names. An empty
    table gives no rows.
    """
    prepare(docs.sparkSession)
    return pack(pieces_of(docs, tokenizer, capacity, end_id), capacity).drop("row")
