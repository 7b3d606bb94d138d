"""Token-ID output: shards of one concatenated id array each, with Elias-Fano coded document ends and ids.

File (little endian): MAGIC, then HEADER (partition, shard, bytes per id, documents, documents without
an id, tokens, least doc_id), the ids, the code of the documents' ends in the id array, the code of
doc_id minus the least doc_id. Documents without a doc_id come first. Shards by (partition, shard) hold
the documents in ascending order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustframe.llm import eliasfano
from gustframe.llm.common import byte_slices, new_folder, prepare, stored, utf8
from gustframe.llm.encoding import ByteBpe, encoder_of

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Ids of one shard (a document is never cut, so a shard may exceed it by one document).
SHARD_TOKENS = 4 << 20
SLICE = 4 << 20
MAGIC, HEADER = b"GFTOKID1", "<IIIIQQq"


def write_shard(partition: int, shard: int, id_bytes: int, doc_ids: list, sizes: list[int], ids: bytes) -> bytes:
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    head = struct.pack(HEADER, partition, shard, id_bytes, len(doc_ids) - len(known), len(doc_ids), sum(sizes), least)
    gaps = np.array([d - least for d in known], np.uint64)
    return MAGIC + head + ids + eliasfano.encode(np.cumsum(sizes, dtype=np.uint64)) + eliasfano.encode(gaps)


class Shard:
    """One file's documents, found by select: no table of their offsets is built, whatever their number."""

    def __init__(self, data: bytes):
        if data[:len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        (self.partition, self.shard, id_bytes, self.unnamed, self.documents, self.tokens,
         self.least) = struct.unpack_from(HEADER, data, len(MAGIC))
        at = len(MAGIC) + struct.calcsize(HEADER)
        self.ids = np.frombuffer(data, f"<u{id_bytes}", self.tokens, at)
        rest = memoryview(data)[at + self.tokens * id_bytes:]
        self.ends = eliasfano.EliasFano(rest)
        self.names = eliasfano.EliasFano(rest[self.ends.size:])

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0:self.ends.select(i)]

    def ends_of(self, first: int, last: int) -> np.ndarray:
        """Where the documents ``first`` to ``last`` - 1 end in the id array."""
        return self.ends.select_run(first, last).astype(np.int64)

    def doc_ids(self, first: int, last: int) -> list:
        known = max(first - self.unnamed, 0), max(last - self.unnamed, 0)
        return [None] * (min(last, self.unnamed) - min(first, self.unnamed)) + \
            [self.least + int(x) for x in self.names.select_run(*known)]


def _save(folder: str, name: str, data: bytes) -> None:
    """Write under a name of its own, then rename: a task that runs twice leaves one whole file."""
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{path}/{name}")


def _load(folder: str, name: str) -> bytes:
    store, path = pafs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}") as file:
        return file.read()


def _name(partition: int, shard: int) -> str:
    return f"part-{partition:06d}-{shard:06d}.tok"


def _write(folder: str, tokenizer: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ByteBpe, tokenizer)
        end = np.array([end_id], encoder.kind).tobytes()
        partition, shard = TaskContext.get().partitionId(), 0
        names: list = []
        sizes: list[int] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            _save(folder, _name(partition, shard), write_shard(partition, shard, encoder.id_bytes, names, sizes, b"".join(held)))
            return pa.RecordBatch.from_arrays(
                [pa.array([partition]), pa.array([shard]), pa.array([len(names)]), pa.array([sum(sizes)])],
                ["partition", "shard", "documents", "tokens"])

        total = 0
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in byte_slices(texts, SLICE):
                for doc_id, own in zip(ids[a:b], encoder.encode([t.decode("utf-8", "replace") for t in texts[a:b]])):
                    names.append(doc_id)
                    sizes.append(len(own) // encoder.id_bytes + 1)
                    held += (own, end)
                    total += sizes[-1]
                    if total >= shard_tokens:
                        yield flush()
                        shard, total, names, sizes, held = shard + 1, 0, [], [], []
        if names:
            yield flush()
    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts to ``folder`` (in a store that driver and executors share); returns the
    manifest: partition, shard, documents, tokens and start (ids of all shards before), one row a file.

    Rows go by ascending doc_id (null first; ties by text) into ranges of rows, of which equal rows may take several; a
    null or empty text is the end id alone. A long text is one document of its shard. Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    ordered = (rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
               .repartitionByRange(parts, "doc_id", "tie", "row")
               .sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text"))
    manifest = stored(ordered.mapInArrow(_write(folder, tokenizer, end_id, shard_tokens),
                                         "partition long, shard long, documents long, tokens long"), "token-manifest")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    totals = (manifest.groupBy("partition").agg(F.sum("tokens").alias("all"))
              .withColumn("base", F.coalesce(F.sum("all").over(before().orderBy("partition")), F.lit(0))))
    return (manifest.withColumn("own", F.coalesce(F.sum("tokens").over(before("partition").orderBy("shard")), F.lit(0)))
            .join(totals.select("partition", "base"), "partition")
            .select("partition", "shard", "documents", "tokens", (F.col("base") + F.col("own")).alias("start")))


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(_load(folder, _name(row["partition"], row["shard"])))
                before = 0
                for first in range(0, shard.documents, eliasfano.STEP):
                    last = min(first + eliasfano.STEP, shard.documents)
                    ends = shard.ends_of(first, last)
                    starts = np.concatenate([[before], ends[:-1]])
                    before = int(ends[-1])
                    crc = [zlib.crc32(shard.ids[a:b].astype("<u4")) for a, b in zip(starts, ends)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids(first, last), pa.int64()), pa.array(starts + row["start"]),
                         pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, one file in memory at a time."""
    spark = manifest.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (manifest.select("partition", "shard", "start").repartition(parts, "partition", "shard")
            .mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_output(docs: DataFrame, folder: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write ``docs`` as token shards and read them back: one row per document (see ``read_tokens``).

    Repeated rows are written as often as they come; an empty table writes no file and gives no rows.
    """
    folder = folder or new_folder(docs.sparkSession, "token-shards")
    return read_tokens(write_tokens(docs, folder, tokenizer), folder)
