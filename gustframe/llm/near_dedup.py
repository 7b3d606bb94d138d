"""Near-duplicate documents by min-max hashing, with every link confirmed on the full shingle sets.

1. One pass over the texts: shingle set size, set fingerprint, band keys, set parity.
2. Rows with the same set are one node, so a group of exact copies never pairs up. A node is named by its least doc_id
   and the hash of that row's text: a doc_id that is repeated with other texts stands for several nodes, all linked.
3. Every band bucket links its members to its least node (a star: members - 1 pairs, no matter how
   large). Pairs that sizes, estimate and parity allow are confirmed on the full sets.
4. Buckets whose members are not one component yet are compared in blocks of BLOCK nodes, in numpy,
   across components only; only pairs that the same tests allow leave the task, to be confirmed too.
5. Components of all confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.llm import minmax
from gustframe.llm.common import byte_slices, prepare, stored, utf8
from gustframe.llm.components import components
from gustframe.llm.wordhash import WordHasher

PERCENT = 85
#: Nodes of one block; a comparison task holds two blocks.
BLOCK = 256
SLICE = 8 << 20
#: Bits that say which nodes' texts are asked for: one in 46 other texts passes them for 730,000 nodes.
MARKS = 1 << 25

#: A pair of nodes: doc_id and text hash of both.
_PAIR = ("a", "ta", "b", "tb")
_PAIRS = "a long, ta long, b long, tb long"
_SIGNATURE = "doc_id long, t long, n_shingles long, f1 long, f2 long, bands array<long>, parity array<long>"


def _lists(rows: list[np.ndarray], present: np.ndarray, width: int) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(np.where(present, width, 0))]).astype(np.int32)
    mask = pa.array(~present)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()), mask=mask)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        texts, ids, marks = batch.column("text").to_pylist(), batch.column("doc_id"), batch.column("t")
        for a, b in byte_slices(texts, SLICE):
            words, counts = hasher.words(texts[a:b])
            ends = np.concatenate([[0], np.cumsum(counts)])
            sizes, prints, bands, parities = np.zeros(b - a, np.int64), np.zeros((b - a, 2), np.uint64), [], []
            for i in range(b - a):
                s = minmax.shingles(words[ends[i]:ends[i + 1]])
                sizes[i] = len(s)
                if len(s):
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    prints[i] = whole >> 64, whole & (2**64 - 1)
                    bands.append(minmax.signature(s))
                    parities.append(minmax.parity(s))
            signed = prints.view(np.int64)
            some = sizes > 0
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), marks.slice(a, b - a), pa.array(sizes), pa.array(signed[:, 0]), pa.array(signed[:, 1]),
                 _lists(bands, some, minmax.BANDS), _lists(parities, some, minmax.PARITY_BITS // 64)],
                ["doc_id", "t", "n_shingles", "f1", "f2", "bands", "parity"])


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 1)


def _sizes_fit(a: str, b: str, percent: int):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _likely(percent: int):
    """Arrow function: keep the pairs that estimate and parity allow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = minmax.possible(batch.column("n_a").to_numpy(), _matrix(batch.column("parity_a")),
                                       batch.column("n_b").to_numpy(), _matrix(batch.column("parity_b")), percent)
                keep &= minmax.estimate(_matrix(batch.column("bands_a")),
                                        _matrix(batch.column("bands_b"))) >= minmax.LEAST_ESTIMATE
                yield batch.select(list(_PAIR)).filter(pa.array(keep))
    return run


def _cell_pairs(percent: int):
    """Arrow function over rows sorted by (key, ci, cj): the likely pairs of each cell.

    A pair that shares several buckets is looked at in the first of them only; pairs inside one
    component and pairs with the bucket's centre (already tested) are left out.
    """
    def pairs(cell: dict) -> np.ndarray:
        node, t, root, n = cell["node"], cell["t"], cell["root"], cell["n"]
        centre = (node == cell["center"]) & (t == cell["center_t"])
        bands, parity, block = cell["bands"], cell["parity"], cell["block"]
        left = np.flatnonzero(block == cell["ci"])
        right = np.flatnonzero(block == cell["cj"])
        same = cell["ci"] == cell["cj"]
        out = []
        for i in left[~centre[left]]:
            j = right[right > i] if same else right
            j = j[(root[j] != root[i]) & ~centre[j]]
            j = j[np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * percent]
            if not len(j):
                continue
            j = j[minmax.possible(n[i], parity[i][None, :], n[j], parity[j], percent)]
            shared = bands[j] == bands[i]
            j = j[bands[i][shared.argmax(axis=1)] == cell["key"]]
            j = j[minmax.estimate(bands[j], np.broadcast_to(bands[i], (len(j), minmax.BANDS)).copy()) >= minmax.LEAST_ESTIMATE]
            first = node[i] < node[j]               # the nodes differ, or they would have one root
            both = [(node[i], node[j]), (t[i], t[j])]
            (a, b), (ta, tb) = [(np.where(first, x, y), np.where(first, y, x)) for x, y in both]
            out.append(np.stack([a, ta, b, tb], axis=1))
        return np.concatenate(out) if out else np.zeros((0, len(_PAIR)), np.int64)

    def columns(table: pa.Table) -> dict:
        table = table.combine_chunks()
        one = {k: table.column(k).to_numpy() for k in ("key", "ci", "cj", "center", "center_t", "node", "t", "root", "n", "block")}
        return one | {k: _matrix(pa.concat_arrays(table.column(k).chunks)) for k in ("bands", "parity")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cells(table: pa.Table, last: bool):
            """Whole cells of the table; the last one may go on in the next batch."""
            c = columns(table)
            edge = np.flatnonzero((np.diff(c["key"]) != 0) | (np.diff(c["ci"]) != 0) | (np.diff(c["cj"]) != 0)) + 1
            bounds = [0, *edge.tolist(), table.num_rows]
            found = []
            for a, b in zip(bounds[:-1], bounds[1:] if last else bounds[1:-1]):
                cell = {k: v[a:b] for k, v in c.items()}
                found.append(pairs(cell | {k: int(cell[k][0]) for k in ("key", "ci", "cj", "center", "center_t")}))
            both = np.concatenate(found) if found else np.zeros((0, len(_PAIR)), np.int64)
            rest = [] if last else table.slice(bounds[-2]).to_batches()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in both.T.copy()], list(_PAIR)), rest

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                out, held = cells(pa.Table.from_batches(held), False)
                yield out
        if held:
            yield cells(pa.Table.from_batches(held), True)[0]
    return run


def _confirmed(percent: int):
    """Arrow function: the pairs whose full shingle sets link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        last_node, last_set = None, None

        def shingles(text: bytes) -> np.ndarray:
            return minmax.shingles(hasher.words([text])[0])

        for batch in batches:
            keep = []
            nodes = zip(batch.column("a").to_pylist(), batch.column("ta").to_pylist())
            for node, text_a, text_b in zip(nodes, batch.column("text_a"), batch.column("text_b")):
                if node != last_node:
                    last_node, last_set = node, shingles(text_a.as_py())
                keep.append(minmax.linked(last_set, shingles(text_b.as_py()), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that can join ``wanted`` on (doc_id, t): all that do, and the few others whose hash has a bit
    of theirs. At most MARKS / 64 words of bits are broadcast, however many nodes are wanted, and no text is shuffled."""
    mark = F.pmod(F.xxhash64("doc_id", "t"), F.lit(MARKS))
    place = [F.shiftright(mark, 6).alias("word"), (mark % 64).cast("int").alias("bit")]
    words = wanted.select(*place).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    return docs.select("*", *place).join(F.broadcast(words), "word").where(F.getbit("bits", F.col("bit")) == 1).select(*docs.columns)


def _texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each node of ``pairs``."""
    wanted = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("ta").alias("t")),
                                            F.struct(F.col("b").alias("doc_id"), F.col("tb").alias("t")))).alias("n")).select("n.*").distinct()
    return _marked(docs, wanted).join(wanted, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"])


def _links(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Confirm pairs on the whole texts of their nodes; (a, b) of those that link."""
    texts = stored(_texts(pairs, docs), "pair-texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("t").alias("ta"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("t").alias("tb"), F.col("text").alias("text_b"))
    return (pairs.join(right, ["b", "tb"]).join(left, ["a", "ta"]).select(*_PAIR, "text_a", "text_b")
            .mapInArrow(_confirmed(percent), "a long, b long"))


def _same_id(sig: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): the nodes of the sets that one doc_id has in several rows, each with the least of them."""
    sets = sig.where("n_shingles > 0 and doc_id is not null").select("doc_id", F.struct("f1", "f2").alias("f"))
    repeated = sets.groupBy("doc_id").agg(F.min("f").alias("lo"), F.max("f").alias("hi")).where("lo <> hi").select("doc_id")
    owned = (sets.join(repeated, "doc_id").distinct().select("doc_id", "f.*")
             .join(nodes.select("f1", "f2", "node"), ["f1", "f2"]).select("doc_id", "node").distinct())
    least = owned.groupBy("doc_id").agg(F.min("node").alias("a"))
    return owned.join(least, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    A text's set is its distinct 5-word shingles (words: runs without ASCII white space, A-Z lower-cased;
    fewer than five words: the whole sequence). Null and empty texts have an empty set and link with
    nothing. Rows that repeat a doc_id are one document: with the same text they get the same result, and other
    texts with words are linked through the id. Rows without a doc_id join no group: component_id
    is null unless a row with an id has the same set; then it is that row's. ``kept`` is true for the row
    whose id is its component's. Other columns are ignored; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
            .select("doc_id", F.xxhash64("text").alias("t"), "text"))
    sig = stored(rows.mapInArrow(_signatures, _SIGNATURE), "signatures")
    nodes = stored(
        sig.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2")
        .agg(F.min(F.struct("doc_id", "t")).alias("name"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
             F.first("parity").alias("parity"))
        .select("f1", "f2", F.col("name.doc_id").alias("node"), F.col("name.t").alias("t"), "n", "bands", "parity"), "nodes")

    members = nodes.select("node", "t", "n", F.posexplode("bands").alias("band", "key"))
    buckets = stored(members.groupBy("band", "key").agg(F.min(F.struct("node", "t")).alias("c"), F.count(F.lit(1)).alias("size"))
                     .where("size > 1").select("band", "key", F.col("c.node").alias("center"), F.col("c.t").alias("center_t"), "size"),
                     "buckets")
    in_bucket = stored(members.join(buckets, ["band", "key"])
                       .select("band", "key", "center", "center_t", "size", "node", "t", "n"), "members")

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("t").alias(f"t{x}"), F.col("n").alias(f"n_{x}"),
                                  F.col("bands").alias(f"bands_{x}"), F.col("parity").alias(f"parity_{x}"))
    star = in_bucket.where("node <> center").select(
        F.col("center").alias("a"), F.col("center_t").alias("ta"), F.col("node").alias("b"), F.col("t").alias("tb")).distinct()
    star = (star.join(side("b"), ["b", "tb"]).join(side("a"), ["a", "ta"]).where(_sizes_fit("n_a", "n_b", percent))
            .mapInArrow(_likely(percent), _PAIRS))
    texts = rows.where("doc_id is not null")
    links = stored(_links(stored(star, "star-pairs"), texts, percent).union(_same_id(sig, nodes)), "star-links")
    roots = stored(components(links), "roots")

    rooted = in_bucket.where("size > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_buckets = rooted.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    cells = (rooted.join(open_buckets.select("band", "key"), ["band", "key"])
             .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", "center", "center_t", "node", "t", "root", "n", "block", F.least("block", "other").alias("ci"),
                     F.greatest("block", "other").alias("cj")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    across = (cells.join(nodes.select("node", "t", "bands", "parity"), ["node", "t"])
              .repartition(parts, "key", "ci", "cj").sortWithinPartitions("key", "ci", "cj", "node", "t")
              .mapInArrow(_cell_pairs(percent), _PAIRS).distinct())
    more = stored(_links(stored(across, "block-pairs"), texts, percent), "block-links")
    roots = components(links.union(more))

    sets = (nodes.select("f1", "f2", "node").join(roots, "node", "left")
            .select("f1", "f2", F.coalesce("root", "node").alias("component_id")))
    return (sig.select("doc_id", "n_shingles", "f1", "f2")
            .join(sets, ["f1", "f2"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
