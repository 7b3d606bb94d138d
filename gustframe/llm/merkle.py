"""Merkle manifest of a table by time-forward processing.

A node's digest is a message to its parent, and a priority queue ordered by node label delivers the messages. Leaves are
cut into blocks of 2**LEVELS positions. Inside a block the queue is a heap of a few messages, since a label is (last leaf
below the node, level) and a node is due as soon as that leaf is read. Messages that leave a block are rows; the sort of
Spark's exchange, which spills to disk, is the external part of the queue and brings them to the block of their parent.
Such rounds go upward until each group has one node, and then over the groups' nodes to the root. The reversed sweep goes
through the same rounds downward: the first message of a block is the proof suffix of its top node, and every leaf gets
its own siblings with that suffix behind them.

A proof is bytes: for each level NONE (no sibling), or LEFT or RIGHT and the 32 bytes of the sibling.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustframe.llm.common import prepare, stored

#: Levels of one round: a task holds a block of 2**LEVELS digests and a heap of about LEVELS messages.
LEVELS = 12
NONE, LEFT, RIGHT = b"\0", b"\1", b"\2"
SIZE = 32
OUT_ROWS = 4096


def digest_of(children: list[bytes]) -> bytes:
    """sha256 of the children's digests as lowercase hex text."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def height_of(nodes: int) -> int:
    """Levels above ``nodes`` nodes of one level until one is left."""
    return max(nodes - 1, 0).bit_length()


def sweep(leaves: list[bytes], levels: int) -> list[list[bytes]]:
    """Digests of all nodes above a block's leaves, by level, from messages taken in the order of labels."""
    out: list[list[bytes]] = [leaves] + [[] for _ in range(levels)]
    queue: list[tuple[int, int, int, bytes]] = []

    def post(level: int, index: int, digest: bytes) -> None:
        if level < levels:
            last = min(((index >> 1) + 1) << (level + 1), len(leaves)) - 1
            heapq.heappush(queue, (last, level + 1, index, digest))

    for i, leaf in enumerate(leaves):
        post(0, i, leaf)
        while queue and queue[0][0] == i:
            _, level, index, digest = heapq.heappop(queue)
            children = [digest]
            while queue and queue[0][:2] == (i, level):
                children.append(heapq.heappop(queue)[3])
            out[level].append(digest_of(children))
            post(level, index >> 1, out[level][-1])
    return out


def unsweep(nodes: list[list[bytes]], suffix: bytes) -> Iterator[tuple[int, bytes]]:
    """(position, proof) of each leaf, last leaf first: the labels in reverse, each node handing its children their
    sibling and its own proof."""
    levels = len(nodes) - 1
    queue = [(-(len(nodes[0]) - 1), -levels, 0, suffix)]
    while queue:
        _, level, index, proof = heapq.heappop(queue)
        if not level:
            yield index, proof
            continue
        below = nodes[-level - 1]
        for child in (2 * index, 2 * index + 1):
            if child < len(below):
                other = child ^ 1
                own = NONE if other >= len(below) else (LEFT if other < child else RIGHT) + below[other]
                last = min((child + 1) << (-level - 1), len(nodes[0])) - 1
                heapq.heappush(queue, (-last, level + 1, child, own + proof))


def steps(proof: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(side, sibling) per level, from the leaf upward; a level without a sibling has none."""
    at = 0
    while at < len(proof):
        side = proof[at:at + 1]
        at += 1
        yield side, b"" if side == NONE else proof[at:at + SIZE]
        at += 0 if side == NONE else SIZE


def folded(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof give."""
    for side, sibling in steps(proof):
        leaf = digest_of([sibling, leaf] if side == LEFT else [leaf, sibling])
    return leaf


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[dict]]]:
    """The rows of each (g, block), which come one after the other."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["g"], row["block"])
            if own != key:
                if rows:
                    yield key, rows
                key, rows = own, []
            rows.append(row)
    if rows:
        yield key, rows


def _chunks(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


NODE = pa.schema([("g", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
MESSAGE = pa.schema([("g", pa.int64()), ("block", pa.int64()), ("suffix", pa.binary()), ("subroot", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")),
                    ("verified", pa.bool_())])


def _up(levels: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (g, block), own in _blocks(batches):
                n = own[0]["n"]
                yield g, block, -(-n >> levels), sweep([r["digest"] for r in own], min(levels, height_of(n)))[-1][0]
        yield from _chunks(rows(), NODE)
    return run


def _opened(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[tuple[int, dict, list[dict], Iterator[tuple[int, bytes]]]]:
    """g, the message, the rows of the leaves and (position in the block, proof) of each."""
    for (g, _), (message, *own) in _blocks(batches):
        nodes = sweep([r["digest"] for r in own], min(levels, height_of(own[0]["n"])))
        yield g, message, own, unsweep(nodes, message["suffix"])


def _down(levels: int) -> Callable:
    """Messages to the blocks below: each node's proof goes to the block whose top it is."""
    return lambda batches: _chunks(((g, own[i]["pos"], proof, message["subroot"]) for g, message, own, found in _opened(batches, levels)
                                    for i, proof in found), MESSAGE)


def _across(levels: int) -> Callable:
    """Messages from the tree over the groups to the only block of each group's last round."""
    return lambda batches: _chunks(((own[i]["pos"], 0, proof, own[i]["digest"]) for _, _, own, found in _opened(batches, levels)
                                    for i, proof in found), MESSAGE)


def _finish(levels: int, root: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, message, own, found in _opened(batches, levels):
                for i, proof in found:
                    row = own[i]
                    again = folded(row["tampered"] or row["digest"], proof)
                    siblings = b"".join(s for _, s in steps(proof))
                    yield (row["doc_id"], row["digest"].hex(), message["subroot"].hex(), root.hex(),
                           digest_of([siblings]).hex(), again.hex(), again == root)
        yield from _chunks(rows(), RESULT)
    return run


def _round(levels: int, nodes: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """The rows of each block in one task, in the order of positions, a block's message before them."""
    rows = nodes.withColumn("block", F.shiftright("pos", levels))
    if messages is not None:
        rows = rows.unionByName(messages.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    return (rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "block")
            .sortWithinPartitions("g", "block", "pos"))


def _tree(levels: int, nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes of each round from the leaves (g, pos, n, digest) to one node a group; ``most``: the largest group."""
    out = [nodes]
    while most > 1:
        below = _round(levels, out[-1].select("g", "pos", "n", "digest"))
        out.append(stored(below.mapInArrow(_up(levels), "g long, pos long, n long, digest binary"), "merkle-nodes"))
        most = -(-most >> levels)
    return out


def _placed(leaves: DataFrame, group: str, order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Leaves with g (rank of the group), pos (place in the group) and n (the group's size), and one row a group.

    Rows are dealt into ranges of (group, order, row), so neither a large group nor repeated rows make a large task;
    places come from a table with one row per range and group.
    """
    spark = leaves.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = (leaves.repartitionByRange(parts, group, *order, "row").sortWithinPartitions(group, *order, "row")
                .withColumn("__at", F.monotonically_increasing_id()))
    ranked = stored(in_order.withColumns({"__part": F.shiftright("__at", 33), "__at": F.expr("__at & 8589934591")}), "merkle-order")
    spans = ranked.groupBy("__part", group).agg(F.count("*").alias("rows"), F.min("__at").alias("first"))
    in_group = Window.partitionBy(group).orderBy("__part")
    spans = (spans.withColumn("before", F.coalesce(F.sum("rows").over(in_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("n", F.sum("rows").over(Window.partitionBy(group))))
    spans = stored(spans, "merkle-spans")
    opens = spans.where("before = 0").withColumn("here", F.row_number().over(Window.partitionBy("__part").orderBy(F.col(group).asc_nulls_first())))
    # one row per range: bounded by the number of shuffle partitions
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = opens.groupBy("__part").agg(F.count("*").alias("groups")).withColumn("base", F.coalesce(F.sum("groups").over(earlier), F.lit(0)))
    groups = stored(opens.join(bases, "__part").select(F.col(group).alias("__group"), (F.col("base") + F.col("here") - 1).alias("g"), "n"),
                    "merkle-groups")
    spans = (spans.join(groups.select("__group", "g"), F.col(group).eqNullSafe(F.col("__group")))
             .select(F.col("__part").alias("__p"), "__group", "g", "n", (F.col("before") - F.col("first")).alias("shift")))
    placed = (ranked.join(spans, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__group")))
              .withColumn("pos", F.col("__at") + F.col("shift")).drop("__part", "__p", "__group", "__at", "shift", "row"))
    return placed, groups


def sized(col: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*cols: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[sized(c) for c in cols]), 256))


def manifest(rows: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang",
             id_col: str = "doc_id", tampered_field: str = "n_chars", is_tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row (hex digests).

    A leaf is the digest of ``fields``. In each ``group`` leaves go by ascending id (null first; rows that repeat an id by
    their digest, so equal rows are interchangeable); groups go null first, then bytewise. Where ``is_tampered`` holds, the
    checked leaf has one added to ``tampered_field`` (a null stays). Texts are hashed where they are read, whatever
    their length, and only digests travel. Null fields count as ``-``; other columns are not read, whatever their names. An
    empty table gives no rows.
    """
    spark = prepare(rows.sparkSession)
    plus = [F.col(c).cast("decimal(38,0)") + 1 if c == tampered_field else F.col(c) for c in fields]
    changed = F.coalesce(is_tampered, F.lit(False)) if is_tampered is not None else F.lit(False)
    leaves = stored(rows.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(group).cast("string").alias("lang"),
        leaf_digest(*[F.col(c) for c in fields]).alias("digest"),
        F.when(changed & F.col(tampered_field).isNotNull(), leaf_digest(*plus)).alias("tampered"),
        F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    placed, groups = _placed(leaves, "lang", ("doc_id", "digest"))
    count, most = groups.agg(F.count("*"), F.max("n")).first()
    if not count:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                         "folded_root string, verified boolean")
    rounds = _tree(levels, placed, most)
    tops = rounds[-1].select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(count).cast("long").alias("n"), "digest")
    over = _tree(levels, tops, count)
    root = bytes(over[-1].select("digest").first()[0])
    suffix = "g long, block long, suffix binary, subroot binary"
    messages = spark.createDataFrame([(0, 0, b"", None)], suffix)
    for nodes in reversed(over[1:-1]):
        messages = stored(_round(levels, nodes, messages).mapInArrow(_down(levels), suffix), "merkle-proofs")
    messages = stored(_round(levels, over[0], messages).mapInArrow(_across(levels), suffix), "merkle-proofs")
    for nodes in reversed(rounds[1:-1]):
        messages = stored(_round(levels, nodes, messages).mapInArrow(_down(levels), suffix), "merkle-proofs")
    return _round(levels, rounds[0].select("g", "pos", "n", "digest", "doc_id", "tampered"), messages).mapInArrow(
        _finish(levels, root), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
