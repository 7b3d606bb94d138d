"""Order-dependent helpers that never put a whole key into one task: a segmented scan.

A window ``partitionBy(key).orderBy(ts)`` sends every row of a key to one task; with a hot key (a third of all rows)
that task is the job. Here rows are dealt into ranges of (key, full order), so a hot key, and a hot minute of it, takes as
many ranges as it needs. One pass inside each range gives the result up to what came before the range; a key can only
come from before in a range's first segment, so the carry is one row per range, whatever the number of keys. These rows
(at most one per shuffle partition) are folded in order and broadcast back.

The ranged rows are checkpointed once to ``spark.checkpoint.dir``: the pass and the carries must see the same ranges.

* ``sequence_lag``    previous row's values
* ``sequence_index``  1-based position of a row within its key, and the key size
* ``sequence_streak`` length of the run of true flags that ends at a row
* ``sequence_sum``    running sum of whole numbers
* ``sequence_asof``   last right row at or before each left row
* ``sequence_chain``  links of a chain of rows that keep a pause
* ``global_index``    position in a total order of all rows
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Columns that a pass adds beside its results: range, whether the row is the range's first or last, whether it is in the
#: range's first segment.
_MARKS = "_seq_part long, _seq_first boolean, _seq_last boolean, _seq_open boolean"


def _cols(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _ranges(df: DataFrame, *order: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


# --- the pass inside a range ----------------------------------------------------------------------------------------

def _behind(last: pa.RecordBatch | None, batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column with the row before the batch (null for the first batch) in front."""
    own = batch.column(name)
    head = pa.nulls(1, own.type) if last is None else last.column(name)
    return pa.concat_arrays([head, own])


def _changes(last: pa.RecordBatch | None, batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """True where a row has another key than the row before it."""
    out = np.zeros(batch.num_rows, bool)
    for k in keys:
        both = _behind(last, batch, k)
        a, b = both[1:], both[:-1]
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out |= other.to_numpy(zero_copy_only=False)
    if last is None:
        out[0] = True
    return out


class _Lag:
    def __init__(self, values: list[str], prefix: str):
        self.values, self.names = values, [prefix + v for v in values]

    def start(self) -> None:
        pass

    def step(self, last, batch, start, fresh) -> list[pa.Array]:
        at = pa.array(np.arange(batch.num_rows), mask=fresh)
        return [_behind(last, batch, v).take(at) for v in self.values]


class _Index:
    names = ["_seq_at"]

    def start(self) -> None:
        self.before = 0

    def step(self, last, batch, start, fresh) -> list[pa.Array]:
        at = np.arange(batch.num_rows) - start + np.where(start < 0, self.before, 1)
        self.before = int(at[-1])
        return [pa.array(at)]


class _Streak:
    names = ["_seq_run", "_seq_all"]

    def __init__(self, flag: str):
        self.flag = flag

    def start(self) -> None:
        self.run, self.whole = 0, True

    def step(self, last, batch, start, fresh) -> list[pa.Array]:
        n = np.arange(batch.num_rows)
        flag = pc.fill_null(batch.column(self.flag), False).to_numpy(zero_copy_only=False)
        miss = np.maximum.accumulate(np.where(flag, -1, n))
        run = n - np.maximum(miss, np.where(start < 0, -1, start - 1))
        earlier = (start < 0) & (miss < 0)
        run = run + np.where(earlier, self.run, 0)
        whole = np.where(start < 0, (miss < 0) & self.whole, miss < start)
        self.run, self.whole = int(run[-1]), bool(whole[-1])
        return [pa.array(run), pa.array(whole)]


class _Sum:
    names = ["_seq_sum"]

    def __init__(self, value: str):
        self.value = value

    def start(self) -> None:
        self.before = 0

    def step(self, last, batch, start, fresh) -> list[pa.Array]:
        total = np.cumsum(pc.fill_null(batch.column(self.value), 0).to_numpy(zero_copy_only=False))
        before = np.concatenate([[0], total])[np.maximum(start, 0)]
        out = total - before + np.where(start < 0, self.before, 0)
        self.before = int(out[-1])
        return [pa.array(out.astype(np.int64))]


class _Fill:
    names = ["_seq_fill"]

    def __init__(self, source: str):
        self.source = source

    def start(self) -> None:
        self.held = None

    def step(self, last, batch, start, fresh) -> list[pa.Array]:
        own = batch.column(self.source)
        both = pa.concat_arrays([pa.nulls(1, own.type) if self.held is None else self.held, own])
        n = np.arange(1, batch.num_rows + 1)
        at = np.maximum.accumulate(np.where(own.is_valid().to_numpy(zero_copy_only=False), n, 0))
        filled = both.take(pa.array(at, mask=(start >= 0) & (at <= start)))
        self.held = filled[-1:]
        return [filled]


def _pass(kind, keys: list[str]) -> Callable:
    """Every batch with the results of ``kind`` up to what came before the range, and the marks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, waiting, segments = TaskContext.get().partitionId(), None, None, 0
        kind.start()

        def marked(batch, results, opened, first, final) -> pa.RecordBatch:
            n = batch.num_rows
            at = np.arange(n)
            return pa.RecordBatch.from_arrays(
                [*batch.columns, *results, pa.array(np.full(n, part, np.int64)), pa.array(first & (at == 0)),
                 pa.array(final & (at == n - 1)), pa.array(opened)],
                [*batch.schema.names, *kind.names, "_seq_part", "_seq_first", "_seq_last", "_seq_open"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = _changes(last, batch, keys)
            start = np.maximum.accumulate(np.where(fresh, np.arange(batch.num_rows), -1))
            opened = segments + np.cumsum(fresh) == 1
            results = kind.step(last, batch, start, fresh)
            if waiting is not None:
                yield marked(*waiting, False)
            waiting = (batch, results, opened, last is None)
            segments += int(fresh.sum())
            last = batch.slice(batch.num_rows - 1)
        if waiting is not None:
            yield marked(*waiting, True)
    return run


def _folded(keys: list[str], schema: pa.Schema, out: Callable) -> Callable:
    """(range, carry) from the first and last rows of all ranges in order. ``out(row, carry)`` is what the last row of
    a range hands on, given the carry into the range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, before, found = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = [row[k] for k in keys]
                if row["_seq_first"]:
                    carry = state if before == own else None
                    found.append((row["_seq_part"], carry))
                if row["_seq_last"]:
                    state, before = out(row, carry), own
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], schema.field(i).type) for i in (0, 1)], schema=schema)
    return run


def _scan(df: DataFrame, keys: list[str], order: list[str], kind, results: list[StructField], used: list[str], carry: str,
          out: Callable) -> DataFrame:
    """Ranged rows with the results of ``kind``, the marks and ``_seq_carry`` (null where nothing came before)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = StructType(df.schema.fields + results + StructType.fromDDL(_MARKS).fields)
    marked = _ranges(df, *keys, *order).mapInArrow(_pass(kind, keys), schema).checkpoint(eager=True)
    edges = (marked.where("_seq_first or _seq_last").select(*keys, *used, *[f.name for f in StructType.fromDDL(_MARKS)])
             .repartition(1).sortWithinPartitions("_seq_part", F.col("_seq_last").cast("int")))       # two rows per range at most
    carried = StructType([StructField("_seq_part", schema["_seq_part"].dataType),
                          StructField("_seq_carry", schema[carry].dataType if carry in schema.names else StructType.fromDDL(f"x {carry}")[0].dataType)])
    carries = edges.mapInArrow(_folded(keys, to_arrow_schema(carried), out), carried)
    return marked.join(F.broadcast(carries), "_seq_part", "left")                                  # one row per range


# --- operators ------------------------------------------------------------------------------------------------------

def sequence_lag(df: DataFrame, keys, order, values, prefix: str = "prev_") -> DataFrame:
    """Add ``prefix+v`` = value of ``v`` on the previous row of the same key, in a total ``order`` within the key."""
    keys, order, values = _cols(keys), _cols(order), _cols(values)
    d = df.withColumn("_seq_own", F.struct(*values))
    results = [StructField(prefix + v, df.schema[v].dataType) for v in values]
    j = _scan(d, keys, order, _Lag(values, prefix), results, ["_seq_own"], "_seq_own", lambda row, carry: row["_seq_own"])
    return j.select(*df.columns, *[F.when(F.col("_seq_first"), F.col(f"_seq_carry.{v}")).otherwise(F.col(prefix + v)).alias(prefix + v)
                                   for v in values])


def sequence_index(df: DataFrame, keys, order, index_col: str = "seq_idx", size_col: str | None = "seq_n") -> DataFrame:
    """Add the 1-based position of each row within its key, and the number of the key's rows."""
    keys, order = _cols(keys), _cols(order)
    results = StructType.fromDDL("_seq_at long").fields
    j = _scan(df, keys, order, _Index(), results, ["_seq_at"], "long",
              lambda row, carry: row["_seq_at"] + ((carry or 0) if row["_seq_open"] else 0))
    at = F.col("_seq_at") + F.when(F.col("_seq_open"), F.coalesce("_seq_carry", F.lit(0))).otherwise(0)
    d = j.select(*df.columns, at.alias(index_col))
    if not size_col:
        return d
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size_col))
    return d.join(sizes, on=keys, how="inner").select(*df.columns, index_col, size_col)


def sequence_streak(df: DataFrame, keys, order, flag: str, out: str = "streak") -> DataFrame:
    """Length of the run of consecutive ``flag`` = true rows that ends at each row, per key."""
    keys, order = _cols(keys), _cols(order)
    results = StructType.fromDDL("_seq_run long, _seq_all boolean").fields
    j = _scan(df, keys, order, _Streak(flag), results, ["_seq_run", "_seq_all"], "long",
              lambda row, carry: row["_seq_run"] + ((carry or 0) if row["_seq_open"] and row["_seq_all"] else 0))
    run = F.col("_seq_run") + F.when(F.col("_seq_open") & F.col("_seq_all"), F.coalesce("_seq_carry", F.lit(0))).otherwise(0)
    return j.select(*df.columns, run.alias(out))


def sequence_sum(df: DataFrame, keys, order, value: str, out: str = "upto") -> DataFrame:
    """Sum of the whole numbers ``value`` over the rows of the key up to each row, the row included."""
    keys, order = _cols(keys), _cols(order)
    d = df.withColumn(value, F.col(value).cast("long"))
    results = StructType.fromDDL("_seq_sum long").fields
    j = _scan(d, keys, order, _Sum(value), results, ["_seq_sum"], "long",
              lambda row, carry: row["_seq_sum"] + ((carry or 0) if row["_seq_open"] else 0))
    total = F.col("_seq_sum") + F.when(F.col("_seq_open"), F.coalesce("_seq_carry", F.lit(0))).otherwise(0)
    return j.select(*df.columns, total.alias(out))


def sequence_asof(left: DataFrame, right: DataFrame, keys, left_t: Column, right_t: Column,
                  right_tie: str, right_cols, out: str = "_asof", time_type: str = "long") -> DataFrame:
    """For each ``left`` row, the last ``right`` row of the same key with ``right_t <= left_t``.

    ``left_t`` / ``right_t`` are numeric of ``time_type`` (e.g. micros; negate both for a forward lookup); ``right_tie`` breaks ties among
    right rows. Both sides become one sequence in which the last right row is carried forward: linear work, no pairs.
    Adds struct column ``out`` (null when no right row precedes).
    """
    keys = _cols(keys)
    found = F.struct(*[F.col(c) for c in right_cols])
    L = left.select(*[F.col(k) for k in keys], left_t.cast(time_type).alias("_aq_t"), F.lit(1).alias("_aq_kind"),
                    F.monotonically_increasing_id().alias("_aq_tie"),
                    F.lit(None).cast(right.select(found).schema[0].dataType).alias("_aq_r"),
                    F.struct(*[F.col(c) for c in left.columns]).alias("_aq_l"))
    R = right.select(*[F.col(k) for k in keys], right_t.cast(time_type).alias("_aq_t"), F.lit(0).alias("_aq_kind"),
                     F.col(right_tie).cast("long").alias("_aq_tie"), found.alias("_aq_r"),
                     F.lit(None).cast(L.schema["_aq_l"].dataType).alias("_aq_l"))
    both = L.unionByName(R)
    results = [StructField("_seq_fill", both.schema["_aq_r"].dataType)]
    j = _scan(both, keys, ["_aq_t", "_aq_kind", "_aq_tie"], _Fill("_aq_r"), results, ["_seq_fill"], "_seq_fill",
              lambda row, carry: row["_seq_fill"] if row["_seq_fill"] is not None or not row["_seq_open"] else carry)
    got = F.when(F.col("_seq_open"), F.coalesce("_seq_fill", "_seq_carry")).otherwise(F.col("_seq_fill"))
    return j.where(F.col("_aq_kind") == 1).select("_aq_l.*", got.alias(out))


def _segments(batches: Iterator[pa.RecordBatch], keys: list[str], t: str, pause: str):
    """(keys, times, pauses) of each key of a range in order; times that repeat are kept once."""
    held, last = [], None

    def whole():
        at, wait = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        first = np.append(True, at[1:] != at[:-1])
        return [last.column(k) for k in keys], at[first], wait[first]

    for batch in batches:
        if not batch.num_rows:
            continue
        edges = np.flatnonzero(_changes(last, batch, keys))
        at, wait = batch.column(t).to_numpy(), batch.column(pause).to_numpy()
        bounds = [0, *edges[edges > 0].tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if held and a in edges:
                yield whole()
                held = []
            held.append((at[a:b], wait[a:b]))
            last = batch.slice(a, 1)
        last = batch.slice(batch.num_rows - 1)
    if held:
        yield whole()


def _ends(at: np.ndarray, wait: np.ndarray) -> np.ndarray:
    """The place of the last link of the chain from every place: pointers are doubled until all rest."""
    to = np.searchsorted(at, at + wait)
    to = np.where(to < len(at), to, np.arange(len(at)))
    while True:
        further = to[to]
        if (further == to).all():
            return to
        to = further


def _links(keys: list[str], t: str, pause: str, most: int) -> Callable:
    """What the fold needs of a range: of its first key each place where a chain may enter, and when the next link may
    come after the chain's last one; of its last key, if it is another, the same from its first place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def rows(kind: int, key: list, at: np.ndarray, wait: np.ndarray, n: int) -> pa.RecordBatch:
            ends = _ends(at, wait)[:n]
            return pa.RecordBatch.from_arrays(
                [*(k.take(pa.array([0] * n, pa.int32())) for k in key), pa.array(np.full(n, part, np.int64)), pa.array([kind] * n, pa.int32()),
                 pa.array(at[:n]), pa.array(at[ends] + wait[ends])], [*keys, "_seq_part", "_kind", "_enter", "_free"])

        for i, own in enumerate(_segments(batches, keys, t, pause)):
            if not i:
                yield rows(0, *own, min(len(own[1]), int(np.searchsorted(own[1], own[1][0] + most)) + 1))
            last = own if i else None
        if last:
            yield rows(1, *last, 1)
    return run


def _entered(keys: list[str]) -> Callable:
    """(range, place where the chain enters it) from the rows of ``_links`` in order, one at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, free, done = None, None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                own = [row[k] for k in keys]
                if row["_kind"] or own != key:
                    if not row["_kind"]:
                        found.append((row["_seq_part"], row["_enter"]))
                        done = row["_seq_part"]
                    key, free = own, row["_free"]
                elif done != row["_seq_part"] and row["_enter"] >= free:
                    found.append((row["_seq_part"], row["_enter"]))
                    done, free = row["_seq_part"], row["_free"]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["_seq_part", "_enter"])
    return run


def _chained(keys: list[str], t: str, pause: str) -> Callable:
    """The links of every key's chain: in a range's first key from the place where it enters, in others from the first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter = []

        def seen():
            for batch in batches:
                if batch.num_rows and not enter:
                    enter.append(batch.column("_enter")[0].as_py())
                yield batch

        for i, (key, at, wait) in enumerate(_segments(seen(), keys, t, pause)):
            found, j = [], 0
            if not i:
                j = len(at) if enter[0] is None else int(np.searchsorted(at, enter[0]))
            while j < len(at):
                found.append(at[j])
                j = int(np.searchsorted(at, at[j] + wait[j]))
            yield pa.RecordBatch.from_arrays([*(k.take(pa.array([0] * len(found), pa.int32())) for k in key), pa.array(found, pa.int64())], [*keys, t])
    return run


def sequence_chain(df: DataFrame, keys, t: str, tie: str, pause: str) -> DataFrame:
    """Keys and ``t`` of the links of each key's chain: its first row, then always the first row at or after the last link's
    ``t + pause`` (whole numbers, ``pause`` > 0; of rows with one ``t`` the first by ``tie``). Linear work: a range hands on only the
    rows of its first key within the longest pause of its start, where a chain may enter; these are folded in order."""
    keys = _cols(keys)
    kinds = [df.schema[k] for k in keys]
    most = df.agg(F.max(pause)).first()[0] or 0
    d = _ranges(df.select(*keys, t, tie, pause), *keys, t, tie).withColumn("_seq_part", F.spark_partition_id().cast("long"))
    d = d.checkpoint(eager=True)
    links = d.mapInArrow(_links(keys, t, pause, most), StructType(kinds + StructType.fromDDL(
        "_seq_part long, _kind int, _enter long, _free long").fields))
    enter = (links.repartition(1).sortWithinPartitions("_seq_part", "_kind", "_enter")
             .mapInArrow(_entered(keys), "_seq_part long, _enter long"))
    return (d.join(F.broadcast(enter), "_seq_part", "left")                                        # one row per range
            .mapInArrow(_chained(keys, t, pause), StructType(kinds + [StructField(t, df.schema[t].dataType)])))


def global_index(df: DataFrame, order, index_col: str = "position", size_col: str | None = None) -> DataFrame:
    """1-based position of every row in the total ``order``: one range shuffle on the full (unique) order, which splits even
    a hot timestamp. The place inside a range is the low part of ``monotonically_increasing_id``; offsets come from a table
    with one row per range."""
    d = _ranges(df, *_cols(order)).withColumn("_gi_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    part, place = F.shiftright("_gi_id", 33), F.expr("_gi_id & 8589934591")
    counts = d.groupBy(part.alias("_gi_part")).agg(F.count(F.lit(1)).alias("_gi_rows"))
    earlier = Window.orderBy("_gi_part").rowsBetween(Window.unboundedPreceding, -1)                # one row per range
    counts = counts.withColumn("_gi_off", F.coalesce(F.sum("_gi_rows").over(earlier), F.lit(0)))
    extra = []
    if size_col:
        counts = counts.withColumn(size_col, F.sum("_gi_rows").over(Window.partitionBy()))
        extra = [size_col]
    d = d.withColumn("_gi_part", part).join(F.broadcast(counts), "_gi_part")
    return d.select(*df.columns, (place + F.col("_gi_off") + 1).alias(index_col), *extra)
