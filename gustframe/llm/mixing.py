"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Each pattern can
give its words up to three times, a later copy costing more than an earlier one; the flow routes that
capacity to the sources' quotas at least cost. A pattern's documents are then taken in a seeded order.

The flow falls into parts without common sources. A part of one source and its one pattern has one flow only, the
quota itself: such parts are worked out by DataFrame functions, whatever their number. Patterns that share sources
with others go through the flow on the driver; there is one row per pattern.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gustframe.llm.common import packed, prepare, stored
from gustframe.operators.sequence import global_index

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = "mix"
#: Patterns that share sources are the only rows that reach the driver; their number is checked against this bound.
MOST_PATTERNS = 20_000
#: Tables of patterns or sources with at most this many rows are broadcast.
BROADCAST_ROWS = 50_000
#: Hexadecimal digits of the seeded order that make up a bin of the running sum.
BIN_DIGITS = 3
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[float]:
    """Share the sum of ``sizes`` by weight; no target exceeds ``repeats`` times its size.

    The excess of a source that is full goes to the others by weight until none is above.
    """
    total, full = sum(sizes), set()
    while True:
        rest = total - sum(repeats * sizes[i] for i in full)
        share = sum(w for i, w in enumerate(weights) if i not in full)
        now = [float(repeats * s) if i in full else rest * w / share for i, (s, w) in enumerate(zip(sizes, weights))]
        above = {i for i in range(len(sizes)) if i not in full and now[i] > repeats * sizes[i]}
        if not above:
            return now
        full |= above


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """Words that each pattern (member sources, size) gives to each source.

    The k-th copy of a pattern's words costs 2k - 1 each (k*k in all, so convex). Successive shortest
    augmenting paths; quotas that no capacity can reach stay partly unfilled.
    """
    n, m = len(patterns), len(quotas)
    used = [0] * n
    given: list[dict[int, int]] = [{s: 0 for s in members} for members, _ in patterns]
    left = list(quotas)
    of_source: list[list[int]] = [[] for _ in range(m)]
    for p, (members, size) in enumerate(patterns):
        for s in members if size else ():
            of_source[s].append(p)

    def step(p: int) -> tuple[int, int]:
        """Cost of the next copy of a pattern, and its words that are left."""
        size = patterns[p][1]
        k = used[p] // size if size else repeats
        return (2 * k + 1, (k + 1) * size - used[p]) if k < repeats else (0, 0)

    while True:
        # from the source of the flow, patterns cost their next copy; p -> s is free, s -> p gives back
        cost = {p: step(p)[0] for p in range(n) if step(p)[1]}
        came: dict[int, int | None] = dict.fromkeys(cost)
        queue = deque(sorted(cost, key=cost.get))
        best = None
        while queue:
            x = queue.popleft()
            if x < n:
                steps = [(n + s, 0) for s in given[x]]
            else:
                steps = [(p, 0) for p in of_source[x - n] if given[p].get(x - n)]
                if left[x - n] and (best is None or cost[x] < cost[best]):
                    best = x
            for y, c in steps:
                if cost[x] + c < cost.get(y, 1 << 60):
                    cost[y] = cost[x] + c
                    came[y] = x
                    queue.append(y)
        if best is None:
            return given
        path = [best]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        amount = min([step(path[0])[1], left[best - n]]
                     + [given[b][a - n] for a, b in zip(path, path[1:]) if a >= n])
        used[path[0]] += amount
        left[best - n] -= amount
        for a, b in zip(path, path[1:]):
            if a < n:
                given[a][b - n] += amount
            else:
                given[b][a - n] -= amount


@dataclass(frozen=True)
class Plan:
    """table: pattern, copies (whole ones), cut_key, cut_size: documents up to there in the seeded order get one more,
    and so does the one of fill_key, fill_size. sources: name, size, target."""

    table: DataFrame
    sources: DataFrame


def _small(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast where its rows are few; a larger one is left to the shuffled join, in which
    adaptive execution splits a hot key."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def source_targets(kinds: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """name, size and target of every source of ``kinds`` (names, size), as ``targets`` gives them.

    A round is one aggregate over the sources. A source is full if its share by weight exceeds ``repeats`` times its
    size; what full ones leave makes the share of the others larger, so a full one stays full. The rounds end when
    no more are full.
    """
    sizes = kinds.select(F.explode("names").alias("name"), "size").groupBy("name").agg(F.sum("size").alias("size"))
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")
    sources = stored(global_index(sizes, "name", "place")
                     .select("name", "size", F.get(F.array(*map(F.lit, weights)), turn).cast("long").alias("weight")), "mix-sources")
    total = kinds.agg(F.sum("size")).first()[0] or 0
    wide = lambda c: c.cast("decimal(38,0)")
    full, known = F.lit(False), -1
    while True:
        n, held, share = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("size"))), F.sum(F.when(~full, F.col("weight")))).first()
        rest, share = total - repeats * (held or 0), share or 1
        if n == known:
            break
        known, full = n, wide(F.lit(rest)) * F.col("weight") > wide(F.col("size")) * F.lit(repeats * share)
    part = (F.lit(rest) * F.col("weight")).cast("double") / F.lit(float(share))
    return sources.select("name", "size", F.when(full, (F.col("size") * repeats).cast("double")).otherwise(part).alias("target"))


def _names(members: Column) -> Column:
    """Sources as strings that sort by code point, null last."""
    return F.array_sort(F.array_distinct(F.transform(members, lambda x: F.coalesce(F.concat(F.lit("s"), x), F.lit("t")))))


def seeded(docs: DataFrame, members: Column, id_col: str, text_col: str, seed: str) -> DataFrame:
    """Adds __size, __pattern, __names and __key (the seeded order) to the rows."""
    return (docs.withColumn("__names", _names(members))
            .withColumn("__size", F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("long"))
            .withColumn("__pattern", F.to_json("__names"))
            .withColumn("__key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))))


def make_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> Plan:
    """Targets, flow and cut points from narrow rows (__names, __pattern, __size, __key)."""
    spark = rows.sparkSession
    kinds = stored(rows.groupBy("__pattern").agg(F.first("__names").alias("names"), F.sum("__size").alias("size")), "mix-patterns")
    sources = stored(source_targets(kinds, weights, repeats), "mix-targets")
    alone = kinds.select("__pattern", F.explode("names").alias("name"), F.size("names").alias("k")).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("__pattern").alias("__pattern"), F.max("k").alias("k")).where("n = 1 and k = 1")
    quota = F.floor("target").cast("long")
    whole = alone.join(sources, "name").where("size > 0").select(
        "__pattern", F.floor(quota / F.col("size")).cast("long").alias("copies"), (quota % F.col("size")).alias("rest"))
    return Plan(_cuts(rows, stored(whole.union(_flow(spark, kinds, alone, sources, repeats)), "mix-flow")), sources)


def _flow(spark, kinds: DataFrame, alone: DataFrame, sources: DataFrame, repeats: int) -> DataFrame:
    """__pattern, copies and rest of the patterns that share sources with others or have several."""
    shared = stored(kinds.where(F.size("names") > 0).join(alone.select("__pattern"), "__pattern", "left_anti"), "mix-shared")
    found = shared.limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources that overlap")
    found.sort(key=lambda r: r["__pattern"])
    goals = sources.join(shared.select(F.explode("names").alias("name")).distinct(), "name", "left_semi").collect()
    goals.sort(key=lambda r: r.name)
    place = {r.name: i for i, r in enumerate(goals)}
    flow = min_cost_flow([(tuple(place[s] for s in r.names), r.size) for r in found], [int(r.target) for r in goals], repeats)
    planned = [(r["__pattern"], *(divmod(sum(given.values()), r.size) if r.size else (0, 0))) for r, given in zip(found, flow)]
    return spark.createDataFrame(planned, StructType([
        StructField("__pattern", StringType()), StructField("copies", LongType()), StructField("rest", LongType())]))


def _cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """For each pattern the last (key, size) of the seeded order up to which ``rest`` words suffice, and the one
    document behind it whose size is nearest to the words still missing.

    Running sums go over bins first; only the one bin that holds a pattern's cut is summed by document.
    """
    binned = rows.withColumn("bin", F.substring("__key", 1, BIN_DIGITS))
    bins = binned.groupBy("__pattern", "bin").agg(F.sum("__size").alias("words"))
    before = Window.partitionBy("__pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edge = (bins.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).join(_small(plan), "__pattern")
            .where("rest > 0 and start <= rest and rest < start + words").select("__pattern", "bin", "start", "rest"))
    edge = stored(edge, "mix-bins")
    keys = (binned.join(_small(edge), ["__pattern", "bin"])
            .groupBy("__pattern", "start", "rest", "__key", "__size").agg(F.sum("__size").alias("words")))
    order = Window.partitionBy("__pattern").orderBy("__key", "__size").rowsBetween(Window.unboundedPreceding, 0)
    cut = (keys.withColumn("end", F.col("start") + F.sum("words").over(order)).where("end <= rest").groupBy("__pattern")
           .agg(F.max(F.struct("__key", "__size", "end")).alias("cut")))
    cuts = stored(
        edge.join(cut, "__pattern", "left")
        .select("__pattern", F.coalesce(F.col("cut.__key"), F.col("bin")).alias("cut_key"),
                F.coalesce(F.col("cut.__size"), F.lit(-1)).alias("cut_size"),
                (F.col("rest") - F.coalesce(F.col("cut.end"), F.col("start"))).alias("missing")), "mix-cuts")
    behind = (rows.where("__size > 0").join(_small(cuts), "__pattern").where(~_up_to_cut())
              .withColumn("off", F.abs(F.col("__size") - F.col("missing"))).where("off < missing")
              .groupBy("__pattern").agg(F.min(F.struct("off", "__key", "__size")).alias("fill")))
    return stored(
        plan.join(cuts, "__pattern", "left").join(behind, "__pattern", "left")
        .select("__pattern", "copies", "cut_key", "cut_size", F.col("fill.__key").alias("fill_key"),
                F.col("fill.__size").alias("fill_size")), "mix-plan")


def _up_to_cut():
    return F.struct(F.col("__key").alias("k"), F.col("__size").alias("s")) <= F.struct(
        F.col("cut_key").alias("k"), F.col("cut_size").alias("s"))


def copies(rows: DataFrame, plan: Plan) -> DataFrame:
    """Adds __copies: how often the mix takes a row (0 to ``repeats``)."""
    fill = (F.col("__key") == F.col("fill_key")) & (F.col("__size") == F.col("fill_size"))
    extra = F.coalesce(F.col("cut_key").isNotNull() & _up_to_cut(), F.lit(False)) | F.coalesce(fill, F.lit(False))
    return (rows.join(_small(plan.table), "__pattern", "left")
            .withColumn("__copies", F.coalesce(F.col("copies"), F.lit(0)) + extra.cast("long"))
            .drop("copies", "cut_key", "cut_size", "fill_key", "fill_size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED,
        id_col: str = "doc_id", text_col: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``docs``, each in its one source.

    Size is the number of words (runs without ASCII white space; null and empty texts: 0). Sources by
    code point, null last, weigh ``weights`` in turn. taken is a whole multiple (0 to ``repeats``) of the
    size: rows come in the order of md5(seed:doc_id), then size; rows that agree in both are taken
    alike. Behind the cut the one document whose size is nearest to the words still missing is taken too,
    so a source's taken words miss its target by less than one document. A source without words has target 0. Any number of sources
    is taken. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = seeded(docs.select(id_col, text_col, source), F.array(F.col(source)), id_col, text_col, seed)
    rows = stored(rows.select(F.col(id_col).alias("doc_id"), "__names", "__pattern", "__size", "__key"), "mix-sizes")
    plan = make_plan(rows, weights, repeats)
    own = plan.sources.select(F.col("name").alias("__name"), F.col("size").alias("source_size"), "target")
    taken = copies(rows, plan).withColumn("__name", F.element_at("__names", 1))
    return taken.join(_small(own), "__name", "left").select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__copies")).alias("taken"))


def mixed(docs: DataFrame, members: Column, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: the rows of ``docs`` (all columns), each as often as it is taken.

    ``members`` is an array column of the sources that a row belongs to (null element: the nameless
    source; null or empty array: taken 0 times). Documents without words are taken 0 times.
    """
    prepare(docs.sparkSession)
    whole = packed(docs.withColumn("__members", F.coalesce(members, F.array().cast("array<string>"))), "__members")
    rows = seeded(whole.select("*", F.col(f"__row.{id_col}").alias("__id"), F.col(f"__row.{text_col}").alias("__text")),
                  F.col("__members"), "__id", "__text", seed)
    plan = make_plan(stored(rows.select("__names", "__pattern", "__size", "__key"), "mix-sizes"), weights, repeats)
    taken = copies(rows, plan).where("__copies > 0 and __size > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("__row.*").drop("__members")
