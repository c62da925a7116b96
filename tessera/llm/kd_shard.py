"""Operator 5, sharding by a k-d tree. Native: only DataFrame functions.

A point is a group of equal texts, with its metadata (by default the logarithm of its
size, its language and its source, those that docs has; the least value where copies
differ) and its bytes as weight. Every node splits at the weighted median of its widest
dimension, measured against the root's, until there are as many leaves as shards (or
leaves are down to the target bytes).

* Medians are distributed: a round sums the weights of up to 2^16 bins a node, for all
  nodes of a level together, and finds the bin that holds the cut, in Spark; a row a
  node comes to the driver. The next round looks into that bin, until it holds under
  `slack` of a shard. Points of equal coordinates are ordered by the text's CRC.
* A level reads the points, writes them with their new nodes, and drops the old table.
* Groups of over `slack` of a shard are few, max(2^16, 4 x shards) at most, and the
  driver knows them. At each cut they are set apart, in the order of the dimension:
  the one in the middle goes whole to a side that has room for it, and the cut moves
  through the other points until both sides are right. Only a group that fits neither
  side, which may hold a third of all rows, is cut, by the number of its rows.

Text is read once; after that rows are a few numbers wide. Rows meet their point by the
text's hash; rows of the groups that the driver knows don't move for it.

Null texts have no bytes (size 1, CRC 0); null metadata is a value of its own. Rows that
repeat a doc_id, or all of a row, are counted each. A very long text weighs what it
weighs: a shard may be as large as its largest document. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

BIN_BITS = 16
SLACK = 0.002
KNOWN = 1 << 16
METADATA = ("lang", "source")


@dataclass
class Group:
    """The rows [first, last) of a group of equal texts, each of the same size."""

    key: int
    size: int
    dims: tuple[int, ...]
    first: int
    last: int
    tie: int = 0

    @property
    def weight(self) -> int:
        return (self.last - self.first) * self.size


@dataclass
class Node:
    first: int  # leaf
    leaves: int
    groups: list[Group] = field(default_factory=list)


def set_apart(groups: list[Group], axis: int, goal: float, room: float) -> tuple[list[Group], list[Group]]:
    """Groups for the left, which takes `goal` bytes, and for the right, which has
    room for `room`: in the order of the axis, cut only where neither side has room."""
    left: list[Group] = []
    rest = sorted(groups, key=lambda g: (g.dims[axis], g.key, g.first))
    held, total = 0, sum(g.weight for g in groups)
    middle = total * goal / (goal + room) if total else 0
    while rest and held + rest[0].weight <= middle:
        held += rest[0].weight
        left.append(rest.pop(0))
    if rest and held < middle:
        g = rest[0]
        after = held + g.weight
        left_fits, right_fits = after <= goal, total - held <= room
        if left_fits and (after - middle <= middle - held or not right_fits):
            left.append(rest.pop(0))
        elif not right_fits:
            cut = g.first + min(g.last - g.first, max(0, round((middle - held) / g.size)))
            left.append(Group(g.key, g.size, g.dims, g.first, cut, g.tie))
            rest[0] = Group(g.key, g.size, g.dims, cut, g.last, g.tie)
    return [g for g in left if g.weight], [g for g in rest if g.weight]


def _medians(points: DataFrame, ranges: dict[int, tuple[int, int]], goal: dict[int, float], fine: float) -> dict[int, int]:
    """For each node the coordinate `at` below which its points hold the goal, but
    for `fine`. points: node, at, weight; ranges: inclusive."""
    spark = points.sparkSession
    out: dict[int, int] = {}
    open_ = {n: (lo, hi, 0.0) for n, (lo, hi) in ranges.items()}
    while open_:
        look = [(n, lo, hi, -(-(hi - lo + 1) >> BIN_BITS), goal[n] - before) for n, (lo, hi, before) in open_.items()]
        table = common.local_table(spark, look, "node int, lo bigint, hi bigint, step bigint, want double")
        inside = points.join(F.broadcast(table), "node").where("at between lo and hi")
        sums = inside.groupBy("node", F.expr("(at - lo) div step").alias("bin")).agg(F.sum("weight").alias("w"), F.first("want").alias("want"))
        run = sums.withColumn("sum", F.sum("w").over(Window.partitionBy("node").orderBy("bin")))
        cross = run.where(F.col("sum") > F.col("want")).groupBy("node").agg(F.min(F.struct("bin", "w", "sum")).alias("c"))
        found = {r.node: r.c for r in cross.collect()}  # a row a node
        for n, lo, hi, step, want in look:
            before = open_.pop(n)[2]
            if n not in found:  # all there is goes left
                out[n] = hi + 1
                continue
            b, w, sum_ = found[n]
            if w <= fine or step == 1:
                out[n] = lo + step * (b + (sum_ - want < want - (sum_ - w)))
            else:
                open_[n] = (lo + b * step, min(hi, lo + (b + 1) * step - 1), before + sum_ - w)
    return out


def kd_tree(points: DataFrame, groups: list[Group], dims: list[str], leaves: int, total: int, rows: int, slack: float = SLACK) -> tuple[DataFrame, dict[int, Node]]:
    """points: a table of key, tie, weight, node 0 and dims (longs under 2^30), of
    `rows` at most. The points with their last nodes, and these."""
    spark = points.sparkSession
    nodes, root = {0: Node(0, leaves, groups)}, None
    while busy := [n for n, x in nodes.items() if x.leaves > 1]:
        each = [F.sum("weight").alias("w"), *[f(d).alias(f"{k}{i}") for i, d in enumerate(dims) for k, f in (("lo", F.min), ("hi", F.max))]]
        stats = {r.node: r for r in points.groupBy("node").agg(*each).collect()}  # a row a node
        axis, ranges, goal, cuts = {}, {}, {}, {}
        for n in busy:
            own, r = nodes[n], stats.get(n)
            low = [min([g.dims[i] for g in own.groups] + ([r[f"lo{i}"]] if r else []), default=0) for i in range(len(dims))]
            high = [max([g.dims[i] for g in own.groups] + ([r[f"hi{i}"]] if r else []), default=0) for i in range(len(dims))]
            root = root or [max(1, b - a) for a, b in zip(low, high, strict=True)]
            widths = [(b - a) / w for a, b, w in zip(low, high, root, strict=True)]
            axis[n] = widths.index(max(widths))
            held = sum(g.weight for g in own.groups) + (r.w if r else 0)
            share = held * (own.leaves // 2) / own.leaves
            left, right = set_apart(own.groups, axis[n], share, held - share)
            half = own.leaves // 2
            nodes[2 * n + 1], nodes[2 * n + 2] = Node(own.first, half, left), Node(own.first + half, own.leaves - half, right)
            if r:
                goal[n] = share - sum(g.weight for g in left)
                ranges[n] = (r[f"lo{axis[n]}"] << 32, (r[f"hi{axis[n]}"] << 32) + (1 << 32) - 1)
        for n in busy:
            del nodes[n]
        if ranges:
            sides = common.local_table(spark, [(n, axis[n]) for n in ranges], "node int, axis int")
            value = F.element_at(F.array(*dims), F.col("axis") + 1)
            placed = points.join(F.broadcast(sides), "node", "left").withColumn("at", F.shiftleft(value, 32) + F.col("tie"))
            cuts = _medians(placed.where("axis is not null").select("node", "at", "weight"), ranges, goal, slack * total / leaves / 2)
            table = common.local_table(spark, [(n, c) for n, c in cuts.items()], "node int, cut bigint")
            moved = F.when(F.col("cut").isNull(), F.col("node")).when(F.col("at") < F.col("cut"), 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)
            new = placed.join(F.broadcast(table), "node", "left").withColumn("node", moved.cast("int")).select(*points.columns)
            new = common.materialise(new, "points", rows)
            common.discard(points)
            points = new
    return points, nodes


def code(column: Column) -> Column:
    """Text metadata as a number under 2^30; null is 0, equal values are equal."""
    return F.coalesce(F.shiftright(F.crc32(column.cast("string").cast("binary")), 3) + 1, F.lit(0)).cast("bigint")


def kd_shard(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot,
    grown_shard. With target_bytes the number of shards follows the input."""
    spark = docs.sparkSession
    text = F.coalesce(common.quoted(text_col), F.lit(""))
    has = {c.lower() for c in docs.columns}
    extra = [code(common.quoted(c)).alias(f"d{i + 1}") for i, c in enumerate(c for c in metadata if c.lower() in has)]
    dims = [f"d{i}" for i in range(len(extra) + 1)]
    size = (F.octet_length(text) + 1).cast("bigint")
    # widths are compared on a scale of sizes by their logarithm: sizes have long tails
    rows = docs.select(F.monotonically_increasing_id().alias("row"), common.quoted(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("tie"), F.xxhash64(text).alias("key"), *extra)
    rows = common.materialise(rows.withColumn("d0", F.floor(F.log2("size") * F.lit(1 << 20)).cast("bigint")), "rows")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = shards or max(1, -(-total // target_bytes))

    groups = rows.groupBy("key", "size", "tie").agg(F.count(F.lit(1)).alias("n"), *[F.min(d).alias(d) for d in dims])
    groups = common.materialise(groups.withColumn("weight", F.col("n") * F.col("size")).withColumn("node", F.lit(0)), "points", n)
    known = max(SLACK, min(0.25, shards / KNOWN)) * total / shards
    large = groups.where((F.col("weight") > known) & (F.col("n") > 1))
    held = [Group(r.key, r.size, tuple(r[d] for d in dims), 0, r.n, r.tie) for r in large.collect()]  # max(KNOWN, 4 * shards) at most
    light = groups.where((F.col("weight") <= known) | (F.col("n") == 1)).select("key", "size", "tie", "weight", "node", *dims)
    points, nodes = kd_tree(light, held, dims, shards, total, n)

    leaf = common.local_table(spark, [(i, x.first) for i, x in nodes.items()], "node int, shard int")
    rows = rows.select("row", "doc_id", "size", "tie", "key")
    few = common.local_table(spark, sorted({(g.key, g.size, g.tie) for g in held}), "key bigint, size bigint, tie bigint")
    own = ["key", "size", "tie"]
    placed = rows.join(F.broadcast(few), own, "left_anti").join(points.select("node", *own), own).join(F.broadcast(leaf), "node").drop("node", "key")
    if held:
        spans = [(g.key, g.size, g.tie, x.first, g.first, g.last) for x in nodes.values() for g in x.groups]
        table = common.local_table(spark, spans, "key bigint, size bigint, tie bigint, shard int, first bigint, last bigint")
        mine = common.materialise(rows.join(F.broadcast(few), own), "large")
        ranked = common.gapless(mine, own, ["row"], "rank")
        there = ranked.join(F.broadcast(table), own).where("rank >= first and rank < last")
        placed = placed.unionByName(there.select("row", "doc_id", "size", "tie", "shard"))
    placed = common.materialise(placed.select("row", "doc_id", "size", "tie", "shard"), "placed")
    common.discard(rows, groups, points, *([mine] if held else []))
    slotted = common.gapless(placed, ["shard"], ["row"], "slot")
    return slotted.select("doc_id", "size", F.col("tie").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
