"""Operator 11, how filters interact: what each would remove in every order.

1. One Arrow pass over the texts gives each document its verdicts, a bit for each filter
   that it fails; the filter for copies compares digests over the whole table. They are
   written to a table, with the part and the labels: some bytes a document.
2. The trie of all orders is walked depth first. A node is the set of filters applied so
   far; its survivors are a persisted DataFrame, made from the parent's by applying one
   filter. Orders that have applied the same filters share the node: each of the
   2^n sets is visited once (memoised), not each of the n! orders' prefixes, and no more
   than n + 1 sets of survivors are persisted at a time. Survivors that are lost with an
   executor are filtered again from the table.
3. At every node, one aggregation counts what each further filter removes from the
   survivors there: the actual removals of that edge, by part. Counts are tables of a row
   for each part, filter and node.
4. Every order's steps look their edges up.

Null texts count as empty, a null part is the empty string. Rows that repeat a doc_id are
a document each, and none is a copy by another's equal id; a null doc_id is no copy and no
original. Of a doc_id's labels one that is 1 is enough; labels without a document count
nowhere. A text is held whole by its task. Other columns are ignored, whatever their
names. An empty table gives no parts, so no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: of a text and its UTF-8 bytes, whether the document fails
Filter = Callable[[str, bytes], bool]

UPPER = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"
COPY = "copy"


def few_words(least: int = 200) -> Filter:
    return lambda text, data: len(data.split()) < least


def repetitive(percent: int = 50) -> Filter:
    """Too few distinct words, case counting."""

    def fails(text: str, data: bytes) -> bool:
        words = data.split()  # at space and \t to \r alone
        return 100 * len(set(words)) < percent * len(words)

    return fails


def shouting(percent: int = 3) -> Filter:
    """Too many capitals A-Z among the code points."""
    return lambda text, data: 100 * (len(data) - len(data.translate(None, UPPER))) > percent * len(text)


def symbols(chars: bytes = SYMBOLS) -> Filter:
    return lambda text, data: len(data.translate(None, chars)) < len(data)


FILTERS: dict[str, Filter | str] = {"A": few_words(), "B": repetitive(), "C": shouting(), "D": symbols(), "E": COPY}


def verdicts(docs: DataFrame, filters: dict[str, Filter | str], part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, fails): fails has bit i set where filter i fails."""
    common.small_batches(docs.sparkSession)
    own = [(1 << i, f) for i, f in enumerate(filters.values()) if f != COPY]
    copies = sum(1 << i for i, f in enumerate(filters.values()) if f == COPY)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for batch in batches:
            fails, digests = [], []
            for x in batch.column(2):
                text = x.as_py() or ""
                data = text.encode("utf-8", "surrogatepass")
                fails.append(sum(bit for bit, f in own if f(text, data)))
                digests.append(hashlib.sha256(data).digest() if copies else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "fails", "digest"])

    part = F.coalesce(common.quoted(part_col).cast("string"), F.lit(""))
    src = docs.select(common.quoted(id_col).cast("bigint").alias("doc_id"), part.alias("part"), common.quoted(text_col).alias("text"))
    read = src.mapInArrow(step, "doc_id bigint, part string, fails int, digest binary")
    if not copies:
        return read.drop("digest")
    read = common.materialise(read, "verdicts")
    groups = read.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # a text that no other document has is no copy: it meets nothing
    several = common.materialise(groups.where("copies > 1 and first is not null"), "copies")
    total = read.count()
    hot = F.broadcast(several.where(F.col("copies") * common.HOT_KEYS > total).select("digest", F.col("first").alias("hot")))
    cold = several.where(F.col("copies") * common.HOT_KEYS <= total).select("digest", "first")
    met = read.join(hot, "digest", "left")
    light = met.where("hot is null").join(cold, "digest", "left")
    both = light.select("doc_id", "part", "fails", "first").unionByName(met.where("hot is not null").select("doc_id", "part", "fails", F.col("hot").alias("first")))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return both.select("doc_id", "part", F.when(later, F.col("fails").bitwiseOR(F.lit(copies))).otherwise(F.col("fails")).alias("fails"))


def labelled(judged: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds good and toxic."""
    named = labels.select(common.quoted(id_col).cast("bigint").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    one = named.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic"))
    # rows without an id have no labels, and would meet in one task of the join
    met = judged.where("doc_id is not null").join(one, "doc_id", "left").unionByName(judged.where("doc_id is null"), allowMissingColumns=True)
    return met.select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def walk(judged: DataFrame, n: int) -> DataFrame:
    """(part, node, i, survivors, removed, good_lost, toxic_lost): what filter i removes from
    the survivors of the filters in the bits of node."""
    counted: dict[int, DataFrame] = {}

    def fails(i: int):
        return F.col("fails").bitwiseAND(F.lit(1 << i)) != 0

    def visit(node: int, survivors: DataFrame) -> None:
        held = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        nexts = [i for i in range(n) if not node >> i & 1]
        sums = [F.struct(F.lit(i).alias("i"), F.count_if(fails(i)).alias("removed"), F.count_if(fails(i) & F.col("good")).alias("good_lost"), F.count_if(fails(i) & F.col("toxic")).alias("toxic_lost")) for i in nexts]
        each = held.groupBy("part").agg(F.count(F.lit(1)).alias("survivors"), F.array(*sums).alias("e")).select("part", F.lit(node).alias("node"), "survivors", F.explode("e").alias("e"))
        counted[node] = common.materialise(each.select("part", "node", "survivors", "e.*"), "edges", rows=0)
        for i in nexts:
            after = node | 1 << i
            if after not in counted and after != (1 << n) - 1:
                visit(after, held.where(~fails(i)))
        held.unpersist()

    visit(0, judged)
    out = None
    for edges in counted.values():
        out = edges if out is None else out.unionByName(edges)
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter | str] | None = None, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each part, order of the filters (their names in a row) and step from 1:
    kept, removed, redundant (fails, but went before), unique_fails (fails this alone),
    good_lost, toxic_lost, and shapley: removed by that filter, summed over all orders.
    Filters have names of one letter; there are seven of them at most."""
    filters = FILTERS if filters is None else filters
    n = len(filters)
    if not 0 < n <= 7 or any(len(x) != 1 for x in filters):
        raise ValueError("one to seven filters, named by one letter each")
    judged = common.materialise(labelled(verdicts(docs, filters, part_col, id_col, text_col), labels, id_col), "judged")
    edges = common.materialise(walk(judged, n), "edges", rows=0)
    ones = [F.count_if(F.col("fails").bitwiseAND(F.lit(1 << i)) != 0).alias(f"f{i}") for i in range(n)]
    alone = [F.count_if(F.col("fails") == 1 << i).alias(f"u{i}") for i in range(n)]
    parts = judged.groupBy("part").agg(*ones, *alone)
    pick = lambda c: F.element_at(F.array(*[F.col(f"{c}{i}") for i in range(n)]), F.col("i") + 1)
    names = list(filters)
    steps = []
    for order in permutations(range(n)):
        node = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(names[k] for k in order), step, i, node))
            node |= 1 << i
    trie = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "i", "node"), x, strict=True)) for x in steps])), "array<struct<filter_order:string,step:int,i:int,node:int>>")
    # of all orders, those that reach an edge from a node of k filters are k! (n - k - 1)!
    share = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - k - 1)) for k in range(n)]), F.bit_count("node") + 1)
    shapley = edges.groupBy("part", "i").agg(F.sum(F.col("removed") * share).cast("bigint").alias("shapley"))
    sized = parts.select("*", F.inline(trie))
    met = sized.join(edges, ["part", "node", "i"], "left").join(shapley, ["part", "i"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return met.select(
        "part", "filter_order", "step", (zero("survivors") - zero("removed")).alias("kept"), zero("removed").alias("removed"), (pick("f") - zero("removed")).cast("bigint").alias("redundant"),
        pick("u").cast("bigint").alias("unique_fails"), zero("good_lost").alias("good_lost"), zero("toxic_lost").alias("toxic_lost"), zero("shapley").alias("shapley"),
    )
