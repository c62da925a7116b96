"""What the training-data operators share: shared-folder tables, ranks without a
single task, connected components and fixed-size key bitmaps."""

from __future__ import annotations

import gc
import json
import re
import tempfile
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import tables
from tessera.functions.tokens import small_batches  # noqa: F401

# ---------------------------------------------------------------- shared folder


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Where the setting is absent and the session is local (tests on one machine) a
    temporary folder is made once and put into the session; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with all below it when the driver ends."""
    shared_root(spark)
    return tables.scratch(spark, name)


ROWS_A_FILE = 50_000


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to a table in the shared folder and read it back: the lineage
    ends there, and a lost executor costs no recomputation of what came before.
    rows, where some upper estimate is known, keeps small results from being
    written as a file for each shuffle partition."""
    path = scratch(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    tables.remove(spark, *paths)


def discard(*written: DataFrame) -> None:
    """Delete the written tables below these frames, which nothing reads any more."""
    for table in written:
        root = f"{shared_root(table.sparkSession)}/tessera/".split(":", 1)[-1].lstrip("/")
        folders = {f.rpartition("/")[0] for f in table.inputFiles()}
        remove(table.sparkSession, *{f for f in folders if f.split(":", 1)[-1].lstrip("/").startswith(root)})


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now, not at some later
    collection of the driver's garbage: they would hold disk all that time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table from the driver's rows without Python on the executors."""
    names = [x.split()[0] for x in schema.split(",")]
    data = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    fields = ", ".join(x.strip().replace(" ", ": ", 1) for x in schema.split(","))
    return spark.sql(f"select inline(from_json(:data, 'array<struct<{fields}>>'))", args={"data": data})


def fresh(columns: Sequence[str], name: str) -> str:
    """A column name that does not clash with those there."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(columns: Sequence[str], results: Sequence[str]) -> list[str]:
    """The columns that no result replaces; names are compared as Spark does, without case."""
    taken = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in taken]


def numbered(columns: Sequence[str]) -> list[Column]:
    """The columns as c0, c1, ..., so that they can't clash with an operator's own."""
    return [quoted(c).alias(f"c{i}") for i, c in enumerate(columns)]


def renamed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """numbered undone for the first columns of df."""
    return df.toDF(*columns, *df.columns[len(columns) :])


# -------------------------------------------------------------- Python workers

_resident: dict[str, object] = {}


def resident(key: str, build: Callable[[], object]):
    """What a Python worker keeps between tasks: one thing at most, and only until a
    task of an operator that asks for another, or calls alone()."""
    if key not in _resident:
        alone()
        _resident[key] = build()
    return _resident[key]


def alone() -> None:
    """Give back the memory of what another operator's tasks have left in this worker."""
    if _resident:
        _resident.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


# ------------------------------------------------------------------------ ranks

RANK_BLOCKS = 2048


def gapless(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, weight: str | None = None, blocks: int = RANK_BLOCKS) -> DataFrame:
    """Number the rows of each key from 0 without gaps (or, with weight, give the
    sum of the weights of the rows before).

    A key may hold any share of the rows. Rows are dealt by key and a hash of
    the order columns to `blocks` blocks a key; the blocks' totals are summed up
    over (key, block), and each block is ranked on its own. The totals have at
    most keys x blocks rows and are joined, not broadcast. Keys hold no nulls. df is read twice, so
    hand in a materialised table."""
    block, base = "__block", "__base"
    value = F.col(weight) if weight else F.lit(1).cast("bigint")
    dealt = df.withColumn(block, F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    on = [*keys, block]
    totals = dealt.groupBy(*on).agg(F.sum(value).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(block) if keys else Window.orderBy(block)
    # coalesced on purpose: without keys there are at most `blocks` rows in all
    totals = totals.withColumn(base, F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")).drop("__n")
    own = Window.partitionBy(*on).orderBy(*order)
    inner = F.row_number().over(own).cast("bigint") - 1 if not weight else F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - value
    # equal names on both sides, so that the join keeps the window's partitioning
    joined = dealt.withColumn("__inner", inner).join(totals, on)
    return joined.select(*df.columns, (F.col("__inner") + F.col(base)).cast("bigint").alias(out))


# --------------------------------------------------------- connected components


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, rows: int | None = None, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find. edges: (a, b) of one orderable type. Returns
    (node, root), root being the smallest node reachable; nodes without an edge
    to another node are not listed.

    Rounds of large-star and small-star: every node links its larger neighbours
    to the smallest node it sees, then its smaller ones. Each round is two
    aggregations and two joins over the edges, ends in a table in the shared
    folder, and never has more edges than the one before plus the nodes. Only a
    count and a checksum come to the driver. rows: an estimate of the edges."""
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, "cc", rows)
    state = _fingerprint(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        both = large.join(m, "u")
        small = both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).distinct()
        new = materialise(small, "cc", 2 * state[0])
        discard(e)
        now = _fingerprint(new)
        e, done, state = new, now == state, now
        if done:
            break
    else:
        raise RuntimeError("connected components did not settle")
    release(spark)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# ------------------------------------------------------------------- hot keys

HOT_KEYS = 1024


def by_key(rows: DataFrame, facts: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """rows (total of them) joined with facts, a table of one row a key that says how
    many rows each key has. Keys of over total / HOT_KEYS rows, so HOT_KEYS at most,
    are broadcast and their rows stay where they are; no task of the shuffle for the
    others gets a larger group than that. Keys hold no nulls."""
    hot = F.col(size) * HOT_KEYS > total
    few = facts.where(hot).drop(size)
    cold = rows.join(F.broadcast(few.select(*keys)), list(keys), "left_anti").join(facts.where(~hot).drop(size), list(keys))
    return rows.join(F.broadcast(few), list(keys)).unionByName(cold)


# ------------------------------------------------------------------ ranges

RANGE_BITS = 12
MAX_RANGES = 1 << 15


def range_edges(rows: DataFrame, key: str, weight: str, ranges: int) -> list[int]:
    """The last key of each range but the last, so that ranges of a whole-number key
    hold about equal weights.

    Sums of bins come to the driver, a bin being a key without its last bits; bins
    of over half a range are looked into again. That makes 2^RANGE_BITS sums a
    round, or 16 for each bin looked into: under 2^20 for MAX_RANGES ranges. A key is
    not cut, rows without one are left out."""
    ranges = min(ranges, MAX_RANGES)
    rows = rows.where(F.col(key).isNotNull())
    lo, hi, total = rows.agg(F.min(key), F.max(key), F.sum(weight)).first()
    if ranges < 2 or not total:
        return []
    cut, held = 0, rows.withColumn("__k", F.col(key))
    while (hi >> cut) - (lo >> cut) >= 1 << RANGE_BITS:
        cut += 1
    done: dict[int, int] = {}  # last key of a bin: its weight
    while True:
        sums = held.groupBy(F.shiftright("__k", cut).alias("b")).agg(F.sum(weight).alias("w")).collect()
        heavy = [r.b for r in sums if r.w > total / (2 * ranges)] if cut else []
        again = set(heavy)
        done |= {((r.b + 1) << cut) - 1: r.w for r in sums if r.b not in again}
        if not heavy:
            break
        chosen = local_table(rows.sparkSession, [(b,) for b in heavy], "__b bigint")
        held = held.withColumn("__b", F.shiftright("__k", cut)).join(F.broadcast(chosen), "__b", "left_semi").drop("__b")
        cut = max(0, cut - max(4, RANGE_BITS - len(heavy).bit_length()))
    edges, sum_, last = [], 0, None
    for b, w in sorted(done.items()):
        if last is not None and sum_ + w / 2 > total / ranges * (len(edges) + 1) and len(edges) < ranges - 1:
            edges.append(last)
        sum_, last = sum_ + w, b
    return edges


# ------------------------------------------------------------------ key bitmaps

BITMAP_LOG2 = 24
MAX_BITMAP_LOG2 = 28


def bitmap_log2(keys: int) -> int:
    """Bits for a bitmap that at most an eighth of is set, within 128 KB to 32 MB: the
    bound that lets it be broadcast. Over 2^25 keys it lets more rows through."""
    return min(MAX_BITMAP_LOG2, max(20, (8 * max(1, keys) - 1).bit_length()))


def key_bitmap(keys: DataFrame, column: str, log2_bits: int = BITMAP_LOG2) -> DataFrame:
    """One-hash Bloom filter of a long column, as rows (seg, bits) of 4 KB each.

    Its size is fixed by log2_bits (2 MB at 24), so it may be broadcast. Many keys
    fill it and it then lets more rows through; it never loses one."""
    pos = F.col(column).bitwiseAND(F.lit((1 << log2_bits) - 1))
    return keys.select(F.shiftright(pos, 15).alias("seg"), pos.bitwiseAND(F.lit(32767)).alias("__p")).groupBy("seg").agg(F.bitmap_construct_agg("__p").alias("bits"))


def bitmap_bytes(bitmap: DataFrame, log2_bits: int = BITMAP_LOG2) -> bytes:
    """The whole bitmap (2^log2_bits / 8 bytes) for use in Arrow functions."""
    out = bytearray(1 << (log2_bits - 3))
    for seg, bits in bitmap.collect():
        out[seg * 4096 : seg * 4096 + 4096] = bits
    return bytes(out)


def in_bitmap(df: DataFrame, bitmap: DataFrame, column: str, log2_bits: int = BITMAP_LOG2, inside: bool = True) -> DataFrame:
    """The rows of df whose key may be in the bitmap (or else the other rows);
    native, without a shuffle of df."""
    pos = F.col(column).bitwiseAND(F.lit((1 << log2_bits) - 1))
    seg, off = F.shiftright(pos, 15), pos.bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.expr("substring(__bm_bits, __bm_off div 8 + 1, 1)")), 16, 10).cast("int")
    own = df.columns
    side = F.broadcast(bitmap.select(F.col("seg").alias("__bm_seg"), F.col("bits").alias("__bm_bits")))
    joined = df.withColumns({"__bm_at": seg, "__bm_off": off}).join(side, F.col("__bm_at") == F.col("__bm_seg"), "left")
    there = F.col("__bm_bits").isNotNull() & (byte.bitwiseAND(F.expr("shiftleft(1, __bm_off % 8)")) != 0)
    return joined.where(F.coalesce(there if inside else ~there, F.lit(not inside))).select(*map(quoted, own))


def without(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of df whose id is not in ids (one column, nulls count as a value).
    Only rows that a bitmap of the ids lets through are shuffled."""
    key = fresh(df.columns, "__key")
    ids = materialise(ids.select(F.col(ids.columns[0]).alias("__gone")).distinct(), "gone")
    bits = bitmap_log2(ids.count())
    bitmap = materialise(key_bitmap(ids.select(F.xxhash64("__gone").alias("k")), "k", bits), "bitmap", rows=0)
    keyed = df.withColumn(key, F.xxhash64(quoted(id_col)))
    rivals = in_bitmap(keyed, bitmap, key, bits)
    left = rivals.join(ids, quoted(id_col).eqNullSafe(F.col("__gone")), "left_anti")
    return in_bitmap(keyed, bitmap, key, bits, inside=False).unionByName(left).drop(key)
