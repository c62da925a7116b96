"""Operator 10, exact deduplication over an extendible-hash index. Native: only
DataFrame functions.

1. One scan of the texts writes the entries (row, doc_id, 64-bit hash of the normalised
   text, SHA-256, code points) to the shared folder; texts are not shuffled.
2. Entries are added up by hash, on the map side first, so a text with a third of all
   copies is a row a task. Each sum is a slot's entry: rows, the row that would stay.
3. A directory over the hash's leading bits starts with one bucket and doubles until
   no bucket holds more entries than its capacity. The capacity grows with the entries
   so that 2^MAX_DEPTH slots suffice; the directory is the only thing broadcast besides
   a bitmap of bounded size.
4. A second scan brings the texts of hashes that occur more than once (a bitmap lets
   only those through). They are grouped by hash and bytes, copies meeting on the map side:
   this shuffle, not an owner task, compares bytes, as a text of which a third of all rows
   are copies would move to its owner row by row if it were dealt by bucket alone. Each
   distinct text comes out as one row: its hash and how many have it.
5. Owner tasks hold buckets: entries and these rows are dealt by bucket, in one shuffle, and
   each hash's chain is closed there. A chain of one text is a group and its row that
   stays is settled; so is a chain of a single row.
6. Chains of several texts (a collision of 64 bits) are taken apart by the bytes of
   their texts, from a third scan that only happens if there are any.

Rows meet their group by the hash; rows of the largest groups don't move for it.

Null texts count as empty. Ties in code points go to the smallest doc_id, a null doc_id
losing to any other; of rows equal in these too, one stays and the others go. A very
long text is held whole by the task that reads it, and by the one that compares it. An
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: The characters deleted before texts are compared.
SPACES = " \t\n\x0b\f\r"
MAX_DEPTH = 14
BUCKET_ENTRIES = 1 << 16


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def text_hash(norm: Column) -> Column:
    return F.xxhash64(norm)


def digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def directory(counts: list[tuple[int, int]], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """(global depth, bucket of each slot) for (leading bits, entries) pairs."""
    size = [0] * (1 << max_depth)
    for prefix, n in counts:
        size[prefix] += n
    below = [0]
    for n in size:
        below.append(below[-1] + n)
    buckets, todo = [], [(0, 0)]  # local depth, prefix
    while todo:
        depth, prefix = todo.pop()
        width = max_depth - depth
        held = below[(prefix + 1) << width] - below[prefix << width]
        if held > capacity and depth < max_depth:
            todo += [(depth + 1, 2 * prefix + 1), (depth + 1, 2 * prefix)]
        else:
            buckets.append((depth, prefix))
    depth = max(d for d, _ in buckets)
    slots: list[int] = []
    for i, (d, _) in enumerate(buckets):
        slots += [i] * (1 << (depth - d))
    return depth, slots


def _rank() -> Column:
    """What decides who stays of a group, the least first."""
    return F.struct((-F.col("cp")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")


def _decided(rows: DataFrame) -> DataFrame:
    """rows: row, doc_id, sha, best, n."""
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    return rows.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), sha)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    src = docs.select(common.quoted(id_col).alias("doc_id"), common.quoted(text_col).alias("text"))
    cp = F.length(F.coalesce("text", F.lit(""))).alias("cp")
    norm = src.select("doc_id", normalised(F.col("text")).alias("norm"), cp).withColumn("h", text_hash(F.col("norm")))
    entries = norm.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h", digest(F.col("norm")).alias("sha"), "cp")
    entries = common.materialise(entries, "entries")
    rows = entries.count()

    slots_ = entries.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(_rank()).alias("best"))
    slots_ = common.materialise(slots_.withColumn("prefix", F.shiftrightunsigned("h", 64 - MAX_DEPTH).cast("int")), "slots", rows)
    counts = [tuple(r) for r in slots_.groupBy("prefix").count().collect()]  # 2^MAX_DEPTH rows at most
    depth, of_slot = directory(counts, max(capacity, 4 * sum(n for _, n in counts) >> MAX_DEPTH))
    directory_ = common.local_table(spark, list(enumerate(of_slot)), "slot int, bucket int")

    several = slots_.where("n > 1").select("h")
    bits = common.bitmap_log2(several.count())
    bitmap = common.materialise(common.key_bitmap(several, "h", bits), "bitmap", rows=0)
    texts = common.in_bitmap(norm.select("h", "norm"), bitmap, "h", bits).groupBy("h", "norm").agg(F.count(F.lit(1)).alias("same"))

    dealt = slots_.select("h", "n", "best", F.lit(None).cast("bigint").alias("same"))
    dealt = dealt.unionByName(texts.select("h", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast(slots_.schema["best"].dataType).alias("best"), "same"))
    dealt = dealt.withColumn("slot", F.shiftrightunsigned("h", 64 - MAX_DEPTH).cast("int"))
    dealt = dealt.withColumn("slot", F.shiftright("slot", MAX_DEPTH - depth)).join(F.broadcast(directory_), "slot").drop("slot")
    owned = dealt.repartition("bucket").sortWithinPartitions("bucket", "h")
    index = owned.groupBy("bucket", "h").agg(  # in place: a hash lies in one bucket
        F.max("n").alias("n"), F.max("best").alias("best"), F.count("same").alias("chain"), F.sum("same").alias("same")
    )
    index = common.materialise(index, "index", rows)
    common.discard(slots_)

    one = index.where("chain = 1 and same = n").select("h", "n", "best")
    apart = common.in_bitmap(entries, bitmap, "h", bits, inside=False)
    alone = apart.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    shared = common.by_key(common.in_bitmap(entries, bitmap, "h", bits), one.withColumn("size", F.col("n")), ["h"], "size", rows)
    out = alone.unionByName(_decided(shared))

    mixed = index.where("chain > 1").select("h")
    if not mixed.isEmpty():
        mixed = common.materialise(mixed, "mixed", rows=0)
        own = common.materialise(norm.join(mixed, "h", "left_semi").withColumn("row", F.monotonically_increasing_id()), "collisions")
        groups = own.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("n"), F.min(_rank()).alias("best"))
        out = out.unionByName(_decided(own.join(groups, ["h", "norm"]).withColumn("sha", digest(F.col("norm")))))
    return out
