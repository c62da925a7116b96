"""Fixed-length blocks of the concatenated token stream, and how they are sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import md5_word
from tessera.operators.ordered import Order, columns_of, slices, spans


def placed_ids(df: DataFrame, order: Order, ids: str, n: str | None = None, key: str | None = None) -> DataFrame:
    """(start, end, ids) of each row in the concatenation (with key, in that of its value,
    which is kept). Only light rows are put in order
    (the order's columns, the number of ids and the row's digest); ids meet their places
    in one join on these. n: a column of the number of ids, so that it is known without
    making them. Null orders come first, null ids are none."""
    by = [*([F.col(key)] if key else []), *columns_of(order)]
    keys = [f"__k{i}" for i in range(len(by))]
    named = df.select(*[c.alias(k) for c, k in zip(by, keys, strict=True)], F.coalesce(F.col(n) if n else F.size(ids), F.lit(0)).cast("bigint").alias("__n"), F.col(ids).alias("__ids"))
    # equal rows of one order share a row of the light table, and take their turn in it
    light = named.groupBy(*keys, "__n").agg(F.count(F.lit(1)).alias("__copies")).withColumn("__all", F.col("__n") * F.col("__copies"))
    at = spans(light, [*keys, "__n"], "__all", keys[:1] if key else ()).select(*[F.col(k).alias(f"__a{k}") for k in [*keys, "__n"]], "__copies", "start")
    on = named["__n"] == at["__a__n"]
    for k in keys:
        on = on & named[k].eqNullSafe(at[f"__a{k}"])
    met = named.join(at, on)
    turn = Window.partitionBy(*keys, "__n").orderBy(F.xxhash64("__ids"))
    kept = ["__k0"] if key else []
    single = met.where("__copies = 1").select(*kept, "start", "__n", "__ids")
    several = met.where("__copies > 1").withColumn("start", F.col("start") + (F.row_number().over(turn) - 1) * F.col("__n")).select(*kept, "start", "__n", "__ids")
    return single.unionByName(several).select(*[F.col("__k0").alias(key) for _ in kept], "start", (F.col("start") + F.col("__n")).alias("end"), F.col("__ids").alias(ids))


def pieces(df: DataFrame, order: Order, ids: str, size: int, out: str, n: str | None = None, key: str | None = None) -> DataFrame:
    """(out, lo, p): the ids of each row cut at multiples of `size`; with key, that comes first."""
    at = slices(placed_ids(df, order, ids, n, key), size, out)
    return at.select(*([key] if key else []), out, "lo", F.slice(F.col(ids), (F.col("lo") - F.col("start") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("p"))


def pack_blocks(df: DataFrame, order: Order, ids: str, block: int, drop_tail: bool = True, n: str | None = None) -> DataFrame:
    """(block_id, tokens). Pieces of documents are shuffled, not tokens, and a block
    gathers no more than its length."""
    cut = pieces(df, order, ids, block, "block_id", n)
    blocks = cut.groupBy("block_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "p"))), lambda s: s["p"])).alias("tokens"))
    return blocks.where(F.size("tokens") == block) if drop_tail else blocks


def next_token_pairs(blocks: DataFrame) -> DataFrame:
    pairs = blocks.select("block_id", F.posexplode(F.arrays_zip(F.slice("tokens", F.lit(1), F.size("tokens") - 1).alias("x"), F.slice("tokens", F.lit(2), F.size("tokens") - 1).alias("y"))).alias("pos", "xy"))
    return pairs.select("block_id", "pos", "xy.x", "xy.y")


def draws(spark, n: int, k: int, seed: int, epoch: int = 0, rank: int = 0) -> DataFrame:
    """k draws with replacement of block ids under n: sample_no, block_id."""
    key = F.concat_ws(":", F.lit(seed), F.lit(epoch), F.lit(rank), F.col("id").cast("string"))
    return spark.range(k).select(F.col("id").alias("sample_no"), (md5_word(key) % n).alias("block_id"))


def shuffled(block_id: Column, seed: int) -> Column:
    """A 63-bit sort key that orders blocks at random."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), block_id.cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
