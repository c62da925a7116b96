"""Splits under token budgets, set-based.

Rows come in the order of `order`, null orders first and equal ones by the digest of
the row; null counts of tokens count as none. Where a split turns is told by position,
so that no order is compared with another's value. A null bucket is a bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import Order, running_sums


def saturating_split(df: DataFrame, order: Order, n: str, side: str, train_budget: int, val_budget: int) -> DataFrame:
    """Rows follow their side until one side is full; later rows go to the other
    until it is full too, and no further. Adds `split`."""
    train = F.col(side) == "train"
    own = F.coalesce(F.col(n), F.lit(0))
    r = running_sums(df, order, {"__at": F.lit(1), "__ct": F.when(train, own).otherwise(0), "__cv": F.when(train, 0).otherwise(own)})
    full = (F.col("__ct") >= train_budget) | (F.col("__cv") >= val_budget)
    cut = r.where(full).agg(F.min(F.struct("__at", "__ct", "__cv"))).first()[0]
    if cut is None:
        return r.withColumn("split", F.col(side)).drop("__at", "__ct", "__cv")
    other, left = ("val", val_budget - cut["__cv"]) if cut["__ct"] >= train_budget else ("train", train_budget - cut["__ct"])
    since = F.col("__ct") + F.col("__cv") - own - (cut["__ct"] + cut["__cv"])
    before = F.col("__at") <= cut["__at"]
    out = r.withColumn("split", F.when(before, F.col(side)).when(since < left, F.lit(other)))
    return out.where("split is not null").drop("__at", "__ct", "__cv")


def bucketed_saturating_split(df: DataFrame, order: Order, n: str, side: str, bucket: str, train_budget: int, val_budget: int) -> DataFrame:
    """As above with a budget for each bucket's val rows. A val row of a full bucket
    counts as train; once train is full val rows fill their buckets, whatever their
    side, and once all buckets are full everything goes to train."""
    val, own = F.col(side) == "val", F.coalesce(F.col(n), F.lit(0))
    b = running_sums(df, order, {"__bv": F.when(val, own).otherwise(0)}, (bucket,))
    b = b.withColumn("__to", F.when(val & (F.col("__bv") - own < val_budget), "val").otherwise("train"))
    r = running_sums(b, order, {"__at": F.lit(1), "__ct": F.when(F.col("__to") == "train", own).otherwise(0)})
    # where train is full, and where the last of the buckets is, if all are; a row comes to the driver
    each = r.groupBy(bucket).agg(F.min(F.when(F.col("__ct") >= train_budget, F.col("__at"))).alias("tp"), F.min(F.when(F.col("__bv") >= val_budget, F.col("__at"))).alias("vp"))
    tp, vp = each.agg(F.min("tp"), F.when(F.count("vp") == F.count(F.lit(1)), F.max("vp"))).first()
    drop = ("__bv", "__ct", "__to", "__at")
    if tp is None and vp is None:
        return r.withColumn("split", F.col("__to")).drop(*drop)
    train_full = tp is not None and (vp is None or tp <= vp)
    late = F.col("__at") > (tp if train_full else vp)
    if train_full:
        had = F.when(~late & (F.col("__to") == "val"), own).otherwise(0)
        s = running_sums(r, order, {"__since": F.when(late, own).otherwise(0), "__had": had}, (bucket,))
        out = s.withColumn("split", F.when(~late, F.col("__to")).when(F.col("__since") - own < val_budget - F.col("__had"), "val")).drop("__since", "__had")
    else:
        had = r.where(~late & (F.col("__to") == "train")).agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
        s = running_sums(r, order, {"__since": F.when(late, own).otherwise(0)})
        out = s.withColumn("split", F.when(~late, F.col("__to")).when(F.col("__since") - own < train_budget - had, "train")).drop("__since")
    return out.where("split is not null").drop(*drop)


def budget_by_shard(df: DataFrame, order: Order, n: str, target: int, shard: int) -> DataFrame:
    """Rows until the shards that are full hold the target, so past it by a shard at
    most. Adds `running`."""
    r = running_sums(df, order, {"running": F.col(n)})
    return r.where(F.col("running") - F.coalesce(n, F.lit(0)) < -(-target // shard) * shard)


def budget_prefix(df: DataFrame, order: Order, n: str, target: int) -> DataFrame:
    """Rows until the target is reached, the last one passing it. Adds `running`."""
    return running_sums(df, order, {"running": F.col(n)}).where(F.col("running") - F.coalesce(n, F.lit(0)) < target)
