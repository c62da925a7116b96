"""A corpus in one call: split, mixed, cut into shards of each split, committed at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import hash_split
from tessera.operators.ordered import Order
from tessera.operators.split import bucketed_saturating_split
from tessera.sources.commit_log import CommitLog, Version
from tessera.sources.token_source import manifest, read_tokens, write_tokens


@dataclass
class Plan:
    """What a build does with its rows: the share of val rows by content, the token budgets
    (val's for each bucket), the ids a shard."""

    train_budget: int
    val_budget: int
    shard_size: int
    val_percent: float = 2.0
    dtype: str = "uint16"
    drop_tail: bool = False
    keep: int = 3


def targets(df: DataFrame, order: Order, n: str, bucket: str, text: str, plan: Plan) -> DataFrame:
    """Rows that the budgets have room for, and their target: train, or val/<bucket>. A null
    bucket's is val/none."""
    sides = df.withColumn("__side", hash_split(text, plan.val_percent)).drop(text)
    placed = bucketed_saturating_split(sides, order, n, "__side", bucket, plan.train_budget, plan.val_budget)
    return placed.withColumn("target", F.when(F.col("split") == "train", "train").otherwise(F.concat(F.lit("val/"), F.coalesce(F.col(bucket).cast("string"), F.lit("none"))))).drop("__side", "split")


def build(df: DataFrame, root: str, plan: Plan, key: str, bucket: str, text: str, ids: str, n: str) -> Version:
    """Write the shards of train and of each bucket's val below a new folder of root and make
    them the dataset's next version. key identifies a row and gives the order; ids are its
    tokens, n their number. Rows are split by light columns; ids meet their target in one
    join and their shard in one shuffle. Old versions are pruned."""
    spark = df.sparkSession
    log = CommitLog(spark, root)
    base, folder = log.latest(), log.new_folder()
    light = targets(df.select(key, bucket, text, n), key, n, bucket, text, plan).select(F.col(key).alias("__key"), "target")
    rows = df.select(key, ids, n).join(light, F.col(key) == F.col("__key")).drop("__key")
    write_tokens(rows, key, ids, f"{root.rstrip('/')}/{folder}", plan.shard_size, dtype=plan.dtype, drop_tail=plan.drop_tail, n=n, target="target")
    made = log.commit(base, [folder], dtype=plan.dtype)
    log.prune(plan.keep)
    return made


def built(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, tokens) of the latest version."""
    log = CommitLog(spark, root)
    version = log.latest()
    if not version.folders:
        raise FileNotFoundError(f"{root} has no version")
    path = f"{log.root}/{version.folders[-1]}"
    return manifest(spark, path), read_tokens(spark, path, version.about["dtype"])
