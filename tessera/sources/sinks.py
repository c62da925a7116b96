"""Sinks: manifests of fixed-size shards, retention and JSON reports. Shards themselves are
written by token_source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import slices, spans


def shard_manifest(df: DataFrame, order: str, n: str, size: int, drop_tail: bool = False) -> DataFrame:
    """shard_id, n_tokens, first_pos of the shards that the rows' tokens fill."""
    cut = slices(spans(df, order, n), size, "shard_id").groupBy("shard_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("n_tokens"), F.min("lo").alias("first_pos"))
    return cut.where(F.col("n_tokens") == size) if drop_tail else cut


def newest(df: DataFrame, owner: str, order: list, keep: int = 3) -> DataFrame:
    """The newest rows of each owner."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).where(F.col("__n") <= keep).drop("__n")


def append_lines(df: DataFrame, out: str) -> None:
    """Rows added to a folder of JSON lines; files of its own for each task, no lock."""
    df.write.mode("append").json(out)


def report(df: DataFrame, out: str) -> None:
    """One JSON object a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(out)
