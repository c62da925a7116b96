"""Exact deduplication that keeps the first row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import strip
from tessera.operators.ordered import carried, in_ranges, ranked, same
from tessera.tables import scratch


def content_key(text: str = "text") -> Column:
    return F.md5(strip(text).cast("binary"))


def keep_first(df: DataFrame, order: str, text: str = "text") -> DataFrame:
    """(order) of the first row of each stripped text. Sums meet on the map side, so
    copies of one text are a row a task."""
    return df.groupBy(content_key(text).alias("__h")).agg(F.min(order).alias(order)).select(order)


def keep_first_bounded(df: DataFrame, order: str, capacity: int, text: str = "text", ranges: int | None = None) -> DataFrame:
    """(order) of the rows that a memory of `capacity` kept texts, emptied when full, takes
    for new.

    A row is new if the previous row of its text comes before the place where the memory was
    last emptied. Previous places are found once, over ranges of (text, place), so that a
    text of most rows is cut too; rows are then cut into ranges of their place. The ranges
    are walked in turn, each by a task that starts with two numbers of the one before: where
    the memory was emptied, and how many it holds. So there are as many shuffles and passes
    however often it fills, and as many steps as ranges. Null orders come first, equal ones by
    the row's digest."""
    spark = df.sparkSession
    keyed = ranked(df.select(F.col(order), content_key(text).alias("__h")), order, "__at")
    placed = in_ranges(keyed, "__at", ("__h",))
    if placed.isEmpty():
        return df.select(order).limit(0)
    base = carried(placed, ("__h",), {"at": (F.max("__at"), F.max)})
    own = F.lag("__at").over(Window.partitionBy("__r", "__h").orderBy("__at"))
    lagged = placed.withColumn("__o", own)
    linked = lagged.join(base, same(lagged, base, ("__h",)), "left").select("__at", F.coalesce("__o", "__b_at", F.lit(0).cast("bigint")).alias("before"), F.col(order))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "links")
    linked.repartitionByRange(ranges, "__at").withColumn("r", F.spark_partition_id()).write.partitionBy("r").parquet(path)
    table = spark.read.parquet(path)
    schema = T.StructType([T.StructField("kept", T.BooleanType()), T.StructField("emptied", T.LongType()), T.StructField("held", T.LongType()), df.schema[order]])
    out = scratch(spark, "kept")
    emptied, held = 1, 0
    for r in sorted(x.r for x in table.select("r").distinct().collect()):  # a number for each range
        part = spark.read.schema(table.drop("r").schema).parquet(f"{path}/r={r}").repartition(1).sortWithinPartitions("__at")
        part.mapInArrow(_walk(emptied, held, capacity, schema.names), schema).write.parquet(f"{out}/r={r}")
        emptied, held = spark.read.schema(schema).parquet(f"{out}/r={r}").where("not kept").select("emptied", "held").first()
    return spark.read.schema(schema).parquet(f"{out}/r=*").where("kept").select(order)


def _walk(emptied: int, held: int, capacity: int, names: list[str]):
    """Rows kept of a range in the order of its places, and a last row: the memory's state."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, n = emptied, held
        kind = None
        for batch in batches:
            at, before, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.schema.field(2).type
            kept, i = [], 0
            while i < len(at):
                new = i + np.flatnonzero(before[i:] < start)
                if n + len(new) < capacity:
                    kept.append(new)
                    n += len(new)
                    break
                new = new[: capacity - n]
                kept.append(new)
                i, n = int(new[-1]) + 1, 0
                start = int(at[i - 1]) + 1
            rows = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(rows), bool)), none, none, batch.column(2).take(pa.array(rows))], names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([False]), pa.array([start]), pa.array([n]), pa.nulls(1, kind)], names)

    return step


def new_rows(df: DataFrame, corpus: DataFrame, text: str = "text") -> DataFrame:
    """Rows of df whose text is not in the corpus."""
    return df.withColumn("__h", content_key(text)).join(corpus.select(content_key(text).alias("__h")).distinct(), "__h", "left_anti").drop("__h")
