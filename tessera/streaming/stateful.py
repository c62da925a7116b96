"""Streams with keyed state: bounded deduplication, and flushing by count or by time.

State lies in RocksDB stores that Spark checkpoints with the stream, so a restart goes on
where the last run ended: no row is lost or doubled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.dedup import content_key
from tessera.operators.ordered import quoted

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocks(spark: SparkSession) -> None:
    """Keyed state of several kinds needs this store; a session that names one keeps it."""
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKS)


class BoundedDedup(StatefulProcessor):
    """Keeps the first row of each digest of its key, with a memory of `capacity` digests
    that is emptied when it is full; the digest that fills it is forgotten too."""

    def __init__(self, capacity: int, order: str, ttl_ms: int | None = None):
        self.capacity, self.order, self.ttl_ms = capacity, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "h string", "there boolean", self.ttl_ms)
        self.kept = handle.getValueState("kept", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # rows are structs, so that no null makes a whole number a double
        batch = [(r[self.order], h, r) for frame in rows for h, r in zip(frame["digest"], frame["row"], strict=True)]
        batch.sort(key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1]))
        n = self.kept.get()[0] if self.kept.exists() else 0
        mine: set[str] = set()  # known since the batch began, or since the memory was emptied in it
        new: list[str] = []
        keep, emptied = [], False
        for _, h, row in batch:
            if h in mine:
                continue
            mine.add(h)
            if not emptied and self.seen.containsKey((h,)):
                continue
            keep.append(row)
            new.append(h)
            n += 1
            if n >= self.capacity:
                n, emptied = 0, True
                mine.clear(), new.clear()
        if emptied:
            self.seen.clear()
        for h in new:
            self.seen.updateValue((h,), (True,))
        self.kept.update((n,))
        yield pd.DataFrame({"row": keep})

    def close(self) -> None:
        pass


def dedup_bounded(stream: DataFrame, order: str, capacity: int, buckets: int = 16, text: str = "text", ttl_ms: int | None = None, digest: str | None = None) -> DataFrame:
    """The rows whose stripped text the stream has not seen lately. Texts are dealt by their
    digest to `buckets` memories of capacity / buckets digests each, so that state never has
    more than `capacity` rows, and none is a hot key. Rows of a batch come in the order of
    `order`, the digest telling ties apart; batches come one after the other. ttl_ms: forget
    a digest after so long, too. Null texts are empty ones. digest: a column that holds
    content_key of the texts already, in their stead; rows then need no texts, and a batch's
    rows of a bucket, which a task holds, are light."""
    if capacity < buckets:
        raise ValueError("a memory for each bucket at least")
    rocks(stream.sparkSession)
    key = content_key(text) if digest is None else quoted(digest)
    bucket = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") % buckets
    keyed = stream.select(bucket.cast("int").alias("bucket"), key.alias("digest"), F.struct(*[quoted(c) for c in stream.columns]).alias("row"))
    own, out = BoundedDedup(capacity // buckets, order, ttl_ms), T.StructType([T.StructField("row", stream.schema)])
    return keyed.groupBy("bucket").transformWithStateInPandas(own, outputStructType=out, outputMode="append", timeMode="ProcessingTime" if ttl_ms else "none").select("row.*")


class CountOrTime(StatefulProcessor):
    """Holds a key's items until there are `items` of them or the first has waited for
    `wait_ms`, then gives them out as one group."""

    def __init__(self, items: int, wait_ms: int):
        self.items, self.wait_ms = items, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "item string")
        self.groups = handle.getValueState("groups", "n bigint")

    def _group(self, key, items: list[str], by: str) -> pd.DataFrame:
        n = self.groups.get()[0] if self.groups.exists() else 0
        self.groups.update((n + 1,))
        return pd.DataFrame({"key": [key[0]], "group_no": [n], "flushed_by": [by], "items": [items]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items = [x[0] for x in self.held.get()]
        waiting = bool(items)
        flushed = False
        for frame in rows:
            items.extend(frame["item"].tolist())
            while len(items) >= self.items:
                flushed = True
                yield self._group(key, items[: self.items], "count")
                del items[: self.items]
        if flushed or not waiting:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            if items:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        if items:
            self.held.put([(x,) for x in items])
        else:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        items = [x[0] for x in self.held.get()]
        self.held.clear()
        if items:
            yield self._group(key, items, "time")

    def close(self) -> None:
        pass


def flush_by_count_or_time(stream: DataFrame, key: str, item: str, items: int = 8, wait_ms: int = 2000) -> DataFrame:
    """(key, group_no, flushed_by, items): items of a key in groups of `items`, or fewer once
    the first has waited for wait_ms. Items are strings; what is still held when a query
    stops is given out by the next run, once that has had a batch with rows. State holds fewer than `items` items a key."""
    rocks(stream.sparkSession)
    keyed = stream.select(quoted(key).alias("key"), quoted(item).cast("string").alias("item"))
    out = T.StructType([T.StructField("key", keyed.schema["key"].dataType), T.StructField("group_no", T.LongType()), T.StructField("flushed_by", T.StringType()), T.StructField("items", T.ArrayType(T.StringType()))])
    return keyed.groupBy("key").transformWithStateInPandas(CountOrTime(items, wait_ms), outputStructType=out, outputMode="append", timeMode="ProcessingTime").withColumnRenamed("key", key)
