"""Pausing and stopping a running stream from outside.

Markers are files in a folder that all can reach; a listener looks for them when a batch
has ended. A stopped query's checkpoint holds what it has done, so that the same query
started again goes on after it."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Control:
    """The markers of one stream: ask() sets one, withdraw() takes it away."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, what: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{what}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def ask(self, what: str) -> None:
        fs, path = self._path(what)
        fs.create(path, True).close()

    def withdraw(self, what: str) -> None:
        fs, path = self._path(what)
        fs.delete(path, False)

    def asked(self, what: str) -> bool:
        fs, path = self._path(what)
        return fs.exists(path)

    def gate(self, batch: Callable[[DataFrame, int], None], poll_s: float = 0.2) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a batch begins only while no pause is asked for."""

        def held(df: DataFrame, epoch: int) -> None:
            while self.asked("pause") and not self.asked("stop"):
                time.sleep(poll_s)
            batch(df, epoch)

        return held


class _BatchEnds(StreamingQueryListener):
    """Sets an event when a batch of one query has ended, or the query itself."""

    def __init__(self) -> None:
        self.id, self.event = None, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self.id in (None, str(event.progress.id)):
            self.event.set()

    def onQueryIdle(self, event) -> None:
        if self.id in (None, str(event.id)):
            self.event.set()

    def onQueryTerminated(self, event) -> None:
        self.event.set()


def run_until_stopped(start: Callable[[], StreamingQuery], control: Control, poll_s: float = 0.5) -> StreamingQuery:
    """Start a query and wait until it ends, or a stop is asked for when a batch ends: the
    batch under way then is done again, from the same offsets, by the next run."""
    spark, ends = control.spark, _BatchEnds()
    spark.streams.addListener(ends)
    try:
        query = start()
        ends.id = str(query.id)
        while query.isActive:
            ends.event.wait(poll_s)
            ends.event.clear()
            if control.asked("stop"):
                query.stop()
        if query.exception() is not None:
            raise query.exception()
        return query
    finally:
        spark.streams.removeListener(ends)
