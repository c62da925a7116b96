"""Streams with state: bounds, flushes, restarts, pauses and stops."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.streaming import dedup as streams
from tessera.streaming.control import Control, run_until_stopped
from tessera.streaming.stateful import dedup_bounded, flush_by_count_or_time

SCHEMA = "doc_id bigint, text string"


def add(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, schema=SCHEMA, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def loop(rows, capacity, bucket):
    """The rows kept by memories that are emptied when full."""
    seen, kept = {}, []
    for i, t in rows:
        own = seen.setdefault(bucket(t), set())
        if t not in own:
            own.add(t)
            kept.append(i)
            if len(own) >= capacity:
                own.clear()
    return kept


def test_bounded_dedup_over_many_batches(spark, tmp_path):
    import hashlib
    import random

    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(40)}") for i in range(200)]
    for i in range(20):  # a file a batch, in the order of writing
        add(spark, f"{tmp_path}/in", rows[10 * i : 10 * i + 10])
        time.sleep(0.02)
    bucket = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 2
    out = streams.run_to_end(dedup_bounded(source(spark, f"{tmp_path}/in"), "doc_id", 10, buckets=2), f"{tmp_path}/out")
    assert sorted(r.doc_id for r in out.collect()) == loop(rows, 5, bucket)
    state = spark.read.format("statestore").option("path", f"{tmp_path}/out/state").option("stateVarName", "seen").load()
    assert state.count() <= 10
    add(spark, f"{tmp_path}/in", more := [(200 + i, f"text {rng.randrange(40)}") for i in range(30)])
    again = streams.run_to_end(dedup_bounded(source(spark, f"{tmp_path}/in"), "doc_id", 10, buckets=2), f"{tmp_path}/out")
    assert sorted(r.doc_id for r in again.collect()) == loop(rows + more, 5, bucket)
    with pytest.raises(ValueError):
        dedup_bounded(source(spark, f"{tmp_path}/in"), "doc_id", 1, buckets=2)


def test_flush_by_count_and_by_time(spark, tmp_path):
    schema = "k string, x bigint"
    add(spark, f"{tmp_path}/in", [("a", i) for i in range(20)] + [("b", 100)], schema)
    stream = flush_by_count_or_time(source(spark, f"{tmp_path}/in", schema), "k", "x", items=8, wait_ms=1500)

    def start(trigger):
        return stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(**trigger).start()

    streams.run_to_end(stream, f"{tmp_path}")
    read = lambda: sorted((r.k, r.group_no, r.flushed_by, [int(x) for x in r.items]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    first = read()
    assert [(k, n, by) for k, n, by, _ in first if by == "count"] == [("a", 0, "count"), ("a", 1, "count")]
    # a restart: what was held is neither lost nor doubled, and goes out once it has waited
    query = start({"processingTime": "300 milliseconds"})
    add(spark, f"{tmp_path}/in", [("c", 7)], schema)
    deadline = time.time() + 50
    while len(read()) < 5 and time.time() < deadline:
        time.sleep(0.5)
    query.stop()
    got = read()
    assert {(k, by) for k, _, by, _ in got} == {("a", "count"), ("a", "time"), ("b", "time"), ("c", "time")}
    assert sorted(x for *_, items in got for x in items) == sorted([*range(20), 7, 100])


def test_budget_leaves_a_row_a_batch(spark, tmp_path):
    for i in range(6):
        add(spark, f"{tmp_path}/documents.parquet", [(i, "x" * 9)])
        time.sleep(0.02)
    taken = streams.stream_budget(spark, f"{tmp_path}", f"{tmp_path}/b", 35)
    assert taken.count() == 4
    add(spark, f"{tmp_path}/documents.parquet", [(7, "x")])
    assert streams.stream_budget(spark, f"{tmp_path}", f"{tmp_path}/b", 45).count() == 5
    assert spark.read.parquet(f"{tmp_path}/b/used/epoch=1").count() == 1


def test_a_stream_is_paused_stopped_and_resumed(spark, tmp_path):
    control = Control(spark, f"{tmp_path}/control")
    for i in range(6):
        add(spark, f"{tmp_path}/in", [(i, "x")])
        time.sleep(0.02)
    done = []

    def batch(df, epoch):
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/epoch={epoch}")
        done.append(epoch)
        if len(done) == 2:
            control.ask("pause")

    def start():
        return source(spark, f"{tmp_path}/in").writeStream.foreachBatch(control.gate(batch)).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="0 seconds").start()

    first = threading.Thread(target=run_until_stopped, args=(start, control))
    first.start()
    deadline = time.time() + 60
    while len(done) < 2 and time.time() < deadline:
        time.sleep(0.1)
    time.sleep(1.5)
    assert len(done) == 2  # paused
    control.withdraw("pause")
    while len(done) < 4 and time.time() < deadline:
        time.sleep(0.05)
    control.ask("stop")
    first.join(60)
    assert not first.is_alive()
    control.withdraw("stop")
    second = threading.Thread(target=run_until_stopped, args=(start, control))
    second.start()
    rows = lambda: sorted(r.doc_id for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect())
    while rows() != list(range(6)) and time.time() < deadline:
        time.sleep(0.5)
    control.ask("stop")
    second.join(60)
    assert rows() == list(range(6))


def test_budget_does_not_go_by_the_order_of_files(spark, tmp_path):
    for i in reversed(range(6)):  # the last documents come first, and in two batches
        add(spark, f"{tmp_path}/documents.parquet", [(2 * i, "x" * 9), (2 * i + 1, "y" * 4)])
        time.sleep(0.02)
    taken = streams.stream_budget(spark, f"{tmp_path}", f"{tmp_path}/b", 38)
    assert sorted(map(tuple, taken.collect())) == [(0, 10), (1, 5), (2, 10), (3, 5), (4, 10)]
    add(spark, f"{tmp_path}/documents.parquet", [(-1, "z" * 19), (50, "z")])
    assert sorted(r.doc_id for r in streams.stream_budget(spark, f"{tmp_path}", f"{tmp_path}/b", 38).collect()) == [-1, 0, 1, 2]


def test_bounded_dedup_does_not_go_by_the_order_of_files(spark, tmp_path):
    import hashlib
    import random

    rng = random.Random(5)
    rows = [(i, f"text {rng.randrange(40)}") for i in range(240)]
    for i in reversed(range(6)):
        add(spark, f"{tmp_path}/documents.parquet", rows[40 * i : 40 * i + 40])
        time.sleep(0.02)
    bucket = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 2
    want = loop(rows, 5, bucket)
    out = streams.stream_dedup_bounded(spark, f"{tmp_path}", f"{tmp_path}/a", 10, 2)
    assert sorted(r.doc_id for r in out.collect()) == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", streams.content_key().alias("digest"))
    kept = lambda s: dedup_bounded(s, "doc_id", 10, 2, digest="digest").select("doc_id")
    # several ranges, and a second run of the same folder adds nothing
    for _ in range(2):
        again = streams.run_in_order(docs, "doc_id", "digest", kept, f"{tmp_path}/b", rows=80)
        assert sorted(r.doc_id for r in again.collect()) == want
    assert spark.read.parquet(f"{tmp_path}/b/ordered").select("__r").distinct().count() == 3
