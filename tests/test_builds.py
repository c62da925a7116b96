"""Token shards as a source, versions, one-call builds and the training cursor."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators.cursor import Cursor, ahead, permuted, resumed
from tessera.operators.split import bucketed_saturating_split
from tessera.plans import builds
from tessera.sources.commit_log import CommitLog, Conflict
from tessera.sources.token_source import read_tokens, write_tokens


def ids_of(spark, path, **options):
    out = {}
    for r in read_tokens(spark, path, **options).orderBy("path", "part").collect():
        out.setdefault(r.path, []).extend(r.tokens)
    return out


def test_token_shards_are_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame([(2, [6, 0], "b"), (0, [1, 2, 0], "a"), (1, [3, 40_000, 5, 0], "a"), (3, [], None), (4, None, "a")], "d bigint, ids array<int>, t string")
    m = write_tokens(docs, "d", "ids", f"{tmp_path}/s", 4).orderBy("shard_id").collect()
    assert [(r.target, r.name, r.n_tokens) for r in m] == [("", "train-00000.bin", 4), ("", "train-00001.bin", 4), ("", "train-00002.bin", 1)]
    assert ids_of(spark, f"{tmp_path}/s", ids_a_row=3) == {"train-00000.bin": [1, 2, 0, 3], "train-00001.bin": [40_000, 5, 0, 6], "train-00002.bin": [0]}
    assert write_tokens(docs, "d", "ids", f"{tmp_path}/f", 4, drop_tail=True).count() == 2 == len(ids_of(spark, f"{tmp_path}/f"))
    by = write_tokens(docs, "d", "ids", f"{tmp_path}/t", 4, dtype="uint32", target="t")
    assert {(r.target, r.shard_id, r.n_tokens) for r in by.collect()} == {("a", 0, 4), ("a", 1, 3), ("b", 0, 2)}
    assert ids_of(spark, f"{tmp_path}/t", dtype="uint32")["a/train-00001.bin"] == [40_000, 5, 0]
    with pytest.raises(Exception, match="holds files"):
        write_tokens(docs, "d", "ids", f"{tmp_path}/s", 4)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, [i, 70_000 if i == 9 else 1]) for i in range(12)], "d bigint, ids array<int>")
    with pytest.raises(Exception, match="does not fit"):
        write_tokens(docs, "d", "ids", f"{tmp_path}/s", 2)
    assert not os.path.exists(f"{tmp_path}/s") or not [f for _, _, names in os.walk(f"{tmp_path}/s") for f in names]


def test_of_two_writers_one_wins(spark, tmp_path):
    root = f"file://{tmp_path}/data"
    one, two = CommitLog(spark, root), CommitLog(spark, root)
    assert one.latest().number == 0
    base = two.latest()
    one.commit(one.latest(), ["x"], dtype="uint16")
    with pytest.raises(Conflict):
        two.commit(base, ["y"])
    (tmp_path / "data/_log/.dead.tmp").write_text('{"fold')  # a writer that died
    assert one.latest().folders == ["x"] and two.latest().about == {"dtype": "uint16"}
    for i in range(4):
        (tmp_path / f"data/f{i}").mkdir()
        two.commit(two.latest(), [f"f{i}"])
    (tmp_path / "data/new").mkdir()
    assert two.prune(keep=2) == ["f0", "f1", "x"]
    assert sorted(os.listdir(tmp_path / "data")) == ["_log", "f2", "f3", "new"] and one.numbers() == [5, 4]


def test_a_build_is_its_split(spark, tmp_path):
    rows = [(i, "ab"[i % 3 == 0] if i % 7 else None, f"text {i}", [i % 200] * (i % 5 + 1), i % 5 + 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "d bigint, b string, text string, ids array<int>, n bigint")
    plan = builds.Plan(train_budget=600, val_budget=40, shard_size=64, val_percent=30.0)
    root = f"file://{tmp_path}/corpus"
    assert builds.build(docs, root, plan, "d", "b", "text", "ids", "n").number == 1
    manifest, tokens = builds.built(spark, root)
    want = {}
    side = docs.withColumn("side", builds.hash_split("text", 30.0))
    for r in bucketed_saturating_split(side, "d", "n", "side", "b", 600, 40).orderBy("d").collect():
        want.setdefault("train" if r.split == "train" else f"val/{r.b or 'none'}", []).extend(r.ids)
    got = {}
    for r in tokens.orderBy("path", "part").collect():
        got.setdefault(r.path.rpartition("/")[0], []).extend(r.tokens)
    assert got == want and set(want) == {"train", "val/a", "val/b", "val/none"}
    assert {r.target: r.n for r in manifest.groupBy("target").agg(F.sum("n_tokens").alias("n")).collect()} == {k: len(v) for k, v in want.items()}
    assert manifest.agg(F.max("n_tokens")).first()[0] == 64
    assert builds.build(docs, root, plan, "d", "b", "text", "ids", "n").number == 2


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1024, 5000])
def test_an_epoch_is_a_permutation(spark, n):
    there = permuted(spark.range(n), "id", "b", n, seed=7, epoch=1)
    rows = permuted(there, "b", "back", n, seed=7, epoch=1, inverse=True).collect()
    assert sorted(r.b for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    if n > 90:
        other = [r.b for r in permuted(spark.range(n), "id", "b", n, seed=7, epoch=2).orderBy("id").collect()]
        own = [r.b for r in sorted(rows)]
        assert other != own and sum(a < b for a, b in zip(own, own[1:])) in range(int(0.4 * n), int(0.6 * n))


def test_a_cursor_resumes_where_it_stood(spark):
    start = Cursor(seed=3, blocks=1000, world=4, batch=8)
    assert start.steps == 31
    whole = [tuple(r) for r in ahead(spark, start).orderBy("position").collect()]
    assert len(whole) == 31 * 32 and len({r[4] for r in whole}) == 31 * 32
    at = Cursor(**start.after(12).saved())
    assert [tuple(r) for r in ahead(spark, at).orderBy("position").collect()] == whole[12 * 32 :]
    assert [tuple(r) for r in ahead(spark, at, 2).orderBy("position").collect()] == whole[12 * 32 : 14 * 32]
    blocks = spark.range(1000).withColumnRenamed("id", "block_id")
    left = resumed(blocks, at)
    assert {(r.position, r.block_id) for r in left.collect()} == {(r[3], r[4]) for r in whole[12 * 32 :]}
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert (start.after(31).epoch, start.after(31 * 2 + 5).step) == (1, 5)
    assert ahead(spark, Cursor(1, 10, 4, 8)).count() == 0
