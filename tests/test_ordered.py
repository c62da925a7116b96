"""Running sums over wide, null, hot and tied orders, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics, mix, pack, split
from tessera.operators.ordered import in_ranges, ranked, running_minima, running_sums


def first(x):
    """Nulls first."""
    return (x is not None, x)


def loop(rows):
    out, sums = [], {}
    for k, o, n in sorted(rows, key=lambda r: (first(r[0]), first(r[1]), r[2])):
        sums[k] = sums.get(k, 0) + n
        out.append((k, o, n, sums[k]))
    return sorted(out, key=repr)


def hard_rows(n=600, seed=3):
    rng = random.Random(seed)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.getrandbits(63) - 2**62, rng.randrange(9)) for i in range(n)]
    return rows + [(None, None, 5), ("hot", None, 2), ("a", -(2**62) - 5, 1), ("a", 2**62 + 5, 1), ("one", 0, 7)]


def test_sums_of_wide_orders_null_keys_and_a_hot_key(spark):
    rows = hard_rows()
    df = spark.createDataFrame(rows, "k string, o bigint, n bigint").repartition(5)
    for ranges in (1, 7):
        got = [(r.k, r.o, r.n, r.s) for r in running_sums(df, "o", {"s": F.col("n")}, ("k",), ranges=ranges).collect()]
        assert sorted(got, key=repr) == loop(rows)
    whole = sorted(r.rn for r in ranked(df, ("k", "o"), "rn").collect())
    assert whole == list(range(1, len(rows) + 1))


def test_ranges_are_even_and_in_order(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.xxhash64("id").alias("o"))
    placed = in_ranges(df, "o", ("k",), ranges=16)
    sizes = sorted(r["count"] for r in placed.groupBy("__r").count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2.5 * 20_000 / 16
    edges = [(r.a, r.b) for r in placed.groupBy("__r").agg(F.min(F.struct("k", "o")).alias("a"), F.max(F.struct("k", "o")).alias("b")).orderBy("__r").collect()]
    assert all(x[1] < y[0] for x, y in zip(edges, edges[1:]))


def test_equal_orders_are_told_apart_by_the_row(spark):
    df = spark.createDataFrame([(1, x) for x in "abcabc"], "o int, x string")
    seen = {tuple(sorted((r.x, r.rn) for r in ranked(df.repartition(n), "o", "rn").collect())) for n in (1, 3)}
    assert len(seen) == 1 and sorted(rn for _, rn in seen.pop()) == [1, 2, 3, 4, 5, 6]


def test_orders_that_descend_and_an_empty_table(spark):
    df = spark.createDataFrame([(5,), (None,), (9,)], "o int")
    got = {r.o: r.rn for r in ranked(df, F.col("o").desc_nulls_last(), "rn").collect()}
    assert got == {9: 1, 5: 2, None: 3}
    assert ranked(df.limit(0), "o", "rn").count() == 0


def test_minima_and_means_keep_null_series(spark):
    rows = [(None, 1, 5.0), (None, 2, 3.0), ("a", 1, 4.0), ("a", None, 9.0)]
    df = spark.createDataFrame(rows, "s string, o bigint, v double")
    low = {(r.s, r.o): r.m for r in running_minima(df, "o", "v", "m", ("s",)).collect()}
    assert low == {(None, 1): None, (None, 2): 5.0, ("a", None): None, ("a", 1): 9.0}
    assert metrics.trailing_mean(df, "s", "o", "v").count() == 4
    assert metrics.running_best(df, "s", "o", "v").count() == 4


def test_splits_keep_null_orders_and_buckets(spark):
    rows = [(None, 3, "val", None), (1, 2, "train", None), (2, None, "train", "a"), (3, 4, "val", "a")]
    df = spark.createDataFrame(rows, "i bigint, n bigint, side string, b string")
    assert split.saturating_split(df, "i", "n", "side", 100, 100).count() == 4
    got = {r.i: r.split for r in split.bucketed_saturating_split(df, "i", "n", "side", "b", 100, 3).collect()}
    assert got == {None: "val", 1: "train", 2: "train", 3: "val"}
    cut = {r.i: r.split for r in split.saturating_split(df, "i", "n", "side", 100, 3).collect()}
    assert cut == {None: "val", 1: "train", 2: "train", 3: "train"}
    assert split.budget_prefix(df, "i", "n", 4).count() == 2


def test_sources_without_weight_go_and_null_orders_stay(spark):
    df = spark.createDataFrame([("x", None), ("x", 2**62), ("y", 1), (None, 1), ("z", 1)], "s string, i bigint")
    out = mix.interleave(df, "s", "i", {"x": 2, "y": 1, "z": 0}).orderBy("out_pos").collect()
    assert [r.out_pos for r in out] == [1, 2, 3] and [r.i for r in out if r.s == "x"] == [None, 2**62]


@pytest.mark.parametrize("n", [None, "n"])
def test_blocks_of_tied_and_null_orders(spark, n):
    df = spark.createDataFrame([(1, [1, 2], 2), (1, [3], 1), (None, [4, 5], 2), (7, [], 0), (2**62, [6], 1)], "d bigint, ids array<int>, n bigint")
    blocks = {r.block_id: r.tokens for r in pack.pack_blocks(df, "d", "ids", 2, drop_tail=False, n=n).collect()}
    assert sorted(blocks) == [0, 1, 2] and blocks[0] == [4, 5] and sorted(x for b in blocks.values() for x in b) == [1, 2, 3, 4, 5, 6] and blocks[2][-1:] == [6]
