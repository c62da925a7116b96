"""Set-based operators against the loops they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup, mix, split


def loop_saturating(rows, tt, tv):
    t = v = 0
    out = []
    for i, n, side in rows:
        if t >= tt and v >= tv:
            break
        to = side
        if to == "train" and t >= tt:
            to = "val"
        elif to == "val" and v >= tv:
            to = "train"
        t, v = (t + n, v) if to == "train" else (t, v + n)
        out.append((i, to))
    return out


def loop_bucketed(rows, buckets, tt, tv):
    t, v = 0, dict.fromkeys(buckets, 0)
    out = []
    for i, n, side, b in rows:
        all_full = all(x >= tv for x in v.values())
        if t >= tt and all_full:
            break
        if all_full:
            to = "train"
        elif t >= tt:
            to = "val" if v[b] < tv else None
        else:
            to = "val" if side == "val" and v[b] < tv else "train"
        if to == "val":
            v[b] += n
        elif to == "train":
            t += n
        if to:
            out.append((i, to))
    return out


def rows_of(seed, n=60):
    rng = random.Random(seed)
    return [(i, rng.randint(1, 9), rng.choice(["train", "train", "val"]), rng.choice("ab")) for i in range(n)]


@pytest.mark.parametrize("seed, tt, tv", [(1, 100, 30), (2, 1000, 1000), (3, 40, 100), (4, 5, 3), (5, 120, 1)])
def test_saturating_split(spark, seed, tt, tv):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "i bigint, n bigint, side string, b string")
    got = sorted((r.i, r.split) for r in split.saturating_split(df, "i", "n", "side", tt, tv).collect())
    assert got == loop_saturating([r[:3] for r in rows], tt, tv)


def test_saturating_case(spark):
    rows = [(0, 3, "train"), (1, 2, "val"), (2, 3, "train"), (3, 4, "train"), (4, 1, "train")]
    df = spark.createDataFrame(rows, "i bigint, n bigint, side string")
    assert [r.split for r in split.saturating_split(df, "i", "n", "side", 5, 3).orderBy("i").collect()] == ["train", "val", "train", "val"]


@pytest.mark.parametrize("seed, tt, tv", [(1, 100, 20), (2, 1000, 1000), (3, 40, 30), (6, 150, 5), (7, 90, 12)])
def test_bucketed_split(spark, seed, tt, tv):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "i bigint, n bigint, side string, b string")
    got = sorted((r.i, r.split) for r in split.bucketed_saturating_split(df, "i", "n", "side", "b", tt, tv).collect())
    assert got == loop_bucketed(rows, "ab", tt, tv)


@pytest.mark.parametrize("seed", [1, 2])
def test_bounded_dedup(spark, seed):
    rng = random.Random(seed)
    texts = [rng.choice("abcdefg") for _ in range(50)]
    seen, want = set(), []
    for i, t in enumerate(texts):
        if t not in seen:
            seen.add(t)
            want.append(i)
            if len(seen) >= 3:
                seen = set()
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string")
    assert sorted(r.i for r in dedup.keep_first_bounded(df, "i", 3).collect()) == want


def test_bounded_dedup_of_a_hot_text_over_many_ranges(spark):
    rng = random.Random(7)
    rows = [(2**61 - rng.getrandbits(40) * 100 - i, "hot" if i % 3 == 0 else f"t{rng.randrange(60)}") for i in range(500)]
    seen, want = set(), []
    for i, t in sorted(rows):
        if t not in seen:
            seen.add(t)
            want.append(i)
            if len(seen) >= 20:
                seen = set()
    df = spark.createDataFrame(rows, "i bigint, text string").repartition(3)
    assert sorted(r.i for r in dedup.keep_first_bounded(df, "i", 20, ranges=6).collect()) == want
    assert dedup.keep_first_bounded(df.limit(0), "i", 20).count() == 0


def test_bounded_dedup_case(spark):
    df = spark.createDataFrame(list(enumerate("aabaa")), "i bigint, text string")
    assert sorted(r.i for r in dedup.keep_first_bounded(df, "i", 2).collect()) == [0, 2, 3]


def test_interleave_does_not_depend_on_partitions(spark):
    df = spark.range(300).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("s"))
    seen = []
    for n in (1, 7):
        out = mix.interleave(df.repartition(n), "s", "i", {"x": 3, "y": 1, "z": 0}).orderBy("out_pos").collect()
        seen.append([(r.s, r.i) for r in out])
    assert seen[0] == seen[1] and len(seen[0]) == 300
    head = [s for s, _ in seen[0][:100]]
    assert 70 <= head.count("x") <= 80
    assert [i for s, i in seen[0] if s == "x"] == list(range(0, 300, 3))
    stopped = mix.interleave(df, "s", "i", {"x": 3, "y": 1}, first_exhausted=True)
    assert stopped.where("s = 'x'").count() == 100 and stopped.where("s = 'y'").count() < 40


def test_random_arrivals_follow_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("i"), F.when(F.col("id") < 2000, "x").otherwise("y").alias("s"))
    first = mix.random_arrival(df, "s", "i", {"x": 3.0, "y": 1.0}, seed=1).orderBy("t").limit(2000).where("s = 'x'").count()
    assert 1440 <= first <= 1560


def test_repeat(spark):
    out = mix.repeat(spark.createDataFrame([(5,), (9,)], "i bigint"), "i", 3).orderBy("ord").collect()
    assert [(r.rep, r.i, r.ord) for r in out] == [(k, i, 2 * k + j) for k in range(3) for j, i in enumerate((5, 9))]


def test_sources_in_use():
    w = {"a": 0.5, "b": 0.0, "c": 0.3}
    assert mix.enabled(w, {}) == {"a": 0.5, "c": 0.3}
    assert mix.enabled(w, {"c": True}) == {"c": 0.3}
    assert mix.source_weights(["a", "b"], [1, 3]) == {"a": 0.25, "b": 0.75}
    for bad in ([1], [0, 0]):
        with pytest.raises(ValueError):
            mix.source_weights(["a", "b"], bad)


def test_mixed_splits(spark):
    df = spark.range(200).select(F.col("id").alias("i"), F.lit(10).cast("bigint").alias("n"))
    tables = {"a": {"train": df, "val": df}, "b": {"train": df}}
    with pytest.raises(ValueError):
        mix.mixed_splits(tables, "i", {"a": 1.0, "b": 3.0}, 1, {"train": 995, "val": 200}, "n")
    out = mix.mixed_splits(tables, "i", {"a": 1.0, "b": 3.0}, 1, {"train": 995, "val": 200}, "n", strict=False)
    assert out["train"].count() == 100 and out["val"].count() == 20
    assert 60 <= out["train"].where("source = 'b'").count() <= 90
