"""Weighted interleaving of sources, deterministic and parallel.

Item k of a source of weight w arrives at (2k - 1) L / w, L being the weights' least
common multiple; sources are merged by arrival. An exhausted source leaves its
share to the others. random_arrival gives exponential gaps instead, by which each
next pick is a draw in proportion to the weights. Rows of a source without a weight, a
null one among them, are not mixed; null orders come first within their source."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import md5_word
from tessera.operators.ordered import Order, columns_of, ranked, running_sums

GAP_BITS = 24


def normalised(weights: dict[str, float]) -> dict[str, float]:
    total = max(1e-12, sum(weights.values()))
    return {k: w / total for k, w in weights.items()}


def normalised_column(df: DataFrame, weight: str) -> DataFrame:
    """The weights of a table of a row a source as shares of their sum."""
    total = df.agg(F.greatest(F.lit(1e-12), F.coalesce(F.sum(weight), F.lit(0.0))).alias("__total"))
    return df.withColumn(weight, F.col(weight) / F.lit(total.first()[0]))


def enabled(weights: dict[str, float], flags: dict[str, bool]) -> dict[str, float]:
    """Sources in use: all if no flag is set, else the flagged; none without weight."""
    chosen = weights if not any(flags.values()) else {k: w for k, w in weights.items() if flags.get(k)}
    return {k: w for k, w in chosen.items() if w > 0}


def source_weights(names: list[str], weights: list[float]) -> dict[str, float]:
    """Weights by source; there must be one for each, and not all zero."""
    if len(names) != len(weights):
        raise ValueError(f"{len(weights)} weights for {len(names)} sources")
    if sum(weights) <= 0:
        raise ValueError("weights sum to zero")
    return normalised(dict(zip(names, weights, strict=True)))


def arrivals(df: DataFrame, source: str, rank: str, weights: dict[str, int]) -> DataFrame:
    """Adds the whole-number arrival `at`, distinct over all rows; sources of no weight go."""
    live = {k: w for k, w in weights.items() if w > 0}
    lcm = math.lcm(*live.values())
    step, index = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for i, (k, w) in enumerate(live.items()):
        step = F.when(F.col(source) == k, F.lit(lcm // w)).otherwise(step)
        index = F.when(F.col(source) == k, F.lit(i)).otherwise(index)
    return df.where(F.col(source).isin(list(live))).withColumn("at", ((2 * F.col(rank) - 1) * step * len(live) + index).cast("bigint"))


def interleave(df: DataFrame, source: str, order: Order, weights: dict[str, int], first_exhausted: bool = False) -> DataFrame:
    """Adds out_pos from 1. first_exhausted stops where the first source ends."""
    live = [k for k, w in weights.items() if w > 0]
    at = arrivals(ranked(df.where(F.col(source).isin(live)), order, "__rn", (source,)), source, "__rn", weights)
    if first_exhausted:
        n = sum(1 for w in weights.values() if w > 0)
        ends = at.groupBy(source).agg(F.max("at").alias("e")).collect()  # a row for each source
        at = at.where(F.expr(f"at div {n}") <= min((x.e // n for x in ends), default=0))
    return ranked(at, "at", "out_pos").drop("at", "__rn")


def random_arrival(df: DataFrame, source: str, order: Order, weights: dict[str, float], seed: int) -> DataFrame:
    """Adds `t`, the random arrival, a whole number that grows within a source and is
    distinct over all rows. Gaps are exponential, drawn from a digest of seed, source
    and order; they are summed up in blocks."""
    names = list(weights)
    w, index = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    for i, k in enumerate(names):
        w = F.when(F.col(source) == k, F.lit(float(weights[k]))).otherwise(w)
        index = F.when(F.col(source) == k, F.lit(i)).otherwise(index)
    u = (md5_word(F.concat_ws(":", F.lit(seed), F.col(source), *[c.cast("string") for c in columns_of(order)])) + 0.5) / F.lit(2.0**32)
    gap = F.floor(-F.log(u) / w * F.lit(2.0**GAP_BITS)).cast("bigint") + 1
    summed = running_sums(df.where(F.col(source).isin(names)), order, {"t": gap}, (source,))
    return summed.withColumn("t", F.col("t") * len(names) + index)


def random_interleave(df: DataFrame, source: str, order: Order, weights: dict[str, float], seed: int) -> DataFrame:
    """Adds out_pos from 1, by random arrivals."""
    return ranked(random_arrival(df, source, order, weights, seed), "t", "out_pos").drop("t")


def repeat(df: DataFrame, order: Order, times: int) -> DataFrame:
    """Each row `times` times; adds rep and ord, the order after repeating."""
    n = df.count()
    return ranked(df, order, "__rn").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("ord", F.col("rep").cast("bigint") * n + F.col("__rn") - 1).drop("__rn")


def mixed_splits(tables: dict[str, dict[str, DataFrame]], order: Order, weights: dict[str, float], seed: int, targets: dict[str, int], n: str, strict: bool = True) -> dict[str, DataFrame]:
    """For each split its sources mixed at random (val by seed + 999) up to its token
    target. tables: source -> split -> rows. A source without a split is an error,
    or left out where not strict."""
    out = {}
    for split, target in targets.items():
        have = {s: t[split] for s, t in tables.items() if split in t}
        if strict and len(have) < len(tables):
            raise ValueError(f"no {split} in {sorted(set(tables) - set(have))}")
        rows = None
        for s, df in have.items():
            own = df.withColumn("source", F.lit(s))
            rows = own if rows is None else rows.unionByName(own)
        timed = random_arrival(rows, "source", order, {s: weights[s] for s in have}, seed + (999 if split == "val" else 0))
        out[split] = running_sums(timed, "t", {"running": F.col(n)}).where(F.col("running") - F.coalesce(n, F.lit(0)) < target).drop("t")
    return out
