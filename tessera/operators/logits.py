"""Sampling arithmetic over arrays of logits: one row, one array, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def argmax(x: Column) -> Column:
    """The lowest index of the largest value, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once; a plain column in a lambda is
    worked out again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def softmax(x: Column) -> Column:
    shifted = let(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m)))
    return let(shifted, lambda e: let(_sum(e), lambda s: F.transform(e, lambda v: v / s)))


def logsumexp(x: Column) -> Column:
    return let(F.array_max(x), lambda m: m + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - m))))


def cross_entropy(x: Column, target: Column) -> Column:
    return logsumexp(x) - F.element_at(x, target.cast("int") + 1)


def top_k(x: Column, k: int) -> Column:
    """Values under the k-th largest become null; ties with it stay."""
    least = F.element_at(F.sort_array(x, asc=False), F.least(F.lit(k), F.size(x)))
    return let(least, lambda m: F.transform(x, lambda v: F.when(v >= m, v)))


def top_p(x: Column, p: float) -> Column:
    """Values that come after a cumulated probability over p become null."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("kept"))

    def step(a: Column, r: Column) -> Column:
        kept = F.when(a["sum"] <= p, F.array_append(a["kept"], r["i"])).otherwise(a["kept"])
        return F.struct((a["sum"] - r["v"]).alias("sum"), kept.alias("kept"))

    def kept(probs: Column) -> Column:
        return F.aggregate(F.array_sort(F.transform(probs, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), start, step)["kept"]

    return let(softmax(x), lambda probs: let(kept(probs), lambda k: F.transform(x, lambda v, i: F.when(F.array_contains(k, i), v))))


def repetition_penalty(x: Column, seen: Column, penalty: float) -> Column:
    return F.transform(x, lambda v, i: F.when(F.array_contains(seen, i), F.when(v > 0, v / penalty).otherwise(v * penalty)).otherwise(v))


def multinomial(x: Column, u: Column) -> Column:
    """The index that a uniform draw u picks by inverse distribution."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(a: Column, v: Column) -> Column:
        return F.struct((a["sum"] + v).alias("sum"), (a["n"] + F.when(a["sum"] + v <= u, 1).otherwise(0)).alias("n"))

    return F.least(F.aggregate(softmax(x), start, step)["n"], F.size(x) - 1)


def rms_norm(x: Column, eps: float = 1e-6) -> Column:
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)
    return let(F.sqrt(mean + eps), lambda r: F.transform(x, lambda v: v / r))


def rope(x: Column, position: Column, base: float = 10_000.0) -> Column:
    """Rotary embedding of a vector at a position, halves as pairs."""
    half = (F.size(x) / 2).cast("int")
    a, b = F.slice(x, F.lit(1), half), F.slice(x, half + 1, half)

    def angle(i: Column) -> Column:
        return position / F.pow(F.lit(base), 2 * i / F.size(x))

    def turn(sign: int):
        one, two = (a, b) if sign < 0 else (b, a)
        return F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.element_at(one, i + 1) * F.cos(angle(i)) + sign * F.element_at(two, i + 1) * F.sin(angle(i)))

    return F.concat(turn(-1), turn(1))
