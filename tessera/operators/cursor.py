"""Shuffled training order without a sort, and a cursor in it.

A keyed Feistel network is a bijection of [0, 4^k); walking along its cycles until the
value is under n makes it one of [0, n). So the block at any position of an epoch, and the
position of any block, are a few rounds of arithmetic: no order is sorted, shuffled or
kept. Ranks take positions in turn; a cursor is the seed, the epoch and the next step."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 4
#: steps of a walk: three quarters to that power, under 2^-100, need more
WALK = 256


def half_bits(n: int) -> int:
    """Bits of half a value: the fewest by which 2^(2 bits) values cover [0, n)."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(half: Column, key: str, bits: int) -> Column:
    # the low bits of a keyed hash of the half
    return F.xxhash64(F.lit(key), half.cast("bigint")).bitwiseAND(F.lit((1 << bits) - 1))


def _once(state: Column, key: str, bits: int, forth: bool) -> Column:
    """One round: the array holds one state, so that it is computed once."""
    if forth:
        return F.transform(state, lambda s: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(_round(s["r"], key, bits)).alias("r")))
    return F.transform(state, lambda s: F.struct(s["r"].bitwiseXOR(_round(s["l"], key, bits)).alias("l"), s["l"].alias("r")))


def _turn(x: Column, key: str, bits: int, rounds: list[int]) -> Column:
    """One pass of the network; rounds in reverse undo it."""
    state = F.array(F.struct(F.shiftright(x, bits).alias("l"), x.bitwiseAND(F.lit((1 << bits) - 1)).alias("r")))
    for i in rounds:
        state = _once(state, f"{key}:{i}", bits, rounds[0] <= rounds[-1])
    return F.transform(state, lambda s: F.shiftleft(s["l"], bits).bitwiseOR(s["r"]))[0]


def permuted(df: DataFrame, column: str, out: str, n: int, seed: int, epoch: int = 0, inverse: bool = False) -> DataFrame:
    """Adds the number at a place of the epoch's order, both under n (inverse: the place of a
    number). Values that are not in [0, n) get null. The network has less than 4 n values
    or so, so each step of a walk ends it with a chance of a quarter at least; one that has
    not ended after WALK steps is an error, never a wrong number."""
    bits, key = half_bits(n), f"{seed}:{epoch}"
    rounds = list(range(ROUNDS))[:: -1 if inverse else 1]
    x = F.col(column).cast("bigint")
    inside = (x >= 0) & (x < n)
    first = _turn(x, key, bits, rounds)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda a, _: F.when(a >= n, _turn(a, key, bits, rounds)).otherwise(a))
    checked = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a walk did not end")).cast("bigint"))
    return df.withColumn(out, F.when(inside, checked))


@dataclass(frozen=True)
class Cursor:
    """Where training stands: `step` batches of each rank are done in the epoch."""

    seed: int
    blocks: int
    world: int
    batch: int
    epoch: int = 0
    step: int = 0

    @property
    def steps(self) -> int:
        """Whole steps of an epoch: each rank has as many, and whole batches."""
        return self.blocks // (self.world * self.batch)

    def after(self, steps: int) -> Cursor:
        done = self.epoch * self.steps + self.step + steps
        return Cursor(**{**asdict(self), "epoch": done // self.steps, "step": done % self.steps}) if self.steps else self

    def saved(self) -> dict:
        return asdict(self)


def ahead(spark: SparkSession, cursor: Cursor, steps: int | None = None) -> DataFrame:
    """(step, rank, slot, position, block_id) of what follows the cursor in its epoch, or of the
    next `steps` of it: only these positions are made."""
    each = cursor.world * cursor.batch
    last = cursor.steps if steps is None else min(cursor.steps, cursor.step + steps)
    at = spark.range(cursor.step * each, max(cursor.step, last) * each).withColumnRenamed("id", "position")
    found = permuted(at, "position", "block_id", cursor.blocks, cursor.seed, cursor.epoch)
    within = F.col("position") % each
    return found.select(F.expr(f"position div {each}").alias("step"), (within % cursor.world).alias("rank"), F.floor(within / cursor.world).cast("bigint").alias("slot"), "position", "block_id")


def resumed(blocks: DataFrame, cursor: Cursor, block_id: str = "block_id") -> DataFrame:
    """Blocks that follow the cursor, with their position: a filter on each block's own place,
    so neither a sort nor a join."""
    each = cursor.world * cursor.batch
    placed = permuted(blocks, block_id, "position", cursor.blocks, cursor.seed, cursor.epoch, inverse=True)
    return placed.where((F.col("position") >= cursor.step * each) & (F.col("position") < cursor.steps * each))
