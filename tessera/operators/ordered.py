"""Running sums and ranks over a whole table without a single-partition window.

Rows are cut into ranges of (keys, order, tie) by Spark's range exchange, which samples
the values themselves: ranges are even for dense, sparse and hashed orders of any type
that sorts, and a key that holds most rows is cut like the others. The ranges are
written to a table once; sums of each (range, key) are added up over the ranges, of
which a key that goes on from an earlier range is at most one a range, so that what is
broadcast has no more rows than there are ranges; each range is summed on its own.

Nulls: a null key is a key like any other, and null orders come first within their key
(last, or in descending order, where the order column says so). Rows of equal order come
by the digest of all their columns; only wholly equal rows can't be told apart, nor need
be. No row is lost, and no arithmetic is done on keys and orders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.tables import materialise

#: one column or several, by name or as (sorted) columns
Order = str | Column | Sequence[str | Column]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(order: Order) -> list[Column]:
    several = [order] if isinstance(order, str | Column) else list(order)
    return [quoted(c) if isinstance(c, str) else c for c in several]


def digest(df: DataFrame) -> Column:
    """Of all columns of a row; maps, which have no digest, are left out."""
    return F.xxhash64(F.lit(0), *[quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def in_ranges(df: DataFrame, order: Order, keys: Sequence[str] = (), values: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """df as a table with its range __r, its tie __tie and the values; ranges rise with
    (keys, order, tie). ranges: as many as there are shuffle partitions."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    valued = df.withColumns({"__tie": digest(df), **(values or {})})
    cut = valued.repartitionByRange(ranges, *map(quoted, keys), *columns_of(order), F.col("__tie"))
    return materialise(cut.withColumn("__r", F.spark_partition_id()), "ranges")


def same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """The join of a range and its key with what is known of them in b (range __br,
    keys __bk0, __bk1, ...)."""
    on = a["__r"] == b["__br"]
    for i, k in enumerate(keys):
        on = on & a["`" + k.replace("`", "``") + "`"].eqNullSafe(b[f"__bk{i}"])
    return on


def carried(placed: DataFrame, keys: Sequence[str], aggregates: dict[str, tuple[Column, Callable[[str], Column]]]) -> DataFrame:
    """What earlier ranges hold of a key that goes on in a range, a row a range at most."""
    own = [quoted(k).alias(f"__bk{i}") for i, k in enumerate(keys)]
    names = [f"__bk{i}" for i in range(len(keys))]
    totals = placed.groupBy(F.col("__r").alias("__br"), *own).agg(*[c.alias(f"__t_{n}") for n, (c, _) in aggregates.items()])
    before = Window.partitionBy(*names).orderBy("__br").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("__br", *names, F.count(F.lit(1)).over(before).alias("__seen"), *[again(f"__t_{n}").over(before).alias(f"__b_{n}") for n, (_, again) in aggregates.items()])
    return F.broadcast(base.where("__seen > 0").drop("__seen"))


def running_sums(df: DataFrame, order: Order, values: dict[str, Column], keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Adds for each name the inclusive sum of its column (a whole number; null counts as
    none) within the keys, in the order of `order`. Hand in light rows: they are shuffled
    twice and written once."""
    placed = in_ranges(df, order, keys, {f"__v_{n}": F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")) for n, c in values.items()}, ranges)
    base = carried(placed, keys, {n: (F.sum(f"__v_{n}"), F.sum) for n in values})
    own = Window.partitionBy("__r", *map(quoted, keys)).orderBy(*columns_of(order), "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumns({f"__s_{n}": F.sum(f"__v_{n}").over(own) for n in values})
    out = summed.join(base, same(summed, base, keys), "left")
    return out.select(*[summed["`" + c.replace("`", "``") + "`"] for c in df.columns], *[(F.col(f"__s_{n}") + F.coalesce(F.col(f"__b_{n}"), F.lit(0))).cast("bigint").alias(n) for n in values])


def running_minima(df: DataFrame, order: Order, value: str, out: str, keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Adds the least value of the rows before; null for the first."""
    placed = in_ranges(df, order, keys, ranges=ranges)
    base = carried(placed, keys, {"m": (F.min(value), F.min)})
    own = Window.partitionBy("__r", *map(quoted, keys)).orderBy(*columns_of(order), "__tie").rowsBetween(Window.unboundedPreceding, -1)
    least = placed.withColumn("__o", F.min(value).over(own))
    joined = least.join(base, same(least, base, keys), "left")
    return joined.select(*[least["`" + c.replace("`", "``") + "`"] for c in df.columns], F.least("__o", "__b_m").alias(out))


def trailing(df: DataFrame, order: Order, rows: int, out: str, agg: Callable[[], Column], keys: Sequence[str] = (), block: int = 10_000) -> DataFrame:
    """Adds an aggregate of each row and the rows - 1 before it. Rows are dealt to
    blocks by their number; each block also gets the end of the one before."""
    numbered = ranked(df, order, "__rn", keys).withColumn("__rn", F.col("__rn") - 1)
    block = max(block, rows)
    own = numbered.withColumns({"__b": F.expr(f"__rn div {block}"), "__own": F.lit(True)})
    end = numbered.where(F.col("__rn") % block > block - rows).withColumns({"__b": F.expr(f"__rn div {block} + 1"), "__own": F.lit(False)})
    w = Window.partitionBy(*map(quoted, keys), "__b").orderBy("__rn").rowsBetween(1 - rows, Window.currentRow)
    return own.unionByName(end).withColumn(out, agg().over(w)).where("__own").select(*map(quoted, df.columns), out)


def ranked(df: DataFrame, order: Order, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Row numbers from 1 within the keys."""
    return running_sums(df, order, {out: F.lit(1)}, keys)


def spans(df: DataFrame, order: Order, n: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds start and end: where each row's n tokens lie in the concatenation of its keys."""
    return running_sums(df, order, {"end": F.col(n)}, keys).withColumn("start", F.col("end") - F.coalesce(n, F.lit(0)))


def slices(df: DataFrame, size: int, out: str) -> DataFrame:
    """A row for each stretch of `size` positions that [start, end) touches, with
    its part [lo, hi) of the positions: an interval join without a join."""
    cut = df.where("end > start").withColumn(out, F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"(end - 1) div {size}"))))
    return cut.withColumns({"lo": F.greatest("start", F.col(out) * size), "hi": F.least("end", (F.col(out) + 1) * size)})
