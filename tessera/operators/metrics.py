"""Training and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import running_minima, trailing


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def bucket_loss(df: DataFrame, bucket: str, order: str, loss: str, max_steps: int) -> DataFrame:
    """Mean loss of each bucket's first steps, and its perplexity."""
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(bucket).orderBy(order))).where(F.col("__n") <= max_steps)
    return first.groupBy(bucket).agg(F.avg(loss).alias("loss")).withColumn("ppl", F.exp("loss"))


def first_examples(df: DataFrame, group: str, order: str, n: int = 10) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def macro_average(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.avg("loss").alias("loss")).withColumn("ppl", F.exp("loss"))


def metric_or_average(buckets: DataFrame, bucket: str, metric: str) -> DataFrame:
    named = F.max(F.when((F.col(bucket) == metric) & finite(F.col("loss")), F.col("loss")))
    return buckets.agg(F.coalesce(named, F.avg("loss")).alias("value")).select(F.lit(metric).alias("metric"), "value")


def running_best(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """Rows under all before them in their series."""
    out = running_minima(df, order, value, "__best", (series,))
    return out.where(F.col("__best").isNull() | (F.col(value) < F.col("__best"))).drop("__best")


def trailing_mean(df: DataFrame, series: str, order: str, value: str, rows: int = 100) -> DataFrame:
    return trailing(df, order, rows, "mean", lambda: F.avg(value), (series,))


def throughput(df: DataFrame, series: str, ts: str, order: str, tokens: int) -> DataFrame:
    """Tokens a second between a series' rows; null for its first."""
    w = Window.partitionBy(series).orderBy(ts, order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    dt = (at - F.lag(at).over(w)) / F.lit(1e6)
    return df.withColumn("tok_s", F.lit(float(tokens)) / F.greatest(dt, F.lit(1e-6)))


def kth_value(df: DataFrame, value: str, k: int, bins: int = 1 << 14, few: int = 100_000) -> float | None:
    """The k-th smallest value, exactly, from 1. Counts of equal bins narrow the range
    down until few rows are left in it; these alone are put in order."""
    v = F.col(value)
    rest = df.where(v.isNotNull()).select(v.cast("double").alias("v"))
    lo, hi, n = rest.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    if not 1 <= k <= n:
        return None
    inside, before = F.lit(True), 0
    while n > few and lo < hi:
        at = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
        counts = rest.where(inside).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        for r in counts:  # one for each bin at most
            if before + r.n >= k:
                break
            before += r.n
        if (r.lo, r.hi) == (lo, hi):
            break
        lo, hi, n = r.lo, r.hi, r.n
        inside = F.col("v").between(lo, hi)
    if lo == hi:
        return lo
    return rest.where(inside).selectExpr(f"percentile_disc({(k - before - 0.5) / n!r}) within group (order by v) as v").first().v


def error_distribution(df: DataFrame, value: str) -> DataFrame:
    """Exact k-th values, k = max(1, floor(q n)), with maximum and mean."""
    n = df.where(F.col(value).isNotNull()).count()
    k99, k999 = (max(1, int(q * n)) for q in (0.99, 0.999))
    picked = [F.lit(kth_value(df, value, k)).cast("double").alias(name) for k, name in ((k99, "p99"), (k999, "p999"))]
    return df.agg(*[F.first(p).alias(name) for p, name in zip(picked, ("p99", "p999"), strict=True)], F.max(value).alias("max"), F.avg(value).alias("mean"))


def schedule(spark, lr_start: float, lr_end: float, warmup: int, total: int) -> DataFrame:
    """Learning rate by step: up from lr_end in the warm-up, then cosine or linear."""
    steps = spark.range(total + 1).select(F.col("id").alias("step")).withColumn("schedule", F.explode(F.array(F.lit("cosine"), F.lit("linear"))))
    t = F.least(F.greatest((F.col("step") - warmup) / F.lit(float(max(1, total - warmup))), F.lit(0.0)), F.lit(1.0))
    warm = F.lit(lr_end) + (lr_start - lr_end) * (F.col("step") / F.lit(float(max(1, warmup))))
    cosine = F.lit(lr_end) + F.lit(0.5 * (lr_start - lr_end)) * (1 + F.cos(F.lit(3.141592653589793) * t))
    linear = F.lit(lr_start) + (lr_end - lr_start) * t
    return steps.withColumn("lr", F.when(F.col("step") < warmup, warm).when(F.col("schedule") == "linear", linear).otherwise(cosine))


def second_moments(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Sums of squares by row, by column and in all, in one pass of grouping sets."""
    square = cells.select(F.col(row).cast("bigint").alias("r"), F.col(column).cast("bigint").alias("c"), (F.col(value) * F.col(value)).alias("q"))
    g = square.groupingSets([["r"], ["c"], []], "r", "c").agg(F.grouping_id().alias("g"), F.sum("q").alias("sum_sq"))
    return g.select(F.when(F.col("g") == 1, "row").when(F.col("g") == 2, "col").otherwise("all").alias("axis"), F.coalesce("r", "c", F.lit(-1)).alias("idx"), "sum_sq")
