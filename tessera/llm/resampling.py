"""Operator 13, importance resampling towards a target distribution.

Features are all runs of 1 to `ngrams` consecutive words, each hashed to one of `buckets`
buckets (CRC-32). Two passes of Arrow over the documents:

1. A partition counts its features' buckets with np.bincount into one vector of
   `buckets` counts; treeReduce merges the vectors, so that the driver gets a few of
   them however many partitions there are. The target's texts are counted alike. A bucket's
   gain is 1000 times the logarithm of its smoothed share in the target over that in
   the documents, floored.
2. The gains are broadcast (8 bytes a bucket); a document's are gathered by its
   features' buckets and summed with np.bincount weights, a batch at a time.

A document's weight is the floored mean of its features' gains. Gumbel noise drawn from a
digest of seed and doc_id makes the highest scores a sample without replacement in
proportion to exp(weight / 1000). Scores are whole numbers of a bounded range, so their
histogram gives the lowest score drawn; only rows from there on are put in order, in
ranges of equal size.

Null and empty texts, or those without words, have no features and weight 0. Words are
kept apart in pieces of STEP bytes, so a very long text takes no more memory than its
bytes. A null doc_id is drawn like any other (its noise is that of an empty id) and comes
last among equal scores; rows that repeat a doc_id share its noise and are each a
document. Rows of equal score and doc_id come by weight and number of features. Other
columns are ignored, whatever their names. Without documents or a target nothing fails:
an empty table gives no rows, an empty target the gains of its smoothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.operators.ordered import ranked

BUCKETS = 10_000
STEP = 1 << 22
FEW = 1 << 18
TREE_WIDTH = 64

_WORD = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: A-Z to a-z, what is in no word to a space
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))


def word_runs(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes of it at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + STEP)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def features(text: str | None, ngrams: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, hashes of features) of each piece of a text."""
    tail: list[bytes] = []  # words that runs of the next piece begin with
    for words in word_runs(text):
        hashes = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
        for n in range(2, ngrams + 1):
            own = tail[len(tail) - min(n - 1, len(tail)) :] + words
            runs = [b" ".join(own[i : i + n]) for i in range(len(own) - n + 1)]
            hashes.append(np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)))
        tail = (tail + words)[-(ngrams - 1) :] if ngrams > 1 else []
        yield len(words), hashes[0] if ngrams == 1 else np.concatenate(hashes)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, ngrams: int = 1) -> np.ndarray:
    """How often each bucket occurs in all the texts."""
    common.small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        total = np.zeros(buckets, np.int64)
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                for _, hashes in features(text.as_py(), ngrams):
                    held.append(hashes % np.uint32(buckets))
                    size += len(hashes)
                    if size >= FEW:
                        total += np.bincount(np.concatenate(held), minlength=buckets)
                        held, size = [], 0
        if size:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(common.quoted(text_col).alias("text")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    n = vectors.getNumPartitions()
    if not n:
        return np.zeros(buckets, np.int64)
    return vectors.treeReduce(np.add, depth=max(2, math.ceil(math.log(n, TREE_WIDTH)))) if n > 1 else sum(vectors.collect(), np.zeros(buckets, np.int64))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, from counts in the documents and the target."""
    of_all, of_target, n = float(source.sum()), float(target.sum()), len(source)
    ratios = ((target + 1.0) * (of_all + n)) / ((source + 1.0) * (of_target + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios.tolist()], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ngrams: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    names = ["doc_id", "n_words", "n_features", "weight"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        own = shared.value
        for batch in batches:
            rows = batch.num_rows
            words, n, sums = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
            held, owner, size = [], [], 0

            def add():
                # sums of whole numbers under 2^53, so doubles hold them exactly
                sums[:] += np.bincount(np.repeat(owner, [len(h) for h in held]), weights=own[np.concatenate(held) % np.uint32(len(own))], minlength=rows)

            for i, text in enumerate(batch.column(1)):
                for w, hashes in features(text.as_py(), ngrams):
                    words[i] += w
                    n[i] += len(hashes)
                    held.append(hashes)
                    owner.append(i)
                    size += len(hashes)
                    if size >= FEW:
                        add()
                        held, owner, size = [], [], 0
            if size:
                add()
            weight = sums.astype(np.int64) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(weight)], names)

    src = docs.select(common.quoted(id_col).cast("bigint").alias("doc_id"), common.quoted(text_col).alias("text"))
    return src.mapInArrow(step, ", ".join(f"{c} bigint" for c in names))


def noise(seed: int) -> Column:
    """1000 times a Gumbel draw, floored, by a digest of seed and doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def draw(scored: DataFrame, among: Column, percent: int) -> DataFrame:
    """Adds rank to a table of (doc_id, n_features, weight, score, ...): 1, 2, 3, ... for
    the highest scores among the rows that `among` marks, floor(percent N / 100) of these."""
    total = scored.where(among).count()
    wanted = percent * total // 100
    # a row for each score there is: whole numbers between the least and the greatest gain and noise
    counts = scored.where(among).groupBy("score").count().orderBy(F.desc("score")).collect() if wanted else []
    least, sum_ = None, 0
    for score, n in counts:
        least, sum_ = score, sum_ + n
        if sum_ >= wanted:
            break
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    near = F.coalesce(among & (F.col("score") >= least), F.lit(False))
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features"))
    upper = ranked(scored.where(near), order, "rank").withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return upper.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("bigint")))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, buckets: int = BUCKETS, ngrams: int = 1, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """A row a document: doc_id, n_words, n_features, weight, score and, where it is drawn,
    rank. Drawn are `percent` of the documents with min_words words at least."""
    if ngrams < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("ngrams and buckets are 1 or more, percent is 0 to 100")
    gain = gains(bucket_counts(docs, text_col, buckets, ngrams), bucket_counts(target, target_col, buckets, ngrams))
    scored = common.materialise(weigh(docs, gain, id_col, text_col, ngrams).withColumn("score", F.col("weight") + noise(seed)), "scored")
    return draw(scored, F.col("n_words") >= min_words, percent)
