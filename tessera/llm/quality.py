"""Operator 3, quality classification by histogram gradient-boosted trees over
document statistics.

Every whole text gives the statistics named in FEATURES, from its byte histogram,
its words and its lines. Trees are grown depth by depth on binned statistics with
second-order logistic loss; the model is then flattened to arrays (feature,
threshold and leaf value of each heap position of each tree), which numpy walks
for a whole batch at once, a level at a time.

Fitting uses a bounded sample of labelled documents: SAMPLE of them at most, taken by
a hash of doc_id, whose statistics (SAMPLE x features doubles) come to the driver.
Labels of a document that contradict each other, and null ones, are left out; of rows
that repeat a doc_id the least text is learned from.

Null texts count as empty; empty texts get a score like any other. Without labelled
rows of both classes every score is the share of label 1 (0.5 without any). Ties
between splits go to the first statistic, then the lowest threshold; a value equal to
a threshold goes left. Repeated rows get a row each, very long texts are held whole by
their task, empty tables give no rows. Columns are kept as asked, whatever their names;
one named score, under any case, is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

SAMPLE = 20_000
BINS = 64
DEPTH = 4
TREES = 150
RATE = 0.08
RIDGE = 1.0
MIN_HESSIAN = 4.0

FEATURES = ["log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "non_ascii", "punct", "symbol", "bang", "bar", "stop", "comma", "entropy", "log_lines", "line_bytes", "repeated_lines", "short_lines", "closed_lines", "distinct_words", "top_word", "top_pair_run", "capital_words", "caps_words", "short_words", "plain_words", "digit_words", "longest_word", "repeated_bytes"]


def _of(chars: bytes) -> np.ndarray:
    m = np.zeros(256)
    m[list(chars)] = 1
    return m


UPPER, DIGIT = _of(bytes(range(65, 91))), _of(bytes(range(48, 58)))
SPACE, HIGH = _of(b" \t\n\x0b\f\r"), _of(bytes(range(128, 256)))
ALNUM = _of(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)))
PUNCT = _of(bytes(range(33, 127))) * (1 - ALNUM)
SYMBOL = PUNCT * (1 - _of(b".,;:!?'\"()-"))
CLASSES = np.stack([UPPER, DIGIT, SPACE, HIGH, PUNCT, SYMBOL, _of(b"!"), _of(b"|"), _of(b"."), _of(b",")], axis=1)


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    raw = np.frombuffer(data, np.uint8)
    hist = np.bincount(raw, minlength=256)
    p = hist[hist > 0] / n
    share = (hist @ CLASSES / n).tolist()
    words = data.split()
    w = max(1, len(words))
    tally = Counter(words)
    top = tally.most_common(1)[0][1] if words else 0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    first = np.fromiter((x[0] for x in words), np.uint8, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(len(data)), np.log1p(len(words)), float(lengths.mean()) if words else 0.0, *share[:6],
        *share[6:10], float(-(p * np.log2(p)).sum()) if len(p) else 0.0, np.log1p(len(lines)), len(data) / m,
        1 - len(set(lines)) / m, sum(len(x) < 30 for x in lines) / m, sum(x.rstrip()[-1:] in b".!?" for x in lines) / m,
        len(tally) / w, top / w, repeats / w,
        float(((first >= 65) & (first < 91)).sum()) / w, sum(x.isupper() for x in words) / w, float((lengths <= 2).sum()) / w,
        sum(x.isalpha() for x in words) / w, sum(x.isdigit() for x in words) / w, float(np.log1p(lengths.max())) if words else 0.0,
        float((raw[1:] == raw[:-1]).sum()) / n,
    ]


@dataclass
class Trees:
    """Heaps of equal depth: node i has children 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1), np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x))) if len(x) else np.zeros(0)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    pos = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Trees(float(np.log(pos / (1 - pos))))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    d = x.shape[1]
    flat = binned + np.arange(d) * BINS
    margin = np.full(len(y), model.base)
    feats, thrs, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feat, thr, at = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            low, nodes = 2**level - 1, 2**level
            key = ((at - low)[:, None] * (d * BINS) + flat).ravel()
            shape = (nodes, d, BINS)
            gs = np.bincount(key, np.repeat(g, d), nodes * d * BINS).reshape(shape).cumsum(axis=2)
            hs = np.bincount(key, np.repeat(h, d), nodes * d * BINS).reshape(shape).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hs < MIN_HESSIAN) | (ht - hs < MIN_HESSIAN)] = -1
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for i, b in enumerate(best.tolist()):
                j, k = divmod(b, BINS)
                if gain[i, j, k] > 1e-6 and k < len(edges[j]):
                    feat[low + i], thr[low + i] = j, edges[j][k]
            at = 2 * at + 1 + (x[np.arange(len(y)), feat[at]] > thr[at])
        at -= 2**DEPTH - 1
        value = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + RIDGE)
        margin += value[at]
        feats.append(feat), thrs.append(thr), leaves.append(value)
    model.feature, model.threshold, model.leaf = np.stack(feats), np.stack(thrs), np.stack(leaves)
    return model


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in column], float).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """labels: (id, label 0 or 1). Documents without a label are not learned from."""
    marks = labels.select(common.quoted(id_col).alias("__id"), common.quoted(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    marks = marks.groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z").drop("__z")
    total = marks.count()
    share = min(1.0, 0.97 * sample / max(1, total))
    chosen = marks.where(F.shiftrightunsigned(F.xxhash64("__id"), 11).cast("double") / float(1 << 53) < share).limit(sample)
    # at most `sample` rows of 12 bytes: the bound that lets them be broadcast
    src = docs.select(common.quoted(id_col).alias("__id"), common.quoted(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    src = src.groupBy("__id", "__y").agg(F.min("__text").alias("__text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_matrix(b.column(1))), pa.list_(pa.float64())), b.column(2)], ["x", "y"])

    rows = src.select("__id", "__text", "__y").mapInArrow(step, "x array<double>, y int").collect()
    rows.sort(key=lambda r: (r.x, r.y))
    return grow(np.array([r.x for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.y for r in rows], float))


def score(docs: DataFrame, model: Trees, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, if none are named) with score."""
    keep = common.others(docs.columns if keep is None else keep, ("score",))
    src = docs.select(*common.numbered(keep), common.quoted(text_col).alias("text"))
    schema = T.StructType(src.schema.fields[:-1] + [T.StructField("score", T.DoubleType())])
    common.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for b in batches:
            s = sent.value.score(_matrix(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(s, pa.float64())], [f.name for f in schema])

    return common.renamed(src.mapInArrow(step, schema), keep)
