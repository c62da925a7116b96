"""Operator 1, language identification by nearest centroid.

A text becomes counts of byte trigrams of its lowered letters, hashed to DIM
features; counts are damped by their logarithm, weighted by inverse document
frequency and scaled to length one. Each language has several centroids, found
by spherical k-means over a bounded sample of labelled documents. A text takes
the language of the centroid with the largest cosine, which is also its score.

Rejection goes by distance: each centroid keeps the cosine that all but a small
share of its own sample reach, less a margin; a text further away than that from
its nearest centroid is rejected, and so is one without a letter. Texts of fewer
than ENOUGH trigrams lie far from any centroid by their shortness, so the cosine
asked of them is less in proportion.

Fitting: document frequencies and language counts cover all labelled documents
given. The sample is bounded by SAMPLE documents over all languages (an equal
share and SPARE more each, taken by a hash of doc_id and text; equal ones count once);
only its count vectors come to the driver, DIM x 2 bytes each, twice as many at most. The MAX_LANGUAGES most frequent languages are learned, which bounds the model
(CENTROIDS x DIM x 4 bytes a language, so 66 MB).

Null, empty and letterless texts are `und` with score 0 and rejected. Rows with a
null language are never learned from. Without any labelled row all is `und`. Ties
between centroids go to the language first by name. Repeated rows get a row each.
Very long texts are counted in pieces. Empty tables give no rows. Columns are kept as
asked, whatever their names; one of a result's name, under any case, is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

DIM = 4096
SAMPLE = 2400
SPARE = 16
MAX_LANGUAGES = 1000
CENTROIDS = 4
REJECT_SHARE = 0.002
REJECT_MARGIN = 0.75
ENOUGH = 400
PIECE = 1 << 19
CHUNK = 64
#: bytes to features' alphabet: a to z and bytes from 128 as they are, anything else a space
LETTERS = np.array([c if 97 <= c < 123 or c >= 128 else 32 for c in range(256)], np.uint32)
#: fixed values: odd multipliers of the trigram hash
MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def _codes(data: bytes) -> np.ndarray:
    b = LETTERS[np.frombuffer(data, np.uint8)]
    h = b[:-2] * MIX[0] ^ b[1:-1] * MIX[1] ^ b[2:] * MIX[2]
    h ^= h >> np.uint32(15)
    h *= MIX[1]
    code = (h >> np.uint32(20)).astype(np.int64)
    return code[(b[:-2] != 32) | (b[1:-1] != 32)]


def count_vector(text: str | None) -> np.ndarray:
    out = np.zeros(DIM, np.int64)
    data = b" " + (text or "").lower().encode("utf-8", "surrogatepass") + b" "
    for i in range(0, len(data), PIECE):
        out += np.bincount(_codes(data[i : i + PIECE + 2]), minlength=DIM)
    return out


def count_matrix(texts: list[str | None]) -> np.ndarray:
    """One row of counts for each text."""
    if sum(len(t or "") for t in texts) > PIECE:
        return np.stack([count_vector(t) for t in texts])
    codes = [_codes(b" " + (t or "").lower().encode("utf-8", "surrogatepass") + b" ") for t in texts]
    flat = np.concatenate(codes) + np.repeat(np.arange(len(texts)) * DIM, [len(c) for c in codes])
    return np.bincount(flat, minlength=len(texts) * DIM).reshape(len(texts), DIM)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray  # the cosine under which a centroid rejects

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroid, cosine and rejection of each text."""
        at, score, far = [], [], []
        for i in range(0, len(texts), CHUNK):
            counts = count_matrix(texts.slice(i, CHUNK).to_pylist())
            s = weighted(counts, self.idf) @ self.centroids.T
            k = s.argmax(axis=1)
            v = s[np.arange(len(k)), k]
            at.append(k)
            score.append(np.clip(v, 0, 1))
            far.append(v < self.floor[k] * np.minimum(1, counts.sum(axis=1) / ENOUGH))
        return np.concatenate(at), np.concatenate(score).astype(float), np.concatenate(far)


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with farthest-first starts: centroids and assignments."""
    rng = np.random.default_rng(seed)
    start = [int(rng.integers(len(x)))]
    best = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        p = np.maximum(1 - best, 0) ** 2
        start.append(int(rng.choice(len(x), p=p / p.sum())) if p.sum() > 1e-9 else 0)
        best = np.maximum(best, x @ x[start[-1]])
    c = x[start]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        new = np.stack([x[at == j].sum(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(axis=1)


def fit_sample(langs: list[str], counts: np.ndarray, df: np.ndarray, docs: int, k: int = CENTROIDS) -> Model:
    idf = (np.log((1 + docs) / (1 + df)) + 0.1).astype(np.float32)
    x = weighted(counts, idf)
    names, cents, floors = [], [], []
    langs_ = np.array(langs)
    for lang in sorted(set(langs)):
        own = x[langs_ == lang]
        c, at = kmeans(own, k)
        for j in range(len(c)):
            near = own[at == j] @ c[j]
            names.append(lang)
            cents.append(c[j])
            floors.append(REJECT_MARGIN * np.quantile(near, REJECT_SHARE) if len(near) else 1.0)
    return Model(names, idf, np.stack(cents).astype(np.float32), np.array(floors, np.float32))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, k: int = CENTROIDS) -> Model | None:
    """Learn from the rows of labelled with a text and a language."""
    spark = labelled.sparkSession
    common.small_batches(spark)
    src = labelled.select(*(common.quoted(c).alias(n) for c, n in ((id_col, "doc_id"), (text_col, "text"), (lang_col, "lang")))).where("text is not null and lang is not null")
    sizes = src.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("doc_id", "text"), 0.02).alias("rows"))
    sizes = [(r.lang, r.rows) for r in sizes.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()]
    if not sizes:
        return None
    each = sample // len(sizes) + SPARE
    shares = common.local_table(spark, [(lang, min(1.0, each / n)) for lang, n in sizes], "lang string, share double")
    src = src.join(F.broadcast(shares), "lang")
    picked = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).cast("double") / float(1 << 53) < F.col("share")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        df, docs, met = np.zeros(DIM, np.int64), 0, set()
        for batch in batches:
            take = batch.column(2).to_numpy(zero_copy_only=False)
            for i in range(0, batch.num_rows, CHUNK):
                m = count_matrix(batch.column(0).slice(i, CHUNK).to_pylist())
                df += (m > 0).sum(axis=0)
                docs += len(m)
                own = {(batch.column(1)[i + int(j)].as_py(), np.minimum(m[j], 65535).astype("<u2").tobytes()) for j in np.flatnonzero(take[i : i + CHUNK])} - met
                if own:
                    met |= own
                    langs, rows = zip(*sorted(own))
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary()), pa.array([-1] * n, pa.int32()), pa.array([0] * n, pa.int64())], ["lang", "counts", "feature", "n"])
        seen = np.flatnonzero(df)
        n = len(seen) + 1
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.array(np.append(seen, DIM).astype(np.int32)), pa.array(np.append(df[seen], docs))], ["lang", "counts", "feature", "n"])

    found = common.materialise(src.select("text", "lang", picked.alias("take")).mapInArrow(step, "lang string, counts binary, feature int, n bigint"), "langid")
    df = np.zeros(DIM + 1, np.int64)
    for f, n in found.where("feature >= 0").groupBy("feature").agg(F.sum("n")).collect():
        df[f] = n
    langs, counts = [], []  # a row at a time, so that the driver holds them once
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("counts"), "counts"))
    rows = found.where("feature < 0").select("lang", "counts").distinct().withColumn("rank", rank).where(F.col("rank") <= 2 * each)
    for r in rows.orderBy("lang", "counts").toLocalIterator():
        langs.append(r.lang)
        counts.append(np.frombuffer(r.counts, "<u2"))
    common.discard(found)
    return fit_sample(langs, np.stack(counts), df[:DIM], int(df[DIM]), k)


def has_letter(text_col: str = "text") -> Column:
    return F.coalesce(common.quoted(text_col).rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, if none are named) with lang_pred, score and rejected."""
    spark = docs.sparkSession
    common.small_batches(spark)
    keep = common.others(docs.columns if keep is None else keep, ("lang_pred", "score", "rejected"))
    if model is None:
        return docs.select(*map(common.quoted, keep), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    sent = spark.sparkContext.broadcast(model)
    src = docs.select(*common.numbered(keep), has_letter(text_col).alias("ok"), common.quoted(text_col).alias("text"))
    schema = T.StructType(src.schema.fields[:-2] + T._parse_datatype_string("lang_pred string, score double, rejected boolean").fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        model = sent.value
        names = np.array(model.languages, object)
        for batch in batches:
            n = batch.num_columns
            if not batch.num_rows:
                continue
            ok = batch.column(n - 2).to_numpy(zero_copy_only=False).astype(bool)
            at, score, far = model.predict(batch.column(n - 1))
            lang = np.where(ok, names[at], "und")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n - 2)), pa.array(lang, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(~ok | far)], [f.name for f in schema])

    return common.renamed(src.mapInArrow(step, schema), keep)
