"""A corpus from raw documents to packed token sequences.

STAGES are applied one after the other; each gets all that its predecessor kept,
as a Parquet table, and all but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, remove, scratch, table, without
from tessera.llm.decontaminate import contamination
from tessera.llm.language_id import fit, identify
from tessera.llm.line_dedup import BLANK, line_dedup
from tessera.llm.packing import pack_documents
from tessera.llm.queries import vocabulary
from tessera.llm.simhash import fingerprint_column, simhash_groups

#: the columns that operators read; any other is out of their sight, whatever its name
READ = ("doc_id", "text", "lang")


def shielded(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that the operator returns, with the columns of docs and no others."""
    inner = [c if c in READ else f"own_{i}" for i, c in enumerate(docs.columns)]
    return operator(docs.toDF(*inner)).select(*inner).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rejected go: null ones, those without a letter and those far from every
    language. Repeated rows and very long texts are judged like any other."""
    return shielded(docs, lambda d: identify(d, fit(d)).where("not rejected"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar lines one stays. Documents that lose all their lines
    go, blank ones not counting; those that never had any stay. n_chars is counted anew."""
    left = F.translate("text", BLANK + "\n", "") != ""
    out = shielded(docs, lambda d: line_dedup(d).where((F.col("n_removed") == 0) | left))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id stays; of
    rows of one group that share that doc_id, one. Null and empty texts are a group; a
    null doc_id only stays where its group has no other."""
    groups = materialise(simhash_groups(docs), "groups")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = groups.groupBy("doc_id").agg(F.bool_or(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    out = without(docs, ids.where("not stays").select("doc_id"), "doc_id")
    several = materialise(ids.where("stays and n > 1").select("doc_id"), "several", rows=0)
    if several.isEmpty():
        return out
    # a doc_id of several rows: each is looked up by its own fingerprint
    inner = [f"own_{i}" for i in range(len(docs.columns))]
    text, key = (F.col(inner[docs.columns.index(c)]) for c in ("text", "doc_id"))
    held = groups.where(stays).select(F.col("doc_id").alias("of"), F.col("fingerprint").alias("print")).distinct()
    rows = out.join(several, out["doc_id"].eqNullSafe(several["doc_id"]), "left_semi").toDF(*inner).withColumn("own_print", fingerprint_column(text))
    kept = rows.join(held, key.eqNullSafe(F.col("of")) & (F.col("own_print") == F.col("print")), "left_semi")
    one = kept.dropDuplicates([inner[docs.columns.index("doc_id")]]).select(*inner).toDF(*docs.columns)
    return without(out, several, "doc_id").unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts hold none."""
    return shielded(docs, lambda d: contamination(d, table(spark, sf_dir, "benchmark"), window=10, spans=False).where("not contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids, in sequences of 1024; a null text is the end
    id alone. Columns of docs other than doc_id are not kept."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0, window=1024, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Trained centroids, MinHash and a tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes once the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs
