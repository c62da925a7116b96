"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table


def held_out() -> Column:
    """Rows that nothing is learned from; null for a row without a doc_id, which is learned
    from no more than those."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language_id import fit, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return identify(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, keep=["doc_id"], spans=False)


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, wherever it is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, window=1024)


def op5_kd_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.kd_shard import kd_shard

    return kd_shard(table(spark, sf_dir, "documents"), shards=8)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"), words=4, distance=4)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import read_warc, write_warc

    return read_warc(spark, write_warc(table(spark, sf_dir, "pages"), revisit_bytes=1000)).drop("url")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_store import read_tokens, write_tokens

    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), ngram=4, percent=85)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.resampling import importance_resample

    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, min_words=20, seed=2024).drop("n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_decontaminate, op3_quality, op4_packing, op5_kd_shard, op6_line_dedup, op7_simhash, op8_warc, op9_token_store, op10_exact_dedup, op11_filter_audit, op12_ngram_join, op13_importance_resampling)}

ORACLES: dict[str, str] = {
    "op8_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND keep <> page_id THEN keep END AS refers_to
FROM k""",
    "op2_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS pattern
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS pattern
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT doc_id, n, k, item_id FROM dw JOIN iw USING (n, pattern)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
who AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN who USING (doc_id)""",
    "op10_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
ranked AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM ranked""",
    "op11_filter_audit": r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
m AS (
  SELECT doc_id, part,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > first, false)::INT AS fails
  FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
cube AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
letter AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(name, bit)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, k::INT AS step, (SELECT bit FROM letter WHERE name = filter_order[k]) AS bit,
         list_sum(list_transform(range(1, k), lambda j: 1 << (ascii(filter_order[j]) - 65)))::INT AS before
  FROM orders, range(1, 6) AS r(k)),
counted AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (fails & (bit | coalesce(before, 0)) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails & bit <> 0 AND fails & coalesce(before, 0) = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails & bit <> 0 AND fails & coalesce(before, 0) <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (good AND fails & bit <> 0 AND fails & coalesce(before, 0) = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (toxic AND fails & bit <> 0 AND fails & coalesce(before, 0) = 0), 0)::BIGINT AS toxic_lost
  FROM cube, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted""",
    "op12_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D\x20]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root)::BIGINT AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY ALL""",
    "op13_importance_resampling": r"""
WITH words AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 't', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
crc AS (
  SELECT w, xor(list_reduce(list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT),
                lambda a, b: list_reduce(range(0, 8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS b
  FROM (SELECT DISTINCT w FROM words)),
n AS (SELECT side, b, count(*) AS n FROM words JOIN crc USING (w) GROUP BY ALL),
sums AS (SELECT coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM n),
gains AS (
  SELECT b, floor(1000 * ln(((coalesce(sum(n) FILTER (side = 't'), 0) + 1)::DOUBLE * ((SELECT s FROM sums) + 10000)) / ((coalesce(sum(n) FILTER (side = 'd'), 0) + 1)::DOUBLE * ((SELECT t FROM sums) + 10000)))) AS gain
  FROM n GROUP BY b),
weights AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
  FROM words JOIN crc USING (w) JOIN gains USING (b) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM drawn) THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (doc_id)""",
}
