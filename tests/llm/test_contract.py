"""The queries' contracts, and the pipeline against its stages done plainly."""

import random
import re

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op3_quality": ["doc_id", "held_out", "score", "predicted"],
    "op4_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5_kd_shard": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op6_line_dedup": ["doc_id", "text", "n_lines", "n_removed"],
    "op7_simhash": ["doc_id", "fingerprint", "component_id"],
    "op8_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, sf, name):
    from tessera.llm.queries import QUERIES

    df = QUERIES[name](spark, sf)
    assert set(COLUMNS[name]) <= set(df.columns)
    rows = spark.read.parquet(f"{sf}/{'pages' if name == 'op8_warc' else 'documents'}.parquet").count()
    assert df.count() >= rows if name == "op4_packing" else df.count() == rows


@pytest.mark.parametrize("name", ["op2_decontaminate", "op8_warc", "op10_exact_dedup"])
def test_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    from tessera.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = QUERIES[name](spark, sf)
    want = con.sql(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_native_operators_run_no_python(spark, sf):
    from tessera.llm.queries import QUERIES

    for name in ("op5_kd_shard", "op10_exact_dedup"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas|MapIn", plan)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory, sf):
    """Documents of four languages with copies, near copies, a leak, noise and nulls."""
    from tessera.llm.common import scratch

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars between 300 and 4000").limit(80)
    rng = random.Random(9)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id = 3").first().text
    a = rows[0]
    rows += [(9001, a[1], a[2], "x", a[4]), (9002, rows[1][1] + " " + leak, rows[1][2], "x", 0), (9003, None, None, "x", None), (9004, "", "en", "x", 0), (9005, "123 456", "en", "x", 7)]
    rng.shuffle(rows)
    folder = scratch(spark, "corpus")
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, corpus).cache()
        if name != "packing":
            assert out.columns == columns
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        docs = out
    assert not kept["language_id"] & {9003, 9004, 9005} and 9001 in kept["language_id"]
    assert len(kept["language_id"] & set(range(9000))) >= 76
    assert 9001 not in kept["line_dedup"]
    assert 9002 not in kept["decontaminate"]
    assert kept["packing"] == kept["decontaminate"]
    assert pipeline.run(spark, corpus).select("doc_id").distinct().count() == len(kept["packing"])


def test_near_dedup_keeps_one_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(5, text), (3, text + " more"), (9, "another text of its own entirely, with other words in it"), (None, text)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENT)
    assert [r.doc_id for r in pipeline.near_dedup(spark, docs, "").orderBy("doc_id").collect()] == [3, 9]


DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
OWN = "A line of its own that only this document has, number {}."


def test_near_dedup_of_repeated_ids(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(3, text), (3, text), (3, "a wholly other text under the same id as before"), (2, "a wholly other text under the same id as before"), (7, OWN.format(7)), (None, "x"), (None, "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENT)
    got = [(r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(3, text), (2, rows[3][1]), (7, OWN.format(7)), (None, "x")], key=repr)


def test_documents_left_without_a_line_go(spark):
    line = "the very same line, which more than one document has"
    rows = [(1, line), (2, line + "\n\n"), (3, "\t\n" + line + "\n \x0b\f\r"), (4, line + "\n" + OWN.format(4)), (5, " \n\t"), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENT)
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == {1: (line, len(line)), 4: (OWN.format(4), len(OWN.format(4))), 5: (" \n\t", 3), 6: (None, None), 7: ("", 0)}


CLASHES = {"Score": "double", "N_HIT": "int", "drop": "string", "__d": "int", "n_lines": "int", "N_Removed": "int", "fp": "bigint", "component_id": "int", "c0": "int", "rejected": "boolean", "a.b": "string", "own_1": "int"}


def test_stages_leave_columns_alone(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    more = docs.select("*", *[F.lit(i).cast(t).alias(c) for i, (c, t) in enumerate(CLASHES.items())])
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, more, corpus)
        assert out.schema.simpleString() == more.schema.simpleString()
        assert {r[5:] for r in out.collect()} == {more.first()[5:]}
    assert pipeline.STAGES[-1][1](spark, more, corpus).count() >= more.count()


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "simhash", "decontaminate"])
def test_a_stage_is_its_operator_done_plainly(spark, corpus, name):
    """Which documents stay, told from the operators' rules row by row."""
    from test_dedup_operators import brute_lines, components

    from tessera.llm import decontaminate, language_id, line_dedup, simhash

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in dict(pipeline.STAGES)[name](spark, docs, corpus).collect()}
    if name == "language_id":
        model = language_id.fit(docs)
        at, _, far = model.predict(__import__("pyarrow").array([t for _, t in rows]))
        want = {i: t for (i, t), f in zip(rows, far) if t and not f and any(c.isalpha() for c in t)}
    elif name == "simhash":
        prints = [simhash.fingerprint(t) for _, t in rows]
        root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
        first = {r: min(i for (i, _), q in zip(rows, root) if q == r) for r in root}
        want = {i: t for (i, t), r in zip(rows, root) if first[r] == i}
    elif name == "decontaminate":
        windows = set()
        for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect():
            w = decontaminate.words(r.text)
            n = min(10, len(w))
            windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)}
        sizes = {len(x) for x in windows}
        want = {i: t for i, t in rows if not any(tuple(decontaminate.words(t)[k : k + n]) in windows for n in sizes for k in range(len(decontaminate.words(t)) - n + 1))}
    else:
        cut = brute_lines(sorted(rows))
        want = {i: cut[i] for i, t in rows if cut[i] == t or any(x.strip(line_dedup.BLANK) for x in cut[i].split("\n"))}
    assert got == want


def test_stages_of_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where(F.lit(False))
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0
