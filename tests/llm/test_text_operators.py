"""Language ID, quality, decontamination and their edge cases."""

import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, quality

BENCH = [(1, "same text word for word in two documents of one table"), (2, "Mot pour mot"), (2, "mot pour mot"), (3, None), (None, "goes on and on number 17 and ends here at last"), (4, "")]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_contamination(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    out = []
    for doc_id, text in docs:
        w = split(text)
        hit, who = set(), set()
        for item, t in items:
            v = split(t)
            n = min(window, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit |= set(range(j, j + n))
                        who.add(item)
        out.append((doc_id, len(w), len(hit), len({x for x in who if x is not None})))
    return sorted(out, key=repr)


def test_contamination_is_brute_force(spark, hard):
    small = hard.where("doc_id is null or doc_id <> 8").unionByName(hard.where("doc_id = 8").withColumn("text", F.substring("text", 1, 3000)))
    items = spark.createDataFrame(BENCH, "item_id bigint, text string")
    want = brute_contamination([(r.doc_id, r.text) for r in small.collect()], BENCH)
    for limit in (1 << 20, 90):  # one automaton, and one after the other
        got = decontaminate.contamination(small, items, max_nodes=limit)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got.collect()), key=repr) == want


def test_long_items_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 3)
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, " ".join(f"w{i}" for i in range(11, 25))), (3, " ".join(f"w{i}" for i in range(9)))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, text)], "item_id bigint, text string")
    for limit in (1 << 20, 60):
        got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.contamination(docs, items, max_nodes=limit).collect()}
        assert got == {1: (40, 1), 2: (14, 1), 3: (0, 0)}


def test_an_automaton_has_no_more_nodes_than_counted():
    rng = np.random.default_rng(3)
    w = [b"w%d" % i for i in rng.integers(0, 50, 500)]
    p = decontaminate.Patterns.of([("a", b" ".join(w))], 10)
    assert p.automaton.get_stats()["nodes_count"] <= 491 * 10 + 1


def test_items_that_open_alike_are_named_once():
    opening = b" ".join(b"word%d" % i for i in range(10))
    parts = [(f"{i:06d}", opening + b" own%d" % i) for i in range(40_000)]
    began = time.process_time()
    p = decontaminate.Patterns.of(parts, 10)
    text = opening.decode()
    told = [p.told(p.scan(text + f" own{i}")[2]) for i in (1, 1, 7)]
    assert time.process_time() - began < 20
    assert all(n == 40_000 for n, _ in told) and len({d for _, d in told}) == 1
    assert len(p.groups) == 40_001 and sum(map(len, p.groups)) == 80_000


def test_contamination_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mot pour mot", 3, "x", 4)], "doc_id bigint, text string, `N_HIT` int, words string, c0 int")
    items = spark.createDataFrame([(2, "mot pour mot")], "item_id bigint, text string")
    got = decontaminate.contamination(docs, items)
    assert got.columns[:4] == ["doc_id", "text", "words", "c0"] and got.first()[:6] == (1, "mot pour mot", "x", 4, 3, 3)


def test_spans_are_places_of_the_original(spark):
    docs = spark.createDataFrame([(1, "Éa -- MOT,  pour\nmot! and MOT POUR MOT")], "doc_id bigint, text string")
    items = spark.createDataFrame([(2, "mot pour mot")], "item_id bigint, text string")
    r = decontaminate.contamination(docs, items).first()
    assert [r.text[a:b] for a, b in r.spans] == ["MOT,  pour\nmot", "MOT POUR MOT"]


def test_contamination_of_empty_tables(spark, hard, empty):
    items = spark.createDataFrame(BENCH, "item_id bigint, text string")
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(hard, items.limit(0)).where("contaminated").count() == 0


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learn = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = language_id.identify(docs, language_id.fit(learn)).collect()
    right = [r.lang == r.lang_pred for r in got if held(r.doc_id)]
    assert sum(right) >= 0.95 * len(right)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(hard, empty):
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in language_id.identify(hard, language_id.fit(hard), keep=["doc_id", "score"]).collect()}
    assert {(4, "und", True), (5, "und", True), (6, "und", True), (9, "und", True)} <= got
    assert language_id.fit(empty) is None
    assert {r.lang_pred for r in language_id.identify(hard, None).collect()} == {"und"}


def test_equal_rows_leave_room_for_other_languages(spark):
    rows = [(1, "the same english words again", "aa")] * 300 + [(i, f"zwei drei vier fuenf {i} sechs", "zz") for i in range(60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample=40)
    assert set(model.languages) == {"aa", "zz"}
    many = [(i, f"text of its own {chr(97 + i % 26) * 5}", f"l{i:03d}") for i in range(260)]
    assert len(set(language_id.fit(spark.createDataFrame(many, "doc_id bigint, text string, lang string"), sample=100).languages)) == 260


def test_language_and_quality_with_clashing_columns(spark, hard):
    docs = hard.select("doc_id", "text", "lang", F.lit(1).alias("Score"), F.lit(2).alias("REJECTED"), F.lit(3).alias("ok"), F.lit(4).alias("c1"), F.lit(5).alias("a b.c"))
    got = language_id.identify(docs, language_id.fit(docs))
    assert got.columns == ["doc_id", "text", "lang", "ok", "c1", "a b.c", "lang_pred", "score", "rejected"] and got.count() == docs.count()
    got = quality.score(docs, quality.fit(docs, spark.createDataFrame([(1, 1), (7, 0)], "doc_id bigint, quality int")))
    assert got.columns == ["doc_id", "text", "lang", "REJECTED", "ok", "c1", "a b.c", "score"] and got.count() == docs.count()


def brute_cosines(texts, model):
    """Every text against every centroid, in plain Python."""
    out = []
    for t in texts:
        x = np.log1p(language_id.count_vector(t).astype(float)) * model.idf
        x = x / max(np.linalg.norm(x), 1e-12)
        s = [float(np.dot(x, c)) for c in model.centroids]
        out.append((model.languages[int(np.argmax(s))], max(s)))
    return out


def test_the_nearest_of_all_centroids_decides(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 100").limit(60)
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = language_id.identify(docs, model).collect()
    for r, (lang, cos) in zip(rows, brute_cosines([r.text for r in rows], model), strict=True):
        assert abs(r.score - min(1, cos)) < 1e-4 and r.lang_pred in (lang, "und")


def test_far_texts_are_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(1, "漢字仮名交じり文" * 200), (2, "zqxj kvwz " * 300)], "doc_id bigint, text string")
    assert all(r.rejected for r in language_id.identify(odd, language_id.fit(docs)).collect())


def test_long_text_counts_in_pieces(monkeypatch):
    text = "some words and more of them " * 50
    whole = language_id.count_vector(text)
    monkeypatch.setattr(language_id, "PIECE", 64)
    assert (language_id.count_vector(text) == whole).all()


def test_trees_learn_and_walk_alike():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = quality.grow(x[:2000], y[:2000], trees=60)
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    one = []
    for row in x[:50]:  # the same trees, node by node
        m = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            m += leaf[at - len(f)]
        one.append(m)
    assert np.allclose(one, model.margin(x[:50]))


def test_quality_of_held_out_documents(spark):
    from tessera.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op3_quality"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert len(rows) > 30 and sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def slow_score(model, x):
    m = model.base
    for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
        at = 0
        while at < len(f):
            at = 2 * at + (2 if x[f[at]] > t[at] else 1)
        m += leaf[at - len(f)]
    return 1 / (1 + np.exp(-m))


def test_scores_are_those_of_a_walk_node_by_node(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    for r in quality.score(docs, model).limit(40).collect():
        assert abs(r.score - slow_score(model, quality.statistics(r.text))) < 1e-9
    again = docs.unionByName(docs.where("doc_id % 2 = 0").withColumn("text", F.concat("text", F.lit(" zz"))))
    assert (quality.fit(again, labels).threshold == model.threshold).all()  # the least text of an id


def test_quality_edges(spark, hard, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (7, 1), (9, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    got = quality.score(hard, quality.fit(hard, labels), keep=["doc_id"]).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.fit(empty, labels).base == pytest.approx(0, abs=1e-9)
    assert quality.score(empty, quality.fit(hard, labels.limit(0))).count() == 0


def test_statistics_have_their_names():
    for t in (None, "", "  \n", "One two.\nOne two.\n", "a" * 100_000):
        s = quality.statistics(t)
        assert len(s) == len(quality.FEATURES) and np.isfinite(s).all()
