"""Exact, near and line deduplication against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, exact_dedup, line_dedup, simhash

DOCS = "doc_id bigint, text string"


def components(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def check_exact(docs, **options):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t if c not in " \t\n\v\f\r")].append((i, t))
    want = []
    for norm, own in groups.items():
        first, *rest = sorted(own, key=lambda x: (-len(x[1]), x[0] is None, x[0]))
        want += [(i, first[0], len(own), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, (i, _) in enumerate([first, *rest])]
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs, **options).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_exact_dedup_is_brute_force(spark, hard, empty):
    check_exact(hard, capacity=2)
    assert exact_dedup.exact_dedup(empty).count() == 0
    check_exact(spark.createDataFrame([(1, "a b"), (1, "ab"), (1, "ab"), (2, "a b"), (None, "a  b"), (None, "c"), (None, "c")], DOCS))


def test_exact_dedup_of_a_hot_text(spark):
    check_exact(spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the  hot text").otherwise(F.concat(F.lit("t "), (F.col("id") % 900).cast("string"))).alias("text"), F.lit(1).alias("h"), F.lit(2).alias("N")))


def test_chains_are_taken_apart_by_bytes(spark, hard, monkeypatch):
    monkeypatch.setattr(exact_dedup, "text_hash", lambda norm: F.pmod(F.xxhash64(norm), F.lit(3)))
    check_exact(hard)
    monkeypatch.setattr(exact_dedup, "text_hash", lambda norm: F.lit(5).cast("bigint"))
    check_exact(hard, capacity=1)


def test_the_index_is_dealt_once_and_settled_in_its_buckets(spark, sf):
    plans = []
    write = common.materialise
    with pytest.MonkeyPatch.context() as m:
        m.setattr(common, "materialise", lambda df, name, rows=None: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), write(df, name, rows))[1])
        exact_dedup.exact_dedup(spark.read.parquet(f"{sf}/documents.parquet")).count()
    plan = dict(plans)["index"]
    assert plan.count("hashpartitioning(bucket") == 1


def test_directory_doubles_until_buckets_fit():
    depth, slots = exact_dedup.directory([(0, 5), (1, 5), (8, 1)], 5, max_depth=4)
    assert depth == 4 and len(slots) == 16
    assert slots[0] != slots[1] and len(set(slots[8:])) == 1
    assert exact_dedup.directory([(3, 100)], 5, max_depth=4)[0] == 4  # one hash cannot be split further
    assert exact_dedup.directory([], 5, max_depth=4) == (0, [0])


def slow_fingerprint(text, n=4):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(hard, empty):
    for r in simhash.simhash_groups(hard).collect():
        assert any(r.fingerprint == f"{slow_fingerprint(x.text):016x}" for x in hard.where(f"doc_id <=> {'null' if r.doc_id is None else r.doc_id}").collect())
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("width, cap", [(1, 4096), (2, 4096), (3, 4096), (4, 4096), (2, 4), (4, 4), (None, 4096)])
def test_links_of_fingerprints_are_brute_force(spark, width, cap):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for _ in range(rng.randrange(12)):
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                f ^= 1 << b
            fps.append(f)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), 4, len(fps), width, cap)
    at = {s: i for i, s in enumerate(signed)}
    got = components(len(fps), [(at[r.a], at[r.b]) for r in links.collect()])
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("distance", [1, 4, 6])
def test_covers_serve_every_choice_of_positions(distance):
    from itertools import combinations

    least = 8 - distance
    for width in range(1, least + 1):
        sets = simhash.cover(width, least)
        assert all(any(set(s) <= set(x) for s in sets) for x in combinations(range(8), least))


def test_the_tally_counts_shared_bytes():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 3, (500, 8)).astype(np.uint8) for _ in range(2))
    want = [(x == y).sum() >= 5 and np.bitwise_count(x ^ y).sum() <= 3 for x, y in zip(a, b)]
    assert simhash.linker(3)(a.view(np.int64).ravel(), b.view(np.int64).ravel()).tolist() == want


@pytest.mark.parametrize("width", [None, 2])
def test_components_of_documents_are_brute_force(spark, width):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        t = rng.choices(words, k=rng.choice([3, 60, 200]))
        for _ in range(rng.randrange(5)):
            t = list(t)
            t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    rows = [(i, t) for i, t in enumerate(texts + texts[:4] + ["", None, " \n"])] + [(None, texts[0])]
    rng.shuffle(rows)
    fps = [slow_fingerprint(t) for _, t in rows]
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    want = sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, root)), key=repr)
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], DOCS + ", fp int, `Fingerprint` string")
    got = simhash.simhash_groups(docs, width=width)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(7, 7)]
    want = components(200, edges)
    smallest = {}
    for i in range(200):
        smallest[want[i]] = min(smallest.get(want[i], i), i)
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: smallest[want[i]] for i in range(200) if sum(w == want[i] for w in want) > 1}
    assert common.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_lines(rows):
    places = defaultdict(list)
    for i, t in rows:
        for p, x in enumerate((t or "").split("\n")):
            if x.strip(line_dedup.BLANK):
                places[x].append((i, p))
    lines = list(places)
    grams = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    root = components(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if grams[i] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])])
    own = defaultdict(list)
    for i, x in enumerate(lines):
        own[root[i]] += places[x]
    gone = {p for v in own.values() for p in sorted(v)[1:]}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}


def test_line_dedup_is_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(rng.choice([3, 12, 40]))) for _ in range(25)]

    def line():
        x = rng.choice(base)
        if rng.random() < 0.5:
            i = rng.randrange(len(x))
            x = x[:i] + rng.choice("xyz") + x[i + 1 :]
        return x

    rows = [(i, "\n".join(rng.choice([line(), line(), line(), "", "ab", " "]) for _ in range(rng.randrange(12)))) for i in range(60)] + [(99, None), (100, "")]
    docs = spark.createDataFrame(rows, DOCS)
    want = brute_lines(rows)
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()} == want
    monkeypatch.setattr(line_dedup.candidate_sets, "__defaults__", (6, None))  # sets over six go through blocks
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()} == want


def test_line_dedup_edges(hard, empty):
    got = line_dedup.line_dedup(hard).collect()
    assert len(got) == hard.count()
    by = {r.doc_id: r for r in got}
    assert by[4].text is None and by[5].text == "" and by[6].text == " \n\t " and by[8].n_removed > 2900
    assert [r.text for r in got if r.doc_id == 2] == ["", ""] and by[1].n_removed == 0
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_with_clashing_columns(spark):
    schema = "`Doc_ID` bigint, `drop` int, text string, `__d` int, `__key` int, `N_Lines` string, k int, `a.b` string, c0 int"
    line = "one line that is in both documents"
    docs = spark.createDataFrame([(1, 5, f"{line}\nown", 6, 7, "x", 8, "y", 9), (2, 5, f"other\n{line}", 6, 7, "x", 8, "y", 9)], schema)
    got = line_dedup.line_dedup(docs)
    assert got.columns == ["Doc_ID", "drop", "text", "__d", "__key", "k", "a.b", "c0", "n_lines", "n_removed"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, 5, f"{line}\nown", 6, 7, 8, "y", 9, 2, 0), (2, 5, "other", 6, 7, 8, "y", 9, 2, 1)]


def test_lines_that_share_half_an_id(spark, monkeypatch):
    own = line_dedup.line_id
    monkeypatch.setattr(line_dedup, "line_id", lambda x: own("l" if x.startswith("line number 0") or x.endswith("1") else x)[:8] + own(x)[8:])
    rows = [(i, f"line number {i} of those that are here\nthe very same line in all documents, {i % 3}") for i in range(12)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()} == brute_lines(rows)


def test_a_hot_line_is_no_key(spark):
    """One line in every document: its places are not gathered in one task."""
    places = common.materialise(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(1).cast("bigint").alias("text_key"), F.lit(0).alias("pos"), F.lit(b"x").alias("id")), "places")
    out = line_dedup.surplus(places, spark.createDataFrame([], "node binary, root binary"))
    assert out.count() == 1999 and out.agg(F.min("doc_id")).first()[0] == 1


def test_bands_find_similar_lines():
    rng = random.Random(2)
    found = 0
    for _ in range(300):
        a = "".join(rng.choice("abcdefgh ") for _ in range(200))
        b = list(a)
        for i in rng.sample(range(200), 2):
            b[i] = "z"
        ka, kb = line_dedup.band_keys([a, "".join(b)])
        found += bool((ka == kb).any())
    assert found >= 297


def test_similarity_is_that_of_the_shingles():
    rng = random.Random(7)
    lines = []
    for _ in range(40):
        x = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(8, 120)))
        lines += [x, x[: len(x) // 2] + rng.choice(["", "zz", "漢"]) + x[len(x) // 2 :], x + x]
    s, every = line_dedup.Shingled(lines), np.arange(len(lines))
    for i, x in enumerate(lines):
        own = {x[k : k + 8] for k in range(len(x) - 7)}
        want = []
        for y in lines:
            other = {y[k : k + 8] for k in range(len(y) - 7)}
            want.append(len(own & other) >= 0.8 * len(own | other) - 1e-9)
        assert s.near(every, i, 0.8).tolist() == want


def test_long_lines_are_compared_two_at_a_time(monkeypatch):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdef ") for _ in range(500))
    sets = [{b"a": base, b"b": base[:250] + "zz" + base[250:], b"c": base[::-1], b"d": base + "q"}, {b"x": "entirely other", b"y": "line of words"}]
    want = line_dedup.set_links(sets, 0.8)
    assert sorted(zip(*want)) == [(b"b", b"a"), (b"d", b"a")]
    monkeypatch.setattr(line_dedup, "LINE_CHARS", 100)
    assert line_dedup.set_links(sets, 0.8) == want


def test_sets_of_few_lines_are_compared_at_once(monkeypatch):
    """Small sets give the links that one at a time gives, and no line is shingled by itself."""
    rng = random.Random(9)
    sets = []
    for k in range(300):
        base = "".join(rng.choice("abcdefgh é") for _ in range(rng.choice([8, 9, 30, 200, 900])))
        own = {b"%d" % k: base}
        for j in range(rng.randrange(1, 4)):
            at, n = rng.randrange(len(base)), rng.choice([0, 1, 2, len(base) // 30])
            own[b"%d.%d" % (k, j)] = rng.choice([base[:at] + "x" * n + base[at:], base[::-1], base + base, "漢" + base])
        sets.append(own)
    want = [[], []]
    for own in sets:
        ids, lines = list(own), list(own.values())
        got = line_dedup.star_forest(np.arange(len(ids)), line_dedup.long_lines_near(lines, 0.8))
        for x, y in zip(want, got):
            x += [ids[i] for i in y]
    assert len(want[0]) > 100
    monkeypatch.setattr(line_dedup, "SORTED", 3000)
    assert line_dedup.set_links(sets, 0.8) == tuple(want)
    monkeypatch.setattr(line_dedup, "Shingled", None)
    latin = [own for own in sets if max(map(max, own.values())) < "Ā"]
    assert len(line_dedup.set_links(latin, 0.8)[0]) > 50


def test_without(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d")], DOCS)
    gone = spark.createDataFrame([(2,), (None,)], "x bigint")
    assert sorted(r.text for r in common.without(docs, gone, "doc_id").collect()) == ["a", "d"]
    assert common.without(docs, gone.limit(0), "doc_id").count() == 4
