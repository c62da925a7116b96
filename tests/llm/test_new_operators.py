"""Filter audit, n-gram join and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, ngram_join, resampling

DOCS = "doc_id bigint, text string, lang string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


# ------------------------------------------------------------------ filter audit


def brute_audit(rows, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = words(t)
        same = [j for j, u, _ in rows if (u or "") == t and j is not None]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j < i for j in same)}
        docs.append((lang or "", i, {k for k, v in fails.items() if v}))
    out = []
    for part in {p for p, _, _ in docs}:
        own = [(i, f) for p, i, f in docs if p == part]
        shapley, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def audit_rows():
    rng = random.Random(5)
    long_ = " ".join(f"w{i}" for i in range(220))
    texts = [long_, long_ + " # X", "x " * 300, "LOUD AND CLEAR", "a | b", "", None, "few words here", "RED " * 250]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", None])) for i in range(90)]
    return rows + [(3, "few words here", "en"), (3, "few words here", "en"), (None, "few words here", "en"), (None, long_, "de"), (-1, None, "fr"), (200, "Only one, in its language", "it")]


def test_filter_audit_is_brute_force(spark):
    rows = audit_rows()
    labels = [(i, i % 2, (i + 1) % 3 == 0) for i in range(0, 80, 3)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (9999, 1, 1), (6, None, None)]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], DOCS + ", fails int, Part boolean")
    given = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id bigint, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.filter_audit(docs, given).collect())
    assert got == brute_audit(rows, [(i, q, t) for i, q, t in labels])


def test_audit_shares_states_and_holds_few(spark, monkeypatch):
    visited, held, most = [], 0, 0
    kind = type(spark.range(1))
    write, persist, drop = filter_audit.common.materialise, kind.persist, kind.unpersist

    def persisted(self, *a):
        nonlocal held, most
        held += 1
        most = max(most, held)
        return persist(self, *a)

    def dropped(self, *a):
        nonlocal held
        held -= 1
        return drop(self, *a)

    monkeypatch.setattr(kind, "persist", persisted)
    monkeypatch.setattr(kind, "unpersist", dropped)
    monkeypatch.setattr(filter_audit.common, "materialise", lambda df, name, rows=None: (visited.append(name), write(df, name, rows))[1])
    judged = spark.createDataFrame([("en", i % 8, False, False) for i in range(40)], "part string, fails int, good boolean, toxic boolean")
    filter_audit.walk(judged, 3).collect()
    assert visited.count("edges") == 7 and most <= 3 and held == 0


def test_audit_of_an_empty_table(spark, empty):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert filter_audit.filter_audit(empty, labels).count() == 0


def test_audit_of_the_hard_rows_with_two_filters(spark, hard):
    own = {"x": filter_audit.symbols(b"!"), "y": filter_audit.few_words(5)}
    rows = filter_audit.filter_audit(hard, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), own).collect()
    assert len(rows) == 2 * 2 * hard.select("lang").distinct().count()
    assert {r.filter_order for r in rows} == {"xy", "yx"} and sum(r.good_lost + r.toxic_lost for r in rows) == 0
    with pytest.raises(ValueError):
        filter_audit.filter_audit(hard, hard, {})


# ------------------------------------------------------------------- n-gram join


def brute_join(rows, n=4, percent=85):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x09-\x0D\x20]+", lower(t)) if x]
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, len(sets[i]), ids.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def check_join(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, size int, Set string").repartition(3)
    got = sorted((tuple(r) for r in ngram_join.ngram_join(docs, **options).collect()), key=repr)
    assert got == brute_join(rows, options.get("ngram", 4), options.get("percent", 85))


def versions(rng, words, k, most):
    """Texts around one, each with up to `most` words changed, added or left out."""
    out = []
    for _ in range(k):
        w = list(words)
        for _ in range(rng.randrange(most + 1)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [f"new{rng.random()}"], [w[i], "more"]])
        out.append(" ".join(w))
    return out


def join_rows(seed=1):
    rng = random.Random(seed)
    texts = []
    for size in (1, 3, 4, 5, 8, 11, 14, 20, 30, 60, 150, 400):
        words = [f"w{rng.randrange(500)}" for _ in range(size)]
        texts += versions(rng, words, 12, max(1, size // 22))
    texts += ["", None, " \n\t", "One two", "one  TWO\n", "one two three four", "x " * 50, "x " * 60]
    rows = list(enumerate(texts, 10))
    rng.shuffle(rows)
    return rows + [(None, texts[0]), (None, "only without an id, some words long"), (12, texts[2]), (12, texts[2]), (5, texts[-3]), (11, "another text under a known id, which is of its own")]


@pytest.mark.parametrize("tolerance", [(0, 1), (1, 3), (2, 5)])
def test_join_is_brute_force(spark, tolerance):
    check_join(spark, join_rows(tolerance[0]), tolerance=tolerance)


def test_chains_in_long_postings(spark, monkeypatch):
    """Versions that drift: the first is far from the last, all are one component."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[rng.randrange(120)] = f"v{i}"
    rows += [(100 + i, " ".join(f"u{i}x{j}" if j % 2 else f"w{j}" for j in range(120))) for i in range(20)]
    check_join(spark, rows, cap=8)
    monkeypatch.setattr(ngram_join, "FEW", 2)
    check_join(spark, rows, cap=8)


def test_open_postings_give_what_stars_miss(spark, monkeypatch):
    """Of five sets that meet in a posting, the first links with none, the others chain."""
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    far = np.unique(rng.integers(0, 2**63, 160, dtype=np.uint64))
    near = [base[i * 8 : 160 + i * 8] for i in range(4)]
    rows = [(i, len(x), bytearray(x.tobytes())) for i, x in enumerate([far, *near], 1)]
    sets = spark.createDataFrame(rows, "member bigint, size bigint, elements binary")
    sketches = spark.createDataFrame([(i, n, bytearray(ngram_join.sketch_of(np.frombuffer(x, np.uint64)).tobytes())) for i, n, x in rows], sets.schema)
    lists = spark.createDataFrame([(7, i) for i in range(1, 6)] + [(8, 1), (8, 2), (8, 3)], "posting bigint, member bigint")
    known = spark.createDataFrame([(2, 2), (3, 2)], "node bigint, root bigint")
    for cap, few in ((512, 4), (512, 0), (2, 4)):
        tasks = ngram_join.open_tasks(lists, known, cap)
        monkeypatch.setattr(ngram_join, "FEW", few)
        left = ngram_join.compared(tasks, sketches, 85, whole=False)
        assert {r.pair for r in left.collect()} <= {few > 0}
        links = {frozenset(r) for r in ngram_join.verified(left.where("pair").select("a", "b"), sets, 85, whole=True).select("a", "b").collect()}
        rest = left.where("not pair").select(F.col("a").alias("task"), F.col("b").alias("member"))
        links |= {frozenset(r) for r in ngram_join.compared(tasks.join(rest, ["task", "member"], "left_semi"), sets, 85, whole=True).collect()}
        seen = {2, 3}
        for _ in range(4):
            for a, b in links:
                if {a, b} & seen:
                    seen |= {a, b}
        assert seen == {2, 3, 4, 5}


def test_overlapping_postings_bring_a_member_once(spark):
    """Postings around one component are a task; only members that met in one are compared."""
    rng = np.random.default_rng(6)
    lists = [(p, int(m)) for p in range(40) for m in rng.choice(30, 20, replace=False)] + [(100 + i, 200 + i + j) for i in range(6) for j in range(2)]
    known = spark.createDataFrame([(i, 0) for i in range(25)], "node bigint, root bigint")
    lists_df = spark.createDataFrame(lists, "posting bigint, member bigint")
    met = {}
    for p, m in lists:
        met.setdefault(p, set()).add(m)
    want = {(a, b) for own in met.values() for a in own for b in own if a < b and (a > 24 or b > 24)}
    for cap in (512, 8):
        tasks = ngram_join.open_tasks(lists_df, known, cap).collect()
        near = [r for r in tasks if r.member < 30]
        assert len(near) == (30 if cap == 512 else 30 * 8)  # 800 rows when each posting brought its members
        got, of = set(), {}
        for r in tasks:
            of.setdefault(r.task, []).append(r)
        for own in of.values():
            meet = ngram_join.together([np.array(r.postings) for r in own], np.array([r.side for r in own]))
            got |= {tuple(sorted((x.member, y.member))) for i, x in enumerate(own) for j, y in enumerate(own) if meet[i, j] and x.root != y.root}
        assert got == want


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (30, 33), (90, 80), (700, 690), (700, 1500)):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        ys = [np.union1d(x[: n - k], rng.integers(0, 2**64, max(0, m - n + k), dtype=np.uint64)) for k in (0, 1, n // 2, n)]
        true = [len(np.setxor1d(x, y)) for y in ys]
        got = ngram_join.distances(ngram_join.sketch_of(x), [ngram_join.sketch_of(y) for y in ys])
        assert all(a <= b and a % 2 == b % 2 for a, b in zip(got.tolist(), true)) and got[-1] > min(n, m) // 3


def test_join_of_a_hot_text_and_an_empty_table(spark, empty, hard):
    rows = [(i, "the hot text of which a third of all documents are copies" if i % 3 == 0 else f"text {i} of its own with number {i * 7}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()}
    assert all(got[i] == (0 if i % 3 == 0 else i) for i in range(900))
    assert ngram_join.ngram_join(empty).count() == 0
    check_join(spark, [(r.doc_id, r.text) for r in hard.collect()])


def test_keys_meet_within_the_distance():
    """Any two sets within the bound share a key of the larger one's band."""
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 6, 9, 40, 333, 2000):
        for flips, pieces in ((0, 1), (1, 3), (2, 5), (3, 7)):
            x = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            for gone in (0, 1, int(ngram_join.farthest(2 * size, 85)) // 2):
                y = np.union1d(x[gone:], rng.integers(0, 2**64, gone, dtype=np.uint64))
                both = len(np.intersect1d(x, y))
                if not len(y) or 100 * both < 85 * (len(x) + len(y) - both):
                    continue
                band = int(np.searchsorted(ngram_join.bands(85)[0], max(len(x), len(y)), side="right")) - 1
                keys = [set(ngram_join.keys_of(e, band, 85, flips, pieces).tolist()) for e in (x, y)]
                assert keys[0] & keys[1]


@pytest.mark.parametrize("weak", [-1, 1, 3, 64])
def test_posted_keys_meet_in_the_smaller_ones_band(monkeypatch, weak):
    """Any two sets that link share a posted key, whatever keys of few bits are left out."""
    monkeypatch.setattr(ngram_join, "WEAK", weak)
    rng = np.random.default_rng(7)
    tried = 0
    for size in (*range(1, 24), 40, 57, 90, 150, 333, 1200):
        for flips, pieces in ((0, 1), (1, 3), (2, 5), (3, 7)):
            x = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            most = int(ngram_join.farthest(2 * size + size // 6, 85))
            for gone in {0, most // 3, most // 2, most}:
                for new in {0, most // 2, most - gone, ngram_join.partner(size, 85) - size + gone}:
                    y = np.union1d(x[gone:], rng.integers(0, 2**64, new, dtype=np.uint64))
                    both = len(np.intersect1d(x, y))
                    if not both or 100 * both < 85 * (len(x) + len(y) - both):
                        continue
                    homes = [ngram_join.homes(len(e), 85) for e in (x, y)]
                    own = min(h[0] for h in homes)
                    assert all(own in h for h in homes)
                    keys = [set(ngram_join.keys_of(e, own, 85, flips, pieces).tolist()) for e in (x, y)]
                    assert keys[0] & keys[1]
                    tried += 1
    assert tried > 500


def test_a_set_has_fewer_keys_than_half_its_elements(spark):
    """Keys are what the shuffle carries; they were 0.57 an element."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(100, 1500))) for _ in range(200)]
    docs = spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "text binary")
    elements = sum(len(ngram_join.set_of(t)) for t in texts)
    assert ngram_join.postings(docs, 4, 85, 1, 3).count() < 0.45 * elements


# -------------------------------------------------------------------- resampling

BENCH = ["the prime number of the two", "une phrase en français", "", None, "prime prime NUMBER"]


def brute_resample(rows, target, percent, least, n=1, buckets=10_000):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(feats(x)[1])
    for x in target:
        t.update(feats(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        words, f = feats(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    drawn = [(*r, k) for k, r in enumerate(order[: percent * len(order) // 100], 1)]
    rest = order[len(drawn) :] + [r for r in out if r[1] < least]
    return sorted(drawn + [(*r, None) for r in rest], key=repr)


def resample_rows(hard):
    rng = random.Random(3)
    words = ["the", "of", "prime", "Number", "two", "maison", "ein", "haus", "été", "42"]
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    return rows + [(None, "the prime number two " * 8)] * 3 + [(100, "the prime number two " * 8)] * 2


@pytest.mark.parametrize("n, percent", [(1, 10), (1, 100), (2, 37), (3, 0)])
def test_resampling_is_brute_force(spark, hard, monkeypatch, n, percent):
    rows = resample_rows(hard)
    monkeypatch.setattr(resampling, "STEP", 64)
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id bigint, text string, score int, RANK string").repartition(5)
    target = spark.createDataFrame([(t,) for t in BENCH], "text string")
    got = sorted((tuple(r) for r in resampling.importance_resample(docs, target, percent=percent, ngrams=n).collect()), key=repr)
    assert got == brute_resample(rows, BENCH, percent, 20, n)


def test_counts_merge_over_many_partitions(spark):
    texts = spark.range(500).select(F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")).repartition(90)
    counts = resampling.bucket_counts(texts, buckets=97)
    want = Counter(zlib.crc32(w.encode()) % 97 for i in range(500) for w in ("word", str(i)))
    assert counts.tolist() == [want[b] for b in range(97)]


def test_resampling_of_empty_tables(spark, empty, hard):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.importance_resample(empty, target).count() == 0
    assert resampling.importance_resample(hard, target.limit(0)).count() == hard.count()
    with pytest.raises(ValueError):
        resampling.importance_resample(hard, target, ngrams=0)


def test_pieces_of_a_long_text_give_the_same_features(monkeypatch):
    text = "Some words, more Words; and 12 numbers " * 50
    whole = [np.sort(np.concatenate([h for _, h in resampling.features(text, n)])) for n in (1, 2, 3)]
    monkeypatch.setattr(resampling, "STEP", 5)
    assert all((np.sort(np.concatenate([h for _, h in resampling.features(text, n)])) == w).all() for n, w in zip((1, 2, 3), whole))
