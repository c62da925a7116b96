"""Packing, sharding, WARC and token files: exact round trips and laws."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, kd_shard, packing, token_store, tokens, warc

P = pytest.importorskip("public_tokenizers")
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


MARKS = ["<|endoftext|>", "<|EndOfText|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|StartOfText|>", "<|", "|>", "endoftext"]
PARTS = ["a", "b", "A", "J", "K", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "'S", "'ll", "'LL", "'", "1", "²", "½", "é", "É", "é", "J̌", "≠", "́", " ", "　", "!", "…", "İ", "Σ", "ΑΣ ", "\x1c", "\x1f", "\x85", "​", "﻿", "᠎", " ", " ", "ß", "ẞ", "中", "🙂", "\x00", "\v", "\f", " the", " and,", "don't", " word.", "Ÿ", "×", "÷", "ª", "µ", "`", "~", "{", "_", "ǅ", "ﬁ", "K", "Ω", "٣", "x,y.z", "...", ",.", *MARKS]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_the_librarys(path):
    from tokenizers import Tokenizer

    whole, ours = Tokenizer.from_file(path), tokens.Encoder(tokens.tokenizer_source(path))
    assert ours.kind != "whole"
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(6000)] + ["a <|EndOfText|> b", "", "x" * 5000]
    for i in range(0, len(texts), 300):
        some = texts[i : i + 300]
        for t, got, want in zip(some, ours.encode(some), whole.encode_batch(some, add_special_tokens=False), strict=True):
            assert got.tolist() == want.ids, repr(t)


@pytest.mark.parametrize("change", [lambda s: s["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": " a"}, "content": "b"}), lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"[^\s]+"), lambda s: s["added_tokens"][0].update(normalized=True), lambda s: s["model"].update(dropout=0.1), lambda s: s.update(pre_tokenizer={"type": "Whitespace"})])
def test_any_other_tokenizer_gets_whole_texts(change):
    import json

    spec = json.loads(tokens.tokenizer_source(WORD))
    change(spec)
    assert tokens.make_of(spec) == "whole"
    assert tokens.make_of(json.loads(tokens.tokenizer_source(BYTE))) == "space first"


def test_memory_of_pieces_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    enc = tokens.Encoder(tokens.tokenizer_source(BYTE))
    for i in range(300):
        enc.encode_one(f"word{i} other{i}, " * 2)
    assert all(len(p) <= 51 and len(p.older) <= 51 for p in (enc.bare, enc.spaced))


def check_packing(rows, window):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window


def test_packing_edges(hard, empty):
    rows = packing.pack_documents(hard, BYTE, window=64, keep_ids=True).collect()
    check_packing(rows, 64)
    enc = tokens.Encoder(tokens.tokenizer_source(BYTE))
    want = sorted((r.doc_id is None, r.doc_id or 0, [*enc.encode_one(r.text or "").tolist(), 0]) for r in hard.collect())
    per = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert zlib.crc32(r.ids) == r.ids_crc32
        per.setdefault((r.doc_id is None, r.doc_id or 0, r.start), []).append(np.frombuffer(r.ids, "<u4").tolist())
    total = sum(len(x[2]) for x in want)
    assert sum(r.length for r in rows) == total
    assert sorted(i for x in per.values() for p in x for i in p) == sorted(i for x in want for i in x[2])
    assert packing.pack_documents(empty, BYTE).count() == 0


def test_plan_uses_every_length_and_pads_little():
    rng = np.random.default_rng(4)
    hist = np.bincount(np.clip(rng.gamma(2, 150, 20_000).astype(int), 1, 1024), minlength=1025)
    chosen = packing.plan(hist, 1024)
    used = np.zeros(1025, int)
    for lengths, times in chosen:
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] += times
    assert (used == hist).all()
    room = sum(times for _, times in chosen) * 1024
    assert room - (hist * np.arange(1025)).sum() < 0.003 * room


def test_nnls_meets_a_histogram_it_can():
    hist = np.zeros(1025)
    hist[[300, 724, 200, 824]] = [50, 50, 30, 30]
    combos = packing.combinations_of(hist, 1024)
    x = packing.nnls(combos, hist, sweeps=500)
    left = hist.copy()
    for c, n in zip(combos, x):
        for k in c:
            left[k] -= n
    assert (x >= 0).all() and np.abs(left).sum() < 8


def shard_law(spark, docs, shards, slack):
    rows = kd_shard.kd_shard(docs, shards).collect()
    size = np.zeros(shards)
    slots = {}
    for r in rows:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(rows) == docs.count() and {r.law for r in rows} == {"bytes"}
    assert size.max() - size.min() <= slack * size.mean(), size
    return rows


def test_shards_are_even_and_groups_stay_together(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    big = docs.select(F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"), "doc_id", "text").select((F.col("doc_id") * 100 + F.col("k")).alias("doc_id"), F.concat("text", F.when(F.col("k") > 1, F.col("k").cast("string")).otherwise("")).alias("text"))
    rows = shard_law(spark, big, 8, 0.02)
    text = {r.doc_id: r.text for r in big.collect()}
    where = {}
    for r in rows:
        where.setdefault(text[r.doc_id], set()).add(r.shard)
        assert r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 1
    assert all(len(x) == 1 for x in where.values())


def test_a_group_larger_than_a_shard_is_split(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 500, "the same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    shard_law(spark, docs, 5, 0.05)


def test_large_groups_stay_whole_where_they_fit(spark):
    group = F.when(F.col("id") % 10 < 2, "one text of many rows").when(F.col("id") % 10 == 2, "another one text of many rows").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string")))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), group.alias("text"))
    rows = shard_law(spark, docs, 4, 0.01)
    for n in (22, 30):
        assert len({r.shard for r in rows if r.size == n}) == 1


def brute_tree(weights, coordinates, leaves):
    """Leaf of each point: the median of the widest dimension, by sorting."""
    out = {}
    root = [max(1, max(c[i] for c in coordinates) - min(c[i] for c in coordinates)) for i in range(len(coordinates[0]) - 1)]

    def split(points, first, k):
        if k == 1 or not points:
            out.update(dict.fromkeys(points, first))
            return
        widths = [(max(coordinates[p][i] for p in points) - min(coordinates[p][i] for p in points)) / w for i, w in enumerate(root)]
        axis = widths.index(max(widths))
        points = sorted(points, key=lambda p: (coordinates[p][axis], coordinates[p][-1]))
        goal, held, at = sum(weights[p] for p in points) * (k // 2) / k, 0, 0
        while at < len(points) and held + weights[points[at]] <= goal:
            held += weights[points[at]]
            at += 1
        if at < len(points) and held + weights[points[at]] - goal < goal - held:
            at += 1
        split(points[:at], first, k // 2)
        split(points[at:], first + k // 2, k - k // 2)

    split(list(range(len(weights))), 0, leaves)
    return out


@pytest.mark.parametrize("leaves", [2, 5, 8])
def test_medians_are_those_of_sorting(spark, leaves, monkeypatch):
    monkeypatch.setattr(kd_shard, "BIN_BITS", 3)  # many rounds
    rng = random.Random(leaves)
    rows = [(i, rng.randrange(1 << 32), rng.randrange(1, 50), 0, rng.randrange(1000), rng.choice([0, 7, 9, 1 << 20])) for i in range(300)]
    points = common.materialise(spark.createDataFrame(rows, "key bigint, tie bigint, weight bigint, node int, d0 bigint, d1 bigint"), "points")
    out, nodes = kd_shard.kd_tree(points, [], ["d0", "d1"], leaves, sum(r[2] for r in rows), 300, slack=0)
    got = {r.key: nodes[r.node].first for r in out.collect()}
    assert got == brute_tree([r[2] for r in rows], [(r[4], r[5], r[1]) for r in rows], leaves)


def test_groups_are_set_apart_whole_where_they_fit():
    g = [kd_shard.Group(i, 10, (i,), 0, n) for i, n in enumerate((30, 50, 20))]
    for goal, room, want in ((800, 900, [0]), (900, 400, [0, 1]), (450, 750, [0]), (850, 250, [0, 1])):
        left, right = kd_shard.set_apart(g, 0, goal, room)
        assert [x.key for x in left] == want and len(left + right) == 3
    left, right = kd_shard.set_apart(g[1:2], 0, 250, 250)  # fits neither side
    assert [(x.first, x.last) for x in left + right] == [(0, 25), (25, 50)]
    assert kd_shard.set_apart([], 0, 5, 5) == ([], [])
    left, right = kd_shard.set_apart([kd_shard.Group(1, 1, (0,), 0, 90)], 0, 50, 100)
    assert not left and len(right) == 1


def test_shard_edges(hard, empty):
    assert kd_shard.kd_shard(empty).count() == 0
    rows = kd_shard.kd_shard(hard, 3).collect()
    assert len(rows) == hard.count() and {r.shard for r in rows} <= {0, 1, 2}
    assert next(r for r in rows if r.doc_id == 4).size == 1
    assert kd_shard.kd_shard(hard, None, target_bytes=100_000).agg(F.max("shard")).first()[0] == 2


def test_gapless_ranks(spark):
    df = common.materialise(spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("w")), "t")
    for k in range(3):
        rows = common.gapless(df, ["k"], ["o"], "r", blocks=8).where(f"k = {k}").collect()
        assert sorted(r.r for r in rows) == list(range(len(rows)))
    got = sorted((r.s, r.w) for r in common.gapless(df, ["k"], ["o"], "s", weight="w", blocks=8).where("k = 1 and w > 0").collect())
    at = 0
    for s, w in got:
        assert s == at
        at += w


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [3, 3, 9, 1_000_000], list(range(700)), sorted(random.Random(1).choices(range(10**12), k=3000)), [0, 2**64 - 1], [2**64 - 1]])
def test_elias_fano(values):
    e = token_store.EliasFano.from_bytes(token_store.EliasFano.encode(np.array(values, np.uint64)).to_bytes())
    assert e.values().tolist() == values and [e.select(i) for i in range(len(values))] == values
    for i, j in [(0, 0), (0, 1), (1, 3), (7, 300), (255, 257), (len(values) - 1, len(values))]:
        if 0 <= i <= j <= len(values):
            assert e.values(i, j).tolist() == values[i:j]
    if len(values) == 3000:
        assert len(e.to_bytes()) < 3000 * 4.5  # 2 + log2(10^12 / 3000) bits a value
    with pytest.raises(IndexError):
        e.select(len(values))


def test_token_files_round_trip(spark, hard, empty):
    from tessera.llm.files import Folder

    out = token_store.write_tokens(hard, WORD, 1, shard_bytes=60_000, roll=20_000)
    enc = tokens.Encoder(tokens.tokenizer_source(WORD))
    want, at = [], 0
    for d, ids in sorted(((r.doc_id, [*enc.encode_one(r.text or "").tolist(), 1]) for r in hard.collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = [tuple(r) for r in token_store.read_tokens(spark, out, with_ids=True, window=500).orderBy("start").collect()]
    assert got == want
    names = [r.name for r in spark.read.parquet(f"{out}/manifest").orderBy("shard", "part").collect()]
    assert len(names) > 2
    found = []
    for n in names:  # random access through the select structures
        with Folder(f"{out}/files").read(n) as f:
            r = token_store.StoreReader(f)
            found += [(r.doc_id(i), r.ids(i).tolist()) for i in range(r.documents)]
    assert found == [(d, ids) for d, _, _, _, ids in want]
    assert token_store.read_tokens(spark, token_store.write_tokens(empty, WORD, 1)).count() == 0


def test_token_files_take_any_id(spark):
    rows = [(-(1 << 63), "first"), ((1 << 63) - 1, "a <|EndOfText|> b"), (0, None), (None, "x y"), (0, "same"), (0, "same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = token_store.read_tokens(spark, token_store.write_tokens(docs, WORD, 1), with_ids=True).orderBy("start").collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    want = sorted(((d, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for d, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.doc_id, r.ids) for r in got] == want


def test_ranges_hold_equal_weights(spark):
    rng = random.Random(6)
    ids = [rng.choice([i, i * 10**15, -i * 10**12, 5]) for i in range(4000)] + [-(1 << 63), (1 << 63) - 1, None]
    rows = [(i, 1 if i == 5 else rng.choice([1, 1, 40])) for i in ids]
    df = common.materialise(spark.createDataFrame(rows, "k bigint, w bigint"), "ranges")
    edges = common.range_edges(df, "k", "w", 10)
    assert edges == sorted(set(edges)) and len(edges) <= 9
    held = np.zeros(10)
    for k, w in rows:
        if k is not None:
            held[np.searchsorted(edges, k, side="left")] += w
    assert held.max() < 2 * held.sum() / 10
    assert common.range_edges(df.limit(0), "k", "w", 10) == [] == common.range_edges(df, "k", "w", 1)


def pages_of(hard):
    return hard.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})


def test_warc_round_trip(spark, hard, empty):
    pages = pages_of(hard)
    out = warc.write_warc(pages, shard_bytes=100_000, roll_bytes=600, revisit_bytes=50)
    rows = warc.read_warc(spark, out, with_payload=True).collect()
    data = {}
    for p in pages.collect():
        data.setdefault(p.page_id, (p.html or "").encode())
    for r in rows:
        assert r.payload_bytes == len(data[r.page_id]) and r.payload_digest == hashlib.sha1(data[r.page_id]).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else r.payload == data[r.page_id]
    kinds = sorted((r.page_id, r.record_type, r.refers_to) for r in rows if r.page_id in (1, 2, 4, 5))
    assert kinds == [(1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (4, "response", None), (5, "response", None)]
    manifest = spark.read.parquet(f"{out}/manifest")
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == pages.count()
    assert warc.read_warc(spark, warc.write_warc(pages_of(empty))).count() == 0


def test_warc_files_are_the_same_whatever_the_partitions(spark, hard):
    from tessera.llm.files import Folder

    seen = []
    for n in (1, 5):
        out = warc.write_warc(pages_of(hard).repartition(n), shard_bytes=100_000, roll_bytes=2000, revisit_bytes=50)
        files = {}
        for r in spark.read.parquet(f"{out}/manifest").collect():
            with Folder(f"{out}/files").read(r.name) as f:
                files[r.name] = f.read()
            assert hashlib.sha1(files[r.name]).hexdigest() == r.sha1 and len(files[r.name]) == r.bytes
            assert gzip.decompress(files[r.name]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        seen.append(files)
    assert seen[0] == seen[1]


def test_a_damaged_record_is_noticed(tmp_path):
    good = warc.page_record(1, 0, "u", b"payload", None)
    assert next(warc.records_of(open_bytes(good)))[1].endswith(b"payload")
    with pytest.raises(ValueError):
        list(warc.records_of(open_bytes(good[:-10])))


def open_bytes(data):
    import io

    return io.BytesIO(data)


def test_groups_cover_a_batch_whatever_its_texts(monkeypatch):
    import pyarrow as pa

    texts = ["", "one two", " " * 9, "x" * 500 + "\nA é Ünï", "", "a\n b ", "tail " * 99, "Ａ b c Hello"]
    for path in (WORD, BYTE):
        enc = tokens.Encoder(tokens.tokenizer_source(path))
        want = [x.ids for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        for group, span in ((1, 1), (64, 3), (1 << 22, 1 << 19)):
            monkeypatch.setattr(tokens, "GROUP", group)
            monkeypatch.setattr(tokens, "SPAN", span)
            batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"]).slice(1)
            got = [(d, ids.tolist()) for part, found in enc.groups(batch, 1) for d, ids in zip(part.column(0).to_pylist(), found, strict=True)]
            assert got == list(enumerate(want))[1:]


def test_a_worker_keeps_one_thing():
    from tessera.llm import common

    first = common.resident("a", list)
    assert common.resident("a", list) is first
    second = common.resident("b", list)
    assert common.resident("a", list) is not first and common.resident("b", list) is not second
    common.alone()
    assert not common._resident
