"""Small cases with known results."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import tokens as K
from tessera.operators import chat, logits, metrics, pack
from tessera.operators.ordered import running_minima, slices, spans, trailing
from tessera.sources import discovery, readers, sinks, synthetic, token_source


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs])


def render(spark, **given):
    types = {"conversations": "array<struct<from:string,value:string>>", "messages": "array<struct<role:string,content:string>>"}
    names = ["conversations", "messages", "instruction", "input", "output", "prompt", "response"]
    schema = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
    return spark.createDataFrame([tuple(given.get(n) for n in names)], schema).select(chat.dispatch().alias("v")).first().v


def test_chat_schemas(spark):
    assert render(spark, conversations=[("human", " Hi "), ("gpt", "Hello")]) == "<|user|>\nHi\n<|assistant|>\nHello\n"
    assert render(spark, messages=[("system", "S"), ("user", "  "), ("model", "A")]) == "<|system|>\nS\n<|assistant|>\nA\n"
    assert render(spark, conversations=[], prompt="p", response="r") is None
    assert render(spark, instruction="Add", input=" 1,2 ", output="3") == "<|user|>\nAdd\n\nInput:\n1,2\n<|assistant|>\n3\n"
    assert render(spark, prompt="p", response="r") == "<|user|>\np\n<|assistant|>\nr\n"
    assert value(spark, X.normalize_role(F.lit("tool"))) == "user"


def test_tool_transcripts(spark):
    def out(s):
        return value(spark, chat.tool_transcript(F.lit(s)))

    assert out("SYSTEM: s USER: u ASSISTANT: a <|endoftext|>") == "<|system|>\ns \n<|user|>\nu \n<|assistant|>\na\n"
    assert out('{"name": "web_search", "arguments": "q"}') == '<call:search>{"name": "web_search", "args": "q"}</call>\n'
    assert out('{"name": "f", "arguments": {"a": 1}}') == '{"name": "f", "arguments": {"a": 1}}\n'
    assert out("FUNCTION RESPONSE: 42\nUSER: thanks") == "<response>42\n</response>\n<|user|>\nthanks\n"


@pytest.mark.parametrize("text, want", [("a -12 b 7", 7), ("3-4", -4), ("none", None), ("", None)])
def test_last_int(spark, text, want):
    assert value(spark, X.last_int(F.lit(text))) == want


def test_strip_is_unicode(spark):
    odd = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    assert value(spark, X.strip(F.lit(odd + "x y" + odd))) == "x y" == (odd + "x y" + odd).strip()
    assert value(spark, X.strip(F.lit(None).cast("string"))) == ""


def test_first_truthy_stops_at_white_space(spark):
    assert value(spark, X.first_truthy(F.lit("  "), F.lit("t"))) == ""
    assert value(spark, X.first_truthy(F.lit(""), F.lit(None).cast("string"), F.lit("c"))) == "c"


def test_end_ids(spark):
    ids = spark.createDataFrame([([5, 6],), ([5, 9],), ([],)], "i array<int>").select(K.append_eos(F.col("i"), 9).alias("v")).collect()
    assert [r.v for r in ids] == [[5, 6, 9], [5, 9], None]
    assert value(spark, K.truncate_eos(arr(5, 6, 9), 2, 9)) == [5, 9]


def test_split_threshold(spark):
    share = spark.range(20_000).select(X.hash_split(F.col("id").cast("string"), 0.29).alias("s")).where("s = 'val'")
    below = spark.range(20_000).where(X.bucket10k(F.col("id").cast("string")) < 28)
    assert share.count() == below.count()


def test_blocks_pairs_and_shards(spark, tmp_path):
    docs = spark.createDataFrame([(0, [1, 2, 0]), (1, [3, 4, 5, 0]), (2, [6, 0])], "d bigint, ids array<int>")
    blocks = pack.pack_blocks(docs, "d", "ids", 4)
    assert sorted(tuple(r.tokens) for r in blocks.collect()) == [(1, 2, 0, 3), (4, 5, 0, 6)]
    pairs = pack.next_token_pairs(blocks.where("block_id = 0")).orderBy("pos").collect()
    assert [(r.x, r.y) for r in pairs] == [(1, 2), (2, 0), (0, 3)]
    rows = token_source.write_tokens(docs, "d", "ids", f"{tmp_path}/s", 4).orderBy("shard_id").collect()
    assert [(r.name, r.n_tokens) for r in rows] == [("train-00000.bin", 4), ("train-00001.bin", 4), ("train-00002.bin", 1)]
    back = [x for r in readers.token_shards(spark, f"{tmp_path}/s", ids_a_row=3).orderBy("path", "part").collect() for x in r.tokens]
    assert back == [1, 2, 0, 3, 4, 5, 0, 6, 0]
    token_source.write_tokens(docs, "d", "ids", f"{tmp_path}/f", 4, drop_tail=True).collect()
    assert discovery.shards_below(spark, f"{tmp_path}/f").count() == 2
    assert [r.s for r in readers.chunks(spark.createDataFrame([(list(range(10)),)], "t array<int>"), F.col("t"), 4).select(F.size("chunk").alias("s")).collect()] == [4, 4, 2]


def test_heads_of_shards(spark, tmp_path):
    text = "häuser und höfe"
    ids = list(text.encode())
    token_source.write_tokens(spark.createDataFrame([(0, [*ids, 256, *ids])], "d bigint, ids array<int>"), "d", "ids", f"{tmp_path}/s", len(ids) + 4).collect()
    rows = readers.token_shards(spark, f"{tmp_path}/s", ids_a_row=len(ids) + 1, rows=1).orderBy("path").select(F.size("tokens").alias("n"), K.byte_text("tokens").alias("t")).collect()
    assert rows[0].t == text and rows[0].n == len(ids) + 1 and rows[1].n == len(ids) - 3


def test_a_stream_goes_on_from_its_folder(spark, tmp_path):
    from tessera.streaming import dedup as streams

    def add(rows, name):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")

    add([(1, "a"), (2, "b"), (3, "a ")], "one")
    first = streams.stream_dedup(spark, f"{tmp_path}", f"{tmp_path}/d").count()
    taken = {r.doc_id for r in streams.stream_budget(spark, f"{tmp_path}", f"{tmp_path}/b", 7).collect()}
    add([(4, "b"), (5, "c"), (6, "d")], "two")
    assert (first, streams.stream_dedup(spark, f"{tmp_path}", f"{tmp_path}/d").count()) == (2, 4)
    assert taken == {1, 2, 3} == {r.doc_id for r in streams.stream_budget(spark, f"{tmp_path}", f"{tmp_path}/b", 7).collect()}
    again = streams.stream_totals(spark, f"{tmp_path}", f"{tmp_path}/t").agg(F.sum("docs")).first()[0]
    assert again == 6 == streams.stream_totals(spark, f"{tmp_path}", f"{tmp_path}/t").agg(F.sum("docs")).first()[0]


def test_spans_and_slices(spark):
    rng = random.Random(1)
    sizes = [rng.randrange(0, 9) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(sizes)), "d bigint, n bigint")
    got = spans(df, "d", "n").orderBy("d").collect()
    at = 0
    for r, n in zip(got, sizes):
        assert (r.start, r.end) == (at, at + n)
        at += n
    per = {}
    for r in slices(spans(df, "d", "n"), 7, "k").collect():
        per[r.k] = per.get(r.k, 0) + r.hi - r.lo
    assert per == {k: min(7, at - 7 * k) for k in range(-(-at // 7))}


def test_logits(spark):
    assert value(spark, logits.top_k(arr(1.0, 3.0, 3.0, 2.0), 1)) == [None, 3.0, 3.0, None]
    assert value(spark, logits.top_p(F.transform(arr(0.5, 0.3, 0.2), lambda v: F.log(v)), 0.6))[2] is None
    assert value(spark, logits.repetition_penalty(arr(2.0, -2.0, 4.0), arr(0, 1), 2.0)) == [1, -4, 4]
    assert value(spark, logits.argmax(arr(1.0, 3.0, 3.0))) == 1
    p = np.exp([1.0, 2.0, 0.5]) / np.exp([1.0, 2.0, 0.5]).sum()
    assert np.allclose(value(spark, logits.softmax(arr(1.0, 2.0, 0.5))), p)
    for u, want in ((0.0, 0), (p[0] + 0.01, 1), (0.999, 2)):
        assert value(spark, logits.multinomial(arr(1.0, 2.0, 0.5), F.lit(float(u)))) == want
    turned = value(spark, logits.rope(arr(1.0, 2.0, 3.0, 4.0), F.lit(0)))
    assert turned == [1, 2, 3, 4]


def test_schedule(spark):
    lr = {r.step: r.lr for r in metrics.schedule(spark, 1e-3, 1e-4, 100, 1000).where("schedule = 'cosine'").collect()}
    assert [round(lr[s], 12) for s in (0, 50, 100, 1000)] == [1e-4, 5.5e-4, 1e-3, 1e-4]


def test_kth_values(spark):
    r = metrics.error_distribution(spark.range(1, 1001).select(F.col("id").cast("double").alias("v")), "v").first()
    assert (r.p99, r.p999, r.max) == (990, 999, 1000)


def test_metric_falls_back(spark):
    b = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", 3.0)], "bucket string, loss double")
    assert metrics.metric_or_average(b, "bucket", "a").first().value == 1
    assert metrics.metric_or_average(b.where("bucket <> 'b'"), "bucket", "zz").first().value == 2


def test_history(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x" * 100), (1, 1, "assistant", "y" * 30), (2, 0, "user", "z" * 500)], "conv_id bigint, turn bigint, role string, text string")
    assert sorted((r.conv_id, r.turn) for r in chat.truncate_history(turns, 128, 0).collect()) == [(1, 1), (2, 0)]


def test_sources(spark, tmp_path):
    assert readers.source_spec("a=/x:y:0.5") == ("a", "/x:y", 0.5)
    with pytest.raises(ValueError):
        readers.source_spec("a=/x")
    for part in ("train", "val/one", "val/two/deep", "val/none"):
        (tmp_path / part).mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        discovery.validate_sources(spark, [("a", str(tmp_path), 1.0)])
    for part in ("train", "val/one", "val/two/deep"):
        np.arange(5, dtype="<u2").tofile(tmp_path / part / "x.bin")
    discovery.validate_sources(spark, [("a", str(tmp_path), 1.0)])
    assert list(discovery.val_buckets(spark, f"{tmp_path}/val")) == ["one", "two"]
    assert list(discovery.val_buckets(spark, f"{tmp_path}/train")) == ["val"]
    assert discovery.val_buckets(spark, f"{tmp_path}/nowhere") == {"val": f"{tmp_path}/nowhere"}
    (tmp_path / "dpo").mkdir()
    (tmp_path / "dpo/p.npz").write_bytes(b"1")
    assert [discovery.copy_extra(spark, [("a", str(tmp_path))], f"{tmp_path}/out") for _ in range(2)] == [1, 0]


def test_json_lines(spark, tmp_path):
    lines = ['{"instruction": "i", "input": "", "output": "o"}', "", "not json", "[1]", '{"instruction": " ", "output": "o"}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    assert [tuple(r) for r in readers.json_lines(spark, f"{tmp_path}/x.jsonl").collect()] == [("i", "", "o")]
    (tmp_path / "chat.json").write_text(json.dumps({"system": "s", "turns": [{"user": "u", "assistant": "a"}]}))
    assert [tuple(r) for r in readers.saved_chat(spark, f"{tmp_path}/chat.json").collect()] == [("s", 0, "u", "a")]
    sinks.report(spark.createDataFrame([("arithmetic", 2, 0.5)], "task string, n int, acc double"), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").first().acc == 0.5


def test_prompts(spark):
    df = spark.createDataFrame([("one\n---\n\n  two\nlines\n --- \n---\n",)], "value string")
    assert [r.prompt for r in readers.line_delimited(df, "value").orderBy("prompt_no").collect()] == ["one", "two\nlines"]


def test_episodes_hold_their_answers(spark):
    for r in synthetic.kv_episodes(spark, 5, 1000, 4000, seed=3).collect():
        assert synthetic.kv_answer(r.prompt) == int(r.answer)
        assert r.prompt.split("LOG BEGIN\n")[1].split("\nLOG END")[0].count("\n") % 128 == 127
    for r in synthetic.needles(spark, 3, 600).collect():
        assert r.answer in r.prompt and len(r.prompt.encode()) >= 536


def test_state_keys(spark):
    assert value(spark, X.state_key(F.lit("_orig_mod._orig_mod.w"))) == "_orig_mod.w"
    assert value(spark, X.kept_key(F.lit("a.inv_freq"), ["inv_freq"])) is False
    assert value(spark, X.kept_key(F.lit("a.weight"), ["inv_freq"])) is True


def test_splits_of_bytes_and_of_decoded_ids(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    df = spark.range(300).select(F.concat(F.lit("text number "), F.col("id").cast("string")).alias("t"))
    rows = df.select(K.blake2b_split(F.col("t")).alias("a"), K.blake2b_split(F.col("t").cast("binary")).alias("b"), K.decoded_split(K.library_tokens(path)("t"), path).alias("c")).collect()
    assert all(r.a == r.b == r.c for r in rows) and {r.a for r in rows} == {"train", "val"}


def test_trailing_and_minima_across_blocks(spark):
    rng = random.Random(8)
    xs = [rng.randrange(1000) for _ in range(300)]
    df = spark.createDataFrame([(i * 7, x, "s") for i, x in enumerate(xs)], "o bigint, x bigint, k string")
    got = {r.o // 7: r.m for r in trailing(df, "o", 10, "m", lambda: F.sum("x"), ("k",), block=25).collect()}
    assert got == {i: sum(xs[max(0, i - 9) : i + 1]) for i in range(300)}
    low = {r.o // 7: r.m for r in running_minima(df, "o", "x", "m", ranges=9).collect()}
    assert low == {i: min(xs[:i]) if i else None for i in range(300)}


def test_kth_value_narrows_down(spark):
    rng = random.Random(9)
    xs = [rng.choice([0.5, 0.5, rng.random(), rng.gauss(0, 100)]) for _ in range(700)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    for k in (1, 2, 350, 400, 699, 700):
        assert metrics.kth_value(df, "x", k, bins=8, few=5) == sorted(xs)[k - 1]
    assert metrics.kth_value(df, "x", 701) is None and metrics.kth_value(df.limit(0), "x", 1) is None


def test_many_files_are_listed_and_copied(spark, tmp_path):
    (tmp_path / "a/dpo").mkdir(parents=True)
    (tmp_path / "b/dpo/deep").mkdir(parents=True)
    for i in range(1500):
        (tmp_path / f"a/dpo/{i:05d}.npz").write_bytes(b"%d" % i)
    for name in ("b/dpo/x.npz", "b/dpo/deep/y.npz", "b/dpo/z.txt"):
        (tmp_path / name).write_bytes(b"b")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/a_00007.npz").write_bytes(b"kept")
    sources = [("a", f"file://{tmp_path}/a"), ("b", f"{tmp_path}/b"), ("c", f"{tmp_path}/none")]
    assert [discovery.copy_extra(spark, sources, f"{tmp_path}/out") for _ in range(2)] == [1500, 0]
    assert (tmp_path / "out/a_00007.npz").read_bytes() == b"kept" and (tmp_path / "out/a_01499.npz").read_bytes() == b"1499"
    files = discovery.listing(spark, f"{tmp_path}/out")
    assert files.count() == 1501 and files.where("name = 'b_x.npz'").first().length == 1
    assert discovery.listing(spark, f"{tmp_path}/b", "*.npz").orderBy("name").first().name == "dpo/deep/y.npz"


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_library_ids_and_texts_equal_the_library(spark, file):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, own = P.path(file), Tokenizer.from_file(P.path(file))
    texts = ["", None, "a\n\n b", "naïve 漢字  x", "\U0001f600 tab\t", *[" ".join(f"w{i * j}" for j in range(i)) for i in range(40)], "it's <|endoftext|> here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("ids", K.library_tokens(path)("t"))
    for r in df.select("i", "ids", K.library_texts(path)("ids").alias("t")).collect():
        want = own.encode(texts[r.i] or "", add_special_tokens=False).ids
        assert r.ids == want and r.t == own.decode(want, skip_special_tokens=False)
    # characters that are cut, and ids that are none
    rng = random.Random(6)
    lists = [[rng.randrange(own.get_vocab_size() + 9) for _ in range(rng.randrange(30))] for _ in range(300)] + [None, list(range(own.get_vocab_size()))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<int>").select("i", K.library_texts(path)("ids").alias("t"))
    assert all(r.t == own.decode(lists[r.i] or [], skip_special_tokens=False) for r in df.collect())


def test_batches_of_token_functions_are_bounded(spark, tmp_path):
    """Long rows come in small batches, and the byte tokens of a text are made once."""
    df = spark.range(64, numPartitions=1).select("id", F.repeat(F.lit("abcdefgh"), 1 << 16).alias("t"))
    rows = K.arrow_function(lambda t: pa.array([len(t)] * len(t), pa.int32()), "int")(F.col("t"))
    assert df.select(rows.alias("n")).agg(F.max("n")).first()[0] <= 9
    assert spark.conf.get(K.BATCH_BYTES) == "4m"
    cut = readers.chunks(df.select("id", K.byte_tokens("t").alias("ids")), F.col("ids"), 1 << 18).select("id", "chunk_no")
    assert cut.count() == 128
    assert cut._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    empty = spark.createDataFrame([(1, []), (2, None), (3, [5])], "id int, ids array<int>")
    assert [(r.id, r.chunk_no, r.chunk) for r in readers.chunks(empty, F.col("ids"), 4).collect()] == [(3, 0, [5])]
