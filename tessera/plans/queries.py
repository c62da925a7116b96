"""The query catalogue: each entry applies an operator to the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import tokens as K
from tessera.operators import chat, dedup, logits, metrics, mix, pack, split
from tessera.operators.cursor import Cursor, ahead
from tessera.operators.ordered import ranked, slices, spans
from tessera.plans import builds
from tessera.sources import readers, sinks, synthetic, token_source
from tessera.sources.readers import table
from tessera.tables import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

WEIGHTS = {"en": 5, "fr": 3, "de": 2, "es": 1}
BLOCK = 513


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def sized(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "lang", "source", X.n_tokens("text").alias("n"), X.hash_split("text", 2.0).alias("side"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "lang", X.n_tokens("text").alias("n"), F.array_append(K.byte_tokens("text"), F.lit(X.EOS)).alias("ids"))


# ------------------------------------------------------------------ sources


@query
def scan_documents(spark, d):
    return docs(spark, d).select("doc_id", "lang", "source", "n_chars")


@query
def source_text_clean(spark, d):
    return docs(spark, d).select(F.col("lang").alias("bucket"), "doc_id", X.strip("text").alias("text")).where("text <> ''")


@query
def concat_configs(spark, d):
    """All of one source, then all of the next; rows of no source come first."""
    return ranked(docs(spark, d).select("source", "doc_id"), ("source", "doc_id"), "out_pos").select("out_pos", "doc_id")


@query
def paired_prompt(spark, d):
    both = docs(spark, d).select("doc_id", X.strip("text").alias("article")).join(table(spark, d, "benchmark").select("item_id", X.strip("text").alias("abstract")), F.col("item_id") == F.col("doc_id"))
    # Fixed value: the wording of the prompt
    user = F.concat(F.lit("Summarize the following paper into a concise abstract.\n\n<paper>\n"), F.col("article"), F.lit("\n</paper>\n"))
    return both.where("article <> '' and abstract <> ''").select(F.col("doc_id").alias("id"), F.concat(F.lit("<|user|>\n"), user, F.lit("\n<|assistant|>\n"), F.col("abstract"), F.lit("\n")).alias("prompt"))


@query
def jsonl_parse(spark, d):
    return table(spark, d, "events").select("event_id", readers.parsed_json(F.col("props"), "k bigint")["k"].alias("k")).where("k is not null")


@query
def repeat_source(spark, d):
    return mix.repeat(table(spark, d, "benchmark").select("item_id"), "item_id", 3)


@query
def split_substring_delim(spark, d):
    return readers.pieces(docs(spark, d).select("doc_id", "text"), "text", "\n").drop("text")


@query
def split_min_len(spark, d):
    return readers.pieces(docs(spark, d).select("doc_id", "text"), "text", "\n", 50).drop("text")


@query
def split_line_delim(spark, d):
    """Sentences, set apart by lines that hold nothing but a delimiter."""
    marked = F.replace(F.col("text"), F.lit(". "), F.lit("\n --- \n"))
    return readers.line_delimited(docs(spark, d).select("doc_id", marked.alias("value")), "value").drop("value")


@query
def chunk_tokens(spark, d):
    return readers.chunks(docs(spark, d).select("doc_id", K.byte_tokens("text").alias("t")), F.col("t"), 1024).select("doc_id", "chunk_no", F.size("chunk").cast("bigint").alias("n_tokens"))


@query
def synth_kv_episodes(spark, d):
    """An episode for each fifty documents or part of them."""
    return synthetic.kv_episodes(spark, -(-docs(spark, d).count() // 50), 2000, 6000)


@query
def needle_items(spark, d):
    """A prompt for each fifty documents or part of them."""
    return synthetic.needles(spark, -(-docs(spark, d).count() // 50), 2000)


@query
def arith_items(spark, d):
    """An item for each document."""
    return synthetic.arithmetic(spark, docs(spark, d).count())


# -------------------------------------------------------------------- sinks


@query
def shard_manifest(spark, d):
    return sinks.shard_manifest(sized(spark, d), "doc_id", "n", 100_000)


def _scratch(spark: SparkSession) -> str:
    return scratch(spark, "query")


def _shards(spark: SparkSession, d: str, **options) -> tuple[str, DataFrame]:
    """The folder of the documents' token shards, and its manifest."""
    out = _scratch(spark)
    return out, token_source.write_tokens(tokens(spark, d), "doc_id", "ids", out, 100_000, n="n", **options)


@query
def shard_manifest_drop_tail(spark, d):
    """What a writer that drops the last, short shard has written."""
    _, manifest = _shards(spark, d, drop_tail=True)
    return manifest.select("shard_id", "n_tokens", (F.col("shard_id") * 100_000).alias("first_pos"))


@query
def bin_scan(spark, d):
    """Shards written, read back in pieces of bounded size, and counted."""
    t = token_source.read_tokens(spark, _shards(spark, d)[0], ids_a_row=30_000)
    return t.groupBy("path").agg(F.sum(F.size("tokens")).alias("n_tokens"), F.sum(K.total(F.col("tokens"))).alias("token_sum"))


@query
def shard_head(spark, d):
    """The first 500 ids of each shard and their text."""
    t = readers.token_shards(spark, _shards(spark, d)[0], ids_a_row=500, rows=1)
    own = F.regexp_extract("path", "([^/]+)$", 1).alias("path")
    return t.select(own, F.size("tokens").cast("bigint").alias("n_tokens"), K.total(F.col("tokens")).alias("token_sum"), F.length(K.byte_text("tokens")).cast("bigint").alias("n_chars"))


@query
def corpus_build(spark, d):
    """One call writes the shards of train and of each language's val and commits them; the
    version is read back."""
    root = _scratch(spark)
    own = docs(spark, d).select("doc_id", "lang", "text").join(tokens(spark, d).select("doc_id", "n", "ids"), "doc_id")
    builds.build(own, root, builds.Plan(600_000, 8_000, 50_000), "doc_id", "lang", "text", "ids", "n")
    _, t = builds.built(spark, root)
    target = F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("target")
    return t.groupBy(target).agg(F.countDistinct("path").alias("shards"), F.sum(F.size("tokens")).alias("n_tokens"), F.sum(K.total(F.col("tokens"))).alias("token_sum"))


@query
def jsonl_append(spark, d):
    """Rows appended in two goes to one folder of JSON lines, read back."""
    out, rows = _scratch(spark), docs(spark, d).select("doc_id", "lang")
    for part in (0, 1):
        sinks.append_lines(rows.where(F.col("doc_id") % 2 == part), out)
    return spark.read.schema("doc_id bigint, lang string").json(out)


@query
def retention_top3(spark, d):
    return sinks.newest(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query
def eval_report(spark, d):
    labels = table(spark, d, "labels")
    long = labels.select(F.explode(F.array(F.struct(F.lit("quality").alias("task"), F.col("quality").alias("ok")), F.struct(F.lit("toxic").alias("task"), F.col("toxic").alias("ok")))).alias("t")).select("t.*")
    return long.groupBy("task").agg(F.count("ok").alias("n"), F.round(F.avg("ok"), 6).alias("acc"))


# ------------------------------------------------------- projections, filters

PAD = "   \n\t"


@query
def strip_text(spark, d):
    padded = F.concat(F.lit(PAD), F.col("text"), F.lit(PAD))
    return docs(spark, d).select("doc_id", X.strip(padded).alias("text")).withColumn("n", F.length("text").cast("bigint"))


@query
def nonempty_unstripped(spark, d):
    """White space counts as a text here; null and empty ones don't."""
    c = docs(spark, d).select("doc_id", F.expr("case doc_id % 4 when 0 then '' when 1 then ' ' when 2 then text end").alias("text"))
    return c.where(X.nonempty("text")).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query
def filter_lang_ci(spark, d):
    given = F.concat(F.lit(" "), F.upper("lang"), F.lit(" "))
    return docs(spark, d).where(X.member_ci(given, ["EN", "de "])).select("doc_id", "lang")


@query
def filter_lang_any(spark, d):
    """No names given: every row stays."""
    return docs(spark, d).where(X.member_ci(F.col("lang"), [])).select("doc_id", "lang")


@query
def filter_lang_counts(spark, d):
    kept = F.col("lang").isin("en", "fr")
    return docs(spark, d).agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("skipped"))


@query
def truncate_chars(spark, d):
    return docs(spark, d).select("doc_id", X.truncate("text", 200).alias("text"))


@query
def first_truthy(spark, d):
    c = docs(spark, d).select("doc_id", F.expr("case doc_id % 4 when 0 then '' when 1 then '  ' when 2 then text end").alias("content"), F.expr("case when doc_id % 3 = 0 then text end").alias("t"), F.concat(F.lit("code "), F.col("doc_id").cast("string")).alias("code"))
    return c.select("doc_id", X.first_truthy("content", "t", "code").alias("picked")).where("picked <> ''")


@query
def normalize_role(spark, d):
    raw = F.expr("case role when 'user' then element_at(array('human', ' User ', 'tool'), cast(turn % 3 as int) + 1) when 'assistant' then element_at(array('gpt', 'MODEL', 'assistant'), cast(turn % 3 as int) + 1) else 'System' end")
    return table(spark, d, "conversations").select("conv_id", "turn", X.normalize_role(raw).alias("role"))


@query
def append_eos(spark, d):
    ids = K.append_eos(K.append_eos(K.byte_tokens("text")))  # the second time it is there
    return docs(spark, d).select("doc_id", ids.alias("ids")).where("ids is not null").select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.element_at("ids", -1).alias("last"))


@query
def token_len_filter(spark, d):
    return sized(spark, d).where("n >= 32").select("doc_id", F.col("n").alias("n_tokens"))


@query
def token_truncate_eos(spark, d):
    t = tokens(spark, d).select("doc_id", K.truncate_eos(F.col("ids"), 2048).alias("ids"))
    return t.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.element_at("ids", -1).alias("last"), K.total(F.col("ids")).alias("token_sum"))


STOPS = ["the. The", "\nIn ", "###", " und "]


@query
def stop_match(spark, d):
    return docs(spark, d).select("doc_id", X.stop_hit("text", STOPS).alias("hit"))


# -------------------------------------------------------------------- joins


@query
def lang_semi_join(spark, d):
    langs = spark.createDataFrame([("en",), ("es",)], "lang string")
    return docs(spark, d).join(F.broadcast(langs), "lang", "left_semi").select("doc_id")


@query
def incremental_anti_join(spark, d):
    own = docs(spark, d).select("doc_id", "text")
    half = own.agg(F.max("doc_id")).first()[0] // 2
    return dedup.new_rows(own.where(F.col("doc_id") > half), own.where(F.col("doc_id") <= half)).select("doc_id")


@query
def block_doc_map(spark, d):
    return slices(spans(sized(spark, d), "doc_id", "n"), BLOCK, "block_id").select("block_id", "doc_id", (F.col("hi") - F.col("lo")).alias("n_tokens_in_block"))


# ------------------------------------------------------ dedup, split, budgets


@query
def hash_split(spark, d):
    return sized(spark, d).select("doc_id", F.col("side").alias("split"))


@query
def hash_split_blake2b(spark, d):
    return docs(spark, d).select("doc_id", K.blake2b_split("text").alias("split"))


@query
def dedup_exact(spark, d):
    return dedup.keep_first(docs(spark, d), "doc_id")


@query
def dedup_bounded(spark, d):
    return dedup.keep_first_bounded(docs(spark, d), "doc_id", 300)


@query
def saturating_split(spark, d):
    return split.saturating_split(sized(spark, d), "doc_id", "n", "side", 600_000, 40_000).select("doc_id", "split")


@query
def bucketed_saturating_split(spark, d):
    return split.bucketed_saturating_split(sized(spark, d), "doc_id", "n", "side", "lang", 600_000, 8_000).select("doc_id", "lang", "split")


@query
def budget_prefix(spark, d):
    return split.budget_prefix(sized(spark, d), "doc_id", "n", 500_000).select("doc_id", "n", "running")


@query
def shard_budget(spark, d):
    """A budget that only counts tokens of shards already full."""
    return split.budget_by_shard(sized(spark, d), "doc_id", "n", 450_000, 100_000).select("doc_id", "n", "running")


@query
def mix_report(spark, d):
    weights = spark.createDataFrame([(k, w) for k, w in mix.normalised({k: float(w) for k, w in WEIGHTS.items()}).items()], "source string, weight_norm double")
    have = sized(spark, d).groupBy(F.col("lang").alias("source")).agg(F.sum("n").alias("tokens"))
    return weights.join(have, "source").select("source", F.round("weight_norm", 9).alias("weight_norm"), "tokens")


@query
def weighted_interleave(spark, d):
    return mix.interleave(docs(spark, d).select(F.col("lang").alias("source"), "doc_id"), "source", "doc_id", WEIGHTS).select("out_pos", "source", "doc_id")


@query
def interleave_chunks(spark, d):
    n = F.octet_length("text")
    c = docs(spark, d).where(n > 0).select(F.col("lang").alias("source"), "doc_id", F.explode(F.sequence(F.lit(0), F.expr("(octet_length(text) - 1) div 1024").cast("int"))).alias("chunk_no"))
    return mix.interleave(c, "source", ("doc_id", "chunk_no"), WEIGHTS).select("out_pos", "source", "doc_id", "chunk_no")


@query
def interleave_first_exhausted(spark, d):
    return mix.interleave(docs(spark, d).select(F.col("lang").alias("source"), "doc_id"), "source", "doc_id", WEIGHTS, first_exhausted=True).select("out_pos", "source", "doc_id")


@query
def random_interleave(spark, d):
    """Each next pick a draw in proportion to the weights, by arrival times."""
    return mix.random_interleave(docs(spark, d).select(F.col("lang").alias("source"), "doc_id"), "source", "doc_id", WEIGHTS, seed=5).select("out_pos", "source", "doc_id")


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts of some languages, chunks of 1024 byte tokens of the others."""
    n = F.octet_length("text")
    unit = F.when(F.col("lang").isin("en", "fr"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.expr("(octet_length(text) - 1) div 1024").cast("int")))
    units = docs(spark, d).where(n > 0).select(F.col("lang").alias("source"), "doc_id", F.explode(unit).alias("chunk_no"), n.alias("n"))
    size = F.when(F.col("source").isin("en", "fr"), F.col("n")).otherwise(F.least(F.lit(1024), F.col("n") - 1024 * F.col("chunk_no")))
    return units.withColumn("n_tokens", size.cast("bigint"))


@query
def random_mixed_units(spark, d):
    """Texts and chunks, each next pick a draw in proportion to the weights."""
    return mix.random_interleave(_units(spark, d), "source", ("doc_id", "chunk_no"), WEIGHTS, seed=5).select("out_pos", "source", "doc_id", "chunk_no", "n_tokens")


@query
def interleave_mixed_units(spark, d):
    """The same by fixed strides."""
    return mix.interleave(_units(spark, d), "source", ("doc_id", "chunk_no"), WEIGHTS).select("out_pos", "source", "doc_id", "chunk_no", "n_tokens")


@query
def split_driver(spark, d):
    """Both splits mixed from all languages up to their targets, val by a seed of its own."""
    own = sized(spark, d).select("lang", "doc_id", "n", "side")
    tables = {k: {s: own.where((F.col("lang") == k) & (F.col("side") == s)).select("doc_id", "n") for s in ("train", "val")} for k in WEIGHTS}
    out = mix.mixed_splits(tables, "doc_id", {k: float(w) for k, w in WEIGHTS.items()}, 5, {"train": 400_000, "val": 20_000}, "n")
    rows = [t.select(F.lit(s).alias("split"), "source", "doc_id", "running") for s, t in out.items()]
    return rows[0].unionByName(rows[1])


@query
def normalize_weights(spark, d):
    """Each source's share of the documents."""
    return mix.normalised_column(docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("w")), "w").withColumn("w", F.round("w", 9))


# ------------------------------------------------------------------- tokens


@query
def tokenize_bytes(spark, d):
    return tokens(spark, d).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), K.total(F.col("ids")).alias("token_sum"))


@query
def tokenize_bpe(spark, d):
    """Ids of a public byte-level vocabulary, whose path the package names."""
    import public_tokenizers

    return docs(spark, d).select("doc_id", K.library_tokens(public_tokenizers.path("byte_bpe_50k.json"))("text").alias("ids")).select("doc_id", F.size("ids").alias("n_tokens"), K.total(F.col("ids")).alias("token_sum"))


@query
def detokenize_bpe(spark, d):
    """Texts of the ids, equal to what was encoded."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return docs(spark, d).select("doc_id", K.library_texts(path)(K.library_tokens(path)("text")).alias("text"))


@query
def pretoken_counts(spark, d):
    words = docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"( ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+)"), F.lit(1))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


@query
def bpe_pair_counts(spark, d):
    """Neighbouring characters, weighed by how often their word occurs."""
    words = pretoken_counts(spark, d).where(F.length("word") > 1)
    pairs = words.select(F.col("count").alias("n"), "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    return pairs.groupBy(F.expr("substring(word, i, 1)").alias("left"), F.expr("substring(word, i + 1, 1)").alias("right")).agg(F.sum("n").alias("count"))


@query
def pack_blocks(spark, d):
    b = pack.pack_blocks(tokens(spark, d), "doc_id", "ids", BLOCK, n="n")
    return b.select("block_id", F.size("tokens").cast("bigint").alias("n"), K.total(F.col("tokens")).alias("token_sum"), F.element_at("tokens", 1).alias("first"), F.element_at("tokens", -1).alias("last"))


@query
def next_token_pairs(spark, d):
    """Pairs of all blocks, summed up by block."""
    pairs = pack.next_token_pairs(pack.pack_blocks(tokens(spark, d), "doc_id", "ids", BLOCK, n="n"))
    x, y, at = (F.col(c).cast("bigint") for c in ("x", "y", "pos"))
    return pairs.groupBy("block_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(x * y).alias("xy"), F.sum((at + 1) * (x + 3 * y)).alias("weighed"))


def n_blocks(spark: SparkSession, d: str) -> int:
    return sized(spark, d).agg(F.sum("n")).first()[0] // BLOCK


@query
def sample_with_replacement(spark, d):
    n = n_blocks(spark, d)
    return pack.draws(spark, n, n // 2, seed=7, epoch=1, rank=0)


@query
def resume_offset(spark, d):
    return sample_with_replacement(spark, d).where(F.col("sample_no") >= 3 * 8)


def _order(spark: SparkSession, d: str) -> DataFrame:
    blocks = spark.range(n_blocks(spark, d)).select(F.col("id").alias("block_id"), pack.shuffled(F.col("id"), 7).alias("k"))
    return ranked(blocks, "k", "pos").withColumn("pos", F.col("pos") - 1)


@query
def shard_by_rank(spark, d):
    n = n_blocks(spark, d)
    return _order(spark, d).where(F.col("pos") < n // 4 * 4).select((F.col("pos") % 4).alias("rank"), F.expr("pos div 4").alias("sample_no"), "block_id")


@query
def batches_drop_last(spark, d):
    n = n_blocks(spark, d)
    return _order(spark, d).where(F.col("pos") < n // 8 * 8).select(F.expr("pos div 8").alias("batch_id"), F.col("pos").alias("sample_no"), "block_id")


@query
def training_cursor(spark, d):
    """What follows a saved cursor in its epoch, by a bijection of block ids; no sort."""
    at = Cursor(seed=7, blocks=n_blocks(spark, d), world=4, batch=8).after(3)
    return ahead(spark, at).select("step", "rank", "slot", "block_id")


# --------------------------------------------------------------------- chat


def forms(spark: SparkSession, d: str) -> DataFrame:
    """Conversations in four schemas, by conv_id."""
    c = chat.conversations(table(spark, d, "conversations"))

    def first(role: str):
        return F.get(F.filter("turns", lambda t: t["role"] == role), F.lit(0))["text"]

    form = F.pmod("conv_id", F.lit(4)).cast("int")
    return c.select(
        "conv_id", form.alias("form"), "turns",
        F.when(form == 0, F.transform("turns", lambda t: F.struct(t["role"].alias("from"), t["text"].alias("value")))).alias("conversations"),
        F.when(form == 1, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("messages"),
        F.when(form == 2, first("user")).alias("instruction"), F.when(form == 2, first("system")).alias("input"), F.when(form == 2, first("assistant")).alias("output"),
        F.when(form == 3, first("user")).alias("prompt"), F.when(form == 3, first("assistant")).alias("response"),
    )


@query
def chat_schema_dispatch(spark, d):
    return forms(spark, d).select("conv_id", "form", chat.dispatch().alias("rendered")).where("rendered is not null")


@query
def chatml_render(spark, d):
    return chat.conversations(table(spark, d, "conversations")).select("conv_id", X.dialog(F.col("turns"), "role", "text").alias("rendered")).where("rendered is not null")


@query
def instruction_render(spark, d):
    f = forms(spark, d).withColumn("one", F.get(F.filter("turns", lambda t: t["role"] == "user"), F.lit(0))["text"]).withColumn("two", F.coalesce(F.get(F.filter("turns", lambda t: t["role"] == "user"), F.lit(1))["text"], F.lit(""))).withColumn("out", F.get(F.filter("turns", lambda t: t["role"] == "assistant"), F.lit(0))["text"])
    return f.where("one is not null and out is not null").select("conv_id", X.instruction(F.col("one"), F.col("two"), F.col("out")).alias("rendered"))


@query
def role_tag_replace(spark, d):
    said = F.array_join(F.transform("turns", lambda t: F.concat(F.upper(t["role"]), F.lit(": "), t["text"])), " ")
    return chat.conversations(table(spark, d, "conversations")).select("conv_id", X.role_tags(F.concat(said, F.lit(" <|endoftext|>"))).alias("text"))


#: transcripts of a conversation {id}: with a call, a nested one that stays, a response
TRANSCRIPTS = [
    "SYSTEM: s USER: u{id} ASSISTANT: a <|endoftext|>",
    'USER: find {id} ASSISTANT: {"name": "Web_Search", "arguments": "q{id}"} FUNCTION RESPONSE: found\nUSER: ok',
    '{"name": "f", "arguments": {"a": {id}}}',
    'USER: do ASSISTANT: {"name" : "run" , "arguments":{id}} and {"name": "x", "arguments": "7"}',
]


@query
def tool_transcript(spark, d):
    form = F.element_at(F.array(*map(F.lit, TRANSCRIPTS)), F.pmod("conv_id", F.lit(len(TRANSCRIPTS))).cast("int") + 1)
    c = table(spark, d, "conversations").select("conv_id").distinct()
    return c.select("conv_id", chat.tool_transcript(F.replace(form, F.lit("{id}"), F.col("conv_id").cast("string"))).alias("text"))


@query
def history_truncate(spark, d):
    return chat.truncate_history(table(spark, d, "conversations"), 640, 128).select("conv_id", "turn")


@query
def tail_tokens(spark, d):
    t = docs(spark, d).select("doc_id", K.tail(K.byte_tokens("text"), 256).alias("ids"))
    return t.select("doc_id", F.size("ids").cast("bigint").alias("n"), K.total(F.col("ids")).alias("token_sum"))


@query
def recent_distinct(spark, d):
    return docs(spark, d).select("doc_id", F.size(F.array_distinct(K.tail(K.byte_tokens("text"), 256))).cast("bigint").alias("n_distinct"))


@query
def pretty_piece(spark, d):
    marked = F.replace(F.replace(F.col("text"), F.lit(" "), F.lit("Ġ")), F.lit("\n"), F.lit("Ċ"))
    return docs(spark, d).select("doc_id", X.pretty_piece(F.concat(F.lit("▁"), marked, F.lit("\r\n"))).alias("text"))


# ------------------------------------------------------------------- totals


@query
def token_totals(spark, d):
    own = docs(spark, d).select("doc_id", "lang", X.strip("text").alias("text")).where("text <> ''")
    first = own.groupBy(dedup.content_key().alias("h")).agg(F.min(F.struct("doc_id", "lang", X.n_tokens("text").alias("n"), X.hash_split("text", 2.0).alias("split"))).alias("r"))
    return first.groupBy("r.split", "r.lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("r.n").alias("tokens"))


@query
def block_count(spark, d):
    return sized(spark, d).agg(F.sum("n").alias("total_tokens")).withColumn("blocks", F.expr(f"total_tokens div {BLOCK}"))


@query
def prefix_offsets(spark, d):
    return spans(sized(spark, d), "doc_id", "n").select("doc_id", "start", "end")


@query
def limit_rows(spark, d):
    return docs(spark, d).select("doc_id").orderBy("doc_id").limit(100)  # the feature: the first rows


# ------------------------------------------------------------------ metrics


def losses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("bucket"), (F.col("value") / 10).alias("loss"), "value", "ts")


def by_bucket(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bucket_loss(losses(spark, d), "bucket", "event_id", "loss", 200)


@query
def perplexity(spark, d):
    return by_bucket(spark, d).select("bucket", F.round("loss", 6).alias("loss"), F.round("ppl", 4).alias("ppl"))


@query
def macro_average(spark, d):
    return metrics.macro_average(by_bucket(spark, d)).select(F.round("loss", 6).alias("loss"), F.round("ppl", 4).alias("ppl"))


@query
def metric_fallback(spark, d):
    b = by_bucket(spark, d)
    both = metrics.metric_or_average(b, "bucket", "click").unionByName(metrics.metric_or_average(b, "bucket", "missing"))
    return both.select("metric", F.round("value", 6).alias("value"))


@query
def running_best(spark, d):
    return metrics.running_best(losses(spark, d), "bucket", "event_id", "value").select("event_id", "value")


@query
def trailing_mean_100(spark, d):
    return metrics.trailing_mean(losses(spark, d), "bucket", "event_id", "value").select("event_id", F.round("mean", 9).alias("mean"))


@query
def accuracy(spark, d):
    both = docs(spark, d).join(table(spark, d, "labels"), "doc_id")
    ok = (F.col("quality") == 1) == F.contains(F.col("text"), F.lit(". "))
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok.cast("double")), 6).alias("acc"))


@query
def accuracy_examples(spark, d):
    """The first ten examples of each language and how they were judged."""
    both = docs(spark, d).join(table(spark, d, "labels"), "doc_id")
    ok = (F.col("quality") == 1) == F.contains(F.col("text"), F.lit(". "))
    return metrics.first_examples(both.select("lang", "doc_id", ok.alias("ok")), "lang", "doc_id").select("lang", "doc_id", "ok")


@query
def grouped_contains_acc(spark, d):
    band = F.least(F.expr("octet_length(text) div 1000"), F.lit(5)).cast("int")
    return docs(spark, d).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.contains("text", F.lit(" the ")).cast("double")), 6).alias("acc"))


@query
def throughput(spark, d):
    return metrics.throughput(losses(spark, d), "user_id", "ts", "event_id", 1_048_576).select("event_id", F.round("tok_s", 3).alias("tok_s"))


@query
def kth_value_quantiles(spark, d):
    return metrics.error_distribution(losses(spark, d), "value").withColumn("mean", F.round("mean", 4))


@query
def lr_schedule(spark, d):
    """A step for each packed block."""
    return metrics.schedule(spark, 1e-3, 1e-4, 100, n_blocks(spark, d)).select("step", "schedule", F.round("lr", 12).alias("lr"))


# ------------------------------------------------------------------- logits


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", logits.doubles(F.transform("embedding", lambda v: v.cast("double") * 10)).alias("x"), "label")


def cells(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("x").alias("i", "value")).where("value is not null").withColumn("value", F.round("value", 6))


@query
def topk_logits(spark, d):
    return cells(vectors(spark, d).withColumn("x", logits.top_k(F.col("x"), 5)))


@query
def topp_filter(spark, d):
    return cells(vectors(spark, d).withColumn("x", logits.top_p(F.col("x"), 0.6)))


@query
def argmax(spark, d):
    return vectors(spark, d).select("vec_id", logits.argmax(F.col("x")).alias("i"))


@query
def softmax(spark, d):
    return cells(vectors(spark, d).withColumn("x", logits.softmax(F.col("x"))))


@query
def repetition_penalty(spark, d):
    return cells(vectors(spark, d).withColumn("x", logits.repetition_penalty(F.col("x"), F.array(F.lit(0), F.col("label"), F.col("label") + 7), 1.2)))


@query
def multinomial_draw(spark, d):
    u = (X.md5_word(F.concat(F.lit("draw:"), F.col("vec_id").cast("string"))) + 0.5) / F.lit(2.0**32)
    return vectors(spark, d).select("vec_id", logits.multinomial(F.col("x"), u).alias("i"))


@query
def rms_norm(spark, d):
    return cells(vectors(spark, d).withColumn("x", logits.rms_norm(F.col("x"))))


@query
def rope_rotate(spark, d):
    return cells(vectors(spark, d).withColumn("x", logits.rope(F.col("x"), F.pmod("vec_id", F.lit(128)))))


@query
def logsumexp_ce(spark, d):
    return vectors(spark, d).select("vec_id", F.round(logits.cross_entropy(F.col("x"), F.col("label")), 6).alias("loss"))


@query
def factored_second_moment(spark, d):
    grid = vectors(spark, d).select("vec_id", F.posexplode("x").alias("i", "value"))
    return metrics.second_moments(grid, "vec_id", "i", "value").withColumn("sum_sq", F.round("sum_sq", 3))


@query
def last_int(spark, d):
    fixed = spark.createDataFrame([(-1, "a -12 b 7"), (-2, "3-4"), (-3, "none")], "id bigint, text string")
    return docs(spark, d).select(F.col("doc_id").alias("id"), "text").unionByName(fixed).select("id", X.last_int("text").alias("value"))


# ---------------------------------------------------------------- streaming


@query
def stream_dedup(spark, d):
    from tessera.streaming import dedup as streams

    return streams.stream_dedup(spark, d, _scratch(spark))


@query
def stream_dedup_bounded(spark, d):
    from tessera.streaming import dedup as streams

    return streams.stream_dedup_bounded(spark, d, _scratch(spark), 300, buckets=4)


@query
def stream_flush(spark, d):
    """How many full groups of eight each source gives out."""
    from tessera.streaming import dedup as streams

    groups = streams.stream_flush(spark, d, _scratch(spark), items=8, wait_ms=3_600_000)
    return groups.where("flushed_by = 'count'").groupBy("source").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.size("items")).alias("items"))


@query
def stream_budget(spark, d):
    from tessera.streaming import dedup as streams

    return streams.stream_budget(spark, d, _scratch(spark), 300_000)


@query
def stream_totals(spark, d):
    from tessera.streaming import dedup as streams

    return streams.stream_totals(spark, d, _scratch(spark))
