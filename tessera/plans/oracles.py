"""The catalogue's queries in SQL, for a second engine on the same tables."""

from __future__ import annotations

from tessera.functions.text import WS
from tessera.plans.queries import BLOCK, PAD, STOPS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WHITE = lit(WS)
#: tables of shared definitions, put before a query as needed
SIZED = "sized AS (SELECT doc_id, lang, source, strlen(text) + 1 AS n, CASE WHEN ('0x' || substr(md5(text), 1, 8))::BIGINT % 10000 < 200 THEN 'val' ELSE 'train' END AS side FROM documents)"
SPANS = SIZED + ', spans AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id)::BIGINT AS "end", (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS start FROM sized)'
BYTES = "bytes AS (SELECT doc_id, i, ('0x' || substr(h, 2 * i + 1, 2))::INT AS x FROM (SELECT doc_id, h, unnest(range(len(h) // 2)) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents)))"
IDS = SPANS + ", " + BYTES + ", ids AS (SELECT doc_id, i, x FROM bytes UNION ALL SELECT doc_id, n - 1, 256 FROM sized), stream AS (SELECT start + i AS p, x FROM ids JOIN spans USING (doc_id))"
RANKED = "weights(source, w, idx) AS (VALUES ('en', 5, 0), ('fr', 3, 1), ('de', 2, 2), ('es', 1, 3))"
TOTAL = f"(SELECT sum(strlen(text) + 1)::BIGINT // {BLOCK} FROM documents)"
TURNS = f"turns AS (SELECT conv_id, turn, role, text, trim(text, {WHITE}) AS t, CASE WHEN trim(text, {WHITE}) = '' THEN '' ELSE '<|' || role || '|>' || chr(10) || trim(text, {WHITE}) || chr(10) END AS r FROM conversations)"
VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE * 10) AS x FROM embeddings), c AS (SELECT vec_id, label, len(x) AS len, unnest(range(len(x)))::INT AS i, unnest(x) AS x FROM v)"
LOSSES = "e AS (SELECT event_id, user_id, event_type AS bucket, value / 10 AS loss, value, ts FROM events), b AS (SELECT bucket, avg(loss) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY event_id) AS k FROM e) WHERE k <= 200 GROUP BY bucket)"
SHUFFLED = f"o AS (SELECT range AS block_id, row_number() OVER (ORDER BY ('0x' || substr(md5('7:' || range), 1, 15))::BIGINT) - 1 AS pos FROM range({TOTAL}))"


def interleaved(items: str, order: str, columns: str, where: str = "") -> str:
    return f"""WITH {RANKED}, items AS ({items}),
r AS (SELECT i.*, idx, (2 * row_number() OVER (PARTITION BY i.source ORDER BY {order}) - 1) * (30 // w) AS vt FROM items i JOIN weights USING (source))
SELECT row_number() OVER (ORDER BY vt, idx) AS out_pos, {columns} FROM r {where}"""


#: random arrivals of items (source, doc_id, n), by the seed's digests
ARRIVALS = """weights(source, w, idx) AS (VALUES ('en', 5, 0), ('fr', 3, 1), ('de', 2, 2), ('es', 1, 3)), items AS ({items}),
arrivals AS (SELECT source, doc_id, n, (sum(floor(-ln((('0x' || substr(md5('{seed}:' || source || ':' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE) / w * 16777216.0::DOUBLE)::BIGINT + 1) OVER (PARTITION BY source ORDER BY doc_id))::BIGINT * 4 + idx AS t FROM items JOIN weights USING (source))"""


def first(role: str, k: int = 1) -> str:
    return f"list(t ORDER BY turn) FILTER (role = '{role}')[{k}]"


EXCHANGE = "CASE WHEN {u} = '' THEN '' ELSE '<|user|>' || chr(10) || {u} || chr(10) END || CASE WHEN {a} = '' THEN '' ELSE '<|assistant|>' || chr(10) || {a} || chr(10) END"

ORACLES: dict[str, str] = {
    "bin_scan": f"WITH {IDS} SELECT 'train-' || lpad((p // 100000)::VARCHAR, 5, '0') || '.bin' AS path, count(*)::BIGINT AS n_tokens, sum(x)::BIGINT AS token_sum FROM stream GROUP BY p // 100000",
    "jsonl_append": "SELECT doc_id, lang FROM documents",
    "nonempty_unstripped": "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 1 ELSE length(text) END::BIGINT AS n FROM documents WHERE doc_id % 4 = 1 OR (doc_id % 4 = 2 AND text <> '')",
    "filter_lang_any": "SELECT doc_id, lang FROM documents",
    "shard_budget": f'WITH {SPANS} SELECT doc_id, n, "end" AS running FROM spans WHERE start < 500000',
    "random_interleave": f"WITH {ARRIVALS.format(seed=5, items='SELECT lang AS source, doc_id, 0 AS n FROM documents')} SELECT row_number() OVER (ORDER BY t) AS out_pos, source, doc_id FROM arrivals",
    "interleave_mixed_units": interleaved(
        "SELECT lang AS source, doc_id, strlen(text) AS n, unnest(CASE WHEN lang IN ('en', 'fr') THEN [0] ELSE range((strlen(text) + 1023) // 1024) END)::INT AS chunk_no FROM documents WHERE strlen(text) > 0",
        "doc_id, chunk_no",
        "source, doc_id, chunk_no, (CASE WHEN source IN ('en', 'fr') THEN n ELSE least(1024, n - 1024 * chunk_no) END)::BIGINT AS n_tokens",
    ),
    "split_driver": " UNION ALL ".join(
        f"SELECT * FROM (WITH {SIZED}, {ARRIVALS.format(seed=seed, items=f'SELECT lang AS source, doc_id, n FROM sized WHERE side = {lit(side)}')}, r AS (SELECT *, sum(n) OVER (ORDER BY t)::BIGINT AS running FROM arrivals) SELECT {lit(side)} AS split, source, doc_id, running FROM r WHERE running - n < {target})"
        for side, seed, target in (("train", 5, 400_000), ("val", 1004, 20_000))
    ),
    "accuracy_examples": "SELECT lang, doc_id, ok FROM (SELECT lang, doc_id, (quality = 1) = contains(text, '. ') AS ok, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents JOIN labels USING (doc_id)) WHERE k <= 10",
    "tool_transcript": """WITH c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, CASE conv_id % 4
 WHEN 0 THEN '<|system|>' || chr(10) || 's ' || chr(10) || '<|user|>' || chr(10) || 'u' || conv_id || ' ' || chr(10) || '<|assistant|>' || chr(10) || 'a' || chr(10)
 WHEN 1 THEN '<|user|>' || chr(10) || 'find ' || conv_id || ' ' || chr(10) || '<|assistant|>' || chr(10) || '<call:search>{"name": "Web_Search", "args": "q' || conv_id || '"}</call> <response>found' || chr(10) || '</response>' || chr(10) || '<|user|>' || chr(10) || 'ok' || chr(10)
 WHEN 2 THEN '{"name": "f", "arguments": {"a": ' || conv_id || '}}' || chr(10)
 ELSE '<|user|>' || chr(10) || 'do ' || chr(10) || '<|assistant|>' || chr(10) || '<call:tool>{"name": "run", "args": ' || conv_id || '}</call> and <call:tool>{"name": "x", "args": 7}</call>' || chr(10) END AS text
FROM c""",
    "multinomial_draw": f"""WITH {VECTORS}, p AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM c),
q AS (SELECT vec_id, i, len, sum(e) OVER (PARTITION BY vec_id ORDER BY i) / sum(e) OVER (PARTITION BY vec_id) AS cum, (('0x' || substr(md5('draw:' || vec_id), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM p)
SELECT vec_id, coalesce(min(i) FILTER (cum > u), max(len) - 1)::INT AS i FROM q GROUP BY vec_id""",
    "stream_budget": f"WITH {SPANS} SELECT doc_id, n FROM spans WHERE start < 300000",
    "stream_dedup": f"SELECT md5(t) AS h, strlen(t)::BIGINT + 1 AS n FROM (SELECT DISTINCT trim(text, {WHITE}) AS t FROM documents)",
    "scan_documents": "SELECT doc_id, lang, source, n_chars FROM documents",
    "source_text_clean": f"SELECT lang AS bucket, doc_id, trim(text, {WHITE}) AS text FROM documents WHERE trim(text, {WHITE}) <> ''",
    "concat_configs": "SELECT row_number() OVER (ORDER BY source, doc_id) AS out_pos, doc_id FROM documents",
    "paired_prompt": f"""SELECT doc_id AS id, '<|user|>' || chr(10) || 'Summarize the following paper into a concise abstract.' || chr(10) || chr(10) || '<paper>' || chr(10) || trim(d.text, {WHITE}) || chr(10) || '</paper>' || chr(10) || chr(10) || '<|assistant|>' || chr(10) || trim(b.text, {WHITE}) || chr(10) AS prompt
FROM documents d JOIN benchmark b ON item_id = doc_id WHERE trim(d.text, {WHITE}) <> '' AND trim(b.text, {WHITE}) <> ''""",
    "jsonl_parse": "SELECT event_id, TRY_CAST(props::JSON ->> 'k' AS BIGINT) AS k FROM events WHERE json_valid(props) AND TRY_CAST(props::JSON ->> 'k' AS BIGINT) IS NOT NULL",
    "repeat_source": "SELECT item_id, rep::INT AS rep, rep * n + rn - 1 AS ord FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS rn, count(*) OVER () AS n FROM benchmark), (SELECT unnest(range(3)) AS rep)",
    "split_substring_delim": f"SELECT doc_id, (k - 1)::INT AS piece_no, trim(p[k], {WHITE}) AS piece FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE trim(p[k], {WHITE}) <> ''",
    "split_min_len": f"SELECT doc_id, (k - 1)::INT AS piece_no, trim(p[k], {WHITE}) AS piece FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE length(trim(p[k], {WHITE})) > 50",
    "chunk_tokens": "SELECT doc_id, k::INT AS chunk_no, least(1024, n - 1024 * k)::BIGINT AS n_tokens FROM (SELECT doc_id, strlen(text) AS n, unnest(range((strlen(text) + 1023) // 1024)) AS k FROM documents)",
    "arith_items": """WITH r AS (SELECT range AS id, ('0x' || substr(md5('a:0:' || range), 1, 8))::BIGINT % 20001 - 10000 AS a, ('0x' || substr(md5('b:0:' || range), 1, 8))::BIGINT % 20001 - 10000 AS b, ('0x' || substr(md5('op:0:' || range), 1, 8))::BIGINT % 3 AS o FROM range(200))
SELECT id, a, b, ['+', '-', '*'][o + 1] AS op, CASE o WHEN 0 THEN a + b WHEN 1 THEN a - b ELSE a * b END AS answer FROM r""",
    "shard_manifest": f'WITH {SPANS} SELECT k AS shard_id, sum(least("end", (k + 1) * 100000) - greatest(start, k * 100000))::BIGINT AS n_tokens, k * 100000 AS first_pos FROM (SELECT *, unnest(range(start // 100000, ("end" - 1) // 100000 + 1)) AS k FROM spans) GROUP BY k',
    "shard_manifest_drop_tail": f"WITH {SPANS}, t AS (SELECT sum(n)::BIGINT AS n FROM sized) SELECT k AS shard_id, 100000::BIGINT AS n_tokens, k * 100000 AS first_pos FROM (SELECT unnest(range(n // 100000)) AS k FROM t)",
    "retention_top3": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3",
    "eval_report": "SELECT task, count(ok) AS n, round(avg(ok), 6) AS acc FROM (SELECT 'quality' AS task, quality AS ok FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY task",
    "strip_text": f"SELECT doc_id, trim({lit(PAD)} || text || {lit(PAD)}, {WHITE}) AS text, length(trim({lit(PAD)} || text || {lit(PAD)}, {WHITE})) AS n FROM documents",
    "filter_lang_ci": "SELECT doc_id, lang FROM documents WHERE lower(lang) IN ('en', 'de')",
    "filter_lang_counts": "SELECT count(*) FILTER (lang IN ('en', 'fr')) AS kept, count(*) FILTER (lang NOT IN ('en', 'fr')) AS skipped FROM documents",
    "truncate_chars": f"SELECT doc_id, substring(trim(text, {WHITE}), 1, 200) AS text FROM documents",
    "first_truthy": f"""WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN text END AS content, CASE WHEN doc_id % 3 = 0 THEN text END AS t, 'code ' || doc_id AS code FROM documents)
SELECT doc_id, trim(coalesce(nullif(content, ''), nullif(t, ''), code), {WHITE}) AS picked FROM c WHERE trim(coalesce(nullif(content, ''), nullif(t, ''), code), {WHITE}) <> ''""",
    "normalize_role": "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'assistant' ELSE 'system' END AS role FROM conversations",
    "append_eos": "SELECT doc_id, strlen(text) + 1 AS n_tokens, 256 AS last FROM documents WHERE text <> ''",
    "token_len_filter": f"WITH {SIZED} SELECT doc_id, n AS n_tokens FROM sized WHERE n >= 32",
    "token_truncate_eos": f"WITH {SIZED}, {BYTES}, s AS (SELECT doc_id, sum(x) AS s FROM bytes WHERE i < 2047 GROUP BY doc_id) SELECT doc_id, least(n, 2048) AS n_tokens, 256 AS last, (coalesce(s, 0) + 256)::BIGINT AS token_sum FROM sized LEFT JOIN s USING (doc_id)",
    "stop_match": "SELECT doc_id, " + " OR ".join(f"contains(right(text, 512), {lit(s)})" for s in STOPS) + " AS hit FROM documents",
    "lang_semi_join": "SELECT doc_id FROM documents WHERE lang IN ('en', 'es')",
    "incremental_anti_join": f"WITH d AS (SELECT doc_id, trim(text, {WHITE}) AS t, (SELECT max(doc_id) // 2 FROM documents) AS half FROM documents) SELECT doc_id FROM d WHERE doc_id > half AND t NOT IN (SELECT t FROM d WHERE doc_id <= half)",
    "block_doc_map": f'WITH {SPANS} SELECT k AS block_id, doc_id, least("end", (k + 1) * {BLOCK}) - greatest(start, k * {BLOCK}) AS n_tokens_in_block FROM (SELECT *, unnest(range(start // {BLOCK}, ("end" - 1) // {BLOCK} + 1)) AS k FROM spans)',
    "hash_split": f"WITH {SIZED} SELECT doc_id, side AS split FROM sized",
    "dedup_exact": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY trim(text, {WHITE})",
    "saturating_split": f"""WITH {SIZED}, r AS (SELECT *, coalesce(sum(n) FILTER (side = 'train') OVER w, 0) AS ct, coalesce(sum(n) FILTER (side = 'val') OVER w, 0) AS cv FROM sized WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT * FROM r WHERE ct >= 600000 OR cv >= 40000 ORDER BY doc_id LIMIT 1),
j AS (SELECT r.doc_id, r.side, c.doc_id AS cut_at, r.ct + r.cv - r.n - c.ct - c.cv AS since, CASE WHEN c.ct >= 600000 THEN 'val' ELSE 'train' END AS other, CASE WHEN c.ct >= 600000 THEN 40000 - c.cv ELSE 600000 - c.ct END AS room FROM r LEFT JOIN cut c ON true)
SELECT doc_id, CASE WHEN cut_at IS NULL OR doc_id <= cut_at THEN side ELSE other END AS split FROM j WHERE cut_at IS NULL OR doc_id <= cut_at OR since < room""",
    "bucketed_saturating_split": f"""WITH {SIZED}, b AS (SELECT *, coalesce(sum(n) FILTER (side = 'val') OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING), 0) AS bv FROM sized),
t AS (SELECT *, CASE WHEN side = 'val' AND bv - n < 8000 THEN 'val' ELSE 'train' END AS "to" FROM b),
r AS (SELECT *, coalesce(sum(n) FILTER ("to" = 'train') OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING), 0) AS ct FROM t),
s AS (SELECT lang, min(doc_id) FILTER (ct >= 600000) AS tp, min(doc_id) FILTER (bv >= 8000) AS vp FROM r GROUP BY lang),
p AS (SELECT min(tp) AS tp, CASE WHEN count(*) = count(vp) THEN max(vp) END AS vp FROM s),
q AS (SELECT CASE WHEN tp IS NULL AND vp IS NULL THEN NULL WHEN tp IS NOT NULL AND (vp IS NULL OR tp <= vp) THEN tp ELSE vp END AS cut, tp IS NOT NULL AND (vp IS NULL OR tp <= vp) AS train_full FROM p),
u AS (SELECT r.*, cut, train_full, cut IS NOT NULL AND doc_id > cut AS late FROM r, q),
x AS (SELECT *, coalesce(sum(n) FILTER (late) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING), 0) AS since_b, coalesce(sum(n) FILTER (late) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING), 0) AS since, coalesce(sum(n) FILTER (NOT late AND "to" = 'val') OVER (PARTITION BY lang), 0) AS had_b, coalesce(sum(n) FILTER (NOT late AND "to" = 'train') OVER (), 0) AS had FROM u)
SELECT doc_id, lang, CASE WHEN NOT late THEN "to" WHEN train_full THEN 'val' ELSE 'train' END AS split FROM x WHERE NOT late OR CASE WHEN train_full THEN since_b - n < 8000 - had_b ELSE since - n < 600000 - had END""",
    "budget_prefix": f'WITH {SPANS} SELECT doc_id, n, "end" AS running FROM spans WHERE start < 500000',
    "mix_report": f"WITH {SIZED}, {RANKED} SELECT source, round(w / 11.0::DOUBLE, 9) AS weight_norm, sum(n)::BIGINT AS tokens FROM (SELECT lang AS source, n FROM sized) JOIN weights USING (source) GROUP BY source, w",
    "weighted_interleave": interleaved("SELECT lang AS source, doc_id FROM documents", "doc_id", "source, doc_id"),
    "interleave_chunks": interleaved("SELECT lang AS source, doc_id, unnest(range((strlen(text) + 1023) // 1024))::INT AS chunk_no FROM documents", "doc_id, chunk_no", "source, doc_id, chunk_no"),
    "interleave_first_exhausted": interleaved("SELECT lang AS source, doc_id FROM documents", "doc_id", "source, doc_id", "WHERE vt <= (SELECT min(m) FROM (SELECT max(vt) AS m FROM r GROUP BY source))"),
    "normalize_weights": "SELECT source, round(w / sum(w) OVER (), 9) AS w FROM (VALUES ('web', 0.6::DOUBLE), ('code', 0.3), ('math', 0.3), ('off', 0.0)) t(source, w)",
    "tokenize_bytes": f"WITH {SIZED}, {BYTES}, s AS (SELECT doc_id, sum(x) AS s FROM bytes GROUP BY doc_id) SELECT doc_id, n AS n_tokens, (coalesce(s, 0) + 256)::BIGINT AS token_sum FROM sized LEFT JOIN s USING (doc_id)",
    "detokenize_bpe": "SELECT doc_id, text FROM documents",
    "pretoken_counts": r"SELECT word, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, ' ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')) AS word FROM documents) GROUP BY word",
    "bpe_pair_counts": r"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, ' ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')) AS word FROM documents) GROUP BY word)
SELECT substring(word, i, 1) AS "left", substring(word, i + 1, 1) AS "right", sum(n)::BIGINT AS count FROM (SELECT word, n, unnest(range(1, length(word))) AS i FROM w) GROUP BY ALL""",
    "pack_blocks": f"WITH {IDS} SELECT p // {BLOCK} AS block_id, count(*) AS n, sum(x)::BIGINT AS token_sum, min_by(x, p) AS first, max_by(x, p) AS last FROM stream GROUP BY 1 HAVING count(*) = {BLOCK}",
    "next_token_pairs": f"WITH {IDS}, q AS (SELECT p // {BLOCK} AS block_id, p % {BLOCK} AS pos, x::BIGINT AS x, lead(x) OVER (ORDER BY p)::BIGINT AS y FROM stream) SELECT block_id, count(*) AS pairs, sum(x * y)::BIGINT AS xy, sum((pos + 1) * (x + 3 * y))::BIGINT AS weighed FROM q WHERE pos < {BLOCK} - 1 AND block_id < {TOTAL} GROUP BY block_id",
    "sample_with_replacement": f"SELECT range AS sample_no, ('0x' || substr(md5('7:1:0:' || range), 1, 8))::BIGINT % {TOTAL} AS block_id FROM range({TOTAL} // 2)",
    "resume_offset": f"SELECT range AS sample_no, ('0x' || substr(md5('7:1:0:' || range), 1, 8))::BIGINT % {TOTAL} AS block_id FROM range({TOTAL} // 2) WHERE range >= 24",
    "shard_by_rank": f"WITH {SHUFFLED} SELECT pos % 4 AS rank, pos // 4 AS sample_no, block_id FROM o WHERE pos < {TOTAL} // 4 * 4",
    "batches_drop_last": f"WITH {SHUFFLED} SELECT pos // 8 AS batch_id, pos AS sample_no, block_id FROM o WHERE pos < {TOTAL} // 8 * 8",
    "chat_schema_dispatch": f"""WITH {TURNS}, g AS (SELECT conv_id, conv_id % 4 AS form, string_agg(r, '' ORDER BY turn) AS dialog, {first("user")} AS u, {first("system")} AS s, {first("assistant")} AS a FROM turns GROUP BY conv_id),
x AS (SELECT conv_id, form::INT AS form, CASE WHEN form < 2 THEN nullif(dialog, '') WHEN u IS NULL OR a IS NULL THEN NULL WHEN form = 2 THEN {EXCHANGE.format(u="(CASE WHEN coalesce(s, '') = '' THEN u ELSE u || chr(10) || chr(10) || 'Input:' || chr(10) || s END)", a="a")} ELSE {EXCHANGE.format(u="u", a="a")} END AS rendered FROM g)
SELECT * FROM x WHERE rendered IS NOT NULL""",
    "chatml_render": f"WITH {TURNS} SELECT conv_id, string_agg(r, '' ORDER BY turn) AS rendered FROM turns GROUP BY conv_id HAVING string_agg(r, '' ORDER BY turn) <> ''",
    "instruction_render": f"""WITH {TURNS}, g AS (SELECT conv_id, {first("user")} AS u, coalesce({first("user", 2)}, '') AS s, {first("assistant")} AS a FROM turns GROUP BY conv_id)
SELECT conv_id, {EXCHANGE.format(u="(CASE WHEN s = '' THEN u ELSE u || chr(10) || chr(10) || 'Input:' || chr(10) || s END)", a="a")} AS rendered FROM g WHERE u IS NOT NULL AND a IS NOT NULL""",
    "role_tag_replace": f"""WITH g AS (SELECT conv_id, trim(string_agg(upper(role) || ': ' || text, ' ' ORDER BY turn) || ' <|endoftext|>', {WHITE}) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, replace(replace(replace(replace(t, 'SYSTEM: ', '<|system|>' || chr(10)), 'USER: ', chr(10) || '<|user|>' || chr(10)), 'ASSISTANT: ', chr(10) || '<|assistant|>' || chr(10)), '<|endoftext|>', '') AS text FROM g""",
    "history_truncate": f"WITH {TURNS}, s AS (SELECT conv_id, turn, sum(strlen(r)) OVER w AS s, row_number() OVER w AS k FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn FROM s WHERE s <= 512 OR k = 1",
    "tail_tokens": f"WITH {SIZED}, {BYTES} SELECT doc_id, count(*) AS n, sum(x)::BIGINT AS token_sum FROM bytes JOIN sized USING (doc_id) WHERE i >= n - 1 - 256 GROUP BY doc_id",
    "recent_distinct": f"WITH {SIZED}, {BYTES} SELECT doc_id, count(DISTINCT x) AS n_distinct FROM bytes JOIN sized USING (doc_id) WHERE i >= n - 1 - 256 GROUP BY doc_id",
    "pretty_piece": "SELECT doc_id, ' ' || text || chr(10) AS text FROM documents",
    "token_totals": f"""WITH k AS (SELECT doc_id, lang, trim(text, {WHITE}) AS t FROM documents WHERE trim(text, {WHITE}) <> '' QUALIFY row_number() OVER (PARTITION BY trim(text, {WHITE}) ORDER BY doc_id) = 1)
SELECT CASE WHEN ('0x' || substr(md5(t), 1, 8))::BIGINT % 10000 < 200 THEN 'val' ELSE 'train' END AS split, lang, count(*) AS docs, sum(strlen(t) + 1)::BIGINT AS tokens FROM k GROUP BY ALL""",
    "block_count": f"SELECT sum(strlen(text) + 1)::BIGINT AS total_tokens, sum(strlen(text) + 1)::BIGINT // {BLOCK} AS blocks FROM documents",
    "prefix_offsets": f'WITH {SPANS} SELECT doc_id, start, "end" FROM spans',
    "limit_rows": "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100",
    "perplexity": f"WITH {LOSSES} SELECT bucket, round(loss, 6) AS loss, round(exp(loss), 4) AS ppl FROM b",
    "macro_average": f"WITH {LOSSES} SELECT round(avg(loss), 6) AS loss, round(exp(avg(loss)), 4) AS ppl FROM b",
    "metric_fallback": f"WITH {LOSSES} SELECT metric, round(coalesce((SELECT loss FROM b WHERE bucket = metric), (SELECT avg(loss) FROM b)), 6) AS value FROM (VALUES ('click'), ('missing')) m(metric)",
    "running_best": f"WITH {LOSSES} SELECT event_id, value FROM (SELECT *, min(value) OVER (PARTITION BY bucket ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e) WHERE best IS NULL OR value < best",
    "trailing_mean_100": f"WITH {LOSSES} SELECT event_id, round(avg(value) OVER (PARTITION BY bucket ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS mean FROM e",
    "accuracy": "SELECT lang, count(*) AS n, round(avg(((quality = 1) = contains(text, '. '))::INT), 6) AS acc FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "grouped_contains_acc": "SELECT least(strlen(text) // 1000, 5)::INT AS band, count(*) AS n, round(avg(contains(text, ' the ')::INT), 6) AS acc FROM documents GROUP BY 1",
    "throughput": f"WITH {LOSSES} SELECT event_id, round(1048576.0::DOUBLE / greatest((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6::DOUBLE, 1e-6::DOUBLE), 3) AS tok_s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "kth_value_quantiles": f"WITH {LOSSES}, r AS (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM e) SELECT max(value) FILTER (k = greatest(1, floor(0.99::DOUBLE * n)::BIGINT)) AS p99, max(value) FILTER (k = greatest(1, floor(0.999::DOUBLE * n)::BIGINT)) AS p999, max(value) AS max, round(avg(value), 4) AS mean FROM r",
    "lr_schedule": """WITH s AS (SELECT range AS step, unnest(['cosine', 'linear']) AS schedule FROM range(1001)), t AS (SELECT *, least(greatest((step - 100) / 900.0::DOUBLE, 0), 1) AS t FROM s)
SELECT step, schedule, round(CASE WHEN step < 100 THEN 1e-4::DOUBLE + (1e-3::DOUBLE - 1e-4::DOUBLE) * (step / 100.0::DOUBLE) WHEN schedule = 'linear' THEN 1e-3::DOUBLE + (1e-4::DOUBLE - 1e-3::DOUBLE) * t ELSE 1e-4::DOUBLE + 0.00045::DOUBLE * (1 + cos(pi() * t)) END, 12) AS lr FROM t""",
    "topk_logits": f"WITH {VECTORS} SELECT vec_id, i, round(x, 6) AS value FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS k FROM c) WHERE k <= 5",
    "topp_filter": f"""WITH {VECTORS}, p AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM c), q AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM p),
r AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS UNBOUNDED PRECEDING) - p AS before FROM q) SELECT vec_id, i, round(x, 6) AS value FROM r WHERE before <= 0.6""",
    "argmax": f"WITH {VECTORS} SELECT vec_id, i FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) = 1",
    "softmax": f"WITH {VECTORS}, p AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM c) SELECT vec_id, i, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS value FROM p",
    "repetition_penalty": f"WITH {VECTORS} SELECT vec_id, i, round(CASE WHEN i IN (0, label, label + 7) THEN CASE WHEN x > 0 THEN x / 1.2::DOUBLE ELSE x * 1.2::DOUBLE END ELSE x END, 6) AS value FROM c",
    "rms_norm": f"WITH {VECTORS} SELECT vec_id, i, round(x / sqrt(avg(x * x) OVER (PARTITION BY vec_id) + 1e-6::DOUBLE), 6) AS value FROM c",
    "rope_rotate": f"""WITH {VECTORS}, a AS (SELECT l.vec_id, l.i, l.len // 2 AS half, l.x AS a, r.x AS b, (l.vec_id % 128) / pow(10000.0::DOUBLE, 2.0 * l.i / l.len) AS t FROM c l JOIN c r ON l.vec_id = r.vec_id AND r.i = l.i + l.len // 2)
SELECT vec_id, i::INT AS i, round(a * cos(t) - b * sin(t), 6) AS value FROM a UNION ALL SELECT vec_id, (i + half)::INT, round(b * cos(t) + a * sin(t), 6) FROM a""",
    "logsumexp_ce": f"WITH {VECTORS}, m AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM c) SELECT vec_id, round(max(m) + ln(sum(exp(x - m))) - max(x) FILTER (i = label), 6) AS loss FROM m GROUP BY vec_id",
    "factored_second_moment": f"WITH {VECTORS} SELECT CASE WHEN grouping(vec_id) = 0 THEN 'row' WHEN grouping(i) = 0 THEN 'col' ELSE 'all' END AS axis, coalesce(vec_id, i, -1)::BIGINT AS idx, round(sum(x * x), 3) AS sum_sq FROM c GROUP BY GROUPING SETS ((vec_id), (i), ())",
    "last_int": r"""WITH d AS (SELECT doc_id AS id, text AS t FROM documents UNION ALL VALUES (-1, 'a -12 b 7'), (-2, '3-4'), (-3, 'none'))
SELECT id, TRY_CAST(regexp_extract_all(t, '-?\d+')[-1] AS BIGINT) AS value FROM d""",
    "stream_totals": f"WITH {SIZED} SELECT side AS split, count(*) AS docs, sum(n)::BIGINT AS tokens FROM sized GROUP BY side",
}

ORACLES["corpus_build"] = f"""SELECT target, ((sum(n_tokens) + 49999) // 50000)::BIGINT AS shards, sum(n_tokens)::BIGINT AS n_tokens, sum(token_sum)::BIGINT AS token_sum
FROM (SELECT doc_id, CASE WHEN split = 'train' THEN 'train' ELSE 'val/' || coalesce(lang, 'none') END AS target FROM ({ORACLES["bucketed_saturating_split"]})) JOIN ({ORACLES["tokenize_bytes"]}) USING (doc_id) GROUP BY target"""
#: A row a step: what the memory holds, and whether the row was new to it.
BOUNDED = """SELECT {b} AS b, doc_id, t, row_number() OVER (PARTITION BY {b} ORDER BY doc_id) AS k FROM (SELECT doc_id, md5(trim(text, {white})) AS t FROM documents)), steps AS (
SELECT DISTINCT b, 0::BIGINT AS k, []::VARCHAR[] AS seen, NULL::BIGINT AS doc_id FROM r UNION ALL
SELECT r.b, r.k, CASE WHEN list_contains(seen, t) THEN seen WHEN len(seen) + 1 >= {capacity} THEN [] ELSE list_append(seen, t) END, CASE WHEN NOT list_contains(seen, t) THEN r.doc_id END
FROM steps JOIN r ON r.b = steps.b AND r.k = steps.k + 1) SELECT doc_id FROM steps WHERE doc_id IS NOT NULL"""
ORACLES["dedup_bounded"] = "WITH RECURSIVE r AS (" + BOUNDED.format(b="0", white=WHITE, capacity=300)
ORACLES["stream_dedup_bounded"] = "WITH RECURSIVE r AS (" + BOUNDED.format(b="('0x' || substr(t, 1, 8))::BIGINT % 4", white=WHITE, capacity=75)
ORACLES["stream_flush"] = "SELECT source, (count(*) // 8)::BIGINT AS groups, (count(*) // 8 * 8)::BIGINT AS items FROM documents GROUP BY source HAVING count(*) >= 8"
#: of documents whole or in chunks; an item's key is its document and its chunk
UNITS = "SELECT lang AS source, doc_id, strlen(text) AS n, unnest(CASE WHEN lang IN ('en', 'fr') THEN [0] ELSE range((strlen(text) + 1023) // 1024) END)::INT AS chunk_no FROM documents WHERE strlen(text) > 0"
ORACLES["random_mixed_units"] = (
    f"WITH {ARRIVALS.format(seed=5, items=UNITS)}".replace("SELECT source, doc_id, n, (sum", "SELECT source, doc_id, chunk_no, n, (sum").replace("':' || doc_id)", "':' || doc_id || ':' || chunk_no)").replace("ORDER BY doc_id))::BIGINT * 4", "ORDER BY doc_id, chunk_no))::BIGINT * 4")
    + " SELECT row_number() OVER (ORDER BY t) AS out_pos, source, doc_id, chunk_no, (CASE WHEN source IN ('en', 'fr') THEN n ELSE least(1024, n - 1024 * chunk_no) END)::BIGINT AS n_tokens FROM arrivals"
)
#: a character is a byte that continues none, or one that continues what the shard does not hold
ORACLES["shard_head"] = f"""WITH {IDS}, h AS (SELECT p // 100000 AS s, p % 100000 AS i, x FROM stream WHERE p % 100000 < 500), f AS (SELECT s, min(i) FILTER (x < 128 OR x > 191) AS lead FROM h GROUP BY s)
SELECT 'train-' || lpad(s::VARCHAR, 5, '0') || '.bin' AS path, count(*)::BIGINT AS n_tokens, sum(x)::BIGINT AS token_sum, (count(*) FILTER (x < 256 AND (x < 128 OR x > 191 OR i < lead)))::BIGINT AS n_chars FROM h JOIN f USING (s) GROUP BY s"""

ORACLES["split_line_delim"] = f"""WITH p AS (SELECT doc_id, string_split(text, '. ') AS p FROM documents)
SELECT doc_id, (k - 1)::INT AS prompt_no, trim(p[k], {WHITE}) AS prompt FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k FROM p) WHERE trim(p[k], {WHITE}) <> ''"""
ORACLES["arith_items"] = ORACLES["arith_items"].replace("range(200)", "range((SELECT count(*) FROM documents))")
ORACLES["normalize_weights"] = "SELECT source, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 9) AS w FROM documents GROUP BY source"
ORACLES["lr_schedule"] = ORACLES["lr_schedule"].replace("range(1001)", f"range({TOTAL} + 1)").replace("900.0::DOUBLE", f"greatest({TOTAL} - 100, 1)::DOUBLE")
