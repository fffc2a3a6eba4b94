"""SQL that DuckDB runs on the same tables, for the queries of queries.py. The order of shards is written out."""

from __future__ import annotations

from .functions.text import EMAIL, URL, WS, WS_IN_LINE

_ORDER = "src9 src13 src4 src12 src17 src3 src5 src8 src14 src2 src7 src18 src1 src19 src10 src6 src15 src16 src0 src11".split()
_SHARDS = "(VALUES " + ", ".join(f"('{s}', '{'validation' if i == 0 else 'train'}', {max(i - 1, 0)})" for i, s in enumerate(_ORDER)) + ") AS s(shard, split, shard_pos)"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _r(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {_q(pattern)}, {_q(to)}, 'g')"


def _strip(x: str) -> str:
    return _r(x, rf"\A[{WS}]+|[{WS}]+\z", "")


def _scrub(x: str) -> str:
    x = _r(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]", "")
    x = _r(x, r"\\cite\w*\{[^}]*\}", "[REF]")
    x = _r(x, r"\\(?:ref|label|eqref)\{[^}]*\}", "")
    x = _r(x, r"\$+[^$]*\$+", " [MATH] ")
    x = _r(x, r"\\[a-zA-Z]+\*?\{[^}]*\}", "")
    x = _r(_r(x, URL, "[URL]"), EMAIL, "[EMAIL]")
    x = f"replace({x}, chr(9), ' ')"
    x = _r(_r(x, r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    x = _r(x, r" {2,}", " ")
    x = _r(x, rf"[{WS_IN_LINE}]+(\n|\z)", r"\1")
    return _strip(x)


def _cut(x: str, most: int) -> str:
    cut = f"substring({x}, 1, {most})"
    at = f"(CASE WHEN instr(reverse({cut}), chr(10) || chr(10)) > 0 THEN length({cut}) - instr(reverse({cut}), chr(10) || chr(10)) - 1 ELSE -1 END)"
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE {_strip(f'CASE WHEN {at} > {most // 2} THEN substring({cut}, 1, {at}) ELSE {cut} END')} END"


_CLEAN = f"""scrubbed AS (SELECT *, CASE WHEN length(text) >= 100 THEN {_scrub('text')} END AS scrub FROM documents),
 cleaned AS (SELECT *, length(scrub) AS scrubbed_length, CASE WHEN length(scrub) >= 100 THEN {_cut('scrub', 100_000)} END AS clean FROM scrubbed JOIN {_SHARDS} ON scrubbed.source = s.shard)"""
_IDS = lambda x: f"list_transform(list_filter(regexp_split_to_array({x}, '[ \\n\\t\\r]+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 4))::INT % 31997 + 3)"
_TOKENS = f"{_CLEAN}, tokens AS (SELECT *, len(ids) AS n_tokens FROM (SELECT split, shard, shard_pos, doc_id, list_append({_IDS('clean')}, 2) AS ids FROM cleaned WHERE text <> '' AND clean IS NOT NULL))"
_JOIN = lambda x: f"array_to_string({x}, ' ')"
_CONV = "conv AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
_BLOCKS = f"{_TOKENS}, blocks AS (SELECT unnest(range((sum(n_tokens)::BIGINT - 1) // 64)) AS block_id FROM tokens WHERE split = 'train')"
_NORMAL = lambda x: f"replace(lower(trim({_r(x, f'[{WS}]+', ' ')})), 'ß', 'ss')"


def _percentile(column: str, share: float) -> str:
    return f"list_sort(list({column}))[least(count({column}) - 1, floor({share} * count({column})))::INT + 1]"


def _chunk(overlap: int) -> str:
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda q: length(q))), 0)"
    tail = f"coalesce(list_max(list_filter(range(1, len(now) + 1), lambda k: {total('now[-k:]')} < {overlap})), 0)" if overlap else "0"
    return f"""WITH RECURSIVE {_CONV},
 parts AS (SELECT conv_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {_strip('p')}), lambda p: p <> '') AS ps FROM conv WHERE length(text) > 400),
 fold AS (SELECT conv_id, ps, 0 AS i, []::VARCHAR[] AS done, []::VARCHAR[] AS now FROM parts
  UNION ALL SELECT conv_id, ps, i + 1, CASE WHEN overfull THEN list_append(done, array_to_string(now, chr(10) || chr(10))) ELSE done END,
   list_append(CASE WHEN overfull THEN (CASE WHEN tail > 0 THEN now[-tail:] ELSE []::VARCHAR[] END) ELSE now END, ps[i + 1])
  FROM (SELECT *, len(now) > 0 AND {total('now')} + length(ps[i + 1]) > 400 AS overfull, {tail} AS tail FROM fold WHERE i < len(ps))),
 chunks AS (SELECT conv_id, list_filter(list_append(done, array_to_string(now, chr(10) || chr(10))), lambda c: length(c) >= 20) AS cs FROM fold WHERE i = len(ps)
  UNION ALL SELECT conv_id, [text] FROM conv WHERE length(text) <= 400)
 SELECT conv_id, (unnest(range(len(cs))))::INT AS chunk, unnest(cs) AS text FROM chunks"""


def _windows(size: int, step: int) -> str:
    return f"""WITH t AS (SELECT doc_id, {_IDS('text')} AS ids FROM documents), w AS (SELECT doc_id, ids, unnest(range(0, len(ids) - 1, {step})) AS s FROM t WHERE len(ids) >= 2)
 SELECT doc_id, (s // {step})::INT AS "window", len(ids[s + 1 : s + {size} + 1])::INT AS n, md5({_JOIN(f'ids[s + 1 : s + {size} + 1]')}) AS ids_md5 FROM w"""


def _histogram(x: str, source: str = "documents") -> str:
    edges = [0, 100, 500, 1000, 5000, 10_000, 50_000, 100_000]
    bins = ", ".join(f"({a}, {b if b else 'NULL'})" for a, b in zip(edges, [*edges[1:], None], strict=True))
    return f"SELECT b.low::BIGINT AS low, coalesce(b.high, -1)::BIGINT AS high, count(d.x) AS n FROM (VALUES {bins}) b(low, high) LEFT JOIN (SELECT {x} AS x FROM {source}) d ON d.x >= b.low AND (b.high IS NULL OR d.x < b.high) GROUP BY 1, 2"


def _across(key: str, source: str) -> str:
    of = lambda s: f"coalesce(string_agg(DISTINCT shard, ', ' ORDER BY shard) FILTER (split = '{s}'), '')"
    return f"SELECT * FROM (SELECT {key} AS key, count(*) AS n, {of('train')} AS train_shards, {of('validation')} AS validation_shards FROM {source} WHERE {key} <> '' GROUP BY 1) WHERE train_shards <> '' AND validation_shards <> ''"


_DOCS = f"(SELECT d.*, s.* FROM documents d JOIN {_SHARDS} ON d.source = s.shard)"
_PAGE_ORDER = "p3 p4 p6 p7 p2 p5 p0 p1".split()
_PAGES = "(SELECT p.url, s.* FROM pages p JOIN (VALUES " + ", ".join(f"('{s}', '{'validation' if i == 0 else 'train'}')" for i, s in enumerate(_PAGE_ORDER)) + ") AS s(shard, split) ON 'p' || p.page_id % 8 = s.shard)"
_LOGITS = "logits AS (SELECT vec_id, (unnest(range(len(embedding))))::INT AS token, unnest(list_transform(embedding, lambda x: round(x::DOUBLE * 10, 4))) AS logit FROM embeddings)"
_VEC = "vec AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
_CE = "CASE WHEN label <> -1 THEN ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[label + 1] END"


def _listed(x: str, n: int = 64) -> str:
    return f"WITH {_VEC} SELECT vec_id, (unnest(range({n})))::INT AS i, unnest(list_transform({x}, lambda v: round(v, 8) + 0.0)) AS v FROM vec"


def _hash(*parts: str) -> str:
    return f"sha256(concat_ws('|', {', '.join(parts)}))"


def _rate(rest: str) -> str:
    return f"SELECT step, round(CASE WHEN step < 100 THEN 3e-4 * step / 100 {rest} END, 10)::DOUBLE AS rate FROM (SELECT unnest(range(1201)) AS step)"


def oracle_sql() -> dict[str, str]:
    clean, tokens = f"WITH {_CLEAN}", f"WITH {_TOKENS}"
    order = f"shuffled AS (SELECT block_id, block_id // 256 * 256 + row_number() OVER (PARTITION BY block_id // 256 ORDER BY {_hash('42', 'block_id')}) - 1 AS position FROM blocks)"
    epochs = lambda n: f"orders AS (SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY {_hash('42', 'epoch', 'block_id')}) - 1 AS \"offset\", block_id FROM blocks, (SELECT unnest(range({n}))::INT AS epoch))"
    return {
        "clean_profile": f"{clean} SELECT split, shard, count(*) AS seen, count(clean) AS kept, count(*) - count(clean) AS filtered, coalesce(sum(length(clean)), 0)::BIGINT AS chars_kept FROM cleaned WHERE text <> '' GROUP BY ALL",
        "clean_text": f"{clean} SELECT doc_id, clean FROM cleaned",
        "clean_pages": f"SELECT page_id, {_scrub('html')} AS clean FROM pages",
        "length_filter_reasons": f"{clean} SELECT lang, CASE WHEN length(text) < 100 THEN 'raw' WHEN clean IS NULL THEN 'cleaned' ELSE 'kept' END AS reason, count(*) AS n FROM cleaned GROUP BY ALL",
        "truncate_paragraph": f"WITH {_CONV} SELECT conv_id, {_cut('text', 600)} AS text FROM conv",
        "chunk_paragraphs": _chunk(0),
        "chunk_overlap": _chunk(250),
        "conversation_paragraphs": f"WITH {_CONV}, p AS (SELECT conv_id, unnest(range(len(string_split(text, chr(10) || chr(10)))))::INT AS position, {_strip('unnest(string_split(text, chr(10) || chr(10)))')} AS text FROM conv) SELECT * FROM p WHERE text <> ''",
        "shard_split": f"SELECT * FROM {_SHARDS}",
        "estimated_documents": "SELECT count(*) AS estimate FROM documents",
        "worker_files": f"SELECT shard_pos % 4 AS worker, split, count(DISTINCT shard) AS shards, count(*) AS documents FROM {_DOCS} GROUP BY ALL",
        "shard_inventory": f"""WITH d AS (SELECT x.*, l.quality FROM {_DOCS} x LEFT JOIN labels l USING (doc_id)), m AS (SELECT shard, lang, row_number() OVER (PARTITION BY shard ORDER BY count(*) DESC, lang) AS r FROM d GROUP BY shard, lang)
 SELECT d.split, d.shard, count(*) AS documents, sum(n_chars)::BIGINT AS token_sum, count_if(text IS NULL)::BIGINT AS null_texts, count_if(quality IS NULL)::BIGINT AS null_scores, median(n_chars)::DOUBLE AS median_chars, {_percentile('n_chars', 0.05)} AS p05_chars, {_percentile('n_chars', 0.95)} AS p95_chars, any_value(m.lang) AS lang FROM d JOIN m ON m.shard = d.shard AND m.r = 1 GROUP BY d.split, d.shard""",
        "language_counts": "SELECT source AS shard, '{' || string_agg('\"' || lang || '\":' || n, ',' ORDER BY lang) || '}' AS counts FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL) GROUP BY source",
        "cluster_sample": f"""WITH r AS (SELECT source AS shard, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_index, 42 + ('0x' || substr(sha256(source), 1, 8))::BIGINT AS seed FROM documents),
 c AS (SELECT *, row_index // 10 AS cluster FROM r), p AS (SELECT shard, cluster, row_number() OVER (PARTITION BY shard ORDER BY {_hash('seed', 'cluster')}) AS pick FROM (SELECT DISTINCT shard, seed, cluster FROM c)),
 q AS (SELECT c.shard, c.cluster, pick, doc_id, row_number() OVER (PARTITION BY c.shard, c.cluster ORDER BY {_hash('seed', 'c.cluster', 'row_index')}) AS draw FROM c JOIN p ON p.shard = c.shard AND p.cluster = c.cluster AND pick <= 3)
 SELECT shard, cluster, pick, draw, doc_id FROM q WHERE draw <= 2 + (pick <= 1)::INT""",
        "shard_seeds": "SELECT DISTINCT source AS shard, 42 + ('0x' || substr(sha256(source), 1, 8))::BIGINT AS seed FROM documents",
        "length_stats": f"{clean} SELECT count(text) AS texts, count_if(length(text) < 100)::BIGINT AS below_min, count_if(clean IS NULL)::BIGINT AS filtered, count_if(scrubbed_length > 100000)::BIGINT AS would_truncate, count_if(strlen(replace(text, chr(10), ' ')) > 4192)::BIGINT AS over_byte_limit, median(length(text))::DOUBLE AS median_chars, {_percentile('length(text)', 0.95)} AS p95_chars FROM cleaned",
        "histogram_chars": _histogram("length(text)"),
        "histogram_bytes": _histogram("strlen(text)"),
        "split_summary": f"SELECT split, count(DISTINCT shard) AS shards, count(*) AS documents, sum(n_chars)::BIGINT AS token_sum, median(n_chars)::DOUBLE AS median_chars FROM {_DOCS} GROUP BY split",
        "cross_split_duplicates": f"{clean}, f AS (SELECT sha256({_NORMAL('clean')}) AS k, shard, split FROM cleaned WHERE clean IS NOT NULL) {_across('k', 'f')}",
        "cross_split_ids": _across("doc_id::VARCHAR", _DOCS),
        "cross_split_languages": _across("lang", _DOCS),
        "cross_split_urls": _across("url", _PAGES),
        "cross_split_hosts": _across("regexp_extract(url, '^[a-z]+://([^/]+)', 1)", _PAGES),
        "histogram_tokens": f"{tokens} {_histogram('n_tokens', 'tokens')}",
        "multinomial_draw": f"WITH {_LOGITS}, p AS (SELECT vec_id, token, sum(exp(logit)) OVER (PARTITION BY vec_id ORDER BY token) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS upto FROM logits) SELECT vec_id, least(count_if(upto <= (vec_id * 7919 % 10007 + 0.5) / 10007), count(*) - 1)::INT AS token FROM p GROUP BY vec_id",
        "audit_summary": f"{clean} SELECT count(*) AS documents, count(DISTINCT shard) AS shards, sum(n_chars)::BIGINT AS token_sum, count(clean) AS kept, count(DISTINCT {_NORMAL('clean')}) AS distinct_texts FROM cleaned",
        "tokenizer_provenance": f"""{clean}, r AS (SELECT *, row_number() OVER (ORDER BY split DESC, shard_pos, doc_id) AS rank FROM cleaned WHERE clean IS NOT NULL), a AS (SELECT * FROM r WHERE rank <= 2000000)
 SELECT s.shard, s.split, count(a.doc_id) AS accepted, coalesce(count_if(strlen(replace(a.clean, chr(10), ' ')) > 4192), 0)::BIGINT AS over_limit FROM {_SHARDS} LEFT JOIN a ON a.shard = s.shard GROUP BY 1, 2""",
        "doc_limit": "SELECT source AS shard, doc_id, rank_in_shard FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS rank_in_shard FROM documents WHERE text <> '') WHERE rank_in_shard <= 5",
        "token_budget": f"{tokens} SELECT * FROM (SELECT split, shard, doc_id, n_tokens, coalesce(sum(n_tokens) OVER (PARTITION BY split ORDER BY shard_pos, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tokens_before FROM tokens) WHERE tokens_before < 20000",
        "token_rollup": f"{tokens} SELECT split, shard, count(*) AS documents, sum(n_tokens)::BIGINT AS tokens, (2 * sum(n_tokens))::BIGINT AS bytes, round(sum(n_tokens) / count(*), 6) AS tokens_per_document FROM tokens GROUP BY ROLLUP (split, shard)",
        "token_ids": f"{tokens} SELECT doc_id, {_JOIN('ids')} AS ids FROM tokens",
        "encode_specials": f"SELECT doc_id, {_JOIN(f'list_concat([1], {_IDS("text")}, [2])')} AS ids FROM documents",
        "document_chunks": "SELECT shard, (rank - 1) // 16 AS chunk, count(*) AS documents, sum(n)::BIGINT AS chars FROM (SELECT source AS shard, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE text <> '') GROUP BY ALL",
        "pack_blocks": f"""{tokens}, stream AS (SELECT flatten(list(ids ORDER BY shard_pos, doc_id)) AS ids FROM tokens WHERE split = 'train'), b AS (SELECT ids, unnest(range((len(ids) - 1) // 512)) AS block_id FROM stream)
 SELECT block_id, 512 AS size, md5({_JOIN('ids[block_id * 512 + 1 : block_id * 512 + 512]')}) AS inputs_md5, md5({_JOIN('ids[block_id * 512 + 2 : block_id * 512 + 513]')}) AS labels_md5 FROM b""",
        "block_counts": f"{tokens} SELECT split, sum(n_tokens)::BIGINT AS tokens, ((sum(n_tokens)::BIGINT - 1) // 512) AS blocks FROM tokens GROUP BY split",
        "buffer_shuffle": f"WITH {_BLOCKS}, {order} SELECT * FROM shuffled",
        "batches_drop_last": f"WITH {_BLOCKS}, {order} SELECT position // 16 AS batch, count(*) AS n, min(block_id) AS least, sum(block_id)::BIGINT AS total FROM shuffled GROUP BY 1 HAVING count(*) = 16",
        "coverage_order": f"WITH {_BLOCKS}, {epochs(2)} SELECT * FROM orders",
        "coverage_cursor": f"WITH {_BLOCKS}, {epochs(8)}, n AS (SELECT count(*) AS n FROM blocks), p AS (SELECT unnest(range(200)) * 37 AS position) SELECT position, epoch, \"offset\", block_id, round(100.0 * \"offset\" / n, 6)::DOUBLE AS percent FROM p, n JOIN orders ON epoch = position // n AND \"offset\" = position % n",
        "eval_chunks": _windows(128, 128),
        "ppl_windows": _windows(128, 64),
        "lr_cosine": _rate("WHEN step > 1000 THEN 3e-5 ELSE 3e-5 + 0.5 * (1 + cos(pi() * (step - 100) / 900.0)) * 2.7e-4"),
        "lr_linear": _rate("WHEN step >= 1000 THEN 3e-5 ELSE 3e-4 - (step - 100) / 900.0 * 2.7e-4"),
        "lr_constant": _rate("ELSE 3e-4"),
        "interval_metrics": "SELECT event_id // 100 AS interval, count(*) AS steps, round(avg(value), 6) AS loss, round(exp(least(avg(value) / 10, 20)), 6) AS perplexity FROM events GROUP BY 1",
        "interval_throughput": """WITH e AS (SELECT event_id // 100 AS interval, count(*) AS documents, round(sum(value), 6) AS tokens, min(ts) AS began FROM events GROUP BY 1), s AS (SELECT *, (epoch_us(began) - epoch_us(lag(began) OVER (ORDER BY interval))) / 1e6 AS seconds FROM e)
 SELECT interval, documents, tokens, seconds::DOUBLE AS seconds, CASE WHEN seconds > 0 THEN round(documents / seconds, 6) END AS documents_per_second FROM s""",
        "eval_mean": "SELECT round(avg(loss), 6) AS loss, count(*) AS batches FROM (SELECT event_id // 16 AS batch, avg(value) AS loss FROM events WHERE event_id < 800 GROUP BY 1) WHERE batch < 50",
        "best_so_far": "SELECT event_type, event_id, round(value, 6) AS value FROM (SELECT *, min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NULL OR value < b",
        "keep_last_n": "SELECT event_type, event_id, age FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC)::INT AS age FROM events) WHERE age <= 5",
        "latest_complete": "SELECT event_type, max(event_id) AS latest FROM events WHERE value IS NOT NULL GROUP BY 1",
        "softmax": f"WITH {_LOGITS} SELECT vec_id, token, round(exp(logit / 0.8) / sum(exp(logit / 0.8)) OVER (PARTITION BY vec_id), 9) AS p FROM logits",
        "top_k": f"WITH {_LOGITS} SELECT vec_id, token, logit FROM logits QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) <= 5",
        "top_p": f"WITH {_LOGITS}, s AS (SELECT vec_id, token, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS p FROM logits) SELECT vec_id, token, round(p, 9) AS p FROM s QUALIFY sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, token ROWS UNBOUNDED PRECEDING) - p <= 0.9",
        "repetition_penalty": f"WITH {_LOGITS} SELECT vec_id, token, round(CASE WHEN token % 9 = vec_id % 9 THEN logit / 1.2 ELSE logit END, 9) AS logit FROM logits",
        "beam_step": f"""WITH {_LOGITS}, l AS (SELECT *, logit - ln(sum(exp(logit)) OVER (PARTITION BY vec_id)) AS lp FROM logits), c AS (SELECT vec_id // 4 AS "group", vec_id, token, round((lp - vec_id % 4) / pow(6.0, 0.7), 9) AS score FROM l)
 SELECT * FROM (SELECT "group", row_number() OVER (PARTITION BY "group" ORDER BY score DESC, vec_id, token)::INT AS beam, vec_id, token, score FROM c) WHERE beam <= 4""",
        "rms_norm": _listed("list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda u: u * u)) / 64 + 1e-5))"),
        "rope": _listed("list_transform(range(64), lambda i: x[i + 1] * cos(vec_id * pow(10000.0, -2.0 * (i % 32) / 64)) + (CASE WHEN i < 32 THEN -x[i + 33] ELSE x[i - 31] END) * sin(vec_id * pow(10000.0, -2.0 * (i % 32) / 64)))"),
        "swiglu": _listed("list_transform(range(32), lambda i: x[i + 1] / (1 + exp(-x[i + 1])) * x[i + 33])", 32),
        "cross_entropy": f"WITH {_VEC} SELECT vec_id, round({_CE}, 8) AS loss FROM vec",
        "token_weighted_nll": f"WITH {_VEC}, c AS (SELECT vec_id % 10 AS chunk, sum({_CE}) AS nll, count({_CE}) AS n FROM vec GROUP BY 1) SELECT round(sum(nll) / sum(n), 8) AS loss, round(exp(least(sum(nll) / sum(n), 20)), 6) AS perplexity, sum(n)::BIGINT AS tokens FROM c",
        "param_counts": "SELECT preset, (32000 * d + layers * (3 * d * d + 3 * d * ff + 2 * d) + d)::BIGINT AS parameters FROM (VALUES ('nano', 4, 256, 1024), ('small', 12, 768, 3072), ('medium', 24, 1024, 4096), ('large', 36, 1280, 5120), ('xl', 48, 1600, 6400)) p(preset, layers, d, ff)",
        "bpe_word_counts": "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n\\t\\r]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1 HAVING count(*) >= 2",
    }
