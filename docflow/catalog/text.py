"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.catalog import base as B
from docflow.functions import records as R
from docflow.functions import structure as S
from docflow.functions import terms as W
from docflow.functions import text as X

col = F.col

TOKENS = r"(CASE WHEN regexp_matches({c}, '\S') THEN CAST(ceil(length({c}) / 4e0) AS BIGINT) ELSE 0 END)"
WS = r"trim(regexp_replace({c}, '[\s\p{Z}]+', ' ', 'g'))"
STRIP = r"regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def tok(c):
    return TOKENS.replace("{c}", c)


def ws(c):
    return WS.replace("{c}", c)


def strip(c):
    return STRIP.replace("{c}", c)


def docs(s, d):
    return B.load(s, d, "documents")


def token_cost(s, d):
    t = X.estimate_tokens(col("text"))
    return docs(s, d).select(
        "doc_id", t.alias("tokens"),
        X.estimate_cost(t, "chat_in").alias("chat_in"), X.estimate_cost(t, "chat_out").alias("chat_out"),
        X.estimate_cost(t, "embedding").alias("embedding"),
    )


def truncations(s, d):
    return docs(s, d).select(
        "doc_id", X.truncate(col("text"), 200).alias("query_text"),
        X.truncate(col("text"), 1000).alias("error_text"), X.truncate(col("text"), 600, "...").alias("preview"),
        X.truncate_to_tokens(col("text"), 512).alias("limited"),
    )


def numbers(s, d):
    x = (col("value") - 50.0) / 7.0
    return B.load(s, d, "events").select(
        "event_id", X.round_half_up(x, 2).alias("r2"), X.round_half_up(x, 4).alias("r4"),
        X.round_half_up(x, 6).alias("r6"),
        X.ratio(col("user_id") % 7, col("event_id") % 5).alias("share"),
    )


def verdicts(s, d):
    text = F.expr(
        """CASE doc_id % 4 WHEN 0 THEN concat('```json', chr(10), '{"faithful": false, "score": 0.', CAST(doc_id % 10 AS STRING), ', "reason": "r', CAST(toxic AS STRING), '"}', chr(10), '```')
        WHEN 1 THEN '{"score": 0.5}' WHEN 2 THEN 'not json' ELSE '```\n{"faithful": true}\n```' END"""
    )
    return B.load(s, d, "labels").select("doc_id", R.parse_verdict(text, "faithful").alias("v")).select(
        "doc_id", "v.*"
    )


WORDS_SQL = r"list_filter(string_split(trim(regexp_replace({c}, '[^\p{L}\p{M}\p{Nl}\p{Nd}]+', ' ', 'g')), ' '), lambda w: length(w) > 0)"


# Words of a query one by one; a word counts if fewer than ten terms came before it.
SEARCH_TERMS_SQL = r"""
WITH w AS (SELECT item_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT item_id, """ + WORDS_SQL.replace("{c}", "text") + r""" AS ws FROM benchmark)),
t AS (SELECT item_id, i, CASE WHEN regexp_matches(w, '\p{Han}') AND length(w) <= 2 THEN [w]
  WHEN regexp_matches(w, '\p{Han}') THEN list_transform(range(1, length(w)), lambda k: substring(w, k, 2))
  WHEN length(w) >= 2 THEN [lower(w)] ELSE [] END AS ts FROM w),
c AS (SELECT item_id, i, ts, coalesce(sum(len(ts)) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
"""

RERANK_TERMS_SQL = r"""
WITH RECURSIVE w AS (SELECT item_id, """ + WORDS_SQL.replace("{c}", "text") + r""" AS ws FROM benchmark),
r AS (SELECT item_id, ws, 1 AS i, CAST([] AS VARCHAR[]) AS acc FROM w
  UNION ALL SELECT item_id, ws, i + 1, list_concat(acc, list_filter((CASE WHEN length(ws[i]) > 2 AND regexp_matches(ws[i], '\p{Han}')
     THEN list_transform(range(1, length(ws[i])), lambda k: substring(ws[i], k, 2)) ELSE [ws[i]] END), lambda t: NOT list_contains(acc, t)))
  FROM r WHERE i <= len(ws)),
f AS (SELECT item_id, arg_max(acc, i) AS terms FROM r GROUP BY item_id)
"""


def search_terms(s, d):
    t = W.search_terms(col("text"))
    return B.load(s, d, "benchmark").select(
        "item_id", F.array_join(F.transform(t, lambda x: F.concat(x, F.lit(":*"))), " | ").alias("tsquery")
    )


def rerank_terms(s, d):
    return B.load(s, d, "benchmark").select(
        "item_id", F.array_join(W.rerank_terms(col("text")), "|").alias("terms")
    )


def lexical(s, d):
    """Every conversation turn against the terms of its own first turn."""
    c = B.load(s, d, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    return c.join(first, "conv_id").select(
        "conv_id", "turn",
        F.round(W.lexical_score(col("text"), W.rerank_terms(col("q"))), 6).alias("score"),
    )


LEXICAL_SQL = r"""
WITH RECURSIVE q AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, """ + WORDS_SQL.replace("{c}", "text") + r""" AS ws FROM q),
r AS (SELECT conv_id, ws, 1 AS i, CAST([] AS VARCHAR[]) AS acc FROM w
  UNION ALL SELECT conv_id, ws, i + 1, CASE WHEN list_contains(acc, ws[i]) THEN acc ELSE list_append(acc, ws[i]) END FROM r WHERE i <= len(ws)),
f AS (SELECT conv_id, arg_max(acc, i) AS terms FROM r GROUP BY conv_id)
SELECT conv_id, turn, round(CASE WHEN len(terms) = 0 OR NOT regexp_matches(text, '\S') THEN 0e0
  ELSE CAST(len(list_filter(terms, lambda t: contains(lower(text), lower(t)))) AS DOUBLE) / len(terms) END, 6) AS score
FROM conversations JOIN f USING (conv_id)"""


def cosine_neighbours(s, d):
    """Every vector with the vector of the next id."""
    e = B.load(s, d, "embeddings")
    nxt = e.select((col("vec_id") - 1).alias("vec_id"), col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(W.cosine(col("embedding"), col("other")), 6).alias("similarity"))


def json_fields(s, d):
    r = B.runs(s, d)
    return r.select(
        "trace_id", R.json_text(col("extra_data"), "answerState").alias("state"),
        R.json_long(col("props"), "k").alias("k"), R.json_long(col("props"), "missing").alias("missing"),
        R.json_long(col("extra_data"), "estimatedChatOutputTokens").alias("text_number"),
        R.json_double(col("extra_data"), "estimatedChatInputCost").alias("cost"),
    )


def json_merged(s, d):
    merged = R.json_merge(
        F.when(col("event_id") % 5 == 0, "broken").otherwise(col("props")),
        F.create_map(F.lit("state"), col("event_type"), F.lit("user"), col("user_id").cast("string")),
    )
    back = F.from_json(merged, "map<string,string>")
    return B.load(s, d, "events").select(
        "event_id", back["k"].alias("k"), back["state"].alias("state"), back["user"].alias("user"),
    )


def chunk_meta(s, d):
    t = S.chunk_traits(col("text"), F.substring_index("text", "\n", 1))
    return B.markdown(s, d).select("doc_id", t.alias("t")).select("doc_id", "t.*")


def line_classes(s, d):
    return B.lines(s, d).select(
        "doc_id", "line_no",
        S.is_heading(F.concat((col("line_no") % 9).cast("string"), F.lit(". "), col("line"))).alias("numbered"),
        S.is_heading(col("line")).alias("plain"),
        S.block_type(F.concat(F.when(col("line_no") % 3 == 0, "- ").when(col("line_no") % 3 == 1, "| x | ").otherwise(""), col("line"), F.when(col("line_no") % 3 == 1, " |").otherwise(""))).alias("kind"),
    )


def table_forms(s, d):
    text = F.replace(col("text"), F.lit(" "), F.lit(" | "))
    return docs(s, d).select("doc_id", S.table_markdown(text).alias("markdown"), S.table_html(text).alias("html"))


CELLS_SQL = r"list_filter(list_transform(string_split(l, '|'), lambda c: regexp_replace(c, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda c: length(c) > 0)"
CELLS2_SQL = r"list_filter(list_transform(regexp_split_to_array(l, '[\s\p{Z}]{2,}'), lambda c: regexp_replace(c, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda c: length(c) > 0)"
TABLES_SQL = rf"""
WITH r AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, ' ', ' | '), chr(10)),
    lambda l: CASE WHEN contains(l, '|') THEN {CELLS_SQL} ELSE {CELLS2_SQL} END), lambda c: len(c) > 0) AS rows FROM documents),
f AS (SELECT doc_id, rows, list_transform(rows[2:], lambda x: list_resize(x, len(rows[1]), '')) AS body FROM r)
SELECT doc_id, CASE WHEN len(rows) > 0 THEN concat('| ', array_to_string(rows[1], ' | '), ' |', chr(10), '| ',
    array_to_string(list_transform(rows[1], lambda x: '---'), ' | '), ' |',
    CASE WHEN len(body) > 0 THEN concat(chr(10), array_to_string(list_transform(body, lambda x: concat('| ', array_to_string(x, ' | '), ' |')), chr(10))) ELSE '' END) END AS markdown,
  CASE WHEN len(rows) > 0 THEN concat('<table><thead><tr>', array_to_string(list_transform(rows[1], lambda x: concat('<th>', x, '</th>')), ''), '</tr></thead>',
    CASE WHEN len(body) > 0 THEN concat('<tbody>', array_to_string(list_transform(body, lambda x: concat('<tr>', array_to_string(list_transform(x, lambda y: concat('<td>', y, '</td>')), ''), '</tr>')), ''), '</tbody>') ELSE '' END, '</table>') END AS html
FROM f"""


def prompts(s, d):
    c = F.split("text", "\n")
    return docs(s, d).select(
        "doc_id", X.fill_prompt("Evidence:\n%s\nQuestion: %s", X.join_contexts(c), F.substring_index("text", ".", 1)).alias("prompt"),
        X.number_contexts(c).alias("numbered"), X.bullet_contexts(c).alias("bullets"),
    )


def retries(s, d):
    t = B.tasks(s, d)
    now = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return t.select(
        "task_id", R.backoff_minutes(col("retry_count")).cast("bigint").alias("backoff"),
        R.claimable(F.when(col("status") == "FAILED", "RUNNING").when(col("status") == "SUCCESS", "QUEUED").otherwise(col("status")), col("create_time"), col("completed_at"), now).alias("claimable"),
        R.duration_ms(col("started_at"), col("completed_at")).alias("took_ms"),
        R.window_hours((col("task_id") % 1000 - 50).cast("int"), 720).cast("bigint").alias("hours"),
    )


def sections(s, d):
    return B.lines(s, d).select(
        "doc_id", "line_no", S.section_id(F.floor(col("line_no") / 40), col("line_no")).alias("section_id"),
        S.path_section_id(col("line")).alias("parent_id"),
    )


ENTRIES: dict[str, B.Entry] = {
    "token_cost": (
        token_cost,
        f"""WITH t AS (SELECT doc_id, {tok('text')} AS tokens FROM documents)
SELECT doc_id, tokens, floor(tokens * 2e-3 / 1e3 * 1e6 + 5e-1) / 1e6 AS chat_in, floor(tokens * 8e-3 / 1e3 * 1e6 + 5e-1) / 1e6 AS chat_out,
  floor(tokens * 1e-4 / 1e3 * 1e6 + 5e-1) / 1e6 AS embedding FROM t""",
    ),
    "whitespace_normalized": (
        lambda s, d: docs(s, d).select("doc_id", X.normalize_ws(col("text")).alias("text")),
        f"SELECT doc_id, {ws('text')} AS text FROM documents",
    ),
    "truncated_texts": (
        truncations,
        f"""SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) ELSE text END AS query_text,
CASE WHEN length(text) > 1000 THEN substring(text, 1, 1000) ELSE text END AS error_text,
CASE WHEN length(text) > 600 THEN concat(substring(text, 1, 600), '...') ELSE text END AS preview,
CASE WHEN {tok('text')} > 512 AND length(text) > 2048 THEN substring(text, 1, 2048) ELSE text END AS limited FROM documents""",
    ),
    "content_hashes": (
        lambda s, d: docs(s, d).select(
            "doc_id", X.content_hash(col("text")).alias("content_hash"),
            X.result_key(col("source"), F.lit(8), col("text")).alias("result_key"),
        ),
        "SELECT doc_id, sha256(text) AS content_hash, concat(source, ':', '8', ':', md5(text)) AS result_key FROM documents",
    ),
    "file_slugs": (
        lambda s, d: B.load(s, d, "pages").select("page_id", X.slug(col("url")).alias("slug")),
        r"""WITH k AS (SELECT page_id, regexp_replace(regexp_replace(url, '[^0-9A-Za-z_\-\x{4e00}-\x{9fff}]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pages)
SELECT page_id, CASE WHEN length(s) > 0 THEN s ELSE 'sample' END AS slug FROM k""",
    ),
    "answer_states": (
        lambda s, d: B.load(s, d, "conversations").select(
            "conv_id", "turn",
            X.answer_state(F.when(col("turn") % 5 == 1, F.concat(F.lit("证据 不足 "), col("text"))).when(col("turn") % 5 == 2, " ").otherwise(col("text"))).alias("state"),
        ),
        r"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 1 THEN concat('证据 不足 ', text) WHEN turn % 5 = 2 THEN ' ' ELSE text END AS a FROM conversations)
SELECT conv_id, turn, CASE WHEN NOT regexp_matches(a, '\S') THEN 'empty_answer' WHEN regexp_matches(regexp_replace(a, '\s+', '', 'g'),
 '无法根据现有知识库|无法根据提供的证据|证据不足|无法确认|未找到相关信息|没有足够信息') THEN 'refused' ELSE 'answered' END AS state FROM a""",
    ),
    "rounded_numbers": (
        numbers,
        """WITH n AS (SELECT event_id, user_id, (value - 50e0) / 7e0 AS x FROM events)
SELECT event_id, floor(x * 1e2 + 5e-1) / 1e2 AS r2, floor(x * 1e4 + 5e-1) / 1e4 AS r4, floor(x * 1e6 + 5e-1) / 1e6 AS r6,
CASE WHEN event_id % 5 > 0 THEN floor(CAST(user_id % 7 AS DOUBLE) / (event_id % 5) * 1e4 + 5e-1) / 1e4 ELSE 0e0 END AS share FROM n""",
    ),
    "search_terms": (
        search_terms,
        SEARCH_TERMS_SQL
        + """SELECT b.item_id, coalesce(string_agg(concat(x.term, ':*'), ' | ' ORDER BY x.i, x.k), '') AS tsquery FROM benchmark b
LEFT JOIN (SELECT item_id, i, unnest(range(len(ts))) AS k, unnest(ts) AS term FROM c) x ON b.item_id = x.item_id GROUP BY b.item_id""",
    ),
    "rerank_terms": (rerank_terms, RERANK_TERMS_SQL + "SELECT item_id, array_to_string(terms, '|') AS terms FROM f"),
    "lexical_scores": (lexical, LEXICAL_SQL),
    "cosine_similarity": (
        cosine_neighbours,
        """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    ),
    "json_fields": (
        json_fields,
        f"""WITH r AS ({B.RUNS_SQL}) SELECT trace_id, json_extract_string(extra_data, '$.answerState') AS state,
coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, CAST(0 AS BIGINT) AS missing,
coalesce(TRY_CAST(json_extract_string(extra_data, '$.estimatedChatOutputTokens') AS BIGINT), 0) AS text_number,
coalesce(TRY_CAST(json_extract_string(extra_data, '$.estimatedChatInputCost') AS DOUBLE), 0e0) AS cost FROM r""",
    ),
    "json_merge": (
        json_merged,
        """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k,
event_type AS state, CAST(user_id AS VARCHAR) AS "user" FROM events""",
    ),
    "judge_scores_parsed": (
        lambda s, d: B.judge(s, d).select("sample_id", "metric", R.parse_score(col("response")).alias("score")),
        rf"""WITH j AS ({B.JUDGE_SQL}), p AS (SELECT sample_id, metric, coalesce(TRY_CAST(regexp_extract(response, '"score"\s*:\s*([0-9.]+)', 1) AS DOUBLE),
TRY_CAST(regexp_extract(response, '分数[：:]\s*([0-9.]+)', 1) AS DOUBLE)) AS x FROM j)
SELECT sample_id, metric, CASE WHEN x IS NULL THEN NULL ELSE greatest(0e0, least(1e0, x)) END AS score FROM p""",
    ),
    "verdicts": (
        verdicts,
        r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN false ELSE true END AS faithful,
CASE doc_id % 4 WHEN 0 THEN CAST(concat('0.', doc_id % 10) AS DOUBLE) WHEN 1 THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS score,
CASE doc_id % 4 WHEN 0 THEN concat('r', toxic) WHEN 2 THEN 'Parse error' ELSE 'Unknown' END AS reason FROM labels""",
    ),
    "chunk_metadata": (
        chunk_meta,
        rf"""WITH m AS ({B.MARKDOWN_SQL}), t AS (SELECT doc_id, {strip('text')} AS b, split_part(text, chr(10), 1) AS h FROM m)
SELECT doc_id, contains(b, '```') AS has_code_block, regexp_matches(b, '(?m)^\|.+\|\s*$') AS has_table, regexp_matches(b, '(?m)^(-|\*|\d+[.])\s+.+$') AS has_list,
CASE WHEN NOT regexp_matches(b, '\S') THEN 'empty' WHEN regexp_matches(b, '(?m)^\|.+\|\s*$') THEN 'table' WHEN contains(b, '```') THEN 'code'
 WHEN regexp_matches(b, '(?m)^(-|\*|\d+[.])\s+.+$') THEN 'list' WHEN regexp_matches(h, '\S') AND starts_with(b, h) THEN 'section' ELSE 'paragraph' END AS segment_type,
CASE WHEN regexp_matches(h, '\S') THEN CAST(greatest(1, length(regexp_extract({strip('h')}, '^(#{{1,6}})\s+(.+)$', 1))) AS INTEGER) END AS heading_level FROM t""",
    ),
    "block_classes": (
        line_classes,
        rf"""WITH l AS ({B.LINES_SQL}), x AS (SELECT doc_id, line_no, line, concat(line_no % 9, '. ', line) AS n,
 concat(CASE line_no % 3 WHEN 0 THEN '- ' WHEN 1 THEN '| x | ' ELSE '' END, line, CASE line_no % 3 WHEN 1 THEN ' |' ELSE '' END) AS b FROM l)
SELECT doc_id, line_no, length(n) <= 80 AND regexp_matches(n, '{S.HEADING}') AS numbered, length(line) <= 80 AND regexp_matches(line, '{S.HEADING}') AS plain,
 CASE WHEN starts_with(b, '```') AND ends_with(b, '```') THEN 'code' WHEN regexp_matches(b, '{S.TABLE_ROW}') THEN 'table'
 WHEN regexp_matches(b, '{S.LIST_ITEM}') THEN 'list' ELSE 'paragraph' END AS kind FROM x""",
    ),
    "table_rendering": (table_forms, TABLES_SQL),
    "prompt_assembly": (
        prompts,
        r"""SELECT doc_id, concat('Evidence:', chr(10), replace(text, chr(10), concat(chr(10), '---', chr(10))), chr(10), 'Question: ', split_part(text, '.', 1)) AS prompt,
array_to_string(list_transform(string_split(text, chr(10)), lambda c, i: concat('[', i, '] ', c, chr(10), chr(10))), '') AS numbered,
array_to_string(list_transform(string_split(text, chr(10)), lambda c: concat('- ', c)), chr(10)) AS bullets FROM documents""",
    ),
    "expected_terms": (
        lambda s, d: docs(s, d).select("doc_id", F.array_join(X.expected_terms(col("text")), "|").alias("terms")),
        rf"""WITH n AS (SELECT doc_id, {ws('text')} AS t FROM documents),
p AS (SELECT doc_id, t, list_filter(list_transform(string_split(replace(t, '?', '.'), '.'), lambda x: trim(x)), lambda x: length(x) > 0) AS parts FROM n)
SELECT doc_id, CASE WHEN length(t) = 0 THEN '' WHEN length(t) <= 180 THEN t WHEN len(parts) = 0 THEN substring(t, 1, 180) ELSE array_to_string(parts[1:3], '|') END AS terms FROM p""",
    ),
    "retry_rules": (
        retries,
        f"""WITH t AS ({B.TASKS_SQL}), u AS (SELECT *, CASE status WHEN 'FAILED' THEN 'RUNNING' WHEN 'SUCCESS' THEN 'QUEUED' ELSE status END AS st FROM t)
SELECT task_id, CAST(CASE retry_count WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 15 END AS BIGINT) AS backoff,
coalesce((st IN ('QUEUED', 'RETRYING') AND create_time <= TIMESTAMP '1998-01-01 00:00:00') OR (st = 'RUNNING' AND completed_at <= TIMESTAMP '1998-01-01 00:00:00'), false) AS claimable,
coalesce(date_diff('millisecond', started_at, completed_at), 0) AS took_ms,
CASE WHEN task_id % 1000 - 50 <= 0 THEN 24 ELSE least(task_id % 1000 - 50, 720) END AS hours FROM u""",
    ),
    "section_ids": (
        sections,
        rf"""WITH l AS ({B.LINES_SQL}) SELECT doc_id, line_no, concat('sec-', CAST(floor(line_no / 40) AS BIGINT), '-', line_no) AS section_id,
CASE WHEN regexp_matches(line, '\S') THEN concat('sec-path-', substring(sha256(line), 1, 16)) END AS parent_id FROM l""",
    ),
}
