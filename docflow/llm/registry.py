"""Registered queries of this package and their SQL twins, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docflow.llm import alignment, bpe, chat, exact_dedup, langid, licenses, line_dedup, manifest, mixing, ngram_join, quality, suffix_dedup, url_lists

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tools that the calls of the test conversations name, and one that nobody knows.
SCHEMAS = {
    "search": {"properties": {"query": "string", "limit": "integer"}, "required": ["query"]},
    "lookup": {"properties": {"query": "string", "exact": "boolean"}, "required": ["query"]},
    "calc": {"properties": {"expression": "string", "limit": "integer"}, "required": ["expression"], "additional": True},
}
# Every assistant turn is a call; it waits for two earlier ones. Every later user turn answers the turn before.
CALLS = """SELECT conv_id, turn, concat('c', turn) AS call_id,
  CASE turn % 8 WHEN 1 THEN 'search' WHEN 3 THEN 'lookup' WHEN 5 THEN 'calc' ELSE 'other' END AS name,
  CASE (conv_id + turn) % 6 WHEN 0 THEN {limit} WHEN 1 THEN {quoted} WHEN 2 THEN text WHEN 3 THEN {exact} ELSE {plain} END AS arguments,
  CASE WHEN turn > 2 THEN array(concat('c', 2 * {div8} + 1), concat('c', 2 * {div6} + 1))
    WHEN conv_id % 11 = 0 THEN array('c3') END AS after
FROM {conversations} WHERE role = 'assistant'"""
RESULTS = """SELECT conv_id, turn, CASE WHEN role = 'user' THEN concat('c', turn - 1) ELSE concat('s', turn) END AS call_id, text AS content
FROM {conversations} WHERE role = 'system' OR role = 'user' AND turn > 0"""


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    calls = spark.sql(
        CALLS.format(
            limit="to_json(struct(turn % 7 AS limit))", quoted="to_json(struct(text AS query, string(turn % 7) AS limit))",
            exact="to_json(struct(text AS query, true AS exact))", plain="to_json(struct(text AS query, turn % 7 AS limit))",
            div8="((turn - 2) div 8)", div6="((turn - 1) div 6)", conversations="{conversations}",
        ),
        conversations=turns,
    )
    return chat.link_tool_calls(calls, spark.sql(RESULTS, conversations=turns), SCHEMAS)


OP1_SQL = (
    "WITH RECURSIVE calls AS ("
    + CALLS.replace("array(", "list_value(").format(
        limit="concat('{\"limit\":', turn % 7, '}')", quoted="concat('{\"query\":', to_json(text), ',\"limit\":\"', turn % 7, '\"}')",
        exact="concat('{\"query\":', to_json(text), ',\"exact\":true}')",
        plain="concat('{\"query\":', to_json(text), ',\"limit\":', turn % 7, '}')",
        div8="((turn - 2) // 8)", div6="((turn - 1) // 6)", conversations="conversations",
    )
    + "), results AS (" + RESULTS.format(conversations="conversations") + """),
one AS (SELECT conv_id, call_id, arg_min(struct_pack(turn, name, arguments, after), (turn, name, arguments)) AS c, count(*) AS copies
  FROM calls WHERE conv_id IS NOT NULL AND call_id IS NOT NULL GROUP BY ALL),
asked AS (SELECT conv_id, call_id, copies, c.turn, c.name, c.arguments, c.after FROM one),
answered AS (SELECT conv_id, call_id, arg_min(struct_pack(turn, content), (turn, content)) AS r
  FROM results WHERE conv_id IS NOT NULL AND call_id IS NOT NULL GROUP BY ALL),
wanted AS (SELECT DISTINCT conv_id, call_id, unnest(after) AS before FROM asked),
edges AS (SELECT w.* FROM wanted w JOIN asked a ON a.conv_id = w.conv_id AND a.call_id = w.before WHERE w.before <> w.call_id),
depth AS (
  SELECT conv_id, call_id, 0 AS level FROM asked
  UNION
  SELECT e.conv_id, e.call_id, d.level + 1 FROM depth d JOIN edges e ON e.conv_id = d.conv_id AND e.before = d.call_id WHERE d.level < 60),
-- a cycle reaches the bound of the recursion, and what is behind it too
levels AS (SELECT conv_id, call_id, max(level)::INT AS level FROM depth GROUP BY ALL HAVING max(level) < 60),
parsed AS (
  SELECT a.*, l.level, CASE WHEN json_valid(arguments) THEN arguments::JSON END AS j
  FROM asked a LEFT JOIN levels l USING (conv_id, call_id)),
fields AS (
  SELECT *, json_type(j, '$.query') AS q, json_type(j, '$.limit') AS l, json_type(j, '$.exact') AS x, json_type(j, '$.expression') AS e
  FROM parsed),
judged AS (
  SELECT *, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'bad_json'
    WHEN name NOT IN ('search', 'lookup', 'calc') THEN 'unknown_tool'
    ELSE array_to_string(list_sort(list_filter([
      CASE WHEN name IN ('search', 'lookup') AND q IS NULL THEN 'missing:query' END,
      CASE WHEN name IN ('search', 'lookup') AND q <> 'VARCHAR' THEN 'type:query' END,
      CASE WHEN name IN ('search', 'calc') AND l NOT IN ('UBIGINT', 'BIGINT') THEN 'type:limit' END,
      CASE WHEN name = 'lookup' AND x <> 'BOOLEAN' THEN 'type:exact' END,
      CASE WHEN name = 'calc' AND e IS NULL THEN 'missing:expression' END,
      CASE WHEN name = 'calc' AND e <> 'VARCHAR' THEN 'type:expression' END,
      CASE WHEN name = 'lookup' AND l IS NOT NULL THEN 'extra:limit' END,
      CASE WHEN name = 'search' AND x IS NOT NULL THEN 'extra:exact' END], lambda f: f IS NOT NULL)), ',') END AS errors
  FROM fields),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, r.r.turn AS result_turn, c.name,
    c.level, c.copies, c.errors, c.call_id IS NOT NULL AS is_call, r.call_id IS NOT NULL AS is_result,
    CASE WHEN j IS NOT NULL THEN concat('{', array_to_string(list_filter([
      CASE WHEN x IS NOT NULL THEN concat('"exact":', j->'$.exact') END, CASE WHEN l IS NOT NULL THEN concat('"limit":', j->'$.limit') END,
      CASE WHEN q IS NOT NULL THEN concat('"query":', j->'$.query') END], lambda f: f IS NOT NULL), ','), '}')
      WHEN arguments IS NOT NULL THEN to_json(arguments)::VARCHAR ELSE 'null' END AS args, r.r.content AS content
  FROM judged c FULL JOIN answered r ON r.conv_id = c.conv_id AND r.call_id = c.call_id)
SELECT conv_id, call_id, turn, result_turn, name, level, copies, errors,
  CASE WHEN NOT is_call THEN 'orphan_result' WHEN level IS NULL THEN 'cycle' WHEN errors <> '' THEN 'invalid'
    WHEN NOT is_result THEN 'no_result' WHEN result_turn <= turn THEN 'early_result' ELSE 'ok' END AS status,
  concat('{"arguments":', args, ',"id":', to_json(call_id), ',"name":', coalesce(to_json(name)::VARCHAR, 'null'), ',"result":',
    coalesce(to_json(content)::VARCHAR, 'null'), '}') AS json,
  CASE WHEN level IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, level IS NULL ORDER BY level, turn, call_id) - 1 END AS position
FROM linked"""
)


# Every page is a capture, and an event that lists its host or the domain above it, or takes it off.
CAPTURES = """SELECT page_id, url, {captured} AS fetched_at FROM {pages}"""
EVENTS = """SELECT CASE page_id % 4 WHEN 0 THEN 'malware' WHEN 1 THEN 'spam' WHEN 2 THEN 'adult' ELSE 'trusted' END AS list,
  CASE WHEN page_id % 20 = 7 THEN regexp_replace({host}, '^[^.]+[.]', '') ELSE {host} END AS domain,
  {day} AS day, page_id % 3 <> 0 AS listed, concat('k', page_id % 5) AS category FROM {pages}"""


def op2_dated_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = "lower(regexp_extract(url, '://([^/?#:]+)', 1))"
    captures = CAPTURES.format(captured="timestamp_seconds(1704067200 + page_id * 41231 % 31536000)", pages="{pages}")
    events = EVENTS.format(host=host, day="date_add(date'2024-01-01', cast(page_id * 7919 % 365 AS int))", pages="{pages}")
    return url_lists.judge_captures(
        spark.sql(captures, pages=pages), spark.sql(events, pages=pages), ["malware", "spam", "adult"], ["trusted"]
    )


_HOST = "lower(regexp_extract(url, '://([^/?#:]+)', 1))"
OP2_SQL = (
    "WITH captures AS (" + CAPTURES.format(captured="make_timestamp((1704067200 + page_id * 41231 % 31536000) * 1000000)", pages="pages")
    + "), events AS (" + EVENTS.format(host=_HOST, day="date '2024-01-01' + (page_id * 7919 % 365)::INT", pages="pages") + """),
daily AS (SELECT list, domain, day, max((listed, category)) AS s FROM events WHERE domain IS NOT NULL AND day IS NOT NULL GROUP BY ALL),
intervals AS (
  SELECT list, domain, s[1] AS listed, day AS valid_from, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS valid_to FROM daily),
seen AS (SELECT page_id, coalesce(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '') AS host, fetched_at::DATE AS day FROM captures),
met AS (
  SELECT s.page_id, i.list, i.domain FROM seen s JOIN intervals i
  ON (s.host = i.domain OR ends_with(s.host, concat('.', i.domain))) AND contains(i.domain, '.')
  AND i.listed AND s.day >= i.valid_from AND (i.valid_to IS NULL OR s.day < i.valid_to)),
verdict AS (
  SELECT page_id, count(*) AS n_entries, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists,
    arg_max(domain, (length(domain), list = 'trusted', domain)) AS decided_by,
    arg_max(list = 'trusted', (length(domain), list = 'trusted', domain)) AS kept
  FROM met GROUP BY page_id)
SELECT s.page_id, s.host, s.day, coalesce(v.n_entries, 0) AS n_entries, coalesce(v.lists, '') AS lists, v.decided_by,
  coalesce(v.kept, true) AS kept
FROM seen s LEFT JOIN verdict v USING (page_id)"""
)


def op3_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def op4_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_suffix_automaton_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(table(spark, sf_dir, "documents")).drop("spans")


def op9_min_cost_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


# The level at which weighted sources use up the share: sources whose limit lies below it stop there.
OP9_SQL = """WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5(concat('mix-', doc_id)) AS draw FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2.0 * source_size / weight AS stop,
    coalesce(sum(2.0 * source_size) OVER low, 0) AS stopped, sum(weight) OVER () - coalesce(sum(weight) OVER low, 0) AS free,
    1.5 * sum(source_size) OVER () AS total
  FROM sources WINDOW low AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT (total - stopped) / free AS height FROM ranked WHERE (total - stopped) / free <= stop
  ORDER BY stop, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, round(least(2.0 * source_size, weight * height), 6)::DOUBLE AS target
  FROM sources, level),
ordered AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS quota,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
  (quota // source_size) * size + greatest(0, least(size, quota % source_size - ahead)) END::BIGINT AS taken
FROM ordered"""


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokens(table(spark, sf_dir, "documents"), a, b)


def op12_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


OP12_SQL = """WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS key FROM lines),
judged AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM keyed),
words AS (SELECT doc_id, pos // 64 AS word, 18446744073709551615::HUGEINT - sum(1::HUGEINT << (pos % 64)) AS keep
  FROM judged WHERE gone GROUP BY ALL),
maps AS (SELECT doc_id, string_agg(concat(word, ':', lpad(lower(hex(keep::UBIGINT)), 16, '0')), ',' ORDER BY word) AS keep_words
  FROM words GROUP BY doc_id),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id)
SELECT kept.*, coalesce(keep_words, '') AS keep_words FROM kept LEFT JOIN maps USING (doc_id)"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents")).drop("proof")


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen({0}::VARCHAR), ':', {0}) END"
_LEAF = "sha256(concat(" + ", ".join(map(_FIELD.format, ("doc_id", "source", "lang", "{n}", "text"))) + "))"
# The CRC of a decimal number, bit by bit: there is no such function.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
  lambda x, _: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""
OP13_SQL = (
    "WITH RECURSIVE hashed AS (SELECT doc_id, lang, " + _LEAF.format(n="n_chars") + " AS leaf, CASE WHEN " + _CRC
    + " % 7 = 0 AND n_chars IS NOT NULL THEN " + _LEAF.format(n="(n_chars + 1)") + """ END AS other FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
  count(*) OVER (PARTITION BY lang) AS n FROM hashed),
up AS (
  SELECT lang, 0 AS level, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1
  GROUP BY lang, level, n, idx // 2),
subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
over_all AS (
  SELECT 0 AS level, idx, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM over_all WHERE n > 1
  GROUP BY level, n, idx // 2),
below AS (SELECT DISTINCT lang, level FROM up WHERE n > 1),
above AS (SELECT DISTINCT level FROM over_all WHERE n > 1),
steps AS (
  SELECT l.lang, l.idx, b.level, (l.idx >> b.level) & 1 AS side, u.digest AS sibling
  FROM leaves l JOIN below b ON b.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN up u ON u.lang IS NOT DISTINCT FROM l.lang AND u.level = b.level AND u.idx = xor(l.idx >> b.level, 1)
  UNION ALL
  SELECT l.lang, l.idx, 1000 + a.level, (s.idx >> a.level) & 1, o.digest
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN above a ON true
  LEFT JOIN over_all o ON o.level = a.level AND o.idx = xor(s.idx >> a.level, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang, idx ORDER BY level) AS step FROM steps),
folded AS (
  SELECT lang, idx, 0::BIGINT AS step, coalesce(other, leaf) AS digest FROM leaves
  UNION ALL
  SELECT f.lang, f.idx, s.step, sha256(CASE WHEN sibling IS NULL THEN digest WHEN side = 1 THEN concat(sibling, digest)
    ELSE concat(digest, sibling) END)
  FROM folded f JOIN numbered s ON s.lang IS NOT DISTINCT FROM f.lang AND s.idx = f.idx AND s.step = f.step + 1),
ends AS (SELECT lang, idx, arg_max(digest, step) AS folded_root FROM folded GROUP BY ALL),
proofs AS (SELECT lang, idx, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM numbered GROUP BY ALL)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root,
  e.folded_root = r.digest AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT digest FROM over_all WHERE n = 1) r ON true
JOIN ends e ON e.lang IS NOT DISTINCT FROM l.lang AND e.idx = l.idx
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.idx = l.idx"""
)


ENTRIES = {
    "op1_tool_calls": (op1_tool_calls, OP1_SQL),
    "op2_dated_url_lists": (op2_dated_url_lists, OP2_SQL),
    "op3_grace_dedup": (op3_grace_dedup, OP3_SQL),
    "op4_multi_order_jaccard": (op4_multi_order_jaccard, None),
    "op5_bpe_transducer": (op5_bpe_transducer, None),
    "op6_divergence_rules": (op6_divergence_rules, None),
    "op7_naive_bayes_language": (op7_naive_bayes_language, None),
    "op8_suffix_automaton_licenses": (op8_suffix_automaton_licenses, None),
    "op9_min_cost_mix": (op9_min_cost_mix, OP9_SQL),
    "op10_suffix_array_dedup": (op10_suffix_array_dedup, None),
    "op11_pair_alignment": (op11_pair_alignment, None),
    "op12_line_bitmaps": (op12_line_bitmaps, OP12_SQL),
    "op13_merkle_manifest": (op13_merkle_manifest, OP13_SQL),
}
