"""Chunking, segmentation and parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.catalog import base as B
from docflow.catalog.retrieval import EMBEDDER
from docflow.catalog.text import strip, tok
from docflow.functions.structure import markdown_level, markdown_title
from docflow.operators import chunking as C
from docflow.operators import segments as S
from docflow.operators.markdown import markdown_normalize
from docflow.operators.ordered import lead, ordered, slicing
from docflow.plans.ingest import ingest

col = F.col


def docs(s, d):
    return B.load(s, d, "documents")


def _texts(df):
    return df.select("doc_id", "chunk_index", "content")


FIXED_SQL = """SELECT doc_id, CAST(o // {step} AS INTEGER) AS chunk_index, substring(text, o + 1, {size}) AS content
FROM (SELECT doc_id, text, unnest(range(0, length(text), {step})) AS o FROM documents)"""


def fixed(s, d):
    return C.chunk_fixed(docs(s, d)).select("doc_id", "chunk_index", "content", "segment_type", "has_list")


FIXED_META_SQL = rf"""WITH c AS ({FIXED_SQL.format(step=450, size=500)}), b AS (SELECT *, {strip('content')} AS b FROM c)
SELECT doc_id, chunk_index, content, CASE WHEN NOT regexp_matches(b, '\S') THEN 'empty' WHEN regexp_matches(b, '(?m)^\|.+\|\s*$') THEN 'table' WHEN contains(b, '```') THEN 'code'
 WHEN regexp_matches(b, '(?m)^(-|\*|\d+[.])\s+.+$') THEN 'list' ELSE 'paragraph' END AS segment_type, regexp_matches(b, '(?m)^(-|\*|\d+[.])\s+.+$') AS has_list FROM b"""

PARENT_CHILD_SQL = """WITH p AS (SELECT doc_id, o // 950 AS i, substring(text, o + 1, 1000) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text), 950)) AS o FROM documents)),
c AS (SELECT doc_id, i, 0 AS j, concat(doc_id, ':p', i) AS chunk_id, CAST(NULL AS VARCHAR) AS parent_id, content FROM p
  UNION ALL SELECT doc_id, i, 1 + o // 250, concat(doc_id, ':p', i, ':c', o // 250), concat(doc_id, ':p', i), substring(content, o + 1, 300)
  FROM (SELECT doc_id, i, content, unnest(range(0, length(content), 250)) AS o FROM p))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS chunk_index, chunk_id, parent_id, content, parent_id IS NULL AS is_parent FROM c"""

# Paragraph packing, one step per paragraph: a chunk grows or closes, then the next one starts.
PARAGRAPH_SQL = r"""WITH RECURSIVE m AS ({src}),
b AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n+'), lambda x: regexp_replace(x, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), lambda x: regexp_matches(x, '\S')) AS bs, text FROM m),
u0 AS (SELECT doc_id, unnest(range(len(bs))) AS i, unnest(bs) AS t FROM b),
u1 AS (SELECT doc_id, i, t, length(t) <= 80 AND regexp_matches(t, '{heading}') AS h FROM u0),
u2 AS (SELECT *, max(CASE WHEN h THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS hi FROM u1),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, t, length(t) AS len, hi FROM u2 WHERE NOT h),
mx AS (SELECT doc_id, max(n) AS total FROM u GROUP BY doc_id),
g AS (SELECT doc_id, 1 AS s, 1 AS e, len AS size, 0 AS k, false AS closed FROM u WHERE n = 1
  UNION ALL
  SELECT g.doc_id, CASE WHEN closed THEN greatest(s + 1, e + 1 - {overlap}) ELSE s END, CASE WHEN closed THEN greatest(s + 1, e + 1 - {overlap}) WHEN stop THEN e ELSE e + 1 END,
    CASE WHEN closed THEN nl.len WHEN stop THEN size ELSE size + 2 + un.len END, CASE WHEN closed THEN k + 1 ELSE k END, CASE WHEN closed THEN false ELSE stop END
  FROM (SELECT g.*, total, e >= total AS last FROM g JOIN mx USING (doc_id)) g
  LEFT JOIN u un ON un.doc_id = g.doc_id AND un.n = g.e + 1 LEFT JOIN u nl ON nl.doc_id = g.doc_id AND nl.n = greatest(s + 1, e + 1 - {overlap}),
  LATERAL (SELECT size >= {mx} OR last OR (size + 2 + un.len > {mx} AND size >= {mn}) AS stop) z
  WHERE NOT (closed AND last)),
r AS (SELECT DISTINCT doc_id, s, e, k FROM g WHERE closed),
o AS (SELECT r.doc_id, k, string_agg(t, concat(chr(10), chr(10)) ORDER BY n) AS content, arg_min(hi, n) FILTER (WHERE hi IS NOT NULL) AS hi FROM r JOIN u ON u.doc_id = r.doc_id AND n BETWEEN s AND e GROUP BY r.doc_id, k
  UNION ALL SELECT doc_id, 0, regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), NULL FROM b WHERE doc_id NOT IN (SELECT doc_id FROM u) AND regexp_matches(text, '\S'))
SELECT o.doc_id, CAST(k AS INTEGER) AS chunk_index, content, u0.t AS heading_path
FROM o LEFT JOIN u0 ON u0.doc_id = o.doc_id AND u0.i = hi"""


def _paragraph_sql(src: str, mx: int = 900, overlap: int = 1, mn: int = 180) -> str:
    from docflow.functions.structure import HEADING

    return (
        PARAGRAPH_SQL.replace("{src}", src).replace("{heading}", HEADING).replace("{overlap}", str(overlap))
        .replace("{mx}", str(mx)).replace("{mn}", str(mn))
    )


def _packed(df):
    return df.select("doc_id", "chunk_index", "content", "heading_path")


SENTENCE_SQL = r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([。！？.!?;；])\s*', '\1' || chr(1), 'g'), '\n\s*\n+', chr(1), 'g'), chr(1)) AS ps FROM documents),
k AS (SELECT doc_id, list_filter(list_transform(ps, lambda x: regexp_replace(x, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), lambda x: length(x) >= 1) AS ks FROM p),
h AS (SELECT doc_id, flatten(list_transform(ks, lambda x: list_transform(range(0, length(x), 500), lambda o: substring(x, o + 1, 500)))) AS hs FROM k)
"""


def adjacent(s, d):
    """Similarity of every vector with the next one of the same label."""
    e = B.load(s, d, "embeddings")
    plan = slicing(e, ["label"], ["vec_id"])
    from docflow.functions.terms import cosine

    nxt = ordered(e, plan, _next=lead(col("embedding")))
    return nxt.where(col("_next").isNotNull()).select(
        "label", "vec_id", F.round(cosine(col("embedding"), col("_next")), 6).alias("similarity")
    )


BLOCKS_SQL = rf"""m AS ({B.MARKDOWN_SQL}), bl AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n+'), lambda x: {strip('x')}), lambda x: regexp_matches(x, '\S')) AS bs FROM m),
k AS (SELECT doc_id, CAST(unnest(range(len(bs))) AS INTEGER) AS i, unnest(bs) AS t FROM bl),
l AS (SELECT doc_id, i, t, length(regexp_extract(t, '^(#{{1,6}})\s+(.+)$', 1)) AS level, {strip("regexp_extract(t, '^(#{1,6})\\s+(.+)$', 2)")} AS title,
  CASE WHEN starts_with(t, '```') AND ends_with(t, '```') THEN 'code' WHEN regexp_matches(t, '(?m)^\|.+\|\s*$') THEN 'table' WHEN regexp_matches(t, '(?m)^(-|\*|\d+[.])\s+.+$') THEN 'list' ELSE 'paragraph' END AS kind FROM k)"""
# The heading stack, block by block.
STACK_SQL = f"""WITH RECURSIVE {BLOCKS_SQL},
st AS (SELECT doc_id, -1 AS i, CAST([] AS VARCHAR[]) AS stack FROM bl
  UNION ALL SELECT st.doc_id, l.i, CASE WHEN level > 0 THEN list_append(stack[1:level - 1], title) ELSE stack END FROM st JOIN l ON l.doc_id = st.doc_id AND l.i = st.i + 1),
pa AS (SELECT l.doc_id, l.i, t, level, title, CASE WHEN level > 0 THEN 'heading' ELSE kind END AS type, len(stack) AS depth, CASE WHEN len(stack) > 0 THEN array_to_string(stack, ' > ') END AS path
  FROM l JOIN st ON st.doc_id = l.doc_id AND st.i = l.i)
"""
SEGMENTS_SQL = STACK_SQL + """, fl AS (SELECT *, CASE WHEN type = 'list' AND lag(type) OVER w = 'list' THEN 0 ELSE 1 END AS new FROM pa WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ru AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM fl),
sg AS (SELECT doc_id, run, min(i) AS s, max(i) AS e, arg_min(type, i) AS type, string_agg(t, chr(10) ORDER BY i) AS content, arg_min(path, i) AS path, max(CASE WHEN level > 0 THEN level END) AS level FROM ru GROUP BY doc_id, run)
"""


def blocks(s, d):
    b = F.posexplode(C.text_blocks(col("text"))).alias("block_no", "t")
    rows = B.markdown(s, d).select("doc_id", b)
    return rows.select("doc_id", "block_no", markdown_level(col("t")).alias("level"), markdown_title(col("t")).alias("title"))


def segs(s, d):
    return S.segment_text(B.markdown(s, d)).select(
        "doc_id", "segment_id", "type", "content", "heading_path", "start_order", "end_order", "heading_level",
    )


def runs(s, d):
    """List runs over row segments built without merging: every block its own row."""
    lines = B.lines(s, d).select(
        "doc_id", col("line_no").alias("start_order"), F.when(col("line_no") % 5 > 1, "list").otherwise("paragraph").alias("type"),
        col("line").alias("content"), F.floor(col("line_no") / 8).cast("string").alias("heading_path"),
    )
    return S.merge_list_runs(lines)


RUNS_SQL = f"""WITH l AS ({B.LINES_SQL}), x AS (SELECT doc_id, line_no, line, CASE WHEN line_no % 5 > 1 THEN 'list' ELSE 'paragraph' END AS type, CAST(CAST(floor(line_no / 8) AS BIGINT) AS VARCHAR) AS p FROM l),
f AS (SELECT *, CASE WHEN type = 'list' AND lag(type) OVER w = 'list' AND p = lag(p) OVER w THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM f)
SELECT doc_id, arg_min(type, line_no) AS type, string_agg(line, chr(10) ORDER BY line_no) AS content, arg_min(p, line_no) AS heading_path, min(line_no) AS start_order, max(line_no) AS end_order FROM r GROUP BY doc_id, run"""


def configured(s, d):
    names = ["fixed", "recursive", "Paragraph ", "manual", "parent-child", "semantic", "unknown", ""]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (col("doc_id") % 8 + 1).cast("int"))
    config = F.when(col("doc_id") % 16 < 8, '{"chunkSize": 300, "overlap": "20", "maxChars": 400, "minChunkChars": 50}')
    return C.chunk(B.paragraphs(s, d).withColumn("strategy", name).withColumn("config", config), embedder=EMBEDDER)


def structured(s, d):
    name = F.element_at(F.array(*[F.lit(n) for n in ("paragraph", "paper", "manual", "table")]), (col("doc_id") % 4 + 1).cast("int"))
    docs_ = B.markdown(s, d).withColumn("_how", name)
    return C.chunk_segments(S.segment_documents(docs_, keep=("_how",)), col("_how")).select(
        "doc_id", "chunk_index", "content", "heading_path", "segment_type", "heading_level", "chunk_strategy",
    )


def chunk_rows(s, d):
    info = docs(s, d).select("doc_id", col("source").alias("kb_id"), F.concat(col("lang"), F.lit(".txt")).alias("doc_name"), F.lit("txt").alias("file_type"), F.lit(7).alias("created_by"))
    rows = C.build_chunk_rows(info, C.chunk_fixed(docs(s, d)), "hashing", 64)
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    return rows.select(
        "chunk_id", "kb_id", "doc_id", "chunk_index", "content_hash", "char_count", "token_count", "enabled",
        m("docName").alias("doc_name"), m("segmentType").alias("segment_type"), m("embeddingDimension").alias("dimension"), F.size("metadata").alias("keys"),
    )


def previews(s, d):
    return C.preview(_texts(C.chunk_fixed(docs(s, d))), "chunk_index", None, 20, 100)


def source_files(s, d):
    """Documents as uploads of three types."""
    ext = F.element_at(F.array(F.lit("md"), F.lit("txt"), F.lit("html")), (col("doc_id") % 3 + 1).cast("int"))
    body = F.when(col("doc_id") % 3 == 2, F.concat(F.lit("<h1>T</h1><p>"), F.replace("text", F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))).otherwise(col("text"))
    name = F.element_at(F.array(*[F.lit(n) for n in ("paragraph", "fixed", "manual", "semantic")]), (col("doc_id") % 4 + 1).cast("int"))
    return docs(s, d).select("doc_id", col("source").alias("kb_id"), F.concat_ws(".", col("doc_id").cast("string"), ext).alias("file_name"), body.alias("text"), name.alias("strategy"), F.lit("{}").alias("config"), F.lit(7).alias("created_by"))


def ingested(s, d):
    out = ingest(source_files(s, d), EMBEDDER)
    return out.chunks.join(out.vectors.select("chunk_id", F.size("embedding").alias("dimension")), "chunk_id").select(
        "chunk_id", "doc_id", "chunk_index", "content_hash", "char_count", "token_count", "dimension",
    )


# A page has a navigation list and an advertisement, then an article, which is one block, and a footer without one.
PAGES_SQL = r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(split_part(t, '<article>', 1), '\s+', ' ', 'g') AS head, split_part(split_part(t, '<article>', 2), '</article>', 1) AS body, split_part(t, '</article>', 2) AS foot FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(head, '<li\b[^>]*>', chr(10) || '- ', 'g'), '</?(div|ul)\b[^>]*>', chr(10) || chr(10), 'g') AS head,
  regexp_replace(regexp_replace(body, '</?(p|h1|br)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS body, foot FROM b),
d AS (SELECT page_id, concat(head, chr(10), chr(10), trim(regexp_replace(body, '\s+', ' ', 'g')), chr(10), chr(10), trim(regexp_replace(regexp_replace(foot, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) AS t FROM c),
e AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM d)
SELECT page_id, replace(replace(replace(replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS text FROM e"""

# Every line of the Markdown texts is a block of its own.
MARKED_SQL = r"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT doc_id, i, CASE WHEN i % 11 IN (0, 4, 6) THEN concat(CASE i % 11 WHEN 0 THEN '# ' WHEN 4 THEN '### ' ELSE '## ' END, regexp_replace(line, '\s+#*\s*$', ''), chr(10), chr(10))
  WHEN i % 11 IN (7, 8) THEN concat('- ', trim(line), chr(10), chr(10), chr(10), CASE WHEN i % 11 = 8 THEN chr(10) ELSE '' END) WHEN i % 11 = 9 THEN concat('| a | ', line, ' |', chr(10), chr(10))
  WHEN regexp_matches(line, '\S') THEN concat(trim(line), chr(10), chr(10)) ELSE '' END AS t FROM l)
SELECT doc_id, regexp_replace(string_agg(t, '' ORDER BY i), '^\s+|\s+$', '', 'g') AS text FROM b GROUP BY doc_id"""

# Sentences are added to a chunk while they fit, one step per sentence.
LENGTH_PACKED_SQL = "WITH RECURSIVE " + SENTENCE_SQL.removeprefix("WITH ") + """,
u AS (SELECT doc_id, unnest(range(1, len(hs) + 1)) AS n, unnest(hs) AS t FROM h),
g AS (SELECT doc_id, n, 0 AS k, length(t) AS size FROM u WHERE n = 1
  UNION ALL SELECT u.doc_id, u.n, CASE WHEN size + length(t) > 1500 THEN k + 1 ELSE k END, CASE WHEN size + length(t) > 1500 THEN length(t) ELSE size + 1 + length(t) END
  FROM g JOIN u ON u.doc_id = g.doc_id AND u.n = g.n + 1)
SELECT g.doc_id, CAST(k AS INTEGER) AS chunk_index, string_agg(t, ' ' ORDER BY g.n) AS content FROM g JOIN u ON u.doc_id = g.doc_id AND u.n = g.n GROUP BY g.doc_id, k"""


# A piece that is too long is cut at the first separator and packed again, one separator per step.
_SEPARATORS = "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in C.SEPARATORS) + "]"
RECURSIVE_SQL = f"""WITH RECURSIVE sp AS (SELECT {_SEPARATORS} AS sep),
pc AS (SELECT doc_id, [0] AS path, text AS t, 1 AS level FROM documents WHERE regexp_matches(text, '\\S') OR length(text) > 1000
  UNION ALL
  SELECT doc_id, list_append(path, unnest(range(len(ps)))), unnest(ps), level + 1 FROM (
    SELECT doc_id, path, level, CASE WHEN contains(t, sep[level]) THEN list_filter(list_append(z.packs, z.cur), lambda x: x <> '') ELSE [t] END AS ps
    FROM pc, sp, LATERAL (SELECT list_reduce(list_transform(string_split(t, sep[level]), lambda x: {{'packs': CAST([] AS VARCHAR[]), 'cur': x}}), lambda a, x:
      CASE WHEN a.cur = '' THEN {{'packs': a.packs, 'cur': x.cur}}
        WHEN length(a.cur) + length(sep[level]) + length(x.cur) > 1000 THEN {{'packs': list_append(a.packs, a.cur), 'cur': x.cur}}
        ELSE {{'packs': a.packs, 'cur': concat(a.cur, sep[level], x.cur)}} END) AS z) y
    WHERE length(t) > 1000 AND level <= len(sep)))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS INTEGER) AS chunk_index, t AS content FROM pc, sp WHERE length(t) <= 1000 OR level > len(sep)"""


def _similar_sql(units: str) -> str:
    """Similarity of each unit (doc_id, n, t) with the next one by the hashing embedder."""
    return rf"""tk AS (SELECT doc_id, n, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{Nd}}]+')) AS tok FROM {units}),
th AS (SELECT doc_id, n, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) AS h, count(*) AS c FROM tk GROUP BY ALL),
sl AS (SELECT doc_id, n, h % 64 AS slot, CAST(sum(CASE WHEN (h // 64) % 2 = 0 THEN c ELSE -c END) AS DOUBLE) AS x FROM th GROUP BY ALL),
nm AS (SELECT doc_id, n, sqrt(sum(x * x)) AS norm FROM sl GROUP BY ALL),
dt AS (SELECT a.doc_id, a.n, sum(a.x * b.x) AS dot FROM sl a JOIN sl b ON b.doc_id = a.doc_id AND b.n = a.n + 1 AND b.slot = a.slot GROUP BY ALL),
si AS MATERIALIZED (SELECT u.doc_id, u.n, coalesce(CASE WHEN a.norm * b.norm > 0 THEN dot / (a.norm * b.norm) END, 0e0) AS sim FROM {units} u LEFT JOIN nm a ON a.doc_id = u.doc_id AND a.n = u.n
  LEFT JOIN nm b ON b.doc_id = u.doc_id AND b.n = u.n + 1 LEFT JOIN dt ON dt.doc_id = u.doc_id AND dt.n = u.n)"""


SEMANTIC_SQL = "WITH RECURSIVE " + SENTENCE_SQL.removeprefix("WITH ") + f""", u AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(hs) + 1)) AS n, unnest(hs) AS t FROM h), {_similar_sql('u')},
g AS (SELECT doc_id, n, 0 AS k, length(t) AS size FROM u WHERE n = 1
  UNION ALL SELECT u.doc_id, u.n, CASE WHEN cut THEN k + 1 ELSE k END, CASE WHEN cut THEN length(t) ELSE size + 1 + length(t) END
  FROM g JOIN u ON u.doc_id = g.doc_id AND u.n = g.n + 1 JOIN si ON si.doc_id = g.doc_id AND si.n = g.n, LATERAL (SELECT size >= 100 AND (size + length(t) > 1500 OR sim < 0.5) AS cut) z)
SELECT g.doc_id, CAST(k AS INTEGER) AS chunk_index, string_agg(t, ' ' ORDER BY g.n) AS content FROM g JOIN u ON u.doc_id = g.doc_id AND u.n = g.n GROUP BY g.doc_id, k"""
SEMANTIC_SEGMENT_SQL = SEGMENTS_SQL + f""", u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS n, content AS t, type, s, CASE WHEN regexp_matches(path, '\\S') THEN path ELSE '' END AS path
  FROM sg WHERE type <> 'heading' AND regexp_matches(content, '\\S')), {_similar_sql('u')},
g AS (SELECT doc_id, n, 0 AS k, length(t) AS size, path AS own FROM u WHERE n = 1
  UNION ALL SELECT u.doc_id, u.n, CASE WHEN cut THEN k + 1 ELSE k END, CASE WHEN cut THEN length(t) ELSE size + 2 + length(t) END, CASE WHEN cut OR coalesce(own, '') = '' THEN coalesce(u.path, '') ELSE own END
  FROM g JOIN u ON u.doc_id = g.doc_id AND u.n = g.n + 1 JOIN si ON si.doc_id = g.doc_id AND si.n = g.n,
  LATERAL (SELECT (size >= 100 AND (size + length(t) > 1500 OR sim < 0.5)) OR (coalesce(own, '') <> '' AND coalesce(u.path, '') <> '' AND own <> u.path) AS cut) z),
o AS (SELECT g.doc_id, CAST(k AS INTEGER) AS chunk_index, string_agg(t, concat(chr(10), chr(10)) ORDER BY g.n) AS content, arg_min(NULLIF(path, ''), g.n) AS heading_path, arg_max(type, g.n) AS segment_type,
  concat('seg-', arg_max(s, g.n)) AS segment_id FROM g JOIN u ON u.doc_id = g.doc_id AND u.n = g.n GROUP BY g.doc_id, k)
SELECT *, 'semantic' AS chunk_strategy, CAST(length(content) AS INTEGER) AS char_count, {tok('content')} AS token_count FROM o"""


ENTRIES: dict[str, B.Entry] = {
    "fixed_chunks": (fixed, FIXED_META_SQL),
    "parent_child_chunks": (
        lambda s, d: C.chunk_parent_child(docs(s, d)).select("doc_id", "chunk_index", "chunk_id", "parent_id", "content", "is_parent"),
        PARENT_CHILD_SQL,
    ),
    "paragraph_chunks": (lambda s, d: _packed(C.chunk_paragraph(B.paragraphs(s, d))), _paragraph_sql(B.PARAGRAPHS_SQL)),
    "paragraph_chunks_headings": (
        lambda s, d: _packed(C.chunk_paragraph(B.markdown(s, d), 400, 2, 100)), _paragraph_sql(B.MARKDOWN_SQL, 400, 2, 100),
    ),
    "structured_chunks": (structured, None),
    "recursive_chunks": (lambda s, d: _texts(C.chunk_recursive(docs(s, d))), RECURSIVE_SQL),
    "semantic_chunks": (lambda s, d: _texts(C.chunk_semantic(docs(s, d), EMBEDDER)), SEMANTIC_SQL),
    "semantic_segment_chunks": (
        lambda s, d: C.chunk_semantic_segments(S.segment_documents(B.markdown(s, d)), EMBEDDER), SEMANTIC_SEGMENT_SQL,
    ),
    "length_packed_chunks": (lambda s, d: _texts(C.chunk_pack(docs(s, d))), LENGTH_PACKED_SQL),
    "sentences": (
        lambda s, d: C.split_sentences(docs(s, d)),
        SENTENCE_SQL + "SELECT doc_id, CAST(unnest(range(len(hs))) AS INTEGER) AS sentence_no, unnest(hs) AS sentence FROM h",
    ),
    "configured_chunks": (configured, None),
    "chunk_rows": (
        chunk_rows,
        rf"""WITH c AS ({FIXED_META_SQL}) SELECT concat(c.doc_id, ':', chunk_index) AS chunk_id, source AS kb_id, c.doc_id, chunk_index, sha256(content) AS content_hash, length(content) AS char_count,
{tok('content')} AS token_count, 1 AS enabled, concat(lang, '.txt') AS doc_name, segment_type, '64' AS dimension, 10 AS keys FROM c JOIN documents d ON d.doc_id = c.doc_id""",
    ),
    "chunk_preview": (
        previews,
        f"""WITH c AS ({FIXED_SQL.format(step=450, size=500)}) SELECT doc_id, chunk_index, CASE WHEN length(content) > 600 THEN concat(substring(content, 1, 600), '...') ELSE content END AS content FROM c WHERE chunk_index < 20""",
    ),
    "adjacent_similarity": (
        adjacent,
        """WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS a, lead(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT label, vec_id, round(list_cosine_similarity(a, b), 6) AS similarity FROM e WHERE b IS NOT NULL""",
    ),
    "heading_paths": (
        lambda s, d: S.heading_paths(blocks(s, d)),
        STACK_SQL + "SELECT doc_id, i AS block_no, CAST(level AS INTEGER) AS level, title, path AS heading_path, CAST(depth AS INTEGER) AS depth FROM pa",
    ),
    "list_runs": (runs, RUNS_SQL),
    "text_segments": (
        segs,
        SEGMENTS_SQL + "SELECT doc_id, concat('seg-', s) AS segment_id, type, content, path AS heading_path, s AS start_order, e AS end_order, CAST(level AS INTEGER) AS heading_level FROM sg",
    ),
    "html_pages": (lambda s, d: S.html_to_markdown(B.load(s, d, "pages")), PAGES_SQL),
    "markdown_texts": (lambda s, d: markdown_normalize(B.markdown(s, d)), MARKED_SQL),
    "ingested_chunks": (ingested, None),
}
