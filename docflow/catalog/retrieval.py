"""Search, fusion, re-ranking and context queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docflow.catalog import base as B
from docflow.catalog.text import SEARCH_TERMS_SQL, WORDS_SQL
from docflow.hooks import HashingEmbedder, embed_once
from docflow.operators import retrieval as R
from docflow.operators import tables as T
from docflow.plans.retrieve import retrieve
from docflow.session import MAX_BROADCAST_ROWS, at_most

col = F.col
EMBEDDER = HashingEmbedder()


def vec_queries(s, d):
    return B.load(s, d, "embeddings").select(col("vec_id").alias("query_id"), "embedding", "label")


def vec_chunks(s, d):
    return B.load(s, d, "embeddings").select(col("vec_id").alias("chunk_id"), "embedding", "label")


def key_queries(s, d):
    return B.load(s, d, "benchmark").select(col("item_id").alias("query_id"), col("text").alias("query"))


def key_chunks(s, d):
    return B.load(s, d, "documents").select(
        col("doc_id").alias("chunk_id"), col("text").alias("content"), "doc_id",
        F.lit(0).alias("chunk_index"), F.concat(F.lit("doc-"), col("doc_id").cast("string")).alias("doc_name"),
        F.lit(None).cast("string").alias("heading_path"), F.lit("paragraph").alias("segment_type"), "source",
    )


def _shown(df):
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def vector_hits(s, d, k=8):
    return R.vector_topk(vec_queries(s, d), vec_chunks(s, d), k)


def keyword_hits(s, d, k=8):
    return R.keyword_topk(key_queries(s, d), key_chunks(s, d), k)


VECTOR_SQL = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
vh AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.e, b.e), 12) AS s FROM v a, v b WHERE {cond}),
vr AS (SELECT query_id, chunk_id, s AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS INTEGER) AS rank FROM vh QUALIFY rank <= {k})
"""
KEYWORD_SQL = (
    SEARCH_TERMS_SQL
    + r""", q0 AS (SELECT item_id AS query_id, list_distinct(flatten(list(ts))) AS ts FROM c GROUP BY item_id),
q AS (SELECT query_id, t.term, substring(t.term, 1, 2) AS head FROM q0, unnest(list_filter(ts, lambda t: len(list_filter(ts, lambda u: u <> t AND starts_with(t, u))) = 0)) AS t(term)),
k AS (SELECT doc_id AS chunk_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda t: length(t) > 0)) AS token FROM documents),
kc AS (SELECT chunk_id, token, count(*) AS n FROM k GROUP BY ALL),
kh AS (SELECT query_id, chunk_id, CAST(sum(n) AS BIGINT) AS m FROM kc JOIN q ON substring(token, 1, 2) = head AND starts_with(token, term) GROUP BY ALL),
ks AS (SELECT query_id, chunk_id, (1e-1 * m) / (1e0 + 1e-1 * m) AS score FROM kh),
kr AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM ks QUALIFY rank <= {k})
"""
)


def few(s, d, k=20):
    """k hits per question: counting the questions bounds the hits."""
    return at_most(key_queries(s, d), MAX_BROADCAST_ROWS // k)


def rrf(s, d):
    """Two keyword lists per question: its own, and one for a rewrite without its first word. One pass finds both."""
    q = key_queries(s, d)
    both = q.select((col("query_id") * 2).alias("query_id"), "query").unionByName(
        q.select((col("query_id") * 2 + 1).alias("query_id"), F.regexp_replace("query", r"^\S+\s*", "").alias("query"))
    )
    hits = R.keyword_topk(both, key_chunks(s, d), 20)
    legs = hits.withColumn("leg", (col("query_id") % 2).cast("int")).withColumn("query_id", F.floor(col("query_id") / 2))
    return R.rrf_fuse(legs, 10).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "first_leg", F.round("first_score", 6).alias("first_score"), "lists",
    )


_SHORT = KEYWORD_SQL.replace("FROM benchmark", "FROM (SELECT item_id, regexp_replace(text, '^\\S+\\s*', '') AS text FROM benchmark)")


def _renamed(sql: str, suffix: str) -> str:
    """Second copy of the keyword CTEs under other names."""
    body = sql.strip().removeprefix("WITH ")
    for n in ("w", "t", "c", "q0", "q", "k", "kc", "kh", "ks", "kr"):
        body = re.sub(rf"(^|, ?\n|,\s){n} AS \(", lambda m, n=n: f"{m.group(1)}{n}{suffix} AS (", body)
        body = re.sub(rf"\b(FROM|JOIN) {n}\b(?!\()", lambda m, n=n: f"{m.group(1)} {n}{suffix}", body)
    return body


RRF_SQL = (
    KEYWORD_SQL.replace("{k}", "20") + ", " + _renamed(_SHORT.replace("{k}", "20"), "2")
    + """, l AS (SELECT query_id, chunk_id, score, rank, 0 AS leg FROM kr UNION ALL SELECT query_id, chunk_id, score, rank, 1 FROM kr2),
f AS (SELECT query_id, chunk_id, round(sum(1e0 / (60 + rank)), 12) AS s, min(leg) AS first_leg, arg_min(score, leg) AS fs, count(*) AS lists FROM l GROUP BY ALL)
SELECT query_id, chunk_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS INTEGER) AS rank, first_leg, round(fs, 6) AS first_score, lists FROM f QUALIFY rank <= 10"""
)


def lexical_rerank(s, d):
    hits = R.attach_chunks(keyword_hits(s, d, 20), key_chunks(s, d), small=few(s, d)).join(key_queries(s, d), "query_id")
    return _shown(R.rerank_lexical(hits, 8))


RERANK_SQL = (
    KEYWORD_SQL.replace("WITH w", "WITH RECURSIVE w").replace("{k}", "20")
    + r""", rw AS (SELECT item_id, """ + WORDS_SQL.replace("{c}", "text") + r""" AS ws FROM benchmark),
rr AS (SELECT item_id, ws, 1 AS i, CAST([] AS VARCHAR[]) AS acc FROM rw
  UNION ALL SELECT item_id, ws, i + 1, CASE WHEN list_contains(acc, ws[i]) THEN acc ELSE list_append(acc, ws[i]) END FROM rr WHERE i <= len(ws)),
rf AS (SELECT item_id, arg_max(acc, i) AS terms FROM rr GROUP BY item_id),
b AS (SELECT query_id, chunk_id, kr.score * 8e-1 + CAST(len(list_filter(terms, lambda t: contains(lower(text), lower(t)))) AS DOUBLE) / len(terms) * 2e-1 AS s
  FROM kr JOIN rf ON rf.item_id = query_id JOIN documents ON doc_id = chunk_id)
SELECT query_id, chunk_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS INTEGER) AS rank FROM b QUALIFY rank <= 8"""
)


def length_scorer(queries, contents):
    """Stand-in for a remote scorer; it rejects one kind of query."""
    if any("?" in q for q in queries):
        raise ValueError("unsupported")
    return [1.0 / (1 + len(c)) for c in contents]


def external_rerank(s, d):
    hits = R.attach_chunks(keyword_hits(s, d, 20), key_chunks(s, d), small=few(s, d)).join(key_queries(s, d), "query_id")
    return _shown(R.rerank_with(hits, length_scorer, 8)).withColumn("score", F.round("score", 6))


EXTERNAL_SQL = (
    KEYWORD_SQL.replace("{k}", "20")
    + """, b AS (SELECT query_id, chunk_id, 1e0 / (1 + length(text)) AS s FROM kr JOIN documents ON doc_id = chunk_id)
SELECT query_id, chunk_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS INTEGER) AS rank FROM b QUALIFY rank <= 8"""
)


def line_chunks(s, d):
    return B.lines(s, d).select(
        "doc_id", col("line_no").cast("int").alias("chunk_index"),
        F.concat_ws(":", col("doc_id").cast("string"), col("line_no").cast("string")).alias("chunk_id"), col("line").alias("content"),
    )


def line_hits(s, d):
    """Long lines of a document are hits of the query named by its language."""
    return B.lines(s, d).where(F.length("line") > 400).join(B.load(s, d, "documents").select("doc_id", col("lang").alias("query_id")), "doc_id").select(
        "query_id", "doc_id", col("line_no").cast("int").alias("chunk_index"), F.lit(0.5).alias("score"),
    )


def window(s, d):
    return R.expand_window(line_hits(s, d), line_chunks(s, d), 2)


def parents(s, d):
    c = line_chunks(s, d)
    hits = c.select(
        col("doc_id").alias("query_id"), "chunk_id", "content", (F.lit(1.0) / (1 + col("chunk_index"))).alias("score"),
        F.when(col("chunk_index") % 3 > 0, F.concat_ws(":", col("doc_id").cast("string"), (col("chunk_index") + col("chunk_index") % 5 - 2).cast("string"))).alias("parent_id"),
    )
    return R.expand_parent(hits, c).withColumn("score", F.round("score", 6))


PARENT_SQL = f"""WITH l AS ({B.LINES_SQL}), c AS (SELECT doc_id, line_no, concat(doc_id, ':', line_no) AS chunk_id, line AS content FROM l),
h AS (SELECT doc_id AS query_id, chunk_id, content, 1e0 / (1 + line_no) AS score, CASE WHEN line_no % 3 > 0 THEN concat(doc_id, ':', line_no + line_no % 5 - 2) END AS parent_id FROM c)
SELECT query_id, CASE WHEN p.chunk_id IS NOT NULL THEN h.parent_id ELSE h.chunk_id END AS chunk_id, coalesce(p.content, h.content) AS content, round(score, 6) AS score,
p.chunk_id IS NOT NULL AS is_parent, CAST(p.line_no AS INTEGER) AS parent_index FROM h LEFT JOIN c p ON p.chunk_id = h.parent_id"""


def citations(s, d):
    meta = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("docId", "docName", "chunkIndex", "segmentType", "headingLevel")]),
        F.array(col("doc_id").cast("string"), col("source"), F.when(col("doc_id") % 5 == 0, "x1").otherwise((col("doc_id") % 9).cast("string")), F.lit("paragraph"), F.lit(" ")),
    )
    hits = B.load(s, d, "documents").select(col("lang").alias("query_id"), col("doc_id").alias("chunk_id"), col("text").alias("content"), F.lit(0.25).alias("score"), meta.alias("metadata"))
    return R.to_citations(hits)


def evidence(s, d):
    hits = B.lines(s, d).join(B.load(s, d, "documents").select("doc_id", "source", "lang"), "doc_id").select(
        col("doc_id").alias("query_id"), F.concat(F.lit("c"), col("line_no").cast("string")).alias("chunk_id"), col("line").alias("content"),
        F.when(col("line_no") % 4 > 0, col("source")).alias("doc_name"), F.when(col("line_no") % 3 > 0, col("line_no")).alias("chunk_index"),
        F.when(col("line_no") % 2 > 0, col("lang")).otherwise(" ").alias("heading_path"), F.when(col("line_no") % 5 > 0, "table").alias("segment_type"), (col("line_no") + 1).alias("rank"),
    )
    return R.evidence_context(hits, 8)


EVIDENCE_SQL = f"""WITH l AS ({B.LINES_SQL}), h AS (SELECT l.doc_id, line_no, concat('[', CASE WHEN line_no % 3 > 0 THEN CAST(line_no + 1 AS VARCHAR) ELSE concat('c', line_no) END, '] ',
 CASE WHEN line_no % 4 > 0 THEN source ELSE 'Unknown Document' END, CASE WHEN line_no % 5 > 0 THEN ' <table>' ELSE '' END, CASE WHEN line_no % 2 > 0 THEN concat(' ', lang) ELSE '' END, chr(10), line) AS b
 FROM l JOIN documents d ON d.doc_id = l.doc_id WHERE line_no < 8)
SELECT doc_id AS query_id, string_agg(b, concat(chr(10), chr(10)) ORDER BY line_no) AS context, count(*) AS blocks FROM h GROUP BY doc_id"""


def rewrites(s, d):
    c = B.load(s, d, "documents").select(col("doc_id").alias("query_id"), F.substring_index("text", "\n", 1).alias("query"), col("text").alias("response"))
    return R.rewrite_list(c, 4)


REWRITE_SQL = r"""WITH q AS (SELECT doc_id AS query_id, split_part(text, chr(10), 1) AS query,
 list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), lambda l: regexp_matches(l, '\S')) AS ls FROM documents),
a AS (SELECT query_id, CASE WHEN regexp_matches(query, '\S') THEN list_concat([query], list_filter(ls, lambda l: l <> query)[1:3]) ELSE [query] END AS qs FROM q)
SELECT query_id, CAST(unnest(range(len(qs))) AS INTEGER) AS rewrite_no, unnest(qs) AS query FROM a"""


def embedded_once(s, d):
    """Every turn gets the vector of its text; copies share one."""
    c = embed_once(B.load(s, d, "conversations").select("conv_id", "turn", "text"), "text", EMBEDDER)
    v = F.transform("embedding", lambda x: x.cast("double"))
    return c.select("conv_id", "turn", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"),
                    F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("energy"))


EMBED_SQL = r"""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS tok FROM conversations),
h AS (SELECT conv_id, turn, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) AS h FROM t),
g AS (SELECT conv_id, turn, h % 64 AS slot, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM h GROUP BY ALL),
e AS (SELECT conv_id, turn, CAST(sum(x) AS DOUBLE) AS total, CAST(sum(x * x) AS DOUBLE) AS energy FROM g GROUP BY ALL)
SELECT c.conv_id, c.turn, coalesce(total, 0e0) AS total, coalesce(energy, 0e0) AS energy FROM conversations c LEFT JOIN e ON c.conv_id = e.conv_id AND c.turn = e.turn"""


def _retrieval(s, d, **kw):
    chunks = key_chunks(s, d)
    vectors = embed_once(chunks.select("chunk_id", "content"), "content", EMBEDDER).select("chunk_id", "embedding")
    return retrieve(key_queries(s, d), chunks, vectors, EMBEDDER, **kw)


def hybrid(s, d):
    return _retrieval(s, d, keyword_threshold=0.1, threshold=0.2).contexts


def multi_query(s, d):
    """Questions with rewrites: each of their own lines."""
    chunks = key_chunks(s, d)
    vectors = embed_once(chunks.select("chunk_id", "content"), "content", EMBEDDER).select("chunk_id", "embedding")
    q = key_queries(s, d).withColumn("response", col("query"))
    most = q.agg(F.max(F.size(F.split("query", "\n")))).first()[0] or 1
    found = retrieve(q, chunks, vectors, EMBEDDER, rewrites=most + 1, keyword_threshold=0.1, threshold=0.1, rerank=False)
    return found.hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


HYBRID_VECTORS_SQL = r"""
tk AS (SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS tok FROM documents
  UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) FROM benchmark),
th AS (SELECT side, id, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) AS h, count(*) AS n FROM tk GROUP BY ALL),
sl AS (SELECT side, id, h % 64 AS slot, CAST(sum(CASE WHEN (h // 64) % 2 = 0 THEN n ELSE -n END) AS DOUBLE) AS x FROM th GROUP BY ALL),
nm AS (SELECT side, id, sqrt(sum(x * x)) AS norm FROM sl GROUP BY ALL),
dp AS (SELECT a.id AS query_id, b.id AS chunk_id, sum(a.x * b.x) AS dot FROM sl a JOIN sl b ON a.slot = b.slot AND a.side = 'q' AND b.side = 'd' GROUP BY ALL),
pr AS (SELECT q.id AS query_id, c.id AS chunk_id, round(coalesce(CASE WHEN q.norm > 0 AND c.norm > 0 THEN dot / (q.norm * c.norm) END, 0e0), 12) AS score
  FROM nm q JOIN nm c ON q.side = 'q' AND c.side = 'd' LEFT JOIN dp ON dp.query_id = q.id AND dp.chunk_id = c.id),
vv AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pr QUALIFY rank <= 8)
"""
HYBRID_SQL = (
    KEYWORD_SQL.replace("WITH w", "WITH RECURSIVE w").replace("{k}", "8") + "," + HYBRID_VECTORS_SQL
    + r""", lg AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM vv WHERE score >= 0.2
  UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) FROM kr WHERE score >= 0.1),
fs AS (SELECT query_id, chunk_id, round(sum(1e0 / (60 + r)), 12) AS score FROM lg GROUP BY ALL),
fu AS (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 8),
rw AS (SELECT item_id, """ + WORDS_SQL.replace("{c}", "text") + r""" AS ws FROM benchmark),
rr AS (SELECT item_id, ws, 1 AS i, CAST([] AS VARCHAR[]) AS acc FROM rw
  UNION ALL SELECT item_id, ws, i + 1, CASE WHEN list_contains(acc, ws[i]) THEN acc ELSE list_append(acc, ws[i]) END FROM rr WHERE i <= len(ws)),
rf AS (SELECT item_id, arg_max(acc, i) AS terms FROM rr GROUP BY item_id),
b AS (SELECT query_id, chunk_id, text, fu.score * 8e-1 + CAST(len(list_filter(terms, lambda t: contains(lower(text), lower(t)))) AS DOUBLE) / len(terms) * 2e-1 AS s
  FROM fu JOIN rf ON rf.item_id = query_id JOIN documents ON doc_id = chunk_id),
o AS (SELECT query_id, concat('[1] doc-', chunk_id, ' <paragraph>', chr(10), text) AS blk, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rk FROM b)
SELECT query_id, string_agg(blk, concat(chr(10), chr(10)) ORDER BY rk) AS context, count(*) AS blocks FROM o WHERE rk <= 8 GROUP BY query_id"""
)


_ASKED = "(SELECT concat(query_id, '#', n) AS item_id, text FROM aq)"
MULTI_SQL = (
    r"""WITH RECURSIVE al AS (SELECT item_id AS query_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')),
  lambda l: regexp_matches(l, '\S') AND l <> text) AS ls FROM benchmark),
ak AS (SELECT query_id, CASE WHEN regexp_matches(text, '\S') THEN list_concat([text], ls) ELSE [text] END AS qs FROM al),
aq AS (SELECT query_id, unnest(range(len(qs))) AS n, unnest(qs) AS text FROM ak), """
    + KEYWORD_SQL.strip().removeprefix("WITH ").replace("{k}", "8").replace("FROM benchmark", f"FROM {_ASKED}")
    + "," + HYBRID_VECTORS_SQL.replace("FROM benchmark", f"FROM {_ASKED}").replace("SELECT 'd' AS side, doc_id AS id", "SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id")
    + r""", lg AS (SELECT split_part(query_id, '#', 1)::BIGINT AS query_id, chunk_id::BIGINT AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id::BIGINT) AS r FROM vn WHERE score >= 0.1
  UNION ALL SELECT split_part(query_id, '#', 1)::BIGINT, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) FROM kr WHERE score >= 0.1),
fs AS (SELECT query_id, chunk_id, round(sum(1e0 / (60 + r)), 12) AS score FROM lg GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fs QUALIFY rank <= 8"""
).replace("vv AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pr QUALIFY rank <= 8)",
          "vn AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id::BIGINT) AS rank FROM pr QUALIFY rank <= 8)")


def _vec(cond: str, k: int = 8) -> str:
    return ("WITH" + VECTOR_SQL).replace("{cond}", cond).replace("{k}", str(k))


ENTRIES: dict[str, B.Entry] = {
    "vector_topk": (
        lambda s, d: _shown(vector_hits(s, d)),
        _vec("true") + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vr",
    ),
    "vector_topk_filtered": (
        lambda s, d: _shown(R.vector_topk(vec_queries(s, d), vec_chunks(s, d), 5, by="label")),
        _vec("a.label = b.label", 5) + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vr",
    ),
    "score_threshold": (
        lambda s, d: _shown(T.filter_score(vector_hits(s, d), 0.3)),
        _vec("true") + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vr WHERE score >= 0.3",
    ),
    "keyword_topk": (
        lambda s, d: _shown(keyword_hits(s, d)),
        KEYWORD_SQL.replace("{k}", "8") + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kr",
    ),
    "reciprocal_rank_fusion": (rrf, RRF_SQL),
    "lexical_rerank": (lexical_rerank, RERANK_SQL),
    "external_rerank": (external_rerank, EXTERNAL_SQL),
    "rerank_threshold": (
        lambda s, d: T.filter_reranked(lexical_rerank(s, d), 0.8),
        RERANK_SQL.replace("SELECT query_id, chunk_id, round(s, 6) AS score, CAST(row_number()", "SELECT * FROM (SELECT query_id, chunk_id, round(s, 6) AS score, CAST(row_number()") + ") WHERE score >= 0.8",
    ),
    "window_expansion": (
        window,
        f"""WITH l AS ({B.LINES_SQL}), h AS (SELECT lang AS query_id, l.doc_id, line_no FROM l JOIN documents d ON d.doc_id = l.doc_id WHERE length(line) > 400),
n AS (SELECT DISTINCT query_id, doc_id, unnest(range(greatest(0, line_no - 2), line_no + 3)) AS line_no FROM h)
SELECT query_id, concat(n.doc_id, ':', n.line_no) AS chunk_id, n.doc_id, CAST(n.line_no AS INTEGER) AS chunk_index, line AS content, 1e0 AS score FROM n JOIN l ON l.doc_id = n.doc_id AND l.line_no = n.line_no""",
    ),
    "parent_expansion": (parents, PARENT_SQL),
    "citations": (
        citations,
        """SELECT lang AS query_id, doc_id AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, source AS doc_name, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 9 AS INTEGER) END AS chunk_index,
CAST(NULL AS VARCHAR) AS heading_path, 'paragraph' AS segment_type, CAST(NULL AS INTEGER) AS heading_level, CAST(0.25 AS DOUBLE) AS score, substring(text, 1, 200) AS snippet FROM documents""",
    ),
    "evidence_context": (evidence, EVIDENCE_SQL),
    "query_rewrites": (rewrites, REWRITE_SQL),
    "embed_once": (embedded_once, EMBED_SQL),
    "hybrid_retrieval": (hybrid, HYBRID_SQL),
    "multi_query_retrieval": (multi_query, MULTI_SQL),
}
