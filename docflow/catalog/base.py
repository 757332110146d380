"""Loading and the views that stand in for tables the data set does not have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docflow.session import spread

Query = Callable[[SparkSession, str], DataFrame]
Entry = tuple[Query, str | None]

# Text-heavy tables and their key: one file of them is one task unless spread.
HEAVY = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, HEAVY[name]) if name in HEAVY else df


def sql_over(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """Run view text over the named tables; ``{t}`` marks a table."""
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in tables})


def _both(text: str, *tables: str) -> tuple[str, str]:
    """The same view for Spark (table marks) and for the oracle (plain names)."""
    plain, marked = text, text.replace("{", "{{").replace("}", "}}")
    for t in tables:
        plain = plain.replace("{" + t + "}", t)
        marked = marked.replace("{{" + t + "}}", "{" + t + "}")
    return marked, plain


RUNS, RUNS_SQL = _both(
    """SELECT event_id AS trace_id, user_id % 20 AS user_id,
  CASE WHEN event_id % 13 = 0 THEN 'rag_query_stream' ELSE 'rag_query' END AS trace_name,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS status, ts AS create_time,
  CAST(floor(value * 10) AS BIGINT) AS duration_ms,
  CASE WHEN event_id % 9 = 0 THEN 'empty_retrieval' WHEN event_id % 7 = 0 THEN 'refused' ELSE 'answered' END AS answer_state,
  concat('{"answerState":"', CASE WHEN event_id % 9 = 0 THEN 'empty_retrieval' WHEN event_id % 7 = 0 THEN 'refused' ELSE 'answered' END,
    '","estimatedChatInputTokens":', CAST(event_id % 500 AS STRING), ',"estimatedChatOutputTokens":"', CAST(event_id % 90 AS STRING),
    '","estimatedEmbeddingTokens":', CAST(event_id % 40 AS STRING), ',"estimatedChatInputCost":0.00', CAST(100 + event_id % 500 AS STRING),
    ',"estimatedChatOutputCost":0.0', CAST(100 + event_id % 90 AS STRING), ',"estimatedEmbeddingCost":0.000', CAST(100 + event_id % 40 AS STRING), '}') AS extra_data,
  props, 0 AS deleted FROM {events}""",
    "events",
)

NODES, NODES_SQL = _both(
    """SELECT event_id AS trace_id, CASE WHEN event_id % 3 = 0 THEN 'generate' ELSE 'retrieve' END AS node_type,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS status, ts AS create_time,
  CAST(floor(value) AS BIGINT) AS duration_ms FROM {events}
UNION ALL SELECT event_id, 'rerank', 'SUCCESS', ts + INTERVAL '1' SECOND, CAST(floor(value) AS BIGINT) FROM {events} WHERE event_type = 'view'""",
    "events",
)

TASKS, TASKS_SQL = _both(
    """SELECT o_orderkey AS task_id, o_custkey % 20 AS created_by, o_orderkey % 200 AS doc_id,
  CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCESS' ELSE 'RETRYING' END AS status,
  o_orderkey % 4 AS retry_count, o_orderdate AS create_time, o_orderdate AS started_at,
  CASE o_orderkey % 3 WHEN 0 THEN o_orderdate + INTERVAL '10' MINUTE WHEN 1 THEN o_orderdate + INTERVAL '95' SECOND END AS completed_at
  FROM {orders}""",
    "orders",
)

CHUNKS, CHUNKS_SQL = _both(
    """SELECT doc_id, source AS kb_id, text AS content, 0 AS deleted, 0 AS chunk_index, doc_id AS chunk_id,
  CASE WHEN doc_id % 3 = 0 THEN CAST(floor(n_chars / 5) AS BIGINT) ELSE 0 END AS token_count,
  CASE WHEN doc_id % 3 = 1 THEN n_chars ELSE 0 END AS char_count FROM {documents}""",
    "documents",
)

FEEDBACK, FEEDBACK_SQL = _both(
    """SELECT event_id AS trace_id, event_type AS kb_id, user_id,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 1 + event_id % 5 END AS rating, ts AS create_time, 0 AS deleted FROM {events}""",
    "events",
)

CASES, CASES_SQL = _both(
    """SELECT doc_id AS case_id, quality AS answer_passed, 1 - toxic AS citation_passed,
  CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS refusal_passed FROM {labels}""",
    "labels",
)

JUDGE, JUDGE_SQL = _both(
    """SELECT doc_id AS sample_id, 'faithfulness' AS metric, CASE WHEN doc_id % 5 = 0 THEN 'no score'
  WHEN doc_id % 2 = 0 THEN concat('{"score": ', CAST(quality AS STRING), '.0}') ELSE concat('分数：', CAST(toxic AS STRING), '.5') END AS response FROM {labels}
UNION ALL SELECT doc_id, 'answer_relevancy', CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('{"score" : 0.', CAST(doc_id % 10 AS STRING), '}') END FROM {labels}""",
    "labels",
)

# Lines of a document, numbered from 0.
LINES = """SELECT doc_id, CAST(pos AS BIGINT) AS line_no, line FROM {documents} LATERAL VIEW posexplode(split(text, chr(10))) t AS pos, line"""
LINES_SQL = """SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"""

_BOXES = """SELECT doc_id, line_no AS box_no, CAST(floor(line_no / 40) AS BIGINT) AS page_num,
  CASE WHEN line_no % 2 = 0 THEN CAST(50 AS DOUBLE) ELSE CAST(320 AS DOUBLE) END AS x1, CAST(20 + 14 * (line_no % 40) AS DOUBLE) AS y1,
  CASE WHEN line_no % 2 = 0 THEN CAST(280 AS DOUBLE) ELSE CAST(550 AS DOUBLE) END AS x2, CAST(32 + 14 * (line_no % 40) AS DOUBLE) AS y2,
  CASE WHEN line_no % 10 = 0 THEN CAST(18 AS DOUBLE) ELSE CAST(12 AS DOUBLE) END AS font_size, line_no % 10 = 0 AS bold, line AS text"""
BOXES = f"{_BOXES} FROM ({LINES})"
BOXES_SQL = f"{_BOXES} FROM ({LINES_SQL})"

# Markdown made of the lines: headings, lists, a table and plain blocks.
_MARK = """CASE WHEN {i} % 11 = 0 THEN '# ' WHEN {i} % 11 = 4 THEN '### ' WHEN {i} % 11 = 6 THEN '## '
  WHEN {i} % 11 = 7 THEN '- ' WHEN {i} % 11 = 8 THEN '- ' WHEN {i} % 11 = 9 THEN '| a | ' ELSE '' END"""
_TAIL = "CASE WHEN {i} % 11 = 9 THEN ' |' ELSE '' END"
MARKDOWN = (
    "SELECT doc_id, array_join(transform(split(text, chr(10)), (l, i) -> concat("
    + _MARK.replace("{i}", "i") + ", l, " + _TAIL.replace("{i}", "i")
    + ")), concat(chr(10), chr(10))) AS text FROM {documents}"
)
MARKDOWN_SQL = (
    "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: concat("
    + _MARK.replace("{i}", "(i - 1)") + ", l, " + _TAIL.replace("{i}", "(i - 1)")
    + ")), concat(chr(10), chr(10))) AS text FROM documents"
)

PARAGRAPHS = "SELECT doc_id, replace(text, chr(10), concat(chr(10), chr(10))) AS text FROM {documents}"
PARAGRAPHS_SQL = "SELECT doc_id, replace(text, chr(10), concat(chr(10), chr(10))) AS text FROM documents"


def runs(spark, d):
    return sql_over(spark, d, RUNS, "events")


def nodes(spark, d):
    return sql_over(spark, d, NODES, "events")


def tasks(spark, d):
    return sql_over(spark, d, TASKS, "orders")


def chunk_table(spark, d):
    return sql_over(spark, d, CHUNKS, "documents")


def feedback(spark, d):
    return sql_over(spark, d, FEEDBACK, "events")


def cases(spark, d):
    return sql_over(spark, d, CASES, "labels")


def judge(spark, d):
    return sql_over(spark, d, JUDGE, "labels")


def boxes(spark, d):
    return sql_over(spark, d, BOXES, "documents")


def lines(spark, d):
    return sql_over(spark, d, LINES, "documents")


def markdown(spark, d):
    return sql_over(spark, d, MARKDOWN, "documents")


def paragraphs(spark, d):
    return sql_over(spark, d, PARAGRAPHS, "documents")
