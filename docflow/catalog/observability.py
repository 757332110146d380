"""Metrics, alerts, traces and feedback."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from docflow.catalog import base as B
from docflow.operators import observability as O
from docflow.operators import tables as T
from docflow.operators.conversations import auto_title

col = F.col
START, END = datetime(1990, 1, 1), datetime(2030, 1, 1)
NOW = datetime(2024, 1, 31)

CTE = f"""r AS ({B.RUNS_SQL}), n AS ({B.NODES_SQL}), t AS ({B.TASKS_SQL}), c AS ({B.CHUNKS_SQL}),
dt AS (SELECT doc_id, CAST(sum(CASE WHEN token_count > 0 THEN token_count WHEN char_count > 0 THEN CAST(ceil(char_count / 4e0) AS BIGINT) ELSE CASE WHEN regexp_matches(content, '\\S') THEN CAST(ceil(length(content) / 4e0) AS BIGINT) ELSE 0 END END) AS BIGINT) AS tokens FROM c GROUP BY doc_id)"""


def _rate(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN floor(CAST({a} AS DOUBLE) / {b} * 1e4 + 5e-1) / 1e4 ELSE 0e0 END"


def metrics_sql(name: str, window: str) -> str:
    """Metrics of one time window as CTE ``name``."""
    j = lambda k, t: f"coalesce(TRY_CAST(json_extract_string(extra_data, '$.{k}') AS {t}), 0)"
    return f"""{name}r AS (SELECT user_id, count(*) AS tq, count(*) FILTER (status = 'SUCCESS') AS sq, count(*) FILTER (status = 'ERROR') AS fq,
 count(*) FILTER (answer_state = 'empty_retrieval') AS e, count(*) FILTER (answer_state IN ('empty_retrieval', 'refused')) AS rf, avg(duration_ms) FILTER (duration_ms > 0) AS dur,
 count(*) FILTER (trace_id IN (SELECT trace_id FROM n WHERE node_type = 'generate' AND status = 'ERROR')) AS bad,
 CAST(sum({j('estimatedChatInputTokens', 'BIGINT')}) AS BIGINT) AS ci, CAST(sum({j('estimatedChatOutputTokens', 'BIGINT')}) AS BIGINT) AS co, CAST(sum({j('estimatedEmbeddingTokens', 'BIGINT')}) AS BIGINT) AS qe,
 sum({j('estimatedChatInputCost', 'DOUBLE')}) + sum({j('estimatedChatOutputCost', 'DOUBLE')}) AS cc, sum({j('estimatedEmbeddingCost', 'DOUBLE')}) AS qc
 FROM r WHERE trace_name = 'rag_query' AND deleted = 0 AND {window} GROUP BY user_id),
{name}t AS (SELECT created_by AS user_id, count(*) AS tt, count(*) FILTER (status IN ('SUCCESS', 'FAILED')) AS te, count(*) FILTER (status = 'SUCCESS') AS dn, count(*) FILTER (retry_count > 0) AS rt,
 avg(date_diff('millisecond', started_at, completed_at)) FILTER (completed_at IS NOT NULL) AS td FROM t WHERE {window} GROUP BY created_by),
{name}i AS (SELECT created_by AS user_id, CAST(sum(tokens) AS BIGINT) AS it FROM (SELECT DISTINCT created_by, doc_id FROM t WHERE status = 'SUCCESS' AND {window}) JOIN dt USING (doc_id) GROUP BY created_by),
{name} AS (SELECT user_id, coalesce(tq, 0) AS total_queries, coalesce(sq, 0) AS successful_queries, coalesce(fq, 0) AS failed_queries, coalesce(tt, 0) AS total_tasks, coalesce(te, 0) AS terminal_tasks,
 coalesce(ci, 0) AS chat_input_tokens, coalesce(co, 0) AS chat_output_tokens, coalesce(qe, 0) AS query_embedding_tokens, coalesce(it, 0) AS ingestion_tokens,
 {_rate('e', 'sq')} AS empty_retrieval_rate, {_rate('rf', 'sq')} AS refusal_rate, floor(coalesce(dur, 0e0) * 1e2 + 5e-1) / 1e2 AS average_response_ms, {_rate('bad', 'tq')} AS model_error_rate,
 {_rate('dn', 'te')} AS task_success_rate, {_rate('rt', 'tt')} AS task_retry_rate, floor(coalesce(td, 0e0) * 1e2 + 5e-1) / 1e2 AS average_task_ms,
 coalesce(ci, 0) + coalesce(co, 0) + coalesce(qe, 0) + coalesce(it, 0) AS total_tokens, floor(coalesce(cc, 0e0) * 1e6 + 5e-1) / 1e6 AS chat_cost,
 floor((coalesce(qc, 0e0) + floor(coalesce(it, 0) * 1e-4 / 1e3 * 1e6 + 5e-1) / 1e6) * 1e6 + 5e-1) / 1e6 AS embedding_cost,
 floor((coalesce(cc, 0e0) + floor((coalesce(qc, 0e0) + floor(coalesce(it, 0) * 1e-4 / 1e3 * 1e6 + 5e-1) / 1e6) * 1e6 + 5e-1) / 1e6) * 1e6 + 5e-1) / 1e6 AS total_cost
 FROM {name}r FULL JOIN {name}t USING (user_id) LEFT JOIN {name}i USING (user_id))"""


STREAK_CTE = """st AS (SELECT created_by AS user_id, status, row_number() OVER (PARTITION BY created_by ORDER BY create_time DESC, task_id DESC) AS rn FROM t QUALIFY rn <= 10),
fs AS (SELECT user_id, count(*) AS recent_tasks, coalesce(min(rn) FILTER (status <> 'FAILED') - 1, count(*)) AS failures FROM st GROUP BY user_id)"""

ALERT_CTE = f"""{CTE}, {metrics_sql('cu', "create_time >= TIMESTAMP '2024-01-16 00:00:00' AND create_time < TIMESTAMP '2024-01-31 00:00:00'")},
{metrics_sql('ba', "create_time >= TIMESTAMP '2024-01-01 00:00:00' AND create_time < TIMESTAMP '2024-01-16 00:00:00'")}, {STREAK_CTE},
jo AS (SELECT user_id, coalesce(c.successful_queries, 0) AS cs, coalesce(b.successful_queries, 0) AS bs, coalesce(c.total_queries, 0) AS ct, coalesce(b.total_queries, 0) AS bt,
 1e0 - coalesce(c.empty_retrieval_rate, 0e0) AS cr, 1e0 - coalesce(b.empty_retrieval_rate, 0e0) AS br, coalesce(c.model_error_rate, 0e0) AS ce, coalesce(b.model_error_rate, 0e0) AS be, coalesce(failures, 0) AS f
 FROM cu c FULL JOIN ba b USING (user_id) FULL JOIN fs USING (user_id)),
ar AS (SELECT user_id, 'ingestion_consecutive_failures' AS code, CASE WHEN f >= 1 THEN 'ACTIVE' ELSE 'OK' END AS status, 'critical' AS hot, CAST(f AS DOUBLE) AS current_value, CAST(NULL AS DOUBLE) AS baseline_value, 1e0 AS threshold FROM jo
 UNION ALL SELECT user_id, 'retrieval_quality_decline', CASE WHEN cs < 5 OR bs < 5 THEN 'INSUFFICIENT_DATA' WHEN br - cr >= 1e-2 THEN 'ACTIVE' ELSE 'OK' END, 'warning', cr, br, 1e-2 FROM jo
 UNION ALL SELECT user_id, 'model_error_rate_spike', CASE WHEN ct < 5 OR bt < 5 THEN 'INSUFFICIENT_DATA' WHEN ce >= 5e-2 AND ce - be >= 1e-2 THEN 'ACTIVE' ELSE 'OK' END, 'warning', ce, be, 5e-2 FROM jo),
al AS (SELECT user_id, code, CASE WHEN status = 'ACTIVE' THEN hot ELSE 'info' END AS level, status, current_value, baseline_value, threshold FROM ar)"""

# Lower limits than the defaults, so that the data raises all three states.
LIMITS = {"failures": 1, "success_drop": 0.01, "error_rate": 0.05, "error_rise": 0.01}


def metrics(s, d):
    return O.rag_metrics(B.runs(s, d), B.nodes(s, d), B.tasks(s, d), B.chunk_table(s, d), START, END)


def alerts(s, d):
    return O.window_alerts(B.runs(s, d), B.nodes(s, d), B.tasks(s, d), B.chunk_table(s, d), NOW, 360, 360, LIMITS)


def signatures(s, d):
    """Daily signature per user: its share of errors in tenths and whether it saw a purchase."""
    e = B.load(s, d, "events").withColumn("user_id", col("user_id") % 20)
    day = e.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("sent_at")).agg(
        F.floor(F.avg((col("event_type") == "error").cast("double")) * 10).alias("e"), F.max((col("event_type") == "purchase").cast("int")).alias("p"),
    )
    rows = day.select(
        "user_id", "sent_at",
        F.inline(F.array(
            F.struct(F.lit("error").alias("code"), F.lit("ACTIVE").alias("status"), col("e").alias("current_value")),
            F.struct(F.lit("buy").alias("code"), F.lit("ACTIVE").alias("status"), col("p").cast("bigint").alias("current_value")),
        )),
    )
    return O.alert_signature(T.active_alerts(rows), ["user_id", "sent_at"])


SIGNATURE_CTE = """dy AS (SELECT user_id % 20 AS user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS sent_at, CAST(floor(avg(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END) * 10) AS BIGINT) AS e,
 max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS p FROM events GROUP BY ALL), sg AS (SELECT user_id, sent_at, concat('buy:ACTIVE:', p, '|error:ACTIVE:', e) AS signature FROM dy)"""


def phases(s, d):
    logs = B.load(s, d, "lineitem").select(
        (col("l_orderkey") * 8 + col("l_linenumber")).alias("task_id"), (col("l_partkey")).alias("doc_id"), F.when(col("l_partkey") % 7 > 0, col("l_quantity").cast("bigint")).alias("extract_ms"),
        F.when(col("l_partkey") % 7 > 1, col("l_suppkey")).alias("chunk_ms"), F.when(col("l_partkey") % 7 > 2, col("l_partkey")).alias("embed_ms"),
        F.when(col("l_partkey") % 7 > 3, F.lit(5)).alias("persist_ms"), F.when(col("l_partkey") % 2 == 0, F.lit(9)).alias("chunk_count"),
    )
    fail = B.tasks(s, d).where("status = 'FAILED'").select(
        (col("task_id") * 8 + 1).alias("task_id"), F.concat(F.lit("boom "), col("task_id").cast("string")).alias("error")
    )
    return O.phase_nodes(logs, fail)


PHASES_SQL = f"""WITH t AS ({B.TASKS_SQL}), l AS (SELECT l_orderkey * 8 + l_linenumber AS task_id, l_partkey AS doc_id, CASE WHEN l_partkey % 7 > 0 THEN CAST(floor(l_quantity) AS BIGINT) END AS x, CASE WHEN l_partkey % 7 > 1 THEN l_suppkey END AS c,
 CASE WHEN l_partkey % 7 > 2 THEN l_partkey END AS e, CASE WHEN l_partkey % 7 > 3 THEN 5 END AS p, CASE WHEN l_partkey % 2 = 0 THEN 9 END AS n FROM lineitem),
f AS (SELECT task_id * 8 + 1 AS task_id, concat('boom ', task_id) AS error FROM t WHERE status = 'FAILED'),
j AS (SELECT task_id, doc_id, error, n, x, c, e, p, CASE WHEN error IS NULL THEN NULL WHEN x IS NULL THEN 'parse' WHEN c IS NULL THEN 'chunk' WHEN e IS NULL THEN 'embed' ELSE 'persist' END AS failed FROM f FULL JOIN l USING (task_id)),
u AS (SELECT *, 'parse' AS phase, 1 AS phase_order, x AS ms, 'Document parsed' AS m FROM j UNION ALL SELECT *, 'chunk', 2, c, 'Document chunked' FROM j
 UNION ALL SELECT *, 'embed', 3, e, 'Embeddings generated' FROM j UNION ALL SELECT *, 'persist', 4, p, 'Chunks and vectors persisted' FROM j)
SELECT task_id, doc_id, phase, phase_order, CASE WHEN phase = failed THEN 'FAILED' ELSE 'SUCCESS' END AS status, coalesce(ms, 0) AS duration_ms, CASE WHEN phase = failed THEN error ELSE m END AS message,
CASE WHEN phase IS DISTINCT FROM failed AND phase IN ('chunk', 'persist') THEN CAST(coalesce(n, 0) AS BIGINT) END AS chunk_count FROM u WHERE ms IS NOT NULL OR phase = failed"""

METRIC_COLUMNS = """user_id, total_queries, successful_queries, failed_queries, total_tasks, terminal_tasks, chat_input_tokens, chat_output_tokens, query_embedding_tokens, ingestion_tokens,
empty_retrieval_rate, refusal_rate, average_response_ms, model_error_rate, task_success_rate, task_retry_rate, average_task_ms, total_tokens, chat_cost, embedding_cost, total_cost"""

ENTRIES: dict[str, B.Entry] = {
    "usage_metrics": (
        metrics,
        f"WITH {CTE}, {metrics_sql('m', 'create_time >= TIMESTAMP ' + chr(39) + '1990-01-01 00:00:00' + chr(39))} SELECT {METRIC_COLUMNS} FROM m",
    ),
    "window_alerts": (alerts, f"WITH {ALERT_CTE} SELECT * FROM al"),
    "active_alerts": (lambda s, d: T.active_alerts(alerts(s, d)), f"WITH {ALERT_CTE} SELECT * FROM al WHERE status = 'ACTIVE'"),
    "failure_streaks": (lambda s, d: O.failure_streak(B.tasks(s, d)), f"WITH t AS ({B.TASKS_SQL}), {STREAK_CTE} SELECT * FROM fs"),
    "runs_with_failed_generation": (
        lambda s, d: O.runs_with_node(B.runs(s, d), B.nodes(s, d), "generate", "ERROR").select("trace_id", "user_id"),
        f"WITH r AS ({B.RUNS_SQL}), n AS ({B.NODES_SQL}) SELECT trace_id, user_id FROM r WHERE trace_id IN (SELECT trace_id FROM n WHERE node_type = 'generate' AND status = 'ERROR')",
    ),
    "ingestion_tokens": (
        lambda s, d: O.ingestion_tokens(B.tasks(s, d), B.chunk_table(s, d)),
        f"WITH {CTE} SELECT created_by, CAST(sum(tokens) AS BIGINT) AS ingestion_tokens FROM (SELECT DISTINCT created_by, doc_id FROM t WHERE status = 'SUCCESS') JOIN dt USING (doc_id) GROUP BY created_by",
    ),
    "trace_details": (
        lambda s, d: O.trace_detail(B.runs(s, d).select("trace_id", "user_id", "status"), B.nodes(s, d)),
        f"""WITH r AS ({B.RUNS_SQL}), n AS ({B.NODES_SQL}) SELECT r.trace_id, user_id, r.status, row_number() OVER (PARTITION BY n.trace_id ORDER BY n.create_time, node_type) AS node_order,
node_type, n.status AS node_status, n.duration_ms AS node_duration_ms FROM r LEFT JOIN n ON n.trace_id = r.trace_id""",
    ),
    "feedback_summary": (
        lambda s, d: O.feedback_summary(B.feedback(s, d), "kb_id"),
        f"""WITH f AS ({B.FEEDBACK_SQL}) SELECT kb_id, count(*) AS total, count(*) FILTER (rating >= 4) AS positive, count(*) FILTER (rating = 3) AS neutral, count(*) FILTER (rating <= 2) AS negative,
coalesce(avg(rating), 0e0) AS average FROM f GROUP BY kb_id""",
    ),
    "active_users": (
        lambda s, d: O.active_users(B.runs(s, d), B.tasks(s, d), datetime(1998, 6, 1)),
        f"""WITH r AS ({B.RUNS_SQL}), t AS ({B.TASKS_SQL}) SELECT user_id FROM r WHERE trace_name = 'rag_query' AND deleted = 0 AND create_time >= TIMESTAMP '1998-06-01 00:00:00'
UNION SELECT created_by FROM t WHERE create_time >= TIMESTAMP '1998-06-01 00:00:00'""",
    ),
    "recent_messages": (
        lambda s, d: O.recent_messages(B.load(s, d, "conversations"), 4),
        "SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4",
    ),
    "conversation_titles": (
        lambda s, d: auto_title(B.load(s, d, "conversations")),
        r"""WITH f AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id), n AS (SELECT conv_id, trim(regexp_replace(t, '[\s\p{Z}]+', ' ', 'g')) AS t FROM f)
SELECT conv_id, CASE WHEN length(t) > 30 THEN concat(substring(t, 1, 30), '...') ELSE t END AS title FROM n""",
    ),
    "alert_signatures": (signatures, f"WITH {SIGNATURE_CTE} SELECT user_id, sent_at, signature FROM sg"),
    "changed_alerts": (
        lambda s, d: O.changed_signatures(signatures(s, d), "sent_at"),
        f"WITH {SIGNATURE_CTE} SELECT user_id, sent_at, signature FROM sg QUALIFY signature IS DISTINCT FROM lag(signature) OVER (PARTITION BY user_id ORDER BY sent_at)",
    ),
    "phase_timeline": (phases, PHASES_SQL),
}
