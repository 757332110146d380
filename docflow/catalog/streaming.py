"""Streaming jobs run over what is there, and their batch twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from docflow.catalog import base as B
from docflow.catalog.chunking import source_files
from docflow.catalog.observability import SIGNATURE_CTE, signatures
from docflow.catalog.retrieval import EMBEDDER
from docflow.operators.tables import latest_state
from docflow.session import work_path
from docflow.sources.writers import read_buckets
from docflow.streaming import alerts as A
from docflow.streaming import batch as S
from docflow.streaming import jobs as J

col = F.col
# A bucket of three that gets one token back every 12 hours: the events are sparse.
LIMIT = dict(capacity=3, refill=1, window_ms=12 * 3600 * 1000)


def file_stream(s, d, table):
    schema = B.load(s, d, table).schema
    return s.readStream.schema(schema).parquet(f"{d}/{table[:-1]}[{table[-1]}].parquet")


def as_stream(df, name):
    """A table as a stream: its files are the source."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def finished(stream, name, mode="append"):
    return J.run_available(stream, work_path(stream.sparkSession, name), mode=mode)


def limited(s, d):
    return S.rate_limit(B.load(s, d, "events"), **LIMIT)


def limited_stream(s, d):
    return finished(J.rate_limit_stream(file_stream(s, d, "events"), **LIMIT), "limited")


LIMIT_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events),
st AS (SELECT user_id, event_id, n, true AS allowed, CAST(2 AS BIGINT) AS tokens, ms AS last FROM e WHERE n = 1
 UNION ALL SELECT user_id, event_id, n, have > 0, CAST(CASE WHEN have > 0 THEN have - 1 ELSE have END AS BIGINT), moved FROM (
  SELECT e.user_id, e.event_id, e.n, CASE WHEN a > 0 THEN least(3, st.tokens + a) ELSE st.tokens END AS have, CASE WHEN a > 0 THEN e.ms ELSE st.last END AS moved
  FROM st JOIN e ON e.user_id = st.user_id AND e.n = st.n + 1, LATERAL (SELECT CAST(floor(CAST(e.ms - st.last AS DOUBLE) / 43200000e0 * 1) AS BIGINT) AS a) z))
SELECT user_id, event_id, allowed, tokens FROM st"""


def task_events(s, d):
    """Line items as the history of their order's task: enqueue, then what happened."""
    x = B.load(s, d, "lineitem")
    kind = (
        F.when(col("l_linenumber") == 1, "enqueue").when(col("l_linenumber") % 2 == 0, "claim")
        .when(col("l_returnflag") == "R", "failure").when(col("l_returnflag") == "A", "success").when(col("l_linestatus") == "F", "retry").otherwise("renew")
    )
    seq = col("l_linenumber").cast("bigint") * 1_000_000_000 + col("l_partkey") * 10_000 + col("l_suppkey")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = F.timestamp_add("MINUTE", (col("l_linenumber") * 20 + col("l_partkey") % 15).cast("int"), base)
    return x.select(col("l_orderkey").alias("task_id"), seq.alias("seq"), kind.alias("event"), at.alias("at"))


def current_tasks(s, d):
    return latest_state(S.task_states(task_events(s, d)), "task_id", ["seq"])


def task_stream(s, d):
    return finished(J.task_state_stream(as_stream(task_events(s, d), "task-events")), "task-states")


OPEN_SQL = f"""WITH t AS ({B.TASKS_SQL}) SELECT doc_id, task_id, CASE status WHEN 'FAILED' THEN 'QUEUED' ELSE 'RUNNING' END AS status, create_time FROM t WHERE status <> 'RETRYING'
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY create_time DESC, task_id DESC) = 1"""


def open_tasks(s, d):
    t = B.tasks(s, d).withColumn("status", F.when(col("status") == "FAILED", "QUEUED").when(col("status") == "SUCCESS", "RUNNING").otherwise(col("status")))
    return S.open_tasks(t.select("doc_id", "task_id", "status", "create_time"))


def messages(s, d):
    """Events as queue messages: some broken, some without document, some sent twice."""
    e = B.load(s, d, "events")
    good = F.concat(
        F.lit('{"eventId":"e'), col("event_id").cast("string"), F.lit('","eventType":"'), col("event_type"),
        F.lit('","payload":{"taskId":"t'), col("user_id").cast("string"), F.lit('"'),
        F.when(col("event_id") % 10 != 1, F.concat(F.lit(',"docId":"d'), (col("event_id") % 100).cast("string"), F.lit('"'))).otherwise(""),
        F.lit('},"timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"}'),
    )
    m = e.select(F.when(col("event_id") % 10 == 0, "{broken").otherwise(good).alias("value"), "event_id")
    return m.unionByName(m.where("event_id % 3 = 0")).select("value")


DECODE_SQL = """SELECT concat('e', event_id) AS event_id, event_type, concat('d', event_id % 100) AS doc_id, concat('t', user_id) AS task_id, date_trunc('second', ts) AS ts FROM events WHERE event_id % 10 NOT IN (0, 1)"""


def decoded_stream(s, d):
    out = finished(J.decode_stream(as_stream(messages(s, d), "messages")), "decoded")
    return out.withColumn("ts", col("ts").cast("timestamp_ntz"))


def answer_events(s, d):
    """Words of a conversation as chunk events, framed by metadata, verification and done."""
    c = B.load(s, d, "conversations")
    words = c.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w")).select(
        col("conv_id").alias("trace_id"), (col("turn") * 100000 + col("i") + 1).alias("seq"), F.lit("chunk").alias("type"), F.concat("w", F.lit(" ")).alias("data"),
    )
    one = c.where("turn = 0")
    extra = one.where("conv_id % 7 <> 0").select(col("conv_id").alias("trace_id"), F.lit(0).cast("bigint").alias("seq"), F.lit("metadata").alias("type"), F.concat(F.lit("m"), col("conv_id").cast("string")).alias("data"))
    check = one.where("conv_id % 2 = 0").select(col("conv_id").alias("trace_id"), F.lit(90000000).cast("bigint").alias("seq"), F.lit("verification").alias("type"), F.lit("ok").alias("data"))
    done = one.where("conv_id % 5 <> 0").select(col("conv_id").alias("trace_id"), F.lit(90000001).cast("bigint").alias("seq"), F.lit("done").alias("type"), F.lit(None).cast("string").alias("data"))
    return words.unionByName(extra).unionByName(check).unionByName(done)


ANSWERS_SQL = """WITH w AS (SELECT conv_id, turn, unnest(range(len(string_split(text, ' ')))) AS i, unnest(string_split(text, ' ')) AS w FROM conversations)
SELECT conv_id AS trace_id, string_agg(concat(w, ' '), '' ORDER BY turn, i) AS answer, concat('m', conv_id) AS metadata, CASE WHEN conv_id % 2 = 0 THEN 'ok' END AS verification, count(*) AS chunks FROM w
WHERE conv_id % 5 <> 0 AND conv_id % 7 <> 0 GROUP BY conv_id"""


def slices(s, d):
    x = S.metric_slices(B.runs(s, d))
    return x.withColumn("slice_start", col("slice_start").cast("timestamp_ntz"))


SLICE_CTE = f"""r AS ({B.RUNS_SQL}), sl AS (SELECT user_id, time_bucket(INTERVAL '5 minutes', create_time) AS slice_start, count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS successful, count(*) FILTER (status = 'ERROR') AS failed,
count(*) FILTER (answer_state = 'empty_retrieval') AS empty FROM r WHERE trace_name = 'rag_query' GROUP BY ALL)"""


def slices_stream(s, d):
    stream = J.slice_stream(as_stream(B.runs(s, d), "runs"))
    return finished(stream, "slices").withColumn("slice_start", col("slice_start").cast("timestamp_ntz"))


def rolling(s, d):
    return J.rolling_rates(S.metric_slices(B.runs(s, d)), datetime(2024, 1, 31), 360, 360)


# The runs are sparse: windows of five days, a few runs are enough.
ROLLING = dict(hours=120, baseline_hours=120, cfg={"min_samples": 3, "error_rate": 0.1, "error_rise": 0.05, "success_drop": 0.05})


def alert_changes(s, d):
    x = A.changed_alerts(S.metric_slices(B.runs(s, d)), **ROLLING)
    return x.withColumn("sent_at", col("sent_at").cast("timestamp_ntz"))


def alert_changes_stream(s, d):
    J.use_rocksdb(s)
    out = finished(A.alert_changes_stream(as_stream(B.runs(s, d), "runs"), **ROLLING), "alert-changes")
    return out.withColumn("sent_at", col("sent_at").cast("timestamp_ntz"))


def _alerts_sql(until: str = "true") -> str:
    """Both windows before the end of each slice; rates per ten thousand."""
    sums = ", ".join(f"sum({c}) OVER now AS n_{c}, coalesce(sum({c}) OVER before, 0) AS b_{c}" for c in A.COUNTS)
    rate = lambda part, whole: f"CASE WHEN {whole} > 0 THEN CAST(floor(10000e0 * {part} / {whole} + 0.5e0) AS BIGINT) ELSE 0 END"
    return f"""WITH {SLICE_CTE}, tm AS (SELECT *, epoch_ms(slice_start) AS ms FROM sl),
su AS (SELECT user_id, slice_start, ms, {sums} FROM tm WINDOW now AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 431700000 PRECEDING AND CURRENT ROW),
  before AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 863700000 PRECEDING AND 432000000 PRECEDING)),
ra AS (SELECT *, {rate('n_failed', 'n_total')} AS ne, {rate('b_failed', 'b_total')} AS be, 10000 - ({rate('n_empty', 'n_successful')}) AS ng, 10000 - ({rate('b_empty', 'b_successful')}) AS bg FROM su),
si AS (SELECT user_id, slice_start + INTERVAL '5 minutes' AS sent_at, concat_ws('|', CASE WHEN least(n_total, b_total) >= 3 AND ne >= 1000 AND ne - be >= 500 THEN concat('{A.ERRORS}:ACTIVE:', ne) END,
  CASE WHEN least(n_successful, b_successful) >= 3 AND bg - ng >= 500 THEN concat('{A.QUALITY}:ACTIVE:', ng) END) AS signature FROM ra),
ch AS (SELECT *, coalesce(lag(signature) OVER (PARTITION BY user_id ORDER BY sent_at), '') AS last FROM si)
SELECT user_id, sent_at, signature FROM ch WHERE signature <> last AND {until}"""


def _sum(p, cond):
    return ", ".join(f"CAST(coalesce(sum({c}) FILTER ({cond}), 0) AS BIGINT) AS {p}_{c}" for c in ("total", "successful", "failed", "empty"))


def ingest_job(s, d):
    root = work_path(s, "ingest")
    docs = source_files(s, d).withColumn("uploaded_at", F.lit(1))
    q = J.ingest_stream(as_stream(docs, "uploads"), EMBEDDER, f"{root}/chunks", f"{root}/vectors", f"{root}/checkpoint", 16)
    q.awaitTermination()
    return read_buckets(s, f"{root}/chunks").select("chunk_id", "doc_id", "chunk_index", "content_hash", "char_count", "token_count")


ENTRIES: dict[str, B.Entry] = {
    "rate_limit": (limited, LIMIT_SQL),
    "rate_limit_stream": (limited_stream, LIMIT_SQL),
    "task_states": (current_tasks, None),
    "task_states_stream": (task_stream, None),
    "open_tasks": (open_tasks, OPEN_SQL),
    "decoded_messages": (lambda s, d: S.decode_events(messages(s, d)), DECODE_SQL),
    "decoded_messages_stream": (decoded_stream, DECODE_SQL),
    "assembled_answers": (lambda s, d: S.assemble_answers(answer_events(s, d)), ANSWERS_SQL),
    "changed_alerts_stream": (
        lambda s, d: finished(J.dedup_alerts(as_stream(signatures(s, d), "signatures")), "alerts"),
        f"WITH {SIGNATURE_CTE} SELECT user_id, sent_at, signature FROM sg QUALIFY signature IS DISTINCT FROM lag(signature) OVER (PARTITION BY user_id ORDER BY sent_at)",
    ),
    "metric_slices": (slices, f"WITH {SLICE_CTE} SELECT * FROM sl"),
    "metric_slices_stream": (
        slices_stream,
        f"WITH {SLICE_CTE} SELECT sl.* FROM sl WHERE slice_start + INTERVAL '5 minutes' <= (SELECT max(create_time) - INTERVAL '10 minutes' FROM r)",
    ),
    "rolling_rates": (
        rolling,
        f"""WITH {SLICE_CTE} SELECT user_id, {_sum('current', "slice_start >= TIMESTAMP '2024-01-16 00:00:00'")}, {_sum('baseline', "slice_start < TIMESTAMP '2024-01-16 00:00:00'")} FROM sl
WHERE slice_start >= TIMESTAMP '2024-01-01 00:00:00' AND slice_start < TIMESTAMP '2024-01-31 00:00:00' GROUP BY user_id""",
    ),
    "alert_changes": (alert_changes, _alerts_sql()),
    "alert_changes_stream": (alert_changes_stream, _alerts_sql("sent_at <= (SELECT max(create_time) - INTERVAL '10 minutes' FROM r)")),
    "ingest_stream": (ingest_job, None),
}
