"""Table maintenance, settings and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.catalog import base as B
from docflow.functions import text as X
from docflow.operators import tables as T
from docflow.session import work_path
from docflow.sources import readers, writers

col = F.col

# Two states of a chunk table: the second lacks short chunks, changes some and has new ones.
OLD_SQL = "SELECT doc_id, line_no AS chunk_index, concat(CAST(doc_id AS STRING), ':', CAST(line_no AS STRING)) AS chunk_id, line AS content FROM ({lines})"
NEW_SQL = """SELECT doc_id, line_no AS chunk_index, concat(CAST(doc_id AS STRING), ':', CAST(line_no AS STRING)) AS chunk_id,
 CASE WHEN line_no % 3 = 0 THEN concat(line, ' (changed)') ELSE line END AS content FROM ({lines}) WHERE length(line) > 40
 UNION ALL SELECT doc_id + 1000000, CAST(0 AS BIGINT), concat(CAST(doc_id + 1000000 AS STRING), ':0'), text FROM {documents}"""
OLD_D = OLD_SQL.replace("{lines}", B.LINES_SQL)
NEW_D = NEW_SQL.replace("{lines}", B.LINES_SQL).replace("{documents}", "documents")


def old(s, d):
    return B.sql_over(s, d, OLD_SQL.replace("{lines}", B.LINES), "documents")


def new(s, d):
    return B.sql_over(s, d, NEW_SQL.replace("{lines}", B.LINES), "documents")


KBS = """SELECT DISTINCT source AS kb_id, CASE WHEN source IN ('src1', 'src2') THEN CAST(0.5 AS DOUBLE) END AS similarity_threshold,
 CASE WHEN source IN ('src2', 'src3') THEN 12 ELSE 0 END AS vector_top_k, CASE WHEN source = 'src3' THEN 7 END AS keyword_top_k,
 CASE WHEN source = 'src1' THEN 'Short: %s' ELSE ' ' END AS prompt_template, CASE WHEN source = 'src4' THEN 1 ELSE 0 END AS deleted FROM {documents}"""
DEFAULTS = {"similarity_threshold": 0.3, "vector_top_k": 20, "keyword_top_k": 15, "prompt_template": "Default %s"}


def settings(s, d):
    q = B.load(s, d, "documents").select("doc_id", col("source").alias("kb_id"))
    return T.resolve_settings(q, B.sql_over(s, d, KBS, "documents"), DEFAULTS)


def contains(s, d):
    meta = F.create_map(F.lit("kbId"), col("source"), F.lit("lang"), col("lang"))
    rows = B.load(s, d, "documents").withColumn("metadata", meta)
    return rows.where(T.metadata_contains(col("metadata"), kbId="src1", lang="en")).select("doc_id", "lang")


def cascade(s, d):
    c = B.chunk_table(s, d)
    kbs = c.select("kb_id").distinct().withColumn("deleted", F.lit(0))
    gone = kbs.where(col("kb_id").isin("src1", "src3"))
    out = T.cascade_delete_kb({"kbs": kbs, "documents": c.select("doc_id", "kb_id", "deleted"),
                               "chunks": c.select("chunk_id", "kb_id"), "vectors": c.select("chunk_id", "kb_id")}, gone)
    tagged = [
        out["kbs"].select(F.lit("kb").alias("part"), col("kb_id").alias("id"), "deleted"),
        out["documents"].select(F.lit("document").alias("part"), col("doc_id").cast("string").alias("id"), "deleted"),
        *[out[t].select(F.lit(t).alias("part"), col("chunk_id").cast("string").alias("id"), F.lit(0).alias("deleted")) for t in ("chunks", "vectors")],
    ]
    r = tagged[0]
    for t in tagged[1:]:
        r = r.unionByName(t)
    return r


def stored_upsert(s, d):
    """The upsert through bucketed files."""
    path = work_path(s, "chunks")
    writers.write_buckets(old(s, d), path, "chunk_id", 16)
    writers.upsert_path(s, path, new(s, d), "chunk_id", 16)
    return writers.read_buckets(s, path)


def stored_replace(s, d):
    path = work_path(s, "doc-chunks")
    writers.write_buckets(old(s, d), path, "doc_id", 16)
    writers.replace_path(s, path, new(s, d), 16)
    writers.replace_path(s, path, new(s, d), 16)  # a repeated run changes nothing
    return writers.read_buckets(s, path)


def event_log(s, d):
    """Append the log twice as it grows, read the newest state back."""
    path = work_path(s, "log")
    e = B.load(s, d, "events").select("event_id", "user_id", col("ts").alias("create_time"))
    half = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    writers.append_events(e.where(col("create_time") < half), path)
    writers.append_events(e.where(col("create_time") >= half).withColumn("status", F.lit("SUCCESS")), path)
    return T.latest_state(s.read.parquet(path), "user_id", ["create_time", "event_id"])


def text_files(s, d):
    """One text file per language partition, read back whole."""
    path = work_path(s, "texts")
    src = B.load(s, d, "benchmark").select("item_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    src.repartitionByRange(4, "item_id").sortWithinPartitions("item_id").select("value").write.text(path)
    whole = readers.read_text_documents(s, path)
    return whole.select(F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"))


def routed(s, d):
    name = F.concat(col("doc_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".MD", ".html", ".txt", ".xyz")]), (col("doc_id") % 4 + 1).cast("int")))
    src = B.load(s, d, "documents").select("doc_id", name.alias("file_name"), "text")
    keep = lambda df: df.select("doc_id", "text")
    ok, bad = readers.route_by_type(src, {"markdown": keep, "html": keep, "text": keep})
    return ok.select("doc_id", "parser", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("doc_id", F.lit(None).cast("string").alias("parser"), "error")
    )


def diff(s, d):
    h = lambda df: df.select("doc_id", X.content_hash(col("content")).alias("content_hash"))
    return T.chunk_diff(h(old(s, d)), h(new(s, d)))


def latest_logs(s, d):
    t = B.tasks(s, d).select("task_id", "doc_id", "status")
    logs = B.load(s, d, "lineitem").select(
        (col("l_orderkey") % 150).alias("doc_id"), col("l_shipdate").alias("create_time"),
        (col("l_orderkey") * 10 + col("l_linenumber")).alias("log_no"), col("l_returnflag").alias("result"),
    )
    return T.latest_log(t, logs, ["create_time", "log_no"])


def stats(s, d):
    c = old(s, d).withColumn("char_count", F.length("content").cast("bigint")).withColumn("token_count", X.estimate_tokens(col("content")))
    return T.document_stats(c)


ENTRIES: dict[str, B.Entry] = {
    "visible_rows": (
        lambda s, d: T.visible(B.tasks(s, d).withColumn("deleted", (col("task_id") % 6 == 0).cast("int")), 7).select("task_id", "create_time"),
        f"WITH t AS ({B.TASKS_SQL}) SELECT task_id, create_time FROM t WHERE created_by = 7 AND task_id % 6 <> 0",
    ),
    "metadata_filter": (contains, "SELECT doc_id, lang FROM documents WHERE source = 'src1' AND lang = 'en'"),
    "resolved_settings": (
        settings,
        f"""WITH k AS (SELECT * FROM ({B._both(KBS, 'documents')[1]}) WHERE deleted = 0)
SELECT doc_id, source AS kb_id, coalesce(similarity_threshold, 0.3::DOUBLE) AS similarity_threshold, coalesce(CASE WHEN vector_top_k > 0 THEN vector_top_k END, 20) AS vector_top_k,
coalesce(CASE WHEN keyword_top_k > 0 THEN keyword_top_k END, 15) AS keyword_top_k, CASE WHEN regexp_matches(prompt_template, '\\S') THEN prompt_template ELSE 'Default %s' END AS prompt_template
FROM documents LEFT JOIN k ON source = kb_id""",
    ),
    "newest_runs": (
        lambda s, d: T.latest_n(B.runs(s, d), 500, hi=100, tie="trace_id").select("trace_id", "create_time"),
        f"WITH r AS ({B.RUNS_SQL}) SELECT trace_id, create_time FROM r ORDER BY create_time DESC, trace_id LIMIT 100",
    ),
    "newest_feedback": (
        lambda s, d: T.latest_n(B.feedback(s, d), None, hi=200, tie="trace_id").select("trace_id", "rating"),
        f"WITH f AS ({B.FEEDBACK_SQL}) SELECT trace_id, rating FROM f ORDER BY create_time DESC, trace_id LIMIT 50",
    ),
    "upsert_vectors": (
        lambda s, d: T.upsert_vectors(old(s, d), new(s, d)),
        f"WITH o AS ({OLD_D}), n AS ({NEW_D}) SELECT * FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM n) UNION ALL SELECT * FROM n",
    ),
    "upsert_stored": (
        stored_upsert,
        f"WITH o AS ({OLD_D}), n AS ({NEW_D}) SELECT * FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM n) UNION ALL SELECT * FROM n",
    ),
    "delete_by_document": (
        lambda s, d: T.delete_by(old(s, d), B.load(s, d, "labels").where("toxic = 1"), "doc_id"),
        f"WITH o AS ({OLD_D}) SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    ),
    "cascade_delete": (
        cascade,
        f"""WITH c AS ({B.CHUNKS_SQL}), g AS (SELECT * FROM c WHERE kb_id NOT IN ('src1', 'src3'))
SELECT 'kb' AS part, kb_id AS id, CAST(max(CASE WHEN kb_id IN ('src1', 'src3') THEN 1 ELSE 0 END) AS INTEGER) AS deleted FROM c GROUP BY kb_id
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), CASE WHEN kb_id IN ('src1', 'src3') THEN 1 ELSE 0 END FROM c
UNION ALL SELECT 'chunks', CAST(chunk_id AS VARCHAR), 0 FROM g UNION ALL SELECT 'vectors', CAST(chunk_id AS VARCHAR), 0 FROM g""",
    ),
    "replace_documents": (
        lambda s, d: T.replace_document_chunks(old(s, d), new(s, d)),
        f"WITH o AS ({OLD_D}), n AS ({NEW_D}) SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n",
    ),
    "replace_stored": (
        stored_replace,
        f"WITH o AS ({OLD_D}), n AS ({NEW_D}) SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n",
    ),
    "chunk_diff": (
        diff,
        f"""WITH o AS (SELECT doc_id, sha256(content) AS content_hash, count(*) AS old_copies FROM ({OLD_D}) GROUP BY ALL),
n AS (SELECT doc_id, sha256(content) AS content_hash, count(*) AS new_copies FROM ({NEW_D}) GROUP BY ALL)
SELECT doc_id, content_hash, coalesce(old_copies, 0) AS old_copies, coalesce(new_copies, 0) AS new_copies,
CASE WHEN old_copies IS NULL THEN 'add' WHEN new_copies IS NULL THEN 'drop' ELSE 'keep' END AS action FROM o FULL JOIN n USING (doc_id, content_hash)""",
    ),
    "latest_state": (
        lambda s, d: T.latest_state(B.tasks(s, d).select("doc_id", "task_id", "status", "create_time"), "doc_id", ["create_time", "task_id"]),
        f"""WITH t AS ({B.TASKS_SQL}) SELECT doc_id, task_id, status, create_time FROM t
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY create_time DESC, task_id DESC) = 1""",
    ),
    "latest_log": (
        latest_logs,
        f"""WITH t AS ({B.TASKS_SQL}), l AS (SELECT l_orderkey % 150 AS doc_id, l_shipdate AS log_create_time, l_orderkey * 10 + l_linenumber AS log_log_no, l_returnflag AS log_result FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey % 150 ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC) = 1)
SELECT t.doc_id, task_id, status, log_create_time, log_log_no, log_result FROM t LEFT JOIN l ON t.doc_id = l.doc_id""",
    ),
    "document_stats": (
        stats,
        rf"""WITH o AS ({OLD_D}) SELECT doc_id, count(*) AS chunk_count, CAST(sum(length(content)) AS BIGINT) AS char_count,
CAST(sum(CASE WHEN regexp_matches(content, '\S') THEN CAST(ceil(length(content) / 4e0) AS BIGINT) ELSE 0 END) AS BIGINT) AS token_count FROM o GROUP BY doc_id""",
    ),
    "event_log": (
        event_log,
        """SELECT user_id, event_id, ts AS create_time, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'RUNNING' ELSE 'SUCCESS' END AS status FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    ),
    "text_files": (text_files, "SELECT replace(text, chr(10), ' ') AS line FROM benchmark"),
    "routed_documents": (
        routed,
        """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'html' WHEN 2 THEN 'text' END AS parser,
CASE WHEN doc_id % 4 = 3 THEN 'Unsupported file type: xyz' END AS error FROM documents""",
    ),
}
