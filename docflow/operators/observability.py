"""Operational metrics and alerts from runs, nodes, tasks and feedback."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.records import duration_ms, json_double, json_long, json_text
from docflow.functions.text import (
    estimate_cost,
    estimate_tokens,
    ratio,
    round_half_up,
    tokens_for_chars,
)
from docflow.operators.ordered import lag, ordered, row_number, slicing

# Fixed default thresholds.
ALERT_DEFAULTS = {
    "min_samples": 5,
    "failures": 3,
    "success_drop": 0.15,
    "error_rate": 0.20,
    "error_rise": 0.10,
}


def clamp_hours(hours: int, most: int | None = None) -> int:
    """Length of a window: a day where none is given, at most ``most`` hours if that is given."""
    hours = hours if hours > 0 else 24
    return hours if most is None else min(hours, most)


def in_window(df: DataFrame, start: datetime, end: datetime, column: str = "create_time") -> DataFrame:
    at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    return df.where((F.col(column) >= at(start)) & (F.col(column) < at(end)))


def runs_with_node(runs: DataFrame, nodes: DataFrame, node_type: str, status: str) -> DataFrame:
    """Runs that have a node of this type and status. Node ids are made distinct first."""
    hit = nodes.where((F.col("node_type") == node_type) & (F.col("status") == status))
    return runs.join(hit.select("trace_id").distinct(), "trace_id", "left_semi")


def chunk_tokens() -> Column:
    """Stored token count, else by character count, else by content."""
    return (
        F.when(F.col("token_count") > 0, F.col("token_count").cast("bigint"))
        .when(F.col("char_count") > 0, tokens_for_chars(F.col("char_count")))
        .otherwise(estimate_tokens(F.col("content")))
    )


def document_tokens(chunks: DataFrame) -> DataFrame:
    return (
        chunks.where(F.col("deleted") == 0)
        .groupBy("doc_id")
        .agg(F.sum(F.coalesce(chunk_tokens(), F.lit(0))).cast("bigint").alias("tokens"))
    )


def ingestion_tokens(tasks: DataFrame, chunks: DataFrame, by: str = "created_by") -> DataFrame:
    """Tokens of the documents whose task succeeded, each document once per ``by``.

    Both sides are one row per document before they meet.
    """
    done = tasks.where((F.col("status") == "SUCCESS") & F.col("doc_id").isNotNull())
    return (
        done.select(by, "doc_id")
        .distinct()
        .join(document_tokens(chunks), "doc_id")
        .groupBy(by)
        .agg(F.sum("tokens").cast("bigint").alias("ingestion_tokens"))
    )


def trace_detail(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every run with its nodes in time order: one row per node, ``node_order`` from 1.

    A run without nodes keeps one row. Node rows stay rows, so a run with very
    many nodes is never gathered.
    """
    plan = slicing(nodes, ["trace_id"], ["create_time", "node_type"])
    placed = ordered(nodes, plan, node_order=row_number()).select(
        "trace_id", "node_order", F.col("node_type"), F.col("status").alias("node_status"),
        F.col("duration_ms").alias("node_duration_ms"),
    )
    return runs.join(placed, "trace_id", "left")


def feedback_summary(df: DataFrame, by: str | Sequence[str]) -> DataFrame:
    keys = [by] if isinstance(by, str) else list(by)
    r = F.col("rating")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(r >= 4).alias("positive"),
        F.count_if(r == 3).alias("neutral"),
        F.count_if(r <= 2).alias("negative"),
        F.coalesce(F.avg("rating"), F.lit(0.0)).alias("average"),
    )


def active_users(runs: DataFrame, tasks: DataFrame, since: datetime, names: Sequence[str] = ("rag_query",)) -> DataFrame:
    """Users with a run or a task since a time. Each side is distinct before the union."""
    at = F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz")
    a = runs.where(
        F.col("trace_name").isin(*names) & (F.col("deleted") == 0) & (F.col("create_time") >= at)
    ).select("user_id")
    b = tasks.where(F.col("create_time") >= at).select(F.col("created_by").alias("user_id"))
    both = a.where(F.col("user_id").isNotNull()).unionByName(b.where(F.col("user_id").isNotNull()))
    return both.distinct()


def rag_metrics(
    runs: DataFrame, nodes: DataFrame, tasks: DataFrame, chunks: DataFrame,
    start: datetime, end: datetime, names: Sequence[str] = ("rag_query",),
) -> DataFrame:
    """All metrics of a time window, one row per user, in one job."""
    r = in_window(runs, start, end).where(
        F.col("trace_name").isin(*names) & (F.col("deleted") == 0)
    )
    failing = (
        nodes.where((F.col("node_type") == "generate") & (F.col("status") == "ERROR"))
        .select("trace_id")
        .distinct()
        .withColumn("_bad", F.lit(True))
    )
    state = json_text(F.col("extra_data"), "answerState")
    if "answer_state" in runs.columns:
        state = F.coalesce(state, F.col("answer_state"))
    long = lambda k: F.sum(json_long(F.col("extra_data"), k))
    money = lambda k: F.sum(json_double(F.col("extra_data"), k))
    by_user = (
        r.join(failing, "trace_id", "left")
        .withColumn("_state", state)
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("total_queries"),
            F.count_if(F.col("status") == "SUCCESS").alias("successful_queries"),
            F.count_if(F.col("status") == "ERROR").alias("failed_queries"),
            F.count_if(F.col("_state") == "empty_retrieval").alias("_empty"),
            F.count_if(F.col("_state").isin("empty_retrieval", "refused")).alias("_refused"),
            F.avg(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))).alias("_duration"),
            F.count_if(F.col("_bad")).alias("_bad"),
            long("estimatedChatInputTokens").alias("chat_input_tokens"),
            long("estimatedChatOutputTokens").alias("chat_output_tokens"),
            long("estimatedEmbeddingTokens").alias("query_embedding_tokens"),
            (money("estimatedChatInputCost") + money("estimatedChatOutputCost")).alias("_chat_cost"),
            money("estimatedEmbeddingCost").alias("_query_cost"),
        )
    )
    t = in_window(tasks, start, end)
    taken = F.when(
        F.col("started_at").isNotNull() & F.col("completed_at").isNotNull(),
        duration_ms(F.col("started_at"), F.col("completed_at")),
    )
    by_owner = (
        t.groupBy(F.col("created_by").alias("user_id"))
        .agg(
            F.count(F.lit(1)).alias("total_tasks"),
            F.count_if(F.col("status").isin("SUCCESS", "FAILED")).alias("terminal_tasks"),
            F.count_if(F.col("status") == "SUCCESS").alias("_done"),
            F.count_if(F.col("retry_count") > 0).alias("_retried"),
            F.avg(taken).alias("_task_duration"),
        )
    )
    tokens = ingestion_tokens(t, chunks).withColumnRenamed("created_by", "user_id")
    m = by_user.join(by_owner, "user_id", "full_outer").join(tokens, "user_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    real = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    embedding = round_half_up(
        real("_query_cost") + estimate_cost(zero("ingestion_tokens"), "embedding"), 6
    )
    counts = [
        "total_queries", "successful_queries", "failed_queries", "total_tasks", "terminal_tasks",
        "chat_input_tokens", "chat_output_tokens", "query_embedding_tokens", "ingestion_tokens",
    ]
    return m.select(
        "user_id",
        *[zero(c).alias(c) for c in counts],
        ratio(zero("_empty"), zero("successful_queries")).alias("empty_retrieval_rate"),
        ratio(zero("_refused"), zero("successful_queries")).alias("refusal_rate"),
        round_half_up(real("_duration"), 2).alias("average_response_ms"),
        ratio(zero("_bad"), zero("total_queries")).alias("model_error_rate"),
        ratio(zero("_done"), zero("terminal_tasks")).alias("task_success_rate"),
        ratio(zero("_retried"), zero("total_tasks")).alias("task_retry_rate"),
        round_half_up(real("_task_duration"), 2).alias("average_task_ms"),
        (
            zero("chat_input_tokens") + zero("chat_output_tokens")
            + zero("query_embedding_tokens") + zero("ingestion_tokens")
        ).alias("total_tokens"),
        round_half_up(real("_chat_cost"), 6).alias("chat_cost"),
        embedding.alias("embedding_cost"),
        round_half_up(real("_chat_cost") + embedding, 6).alias("total_cost"),
    )


def failure_streak(tasks: DataFrame, n: int = 10, tie: str = "task_id") -> DataFrame:
    """Leading failures among the newest ``n`` tasks of a user.

    The row_number cut plans as a partial and final group limit, so at most n
    rows of a user leave any partition.
    """
    w = Window.partitionBy("created_by").orderBy(F.col("create_time").desc(), F.col(tie).desc())
    newest = tasks.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return newest.groupBy(F.col("created_by").alias("user_id")).agg(
        F.count(F.lit(1)).alias("recent_tasks"),
        F.coalesce(
            F.min(F.when(F.col("status") != "FAILED", F.col("_rn"))) - 1, F.count(F.lit(1))
        ).cast("bigint").alias("failures"),
    )


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    """Last ``n`` turns of each conversation; ``turn`` keeps the reading order."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return (
        messages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    )


def alerts(
    current: DataFrame, baseline: DataFrame, streaks: DataFrame, cfg: Mapping[str, float] | None = None
) -> DataFrame:
    """Three alerts per user: (user_id, code, level, status, current_value, baseline_value, threshold)."""
    c = {**ALERT_DEFAULTS, **(cfg or {})}
    cur = current.select(
        "user_id", F.col("successful_queries").alias("_cs"), F.col("total_queries").alias("_ct"),
        (F.lit(1.0) - F.col("empty_retrieval_rate")).alias("_cr"), F.col("model_error_rate").alias("_ce"),
    )
    base = baseline.select(
        "user_id", F.col("successful_queries").alias("_bs"), F.col("total_queries").alias("_bt"),
        (F.lit(1.0) - F.col("empty_retrieval_rate")).alias("_br"), F.col("model_error_rate").alias("_be"),
    )
    both = cur.join(base, "user_id", "full_outer").join(
        streaks.select("user_id", "failures"), "user_id", "full_outer"
    )
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    f = lambda x, d: F.coalesce(F.col(x), F.lit(d))
    cr, br = f("_cr", 1.0), f("_br", 1.0)
    ce, be = f("_ce", 0.0), f("_be", 0.0)
    few_s = (n("_cs") < c["min_samples"]) | (n("_bs") < c["min_samples"])
    few_t = (n("_ct") < c["min_samples"]) | (n("_bt") < c["min_samples"])
    drop = br - cr >= c["success_drop"]
    spike = (ce >= c["error_rate"]) & (ce - be >= c["error_rise"])
    failing = n("failures") >= c["failures"]

    def alert(code: str, hot: str, few: Column, on: Column, now: Column, then: Column, limit: float) -> Column:
        status = F.when(few, "INSUFFICIENT_DATA").when(on, "ACTIVE").otherwise("OK")
        return F.struct(
            F.lit(code).alias("code"),
            F.when(status == "ACTIVE", hot).otherwise("info").alias("level"),
            status.alias("status"),
            now.cast("double").alias("current_value"),
            then.cast("double").alias("baseline_value"),
            F.lit(float(limit)).alias("threshold"),
        )

    rows = F.array(
        alert("ingestion_consecutive_failures", "critical", F.lit(False), failing, n("failures"), F.lit(None), c["failures"]),
        alert("retrieval_quality_decline", "warning", few_s, drop, cr, br, c["success_drop"]),
        alert("model_error_rate_spike", "warning", few_t, spike, ce, be, c["error_rate"]),
    )
    return both.select("user_id", F.inline(rows))


def window_alerts(
    runs: DataFrame, nodes: DataFrame, tasks: DataFrame, chunks: DataFrame, now: datetime,
    hours: int = 24, baseline_hours: int = 24, cfg: Mapping[str, float] | None = None,
    names: Sequence[str] = ("rag_query",),
) -> DataFrame:
    """Alerts of the last ``hours`` against the window before."""
    start = now - timedelta(hours=clamp_hours(hours))
    before = start - timedelta(hours=clamp_hours(baseline_hours))
    current = rag_metrics(runs, nodes, tasks, chunks, start, now, names)
    baseline = rag_metrics(runs, nodes, tasks, chunks, before, start, names)
    return alerts(current, baseline, failure_streak(tasks), cfg)


def alert_signature(active: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Sorted ``code:status:value`` entries per key. A key has one entry per alert code."""
    entry = F.concat_ws(":", "code", "status", F.col("current_value").cast("string"))
    return active.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_set(entry)), "|").alias("signature")
    )


def changed_signatures(signatures: DataFrame, order: str, force: bool = False) -> DataFrame:
    """Signatures that differ from the one sent before for the same user."""
    plan = slicing(signatures, ["user_id"], [order])
    seen = ordered(signatures, plan, _last=lag(F.col("signature")))
    changed = F.lit(True) if force else ~F.col("signature").eqNullSafe(F.col("_last"))
    return seen.where(changed).drop("_last")


def phase_nodes(logs: DataFrame, failures: DataFrame) -> DataFrame:
    """Phases of a processed document with duration and status.

    ``logs`` has (task_id, doc_id, extract_ms, chunk_ms, embed_ms, persist_ms,
    chunk_count), ``failures`` (task_id, error). The first phase without a
    duration is the failed one.
    """
    names = [("parse", "extract_ms", "Document parsed"), ("chunk", "chunk_ms", "Document chunked"),
             ("embed", "embed_ms", "Embeddings generated"), ("persist", "persist_ms", "Chunks and vectors persisted")]
    joined = failures.join(logs, "task_id", "full_outer")
    missing = F.lit("persist")
    for phase, column, _ in reversed(names):
        missing = F.when(F.col(column).isNull(), phase).otherwise(missing)
    failed = F.when(F.col("error").isNotNull(), missing)
    rows = F.array(
        *[
            F.struct(
                F.lit(phase).alias("phase"), F.lit(i).alias("phase_order"),
                F.col(column).cast("bigint").alias("_ms"), F.lit(message).alias("_message"),
            )
            for i, (phase, column, message) in enumerate(names, 1)
        ]
    )
    flat = joined.select("task_id", "doc_id", "error", "chunk_count", failed.alias("_failed"), F.inline(rows))
    is_failed = F.coalesce(F.col("phase") == F.col("_failed"), F.lit(False))
    return flat.where(F.col("_ms").isNotNull() | is_failed).select(
        "task_id", "doc_id", "phase", "phase_order",
        F.when(is_failed, "FAILED").otherwise("SUCCESS").alias("status"),
        F.coalesce("_ms", F.lit(0)).cast("bigint").alias("duration_ms"),
        F.when(is_failed, F.col("error")).otherwise(F.col("_message")).alias("message"),
        F.when(
            ~is_failed & F.col("phase").isin("chunk", "persist"),
            F.coalesce("chunk_count", F.lit(0)).cast("bigint"),
        ).alias("chunk_count"),
    )
