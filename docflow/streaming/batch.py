"""Batch twins of the streaming jobs: the same rules over finished tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.operators.ordered import lag, ordered, running_sum, slicing
from docflow.streaming.state import (
    MINUTE_MS,
    full_after_ms,
    next_task_state,
    take_token,
)


def fold_sorted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str],
    step: Callable[[object, tuple], tuple[object, tuple]], inputs: Sequence[str], schema: T.StructType,
) -> DataFrame:
    """Carry a state through the rows of every key in order; one output row per input row.

    Rows are streamed in sorted Arrow batches and only the state of the current
    key is kept, so the size of a key does not matter for memory.
    ``step(state, row) -> (state, output)``; output follows the keys in ``schema``.
    """
    names = schema.fieldNames()
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            key_rows = zip(*[batch[k] for k in keys])
            for key, row in zip(key_rows, zip(*[batch[c] for c in inputs])):
                if key != current:
                    current, state = key, None
                state, values = step(state, row)
                out.append((*key, *values))
            yield pd.DataFrame(out, columns=names)

    return (
        df.select(*dict.fromkeys([*keys, *order, *inputs]))
        .repartition(*keys)
        .sortWithinPartitions(*keys, *order)
        .mapInPandas(run, schema)
    )


def rate_limit(
    events: DataFrame, key: str = "user_id", ts: str = "ts", event_id: str = "event_id",
    capacity: int = 60, refill: int = 30, window_ms: int = MINUTE_MS,
) -> DataFrame:
    """Token bucket per key: (key, event_id, allowed, tokens).

    After an idle time long enough to fill the bucket nothing of the past
    matters, so a key is cut there and its sessions run in parallel.
    """
    idle = full_after_ms(capacity, refill, window_ms)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    timed = events.select(
        key, event_id, F.timestamp_diff("MILLISECOND", epoch, F.col(ts).cast("timestamp_ntz")).alias("_ms")
    )
    plan = slicing(timed, [key], ["_ms", event_id])
    seen = ordered(timed, plan, _before=lag(F.col("_ms")))
    fresh = F.col("_before").isNull() | (F.col("_ms") - F.col("_before") >= idle)
    cut = ordered(seen.withColumn("_new", F.when(fresh, 1).otherwise(0)), plan, _session=running_sum(F.col("_new")))

    def step(state, row):
        tokens, last = state or (None, None)
        ok, tokens, last = take_token(tokens, last, row[1], capacity, refill, window_ms)
        return (tokens, last), (row[0], ok, tokens)

    schema = T.StructType(
        [
            T.StructField(key, events.schema[key].dataType),
            T.StructField("_session", T.LongType()),
            T.StructField(event_id, events.schema[event_id].dataType),
            T.StructField("allowed", T.BooleanType()),
            T.StructField("tokens", T.LongType()),
        ]
    )
    return fold_sorted(cut, [key, "_session"], ["_ms", event_id], step, [event_id, "_ms"], schema).drop("_session")


STATE = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("retry_count", T.LongType()),
        T.StructField("next_run_at", T.TimestampNTZType()),
        T.StructField("lease_until", T.TimestampNTZType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("completed_at", T.TimestampNTZType()),
    ]
)


def task_states(events: DataFrame) -> DataFrame:
    """State of a task after each of its events.

    ``events`` has (task_id, seq, event, at); the newest row per task
    (``latest_state``) is its current state.
    """
    schema = T.StructType(
        [T.StructField("task_id", events.schema["task_id"].dataType),
         T.StructField("seq", events.schema["seq"].dataType), *STATE.fields]
    )
    fields = STATE.fieldNames()

    def step(state, row):
        state = next_task_state(state, row[1], row[2])
        return state, (row[0], *[state[f] for f in fields])

    return fold_sorted(events, ["task_id"], ["seq", "event", "at"], step, ["seq", "event", "at"], schema)


def open_tasks(tasks: DataFrame) -> DataFrame:
    """At most one open task per document: the newest of its queued or running ones."""
    is_open = tasks.where(F.col("status").isin("QUEUED", "RUNNING"))
    rest = [c for c in tasks.columns if c != "doc_id"]
    newest = F.max_by(F.struct(*rest), F.struct("create_time", "task_id")).alias("_t")
    return is_open.groupBy("doc_id").agg(newest).select("doc_id", "_t.*")


EVENT = T.StructType(
    [
        T.StructField("eventId", T.StringType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)


def decode_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """Queue messages to (event_id, event_type, doc_id, task_id, ts); unusable ones are dropped."""
    m = messages.select(F.from_json(F.col(column), EVENT).alias("e"))
    return m.select(
        F.col("e.eventId").alias("event_id"),
        F.col("e.eventType").alias("event_type"),
        F.try_element_at("e.payload", F.lit("docId")).alias("doc_id"),
        F.try_element_at("e.payload", F.lit("taskId")).alias("task_id"),
        F.col("e.timestamp").alias("ts"),
    ).where(F.col("doc_id").isNotNull())


def decode_events(messages: DataFrame, column: str = "value") -> DataFrame:
    """Decoded messages, each event id once (the earliest)."""
    decoded = decode_messages(messages, column)
    rest = ["event_type", "doc_id", "task_id", "ts"]
    first = F.min_by(F.struct(*rest), F.struct("ts", "doc_id", "task_id", "event_type")).alias("_e")
    return decoded.groupBy("event_id").agg(first).select("event_id", "_e.*")


PART_EVENTS = 10_000


def assemble_answers(events: DataFrame) -> DataFrame:
    """Answer text per trace from its chunk events, with metadata and verification.

    ``events`` has (trace_id, seq, type, data). Text is joined in parts of
    bounded size first; only traces that are done and have metadata count.
    """
    parts = events.groupBy("trace_id", F.floor(F.col("seq") / PART_EVENTS).alias("_part")).agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(F.when(F.col("type") == "chunk", F.struct("seq", "data")))
                ),
                lambda x: x["data"],
            ),
            "",
        ).alias("_text"),
        F.max_by(F.when(F.col("type") == "metadata", F.col("data")), F.when(F.col("type") == "metadata", F.col("seq"))).alias("_meta"),
        F.max_by(F.when(F.col("type") == "verification", F.col("data")), F.when(F.col("type") == "verification", F.col("seq"))).alias("_check"),
        F.count_if(F.col("type") == "chunk").alias("_chunks"),
        F.bool_or(F.col("type") == "done").alias("_done"),
    )
    whole = parts.groupBy("trace_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_part", "_text"))), lambda x: x["_text"]), ""
        ).alias("answer"),
        F.max_by("_meta", F.when(F.col("_meta").isNotNull(), F.col("_part"))).alias("metadata"),
        F.max_by("_check", F.when(F.col("_check").isNotNull(), F.col("_part"))).alias("verification"),
        F.sum("_chunks").alias("chunks"),
        F.bool_or("_done").alias("_done"),
    )
    return whole.where(F.col("_done") & F.col("metadata").isNotNull()).drop("_done")


def metric_slices(runs: DataFrame, every: str = "5 minutes", names: Sequence[str] = ("rag_query",)) -> DataFrame:
    """Run counts per user and time slice: the partial sums behind rolling metrics.

    Slices do not overlap, so an event is counted once and not once per rolling
    window. Works on tables and, with a watermark, on streams.
    """
    kept = runs.where(F.col("trace_name").isin(*names) & (F.col("deleted") == 0))
    return (
        kept.groupBy("user_id", F.window("create_time", every).alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("status") == "SUCCESS").alias("successful"),
            F.count_if(F.col("status") == "ERROR").alias("failed"),
            F.count_if(F.col("answer_state") == "empty_retrieval").alias("empty"),
        )
        .select("user_id", F.col("_w.start").alias("slice_start"), "total", "successful", "failed", "empty")
    )
