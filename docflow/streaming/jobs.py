"""Structured Streaming jobs.

Writers use checkpoints below the shared work folder and sinks that can be
repeated after a failure.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docflow.hooks import Embedder
from docflow.operators.observability import clamp_hours
from docflow.plans.ingest import ingest
from docflow.session import work_path
from docflow.sources.buckets import replace_path, table_exists, write_buckets
from docflow.streaming import state
from docflow.streaming.batch import STATE, decode_messages, metric_slices
from docflow.streaming.state import (
    MINUTE_MS,
    full_after_ms,
    next_task_state,
    take_token,
)


# The worker that sets up a stateful operator starts before shipped files are on its
# path; the processors and their rules therefore travel with the query itself.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(state)


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB, not on the heap."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def run_available(stream: DataFrame, path: str, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet files and read them back."""
    spark = stream.sparkSession
    q = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint or work_path(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def ingest_stream(
    documents: DataFrame, embedder: Embedder, chunk_path: str, vector_path: str, checkpoint: str,
    buckets: int = 64,
) -> StreamingQuery:
    """Parse, chunk, embed and store uploaded documents as they arrive.

    Every micro-batch replaces whole documents, so a repeated batch or a
    re-delivered document leaves the same tables. Within a batch the newest
    upload of a document wins.
    """

    def store(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != "doc_id"]
        newest = batch.groupBy("doc_id").agg(
            F.max_by(F.struct(*rest), F.struct("uploaded_at", "text")).alias("_d")
        ).select("doc_id", "_d.*").persist()
        try:
            out = ingest(newest, embedder)
            for df, path in ((out.chunks, chunk_path), (out.vectors, vector_path)):
                if table_exists(spark, path):
                    replace_path(spark, path, df, buckets, newest.select("doc_id"))
                else:
                    write_buckets(df, path, "doc_id", buckets)
        finally:
            newest.unpersist()

    return (
        documents.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


BUCKET = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("last", T.LongType())])


def _millis(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[ms]").astype("int64")


class TokenBucket(StatefulProcessor):
    """Token bucket of one key. Idle keys are dropped once they would be full."""

    def __init__(self, capacity: int, refill: int, window_ms: int):
        self.rule = (capacity, refill, window_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", BUCKET)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tokens, last = self.bucket.get() if self.bucket.exists() else (None, None)
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for event_id, now in zip(batch["event_id"], _millis(batch["ts"])):
            ok, tokens, last = take_token(tokens, last, int(now), *self.rule)
            out.append((key[0], event_id, ok, tokens))
        self.bucket.update((tokens, last))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(_millis(batch["ts"]).iloc[-1]) + full_after_ms(*self.rule))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed", "tokens"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        yield pd.DataFrame([], columns=["user_id", "event_id", "allowed", "tokens"])

    def close(self) -> None:
        pass


def rate_limit_stream(
    events: DataFrame, capacity: int = 60, refill: int = 30, window_ms: int = MINUTE_MS,
    delay: str = "1 minute",
) -> DataFrame:
    """Streaming token bucket over (user_id, event_id, ts)."""
    use_rocksdb(events.sparkSession)
    timed = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    schema = T.StructType(
        [T.StructField("user_id", events.schema["user_id"].dataType),
         T.StructField("event_id", events.schema["event_id"].dataType),
         T.StructField("allowed", T.BooleanType()), T.StructField("tokens", T.LongType())]
    )
    return timed.withWatermark("ts", delay).groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=TokenBucket(capacity, refill, window_ms), outputStructType=schema,
        outputMode="append", timeMode="EventTime",
    )


class LastSignature(StatefulProcessor):
    """Lets a signature pass only if it differs from the last one of the key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "signature string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        batch = pd.concat(list(rows)).sort_values("sent_at")
        out = []
        for at, signature in zip(batch["sent_at"], batch["signature"]):
            if signature != last:
                out.append((key[0], at, signature))
                last = signature
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "sent_at", "signature"])

    def close(self) -> None:
        pass


def dedup_alerts(signatures: DataFrame) -> DataFrame:
    """Streaming twin of ``changed_signatures`` over (user_id, sent_at, signature)."""
    use_rocksdb(signatures.sparkSession)
    schema = signatures.select("user_id", "sent_at", "signature").schema
    return signatures.select("user_id", "sent_at", "signature").groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=LastSignature(), outputStructType=schema, outputMode="update", timeMode="None",
    )


LANES = 4096  # tasks whose rows of a micro-batch come to Python together


class TaskMachine(StatefulProcessor):
    """State machines of the ingestion tasks of one lane.

    The state stays one entry per task. What costs per key of a stateful operator, a
    frame in, a frame out and several calls to the store, is paid per lane; a task costs
    one write, and one read once the lane holds anything.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tasks = handle.getMapState("tasks", "task string", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, known = STATE.fieldNames(), self.tasks.exists()
        batch = pd.concat(list(rows)).sort_values(["task", "last", "seq", "event", "at"])
        out, state, current = [], None, None
        for row in zip(*(batch[c] for c in ("task", "last", "seq", "event", "at"))):
            if row[0] != current:
                self._put(current, state)
                current, state = row[0], None
                if known and self.tasks.containsKey((current,)):
                    state = dict(zip(names, self.tasks.getValue((current,))))
            state = next_task_state(state, row[3], row[4].to_pydatetime())
            out.append((*row[:3], *[state[n] for n in names]))
        self._put(current, state)
        yield pd.DataFrame(out, columns=["task", "last", "seq", *names])

    def _put(self, task: str | None, state: dict | None) -> None:
        if state is not None:
            self.tasks.updateValue((task,), tuple(state[n] for n in STATE.fieldNames()))

    def close(self) -> None:
        pass


def task_state_stream(events: DataFrame) -> DataFrame:
    """Streaming twin of ``task_states`` over (task_id, seq, event, at).

    Ids travel as text and a missing ``seq`` as a flag, so that a null beside them does
    not turn numbers into floats.
    """
    use_rocksdb(events.sparkSession)
    task, seq = events.schema["task_id"], events.schema["seq"]
    named = F.coalesce(F.concat(F.lit("="), F.col("task_id").cast("string")), F.lit(""))
    laid = events.select(
        F.pmod(F.xxhash64("task_id"), F.lit(LANES)).alias("lane"), named.alias("task"), F.col("seq").isNull().alias("last"),
        F.coalesce("seq", F.lit("0").cast(seq.dataType)).alias("seq"), "event", "at",
    )
    schema = T.StructType([T.StructField("task", T.StringType()), T.StructField("last", T.BooleanType()), seq, *STATE.fields])
    states = laid.groupBy("lane").transformWithStateInPandas(
        statefulProcessor=TaskMachine(), outputStructType=schema, outputMode="update", timeMode="None",
    )
    return states.select(
        F.when(F.col("task") != "", F.substring("task", 2, 2**31 - 1)).cast(task.dataType).alias("task_id"),
        F.when(~F.col("last"), F.col("seq")).alias("seq"), *STATE.fieldNames(),
    )


def decode_stream(messages: DataFrame, delay: str = "10 minutes", column: str = "value") -> DataFrame:
    """Decoded queue messages, repeated event ids dropped within the watermark."""
    decoded = decode_messages(messages, column).withColumn("ts", F.col("ts").cast("timestamp"))
    return decoded.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def slice_stream(runs: DataFrame, every: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Streaming metric slices, emitted once their time has passed."""
    timed = runs.withColumn("create_time", F.col("create_time").cast("timestamp"))
    return metric_slices(timed.withWatermark("create_time", delay), every)


def rolling_rates(slices: DataFrame, now: datetime, hours: int = 24, baseline_hours: int = 24) -> DataFrame:
    """Success and error rates of the last window and the one before, from slices."""
    start = now - timedelta(hours=clamp_hours(hours))
    before = start - timedelta(hours=clamp_hours(baseline_hours))
    at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp")
    recent = slices.where((F.col("slice_start") >= at(before)) & (F.col("slice_start") < at(now)))
    cur = F.col("slice_start") >= at(start)
    sums = [
        F.sum(F.when(cur if p == "current" else ~cur, F.col(c)).otherwise(0)).cast("bigint").alias(f"{p}_{c}")
        for p in ("current", "baseline")
        for c in ("total", "successful", "failed", "empty")
    ]
    return recent.groupBy("user_id").agg(*sums)
