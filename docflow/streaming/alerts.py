"""Alerts of rolling windows, sent when their signature changes.

The stream is a chain of two stateful operators: runs are counted per user and slice,
and a slice, once its time has passed, goes to the user's rolling state, which holds the
slices of the last two windows and nothing older. A timer at the end of each slice
compares the windows; what leaves is the signature of the active alerts, where it differs
from the one before. The batch twin does the same by range windows over stored slices.

Rates are whole numbers per ten thousand, so both sides agree to the last digit.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docflow.operators.observability import ALERT_DEFAULTS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 10_000
HOUR_MS = 3_600_000
COUNTS = ("total", "successful", "failed", "empty")
QUALITY, ERRORS = "retrieval_quality_decline", "model_error_rate_spike"


def limits(cfg: Mapping[str, float] | None) -> dict[str, int]:
    """Alert thresholds with rates per ten thousand."""
    c = {**ALERT_DEFAULTS, **(cfg or {})}
    return {"min_samples": int(c["min_samples"]), **{k: round(c[k] * SCALE) for k in ("success_drop", "error_rate", "error_rise")}}


def _share(part: int, whole: int) -> int:
    return math.floor(SCALE * part / whole + 0.5) if whole > 0 else 0


def signature_of(now: Mapping[str, int], before: Mapping[str, int], limit: Mapping[str, int]) -> str:
    """``code:status:value`` of the active alerts of two windows of counts, sorted by code."""
    found = []
    errors, errors_before = _share(now["failed"], now["total"]), _share(before["failed"], before["total"])
    if min(now["total"], before["total"]) >= limit["min_samples"] and errors >= limit["error_rate"] and errors - errors_before >= limit["error_rise"]:
        found.append(f"{ERRORS}:ACTIVE:{errors}")
    good, good_before = (SCALE - _share(w["empty"], w["successful"]) for w in (now, before))
    if min(now["successful"], before["successful"]) >= limit["min_samples"] and good_before - good >= limit["success_drop"]:
        found.append(f"{QUALITY}:ACTIVE:{good}")
    return "|".join(found)


def changed_alerts(
    slices: DataFrame, hours: int = 24, baseline_hours: int = 24, cfg: Mapping[str, float] | None = None,
    slice_minutes: int = 5,
) -> DataFrame:
    """(user_id, sent_at, signature) at the end of every slice after which the signature is another one.

    ``slices``: user_id, slice_start and the counts. A user without active alerts has
    the empty signature, also before the first slice.
    """
    step, limit = slice_minutes * 60_000, limits(cfg)
    timed = slices.withColumn("_ms", F.unix_millis(F.col("slice_start").cast("timestamp")))
    order = Window.partitionBy("user_id").orderBy("_ms")
    now = order.rangeBetween(step - hours * HOUR_MS, 0)
    before = order.rangeBetween(step - (hours + baseline_hours) * HOUR_MS, -hours * HOUR_MS)
    sums = timed.select(
        "user_id", "_ms", *(F.sum(c).over(now).alias(f"now_{c}") for c in COUNTS),
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in COUNTS),
    )

    def share(part: str, whole: str) -> Column:
        rate = F.floor(F.lit(float(SCALE)) * F.col(part) / F.col(whole) + 0.5)
        return F.when(F.col(whole) > 0, rate).otherwise(0).cast("bigint")

    errors, errors_before = (share(f"{w}_failed", f"{w}_total") for w in ("now", "before"))
    good, good_before = (F.lit(SCALE) - share(f"{w}_empty", f"{w}_successful") for w in ("now", "before"))
    least = limit["min_samples"]
    spike = (F.least("now_total", "before_total") >= least) & (errors >= limit["error_rate"]) & (errors - errors_before >= limit["error_rise"])
    decline = (F.least("now_successful", "before_successful") >= least) & (good_before - good >= limit["success_drop"])
    entry = lambda on, code, value: F.when(on, F.concat(F.lit(f"{code}:ACTIVE:"), value.cast("string")))
    signature = F.concat_ws("|", entry(spike, ERRORS, errors), entry(decline, QUALITY, good))
    signed = sums.select("user_id", "_ms", signature.alias("signature"))
    last = F.coalesce(F.lag("signature").over(order), F.lit(""))
    return signed.withColumn("_last", last).where("signature != _last").select(
        "user_id", F.timestamp_millis(F.col("_ms") + step).alias("sent_at"), "signature"
    )


class RollingAlerts(StatefulProcessor):
    """Slices of one user, the sums of both windows and the signature sent last.

    A slice has three timers: at its end it enters the recent window and the windows
    are compared, later it moves to the baseline, and last it leaves the state. Each
    touches one slice, so a long history costs no more than a short one.
    """

    def __init__(self, hours: int, baseline_hours: int, slice_ms: int, limit: Mapping[str, int]):
        self.windows = (hours * HOUR_MS, baseline_hours * HOUR_MS)
        self.slice_ms, self.limit = slice_ms, dict(limit)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slices = handle.getMapState("slices", "at bigint", ", ".join(f"{c} bigint" for c in COUNTS))
        self.sums = handle.getValueState("sums", ", ".join(f"{w}_{c} bigint" for w in ("now", "before") for c in COUNTS))
        self.last = handle.getValueState("last", "signature string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for row in batch.itertuples(index=False):
                self.slices.updateValue((row.at,), (row.total, row.successful, row.failed, row.empty))
                for later in (0, self.windows[0], sum(self.windows)):
                    self.handle.registerTimer(row.at + self.slice_ms + later)
        yield pd.DataFrame([], columns=["user_id", "sent_at", "signature"])

    def _counts(self, at: int) -> tuple | None:
        return tuple(self.slices.getValue((at,))) if self.slices.containsKey((at,)) else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        own, (recent, baseline) = end - self.slice_ms, self.windows
        held = self.sums.get() if self.sums.exists() else (0,) * (2 * len(COUNTS))
        now, before = list(held[: len(COUNTS)]), list(held[len(COUNTS) :])
        if (moved := self._counts(own - recent)) is not None:
            now = [n - m for n, m in zip(now, moved, strict=True)]
            before = [n + m for n, m in zip(before, moved, strict=True)]
        if (gone := self._counts(own - recent - baseline)) is not None:
            before = [n - g for n, g in zip(before, gone, strict=True)]
            self.slices.removeKey((own - recent - baseline,))
        out = []
        if (entered := self._counts(own)) is not None:
            now = [n + e for n, e in zip(now, entered, strict=True)]
            signature = signature_of(dict(zip(COUNTS, now, strict=True)), dict(zip(COUNTS, before, strict=True)), self.limit)
            if signature != (self.last.get()[0] if self.last.exists() else ""):
                self.last.update((signature,))
                out.append((key[0], pd.Timestamp(end, unit="ms"), signature))
        self.sums.update((*now, *before))
        yield pd.DataFrame(out, columns=["user_id", "sent_at", "signature"])

    def close(self) -> None:
        pass


def alert_changes_stream(
    runs: DataFrame, hours: int = 24, baseline_hours: int = 24, cfg: Mapping[str, float] | None = None,
    slice_minutes: int = 5, delay: str = "10 minutes", names: tuple[str, ...] = ("rag_query",),
) -> DataFrame:
    """Streaming twin of ``changed_alerts`` over runs (user_id, trace_name, deleted, status, answer_state, create_time).

    Needs a session whose state store is RocksDB (``use_rocksdb``).
    """
    kept = runs.where(F.col("trace_name").isin(*names) & (F.col("deleted") == 0))
    timed = kept.withColumn("create_time", F.col("create_time").cast("timestamp")).withWatermark("create_time", delay)
    counted = timed.groupBy("user_id", F.window("create_time", f"{slice_minutes} minutes").alias("_w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "SUCCESS").alias("successful"),
        F.count_if(F.col("status") == "ERROR").alias("failed"), F.count_if(F.col("answer_state") == "empty_retrieval").alias("empty"),
    )
    slices = counted.select("user_id", F.window_time("_w").alias("slice_time"), F.unix_millis("_w.start").alias("at"), *COUNTS)
    schema = T.StructType([runs.schema["user_id"], T.StructField("sent_at", T.TimestampType()), T.StructField("signature", T.StringType())])
    return slices.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=RollingAlerts(hours, baseline_hours, slice_minutes * 60_000, limits(cfg)),
        outputStructType=schema, outputMode="append", timeMode="EventTime",
    )
