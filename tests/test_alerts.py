"""Rolling alerts: the rule, the batch form and the stream agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.catalog import base as B
from docflow.catalog import streaming as CS
from docflow.streaming import alerts as A
from docflow.streaming import batch as SB


def test_batch_follows_the_rule(spark, sf):
    slices = SB.metric_slices(B.runs(spark, sf)).withColumn("at", F.unix_millis(F.col("slice_start").cast("timestamp")))
    by_user: dict = {}
    for r in slices.collect():
        by_user.setdefault(r.user_id, []).append((r["at"], {c: r[c] for c in A.COUNTS}))
    step, window, limit, want = 300_000, 120 * A.HOUR_MS, A.limits(CS.ROLLING["cfg"]), []
    for user, rows in by_user.items():
        last = ""
        for at, _ in sorted(rows, key=lambda r: r[0]):
            end = at + step
            sums = [{c: sum(n[c] for t, n in rows if lo <= t < hi) for c in A.COUNTS} for lo, hi in ((end - window, end), (end - 2 * window, end - window))]
            signature = A.signature_of(*sums, limit)
            if signature != last:
                want.append((user, end, signature))
            last = signature
    got = A.changed_alerts(slices, **CS.ROLLING).select("user_id", F.unix_millis("sent_at"), "signature").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20


def test_stream_equals_batch_up_to_the_watermark(spark, sf):
    batch = {tuple(r) for r in CS.alert_changes(spark, sf).collect()}
    stream = {tuple(r) for r in CS.alert_changes_stream(spark, sf).collect()}
    assert stream <= batch
    newest = B.runs(spark, sf).agg(F.max("create_time")).first()[0]
    assert all((newest - sent).total_seconds() < 700 for _, sent, _ in batch - stream)
