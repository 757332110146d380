"""Task states on the stream: many tasks per call, state from one batch to the next, exact ids."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd

from docflow.catalog.streaming import as_stream, finished
from docflow.streaming import jobs as J

START = datetime(2024, 1, 1)


class _Tasks:
    """Map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def exists(self):
        return bool(self.held)

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def getMapState(self, *_):
        return self


def _events(kind, minute, tasks):
    at = START + timedelta(minutes=minute)
    return pd.DataFrame([(f"={t}", False, minute, kind, pd.Timestamp(at)) for t in tasks], columns=["task", "last", "seq", "event", "at"])


def test_tasks_share_a_call():
    store, machine = _Tasks(), J.TaskMachine()
    machine.init(store)
    first = pd.concat([_events("claim", 2, range(50)), _events("enqueue", 1, range(50))])
    (out,) = machine.handleInputRows((0,), iter([first.iloc[:30], first.iloc[30:]]), None)
    assert len(out) == 100 and store.calls == 50  # one write per task
    assert out.groupby("task")["status"].apply(list).map(tuple).unique().tolist() == [("QUEUED", "RUNNING")]
    (out,) = machine.handleInputRows((0,), iter([_events("success", 3, range(40, 60))]), None)
    assert out["status"].tolist() == ["SUCCESS"] * 10 + [None] * 10  # the last ten were never enqueued


def test_ids_stay_exact_beside_nulls(spark):
    big = 2**60 + 1
    at = "timestamp_ntz'2024-01-01 00:00:00'"
    ev = spark.sql(f"SELECT * FROM VALUES (CAST({big} AS BIGINT), CAST({big} AS BIGINT), 'enqueue', {at}), ({big}, NULL, 'claim', {at}), (NULL, 1, 'enqueue', {at}) t(task_id, seq, event, at)")
    got = {(r.task_id, r.seq): r.status for r in finished(J.task_state_stream(as_stream(ev, "ev")), "ev-out").collect()}
    assert got == {(big, big): "QUEUED", (big, None): "RUNNING", (None, 1): "QUEUED"}
