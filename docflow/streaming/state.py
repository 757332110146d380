"""Keyed rules shared by the streaming jobs and their batch twins."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

MINUTE_MS = 60_000
LEASE_MINUTES = 30
MAX_RETRIES = 3


def take_token(
    tokens: float | None, last: int | None, now: int, capacity: int, refill: int, window_ms: int
) -> tuple[bool, int, int]:
    """One request against a bucket: (allowed, tokens left, refill time)."""
    if tokens is None or last is None:
        tokens, last = capacity, now
    added = math.floor((now - last) / window_ms * refill)
    if added > 0:
        tokens, last = min(capacity, tokens + added), now
    return (True, int(tokens) - 1, int(last)) if tokens > 0 else (False, int(tokens), int(last))


def full_after_ms(capacity: int, refill: int, window_ms: int) -> int:
    """Idle time after which any bucket is full again."""
    return math.ceil(capacity * window_ms / refill)


def backoff(retry: int) -> timedelta:
    # 1, 5, then 15 minutes.
    return timedelta(minutes={1: 1, 2: 5}.get(retry, 15))


def next_task_state(state: dict | None, event: str, at: datetime) -> dict:
    """State of a task after one event; events that do not apply change nothing.

    Events: enqueue, claim, renew, success, failure, retry.
    """
    s = state or {"status": None, "retry_count": 0, "next_run_at": None, "lease_until": None,
                  "started_at": None, "completed_at": None}
    status = s["status"]
    if event == "enqueue":
        if status in ("QUEUED", "RUNNING"):
            return s
        return {"status": "QUEUED", "retry_count": 0, "next_run_at": at, "lease_until": None,
                "started_at": None, "completed_at": None}
    if event == "claim":
        due = s["next_run_at"] is None or s["next_run_at"] <= at
        free = s["lease_until"] is not None and s["lease_until"] <= at
        if (status in ("QUEUED", "RETRYING") and due) or (status == "RUNNING" and free):
            return {**s, "status": "RUNNING", "lease_until": at + timedelta(minutes=LEASE_MINUTES),
                    "started_at": s["started_at"] or at}
        return s
    if event == "renew" and status == "RUNNING":
        return {**s, "lease_until": at + timedelta(minutes=LEASE_MINUTES)}
    if event == "success" and status is not None:
        return {**s, "status": "SUCCESS", "lease_until": None, "next_run_at": None, "completed_at": at}
    if event == "failure" and status is not None:
        if s["retry_count"] < MAX_RETRIES:
            n = s["retry_count"] + 1
            return {**s, "status": "RETRYING", "retry_count": n, "lease_until": None,
                    "next_run_at": at + backoff(n), "completed_at": None}
        return {**s, "status": "FAILED", "lease_until": None, "next_run_at": None, "completed_at": at}
    if event == "retry" and status == "FAILED":
        return {**s, "status": "QUEUED", "retry_count": 0, "next_run_at": at, "lease_until": None,
                "completed_at": None}
    return s
