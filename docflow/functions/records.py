"""JSON fields, judge answers, statuses and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(c: Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(c), f"$.{key}", "string")


def json_long(c: Column, key: str) -> Column:
    return F.coalesce(
        F.try_variant_get(F.try_parse_json(c), f"$.{key}", "bigint"), F.lit(0).cast("bigint")
    )


def json_double(c: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(c), f"$.{key}", "double"), F.lit(0.0))


def map_merge(base: Column, updates: Column) -> Column:
    """Union of two maps; on equal keys ``updates`` wins. Null maps count as empty."""
    empty = F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<string>")
    )
    old, new = F.coalesce(base, empty), F.coalesce(updates, empty)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def json_merge(c: Column, updates: Column) -> Column:
    """Flat JSON text merged with a map; unreadable JSON leaves the updates only."""
    old = F.from_json(c, "map<string,string>")
    return F.to_json(map_merge(old, updates))


def parse_score(response: Column) -> Column:
    """Judge score in 0..1: ``"score": x`` first, else ``分数: x``; null if none."""
    json_hit = F.nullif(
        F.regexp_extract(response, r'"score"\s*:\s*([0-9.]+)', 1), F.lit("")
    ).try_cast("double")
    text_hit = F.nullif(
        F.regexp_extract(response, r"分数[：:]\s*([0-9.]+)", 1), F.lit("")
    ).try_cast("double")
    found = F.coalesce(json_hit, text_hit)
    return F.when(found.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))


def parse_verdict(response: Column, flag: str) -> Column:
    """Verdict struct from model JSON, code fences removed.

    A field that is missing takes its default; unreadable JSON gives
    ``(true, 0.8, 'Parse error')``.
    """
    edges = r"^[\x00-\x20]+|[\x00-\x20]+$"
    body = F.regexp_replace(F.coalesce(response, F.lit("")), edges, "")
    body = F.regexp_replace(body, r"^```(json)?", "")
    body = F.regexp_replace(F.regexp_replace(body, r"```$", ""), edges, "")
    doc = F.try_parse_json(body)
    ok = doc.isNotNull()
    return F.struct(
        F.coalesce(F.try_variant_get(doc, f"$.{flag}", "boolean"), F.lit(True)).alias(flag),
        F.coalesce(F.try_variant_get(doc, "$.score", "double"), F.lit(0.8)).alias("score"),
        F.when(ok, F.coalesce(F.try_variant_get(doc, "$.reason", "string"), F.lit("Unknown")))
        .otherwise("Parse error")
        .alias("reason"),
    )


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end; 0 if either is missing."""
    return F.coalesce(F.timestamp_diff("MILLISECOND", start, end), F.lit(0)).cast("bigint")


def window_hours(hours: Column, most: int | None = None) -> Column:
    """Not positive means a day; at most ``most`` hours if that is given."""
    asked = F.when(hours <= 0, F.lit(24)).otherwise(hours)
    return asked if most is None else F.least(asked, F.lit(most))


def backoff_minutes(retry_count: Column) -> Column:
    # First retry after 1 minute, second after 5, later ones after 15.
    return F.when(retry_count == 1, 1).when(retry_count == 2, 5).otherwise(15)


def claimable(status: Column, next_run_at: Column, lease_until: Column, now: Column) -> Column:
    """Waiting tasks whose time has come, and running ones whose lease ran out."""
    due = next_run_at.isNull() | (next_run_at <= now)
    return F.coalesce(
        (status.isin("QUEUED", "RETRYING") & due)
        | ((status == "RUNNING") & (lease_until <= now)),
        F.lit(False),
    )
