from __future__ import annotations

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docflow.llm import line_dedup
from tests.llm.fixtures import SCHEMA, awkward_rows, clashing, prose

SPACES = " \t\n\x0b\x0c\r"


def key_of(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def expected(rows: list[tuple]) -> list[tuple]:
    """Plain version: the first document of each key, then each text line by line."""
    place = lambda i: (i is None, i or 0)
    first: dict[str, tuple] = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            k = key_of(line)
            first[k] = min(first.get(k, place(r[0])), place(r[0]))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        gone = [len(key_of(x)) >= 10 and first[key_of(x)] != place(r[0]) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        words = collections.defaultdict(lambda: 2**64 - 1)
        for at, g in enumerate(gone):
            if g:
                words[at // 64] &= ~(1 << at % 64)
        shown = ",".join(f"{w}:{words[w]:016x}" for w in sorted(words))
        out.append((r[0], len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), shown))
    return sorted(out, key=str)


def line_rows() -> list[tuple]:
    """Shared, repeated, short, indented, upper-case and empty lines; one document of many lines, one common line."""
    rng = random.Random(3)
    pool = [prose(rng, rng.choice([1, 2, 6, 20])) for _ in range(60)]
    rows = []
    for i in range(150):
        lines = [rng.choice(pool) for _ in range(rng.randrange(0, 12))] + ["Read the terms of use"] * (i % 3)
        lines = [rng.choice(["", " ", "\t\x0b"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r", " \n"]) for x in lines]
        rows.append((i * 3 % 151, "\n".join(lines), "en", "a", 1))
    rows.append((7000, "\n".join(rng.choice(pool) + str(k % 4000) for k in range(9000)), "en", "a", 1))
    rows.append((7001, "\n".join(rng.choice(pool) + str(k % 4000) for k in range(9000)), "en", "a", 1))
    same = "\n".join(pool[:30])
    return rows + [(3, same, "en", "a", 1), (3, same, "en", "a", 1), (None, same, "en", "a", 1), (None, pool[1], None, None, None)]


def result(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256, r.keep_words) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows", [line_rows(), awkward_rows()], ids=["lines", "awkward"])
def test_lines(spark, rows):
    docs = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert result(line_dedup.dedup_lines(docs)) == expected(rows)


def test_without_hot_lines(spark, monkeypatch):
    """The same result whether common lines go by table or by range."""
    monkeypatch.setattr(line_dedup, "hot_hashes", lambda occurrences: [])
    rows = line_rows()
    assert result(line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_common_lines_are_hot(spark):
    shaped = spark.range(5000).select(
        F.col("id").alias("doc"), F.lit(1).cast("long").alias("mark"), F.lit(0).alias("at"),
        F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id") + 1000).alias("h1"), F.lit(5).cast("long").alias("h2"),
    )
    assert line_dedup.hot_hashes(shaped) == [77]
    assert sorted(r.doc for r in line_dedup.dropped_lines(shaped).collect()) == list(range(3, 5000, 3))


def test_range_partitions_need_no_second_exchange(spark):
    """The first document of a line is found in the range partition itself."""
    shaped = spark.range(100).selectExpr("id doc", "id mark", "0 at", "id % 7 h1", "id % 3 h2")
    plan = line_dedup.dropped_lines(shaped)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h1" in plan
    windowed = plan[plan.index("Window") :]
    assert "hashpartitioning" not in windowed[: windowed.index("rangepartitioning")]


def test_survivors_keep_their_columns(spark):
    rows = line_rows()
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.where("doc_id is not null").collect())
    assert got == sorted((e[0], e[3]) for e in expected(rows) if e[0] is not None)


def test_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
