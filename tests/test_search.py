from __future__ import annotations

import collections
import random

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from docflow.operators import keyword_index as K
from docflow.operators import retrieval as R
from docflow.operators import vector_scan as V


def _chunks(rng, n):
    words = ["a" * i + c for i in range(1, 5) for c in "bcdef"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(n)]


def test_keyword_blocks_match_brute_force(spark, monkeypatch):
    """Several blocks per task, ties at the border of the best k, terms that cover others, empty texts."""
    rng = random.Random(8)
    chunks = _chunks(rng, 900) + [(5000, None)]
    queries = [(q, " ".join(rng.choice(["aab", "aa", "ab", "aaac", "zz", "AAB", "x"]) for _ in range(rng.randrange(0, 5)))) for q in range(40)]
    want = set()
    for q, text in queries:
        terms = {t.lower() for t in text.split() if len(t) > 1}
        hits = collections.Counter()
        for c, content in chunks:
            hits[c] = sum(any(w.startswith(t) for t in terms) for w in (content or "").split())
        best = sorted(((-m, c) for c, m in hits.items() if m))[:7]
        want |= {(q, c, round(-0.1 * m / (1 - 0.1 * m), 9), i) for i, (m, c) in enumerate(best, 1)}
    q = spark.createDataFrame(queries, "query_id int, query string")
    c = spark.createDataFrame(chunks, "chunk_id long, content string").repartition(3)
    for terms in (K.TERMS_PER_ROUND, 30):
        got = R.keyword_topk(q, c, 7, terms_per_round=terms).collect()
        assert {(r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in got} == want


def test_blocks_below_the_bound_are_skipped(monkeypatch):
    """Once the best k are found in long chunks, blocks of short ones are not scored."""
    monkeypatch.setattr(K, "BLOCK", 4)
    rng = random.Random(1)
    texts = [["ab"] * 60 + ["cd"] * 9 for _ in range(8)] + [["ab", "ef"] for _ in range(400)]
    rng.shuffle(texts)
    asked = K.Asked(np.array([1, 2]), [["ab", "cd"], ["ef"]], 4)
    scored = []
    keep = asked._score
    monkeypatch.setattr(asked, "_score", lambda block, queries, *rest: (scored.append(list(queries)), keep(block, queries, *rest)))
    for block in K._blocks(np.arange(len(texts)), pa.array(texts, pa.list_(pa.string()))):
        asked.search(block)
    assert sum(0 in queries for queries in scored) <= 2
    assert asked.top.scores[0].tolist() == [69.0] * 4 and asked.top.scores[1].tolist() == [1.0] * 4
    assert asked.top.found[1].tolist() == sorted(i for i, t in enumerate(texts) if "ef" in t)[:4]


def test_one_task_hands_on_k_rows_per_query(spark):
    q = spark.createDataFrame([(1, "ab"), (2, "ac ad")], "query_id int, query string")
    c = spark.range(1000).selectExpr("id chunk_id", "'ab ac ad' content").repartition(4)
    plan = R.keyword_topk(q, c, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(query_id") == 1 and "Join" not in plan


def _vectors(rng, n, dim=12):
    centres = rng.normal(size=(10, dim))
    out = centres[rng.integers(0, 10, n)] + rng.normal(size=(n, dim)) * 0.05
    out[rng.integers(0, n, 3)] = 0
    return out


def test_pivots_prune_and_stay_exact():
    rng = np.random.default_rng(5)
    mat, asked = _vectors(rng, 4000), _vectors(rng, 50)
    asked[7] = 0
    unit = lambda m: V.unit_rows(pa.array(m.tolist()), None)
    s = V.Searched(np.arange(50), unit(asked), 5)
    for at in range(0, 4000, 1000):
        s.add(np.arange(at, at + 1000), unit(mat[at : at + 1000]))
    assert s.compared < 0.5 * 50 * 4000
    scores = np.round(unit(asked) @ unit(mat).T, V.SCORE_DIGITS)
    for q in range(50):
        best = np.lexsort((np.arange(4000), -scores[q]))[:5]
        assert s.top.found[q].tolist() == best.tolist()


def test_vector_rounds(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist(), "g%d" % (i % 3) if i % 11 else None) for i, v in enumerate(_vectors(rng, 600))]
    v = spark.createDataFrame(rows, "chunk_id int, embedding array<double>, g string").repartition(5)
    q = v.where("chunk_id % 7 = 0").withColumnRenamed("chunk_id", "query_id")
    for by in (None, "g"):
        want = {tuple(r) for r in R.vector_topk(q, v, 4, by).collect()}
        assert {tuple(r) for r in R.vector_topk(q, v, 4, by, query_block=30).collect()} == want
        assert len(want) == 4 * (q.where("g is not null").count() if by else q.count())


def test_hits_without_a_parent_are_dealt_out(spark):
    """They are not one key of the join, and each stays as it is; a missing parent keeps the child."""
    from docflow.operators.retrieval import expand_parent

    chunks = spark.range(400).selectExpr("string(id) chunk_id", "concat('text ', id) content", "int(id) chunk_index")
    hits = chunks.selectExpr("1 query_id", "chunk_id", "content", "0.5D score", "CASE chunk_id WHEN '1' THEN '7' WHEN '2' THEN 'none' END parent_id")
    got = expand_parent(hits, chunks, small=False)
    rows = sorted((r.chunk_id, r.content, r.is_parent, r.parent_index) for r in got.collect())
    assert rows == sorted([(str(i), f"text {i}", False, None) for i in range(400) if i != 1] + [("7", "text 7", True, 7)])
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in expand_parent(hits, chunks, small=False).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) == 8 and max(sizes) < 200


def test_batches_to_python_are_bounded_by_bytes(spark):
    """A session that ships the package sends no batch far beyond the bound; one with its own bound keeps it."""
    from docflow import session

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        session.ship(spark)
        assert int(spark.conf.get(key).rstrip("bB")) <= session.BATCH_BYTES
        long = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("x"), 500_000).alias("t"))
        sizes = [r.n for r in long.mapInArrow(_nbytes, "n long").collect()]
        assert sum(sizes) >= 50_000_000 and max(sizes) < session.BATCH_BYTES + 1_000_000
        spark.conf.set(key, "1000000")
        session.ship(spark)
        assert spark.conf.get(key).rstrip("bB") == "1000000"
    finally:
        spark.conf.set(key, before)


def _nbytes(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])
