"""Nothing of a text is lost on the way into chunks, and stale chunks go."""

from __future__ import annotations

import re

import pytest

from docflow.hooks import HashingEmbedder, generate
from docflow.operators import chunking as C
from docflow.operators import retrieval as R
from docflow.operators import tables as T
from docflow.sources import writers

TEXTS = ["x" * 10_000, "Yes. No. It is so. " * 400, "one\n\ntwo\n\n" + "word " * 3_000, "，".join(["段落"] * 4_000)]
CHUNKERS = {
    "fixed": lambda d: C.chunk_fixed(d, 500, 0),
    "fixed_large": lambda d: C.chunk_fixed(d, 5_000, 0),
    "paragraph": lambda d: C.chunk_paragraph(d, overlap=0),
    "recursive": lambda d: C.chunk_recursive(d),
    "semantic": lambda d: C.chunk_semantic(d, HashingEmbedder(), max_chars=4_000),
    "pack": lambda d: C.chunk_pack(d),
}


def letters(text):
    return re.sub(r"[^\w]", "", text)


@pytest.mark.parametrize("name", sorted(CHUNKERS))
def test_chunks_hold_all_letters(spark, name):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got: dict = {}
    for r in CHUNKERS[name](docs).orderBy("doc_id", "chunk_index").collect():
        got[r.doc_id] = got.get(r.doc_id, "") + r.content
    assert {i: letters(t) for i, t in got.items()} == {i: letters(t) for i, t in enumerate(TEXTS)}


def test_blank_versions_clear_old_chunks(spark, tmp_path):
    rows = "doc_id long, content string"
    old = spark.createDataFrame([(i, f"old {i}") for i in range(20)], rows)
    new = spark.createDataFrame([(1, "new 1")], rows)
    replaced = spark.createDataFrame([(1,), (2,)], "doc_id long")
    want = sorted([(1, "new 1"), *((i, f"old {i}") for i in range(20) if i not in (1, 2))])
    assert sorted(map(tuple, T.replace_document_chunks(old, new, replaced).collect())) == want
    path = f"{tmp_path}/chunks"
    writers.write_buckets(old, path, "doc_id", 64)
    for _ in range(2):
        writers.replace_path(spark, path, new, 64, replaced)
        assert sorted((r.doc_id, r.content) for r in writers.read_buckets(spark, path).collect()) == want


@pytest.mark.parametrize("partitions", [1, 16])
def test_a_failing_query_stands_alone(spark, partitions):
    hits = [(q, f"q{q}", c, f"text {c}", 0.5, 1) for q in range(6) for c in range(4)]
    frame = spark.createDataFrame(hits, "query_id long, query string, chunk_id long, content string, score double, rank int")

    def scorer(queries, contents):
        if "q3" in queries:
            raise ValueError("no")
        return [int(c[-1]) / 10 for c in contents]

    out = R.rerank_with(frame.repartition(partitions), scorer, 4).collect()
    assert {(r.query_id, r.chunk_id): r.score for r in out} == {
        (q, c): 0.5 if q == 3 else c / 10 for q in range(6) for c in range(4)
    }


def test_a_failing_prompt_stands_alone(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([("a",), ("bad",), (None,), ("c",)], "p string").coalesce(1)
    assert [r[0] for r in rows.select(generate(model)("p")).collect()] == ["A", None, None, "C"]


@pytest.mark.parametrize("options", [{"rerank": False}, {"rerank": True}, {"rerank": False, "vector_k": 9}])
def test_retrieval_without_fusion(spark, options):
    from docflow.plans.retrieve import retrieve

    texts = ["red apple tree", "green apple", "blue boat", "boat on a red river", "apple boat", "river tree"]
    chunks = spark.createDataFrame(
        [(i, t, i, 0, "d", None, "paragraph") for i, t in enumerate(texts)],
        "chunk_id long, content string, doc_id long, chunk_index int, doc_name string, heading_path string, segment_type string",
    )
    embedder = HashingEmbedder()
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(embedder(texts))], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, "red apple"), (2, "boat")], "query_id long, query string")
    hits = retrieve(queries, chunks, vectors, embedder, top_k=3, fuse_single=False, **options).hits.collect()
    for q in (1, 2):
        assert sorted(r["rank"] for r in hits if r.query_id == q) == [1, 2, 3]
