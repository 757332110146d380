"""Steps whose cost once grew faster than the input, or was paid more than once."""

from __future__ import annotations

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from docflow import hooks
from docflow.operators import layout as L
from docflow.operators import vector_scan as V

BOX = "doc_id int, page_num int, box_no int, x1 double, y1 double, x2 double, y2 double, font_size double, bold boolean, text string"


def test_vectors_are_made_once_however_many_rounds(spark):
    rng = np.random.default_rng(3)
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 6)))]
    plain = spark.createDataFrame(rows, "chunk_id int, embedding array<double>")
    q = plain.where("chunk_id < 100").withColumnRenamed("chunk_id", "query_id")
    want = {tuple(r) for r in V.vector_topk(q, plain, 3).collect()}
    assert {tuple(r) for r in V.vector_topk(q, plain.mapInArrow(make, plain.schema), 3, query_block=9).collect()} == want
    assert made.value == 300


def test_scores_are_screened_in_single_precision():
    """Near ties, copies, zero vectors and ids of growing length come out as by brute force."""
    rng = np.random.default_rng(4)
    mat = rng.normal(size=(3000, 16))
    mat[1500:] = mat[:1500] * 3
    mat[::50] = mat[1] + rng.normal(size=(60, 16)) * 1e-8
    mat[7], mat[2007] = 0, 0
    mat = np.divide(mat, np.linalg.norm(mat, axis=1, keepdims=True), out=np.zeros_like(mat), where=mat.any(axis=1)[:, None])
    ids = np.array([f"{'x' * (i // 1000)}{i}" for i in range(3000)])
    s = V.Searched(np.arange(200), mat[:200], 6)
    for at in range(0, 3000, 1000):
        s.add(ids[at : at + 1000].astype(str), mat[at : at + 1000])
    scores = np.round(np.array([np.einsum("ij,j->i", mat, v) for v in mat[:200]]), V.SCORE_DIGITS)
    assert s.single.dtype == np.float32
    for q in range(200):
        best = np.lexsort((ids, -scores[q]))[:6]
        assert np.abs(s.top.scores[q] - scores[q][best]).max() < 1e-11
        assert len(set(s.top.found[q])) == 6


def test_columns_of_many_pages_at_once():
    rng = np.random.default_rng(1)
    x, w, width = [], [], []
    for i in range(400):
        at = rng.choice([60, 180, 300, 420, 540, 90.5], rng.integers(1, 5))
        v = np.round(rng.choice(at, rng.integers(1, 60)), 1) + rng.integers(-9, 9) * (i % 2)
        v = v if i % 5 else v + rng.integers(-20, 20, len(v)) / 2
        places, counts = np.unique(v, return_counts=True)
        x.append(places)
        w.append(counts.astype(float))
        width.append(float(rng.choice([0, 100, 600, 2000])))
    assert L.many_boundaries(x, w, np.array(width)) == [L.page_boundaries(*p) for p in zip(x, w, width, strict=True)]


@pytest.mark.parametrize("strategy", ["paper", "table"])
def test_document_rows_read_the_boxes_once(spark, strategy):
    """Columns and segments of a document come from one pass of the merges."""
    rows = [(1, i // 6, i, 50.0, 14.0 * (i % 6), 280.0, 14.0 * (i % 6) + 8, 18.0 if i % 6 == 0 else 12.0, False, t)
            for i, t in enumerate(["Head", "Table 1: cap", "a | b | c", "text.", "   ", " more"] * 3)]
    rows += [(2, 0, 0, 50.0, 0.0, 280.0, 10.0, 12.0, False, " ")]
    boxes = spark.createDataFrame(rows, BOX)
    pages = boxes.select("doc_id", "page_num").distinct().unionByName(spark.createDataFrame([(3, 0), (1, 9)], "doc_id int, page_num int"))
    found = L.layout_segments(boxes, pages.withColumn("page_width", F.lit(600.0)), strategy)
    want = {r.doc_id: r["count"] for r in found.segments.groupBy("doc_id").count().collect()}
    got = {r.doc_id: (r.page_count, r.detected_columns, r.segment_count) for r in found.documents.collect()}
    assert got == {1: (4, 1, want[1]), 2: (1, 1, None), 3: (1, 1, None)}
    assert found.documents._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def test_latin_texts_are_embedded_without_the_unicode_pattern(monkeypatch):
    texts = ["Straße ÉTÉ µm x² 10½ a_b", "", "".join(f"x{chr(c)}" for c in range(256))]
    more = ["Ünïcode 数据 поиск ٣٤", "İstanbul ΣΑΣ"]

    def plain(text):
        out = np.zeros(8, np.float32)
        for t in regex.findall(r"[\p{L}\p{Nd}]+", text.lower()):
            h = int(hooks.hashlib.md5(t.encode()).hexdigest()[:8], 16)
            out[h % 8] += 1.0 if (h // 8) % 2 == 0 else -1.0
        return out

    want = np.array([plain(t) for t in texts + more])
    embed = hooks.HashingEmbedder(8)
    assert (embed(texts + more) == want).all()
    monkeypatch.setattr(regex, "findall", lambda *_: pytest.fail("not needed"))
    assert (embed(texts) == want[:3]).all()
