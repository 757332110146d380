"""Folds and searches against straightforward loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.catalog import base as B
from docflow.catalog import layout as CL
from docflow.catalog import streaming as CS
from docflow.hooks import HashingEmbedder
from docflow.operators import chunking as C
from docflow.operators import layout as L
from docflow.operators import retrieval as R
from docflow.streaming import batch as SB
from docflow.streaming.state import next_task_state


def test_recursive_pieces(spark, sf):
    src = {r.doc_id: r.text for r in B.load(spark, sf, "documents").collect()}
    got: dict = {}
    for r in C.chunk_recursive(B.load(spark, sf, "documents"), 300).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)

    def split(text, level=0):
        if len(text) <= 300 or level == len(C.SEPARATORS):
            return [text]
        sep = C.SEPARATORS[level]
        parts = text.split(sep)
        if len(parts) == 1:
            return split(text, level + 1)
        groups, cur = [], ""
        for p in parts:
            cand = p if not cur else cur + sep + p
            if len(cand) > 300 and cur:
                groups.append(cur)
                cur = p
            else:
                cur = cand
        groups += [cur] if cur else []
        return [x for g in groups for x in split(g, level + 1)]

    for doc_id, text in src.items():
        if text.strip():
            assert got[doc_id] == split(text)


def test_semantic_and_length_chunks(spark, sf):
    emb = HashingEmbedder()
    docs = B.load(spark, sf, "documents")
    sents: dict = {}
    for r in C.split_sentences(docs).orderBy("doc_id", "sentence_no").collect():
        sents.setdefault(r.doc_id, []).append(r.sentence)

    def chunks(parts, semantic):
        v = emb(parts).astype(float)
        out, cur = [], ""
        for i, s in enumerate(parts):
            if cur:
                if semantic:
                    full = len(cur) + len(s) > 1500 and len(cur) >= 100
                    a, b = v[i - 1], v[i]
                    n = np.linalg.norm(a) * np.linalg.norm(b)
                    sim = a @ b / n if n else 0.0
                    cut = full or (len(cur) >= 100 and sim < 0.5)
                else:
                    cut = len(cur) + len(s) > 1500
                if cut:
                    out.append(cur)
                    cur = ""
            cur = f"{cur} {s}" if cur else s
        return out + [cur]

    for got_df, semantic in ((C.chunk_semantic(docs, emb), True), (C.chunk_pack(docs), False)):
        got: dict = {}
        for r in got_df.orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r.doc_id, []).append(r.content)
        assert got.keys() == sents.keys()
        for k, parts in sents.items():
            assert got[k] == chunks(parts, semantic)


def test_failing_embedder_packs_by_length(spark, sf):
    def broken(texts):
        raise RuntimeError("down")

    docs = B.load(spark, sf, "documents")
    a = C.chunk_semantic(docs, broken).select("doc_id", "chunk_index", "content")
    b = C.chunk_pack(docs).select("doc_id", "chunk_index", "content")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _fold(boxes, order, merge):
    out = []
    for b in sorted(boxes, key=order):
        m = merge(out[-1], b) if out else None
        if m is None:
            out.append(dict(b))
        else:
            out[-1] = m
    return out


def _join(a, b, **kw):
    return {**a, "x1": min(a["x1"], b["x1"]), "y1": min(a["y1"], b["y1"]), "x2": max(a["x2"], b["x2"]),
            "y2": max(a["y2"], b["y2"]), "text": " ".join(f"{a['text']} {b['text']}".split()),
            "n": a["n"] + b["n"], **kw}


def _pages(df):
    pages: dict = {}
    for r in df.collect():
        b = {**r.asDict(), "n": 1, "font_size": r["font_size"]}
        pages.setdefault((r["doc_id"], r["page_num"]), []).append(b)
    return pages


def _shape(rows):
    return sorted((r["doc_id"], r["page_num"], r["box_no"], r["x1"], r["y1"], r["x2"], r["y2"], r["text"], r["n"]) for r in rows)


def test_line_merge(spark, sf):
    b = L.classify_boxes(CL.marked_boxes(spark, sf))
    y = F.floor(F.col("box_no") / 2) * 14.0
    wide = b.withColumn("y1", y).withColumn("y2", y + 12.0).withColumn(
        "x2", F.when(F.col("box_no") % 2 == 0, 305.0 + F.col("box_no") % 30).otherwise(F.col("x2")))

    def merge(p, n):
        gap = n["x1"] - p["x2"]
        if p["type"] == n["type"] and abs(n["y1"] - p["y1"]) <= max(p["font_size"], n["font_size"]) * 0.7 and 0 <= gap <= max(18.0, p["font_size"] * 1.5):
            return _join(p, n, font_size=max(p["font_size"], n["font_size"]))
        return None

    want = [x for rows in _pages(wide).values() for x in _fold(rows, lambda r: (r["y1"], r["x1"], r["box_no"]), merge)]
    got = [{**r.asDict(), "n": r["merged_boxes"]} for r in L.merge_horizontal(wide).collect()]
    assert any(x["n"] > 1 for x in want)
    assert _shape(got) == _shape(want)


@pytest.mark.parametrize("down", [False, True])
def test_column_merges(spark, sf, down):
    src = CL.columned(spark, sf).withColumn("merged_boxes", F.lit(1))
    if down:
        src = src.withColumn("type", F.when(F.col("type").isin("Title", "List"), "Text").otherwise(F.col("type")))

    def merge(p, n):
        low = n["y1"] - p["y2"]
        font = max(p["font_size"], n["font_size"])
        if p["type"] != n["type"] or p["column_index"] != n["column_index"]:
            return None
        if down:
            ok = p["type"] == "Text" and low <= font * 1.8 and abs(n["x1"] - p["x1"]) <= max(24.0, p["font_size"] * 2) and abs(p["font_size"] - n["font_size"]) <= 1.5
        else:
            ok = n["type"] not in L.STRUCTURAL and low <= font * 1.6
        return _join(p, n) if ok else None

    want = [x for rows in _pages(src).values() for x in _fold(rows, lambda r: (r["column_index"], r["y1"], r["x1"], r["box_no"]), merge)]
    op = L.concat_downward if down else L.merge_vertical
    got = [{**r.asDict(), "n": r["merged_boxes"]} for r in op(src).collect()]
    assert any(x["n"] > 1 for x in want)
    assert _shape(got) == _shape(want)


def test_columns_found(spark):
    rows = [(1, 0, i, x, 10.0 * i, x + 100.0, 10.0 * i + 8, 12.0, False, "t", "Text") for i, x in enumerate([50.0, 320.0] * 20)]
    rows += [(2, 0, i, 50.0 + i % 5, 10.0 * i, 500.0 + i % 5, 10.0 * i + 8, 12.0, False, "t", "Text") for i in range(20)]
    b = spark.createDataFrame(rows, "doc_id int, page_num int, box_no int, x1 double, y1 double, x2 double, y2 double, font_size double, bold boolean, text string, type string")
    pages = spark.createDataFrame([(1, 0, 600.0), (2, 0, 600.0)], "doc_id int, page_num int, page_width double")
    got = {(r.doc_id, r.box_no): r.column_index for r in L.assign_columns(b, pages).collect()}
    assert all(got[(1, i)] == i % 2 for i in range(40))
    assert all(got[(2, i)] == 0 for i in range(20))


def test_large_query_sets_take_rounds(spark, sf):
    e = B.load(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding", "label")
    v = e.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label")
    v = v.unionByName(v.where("vec_id % 3 = 0" if "vec_id" in v.columns else "chunk_id % 3 = 0").withColumn("chunk_id", F.concat("chunk_id", F.lit("c"))))
    for by in (None, "label"):
        want = {tuple(r) for r in R.vector_topk(q, v, 5, by).collect()}
        got = {tuple(r) for r in R.vector_topk(q, v, 5, by, query_block=20).collect()}
        assert got == want


def test_many_terms_take_rounds(spark, sf):
    from docflow.catalog.retrieval import key_chunks, key_queries

    want = {tuple(r) for r in R.keyword_topk(key_queries(spark, sf), key_chunks(spark, sf), 8).collect()}
    for by in (None, "source"):
        q, c = key_queries(spark, sf), key_chunks(spark, sf)
        if by:
            q = q.crossJoin(c.select("source").distinct().orderBy("source").limit(2))
            want = {tuple(r) for r in R.keyword_topk(q, c, 8, by).collect()}
        got = {tuple(r) for r in R.keyword_topk(q, c, 8, by, terms_per_round=100).collect()}
        assert len(got) > 50 and got == want


def test_han_terms(spark):
    q = spark.createDataFrame([(1, "检索"), (2, "知识库检索"), (3, "图"), (4, "Ab x")], "query_id int, query string")
    c = spark.createDataFrame([(1, "检索系统 知识 图书"), (2, "abc ab 识库")], "chunk_id int, content string")
    got = {(r.query_id, r.chunk_id): round(r.score / (1 - r.score) / 0.1) for r in R.keyword_topk(q, c, 5).collect()}
    # a Han run is one token, so a term matches at the start of a run
    assert got == {(1, 1): 1, (2, 1): 2, (2, 2): 1, (3, 1): 1, (4, 2): 2}


def test_task_machine(spark, sf):
    ev = CS.task_events(spark, sf)
    state: dict = {}
    for r in sorted(ev.collect(), key=lambda r: (r.task_id, r.seq, r.event, r["at"])):
        state[r.task_id] = next_task_state(state.get(r.task_id), r.event, r["at"])
    batch = {r.task_id: (r.status, r.retry_count, r.next_run_at, r.lease_until) for r in CS.current_tasks(spark, sf).collect()}
    assert batch == {k: (s["status"], s["retry_count"], s["next_run_at"], s["lease_until"]) for k, s in state.items()}
    stream = CS.task_stream(spark, sf).select(*SB.task_states(ev).columns)
    both = SB.task_states(ev)
    assert stream.exceptAll(both).count() == 0 and both.exceptAll(stream).count() == 0


def test_retry_ends_in_failure():
    from datetime import datetime, timedelta

    now, s = datetime(2024, 1, 1), None
    s = next_task_state(s, "enqueue", now)
    for wait in (1, 5, 15):
        s = next_task_state(s, "claim", now)
        assert s["status"] == "RUNNING"
        assert next_task_state(s, "claim", now) == s  # the lease still holds
        assert next_task_state(s, "claim", s["lease_until"])["status"] == "RUNNING"
        s = next_task_state(s, "failure", now)
        assert s["status"] == "RETRYING" and s["next_run_at"] == now + timedelta(minutes=wait)
        assert next_task_state(s, "claim", now)["status"] == "RETRYING"  # not due yet
        now = s["next_run_at"]
    s = next_task_state(next_task_state(s, "claim", now), "failure", now)
    assert s["status"] == "FAILED"
    assert next_task_state(s, "retry", now)["status"] == "QUEUED"


def test_rate_limit_of_a_busy_key(spark):
    ev = spark.sql("SELECT 1L AS user_id, id AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 0.9) AS ts FROM range(500)")
    got = {r.event_id: (r.allowed, r.tokens) for r in SB.rate_limit(ev).collect()}
    tokens, last, want = 60, 0, {}
    for i in range(500):
        now = round(i * 900)
        add = math.floor((now - last) / 60000 * 30)
        if add > 0:
            tokens, last = min(60, tokens + add), now
        want[i] = (tokens > 0, tokens - 1 if tokens > 0 else tokens)
        tokens = want[i][1]
    assert got == want and not all(a for a, _ in got.values())


@pytest.mark.parametrize("how", ["paragraph", "paper", "manual", "table"])
def test_segment_packing(spark, sf, how):
    """Chunks of segments against a plain loop over the rules."""
    from docflow.operators import segments as S

    nested = S.segment_documents(B.markdown(spark, sf))
    got: dict = {}
    for r in C.chunk_segments(nested, how, 300, 1, 60).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.content, r.heading_path))
    for doc in nested.collect():
        units = [u for u in doc.segments if u.type != "heading"]
        if not units:
            continue
        want, i = [], 0
        while i < len(units):
            if how == "table" and units[i].type in ("table", "caption"):
                want.append((units[i].content, units[i].heading_path))
                i += 1
                continue
            parts, path, j = [], None, i
            while j < len(units):
                u, size = units[j], len("\n\n".join(parts))
                moved = bool(path and u.heading_path and path != u.heading_path)
                if parts and (
                    (how == "table" and u.type in ("table", "caption"))
                    or (moved and size >= 60)
                    or (how == "paper" and size >= 60 and u.type in ("caption", "table", "figure"))
                    or (size + 2 + len(u.content) > 300 and size >= 60)
                ):
                    break
                parts.append(u.content)
                path = path or u.heading_path
                j += 1
                if len("\n\n".join(parts)) >= 300:
                    break
            want.append(("\n\n".join(parts), path))
            if j >= len(units):
                break
            i = max(i + 1, j - 1)
        assert got[doc.doc_id] == want
