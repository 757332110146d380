"""File forms, repeated writes and partition independence."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docflow.catalog import base as B
from docflow.catalog import chunking as CC
from docflow.operators import chunking as C
from docflow.operators import evaluation as E
from docflow.operators import segments as S
from docflow.session import work_path
from docflow.sources import buckets, readers, writers


def test_json_envelopes(spark, tmp_path):
    rec = lambda i: {"question_id": i, "question": f"q{i}", "answers": ["", f" a {i} "],
                     "documents": [{"title": "T", "is_selected": False, "paragraphs": ["p  1"]}, {"title": "U", "is_selected": True, "paragraphs": []}]}
    (tmp_path / "a.jsonl").write_text(json.dumps(rec(1)) + "\n\n" + json.dumps(rec(2)) + "\n")
    (tmp_path / "b.json").write_text(json.dumps([rec(3), rec(4)], indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"data": [rec(5)]}, indent=1))
    (tmp_path / "d.json").write_text(json.dumps(rec(6), indent=1))
    (tmp_path / "e.txt").write_text("not read")
    rows = readers.read_eval_records(spark, str(tmp_path))
    got = {r.question_id: r.source_file for r in rows.collect()}
    assert got == {"1": "a.jsonl", "2": "a.jsonl", "3": "b.json", "4": "b.json", "5": "c.json", "6": "d.json"}
    first = E.to_eval_samples(rows, limit=3).orderBy("sample_id").collect()
    assert [(r.sample_id, r.ground_truth, r.contexts) for r in first] == [(str(i), f"a {i}", ["T\np 1"]) for i in (1, 2, 3)]


def test_upsert_is_idempotent(spark):
    path = work_path(spark, "t")
    old = spark.range(100).select(F.col("id").cast("string").alias("chunk_id"), F.lit("old").alias("v"))
    new = spark.range(90, 120).select(F.col("id").cast("string").alias("chunk_id"), F.lit("new").alias("v"))
    writers.write_buckets(old, path, "chunk_id", 8)
    for _ in range(2):
        writers.upsert_path(spark, path, new, "chunk_id", 8)
    got = {r.chunk_id: r.v for r in writers.read_buckets(spark, path).collect()}
    assert got == {str(i): "new" if i >= 90 else "old" for i in range(120)}


def test_partitions_do_not_matter(spark, sf):
    d = B.markdown(spark, sf)
    for n in (1, 7):
        x = d.repartition(n)
        for op in (C.chunk_paragraph, S.segment_text, C.chunk_recursive):
            a, b = op(d), op(x)
            assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_fixed_chunks_cover_the_text(spark, sf):
    src = {r.doc_id: r.text for r in B.load(spark, sf, "documents").collect()}
    got: dict = {}
    for r in C.chunk_fixed(B.load(spark, sf, "documents"), 200, 30).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    for k, t in src.items():
        assert "".join(c[:170] for c in got[k]) == t


def test_ingest_batch_equals_stream(spark, sf):
    from docflow.catalog.streaming import ingest_job

    a = ingest_job(spark, sf)
    b = CC.ingested(spark, sf).select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_nested_and_row_paths_agree(spark, sf):
    rows = S.heading_paths(CC.blocks(spark, sf)).where("level > 0").select("doc_id", F.col("block_no").alias("start_order"), "heading_path")
    segs = S.segment_text(B.markdown(spark, sf)).where("type = 'heading'").select("doc_id", "start_order", "heading_path")
    assert rows.exceptAll(segs).count() == 0 and segs.exceptAll(rows).count() == 0


def _table(spark, lo, hi, v):
    return spark.range(lo, hi).select(F.col("id").cast("string").alias("chunk_id"), F.lit(v).alias("v"), F.col("id").alias("n"))


def test_a_broken_write_leaves_the_table(spark):
    """A failure between two buckets, or before the manifest, is not seen by readers; the next write goes on."""
    path = work_path(spark, "t")
    buckets.write_buckets(_table(spark, 0, 200, "old"), path, "chunk_id", 8)
    before = sorted(map(tuple, buckets.read_buckets(spark, path).collect()))
    fail = F.when(F.col("chunk_id") == "150", F.raise_error(F.lit("lost")).cast("string")).otherwise("new")
    with pytest.raises(Exception, match="lost"):
        buckets.upsert_path(spark, path, _table(spark, 100, 300, "new").withColumn("v", fail), "chunk_id", 8)
    assert sorted(map(tuple, buckets.read_buckets(spark, path).collect())) == before
    with pytest.raises(Exception, match="repeat"):
        buckets.upsert_path(spark, path, _table(spark, 5, 9, "x").unionAll(_table(spark, 7, 8, "y")), "chunk_id", 8)
    assert sorted(map(tuple, buckets.read_buckets(spark, path).collect())) == before
    reader = buckets.read_buckets(spark, path)
    buckets.upsert_path(spark, path, _table(spark, 190, 210, "new"), "chunk_id", 8)
    assert sorted(map(tuple, reader.collect())) == before
    got = {r.chunk_id: r.v for r in buckets.read_buckets(spark, path).collect()}
    assert got == {str(i): "new" if i >= 190 else "old" for i in range(210)}
    buckets.vacuum(spark, path)
    assert {r.chunk_id: r.v for r in buckets.read_buckets(spark, path).collect()} == got


def test_repeated_updates_are_reduced(spark):
    path = work_path(spark, "t")
    buckets.write_buckets(_table(spark, 0, 10, "old"), path, "chunk_id", 4)
    twice = _table(spark, 8, 12, "a").unionAll(_table(spark, 8, 12, "b").withColumn("n", F.col("n") + 100))
    buckets.upsert_path(spark, path, twice, "chunk_id", 4, newest="n")
    got = {r.chunk_id: r.v for r in buckets.read_buckets(spark, path).collect()}
    assert got == {str(i): "b" if i >= 8 else "old" for i in range(12)}


def test_the_second_of_two_writers_is_refused(spark, monkeypatch):
    path = work_path(spark, "t")
    buckets.write_buckets(_table(spark, 0, 10, "old"), path, "chunk_id", 4)
    keep = buckets._commit

    def late(folder, version, *rest):
        monkeypatch.setattr(buckets, "_commit", keep)
        buckets.upsert_path(spark, path, _table(spark, 0, 5, "first"), "chunk_id", 4)
        return keep(folder, version, *rest)

    monkeypatch.setattr(buckets, "_commit", late)
    with pytest.raises(buckets.Conflict):
        buckets.upsert_path(spark, path, _table(spark, 3, 8, "second"), "chunk_id", 4)
    got = {r.chunk_id: r.v for r in buckets.read_buckets(spark, path).collect()}
    assert got == {str(i): "first" if i < 5 else "old" for i in range(10)}


def test_second_run_embeds_nothing(spark, sf):
    from docflow.hooks import HashingEmbedder, embed_once, embed_stored

    path, model = work_path(spark, "vectors"), HashingEmbedder()
    turns = B.load(spark, sf, "conversations").select("conv_id", "turn", "text")
    want = sorted(map(str, embed_once(turns, "text", model).collect()))
    assert sorted(map(str, embed_stored(turns, "text", model, path).collect())) == want

    def refuse(texts):
        assert set(texts) <= {"a new text"}, texts
        return model(texts)

    assert sorted(map(str, embed_stored(turns, "text", refuse, path).collect())) == want
    more = turns.unionAll(spark.createDataFrame([(-1, 0, "a new text"), (-2, 0, "a new text"), (-3, 0, None)], turns.schema))
    assert embed_stored(more.where("text is not null"), "text", refuse, path).count() == turns.count() + 2


def test_texts_are_not_joined_on_their_way_in(spark):
    """From upload to staged text there is no exchange at all."""
    from docflow.operators.chunking import strategy_label
    from docflow.plans.ingest import parse

    files = spark.range(30).selectExpr(
        "id doc_id", "concat(id, element_at(array('.md', '.txt', '.html'), int(id % 3 + 1))) file_name", "'# a' text", "'Fixed ' strategy", "'{}' config"
    ).withColumn("strategy", strategy_label(F.col("strategy")))
    plan = parse(files, keep=("strategy", "config"))[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_changes_are_moved_once(spark, tmp_path):
    """Changed rows are written once, where they stay, and without a shuffle; nulls and replaced ids included."""
    path = str(tmp_path / "t")
    rows = lambda lo, hi, v: spark.range(lo, hi, 1, 3).select(F.expr("if(id = 0, null, id)").alias("doc_id"), F.lit(v).alias("v"))
    buckets.write_buckets(rows(0, 100, "old").unionAll(rows(0, 100, "old")), path, "doc_id", 4)
    for _ in range(2):
        buckets.replace_path(spark, path, rows(10, 120, "new"), 4, rows(5, 7, "").select(F.col("doc_id").cast("int")))
    got = sorted((str(r.doc_id), r.v) for r in buckets.read_buckets(spark, path).collect())
    assert got == sorted([(str(i or None), "old") for i in range(10) if i not in (5, 6)] * 2 + [(str(i), "new") for i in range(10, 120)])
    buckets.vacuum(spark, path)
    kept = [p.relative_to(path).parts[0] for p in (tmp_path / "t").rglob("*.parquet")]
    assert len(set(kept)) == 2  # the remaining rows and the changes as they were written
    assert max(map(kept.count, set(kept))) >= 3 * 4  # three tasks, four buckets: rows were not dealt out


@pytest.mark.parametrize("bound", [200_000, 20, 5])
def test_replacing_joins_agree(spark, monkeypatch, bound):
    """Few changed documents, few that remain, many of both: the same rows, null ids too."""
    monkeypatch.setattr(buckets, "MAX_BROADCAST_ROWS", bound)
    path = work_path(spark, "t")
    rows = lambda lo, hi, v: spark.range(lo, hi).select(F.expr("if(id = 0, null, id)").alias("doc_id"), F.lit(v).alias("v"))
    buckets.write_buckets(rows(0, 60, "old"), path, "doc_id", 4)
    buckets.replace_path(spark, path, rows(10, 70, "new"), 4)
    got = {r.doc_id: r.v for r in buckets.read_buckets(spark, path).collect()}
    assert got == {(i or None): "new" if i >= 10 else "old" for i in range(70)}
