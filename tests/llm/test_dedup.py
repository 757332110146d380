from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from docflow.llm import exact_dedup, ngram_join, suffix_dedup
from tests.llm.fixtures import SCHEMA, awkward_rows, clashing, components, prose, repeats_removed, shingle_set


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clashing(spark.createDataFrame(rows, SCHEMA).repartition(5)).cache()


def _exact_expected(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("table_bytes", [1 << 26, 3000])
def test_exact_groups(docs, rows, table_bytes):
    got = exact_dedup.exact_duplicates(docs, table_bytes=table_bytes, buckets=2).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == _exact_expected(rows)
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r[1] or "" for r in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_survivors_keep_their_columns(docs, rows):
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted({r[1] or "" for r in rows})


def test_table_compares_complete_content():
    table = exact_dedup.ContentTable(1 << 20)
    assert [table.put(7, b"a"), table.put(7, b"b"), table.put(7, b"a"), table.put(8, b"a")] == [0, 1, 0, 2]
    for i in range(5000):
        table.put(i * 1024, str(i).encode())
    assert table.put(3 * 1024, b"3") == table.contents.index(b"3")


def test_near_components(docs, rows):
    texts = [r[1] for r in rows]
    ids = [r[0] for r in rows]
    of = components(texts)
    members = collections.defaultdict(list)
    for i, c in zip(ids, of, strict=True):
        members[c].append(i)
    want = sorted(
        ((i, len(shingles), min((m for m in members[c] if m is not None), default=None)) for i, c, shingles in
         zip(ids, of, map(shingle_set, texts), strict=True)), key=str,
    )
    got = ngram_join.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_near_survivors(docs, rows):
    out = ngram_join.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(set(got))
    of = components([r[1] for r in rows])
    at = {(r[0], r[1]): c for r, c in zip(rows, of, strict=True)}
    assert collections.Counter(at[g] for g in got).most_common(1)[0][1] == 1
    assert {at[g] for g in got} == set(at.values())
    assert {r.kept for r in out.collect()} == {7} and {r["_id"] for r in out.collect()} == {7}


def test_blocks_of_far_nodes(spark, monkeypatch):
    """A group whose members are similar to the base but not to each other, in blocks of four."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert [got[i] for i in range(60)] == components(texts)


def test_unlimited_profiles_do_not_bound_the_overlap():
    huge, small = np.full(128, ngram_join.UNLIMITED, "<u2"), np.full(128, 60_000, "<u2")
    row = lambda node, n, far, counts: {
        "hub": 1, "block": 0, "node": node, "n": n, "label": node, "far": far, "profile": counts.tobytes()
    }
    held = [row(1, 10**7, False, huge), row(2, 7 * 10**6, False, huge), row(3, 128 * 60_000, False, small)]
    batch = pa.RecordBatch.from_pylist([*held, row(4, 10**7, True, huge)])
    (out,) = ngram_join._compare(iter([batch]))
    # the second is too short; the third may share all it has
    assert out.to_pylist() == [{"a": 1, "b": 4}, {"a": 3, "b": 4}]


@pytest.mark.parametrize("shard_bytes", [4 << 20, 700])
def test_repeated_strings(spark, shard_bytes):
    rng = random.Random(4)
    passage, other = prose(rng, 40), prose(rng, 30)
    texts = [None, "", "short", "ab" * 200, "z" * 90, passage, passage, f"{prose(rng, 9)} {passage} {prose(rng, 9)}"]
    texts += [f"{prose(rng, 5)} {other} {prose(rng, 5)} {passage[20:150]}" for _ in range(12)] + [prose(rng, 60) for _ in range(20)]
    want = repeats_removed(texts, 60)
    docs = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    out = suffix_dedup.remove_repeats(docs, length=60, shard_bytes=shard_bytes, with_text=True).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    assert [got[i] for i in range(len(texts))] == want
    assert all(hashlib.sha256(r.kept_bytes).hexdigest() == r.kept_sha256 for r in out)


def test_repeated_strings_awkward(docs, rows):
    want = collections.Counter(repeats_removed([r[1] for r in rows], 400))
    got = suffix_dedup.remove_repeats(docs).collect()
    assert collections.Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)


def test_passage_in_many_surroundings(spark):
    """A few keys with one context per document, many times what a shard holds."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = noise(75)
    texts = [f"{noise(70)}{passage}{noise(70)}" for _ in range(300)] + [f"{noise(5)}{passage}" for _ in range(4)]
    texts += [texts[0][20:], texts[1][:140], passage[:61]]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[3])]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=60, shard_bytes=400).collect()
    want = repeats_removed([t for _, t in rows], 60)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)
    assert got == collections.Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_contexts_of_a_large_key_leave_the_task(monkeypatch):
    made = []
    monkeypatch.setattr(suffix_dedup, "Shard", lambda contexts, length, shard=suffix_dedup.Shard: made.append(1) or shard(contexts, length))
    rng = random.Random(2)
    rows = [
        {"key": 7, "content": i, "doc_id": i, "mark": 0, "first": 0, "n": 41, "large": True, "context": prose(rng, 40).encode()[:100]}
        for i in range(50)
    ]
    out = list(suffix_dedup._match(60, 400)(iter([pa.RecordBatch.from_pylist(rows)])))
    assert made == []
    assert [c for b in out for c in b.column("context").to_pylist()] == [r["context"] for r in rows]


def test_pieces_cover_every_start_once():
    rng = random.Random(3)
    for text in (prose(rng, 60), "ab" * 200, "z" * 90, prose(rng, 8) * 6):
        data = text.encode()
        for key, first, n, _ in suffix_dedup.segments(np.frombuffer(data, np.uint8), 60):
            found = sorted((a, b) for a, b, *_ in suffix_dedup.pieces(data[first : first + n + 59], key, n, 60))
            assert [s for a, b in found for s in range(a, b + 1)] == list(range(n))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 4):
        text = np.append(rng.integers(97, 97 + letters, 300), 256).astype(np.int32)
        order = suffix_dedup.suffix_array(text)
        tails = [text[i:].tolist() for i in range(len(text))]
        assert order.tolist() == sorted(range(len(text)), key=tails.__getitem__)
        shared = suffix_dedup.common_prefixes(text, order)
        for k in range(1, len(text)):
            a, b = tails[order[k - 1]], tails[order[k]]
            assert shared[k] == next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(none).count() == 0
    assert ngram_join.near_duplicates(none).count() == 0
    assert ngram_join.drop_near_duplicates(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
