from __future__ import annotations

import collections
import hashlib
import struct

import public_tokenizers

import corpus_pipeline
from docflow.llm import langid
from tests.llm.fixtures import SCHEMA, SPACE, awkward_rows, components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _mixed(rows):
    """Copies of each row: targets by weight, documents in the order of their MD5."""
    size = {r: len(SPACE.findall(r[1] or "")) for r in rows}
    total = collections.Counter()
    for r in rows:
        total[r[3]] += size[r]
    ordered = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(ordered)}
    left, target, free = 1.5 * sum(total.values()), {}, set(ordered)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * total[s] + 1e-9]
        for s in over or free:
            target[s] = 2 * total[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        free = free - set(over) if over else set()
    out = []
    for s in ordered:
        quota, ahead = int(round(target[s], 6)), 0
        whole, rest = divmod(quota, total[s]) if total[s] else (0, 0)
        key = lambda r: (hashlib.md5("-".join(["mix", *([str(r[0])] if r[0] is not None else [])]).encode()).hexdigest(), r[0] or 0)
        for r in sorted((r for r in rows if r[3] == s), key=key):
            taken = whole * size[r] + max(0, min(size[r], rest - ahead))
            ahead += size[r]
            out += [r] * (-(-taken // size[r]) if size[r] else 0)
    return out


def test_run_matches_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [r for r in awkward_rows(seed=9) if r[0] is not None]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "bpe"]
    known = {r.doc_id for r in langid.identify(docs).where("lang_pred != 'und' and score >= 0.5").collect()}
    left = {r[1]: r for r in sorted(r for r in rows if r[0] in known)}  # the last of equal texts has the largest id
    ordered = sorted(left.values())
    left = [r for i, r in enumerate(ordered) if components([x[1] for x in ordered])[i] == i]
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), collections.Counter()
    for r in _mixed(left):
        ids = library.encode(r[1], add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == want


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(awkward_rows(seed=3), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == COLUMNS
        assert stage(spark, docs.limit(0), "").count() == 0
