from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest

from docflow.llm import manifest
from tests.llm.fixtures import SCHEMA, awkward_rows, clashing


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row: tuple, more: int = 0) -> str:
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + more
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root of a list of digests, and of each of them its siblings with their sides."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for proof, i in zip(proofs, at, strict=True):
            other = i ^ 1
            proof.append(("=", "") if other >= len(nodes) else ("<" if i % 2 else ">", nodes[other]))
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], proofs


def expected(rows: list[tuple]) -> list[tuple]:
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built[g] = tree([leaf_of(r) for r in groups[g]])
    root, over = tree([built[g][0] for g in langs])
    out = []
    for g, above in zip(langs, over, strict=True):
        subroot, proofs = built[g]
        for r, inside in zip(groups[g], proofs, strict=True):
            proof = inside + above
            value = leaf_of(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for side, other in proof:
                value = sha(other + value if side == "<" else value + other)
            shown = "".join(side + other for side, other in proof)
            out.append((r[0], leaf_of(r), subroot, root, sha("".join(d for _, d in proof)), value, value == root, shown))
    return sorted(out, key=str)


def result(df) -> list[tuple]:
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    return awkward_rows(n=90)


@pytest.mark.parametrize("width,limit", [(14, 1 << 13), (2, 3)])
def test_manifest(spark, rows, width, limit):
    """One block per language, and many small blocks in several rounds with queues that spill."""
    docs = clashing(spark.createDataFrame(rows, SCHEMA).repartition(6))
    got = result(manifest.manifest(docs, width, limit))
    assert got == expected(rows)
    assert {r[6] for r in got} == {True, False}


def test_many_languages(spark):
    """Groups of one document, an empty name and null; the tree above them has several rounds."""
    names = [None, "", "=", "é", "z" * 50] + [f"l{i}" for i in range(30)]
    rows = [(i, f"text {i}", names[i % 35] if i < 60 else "en", "a", None if i % 5 == 0 else i) for i in range(200)]
    got = result(manifest.manifest(spark.createDataFrame(rows, SCHEMA), 2, 4))
    assert got == expected(rows)
    assert all(r[6] for r in got if r[0] % 5 == 0)


def test_empty_and_single(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = [(4, "only", "en", "a", 4)]
    got = result(manifest.manifest(spark.createDataFrame(one, SCHEMA)))
    assert got == expected(one)
    assert got[0][1] == got[0][2] == got[0][3]


@pytest.mark.parametrize("limit", [1, 2, 50, 10_000])
def test_queue_spills_and_orders(limit):
    rng = random.Random(limit)
    queue, plain, out = manifest.ExternalQueue(limit), [], []
    for step in range(4000):
        if plain and rng.random() < 0.45:
            label, payload = queue.pop()
            assert label == min(plain)[0]
            plain.remove((label, payload))
            out.append(label)
        else:
            message = (rng.randrange(-10**9, 10**9), bytes(rng.randrange(256) for _ in range(rng.randrange(5))))
            queue.push(*message)
            plain.append(message)
        if plain:
            assert queue.first() == min(plain)[0]
    assert sorted(plain)[0][0] == queue.first()
    assert [queue.pop()[0] for _ in range(len(plain))] == sorted(label for label, _ in plain)
    queue.close()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 1025])
def test_sweeps(n):
    leaves = [sha(str(i)).encode() for i in range(n)]
    root, proofs = tree([x.decode() for x in leaves])
    for limit in (2, 1 << 13):
        log = manifest.forward(leaves, manifest.levels_of(n), limit)
        assert log[-1] == [root.encode()]
        got = list(manifest.backward(log, limit))
        assert [p.decode() for p in got] == ["".join(s + d for s, d in proof) for proof in proofs]
        assert {manifest.fold(leaf, p) for leaf, p in zip(leaves, got, strict=True)} == {root.encode()}
