from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docflow.llm import alignment
from tests.llm.fixtures import SCHEMA, awkward_rows, clashing, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a  b", "  lead and trail  ", "tab\tq\n\nz", "<s> hi <0x41> <|endoftext|> </s>", "mid▁dle of it", "▁", " ", "\n", "\x00z \x1c y",
    "日本 語 text 日本", "é é ﬁ Å Å", "I'm we've it's 12 345", "a b c d", "… — “q” ‘r’", "👍🏽 x 👨‍👩‍👧 y", "x" * 300 + " y",
    "naïve café", "don 't", "q   r 　 s", "mixed▁ ends ▁", "!! ?? ## $$ %%", "a\r\nb \r\n c",
]


def plain(texts: list[str | None]) -> list[tuple]:
    """Straight from the rule: whole texts, every pair of tokens whose ranges overlap."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
    aligned, counts = [], collections.Counter()
    for text in texts:
        if not text:
            aligned.append(None)
            continue
        want = (" " + text).encode()
        sides = []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        sides.append([(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in ids])
        ids = b.encode(text)
        sides.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids])
        if any(b"".join(x for _, x in side) != want for side in sides):
            aligned.append(None)
            continue
        spans = []
        for side in sides:
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, j = [], 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if s >= start and e <= end) for side in spans))
            start = end
        aligned.append((len(spans[0]), len(spans[1]), len(ends), links, ";".join(groups)))
        counts.update(links)
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for x in aligned:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = x
        tops = sum(1 for p in links if counts[p] == best[p[1]])
        out.append((n_a, n_b, n_groups, len(links), tops, sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()))
    return out


def some_rows() -> list[tuple]:
    rng = random.Random(11)
    rows = [r for r in awkward_rows(n=60) if len(r[1] or "") < 5000]
    texts = ODD + [" ".join(rng.choice(ODD) for _ in range(6)) for _ in range(20)] + [prose(rng, 60)] * 3
    return rows + [(1000 + i, t, "en", "a", len(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("most", [1 << 21, 300, 1])
def test_alignment(spark, most):
    """All pairs in the table; most of them joined by key; all of them."""
    rows = some_rows()
    docs = clashing(spark.createDataFrame(rows, SCHEMA).repartition(7))
    got = alignment.align_tokens(docs, A, B, most=most)
    assert got.columns == alignment.COLUMNS
    want = sorted(((r[0], *x) for r, x in zip(rows, plain([r[1] for r in rows]), strict=True)), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_empty(spark):
    assert alignment.align_tokens(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    nothing = alignment.align_tokens(spark.createDataFrame([(1, None, None, None, None)], SCHEMA), A, B).collect()
    assert [tuple(r) for r in nothing] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_long_texts_are_cut(spark, monkeypatch):
    """Texts of many stretches, and a stretch that no blank ends, give what the whole text gives."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(ODD).replace("▁", "_") for _ in range(300)) for _ in range(4)]
    texts += [texts[0] + " ▁ " + texts[1], "日本" * 500 + " a b c", "x" * 3000]
    pair = alignment.Pair(A, B)
    whole = list(alignment.tokens_of(pair, texts))
    monkeypatch.setattr(alignment, "STRETCH", 50)
    cut = list(alignment.tokens_of(pair, texts))
    assert len(cut[0]) > 20 and cut[4] == whole[4] == []
    for x, y in zip(cut, whole, strict=True):
        for side in (0, 1):
            assert [i for part in x for i in part[side].tolist()] == [i for part in y for i in part[side].tolist()]
    # the workers read the patched length from their own copy of the module, so the column goes through the same code here
    rows = pa.RecordBatch.from_pydict({"a": [[p[0].astype("<u2").tobytes() for p in t] for t in cut], "b": [[p[1].astype("<u2").tobytes() for p in t] for t in cut]})
    sizes = tuple(np.array([len(t) for t in side], np.int64) for side in (pair.a_bytes, pair.b_bytes))
    for first, _, pieces in alignment._runs(rows):
        if cut[first]:
            shown = b";".join(bytes(alignment._stretch(s, sizes).groups()[0]) for s in pieces)
            whole_row = tuple([[whole[first][0][side].astype("<u2").tobytes()]] for side in (0, 1))
            assert shown == bytes(alignment._stretch(whole_row, sizes).groups()[0])


def test_ranks_give_the_ids_of_the_file():
    """The faster encoder against the library that reads the file, over all code points in several places."""
    pair = alignment.Pair(A, B)
    library = alignment.Pair._library(A)
    places = ("a{0}b", "a {0} b", "{0}{0}x", " {0}", "1{0}2", "{0} {0}", "\n{0}", "'{0}", "x  {0}", "{0}  x", "'s{0}", "!{0}!")
    texts = [p.format(chr(c)) for c in range(0x250) for p in places]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in range(0x250, 0x110000, 7) if not 0xD800 <= c < 0xE000] + ODD
    assert [x.tolist() for x in pair.a(texts)] == [x.tolist() for x in library(texts)]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 200_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 48, n))
    made = alignment.PerfectHash.of(keys)
    assert sorted(made.find(keys).tolist()) == list(range(len(keys)))


def test_table_verifies_keys(spark):
    rng = random.Random(4)
    keys = sorted({rng.randrange(1 << 47) for _ in range(150_000)})
    df = spark.createDataFrame([(k, k % 5) for k in keys], "key long, links long").repartition(9)
    table = alignment.build_table(df, len(keys))
    assert table.bits == 2 and sorted(table.keys.tolist()) == keys
    assert table.keys[table.find(np.array(keys))].tolist() == keys
    held = set(keys)
    strangers = np.array([k + 1 for k in keys if k + 1 not in held][:5000])
    assert (table.find(strangers) == -1).all()
    alignment.sum_counts(df.unionAll(df), table)
    assert (table.counts == 2 * (table.keys % 5)).all()
