from __future__ import annotations

import collections
import hashlib
import json
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from docflow.llm import bpe, langid, licenses, mixing, quality
from tests.llm.fixtures import SCHEMA, SPACE, awkward_rows, clashing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clashing(spark.createDataFrame(rows, SCHEMA).repartition(5)).cache()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_tokens_match_the_library(docs, rows, library):
    want = collections.Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[r[0], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in bpe.token_digests(docs, PATH).collect()) == want


def test_odd_texts_match_the_library(library):
    merges = bpe.MergeList(json.load(open(PATH)))
    cache, rng = bpe.PieceCache(merges), random.Random(1)
    letters = "abthein'’éöß日本ΣσİǅǺ̧ \t\n\x0b\x1c\x1f\x85\xa0 　​0½²٣<|>!?-_😀"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 40, 400])))
        text += rng.choice(["", "<|endoftext|>x", "a<|startoftext|>", "th" * 500])
        ids = [i for part in bpe.encode(text, cache) for (i,) in struct.iter_unpack("<I", part)]
        assert ids == library.encode(text, add_special_tokens=False).ids
        decoder = bpe.TextDecoder(merges)
        cut = rng.randrange(len(ids) + 1)
        assert decoder.feed(ids[:cut]) + decoder.feed(ids[cut:]) + decoder.end() == library.decode(ids, skip_special_tokens=False)


def test_lookahead_suffices():
    """Tokens that a bounded window emits are those of the whole word, for random merge lists."""
    rng = random.Random(8)
    for _ in range(60):
        known, merges = ["a", "b", "c"], []
        while len(merges) < 25:
            pair = (rng.choice(known), rng.choice(known))
            if pair not in merges and len(pair[0]) + len(pair[1]) < 9 and pair[0] + pair[1] not in known:
                merges.append(pair)
                known.append(pair[0] + pair[1])
        vocab = {t: i for i, t in enumerate([*known, *(t + "/" for t in "abc")])}
        file = {
            "model": {"vocab": vocab, "merges": [list(m) for m in merges], "end_of_word_suffix": "/"},
            "pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": r"\p{L}+"}}]},
        }
        made = bpe.MergeList(file)
        word = [rng.choice("abc") for _ in range(4 * made.window)]
        assert list(made.stream(word)) == made.merged([*word[:-1], word[-1] + "/"])


def test_ids_and_texts_round_trip(docs, rows):
    back = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()
    assert len(back) == len(rows) and all(isinstance(r.text, str) for r in back)


def test_language_rules(spark, docs, rows):
    got = langid.identify(docs).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
    none = {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == none
    bare = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in bare} == {("und", 0.0)}


def test_language_accuracy_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs).where("held_out").join(docs, "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_language_scores_by_hand(spark):
    rows = [(0, "ab ab"), (2, "cd cd"), (3, "ab")]
    labelled = spark.createDataFrame([(i, t, t[0]) for i, t in rows], "doc_id long, text string, lang string")
    model = langid.train(labelled, "text", "lang")
    assert model.labels == ["a", "c"]
    grams = lambda t: [t[i : i + w] for w in (2, 3) for i in range(len(t) - w + 1)]
    bucket = {g: int(b) for t in ("ab ab", "cd cd", "ab") for g, b in zip(grams(f" {t} "), langid.ngram_buckets([t])[0], strict=True)}
    counts = {"a": collections.Counter(), "c": collections.Counter()}
    for _, t in rows:
        counts[t[0]].update(bucket[g] for g in grams(f" {t} "))
    odds = []
    for label, share in (("a", 2 / 3), ("c", 1 / 3)):
        total = sum(counts[label].values()) + 0.5 * langid.BUCKETS
        p = share
        for g in grams(" ab "):
            p *= (counts[label][bucket[g]] + 0.5) / total
        odds.append(p)
    assert langid.scores(["ab"], model)[0][0] == pytest.approx(odds[0] / sum(odds))


def test_license_places(docs, rows):
    table = {r[0]: r[1] for r in rows}
    for r in licenses.license_spans(docs).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), table[r.doc_id] or ""))
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), 0, None, None, "")


def test_license_labels(spark):
    mit = licenses.TEMPLATES[0][1]
    texts = [
        "Licensed under CC-BY and cc by; see the GNU General Public License. All rights reserved", None, "",
        f"intro {mit} outro", f"{mit[:60]} of", "cc by cc by by", "the rights of the software and of the work",
    ]
    out = licenses.license_spans(clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    got = {r.doc_id: r for r in out.collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (4, 2, 13, "cc-by,gpl,reserved")
    assert (got[1].n_words, got[1].first_word, got[1].labels, got[1].score) == (0, None, "", 0.0) and got[2].n_base == 0
    assert (got[3].labels, got[3].base_labels, got[3].score) == ("mit", "", 1.0)
    assert [(s.label, s.first, s.last) for s in got[3].spans] == [("mit", 1, len(licenses.words_of(mit.encode())))]
    assert got[4].labels == "" and 0 < got[4].score < 0.6
    assert (got[5].n_base, got[5].first_word, got[5].last_word) == (2, 0, 2)
    assert got[6].labels == "" and got[6].score < 0.2


def test_license_names(spark):
    """Notices that differ from other licences' in a word or two."""
    cc = "This work is licensed under a Creative Commons Attribution"
    want = {
        "This work is licensed under the MIT License": "mit",
        "This work is licensed under the Apache License, Version 2.0": "apache-2.0",
        "This work is licensed under the Apache License, Version 1.1": "",
        "This work is licensed under the Mozilla Public License": "",
        f"{cc} 4.0 International License": "cc-by",
        f"{cc} 3.0 Unported License": "cc-by",
        f"{cc}-NonCommercial 4.0 International License": "cc-by-nc",
        f"{cc}-ShareAlike 4.0 International License": "cc-by-sa",
        f"{cc}-ShareAlike 3.0 Unported License": "cc-by-sa",
        f"{cc}-NoDerivatives 4.0 International License": "cc-by-nd",
        f"{cc}-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa",
        f"{cc}-NonCommercial-NoDerivatives 4.0 International License": "cc-by-nc-nd",
        "Released under the MIT License": "mit",
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score >= 0.6) for r in licenses.license_spans(docs).collect()}
    assert [got[i] for i in range(len(want))] == [(labels, labels != "") for labels in want.values()]


def _plain_spans(words, template, name, long_match=4, gap=8):
    """Spans of a template by comparing all pairs of words."""
    n, m = len(words), len(template)
    tail = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            tail[i + 1][j + 1] = tail[i][j] + 1 if words[i] == template[j] else 0
    best = [max(row) for row in tail] + [0]
    out, open_ = [], []
    for i in range(1, n + 1):
        size = best[i]
        if size < long_match or best[i + 1] == size + 1:
            continue
        at = tail[i].index(size) - 1
        if open_ and at > open_[-1][1] and at - size + 1 > open_[0][1] - open_[0][2] + 1 and i - size - open_[-1][0] <= gap + 1:
            open_.append((i - 1, at, size))
        else:
            out.append(open_)
            open_ = [(i - 1, at, size)]
    spans = []
    for parts in filter(None, [*out, open_]):
        inside = any(
            words[p : p + len(name)] == name and words[p + len(name) : p + len(name) + 1] not in [[v] for v in licenses.VARIANTS]
            for last, _, size in parts for p in range(last - size + 1, last - len(name) + 2)
        )
        if inside or not name:
            held = {j for _, at, size in parts for j in range(at - size + 1, at + 1) if j > parts[0][1] or at == parts[0][1]}
            spans.append((parts[0][0] - parts[0][2] + 1, parts[-1][0], len(held) / m))
    return spans


def test_license_spans_match_plain_search(spark):
    """Texts with several whole, cut and altered notices between other words."""
    rng = random.Random(12)
    templates = [[licenses.words_of(part.encode()) for part in t[1:]] for t in licenses.TEMPLATES]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 7)):
            notice = list(rng.choice(templates)[0])
            for _ in range(rng.choice([0, 0, 1, 3])):
                notice[rng.randrange(len(notice))] = rng.choice([b"the", b"other", b"license", b"noncommercial"])
            words += notice[: rng.choice([len(notice), len(notice), 7])] + [b"word"] * rng.choice([0, 2, 30])
        texts.append(b" ".join(words).decode())
    mit = licenses.TEMPLATES[0][1]
    texts.append(f"{mit} first file {mit}\n{mit}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_spans(docs).collect()}
    for i, text in enumerate(texts):
        words = licenses.words_of(text.encode())
        spans = [(t[0], *s) for t, (w, name) in zip(licenses.TEMPLATES, templates, strict=True) for s in _plain_spans(words, w, name)]
        want = sorted(s for s in spans if s[3] >= 0.6)
        assert sorted((s.label, s.first, s.last, s.covered) for s in got[i].spans) == want
        phrases = {p.encode(): label for p, label in licenses.PHRASES.items()}
        places = [(a, p) for a in range(len(words)) for p in phrases if words[a : a + len(p.split())] == p.split()]
        assert got[i].n_base == len(places) and got[i].first_word == min((a for a, _ in places), default=None)
        assert got[i].labels == ",".join(sorted({phrases[p] for _, p in places} | {s[0] for s in want}))
        assert got[i].score == (1.0 if places else max((s[3] for s in spans), default=0.0))
    assert [s.label for s in got[60].spans] == ["mit"] * 3


def _repeated(words):
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(marked)


def test_quality_counts(docs, rows):
    want = collections.Counter()
    for i, text, *_ in rows:
        words = SPACE.findall(text or "")
        lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
        want[
            i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), _repeated(words),
            len(words) < 20 or 100 * _repeated(words) > 30 * len(words),
        ] += 1
    got = quality.judge(docs).collect()
    assert collections.Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got
    ) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_junk_is_far_from_prose(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = quality.judge(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    assert got.where("quality = 1 and not kept").count() == 0


def test_every_language_has_its_reference(spark):
    """Clean texts of a fifth language stay, also beside common ones; junk goes in all of them."""
    rng = random.Random(7)
    english = lambda: " ".join(rng.choice("the of and to in is was that it for tree river stone cloud amber quiet".split()) + rng.choice("aeiou") * rng.randrange(2) for _ in range(120))
    kana = lambda: " ".join("".join(rng.choice("あいうえおかきくけこさしすせそ日本語") for _ in range(rng.randrange(1, 6))) for _ in range(120))
    junk = lambda: " ".join("".join(rng.choice("#*$%&|<>0123456789") for _ in range(rng.randrange(1, 6))) for _ in range(120))
    texts = [("en", english()) for _ in range(40)] + [("ja", kana()) for _ in range(40)] + [(x, junk()) for x in ("en", "ja", None)]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert not any(got[i].base_failed for i in got)
    assert [got[i].kept for i in range(80)] == [True] * 80
    assert [got[i].kept for i in range(80, 83)] == [False] * 3
    given = {r.doc_id: r for r in quality.judge(docs, languages=["en"]).collect()}
    assert all(given[i].divergence is None and given[i].kept for i in range(40, 80))
    assert not given[80].kept and given[0].divergence == got[0].divergence


def test_mixture(docs, rows):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for i, text, _, source, _ in rows:
        sizes[source] += len(SPACE.findall(text or ""))
    weights = dict(zip(["a", "b", "ü", None], [3, 1, 2, 3], strict=True))
    left, target, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while free:
        over = [s for s in free if left * weights[s] / sum(weights[x] for x in free) > 2 * sizes[s] + 1e-9]
        level = left / sum(weights[x] for x in free)
        if not over:
            target |= {s: level * weights[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    of = collections.defaultdict(int)
    source_of = {(i, len(SPACE.findall(t or ""))): s for i, t, _, s, _ in rows}
    for r in got:
        s = source_of[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r["size"]
        assert r.copies == (-(-r.taken // r["size"]) if r["size"] else 0)
        of[s] += r.taken
    assert all(abs(of[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


def test_flow_prefers_fresh_tokens_of_overlapping_sources():
    patterns = {("a",): 10, ("a", "b"): 10, ("b",): 0}
    assert mixing.route(patterns, {"a": 10, "b": 10}) == {("a",): 10, ("a", "b"): 10, ("b",): 0}
    assert mixing.route(patterns, {"a": 15, "b": 15}) == {("a",): 15, ("a", "b"): 15, ("b",): 0} or sum(
        mixing.route(patterns, {"a": 15, "b": 15}).values()) == 30


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else None) for i in range(30)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert len(got) == 30 and all(0 <= r.taken <= 20 for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.token_digests(none, PATH).count() == 0
    assert langid.identify(none).count() == 0
    assert licenses.license_spans(none).count() == 0
    assert quality.judge(none).count() == 0
    assert mixing.mix(none).count() == 0


def test_distance_to_a_reference(spark):
    import numpy as np

    rng = random.Random(6)
    for _ in range(5):
        counts, reference = [rng.choice([0, 1, 5, 40]) for _ in range(9)], [rng.choice([0, 2, 70]) for _ in range(9)]
        counts[0] = reference[0] = 3
        p, q = np.array(counts) / sum(counts), np.array(reference) / sum(reference)
        m = (p + q) / 2
        part = lambda x, m=m: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        row = spark.createDataFrame([(counts,)], "c array<long>")
        got = row.select(quality.js_distance(F.col("c"), F.lit(sum(counts)), reference)).first()[0]
        assert got == pytest.approx(((part(p) + part(q)) / 2) ** 0.5)
