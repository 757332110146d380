"""Awkward rows and slow, plain versions of the operators."""

from __future__ import annotations

import collections
import hashlib
import random
import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = "the of and to in is was that it for tree river stone cloud amber quiet morning harbour lantern ridge über naïve 日本 ß".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def awkward_rows(seed: int = 5, n: int = 120) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): copies, near copies, nulls, empties, long texts, repeated rows."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \t\n", "one", "One two", "!!! ### ...", "\x1c\x00é\n", "a " * 900, "x" * 3000]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.35 or not any(texts):
            texts.append(prose(rng, rng.choice([3, 30, 150, 400])))
        elif kind < 0.55:
            texts.append(rng.choice(texts))
        else:
            words = (rng.choice([t for t in texts if t]) or "").split(" ")
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            texts.append(" ".join(words))
    texts.append(prose(rng, 20_000))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["b", "a", None, "ü"]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, texts[20], "en", "a", 1), (None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df):
    """The same rows with further columns, named like those that operators add."""
    from pyspark.sql import functions as F

    extra = ["node", "label", "_row", "_id", "_mark", "key", "size", "taken", "words", "runs", "mark", "pattern", "score", "kept"]
    return df.select("*", *(F.lit(7).alias(c) for c in extra))


def shingle_set(text: str | None) -> frozenset:
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = SPACE.findall(lowered)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(texts: list[str | None]) -> list[int]:
    """For each text the smallest position linked with it."""
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def repeats_removed(texts: list[str | None], length: int) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[a : a + length] for d in data for a in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for a in range(len(d) - length + 1):
            if seen[d[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        rest = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out
