"""Operators at the bounds they promise."""

from __future__ import annotations

import itertools
import random
import time
import tracemalloc

import numpy as np

from docflow.llm import langid, mixing
from tests.llm.fixtures import prose


def _model(labels: int) -> langid.LanguageModel:
    rng = np.random.default_rng(1)
    return langid.LanguageModel([f"l{i:03d}" for i in range(labels)], np.full(labels, -np.log(labels)), np.log(rng.random((langid.BUCKETS, labels)) + 0.1))


def test_scores_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (0, 1, 30, 4000, 2)]
    whole = langid.scores(texts, _model(20))
    monkeypatch.setattr(langid, "SCORED", 100)
    assert np.allclose(langid.scores(texts, _model(20)), whole, atol=1e-9)
    buckets, owner = langid.ngram_buckets(texts)
    for i in range(len(texts)):
        log = _model(20).weight[buckets[owner == i]].sum(axis=0)
        odds = np.exp(log - log.max())
        assert np.allclose(whole[i], odds / odds.sum(), atol=1e-6)


def test_memory_does_not_grow_with_labels():
    """256 labels on one long text: the matrix is met in pieces."""
    text = prose(random.Random(2), 200_000)
    peaks = []
    for labels in (4, 256):
        model = _model(labels)
        tracemalloc.start()
        langid.scores([text], model)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + (64 << 20)


def _cost(taken: dict, patterns: dict) -> int:
    return sum((2 * (t // patterns[p]) + 1) * (t % patterns[p]) + patterns[p] * (t // patterns[p]) ** 2 for p, t in taken.items() if patterns[p])


def _best(patterns: dict, quotas: dict, repeats: int) -> tuple[int, int]:
    """Most tokens, then least cost, over all amounts per arc."""
    arcs = [(p, s) for p in patterns for s in p]
    best = None
    for amounts in itertools.product(*(range(min(repeats * patterns[p], quotas[s]) + 1) for p, s in arcs)):
        out = {p: sum(a for a, (q, _) in zip(amounts, arcs, strict=True) if q == p) for p in patterns}
        into = {s: sum(a for a, (_, t) in zip(amounts, arcs, strict=True) if t == s) for s in quotas}
        if all(out[p] <= repeats * patterns[p] for p in patterns) and all(into[s] <= quotas[s] for s in quotas):
            key = (-sum(out.values()), _cost(out, patterns))
            best = key if best is None or key < best else best
    return best


def test_layers_find_the_cheapest_flow():
    rng = random.Random(3)
    for _ in range(25):
        sources = ["a", "b", "c"][: rng.randrange(1, 4)]
        patterns = {p: rng.randrange(0, 4) for n in (1, 2) for p in itertools.combinations(sources, n) if rng.random() < 0.7}
        quotas = {s: rng.randrange(0, 6) for s in sources}
        taken = mixing.route(patterns, quotas)
        assert (-sum(taken.values()), _cost(taken, patterns)) == _best(patterns, quotas, 2)


def test_as_many_patterns_as_the_bound():
    rng = random.Random(4)
    sources = [f"s{i}" for i in range(40)]
    patterns = {}
    while len(patterns) < mixing.MAX_PATTERNS:
        patterns[tuple(sorted(rng.sample(sources, rng.randrange(1, 5))))] = rng.randrange(1, 10_000)
    total = sum(patterns.values())
    quotas = {s: int(1.5 * total * w / 820) for w, s in enumerate(sources, 1)}
    started = time.time()
    taken = mixing.route(patterns, quotas)
    assert time.time() - started < 60
    assert all(t <= 2 * patterns[p] for p, t in taken.items()) and sum(taken.values()) <= sum(quotas.values())
