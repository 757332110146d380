"""Hashes of words and of word shingles, in numpy over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from docflow.llm.blocks import SPACES

BLOCK = 4 << 20
_BASE = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SPACES, np.uint8))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> np.ndarray:
    """The base to the power 0 to n - 1, modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = _BASE
    return np.multiply.accumulate(out)


def _block_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~_SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    heads = cuts[cuts < len(data)]
    begin[heads] = word[heads]
    starts = np.flatnonzero(begin)
    if len(starts) == 0:
        return np.empty(0, np.uint64), starts
    if starts[0] > 0:  # bytes before the first word count for nothing
        data, word, begin = data[starts[0] :], word[starts[0] :], begin[starts[0] :]
    at = np.flatnonzero(begin)
    place = np.arange(len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))
    letters = _LETTER[_LOWER[data]] * powers(int(place.max()) + 1)[place]
    letters[~word] = 0
    return mix(np.add.reduceat(letters, at)), starts


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the lower-cased (A-Z) texts, and the number of words before each text."""
    hashes, starts, done = [], [], 0
    while done < len(data):
        end, width = len(data), BLOCK
        while done + width < len(data):  # a block ends before white space, however far that is
            gaps = np.flatnonzero(_SPACE[data[done + 1 : done + width]])
            if len(gaps):
                end = done + 1 + int(gaps[-1])
                break
            width *= 2
        cuts = offsets[(offsets >= done) & (offsets < end)] - done
        h, s = _block_words(data[done:end], cuts)
        hashes.append(h)
        starts.append(s + done)
        done = end
    at = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.searchsorted(at, offsets)


def shingles(hashes: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside a text, and the text it belongs to.

    A text with fewer words gives its whole sequence as one; one without words gives none.
    """
    counts = np.diff(before)
    out, owners = [], []
    if len(hashes) >= size:
        h = hashes[: len(hashes) - size + 1].copy()
        for j in range(1, size):
            h = h * _STEP + hashes[j : len(hashes) - size + 1 + j]
        owner = np.repeat(np.arange(len(counts)), counts)
        inside = owner[: len(h)] == owner[size - 1 :]
        out.append(mix(h[inside] + np.uint64(size)))
        owners.append(owner[: len(h)][inside])
    for width in range(1, size):
        short = np.flatnonzero(counts == width)
        if len(short):
            first = before[short]
            h = hashes[first].copy()
            for j in range(1, width):
                h = h * _STEP + hashes[first + j]
            out.append(mix(h + np.uint64(width)))
            owners.append(short)
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(owners)
