"""Licence scan with a generalised suffix automaton over the words of licence templates.

The automaton of all templates is built once and broadcast (its size is bounded by
the templates: fewer than two states per word). A text streams through it word by
word; the state and length after each word are its matching statistics, the longest
suffix that occurs in some template. The states behind its suffix links give the
same for each template by itself. Ends of long matches are chained per template in
the order of the text; the words a chain covers are a covered span of the template.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.blocks import raw_bytes, text_or_empty

# Phrases of the contract and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Wording of public licences and notices, the label of each, and the words that tell it from others.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", ""),
    ("mit", "Released under the MIT License", "MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Apache License Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License", "GNU General Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution"),
    ("cc-by", "Licensed under CC BY 4.0", "CC BY"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Attribution-NonCommercial"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "CC BY-NC"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Attribution-ShareAlike"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "CC BY-SA"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "Attribution-NoDerivatives"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", "CC BY-ND"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Attribution-NonCommercial-ShareAlike"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0", "CC BY-NC-SA"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Attribution-NonCommercial-NoDerivatives"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0", "CC BY-NC-ND"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law", ""),
]
# Behind its name these words make it the name of another licence.
VARIANTS = frozenset(b"noncommercial non nc sharealike share sa noderivatives noderivs no nd".split())
LONG_MATCH = 4
LARGEST_GAP = 8
COVERED = 0.6

_WORD_BYTES = np.full(256, ord(" "), np.uint8)
_WORD_BYTES[48:58] = np.arange(48, 58)
_WORD_BYTES[97:123] = np.arange(97, 123)
_WORD_BYTES[65:91] = np.arange(97, 123)
_WORD_BYTES[128:] = np.arange(128, 256)
WORD_TABLE = _WORD_BYTES.tobytes()


def words_of(text: bytes) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


@dataclass
class Automaton:
    """Generalised suffix automaton; state 0 is the empty match."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    to: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    # per state: template -> last position (in the template) of the first occurrence of its matches
    ends: list[dict[int, int]] = field(default_factory=lambda: [{}])
    # per state: template -> its longest suffix of the state's matches (0: the whole match) and where that first ends
    longest: list[dict[int, tuple[int, int]]] = field(default_factory=list)
    phrases: list[tuple] = field(default_factory=list)

    def _state(self, length: int, to: dict, link: int, ends: dict) -> int:
        self.length.append(length)
        self.to.append(to)
        self.link.append(link)
        self.ends.append(ends)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.to[q]), self.link[q], {})
        while p >= 0 and self.to[p].get(word) == q:
            self.to[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.to[last].get(word)
        if q is not None:  # known from an earlier template
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        current = self._state(self.length[last] + 1, {}, 0, {})
        p = last
        while p >= 0 and word not in self.to[p]:
            self.to[p][word] = current
            p = self.link[p]
        if p >= 0:
            q = self.to[p][word]
            self.link[current] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return current

    def add(self, template: int, words: list[bytes]) -> int:
        state = 0
        for word in words:
            state = self._extend(state, self.vocabulary.setdefault(word, len(self.vocabulary)))
        return state

    def walk(self, words: list[bytes]) -> int:
        state = 0
        for word in words:
            state = self.to[state][self.vocabulary[word]]
        return state


def build(templates: list[list[bytes]], phrases: list[list[bytes]]) -> Automaton:
    """The automaton of templates and phrases, with the occurrences and phrases of each state."""
    made = Automaton()
    for number, words in enumerate([*templates, *phrases]):
        made.add(number, words)
    for number, words in enumerate(templates):
        state = 0
        for position, word in enumerate(words):
            state = made.to[state][made.vocabulary[word]]
            made.ends[state].setdefault(number, position)
    # a state's matches end wherever longer matches with them as suffix end
    for state in sorted(range(1, len(made.length)), key=made.length.__getitem__, reverse=True):
        shorter = made.ends[made.link[state]]
        for number, position in made.ends[state].items():
            shorter[number] = min(position, shorter.get(number, position))
    made.longest = [{} for _ in made.length]
    for state in sorted(range(1, len(made.length)), key=made.length.__getitem__):
        s = made.link[state]
        shorter = {t: (size or made.length[s], position) for t, (size, position) in made.longest[s].items()}
        made.longest[state] = shorter | {t: (0, position) for t, position in made.ends[state].items()}
    of_state = {made.walk(words): (i, len(words)) for i, words in enumerate(phrases)}
    for state in range(len(made.length)):
        found, s = [], state
        while s > 0:
            if s in of_state:
                found.append(of_state[s])
            s = made.link[s]
        made.phrases.append(tuple(found))
    return made


@dataclass
class Scan:
    """What was found in one text: phrase places (start, phrase) and spans (template, first, last, covered share)."""

    n_words: int
    places: list[tuple[int, int]]
    spans: list[tuple[int, int, int, float]]


def named(words: list[bytes], first: int, last: int, name: list[bytes]) -> bool:
    """Whether the words from ``first`` to ``last`` hold the name, and not as the beginning of a variant's."""
    size = len(name)
    return not size or any(
        words[at : at + size] == name and not VARIANTS.intersection(words[at + size : at + size + 1])
        for at in range(first, last - size + 2)
    )


def chains(matches: list[tuple[int, int, int, bool]], size: int, gap: int) -> Iterator[tuple[float, int, int]]:
    """Share of a template of ``size`` words that each chain covers, and the chain's span in the text.

    Matches are (last word in the text, last word in the template, length, whether the
    template's name is in it), in the order of the text. A match goes on from its
    predecessor if it lies behind it in the template, does not hold all that the chain
    has (it then begins the notice anew) and is at most ``gap`` words further on in the
    text; words that both cover count once. A chain without the name does not count:
    words that are skipped between matches are never those of the name.
    """
    covered = start = text_end = template_start = template_end = 0
    known = False
    for last, at, length, has_name in matches:
        first, begins = last - length + 1, at - length + 1
        if covered and at > template_end and begins > template_start and first - text_end <= gap + 1:
            covered += min(length, at - template_end)
            known |= has_name
        else:
            if known:
                yield covered / size, start, text_end
            covered, start, template_start, known = length, first, begins, has_name
        text_end, template_end = last, at
    if known:
        yield covered / size, start, text_end


def scan(
    text: bytes, automaton: Automaton, sizes: list[int], names: list[list[bytes]], long_match: int = LONG_MATCH, gap: int = LARGEST_GAP
) -> Scan:
    """Stream a text through the automaton."""
    words = words_of(text)
    known = np.fromiter(map(automaton.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
    inside = np.flatnonzero(known >= 0)
    cuts = np.flatnonzero(np.diff(inside) > 1) + 1
    begins = inside[np.append(0, cuts)] if len(inside) else inside
    ends = inside[np.append(cuts - 1, len(inside) - 1)] if len(inside) else inside
    wide = ends > begins  # every phrase has two words or more
    places: list[tuple[int, int]] = []
    matches: dict[int, list[tuple[int, int, int, bool]]] = {}
    to, link, lengths = automaton.to, automaton.link, automaton.length
    for begin, end in zip(begins[wide].tolist(), ends[wide].tolist(), strict=True):
        run = known[begin : end + 1].tolist()
        state = size = 0
        for i, word in enumerate([*run, None]):
            before, before_size = state, size
            while state and word not in to[state]:
                state = link[state]
                size = lengths[state]
            state = to[state].get(word, 0)
            size = size + 1 if state else 0
            for phrase, width in automaton.phrases[state]:
                if size >= width:
                    places.append((begin + i - width + 1, phrase))
            if before_size < long_match:
                continue
            # a template's match is longest where the next word does not prolong it
            for template, (part, position) in automaton.longest[before].items():
                width, last = part or before_size, begin + i - 1
                after = automaton.longest[state].get(template) if state else None
                if width >= long_match and (after is None or (after[0] or size) != width + 1):
                    has_name = named(words, last - width + 1, last, names[template])
                    matches.setdefault(template, []).append((last, position, width, has_name))
    spans = [
        (template, first, last, share)
        for template, found in matches.items()
        for share, first, last in chains(found, sizes[template], gap)
    ]
    return Scan(len(words), places, spans)


def _scan_all(shared, labels: list[str], sizes: list[int], names: list[list[bytes]], phrase_labels: list[str], least: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            data, offsets = raw_bytes(batch.column("text"))
            raw, rows = data.tobytes(), []
            for i in range(batch.num_rows):
                found = scan(raw[offsets[i] : offsets[i + 1]], automaton, sizes, names)
                starts = [start for start, _ in found.places]
                base = {phrase_labels[p] for _, p in found.places}
                met = [span for span in found.spans if span[3] >= least]
                rows.append({
                    "n_words": found.n_words, "n_base": len(starts), "first_word": min(starts, default=None),
                    "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
                    "labels": ",".join(sorted(base | {labels[t] for t, *_ in met})),
                    "score": 1.0 if base else max((share for *_, share in found.spans), default=0.0),
                    "spans": [{"label": labels[t], "first": a, "last": b, "covered": share} for t, a, b, share in met],
                })
            out = pa.RecordBatch.from_pylist(rows, schema=_FOUND)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out.columns], names=["doc_id", *out.schema.names])

    return task


_FOUND = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))),
])


def license_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: list[tuple[str, str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, least: float = COVERED,
) -> DataFrame:
    """Per row: n_words, phrase places, labels, score and the covered template spans.

    A template (label, wording, name) counts if a chain covers ``least`` of its words
    and its name, which no word of VARIANTS may follow; an empty name asks for none.
    ``score`` is 1 where a phrase stands, else the best share so covered of any template.
    ``spans`` lists every such chain, also several of one template. Null and empty
    texts have no words, empty labels, null places and score 0. Repeated rows are
    scanned each for itself; other columns are not read; an empty table gives no
    rows. The text stays where it lies: no shuffle.
    """
    words, names = ([words_of(t[i].encode()) for t in templates] for i in (1, 2))
    automaton = build(words, [words_of(p.encode()) for p in phrases])
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    task = _scan_all(shared, [t[0] for t in templates], [len(w) for w in words], names, list(phrases.values()), least)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        task,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label: string, first: long, last: long, covered: double>>",
    )
