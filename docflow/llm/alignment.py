"""Alignment of two tokenizers over a corpus, with counts of the id pairs that meet.

Byte ranges of tokens of A and B that overlap are links; the offsets where tokens of
both end cut a text into groups. Pairs of ids are counted over the whole corpus:

1. Both tokenizers encode every text once; the ids are stored. A first pass aligns all
   documents and writes the pairs of each task with their links.
2. The distinct pairs are dealt to shards by hash, and each shard gets a minimal perfect
   hash: cascading bit arrays in which a key owns a bit nobody else hits; its number is
   the rank of that bit. The keys are kept in that order, so a lookup is verified.
3. Tasks add their pairs up in dense vectors indexed by that hash, and the vectors are
   summed up a tree.
4. A second pass aligns all documents again and looks the counts up.

The table of step 2 is broadcast and holds at most ``most`` pairs, those with most links.
Pairs beyond it are counted and joined by key; each of them has fewer links than any in
the table, so no key of that join is hot. The number of counts per B id is bounded by
its vocabulary.

Neither tokenizer lets a token reach over a single blank between two printable ASCII
characters: A starts a new piece at the blank, and B has no token with a blank after
another character (checked when the file is read). Long texts are cut there, so memory
depends on the length of a stretch. Many short texts are aligned in one numpy step.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.blocks import partitions, runs_of_rows, stored, text_or_empty
from docflow.llm.bpe import _ship_file, byte_symbols
from docflow.llm.word_hashes import mix

CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
BLANK = "▁"
# The pieces that the byte-level file splits a text into: a fixed value of that format.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STRETCH = 1 << 19
ALIGNED_TOKENS = 1 << 18
ROWS_AT_ONCE = 256
PAIRS_AT_ONCE = 1 << 18
SHARD_BITS = 16
MOST_PAIRS = 1 << 21
FAN_IN = 8
SLICE = 1 << 16
A_SHIFT = 32
B_MASK = (1 << A_SHIFT) - 1


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        with open(a_path, encoding="utf-8") as f:
            file = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        vocabulary = {t: i for t, i in file["model"]["vocab"].items() if all(c in byte_of for c in t)}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token)
        self.a = self._ranked(file, vocabulary) or self._library(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.cuts = file.get("normalizer") is None and not any(BLANK in p.lstrip(BLANK) for p in pieces)

    def _ranked(self, file: dict, vocabulary: dict[str, int]):
        """The same byte pairs by rank, if the file's ids are its merge order; several times as fast."""
        import tiktoken

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        base = len(byte_symbols())
        special = {t["id"] for t in file["added_tokens"]}
        plain = file.get("normalizer") is None and file["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
        }
        if not plain or any(vocabulary.get(x + y) != base + i for i, (x, y) in enumerate(merges)):
            return None
        ranks = {self.a_bytes[i]: i for i in vocabulary.values() if i not in special}
        encoding = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [np.array(encoding.encode_ordinary(t), "<u4") for t in texts]

    @staticmethod
    def _library(path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = True
        return lambda texts: [np.array(e.ids, "<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both tokenizers for blank + text."""
        return self.a([" " + t for t in texts]), [np.array(i, "<u4") for i in self.b.encode(texts, num_threads=1)]

    def joined(self, a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes]:
        return b"".join(map(self.a_bytes.__getitem__, a.tolist())), b"".join(map(self.b_bytes.__getitem__, b.tolist()))


def stretches(text: str) -> list[str]:
    """The text cut at blanks no token reaches over, about STRETCH characters each; a cut takes its blank away."""
    out, start = [], 0
    while len(text) - start > STRETCH and (cut := CUT.search(text, start + STRETCH - 1)):
        out.append(text[start : cut.start()])
        start = cut.end()
    return [*out, text[start:]]


def tokens_of(pair: Pair, texts: list[str]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Ids of both sides for each stretch of each text; none for texts that the bytes do not give back."""
    short = [t for t in texts if t and (len(t) <= STRETCH or not pair.cuts)]
    known = dict(zip(short, zip(*pair.encode(short), strict=True), strict=True)) if short else {}
    for text in texts:
        if not text:
            yield []
        elif text in known:
            yield _exact(pair, [text], [known[text]])
        else:
            parts = stretches(text)
            held = _exact(pair, parts, [tuple(x[0] for x in pair.encode([p])) for p in parts])
            # a stretch that differs can be made good by another only if the whole text is given back
            yield held or _exact(pair, [text], [tuple(x[0] for x in pair.encode([text]))])


def _exact(pair: Pair, parts: list[str], ids: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    same = all(set(pair.joined(a, b)) == {(" " + p).encode()} for p, (a, b) in zip(parts, ids, strict=True))
    return ids if same else []


_TOKENS = "row long, doc_id long, a array<binary>, b array<binary>"
_PAIR: dict[tuple[str, str], Pair] = {}


def _pair(names: tuple[str, str]) -> Pair:
    key = (SparkFiles.get(names[0]), SparkFiles.get(names[1]))
    if key not in _PAIR:
        _PAIR[key] = Pair(*key)
    return _PAIR[key]


def _kind(ids: int) -> str:
    """The stored form of ids below ``ids``."""
    return "<u2" if ids <= 1 << 16 else "<u4"


def _encode(names: tuple[str, str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, row = _pair(names), TaskContext.get().partitionId() << 33
        for batch in batches:
            lengths = np.concatenate([[0], np.cumsum(pa.compute.binary_length(batch["text"]).to_numpy())])
            for first, last in runs_of_rows(lengths, 4 * STRETCH):
                found = list(tokens_of(pair, batch["text"].slice(first, last - first).to_pylist()))
                sides = [
                    pa.array([[p[s].astype(kind).tobytes() for p in parts] for parts in found], pa.list_(pa.binary()))
                    for s, kind in ((0, _kind(len(pair.a_bytes))), (1, _kind(len(pair.b_bytes))))
                ]
                rows = pa.array(range(row, row + len(found)), pa.int64())
                row += len(found)
                yield pa.RecordBatch.from_arrays([rows, batch["doc_id"].slice(first, last - first), *sides], names=["row", "doc_id", "a", "b"])

    return task


class Stretch:
    """The alignment of the tokens of some texts, one after the other.

    ``a`` and ``b`` are their ids, ``edges`` the number of bytes before each text. Both
    sides have the same bytes, so ends of tokens can be compared over all texts at once.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, n_a: np.ndarray):
        self.a, self.b = a, b
        self.a_ends, self.b_ends = np.cumsum(a_size[a]), np.cumsum(b_size[b])
        self.edges = np.concatenate([[0], self.a_ends])[np.concatenate([[0], np.cumsum(n_a)])]
        # Between two neighbouring ends, of either side, there is one token of each, and two
        # tokens overlap in one such stretch only: that is their link.
        ends = np.zeros(int(self.edges[-1]) + 1, np.int8)
        ends[self.a_ends] = 1
        ends[self.b_ends] += 2
        self.ends, self.common = np.flatnonzero(ends), np.flatnonzero(ends == 3)
        self.keys = (a[np.searchsorted(self.a_ends, self.ends)] << A_SHIFT) | b[np.searchsorted(self.b_ends, self.ends)]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per link over each text."""
        before = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return np.diff(before[np.searchsorted(self.ends, self.edges, side="right")])

    def counts(self, ends: np.ndarray) -> np.ndarray:
        """How many of some ends lie in each text."""
        return np.diff(np.searchsorted(ends, self.edges, side="right"))

    def groups(self) -> list[memoryview]:
        """``a1,a2|b1;a3|b2,b3`` of each text: ids of both sides group by group, as bytes."""
        n_a, n_b = len(self.a), len(self.b)
        in_a, in_b = np.searchsorted(self.common, self.a_ends), np.searchsorted(self.common, self.b_ends)
        whole = np.arange(len(self.common) + 1)
        before_a, before_b = np.searchsorted(in_a, whole), np.searchsorted(in_b, whole)
        at_a, at_b = np.arange(n_a) + before_b[in_a], np.arange(n_b) + before_a[in_b + 1]
        ids, sign = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        sign[at_a[before_a[:-1]]], sign[at_b[before_b[:-1]]] = ord(";"), ord("|")
        tokens = self.counts(self.a_ends) + self.counts(self.b_ends)
        begins = np.concatenate([[0], np.cumsum(tokens)])
        sign[begins[:-1][tokens > 0]] = 0  # a text starts without a sign
        digits = _digits(1 << max(16, int(ids.max(initial=0)).bit_length()))
        width = digits.shape[1]
        shown, used = np.empty((len(ids), width + 1), np.uint8), np.ones((len(ids), width + 1), bool)
        shown[:, 0], shown[:, 1:] = sign, digits[ids]
        used[:, 0], used[:, 1:] = sign > 0, shown[:, 1:] > 0
        size = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[begins]
        data = memoryview(shown[used].tobytes())
        return [data[s:e] for s, e in zip(size[:-1], size[1:], strict=True)]


@lru_cache(maxsize=2)
def _digits(most: int) -> np.ndarray:
    """Decimal digits of 0 to most - 1, left-aligned, 0 where there is none."""
    out = np.zeros((most, len(str(most - 1))), np.uint8)
    for i in range(most):
        text = str(i).encode()
        out[i, : len(text)] = np.frombuffer(text, np.uint8)
    return out


def _sizes(names: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    pair = _pair(names)
    return tuple(np.array([len(t) for t in side], np.int64) for side in (pair.a_bytes, pair.b_bytes))


Side = list[list[bytes]]  # of each text the ids of its stretches


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[tuple[Side, Side]]]]:
    """Ranges of rows with what to align: many texts of one stretch together, others stretch by stretch."""
    for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(begin, ROWS_AT_ONCE)
        a, b = part["a"].to_pylist(), part["b"].to_pylist()
        size = [sum(map(len, x)) // 2 for x in a]
        first = 0
        while first < len(a):
            last, held = first + 1, size[first]
            while last < len(a) and len(a[first]) < 2 and len(a[last]) < 2 and held + size[last] <= ALIGNED_TOKENS:
                held, last = held + size[last], last + 1
            together = [(a[first:last], b[first:last])]
            apart = [([[x]], [[y]]) for x, y in zip(a[first], b[first], strict=True)]
            yield begin + first, begin + last, together if len(a[first]) < 2 else apart
            first = last


def _stretch(sides: tuple[Side, Side], sizes: tuple[np.ndarray, np.ndarray]) -> Stretch:
    kinds = [np.dtype(_kind(len(n))) for n in sizes]
    ids = [np.frombuffer(b"".join(x for parts in side for x in parts), k).astype(np.int64) for side, k in zip(sides, kinds, strict=True)]
    n_a = [sum(map(len, parts)) // kinds[0].itemsize for parts in sides[0]]
    return Stretch(*ids, *sizes, np.array(n_a, np.int64))


class KeyCounts:
    """Sums per key, in sorted arrays."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, links: np.ndarray) -> None:
        self.held.append((keys, links))
        self.size += len(keys)
        if self.size > 2 * PAIRS_AT_ONCE:
            self._reduce()

    def _reduce(self) -> None:
        keys, at = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, np.concatenate([n for _, n in self.held]))
        self.held, self.size = [(keys, sums)], len(keys)

    def take(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """All sums as a batch, if there are more than ``least``."""
        if self.size > least:
            self._reduce()
            if self.size > least:
                (keys, links), self.held, self.size = self.held[0], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(links)], names=["key", "links"])


def _count(names: tuple[str, str]):
    """First pass: the pairs of a task with their links."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, counts = _sizes(names), KeyCounts()
        for batch in batches:
            for _, _, pieces in _runs(batch):
                for sides in pieces:
                    counts.add(*np.unique(_stretch(sides, sizes).keys, return_counts=True))
            yield from counts.take(PAIRS_AT_ONCE)
        yield from counts.take()

    return task


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys by cascading bit arrays.

    On each level the keys that are left hash to twice as many bits; a key that is
    alone on its bit owns it, the others go on to the next level. The hash of a key
    is the rank of its bit among all bits that are owned.
    """

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mix(keys.astype(np.uint64) ^ salt) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], keys
        while len(left):
            bits = -(-2 * len(left) // 64) * 64
            at = cls._place(left, len(sizes), bits)
            alone = np.bincount(at, minlength=bits) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(bits)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(words) if words else np.empty(0, np.uint64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; for keys that are not in the set any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, start = np.arange(len(keys)), 0
        for level, bits in enumerate(self.sizes):
            at = start + self._place(keys[left], level, bits)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            value = self.words[word]
            owned = (value >> bit) & np.uint64(1) == 1
            below = value & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[owned]] = (self.ranks[word] + np.bitwise_count(below))[owned]
            left, start = left[~owned], start + bits
        return out


class PairTable:
    """Perfect hashes of all shards, with the keys in their order and, once summed, a count of each."""

    def __init__(self, bits: int, shards: dict[int, tuple[list[int], bytes, bytes]]):
        self.bits = bits
        self.hashes: dict[int, PerfectHash] = {}
        self.start = np.zeros((1 << bits) + 1, np.int64)
        keys = [np.empty(0, np.int64)]
        for shard, (sizes, words, held) in sorted(shards.items()):
            self.hashes[shard] = PerfectHash(list(sizes), np.frombuffer(words, "<u8"))
            keys.append(np.frombuffer(held, "<i8"))
            self.start[shard + 1] = len(keys[-1])
        self.start = np.cumsum(self.start)
        self.keys = np.concatenate(keys)
        self.counts = np.zeros(len(self.keys), np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, verified against the stored key; -1 if it is not in the table."""
        out = np.full(len(keys), -1, np.int64)
        shards = shard_of(keys, self.bits)
        order = np.argsort(shards, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1) if len(order) else ():
            shard = int(shards[rows[0]])
            if shard in self.hashes:
                at = self.hashes[shard].find(keys[rows])
                out[rows] = np.where(at >= 0, at + self.start[shard], -1)
        known = np.flatnonzero(out >= 0)
        out[known[self.keys[out[known]] != keys[known]]] = -1
        return out


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    # hashes inside a shard take other salts, so that they do not depend on the shard
    return (mix(keys.astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _deal(bits: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(keys, bits), pa.int64()), batch.column("key")], names=["shard", "key"])

    return task


_SHARD = pa.schema([("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("keys", pa.binary())])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The perfect hash of each shard of a task, and the keys in its order."""
    held = [(b.column("shard").to_numpy(zero_copy_only=False), b.column("key").to_numpy(zero_copy_only=False)) for b in batches]
    if not held:
        return
    shards, keys = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(shards, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1):
        own = np.sort(keys[rows])
        made = PerfectHash.of(own)
        placed = np.empty_like(own)
        placed[made.find(own)] = own
        yield pa.RecordBatch.from_pylist(
            [{"shard": int(shards[rows[0]]), "sizes": made.sizes, "words": made.words.astype("<u8").tobytes(), "keys": placed.astype("<i8").tobytes()}],
            _SHARD,
        )


def _frequent(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Counts of all pairs, with a flag ``listed`` on the at most ``most`` with most links."""
    counted = stored(
        pairs.groupBy("key").agg(F.sum("links").alias("links")).withColumn("grade", F.floor(8 * F.log2("links")).cast("int")),
        "pair-counts",
    )
    room, least = most, None
    for r in sorted(counted.groupBy("grade").count().collect(), key=lambda r: -r["grade"]):  # at most 8 x 63 grades
        if r["count"] > room:
            break
        room, least = room - r["count"], r["grade"]
    listed = F.lit(False) if least is None else F.col("grade") >= least
    return counted.where(listed).select("key"), counted.where(~listed).select("key", "links")


def build_table(keys: DataFrame, n: int) -> PairTable:
    """Perfect hash of ``n`` distinct keys; the driver gets 9 bytes a key."""
    bits = (n >> SHARD_BITS).bit_length()
    dealt = keys.select("key").mapInArrow(_deal(bits), "shard long, key long").repartition(min(partitions(keys), 1 << bits), "shard")
    rows = dealt.mapInArrow(_build, "shard long, sizes array<long>, words binary, keys binary").collect()
    return PairTable(bits, {r["shard"]: (r["sizes"], bytes(r["words"]), bytes(r["keys"])) for r in rows})


def _dense(table: Broadcast):
    """The pairs of a task added up in one vector over the perfect hash, cut into slices."""
    schema = pa.schema([("slice", pa.int64()), ("part", pa.int64()), ("counts", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = table.value
        vector = np.zeros(len(held.keys), np.int64)
        for batch in batches:
            at = held.find(batch.column("key").to_numpy(zero_copy_only=False))
            links = batch.column("links").to_numpy(zero_copy_only=False)
            np.add.at(vector, at[at >= 0], links[at >= 0])
        part = TaskContext.get().partitionId()
        for number, start in enumerate(range(0, len(vector), SLICE)):
            piece = vector[start : start + SLICE]
            if piece.any():
                yield pa.RecordBatch.from_pylist([{"slice": number, "part": part, "counts": piece.astype("<i8").tobytes()}], schema)

    return task


def _added(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, "<i8") for c in rows.column("counts").to_pylist())
    first = rows.slice(0, 1)
    return first.select(["slice", "part"]).append_column("counts", pa.array([total.astype("<i8").tobytes()], pa.binary()))


def sum_counts(pairs: DataFrame, table: PairTable) -> None:
    """Fill ``table.counts``: one dense vector per task, summed FAN_IN at a time until one is left."""
    width = partitions(pairs)
    spread = pairs.select("key", "links").coalesce(width)
    sent = pairs.sparkSession.sparkContext.broadcast(table)
    vectors = spread.mapInArrow(_dense(sent), "slice long, part long, counts binary")
    while width > 1:
        up = vectors.withColumn("part", F.floor(F.col("part") / FAN_IN))
        vectors = up.groupBy("slice", "part").applyInArrow(_added, "slice long, part long, counts binary")
        width = -(-width // FAN_IN)
    for r in vectors.collect():
        piece = np.frombuffer(bytes(r["counts"]), "<i8")
        table.counts[r["slice"] * SLICE : r["slice"] * SLICE + len(piece)] += piece


_OUT = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()),
    ("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
])


def _lost(s: Stretch, missed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the keys that are not in the table, and how often."""
    bounds = np.searchsorted(np.flatnonzero(missed), np.searchsorted(s.ends, s.edges, side="right"))
    keys = s.keys[missed]
    return [np.unique(keys[x:y], return_counts=True) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def _align(names: tuple[str, str], sent: Broadcast):
    """Second pass: the sums of each text over the counts of its links."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _sizes(names)
        table, highest = sent.value
        for batch in batches:
            sums = np.zeros((6, batch.num_rows), np.int64)
            shas, missing = [""] * batch.num_rows, [([], [])] * batch.num_rows
            for first, last, pieces in _runs(batch):
                digest, missed = None, KeyCounts()
                for sides in pieces:
                    s = _stretch(sides, sizes)
                    keys, place = np.unique(s.keys, return_inverse=True)
                    at = table.find(keys)
                    counts = np.zeros(len(keys), np.int64)
                    counts[at >= 0] = table.counts[at[at >= 0]]
                    best = (at >= 0) & (counts == highest[keys & B_MASK])
                    one = np.ones(len(s.ends), np.int64)
                    sums[:, first:last] += [
                        s.counts(s.a_ends), s.counts(s.b_ends), s.counts(s.common), s.per_text(one), s.per_text(best[place]),
                        s.per_text(counts[place]),
                    ]
                    lost = _lost(s, at[place] < 0)
                    if len(pieces) == 1:
                        shas[first:last] = [hashlib.sha256(g).hexdigest() if len(g) else "" for g in s.groups()]
                        missing[first:last] = [(k.tolist(), n.tolist()) for k, n in lost]
                        continue
                    if digest is None:
                        digest = hashlib.sha256()
                    else:
                        digest.update(b";")
                    digest.update(s.groups()[0])
                    missed.add(*lost[0])
                if digest is not None:
                    shas[first] = digest.hexdigest()
                    for found in missed.take():
                        missing[first] = (found["key"].to_pylist(), found["links"].to_pylist())
            columns = [batch["row"], batch["doc_id"], *map(pa.array, sums), shas, *zip(*missing, strict=True)] if batch.num_rows else []
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    return task


def vocabulary_size(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
_ROWS = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, "
    "keys array<long>, times array<long>"
)


def token_table(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored ids of both sides: row, doc_id, and per stretch of the text the ids as 16-bit numbers, or 32-bit ones beyond 65,536."""
    names = (_ship_file(docs, a_path), _ship_file(docs, b_path))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return stored(own.mapInArrow(_encode(names), _TOKENS), "tokens")


def align_tokens(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_PAIRS
) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null, empty or not given back by the bytes of the tokens have
    zeros and an empty digest; they count nowhere. Repeated rows count each for
    itself. Other columns are not read. An empty table gives no rows.
    """
    spark, names = docs.sparkSession, (_ship_file(docs, a_path), _ship_file(docs, b_path))
    tokens = token_table(docs, a_path, b_path, id_col, text_col)
    pairs = stored(tokens.select("a", "b").mapInArrow(_count(names), "key long, links long"), "pairs")
    keys = stored(pairs.select("key").distinct(), "pair-keys")
    n, cold = keys.count(), None
    if n > most:
        keys, cold = _frequent(pairs, most)
        n = most
    table = build_table(keys, n)
    sum_counts(pairs, table)
    highest = np.zeros(vocabulary_size(b_path), np.int64)
    np.maximum.at(highest, table.keys & B_MASK, table.counts)
    if cold is not None:
        tops = cold.groupBy(F.col("key").bitwiseAND(B_MASK).alias("b")).agg(F.max("links").alias("top")).collect()  # one per B id
        np.maximum.at(highest, [r["b"] for r in tops], [r["top"] for r in tops])
    sent = spark.sparkContext.broadcast((table, highest))
    rows = tokens.mapInArrow(_align(names, sent), _ROWS)
    if cold is None:
        return rows.select(*COLUMNS)
    rows = stored(rows, "aligned")
    best = F.broadcast(spark.createDataFrame(list(enumerate(highest.tolist())), "b long, highest long"))
    lost = rows.select("row", F.inline(F.arrays_zip("keys", "times"))).toDF("row", "key", "times")
    met = lost.join(cold, "key").join(best, F.col("key").bitwiseAND(B_MASK) == F.col("b"))
    more = met.groupBy("row").agg(
        F.sum(F.col("times") * F.col("links")).alias("more_sum"),
        F.sum(F.when(F.col("links") == F.col("highest"), F.col("times")).otherwise(0)).alias("more_best"),
    )
    added = {"n_best": "more_best", "count_sum": "more_sum"}
    return rows.join(more, "row", "left").select(
        *((F.col(c) + F.coalesce(added[c], F.lit(0))).alias(c) if c in added else F.col(c) for c in COLUMNS)
    )
