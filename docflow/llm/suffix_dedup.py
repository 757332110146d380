"""Removal of repeated byte strings with per-shard suffix arrays.

1. Every start of a 400-byte string gets a key: the smallest hash of the 32-byte
   grams inside the string. Equal strings have equal keys, and neighbouring starts
   mostly share theirs, so a text falls into segments of starts with one key. A
   segment's context is the text from its first start to the end of its last string.
2. Contexts that occur twice (one key, one 64-bit hash of the content) repeat as a whole. Keys with several different contexts
   go on, one occurrence of each, and so do contexts in which the key's gram stands
   twice; all others are free of repetitions.
3. Contexts are dealt by key and packed into shards. A shard's suffix array is
   refined by the method of Larsson and Sadakane: each round sorts the suffixes that
   are still tied by the rank of what follows and doubles the compared length.
   Common prefixes follow Kasai's rule in its vectorised form: only where the letter
   before differs from the neighbour's are letters compared, elsewhere the value is
   that of the previous suffix less one. A start repeats if it shares 400 bytes with
   a neighbour in the suffix array.
4. A key whose contexts do not fit into a shard never meets in one task. Its strings
   are told apart by where the key's gram stands in them: equal strings have it at the
   same offset. Runs of up to 23 offsets that are equal in everything their strings
   cover repeat as a whole; those that are alone with what all their strings have in
   common are free of repetitions. Of all others one occurrence each is cut into its
   strings, which are counted one by one. Equality is that of 128-bit digests, counted
   in shuffles with partial sums; work and rows grow with the number of starts.
5. The strings found are united per document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.blocks import partitions, raw_bytes, stored, text_or_empty
from docflow.llm.word_hashes import mix

LENGTH = 400
GRAM = 32
PIECE = 1 << 22
MOST_STARTS = 1 << 16
SHARD_BYTES = 4 << 20
OFFSETS = 23
NO_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def start_keys(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of grams, and the key of every start of a string of ``length`` bytes."""
    h, k = _BYTE[data], 1
    while k < gram:  # hash of grams twice as long from two neighbours
        h = h[:-k] * np.uint64(pow(_BASE, k, 1 << 64)) + h[k:]
        k *= 2
    grams = mix(h)
    h, width, k = grams, length - gram + 1, 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return grams, np.minimum(h[: len(h) - (width - k)], h[width - k :])


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, bool]]:
    """(key, first start, number of starts, whether the key's gram stands twice) of each segment of a text.

    Only where the gram stands twice can a string of the segment meet itself.
    """
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        grams, keys = start_keys(data[at : at + PIECE + length - 1], length, gram)
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends = np.append(cuts[1:], len(keys))
        for first, end, key in zip(cuts.tolist(), ends.tolist(), keys[cuts], strict=True):
            twice = bool(np.count_nonzero(grams[first : end + length - gram] == key) > 1)
            for a in range(first, end, MOST_STARTS):
                yield int(key.view(np.int64)), at + a, min(end, a + MOST_STARTS) - a, twice


def _cut(length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist()
            data, offsets = raw_bytes(batch.column("text"))
            raw, found, digests = memoryview(data), [], []
            for i in range(batch.num_rows):
                begin, end = int(offsets[i]), int(offsets[i + 1])
                for key, first, n, twice in segments(data[begin:end], length):
                    found.append((key, ids[i], marks[i], first, n, twice))
                    context = raw[begin + first : begin + first + n + length - 1]
                    digests.append(hashlib.blake2b(context, digest_size=8).digest())
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            content = np.frombuffer(b"".join(digests), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.bool_()), pa.array(content)],
                names=["key", "doc_id", "mark", "first", "n", "twice", "content"],
            )

    return task


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane refinement; all suffixes must differ (a unique symbol at each end)."""
    n = len(symbols)
    wide = np.zeros(n + 3, np.int64)
    wide[:n] = symbols
    key = ((wide[:n] << 16 | wide[1 : n + 1]) << 32) | (wide[2 : n + 2] << 16 | wide[3 : n + 3])
    key = key.view(np.uint64)
    order = np.argsort(key, kind="stable").astype(np.int32)
    tied, h = np.arange(n, dtype=np.int32), 4
    rank = np.empty(n, np.int32)
    first = key[order]
    new = np.append(True, first[1:] != first[:-1])
    del key, first, wide
    while True:
        # a group's rank is the place of its first suffix; groups of one are settled
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(tied)))
        rank[order[tied]] = np.repeat(tied[heads], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        if len(tied) == 0:
            return order
        suffix = order[tied]
        both = rank[suffix].astype(np.int64) * n + rank[suffix + h]
        at = np.argsort(both, kind="stable")
        order[tied] = suffix[at]
        both = both[at]
        new = np.append(True, both[1:] != both[:-1])
        h *= 2


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with its predecessor in the suffix array."""
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (symbols[: n - 1] == symbols[np.maximum(before[1:] - 1, 0)])
    lead = np.flatnonzero(~follows)
    value = np.zeros(len(lead), np.int64)
    open_, size = np.flatnonzero(before[lead] >= 0), 0
    steps = np.arange(16)
    while len(open_):
        a, b = lead[open_] + size, before[lead[open_]] + size
        same = symbols[np.minimum(a[:, None] + steps, n - 1)] == symbols[np.minimum(b[:, None] + steps, n - 1)]
        whole = same.all(axis=1)
        value[open_] = size + np.where(whole, 16, same.argmin(axis=1))
        open_, size = open_[whole], size + 16
    source = np.searchsorted(lead, at, side="right") - 1
    of_text = value[source] - (at - lead[source])
    return of_text[order]


class Shard:
    """Contexts with their suffix array and the starts that repeat inside the shard."""

    def __init__(self, contexts: list[bytes], length: int):
        self.length = length
        sizes = np.array([len(c) + 1 for c in contexts])
        self.begin = np.append(0, np.cumsum(sizes))
        symbols = np.zeros(self.begin[-1], np.int32)
        self.text = b"\0".join(contexts) + b"\0"
        symbols[:] = np.frombuffer(self.text, np.uint8)
        symbols[self.begin[1:] - 1] = 256 + np.arange(len(contexts))
        order = suffix_array(symbols)
        meets = np.append(common_prefixes(symbols, order) >= length, False)
        self.repeats = np.zeros(len(symbols), bool)
        self.repeats[order[meets[:-1] | meets[1:]]] = True
        self.order, left = order, np.repeat(self.begin[1:] - 1, sizes) - np.arange(len(symbols))
        self.starts = left >= length

    def found(self, i: int) -> Iterator[tuple[int, int]]:
        """First and last of each run of repeating starts of context i."""
        marks = np.concatenate(([False], self.repeats[self.begin[i] : self.begin[i + 1]], [False]))
        edges = np.flatnonzero(marks[1:] != marks[:-1]).reshape(-1, 2)
        yield from ((int(a), int(b) - 1) for a, b in edges)


def _match(length: int, shard_bytes: int):
    """Contexts of a partition, sorted by key and content, to runs of repeating starts; contexts of large keys as they are.

    A context comes several times if rows share id and text; it is taken once.
    """

    def settle(pack: list[dict]) -> Iterator[pa.RecordBatch]:
        shard = Shard([r["context"] for r in pack], length)
        out = [
            {"doc_id": r["doc_id"], "mark": r["mark"], "first": r["first"] + a, "last": r["first"] + b}
            for i, r in enumerate(pack)
            for a, b in shard.found(i)
        ]
        yield pa.RecordBatch.from_pylist(out, schema=_MATCHED)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack: list[dict] = []
        used, key, before = 0, None, [None, None]
        for batch in batches:
            names = np.array([before, *zip(*(batch.column(c).to_pylist() for c in ("key", "content")), strict=True)], object)
            batch, before = batch.filter(pa.array((names[1:] != names[:-1]).any(axis=1))), names[-1].tolist()
            large = batch.filter(batch.column("large"))
            if large.num_rows:
                last = pc.subtract(pc.add(large.column("first"), large.column("n")), 1)
                columns = [large.column("doc_id"), large.column("mark"), large.column("first"), last]
                yield pa.RecordBatch.from_arrays([*columns, large.column("key"), large.column("context")], schema=_MATCHED)
            for r in batch.filter(pc.invert(batch.column("large"))).to_pylist():
                if r["key"] != key:
                    if used >= shard_bytes // 2:
                        yield from settle(pack)
                        pack, used = [], 0
                    key = r["key"]
                pack.append(r)
                used += len(r["context"])
        if pack:
            yield from settle(pack)

    return task


_RUNS = [("doc_id", pa.int64()), ("mark", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]
_MATCHED = pa.schema([*_RUNS, ("key", pa.int64()), ("context", pa.binary())])
_PIECES = pa.schema([*_RUNS, ("context_first", pa.int64()), ("core", pa.binary()), ("hull", pa.binary())])
_STRINGS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("first", pa.int64()), ("string", pa.binary())])


def _digest(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()


def pieces(context: bytes, key: int, n: int, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(first start, last start, core, hull) of the pieces of a context with ``n`` starts.

    A start belongs to the first place of the key's gram at or behind it; the starts of
    a piece have neighbouring offsets to one such place. The hull is all that their
    strings cover. The core is what all strings with the piece's offsets have in common,
    also with those offsets that the context lacks.
    """
    grams, _ = start_keys(np.frombuffer(context, np.uint8), length, gram)
    behind = 0
    for place in np.flatnonzero(grams.view(np.int64) == key).tolist():
        last = min(place, n - 1)
        while last >= behind:
            nearest = (place - last) // OFFSETS * OFFSETS
            farthest = min(nearest + OFFSETS - 1, length - gram)
            first = max(behind, place - farthest)
            core = context[place - nearest : place - farthest + length]
            yield first, last, _digest(core), _digest(context[first : last + length])
            last = first - 1
        behind = place + 1


def _pieces(length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"doc_id": r["doc_id"], "mark": r["mark"], "first": r["first"] + a, "last": r["first"] + b,
                 "context_first": r["first"], "core": core, "hull": hull}
                for r in batch.to_pylist()
                for a, b, core, hull in pieces(r["context"], r["key"], r["last"] - r["first"] + 1, length)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_PIECES)

    return task


def _strings(length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"doc_id": r["doc_id"], "mark": r["mark"], "first": r["context_first"] + at, "string": _digest(r["context"][at : at + length])}
                for r in batch.to_pylist()
                for run in r["open"]
                for at in range(run["first"] - r["context_first"], run["last"] - r["context_first"] + 1)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_STRINGS)

    return task


def _runs_of_large_keys(large: DataFrame, length: int) -> DataFrame:
    """Runs of repeating starts of contexts (doc_id, mark, first, last, key, context) that are no shard's."""
    context = ["doc_id", "mark", "context_first"]
    cut = stored(large.mapInArrow(
        _pieces(length), "doc_id long, mark long, first long, last long, context_first long, core binary, hull binary"
    ), "pieces")
    hulls = stored(cut.groupBy("hull").agg(
        F.count("*").alias("copies"), F.min(F.struct(*context, "first", "last")).alias("one"), F.first("core").alias("core")
    ), "hulls")
    whole = cut.join(hulls.where("copies > 1").select("hull"), "hull", "left_semi")
    shared = hulls.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core")
    asked = hulls.join(shared, "core", "left_semi").select("one.*").groupBy(context).agg(
        F.collect_list(F.struct("first", "last")).alias("open")
    )
    text = large.select("doc_id", "mark", F.col("first").alias("context_first"), "context")
    strings = stored(text.join(asked, context).mapInArrow(
        _strings(length), "doc_id long, mark long, first long, string binary"
    ), "strings")
    several = strings.groupBy("string").agg(F.count("*").alias("copies")).where("copies > 1").select("string")
    single = strings.join(several, "string", "left_semi").select("doc_id", "mark", "first", F.col("first").alias("last"))
    return whole.select("doc_id", "mark", "first", "last").unionAll(single)


def cut_runs(text: bytes, runs: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """The text without the strings that start in the runs: rest, bytes removed, spans removed."""
    kept, done, removed, spans = [], 0, 0, 0
    for first, last in sorted(runs):
        end = last + length
        if first > done or spans == 0:
            kept.append(text[done:first])
            spans += 1
            removed += end - first
        elif end > done:
            removed += end - done
        done = max(done, end)
    kept.append(text[done:])
    return b"".join(kept), removed, spans


def _remove(length: int, with_text: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
                rest, removed, spans = cut_runs(text, [(r["first"], r["last"]) for r in runs or ()], length)
                rows.append((len(text), removed, spans, hashlib.sha256(rest).hexdigest(), rest))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, _REST, strict=True)]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
            keep = 5 if with_text else 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays[:keep]], names=["doc_id", *names[:keep]])

    return task


_REST = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())


def repeated_runs(rows: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, mark, first, last): runs of starts whose strings stand anywhere else."""
    parts = partitions(rows)
    cut = stored(rows.mapInArrow(
        _cut(length), "key long, doc_id long, mark long, first long, n long, twice boolean, content long"
    ), "segments")
    content = ["key", "content"]
    contexts = stored(
        cut.groupBy(content).agg(F.count("*").alias("copies"), F.max("twice").alias("twice"), F.min(F.struct("doc_id", "mark", "first", "n")).alias("one")),
        "contexts",
    )
    copied = contexts.where("copies > 1").select(content)
    whole = cut.join(copied, content, "left_semi").select("doc_id", "mark", "first", (F.col("first") + F.col("n") - 1).alias("last"))
    alone = contexts.groupBy("key").agg(
        F.count("*").alias("kinds"), F.max(F.col("twice") & (F.col("copies") == 1)).alias("twice"),
        (F.sum(F.col("one.n") + (length - 1)) > shard_bytes // 2).alias("large"),
    )
    several = alone.where("kinds > 1 or twice").select("key", "large")
    asked = contexts.join(several, "key").select(*content, "large", "one.doc_id", "one.mark", "one.first", "one.n")
    text = rows.select("doc_id", "mark", F.col("text").cast("binary").alias("text"))
    with_text = asked.join(text, ["doc_id", "mark"]).select(
        *content, "doc_id", "mark", "first", "n", "large", F.when(F.col("large"), F.col("content")).otherwise(0).alias("salt"),
        F.expr(f"substring(text, cast(first + 1 as int), cast(n + {length - 1} as int))").alias("context"),
    )
    dealt = with_text.repartition(parts, "key", "salt").sortWithinPartitions(*content).drop("salt")
    matched = stored(
        dealt.mapInArrow(_match(length, shard_bytes), "doc_id long, mark long, first long, last long, key long, context binary"),
        "matched",
    )
    runs = whole.unionAll(matched.where("context is null").select("doc_id", "mark", "first", "last"))
    large = matched.where("context is not null")
    if not large.isEmpty():
        runs = runs.unionAll(_runs_of_large_keys(large, length))
    return stored(runs, "runs")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    shard_bytes: int = SHARD_BYTES, with_text: bool = False,
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept_bytes on request.

    Every byte that lies in a string of ``length`` bytes standing anywhere else goes,
    in the first occurrence too. Null text counts as empty; texts under ``length``
    bytes lose nothing. Rows that repeat a text, with or without their id, repeat
    each other's strings. Other columns are not read. An empty table gives no rows.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    runs = repeated_runs(rows, length, shard_bytes).groupBy("doc_id", "mark").agg(
        F.collect_list(F.struct("first", "last")).alias("runs")
    )
    names = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    out = rows.join(runs, ["doc_id", "mark"], "left").select("doc_id", "text", "runs").mapInArrow(_remove(length, with_text), names)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
