"""Merkle manifest of a dataset by time-forward processing.

Nodes are labelled by level and place, so a label order is an order in time: children
come before their parents. Going forward, an external priority queue ordered by label
carries each node's digest to its parent; going backward, it carries to each child the
part of its proof that lies above it. Labels are cut into aligned blocks of 2^14 leaves:
a block is a whole subtree, its task needs nothing but its leaves going forward and one
proof suffix going backward, and the tops of all blocks are the leaves of the next
round. Each round divides the nodes by 2^14, so a corpus of any size takes a few.

Texts are hashed where they lie; what is shuffled is a few digests per document. The
places of leaves come from range partitions and one count per partition and language.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.blocks import partitions, stored

BLOCK_LEVELS = 14
QUEUE_ITEMS = 1 << 13
TAMPER_EVERY = 7
_HEAD = struct.Struct("<qi")
# How a level of a proof is folded: the sibling stands left, right, or there is none.
LEFT, RIGHT, ALONE = b"<", b">", b"="


def digest_of(parts: Iterable[bytes]) -> bytes:
    """Lowercase hex of the SHA-256 of hex digests, joined."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class ExternalQueue:
    """Priority queue of (label, payload) that holds at most ``limit`` messages in memory.

    What is beyond goes to sorted runs in one unnamed temporary file and is merged
    with the heap on the way out. Equal labels leave in any order.
    """

    def __init__(self, limit: int = QUEUE_ITEMS):
        self.limit = limit
        self.heap: list[tuple[int, bytes]] = []
        self.heads: list[tuple[int, bytes, int]] = []  # next message of each run, and the run
        self.ends: list[list[int]] = []
        self.file = None

    def __len__(self) -> int:
        return len(self.heap) + len(self.heads)

    def push(self, label: int, payload: bytes) -> None:
        heapq.heappush(self.heap, (label, payload))
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.heap.sort()
        start = self.file.seek(0, 2)
        self.file.writelines(_HEAD.pack(label, len(payload)) + payload for label, payload in self.heap)
        self.ends.append([start, self.file.tell()])
        self.heap = []
        self._advance(len(self.ends) - 1)

    def _advance(self, run: int) -> None:
        at, end = self.ends[run]
        if at < end:
            self.file.seek(at)
            label, size = _HEAD.unpack(self.file.read(_HEAD.size))
            heapq.heappush(self.heads, (label, self.file.read(size), run))
            self.ends[run][0] = at + _HEAD.size + size

    def first(self) -> int | None:
        """The smallest label in the queue."""
        labels = [q[0][0] for q in (self.heap, self.heads) if q]
        return min(labels) if labels else None

    def pop(self) -> tuple[int, bytes]:
        if not self.heads or (self.heap and self.heap[0][0] <= self.heads[0][0]):
            return heapq.heappop(self.heap)
        label, payload, run = heapq.heappop(self.heads)
        self._advance(run)
        return label, payload

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def levels_of(nodes: int) -> int:
    """Levels above the leaves of a tree."""
    return (nodes - 1).bit_length()


def forward(leaves: list[bytes], levels: int, limit: int = QUEUE_ITEMS) -> list[list[bytes]]:
    """Digests of all nodes level by level, in the order in which the queue releases them.

    Labels are level * 2^32 + 2 * place of the parent + side, so both children of a
    node are next to each other, left one first, and a level is done before the next.
    """
    log: list[list[bytes]] = [[] for _ in range(levels + 1)]
    log[0] = leaves
    if not levels:
        return log
    queue = ExternalQueue(limit)
    for place, digest in enumerate(leaves):
        queue.push((1 << 32) + place, digest)
    while len(queue):
        label, digest = queue.pop()
        level, place = label >> 32, (label & 0xFFFFFFFF) >> 1
        children = [digest]
        while (after := queue.first()) is not None and after >> 1 == label >> 1:
            children.append(queue.pop()[1])
        node = digest_of(children)
        log[level].append(node)
        if level < levels:
            queue.push(((level + 1) << 32) + place, node)
    queue.close()
    return log


def backward(log: list[list[bytes]], limit: int = QUEUE_ITEMS) -> Iterator[bytes]:
    """The proof of each leaf inside the tree of ``log``, in leaf order, lowest level first.

    Labels are negative, so that the top comes first and children after their parent.
    """
    levels = len(log) - 1
    if not levels:
        yield from (b"" for _ in log[0])
        return
    queue = ExternalQueue(limit)
    queue.push(-(levels << 32), b"")
    proofs = ExternalQueue(limit)
    while len(queue):
        label, above = queue.pop()
        level, place = -label >> 32, -label & 0xFFFFFFFF
        below = log[level - 1]
        left, right = 2 * place, 2 * place + 1
        if right < len(below):
            parts = [(left, RIGHT + below[right]), (right, LEFT + below[left])]
        else:
            parts = [(left, ALONE)]
        for child, part in parts:
            if level == 1:
                proofs.push(child, part + above)
            else:
                queue.push(-(((level - 1) << 32) + child), part + above)
    while len(proofs):
        yield proofs.pop()[1]
    queue.close()
    proofs.close()


def siblings(proof: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(side, digest) of each level of a proof; the digest is empty where there is no sibling."""
    at = 0
    while at < len(proof):
        side = proof[at : at + 1]
        end = at + (1 if side == ALONE else 65)
        yield side, proof[at + 1 : end]
        at = end


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    for side, other in siblings(proof):
        leaf = digest_of((other, leaf) if side == LEFT else (leaf, other))
    return leaf


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(
    docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id", group_col: str = "lang", counted: str = "n_chars",
) -> DataFrame:
    """Per row: group, id, the leaf's digest, and the one of a copy whose ``counted`` is one more.

    The copy is there where 7 divides the CRC-32 of the id and ``counted`` is not null.
    """
    def leaf(changed: bool) -> Column:
        more = F.col(counted).cast("decimal(20,0)") + 1
        return F.unhex(F.sha2(F.concat(*(_field(more if changed and c == counted else F.col(c)) for c in columns)), 256))

    chosen = (F.crc32(F.col(id_col).cast("string")) % TAMPER_EVERY == 0) & F.col(counted).isNotNull()
    group = F.col(group_col).cast("string")
    return docs.select(
        # null before every language, also before the empty one
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("g"),
        F.col(id_col).cast("long").alias("id"), leaf(False).alias("digest"), F.when(chosen, leaf(True)).alias("other"),
    )


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their place inside their group ``g`` (``idx``) and the group's size (``n``).

    Rows lie in range partitions of the whole order, so a group may span many of them.
    Partition and place are written out before they are counted, so a lost executor
    cannot change them. The counts have a row per partition and group.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    laid = stored(
        rows.repartitionByRange(partitions(rows), "g", *order).sortWithinPartitions("g", *order).select(
            "*", F.spark_partition_id().alias("part"), place.alias("at")
        ),
        "ranked",
    )
    counts = laid.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    one = Window.partitionBy("g")
    before = F.sum("c").over(one.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    starts = counts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(one).alias("n"))
    return laid.join(starts, ["g", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Rows of one (group, block) at a time, from batches sorted by both."""
    key, held = None, {}
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        keys = list(zip(columns["g"], columns["block"], strict=True))
        start = 0
        while start < len(keys):
            end = start
            while end < len(keys) and keys[end] == keys[start]:
                end += 1
            if keys[start] != key:
                if key is not None:
                    yield key, held
                key, held = keys[start], {n: [] for n in columns}
            for n, values in columns.items():
                held[n] += values[start:end]
            start = end
    if key is not None:
        yield key, held


def _tree(held: dict[str, list], width: int, limit: int) -> list[list[bytes]]:
    n = held["n"][-1]
    digests = [d.hex().encode() for d in held["digest"] if d is not None]
    return forward(digests, width if n > 1 << width else levels_of(n), limit)


def _tops(width: int, limit: int):
    schema = pa.schema([("g", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, block), held in _blocks(batches):
            top = _tree(held, width, limit)[-1][0]
            blocks = -(-held["n"][0] >> width)
            yield pa.RecordBatch.from_pylist([{"g": g, "idx": block, "n": blocks, "digest": bytes.fromhex(top.decode())}], schema)

    return task


_NODE = "g string, idx long, n long, digest binary, id long, other binary"


def build(nodes: DataFrame, width: int = BLOCK_LEVELS, limit: int = QUEUE_ITEMS) -> tuple[list[DataFrame], DataFrame | None]:
    """The stored nodes of every round, and (g, digest, round) of each group's top."""
    rounds, tops = [stored(nodes, "nodes")], None
    while True:
        cut = rounds[-1].withColumn("block", F.shiftright("idx", width)).select("g", "block", "idx", "n", "digest")
        dealt = cut.repartition(partitions(cut), "g", "block").sortWithinPartitions("g", "block", "idx")
        up = stored(dealt.mapInArrow(_tops(width, limit), "g string, idx long, n long, digest binary"), "tops")
        done = up.where("n = 1").select("g", "digest", F.lit(len(rounds) - 1).alias("round"))
        tops = done if tops is None else tops.unionAll(done)
        left = up.where("n > 1")
        if left.isEmpty():
            return rounds, tops
        rounds.append(left)


def _proofs(width: int, limit: int):
    """Proofs of a block's nodes: their part inside the block, then the block's own."""
    schema = pa.schema([
        ("g", pa.string()), ("idx", pa.int64()), ("id", pa.int64()), ("digest", pa.binary()), ("other", pa.binary()),
        ("proof", pa.binary()), ("subroot", pa.binary()),
    ])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, _), held in _blocks(batches):
            above, subroot = held["proof"][0], held["subroot"][0]  # the message to the block comes first
            log = _tree(held, width, limit)
            rows = []
            for i, proof in enumerate(backward(log, limit), start=1):
                rows.append({
                    "g": g, "idx": held["idx"][i], "id": held["id"][i], "digest": held["digest"][i], "other": held["other"][i],
                    "proof": proof + above, "subroot": subroot,
                })
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return task


def deliver(
    rounds: list[DataFrame], messages: DataFrame, width: int = BLOCK_LEVELS, limit: int = QUEUE_ITEMS
) -> DataFrame:
    """Proofs of the leaves, from (g, proof, subroot, round) for each group's top."""
    below = None
    for level in reversed(range(len(rounds))):
        own = rounds[level]
        payload = [F.col(c) if c in own.columns else F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("other", "binary"))]
        nodes = own.select(
            "g", F.shiftright("idx", width).alias("block"), "idx", "n", "digest", *payload,
            F.lit(None).cast("binary").alias("proof"), F.lit(None).cast("binary").alias("subroot"),
        )
        sent = messages.where(F.col("round") == level).select("g", F.lit(0).cast("long").alias("block"), "proof", "subroot")
        if below is not None:
            sent = sent.unionAll(below.select("g", F.col("idx").alias("block"), "proof", "subroot"))
        blank = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("digest", "binary"), ("id", "long"), ("other", "binary"))]
        heads = sent.select("g", "block", F.lit(-1).cast("long").alias("idx"), *blank, "proof", "subroot")
        dealt = nodes.unionAll(heads).repartition(partitions(own), "g", "block").sortWithinPartitions("g", "block", "idx")
        below = dealt.mapInArrow(
            _proofs(width, limit), "g string, idx long, id long, digest binary, other binary, proof binary, subroot binary"
        )
        if level:
            below = stored(below, "proofs")
    return below


def _checked(root: str):
    """Digests of a leaf and what its proof says: folded from the changed leaf where there is one."""
    fixed = root.encode()
    schema = pa.schema([
        ("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
        ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), ("proof", pa.string()),
    ])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, others, proofs, subroots = (
                batch.column(c).to_pylist() for c in ("id", "digest", "other", "proof", "subroot")
            )
            shown = [p.decode() for p in proofs]
            sums = [digest_of(d for _, d in siblings(p)).decode() for p in proofs]
            folded = [
                fold((d if o is None else o).hex().encode(), p) for d, o, p in zip(digests, others, proofs, strict=True)
            ]
            columns = [
                ids, [d.hex() for d in digests], [s.hex() for s in subroots], [root] * len(ids), sums,
                [f.decode() for f in folded], [f == fixed for f in folded], shown,
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return task


RESULT = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof string"
)


def manifest(docs: DataFrame, width: int = BLOCK_LEVELS, limit: int = QUEUE_ITEMS) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof.

    Null fields are ``-``. Null ids come first and are never changed; rows that
    repeat an id are leaves of their own, ordered by digest, so equal rows have equal
    leaves and their proofs differ only in place. ``proof`` lists the siblings from
    leaf to root, each after ``<`` or ``>`` for its side, ``=`` where there is none.
    Columns beyond the five fields are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rounds, tops = build(ranked(stored(leaves(docs), "leaves"), ["id", "digest"]), width, limit)
    tops = stored(tops, "subroots")
    one = ranked(tops.select(F.lit("").alias("g"), F.col("g").alias("lang"), "digest", "round"), ["lang"])
    upper = one.select("g", "idx", "n", "digest", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("other"), "lang", "round")
    above, summit = build(upper, width, limit)
    top = summit.first()  # one row of 32 bytes; none for an empty table
    if top is None:
        return spark.createDataFrame([], RESULT)
    whole = summit.select("g", F.lit(b"").alias("proof"), F.col("digest").alias("subroot"), "round")
    proofs = deliver(above, whole, width, limit).select("idx", "proof", F.col("digest").alias("subroot"))
    messages = above[0].select("idx", "lang", "round").join(proofs, "idx").select(F.col("lang").alias("g"), "proof", "subroot", "round")
    below = deliver(rounds, stored(messages, "messages"), width, limit)
    return below.mapInArrow(_checked(bytes(top["digest"]).hex()), RESULT)
