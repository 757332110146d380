"""Similarity self-join of word-shingle sets (Jaccard) by prefix filtering under several token orders.

If two sets reach the threshold they share a token among the first
``n - ceil(t n) + 1`` tokens of each, whatever global order the tokens are put in.
Orders here start with the document frequency of a token, capped at 16, and differ
in how they go on; candidates must share prefix tokens under all of them.

1. Shingles are hashed in numpy. A chunk of documents sends each token once to the
   task of its hash range, 5 bytes apiece. Tokens that a chunk sees 16 times are at
   the cap already; only one entry of them is sent, so a passage that is in every
   document never gathers in one task.
2. Hash ranges count documents per token and return to the chunks the tokens that
   occur elsewhere. The others fill prefixes but can't meet, so a document with
   more than a quarter of its tokens to itself is done: it has no partner.
3. Documents with equal sets become one node. Prefix tokens of nodes are posted.
   The most central node of a posting list (the one whose tokens are the most
   frequent) is its hub; all nodes are verified against the hubs of their lists.
4. Nodes that are not connected with a hub are compared with the nodes around it,
   block by block: the tokens of a node are counted in 128 hash classes, and the
   smaller counts of two nodes bound their overlap. Pairs that this leaves are
   verified. No link is lost, but a group of copies is not expanded into its pairs.
5. Verification: the prefixes under the other orders must meet too, then sets are
   intersected in full.

Tokens are 46 to 54 bits of a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.blocks import partitions, raw_bytes, runs_of_rows, stored, text_or_empty
from docflow.llm.components import components
from docflow.llm.word_hashes import mix, shingles, words

WORDS = 5
PERCENT = 75
CAP = 16
CHUNK_BYTES = 4 << 20
LOW_BITS = 40
CLASSES = 128
UNLIMITED = 65_535
BLOCK = 4096
# The first order goes on by the token itself, the others by its hash with one of these numbers.
ORDERS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))
SIGNS = (np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x632BE59BD9B4E019))


def least_overlap(n: np.ndarray | int, percent: int = PERCENT):
    """Tokens that a partner of a set of n must share at least."""
    return -(-n * percent // 100)


def _five(tokens: np.ndarray) -> bytes:
    """The lowest 40 bits of each token."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unfive(data: bytes, high: int) -> np.ndarray:
    low = np.zeros((len(data) // 5, 8), np.uint8)
    low[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return low.view("<u8").reshape(-1).astype(np.int64) | (high << LOW_BITS)


def _pack_owners(owners: np.ndarray, n: int) -> bytes:
    """Sorted owners 0 to n - 1, as counts or as numbers, whichever is shorter."""
    if 2 * len(owners) < n:
        return b"\2" + owners.astype("<u2").tobytes()
    counts = np.bincount(owners, minlength=n)
    return b"\0" + counts.astype("<u1").tobytes() if counts.max(initial=0) < 256 else b"\1" + counts.astype("<u4").tobytes()


def _unpack_owners(data: bytes) -> np.ndarray:
    kind, rest = data[0], data[1:]
    if kind == 2:
        return np.frombuffer(rest, "<u2").astype(np.int64)
    counts = np.frombuffer(rest, "<u1" if kind == 0 else "<u4").astype(np.int64)
    return np.repeat(np.arange(len(counts)), counts)


_SENT = pa.schema([
    ("range", pa.int32()), ("chunk", pa.int64()), ("about", pa.binary()), ("owners", pa.binary()),
    ("tokens", pa.binary()), ("capped", pa.binary()),
])
_RETURNED = pa.schema([
    ("chunk", pa.int64()), ("range", pa.int32()), ("about", pa.binary()), ("owners", pa.binary()),
    ("tokens", pa.binary()), ("counts", pa.binary()),
])


def _send(high_bits: int, size: int):
    """Chunks of documents: a row about the chunk and a row of tokens for each hash range."""
    bits = LOW_BITS + high_bits
    most_rows = min(4096, 1 << (64 - bits))

    def chunk(ids: np.ndarray, marks: np.ndarray, data: np.ndarray, offsets: np.ndarray, key: int) -> Iterator[tuple]:
        hashes, owner = shingles(*words(data, offsets), size)
        if len(ids) == 1:
            hashes = np.unique(hashes)
            count = np.array([len(hashes)])
            owner = np.zeros(len(hashes), np.int64)
        else:
            count = None
        packed = np.unique((owner.astype(np.uint64) << np.uint64(bits)) | (hashes >> np.uint64(64 - bits)))
        owner = (packed >> np.uint64(bits)).astype(np.int64)
        token = packed & np.uint64((1 << bits) - 1)
        if count is None:
            count = np.bincount(owner, minlength=len(ids))
        ends = np.searchsorted(owner, np.arange(len(ids) + 1))
        signs = []
        for salt in SIGNS:
            total = np.append(np.zeros(1, np.uint64), np.cumsum(mix(token ^ salt)))
            signs.append((total[ends[1:]] - total[ends[:-1]]).astype(np.int64))
        order = np.argsort(token, kind="stable")
        token, owner = token[order].astype(np.int64), owner[order]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.empty(0, np.int64)
        run = np.diff(np.append(first, len(token)))
        here = np.repeat(run, run)
        capped = here >= CAP
        about = [ids, marks, count, *signs]
        yield (
            -1 - key % (1 << 20), key, np.stack([a.astype("<i8") for a in about]).tobytes(),
            owner[capped].astype("<u2").tobytes(), token[capped].astype("<i8").tobytes(), None,
        )
        range_of = token >> LOW_BITS
        ends = np.searchsorted(range_of, np.arange((1 << high_bits) + 1))
        for r in range(1 << high_bits):
            part = slice(ends[r], ends[r + 1])
            free = ~capped[part]
            mine, own = token[part][free], owner[part][free]
            by = np.argsort(own, kind="stable")
            hot = np.unique(token[part][~free])
            if len(mine) or len(hot):
                yield r, key, None, _pack_owners(own[by], len(ids)), _five(mine[by]), _five(hot)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            marks = batch.column("mark").to_numpy(zero_copy_only=False)
            data, offsets = raw_bytes(batch.column("text"))
            for first, last in runs_of_rows(offsets, CHUNK_BYTES):
                for a in range(first, last, most_rows):
                    b = min(a + most_rows, last)
                    rows = list(chunk(ids[a:b], marks[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], key))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT
                    )
                    key += 1

    return task


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per hash range: tokens that are in two documents or more, back to their chunks with capped counts."""
    held: dict[int, list] = {}
    for batch in batches:
        rows = batch.to_pylist()
        through = [r for r in rows if r["range"] < 0]
        if through:
            yield pa.RecordBatch.from_pylist([r | {"counts": None} for r in through], schema=_RETURNED)
        for r in rows:
            if r["range"] >= 0:
                held.setdefault(r["range"], []).append(r)
    for number, rows in held.items():
        tokens = [_unfive(r["tokens"], number) for r in rows]
        capped = np.concatenate([_unfive(r["capped"], number) for r in rows])
        every = np.concatenate([*tokens, capped])
        value, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
        count = np.minimum(count, CAP)
        if len(capped):
            count[np.searchsorted(value, capped)] = CAP
        count = count[inverse].astype(np.uint8)
        at, out = 0, []
        for r, mine in zip(rows, tokens, strict=True):
            n = count[at : at + len(mine)]
            at += len(mine)
            met = n > 1
            if met.any():
                out.append({
                    "chunk": r["chunk"], "range": number, "about": None, "counts": n[met].tobytes(),
                    "owners": _unpack_owners(r["owners"])[met].astype("<u2").tobytes(), "tokens": _five(mine[met]),
                })
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_RETURNED)


_SETS = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("sign1", pa.int64()),
    ("sign2", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary()), ("head", pa.list_(pa.int64())),
    ("central", pa.int64()), ("profile", pa.binary()),
])
_SETS_DDL = (
    "row long, doc_id long, mark long, n long, sign1 long, sign2 long, tokens binary, counts binary, "
    "head array<long>, central long, profile binary"
)
NO_ID = -(1 << 63)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: one row per document, with its shared tokens in the first order if it can have partners."""
    held: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            held.setdefault(r["chunk"], []).append(r)
    for rows in held.values():
        about = next(r for r in rows if r["about"] is not None)
        ids, marks, n, sign1, sign2 = np.frombuffer(about["about"], "<i8").reshape(5, -1)
        owner = [np.frombuffer(about["owners"], "<u2").astype(np.int64)]
        token, count = [np.frombuffer(about["tokens"], "<i8")], [np.full(len(owner[0]), CAP, np.uint8)]
        for r in rows:
            if r["about"] is None:
                owner.append(np.frombuffer(r["owners"], "<u2").astype(np.int64))
                token.append(_unfive(r["tokens"], r["range"]))
                count.append(np.frombuffer(r["counts"], np.uint8))
        owner, token, count = np.concatenate(owner), np.concatenate(token), np.concatenate(count)
        shared = np.bincount(owner, minlength=len(ids))
        can = (n > 0) & (shared >= least_overlap(n))
        keep = can[owner]
        owner, token, count = owner[keep], token[keep], count[keep]
        order = np.lexsort((token, count, owner))
        owner, token, count = owner[order], token[order], count[order]
        ends = np.searchsorted(owner, np.arange(len(ids) + 1))
        out = []
        for i in range(len(ids)):
            r = {"row": (about["chunk"] << 12) + i, "doc_id": None if ids[i] == NO_ID else int(ids[i]), "mark": int(marks[i])}
            r |= {"n": int(n[i]), "sign1": int(sign1[i]), "sign2": int(sign2[i])}
            if can[i]:
                mine, often = token[ends[i] : ends[i + 1]], count[ends[i] : ends[i + 1]]
                alone = int(n[i] - shared[i])
                r["head"] = mine[: max(0, int(prefix_length(n[i])) - alone)]
                r["central"] = 1000 * (alone + int(often.sum(dtype=np.int64))) // int(n[i])
                r["tokens"], r["counts"], r["profile"] = mine.astype("<i8").tobytes(), often.tobytes(), profile(mine)
            out.append(r)
        yield pa.RecordBatch.from_pylist(out, schema=_SETS)


def profile(tokens: np.ndarray) -> bytes:
    """Number of tokens in each hash class; a count beyond 16 bits makes all of them unlimited."""
    counts = np.bincount((mix(tokens.astype(np.uint64)) >> np.uint64(57)).astype(np.int64), minlength=CLASSES)
    if counts.max() >= UNLIMITED:
        counts[:] = UNLIMITED
    return counts.astype("<u2").tobytes()


def prefix_length(n):
    """Tokens of a set of n that must hold one of any partner."""
    return n - least_overlap(n) + 1


def _head(tokens: np.ndarray, counts: np.ndarray, posted: int, salt) -> np.ndarray:
    """The shared tokens of a prefix under the order (count, hash with the salt)."""
    return tokens[np.lexsort((mix(tokens.astype(np.uint64) ^ salt), counts))[:posted]]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        data = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        heads: dict[int, tuple] = {}

        def side(i: int, x: str) -> tuple:
            node = data[x][i]
            if node not in heads:
                tokens = np.frombuffer(data[f"t{x}"][i], "<i8")
                counts = np.frombuffer(data[f"c{x}"][i], np.uint8)
                heads[node] = (np.sort(tokens), [_head(tokens, counts, data[f"p{x}"][i], salt) for salt in ORDERS])
            return heads[node]

        for i in range(batch.num_rows):
            (x, xs), (y, ys) = side(i, "a"), side(i, "b")
            if all(np.isin(h, g).any() for h, g in zip(xs, ys, strict=True)):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                if 100 * both >= PERCENT * (data["na"][i] + data["nb"][i] - both):
                    a.append(data["a"][i])
                    b.append(data["b"][i])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that profiles allow: the far nodes of a block against its members, which come first."""
    key, held, block = None, [], None
    for batch in batches:
        a, b = [], []
        for r in batch.to_pylist():
            if (r["hub"], r["block"]) != key:
                key, held, block = (r["hub"], r["block"]), [], None
            counts = np.frombuffer(r["profile"], "<u2")
            if not r["far"]:
                held.append((r["node"], r["n"], r["label"], counts))
                continue
            if block is None and held:
                nodes, sizes, labels, profiles = zip(*held, strict=True)
                block = (np.array(nodes), np.array(sizes), np.array(labels), np.stack(profiles))
            if block is None:
                continue
            node, n, label, profiles = block
            fits = (label != r["label"]) & (100 * n >= PERCENT * r["n"]) & (100 * r["n"] >= PERCENT * n)
            at = np.flatnonzero(fits)
            most = np.minimum(profiles[at], counts).sum(axis=1, dtype=np.int64)
            if counts[0] == UNLIMITED:  # two unlimited profiles bound nothing but the sizes
                most = np.where(profiles[at, 0] == UNLIMITED, np.minimum(n[at], r["n"]), most)
            near = at[100 * most >= PERCENT * (n[at] + r["n"] - most)]
            a.extend(np.minimum(node[near], r["node"]).tolist())
            b.extend(np.maximum(node[near], r["node"]).tolist())
        pairs = np.unique(np.array([a, b], np.int64).reshape(2, -1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its set's size and signature, and its shared tokens if it can have partners."""
    parts = partitions(docs)
    high_bits = min(14, max(6, math.ceil(math.log2(parts)) + 2))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.xxhash64(text_or_empty(text_col)).alias("mark"), text_or_empty(text_col).alias("text"),
    )
    sent = rows.mapInArrow(_send(high_bits, WORDS), "range int, chunk long, about binary, owners binary, tokens binary, capped binary")
    returned = sent.repartition(parts, "range").mapInArrow(
        _shared, "chunk long, range int, about binary, owners binary, tokens binary, counts binary"
    )
    sets = returned.repartition(parts, "chunk").mapInArrow(_gather, _SETS_DDL)
    node = F.when(F.col("tokens").isNotNull(), F.xxhash64("n", "sign1", "sign2"))
    return stored(sets.withColumn("node", node), "shingle-sets")


def _linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    side = lambda x: nodes.select(
        F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"),
        F.col("counts").alias(f"c{x}"), F.size("head").alias(f"p{x}"),
    )
    return stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify, "a long, b long"), "links")


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes; enough of them to connect whatever is connected."""
    posted = nodes.select("node", "central", F.explode("head").alias("token"))
    hubs = posted.groupBy("token").agg(F.max(F.struct("central", "node")).alias("h"), F.count("*").alias("size"))
    hubs = hubs.where("size > 1").select("token", F.col("h.node").alias("hub"))
    around = stored(posted.join(hubs, "token").where("node != hub").select("hub", "node").distinct(), "around")
    ordered = F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")
    sizes = nodes.select("node", "n")
    allowed = around.join(sizes, "node").join(sizes.select(F.col("node").alias("hub"), F.col("n").alias("m")), "hub").where(
        (100 * F.col("n") >= PERCENT * F.col("m")) & (100 * F.col("m") >= PERCENT * F.col("n"))
    )
    tested = stored(allowed.select(*ordered).distinct(), "pairs")
    found = _linked(tested, nodes)

    # nodes around a hub that are not connected with it meet the others around that hub
    label = components(found, rounds=2)
    of_hub = label.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    members = around.unionAll(around.select("hub", F.col("hub").alias("node")).distinct())
    members = members.join(label, "node", "left").join(of_hub, "hub", "left").select(
        "hub", "node", F.coalesce("label", "node").alias("label"),
        (F.coalesce("label", "node") != F.coalesce("hub_label", "hub")).alias("away"),
    )
    blocks = members.groupBy("hub").agg(F.sum(F.col("away").cast("long")).alias("n_away"), F.count("*").alias("size"))
    blocks = blocks.where("n_away > 0").select("hub", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(blocks, "hub").join(nodes.select("node", "n", "profile"), "node")
    own = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("far", F.lit(False))
    far = rows.where("away").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("far", F.lit(True))
    columns = ["hub", "block", "far", "node", "n", "label", "profile"]
    dealt = own.select(columns).unionAll(far.select(columns)).repartition(partitions(nodes), "hub", "block")
    pairs = dealt.sortWithinPartitions("hub", "block", "far").mapInArrow(_compare, "a long, b long").distinct()
    return found.unionAll(_linked(pairs.join(tested, ["a", "b"], "left_anti"), nodes))


def _labelled_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: row, doc_id, mark, n_shingles and the label of its component, null without shared tokens."""
    sets = shingle_sets(docs, id_col, text_col)
    able = sets.where("node is not null")
    one = able.groupBy("node").agg(F.min("row").alias("row"))
    nodes = stored(able.join(one.select("row"), "row", "left_semi").drop("doc_id", "mark", "row"), "nodes")
    columns = ["row", "doc_id", "mark", F.col("n").alias("n_shingles")]
    linked = able.select(*columns, "node").join(components(links(nodes)), "node", "left")
    # rows without a node have no key to be joined by and stay where they are
    alone = sets.where("node is null").select(*columns, F.lit(None).cast("long").alias("label"))
    out = linked.select("row", "doc_id", "mark", "n_shingles", F.coalesce("label", "node").alias("label")).unionAll(alone)
    return stored(out, "labelled")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Null and empty texts and texts without words have 0 shingles and are linked with
    nothing, not with each other. Fewer than 5 words are one shingle. Rows that
    repeat a text, with or without their id, are linked. Null ids count as larger
    than all others; a component of null ids only has a null component_id. Other
    columns are not read. An empty table gives no rows.
    """
    rows = _labelled_sets(docs, id_col, text_col)
    smallest = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = rows.where("label is not null").join(smallest, "label").select("doc_id", "n_shingles", "component_id")
    return linked.unionAll(rows.where("label is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id, with all columns of ``docs``.

    Texts without words stay; of rows that repeat id and text one stays.
    """
    rows = _labelled_sets(docs, id_col, text_col).withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID)))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("_id").alias("_id"), F.col("mark").alias("_mark"))).alias("first")
    kept = rows.where("label is not null").groupBy("label").agg(first).select("first._id", "first._mark")
    alone = rows.where("label is null").select("_id", F.col("mark").alias("_mark"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.select(
        *(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_mark"),
    )
    stay = own.join(kept.unionAll(alone), ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"])
    return stay.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
