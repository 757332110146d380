"""Exact deduplication by Grace hashing.

1. Collapse: each Arrow batch is put through an open-addressing table, so a group
   of copies leaves a batch as one record, however large it is in the corpus.
2. Partition: records are dealt to buckets by hash bits (Spark's shuffle files are
   the spill files of the first level).
3. Fit: a bucket's records go into an open-addressing table of at most
   ``table_bytes``, comparing complete content. A record that meets its content in
   the table joins that entry; one that finds neither its content nor room is
   written to spill files in the shared folder.
4. Recur: spilled records are dealt anew by other hash bits, to twice as many
   buckets, until nothing is spilled.

Content that found room never spills, so entries are complete when their task
ends. The memory of a task is ``table_bytes`` plus 24 bytes per record of the
bucket; records of one content are at most one per input batch.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.blocks import partitions, stored, text_or_empty

TABLE_BYTES = 64 << 20
ENTRY_BYTES = 96


class ContentTable:
    """Open addressing with linear probing; entries are equal when their complete bytes are."""

    def __init__(self, limit: int):
        self.limit = limit
        self.used = 0
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self._resize(1 << 10)

    def _resize(self, size: int) -> None:
        self.mask = size - 1
        self.slots = array("q", [-1]) * size
        for entry, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = entry

    def put(self, h: int, content: bytes) -> int:
        """The entry of the content, new or old; -1 if it is new and there is no room.

        An empty table takes any content, so that each pass makes progress.
        """
        slots, mask = self.slots, self.mask
        at = h & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        cost = len(content) + ENTRY_BYTES
        if self.contents and self.used + cost > self.limit:
            return -1
        entry = len(self.contents)
        slots[at] = entry
        self.hashes.append(h)
        self.contents.append(content)
        self.used += cost
        if 2 * len(self.contents) > mask:
            self._resize(2 * (mask + 1))
        return entry


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record with text for each content of a batch; other rows name its row."""
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        n = batch.num_rows
        ids = batch.column("_id").to_pylist()
        table = ContentTable(1 << 62)
        texts = batch.column("_text").cast(pa.binary())
        entry_of = [
            table.put(h, t) for h, t in zip(batch.column("_hash").to_pylist(), texts.to_pylist(), strict=True)
        ]
        best, count = [-1] * len(table.contents), [0] * len(table.contents)
        for i, e in enumerate(entry_of):
            count[e] += 1
            held = best[e]
            if held < 0 or ids[held] is None or (ids[i] is not None and ids[i] >= ids[held]):
                best[e] = i
        firsts = [best[e] for e in entry_of]
        own = pa.array([i == f for i, f in enumerate(firsts)])
        columns = {name: batch.column(name) for name in batch.schema.names if name != "_text"}
        columns["_row"] = pa.array(range(row, row + n), pa.int64())
        columns["_record"] = pa.array([row + f for f in firsts], pa.int64())
        columns["_copies"] = pa.array([count[e] for e in entry_of], pa.int64())
        columns["_text"] = pa.compute.if_else(own, batch.column("_text"), pa.scalar(None, batch.column("_text").type))
        yield pa.RecordBatch.from_pydict(columns)
        row += n


_RECORD = "_row long, _id long, _copies long, _hash long, _text binary"
_FOUND = "_keep_row long, _keep_id long, _size long, _sha string"


def _fit(limit: int):
    """The task of one bucket: entries of its table, then the records that found no room."""
    schema = pa.schema(
        [("_row", pa.int64()), ("_id", pa.int64()), ("_copies", pa.int64()), ("_hash", pa.int64()),
         ("_text", pa.binary()), ("_keep_row", pa.int64()), ("_keep_id", pa.int64()), ("_size", pa.int64()),
         ("_sha", pa.string())]
    )

    def rows(data: dict) -> pa.RecordBatch:
        n = len(data["_row"])
        arrays = [pa.array(data.get(f.name) or [None] * n, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(limit)
        members: list[list] = []  # of each entry: its records, the key of the row that stays, its copies
        for batch in batches:
            spilled: list[int] = []
            row, ids, copies, hashes, texts = (
                batch.column(c).to_pylist() for c in ("_row", "_id", "_copies", "_hash", "_text")
            )
            for i, text in enumerate(texts):
                entry = table.put(hashes[i], text)
                if entry < 0:
                    spilled.append(i)
                    continue
                if entry == len(members):
                    members.append([array("q"), None, 0])
                held = members[entry]
                held[0].append(row[i])
                key = (ids[i] is not None, ids[i] or 0, row[i])
                if held[1] is None or key > held[1]:
                    held[1] = key
                held[2] += copies[i]
            if spilled:
                yield rows({
                    "_row": [row[i] for i in spilled], "_id": [ids[i] for i in spilled],
                    "_copies": [copies[i] for i in spilled], "_hash": [hashes[i] for i in spilled],
                    "_text": [texts[i] for i in spilled],
                })
        out: dict[str, list] = {c: [] for c in ("_row", "_keep_row", "_keep_id", "_size", "_sha")}
        for content, (records, best, size) in zip(table.contents, members, strict=True):
            sha = hashlib.sha256(content).hexdigest()
            for r in records:
                out["_row"].append(r)
                out["_keep_row"].append(best[2])
                out["_keep_id"].append(best[1] if best[0] else None)
                out["_size"].append(size)
                out["_sha"].append(sha)
            if len(out["_row"]) >= 20_000:
                yield rows(out)
                out = {c: [] for c in out}
        if out["_row"]:
            yield rows(out)

    return task


def grace_groups(records: DataFrame, table_bytes: int = TABLE_BYTES, buckets: int | None = None) -> DataFrame:
    """One row per record: the row that stays, its id, the size of the group and the text's SHA-256."""
    buckets = buckets or partitions(records)
    found, level = None, 0
    while True:
        dealt = records.repartition(buckets, F.xxhash64("_hash", F.lit(level)))
        out = stored(dealt.mapInArrow(_fit(table_bytes), f"{_RECORD}, {_FOUND}"), f"grace-{level}")
        entries = out.where("_size is not null").select("_row", "_keep_row", "_keep_id", "_size", "_sha")
        found = entries if found is None else found.unionAll(entries)
        records = out.where("_size is null").select("_row", "_id", "_copies", "_hash", "_text")
        if records.isEmpty():
            return found
        level, buckets = level + 1, 2 * buckets


def _rows(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    payload = [F.col(c).alias(f"p{i}") for i, c in enumerate(keep)]
    text = text_or_empty(text_col)
    shaped = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash"), *payload)
    names = [f.name for f in shaped.schema if f.name not in ("_text",)]
    schema = ", ".join(f"{n} {shaped.schema[n].dataType.simpleString()}" for n in names)
    return stored(
        shaped.mapInArrow(_collapse, f"{schema}, _row long, _record long, _copies long, _text string"), "grace-rows"
    )


def _grouped(rows: DataFrame, table_bytes: int, buckets: int | None) -> DataFrame:
    records = rows.where("_text is not null").select(
        "_row", "_id", "_copies", "_hash", F.col("_text").cast("binary").alias("_text")
    )
    return grace_groups(records, table_bytes, buckets)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    table_bytes: int = TABLE_BYTES, buckets: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the largest id stays
    (null ids are smallest); of rows that repeat id and text exactly one stays.
    Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    rows = _rows(docs, id_col, text_col, [])
    groups = _grouped(rows, table_bytes, buckets).withColumnRenamed("_row", "_record")
    return rows.select("_row", "_record", "_id").join(groups, "_record").select(
        F.col("_id").alias("doc_id"),
        F.col("_keep_id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_keep_row")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    table_bytes: int = TABLE_BYTES, buckets: int | None = None,
) -> DataFrame:
    """The rows that stay, with all columns of ``docs``. A null text comes back as null."""
    others = [c for c in docs.columns if c not in (text_col,)]
    was_null = "_null_text"
    rows = _rows(docs.withColumn(was_null, F.col(text_col).isNull()), id_col, text_col, [*others, was_null])
    kept = _grouped(rows, table_bytes, buckets).where("_row = _keep_row").select("_row")
    at = {c: f"p{i}" for i, c in enumerate(others)}
    text = F.when(~F.col(f"p{len(others)}"), F.col("_text")).alias(text_col)
    return rows.where("_text is not null").join(kept, "_row", "left_semi").select(
        *(text if c == text_col else F.col(at[c]).alias(c) for c in docs.columns)
    )
