"""Keyword search over an inverted index in blocks, with impact bounds.

Chunks of a task are laid out in blocks, long ones first. A block lists its tokens in
order, so a prefix term is a range of tokens and its postings are one slice. The
running sum of the largest count of each token bounds what any chunk of the block can
reach for a query: a block below the query's k-th best so far is skipped. Every task
keeps the best k per query, so neither postings nor matches are shuffled.

Queries travel to the chunks a bounded number of terms at a time. If one round does
not take them all, the blocks are written once and each round reads those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.functions.terms import search_terms, shortest_prefixes, words_of
from docflow.operators.topk import TopK, cut, groups_of, hit_schema, ids_of
from docflow.session import work_path

TERMS_PER_ROUND = 200_000
BLOCK = 512  # chunks per block
AT_ONCE = 1 << 22  # matches added up together
_LAST = "\U0010ffff"  # behind every token with a prefix: tokens are letters and digits


class Block:
    """Postings of some chunks, sorted by token, and bounds on what a term can add."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, starts: np.ndarray, chunk: np.ndarray, count: np.ndarray):
        self.ids, self.words, self.starts, self.chunk, self.count = ids, words, starts, chunk, count
        largest = np.maximum.reduceat(count, starts[:-1]) if len(words) else np.empty(0, np.int64)
        self.ceiling = np.concatenate([[0], np.cumsum(largest)])

    @classmethod
    def of(cls, ids: np.ndarray, words: np.ndarray, codes: np.ndarray, owners: np.ndarray) -> Block:
        """From token positions: ``codes`` into the sorted ``words``, ``owners`` into ``ids``."""
        met, inverse = np.unique(codes, return_inverse=True)
        keys, count = np.unique(inverse * len(ids) + owners, return_counts=True)
        token, chunk = np.divmod(keys, max(1, len(ids)))
        return cls(ids, words[met], np.searchsorted(token, np.arange(len(met) + 1)), chunk, count.astype(np.int64))


def _blocks(ids: np.ndarray, texts: pa.Array) -> Iterator[Block]:
    """Blocks of chunks given as lists of tokens, long chunks first."""
    sizes = np.diff(texts.offsets.to_numpy())
    coded = texts.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)  # by bytes of UTF-8, which is by code points
    words = np.array(coded.dictionary.take(order).to_pylist(), object)
    rank = np.empty(len(words), np.int64)
    rank[order.to_numpy()] = np.arange(len(words))
    codes = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
    owners = np.repeat(np.arange(len(ids)), sizes)
    if len(words) and words[0] == "":  # splitting leaves empty ends
        codes, owners = codes[codes > 0], owners[codes > 0]
    begins = np.searchsorted(owners, np.arange(len(ids) + 1))
    by_size = np.argsort(-np.diff(begins), kind="stable")
    for at in range(0, len(ids), BLOCK):
        own = by_size[at : at + BLOCK]
        rows = _ranges(begins[own], begins[own + 1] - begins[own])
        yield Block.of(ids[own], words, codes[rows], np.repeat(np.arange(len(own)), begins[own + 1] - begins[own]))


class Asked:
    """Queries of one value of ``by`` with their terms, and their best chunks so far."""

    def __init__(self, ids: np.ndarray, terms: list[list[str]], k: int):
        with_terms = [i for i, t in enumerate(terms) if t]
        self.top = TopK(ids[with_terms], k)
        self.terms = np.array(sorted({t for i in with_terms for t in terms[i]}), object)
        self.ends = np.array([t + _LAST for t in self.terms], object)
        place = {t: i for i, t in enumerate(self.terms)}
        self.pair = np.array([place[t] for i in with_terms for t in terms[i]], np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(terms[i]) for i in with_terms])]).astype(np.int64)

    def search(self, block: Block) -> None:
        if not len(self.pair) or not len(block.words):
            return
        low, high = np.searchsorted(block.words, self.terms), np.searchsorted(block.words, self.ends)
        bound = np.add.reduceat((block.ceiling[high] - block.ceiling[low])[self.pair], self.first[:-1])
        active = np.flatnonzero(bound >= np.maximum(self.top.floor, 1))
        start, length = block.starts[low], block.starts[high] - block.starts[low]
        work = np.add.reduceat(length[self.pair], self.first[:-1])[active]
        step = np.cumsum(work + len(block.ids)) // AT_ONCE
        for queries in np.split(active, np.flatnonzero(np.diff(step)) + 1) if len(active) else ():
            self._score(block, queries, start, length)

    def _score(self, block: Block, queries: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        sizes = self.first[queries + 1] - self.first[queries]
        pairs = self.pair[_ranges(self.first[queries], sizes)]
        postings = _ranges(start[pairs], length[pairs])
        row = np.repeat(np.repeat(np.arange(len(queries)), sizes), length[pairs])
        n = len(block.ids)
        found = np.bincount(row * n + block.chunk[postings], block.count[postings], len(queries) * n).reshape(len(queries), n)
        for at in np.flatnonzero(found.max(axis=1) >= np.maximum(self.top.floor[queries], 1)):
            scores = found[at]
            scores[scores == 0] = -np.inf
            self.top.merge(int(queries[at]), scores, block.ids)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(starts) else np.empty(0, np.int64)
    return np.arange(total) + shift


def _asked(table: pa.Table, by: str | None, k: int) -> dict[object, Asked]:
    ids, terms = ids_of(table["query_id"]), table["terms"].to_pylist()
    return {
        value: Asked(ids[rows], [terms[r] for r in rows], k)
        for value, rows in groups_of(table[by] if by else None, table.num_rows)
    }


def _found(asked: dict[object, Asked]) -> Iterator[pa.RecordBatch]:
    for a in asked.values():
        out = a.top.batch()
        if out is not None:
            yield out


_INDEX = "ids array<{id}>, words array<string>, starts array<long>, chunks array<long>, counts array<long>"


def _index_rows(by: str | None, values: pa.DataType | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, rows in groups_of(batch[by] if by else None, batch.num_rows):
                texts = batch["tokens"].take(pa.array(rows)) if by else batch["tokens"]
                for b in _blocks(ids_of(batch["chunk_id"])[rows], texts):
                    row = [pa.array([x.tolist()]) for x in (b.ids, b.words, b.starts, b.chunk, b.count)]
                    row[1] = pa.array([b.words.tolist()], pa.list_(pa.string()))
                    names = ["ids", "words", "starts", "chunks", "counts"]
                    if by:
                        row, names = [*row, pa.array([value], values)], [*names, by]
                    yield pa.RecordBatch.from_arrays(row, names=names)

    return task


def build_index(chunks: DataFrame, by: str | None = None) -> DataFrame:
    """The blocks of (chunk_id, content) as rows; no chunk is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema = _INDEX.format(id=chunks.schema["chunk_id"].dataType.simpleString())
    kind = None
    if by:
        schema += f", {by} {chunks.schema[by].dataType.simpleString()}"
        kind = to_arrow_type(chunks.schema[by].dataType)
    return _tokens(chunks, by).mapInArrow(_index_rows(by, kind), schema)


def _tokens(chunks: DataFrame, by: str | None) -> DataFrame:
    part = [by] if by else []
    held = chunks.where(F.col("content").isNotNull())
    held = held.where(F.col(by).isNotNull()) if by else held
    return held.select("chunk_id", *part, words_of(F.col("content")).alias("tokens"))


def _scan(table: pa.Table, by: str | None, k: int, indexed: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _asked(table, by, k)
        for batch in batches:
            if indexed:
                for r in batch.to_pylist():
                    if (a := asked.get(r[by] if by else None)) is not None:
                        a.search(Block(
                            np.array(r["ids"]), np.array(r["words"], object), np.array(r["starts"], np.int64),
                            np.array(r["chunks"], np.int64), np.array(r["counts"], np.int64),
                        ))
                continue
            ids = ids_of(batch["chunk_id"])
            for value, rows in groups_of(batch[by] if by else None, batch.num_rows):
                if (a := asked.get(value)) is not None:
                    texts = batch["tokens"].take(pa.array(rows)) if by else batch["tokens"]
                    for block in _blocks(ids[rows], texts):
                        a.search(block)
        yield from _found(asked)

    return task


def keyword_topk(
    queries: DataFrame, chunks: DataFrame, k: int, by: str | None = None, weight: float = 0.1,
    terms_per_round: int = TERMS_PER_ROUND,
) -> DataFrame:
    """Prefix OR search: (query_id, chunk_id, score, rank).

    ``queries`` has (query_id, query), ``chunks`` (chunk_id, content); with ``by``
    both carry that column and only equal values match. With m matching token
    positions, ``s = weight * m`` and the score is ``s / (1 + s)``. The terms of a
    query are cut to its shortest prefixes, so a position counts once.
    """
    part = [by] if by else []
    asked = queries.select("query_id", *part, shortest_prefixes(search_terms(F.col("query"))).alias("terms"))
    asked = asked.where(F.col(by).isNotNull()) if by else asked
    schema = hit_schema(queries, chunks)

    def scored(hits: DataFrame) -> DataFrame:
        s = F.lit(float(weight)) * F.col("score")
        return hits.withColumn("score", s / (F.lit(1.0) + s))

    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    if total <= terms_per_round:
        return cut(scored(_tokens(chunks, by).mapInArrow(_scan(asked.toArrow(), by, k, False), schema)), k)
    spark = queries.sparkSession
    index_path, hit_path, query_path = (work_path(spark, n) for n in ("keyword-index", "keyword-hits", "keyword-queries"))
    index = build_index(chunks, by)
    index.write.parquet(index_path)
    index = spark.read.schema(index.schema).parquet(index_path)
    rounds = -(-total // terms_per_round)
    dealt = asked.withColumn("_round", F.pmod(F.xxhash64("query_id"), F.lit(rounds)))
    dealt.write.parquet(query_path)
    dealt = spark.read.schema(dealt.schema).parquet(query_path)
    for r in range(rounds):
        table = dealt.where(F.col("_round") == r).drop("_round").toArrow()
        cut(index.mapInArrow(_scan(table, by, k, True), schema), k).drop("rank").write.mode("append").parquet(hit_path)
    return cut(scored(spark.read.schema(schema).parquet(hit_path)), k)
