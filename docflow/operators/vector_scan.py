"""Exact vector search in rounds: queries travel, vectors stay in their tasks.

Each round broadcasts a bounded block of queries and reads every vector once. Inside a
task the vectors of a batch are put to their nearest pivot. By the triangle inequality
a vector within r of a pivot is no nearer to a query than the pivot's distance less r,
so the vectors of a pivot are compared only with queries whose k-th best so far is not
already nearer than that. Each query meets its nearest pivot first, which tightens it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.operators.topk import cut, groups_of, hit_schema, ids_of
from docflow.session import work_path

QUERY_BLOCK = 16_384  # queries of a round
QUERY_VALUES = 1 << 21  # and numbers in their vectors
SCORE_DIGITS = 12  # copies of a vector tie exactly, whatever batch they came in
SCORES_AT_ONCE = 4_000_000
HITS_AT_ONCE = 1 << 16  # pairs computed again in double precision
SLACK = 1e-7  # distances are rounded; a pivot is passed over only beyond this


def unit_rows(column: pa.Array, dim: int | None) -> np.ndarray:
    """List column as a unit-length double matrix; zero vectors stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != (dim or sizes[0])).any():
        raise ValueError("vectors must have the same length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(sizes), -1) if len(sizes) else np.zeros((0, dim or 0))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x and y."""
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0))


class Pivots:
    """Vectors put to the nearest of some of them, with the radius of each group; zero vectors are a group."""

    def __init__(self, mat: np.ndarray):
        zero = ~mat.any(axis=1)
        rows = np.flatnonzero(~zero)
        n = int(np.sqrt(len(rows)))
        chosen = mat[rows[:: max(1, len(rows) // max(1, n))][: max(1, n)]]
        self.centres = np.concatenate([chosen, np.zeros((1, mat.shape[1]))])
        far = _apart(mat[rows], chosen)
        nearest = np.full(len(mat), len(chosen))
        nearest[rows] = far.argmin(axis=1) if len(rows) else nearest[rows]
        order = np.argsort(nearest, kind="stable")
        cuts = np.searchsorted(nearest[order], np.arange(len(self.centres) + 1))
        self.members = [order[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        self.radius = np.zeros(len(self.centres))
        if len(rows):
            np.maximum.at(self.radius, nearest[rows], far.min(axis=1))


class Best:
    """Best ``k`` per query as two matrices, merged for many queries at once; ties go to the smaller id."""

    def __init__(self, q_ids: np.ndarray, k: int):
        self.q_ids, self.k = q_ids, k
        self.scores = np.full((len(q_ids), k), -np.inf)
        self.found: np.ndarray | None = None
        self.floor = np.full(len(q_ids), -np.inf)

    def merge(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (query, score, id), each vector once per query."""
        if self.found is None:
            self.found = np.zeros(self.scores.shape, ids.dtype)
        elif self.found.dtype != ids.dtype:  # longer strings
            self.found = self.found.astype(np.result_type(self.found.dtype, ids.dtype))
        met, own = np.unique(queries, return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(met)), self.k), own])
        s = np.concatenate([self.scores[met].ravel(), scores])
        i = np.concatenate([self.found[met].ravel(), ids])
        order = np.lexsort((i, -s, owner))
        begins = np.searchsorted(owner[order], np.arange(len(met)))
        best = order[begins[:, None] + np.arange(self.k)]
        self.scores[met], self.found[met] = s[best], i[best]
        self.floor[met] = self.scores[met, -1]

    def batch(self) -> pa.RecordBatch | None:
        """(query_id, chunk_id, score): at most k rows per query."""
        query, place = np.nonzero(np.isfinite(self.scores))
        if not len(query):
            return None
        arrays = [self.q_ids[query], self.found[query, place], self.scores[query, place]]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["query_id", "chunk_id", "score"])


class Searched:
    """Queries of one value of ``by``, and their best vectors so far.

    Scores are screened in single precision; those that reach the floor, less what
    rounding can take away, are computed again in double precision.
    """

    def __init__(self, ids: np.ndarray, mat: np.ndarray, k: int):
        self.mat, self.single, self.top = mat, mat.astype(np.float32), Best(ids, k)
        self.square = (mat * mat).sum(axis=1)  # 1, or 0 for zero vectors
        self.error = 4 * (mat.shape[1] + 8) * float(np.finfo(np.float32).eps)
        self.compared = 0

    def _reach(self) -> np.ndarray:
        """Distance within which a unit vector can still enter a query's best k."""
        floor = np.where(np.isfinite(self.top.floor), self.top.floor, -2.0)
        return np.sqrt(np.maximum(self.square + 1 - 2 * floor, 0)) + SLACK

    def add(self, ids: np.ndarray, mat: np.ndarray) -> None:
        pivots, single = Pivots(mat), mat.astype(np.float32)
        low = _apart(self.mat, pivots.centres) - pivots.radius[None, :]
        first = low.argmin(axis=1)
        for c, rows in enumerate(pivots.members):
            self._exact(np.flatnonzero(first == c), rows, ids, mat)
        near = (low <= self._reach()[:, None]) | (self.square == 0)[:, None]
        near[np.arange(len(first)), first] = False
        group = np.empty(len(mat), np.int64)
        for c, rows in enumerate(pivots.members):
            group[rows] = c
        share = near.mean(axis=0)
        every = [pivots.members[c] for c in np.flatnonzero(share > 0.5)]
        if every:  # so many queries reach these pivots that all are compared, in one product
            self._screen(np.arange(len(first)), np.concatenate(every), ids, mat, single, first, group)
        for c in np.argsort(low.min(axis=0), kind="stable"):
            if 0 < share[c] <= 0.5:
                still = near[:, c] & ((low[:, c] <= self._reach()) | (self.square == 0))
                self._screen(np.flatnonzero(still), pivots.members[c], ids, mat, single, first, group)

    def _exact(self, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, mat: np.ndarray) -> None:
        """Scores of queries that may have no floor yet, with few rows: screened in double precision."""
        step = max(1, SCORES_AT_ONCE // max(1, len(queries)))
        for at in range(0, len(rows) if len(queries) else 0, step):
            here = rows[at : at + step]
            self.compared += len(queries) * len(here)
            block, least = self.mat[queries] @ mat[here].T, self.top.floor[queries]
            if len(here) > self.top.k:
                least = np.maximum(least, np.partition(block, -self.top.k, axis=1)[:, -self.top.k])
            q, v = np.nonzero(block >= least[:, None] - 2 * 10.0**-SCORE_DIGITS)
            self._settle([(queries[q], here[v])], ids, mat)

    def _screen(
        self, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, mat: np.ndarray, single: np.ndarray,
        first: np.ndarray, group: np.ndarray,
    ) -> None:
        """Scores that can enter a best k; a query's first pivot was compared before."""
        if not len(queries) or not len(rows):
            return
        k, asked, met = self.top.k, self.single[queries], first[queries]
        least = np.where(np.isfinite(self.top.floor[queries]), self.top.floor[queries] - self.error, -np.inf)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, SCORES_AT_ONCE // len(queries))
        for at in range(0, len(rows), step):
            here = rows[at : at + step]
            self.compared += len(queries) * len(here)
            block = asked @ single[here].T
            hit = np.flatnonzero(block >= least[:, None].astype(np.float32))
            if len(hit) > 2 * k * len(queries) and len(here) > k:
                # The k-th best of these vectors bounds the k-th best of all from below.
                bound = np.partition(block, -k, axis=1)[:, -k].astype(np.float64) - 2 * self.error
                least = np.maximum(least, bound)
                hit = np.flatnonzero(block >= least[:, None].astype(np.float32))
            q, v = np.divmod(hit, len(here))
            new = met[q] != group[here[v]]
            held.append((queries[q[new]], here[v[new]]))
            if sum(len(x) for x, _ in held) > HITS_AT_ONCE:
                self._settle(held, ids, mat)
                least = np.maximum(least, self.top.floor[queries] - self.error)
        self._settle(held, ids, mat)

    def _settle(self, held: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, mat: np.ndarray) -> None:
        """Exact scores of the pairs held back, merged."""
        for q, v in held:
            for at in range(0, len(q), HITS_AT_ONCE):
                some, rows = q[at : at + HITS_AT_ONCE], v[at : at + HITS_AT_ONCE]
                score = np.round(np.einsum("ij,ij->i", self.mat[some], mat[rows]), SCORE_DIGITS)
                kept = (score >= self.top.floor[some]) & np.isfinite(score)
                if kept.any():
                    self.top.merge(some[kept], score[kept], ids[rows[kept]])
        held.clear()


def _scan(table: pa.Table, by: str | None, k: int):
    """The task of one round over the vectors where they lie."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mat = ids_of(table["query_id"]), unit_rows(table["embedding"], None)
        dim = mat.shape[1]
        asked = {v: Searched(ids[rows], mat[rows], k) for v, rows in groups_of(table[by] if by else None, len(ids))}
        for batch in batches:
            if not batch.num_rows or not asked:
                continue
            v_ids, v_mat = ids_of(batch["chunk_id"]), unit_rows(batch["embedding"], dim)
            for value, rows in groups_of(batch[by] if by else None, batch.num_rows):
                if (s := asked.get(value)) is not None:
                    s.add(v_ids[rows], v_mat[rows])
        for s in asked.values():
            out = s.top.batch()
            if out is not None:
                yield out

    return task


def vector_topk(
    queries: DataFrame, vectors: DataFrame, k: int, by: str | None = None, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """Exact cosine top-k of every query: (query_id, chunk_id, score, rank).

    ``queries`` has (query_id, embedding), ``vectors`` (chunk_id, embedding); with
    ``by``, both carry that column and only equal values match. No index, no
    approximation; a task hands on at most k rows per query. More queries than
    ``query_block`` take several rounds, each written before the next; for them the
    vectors are written once, spread over the cores.
    """
    part = [by] if by else []

    def given(df: DataFrame, key: str) -> DataFrame:
        held = df.where(F.col("embedding").isNotNull())
        return (held.where(F.col(by).isNotNull()) if by else held).select(key, "embedding", *part)

    q, v, schema = given(queries, "query_id"), given(vectors, "chunk_id"), hit_schema(queries, vectors)
    table = q.limit(query_block + 1).toArrow()  # probe and fetch in one bounded read
    dim = pc.max(pc.list_value_length(table["embedding"])).as_py() or 1
    query_block = max(1, min(query_block, QUERY_VALUES // dim))
    if table.num_rows <= query_block:
        return cut(v.mapInArrow(_scan(table, by, k), schema), k)
    spark = queries.sparkSession
    query_path, vector_path, hit_path = (work_path(spark, n) for n in ("vector-queries", "vectors", "vector-hits"))
    rounds = -(-q.count() // query_block)
    dealt = q.withColumn("_round", F.pmod(F.xxhash64("query_id"), F.lit(rounds)))
    dealt.write.parquet(query_path)
    dealt = spark.read.schema(dealt.schema).parquet(query_path)
    tasks = max(spark.sparkContext.defaultParallelism, v.rdd.getNumPartitions())
    v.repartition(tasks).write.parquet(vector_path)
    v = spark.read.schema(v.schema).parquet(vector_path)
    for r in range(rounds):
        table = dealt.where(F.col("_round") == r).drop("_round").toArrow()
        cut(v.mapInArrow(_scan(table, by, k), schema), k).write.mode("append").parquet(hit_path)
    return spark.read.schema(cut(spark.createDataFrame([], schema), k).schema).parquet(hit_path)
