"""Running best k per query inside a task, and the final cut over all tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TopK:
    """Best ``k`` per query over blocks of candidates; ties go to the smaller id.

    ``floor`` is the score that a candidate of each query must reach to matter.
    """

    def __init__(self, q_ids: np.ndarray, k: int):
        self.q_ids, self.k = q_ids, k
        self.scores: list[np.ndarray] = [np.zeros(0) for _ in q_ids]
        self.found: list[np.ndarray | None] = [None for _ in q_ids]
        self.floor = np.full(len(q_ids), -np.inf)

    def merge(self, q: int, row: np.ndarray, ids: np.ndarray) -> None:
        hit = np.flatnonzero((row >= self.floor[q]) & np.isfinite(row))
        if len(hit) > self.k:
            hit = hit[row[hit] >= np.partition(row[hit], -self.k)[-self.k]]
        if not len(hit):
            return
        s = np.concatenate([self.scores[q], row[hit]])
        i = ids[hit] if self.found[q] is None else np.concatenate([self.found[q], ids[hit]])
        best = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.found[q] = s[best], i[best]
        if len(best) == self.k:
            self.floor[q] = s[best][-1]

    def batch(self) -> pa.RecordBatch | None:
        """(query_id, chunk_id, score): at most k rows per query."""
        got = [q for q in range(len(self.q_ids)) if self.found[q] is not None]
        if not got:
            return None
        arrays = [
            np.concatenate([np.repeat(self.q_ids[q : q + 1], len(self.scores[q])) for q in got]),
            np.concatenate([self.found[q] for q in got]),
            np.concatenate([self.scores[q] for q in got]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["query_id", "chunk_id", "score"])


def ids_of(column: pa.Array) -> np.ndarray:
    out = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return out.astype(str) if out.dtype == object else out


def hit_schema(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def cut(hits: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def groups_of(column: pa.Array | None, rows: int) -> list[tuple[object, np.ndarray]]:
    """Rows of each value of a column; all rows under None without one."""
    if column is None:
        return [(None, np.arange(rows))]
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = column.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    pieces = np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []
    return [(coded.dictionary[int(codes[p[0]])].as_py(), p) for p in pieces]
