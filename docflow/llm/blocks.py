"""Small helpers shared by the Arrow tasks of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.session import work_path

# White space of the word contracts: space and the control characters 9 to 13.
SPACES = b" \t\n\x0b\x0c\r"


def text_or_empty(name: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def raw_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary array without nulls, and its n + 1 offsets."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if len(at) == 0:
        at = np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def runs_of_rows(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write to the shared work folder and go on from the files, so that nothing is computed twice.

    The files are the recovery point after a lost executor. They stay in the
    folder of ``spark.checkpoint.dir``, whose owner clears it.
    """
    path = work_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
