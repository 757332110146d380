"""Corpus export, reports and append-only logs; keyed tables are in ``buckets``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.sources.buckets import read_buckets, replace_path, upsert_path, vacuum, write_buckets

__all__ = [
    "append_events", "read_buckets", "replace_path", "upsert_path", "vacuum", "write_buckets", "write_corpus", "write_report",
]


def write_corpus(exported: DataFrame, manifest: DataFrame, path: str) -> None:
    """Rendered documents as JSON lines (file_name, text) and the manifest beside them.

    Rows keep their file name: at corpus scale one small file per document would
    cost more than the text.
    """
    exported.select("file_name", "text").write.mode("overwrite").json(f"{path}/documents")
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_events(df: DataFrame, path: str, status: str = "RUNNING") -> None:
    """Append events to a log; a missing status starts as ``RUNNING``."""
    if "status" in df.columns:
        df = df.withColumn("status", F.coalesce("status", F.lit(status)))
    else:
        df = df.withColumn("status", F.lit(status))
    df.write.mode("append").parquet(path)
