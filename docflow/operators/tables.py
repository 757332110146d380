"""Table maintenance: visibility, upsert, delete, replace, diff, latest state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import has_text
from docflow.session import broadcast_if_small


def visible(df: DataFrame, user_id, owner: str = "created_by", newest: str = "create_time") -> DataFrame:
    """Rows of one owner that are not deleted, newest first."""
    return df.where((F.col(owner) == F.lit(user_id)) & (F.col("deleted") == 0)).orderBy(
        F.col(newest).desc()
    )


def metadata_contains(metadata: Column, **pairs: str) -> Column:
    """True where the map holds every given key with an equal value."""
    cond = F.lit(True)
    for key, value in pairs.items():
        cond = cond & F.coalesce(F.try_element_at(metadata, F.lit(key)) == F.lit(value), F.lit(False))
    return cond


def filter_score(df: DataFrame, threshold: float | Column, column: str = "score") -> DataFrame:
    """Keep rows with a score of at least ``threshold``."""
    return df.where(F.col(column) >= threshold)


def filter_reranked(df: DataFrame, threshold: float, column: str = "score") -> DataFrame:
    """Threshold after re-ranking; it only applies when it is positive."""
    return filter_score(df, threshold, column) if threshold > 0 else df


def resolve_settings(queries: DataFrame, kbs: DataFrame, defaults: Mapping) -> DataFrame:
    """Per-base settings, falling back to ``defaults`` field by field."""
    kb = kbs.where(F.col("deleted") == 0).select(
        "kb_id", "similarity_threshold", "vector_top_k", "keyword_top_k", "prompt_template"
    )
    joined = queries.join(broadcast_if_small(kb), "kb_id", "left")
    k = lambda c: F.coalesce(F.when(F.col(c) > 0, F.col(c)), F.lit(defaults[c]))
    return joined.select(
        *queries.columns,
        F.coalesce("similarity_threshold", F.lit(defaults["similarity_threshold"])).alias(
            "similarity_threshold"
        ),
        k("vector_top_k").alias("vector_top_k"),
        k("keyword_top_k").alias("keyword_top_k"),
        F.when(has_text(F.col("prompt_template")), F.col("prompt_template"))
        .otherwise(F.lit(defaults["prompt_template"]))
        .alias("prompt_template"),
    )


def latest_n(
    df: DataFrame, limit: int | None, *, lo: int = 1, hi: int = 100, default: int = 50,
    newest: str = "create_time", tie: str | None = None,
) -> DataFrame:
    """Newest rows; the limit is clamped to ``lo..hi``. Plans as a distributed top-n."""
    n = max(lo, min(default if limit is None else limit, hi))
    order = [F.col(newest).desc()] + ([F.col(tie).asc()] if tie else [])
    return df.orderBy(*order).limit(n)


def active_alerts(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "ACTIVE")


def one_per_key(updates: DataFrame, key: str, newest: str | None) -> DataFrame:
    """Each key once: refused if repeated, or the row with the largest ``newest`` (ties by content)."""
    same = Window.partitionBy(key)
    if newest is None:
        twice = F.raise_error(F.lit(f"updates repeat a {key}")).cast(updates.schema[key].dataType)
        counted = updates.withColumn("_copies", F.count(F.lit(1)).over(same))
        return counted.withColumn(key, F.when(F.col("_copies") > 1, twice).otherwise(F.col(key))).drop("_copies")
    last = same.orderBy(F.col(newest).desc_nulls_last(), F.xxhash64(*updates.columns))
    return updates.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")


def upsert_vectors(target: DataFrame, updates: DataFrame, key: str = "chunk_id", newest: str | None = None) -> DataFrame:
    """Insert or replace by key.

    Updates that repeat a key raise an error; with ``newest`` the row with the largest
    value in that column is taken.
    """
    kept = target.join(updates.select(key), key, "left_anti")
    return kept.unionByName(one_per_key(updates, key, newest), allowMissingColumns=True)


def delete_by(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Hard delete of all rows whose ``on`` occurs in ``keys``."""
    return df.join(broadcast_if_small(keys.select(on).distinct()), on, "left_anti")


def soft_delete_by(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Set ``deleted`` on all rows whose ``on`` occurs in ``keys``."""
    marks = keys.select(on).distinct().withColumn("_gone", F.lit(True))
    return (
        df.join(broadcast_if_small(marks), on, "left")
        .withColumn("deleted", F.when(F.col("_gone"), F.lit(1)).otherwise(F.col("deleted")))
        .select(*df.columns)
    )


def cascade_delete_kb(tables: Mapping[str, DataFrame], kb_ids: DataFrame) -> dict[str, DataFrame]:
    """Mark bases and their documents deleted; drop their chunks and vectors."""
    out = dict(tables)
    for name in ("kbs", "documents"):
        out[name] = soft_delete_by(tables[name], kb_ids, "kb_id")
    for name in ("chunks", "vectors"):
        out[name] = delete_by(tables[name], kb_ids, "kb_id")
    return out


def replace_document_chunks(old: DataFrame, new: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Drop every old chunk of the documents in ``new``, then add the new ones.

    ``touched`` (doc_id) names the documents whose chunks go also where the new
    version has none, as that of a document that became blank.
    """
    touched = (new if touched is None else touched.select("doc_id").unionAll(new.select("doc_id"))).select("doc_id").distinct()
    return old.join(broadcast_if_small(touched), "doc_id", "left_anti").unionByName(
        new, allowMissingColumns=True
    )


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per document and content hash: ``keep``, ``add`` or ``drop``.

    Copies are counted before the join, so equal chunks never multiply.
    """
    key = ["doc_id", "content_hash"]
    a = old.groupBy(*key).agg(F.count(F.lit(1)).alias("old_copies"))
    b = new.groupBy(*key).agg(F.count(F.lit(1)).alias("new_copies"))
    return (
        a.join(b, key, "full_outer")
        .select(
            *key,
            F.coalesce("old_copies", F.lit(0)).cast("bigint").alias("old_copies"),
            F.coalesce("new_copies", F.lit(0)).cast("bigint").alias("new_copies"),
        )
        .withColumn(
            "action",
            F.when(F.col("old_copies") == 0, "add")
            .when(F.col("new_copies") == 0, "drop")
            .otherwise("keep"),
        )
    )


def latest_state(events: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest event per key, by the total order ``order``. One partial aggregation."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in events.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_s")
    return events.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def latest_log(tasks: DataFrame, logs: DataFrame, order: Sequence[str] = ("create_time",)) -> DataFrame:
    """Each task with the newest log of its document."""
    newest = latest_state(logs, "doc_id", order)
    renamed = newest.select(
        "doc_id", *[F.col(c).alias(f"log_{c}") for c in newest.columns if c != "doc_id"]
    )
    return tasks.join(renamed, "doc_id", "left")


def document_stats(chunks: DataFrame) -> DataFrame:
    """Chunk, character and token totals per document."""
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.sum("char_count").cast("bigint").alias("char_count"),
        F.sum("token_count").cast("bigint").alias("token_count"),
    )
