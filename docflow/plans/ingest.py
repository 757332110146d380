"""Batch ingestion: parse by type, chunk by strategy, embed once, build rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import has_text, strip_edges
from docflow.hooks import Embedder, embed_once, embed_stored
from docflow.operators.chunking import (
    CHUNK_COLUMNS,
    build_chunk_rows,
    chunk,
    chunk_segments,
    chunk_semantic_segments,
    strategy_label,
)
from docflow.operators.markdown import markdown_normalize
from docflow.operators.segments import html_to_markdown, segment_documents
from docflow.session import cut_lineage, stage_by
from docflow.sources.readers import route_by_type

STRUCTURED = ["paragraph", "smart", "paper", "manual", "table"]
ROW_COLUMNS = [*CHUNK_COLUMNS, "segment_type", "heading_level"]


class Ingest(NamedTuple):
    chunks: DataFrame
    vectors: DataFrame
    errors: DataFrame


def parse(documents: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, file_name, text) to plain structured text and an error table.

    Columns in ``keep`` come along, so nothing is joined to a text afterwards.
    """
    registry = {
        "markdown": lambda d: markdown_normalize(d, keep),
        "html": lambda d: html_to_markdown(d, "doc_id", "text", keep),
        "text": lambda d: d.select("doc_id", "text", *keep),
    }
    return route_by_type(documents, registry)


def chunk_structured(docs: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Chunk (doc_id, text, strategy, config) through segments where the strategy uses them."""
    name = F.when(has_text(F.col("strategy")), F.lower(strip_edges(F.col("strategy")))).otherwise(
        "paragraph"
    )
    tagged = docs.withColumn("_name", name)
    cfg = F.try_parse_json(F.col("config"))

    def number(key: str, default: int) -> Column:
        return F.coalesce(F.try_variant_get(cfg, f"$.{key}", "int"), F.lit(default))

    structured = segment_documents(
        tagged.where(F.col("_name").isin(STRUCTURED)), keep=("_name", "config")
    )
    parts = [
        chunk_segments(
            structured, F.col("_name"), number("maxChars", 900), number("overlapParagraphs", 1),
            number("minChunkChars", 180),
        )
    ]
    flat = tagged.where(~F.col("_name").isin([*STRUCTURED, "semantic"]))
    parts.append(chunk(flat, staged=True))
    if embedder is not None:
        semantic = segment_documents(tagged.where(F.col("_name") == "semantic"))
        parts.append(chunk_semantic_segments(semantic, embedder))
    out = None
    for p in parts:
        for c, t in (("segment_type", "string"), ("heading_level", "int")):
            if c not in p.columns:
                p = p.withColumn(c, F.lit(None).cast(t))
        p = p.select(*ROW_COLUMNS)
        out = p if out is None else out.unionByName(p)
    return out


def ingest(
    documents: DataFrame, embedder: Embedder, model: str = "hashing", dimension: int = 64, store: str | None = None
) -> Ingest:
    """Documents (doc_id, kb_id, file_name, text, strategy, config, created_by) to tables.

    Chunk ids follow from document and position, so running it again gives the
    same rows. ``store`` names a table of vectors by content: what it holds is not
    embedded again.
    """
    labelled = documents.withColumn("strategy", strategy_label(F.col("strategy")))
    parsed, errors = parse(labelled, keep=("strategy", "config"))
    pieces = chunk_structured(stage_by(parsed.select("doc_id", "text", "strategy", "config"), "strategy"), embedder)
    info = documents.select(
        "doc_id", "kb_id", F.col("file_name").alias("doc_name"),
        F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1)).alias("file_type"), "created_by",
    )
    # Stored once: the vectors and the caller read the same rows.
    chunks = cut_lineage(build_chunk_rows(info, pieces, model, dimension))
    own = chunks.select("chunk_id", "kb_id", "doc_id", "content")
    vectors = embed_stored(own, "content", embedder, store) if store else embed_once(own, "content", embedder)
    return Ingest(chunks, vectors.select("chunk_id", "kb_id", "doc_id", "embedding"), errors)
