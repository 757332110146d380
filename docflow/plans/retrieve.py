"""Batch retrieval: rewrite, search both ways, fuse, re-rank, expand, quote."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docflow.hooks import Embedder, embed_once
from docflow.operators.retrieval import (
    Scorer,
    attach_chunks,
    evidence_context,
    expand_parent,
    expand_window,
    keyword_topk,
    rerank_lexical,
    rerank_with,
    rewrite_list,
    rrf_fuse,
    vector_topk,
)
from docflow.operators.tables import filter_reranked, filter_score
from docflow.session import MAX_BROADCAST_ROWS, at_most

# Fixed defaults.
TOP_K = 8
THRESHOLD = 0.3
RRF_K = 60
MAX_CONTEXT = 8
_KEYWORD_LEGS = 10_000  # keyword lists rank behind all vector lists


class Retrieval(NamedTuple):
    hits: DataFrame
    contexts: DataFrame


def retrieve(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, embedder: Embedder | None = None, *,
    top_k: int = TOP_K, vector_k: int | None = None, keyword_k: int | None = None,
    threshold: float = THRESHOLD, keyword_threshold: float | None = None, rewrites: int = 1,
    fuse_single: bool = True, rerank: bool = True, scorer: Scorer | None = None,
    rerank_threshold: float = 0.0, expansion: str | None = None, window: int = 1,
    max_context: int = MAX_CONTEXT, by: str | None = None,
) -> Retrieval:
    """Retrieve for a whole batch of queries in one plan.

    ``queries`` has (query_id, query), plus ``response`` for ``rewrites > 1``, plus
    ``embedding`` if there is no embedder. ``chunks`` has (chunk_id, content,
    doc_id, chunk_index, doc_name, heading_path, segment_type), ``vectors``
    (chunk_id, embedding). With ``by`` both sides match on that column only.
    """
    part = [by] if by else []
    # Every stage keeps at most top_k rows per query, so counting the queries bounds them all.
    small = at_most(queries, MAX_BROADCAST_ROWS // (top_k * (2 * window + 1)))
    if rewrites > 1:
        asked = rewrite_list(queries, rewrites).join(queries.select("query_id", *part), "query_id")
    else:
        extra = ["embedding"] if "embedding" in queries.columns else []
        asked = queries.select("query_id", "query", F.lit(0).alias("rewrite_no"), *part, *extra)
    asked = asked.withColumn(
        "_asked", F.concat_ws("#", F.col("query_id").cast("string"), F.col("rewrite_no").cast("string"))
    )
    vec_q = asked if "embedding" in asked.columns else embed_once(asked, "query", embedder)
    names = asked.select(F.col("_asked").alias("_key"), F.col("query_id").alias("_query"), "rewrite_no")

    def leg(hits: DataFrame, limit: float, offset: int) -> DataFrame:
        kept = filter_score(hits, limit)
        return kept.join(names, kept["query_id"] == names["_key"]).select(
            F.col("_query").alias("query_id"),
            (F.col("rewrite_no") + offset).alias("leg"),
            "chunk_id",
            "score",
        )

    vector = leg(
        vector_topk(
            vec_q.select(F.col("_asked").alias("query_id"), "embedding", *part), vectors,
            vector_k or top_k, by,
        ),
        threshold, 0,
    )
    legs = vector
    if fuse_single or rewrites > 1:
        keyword = leg(
            keyword_topk(
                asked.select(F.col("_asked").alias("query_id"), "query", *part), chunks,
                keyword_k or top_k, by,
            ),
            threshold if keyword_threshold is None else keyword_threshold, _KEYWORD_LEGS,
        )
        legs = vector.unionByName(keyword)
        fused = rrf_fuse(legs, top_k, RRF_K).select("query_id", "chunk_id", "score", "rank")
    else:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        fused = vector.drop("leg").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    info = ["content", "doc_id", "chunk_index", "doc_name", "heading_path", "segment_type"]
    if expansion == "parent":
        info.append("parent_id")
    hits = attach_chunks(fused, chunks, info, small).join(queries.select("query_id", "query"), "query_id")
    if scorer is not None:
        hits = filter_reranked(rerank_with(hits, scorer, top_k), rerank_threshold)
    elif rerank:
        hits = filter_reranked(rerank_lexical(hits, top_k), rerank_threshold)
    order = ["rank"]
    shown = hits
    if expansion == "window":
        shown = expand_window(hits, chunks, window, small=small).join(
            hits.groupBy("query_id", "doc_id").agg(F.any_value("doc_name").alias("doc_name")),
            ["query_id", "doc_id"],
        ).withColumn("doc_name", F.coalesce("doc_name", F.lit("Unknown"))).withColumn(
            "heading_path", F.lit(None).cast("string")
        ).withColumn("segment_type", F.lit(None).cast("string"))
        order = ["chunk_index", "chunk_id"]
    elif expansion == "parent":
        shown = expand_parent(hits, chunks, small)
    return Retrieval(shown, evidence_context(shown, max_context, order))
