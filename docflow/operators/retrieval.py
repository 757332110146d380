"""Vector and keyword search, fusion, re-ranking, context expansion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions.terms import lexical_score, rerank_terms
from docflow.functions.text import has_text, strip_edges
from docflow.operators.keyword_index import keyword_topk
from docflow.operators.topk import cut
from docflow.operators.vector_scan import SCORE_DIGITS, vector_topk
from docflow.session import broadcast_if_small

__all__ = [
    "attach_chunks", "evidence_context", "expand_parent", "expand_window", "keyword_topk", "rerank_lexical",
    "rerank_with", "rewrite_list", "rrf_fuse", "to_citations", "vector_topk",
]

def rrf_fuse(legs: DataFrame, top_k: int, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of result lists.

    ``legs`` has (query_id, leg, chunk_id, score); a list is one (query_id, leg)
    and is a top-k result, so ranking it is bounded. The payload of a chunk that
    occurs in several lists is that of the first one.
    """
    w = Window.partitionBy("query_id", "leg").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    ranked = legs.withColumn("_rank", F.row_number().over(w))
    fused = ranked.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("_rank"))), SCORE_DIGITS).alias("score"),
        F.min("leg").alias("first_leg"),
        F.min_by("score", "leg").alias("first_score"),
        F.count(F.lit(1)).alias("lists"),
    )
    return cut(fused, top_k)


def _small_side(df: DataFrame, small: bool | None) -> DataFrame:
    """Broadcast if the caller has proven a bound, probe if it has not."""
    return broadcast_if_small(df) if small is None else F.broadcast(df) if small else df


def attach_chunks(
    hits: DataFrame, chunks: DataFrame, columns: Sequence[str] = ("content",), small: bool | None = None
) -> DataFrame:
    """Add chunk columns to hits. Few hits travel to the chunks, which are not shuffled.

    ``small`` says that the caller knows the hits to be few (or not); otherwise
    they are counted up to the bound.
    """
    side = chunks.select("chunk_id", *columns)
    return side.join(_small_side(hits, small), "chunk_id").select(*hits.columns, *columns)


def rerank_lexical(
    hits: DataFrame, k: int, retrieval_weight: float = 0.8, lexical_weight: float = 0.2
) -> DataFrame:
    """Blend the retrieval score with the share of query terms found in the content."""
    blended = F.col("score") * F.lit(retrieval_weight) + lexical_score(
        F.col("content"), F.col("_terms")
    ) * F.lit(lexical_weight)
    scored = hits.withColumn("_terms", rerank_terms(F.col("query"))).withColumn("score", blended)
    return cut(scored.drop("_terms", "rank"), k)


Scorer = Callable[[list[str], list[str]], Sequence[float]]


def rerank_with(hits: DataFrame, scorer: Scorer, k: int) -> DataFrame:
    """Re-rank by an external pairwise scorer ``(queries, contents) -> scores``.

    Pairs are scored in Arrow batches wherever they are; candidates are never
    gathered. A batch that fails is scored again query by query, and of a query
    that fails its pairs one by one, so no query suffers from its neighbours. If
    any pair of a query fails, the whole query falls back to its original scores.
    """
    base = hits.drop("rank")
    fields = base.schema.fields + [T.StructField("_new", T.DoubleType())]

    def scores(queries: list[str], contents: list[str]) -> list[float] | None:
        try:
            new = [float(s) for s in scorer(queries, contents)]
        except Exception:  # noqa: BLE001 - any scorer failure means fall back
            return None
        return new if len(new) == len(queries) else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, contents = batch["query"].to_pylist(), batch["content"].to_pylist()
            new: list[float | None] | None = scores(queries, contents)
            if new is None:
                new = [None] * batch.num_rows
                by_query: dict = {}
                for i, q in enumerate(batch["query_id"].to_pylist()):
                    by_query.setdefault(q, []).append(i)
                for rows in by_query.values():
                    part = scores([queries[i] for i in rows], [contents[i] for i in rows])
                    if part is None:
                        part = [(scores([queries[i]], [contents[i]]) or [None])[0] for i in rows]
                    for i, s in zip(rows, part, strict=True):
                        new[i] = s
            yield batch.append_column("_new", pa.array(new, pa.float64()))

    scored = base.mapInArrow(score, T.StructType(fields))
    ok = scored.groupBy("query_id").agg(F.bool_and(F.col("_new").isNotNull()).alias("_ok"))
    final = (
        scored.join(ok, "query_id")
        .withColumn("score", F.when(F.col("_ok"), F.col("_new")).otherwise(F.col("score")))
        .select(*base.columns)
    )
    return cut(final, k)


def expand_window(
    hits: DataFrame, chunks: DataFrame, w: int = 1, keep_score: bool = False, small: bool | None = None
) -> DataFrame:
    """Neighbours ``index - w .. index + w`` of every hit, each chunk once per query.

    Scores become 1.0; ``keep_score`` keeps the best score of the covering hits.
    """
    around = hits.select(
        "query_id",
        "doc_id",
        F.explode(
            F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - w), F.col("chunk_index") + w)
        ).alias("chunk_index"),
        "score",
    )
    wanted = around.groupBy("query_id", "doc_id", "chunk_index").agg(F.max("score").alias("score"))
    if not keep_score:
        wanted = wanted.withColumn("score", F.lit(1.0))
    side = chunks.select("doc_id", "chunk_index", "chunk_id", "content")
    return side.join(_small_side(wanted, small), ["doc_id", "chunk_index"]).select(
        "query_id", "chunk_id", "doc_id", "chunk_index", "content", "score"
    )


def expand_parent(hits: DataFrame, chunks: DataFrame, small: bool | None = None) -> DataFrame:
    """Swap a child for its parent chunk where the parent exists; keep the score.

    Null is one key, so hits without a parent would all meet in one task; a second key
    deals them out by what they hold. It is 0 for all others.
    """
    zero = F.pmod(F.xxhash64("parent_id"), F.lit(1))
    alone = F.col("parent_id").isNull()
    dealt = hits.withColumn("_deal", F.when(alone, F.xxhash64("chunk_id", "content")).otherwise(zero))
    wanted = hits.where(~alone).select("parent_id").distinct().withColumn("_deal", zero)
    parents = (
        chunks.select(
            F.col("chunk_id").alias("parent_id"),
            F.col("content").alias("_content"),
            F.col("chunk_index").alias("parent_index"),
        )
        .withColumn("_deal", zero)
        .join(_small_side(wanted, small), ["parent_id", "_deal"], "left_semi")
    )
    found = F.col("_content").isNotNull()
    rest = [c for c in hits.columns if c not in ("chunk_id", "content", "parent_id")]
    return dealt.join(parents, ["parent_id", "_deal"], "left").select(
        F.when(found, F.col("parent_id")).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.coalesce("_content", "content").alias("content"),
        *rest,
        found.alias("is_parent"),
        "parent_index",
    )


def to_citations(hits: DataFrame, snippet_chars: int | None = 200) -> DataFrame:
    """Typed citation fields from chunk metadata; ``None`` keeps the whole content."""
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    text = F.col("content") if snippet_chars is None else F.substring("content", 1, snippet_chars)
    return hits.select(
        "query_id",
        "chunk_id",
        meta("docId").alias("doc_id"),
        meta("docName").alias("doc_name"),
        meta("chunkIndex").try_cast("int").alias("chunk_index"),
        meta("headingPath").alias("heading_path"),
        meta("segmentType").alias("segment_type"),
        meta("headingLevel").try_cast("int").alias("heading_level"),
        "score",
        text.alias("snippet" if snippet_chars is not None else "content"),
    )


def evidence_context(hits: DataFrame, m: int, order: Sequence[str] = ("rank",)) -> DataFrame:
    """First ``m`` results of each query as one labelled text block.

    ``hits`` has doc_name, chunk_index, heading_path, segment_type and content.
    At most ``m`` rows of a query are gathered.
    """
    label = F.coalesce((F.col("chunk_index") + 1).cast("string"), F.col("chunk_id").cast("string"))
    kind, path = F.col("segment_type"), F.col("heading_path")
    block = F.concat(
        F.lit("["),
        label,
        F.lit("] "),
        F.coalesce("doc_name", F.lit("Unknown Document")),
        F.when(has_text(kind), F.concat(F.lit(" <"), kind, F.lit(">"))).otherwise(""),
        F.when(has_text(path), F.concat(F.lit(" "), path)).otherwise(""),
        F.lit("\n"),
        F.col("content"),
    )
    w = Window.partitionBy("query_id").orderBy(*order)
    first = hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= m)
    blocks = F.array_sort(F.collect_list(F.struct("_rn", block.alias("text"))))
    return first.groupBy("query_id").agg(
        F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n").alias("context"),
        F.count(F.lit(1)).alias("blocks"),
    )


def rewrite_list(queries: DataFrame, count: int, max_chars: int | None = None) -> DataFrame:
    """The query itself, then its rewrites: (query_id, rewrite_no, query).

    ``queries`` has (query_id, query, response); a response line is one rewrite,
    cut to ``max_chars`` if given, and the list ends at ``count`` entries.
    """
    lines = F.transform(
        F.split(F.coalesce("response", F.lit("")), "\n"),
        lambda s: strip_edges(s) if max_chars is None else F.substring(strip_edges(s), 1, max_chars),
    )
    usable = F.filter(lines, lambda s: has_text(s) & (s != F.col("query")))
    more = F.slice(usable, 1, max(count - 1, 1))
    only = F.array(F.col("query"))
    whole = (
        only
        if count <= 1
        else F.when(has_text(F.col("query")), F.concat(only, more)).otherwise(only)
    )
    return queries.select("query_id", F.posexplode(whole).alias("rewrite_no", "query"))
