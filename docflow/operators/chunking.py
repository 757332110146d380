"""Chunking: one document row in, its chunk rows out.

All characters of a text are in its chunks; ``max_tokens`` cuts only where it is
given. Every strategy works inside the document row, so a corpus is chunked without a
shuffle. Splitting, joining and classifying are JVM expressions; the packing
rules in ``kernels`` see lengths only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions.bind import let, rows_of, settle
from docflow.functions.records import map_merge
from docflow.functions.structure import chunk_traits, is_heading
from docflow.functions.text import (
    content_hash,
    estimate_tokens,
    has_text,
    strip_edges,
    truncate,
    truncate_to_tokens,
)
from docflow.operators.kernels import pack_segments_udf, pack_udf, split_points_udf
from docflow.session import stage_by

# Fixed values.
SENTENCE_BREAK = r"(?<=[。！？.!?;；])\s*|\n\s*\n+"
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ".", "!", "?", "；", ";", "，", ","]
BLANK_LINE = r"\n\s*\n+"
TRAITS = ["segment_type", "has_code_block", "has_table", "has_list", "heading_level"]


def _col(x: int | float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def text_blocks(text: Column) -> Column:
    """Blocks between blank lines, edges stripped, blank ones dropped."""
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), BLANK_LINE)
    return F.filter(F.transform(parts, strip_edges), has_text)


def fixed_pieces(text: Column, size: int | Column, overlap: int | Column) -> Column:
    """Overlapping pieces of ``size`` characters, in one pass over the text.

    The text is cut into strides; a piece is the head of the strides it covers.
    """
    size = F.greatest(F.lit(100), _col(size))
    overlap = F.greatest(F.lit(0), F.least(_col(overlap), size - 1))
    stride = size - overlap
    cut = F.concat(F.lit("(?s).{1,"), stride.cast("string"), F.lit("}"))
    covered = F.ceil(size / stride).cast("int")
    return let(
        F.regexp_extract_all(text, cut, F.lit(0)),
        lambda strides: F.transform(
            strides,
            lambda _, i: F.substring(
                F.array_join(F.slice(strides, i + 1, covered), ""), F.lit(1), size
            ),
        ),
    )


def _finish(df: DataFrame, strategy: str | Column | None = None) -> DataFrame:
    """Add chunk traits to (doc_id, chunk_index, content, heading_path)."""
    traits = chunk_traits(F.col("content"), F.col("heading_path"))
    out = df.withColumn("_t", traits).select(
        "doc_id", "chunk_index", "content", "heading_path", *[F.col(f"_t.{t}") for t in TRAITS]
    )
    return out.withColumn("chunk_strategy", _col(strategy) if strategy is not None else F.lit(None).cast("string"))


def _text() -> Column:
    """The text, null where it is blank: a null text has no chunks."""
    return F.when(has_text(F.col("text")), F.col("text"))


def _no_path() -> Column:
    return F.lit(None).cast("string")


def chunk_fixed(
    df: DataFrame, size: int | Column = 500, overlap: int | Column = 50, max_tokens: int | None = None
) -> DataFrame:
    """Pieces of equal size; the last one may lie inside the previous overlap."""
    pieces = rows_of(df, ["doc_id"], fixed_pieces(_text(), size, overlap), "chunk_index", "content")
    return _finish(
        pieces.withColumn("content", truncate_to_tokens(F.col("content"), max_tokens)).withColumn(
            "heading_path", _no_path()
        )
    )


def chunk_parent_child(
    df: DataFrame, parent_size: int | Column = 1000, child_size: int | Column = 300,
    overlap: int | Column = 50, max_tokens: int | None = None,
) -> DataFrame:
    """Large pieces, each followed by its own small pieces. Ids come from positions."""
    cut = lambda c: truncate_to_tokens(c, max_tokens)

    def family(parent: Column, i: Column) -> Column:
        head = F.concat(F.col("doc_id").cast("string"), F.lit(":p"), i.cast("string"))
        none = F.lit(None).cast("string")
        return let(
            cut(parent),
            lambda text: F.concat(
                F.array(
                    F.struct(head.alias("chunk_id"), none.alias("parent_id"), text.alias("content"))
                ),
                F.transform(
                    fixed_pieces(text, child_size, overlap),
                    lambda c, j: F.struct(
                        F.concat(head, F.lit(":c"), j.cast("string")).alias("chunk_id"),
                        head.alias("parent_id"),
                        cut(c).alias("content"),
                    ),
                ),
            ),
        )

    families = F.transform(fixed_pieces(_text(), parent_size, overlap), family)
    rows = rows_of(df, ["doc_id"], F.flatten(families), "chunk_index", "_c")
    traits = chunk_traits(F.col("_c.content"), _no_path())
    return rows.select(
        "doc_id",
        "chunk_index",
        "_c.content",
        "_c.chunk_id",
        "_c.parent_id",
        F.col("_c.parent_id").isNull().alias("is_parent"),
        F.col("_c.parent_id").isNotNull().alias("is_child"),
        traits.alias("_t"),
    ).select(
        "doc_id", "chunk_index", "content", "chunk_id", "parent_id", "is_parent", "is_child",
        *[F.col(f"_t.{t}") for t in TRAITS],
    )


def chunk_paragraph(
    df: DataFrame, max_chars: int | Column = 900, overlap: int | Column = 1,
    min_chars: int | Column = 180, max_tokens: int | None = None, strategy: str | Column | None = None,
) -> DataFrame:
    """Paragraphs packed up to ``max_chars``; headings are carried, not packed."""
    base = df.select(
        "doc_id",
        "text",
        text_blocks(_text()).alias("_blocks"),
        F.greatest(F.lit(200), _col(max_chars)).alias("_max"),
        _col(min_chars).alias("_min"),
        F.greatest(F.lit(0), _col(overlap)).alias("_ov"),
    )
    marked = settle(base).withColumn(
        "_b",
        F.transform(
            "_blocks", lambda b, i: F.struct(b.alias("t"), i.alias("i"), is_heading(b).alias("h"))
        ),
    )
    whole = F.array(
        F.struct(strip_edges(F.col("text")).alias("t"), F.lit(-1).alias("i"), F.lit(False).alias("h"))
    )
    split = (
        settle(marked).withColumn("_heads", F.transform(F.filter("_b", lambda x: x["h"]), lambda x: x["i"]))
        .withColumn("_paras", F.filter("_b", lambda x: ~x["h"]))
        .withColumn("_paras", F.when(F.size("_paras") == 0, whole).otherwise(F.col("_paras")))
        .withColumn("_texts", F.transform("_paras", lambda p: p["t"]))
    )
    packed = settle(split).withColumn(
        "_ranges",
        pack_udf(
            F.transform("_texts", F.length), F.transform("_paras", lambda p: p["i"]), "_heads",
            "_max", "_min", "_ov",
        ),
    )
    chunks = F.transform(
        "_ranges",
        lambda r: F.struct(
            F.array_join(F.slice("_texts", r["s"] + 1, r["e"] - r["s"]), "\n\n").alias("content"),
            F.get("_blocks", r["head"]).alias("heading_path"),
        ),
    )
    rows = rows_of(packed, ["doc_id"], chunks, "chunk_index", "_c").select(
        "doc_id",
        "chunk_index",
        truncate_to_tokens(F.col("_c.content"), max_tokens).alias("content"),
        "_c.heading_path",
    )
    return _finish(rows, strategy)


def chunk_segments(
    docs: DataFrame, strategy: str | Column = "paragraph", max_chars: int | Column = 900,
    overlap: int | Column = 1, min_chars: int | Column = 180, max_tokens: int | None = None,
) -> DataFrame:
    """Segments packed into chunks that respect headings and the strategy.

    ``docs`` has (doc_id, segments) as built by ``segment_documents``. Strategy
    ``paper`` also closes a chunk before tables, figures and captions, ``table``
    isolates tables and captions.
    """
    how = _col(strategy)
    usable = F.filter("segments", lambda s: has_text(s["content"]))
    plain = F.filter("segments", lambda s: has_text(s["content"]) & (s["type"] != "heading"))
    only_heads = F.size(plain) == 0
    base = docs.select(
        "doc_id",
        let(plain, lambda u: F.when(F.size(u) > 0, u).otherwise(let(usable, _headings_as_text))).alias("_u"),
        F.when(~only_heads, how).alias("_how"),
        F.when(only_heads, 900).otherwise(F.greatest(F.lit(200), _col(max_chars))).alias("_max"),
        F.when(only_heads, 180).otherwise(_col(min_chars)).alias("_min"),
        F.when(only_heads, 1).otherwise(F.greatest(F.lit(0), _col(overlap))).alias("_ov"),
    )
    packed = settle(base).withColumn(
        "_ranges",
        pack_segments_udf(
            F.transform("_u", lambda s: F.length(s["content"])),
            F.transform("_u", lambda s: s["type"]),
            F.transform("_u", lambda s: s["heading_path"]),
            "_how", "_max", "_min", "_ov",
        ),
    )

    def part(r: Column) -> Column:
        return F.slice("_u", r["s"] + 1, r["e"] - r["s"])

    def first(values: Column) -> Column:
        return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))

    chunks = F.transform(
        "_ranges",
        lambda r: F.struct(
            F.array_join(F.transform(part(r), lambda s: s["content"]), "\n\n").alias("content"),
            first(
                F.transform(part(r), lambda s: F.when(has_text(s["heading_path"]), s["heading_path"]))
            ).alias("heading_path"),
            F.element_at(F.transform(part(r), lambda s: s["type"]), -1).alias("kind"),
            first(F.transform(part(r), lambda s: s["heading_level"])).alias("level"),
        ),
    )
    rows = (
        rows_of(packed, ["doc_id", "_how"], chunks, "chunk_index", "_c")
        .select(
            "doc_id",
            "chunk_index",
            truncate_to_tokens(F.col("_c.content"), max_tokens).alias("content"),
            "_c.heading_path",
            F.col("_c.kind").alias("_kind"),
            F.col("_c.level").alias("_level"),
            "_how",
        )
        .withColumn("_t", chunk_traits(F.col("content"), F.col("heading_path")))
        .select(
            "doc_id",
            "chunk_index",
            "content",
            "heading_path",
            F.coalesce("_kind", "_t.segment_type").alias("segment_type"),
            "_t.has_code_block",
            "_t.has_table",
            "_t.has_list",
            F.coalesce("_level", "_t.heading_level").alias("heading_level"),
            F.col("_how").alias("chunk_strategy"),
        )
    )
    return rows


def _headings_as_text(all_: Column) -> Column:
    """Units of a document that has headings only: packed as plain paragraphs.

    Over-long headings count as paragraphs under the last short one; without
    any, the whole is one paragraph.
    """
    def unit(content: Column, path: Column, kind: Column, level: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            none.alias("segment_id"), kind.alias("type"), content.alias("content"),
            path.alias("heading_path"), F.lit(0).alias("start_order"), F.lit(0).alias("end_order"),
            level.alias("heading_level"), none.alias("table_markdown"), none.alias("doc_type"),
        )

    none, no_level = F.lit(None).cast("string"), F.lit(None).cast("int")
    whole = unit(F.array_join(F.transform(all_, lambda s: s["content"]), "\n\n"), none, none, no_level)

    def above(i: Column) -> Column:
        heads = F.filter(F.slice(all_, F.lit(1), i), lambda s: is_heading(s["content"]))
        return F.get(heads, F.size(heads) - 1)["content"]

    placed = F.transform(all_, lambda s, i: unit(s["content"], above(i), none, no_level))
    long = F.filter(placed, lambda s: ~is_heading(s["content"]))
    return F.when(F.size(all_) == 0, F.filter(F.array(whole), lambda _: F.lit(False))).when(
        F.size(long) > 0, long
    ).otherwise(F.array(whole))


def piece_spans(text: str, limit: int) -> list[tuple[int, int]]:
    """Positions (begin, end) of pieces of at most ``limit`` characters where separators allow.

    A span that is too long is cut at the marks of the first separator in it; parts
    between marks are packed again up to the limit, and packs go on with the finer
    separators. Empty parts at the head of a pack are left out.
    """
    spans, todo = [], [(0, len(text), 0)]
    while todo:
        begin, end, level = todo.pop()
        if end - begin > limit:
            level = next((i for i in range(level, len(SEPARATORS)) if text.find(SEPARATORS[i], begin, end) >= 0), None)
        if end - begin <= limit or level is None:
            spans.append((begin, end))
            continue
        mark, packs, head, tail = SEPARATORS[level], [], begin, begin
        while begin <= end:
            stop = text.find(mark, begin, end)
            stop = end if stop < 0 else stop
            if tail > head and stop - head > limit:
                packs.append((head, tail, level + 1))
                head = begin
            elif tail == head:
                head = begin
            tail, begin = stop, stop + len(mark)
        packs.append((head, tail, level + 1))
        todo.extend(pack for pack in reversed(packs) if pack[1] > pack[0])
    return spans


@F.pandas_udf(T.ArrayType(T.StructType().add("s", T.IntegerType()).add("n", T.IntegerType())))
def _spans_udf(text: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series(
        [[] if t is None else [{"s": a, "n": b - a} for a, b in piece_spans(t, n)] for t, n in zip(text, limit)]
    )


def chunk_recursive(
    df: DataFrame, max_chars: int | Column = 1000, max_tokens: int | None = None
) -> DataFrame:
    """Split at ever finer separators until the pieces fit; no overlap.

    Texts that already fit stay in the JVM.
    """
    limit = _col(max_chars) if max_tokens is None else F.least(_col(max_chars), F.lit(max_tokens * 4))
    fits = F.length("text") <= limit
    spans = settle(df.select(
        "doc_id", "text", fits.alias("_fits"), _spans_udf(F.when(~fits, _text()), limit).alias("_spans")
    ))
    cut = F.transform("_spans", lambda x: F.substring(F.col("text"), x["s"] + 1, x["n"]))
    pieces = F.when(F.col("_fits"), F.when(has_text(F.col("text")), F.array("text"))).otherwise(cut)
    rows = rows_of(spans, ["doc_id"], pieces, "chunk_index", "content")
    return _finish(
        rows.withColumn("content", truncate_to_tokens(F.col("content"), max_tokens)).withColumn(
            "heading_path", _no_path()
        )
    )


def sentences(
    text: Column, min_chars: int | Column = 1, max_chars: int | Column = 500
) -> Column:
    """Sentences of at least ``min_chars`` (all, unless asked otherwise); longer ones than ``max_chars`` are cut hard."""
    parts = F.transform(F.split(text, SENTENCE_BREAK), strip_edges)
    kept = F.filter(parts, lambda p: F.length(p) >= _col(min_chars))
    hard = F.concat(F.lit("(?s).{1,"), _col(max_chars).cast("string"), F.lit("}"))
    return F.flatten(F.transform(kept, lambda p: F.regexp_extract_all(p, hard, F.lit(0))))


def split_sentences(df: DataFrame, min_chars: int = 1, max_chars: int = 500) -> DataFrame:
    found = sentences(F.col("text"), min_chars, max_chars)
    return rows_of(df, ["doc_id"], found, "sentence_no", "sentence")


Embedder = Callable[[list[str]], np.ndarray]


def _neighbour_similarity(embedder: Embedder, batch_size: int):
    """UDF: texts of a document -> cosine of each text with the next one.

    Null if the embedder fails, so that the caller can pack by length instead.
    """

    def similarity(texts: list[str]) -> list[float] | None:
        try:
            vectors = np.vstack(
                [
                    np.asarray(embedder(texts[i : i + batch_size]), dtype=np.float64)
                    for i in range(0, len(texts), batch_size)
                ]
            )
        except Exception:  # noqa: BLE001 - any embedder failure means pack by length
            return None
        norm = np.linalg.norm(vectors, axis=1)
        dot = (vectors[:-1] * vectors[1:]).sum(axis=1)
        scale = norm[:-1] * norm[1:]
        return np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0).tolist()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([similarity(list(t)) if t is not None and len(t) else [] for t in batch])

    return run


def _ranges_of(starts: Column, items: Column) -> Column:
    """Start positions to slices of ``items``."""
    return F.transform(
        starts,
        lambda s, i: F.slice(
            items, s + 1, F.coalesce(F.get(starts, i + 1), F.size(items)) - s
        ),
    )


def _semantic_rows(rows: DataFrame, max_tokens: int | None) -> DataFrame:
    content = truncate_to_tokens(F.col("_content"), max_tokens)
    return rows.withColumn("content", content).drop("_content").withColumn(
        "chunk_strategy", F.lit("semantic")
    ).withColumn("char_count", F.length("content")).withColumn(
        "token_count", estimate_tokens(F.col("content"))
    )


def chunk_semantic(
    df: DataFrame, embedder: Embedder, threshold: float | Column = 0.5, min_chars: int | Column = 100,
    max_chars: int | Column = 1500, min_sentence: int | Column = 1, max_sentence: int | Column = 500,
    max_tokens: int | None = None, batch_size: int = 20,
) -> DataFrame:
    """Sentences joined until the topic changes or the chunk is full."""
    base = df.select(
        "doc_id", sentences(_text(), min_sentence, max_sentence).alias("_s"),
        _col(threshold).cast("double").alias("_th"), _col(max_chars).alias("_max"), _col(min_chars).alias("_min"),
    )
    starts = split_points_udf(
        F.transform("_s", F.length),
        _neighbour_similarity(embedder, batch_size)("_s"),
        F.lit(None).cast("array<string>"),
        "_th", "_max", "_min", F.lit(1),
    )
    rows = rows_of(
        settle(base).withColumn("_starts", starts), ["doc_id"],
        _ranges_of(F.col("_starts"), F.col("_s")), "chunk_index", "_p",
    )
    return _semantic_rows(
        rows.select("doc_id", "chunk_index", F.array_join("_p", " ").alias("_content"),
                    _no_path().alias("heading_path")),
        max_tokens,
    ).select("doc_id", "chunk_index", "content", "heading_path", "chunk_strategy", "char_count", "token_count")


def chunk_semantic_segments(
    docs: DataFrame, embedder: Embedder, threshold: float = 0.5, min_chars: int = 100,
    max_chars: int = 1500, max_tokens: int | None = None, batch_size: int = 20,
) -> DataFrame:
    """As ``chunk_semantic`` over segments; a new heading path also closes a chunk."""
    plain = F.filter("segments", lambda s: has_text(s["content"]) & (s["type"] != "heading"))
    base = docs.select("doc_id", plain.alias("_u"))
    texts = F.transform("_u", lambda s: s["content"])
    starts = split_points_udf(
        F.transform("_u", lambda s: F.length(s["content"])),
        _neighbour_similarity(embedder, batch_size)(texts),
        F.transform("_u", lambda s: F.coalesce(F.when(has_text(s["heading_path"]), s["heading_path"]), F.lit(""))),
        F.lit(float(threshold)), F.lit(max_chars), F.lit(min_chars), F.lit(2),
    )
    rows = rows_of(
        settle(base).withColumn("_starts", starts), ["doc_id"],
        _ranges_of(F.col("_starts"), F.col("_u")), "chunk_index", "_p",
    )
    paths = F.filter(F.transform("_p", lambda s: s["heading_path"]), has_text)
    return _semantic_rows(
        rows.select(
            "doc_id", "chunk_index",
            F.array_join(F.transform("_p", lambda s: s["content"]), "\n\n").alias("_content"),
            F.get(paths, F.lit(0)).alias("heading_path"),
            F.element_at("_p", -1)["type"].alias("segment_type"),
            F.element_at("_p", -1)["segment_id"].alias("segment_id"),
        ),
        max_tokens,
    ).select("doc_id", "chunk_index", "content", "heading_path", "segment_type", "segment_id",
             "chunk_strategy", "char_count", "token_count")


def chunk_pack(
    df: DataFrame, max_chars: int = 1500, max_tokens: int | None = None, min_sentence: int = 1,
    max_sentence: int = 500,
) -> DataFrame:
    """Sentences packed by length only."""
    base = df.select("doc_id", sentences(_text(), min_sentence, max_sentence).alias("_s"))
    starts = split_points_udf(
        F.transform("_s", F.length), F.lit(None).cast("array<double>"),
        F.lit(None).cast("array<string>"), F.lit(0.0), F.lit(max_chars), F.lit(0), F.lit(1),
    )
    rows = rows_of(
        settle(base).withColumn("_starts", starts), ["doc_id"],
        _ranges_of(F.col("_starts"), F.col("_s")), "chunk_index", "_p",
    )
    return _semantic_rows(
        rows.select("doc_id", "chunk_index", F.array_join("_p", " ").alias("_content"),
                    _no_path().alias("heading_path")),
        max_tokens,
    ).select("doc_id", "chunk_index", "content", "heading_path", "chunk_strategy", "char_count", "token_count")


STRATEGIES = ["fixed", "parent-child", "paper", "manual", "table", "paragraph", "smart", "recursive", "semantic"]


def strategy_label(strategy: Column) -> Column:
    """One of the strategies, "" for none or ``unknown``: a bounded number of values to lay rows out by."""
    name = F.lower(strip_edges(strategy))
    return F.when(~F.coalesce(has_text(strategy), F.lit(False)), "").when(name.isin(STRATEGIES), name).otherwise("unknown")


CHUNK_COLUMNS = ["doc_id", "chunk_index", "content", "heading_path", "chunk_strategy"]


def chunk(
    df: DataFrame, strategy_col: str = "strategy", config_col: str = "config",
    embedder: Embedder | None = None, staged: bool = False,
) -> DataFrame:
    """Chunk each document by its own strategy and JSON configuration.

    One filtered branch per strategy; settings are read per row. An unknown
    strategy packs paragraphs with the defaults. The documents are laid out by
    strategy first, so a branch reads its own ones only; ``staged`` says that
    they already are.
    """
    if not staged:
        df = stage_by(df.withColumn(strategy_col, strategy_label(F.col(strategy_col))), strategy_col)
    name = F.lower(strip_edges(F.col(strategy_col)))
    d = df.withColumn("_name", F.when(has_text(F.col(strategy_col)), name).otherwise("paragraph"))
    cfg = F.try_parse_json(F.col(config_col))

    def number(key: str, default: int) -> Column:
        return F.coalesce(F.try_variant_get(cfg, f"$.{key}", "int"), F.lit(default))

    known = [n for n in STRATEGIES if n != "semantic"]
    of = lambda *names: d.where(F.col("_name").isin(*names))
    packing = dict(
        max_chars=number("maxChars", 900), overlap=number("overlapParagraphs", 1),
        min_chars=number("minChunkChars", 180),
    )
    branches = [
        chunk_fixed(of("fixed"), number("chunkSize", 500), number("overlap", 50)),
        chunk_parent_child(
            of("parent-child"), number("parentSize", 1000), number("childSize", 300), number("overlap", 50)
        ).withColumn("heading_path", _no_path()).withColumn("chunk_strategy", _no_path()),
        chunk_recursive(of("recursive"), number("maxChars", 1000)),
        chunk_paragraph(of("paragraph", "smart"), **packing),
        *[chunk_paragraph(of(s), strategy=s, **packing) for s in ("paper", "manual", "table")],
    ]
    rest = known
    if embedder is not None:
        rest = [*known, "semantic"]
        branches.append(
            chunk_semantic(
                of("semantic"), embedder,
                F.coalesce(F.try_variant_get(cfg, "$.similarityThreshold", "double"), F.lit(0.5)),
                number("minChunkChars", 100), number("maxChunkChars", 1500),
                number("minSentenceChars", 1), number("maxSentenceChars", 500),
            )
        )
    branches.append(chunk_paragraph(d.where(~F.col("_name").isin(*rest))))
    out = branches[0].select(*CHUNK_COLUMNS)
    for b in branches[1:]:
        out = out.unionByName(b.select(*CHUNK_COLUMNS))
    return out


def build_chunk_rows(docs: DataFrame, chunks: DataFrame, model: str, dimension: int) -> DataFrame:
    """Chunk records with hash, sizes and vector metadata.

    ``docs`` has (doc_id, kb_id, doc_name, file_type, created_by). Chunk metadata
    overrides document metadata of the same name.
    """
    info = docs.select("doc_id", "kb_id", "doc_name", "file_type", "created_by")
    rows = chunks.join(info, "doc_id")
    chunk_id = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    text = lambda c: F.col(c).cast("string")
    base = F.create_map(
        F.lit("kbId"), text("kb_id"), F.lit("docId"), text("doc_id"), F.lit("chunkId"), chunk_id,
        F.lit("chunkIndex"), text("chunk_index"), F.lit("docName"), F.col("doc_name"),
        F.lit("docType"), F.col("file_type"), F.lit("createdBy"), text("created_by"),
        F.lit("embeddingModel"), F.lit(model), F.lit("embeddingDimension"), F.lit(str(dimension)),
    )
    names = {"heading_path": "headingPath", "segment_type": "segmentType",
             "heading_level": "headingLevel", "chunk_strategy": "chunkStrategy"}
    own = F.map_filter(
        F.create_map(*[x for c, k in names.items() if c in chunks.columns for x in (F.lit(k), text(c))]),
        lambda _, v: v.isNotNull(),
    )
    return rows.select(
        chunk_id.alias("chunk_id"), "kb_id", "doc_id", "chunk_index", "content",
        content_hash(F.col("content")).alias("content_hash"),
        F.length("content").cast("bigint").alias("char_count"),
        estimate_tokens(F.col("content")).alias("token_count"),
        F.lit(1).alias("enabled"), F.lit(0).alias("deleted"),
        map_merge(base, own).alias("metadata"),
    )


def preview(rows: DataFrame, index: str, limit: int | None, default: int, hard: int, chars: int = 600) -> DataFrame:
    """First rows of every document, text abbreviated. ``index`` is dense from 0."""
    n = default if limit is None else max(1, min(limit, hard))
    return rows.where(F.col(index) < n).withColumn(
        "content", truncate(F.col("content"), chars, "...")
    )
