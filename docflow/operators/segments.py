"""Pages and texts to logical segments."""

from __future__ import annotations

from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions.bind import let, rows_of, settle
from docflow.functions.structure import block_type, markdown_level, markdown_title
from docflow.functions.text import has_text, normalize_ws
from docflow.operators.chunking import text_blocks
from docflow.operators.kernels import heading_stack_udf
from docflow.operators.ordered import last_known, ordered, running_min, running_sum, slicing
from docflow.operators.ordered import lag as lag_of

MAX_LEVEL = 6

_INT, _TEXT = T.IntegerType(), T.StringType()
_SPAN = T.StructType([T.StructField("s", _INT), T.StructField("e", _INT)])
PIECES = T.ArrayType(
    T.StructType(
        [T.StructField("kind", _TEXT), T.StructField("no", _INT), T.StructField("parts", T.ArrayType(_SPAN))]
    )
)


def segment_documents(df: DataFrame, doc_type: str = "md", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with its segments as an array (doc_id, *keep, segments).

    Runs inside the document row: no shuffle. Consecutive list blocks merge.
    """
    blocks = df.select(
        "doc_id",
        *keep,
        F.transform(
            text_blocks(F.coalesce("text", F.lit(""))),
            lambda b: F.struct(b.alias("t"), markdown_level(b).alias("level"), block_type(b).alias("kind")),
        ).alias("_b"),
    )
    # Texts without headings, the majority, send nothing to Python.
    has_headings = F.exists("_b", lambda b: b["level"] > 0)
    levels = F.when(has_headings, F.transform("_b", lambda b: b["level"]))
    stacked = settle(blocks).withColumn("_stack", heading_stack_udf(levels))

    def path(i: Column) -> Column:
        above = F.get("_stack", i)
        names = F.transform(above, lambda h: markdown_title(F.col("_b")[h]["t"]))
        return F.when(F.size(above) > 0, F.array_join(names, " > "))

    def is_list(i: Column) -> Column:
        b = F.col("_b")[i]
        return (b["level"] == 0) & (b["kind"] == "list")

    starts = F.filter(
        F.sequence(F.lit(0), F.size("_b") - 1), lambda i: (i == 0) | ~is_list(i) | ~is_list(i - 1)
    )
    runs = stacked.withColumn("_starts", F.when(F.size("_b") > 0, starts).otherwise(F.array().cast("array<int>")))

    def segment(s: Column, n: Column) -> Column:
        end = F.coalesce(F.get("_starts", n + 1), F.size("_b")) - 1
        b = F.col("_b")[s]
        kind = F.when(b["level"] > 0, "heading").otherwise(b["kind"])
        content = F.array_join(
            F.transform(F.slice("_b", s + 1, end - s + 1), lambda x: x["t"]), "\n"
        )
        return F.struct(
            F.concat(F.lit("seg-"), s.cast("string")).alias("segment_id"),
            kind.alias("type"),
            content.alias("content"),
            path(s).alias("heading_path"),
            s.alias("start_order"),
            end.alias("end_order"),
            F.when(b["level"] > 0, b["level"]).alias("heading_level"),
            F.when(kind == "table", content).alias("table_markdown"),
            F.lit(doc_type).alias("doc_type"),
        )

    return settle(
        settle(runs).select("doc_id", *keep, F.transform("_starts", segment).alias("segments"))
    )


def segment_text(df: DataFrame, doc_type: str = "md") -> DataFrame:
    """One row per segment, in document order."""
    nested = segment_documents(df, doc_type)
    return rows_of(nested, ["doc_id"], F.col("segments"), "segment_no", "s").select(
        "doc_id", "segment_no", "s.*"
    )


def heading_paths(blocks: DataFrame, order: str = "block_no", bounded: bool = False) -> DataFrame:
    """Heading path of every block row (doc_id, order, level, title; level 0 = no heading).

    A heading of level l replaces everything from depth l on. With n the number
    of headings so far, its depth is ``n + min(0, running min of (l - n))``, so a
    skipped level needs no recursion; the name at each depth is the last one
    known there. A level beyond MAX_LEVEL raises an error.
    """
    refused = F.raise_error(F.concat(F.lit("heading level beyond the largest: "), F.col("level").cast("string")))
    blocks = blocks.withColumn("level", F.when(F.col("level") > MAX_LEVEL, refused.cast(blocks.schema["level"].dataType)).otherwise(F.col("level")))
    plan = slicing(blocks, ["doc_id"], [order], bounded=bounded)
    is_head = F.col("level") > 0
    counted = ordered(blocks, plan, _n=running_sum(F.when(is_head, 1).otherwise(0)))
    deep = ordered(counted, plan, _low=running_min(F.when(is_head, F.col("level") - F.col("_n"))))
    deep = deep.withColumn(
        "_depth",
        F.when(F.col("_n") > 0, F.col("_n") + F.least(F.lit(0), F.col("_low"))).otherwise(F.lit(0)),
    )
    names = {
        f"_t{e}": last_known(F.when(is_head & (F.col("_depth") == e), F.col("title")))
        for e in range(1, MAX_LEVEL + 1)
    }
    named = ordered(deep, plan, **names)
    path = F.concat_ws(
        " > ", *[F.when(F.col("_depth") >= e, F.col(f"_t{e}")) for e in range(1, MAX_LEVEL + 1)]
    )
    return named.select(
        *blocks.columns, F.when(F.col("_depth") > 0, path).alias("heading_path"),
        F.col("_depth").cast("int").alias("depth"),
    )


def merge_list_runs(segs: DataFrame, order: str = "start_order", bounded: bool = False) -> DataFrame:
    """Join runs of consecutive list segments under one heading path.

    ``segs`` has (doc_id, type, content, heading_path, order). A group is one run.
    """
    plan = slicing(segs, ["doc_id"], [order], bounded=bounded)
    seen = ordered(
        segs, plan, _pt=lag_of(F.col("type")), _pp=lag_of(F.col("heading_path"))
    )
    joined = (
        (F.col("type") == "list") & (F.col("_pt") == "list")
        & F.col("heading_path").eqNullSafe(F.col("_pp"))
    )
    runs = ordered(
        seen.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)),
        plan, _run=running_sum(F.col("_new")),
    )
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("content").alias("t"))))
    return runs.groupBy("doc_id", "_run").agg(
        F.min_by("type", order).alias("type"),
        F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("content"),
        F.min_by("heading_path", order).alias("heading_path"),
        F.min(order).alias("start_order"),
        F.max(order).alias("end_order"),
    ).drop("_run")


# --- HTML ------------------------------------------------------------------

# Fixed tables: tags that shape the text, and named character references.
TAGS = [
    "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "pre", "table", "tr", "th", "td", "br",
    "p", "div", "section", "article", "blockquote",
]
SPACED = "p|div|section|article|blockquote|h[1-6]|ul|ol|li|pre|table|tr|td|th|br|nav|footer|header|hr"
# The named references of HTML 5; some may stand without a semicolon. A fixed space becomes a plain one.
ENTITIES = {**html5, "nbsp;": " ", "nbsp": " "}
_OPEN = "|".join(sorted((n for n in ENTITIES if not n.endswith(";")), key=lambda n: (-len(n), n)))
_END, _IS = "\x01", "\x02"
DROPPED = r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|head|noscript)\b[^>]*>.*?</\1\s*>"

_CODE = {t: i + 1 for i, t in enumerate(TAGS)}
_HEADS = {_CODE[f"h{n}"]: n for n in range(1, 7)}
_BLOCKS = {_CODE[t] for t in ("p", "div", "section", "article", "blockquote")}
_LISTS = {_CODE["ul"], _CODE["ol"]}
_STARTS = _BLOCKS | _LISTS | set(_HEADS) | {_CODE["pre"], _CODE["table"]}
_CELLS = {_CODE["th"], _CODE["td"]}


def decode_entities(c: Column) -> Column:
    """Character references to characters, each once; unknown names stay, invalid numbers become U+FFFD."""
    named = F.str_to_map(F.lit(_END.join(f"{n}{_IS}{v}" for n, v in ENTITIES.items())), F.lit(_END), F.lit(_IS))

    def one(p: Column) -> Column:
        hexa, deci = (F.regexp_extract(p, rf"^&#{x}+);?", 1) for x in ("[xX]([0-9a-fA-F]", "([0-9]"))
        code = F.when(hexa != "", F.conv(hexa, 16, 10)).when(deci != "", deci).try_cast("bigint")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        name = F.regexp_extract(p, "^&([A-Za-z][A-Za-z0-9]*;)", 1)
        start = F.regexp_extract(p, f"^&({_OPEN})", 1)
        rest = lambda pattern: F.regexp_replace(p, f"^&{pattern}", "")
        return (
            F.when((hexa != "") | (deci != ""), F.concat(number, rest("#[xX]?[0-9a-fA-F]+;?")))
            .when(F.map_contains_key(named, name), F.concat(F.try_element_at(named, name), rest("[A-Za-z0-9]+;")))
            .when(start != "", F.concat(F.try_element_at(named, start), F.substr(p, F.length(start) + 2)))
            .otherwise(p)
        )

    return let(c, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, "(?=&)"), one), "")).otherwise(t))


def _element_end(codes: list[int], at: int) -> tuple[int, int]:
    """Where the content of the element opened at ``at`` ends, and where to go on."""
    tag, depth = codes[at], 0
    for i in range(at, len(codes)):
        if codes[i] == tag:
            depth += 1
        elif codes[i] == -tag:
            depth -= 1
        if depth == 0:
            return i, i + 1
        if tag == _CODE["p"] and i > at and codes[i] in _STARTS:
            return i, i  # a paragraph ends where the next block begins
    return len(codes), len(codes)


def _split_at(codes: list[int], first: int, end: int, openers: set[int]) -> list[int]:
    """Positions of ``openers`` directly inside the element, not in nested lists."""
    out, depth = [], 0
    for i in range(first, end):
        if codes[i] in openers and depth == 0:
            out.append(i)
        elif codes[i] in _LISTS and openers == {_CODE["li"]}:
            depth += 1
        elif -codes[i] in _LISTS and openers == {_CODE["li"]}:
            depth = max(0, depth - 1)
    return out


def _spans(starts: list[int], end: int) -> list[dict]:
    return [{"s": s, "e": e} for s, e in zip(starts, [*starts[1:], end])]


def page_pieces(codes: list[int]) -> list[dict]:
    """Token codes of a page to output pieces ``{kind, no, parts}`` in order."""
    out, i = [], 0

    def add(kind: str, no: int, parts: list[dict]) -> None:
        out.append({"kind": kind, "no": no, "parts": parts})

    while i < len(codes):
        c = codes[i]
        if c == 0:
            add("text", 0, [{"s": i, "e": i + 1}])
        elif c == _CODE["br"]:
            add("br", 0, [])
        elif c in _STARTS:
            end, after = _element_end(codes, i)
            inside = [{"s": i + 1, "e": end}]
            if c in _HEADS:
                add("head", _HEADS[c], inside)
            elif c in _LISTS:
                add("open", 0, [])
                items = _spans(_split_at(codes, i + 1, end, {_CODE["li"]}), end)
                for n, item in enumerate(items, 1):
                    add("item", n if c == _CODE["ol"] else 0, [item])
                add("close", 0, [])
            elif c == _CODE["pre"]:
                add("pre", 0, inside)
            elif c == _CODE["table"]:
                rows = [
                    _spans(_split_at(codes, r["s"], r["e"], _CELLS), r["e"])
                    for r in _spans(_split_at(codes, i + 1, end, {_CODE["tr"]}), end)
                ]
                width = max((len(r) for r in rows), default=0)
                add("open", 0, [])
                for n, cells in enumerate(rows if width else []):
                    add("row0" if n == 0 else "row", width, cells)
                add("close", 0, [])
            else:
                add("block", 0, inside)
            i = after
            continue
        i += 1
    return out


@F.pandas_udf(PIECES)
def _page_pieces_udf(codes: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else page_pieces(list(c)) for c in codes])


def html_to_markdown(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """HTML to Markdown-like text: (key, text) and the columns in ``keep``.

    Pages are cut into tags and texts, cleaned and rendered by expressions; the
    Python helper only sees one small code per token.
    """
    body = F.regexp_replace(F.col(html), DROPPED, "")
    token_list = F.regexp_extract_all(body, F.lit(r"(?s)</?[a-zA-Z][^>]*>|[^<]+|<"), F.lit(0))
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))

    def code(t: Column) -> Column:
        tag = name(t)
        at = F.array_position(F.lit(TAGS), tag).cast("int")
        known = F.when(at == 0, F.lit(len(TAGS) + 1)).otherwise(at)
        return F.when(tag == "", F.lit(0)).when(F.startswith(t, F.lit("</")), -known).otherwise(known)

    tokenised = pages.select(key, *keep, token_list.alias("_tok"))
    pieces = settle(tokenised).withColumn("_pieces", _page_pieces_udf(F.transform("_tok", code)))

    def text(part: Column, keep: bool = False) -> Column:
        inner = F.slice("_tok", part["s"] + 1, part["e"] - part["s"])
        gap = "" if keep else " "
        joined = F.array_join(
            F.transform(
                inner,
                lambda t: F.when(name(t) == "", t)
                .when(F.regexp_like(name(t), F.lit(f"^({SPACED})$")), F.lit(gap))
                .otherwise(""),
            ),
            "",
        )
        decoded = decode_entities(joined)
        return decoded if keep else normalize_ws(decoded)

    def render(p: Column) -> Column:
        first = F.get(p["parts"], F.lit(0))
        cells = F.transform(p["parts"], lambda c: F.replace(text(c), F.lit("|"), F.lit("\\|")))
        filled = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(p["no"] - F.size(cells), F.lit(0))))
        row = F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |\n"))
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), p["no"]), F.lit("\n"))
        mark = F.when(p["no"] > 0, F.concat(p["no"].cast("string"), F.lit(". "))).otherwise("- ")
        return (
            F.when(p["kind"] == "text", text(first))
            .when(p["kind"] == "br", F.lit("\n"))
            .when(p["kind"] == "head", F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), p["no"]), F.lit(" "), text(first), F.lit("\n\n")))
            .when(p["kind"] == "open", F.lit("\n\n"))
            .when(p["kind"] == "close", F.lit("\n"))
            .when(p["kind"] == "item", F.concat(mark, text(first), F.lit("\n")))
            .when(p["kind"] == "pre", F.concat(F.lit("\n\n```\n"), text(first, keep=True), F.lit("\n```\n\n")))
            .when(p["kind"] == "row0", F.concat(row, rule))
            .when(p["kind"] == "row", row)
            .otherwise(F.concat(F.lit("\n\n"), text(first), F.lit("\n\n")))
        )

    whole = F.array_join(F.transform("_pieces", render), "")
    tidy = F.regexp_replace(whole, r"\n{3,}", "\n\n")
    return pieces.select(key, *keep, F.regexp_replace(tidy, r"^\s+|\s+$", "").alias("text"))
