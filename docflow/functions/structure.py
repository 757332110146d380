"""Block, chunk and box classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.functions.bind import let
from docflow.functions.text import has_text, normalize_ws, strip_edges

# Fixed patterns and values.
HEADING = (
    r"^(?:#{1,6}\s+.+|第[一二三四五六七八九十百千0-9]+[章节部分篇]\s*.*"
    r"|[一二三四五六七八九十]+[、.．].+|\d+[、.．].+)$"
)
HEADING_MAX_CHARS = 80
MARKDOWN_HEADING = r"^(#{1,6})\s+(.+)$"
TABLE_ROW = r"(?m)^\|.+\|\s*$"
LIST_ITEM = r"(?m)^(-|\*|\d+[.])\s+.+$"
CAPTION_BOX = r"(?i)^(图|表|figure|table)\s*[0-9一二三四五六七八九十IVXivx.:：-].*"
TABLE_BOX = r"^(.*\|.*\|.*|.*\s{2,}.*\s{2,}.*)"
LIST_BOX = r"^(([-*•])|(\d+[.)]))\s+.+"
MANUAL_HEADING = (
    r"^(第[一二三四五六七八九十百千0-9]+[章节篇部分]\s*.*|\d+(\.\d+){0,3}\s+.+|\d+[、.)]\s*.+)$"
)
ABSTRACT_TITLE = r"(?i)^(abstract|摘要)$"
REFERENCES_TITLE = r"(?i)^(references|参考文献)$"
REFERENCE_ENTRY = r"^(\[?\d+\]?\s+.+|[A-Z][A-Za-z'\-]+.*\(\d{4}[a-z]?\).+)$"


def is_heading(block: Column) -> Column:
    return (F.length(block) <= HEADING_MAX_CHARS) & block.rlike(HEADING)


def markdown_level(block: Column) -> Column:
    """Number of hash marks of a heading line, 0 for any other block."""
    return F.length(F.regexp_extract(block, MARKDOWN_HEADING, 1))


def markdown_title(block: Column) -> Column:
    return strip_edges(F.regexp_extract(block, MARKDOWN_HEADING, 2))


def block_type(block: Column) -> Column:
    """``code``, ``table``, ``list`` or ``paragraph``."""
    return (
        F.when(F.startswith(block, F.lit("```")) & F.endswith(block, F.lit("```")), "code")
        .when(block.rlike(TABLE_ROW), "table")
        .when(block.rlike(LIST_ITEM), "list")
        .otherwise("paragraph")
    )


def chunk_traits(content: Column, heading: Column) -> Column:
    """Struct of what a chunk holds, used as chunk metadata."""
    body = strip_edges(F.coalesce(content, F.lit("")))
    code, table = F.contains(body, F.lit("```")), body.rlike(TABLE_ROW)
    items = body.rlike(LIST_ITEM)
    level = F.when(
        has_text(heading),
        F.greatest(F.lit(1), markdown_level(strip_edges(heading))),
    )
    kind = (
        F.when(~has_text(body), "empty")
        .when(table, "table")
        .when(code, "code")
        .when(items, "list")
        .when(has_text(heading) & F.startswith(body, heading), "section")
        .otherwise("paragraph")
    )
    return F.struct(
        code.alias("has_code_block"),
        table.alias("has_table"),
        items.alias("has_list"),
        kind.alias("segment_type"),
        level.alias("heading_level"),
    )


def box_type(text: Column, bold: Column, font_size: Column, baseline: Column) -> Column:
    """``Caption``, ``Table``, ``List``, ``Title`` or ``Text``; text decides before size."""
    return clean_box_type(normalize_ws(F.coalesce(text, F.lit(""))), bold, font_size, baseline)


def clean_box_type(t: Column, bold: Column, font_size: Column, baseline: Column) -> Column:
    """``box_type`` of a text whose blanks are normalized: no two in a row, so a table has bars."""
    rel = F.when(baseline != 0, font_size / baseline).otherwise(F.lit(1.0))
    return (
        F.when(F.length(t) == 0, "Text")
        .when(t.rlike(CAPTION_BOX), "Caption")
        .when(F.contains(t, F.lit("|")) & t.rlike(TABLE_BOX), "Table")
        .when(t.rlike(LIST_BOX), "List")
        .when((rel >= 1.25) | (bold & (rel >= 1.1)), "Title")
        .otherwise("Text")
    )


def table_cells(line: Column) -> Column:
    """Cells by bar, or by gaps of two or more blanks where there is no bar."""
    raw = F.when(F.contains(line, F.lit("|")), F.split(line, r"\|")).otherwise(
        F.split(line, r"[\s\p{Z}]{2,}")
    )
    trimmed = F.transform(raw, lambda c: F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.filter(trimmed, lambda c: F.length(c) > 0)


def _table_rows(text: Column) -> Column:
    rows = F.transform(F.split(text, r"\r\n|\n|\r"), table_cells)
    return F.filter(rows, lambda r: F.size(r) > 0)


def _fitted(row: Column, width: Column) -> Column:
    padded = F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0))))
    return F.slice(padded, F.lit(1), width)


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _tags(tag: str, cells: Column) -> Column:
    parts = F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")))
    return F.array_join(parts, "")


def table_markdown(text: Column) -> Column:
    """Markdown table, body rows padded or cut to the header; null without rows."""

    def form(rows: Column) -> Column:
        head = F.get(rows, F.lit(0))
        width = F.size(head)
        rule = _line(F.array_repeat(F.lit("---"), width))
        body = F.transform(
            F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))),
            lambda r: _line(_fitted(r, width)),
        )
        lines = F.concat(F.array(_line(head), rule), body)
        return F.when(F.size(rows) > 0, F.array_join(lines, "\n"))

    return let(_table_rows(text), form)


def table_html(text: Column) -> Column:
    def form(rows: Column) -> Column:
        head = F.get(rows, F.lit(0))
        width = F.size(head)
        body = F.transform(
            F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))),
            lambda r: F.concat(F.lit("<tr>"), _tags("td", _fitted(r, width)), F.lit("</tr>")),
        )
        filled = F.concat(F.lit("<tbody>"), F.array_join(body, ""), F.lit("</tbody>"))
        return F.when(
            F.size(rows) > 0,
            F.concat(
                F.lit("<table><thead><tr>"),
                _tags("th", head),
                F.lit("</tr></thead>"),
                F.when(F.size(rows) > 1, filled).otherwise(""),
                F.lit("</table>"),
            ),
        )

    return let(_table_rows(text), form)


def title_level(text: Column, font_size: Column, baseline: Column, strategy: str) -> Column:
    """Heading level of a title box: numbering depth for manuals, else by font size."""
    t = normalize_ws(text)
    rel = F.when(baseline != 0, font_size / baseline).otherwise(F.lit(1.0))
    by_size = F.when(rel >= 1.6, 1).when(rel >= 1.4, 2).otherwise(3)
    if strategy != "manual":
        return by_size
    dots = F.length(t) - F.length(F.regexp_replace(t, r"\.", ""))
    return (
        F.when(t.rlike(MANUAL_HEADING) & F.startswith(t, F.lit("第")), 1)
        .when(t.rlike(MANUAL_HEADING), F.least(F.lit(4), dots + 1))
        .otherwise(by_size)
    )


def section_id(page: Column, order: Column) -> Column:
    return F.concat(F.lit("sec-"), page.cast("string"), F.lit("-"), order.cast("string"))


def path_section_id(heading_path: Column) -> Column:
    """Same path, same id, in every run (the sha-256 prefix of the path)."""
    return F.when(
        has_text(heading_path),
        F.concat(F.lit("sec-path-"), F.substring(F.sha2(heading_path, 256), 1, 16)),
    )
