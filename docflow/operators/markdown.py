"""Markdown to plain structured text, with blocks inside blocks.

The helper below reads the first characters of each line and keeps a stack of open
containers (quotes, list items); it returns which lines make up which block and where
their content starts. The text itself is cut, joined and cleaned by expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions.bind import let, settle
from docflow.operators.segments import decode_entities

SHAPE = 96  # characters of a line the helper sees behind its marks
_INT = T.IntegerType()
PART = T.StructType([T.StructField("line", _INT), T.StructField("at", _INT)])
PIECES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("no", _INT), T.StructField("parts", T.ArrayType(PART))]))

_BULLET, _NUMBER = re.compile(r"([-+*])(?=[ \t]|$)"), re.compile(r"(\d{1,9})([.)])(?=[ \t]|$)")
_RULE, _SETEXT = re.compile(r"([-_*])[ \t]*(?:\1[ \t]*){2,}$"), re.compile(r"(=+|-+)[ \t]*$")
_HEAD, _FENCE = re.compile(r"(#{1,6})(?=[ \t]|$)"), re.compile(r"(`{3,}(?=[^`]*$)|~{3,})")
# Tags that begin a block of markup up to a blank line, and marks with an end of their own.
_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem "
    "nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
_BLOCK_TAG = rf"</?(?:{'|'.join(_TAGS.split())})(?=[ \t>]|/>|$)|<!--|<[?]|<![a-z]|<(?:script|pre|style|textarea)(?=[ \t>]|$)"
_BLOCK_MARKUP = re.compile(rf"(?i)(?:{_BLOCK_TAG})")
_MARKUP = re.compile(rf"(?i)(?:{_BLOCK_TAG}|</?[a-z][a-z0-9-]*(?:\s[^<>]*)?/?>[ \t]*$)")
_MARKUP_ENDS = [(re.compile(r"<!--"), "-->"), (re.compile(r"<[?]"), "?>"), (re.compile(r"(?i)<![a-z]"), ">"), (re.compile(r"(?i)<(?:script|pre|style|textarea)\b"), "</")]


def _indent(line: str, at: int) -> tuple[int, int]:
    """Columns of white space from ``at`` on, a tab up to the next fourth one, and the place behind it."""
    column, start = 0, at
    while at < len(line) and line[at] in " \t":
        column += 4 - (start + column) % 4 if line[at] == "\t" else 1
        at += 1
    return column, at


def _skip(line: str, at: int, columns: int) -> int:
    """Place behind ``columns`` of white space, or behind what there is of it."""
    seen = 0
    while seen < columns and at < len(line) and line[at] in " \t":
        seen += 4 - (at % 4) if line[at] == "\t" else 1
        at += 1
    return at


class _Blocks:
    """Open containers and the open leaf while lines are read; ``out`` is what to render."""

    def __init__(self):
        self.out: list[dict] = []
        self.stack: list[dict] = []  # quotes and items, outermost first
        self.leaf: dict | None = None
        self.ended: list[list | None] = [None]  # per depth: kind and number of the list whose item was the last block there

    def piece(self, kind: str, no: int = 0, parts: list | None = None) -> dict:
        self.out.append({"kind": kind, "no": no, "parts": parts or []})
        return self.out[-1]

    def block(self) -> None:
        """A block that is no list item begins: the list before it at this depth ends."""
        if self.ended[-1] is not None:
            self.piece("list_end")
            self.ended[-1] = None

    def close(self, depth: int) -> None:
        """Close containers beyond ``depth``, innermost first."""
        self.leaf = None
        while len(self.stack) > depth:
            if self.ended.pop() is not None:
                self.piece("list_end")
            if self.stack.pop()["kind"] == "item":
                self.piece("item_end")

    def item(self, mark: str, number: int, width: int) -> None:
        run = self.ended[-1]
        if run is None or run[0] != mark:
            self.block()
            run = self.ended[-1] = [mark, number]
        self.piece("item", run[1] if mark in ".)" else -1)
        run[1] += 1
        self.stack.append({"kind": "item", "width": width, "empty": True})
        self.ended.append(None)


def markdown_pieces(lines: list[str]) -> list[dict]:
    """Shapes of lines to pieces ``{kind, no, parts}`` in the order of the text."""
    b = _Blocks()
    for i, line in enumerate(lines):
        at, depth = 0, 0
        while depth < len(b.stack):  # containers that go on
            box = b.stack[depth]
            columns, behind = _indent(line, at)
            if box["kind"] == "quote":
                if columns > 3 or line[behind : behind + 1] != ">":
                    break
                at = _skip(line, behind + 1, 1)
            elif behind == len(line):
                if box["empty"] and box.get("blank"):
                    break
                box["blank"] = True
                at = behind
            elif columns >= box["width"]:
                at = _skip(line, at, box["width"])
            else:
                break
            depth += 1
        kind = b.leaf["kind"] if b.leaf else None
        inside = depth == len(b.stack)
        columns, behind = _indent(line, at)
        rest = line[behind:]
        if inside and kind == "fence":
            if columns < 4 and re.fullmatch(re.escape(b.leaf["mark"]) + b.leaf["mark"][0] + "*[ \t]*", rest):
                b.leaf = None
            else:
                b.leaf["piece"]["parts"].append({"line": i, "at": _skip(line, at, b.leaf["indent"])})
            continue
        if inside and kind == "markup":
            if (b.leaf["end"] in line) if b.leaf["end"] else not rest:
                b.leaf = None
            continue
        if not rest:
            if inside and kind == "code":
                b.leaf["blank"].append({"line": i, "at": _skip(line, at, 4)})
            else:
                if not inside:
                    b.close(depth)
                b.leaf = None
            continue
        opened = False
        while True:  # containers and leaves that begin here
            if columns > 3:
                if kind == "text" and not opened:
                    break
                if inside and kind == "code" and not opened:
                    b.leaf["piece"]["parts"] += b.leaf["blank"]
                    b.leaf["blank"] = []
                else:
                    b.close(depth) if not opened else None
                    b.block()
                    b.leaf = {"kind": "code", "piece": b.piece("code"), "blank": []}
                    kind, inside, opened = "code", True, True
                b.leaf["piece"]["parts"].append({"line": i, "at": _skip(line, at, 4)})
                rest = ""
                break
            open_text = kind == "text" and inside and not opened
            fresh = _start(b, line, i, columns, behind, rest, open_text, None if opened else depth)
            if fresh is None:
                break
            opened = True
            depth = len(b.stack)
            if fresh < 0:
                rest = ""
                break
            at = fresh
            columns, behind = _indent(line, at)
            rest = line[behind:]
            if not rest:
                break
        if not rest:
            continue
        part = {"line": i, "at": behind}
        if kind == "text" and not opened and b.leaf:
            b.leaf["piece"]["parts"].append(part)
            continue
        if not opened and not inside:
            b.close(depth)
        b.block()
        b.leaf = {"kind": "text", "piece": b.piece("text", parts=[part])}
        for box in b.stack:
            box["empty"] = False
    b.close(0)
    return b.out


def _start(b: _Blocks, line: str, i: int, columns: int, behind: int, rest: str, open_text: bool, depth: int | None) -> int | None:
    """Open what begins at ``behind``: the place to go on from, -1 if the line is used up, None for plain text.

    ``open_text`` says that a paragraph could go on here; containers beyond ``depth`` end.
    """

    def enter() -> None:
        if depth is not None:
            b.close(depth)
        b.leaf = None
        for box in b.stack:
            box["empty"] = False

    if rest[0] == ">":
        enter()
        b.block()
        b.stack.append({"kind": "quote"})
        b.ended.append(None)
        return _skip(line, behind + 1, 1)
    if head := _HEAD.match(rest):
        enter()
        b.block()
        b.piece("heading", len(head[1]), [{"line": i, "at": behind + head.end()}])
        return -1
    if fence := _FENCE.match(rest):
        enter()
        b.block()
        piece = b.piece("fence", 0, [{"line": i, "at": behind + fence.end()}])
        b.leaf = {"kind": "fence", "mark": fence[1], "indent": columns, "piece": piece}
        return -1
    if (markup := _MARKUP.match(rest)) and not (open_text and not _BLOCK_MARKUP.match(rest)):
        enter()
        b.block()
        end = next((e for p, e in _MARKUP_ENDS if p.match(rest)), None)
        if end is None or end not in rest[markup.end() :]:
            b.leaf = {"kind": "markup", "end": end}
        return -1
    if open_text and (under := _SETEXT.match(rest)):
        piece = b.leaf["piece"]
        piece["kind"], piece["no"] = "setext", 1 if under[1][0] == "=" else 2
        b.leaf = None
        return -1
    if _RULE.match(rest):
        enter()
        b.block()
        return -1
    mark = _BULLET.match(rest) or _NUMBER.match(rest)
    if mark is None:
        return None
    gap, text = _indent(line, behind + mark.end())
    if open_text and (text == len(line) or (mark.re is _NUMBER and mark[1] != "1")):
        return None  # such an item cannot interrupt a paragraph
    enter()
    wide = gap if 0 < gap <= 4 and text < len(line) else 1
    sign = mark[mark.lastindex]
    b.item(sign, int(mark[1]) if mark.re is _NUMBER else 0, columns + mark.end() + wide)
    return text if text == len(line) else _skip(line, behind + mark.end(), wide)


@F.pandas_udf(PIECES)
def _pieces_udf(shapes: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else markdown_pieces(list(s)) for s in shapes])


# --- text inside blocks ------------------------------------------------------

_PUNCTUATION = "".join(chr(c) for c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))
_HIDDEN = "".join(chr(0xE000 + ord(c)) for c in _PUNCTUATION)
_TARGET = r"(?:<[^<>]*>|(?:[^()\\\s<]|\\.|\([^()]*\))*)"
_NESTED = rf"\(\s*{_TARGET}(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)"
_LINK = rf"!?\[(?:[^\[\]]|\[[^\[\]]*\])*\](?:{_NESTED}|\[[^\[\]]*\])?"
_TOKENS = rf"(?s)`+[^`]+`+|\\.|<[^<>]*>|{_LINK}|.[^`\\<\[!]*"


def _label(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def inline(text: Column, labels: Column) -> Column:
    """Text without the marks of emphasis, links, images, markup and escapes; code keeps its marks.

    Characters that are not marks any more are hidden until all marks are gone.
    """
    hidden = lambda c: F.translate(c, _PUNCTUATION, _HIDDEN)

    def code(t: Column) -> Column:
        inner = F.translate(F.regexp_extract(t, r"(?s)^`+(.+?)`+$", 1), "\n", " ")
        bare = F.when(inner.rlike(r"^ .*\S.* $"), F.regexp_replace(inner, r"^ | $", "")).otherwise(inner)
        return hidden(F.concat(F.lit("`"), bare, F.lit("`")))

    def link(t: Column) -> Column:
        inner = F.regexp_extract(t, r"(?s)^!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]", 1)
        given = F.regexp_extract(t, r"(?s)\]\[([^\[\]]*)\]$", 1)
        direct = t.rlike(r"(?s)\]\(.*\)$|\]\(\)$")
        known = F.array_contains(labels, _label(F.when(given != "", given).otherwise(inner)))
        shown = F.regexp_replace(inner, r"(?s)!?\[([^\[\]]*)\]\([^()]*\)", "$1")
        return F.when(direct | known, shown).otherwise(t)

    def token(t: Column) -> Column:
        same = F.regexp_extract(t, r"^(`+)", 1) == F.regexp_extract(t, r"(`+)$", 1)
        return (
            F.when(F.startswith(t, F.lit("`")), F.when((F.length(t) > 2) & same, code(t)).otherwise(hidden(t)))
            .when(t == "\\\n", F.lit("\n"))
            .when(F.startswith(t, F.lit("\\")) & t.rlike(r"^\\[!-/:-@\[-`{-~]$"), hidden(F.substr(t, F.lit(2))))
            .when(t.rlike(r"^<[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*>$|^<[^\s<>@]+@[^\s<>@]+>$"), hidden(F.regexp_replace(t, "^<|>$", "")))
            .when(t.rlike(r"(?s)^<(/?[A-Za-z][^<>]*|!--.*--|[?].*[?]|![A-Za-z][^<>]*)>$"), F.lit(""))
            .when(t.rlike(r"(?s)^!?\[.*\]"), link(t))
            .otherwise(t)
        )

    def emphasis(s: Column) -> Column:
        # a run of marks opens before a character and closes behind one; inner emphasis first
        for _ in range(2):
            s = F.regexp_replace(s, r"(?<!\*)(\*{1,3})(?=[^\s*])([^*]+)(?<=[^\s*])\1(?!\*)", "$2")
            s = F.regexp_replace(s, r"(?<!\w)(_{1,3})(?=[^\s_])([^_]+)(?<=[^\s_])\1(?!\w)", "$2")
        return s

    def tokenised(s: Column) -> Column:
        cleaned = F.array_join(F.transform(F.regexp_extract_all(s, F.lit(_TOKENS), F.lit(0)), token), "")
        return F.when(s.rlike(r"[`\\<\[]"), cleaned).otherwise(s)

    return F.translate(decode_entities(emphasis(let(text, tokenised))), _HIDDEN, _PUNCTUATION)


def _definition(label: str) -> str:
    """A line ``[label]: target "title"``."""
    title = r"(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^()\n]*\)))?"
    return rf" {{0,3}}\[{label}\]:[ \t]*(?:<[^<>\n]*>|\S+){title}[ \t]*(?:\n|\z)"


_DEFINED = "(?m)^" + _definition(r"((?:[^\[\]\\]|\\.)+)")
_LEADING = rf"\A(?:{_definition(r'(?:[^\[\]\\]|\\.)+')})+"


def markdown_normalize(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Markdown to plain structured text: (doc_id, text) and the columns in ``keep``.

    Headings (also underlined ones) become ``#`` lines, list items keep ``-`` or their
    number, code of both kinds stands between fences; quotes, nested lists and lazy
    continuation lines are read as blocks inside blocks. Rules, markup and link
    definitions go, emphasis, links and images leave their text. Null text gives null.
    """
    lines = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    base = settle(df.select("doc_id", *keep, lines.alias("_l")))
    shape = lambda s: F.regexp_extract(s, rf"(?s)^[ \t>*+\-0-9.)#`~=_]*.{{0,{SHAPE}}}", 0)
    cut = settle(base.withColumn("_k", _pieces_udf(F.transform("_l", shape))))

    def parts(p: Column, first: int = 0) -> Column:
        of = p["parts"] if not first else F.slice(p["parts"], first + 1, F.greatest(F.size(p["parts"]) - first, F.lit(0)))
        return F.transform(of, lambda x: F.substr(F.get(F.col("_l"), x["line"]), x["at"] + 1))

    def paragraph(p: Column) -> Column:
        return F.array_join(F.transform(parts(p), lambda s: F.rtrim(s)), "\n")

    plain = F.filter("_k", lambda p: p["kind"].isin("text", "setext"))
    found = F.flatten(F.transform(plain, lambda p: F.regexp_extract_all(paragraph(p), F.lit(_DEFINED), F.lit(1))))
    cut = settle(cut.withColumn("_names", F.transform(found, _label)))
    labels = F.col("_names")

    def code(p: Column, first: int) -> Column:
        literal = F.array_join(F.transform(parts(p, first), lambda s: F.concat(s, F.lit("\n"))), "")
        return F.concat(F.when(literal == "", F.lit("\n")).otherwise(literal), F.lit("```\n\n"))

    def render(p: Column) -> Column:
        title = F.regexp_replace(F.trim(F.get(parts(p), F.lit(0))), r"(^|[ \t]+)#+$", "")
        info = F.trim(F.get(parts(p), F.lit(0)))
        marks = F.repeat(F.lit("#"), p["no"])
        body = F.regexp_replace(paragraph(p), _LEADING, "")  # definitions stand at the beginning
        return (
            F.when(p["kind"] == "text", F.when(body != "", F.concat(inline(body, labels), F.lit("\n\n"))).otherwise(""))
            .when(p["kind"] == "setext", F.concat(F.lit("\x01"), marks, F.lit(" "), inline(body, labels), F.lit("\n\n")))
            .when(p["kind"] == "heading", F.concat(F.lit("\x01"), marks, F.lit(" "), inline(title, labels), F.lit("\n\n")))
            .when(p["kind"] == "item", F.when(p["no"] >= 0, F.concat(p["no"].cast("string"), F.lit(". "))).otherwise("- "))
            .when(p["kind"].isin("item_end", "list_end"), F.lit("\n"))
            .when(p["kind"] == "fence", F.concat(F.lit("\x01```"), inline(info, labels), F.lit("\n"), code(p, 1)))
            .otherwise(F.concat(F.lit("\x01```\n"), code(p, 0)))
        )

    whole = F.array_join(F.transform("_k", render), "")
    # a heading or code block stands after a blank line, whatever came before
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, "(?<=\n\n)\x01|^\x01", ""), "(?<=\n)\x01", "\n"), "\x01", "\n\n")
    return cut.select("doc_id", *keep, F.regexp_replace(spaced, r"^[\x00-\x20]+|[\x00-\x20]+$", "").alias("text"))
