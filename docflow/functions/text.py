"""Text, number and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.functions.bind import let

# Fixed values.
CHARS_PER_TOKEN = 4.0
PRICE_PER_1K_TOKENS = {"chat_in": 0.002, "chat_out": 0.008, "embedding": 0.0001}
REFUSAL_MARKERS = (
    "无法根据现有知识库",
    "无法根据提供的证据",
    "证据不足",
    "无法确认",
    "未找到相关信息",
    "没有足够信息",
)

_CONTROL_EDGES = r"^[\x00-\x20]+|[\x00-\x20]+$"


def has_text(c: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def strip_edges(c: Column) -> Column:
    """Drop control characters and blanks at both ends, line breaks included."""
    return F.regexp_replace(c, _CONTROL_EDGES, "")


def normalize_ws(c: Column) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def round_half_up(c: Column, digits: int) -> Column:
    """``floor(x * 10^n + 0.5) / 10^n``: half goes up, also below zero."""
    p = float(10**digits)
    return F.floor(c.cast("double") * F.lit(p) + F.lit(0.5)) / F.lit(p)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Share with 4 decimals; 0 where the denominator is not positive."""
    return F.when(
        denominator > 0, round_half_up(numerator.cast("double") / denominator, 4)
    ).otherwise(F.lit(0.0))


def tokens_for_chars(n: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    per_token = F.lit(max(1.0, chars_per_token))
    return F.when(n > 0, F.ceil(n / per_token)).otherwise(F.lit(0)).cast("bigint")


def estimate_tokens(c: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    """Tokens by code-point count; blank text has none."""
    return F.when(has_text(c), tokens_for_chars(F.length(c), chars_per_token)).otherwise(
        F.lit(0).cast("bigint")
    )


def estimate_cost(tokens: Column, kind: str) -> Column:
    """Price of ``tokens``; kind is ``chat_in``, ``chat_out`` or ``embedding``."""
    return round_half_up(tokens * F.lit(PRICE_PER_1K_TOKENS[kind]) / F.lit(1000.0), 6)


def truncate(c: Column, n: int, suffix: str = "") -> Column:
    """First ``n`` characters, with ``suffix`` only where something was cut."""
    cut = F.substring(c, 1, n)
    cut = F.concat(cut, F.lit(suffix)) if suffix else cut
    return F.when(F.length(c) > n, cut).otherwise(c)


def truncate_to_tokens(c: Column, max_tokens: int | None) -> Column:
    """First ``max_tokens`` tokens by estimate; without a bound the whole text."""
    if max_tokens is None:
        return c
    limit = max_tokens * 4
    too_long = (estimate_tokens(c) > max_tokens) & (F.length(c) > limit)
    return F.when(too_long, F.substring(c, 1, limit)).otherwise(c)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def result_key(kb: Column, top_k: Column, query: Column) -> Column:
    return F.concat_ws(":", kb, top_k.cast("string"), F.md5(query))


def slug(c: Column) -> Column:
    """File-name safe form; ``sample`` where nothing is left."""
    kept = F.regexp_replace(c, r"[^0-9A-Za-z_\-一-鿿]+", "_")
    kept = F.regexp_replace(kept, "^_+|_+$", "")
    return F.when(F.length(kept) > 0, kept).otherwise(F.lit("sample"))


def answer_state(answer: Column) -> Column:
    """``empty_answer``, ``refused`` or ``answered``."""
    squeezed = F.regexp_replace(answer, r"\s+", "")
    return (
        F.when(~has_text(answer), "empty_answer")
        .when(squeezed.rlike("|".join(REFUSAL_MARKERS)), "refused")
        .otherwise("answered")
    )


def expected_terms(c: Column) -> Column:
    """Short answers whole; long ones as their first three sentences."""
    none = F.array().cast("array<string>")

    def of(text: Column) -> Column:
        pieces = F.transform(F.split(text, r"[.?]"), lambda p: F.trim(p))
        return let(
            F.filter(pieces, lambda p: F.length(p) > 0),
            lambda parts: F.when(F.length(text) == 0, none)
            .when(F.length(text) <= 180, F.array(text))
            .when(F.size(parts) == 0, F.array(F.substring(text, 1, 180)))
            .otherwise(F.slice(parts, 1, 3)),
        )

    return let(normalize_ws(F.coalesce(c, F.lit(""))), of)


def join_contexts(contexts: Column) -> Column:
    """Contexts separated by a rule line, for judge prompts."""
    return F.array_join(contexts, "\n---\n")


def number_contexts(contexts: Column) -> Column:
    """Contexts as ``[1] ...`` blocks, each followed by an empty line."""
    return F.array_join(
        F.transform(
            contexts,
            lambda c, i: F.concat(
                F.lit("["), (i + 1).cast("string"), F.lit("] "), c, F.lit("\n\n")
            ),
        ),
        "",
    )


def bullet_contexts(contexts: Column, limit: int | None = None) -> Column:
    """Contexts, or the first ``limit`` ones, as a dash list, for verification prompts."""
    return F.array_join(
        F.transform(contexts if limit is None else F.slice(contexts, 1, limit), lambda c: F.concat(F.lit("- "), c)), "\n"
    )


def fill_prompt(template: str, *parts: Column) -> Column:
    """Insert ``parts`` at the ``%s`` marks of ``template``, in order."""
    pieces = template.split("%s")
    if len(pieces) != len(parts) + 1:
        raise ValueError(f"template has {len(pieces) - 1} marks, {len(parts)} parts given")
    out = [F.lit(pieces[0])]
    for part, piece in zip(parts, pieces[1:]):
        out += [F.coalesce(part, F.lit("null")), F.lit(piece)]
    return F.concat(*out)
