"""Query terms, chunk tokens and lexical scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.functions.bind import let

_NOT_WORD = r"[^\p{IsHan}\p{IsAlphabetic}\p{IsDigit}]+"


def _words(c: Column) -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _NOT_WORD, " "))
    return F.filter(F.split(text, " "), lambda w: F.length(w) > 0)


def _bigrams(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: word.substr(i, F.lit(2)))


def _no_terms() -> Column:
    return F.array().cast("array<string>")


def _gathered(query: Column, terms_of, limit: int | None) -> Column:
    """Terms of all words; with ``limit`` no further word is read once so many terms are there."""
    if limit is None:
        return F.flatten(F.transform(_words(query), terms_of))
    return F.aggregate(
        _words(query), _no_terms(), lambda acc, w: F.when(F.size(acc) >= limit, acc).otherwise(F.concat(acc, terms_of(w)))
    )


def search_terms(query: Column, limit: int | None = None) -> Column:
    """Prefix terms for keyword search, in query order, repeats kept."""

    def terms_of(w: Column) -> Column:
        han = w.rlike(r"\p{IsHan}")
        return (
            F.when(han & (F.length(w) <= 2), F.array(w))
            .when(han, _bigrams(w))
            .when(F.length(w) >= 2, F.array(F.lower(w)))
            .otherwise(_no_terms())
        )

    return _gathered(query, terms_of, limit)


def rerank_terms(query: Column, limit: int | None = None) -> Column:
    """Distinct terms for lexical re-ranking, in query order."""

    def terms_of(w: Column) -> Column:
        return F.when(
            (F.length(w) > 2) & w.rlike(r"\p{IsHan}"), _bigrams(w)
        ).otherwise(F.array(w))

    if limit is None:
        return F.array_distinct(_gathered(query, terms_of, None))
    return F.aggregate(
        _words(query), _no_terms(),
        lambda acc, w: F.when(F.size(acc) >= limit, acc).otherwise(F.array_distinct(F.concat(acc, terms_of(w)))),
    )


def shortest_prefixes(terms: Column) -> Column:
    """Distinct terms without those that another, shorter term already covers.

    What the set matches stays the same, and every token now matches at most
    one term, so hits can be counted without a distinct.
    """
    return let(
        F.array_distinct(terms),
        lambda unique: F.filter(
            unique, lambda t: ~F.exists(unique, lambda u: (u != t) & F.startswith(t, u))
        ),
    )


def words_of(content: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; the first and last may be empty."""
    return F.split(F.lower(content), r"[^\p{L}\p{Nd}]+")


def tokens(content: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(words_of(content), lambda t: F.length(t) > 0)


def counted(words: Column) -> Column:
    """Distinct words with their counts, in word order: array of (word, n).

    Sorted inside the row, so counting the words of a text needs no shuffle.
    """

    def runs(w: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(w) - 1),
            lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)),
        )
        lengths = let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, i: F.struct(
                    F.get(w, at).alias("word"),
                    (F.coalesce(F.get(s, i + 1), F.size(w)) - at).alias("n"),
                ),
            ),
        )
        return F.when(F.size(w) > 0, lengths)

    return let(F.array_sort(words), runs)


def lexical_score(content: Column, terms: Column) -> Column:
    """Share of ``terms`` that occur in ``content``, ignoring case."""
    hits = let(
        F.lower(content),
        lambda low: F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t)))),
    )
    usable = F.coalesce(content.rlike(r"\S"), F.lit(False)) & (F.size(terms) > 0)
    return F.when(usable, hits / F.size(terms)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 if a norm is 0; lengths must agree."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
    checked = F.when(
        F.size(a) != F.size(b), F.raise_error("vectors must have the same length").cast("double")
    ).otherwise(value)
    return F.when(a.isNotNull() & b.isNotNull(), checked)
