"""Quality rules: counts per document, and the divergence of its histograms from language references.

A document's characters are counted in eight classes and its words against the
common words of some languages. The references are the summed histograms of all
documents of each language. A document is far from prose if the mean of its two
Jensen-Shannon distances is large for every language. Texts with few words say too
little and are not judged. Everything is DataFrame expressions; text is not
shuffled, and what the references are made of is one row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.bind import let
from docflow.llm.blocks import stored, text_or_empty

# The ten most common short words of each language.
COMMON = {
    "de": "der die und in den von zu das mit sich",
    "en": "the of and to in is was that it for",
    "es": "de la que el en los se del las por",
    "fr": "de la le et les des en un du une",
}
COMMON_WORDS = sorted({w for words in COMMON.values() for w in words.split()})
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
# What is cut out of a text, class by class; the last class is what is left.
CLASSES = [
    ("lower", "[a-z]+"), ("space", SPACE), ("upper", "[A-Z]+"), ("digit", "[0-9]+"),
    ("symbol", "[#*$%&|<>]+"), ("mark", "[!-~]+"), ("letter", r"\p{L}+"), ("other", None),
]
WINDOW = 8
LEAST_WORDS = 20
REPEATED_PERCENT = 30
JUDGED_WORDS = 50
FARTHEST = 0.25
MOST_LANGUAGES = 256
EDGE = "\x01"


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that stand twice or more in the text."""

    def windows(hashes: Column) -> Column:
        n = F.size(hashes)
        at = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))
        return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))

    def starts(sorted_windows: Column) -> Column:
        same = lambda w, i: F.get(sorted_windows, i)["h"] == w["h"]
        twice = F.filter(sorted_windows, lambda w, i: F.coalesce(same(w, i - 1), F.lit(False)) | F.coalesce(same(w, i + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda w: w["at"]))

    def covered(at: Column) -> Column:
        widths = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1), p + WINDOW) - p))
        return F.aggregate(widths, F.lit(0).cast("bigint"), lambda total, w: total + w)

    def count(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(by_hash, starts), covered)).otherwise(
            F.lit(0).cast("bigint")
        )

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Per document: the counts of the rules and its two histograms."""
    left, cut = F.col("text"), []
    for name, pattern in CLASSES[:-1]:
        cut.append((name, left, pattern))
        left = F.col(f"no_{name}")
    df = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("text")
    ).withColumn("words", word_list(F.col("text")))
    for name, source, pattern in cut:
        df = df.withColumn(f"no_{name}", F.regexp_replace(source, pattern, ""))
    lengths = [F.length(F.col(s)) for s in ("text", *(f"no_{name}" for name, _ in CLASSES[:-1]))]
    chars = [*(a - b for a, b in zip(lengths, lengths[1:], strict=False)), lengths[-1]]
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(NOT_SPACE)))
    common = F.array_join(F.filter("words", lambda w: w.isin(COMMON_WORDS)), EDGE + EDGE)
    df = df.select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        (lengths[0] - (lengths[1] - lengths[2])).cast("long").alias("word_chars"),
        (lengths[4] - lengths[5]).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array(*(c.cast("long") for c in chars)).alias("chars"),
        F.concat(F.lit(EDGE), common, F.lit(EDGE)).alias("common"),
    )
    counts = [
        F.floor((F.length("common") - F.length(F.replace("common", F.lit(EDGE + w + EDGE), F.lit("")))) / (len(w) + 2)).cast("long")
        for w in COMMON_WORDS
    ]
    return df.select("*", F.array(*counts).alias("seen")).drop("common").withColumn(
        "seen", F.concat("seen", F.array(F.col("n_words") - F.aggregate("seen", F.lit(0).cast("bigint"), lambda a, x: a + x)))
    )


def references(measured: DataFrame, languages: list[str] | None) -> dict[str, tuple[list[int], list[int]]]:
    """Summed histograms of the given languages, else of every language; a row for each comes to the driver."""
    sums = [F.sum(F.col(c)[i]) for c, n in (("chars", len(CLASSES)), ("seen", len(COMMON_WORDS) + 1)) for i in range(n)]
    asked = F.col("lang").isNotNull() if languages is None else F.col("lang").isin(languages)
    rows = measured.where(asked).groupBy("lang").agg(F.array(*sums).alias("sums")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {r["lang"]: (r["sums"][: len(CLASSES)], r["sums"][len(CLASSES) :]) for r in rows}


def js_distance(counts: Column, total: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of a histogram to a reference."""
    whole = max(sum(reference), 1)
    parts = None
    for i, n in enumerate(reference):
        p, q = counts[i] / total, F.lit(n / whole)
        m = (p + q) / 2
        part = F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
        if n:
            part = part + q * F.log2(q / m)
        parts = part if parts is None else parts + part
    return F.sqrt(F.greatest(F.lit(0.0), parts / 2))


def own_distance(counts: Column, total: Column, shares: Column) -> Column:
    """``js_distance`` to a reference that is a column of shares; null where there is none."""
    def part(n: Column, q: Column) -> Column:
        p = n / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))

    parts = F.aggregate(F.zip_with(counts, shares, part), F.lit(0.0), lambda a, x: a + x)
    return F.when(shares.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), parts / 2)))


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    languages: list[str] | None = None, judged_words: int = JUDGED_WORDS, farthest: float = FARTHEST,
) -> DataFrame:
    """Per row: the counts, base_failed, divergence (null where not judged) and kept.

    Null text counts as empty: all counts are 0 and the base rule fails. Texts under
    ``judged_words`` words are not judged. The others are judged against the nearest
    reference of ``languages``, by default those of COMMON, and by default also against
    that of their own language, whichever it is; with ``languages``, a text labelled
    with another language is not judged, nor is any text that meets no reference. More
    than MOST_LANGUAGES languages are an error. Repeated rows are judged each for itself; they all count for the
    references. Columns other than the three named are not read. An empty table
    gives no rows.
    """
    measured = stored(features(docs, id_col, text_col, lang_col), "features")
    known = references(measured, languages or None)
    further = {} if languages else {x: known.pop(x) for x in sorted(known) if x not in COMMON}
    n_chars = F.aggregate("chars", F.lit(0).cast("bigint"), lambda a, x: a + x)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    near = [
        (js_distance(F.col("chars"), F.col("n_chars"), chars) + js_distance(F.col("seen"), F.col("n_words"), seen)) / 2
        for _, (chars, seen) in sorted(known.items())
    ]
    if further:
        shares = lambda i: F.create_map(*(
            x for lang, sums in further.items() for x in (F.lit(lang), F.array(*(F.lit(n / max(sum(sums[i]), 1)) for n in sums[i])))
        ))[F.col("lang")]
        near.append((own_distance(F.col("chars"), F.col("n_chars"), shares(0)) + own_distance(F.col("seen"), F.col("n_words"), shares(1))) / 2)
    nearest = F.least(*near) if len(near) > 1 else near[0] if near else F.lit(None).cast("double")
    if languages:
        nearest = F.when(F.col("lang").isNull() | F.col("lang").isin(languages), nearest)
    far = F.when((F.col("n_words") >= judged_words) & (F.col("n_words") > 0), F.round(nearest, 6))
    out = measured.withColumn("n_chars", n_chars).withColumn("base_failed", failed).withColumn("divergence", far)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "divergence",
        (~F.col("base_failed") & F.coalesce(F.col("divergence") <= farthest, F.lit(True))).alias("kept"),
    )
