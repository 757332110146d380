"""Line deduplication that returns keep bitmaps instead of text.

Every line becomes a row of two hashes, document and position; text stays where it
is. Rows are range-partitioned by hash and sorted by document and position inside a
partition, so one pass over a partition sees the first document of each line before
all others. A line that makes up a thousandth of all rows or more is hot: there are
at most that many, their first documents are aggregated before any shuffle and travel
back in a broadcast table, so no partition holds a hot line. What is dropped comes back
as words of 64 bits per document, of which only those with a dropped line are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.bind import let, rows_of
from docflow.llm.blocks import partitions, stored, text_or_empty

STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_POINTS = 10
HOT_KEYS = 1000  # bound of the broadcast table
TRACKED = 20 * HOT_KEYS
WORD = 64


def line_keys(text: Column, least: int = LEAST_POINTS) -> Column:
    """Array of (position, two hashes) of the lines that can be dropped.

    128 bits tell lines apart; two different lines sharing both hashes are not expected below 10^18 lines.
    """
    lines = F.split(F.translate(text, UPPER, LOWER), "\n")
    keyed = F.transform(lines, lambda line, at: F.struct(at.alias("at"), F.btrim(line, F.lit(STRIPPED)).alias("key")))
    able = F.filter(keyed, lambda k: F.char_length(k["key"]) >= least)
    return F.transform(
        able, lambda k: F.struct(k["at"].alias("at"), F.xxhash64(k["key"]).alias("h1"), F.xxhash64(F.lit("line"), k["key"]).alias("h2"))
    )


def _identity(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_or_empty(text_col)).alias("mark")]


def _occurrences(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    shaped = docs.select(*_identity(docs, id_col, text_col), line_keys(text_or_empty(text_col), least).alias("lines"))
    rows = rows_of(shaped, ["doc", "mark"], F.col("lines"), "_n", "line")
    return stored(rows.select("doc", "mark", "line.at", "line.h1", "line.h2"), "lines")


def hot_hashes(occurrences: DataFrame) -> list[int]:
    """First hashes that stand in a thousandth of all rows, by a frequent-items sketch; at most HOT_KEYS.

    What the sketch reports too much only takes the other way to the same result.
    """
    seen = occurrences.select(
        F.count("*").alias("n"), F.expr(f"approx_top_k(h1, {HOT_KEYS}, {TRACKED})").alias("top")
    )
    frequent = seen.select("n", F.inline("top")).where(F.col("count") * HOT_KEYS >= F.col("n")).where("count > 1")
    return [r["item"] for r in frequent.select("item").collect()]


def dropped_lines(occurrences: DataFrame) -> DataFrame:
    """(doc, mark, at) of the rows whose line stands in an earlier document. Null ids come after all others."""
    spark = occurrences.sparkSession
    hot = F.broadcast(spark.createDataFrame([(h,) for h in hot_hashes(occurrences)], "h1 long"))
    mine = (F.col("doc").isNull(), F.col("doc"))
    ahead = F.first("doc").over(
        Window.partitionBy("h1", "h2").orderBy(*(c.asc() for c in mine), "at").rowsBetween(Window.unboundedPreceding, 0)
    )
    cold = occurrences.join(hot, "h1", "left_anti").repartitionByRange(partitions(occurrences), "h1", "h2")
    by_window = cold.withColumn("ahead", ahead)
    common = occurrences.join(hot, "h1")
    firsts = common.groupBy("h1", "h2").agg(F.min("doc").alias("ahead"))  # one row per hot line
    by_table = common.join(F.broadcast(firsts), ["h1", "h2"])
    both = by_window.select("doc", "mark", "at", "ahead").unionAll(by_table.select("doc", "mark", "at", "ahead"))
    return both.where(~F.col("doc").eqNullSafe(F.col("ahead"))).select("doc", "mark", "at")


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """Per document with a dropped line: ``words``, its keep bitmap without the words that are all ones."""
    bit = F.expr(f"shiftleft(1L, cast(at % {WORD} as int))")
    marked = dropped.select("doc", "mark", F.expr(f"cast(at div {WORD} as int)").alias("word"), bit.alias("bit"))
    words = marked.repartition("doc", "mark").groupBy("doc", "mark", "word").agg(F.bit_or("bit").alias("gone"))
    kept = F.struct("word", F.bitwise_not("gone").alias("keep"))
    return words.groupBy("doc", "mark").agg(F.sort_array(F.collect_list(kept)).alias("words"))


def line_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_POINTS
) -> DataFrame:
    """(doc, mark, words) of every document with a dropped line; ``mark`` is the hash of its text."""
    return stored(keep_bitmaps(dropped_lines(_occurrences(docs, id_col, text_col, least))), "bitmaps")


def _whole(words: Column) -> Column:
    """All words up to the last stored one; those between stored ones are all ones."""
    before = lambda i: F.coalesce(F.get(words, i - 1)["word"], F.lit(-1))
    ones = lambda n: F.array_repeat(F.lit(-1).cast("long"), n)
    return F.flatten(F.transform(words, lambda w, i: F.concat(ones(w["word"] - before(i) - 1), F.array(w["keep"]))))


def kept_text(text: Column, words: Column) -> Column:
    """The text without the lines whose bit is 0; a null bitmap keeps all."""

    def standing(dense: Column) -> Column:
        bit = lambda i: F.coalesce(F.get(dense, (i / WORD).cast("int")), F.lit(-1).cast("long"))
        return F.filter(F.split(text, "\n"), lambda _, i: F.getbit(bit(i), i % WORD) == 1)

    return F.when(words.isNull(), text).otherwise(F.array_join(let(_whole(words), standing), "\n"))


def n_dropped(words: Column) -> Column:
    ones = F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(F.bitwise_not(w["keep"])))
    return F.coalesce(ones, F.lit(0).cast("long"))


def bitmap_text(words: Column) -> Column:
    """``word:hex`` of each stored word, comma-joined; empty if all lines stay."""
    shown = F.transform(words, lambda w: F.concat(w["word"].cast("string"), F.lit(":"), F.lower(F.lpad(F.hex(w["keep"]), 16, "0"))))
    return F.coalesce(F.array_join(shown, ","), F.lit(""))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, text (null as empty) and words of every row.

    A sort-merge join at every size: the bitmaps grow with the documents, so a plan
    that broadcasts them while they are few says nothing about the plan at scale.
    """
    own = docs.select(*_identity(docs, id_col, text_col), text_or_empty(text_col).alias("text")).alias("d")
    maps = bitmaps.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "words").hint("merge")
    met = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    return own.join(maps, met, "left").select("doc", "text", "words")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_POINTS
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_sha256, keep_words.

    Null and empty texts are one empty line and keep it. A document is what shares an
    id: of rows that repeat an id none loses a line to another, and null ids are one
    document after all others. Repeated lines of the first document stay. Other
    columns are not read. An empty table gives no rows.
    """
    rows = with_bitmaps(docs, line_bitmaps(docs, id_col, text_col, least), id_col, text_col)
    return rows.select(
        F.col("doc").alias("doc_id"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        n_dropped(F.col("words")).alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col("words")), 256).alias("kept_sha256"),
        bitmap_text(F.col("words")).alias("keep_words"),
    )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_POINTS
) -> DataFrame:
    """``docs`` with the kept lines as text and all other columns; a null text stays null."""
    bitmaps = line_bitmaps(docs, id_col, text_col, least)
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.select(*_identity(docs, id_col, text_col), *(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)))
    maps = bitmaps.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "words").hint("merge")
    met = own.join(maps, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left")
    shown = {n: F.col(n) for n in names}
    at = names[docs.columns.index(text_col)]
    shown[at] = kept_text(F.col(at), F.col("words"))
    return met.select(*(shown[n].alias(c) for c, n in zip(docs.columns, names, strict=True)))
