"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed bigrams and trigrams of every labelled text per label;
a task adds them up in numpy and hands on one row per label and bucket it met.
The log-probability matrix (classes x 32,768 buckets, both bounded) is broadcast;
documents are scored in batches by gathering matrix rows and adding them up per
document. Neither step shuffles text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.blocks import raw_bytes, runs_of_rows, text_or_empty

BUCKETS = 1 << 15
SCORED = 1 << 20  # numbers of the matrix that are gathered together
MAX_CLASSES = 256
SLICE_BYTES = 1 << 20
LABELS_HELD = 64
SMOOTHING = 0.5
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every bigram and trigram of the lower-cased texts, and the text each belongs to.

    A text stands between two blanks, so that first and last letters count as such.
    """
    padded = [f" {t.lower()} " for t in texts]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    pair = codes[:-1] * np.uint64(0x10FFFF + 2) + codes[1:]
    three = pair[:-1] * np.uint64(0x10FFFF + 2) + codes[2:] + np.uint64(1 << 62)
    found, owners = [], []
    for grams, width in ((pair, 2), (three, 3)):
        inside = owner[: len(grams)] == owner[width - 1 :]
        mixed = grams[inside]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD
        found.append((mixed >> np.uint64(64 - 15)).astype(np.int64))
        owners.append(owner[: len(grams)][inside])
    return np.concatenate(found), np.concatenate(owners)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    _, offsets = raw_bytes(batch.column("text"))
    for first, last in runs_of_rows(offsets, SLICE_BYTES):
        yield first, last, batch.column("text").slice(first, last - first).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, bucket, n) of a partition; bucket -1 counts documents."""
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for label, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(at)), pa.array(at - 1), pa.array(counts[at])], names=["label", "bucket", "n"]
            )
        held.clear()

    for batch in batches:
        labels = np.array(batch.column("label").to_pylist(), dtype=object)
        for first, last, texts in _slices(batch):
            buckets, owner = ngram_buckets(texts)
            names, code = np.unique(labels[first:last].astype(str), return_inverse=True)
            for c, name in enumerate(names):
                if name not in held:
                    if len(held) >= LABELS_HELD:
                        yield from flush()
                    held[name] = np.zeros(BUCKETS + 1, np.int64)
                mine = held[name]
                mine[0] += int((code == c).sum())
                mine[1:] += np.bincount(buckets[code[owner] == c], minlength=BUCKETS)
    yield from flush()


@dataclass
class LanguageModel:
    """Sorted labels, their log priors and the log-probabilities of buckets (buckets x labels)."""

    labels: list[str]
    prior: np.ndarray
    weight: np.ndarray


def train(labelled: DataFrame, text_col: str, label_col: str, max_classes: int = MAX_CLASSES) -> LanguageModel:
    """Fit on all rows with a label. More than ``max_classes`` labels raise an error."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("label"), text_or_empty(text_col).alias("text")
    )
    counts = rows.mapInArrow(_count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    bound = max_classes * (BUCKETS + 1)
    table = counts.limit(bound + 1).toArrow()
    labels = sorted(set(table.column("label").to_pylist()))
    if table.num_rows > bound or len(labels) > max_classes:
        raise ValueError(f"more than {max_classes} languages in {label_col}")
    dense = np.zeros((BUCKETS + 1, len(labels)))
    at = {label: i for i, label in enumerate(labels)}
    dense[table.column("bucket").to_numpy() + 1, [at[x] for x in table.column("label").to_pylist()]] = table.column("n").to_numpy()
    documents, grams = dense[0], dense[1:] + SMOOTHING
    prior = np.log(documents / documents.sum()) if len(labels) else documents
    return LanguageModel(labels, prior, np.log(grams / grams.sum(axis=0)) if len(labels) else grams)


def scores(texts: list[str], model: LanguageModel) -> np.ndarray:
    """Posterior probabilities, texts x labels.

    The n-grams of a text are counted per bucket first; the sparse rows then meet the
    matrix so many counts at a time that an array of SCORED numbers holds them.
    """
    buckets, owner = ngram_buckets(texts)
    cells, n = np.unique(owner.astype(np.int64) * BUCKETS + buckets, return_counts=True)
    owner, buckets = np.divmod(cells, BUCKETS)
    log = np.tile(model.prior, (len(texts), 1))
    step = max(1, SCORED // max(1, len(model.labels)))
    for at in range(0, len(cells), step):
        own = owner[at : at + step]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        part = model.weight[buckets[at : at + step]] * n[at : at + step, None]
        log[own[starts]] += np.add.reduceat(part, starts, axis=0)
    odds = np.exp(log - log.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def _predict(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            label, score = [], []
            for _, _, texts in _slices(batch):
                best = scores(texts, model) if model.labels else None
                for i, text in enumerate(texts):
                    if best is None or not _LETTER.search(text):
                        label.append(UNKNOWN)
                        score.append(0.0)
                    else:
                        c = int(best[i].argmax())
                        label.append(model.labels[c])
                        score.append(float(min(1.0, best[i, c])))
            columns = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            columns |= {"lang_pred": pa.array(label, pa.string()), "score": pa.array(score, pa.float64())}
            yield pa.RecordBatch.from_pydict(columns)

    return task


def held_out(id_col: str) -> Column:
    """True for the documents that are not learned from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (posterior of the label).

    Null texts and texts without a letter get ``und`` and score 0, as all texts do
    if nothing was learned. Equal scores go to the first label by code point.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text")
    )
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(
    docs: DataFrame, model: LanguageModel, least: float, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose predicted label is not ``und`` and scores at least ``least``; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shaped = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), text_or_empty(text_col).alias("text"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {shaped.schema[n].dataType.simpleString()}" for n in names)
    judged = shaped.mapInArrow(_predict(shared), f"{kinds}, lang_pred string, score double")
    kept = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Train on the rows that are not held out, predict all rows; whole texts both times."""
    return predict(docs, train(docs.where(~held_out(id_col)), text_col, label_col), id_col, text_col)
