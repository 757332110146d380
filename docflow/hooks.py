"""Model hooks: embedding, scoring and text generation enter the engine here only."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.session import cut_lineage
from docflow.sources.buckets import read_buckets, table_exists, upsert_path, write_buckets

Embedder = Callable[[list[str]], np.ndarray]
TextModel = Callable[[list[str]], Sequence[str]]

EMBED_BATCH = 10
MAX_HASHES = 500_000


class _Hashes(dict):
    """Token -> number, worked out when first asked for; emptied when it grows too large. Bytes are Latin-1."""

    def __missing__(self, token: str | bytes) -> int:
        if len(self) >= MAX_HASHES:
            self.clear()
        raw = token.decode("latin-1") if isinstance(token, bytes) else token
        self[token] = h = int(hashlib.md5(raw.encode()).hexdigest()[:8], 16)
        return h


_HASHES = _Hashes()
# Lower-case Latin-1: letters and digits stay, all else becomes a blank.
_LATIN = bytes(c if re.match("[a-z0-9\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]", chr(c)) else 32 for c in range(256))


def _tokens(text: str) -> list:
    """Lower-cased runs of letters and digits, as bytes where the text is Latin-1."""
    import regex

    low = text.lower()
    try:
        return low.encode("latin-1").translate(_LATIN).split()
    except UnicodeEncodeError:
        return regex.findall(r"[\p{L}\p{Nd}]+", low)


class HashingEmbedder:
    """Deterministic stand-in for a model: signed token counts in ``dim`` slots."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, text in enumerate(texts):
            h = np.array([_HASHES[t] for t in _tokens(text or "")], dtype=np.int64)
            sign = 1.0 - 2.0 * (h // self.dim % 2)
            out[i] = np.bincount(h % self.dim, sign, self.dim)
        return out


def embed_column(embedder: Embedder, batch_size: int = EMBED_BATCH) -> Callable[[Column], Column]:
    """Column function text -> array<float>, calling the model in batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.fillna("").tolist()
            rows: list = []
            for at in range(0, len(texts), batch_size):
                rows.extend(np.asarray(embedder(texts[at : at + batch_size]), dtype=np.float32))
            yield pd.Series(rows, index=batch.index)

    return run


def _keyed(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_key", F.md5(F.coalesce(F.col(text), F.lit(""))))


def _vectors(texts: DataFrame, embedder: Embedder, batch_size: int) -> DataFrame:
    """(_key, embedding) of the distinct texts of (_key, _text)."""
    unique = texts.groupBy("_key").agg(F.any_value(F.col("_text")).alias("_text"))
    return unique.select("_key", embed_column(embedder, batch_size)(F.col("_text")).alias("embedding"))


def embed_once(df: DataFrame, text: str, embedder: Embedder, batch_size: int = EMBED_BATCH) -> DataFrame:
    """Add ``embedding``; each distinct text is embedded once, copies share the vector.

    The distinct side has one row per text hash; a text with very many copies is
    a skewed join key, which adaptive execution splits.
    """
    keyed = _keyed(df, text)
    vectors = _vectors(keyed.select("_key", F.col(text).alias("_text")), embedder, batch_size)
    return keyed.join(vectors, "_key").drop("_key")


def embed_stored(
    df: DataFrame, text: str, embedder: Embedder, path: str, batch_size: int = EMBED_BATCH, buckets: int = 64
) -> DataFrame:
    """As ``embed_once``, with the vectors kept by text hash in a table at ``path``.

    Hashes are compared with the table before any text moves; only texts it does not
    hold go to the model, and none if it holds all. A run that fails in between leaves
    the table as it was.
    """
    spark, keyed = df.sparkSession, _keyed(df, text)
    keys = keyed.select("_key").distinct()
    there = table_exists(spark, path)
    if there:
        keys = keys.join(read_buckets(spark, path).select("_key"), "_key", "left_anti")
    missing = cut_lineage(keys)
    if not there or not missing.isEmpty():
        texts = keyed.select("_key", F.col(text).alias("_text")).join(missing, "_key", "left_semi")
        fresh = _vectors(texts, embedder, batch_size)
        if there:
            upsert_path(spark, path, fresh, "_key", buckets)
        else:
            write_buckets(fresh, path, "_key", buckets)
    return keyed.join(read_buckets(spark, path), "_key").drop("_key")


def generate(model: TextModel, batch_size: int = EMBED_BATCH) -> Callable[[Column], Column]:
    """Column function prompt -> response; null where the model fails or the prompt is null.

    After a failed call its prompts are asked one by one, so a bad one stands alone.
    """

    def answers(prompts: list[str]) -> list:
        try:
            out = list(model(prompts))
            if len(out) == len(prompts):
                return out
        except Exception:  # noqa: BLE001 - a failed call is an empty response
            pass
        return [None] if len(prompts) == 1 else [answers([p])[0] for p in prompts]

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list = [None] * len(batch)
            asked = [i for i, p in enumerate(batch) if p is not None]
            for at in range(0, len(asked), batch_size):
                part = asked[at : at + batch_size]
                for i, a in zip(part, answers([batch.iloc[i] for i in part]), strict=True):
                    out[i] = a
            yield pd.Series(out, index=batch.index, dtype=object)

    return run
