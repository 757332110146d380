"""Conversation level derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import normalize_ws, truncate


def auto_title(messages: DataFrame) -> DataFrame:
    """Title of a conversation: its first user message, cut to 30 characters."""
    first = messages.where(F.col("role") == "user").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("_t")
    )
    return first.select("conv_id", truncate(normalize_ws(F.col("_t")), 30, "...").alias("title"))
