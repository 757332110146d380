"""Answers, verification and trace rows for a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.records import parse_verdict
from docflow.functions.text import (
    answer_state,
    bullet_contexts,
    estimate_cost,
    estimate_tokens,
    fill_prompt,
    has_text,
    round_half_up,
)
from docflow.hooks import TextModel, generate
from docflow.plans.retrieve import Retrieval

# Our own wording; the two marks take the evidence and the question.
PROMPT = (
    "Answer only from the evidence. Say so if it is not enough. Cite block labels.\n\n"
    "Evidence:\n%s\n\nQuestion: %s\n"
)
EVIDENCE_PROMPT = "Is the evidence sufficient? Reply as JSON.\nQuestion: %s\nEvidence:\n%s\n"
FAITHFUL_PROMPT = "Is the answer supported? Reply as JSON.\nQuestion: %s\nEvidence:\n%s\nAnswer: %s\n"


def answer(queries: DataFrame, found: Retrieval, model: TextModel, prompt: str = PROMPT) -> DataFrame:
    """Answer, state, token and cost estimates per query; all parts are kept apart."""
    q = queries.select("query_id", "query").join(found.contexts, "query_id", "left")
    text = fill_prompt(prompt, F.coalesce("context", F.lit("")), F.col("query"))
    asked = q.withColumn("prompt", text)
    answered = asked.withColumn("answer", generate(model)(F.col("prompt")))
    t = answered.withColumn(
        "answer_state",
        F.when(F.coalesce("blocks", F.lit(0)) == 0, "empty_retrieval").otherwise(
            answer_state(F.coalesce("answer", F.lit("")))
        ),
    )
    for name, column in (("chat_input", "prompt"), ("chat_output", "answer"), ("embedding", "query")):
        t = t.withColumn(f"{name}_tokens", estimate_tokens(F.coalesce(column, F.lit(""))))
    t = (
        t.withColumn("chat_input_cost", estimate_cost(F.col("chat_input_tokens"), "chat_in"))
        .withColumn("chat_output_cost", estimate_cost(F.col("chat_output_tokens"), "chat_out"))
        .withColumn("embedding_cost", estimate_cost(F.col("embedding_tokens"), "embedding"))
    )
    total = F.col("chat_input_cost") + F.col("chat_output_cost") + F.col("embedding_cost")
    return t.withColumn(
        "total_tokens", F.col("chat_input_tokens") + F.col("chat_output_tokens") + F.col("embedding_tokens")
    ).withColumn("total_cost", round_half_up(total, 6))


def trace_rows(answers: DataFrame, name: str = "rag_query") -> DataFrame:
    """Run rows for the observability tables, all estimates in ``extra_data``."""
    extra = F.to_json(
        F.struct(
            F.col("answer_state").alias("answerState"),
            F.col("chat_input_tokens").alias("estimatedChatInputTokens"),
            F.col("chat_output_tokens").alias("estimatedChatOutputTokens"),
            F.col("embedding_tokens").alias("estimatedEmbeddingTokens"),
            F.col("chat_input_cost").alias("estimatedChatInputCost"),
            F.col("chat_output_cost").alias("estimatedChatOutputCost"),
            F.col("embedding_cost").alias("estimatedEmbeddingCost"),
            F.col("total_tokens").alias("estimatedTotalTokens"),
            F.col("total_cost").alias("estimatedTotalCost"),
        )
    )
    return answers.select(
        F.col("query_id").alias("trace_id"), F.lit(name).alias("trace_name"),
        F.lit("SUCCESS").alias("status"), extra.alias("extra_data"), F.lit(0).alias("deleted"),
    )


def top_contexts(hits: DataFrame, m: int | None = None) -> DataFrame:
    """Contents per query, or the first ``m``, as an array in rank order; hits are cut per query before."""
    w = Window.partitionBy("query_id").orderBy("rank")
    first = hits.withColumn("_rn", F.row_number().over(w))
    first = first if m is None else first.where(F.col("_rn") <= m)
    return first.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_rn", "content"))), lambda x: x["content"]
        ).alias("contexts")
    )


def _verdict(response: Column, flag: str, empty: Column, empty_value: Column) -> Column:
    """Model failure counts as passed with score 1."""
    failed = F.struct(
        F.lit(True).alias(flag), F.lit(1.0).alias("score"),
        F.lit("Error during verification").alias("reason"),
    )
    return (
        F.when(empty, empty_value).when(response.isNull(), failed).otherwise(parse_verdict(response, flag))
    )


def verify(answers: DataFrame, hits: DataFrame, model: TextModel, max_contexts: int | None = None) -> DataFrame:
    """Is the evidence sufficient, is the answer faithful: scores per query over all or ``max_contexts`` hits."""
    ctx = answers.select("query_id", "query", "answer").join(top_contexts(hits, max_contexts), "query_id", "left")
    none = F.coalesce(F.size("contexts"), F.lit(0)) <= 0
    listed = F.coalesce(bullet_contexts(F.col("contexts")), F.lit(""))
    blank = ~has_text(F.col("answer"))
    ask = generate(model)
    asked = ctx.withColumn(
        "_e", ask(F.when(~none, fill_prompt(EVIDENCE_PROMPT, F.col("query"), listed)))
    ).withColumn(
        "_f", ask(F.when(~blank, fill_prompt(FAITHFUL_PROMPT, F.col("query"), listed, F.col("answer"))))
    )
    no_hits = F.struct(
        F.lit(False).alias("sufficient"), F.lit(0.0).alias("score"), F.lit("No results found").alias("reason")
    )
    no_text = F.struct(
        F.lit(True).alias("faithful"), F.lit(1.0).alias("score"), F.lit("Empty answer").alias("reason")
    )
    return asked.select(
        "query_id",
        _verdict(F.col("_e"), "sufficient", none, no_hits).alias("_ev"),
        _verdict(F.col("_f"), "faithful", blank, no_text).alias("_fv"),
    ).select(
        "query_id", "_ev.sufficient", F.col("_ev.score").alias("evidence_score"),
        F.col("_ev.reason").alias("evidence_reason"), "_fv.faithful",
        F.col("_fv.score").alias("faithful_score"), F.col("_fv.reason").alias("faithful_reason"),
    )
