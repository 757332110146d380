"""Judged evaluation: five prompts per sample, scores, report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import fill_prompt, has_text, join_contexts, number_contexts
from docflow.hooks import TextModel, generate
from docflow.operators.evaluation import METRICS, eval_report, judge_scores, sample_overall

# Our own wording; marks are filled in the order named in ``judge_prompts``.
PROMPTS = {
    "faithfulness": 'Rate support 0..1 as {"score": x}.\nContext:\n%s\nQuestion: %s\nAnswer: %s\n',
    "answer_relevancy": 'Rate relevance 0..1 as {"score": x}.\nQuestion: %s\nAnswer: %s\n',
    "context_precision": 'Rate context order 0..1 as {"score": x}.\n%sQuestion: %s\nTruth: %s\n',
    "context_recall": 'Rate coverage 0..1 as {"score": x}.\nContext:\n%s\nQuestion: %s\nTruth: %s\n',
    "answer_correctness": 'Rate agreement 0..1 as {"score": x}.\nQuestion: %s\nAnswer: %s\nTruth: %s\n',
}


class Evaluation(NamedTuple):
    results: DataFrame
    report: DataFrame


def judge_prompts(answers: DataFrame) -> DataFrame:
    """(sample_id, metric, prompt); a null prompt is not asked.

    ``answers`` has (sample_id, question, ground_truth, answer, contexts).
    """
    c, q = F.col("contexts"), F.col("question")
    a, g = F.col("answer"), F.col("ground_truth")
    usable = has_text(a) & (F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0)
    prompts = {
        "faithfulness": F.when(usable, fill_prompt(PROMPTS["faithfulness"], join_contexts(c), q, a)),
        "answer_relevancy": fill_prompt(PROMPTS["answer_relevancy"], q, a),
        "context_precision": F.when(has_text(g), fill_prompt(PROMPTS["context_precision"], number_contexts(c), q, g)),
        "context_recall": F.when(has_text(g), fill_prompt(PROMPTS["context_recall"], join_contexts(c), q, g)),
        "answer_correctness": F.when(has_text(g), fill_prompt(PROMPTS["answer_correctness"], q, a, g)),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), prompts[m].alias("prompt")) for m in METRICS])
    return answers.select("sample_id", F.inline(rows))


def evaluate(answers: DataFrame, judge: TextModel) -> Evaluation:
    """Judge every sample and metric, then average."""
    asked = judge_prompts(answers).withColumn("response", generate(judge)(F.col("prompt")))
    scores = judge_scores(asked)
    usable = has_text(F.col("answer")) & (F.size("contexts") > 0)
    results = (
        answers.select("sample_id", "question", "answer", usable.alias("_usable"))
        .join(scores, "sample_id")
        .withColumn("faithfulness", F.when(~F.coalesce("_usable", F.lit(False)), 0.0).otherwise(F.col("faithfulness")))
        .drop("_usable")
        .withColumn("overall", sample_overall())
    )
    return Evaluation(results, eval_report(results))
