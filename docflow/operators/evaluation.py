"""Evaluation data, judged and rule-based scores, run comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.records import parse_score
from docflow.functions.text import answer_state, has_text, normalize_ws, slug

METRICS = [
    "faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness",
]


def first_answer(answers: Column) -> Column:
    """First answer that is not blank, whitespace collapsed."""
    clean = F.filter(F.transform(answers, normalize_ws), lambda a: F.length(a) > 0)
    return F.get(clean, F.lit(0))


def _head(text: Column, max_chars: int | None) -> Column:
    return text if max_chars is None else F.substring(text, 1, max_chars)


def contexts(documents: Column, limit: int | None = None, max_chars: int | None = None) -> Column:
    """Context blocks: the first usable document, then selected ones only.

    A block is title and paragraphs. ``limit`` and ``max_chars`` cut where they are given.
    """
    none = F.array().cast("array<string>")

    def block(d: Column) -> Column:
        paras = F.filter(
            F.transform(F.coalesce(d["paragraphs"], none), normalize_ws),
            lambda p: F.coalesce(F.length(p) > 0, F.lit(False)),
        )
        title = F.when(has_text(d["title"]), F.array(F.trim(d["title"]))).otherwise(none)
        lines = F.concat(title, paras)
        usable = (F.size(F.coalesce(d["paragraphs"], none)) > 0) & (F.size(lines) > 0)
        return F.struct(
            F.when(usable, _head(F.array_join(lines, "\n"), max_chars)).alias("text"),
            F.coalesce(d["is_selected"], F.lit(False)).alias("picked"),
        )

    blocks = F.filter(F.transform(documents, block), lambda b: b["text"].isNotNull())
    taken = F.filter(blocks, lambda b, i: (i == 0) | b["picked"])
    texts = F.transform(taken, lambda b: b["text"])
    return F.coalesce(texts if limit is None else F.slice(texts, 1, limit), none)


def sample_id() -> Column:
    blank = lambda c: F.when(F.length(F.col(c)) > 0, F.col(c))
    return F.trim(F.coalesce(blank("question_id"), blank("id"), blank("questionId"), F.lit("")))


def to_eval_samples(records: DataFrame, limit: int | None = None, max_contexts: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Records to samples; those without question, answer or id are dropped.

    With a ``limit`` the first records in file order are taken.
    """
    rows = records.select(
        sample_id().alias("sample_id"),
        F.trim("question").alias("question"),
        first_answer(F.col("answers")).alias("ground_truth"),
        contexts(F.col("documents"), max_contexts, max_chars).alias("contexts"),
        "question_type",
        "source_file",
        *[c for c in ("source_offset", "source_seq") if c in records.columns],
    ).where(has_text(F.col("question")) & F.col("ground_truth").isNotNull() & (F.length("sample_id") > 0))
    if limit is not None:
        rows = rows.orderBy("source_file", "source_offset", "source_seq").limit(limit)
    return rows.drop("source_offset", "source_seq")


def to_rule_cases(samples: DataFrame, top_k: int = 5) -> DataFrame:
    return samples.select(
        F.col("sample_id").alias("case_id"),
        F.lit("").alias("kb_id"),
        F.col("question").alias("query"),
        F.lit(top_k).alias("top_k"),
        F.array("ground_truth").alias("expected_answer_contains"),
        F.array().cast("array<string>").alias("expected_doc_names"),
        F.lit(False).alias("should_refuse"),
    )


def export_documents(records: DataFrame, max_docs: int | None = None, max_chars: int | None = None) -> DataFrame:
    """One rendered text per exported document: (sample_id, doc_index, file_name, text, ...)."""
    none = F.array().cast("array<string>")
    docs = F.coalesce("documents", F.array().cast(records.schema["documents"].dataType))
    picked = F.filter(docs, lambda d: F.coalesce(d["is_selected"], F.lit(False)))
    chosen = F.when(F.size(picked) > 0, picked).otherwise(docs)

    def body(d: Column, i: Column) -> Column:
        paras = F.filter(
            F.transform(F.coalesce(d["paragraphs"], none), normalize_ws),
            lambda p: F.coalesce(F.length(p) > 0, F.lit(False)),
        )
        return F.struct(
            (i + 1).alias("doc_index"),
            normalize_ws(F.coalesce(d["title"], F.lit(""))).alias("title"),
            _head(F.array_join(paras, "\n\n"), max_chars).alias("content"),
            F.coalesce(d["is_selected"], F.lit(False)).alias("is_selected"),
        )

    usable = F.filter(F.transform(chosen, body), lambda b: F.length(b["content"]) > 0)
    rows = records.select(
        sample_id().alias("sample_id"),
        normalize_ws(F.col("question")).alias("question"),
        first_answer(F.col("answers")).alias("ground_truth"),
        "source_file",
        F.inline(usable if max_docs is None else F.slice(usable, 1, max_docs)),
    ).where(has_text(F.col("question")) & F.col("ground_truth").isNotNull() & (F.length("sample_id") > 0))
    text = F.concat(
        F.lit("Sample ID: "), "sample_id", F.lit("\nQuestion: "), "question",
        F.lit("\nReference Answer: "), "ground_truth",
        F.lit("\nDocument Index: "), F.col("doc_index").cast("string"),
        F.lit("\nSelected By Dataset: "), F.when(F.col("is_selected"), "yes").otherwise("no"),
        F.when(F.length("title") > 0, F.concat(F.lit("\nTitle: "), "title")).otherwise(""),
        F.lit("\n\nContent:\n"), "content", F.lit("\n"),
    )
    name = F.concat(slug(F.col("sample_id")), F.lit("-doc"), F.col("doc_index").cast("string"), F.lit(".txt"))
    return rows.withColumn("file_name", name).withColumn("text", text)


def export_manifest(exported: DataFrame) -> DataFrame:
    """Samples with their file names. A sample has at most ``max_docs`` files."""
    files = F.array_sort(F.collect_list(F.struct("doc_index", "file_name")))
    return exported.groupBy("sample_id", "question", "ground_truth", "source_file").agg(
        F.transform(files, lambda f: f["file_name"]).alias("exported_docs")
    )


def judge_scores(responses: DataFrame, metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """Judge responses (sample_id, metric, response) to one row of scores per sample."""
    scored = responses.withColumn("_score", parse_score(F.col("response")))
    return scored.groupBy("sample_id").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("_score"))).alias(m) for m in metrics]
    )


def sample_overall(metrics: Sequence[str] = tuple(METRICS)) -> Column:
    """Mean of the scores a sample has; 0 if it has none."""
    present = F.filter(F.array(*[F.col(m) for m in metrics]), lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(present) > 0, total / F.size(present)).otherwise(F.lit(0.0))


def eval_report(results: DataFrame, metrics: Sequence[str] = tuple(METRICS), by: Sequence[str] = ()) -> DataFrame:
    """Mean per metric over the samples that have it; overall is the mean of those means."""
    means = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), *[F.avg(m).alias(f"avg_{m}") for m in metrics]
    )
    present = F.filter(F.array(*[F.col(f"avg_{m}") for m in metrics]), lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda a, v: a + v)
    return means.withColumn("overall", F.when(F.size(present) > 0, total / F.size(present)))


def rule_eval(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Expected terms contained, expected documents cited, refusal as expected.

    ``cases`` has (case_id, expected_answer_contains, expected_doc_names,
    should_refuse), ``answers`` (case_id, answer, cited_docs).
    """
    j = cases.join(answers, "case_id", "left")
    low = F.lower(F.coalesce("answer", F.lit("")))
    none = F.array().cast("array<string>")
    wanted = F.coalesce("expected_answer_contains", none)
    hit = F.filter(wanted, lambda t: F.contains(low, F.lower(t)))
    docs = F.coalesce("expected_doc_names", none)
    cited = F.array_intersect(docs, F.coalesce("cited_docs", none))
    refused = answer_state(F.coalesce("answer", F.lit(""))) != "answered"
    out = j.select(
        "case_id",
        F.size(wanted).alias("expected_terms"),
        F.size(hit).alias("matched_terms"),
        (F.size(hit) == F.size(wanted)).alias("answer_passed"),
        (F.size(cited) == F.size(F.array_distinct(docs))).alias("citation_passed"),
        (refused == F.coalesce("should_refuse", F.lit(False))).alias("refusal_passed"),
    )
    passed = F.col("answer_passed") & F.col("citation_passed") & F.col("refusal_passed")
    reasons = F.array_join(
        F.filter(
            F.array(
                F.when(~F.col("answer_passed"), "answer"),
                F.when(~F.col("citation_passed"), "citation"),
                F.when(~F.col("refusal_passed"), "refusal"),
            ),
            lambda r: r.isNotNull(),
        ),
        ",",
    )
    return out.withColumn("passed", passed).withColumn("failure_reason", reasons)


def rule_eval_report(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals and rates over case flags (0/1 or boolean)."""
    flag = lambda c: F.col(c).cast("int")
    whole = flag("answer_passed") * flag("citation_passed") * flag("refusal_passed")
    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(whole).cast("bigint").alias("passed"),
        (F.count(F.lit(1)) - F.sum(whole)).cast("bigint").alias("failed"),
        F.avg(whole).alias("pass_rate"),
        F.avg(flag("answer_passed")).alias("answer_accuracy"),
        F.avg(flag("citation_passed")).alias("citation_hit_rate"),
        F.avg(flag("refusal_passed")).alias("refusal_accuracy"),
    )


def compare_runs(base: DataFrame, target: DataFrame) -> DataFrame:
    """Per case: both results and what changed."""
    pick = lambda df, p: df.select(
        "case_id",
        (F.col("answer_passed").cast("int") * F.col("citation_passed").cast("int") * F.col("refusal_passed").cast("int")).alias(f"{p}_passed"),
    )
    j = pick(base, "base").join(pick(target, "target"), "case_id", "full_outer")
    change = (
        F.when(F.col("base_passed").isNull(), "added")
        .when(F.col("target_passed").isNull(), "removed")
        .when(F.col("base_passed") == F.col("target_passed"), "unchanged")
        .when(F.col("target_passed") == 1, "improved")
        .otherwise("regressed")
    )
    return j.withColumn("change", change)


def compare_reports(base: DataFrame, target: DataFrame) -> DataFrame:
    """Rate differences, target minus base; both sides are one aggregate row."""
    rates = ["pass_rate", "answer_accuracy", "citation_hit_rate", "refusal_accuracy"]
    tagged = rule_eval_report(base).withColumn("_s", F.lit(-1)).unionByName(
        rule_eval_report(target).withColumn("_s", F.lit(1))
    )
    return tagged.agg(*[F.sum(F.col(r) * F.col("_s")).alias(f"{r}_delta") for r in rates])


def retrieval_quality(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Recall at k, mean reciprocal rank and hit rate over all queries with truth.

    ``hits`` has (query_id, chunk_id, rank), ``truth`` (query_id, chunk_id).
    """
    pairs = truth.select("query_id", "chunk_id").distinct()
    found = hits.where(F.col("rank") <= k).join(pairs, ["query_id", "chunk_id"])
    per_query = found.groupBy("query_id").agg(
        F.countDistinct("chunk_id").alias("_hits"), F.min("rank").alias("_first")
    )
    wanted = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("_wanted"))
    q = wanted.join(per_query, "query_id", "left")
    hits_n = F.coalesce("_hits", F.lit(0))
    return q.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(hits_n / F.col("_wanted")).alias("recall_at_k"),
        F.avg(F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0))).alias("mrr"),
        F.avg(F.when(hits_n > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    )
