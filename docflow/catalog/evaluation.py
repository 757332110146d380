"""Evaluation data, scores and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.catalog import base as B
from docflow.catalog.retrieval import KEYWORD_SQL, few, key_queries, keyword_hits
from docflow.catalog.text import tok, ws
from docflow.functions.text import PRICE_PER_1K_TOKENS, REFUSAL_MARKERS
from docflow.operators import evaluation as E
from docflow.plans.answer import EVIDENCE_PROMPT, FAITHFUL_PROMPT, PROMPT, answer, top_contexts, trace_rows, verify
from docflow.plans.evaluate import PROMPTS, evaluate
from docflow.plans.retrieve import Retrieval
from docflow.session import work_path
from docflow.sources.readers import parse_json_lines
from docflow.sources.writers import write_corpus, write_report

col = F.col


def record_rows(s, d):
    """Documents as evaluation records: question, answers and three context documents each."""
    x = B.load(s, d, "documents")
    line = F.split("text", "\n")
    doc = lambda i, sel: F.struct(
        F.concat(col("source"), F.lit(f" {i}")).alias("title"), sel.alias("is_selected"),
        F.filter(line, lambda _, k: k % 3 == i).alias("paragraphs"),
    )
    return x.select(
        F.when(col("doc_id") % 5 > 0, col("doc_id").cast("string")).alias("question_id"),
        F.when(col("doc_id") % 10 == 0, F.concat(F.lit("x"), col("doc_id").cast("string"))).alias("id"),
        F.substring_index("text", ".", 1).alias("question"), col("lang").alias("question_type"),
        F.array(F.lit("  "), F.when(col("doc_id") % 7 > 0, F.element_at(line, -1))).alias("answers"),
        F.array(doc(0, col("doc_id") % 2 == 0), doc(1, F.lit(False)), doc(2, F.lit(True))).alias("documents"),
    )


def records(s, d):
    """The records through JSON lines files."""
    path = work_path(s, "records")
    record_rows(s, d).write.json(path)
    return parse_json_lines(s.read, path)


def samples(s, d):
    x = E.to_eval_samples(records(s, d))
    return x.select("sample_id", "question", "ground_truth", F.array_join("contexts", "||").alias("contexts"), "question_type")


REC_SQL = rf"""WITH b AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls, trim(split_part(text, '.', 1)) AS question,
 CASE WHEN doc_id % 5 > 0 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 10 = 0 THEN concat('x', doc_id) ELSE '' END AS sample_id, CASE WHEN doc_id % 7 > 0 THEN string_split(text, chr(10))[-1] END AS a FROM documents),
c AS (SELECT *, {ws('a')} AS ground_truth, list_transform([0, 1, 2], lambda i: list_filter(list_transform(list_filter(ls, lambda l, k: (k - 1) % 3 = i), lambda l: {ws('l')}), lambda l: length(l) > 0)) AS ps,
  list_transform([0, 1, 2], lambda i: len(list_filter(ls, lambda l, k: (k - 1) % 3 = i))) AS np FROM b),
r AS (SELECT * FROM c WHERE regexp_matches(question, '\S') AND length(ground_truth) > 0 AND length(sample_id) > 0)
"""
SAMPLES_SQL = REC_SQL + """, k AS (SELECT *, list_filter(list_transform([1, 2, 3], lambda i: CASE WHEN np[i] > 0 THEN {'i': i, 't': concat(source, ' ', i - 1, CASE WHEN len(ps[i]) > 0 THEN chr(10) ELSE '' END, array_to_string(ps[i], chr(10)))} END), lambda x: x IS NOT NULL) AS bl FROM r)
SELECT sample_id, question, ground_truth, array_to_string(list_transform(list_filter(bl, lambda x, j: j = 1 OR x.i = 3 OR (x.i = 1 AND doc_id % 2 = 0)), lambda x: x.t), '||') AS contexts, lang AS question_type FROM k"""


def exported(s, d):
    rows = record_rows(s, d).withColumn("questionId", F.lit(None).cast("string")).withColumn("source_file", F.lit("documents"))
    return E.export_documents(rows)


def corpus(s, d):
    """Exported texts through files."""
    path = work_path(s, "corpus")
    docs = exported(s, d)
    write_corpus(docs, E.export_manifest(docs), path)
    return s.read.schema("file_name string, text string").json(f"{path}/documents")


def manifest(s, d):
    return E.export_manifest(exported(s, d)).select("sample_id", "ground_truth", F.array_join("exported_docs", ",").alias("files"))


EXPORT_CTE = REC_SQL + r""", s AS (SELECT *, unnest(CASE WHEN doc_id % 2 = 0 THEN [1, 3] ELSE [3] END) AS i, unnest(CASE WHEN doc_id % 2 = 0 THEN [1, 2] ELSE [1] END) AS doc_index FROM (SELECT * REPLACE (""" + ws("question") + r""" AS question) FROM r)),
x AS (SELECT sample_id, ground_truth, doc_index, concat(sample_id, '-doc', doc_index, '.txt') AS file_name, concat('Sample ID: ', sample_id, chr(10), 'Question: ', question, chr(10), 'Reference Answer: ', ground_truth, chr(10), 'Document Index: ', doc_index, chr(10),
 'Selected By Dataset: yes', chr(10), 'Title: ', source, ' ', i - 1, chr(10), chr(10), 'Content:', chr(10), array_to_string(ps[i], concat(chr(10), chr(10))), chr(10)) AS text FROM s WHERE len(ps[i]) > 0)
"""


def scores(s, d):
    return E.judge_scores(B.judge(s, d)).withColumn("overall", E.sample_overall())


SCORES_CTE = rf"""j AS ({B.JUDGE_SQL}), p AS (SELECT sample_id, metric, coalesce(TRY_CAST(regexp_extract(response, '"score"\s*:\s*([0-9.]+)', 1) AS DOUBLE), TRY_CAST(regexp_extract(response, '分数[：:]\s*([0-9.]+)', 1) AS DOUBLE)) AS x FROM j),
w AS (SELECT sample_id, max(CASE WHEN x > 1 THEN 1e0 ELSE x END) FILTER (metric = 'faithfulness') AS faithfulness, max(CASE WHEN x > 1 THEN 1e0 ELSE x END) FILTER (metric = 'answer_relevancy') AS answer_relevancy FROM p GROUP BY sample_id)"""


def report(s, d):
    """The report through its JSON sink."""
    path = work_path(s, "report")
    r = E.eval_report(scores(s, d))
    write_report(r, path)
    back = s.read.schema(r.schema).json(path)
    return back.select("samples", F.round("avg_faithfulness", 6).alias("faithfulness"), F.round("avg_answer_relevancy", 6).alias("answer_relevancy"), "avg_context_recall", F.round("overall", 6).alias("overall"))


def run_report(s, d):
    r = E.rule_eval_report(B.cases(s, d))
    return r.select("total", "passed", "failed", *[F.round(c, 6).alias(c) for c in ("pass_rate", "answer_accuracy", "citation_hit_rate", "refusal_accuracy")])


def second_run(s, d):
    """A later run of the cases: some flip, some are gone, some are new."""
    c = B.cases(s, d).where("case_id % 9 <> 4").withColumn("answer_passed", F.when(col("case_id") % 4 == 0, 1).otherwise(col("answer_passed")))
    return c.withColumn("case_id", F.when(col("case_id") % 11 == 0, col("case_id") + 1000000).otherwise(col("case_id")))


SECOND_CTE = f"""a AS ({B.CASES_SQL}), b AS (SELECT CASE WHEN case_id % 11 = 0 THEN case_id + 1000000 ELSE case_id END AS case_id, CASE WHEN case_id % 4 = 0 THEN 1 ELSE answer_passed END AS answer_passed, citation_passed, refusal_passed FROM a WHERE case_id % 9 <> 4),
x AS (SELECT case_id, CAST(answer_passed * citation_passed * refusal_passed AS INTEGER) AS base_passed FROM a), y AS (SELECT case_id, CAST(answer_passed * citation_passed * refusal_passed AS INTEGER) AS target_passed FROM b)"""


def rule_cases(s, d):
    """Cases on conversations: the first words of every user turn are expected in the answer behind it."""
    c = B.load(s, d, "conversations")
    case = lambda turn: (col("conv_id") * 1000000 + turn).alias("case_id")
    cases = c.where("role = 'user'").select(
        case(col("turn")), F.slice(F.split("text", " "), 1, 2).alias("expected_answer_contains"),
        F.array(F.concat(F.lit("d"), (col("conv_id") % 3).cast("string"))).alias("expected_doc_names"), (col("conv_id") % 4 == 0).alias("should_refuse"),
    )
    answers = c.where("role = 'assistant'").select(
        case(col("turn") - 1), F.when(col("conv_id") % 6 == 0, F.concat(F.lit("证据不足 "), col("text"))).otherwise(col("text")).alias("answer"), F.array(F.lit("d0"), F.lit("d1")).alias("cited_docs"),
    )
    return E.rule_eval(cases, answers)


RULE_SQL = r"""WITH c AS (SELECT conv_id * 1000000 + turn AS case_id, string_split(text, ' ')[1:2] AS w, conv_id % 3 AS dn, conv_id % 4 = 0 AS refuse FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id * 1000000 + turn - 1 AS case_id, CASE WHEN conv_id % 6 = 0 THEN concat('证据不足 ', text) ELSE text END AS a FROM conversations WHERE role = 'assistant'),
j AS (SELECT c.case_id, w, len(list_filter(w, lambda t: contains(lower(coalesce(a, '')), lower(t)))) AS m, dn < 2 AND a IS NOT NULL AS cp, (a IS NULL OR NOT regexp_matches(a, '\S') OR contains(regexp_replace(a, '\s+', '', 'g'), '证据不足')) = refuse AS rp FROM c LEFT JOIN a ON a.case_id = c.case_id),
f AS (SELECT case_id, CAST(len(w) AS INTEGER) AS expected_terms, CAST(m AS INTEGER) AS matched_terms, m = len(w) AS answer_passed, cp AS citation_passed, rp AS refusal_passed FROM j)
SELECT *, answer_passed AND citation_passed AND refusal_passed AS passed, array_to_string(list_filter([CASE WHEN NOT answer_passed THEN 'answer' END, CASE WHEN NOT citation_passed THEN 'citation' END, CASE WHEN NOT refusal_passed THEN 'refusal' END], lambda x: x IS NOT NULL), ',') AS failure_reason FROM f"""


def quality(s, d):
    """Documents of a question's label class count as relevant."""
    truth = key_queries(s, d).join(B.load(s, d, "labels"), (col("doc_id") % 40) == (col("query_id") % 40)).select("query_id", col("doc_id").alias("chunk_id"))
    q = E.retrieval_quality(keyword_hits(s, d, 50), truth, 50)
    return q.select("queries", *[F.round(c, 6).alias(c) for c in ("recall_at_k", "mrr", "hit_rate")])


def quality_sql():
    return KEYWORD_SQL.replace("{k}", "50") + """, tr AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark JOIN labels ON doc_id % 40 = item_id % 40),
fo AS (SELECT kr.query_id, count(*) AS h, min(rank) AS f FROM kr JOIN tr ON tr.query_id = kr.query_id AND tr.chunk_id = kr.chunk_id GROUP BY ALL), wn AS (SELECT query_id, count(*) AS w FROM tr GROUP BY ALL)
SELECT count(*) AS queries, round(avg(coalesce(h, 0) / CAST(w AS DOUBLE)), 6) AS recall_at_k, round(avg(coalesce(1e0 / f, 0e0)), 6) AS mrr, round(avg(CASE WHEN h > 0 THEN 1e0 ELSE 0e0 END), 6) AS hit_rate FROM wn LEFT JOIN fo USING (query_id)"""


def echo(prompts):
    """Stand-in for a chat model: repeats the last line of the prompt."""
    return [p.strip().rsplit("\n", 1)[-1] for p in prompts]


def length_judge(prompts):
    """Stand-in for a judge: a score from the prompt length, sometimes no JSON."""
    return ["no answer" if len(p) % 7 == 0 else '{"score": 0.%d, "sufficient": %s, "faithful": true}' % (len(p) % 10, str(len(p) % 2 == 0).lower()) for p in prompts]


def _found(s, d):
    from docflow.catalog.retrieval import key_chunks
    from docflow.operators.retrieval import attach_chunks, evidence_context

    hits = attach_chunks(keyword_hits(s, d), key_chunks(s, d), ["content", "doc_id", "chunk_index", "doc_name", "heading_path", "segment_type"], few(s, d))
    return Retrieval(hits, evidence_context(hits, 8))


def answers(s, d):
    return answer(key_queries(s, d), _found(s, d), echo)


TRACE = (
    "answerState string, estimatedChatInputTokens bigint, estimatedChatOutputTokens bigint, estimatedEmbeddingTokens bigint, estimatedChatInputCost double, "
    "estimatedChatOutputCost double, estimatedEmbeddingCost double, estimatedTotalTokens bigint, estimatedTotalCost double"
)


def answered(s, d):
    return trace_rows(answers(s, d)).select("trace_id", "status", F.from_json("extra_data", TRACE).alias("x")).select("trace_id", "status", "x.*")


def verified(s, d):
    found = _found(s, d)
    return verify(answer(key_queries(s, d), found, echo), found.hits, length_judge)


def judged(s, d):
    found = _found(s, d)
    a = answer(key_queries(s, d), found, echo).join(top_contexts(found.hits, 5), "query_id", "left")
    rows = a.select(
        col("query_id").alias("sample_id"), col("query").alias("question"), F.substring_index("query", ".", 1).alias("ground_truth"), "answer", "contexts",
    )
    return evaluate(rows, length_judge).results.drop("question", "answer")


def _prompt(template: str, *parts: str) -> str:
    pieces = ["'" + piece.replace("'", "''") + "'" for piece in template.split("%s")]
    filled = [x for pair in zip(pieces, [f"coalesce({p}, 'null')" for p in parts], strict=False) for x in pair]
    return f"concat({', '.join([*filled, pieces[-1]])})"


def _round6(x: str) -> str:
    return f"floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


def _cost(tokens: str, kind: str) -> str:
    return _round6(f"{tokens} * {PRICE_PER_1K_TOKENS[kind]}::DOUBLE / 1000.0::DOUBLE")


def _judge(prompt: str) -> str:
    """The stand-in judge in SQL: its score, or null where it gives no JSON or is not asked."""
    return f"CASE WHEN length({prompt}) % 7 <> 0 THEN CAST(concat('0.', length({prompt}) % 10) AS DOUBLE) END"


# The echo repeats the last line of its prompt, which is that of the question.
ANSWER_CTE = KEYWORD_SQL.replace("{k}", "8") + rf""", bl AS (SELECT query_id, rank, text AS content, concat('[1] doc-', chunk_id, ' <paragraph>', chr(10), text) AS b FROM kr JOIN documents ON doc_id = chunk_id),
cx AS (SELECT query_id, string_agg(b, concat(chr(10), chr(10)) ORDER BY rank) AS context, count(*) AS blocks, list(content ORDER BY rank) AS contents FROM bl GROUP BY query_id),
an AS (SELECT item_id AS query_id, text AS query, blocks, contents, {_prompt(PROMPT, "coalesce(context, '')", "text")} AS prompt,
  regexp_extract(regexp_replace(concat('Question: ', text), '\s+$', ''), '[^
]*$') AS answer FROM benchmark LEFT JOIN cx ON cx.query_id = item_id)"""
ANSWERED_SQL = ANSWER_CTE + rf""", tk AS (SELECT query_id, CASE WHEN blocks IS NULL THEN 'empty_retrieval' WHEN NOT regexp_matches(answer, '\S') THEN 'empty_answer'
  WHEN regexp_matches(regexp_replace(answer, '\s+', '', 'g'), '{"|".join(REFUSAL_MARKERS)}') THEN 'refused' ELSE 'answered' END AS state, {tok('prompt')} AS i, {tok('answer')} AS o, {tok('query')} AS e FROM an),
co AS (SELECT *, {_cost('i', 'chat_in')} AS ci, {_cost('o', 'chat_out')} AS co, {_cost('e', 'embedding')} AS ce FROM tk)
SELECT query_id AS trace_id, 'SUCCESS' AS status, state AS "answerState", CAST(i AS BIGINT) AS "estimatedChatInputTokens", CAST(o AS BIGINT) AS "estimatedChatOutputTokens", CAST(e AS BIGINT) AS "estimatedEmbeddingTokens",
ci AS "estimatedChatInputCost", co AS "estimatedChatOutputCost", ce AS "estimatedEmbeddingCost", CAST(i + o + e AS BIGINT) AS "estimatedTotalTokens", {_round6('ci + co + ce')} AS "estimatedTotalCost" FROM co"""
VERIFIED_SQL = ANSWER_CTE + rf""", li AS (SELECT *, array_to_string(list_transform(contents, lambda c: concat('- ', c)), chr(10)) AS listed FROM an),
pr AS (SELECT query_id, contents IS NULL AS none, NOT regexp_matches(answer, '\S') AS blank, {_prompt(EVIDENCE_PROMPT, 'query', "coalesce(listed, '')")} AS pe, {_prompt(FAITHFUL_PROMPT, 'query', "coalesce(listed, '')", 'answer')} AS pf FROM li)
SELECT query_id, CASE WHEN none THEN false WHEN length(pe) % 7 = 0 THEN true ELSE length(pe) % 2 = 0 END AS sufficient, CASE WHEN none THEN 0e0 ELSE coalesce({_judge('pe')}, 0.8::DOUBLE) END AS evidence_score,
CASE WHEN none THEN 'No results found' WHEN length(pe) % 7 = 0 THEN 'Parse error' ELSE 'Unknown' END AS evidence_reason, true AS faithful, CASE WHEN blank THEN 1e0 ELSE coalesce({_judge('pf')}, 0.8::DOUBLE) END AS faithful_score,
CASE WHEN blank THEN 'Empty answer' WHEN length(pf) % 7 = 0 THEN 'Parse error' ELSE 'Unknown' END AS faithful_reason FROM pr"""
JUDGED_SQL = ANSWER_CTE + rf""", ju AS (SELECT query_id, query, answer, split_part(query, '.', 1) AS truth, contents[1:5] AS c FROM an),
jc AS (SELECT *, array_to_string(c, concat(chr(10), '---', chr(10))) AS joined, array_to_string(list_transform(c, lambda x, i: concat('[', i, '] ', x, chr(10), chr(10))), '') AS numbered,
  regexp_matches(answer, '\S') AND c IS NOT NULL AS usable, regexp_matches(truth, '\S') AS known FROM ju),
jp AS (SELECT query_id, usable, known, {_prompt(PROMPTS['faithfulness'], 'joined', 'query', 'answer')} AS p1, {_prompt(PROMPTS['answer_relevancy'], 'query', 'answer')} AS p2, {_prompt(PROMPTS['context_precision'], 'numbered', 'query', 'truth')} AS p3,
  {_prompt(PROMPTS['context_recall'], 'joined', 'query', 'truth')} AS p4, {_prompt(PROMPTS['answer_correctness'], 'query', 'answer', 'truth')} AS p5 FROM jc),
js AS (SELECT query_id, CASE WHEN usable THEN {_judge('p1')} ELSE 0e0 END AS faithfulness, {_judge('p2')} AS answer_relevancy, CASE WHEN known THEN {_judge('p3')} END AS context_precision,
  CASE WHEN known THEN {_judge('p4')} END AS context_recall, CASE WHEN known THEN {_judge('p5')} END AS answer_correctness FROM jp)
SELECT query_id AS sample_id, faithfulness, answer_relevancy, context_precision, context_recall, answer_correctness,
coalesce(list_avg(list_filter([faithfulness, answer_relevancy, context_precision, context_recall, answer_correctness], lambda x: x IS NOT NULL)), 0e0) AS overall FROM js"""


ENTRIES: dict[str, B.Entry] = {
    "eval_samples": (samples, SAMPLES_SQL),
    "rule_cases": (
        lambda s, d: E.to_rule_cases(E.to_eval_samples(record_rows(s, d).withColumn("questionId", F.lit(None).cast("string")).withColumn("source_file", F.lit("documents")))).select(
            "case_id", "query", "top_k", F.array_join("expected_answer_contains", "|").alias("expected"), F.size("expected_doc_names").alias("documents"), "should_refuse"),
        REC_SQL + "SELECT sample_id AS case_id, question AS query, 5 AS top_k, ground_truth AS expected, 0 AS documents, false AS should_refuse FROM r",
    ),
    "corpus_export": (corpus, EXPORT_CTE + "SELECT file_name, text FROM x"),
    "corpus_manifest": (manifest, EXPORT_CTE + "SELECT sample_id, ground_truth, string_agg(file_name, ',' ORDER BY doc_index) AS files FROM x GROUP BY ALL"),
    "sample_scores": (
        lambda s, d: scores(s, d).select("sample_id", "faithfulness", "answer_relevancy", F.round("overall", 6).alias("overall")),
        f"WITH {SCORES_CTE} SELECT sample_id, faithfulness, answer_relevancy, round(CASE WHEN faithfulness IS NULL AND answer_relevancy IS NULL THEN 0e0 ELSE (coalesce(faithfulness, 0e0) + coalesce(answer_relevancy, 0e0)) / ((faithfulness IS NOT NULL)::INT + (answer_relevancy IS NOT NULL)::INT) END, 6) AS overall FROM w",
    ),
    "eval_report": (
        report,
        f"""WITH {SCORES_CTE} SELECT count(*) AS samples, round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_relevancy), 6) AS answer_relevancy, CAST(NULL AS DOUBLE) AS avg_context_recall, round((avg(faithfulness) + avg(answer_relevancy)) / 2, 6) AS overall FROM w""",
    ),
    "rule_eval_report": (
        run_report,
        f"""WITH a AS ({B.CASES_SQL}) SELECT count(*) AS total, CAST(sum(answer_passed * citation_passed * refusal_passed) AS BIGINT) AS passed, CAST(count(*) - sum(answer_passed * citation_passed * refusal_passed) AS BIGINT) AS failed,
round(avg(answer_passed * citation_passed * refusal_passed), 6) AS pass_rate, round(avg(answer_passed), 6) AS answer_accuracy, round(avg(citation_passed), 6) AS citation_hit_rate, round(avg(refusal_passed), 6) AS refusal_accuracy FROM a""",
    ),
    "run_comparison": (
        lambda s, d: E.compare_runs(B.cases(s, d), second_run(s, d)),
        f"""WITH {SECOND_CTE} SELECT case_id, base_passed, target_passed, CASE WHEN base_passed IS NULL THEN 'added' WHEN target_passed IS NULL THEN 'removed' WHEN base_passed = target_passed THEN 'unchanged' WHEN target_passed = 1 THEN 'improved' ELSE 'regressed' END AS change FROM x FULL JOIN y USING (case_id)""",
    ),
    "report_comparison": (
        lambda s, d: E.compare_reports(B.cases(s, d), second_run(s, d)).select(*[F.round(f"{c}_delta", 6).alias(f"{c}_delta") for c in ("pass_rate", "answer_accuracy", "citation_hit_rate", "refusal_accuracy")]),
        f"""WITH {SECOND_CTE}, p AS (SELECT avg(answer_passed * citation_passed * refusal_passed) AS a, avg(answer_passed) AS b, avg(citation_passed) AS c, avg(refusal_passed) AS e FROM a), q AS (SELECT avg(answer_passed * citation_passed * refusal_passed) AS a, avg(answer_passed) AS b, avg(citation_passed) AS c, avg(refusal_passed) AS e FROM b)
SELECT round(q.a - p.a, 6) AS pass_rate_delta, round(q.b - p.b, 6) AS answer_accuracy_delta, round(q.c - p.c, 6) AS citation_hit_rate_delta, round(q.e - p.e, 6) AS refusal_accuracy_delta FROM p, q""",
    ),
    "rule_evaluation": (rule_cases, RULE_SQL),
    "retrieval_quality": (quality, quality_sql()),
    "answer_batch": (answered, ANSWERED_SQL),
    "verified_answers": (verified, VERIFIED_SQL),
    "judged_answers": (judged, JUDGED_SQL),
}
