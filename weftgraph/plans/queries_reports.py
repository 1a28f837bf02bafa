"""Queries on judging, resumable runs, curation and reports; labels and events stand for questions and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curate, evaluate, judge, report, store
from . import adapter
from .queries import query
from .queries_more import _AVERAGES, _BODY, _CLAMP, _IR, _SHA1, _UUID5, _runs

# -- judged answers: labels with failed generations, failed calls, and answers of a judge of several forms

_ANSWERS = f"""SELECT doc_id AS question_id, concat('r', CAST(doc_id % 3 AS STRING)) AS repository, concat('c', CAST(doc_id % 4 AS STRING)) AS category, concat('Question ', CAST(doc_id AS STRING), '?') AS question,
concat('It does ', CAST(doc_id AS STRING), '.') AS expected_behaviour, concat('Answer ', CAST(doc_id AS STRING)) AS generated_answer, CASE WHEN doc_id % 13 = 0 THEN 'no model' END AS generation_error,
CASE WHEN doc_id % 13 <> 0 AND doc_id % 17 = 0 THEN 'RuntimeError: 429' END AS call_error,
CASE WHEN doc_id % 13 <> 0 AND doc_id % 17 <> 0 THEN CASE doc_id % 6 WHEN 0 THEN {_BODY} WHEN 1 THEN concat('```json\n', {_BODY}, '\n```') WHEN 2 THEN concat('Here: ', {_BODY}, ' as asked') WHEN 3 THEN 'no verdict' WHEN 4 THEN replace({_BODY}, '}}', ', "reason": " good "}}') ELSE '{{"overall": ' END END AS judge_text FROM labels"""
_EVALUATED = f"""WITH a AS (SELECT * FROM ({_ANSWERS}) x JOIN labels ON doc_id = question_id), b AS (SELECT *, generation_error IS NULL AND call_error IS NULL AND doc_id % 6 NOT IN (3, 5) AS good FROM a),
scores AS (SELECT question_id, repository, category, question, generation_error, {', '.join(f"CASE WHEN good THEN {_CLAMP.format(x=x)} ELSE 1 END AS {s}" for s, x in (('correctness', '(doc_id % 7)::DOUBLE'), ('groundedness', '(doc_id % 5) + 0.5::DOUBLE'), ('completeness', '(quality * 5)::DOUBLE'), ('hallucination', '(5 - toxic)::DOUBLE'), ('overall', '(3 + doc_id % 3)::DOUBLE')))},
 CASE WHEN generation_error IS NOT NULL THEN '{judge.NOT_GENERATED}' WHEN call_error IS NOT NULL THEN '{judge.NO_CALL}' WHEN NOT good THEN '{judge.NO_JSON}' WHEN doc_id % 6 = 4 THEN 'good' ELSE '{judge.NO_REASON}' END AS reason,
 CASE WHEN generation_error IS NOT NULL THEN NULL WHEN call_error IS NOT NULL THEN call_error WHEN NOT good THEN 'Unparseable judge response (first 300 chars): ' || judge_text END AS judge_error,
 good AND (3 + doc_id % 3) >= 4 AND 5 - toxic >= 4 AS passed FROM b)"""


def _answers(spark, d) -> DataFrame:
    adapter.tables(spark, d, "labels")
    return spark.sql(_ANSWERS)


def _evaluated(spark, d) -> DataFrame:
    return judge.scored(_answers(spark, d))


@query("judge_prompts", f"SELECT question_id, 'QUESTION:' || chr(10) || question || chr(10) || chr(10) || 'EXPECTED BEHAVIOUR:' || chr(10) || expected_behaviour || chr(10) || chr(10) || 'GENERATED ANSWER:' || chr(10) || generated_answer || chr(10) AS judge_user FROM ({_ANSWERS})")
def _(spark, d):
    return judge.prompts(_answers(spark, d)).select("question_id", "judge_user")


@query("evaluation_scores", f"{_EVALUATED} SELECT question_id, {', '.join(evaluate.SCORES)}, reason, judge_error, passed FROM scores")
def _(spark, d):
    return _evaluated(spark, d).select("question_id", *evaluate.SCORES, "reason", "judge_error", "passed")


@query("echo_judged", f"SELECT question_id, CASE WHEN generation_error IS NULL THEN 3 ELSE 1 END AS overall, CASE WHEN generation_error IS NULL THEN 'echo: nothing was judged' ELSE '{judge.NOT_GENERATED}' END AS reason, false AS passed FROM ({_ANSWERS})")
def _(spark, d):
    return judge.evaluated(_answers(spark, d).drop("judge_text", "call_error")).select("question_id", "overall", "reason", "passed")



_PATTERNS = " UNION ALL ".join(
    f"SELECT {k} AS ord, '{n}' AS pattern, count(*) FILTER ({c}) AS n, count(*) AS total, " + (f"coalesce(string_agg(DISTINCT category, ', ' ORDER BY category) FILTER ({c}), '')" if n.startswith("low") else "''") + " AS categories FROM scores"
    for k, (n, c) in enumerate([("generation_error", "generation_error IS NOT NULL"), ("judge_error", "judge_error IS NOT NULL"), *[(f"low_{s}", f"judge_error IS NULL AND {s} <= 2") for s in evaluate.WEAK_SCORES]])
)


@query("failure_patterns", f"{_EVALUATED} {_PATTERNS}")
def _(spark, d):
    return evaluate.failure_patterns(_evaluated(spark, d))


_SUMMARY = f"summary AS (SELECT CASE WHEN grouping(repository) = 1 THEN 'ALL' ELSE repository END AS repository, count(*) AS total, {', '.join(f'round_even(avg({s}), 2) AS {s}' for s in evaluate.SCORES)}, count(*) FILTER (passed) AS passes, round_even(count(*) FILTER (passed) / count(*), 4) AS pass_rate FROM scores GROUP BY ROLLUP (repository))"


@query("recommendations", f"""{_EVALUATED}, {_SUMMARY}, n AS (SELECT repository, (hallucination < 4)::INT + (groundedness < 4)::INT + (completeness < 4)::INT + (pass_rate < 0.7)::INT AS n FROM summary) SELECT repository, greatest(n, 1)::BIGINT AS n, n = 0 AS praise FROM n""")
def _(spark, d):
    s = evaluate.recommendations(evaluate.judge_summary(_evaluated(spark, d)))
    return s.select("repository", F.size("advice").cast("long").alias("n"), F.get("advice", F.lit(0)).startswith("Answers are good").alias("praise"))


@query("worst_answers", f"{_EVALUATED} SELECT question_id, overall FROM scores WHERE judge_error IS NULL AND generation_error IS NULL ORDER BY overall, question_id LIMIT 5")
def _(spark, d):
    return evaluate.extremes(_evaluated(spark, d))[1].select("question_id", "overall")


@query("evaluation_report", f"""{_EVALUATED}, {_SUMMARY} SELECT 3 AS section, '- **' || repository || '**: ' || total || ' questions, overall avg ' || overall || '/5, pass rate ' || printf('%.1f%%', round(pass_rate * 100, 1)) AS line FROM summary WHERE repository <> 'ALL'
UNION ALL SELECT 9, '- ' || pattern || ': ' || n || '/' || total || CASE WHEN categories <> '' THEN ' (categories: ' || categories || ')' ELSE '' END FROM ({_PATTERNS}) WHERE n > 0
UNION ALL SELECT 13, unnest(list_filter(['### [' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || '] ' || question, '', '- Repository: ' || repository, '- Category: ' || category, '- Generation Error: ' || generation_error,
 CASE WHEN generation_error IS NULL THEN '- Scores: correctness=' || correctness || ', groundedness=' || groundedness || ', completeness=' || completeness || ', hallucination=' || hallucination || ', overall=' || overall END,
 CASE WHEN generation_error IS NULL THEN '- Reason: ' || reason END, '- Judge Error: ' || judge_error, ''], lambda x: x IS NOT NULL)) FROM scores""")
def _(spark, d):
    return report.evaluation_report(_evaluated(spark, d)).filter("section IN (3, 9, 13)").select("section", "line")


@query("evaluation_json", f"""{_EVALUATED} SELECT question_id, '{{"repository":"' || repository || '","category":"' || category || '","question":"' || question || '","scores":{{' || {" || ',' || ".join(f"""'"{s}":' || {s}""" for s in evaluate.SCORES)} || '}},"reason":"' || reason || '","passed":' || passed || ',"judge_error":' || coalesce(to_json(judge_error)::VARCHAR, 'null') || ',"generation_error":' || coalesce('"' || generation_error || '"', 'null') || '}}' AS json FROM scores""")
def _(spark, d):
    return report.evaluation_json(_evaluated(spark, d))


# -- resumable runs: labels are a data set, some answered before

_DATASET = "SELECT concat('r', CAST(doc_id % 3 AS STRING)) AS repository, CAST(doc_id AS STRING) AS question, doc_id AS place FROM labels"
_BEFORE = """SELECT concat('r', CAST(doc_id % 3 AS STRING)) AS repository, CAST(doc_id AS STRING) AS question, CASE doc_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'pending' END AS status, CAST(doc_id % 4 AS INT) AS attempts,
concat('old ', CAST(doc_id AS STRING)) AS generated_answer, CAST(3 AS INT) AS retrieved_node_count, CASE WHEN doc_id % 5 = 1 THEN 'broken' END AS last_error FROM labels WHERE doc_id % 7 < 5"""
_RESULTS = """SELECT repository, question, concat('new ', question) AS generated_answer, CAST(5 AS INT) AS retrieved_node_count, CASE CAST(question AS BIGINT) % 11 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'timeout' END AS error FROM {left}"""
_LEFT = f"(SELECT repository, question FROM ({_DATASET}) x WHERE NOT EXISTS (SELECT 1 FROM ({_BEFORE}) y WHERE y.repository = x.repository AND y.question = x.question AND status = 'done'))"


def _data(spark, d) -> tuple[DataFrame, DataFrame]:
    adapter.tables(spark, d, "labels")
    return spark.sql(_DATASET), spark.sql(_BEFORE)


@query("checkpoint_remaining", f"SELECT repository, question FROM {_LEFT} l")
def _(spark, d):
    return store.to_answer(*_data(spark, d)).select("repository", "question")


_AFTER = f"""before AS ({_BEFORE}), res AS ({_RESULTS.format(left=_LEFT)}), tried AS (SELECT res.*, coalesce(attempts, 0) + 1 AS tries FROM res LEFT JOIN before ON before.repository = res.repository AND before.question = res.question),
after AS (SELECT repository, question, CASE WHEN error IS NULL THEN 'done' WHEN error = 'HTTP 429' OR tries < 3 THEN 'pending' ELSE 'failed' END AS status, tries AS attempts, CASE WHEN error IS NULL THEN generated_answer ELSE '' END AS generated_answer, CASE WHEN error IS NULL THEN retrieved_node_count END AS retrieved_node_count, error AS last_error FROM tried
UNION ALL SELECT * FROM before WHERE (repository, question) NOT IN (SELECT (repository, question) FROM res))"""


def _after(spark, d) -> DataFrame:
    data, before = _data(spark, d)
    store.to_answer(data, before).createOrReplaceTempView("left_questions")
    return store.after_generation(before, spark.sql(_RESULTS.format(left="left_questions")))


@query("generation_round", f"WITH {_AFTER} SELECT repository, question, status, attempts::BIGINT AS attempts, generated_answer, last_error FROM after")
def _(spark, d):
    return _after(spark, d).select("repository", "question", "status", F.col("attempts").cast("long").alias("attempts"), "generated_answer", "last_error")


_JUDGED_BEFORE = "SELECT concat('r', CAST(doc_id % 3 AS STRING)) AS repository, CAST(doc_id AS STRING) AS question, CASE WHEN doc_id % 2 = 0 THEN 'done' ELSE 'pending' END AS status, CAST(1 AS INT) AS attempts, CAST(4 AS INT) AS overall FROM labels WHERE doc_id % 9 < 4"
_TO_JUDGE = f"""{_AFTER}, jb AS ({_JUDGED_BEFORE}), tj AS (SELECT after.repository, after.question, CASE WHEN after.status = 'failed' THEN last_error END AS generation_error, generated_answer, jb.attempts FROM after LEFT JOIN jb ON jb.repository = after.repository AND jb.question = after.question
WHERE after.status IN ('done', 'failed') AND coalesce(jb.status, '') <> 'done')"""


def _judgments(spark) -> DataFrame:
    names = [f.split(" ") for f in store.JUDGMENTS.split(", ")]
    before = spark.sql(_JUDGED_BEFORE)
    return before.select(*[F.col(n) if n in before.columns else F.lit(None).cast(t).alias(n) for n, t in names])


def _judged_round(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    after = _after(spark, d)
    data = spark.sql(_DATASET).withColumn("expected_behaviour", F.lit("x"))
    todo = judge.prompts(store.to_judge(data, after, _judgments(spark)))
    limited = F.col("question").cast("long") % 10 == 0
    sent = F.col("generation_error").isNull()
    told = todo.withColumns({"judge_text": F.when(sent & ~limited, F.lit(judge.ECHO)), "call_error": F.when(sent & limited, "RuntimeError: quota")})
    return data, after, store.after_judging(_judgments(spark), judge.scored(told))


_JUDGED_AFTER = f"""{_TO_JUDGE}, ja AS (SELECT repository, question, CASE WHEN generation_error IS NULL AND question::BIGINT % 10 = 0 THEN 'pending' ELSE 'done' END AS status, (coalesce(attempts, 0) + 1)::BIGINT AS attempts, CASE WHEN generation_error IS NOT NULL THEN 1 WHEN question::BIGINT % 10 = 0 THEN NULL ELSE 3 END AS overall FROM tj
UNION ALL SELECT repository, question, status, attempts, overall FROM jb WHERE (repository, question) NOT IN (SELECT (repository, question) FROM tj))"""


@query("judging_round", f"WITH {_JUDGED_AFTER} SELECT * FROM ja")
def _(spark, d):
    return _judged_round(spark, d)[2].select("repository", "question", "status", F.col("attempts").cast("long").alias("attempts"), "overall")


@query("collected_results", f"WITH {_JUDGED_AFTER} SELECT x.repository, x.question, overall, coalesce(generated_answer, '') AS generated_answer FROM ({_DATASET}) x JOIN ja ON ja.repository = x.repository AND ja.question = x.question LEFT JOIN after ON after.repository = x.repository AND after.question = x.question WHERE ja.status = 'done'")
def _(spark, d):
    return store.collected(*_judged_round(spark, d))[0].select("repository", "question", "overall", "generated_answer")


@query("incomplete_results", f"WITH {_JUDGED_AFTER} SELECT count(*) AS incomplete FROM ({_DATASET}) x WHERE (repository, question) NOT IN (SELECT (repository, question) FROM ja WHERE status = 'done')")
def _(spark, d):
    return store.collected(*_judged_round(spark, d))[1]


@query("dataset_slice", f"SELECT repository, question FROM (SELECT *, row_number() OVER (ORDER BY place) AS n FROM ({_DATASET}) WHERE repository = 'r1') WHERE n > 3 AND n <= (SELECT count(*) FROM ({_DATASET}) WHERE repository = 'r1') - 2 ORDER BY n LIMIT 20")
def _(spark, d):
    return store.chosen(_data(spark, d)[0], " R1 ", 3, -2, 20).select("repository", "question")


# -- curation: labels are candidates

_CANDIDATES = """SELECT CAST(doc_id AS STRING) AS id, concat('How is it ', CAST(doc_id % 50 AS STRING), '?') AS question, concat('s', CAST(doc_id AS STRING)) AS expected_symbol, concat('r', CAST(doc_id % 3 AS STRING)) AS repository, concat('c', CAST(doc_id % 4 AS STRING)) AS category,
CAST(doc_id % 10 AS DOUBLE) / 10 AS quality_score, 'made' AS generation_reason, 'f' AS template_family, 'pending' AS review_status, '' AS review_notes, CAST(NULL AS STRING) AS benchmark_version FROM labels"""
_DECISIONS = "SELECT CAST(doc_id AS STRING) AS id, CASE doc_id % 7 WHEN 0 THEN 'accept' WHEN 1 THEN 'Reject' WHEN 2 THEN 'skip' WHEN 3 THEN 'edit' WHEN 4 THEN 'category' ELSE 'merge' END AS action, CASE WHEN doc_id % 2 = 0 THEN ' new ' ELSE ' ' END AS value FROM labels WHERE doc_id % 7 < 6"
_REWRITES = "SELECT 'How is it 3?' AS question, 'How is three made?' AS new_question, 'clearer' AS note UNION ALL SELECT 'How is it 4?', 'How is four made?', 'shorter'"
_REMOVALS = "SELECT 'How is it 5?' AS question UNION ALL SELECT 'How is four made?'"


def _candidates(spark, d) -> DataFrame:
    adapter.tables(spark, d, "labels")
    return spark.sql(_CANDIDATES)


@query("accepted_candidates", f"SELECT id, 'accepted' AS review_status, 'v9' AS benchmark_version FROM ({_CANDIDATES}) WHERE quality_score >= 0.4")
def _(spark, d):
    return curate.accepted(_candidates(spark, d), version="v9").select("id", "review_status", "benchmark_version")


@query("review_decisions", f"""SELECT c.id, CASE WHEN action = 'edit' AND value = ' new ' THEN 'new' ELSE question END AS question, CASE WHEN action = 'category' AND value = ' new ' THEN 'new' ELSE category END AS category,
CASE WHEN action IN ('accept', 'edit', 'category') THEN 'accepted' WHEN action = 'Reject' THEN 'rejected' WHEN action = 'skip' THEN 'skipped' WHEN action = 'merge' THEN 'merged' ELSE 'pending' END AS review_status,
CASE WHEN value = ' new ' AND action = 'edit' THEN 'Renamed during curation' WHEN value = ' new ' AND action = 'category' THEN 'Category changed from ' || category ELSE '' END AS review_notes, CASE WHEN action IN ('accept', 'edit', 'category') THEN 'v2_curated' END AS benchmark_version
FROM ({_CANDIDATES}) c LEFT JOIN ({_DECISIONS}) x ON x.id = c.id""")
def _(spark, d):
    return curate.decided(_candidates(spark, d), spark.sql(_DECISIONS)).select("id", "question", "category", "review_status", "review_notes", "benchmark_version")


@query("curation_rewrites", f"SELECT id, coalesce(new_question, c.question) AS question, coalesce(note, '') AS review_notes FROM ({_CANDIDATES}) c LEFT JOIN ({_REWRITES}) r ON r.question = c.question WHERE coalesce(new_question, c.question) NOT IN (SELECT question FROM ({_REMOVALS}))")
def _(spark, d):
    return curate.rewritten(_candidates(spark, d), spark.sql(_REWRITES), spark.sql(_REMOVALS)).select("id", "question", "review_notes")


@query("manual_migration", f"SELECT {_UUID5} AS id, question, expected_symbol, repository, 'Uncategorized' AS category, 1.0::DOUBLE AS quality_score, 'v1_manual' AS benchmark_version FROM (SELECT *, {_SHA1.replace('{x}', "repository || ':' || expected_symbol || ':' || question")} AS h FROM ({_CANDIDATES}))")
def _(spark, d):
    manual = _candidates(spark, d).select("repository", "question", F.array("expected_symbol", F.lit("other")).alias("expected_symbols"), F.lit(None).cast("string").alias("category"))
    return curate.migrated(manual).select("id", "question", "expected_symbol", "repository", "category", "quality_score", "benchmark_version")


@query("benchmark_datasets", f"SELECT CASE WHEN repository IN ('r0') THEN 'internal' ELSE repository END AS dataset, question, [expected_symbol]::VARCHAR AS expected FROM ({_CANDIDATES})")
def _(spark, d):
    rows = curate.runnable(_candidates(spark, d), ("r0",))
    return rows.select("dataset", "question", F.concat(F.lit("["), F.array_join("expected", ", "), F.lit("]")).alias("expected"))


# -- retrieval reports


@query("failing_questions", f"{_IR} SELECT user_id, first_hit_rank, CASE WHEN first_hit_rank IS NULL THEN 'not among the first five' ELSE 'other' END AS analysis FROM ir WHERE NOT top_5")
def _(spark, d):
    rows = curate.failing(_runs(spark, d))
    return rows.select("user_id", F.col("first_hit_rank").cast("long").alias("first_hit_rank"), F.when(F.col("first_hit_rank").isNull(), F.col("analysis")).otherwise("other").alias("analysis"))


_CELL = " || ' | ' || ".join(f"printf('%{w}.1f%%', round({c} * 100, 1))" for c, w in zip(report.METRIC_COLUMNS, report.WIDTHS, strict=True))


@query("retrieval_report", f"{_AVERAGES} SELECT '| ' || rpad(repository, 28, ' ') || ' | ' || {_CELL} || ' | ' || printf('%5.3f', round(mrr, 3)) || ' |' AS line FROM a")
def _(spark, d):
    m = _runs(spark, d).withColumns({"dataset": F.col("repository"), "question": F.col("user_id").cast("string"), "category": F.lit("c"), "error": F.lit(None).cast("string"), "retrieval_time": F.lit(0.01), "scores": F.transform("retrieved", lambda x: F.lit(1.0))})
    return report.retrieval_report(m).filter("section IN (1, 2) AND line LIKE '| r%' OR line LIKE '| ALL%'").select("line")


@query("retrieval_json", f"{_IR} SELECT user_id::VARCHAR AS question, CASE WHEN top_5 THEN 'PASS' ELSE 'FAIL' END AS pass_fail, first_hit_rank::BIGINT AS first_hit_rank, round_even(recall_3, 4) AS recall_3, round_even(mrr, 4) AS mrr FROM ir")
def _(spark, d):
    m = _runs(spark, d).withColumns({"dataset": F.col("repository"), "question": F.col("user_id").cast("string"), "category": F.lit("c"), "error": F.lit(None).cast("string"), "retrieval_time": F.lit(0.01), "scores": F.transform("retrieved", lambda x: F.lit(1.0))})
    rows = report.retrieval_json(m).filter("question IS NOT NULL")
    got = lambda p, t: F.get_json_object("json", p).cast(t)
    return rows.select("question", got("$.pass_fail", "string").alias("pass_fail"), got("$.first_hit_rank", "long").alias("first_hit_rank"), got("$.metrics.recall_3", "double").alias("recall_3"), got("$.metrics.mrr", "double").alias("mrr"))


@query("regression_report", f"""{_AVERAGES} SELECT '| **' || t || '** | ' || CASE m WHEN 'mrr' THEN printf('%.3f', b) ELSE printf('%.1f%%', round(b * 100, 1)) END || ' | ' || CASE m WHEN 'mrr' THEN printf('%.3f', round(v, 3)) ELSE printf('%.1f%%', round(v * 100, 1)) END || ' | ' ||
CASE m WHEN 'mrr' THEN printf('%.3f (%s%.3f)', round(v, 3), CASE WHEN v > b THEN '+' ELSE '' END, round(v - b, 3)) ELSE printf('%.1f%% (%s%.1f%%)', round(v * 100, 1), CASE WHEN v > b THEN '+' ELSE '' END, round((v - b) * 100, 1)) END || ' |' AS line
FROM (SELECT unnest(['top_1', 'top_3', 'top_5', 'mrr']) AS m, unnest([top_1, top_3, top_5, mrr]) AS v, unnest([0.8333, 0.9333, 0.9667, 0.879])::DOUBLE AS b, unnest(['Top-1 Accuracy', 'Top-3 Accuracy', 'Top-5 Accuracy', 'Mean Reciprocal Rank (MRR)']) AS t FROM a WHERE repository = 'ALL')""")
def _(spark, d):
    runs = _runs(spark, d).withColumn("question", F.col("user_id").cast("string"))
    overall = evaluate.averages(runs).filter("repository = 'ALL'")
    bench = _candidates(spark, d)
    return report.regression_report(bench, overall, curate.failing(runs), curate.BASELINE, 7).filter("section = 6").select("line")


@query("timing_summary", "SELECT count(*) AS total_questions, count(*) FILTER (quality = 1) AS successful_questions, count(*) FILTER (quality <> 1) AS failed_questions, round_even(coalesce(avg(doc_id % 8 / 8.0::DOUBLE) FILTER (quality = 1), 0), 4) AS average_retrieval_time, round_even(coalesce(avg(doc_id % 4 / 4.0::DOUBLE) FILTER (quality = 1), 0), 4) AS average_generation_time FROM labels")
def _(spark, d):
    adapter.tables(spark, d, "labels")
    rows = spark.table("labels").select((F.col("quality") == 1).alias("success"), (F.col("doc_id") % 8 / F.lit(8.0)).alias("retrieval_time"), (F.col("doc_id") % 4 / F.lit(4.0)).alias("generation_time"))
    return curate.timing_summary(rows)
