"""Benchmarks of questions: reading, review decisions, rewrites, failing questions, and runs with errors kept apart."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import uuid5
from . import evaluate

BENCHMARK = (
    "id string, question string, expected_symbol string, repository string, category string, quality_score double, "
    "generation_reason string, template_family string, review_status string, review_notes string, benchmark_version string"
)
#: Published values of the manual benchmark, used where no file gives others.
BASELINE = {"top_1": 0.8333, "top_3": 0.9333, "top_5": 0.9667, "mrr": 0.879}


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of benchmark questions."""
    return spark.read.schema(BENCHMARK).json(path, multiLine=True)


def write_benchmark(questions: DataFrame, path: str) -> None:
    questions.select(*[f.split(" ")[0] for f in BENCHMARK.split(", ")]).write.mode("overwrite").json(path)


def runnable(benchmark: DataFrame, own: tuple[str, ...] = ("internal",)) -> DataFrame:
    """Questions as they are run: expected symbols as an array, and ``dataset``: internal for the repositories ``own``, else the repository."""
    return benchmark.select("repository", "category", "question", F.array("expected_symbol").alias("expected"), F.when(F.col("repository").isin(*own), "internal").otherwise(F.col("repository")).alias("dataset"))


def baseline(spark: SparkSession, path: str | None = None) -> dict[str, float]:
    """Baseline metrics of a JSON file (metrics: top_1, top_3, top_5, mrr), or BASELINE for those it doesn't give or without one."""
    if path is None:
        return dict(BASELINE)
    row = spark.read.schema("metrics struct<top_1: double, top_3: double, top_5: double, mrr: double>").json(path, multiLine=True).first()
    given = row["metrics"].asDict() if row and row["metrics"] else {}
    return BASELINE | {k: v for k, v in given.items() if v is not None}


def accepted(candidates: DataFrame, threshold: float = 0.4, version: str = "v2_curated") -> DataFrame:
    """The candidates whose score reaches the threshold, stamped."""
    return candidates.filter(F.col("quality_score") >= threshold).withColumns({"review_status": F.lit("accepted"), "benchmark_version": F.lit(version)})


def decided(candidates: DataFrame, decisions: DataFrame, version: str = "v2_curated") -> DataFrame:
    """Candidates after review; ``decisions``: id, action (accept, reject, skip, edit, category, merge) and value (the new question or category).

    Candidates without a decision stay as they are, as after a reviewer stopped.
    A blank value of an edit changes nothing but the status.
    """
    d = decisions.select("id", F.lower("action").alias("_action"), F.trim(F.coalesce("value", F.lit(""))).alias("_value"))
    rows = candidates.join(d, "id", "left")
    new = F.col("_value") != ""
    edit, kind = (F.col("_action") == "edit") & new, (F.col("_action") == "category") & new
    good = F.col("_action").isin("accept", "edit", "category")
    status = F.when(good, "accepted").when(F.col("_action") == "reject", "rejected").when(F.col("_action") == "skip", "skipped").when(F.col("_action") == "merge", "merged")
    notes = F.when(edit, "Renamed during curation").when(kind, F.concat(F.lit("Category changed from "), F.col("category")))
    return rows.withColumns({
        "review_notes": F.coalesce(notes, F.col("review_notes")), "review_status": F.coalesce(status, F.col("review_status")), "benchmark_version": F.when(good, F.lit(version)).otherwise(F.col("benchmark_version")),
        "question": F.when(edit, F.col("_value")).otherwise(F.col("question")), "category": F.when(kind, F.col("_value")).otherwise(F.col("category")),
    }).drop("_action", "_value")


def rewritten(benchmark: DataFrame, rewrites: DataFrame, removals: DataFrame) -> DataFrame:
    """Questions rewritten where they equal one of ``rewrites`` (question, new_question, note), then without those of ``removals`` (question)."""
    r = rewrites.select("question", F.col("new_question").alias("_new"), F.col("note").alias("_note"))
    rows = benchmark.join(r, "question", "left").withColumns({"review_notes": F.coalesce("_note", "review_notes"), "question": F.coalesce("_new", "question")}).drop("_new", "_note")
    return rows.join(removals.select("question"), "question", "left_anti").select(*benchmark.columns)


def migrated(manual: DataFrame) -> DataFrame:
    """Manual questions (repository, question, expected_symbols, category) as benchmark rows: the first expected symbol counts."""
    symbol = F.get("expected_symbols", F.lit(0))
    fixed = {"quality_score": F.lit(1.0), "generation_reason": F.lit("Manually curated baseline"), "template_family": F.lit("manual"), "review_status": F.lit("accepted"), "review_notes": F.lit(""), "benchmark_version": F.lit("v1_manual")}
    return manual.select(uuid5(F.concat_ws(":", "repository", symbol, "question")).alias("id"), "question", symbol.alias("expected_symbol"), "repository", F.coalesce("category", F.lit("Uncategorized")).alias("category"), *[c.alias(n) for n, c in fixed.items()])


def pass_fail() -> Column:
    return F.when(F.col("top_5"), "PASS").otherwise("FAIL")


def failing(measured: DataFrame) -> DataFrame:
    """Questions whose expected symbols are not among the first five, with what may be wrong."""
    rank, got = F.col("first_hit_rank"), F.coalesce("retrieved", F.array().cast("array<string>"))
    expected = F.coalesce(F.get("expected", F.lit(0)), F.lit(""))
    why = F.when(F.size(got) == 0, "nothing retrieved").when(~F.array_contains(got, expected), "not among the first five").otherwise("retrieved below the first five")
    return measured.filter((pass_fail() == "FAIL") | rank.isNull() | (rank > 5)).withColumn("analysis", why)


def run_benchmark(questions: DataFrame, rank: Callable[[DataFrame], DataFrame], k: int = 5) -> DataFrame:
    """Metrics of a batch of questions (question_id, repository, category, question, expected); ``rank`` gives question_id, rank, id, score.

    Errors stay with their questions: a blank question, or one without expected
    symbols, has an error and is measured as nothing retrieved.
    """
    blank = F.trim(F.coalesce("question", F.lit(""))) == ""
    none = F.coalesce(F.size("expected"), F.lit(0)) <= 0
    rows = questions.withColumn("error", F.when(blank, "blank question").when(none, "no expected symbols"))
    got = rank(rows.filter("error IS NULL").select("question_id", "question")).filter(F.col("rank") <= k)
    lists = got.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("_got"))  # k rows a question
    out = rows.join(lists, "question_id", "left")
    empty = F.coalesce("_got", F.array().cast("array<struct<rank: bigint, id: string, score: double>>"))
    out = out.withColumns({"retrieved": F.transform(empty, lambda x: x["id"]), "scores": F.transform(empty, lambda x: x["score"]), "expected": F.coalesce("expected", F.array().cast("array<string>"))}).drop("_got")
    return evaluate.metrics(out)


def timed(engine, question: str) -> dict:
    """One question's answer with the seconds of retrieval, of all, and the rest as generation."""
    from pyspark.sql import SparkSession as S

    asked = S.active().createDataFrame([(1, question)], "question_id long, question string")
    began = time.perf_counter()
    engine.builder.build(asked, None, None).collect()
    retrieval = time.perf_counter() - began
    began = time.perf_counter()
    row = engine.answer(question)
    total = time.perf_counter() - began
    return row | {"retrieval_time": retrieval, "generation_time": max(total - retrieval, 0.0), "total_time": retrieval + max(total - retrieval, 0.0)}


def timing_summary(results: DataFrame) -> DataFrame:
    """One row: totals, successes, failures, and mean times of the successes; ``results``: success, retrieval_time, generation_time."""
    good = F.col("success")
    mean = lambda c: F.bround(F.coalesce(F.avg(F.when(good, F.col(c))), F.lit(0.0)), 4)
    return results.agg(F.count("*").alias("total_questions"), F.count_if(good).alias("successful_questions"), F.count_if(~good).alias("failed_questions"), mean("retrieval_time").alias("average_retrieval_time"), mean("generation_time").alias("average_generation_time"))
