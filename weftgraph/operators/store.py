"""Resumable generation and judging over tables of answers and judgments, kept in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rate_limited
from ..storage import cut
from . import answer, judge

KEYS = ("repository", "question")
TRIES = 3
ANSWERS = "repository string, question string, status string, attempts int, generated_answer string, retrieved_node_count int, last_error string"
JUDGMENTS = "repository string, question string, status string, attempts int, correctness int, groundedness int, completeness int, hallucination int, overall int, reason string, passed boolean, judge_error string, generation_error string, retrieved_node_count int"


def limited(error: Column) -> Column:
    return rate_limited(F.lit(None).cast("int"), F.lit(None).cast("string"), error)


class Store:
    """Answers and judgments of one evaluation.

    Each save writes a new version beside the others and marks it whole last, so
    that a run that dies leaves the version before; loading takes the newest
    whole one, and empty tables where there is none.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def versions(self) -> list[int]:
        """Whole versions, oldest first."""
        fs, path = self._folder()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and all(fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/{t}/_SUCCESS")) for t in ("answers", "judgments")))

    def load(self) -> tuple[DataFrame, DataFrame]:
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], ANSWERS), self.spark.createDataFrame([], JUDGMENTS)
        at = f"{self.path}/v{known[-1]}"
        return self.spark.read.schema(ANSWERS).parquet(f"{at}/answers"), self.spark.read.schema(JUDGMENTS).parquet(f"{at}/judgments")

    def save(self, answers: DataFrame | None = None, judgments: DataFrame | None = None) -> None:
        """Write a version with new tables in place of the old ones; the two versions before it stay."""
        known, (a, j) = self.versions(), self.load()
        at = f"{self.path}/v{known[-1] + 1 if known else 1}"
        (a if answers is None else answers).write.mode("overwrite").parquet(f"{at}/answers")
        (j if judgments is None else judgments).write.mode("overwrite").parquet(f"{at}/judgments")
        fs, _ = self._folder()
        for old in known[:-2]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}"), True)


def to_answer(dataset: DataFrame, answers: DataFrame, force: bool = False) -> DataFrame:
    """Questions of ``dataset`` without a done answer."""
    return dataset if force else dataset.join(answers.filter("status = 'done'").select(*KEYS), list(KEYS), "left_anti")


def after_generation(answers: DataFrame, results: DataFrame) -> DataFrame:
    """The answers after a round: ``results`` (repository, question, generated_answer, retrieved_node_count, error) in place of what was there.

    A rate limit leaves a question pending; another failure does so until the
    TRIES-th, which is recorded as failed.
    """
    before = answers.select(*KEYS, F.col("attempts").alias("_before"))
    tries = F.coalesce("_before", F.lit(0)) + 1
    status = F.when(F.col("error").isNull(), "done").when(limited(F.col("error")), "pending").when(tries < TRIES, "pending").otherwise("failed")
    good = F.col("error").isNull()
    fresh = results.join(before, list(KEYS), "left").select(
        *KEYS, status.alias("status"), tries.cast("int").alias("attempts"), F.when(good, F.col("generated_answer")).otherwise("").alias("generated_answer"),
        F.when(good, F.col("retrieved_node_count")).cast("int").alias("retrieved_node_count"), F.col("error").alias("last_error"),
    )
    return answers.join(results.select(*KEYS), list(KEYS), "left_anti").unionByName(fresh)


def to_judge(dataset: DataFrame, answers: DataFrame, judgments: DataFrame, force: bool = False) -> DataFrame:
    """Questions with a done or failed answer and no done judgment, with what the judge is told."""
    ready = dataset.join(answers.filter("status IN ('done', 'failed')").select(*KEYS, F.col("status").alias("_status"), "generated_answer", "retrieved_node_count", "last_error"), list(KEYS))
    if not force:
        ready = ready.join(judgments.filter("status = 'done'").select(*KEYS), list(KEYS), "left_anti")
    failed = F.col("_status") == "failed"
    error = F.when(failed, F.coalesce("last_error", F.lit("Answer generation failed.")))
    return ready.withColumns({"generation_error": error, "retrieved_node_count": F.when(~failed, F.col("retrieved_node_count"))}).drop("_status", "last_error")


def after_judging(judgments: DataFrame, results: DataFrame) -> DataFrame:
    """The judgments after a round; a rate-limited judge leaves them pending, without scores."""
    before = judgments.select(*KEYS, F.col("attempts").alias("_before"))
    wait = F.coalesce(limited(F.col("judge_error")), F.lit(False)) & F.col("judge_error").isNotNull()
    names = [f.split(" ")[0] for f in JUDGMENTS.split(", ")]
    rest = [F.when(~wait, F.col(c)).alias(c) for c in names[4:]]
    fresh = results.join(before, list(KEYS), "left").select(*KEYS, F.when(wait, "pending").otherwise("done").alias("status"), (F.coalesce("_before", F.lit(0)) + 1).cast("int").alias("attempts"), *rest)
    return judgments.join(results.select(*KEYS), list(KEYS), "left_anti").unionByName(fresh.select(*names))


def collected(dataset: DataFrame, answers: DataFrame, judgments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions with a done judgment, their answers and scores; and one row that counts those without (incomplete)."""
    done = judgments.filter("status = 'done'").drop("status", "attempts")
    whole = dataset.join(done, list(KEYS)).join(answers.select(*KEYS, "generated_answer"), list(KEYS), "left").withColumn("generated_answer", F.coalesce("generated_answer", F.lit("")))
    return whole, dataset.join(done.select(*KEYS), list(KEYS), "left_anti").agg(F.count("*").alias("incomplete"))


def generate(store: Store, dataset: DataFrame, engines: Callable[[str], answer.Engine], force: bool = False) -> None:
    """Answer what is left of ``dataset`` (repository, question, ...), one repository at a time; its answers are saved before the next begins.

    ``engines`` gives the engine of a repository; if it can't, its questions stay as they are.
    """
    for repository in sorted(r["repository"] for r in to_answer(dataset, store.load()[0], force).select("repository").distinct().collect()):
        answers, _ = store.load()
        left = to_answer(dataset.filter(F.col("repository") == repository), answers, force).select(*KEYS).distinct()
        try:
            engine = engines(repository)
        except (OSError, ValueError, answer.AnswerError):
            continue
        got = engine.answers(left.select(F.xxhash64(*KEYS).alias("question_id"), "question"))
        result = got.select(F.lit(repository).alias("repository"), "question", F.col("answer").alias("generated_answer"), F.col("resolved").cast("int").alias("retrieved_node_count"), F.when(F.col("status").isin("failed", "pending"), F.coalesce("error", F.lit("failed"))).alias("error"))
        store.save(answers=after_generation(answers, cut(result)))


def judge_all(store: Store, dataset: DataFrame, provider=None, force: bool = False) -> None:
    """Judge what is answered and not judged yet."""
    answers, judgments = store.load()
    store.save(judgments=after_judging(judgments, cut(judge.evaluated(to_judge(dataset, answers, judgments, force), provider))))


def chosen(dataset: DataFrame, repository: str | None = None, start: int | None = None, end: int | None = None, limit: int | None = None, by: str = "place") -> DataFrame:
    """Part of a dataset: of one repository (whatever its case; ValueError if it has no question), then [start:end] in the order of ``by``, then the first ``limit``."""
    out = dataset
    if repository is not None:
        out = dataset.filter(F.lower(F.trim("repository")) == repository.strip().lower())
        if out.isEmpty():
            known = ", ".join(sorted(r[0] for r in dataset.select("repository").distinct().collect()))
            raise ValueError(f"no question of {repository!r}; repositories: {known}")
    if start is not None or end is not None:
        n = out.count() if (start or 0) < 0 or end is None or end < 0 else None
        first, last, _ = slice(start, end).indices(n if n is not None else end)
        out = out.orderBy(by).offset(first).limit(max(0, last - first))
    return out if limit is None else out.orderBy(by).limit(max(0, limit))
