"""Answers judged by a model, a table at a time: prompts, calls, scores, and what becomes of failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import evaluate

SYSTEM = (
    "You grade an answer about a code base against the behaviour that is expected. Answer with one JSON object and nothing else: whole numbers from 1 (worst) to 5 (best) "
    'as "correctness", "groundedness", "completeness", "hallucination" (5: nothing made up) and "overall", and a sentence or two as "reason".'
)
#: What the echo judge says of every answer: middle scores, below the pass mark.
ECHO = '{"correctness": 3, "groundedness": 3, "completeness": 3, "hallucination": 3, "overall": 3, "reason": "echo: nothing was judged"}'
NOT_GENERATED = "Answer generation failed; question was not sent to the judge."
NO_CALL = "Judge LLM call failed; see judge_error."
NO_JSON = "Judge response could not be parsed as JSON; see judge_error."
NO_REASON = "(judge did not provide a reason)"


def prompts(answers: DataFrame) -> DataFrame:
    """``answers`` (question, expected_behaviour, generated_answer, ...) plus judge_system and judge_user: nothing else of a row reaches the judge."""
    of = lambda c: F.coalesce(c, F.lit(""))
    user = F.concat(F.lit("QUESTION:\n"), of("question"), F.lit("\n\nEXPECTED BEHAVIOUR:\n"), of("expected_behaviour"), F.lit("\n\nGENERATED ANSWER:\n"), of("generated_answer"), F.lit("\n"))
    return answers.withColumn("judge_system", F.lit(SYSTEM)).withColumn("judge_user", user)


def called(asked: DataFrame, provider: Callable[[], Callable[[str, str], str]] | None = None) -> DataFrame:
    """``asked`` (prompts()) plus judge_text and call_error; rows with a generation_error are not sent. Without a provider the echo judge answers."""
    if provider is None:
        sent = F.col("generation_error").isNull()
        return asked.withColumn("judge_text", F.when(sent, ECHO)).withColumn("call_error", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = provider()
        for batch in batches:
            texts, errors = [], []
            for row in batch.itertuples():
                text = error = None
                if row.generation_error is None:
                    try:
                        text = generate(row.judge_system, row.judge_user) or ""
                    except Exception as e:  # any failure of a provider becomes a row's error
                        error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield batch.assign(judge_text=texts, call_error=errors)

    return asked.mapInPandas(run, StructType([*asked.schema.fields, StructField("judge_text", StringType()), StructField("call_error", StringType())]))


def scored(called_: DataFrame) -> DataFrame:
    """Scores, reason, judge_error and passed of each row; ones where there is nothing to go by."""
    out = evaluate.judged(called_.withColumn("judge_text", F.coalesce("judge_text", F.lit(""))))
    failed, no_call, unread = F.col("generation_error").isNotNull(), F.col("call_error").isNotNull(), F.col("judge_error").isNotNull()
    said = F.trim(F.coalesce(F.get_json_object(evaluate.json_object("judge_text"), "$.reason"), F.lit("")))
    reason = F.when(failed, NOT_GENERATED).when(no_call, NO_CALL).when(unread, NO_JSON).otherwise(F.when(said == "", NO_REASON).otherwise(said))
    error = F.when(failed, F.lit(None)).when(no_call, F.col("call_error")).when(unread, F.concat(F.lit("Unparseable judge response (first 300 chars): "), F.substring("judge_text", 1, 300)))
    out = out.withColumn("reason", reason).withColumn("judge_error", error)
    return out.withColumn("passed", ~failed & evaluate.passed()).drop("judge_text", "call_error", "judge_system", "judge_user")


def evaluated(answers: DataFrame, provider: Callable[[], Callable[[str, str], str]] | None = None) -> DataFrame:
    """``answers`` (repository, category, question, expected_behaviour, generated_answer, generation_error, ...) judged."""
    return scored(called(prompts(answers), provider))
