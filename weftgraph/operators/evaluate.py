"""Retrieval metrics, judge scores and reports over tables of questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_up, json_object, judge_score

CUTS = (1, 3, 5)
SCORES = ("correctness", "groundedness", "completeness", "hallucination", "overall")
PASS_FROM = 4


def metrics(runs: DataFrame) -> DataFrame:
    """``runs`` (expected, retrieved: arrays, ...) plus top_n, recall_n, precision_n (n = 1, 3, 5), mrr, first_hit_rank.

    Precision divides by n even if fewer were retrieved; a null retrieval counts as none.
    """
    got = F.coalesce("retrieved", F.array().cast("array<string>"))
    hit = lambda xs: F.filter(xs, lambda x: F.array_contains("expected", x))
    ranks = F.filter(F.transform(got, lambda x, i: F.when(F.array_contains("expected", x), i + 1)), lambda r: r.isNotNull())
    first = F.get(ranks, F.lit(0))
    out = {}
    for n in CUTS:
        hits = F.size(hit(F.slice(got, 1, n)))
        out |= {f"top_{n}": hits > 0, f"recall_{n}": hits / F.greatest(F.size("expected"), F.lit(1)), f"precision_{n}": hits / F.lit(n)}
    return runs.withColumns(out | {"first_hit_rank": first, "mrr": F.coalesce(F.lit(1.0) / first, F.lit(0.0))})


METRICS = (*[f"{m}_{n}" for n in CUTS for m in ("top", "recall", "precision")], "mrr")


def averages(measured: DataFrame, by: str = "repository") -> DataFrame:
    """Means for each group and over all (group ALL); rows with an error are left out."""
    rows = measured.filter("error IS NULL") if "error" in measured.columns else measured
    means = [F.bround(F.avg(F.col(m).cast("double")), 4).alias(m) for m in METRICS]
    total = rows.rollup(by).agg(F.count("*").alias("questions"), *means, F.grouping(by).alias("g"))
    return total.withColumn(by, F.when(F.col("g") == 1, "ALL").otherwise(F.col(by))).drop("g").filter("questions > 0")


def judged(answers: DataFrame, text: str = "judge_text") -> DataFrame:
    """Scores out of a judge's answer: 1 everywhere and an error where no JSON object is found."""
    found = json_object(text)
    score = lambda s: judge_score(F.get_json_object("_json", f"$.{s}"))
    out = answers.withColumn("_json", found).withColumns({s: score(s) for s in SCORES})
    out = out.withColumn("judge_error", F.when(F.col("_json").isNull(), "no JSON object in the judge's answer")).drop("_json")
    return out.withColumn("passed", passed())


def passed() -> Column:
    return F.col("judge_error").isNull() & (F.col("overall") >= PASS_FROM) & (F.col("hallucination") >= PASS_FROM)


def judge_summary(scores: DataFrame, by: str = "repository") -> DataFrame:
    """Count, means, passes and pass rate for each group and over all (ALL)."""
    means = [F.bround(F.avg(s), 2).alias(s) for s in SCORES]
    total = scores.rollup(by).agg(F.count("*").alias("total"), *means, F.count_if("passed").alias("passes"), F.bround(F.count_if("passed") / F.count("*"), 4).alias("pass_rate"), F.grouping(by).alias("g"))
    return total.withColumn(by, F.when(F.col("g") == 1, "ALL").otherwise(F.col(by))).drop("g").filter("total > 0")


# Scores at or below which an answer counts as weak, and the scores looked at.
WEAK = 2
WEAK_SCORES = ("hallucination", "groundedness", "completeness")


def failure_patterns(scores: DataFrame) -> DataFrame:
    """(ord, pattern, n, total, categories) of what goes wrong: errors of generation and of the judge, and weak scores with their categories.

    Answers with a judge's error have no scores to be weak; failed generations
    have the lowest ones.
    """
    made, kind = F.lit(None).cast("string"), F.lit("")
    generation = F.col("generation_error") if "generation_error" in scores.columns else made
    category = F.coalesce("category", F.lit("")) if "category" in scores.columns else kind
    judged_ = F.col("judge_error").isNull()
    rules = [("generation_error", generation.isNotNull()), ("judge_error", ~judged_), *[(f"low_{s}", judged_ & (F.col(s) <= WEAK)) for s in WEAK_SCORES]]
    aggs = [x for n, c in rules for x in (F.count_if(c).alias(f"n_{n}"), F.array_join(F.array_sort(F.collect_set(F.when(c, category))), ", ").alias(f"c_{n}"))]  # few categories
    counted = scores.agg(F.count("*").alias("total"), *aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("pattern"), F.col(f"n_{n}").alias("n"), F.col("total"), (F.col(f"c_{n}") if n.startswith("low") else F.lit("")).alias("categories")) for k, (n, _) in enumerate(rules)])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def recommendations(summary: DataFrame) -> DataFrame:
    """Advice by threshold for each row of judge_summary(); one line of praise where no rule applies."""
    rules = [
        (F.col("hallucination") < 4, "Answers name what the context doesn't hold: tighten the grounding instructions, or take fewer nodes and hops."), (F.col("groundedness") < 4, "Answers lean too little on the context: put more detail of the nodes into it."),
        (F.col("completeness") < 4, "Answers miss parts: see whether retrieval finds enough related nodes."), (F.col("pass_rate") < 0.7, "Fewer than 70% pass: evaluate again after each change of prompt or retrieval."),
    ]
    found = F.filter(F.array(*[F.when(c, t) for c, t in rules]), lambda x: x.isNotNull())
    return summary.withColumn("advice", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Answers are good in all respects: no change is advised."))))


def extremes(scores: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """The best and the worst n rows by overall score, in order of question_id among equals."""
    ok = scores.filter("judge_error IS NULL AND generation_error IS NULL" if "generation_error" in scores.columns else "judge_error IS NULL")
    return ok.orderBy(F.desc("overall"), "question_id").limit(n), ok.orderBy("overall", "question_id").limit(n)


def against(summary: DataFrame, baseline: dict[str, float]) -> DataFrame:
    """(metric, value, baseline, delta) of one row of averages()."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(b)).alias("baseline")) for m, b in baseline.items()])
    out = summary.select(F.explode(rows).alias("r")).select("r.*").withColumn("delta", F.bround(F.col("value") - F.col("baseline"), 4))
    return out.withColumn("text", signed("value", "baseline", F.col("metric") != "mrr"))


def signed(value: Column | str, baseline: Column | str, percent: Column) -> Column:
    """A value with its change: 12.3% (+1.0%), or 0.123 (-0.010); no sign where nothing has changed."""
    value, delta = (F.col(value) if isinstance(value, str) else value), (F.col(value) if isinstance(value, str) else value) - (F.col(baseline) if isinstance(baseline, str) else baseline)
    sign = F.when(delta > 0, "+").otherwise("")
    return F.when(percent, F.format_string("%.1f%% (%s%.1f%%)", half_up(value * 100, 1), sign, half_up(delta * 100, 1))).otherwise(F.format_string("%.3f (%s%.3f)", half_up(value, 3), sign, half_up(delta, 3)))


def report(summary: DataFrame, by: str = "repository") -> DataFrame:
    """A Markdown table, one row of text."""
    cells = [F.coalesce(F.col(by), F.lit("-")), F.col("questions").cast("string"), *[F.format_string("%.1f%%", half_up(F.col(f"top_{n}") * 100, 1)) for n in CUTS], F.format_string("%.3f", half_up(F.col("mrr"), 3))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = "| Repository | Questions | Top-1 | Top-3 | Top-5 | MRR |\n|---|---|---|---|---|---|"
    rows = F.array_sort(F.collect_list(F.struct((F.col(by) == "ALL").alias("last"), F.col(by).alias("name"), line.alias("line"))))  # one row a repository
    return summary.agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("markdown"))
