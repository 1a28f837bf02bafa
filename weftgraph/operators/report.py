"""Reports as tables of lines (section, place, line) and as JSON: text is put together by sorting, wherever the rows are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_up
from . import evaluate
from .curate import pass_fail

METRIC_COLUMNS = ("top_1", "top_3", "top_5", "recall_1", "recall_3", "recall_5", "precision_1", "precision_3", "precision_5")
# The table's head, and the width of each cell.
HEAD = "| Dataset                      | Top-1  | Top-3  | Top-5  | R@1     | R@3     | R@5     | P@1      | P@3      | P@5      | MRR   |"
WIDTHS = (6, 6, 6, 7, 7, 7, 8, 8, 8)
RULE = "|" + "|".join("-" * len(c) for c in HEAD.split("|")[1:-1]) + "|"


def lines(section: int, rows: DataFrame, place: list[Column], *texts: Column | str) -> DataFrame:
    """(section, place, line) of ``texts`` for each row; null texts are left out."""
    made = F.array(*[F.struct(F.lit(k).alias("nth"), (t if isinstance(t, Column) else F.lit(t)).alias("line")) for k, t in enumerate(texts)])
    key = F.concat_ws("\x00", *[c.cast("string") for c in place]) if place else F.lit("")
    out = rows.select(key.alias("key"), F.explode(made).alias("l")).filter("l.line IS NOT NULL")
    return out.select(F.lit(section).alias("section"), F.struct("key", F.col("l.nth").alias("nth")).alias("place"), F.col("l.line").alias("line"))


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def text(report: DataFrame) -> str:
    """The whole report; for writing it elsewhere see write()."""
    return "\n".join(r["line"] for r in report.orderBy("section", "place").select("line").toLocalIterator())


def write(report: DataFrame, path: str) -> None:
    report.orderBy("section", "place").select("line").coalesce(1).write.mode("overwrite").text(path)


def table_row(label: Column) -> Column:
    """One row of the metrics table."""
    cells = [F.format_string(f"%{w}.1f%%", half_up(F.col(c) * 100, 1)) for c, w in zip(METRIC_COLUMNS, WIDTHS, strict=True)]
    return F.concat(F.lit("| "), F.rpad(label, F.greatest(F.length(label), F.lit(28)), F.lit(" ")), F.lit(" | "), F.concat_ws(" | ", *cells, F.format_string("%5.3f", half_up(F.col("mrr"), 3))), F.lit(" |"))


def retrieval_report(measured: DataFrame) -> DataFrame:
    """Lines of the retrieval report: means over all and by dataset, then each question; ``measured``: run_benchmark() with dataset and retrieval_time."""
    means = evaluate.averages(measured, "dataset")
    mark = lambda c: F.when(F.col(c), "✓").otherwise("✗")
    number = lambda c, n: F.format_string(f"%.{n}f", F.col(c))
    hits = F.array_join(F.transform(F.sequence(F.lit(1), F.size("retrieved")), lambda i: F.concat(i.cast("string"), F.lit(". `"), F.element_at("retrieved", i), F.lit("` [score="), F.format_string("%.2f", F.element_at("scores", i)), F.lit("]"), F.when(F.array_contains("expected", F.element_at("retrieved", i)), " ✓").otherwise(""))), "\n")
    expected = F.array_join(F.transform("expected", lambda s: F.concat(F.lit("- `"), s, F.lit("`"))), "\n")
    cells = [*[mark(f"top_{n}") for n in (1, 3, 5)], *[number(f"recall_{n}", 2) for n in (1, 3, 5)], *[number(f"precision_{n}", 2) for n in (1, 3, 5)], number("mrr", 3)]
    good = F.col("error").isNull()
    once = measured.sparkSession.range(1)
    questions = lines(
        3, measured, [F.col("dataset"), F.col("question")],
        F.concat(F.lit("### "), "question"), "", F.concat(F.lit("**Category:** "), "category", F.lit("  ")), F.concat(F.lit("**Repository:** "), "repository", F.lit("  ")), F.concat(F.lit("**Result:** "), pass_fail(), F.lit("  ")),
        F.concat(F.lit("**Retrieval time:** "), number("retrieval_time", 4), F.lit("s")), "", "**Expected symbols:**", F.when(F.size("expected") > 0, expected), "",
        F.when(~good, F.concat(F.lit("**ERROR:** `"), F.substring("error", 1, 200), F.lit("`"))), F.when(good, "**Retrieved symbols (top-5):**"), F.when(good & (F.size("retrieved") > 0), hits), F.when(good, ""),
        F.when(good, "| Metric | Top-1 | Top-3 | Top-5 | R@1 | R@3 | R@5 | P@1 | P@3 | P@5 | MRR |"), F.when(good, "|--------|-------|-------|-------|-----|-----|-----|-----|-----|-----|-----|"),
        F.when(good, F.concat(F.lit("| Value | "), F.concat_ws(" | ", *cells), F.lit(" |"))), F.when(good, F.concat(F.lit("\nFirst hit rank: **"), F.coalesce(F.col("first_hit_rank").cast("string"), F.lit("—")), F.lit("**"))), "",
    )
    own = F.when(F.col("dataset") == "internal", "Internal (own codebase)").otherwise(F.col("dataset"))
    return together([
        lines(0, once, [], "# Retrieval Metrics Report", "", "## Overall Metrics (All Questions)", "", HEAD, RULE), lines(1, means.filter("dataset = 'ALL'"), [], table_row(F.lit("ALL")), "", "## Per-Dataset Metrics", "", HEAD, RULE),
        lines(2, means.filter("dataset <> 'ALL'"), [F.col("dataset") != "internal", F.col("dataset")], table_row(own)), questions,
    ])


def retrieval_json(measured: DataFrame) -> DataFrame:
    """(dataset, json): a JSON object of each dataset's means (ALL: over all), and of each question (dataset, question)."""
    means = evaluate.averages(measured, "dataset").select("dataset", F.lit(None).cast("string").alias("question"), F.to_json(F.struct(*[F.col(m) for m in (*METRIC_COLUMNS, "mrr")])).alias("json"))
    rounded = [F.bround(F.col(m).cast("double"), 4).alias(m) for m in (*METRIC_COLUMNS[3:], "mrr")]
    each = F.struct("repository", "category", "question", F.col("expected").alias("expected_symbols"), F.col("retrieved").alias("retrieved_ids"), F.col("scores").alias("retrieved_scores"), pass_fail().alias("pass_fail"), "first_hit_rank", F.bround("retrieval_time", 4).alias("retrieval_time"), "error", F.struct("top_1", "top_3", "top_5", *rounded).alias("metrics"))
    return means.unionByName(measured.select("dataset", "question", F.to_json(each, {"ignoreNullFields": "false"}).alias("json")))


def evaluation_report(results: DataFrame) -> DataFrame:
    """Lines of the report on judged answers (judge.scored() with repository, category, question_id)."""
    summary = evaluate.recommendations(evaluate.judge_summary(results))
    total = summary.filter("repository = 'ALL'")
    of = lambda c: F.col(c).cast("string")
    rate = F.format_string("%.1f%%", half_up(F.col("pass_rate") * 100, 1))
    scores = F.concat_ws(", ", *[F.concat(F.lit(f"{s}="), of(s)) for s in evaluate.SCORES[:4]])
    shown = [F.concat(F.lit("- **["), "repository", F.lit(" / "), "category", F.lit("]** "), "question"), F.concat(F.lit("  - Overall: "), of("overall"), F.lit("/5 ("), scores, F.lit(")")), F.concat(F.lit("  - Reason: "), "reason")]
    best, worst = evaluate.extremes(results)
    patterns = evaluate.failure_patterns(results).filter("n > 0")
    title = lambda section, *t: lines(section, results.sparkSession.range(1), [], *t)
    failed = F.col("generation_error").isNotNull()
    return together([
        title(0, "# Answer Quality Evaluation Report", "", "## Summary", ""),
        lines(1, total, [], F.concat(F.lit("- Evaluated questions: "), of("total")), F.concat(F.lit("- Passed (overall >= 4 and hallucination >= 4): "), of("passes"), F.lit(" ("), rate, F.lit(")")), *[F.concat(F.lit(f"- Average {s}: "), of(s), F.lit("/5")) for s in evaluate.SCORES], ""),
        title(2, "## Per-Repository Breakdown", ""),
        lines(3, summary.filter("repository <> 'ALL'"), [F.col("repository")], F.concat(F.lit("- **"), "repository", F.lit("**: "), of("total"), F.lit(" questions, overall avg "), of("overall"), F.lit("/5, pass rate "), rate)),
        title(4, "", "## Best Answers", ""), lines(5, best, [5 - F.col("overall"), F.lpad(of("question_id"), 20, "0")], *shown), title(6, "", "## Weakest Answers", ""), lines(7, worst, [F.col("overall"), F.lpad(of("question_id"), 20, "0")], *shown),
        title(8, "", "## Common Failure Patterns", ""), lines(9, patterns, [F.col("ord")], F.concat(F.lit("- "), "pattern", F.lit(": "), of("n"), F.lit("/"), of("total"), F.when(F.col("categories") != "", F.concat(F.lit(" (categories: "), "categories", F.lit(")"))).otherwise(""))),
        title(10, "", "## Recommendations", ""), lines(11, total.select(F.posexplode("advice").alias("k", "a")), [F.col("k")], F.concat(F.lit("- "), "a")), title(12, "", "## All Results", ""),
        lines(
            13, results, [F.lpad(of("question_id"), 20, "0")], F.concat(F.lit("### ["), F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.lit("] "), "question"), "", F.concat(F.lit("- Repository: "), "repository"), F.concat(F.lit("- Category: "), "category"),
            F.when(failed, F.concat(F.lit("- Generation Error: "), "generation_error")), F.when(~failed, F.concat(F.lit("- Scores: "), scores, F.lit(", overall="), of("overall"))), F.when(~failed, F.concat(F.lit("- Reason: "), "reason")), F.concat(F.lit("- Judge Error: "), "judge_error"), "",
        ),
    ])


def evaluation_json(results: DataFrame) -> DataFrame:
    """(question_id, json) of judged answers."""
    row = F.struct("repository", "category", "question", F.struct(*evaluate.SCORES).alias("scores"), "reason", "passed", "judge_error", "generation_error")
    return results.select("question_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def regression_report(benchmark: DataFrame, overall: DataFrame, failing: DataFrame, baseline: dict[str, float], candidates: int) -> DataFrame:
    """Lines that hold a curated benchmark against a baseline: counts, changes of metrics, failing questions; ``overall``: one row of averages()."""
    of = lambda c: F.col(c).cast("string")
    spread = lambda section, c: lines(section, benchmark.groupBy(c).count(), [F.col(c)], F.concat(F.lit("- **"), c, F.lit("**: "), of("count"), F.lit(" questions")))
    title = lambda section, *t: lines(section, benchmark.sparkSession.range(1), [], *t)
    names = {"top_1": "Top-1 Accuracy", "top_3": "Top-3 Accuracy", "top_5": "Top-5 Accuracy", "mrr": "Mean Reciprocal Rank (MRR)"}
    plain = lambda c, m: F.format_string("%.3f", half_up(c, 3)) if m == "mrr" else F.format_string("%.1f%%", half_up(c * 100, 1))
    rows = [F.concat(F.lit(f"| **{t}** | "), plain(F.lit(float(baseline[m])), m), F.lit(" | "), plain(F.col(m), m), F.lit(" | "), evaluate.signed(F.col(m), F.lit(float(baseline[m])), F.lit(m != "mrr")), F.lit(" |")) for m, t in names.items()]
    return together([
        title(0, "# Benchmark Generation Report", "", f"- **Total Candidate Question Templates**: {candidates} candidates"), lines(1, benchmark.agg(F.count("*").alias("n")), [], F.concat(F.lit("- **Total Curated / Accepted Questions**: "), of("n"), F.lit(" questions")), "", "### Repository Distribution"),
        spread(2, "repository"), title(3, "", "### Category Distribution"), spread(4, "category"), title(5, "", "## Validation Metrics", "", "| Metric | Baseline | New | Change |", "| :--- | :--- | :--- | :--- |"), lines(6, overall, [], *rows),
        title(7, "", "### Failing Questions"), lines(8, failing, [F.col("question")], F.concat(F.lit("#### "), "question"), F.concat(F.lit("- **Repository**: "), "repository"), F.concat(F.lit("- **Expected Symbol**: `"), F.coalesce(F.get("expected", F.lit(0)), F.lit("")), F.lit("`")), F.concat(F.lit("- **First Hit Rank**: "), F.coalesce(of("first_hit_rank"), F.lit("Not Found"))), F.concat(F.lit("- **Analysis**: "), "analysis")),
    ])
