"""Context packages, prompts and answers for a batch of questions."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..storage import cut
from . import resolve, traverse
from .contexts import node_blocks
from .views import place

RULE = "─" * 60
NO_CONTEXT = "No relevant code was found for this question."
SYSTEM = (
    "You answer questions about a Python code base. Rely only on the context that is given, name the ids you rely on, and say so if the context is not enough."
)


class AnswerError(RuntimeError):
    """A question could not be answered."""


class ProviderError(AnswerError):
    """The language model failed or answered nothing."""


def policy(intents: list[str]) -> tuple[str, dict[str, int]]:
    """(name, hop budgets) of detected intents: the greatest budget of each relationship; an intent without a policy has the default one."""
    chosen = [i if i in vocab.HOPS else "default" for i in intents] or ["default"]
    hops = [max(h) for h in zip(*[vocab.HOPS[n] for n in chosen], strict=True)]
    return (chosen[0] if len(chosen) == 1 else f"merged({'+'.join(chosen)})"), dict(zip(vocab.RELATIONSHIPS, hops, strict=True))


def policies(asked: DataFrame) -> DataFrame:
    """``asked`` (intents, ...) plus policy and a budget column for each relationship, as column expressions."""
    known = F.transform("intents", lambda i: F.when(i.isin(*vocab.HOPS), i).otherwise("default"))
    chosen = F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("default")))
    name = F.when(F.size(chosen) == 1, F.get(chosen, F.lit(0))).otherwise(F.concat(F.lit("merged("), F.array_join(chosen, "+"), F.lit(")")))
    budgets = {}
    for k, r in enumerate(vocab.RELATIONSHIPS):
        table = F.create_map(*[F.lit(x) for n, h in vocab.HOPS.items() for x in (n, h[k])])
        budgets[f"hops_{r}"] = F.array_max(F.transform(chosen, table.__getitem__))
    return asked.withColumns({"policy": name} | budgets)


def packages(nodes: DataFrame, edges: DataFrame, questions: DataFrame, k: int = 5, hops: int = 1) -> DataFrame:
    """One row a question: intents, keywords, policy, number of resolved nodes, subgraph size, and the context text.

    Questions are expanded together, each as a group of its own with the budgets
    of its policy, so that the number of joins doesn't grow with the questions.
    """
    asked = cut(policies(resolve.understood(questions)))
    ranked = cut(resolve.rank(nodes, edges, questions, k))
    budget = [x for r in vocab.RELATIONSHIPS for x in (F.lit(r), F.col(f"hops_{r}") if hops == 1 else F.least(F.col(f"hops_{r}") * hops, F.lit(3)))]
    seeds = ranked.join(asked.select("question_id", "policy", F.create_map(*budget).alias("limits")), "question_id").select(F.col("question_id").alias("grp"), "id", "policy", "limits")
    plain = traverse.reach(nodes, edges, seeds.filter("policy = 'default'").select("grp", "id"), hops).select("grp", "id")
    walks = [plain, traverse.intent_reach(nodes, edges, seeds.filter("policy <> 'default'"))]
    found = cut(reduce(DataFrame.unionByName, walks).distinct())
    inner = edges.join(found.select("grp", F.col("id").alias("source")), "source").join(found.select("grp", F.col("id").alias("target")), ["grp", "target"])
    arrow = F.concat(F.lit("    "), "source", F.lit("  →  "), "target", F.when(F.col("decorator_name").isNotNull(), F.concat(F.lit("  @"), "decorator_name")).otherwise(""))
    by_rel = inner.groupBy("grp", F.upper("relationship").alias("rel")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(place(0).alias("place"), arrow.alias("line")))).alias("ls"))
    text = F.concat(F.lit("\n  ["), "rel", F.lit("]  ("), F.col("n").cast("string"), F.lit(" edges)\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    parts = by_rel.groupBy("grp").agg(F.sum("n").alias("edge_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel", text.alias("t")))), lambda x: x["t"]), "\n").alias("edges_text"))
    kinds = found.join(nodes.select("id", "type"), "id").groupBy("grp", "type").agg(F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(x["type"], F.lit("="), x["n"].cast("string")))
    sizes = kinds.groupBy("grp").agg(F.sum("n").alias("node_count"), F.array_join(listed, ",").alias("nodes_by_type"))
    labels = nodes.select("id", "label", "file_path", "line_number")
    about = ranked.join(node_blocks(nodes, edges, ranked), "id").join(labels, "id")
    score = F.concat(F.lit("  [score: "), F.format_string("%.2f", "score"), F.lit("  |  "), "reason", F.lit("]\n"))
    source = F.struct("rank", F.struct("id", "type", "label", "score", "file_path", "line_number").alias("s"))
    blocks = about.groupBy("question_id").agg(F.count("*").alias("resolved"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("\n", "block", score).alias("t")))), lambda x: x["t"]), "\n").alias("nodes_text"), F.transform(F.array_sort(F.collect_list(source)), lambda x: x["s"]).alias("sources"))  # at most k rows a question
    rows = asked.join(blocks, "question_id", "left").join(parts.withColumnRenamed("grp", "question_id"), "question_id", "left").join(sizes.withColumnRenamed("grp", "question_id"), "question_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    lines = [
        F.lit("QUESTION"), F.col("question"), F.lit(""), F.lit("DETECTED INTENT"), F.array_join("intents", ", "), F.lit(""), F.lit("KEYWORDS"), F.when(F.size("keywords") > 0, F.array_join("keywords", ", ")).otherwise("(none)"), F.lit(""),
        F.lit(RULE), F.concat(F.lit("RESOLVED NODES  ("), zero("resolved").cast("string"), F.lit(" nodes)")), F.lit(RULE), F.coalesce("nodes_text", F.lit("")),
        F.lit(RULE), F.concat(F.lit("SUBGRAPH  ("), zero("node_count").cast("string"), F.lit(" nodes, "), zero("edge_count").cast("string"), F.lit(" edges)")), F.lit(RULE), F.coalesce("edges_text", F.lit("  (no edges in expanded subgraph)")),
    ]
    counts = [zero(c).alias(c) for c in ("resolved", "node_count", "edge_count")]
    effective = [F.lit(k).cast("int").alias("top_k"), F.lit(hops).cast("int").alias("max_hops")]
    return rows.select("question_id", "question", "intents", "keywords", "policy", *counts, F.coalesce("nodes_by_type", F.lit("")).alias("nodes_by_type"), *effective, "sources", F.concat_ws("\n", *lines).alias("context"))


def prompts(packed: DataFrame, system: str | None = None) -> DataFrame:
    user = F.concat(F.col("context"), F.lit(f"\n\n{RULE}\nANSWER INSTRUCTIONS\n{RULE}\nAnswer from the context above alone and cite the ids you use:\n\n"), F.col("question"))
    return packed.withColumn("system_prompt", F.lit(system or SYSTEM)).withColumn("user_prompt", user)


def echo() -> Column:
    """What the echo provider answers: lengths only, no model."""
    return F.concat(F.lit("[echo] no model is configured\nsystem_prompt length: "), F.length("system_prompt").cast("string"), F.lit(" chars\nuser_prompt length: "), F.length("user_prompt").cast("string"), F.lit(" chars"))


class Retrying:
    """Calls a provider with pacing, retries with growing pauses on rate limits, and a long pause after three in a row."""

    def __init__(self, generate: Callable[[str, str], str], limited: Callable[[Exception], bool], delay=0.0, retries=5, pause=2.0, factor=2.0, longest=60.0, cooldown=60.0, sleep=time.sleep):
        self.generate, self.limited, self.delay, self.retries, self.pause, self.factor, self.longest, self.cooldown, self.sleep = generate, limited, delay, retries, pause, factor, longest, cooldown, sleep
        self.in_row = 0

    def __call__(self, system: str, user: str) -> str:
        pause = self.pause
        for attempt in range(self.retries + 1):
            if self.delay:
                self.sleep(self.delay)
            try:
                out = self.generate(system, user)
                self.in_row = 0
                return out
            except Exception as error:
                if not self.limited(error) or attempt == self.retries:
                    raise
                self.in_row += 1
                self.sleep(self.cooldown if self.in_row % 3 == 0 else min(pause, self.longest) + random.random())
                pause *= self.factor
        raise ProviderError("no attempt was made")


def answered(asked: DataFrame, provider: Callable[[], Callable[[str, str], str]] | None = None) -> DataFrame:
    """``asked`` (prompts(), ...) plus answer, status (done, no_context, failed, pending) and error.

    ``provider`` makes a function (system, user) to text; it is made once in each
    task, so that the number of partitions bounds the calls at a time.  Without
    one the echo provider answers as an expression.  Rate limits leave a
    question pending.
    """
    if provider is None:
        empty = F.col("resolved") == 0
        return asked.withColumn("answer", F.when(empty, NO_CONTEXT).otherwise(echo())).withColumn("status", F.when(empty, "no_context").otherwise("done")).withColumn("error", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = provider()
        for batch in batches:
            out = []
            for row in batch.itertuples():
                if row.resolved == 0:
                    out.append((NO_CONTEXT, "no_context", None))
                    continue
                try:
                    text = (generate(row.system_prompt, row.user_prompt) or "").strip()
                    out.append((text, "done", None) if text else (None, "failed", "empty answer"))
                except Exception as error:
                    out.append((None, "pending" if "429" in str(error) or "rate limit" in str(error).lower() else "failed", str(error)))
            yield batch.assign(**dict(zip(("answer", "status", "error"), map(list, zip(*out, strict=True)), strict=True))) if out else batch.assign(answer=None, status=None, error=None)

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*asked.schema.fields, *[StructField(c, StringType()) for c in ("answer", "status", "error")]])
    return asked.mapInPandas(run, schema)


class Engine:
    """Answers questions about a graph: ``builder`` makes the packages, ``prompt`` the prompts, ``provider`` the answers; each can be exchanged.

    ``builder`` is any object with build(questions, k, hops) that gives the
    columns of packages(); ``prompt`` takes packages and adds system_prompt and
    user_prompt; ``provider`` is as in answered().
    """

    def __init__(self, builder, provider: Callable[[], Callable[[str, str], str]] | None = None, prompt: Callable[[DataFrame], DataFrame] = prompts):
        self.builder, self.provider, self.prompt = builder, provider, prompt

    def answers(self, questions: DataFrame, k: int | None = None, hops: int | None = None) -> DataFrame:
        """One row a question (question_id, question): its package, prompts, answer, status and error. Blank questions fail."""
        blank = F.trim(F.coalesce("question", F.lit(""))) == ""
        asked = answered(self.prompt(self.builder.build(questions.filter(~blank), k, hops)), self.provider)
        failed = questions.filter(blank).select("question_id", "question", F.lit("failed").alias("status"), F.lit("a question must not be blank").alias("error"))
        return asked.unionByName(failed, allowMissingColumns=True)

    def answer(self, question: str, k: int | None = None, hops: int | None = None) -> dict:
        """The row of one question; ValueError if it is blank, ProviderError if the provider fails or says nothing."""
        if not question or not question.strip():
            raise ValueError("a question must not be blank")
        spark = SparkSession.active()
        row = self.answers(spark.createDataFrame([(1, question)], "question_id long, question string"), k, hops).first().asDict(recursive=True)
        if row["status"] in ("failed", "pending"):
            raise ProviderError(f"no answer for {question!r}: {row['error']}")
        return row


class Builder:
    """Packages over one graph with defaults for k and hops."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, k: int = 5, hops: int = 1):
        self.nodes, self.edges, self.k, self.hops = nodes, edges, k, hops

    def build(self, questions: DataFrame, k: int | None = None, hops: int | None = None) -> DataFrame:
        return packages(self.nodes, self.edges, questions, self.k if k is None else k, self.hops if hops is None else hops)


def engine(nodes: DataFrame, edges: DataFrame, provider: Callable[[], Callable[[str, str], str]] | None = None, k: int = 5, hops: int = 1, system: str | None = None) -> Engine:
    return Engine(Builder(nodes, edges, k, hops), provider, lambda packed: prompts(packed, system))
