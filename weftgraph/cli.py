"""Command line: analyse a checkout, build its graph, ask about it, rank a benchmark, curate questions."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import answer, curate, report, resolve
from .storage import cut


def _analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    print(json.dumps(api.analyze(spark, a.path), indent=2))


def _graph(spark: SparkSession, a: argparse.Namespace) -> None:
    nodes, edges = api.build_graph(spark, a.path)
    nodes.write.mode("overwrite").parquet(f"{a.out}/nodes")
    edges.write.mode("overwrite").parquet(f"{a.out}/edges")


def _built(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A graph that is read more than once: parsed and joined once."""
    nodes, edges = api.build_graph(spark, path)
    return cut(nodes), cut(edges)


def _ask(spark: SparkSession, a: argparse.Namespace) -> None:
    nodes, edges = api.cached_graph(spark, a.path, a.cache)[:2] if a.cache else _built(spark, a.path)
    row = answer.engine(nodes, edges, k=a.top_k, hops=a.max_hops).answer(a.question)
    print(row["context"] if a.context else row["answer"])


def _metrics(spark: SparkSession, a: argparse.Namespace) -> None:
    nodes, edges = _built(spark, a.path)
    asked = curate.runnable(curate.read_benchmark(spark, a.benchmark)).withColumn("question_id", F.xxhash64("repository", "question"))
    measured = curate.run_benchmark(asked, lambda q: resolve.rank(nodes, edges, q, 5)).withColumn("retrieval_time", F.lit(0.0))
    report.write(report.retrieval_report(measured), a.out)


def _curate(spark: SparkSession, a: argparse.Namespace) -> None:
    candidates = curate.read_benchmark(spark, a.candidates)
    done = curate.decided(candidates, spark.read.schema("id string, action string, value string").json(a.decisions), a.version).filter("review_status = 'accepted'") if a.decisions else curate.accepted(candidates, a.threshold, a.version)
    curate.write_benchmark(done, a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *needed: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for n in needed:
            p.add_argument(n)
        return p

    command("analyze", _analyze, "path")
    command("graph", _graph, "path", "out")
    p = command("ask", _ask, "path", "question")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--max-hops", type=int, default=1)
    p.add_argument("--cache")
    p.add_argument("--context", action="store_true", help="print the context instead of an answer")
    command("metrics", _metrics, "path", "benchmark", "out")
    p = command("curate", _curate, "candidates", "out")
    p.add_argument("--threshold", type=float, default=0.4)
    p.add_argument("--version", default="v2_curated")
    p.add_argument("--decisions", help="JSON lines of id, action and value; without them all from the threshold up are accepted")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName("weftgraph").getOrCreate(), a)


if __name__ == "__main__":
    main()
