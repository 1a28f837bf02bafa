"""Text functions, files, metrics, question generation, providers."""

import uuid

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.operators import answer, benchgen, evaluate
from weftgraph.sources import repo_files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, text.camel_words(F.lit("HTTPSHandlerFoo"))) == ["https", "handler", "foo"]
    assert one(spark, text.name_words(F.lit("parseHTTPFile"))) == ["parse", "HTTP", "File"]
    assert one(spark, text.snake_words(F.lit("Get__Node_"))) == ["get", "node"] and one(spark, text.snake_words(F.lit("get"))) == []
    assert one(spark, text.stem(F.lit("wrapping"))) == "wra" and one(spark, text.stem(F.lit("ing"))) is None
    assert one(spark, text.uuid5(F.lit("a:b:c"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "a:b:c"))
    for name, ext in ((".gitignore", "NO_EXTENSION"), ("a.PY", ".py"), ("x.tar.gz", ".gz"), ("README", "NO_EXTENSION"), ("..a.b", ".b")):
        assert one(spark, text.extension(F.lit(name))) == ext
    assert one(spark, text.file_category(F.lit(".py"), F.lit("tests/a.py"))) == "source_code" and one(spark, text.file_category(F.lit(".x"), F.lit("Tests/a.x"))) == "tests"
    scores = spark.createDataFrame([("2.5",), ("9",), ("x",), (None,), ("-3",), ("Infinity",)], "v string")
    assert [r[0] for r in scores.select(text.judge_score(F.col("v"))).collect()] == [2, 5, 1, 1, 1, 5]


def test_repository(spark, tmp_path):
    for path, body in {"pkg/__init__.py": "", "pkg/_priv.py": "x=1", "pkg/test_a.py": "", "tests/t.py": "", ".git/x": "", "requirements.txt": "Flask==1", ".gitignore": "", "pkg/big.json": "1" * 500}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    s = repo_files.summary(spark, str(tmp_path))
    assert s["total_files"] == 7 and s["framework"] == "Flask" and s["repository_type"] == "Backend API" and s["top_level_directories"] == ["pkg", "tests"]
    assert s["file_extension_distribution"] == {".py": 4, ".txt": 1, "NO_EXTENSION": 1, ".json": 1} and s["largest_files"][0] == {"file": "pkg/big.json", "size_bytes": 500}
    assert {r["rel_path"] for r in repo_files.python_sources(spark, str(tmp_path)).collect()} == {"pkg/__init__.py", "pkg/_priv.py"}
    assert repo_files.internal_packages(spark, str(tmp_path)) == ("pkg",)
    before = spark.createDataFrame(repo_files.source_listing(spark, str(tmp_path)).drop("content").collect(), "path string, rel_path string, name string, size long, mtime double, depth int, is_dir boolean")
    (tmp_path / "pkg/_priv.py").write_text("x=22")
    (tmp_path / "pkg/new.py").write_text("")
    after = repo_files.source_listing(spark, str(tmp_path))
    assert {(r["rel_path"], r["change"]) for r in repo_files.changed(before, after).collect()} == {("pkg/_priv.py", "modified"), ("pkg/new.py", "added")}
    assert repo_files.fingerprint(before).first() != repo_files.fingerprint(after).first()


def test_metrics(spark):
    rows = [("a", ["x"], ["y", "x"]), ("a", ["x", "y"], ["y", "x", "x", "q", "q"]), ("b", ["z"], None)]
    m = evaluate.metrics(spark.createDataFrame(rows, "repository string, expected array<string>, retrieved array<string>"))
    got = {tuple(r["expected"]): r for r in m.collect()}
    assert got[("x",)]["first_hit_rank"] == 2 and got[("x",)]["mrr"] == 0.5 and not got[("x",)]["top_1"] and got[("x",)]["precision_5"] == 0.2
    assert got[("x", "y")]["recall_3"] == 1.5 and got[("z",)]["mrr"] == 0 and got[("z",)]["first_hit_rank"] is None
    avg = {r["repository"]: r for r in evaluate.averages(m).collect()}
    assert avg["ALL"]["questions"] == 3 and avg["ALL"]["mrr"] == 0.5
    assert "| ALL | 3 |" in evaluate.report(evaluate.averages(m)).first()["markdown"]


def test_questions(spark):
    assert {f for _, _, f, _ in benchgen.TEMPLATES} and len(benchgen.TEMPLATES) == 33
    symbols = spark.createDataFrame([("A.get_node", "get_node"), ("C.get_node", "get_node"), ("get_nodes", "get_nodes"), ("B.set_node", "set_node"), ("box", "box"), ("boxes", "boxes"), ("far", "far_away")], "id string, label string")
    got = {r["id"]: (r["n_same"], r["others"]) for r in benchgen.near_identical(symbols).collect()}
    assert got == {"A.get_node": (1, "get_nodes,set_node"), "C.get_node": (1, "get_nodes,set_node"), "get_nodes": (0, "get_node"), "B.set_node": (0, "get_node"), "box": (0, "boxes"), "boxes": (0, "box")}
    twins = {r["id"]: r["twin"] for r in benchgen._twins(symbols).collect()}
    assert twins == {"A.get_node": "B.set_node", "C.get_node": "A.get_node", "get_nodes": "A.get_node", "B.set_node": "A.get_node", "box": "boxes", "boxes": "box"}


def test_question_rules(spark):
    symbols = spark.createDataFrame([("Cart.total", "total"), ("Order", "Order"), ("order_lines", "order_lines"), ("ship", "ship")], "id string, label string")
    asked = [("ship", "How is ship handled here?"), ("ship", "Where is ship?"), ("ship", "How is ship"), ("ship", "How  is ship?"), ("none", "How is none made?"), ("ship", "What is the?"), ("Order", "What is order?"), ("Order", "What build order xyz?"), ("ship", "How util ship?")]
    importance = spark.createDataFrame([("ship", 0.5)], "id string, importance double")
    got = {r["question"]: (r["quality_score"], r["generation_reason"].split(" (")[0]) for r in benchgen.scored(spark.createDataFrame(asked, "id string, question string"), symbols, importance).collect()}
    assert got == {
        "How is ship handled here?": (0.7, "Accepted: Importance=0.50, Clarity=1.00"), "Where is ship?": (0.0, "Rejection: Question must start with 'How' or 'What'"), "How is ship": (0.0, "Rejection: Question must end with '?'"),
        "How  is ship?": (0.0, "Rejection: Question contains double spaces"), "How is none made?": (0.0, "Rejection: Expected node 'none' not found in public nodes"), "What is the?": (0.0, "Rejection: Question has no meaningful keywords"),
        "What is order?": (0.0, "Rejection: Ambiguous wording"), "What build order xyz?": (0.0, "Rejection: Uses generic verb 'build' with ambiguous noun context"), "How util ship?": (0.5, "Accepted: Importance=0.50, Clarity=0.50"),
    }


def test_providers(spark):
    calls, waits = [], []

    def flaky(system, user):
        calls.append(user)
        if len(calls) < 3:
            raise RuntimeError("429")
        return "fine"

    again = answer.Retrying(flaky, lambda e: "429" in str(e), sleep=waits.append)
    assert again("s", "u") == "fine" and len(waits) == 2 and waits[1] > waits[0] - 1
    with pytest.raises(ValueError):
        answer.Retrying(lambda s, u: (_ for _ in ()).throw(ValueError("no")), lambda e: False)("s", "u")
    asked = spark.createDataFrame([(1, 0, "s", "u"), (2, 1, "s", "u"), (3, 1, "s", "bad")], "question_id long, resolved long, system_prompt string, user_prompt string")

    def provider():
        def generate(system, user):
            if user == "bad":
                raise RuntimeError("rate limit")
            return " ok "

        return generate

    got = {r["question_id"]: (r["status"], r["answer"]) for r in answer.answered(asked, provider).collect()}
    assert got == {1: ("no_context", answer.NO_CONTEXT), 2: ("done", "ok"), 3: ("pending", None)}
    assert {r["status"] for r in answer.answered(asked).collect()} == {"no_context", "done"}
    assert answer.policy(["retrieval", "loading"])[0] == "merged(retrieval+loading)" and answer.policy(["visualization"])[0] == "default"


@pytest.mark.parametrize("other", ["routing", "statistics", "parsing", "configuration", "unknown"])
def test_policy_of_pairs_with_visualization(spark, other):
    """An intent without a policy brings the default one into a merge."""
    from weftgraph import vocab

    for intents in (["visualization", other], [other, "visualization"]):
        names = [i if i in vocab.HOPS else "default" for i in intents]
        want = {r: max(vocab.HOPS[n][k] for n in names) for k, r in enumerate(vocab.RELATIONSHIPS)}
        row = answer.policies(spark.createDataFrame([(intents,)], "intents array<string>")).first()
        assert row["policy"] == f"merged({names[0]}+{names[1]})" and {r: row[f"hops_{r}"] for r in want} == want
        assert answer.policy(intents) == (row["policy"], want)
