"""What the findings of round 3 named: numbers as other engines print them, large sources, tables that stay where they are."""

from pyspark.sql import functions as F

from weftgraph.operators import build, evaluate, parse, report, traverse
from weftgraph.plans import adapter
from weftgraph.schemas import EDGES, NODES
from weftgraph.storage import cut


def test_ties_are_printed_as_after_round(spark):
    means = spark.createDataFrame([(0.0045, 0.5005), (0.0715, 0.5035), (0.1234, 0.1234)], "p double, mrr double")
    rows = means.select(*[F.col("p").alias(c) for c in report.METRIC_COLUMNS], "mrr").select(report.table_row(F.lit("x")).alias("l")).collect()
    cells = [[c.strip() for c in r["l"].split("|")] for r in rows]
    assert [(c[2], c[9], c[11]) for c in cells] == [("0.5%", "0.5%", "0.500"), ("7.2%", "7.2%", "0.503"), ("12.3%", "12.3%", "0.123")]
    signed = means.select(evaluate.signed("p", F.lit(0.0), F.lit(True)).alias("s"), evaluate.signed(F.lit(0.0), "p", F.lit(True)).alias("t")).collect()
    assert [tuple(r) for r in signed][:2] == [("0.5% (+0.5%)", "0.0% (-0.5%)"), ("7.2% (+7.2%)", "0.0% (-7.2%)")]


def test_large_sources_are_parsed_in_pieces(spark):
    method = lambda k: f"    @cached\n    def m_{k}(self, a: int) -> str:\n        'Line of {k}.'\n        load_{k % 50}(len(a))\n        return self.m_{k + 1}()\n\n"
    cls = "import os\r\n\n@register\nclass Big(Base, abc.Other):\n    'Doc.'\n" + "".join(map(method, range(2000))) + "LATER = 1\nif LATER:\n    def hidden(): pass\n"
    functions = "".join(f"@timed(1)\ndef load_{k}(x=1):\n    import a{k % 3}\n    return m_{k}(x)\n" for k in range(2000))
    nested = "class Odd:\n  if True:\n" + "".join(map(method, range(2000)))  # methods of no class body
    text = "X = '''\n" + functions + "'''\ndef after(): pass\n"  # definitions inside a string
    files = {"big.py": cls + functions, "nested.py": nested, "text.py": text, "broken.py": cls + functions + "def (:\n", "small.py": "def f(): pass\n", "bad.py": "def (:\n", "empty.py": None}
    sources = spark.createDataFrame([(p, bytearray(t.encode()) if t is not None else None) for p, t in files.items()], "rel_path string, content binary")
    pieces, whole = parse.pieces(sources).cache(), parse.parse(sources).cache()
    of = {r["file_path"]: r["n"] for r in pieces.groupBy("file_path").agg(F.count("*").alias("n")).collect()}
    assert of["big.py"] > 5 and all(n == 1 for p, n in of.items() if p != "big.py")
    assert pieces.filter("file_path = 'big.py'").agg(F.max(F.size(F.flatten("classes.methods")) + F.size("functions"))).first()[0] < 2000
    ordered = lambda df: [tuple(r) for r in parse.symbols(df).orderBy("file_path", "ord").drop("ord").collect()]
    assert ordered(pieces) == ordered(whole) and len(ordered(whole)) > 4000
    errors = lambda df: sorted(map(tuple, df.filter("parse_error IS NOT NULL").select("file_path", "parse_error").collect()))
    assert errors(pieces) == errors(whole) and [p for p, _ in errors(whole)] == ["bad.py", "broken.py"]
    counts = {r["file_path"]: tuple(r)[1:] for r in parse.by_file(pieces).collect()}
    assert counts["big.py"] == (["a0", "a1", "a2", "os"], 1, 2000, 2000, False) and counts["broken.py"][1:] == (0, 0, 0, True)
    for a, b in zip(build.build_graph(pieces), build.build_graph(whole), strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_small_tables_are_joined_where_the_edges_lie(spark):
    edges = cut(spark.range(400_000).selectExpr("concat('method_of_a_class_', id % 5000) AS source", "concat('function_', id) AS target", "'calls' AS relationship", "CAST(NULL AS STRING) AS decorator_name"))
    few = cut(edges.unionByName(edges).unionByName(edges).select(F.col("target").alias("source")).filter("source LIKE '%_77'").distinct())
    plan = edges.join(few, "source")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_calls_by_keys_are_calls_by_name(spark):
    adapter.tables(spark, "/root/testdata/sf0.001")
    spark.table("customer").unionAll(spark.table("customer").limit(3)).createOrReplaceTempView("customer")  # keys that come twice
    by_name = spark.sql(adapter._BY_NAME)
    assert sorted(map(tuple, spark.sql(adapter._CALL_EDGES).collect())) == sorted(map(tuple, by_name.collect()))


def test_links_stay_in_place_over_all_rounds(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(traverse, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    edges = spark.createDataFrame([(f"n{k}", f"n{k * 7 % 10}", "calls", None) for k in range(1, 10)], EDGES)
    nodes = spark.createDataFrame([(f"n{k}", "Function", f"n{k}", None, None, None, None) for k in range(10)], NODES)
    ranks = traverse.pagerank(nodes, edges, 4)
    assert abs(ranks.agg(F.sum("pagerank")).first()[0] - 1) < 1e-9
    rounds = plans[1:]
    assert len(rounds) == 4 and all("InMemoryTableScan" in p for p in rounds) and len(rounds[3]) < 1.5 * len(rounds[1])
