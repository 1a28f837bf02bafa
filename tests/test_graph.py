"""Parser, graph builder, views, ranker and expansion on small literal graphs."""

import pytest

from weftgraph.operators import build, parse, resolve, traverse, views
from weftgraph.schemas import EDGES, NODES, PARSED


def fn(name, calls=(), line=1):
    return {"name": name, "line_number": line, "arguments": [], "return_type": None, "docstring": None, "calls": sorted(calls), "instantiates": [], "decorators": []}


def cls(name, bases=(), methods=()):
    return {"name": name, "line_number": 1, "inherits_from": list(bases), "docstring": None, "methods": list(methods), "decorators": []}


def parsed(spark, *files):
    return spark.createDataFrame([{"file_path": p, "imports": list(i), "classes": list(c), "functions": list(f), "parse_error": None} for p, i, c, f in files], PARSED)


def counts(edges):
    return {r["relationship"]: r["count"] for r in edges.groupBy("relationship").count().collect()}


def test_two_files(spark):
    nodes, edges = build.build_graph(parsed(
        spark,
        ("app/animals.py", ["abc", "pydantic"], [cls("Animal", (), [fn("speak"), fn("eat")]), cls("Dog", ["Animal", "BaseModel"], [fn("speak"), fn("fetch", ["Animal", "str", "dict"])])], [fn("create_animal", ["Animal", "Dog", "Exception", "list"])]),
        ("app/cats.py", ["pydantic"], [cls("Cat", ["BaseModel", "ABC"], [fn("purr")])], []),
    ))
    assert nodes.count() == 13
    assert counts(edges) == {"imports": 3, "contains": 9, "inherits": 1, "overrides": 1, "instantiates": 3}
    assert not nodes.filter("id IN ('BaseModel', 'ABC', 'Exception', 'list')").count()
    origins = {r["id"]: r["module_origin"] for r in nodes.filter("type = 'Module'").collect()}
    assert origins == {"abc": "stdlib", "pydantic": "third_party"}


def test_three_files(spark):
    nodes, edges = build.build_graph(parsed(
        spark,
        ("services/base.py", ["abc"], [cls("BaseService", (), [fn("execute"), fn("validate")])], []),
        ("services/user_service.py", ["abc", "pydantic"], [cls("UserService", ["BaseService", "ABC", "object"], [fn("execute", ["BaseService", "dict", "list"]), fn("get_user", ["UserRepository", "ValueError"])])], [fn("bootstrap", ["UserService", "UserRepository", "Exception", "BaseModel"])]),
        ("repositories/user_repository.py", ["pydantic"], [cls("UserRepository", ["BaseModel"], [fn("find", ["str", "int"]), fn("save")])], []),
    ))
    assert nodes.count() == 15
    assert counts(edges) == {"imports": 4, "contains": 10, "inherits": 1, "overrides": 1, "instantiates": 4}


def test_bare_method_call_dangles_and_first_file_wins(spark):
    nodes, edges = build.build_graph(parsed(
        spark, ("a.py", [], [cls("A", (), [fn("go", ["run"], 5)])], []), ("b.py", [], [cls("A", (), [fn("run")]), cls("B", (), [fn("x")])], [fn("main", ["run"])]),
    ))
    assert {(r["source"], r["target"]) for r in edges.filter("relationship = 'calls'").collect()} == {("A.go", "run")}
    assert nodes.filter("id = 'A'").first()["file_path"] == "a.py"
    assert views.dangling(nodes, edges).count() == 1


SOURCE = b'''
import os, a.b as c
from x.y import z
from . import sibling
@app.route("/x")
class K(Base, mod.Other, Generic[T]):
    "doc"
    @staticmethod
    async def m(self, a, *, b=f()):
        def inner():
            import late
            g(len(a)); self.h()
        return K()
def top(): pass
'''


def test_parse(spark):
    df = spark.createDataFrame([("k.py", SOURCE), ("bad.py", b"def ("), ("latin.py", b"x = '\xe9'"), ("none.py", None)], "rel_path string, content binary")
    rows = {r["file_path"]: r for r in parse.parse(df).collect()}
    k = rows["k.py"]
    assert k["imports"] == ["a.b", "late", "os", "x.y"]
    (c,) = k["classes"]
    assert c["inherits_from"] == ["Base", "Other", "Generic[T]"] and c["docstring"] == "doc"
    assert [tuple(d) for d in c["decorators"]] == [("app.route", True)]
    (m,) = c["methods"]
    assert m["arguments"] == ["self", "a"] and m["calls"] == ["K", "f", "g", "h"] and [tuple(d) for d in m["decorators"]] == [("staticmethod", False)]
    assert [f["name"] for f in k["functions"]] == ["top"]
    assert rows["bad.py"]["parse_error"].startswith("SyntaxError") and rows["latin.py"]["parse_error"] is None and rows["none.py"]["classes"] == []
    assert views.counts_by(parse.symbols(parse.parse(df)), "kind", "n").count() == 3


def node(id_, type_, label=None, path=None):
    return (id_, type_, label or id_, path, None, None, None)


@pytest.fixture(scope="module")
def master(spark):
    nodes = [node("app/main.py", "File", "main.py"), node("app/utils.py", "File", "utils.py"), node("fastapi", "Module"), node("app.utils", "Module", "utils")]
    nodes += [node(c, "Class") for c in ("Router", "Handler", "BaseHandler")] + [node(f, "Function") for f in ("create_app", "helper")]
    nodes += [node(f"{c}.{m}", "Method", m) for c in ("Handler", "BaseHandler") for m in ("handle", "setup")]
    main, utils = "app/main.py", "app/utils.py"
    edges = [(main, "fastapi", "imports"), (main, "app.utils", "imports"), (main, "Router", "contains"), (main, "create_app", "contains"), (utils, "Handler", "contains"), (utils, "BaseHandler", "contains"), (utils, "helper", "contains")]
    edges += [(c, f"{c}.{m}", "contains") for c in ("Handler", "BaseHandler") for m in ("handle", "setup")]
    edges += [("Handler", "BaseHandler", "inherits"), ("create_app", "Router", "instantiates"), ("Handler.handle", "helper", "calls"), ("create_app", "helper", "calls")]
    edges += [("Handler.handle", "BaseHandler.handle", "overrides"), ("Handler.setup", "BaseHandler.setup", "overrides")]
    rows = [(*e, None) for e in edges] + [("app.route", "Router", "decorates", "app.route")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(rows, EDGES)


@pytest.mark.parametrize(("name", "n", "e"), [("architecture", 7, 5), ("class", 3, 2), ("call", 3, 2)])
def test_views(master, name, n, e):
    nodes, edges = views.view(*master, name)
    assert (nodes.count(), edges.count()) == (n, e)


def test_degrees_and_contexts(spark, master):
    nodes, edges = master
    got = {r["id"]: r["degree"] for r in views.degrees(edges).collect()}
    assert got["app/main.py"] == got["Handler"] == got["BaseHandler"] == 4 and got["app.route"] == 1 and sum(got.values()) == 36
    seed = nodes.filter("id = 'Handler'")
    row = views.class_context(nodes, edges, seed).first()
    assert row["methods"] == "Handler.handle,Handler.setup" and row["files"] == "app/utils.py" and row["parents"] == "BaseHandler"
    row = views.callable_context(nodes, edges, nodes.filter("id = 'Handler.handle'")).first()
    assert (row["callees"], row["owning_class"], row["overrides"], row["callers"]) == ("helper", "Handler", "BaseHandler.handle", "")
    near = {r["id"] for r in traverse.subgraph(nodes, edges, seed, 1)[0].collect()}
    assert near == {"Handler", "Handler.handle", "Handler.setup", "BaseHandler", "app/utils.py"}
    assert {r["id"] for r in traverse.subgraph(nodes, edges, seed, 0)[0].collect()} == {"Handler"}
    ranks = {r["id"]: r["pagerank"] for r in traverse.pagerank(nodes, edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9


def test_intent_reach_follows_one_edge_a_key(spark, master):
    nodes, edges = master
    seeds = spark.createDataFrame([(0, "create_app")], "grp long, id string")
    none = dict.fromkeys(("inherits", "imports", "decorates", "overrides", "contains"), 0)
    strict = {r["id"] for r in traverse.intent_reach(nodes, edges, seeds, none | {"calls": 2, "instantiates": 0}).collect()}
    assert strict == {"create_app", "helper", "Handler.handle"}  # of helper's callers only the first in edge order
    assert {r["id"] for r in traverse.intent_reach(nodes, edges, seeds, none | {"calls": 1, "instantiates": 0}).collect()} == {"create_app", "helper"}
    wide = {r["id"] for r in traverse.intent_reach(nodes, edges, seeds, none | {"calls": 2, "instantiates": 1}, strict=False).collect()}
    assert wide == {"create_app", "helper", "Router", "Handler.handle"}


def test_rank_small_graph(spark):
    nodes = spark.createDataFrame([node("app/utils.py", "File", "utils.py"), node("Retriever", "Class"), node("Retriever.fetch", "Method", "fetch")], NODES)
    edges = spark.createDataFrame([("app/utils.py", "Retriever", "contains", None), ("Retriever", "Retriever.fetch", "contains", None)], EDGES)
    q = spark.createDataFrame([(1, "How does fetch work?"), (2, "xyzzy blarghnarg")], "question_id long, question string")
    asked = {r["question_id"]: r for r in resolve.understood(q).collect()}
    assert asked[1]["keywords"] == ["fetch"] and asked[1]["intents"] == ["retrieval", "loading"] and asked[1]["expanded"] == ["fetch", "retrieve", "load", "download"]
    assert asked[2]["intents"] == ["unknown"]
    got = [(r["id"], r["score"]) for r in resolve.rank(nodes, edges, q).orderBy("rank").collect()]
    assert got == [("Retriever.fetch", 27.0), ("Retriever", -2.0)]


def test_published_keywords(spark):
    q = spark.createDataFrame([(1, "How are routes registered?"), (2, "How does dependency injection work?"), (3, "How are requests handled?"), (4, "How are responses processed?")], "question_id long, question string")
    got = {r["question_id"]: (r["keywords"], r["intents"][0]) for r in resolve.understood(q).collect()}
    assert got[1] == (["routes", "rout", "registered", "register"], "routing")
    assert got[2] == (["dependency", "injection", "injec"], "analysis")
    assert got[3] == (["requests", "request", "handled", "handl"], "routing")
    assert got[4] == (["responses", "respons", "processed", "process"], "transformation")
