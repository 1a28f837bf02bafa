from weftgraph import api


def test_cached_graph(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "pkg").mkdir(parents=True)
    (repo / "pkg/__init__.py").write_text("")
    (repo / "pkg/a.py").write_text("import pkg.b, os\nclass A:\n    def go(self):\n        return helper()\ndef helper():\n    return A()\n")
    nodes, edges, hit = api.cached_graph(spark, str(repo), str(tmp_path / "cache"))
    assert not hit and {(r["source"], r["target"], r["relationship"]) for r in edges.collect()} == {
        ("pkg/a.py", "A", "contains"), ("A", "A.go", "contains"), ("pkg/a.py", "helper", "contains"), ("pkg/a.py", "os", "imports"), ("pkg/a.py", "pkg.b", "imports"), ("A.go", "helper", "calls"), ("helper", "A", "instantiates"),
    }
    assert {r["id"]: r["module_origin"] for r in nodes.filter("type = 'Module'").collect()} == {"os": "stdlib", "pkg.b": "internal"}
    assert api.cached_graph(spark, str(repo), str(tmp_path / "cache"))[2]
    (repo / "pkg/b.py").write_text("x = 1\n")
    assert not api.cached_graph(spark, str(repo), str(tmp_path / "cache"))[2]
    assert api.analyze(spark, str(repo))["total_files"] == 3
