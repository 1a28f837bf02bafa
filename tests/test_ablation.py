"""The ablation query ranks five places for every question in every configuration."""

from weftgraph.operators import resolve
from weftgraph.plans import adapter, queries


def test_ablation_is_whole(spark):
    d = "/root/testdata/sf0.001"
    got = {}
    for r in queries.QUERIES["ablation_topk"](spark, d).collect():
        got.setdefault(r["config"], set()).add((r["question_id"], r["rank"], r["id"], r["score"]))
    assert set(got) == {"baseline", "all", *resolve.TOGGLES}
    nodes, edges = adapter.graph(spark, d, keep=True)
    for config, on in (("baseline", False), ("all", True)):
        ranked = resolve.rank(nodes, edges, adapter.questions(spark), 5, dict.fromkeys(resolve.TOGGLES, on))
        assert got[config] == {(r["question_id"], r["rank"], r["id"], r["score"]) for r in ranked.collect()}
