"""Graph views, degrees, statistics, look-ups and contexts over the node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import CODE_TYPES

#: view: (node types, relationships)
VIEWS = {
    "architecture": (("File", "Module", "Class"), ("imports", "contains")),
    "class": (("Class",), ("inherits", "instantiates", "decorates")),
    "call": (("Function", "Method"), ("calls",)),
}
#: An edge's place in the edge list is the order of these.
EDGE_ORDER = ("source", "target", "relationship", "decorator_name")


def place(side: int | Column) -> Column:
    """Where an end of an edge stands in the edge list: comparable, without numbering the edges."""
    side = F.lit(side) if isinstance(side, int) else side
    return F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in EDGE_ORDER], side.alias("side"))


def ends(edges: DataFrame) -> DataFrame:
    """Both ends of each edge: id, place, out (1 at the source), relationship."""
    both = F.explode(F.array(F.struct(F.col("source").alias("id"), place(0).alias("place"), F.lit(1).alias("out")), F.struct(F.col("target").alias("id"), place(1).alias("place"), F.lit(0).alias("out"))))
    return edges.select(both.alias("e"), "relationship").select("e.*", "relationship")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, first place): each end counts, self-loops twice, ids that are no nodes as well."""
    return ends(edges).groupBy("id").agg(F.count("*").alias("degree"), F.min("place").alias("place"))


def counts_by(table: DataFrame, column: str, name: str) -> DataFrame:
    return table.groupBy(column).agg(F.count("*").alias(name))


def top_by_type(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of each type with most edges; ties by first place in the edge list."""
    ranked = degrees(edges).join(nodes.select("id", "type"), "id")
    rank = F.row_number().over(W.partitionBy("type").orderBy(F.desc("degree"), "place")).cast("long")
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k).select("type", "rank", "id", "degree")


def hotspots(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k ids with most edges, decorator names included."""
    top = degrees(edges).orderBy(F.desc("degree"), "place").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("degree"), "place")).cast("long")).select("rank", "id", "degree")


def view(nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a view: edges need both ends (decorations only their target), nodes an edge."""
    types, relationships = VIEWS[name]
    allowed = nodes.filter(F.col("type").isin(*types))
    ids = allowed.select(F.col("id"))
    kept = edges.filter(F.col("relationship").isin(*relationships)).join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    plain = kept.filter("relationship <> 'decorates'").join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    out = plain.unionByName(kept.filter("relationship = 'decorates'")) if "decorates" in relationships else plain
    out = out.select(*EDGE_ORDER)
    used = out.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return allowed.join(used, "id", "left_semi"), out


def import_graph(edges: DataFrame) -> DataFrame:
    return edges.filter("relationship = 'imports'").select(F.col("source").alias("source_file"), F.col("target").alias("imported_module"))


def label_search(nodes: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    found = nodes.filter(F.lower("label").contains(text.lower()))
    return found.filter(F.col("type") == kind) if kind else found


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (id)."""
    one = edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi")
    return one.join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(*EDGE_ORDER)


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").select(*EDGE_ORDER)


def subgraph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(x["type"], F.lit("="), x["n"].cast("string")))
    n = counts_by(nodes, "type", "n").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.array_join(kinds, ",").alias("nodes_by_type"))  # few types
    e = edges.agg(F.count("*").alias("edge_count"), F.array_join(F.array_sort(F.collect_set("relationship")), ",").alias("edge_types"))
    return n.crossJoin(e)  # two single rows


def statistics(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    return {
        "nodes_by_type": counts_by(nodes, "type", "n"), "edges_by_type": counts_by(edges, "relationship", "n"),
        "top_by_type": top_by_type(nodes, edges), "hotspots": hotspots(edges),
    }


def around(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges at each seed (id): id, out, relationship, other, and the edge's place. Self-loops come twice."""
    e = F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(1).alias("out"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.lit(0).alias("out"), F.col("source").alias("other")),
    ))
    rows = edges.select(e.alias("e"), "relationship", place(0).alias("place"), "decorator_name").select("e.*", "relationship", "place", "decorator_name")
    return rows.join(seeds.select("id"), "id", "left_semi")


def node_context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per seed, direction and relationship: the other ends in edge order, joined by a comma."""
    groups = around(edges, seeds).groupBy("id", "out", "relationship").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "other"))).alias("o"))
    return groups.select("id", F.when(F.col("out") == 1, "outgoing").otherwise("incoming").alias("direction"), "relationship", "n", F.array_join(F.transform("o", lambda x: x["other"]), ",").alias("others"))


def neighbours(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct nodes beside each seed; a loop makes it its own neighbour."""
    beside = around(edges, seeds).select("id", "other").distinct()
    return beside.join(nodes.select(F.col("id").alias("other"), "type"), "other").select("id", "other", "type")


#: field: (out, relationship, type of the other end or None for any node)
CLASS_FIELDS = {
    "methods": (1, "contains", "Method"), "files": (0, "contains", "File"), "parents": (1, "inherits", None), "children": (0, "inherits", None),
    "instantiates": (1, "instantiates", None), "instantiated_by": (0, "instantiates", None),
}
CALLABLE_FIELDS = {
    "callers": (0, "calls", None), "callees": (1, "calls", None), "owning_class": (0, "contains", "Class"), "overrides": (1, "overrides", None), "overridden_by": (0, "overrides", None),
}


def context_lists(fields: dict, first: tuple[str, ...] = ()) -> list[Column]:
    """Aggregates over around() with other_type: an array for each field, in edge order, and the decorators'; fields in ``first`` keep one."""
    lists = []
    for name, (out, relationship, kind) in fields.items():
        hit = (F.col("out") == out) & (F.col("relationship") == relationship) & (F.col("other_type").isNotNull() if kind is None else F.col("other_type") == kind)
        if name in first:
            lists.append(F.filter(F.array(F.min_by("other", F.when(hit, F.col("place")))), lambda x: x.isNotNull()).alias(name))
        else:
            lists.append(F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("place", "other")))), lambda x: x["other"]).alias(name))
    decorator = F.when((F.col("out") == 0) & (F.col("relationship") == "decorates"), F.struct("place", "other"))
    return [*lists, F.transform(F.array_sort(F.collect_list(decorator)), lambda x: x["other"]).alias("decorators")]


def typed_context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, fields: dict, first: tuple[str, ...] = ()) -> DataFrame:
    """One row a seed and a joined list for each field; those in ``first`` keep the first by edge order."""
    rows = around(edges, seeds).join(nodes.select(F.col("id").alias("other"), F.col("type").alias("other_type")), "other", "left")
    got = rows.groupBy("id").agg(*context_lists(fields, first))
    return seeds.select("id").join(got.select("id", *[F.array_join(n, ",").alias(n) for n in (*fields, "decorators")]), "id", "left")


def class_context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return typed_context(nodes, edges, seeds, CLASS_FIELDS, ("files",))


def callable_context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return typed_context(nodes, edges, seeds, CALLABLE_FIELDS, ("owning_class", "overrides"))


def is_test(id_: Column, path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.split(low, "/")
    name = F.element_at(parts, -1)
    by_path = F.array_contains(parts, "tests") | F.array_contains(parts, "test") | name.startswith("test_") | name.startswith("conftest")
    return F.when(F.coalesce(path, F.lit("")) == "", F.lower(id_).contains("test")).otherwise(by_path)


def is_public(node: DataFrame) -> Column:
    from .. import vocab

    label, doc = F.col("label"), F.lower(F.coalesce("docstring", F.lit("")))
    warned = reduce(Column.__or__, [doc.contains(w) for w in ("deprecated", "experimental", "internal use only")])
    private = F.exists(F.split(label, r"\."), lambda p: p.startswith("_"))
    return F.col("type").isin(*CODE_TYPES) & ~is_test(F.col("id"), F.col("file_path")) & ~private & ~F.lower(label).isin(*vocab.GENERIC_NAMES) & ~warned


# Colours by type and relationship, the base size of a view's nodes, and what a degree adds.
NODE_COLOURS = {"File": "#4A90D9", "Module": "#7ED321", "Class": "#F5A623", "Function": "#9B59B6", "Method": "#E74C3C"}
EDGE_COLOURS = {"imports": "#7ED321", "contains": "#4A90D9", "inherits": "#E67E22", "instantiates": "#9B59B6", "decorates": "#1ABC9C", "calls": "#E74C3C", "overrides": "#F39C12"}
OTHER_NODE = "#95A5A6"
BASE_SIZES = {"architecture": 700, "class": 800, "call": 600}
DEGREE_SIZE = 60


def _coloured(column: str, colours: dict[str, str]) -> Column:
    return reduce(lambda w, c: w.when(F.col(column) == c[0], c[1]), list(colours.items()), F.when(F.lit(False), ""))


def drawing(nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """What is drawn of a view: nodes (id, label, type, colour, size) and edges (source, target, relationship, colour); both empty if it has no edge.

    A node's degree counts the pairs it is drawn in, a loop twice; sources of
    decorations that are no nodes are drawn too, without a type.
    """
    kept = view(nodes, edges, name)[1]
    pairs = kept.select("source", "target").distinct()
    degree = pairs.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    known = degree.join(nodes.select("id", "label", "type"), "id", "left")
    drawn = known.select("id", F.coalesce("label", "id").alias("label"), "type", F.coalesce(_coloured("type", NODE_COLOURS), F.lit(OTHER_NODE)).alias("colour"), (F.lit(BASE_SIZES[name]) + DEGREE_SIZE * F.col("degree")).alias("size"))
    return drawn, kept.select("source", "target", "relationship", _coloured("relationship", EDGE_COLOURS).alias("colour"))


def save_picture(nodes: DataFrame, edges: DataFrame, name: str, path: str) -> bool:
    """Draw a view on the driver, with matplotlib and networkx where they are installed; whether there was anything to draw."""
    try:
        import matplotlib
        import networkx
    except ImportError as missing:
        raise RuntimeError(f"pictures need matplotlib and networkx: {missing}") from missing
    matplotlib.use("Agg")
    from matplotlib import pyplot

    drawn, kept = (df.collect() for df in drawing(nodes, edges, name))
    if not kept:
        return False
    graph = networkx.DiGraph([(e["source"], e["target"]) for e in kept])
    facts, colour = {n["id"]: n for n in drawn}, {(e["source"], e["target"]): e["colour"] for e in kept}
    figure, axes = pyplot.subplots(figsize=(18, 12))
    networkx.draw_networkx(graph, networkx.spring_layout(graph, seed=42), ax=axes, node_color=[facts[n]["colour"] for n in graph], node_size=[facts[n]["size"] for n in graph], edge_color=[colour[e] for e in graph.edges], labels={n: facts[n]["label"] for n in graph}, font_size=7)
    axes.set_title(f"{name} graph")
    figure.savefig(path)
    pyplot.close(figure)
    return True
