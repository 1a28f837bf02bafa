"""Texts about nodes for a prompt: lists by type, relations, neighbours, all nodes of a batch at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut
from .views import CALLABLE_FIELDS, CLASS_FIELDS, around, context_lists

# Title of each list in a block.
CLASS_TITLES = {"files": "Defined in file", "methods": "Methods", "parents": "Inherits from", "children": "Subclassed by", "instantiates": "Instantiates", "instantiated_by": "Instantiated by", "decorators": "Decorators"}
CALLABLE_TITLES = {"owning_class": "Owning class", "callers": "Callers", "callees": "Calls", "overrides": "Overrides", "overridden_by": "Overridden by"}


def require(nodes: DataFrame, *ids: str) -> None:
    """KeyError for ids that are no nodes, with ten that are."""
    found = {r["id"] for r in nodes.filter(F.col("id").isin(*ids)).select("id").distinct().collect()}
    if missing := sorted(set(ids) - found):
        known = [r["id"] for r in unknown_sample(nodes).collect()]
        raise KeyError(f"not in the graph: {', '.join(missing)}; some ids that are: {', '.join(known)}")


def unknown_sample(nodes: DataFrame, n: int = 10) -> DataFrame:
    """The first ids of the graph, for an error about an unknown one."""
    return nodes.select("id").distinct().orderBy("id").limit(n)


def beside(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges at each wanted node (id) with the type of the other end, null where that is no node; written once, four reports read it."""
    types = nodes.select(F.col("id").alias("other"), F.col("type").alias("other_type"))
    return cut(around(edges, wanted.select("id").distinct()).join(types, "other", "left"))


def resolved_nodes(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, outgoing_count, incoming_count, neighbour_ids) of wanted nodes (id) that are in the graph."""
    return _counted(nodes, beside(nodes, edges, wanted), wanted)


def _counted(nodes: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    counts = rows.groupBy("id").agg(F.count_if(F.col("out") == 1).alias("outgoing_count"), F.count_if(F.col("out") == 0).alias("incoming_count"))
    near = rows.filter("other_type IS NOT NULL").select("id", "other").distinct().groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("neighbour_ids"))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    own = nodes.select("id").distinct().join(wanted.select("id").distinct(), "id", "left_semi")
    return own.join(counts, "id", "left").join(near, "id", "left").select("id", F.coalesce("outgoing_count", zero).alias("outgoing_count"), F.coalesce("incoming_count", zero).alias("incoming_count"), F.coalesce("neighbour_ids", none).alias("neighbour_ids"))


def _relations(rows: DataFrame, most: int) -> DataFrame:
    """(id, outgoing, incoming): lines of relations by relationship and edge order, at most ``most`` each; ranked before they are gathered."""
    line = F.when(F.col("out") == 1, F.concat(F.lit("  --["), "relationship", F.lit("]--> "), "other")).otherwise(F.concat(F.lit("  <--["), "relationship", F.lit("]-- "), "other"))
    nth = F.row_number().over(W.partitionBy("id", "out", "relationship").orderBy("place"))
    top = rows.withColumn("nth", nth).filter(F.col("nth") <= most)
    side = lambda o: F.transform(F.array_sort(F.collect_list(F.when(F.col("out") == o, F.struct("relationship", "nth", line.alias("line"))))), lambda x: x["line"])
    return top.groupBy("id").agg(side(1).alias("outgoing"), side(0).alias("incoming"))


def _neighbours(rows: DataFrame, most: int) -> DataFrame:
    """(id, near): the title and the first ``most`` neighbours by type and id."""
    distinct = rows.filter("other_type IS NOT NULL").select("id", "other", F.col("other_type").alias("t")).distinct()
    totals = distinct.groupBy("id").agg(F.count("*").alias("total"))
    top = distinct.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("t", "other"))).filter(F.col("nth") <= most)
    line = F.concat(F.lit("  ["), "t", F.lit("] "), "other")
    listed = top.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"]).alias("ls"))
    title = F.concat(F.lit("\nNeighbours ("), F.col("total").cast("string"), F.lit(" total, showing "), F.size("ls").cast("string"), F.lit("):"))
    return listed.join(totals, "id").select("id", F.concat(F.array(title), "ls").alias("near"))


def node_blocks(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, most: int = 20) -> DataFrame:
    """(id, block, outgoing_count, incoming_count, neighbour_ids) of wanted nodes (id).

    A class or a callable has its own lists, whole; relations of each kind and
    side, and neighbours, are listed up to ``most`` with the neighbours' total.
    """
    facts = nodes.join(wanted.select("id").distinct(), "id", "left_semi")
    rows = beside(nodes, edges, facts)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    some = lambda title, c: F.when(text(c) != "", F.concat(F.lit(title), text(c)))
    head = [
        F.concat(F.lit("=== "), F.upper("type"), F.lit(": "), "label", F.lit(" ===")), F.concat(F.lit("ID: "), "id"), some("File: ", F.col("file_path")),
        F.when(F.col("line_number") > 0, some("Line: ", F.col("line_number"))), some("Docstring: ", F.substring_index("docstring", "\n", 1)),
    ]
    lists = rows.groupBy("id").agg(*context_lists(CLASS_FIELDS, ("files",)), *[c for c in context_lists(CALLABLE_FIELDS, ("owning_class", "overrides"))[:-1]])
    of = lambda kinds, titles: [F.when(F.col("type").isin(*kinds), F.when(F.size(n) > 0, F.concat(F.lit(f"{t}: "), F.array_join(n, ", ")))) for n, t in titles.items()]
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.array(F.lit(f"\n{title} relationships:")), F.col(c))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    single = F.filter(F.array(*head, *of(("Class",), CLASS_TITLES), *of(("Function", "Method"), CALLABLE_TITLES)), lambda x: x.isNotNull())
    lines = F.concat(single, part("Outgoing", "outgoing"), part("Incoming", "incoming"), F.coalesce("near", none))
    tables = [lists, _relations(rows, most), _neighbours(rows, most), _counted(nodes, rows, facts)]
    joined = reduce(lambda a, b: a.join(b, "id", "left"), tables, facts)
    method = F.col("type") == "Method"  # a function is in no class
    joined = joined.withColumn("owning_class", F.when(method, F.col("owning_class")).otherwise(none))
    return joined.select("id", F.array_join(lines, "\n").alias("block"), "outgoing_count", "incoming_count", "neighbour_ids")


def edges_of_type(edges: DataFrame, ids: DataFrame, relationship: str) -> DataFrame:
    """Edges of one kind at each id, in both directions; a loop comes twice."""
    return around(edges, ids).filter(F.col("relationship") == relationship).select("id", F.when(F.col("out") == 1, "outgoing").otherwise("incoming").alias("direction"), "other")
