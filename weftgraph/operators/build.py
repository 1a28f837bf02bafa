"""The code graph of parsed files: node and edge tables as joins over the exploded symbols.

Symbols are keyed by bare name, as calls and bases are; of equal ids the first
in file order makes the node.  Name tables are as large as the repositories, so
that joins on them are left to the planner, which broadcasts them only where
their size allows.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import module_origin
from ..storage import cut
from .parse import symbols

EXCLUDED = (*vocab.BUILTIN_SYMBOLS, *vocab.FRAMEWORK_SYMBOLS)


def build_graph(parsed: DataFrame, internal: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of PARSED rows; ``internal``: top-level packages of the repository."""
    all_ = symbols(parsed)
    own = all_.filter((F.col("kind") == "Method") | ~F.col("name").isin(*EXCLUDED)).filter(F.col("owner").isNull() | ~F.col("owner").isin(*EXCLUDED))
    own = own.withColumn("id", F.when(F.col("kind") == "Method", F.concat_ws(".", "owner", "name")).otherwise(F.col("name")))
    classes = own.filter("kind = 'Class'").select("name").distinct()
    functions = own.filter("kind = 'Function'").select("name").distinct()
    methods = own.filter("kind = 'Method'").select("owner", "name").distinct()
    imports = parsed.filter("parse_error IS NULL").select("file_path", F.explode("imports").alias("module"))

    none = F.lit(None).cast("string")
    edge = lambda df, source, target, rel, dec=none: df.select(source.alias("source"), target.alias("target"), F.lit(rel).alias("relationship"), dec.alias("decorator_name"))
    file, id_ = F.col("file_path"), F.col("id")
    contained = own.filter("kind <> 'Method'")
    inherits = own.filter("kind = 'Class'").select("id", F.explode("bases").alias("name")).join(classes, "name", "left_semi")
    overrides = own.filter("kind = 'Method'").select("id", "name", F.explode("bases").alias("owner")).join(methods, ["owner", "name"], "left_semi")
    calls = own.filter("kind <> 'Class'").select("id", "kind", F.explode("calls").alias("name"))
    calls = (
        calls.join(classes.withColumn("is_class", F.lit(True)), "name", "left").join(functions.withColumn("is_function", F.lit(True)), "name", "left")
        .join(methods.select("name").distinct().withColumn("is_method", F.lit(True)), "name", "left")
    )
    called = calls.filter("is_class IS NULL AND (is_function OR (is_method AND kind = 'Method'))")
    decorated = own.select("id", F.explode("decorators").alias("d"))
    edges = (
        edge(contained, file, id_, "contains")
        .unionByName(edge(own.filter("kind = 'Method'"), F.col("owner"), id_, "contains"))
        .unionByName(edge(imports, file, F.col("module"), "imports"))
        .unionByName(edge(inherits, id_, F.col("name"), "inherits"))
        .unionByName(edge(calls.filter("is_class"), id_, F.col("name"), "instantiates"))
        .unionByName(edge(called, id_, F.col("name"), "calls"))
        .unionByName(edge(decorated, F.col("d.name"), id_, "decorates", F.col("d.name")))
        .unionByName(edge(overrides, id_, F.concat_ws(".", "owner", "name"), "overrides"))
        .distinct()
    )

    number = F.lit(None).cast("int")
    files = parsed.filter("parse_error IS NULL").select(
        file.alias("id"), F.lit("File").alias("type"), F.element_at(F.split(file, "/"), -1).alias("label"), file, number.alias("line_number"), none.alias("docstring"), none.alias("module_origin"), F.struct(file, F.lit(0).alias("stage"), F.array(F.lit(0), F.lit(0)).alias("ord")).alias("place"),
    )
    origin = module_origin("module", internal, tuple(sorted(sys.stdlib_module_names)))
    modules = imports.select(
        F.col("module").alias("id"), F.lit("Module").alias("type"), F.element_at(F.split("module", r"\."), -1).alias("label"), none.alias("file_path"), number.alias("line_number"), none.alias("docstring"), origin.alias("module_origin"), F.struct(file, F.lit(1).alias("stage"), F.array(F.lit(0), F.lit(0)).alias("ord")).alias("place"),
    )
    defined = own.select(id_, F.col("kind").alias("type"), F.col("name").alias("label"), file, "line_number", "docstring", none.alias("module_origin"), F.struct(file, F.lit(2).alias("stage"), "ord").alias("place"))
    every = files.unionByName(modules).unionByName(defined)
    first = every.groupBy("id").agg(F.min_by(F.struct("type", "label", "file_path", "line_number", "docstring", "module_origin"), "place").alias("n")).select("id", "n.*")
    used = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return first.join(used, "id", "left_semi"), edges


def numbered(edges: DataFrame) -> DataFrame:
    """Edges with their place in the list, for output: sorted by ranges, each range numbered by itself after the sizes of those before."""
    order = ("source", "target", "relationship", "_decorator")
    ranged = cut(edges.withColumn("_decorator", F.coalesce("decorator_name", F.lit(""))).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(before, "_range").withColumn("pos", (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_before", "_decorator")
