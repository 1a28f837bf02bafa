"""A deterministic code graph made of the star-schema tables, as SQL that Spark and DuckDB both read.

Regions are files, nations classes, customers methods, suppliers functions and
brands modules.  It gives every graph operator an input that another engine can
build as well, at any scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import cut

_VERB = "CASE {k} % 10 WHEN 0 THEN 'parse' WHEN 1 THEN 'build' WHEN 2 THEN 'fetch' WHEN 3 THEN 'route' WHEN 4 THEN '_render' WHEN 5 THEN 'load' WHEN 6 THEN 'save' WHEN 7 THEN 'validate' WHEN 8 THEN 'compute' ELSE 'resolve' END"
_NOUN = "CASE {k} % 7 WHEN 0 THEN 'file' WHEN 1 THEN 'graph' WHEN 2 THEN 'node' WHEN 3 THEN 'request' WHEN 4 THEN 'response' WHEN 5 THEN 'token' ELSE 'report' END"
_ROLE = "CASE n_nationkey % 10 WHEN 0 THEN 'Parser' WHEN 1 THEN 'Builder' WHEN 2 THEN 'Retriever' WHEN 3 THEN 'Router' WHEN 4 THEN 'Result' WHEN 5 THEN 'Loader' WHEN 6 THEN 'Config' WHEN 7 THEN 'Validator' WHEN 8 THEN 'Schema' ELSE 'Resolver' END"
_CLASS = f"concat('Nation', CAST(n_nationkey AS STRING), {_ROLE})"
_FILE = "concat('app/', lower(r_name), '/core.py')"
_METHOD = f"concat({_VERB.format(k='c_custkey')}, '_', {_NOUN.format(k='c_custkey')}, '_', CAST(c_custkey AS STRING))"
_FUNCTION = f"concat({_VERB.format(k='s_suppkey')}, '_', {_NOUN.format(k='(s_suppkey + 3)')}, '_', CAST(s_suppkey AS STRING))"

NODES = f"""
SELECT {_FILE} AS id, 'File' AS type, 'core.py' AS label, {_FILE} AS file_path, CAST(NULL AS INT) AS line_number, CAST(NULL AS STRING) AS docstring, CAST(NULL AS STRING) AS module_origin FROM region
UNION ALL
SELECT {_CLASS}, 'Class', {_CLASS}, {_FILE}, CAST(n_nationkey AS INT) + 1, concat('Nation of ', lower(r_name)), NULL FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat({_CLASS}, '.', {_METHOD}), 'Method', {_METHOD}, {_FILE}, CAST(c_custkey AS INT) + 100, CASE WHEN c_custkey % 11 = 0 THEN 'Deprecated. Use another.' ELSE c_mktsegment END, NULL
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT {_FUNCTION}, 'Function', {_FUNCTION}, {_FILE}, CAST(s_suppkey AS INT) + 10, CAST(NULL AS STRING), NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT DISTINCT concat('vendor.', lower(replace(p_brand, '#', '_'))), 'Module', lower(replace(p_brand, '#', '_')), CAST(NULL AS STRING), CAST(NULL AS INT), CAST(NULL AS STRING), 'third_party' FROM part
"""

EDGES = f"""
SELECT source, target, relationship, decorator_name FROM (
SELECT {_FILE} AS source, {_CLASS} AS target, 'contains' AS relationship, CAST(NULL AS STRING) AS decorator_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT {_CLASS}, concat({_CLASS}, '.', {_METHOD}), 'contains', NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT {_FILE}, {_FUNCTION}, 'contains', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT DISTINCT {_FILE}, concat('vendor.', lower(replace(p_brand, '#', '_'))), 'imports', CAST(NULL AS STRING)
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT c.name, p.name, 'inherits', NULL FROM (SELECT n_nationkey AS k, {_CLASS} AS name FROM nation) c JOIN (SELECT n_nationkey AS k, {_CLASS} AS name FROM nation) p ON p.k = c.k - 5
UNION ALL
SELECT {_FUNCTION}, {_CLASS}, 'instantiates', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000
UNION ALL
SELECT lower(c_mktsegment), concat({_CLASS}, '.', {_METHOD}), 'decorates', lower(c_mktsegment) FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT DISTINCT concat({_CLASS}, '.', {_METHOD}), {_FUNCTION}, 'calls', CAST(NULL AS STRING)
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l_suppkey = s_suppkey
UNION ALL
SELECT a.id, b.id, 'overrides', NULL
FROM (SELECT c_custkey AS c, c_nationkey AS k, concat({_CLASS}, '.', {_METHOD}) AS id FROM customer JOIN nation ON c_nationkey = n_nationkey) a
JOIN (SELECT c_custkey AS c, c_nationkey AS k, concat({_CLASS}, '.', {_METHOD}) AS id FROM customer JOIN nation ON c_nationkey = n_nationkey) b ON b.c = a.c + 1 AND b.k < a.k
) edge_rows
"""

#: Who calls whom in EDGES, by keys: DISTINCT over the keys, which the names are one to one with.
_CALLS = """SELECT DISTINCT c, s FROM (SELECT /*+ REPARTITION(o_custkey) */ o_custkey AS c, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_CALL_EDGES = f"""SELECT concat({_CLASS}, '.', {_METHOD}) AS source, {_FUNCTION} AS target, 'calls' AS relationship, CAST(NULL AS STRING) AS decorator_name
FROM ({_CALLS}) JOIN (SELECT DISTINCT c_custkey, c_nationkey FROM customer) ON c = c_custkey JOIN (SELECT DISTINCT n_nationkey FROM nation) ON c_nationkey = n_nationkey JOIN (SELECT DISTINCT s_suppkey FROM supplier) ON s = s_suppkey"""
_BY_NAME = EDGES[EDGES.rindex("SELECT DISTINCT") : EDGES.rindex("UNION ALL")]

#: Questions put to the ranker.
QUESTIONS = """
SELECT * FROM (VALUES
  (1, 'How are files parsed?'), (2, 'How does request routing work?'), (3, 'How is the call graph built?'), (4, 'Where are reports saved?'),
  (5, 'How is node degree computed?'), (6, 'How are tokens validated?'), (7, 'What does Nation3Router do?'), (8, 'How are responses rendered?'),
  (9, 'How does resolve_node_9 retrieve a graph?'), (10, 'xyzzy blarghnarg')
) AS q(question_id, question)
"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the driver tables (schemas come from the files' footers; scans stay lazy)."""
    for name in names or _TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def graph(spark: SparkSession, sf_dir: str, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the adapter; ``keep`` writes them to the shared folder first, for operators that read them more than once."""
    tables(spark, sf_dir)
    nodes, edges = spark.sql(NODES), spark.sql(EDGES.replace(_BY_NAME, _CALL_EDGES + "\n"))
    spread = 4 * spark.sparkContext.defaultParallelism  # the nodes come from a few small files, one of them with nearly all
    return (cut(nodes.repartition(spread, "id")), cut(edges)) if keep else (nodes, edges)


def questions(spark: SparkSession) -> DataFrame:
    return spark.sql(QUESTIONS).selectExpr("CAST(question_id AS BIGINT) AS question_id", "question")


#: Prefix of every oracle statement over the graph.
WITH_GRAPH = f"WITH nodes AS MATERIALIZED ({NODES}), edges AS MATERIALIZED ({EDGES})"
