"""Queries on the parser and the graph builder: Python sources are made of the star-schema tables, the SQL states the graph from the tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..operators import answer, build, contexts, parse, resolve, views
from ..sources import repo_files
from ..storage import cut
from . import adapter
from .queries import _AROUND, _DRAWN, _INTENT, _SCORES, _SEEDS, G, _drawing_sql, _seeds, query, quoted
from .queries_more import _FILES, _files

_ROLE = "CASE {k} % 3 WHEN 0 THEN 'Parser' WHEN 1 THEN 'Builder' ELSE 'Router' END"
_CLASS = "concat('Nation', CAST({k} AS STRING), " + _ROLE + ")"
_METHOD = "concat('m_', CAST({k} % 40 AS STRING))"
_CALLS = 50


def _sources(spark, d) -> DataFrame:
    """(rel_path, content): a file for each nation with its class, methods and functions; broken files for regions."""
    adapter.tables(spark, d, "region", "nation", "customer", "supplier")
    cls = _CLASS.format(k="(c_custkey % 25)")
    methods = spark.sql(f"""SELECT c_nationkey AS k, c_custkey AS o, concat(
      CASE WHEN c_custkey % 7 = 0 THEN '    @cached\n' ELSE '' END, CASE WHEN c_custkey % 11 = 0 THEN '    @app.route("/x")\n' ELSE '' END,
      '    def ', {_METHOD.format(k='c_custkey')}, '(self, a: int) -> str:\n        "Line of ', c_custkey, '."\n        load_', c_custkey % {_CALLS}, '(len(str(a)))\n        ', {cls}, '()\n        return self.', {_METHOD.format(k='(c_custkey + 1)')}, '()\n') AS t FROM customer""")
    functions = spark.sql(f"""SELECT s_nationkey AS k, s_suppkey AS o, concat(CASE WHEN s_suppkey % 3 = 0 THEN '@timed(1)\n' ELSE '' END, 'def load_', s_suppkey, '(x=1):\n    return ', {_CLASS.format(k='(s_suppkey % 25)')}, '(x) or ', {_METHOD.format(k='s_suppkey')}, '(x) or load_', s_suppkey % 10 + 1, '(x)\n') AS t FROM supplier""")
    joined = lambda rows, name: rows.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n").alias(name))
    head = spark.sql(f"""SELECT n_nationkey AS k, concat('import os, vendor.r', n_regionkey, '\n', CASE WHEN n_nationkey > 0 THEN concat('from app.nation', n_nationkey - 1, ' import x\n') ELSE 'from . import y\n' END,
      '@register\nclass ', {_CLASS.format(k='n_nationkey')}, '(', CASE WHEN n_nationkey >= 5 THEN concat({_CLASS.format(k='(n_nationkey - 5)')}, ', ') ELSE '' END, 'BaseModel):\n    "Nation ', n_nationkey, '."\n') AS h FROM nation""")
    whole = head.join(joined(methods, "m"), "k", "left").join(joined(functions, "f"), "k", "left")
    files = whole.select(F.concat(F.lit("app/nation"), "k", F.lit(".py")).alias("rel_path"), F.concat_ws("\n", "h", "m", "f").cast("binary").alias("content"))
    broken = spark.table("region").select(F.concat(F.lit("app/broken"), "r_regionkey", F.lit(".py")).alias("rel_path"), F.lit("def (:\n").cast("binary").alias("content"))
    return files.unionByName(broken)


def _parsed(spark, d) -> DataFrame:
    return parse.pieces(_sources(spark, d))


_PLACES = f"""WITH cls AS (SELECT n_nationkey AS k, {_CLASS.format(k='n_nationkey')} AS name, 'app/nation' || n_nationkey || '.py' AS file, n_regionkey AS r FROM nation),
met AS (SELECT c_custkey AS o, cls.k, cls.name AS owner, file, {_METHOD.format(k='c_custkey')} AS name, cls.name || '.' || {_METHOD.format(k='c_custkey')} AS id FROM customer JOIN cls ON cls.k = c_nationkey),
fun AS (SELECT s_suppkey AS o, 'load_' || s_suppkey AS name, file FROM supplier JOIN cls ON cls.k = s_nationkey), file AS (SELECT DISTINCT file FROM cls)"""
_EDGES = f"""SELECT file AS source, name AS target, 'contains' AS relationship, NULL::VARCHAR AS decorator_name FROM cls
UNION SELECT owner, id, 'contains', NULL FROM met UNION SELECT file, name, 'contains', NULL FROM fun
UNION SELECT file, m, 'imports', NULL FROM (SELECT file, unnest(['os', 'vendor.r' || r, CASE WHEN k > 0 THEN 'app.nation' || (k - 1) END]) AS m FROM cls) WHERE m IS NOT NULL
UNION SELECT a.name, b.name, 'inherits', NULL FROM cls a JOIN cls b ON b.k = a.k - 5
UNION SELECT a.id, b.id, 'overrides', NULL FROM met a JOIN met b ON b.k = a.k - 5 AND b.name = a.name
UNION SELECT met.id, cls.name, 'instantiates', NULL FROM met JOIN cls ON cls.k = met.o % 25 UNION SELECT fun.name, cls.name, 'instantiates', NULL FROM fun JOIN cls ON cls.k = fun.o % 25
UNION SELECT met.id, fun.name, 'calls', NULL FROM met JOIN fun ON fun.o = met.o % {_CALLS} UNION SELECT fun.name, b.name, 'calls', NULL FROM fun JOIN fun b ON b.o = fun.o % 10 + 1
UNION SELECT met.id, {_METHOD.format(k='(met.o + 1)')}, 'calls', NULL FROM met WHERE {_METHOD.format(k='(met.o + 1)')} IN (SELECT name FROM met)
UNION SELECT 'cached', id, 'decorates', 'cached' FROM met WHERE o % 7 = 0 UNION SELECT 'app.route', id, 'decorates', 'app.route' FROM met WHERE o % 11 = 0
UNION SELECT 'timed', name, 'decorates', 'timed' FROM fun WHERE o % 3 = 0 UNION SELECT 'register', name, 'decorates', 'register' FROM cls"""


def _built(spark, d) -> tuple[DataFrame, DataFrame]:
    return build.build_graph(_parsed(spark, d), ("app",))


@query("built_nodes", f"""{_PLACES} SELECT file AS id, 'File' AS type, split_part(file, '/', 2) AS label, file AS file_path, NULL::VARCHAR AS docstring, NULL::VARCHAR AS module_origin FROM file
UNION ALL SELECT m, 'Module', list_extract(string_split(m, '.'), -1), NULL, NULL, CASE WHEN m = 'os' THEN 'stdlib' WHEN starts_with(m, 'app.') THEN 'internal' ELSE 'third_party' END FROM (SELECT DISTINCT unnest(['os', 'vendor.r' || r, CASE WHEN k > 0 THEN 'app.nation' || (k - 1) END]) AS m FROM cls) WHERE m IS NOT NULL
UNION ALL SELECT name, 'Class', name, file, 'Nation ' || k || '.', NULL FROM cls UNION ALL SELECT id, 'Method', any_value(name), any_value(file), 'Line of ' || min(o) || '.', NULL FROM met GROUP BY id UNION ALL SELECT name, 'Function', name, file, NULL, NULL FROM fun""")
def _(spark, d):
    return _built(spark, d)[0].select("id", "type", "label", "file_path", "docstring", "module_origin")


@query("built_edges", f"{_PLACES} SELECT * FROM ({_EDGES})")
def _(spark, d):
    return _built(spark, d)[1]


for _rel in vocab.RELATIONSHIPS:

    @query(f"built_{_rel}", f"{_PLACES} SELECT source, target FROM ({_EDGES}) WHERE relationship = '{_rel}'")
    def _(spark, d, rel=_rel):
        return _built(spark, d)[1].filter(F.col("relationship") == rel).select("source", "target")


_BUILT = f"""{_PLACES}, edges AS MATERIALIZED ({_EDGES}), nodes AS (SELECT file AS id, 'File' AS type, split_part(file, '/', 2) AS label FROM file UNION ALL SELECT name, 'Class', name FROM cls UNION ALL SELECT DISTINCT id, 'Method', name FROM met UNION ALL SELECT name, 'Function', name FROM fun)"""


@query("built_drawing_nodes", f"{_BUILT}, {_drawing_sql('class')} {_DRAWN.replace('{base}', '800')}")
def _(spark, d):
    nodes, edges = _built(spark, d)
    return views.drawing(cut(nodes), cut(edges), "class")[0]


@query("built_class_view", f"{_BUILT}, {_drawing_sql('class')} SELECT source, target, relationship FROM kept")
def _(spark, d):
    nodes, edges = _built(spark, d)
    return views.view(cut(nodes), cut(edges), "class")[1].select("source", "target", "relationship")


@query("parsed_symbols", f"""{_PLACES} SELECT file AS file_path, 'Class' AS kind, NULL::VARCHAR AS owner, name, 'register' AS decorators, '' AS calls, CASE WHEN k >= 5 THEN {_CLASS.format(k='(k - 5)')} || ',BaseModel' ELSE 'BaseModel' END AS bases FROM cls
UNION ALL SELECT file, 'Method', owner, name, array_to_string(list_filter([CASE WHEN o % 7 = 0 THEN 'cached' END, CASE WHEN o % 11 = 0 THEN 'app.route' END], lambda x: x IS NOT NULL), ','),
 array_to_string(list_sort(list_distinct(list_filter(['load_' || o % {_CALLS}, {_CLASS.format(k='(o % 25)')}, {_METHOD.format(k='(o + 1)')}, CASE WHEN o % 11 = 0 THEN 'route' END], lambda x: x IS NOT NULL))), ','), CASE WHEN k >= 5 THEN {_CLASS.format(k='(k - 5)')} || ',BaseModel' ELSE 'BaseModel' END FROM met
UNION ALL SELECT file, 'Function', NULL, name, CASE WHEN o % 3 = 0 THEN 'timed' ELSE '' END, array_to_string(list_sort(list_distinct(list_filter(['load_' || (o % 10 + 1), {_CLASS.format(k='(o % 25)')}, {_METHOD.format(k='o')}, CASE WHEN o % 3 = 0 THEN 'timed' END], lambda x: x IS NOT NULL))), ','), '' FROM fun""")
def _(spark, d):
    s = parse.symbols(_parsed(spark, d))
    return s.select("file_path", "kind", "owner", "name", F.array_join("decorators.name", ",").alias("decorators"), F.array_join("calls", ",").alias("calls"), F.array_join("bases", ",").alias("bases"))


@query("parsed_files", f"""{_PLACES} SELECT cls.file AS file_path, array_to_string(list_sort(list_filter(['os', 'vendor.r' || r, CASE WHEN k > 0 THEN 'app.nation' || (k - 1) END], lambda x: x IS NOT NULL)), ',') AS imports, 1::BIGINT AS classes, (SELECT count(*) FROM met WHERE met.file = cls.file) AS methods, (SELECT count(*) FROM fun WHERE fun.file = cls.file) AS functions, false AS broken FROM cls
UNION ALL SELECT 'app/broken' || r_regionkey || '.py', '', 0, 0, 0, true FROM region""")
def _(spark, d):
    return parse.by_file(_parsed(spark, d)).withColumn("imports", F.array_join("imports", ","))


# -- blocks of text about nodes, counts, places


def _block_sql(seeds: str, kinds: dict) -> str:
    """Texts of blocks for seeds of one kind, by string aggregation."""
    around = _AROUND.replace(_SEEDS, seeds)
    listed = []
    for title, (out, rel, kind, first) in kinds.items():
        hit = f"out = {out} AND relationship = '{rel}' AND " + (f"type = '{kind}'" if kind else "type IS NOT NULL")
        value = f"min_by(other, place) FILTER ({hit})" if first else f"string_agg(other, ', ' ORDER BY place) FILTER ({hit.replace(' AND type IS NOT NULL', '') if title == 'Decorators' else hit})"
        listed.append(f"'{title}: ' || {value}")
    return f"""{G} {around}, typed AS (SELECT around.*, type FROM around LEFT JOIN nodes ON nodes.id = other), lists AS (SELECT id, concat_ws(chr(10), {', '.join(listed)}) AS t FROM typed GROUP BY id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id, out, relationship ORDER BY place) AS nth FROM around),
rel AS (SELECT id, string_agg('  --[' || relationship || ']--> ' || other, chr(10) ORDER BY relationship, nth) FILTER (out = 1) AS o, string_agg('  <--[' || relationship || ']-- ' || other, chr(10) ORDER BY relationship, nth) FILTER (out = 0) AS i FROM ranked WHERE nth <= 20 GROUP BY id),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY type, other) AS nth, count(*) OVER (PARTITION BY id) AS total FROM (SELECT DISTINCT id, other, type FROM typed WHERE type IS NOT NULL)),
listed AS (SELECT id, chr(10) || 'Neighbours (' || any_value(total) || ' total, showing ' || count(*) || '):' || chr(10) || string_agg('  [' || type || '] ' || other, chr(10) ORDER BY nth) AS t FROM near WHERE nth <= 20 GROUP BY id)
SELECT seeds.id, concat_ws(chr(10), '=== ' || upper(type) || ': ' || label || ' ===', 'ID: ' || seeds.id, 'File: ' || nullif(file_path, ''), CASE WHEN line_number > 0 THEN 'Line: ' || line_number END, 'Docstring: ' || nullif(docstring, ''), nullif(lists.t, ''),
 chr(10) || 'Outgoing relationships:' || chr(10) || o, chr(10) || 'Incoming relationships:' || chr(10) || i, listed.t) AS block
FROM seeds JOIN nodes ON nodes.id = seeds.id LEFT JOIN lists ON lists.id = seeds.id LEFT JOIN rel ON rel.id = seeds.id LEFT JOIN listed ON listed.id = seeds.id"""


_CLASS_LISTS = {
    "Defined in file": (0, "contains", "File", True), "Methods": (1, "contains", "Method", False), "Inherits from": (1, "inherits", None, False), "Subclassed by": (0, "inherits", None, False),
    "Instantiates": (1, "instantiates", None, False), "Instantiated by": (0, "instantiates", None, False), "Decorators": (0, "decorates", None, False),
}
_CALLABLE_LISTS = {"Owning class": (0, "contains", "Class", True), "Callers": (0, "calls", None, False), "Calls": (1, "calls", None, False), "Overrides": (1, "overrides", None, True), "Overridden by": (0, "overrides", None, False)}
_CALLABLES = "SELECT id FROM nodes WHERE type = 'Method' AND contains(label, 'token')"


@query("class_blocks", _block_sql(_SEEDS, _CLASS_LISTS))
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    return contexts.node_blocks(nodes, edges, _seeds(nodes)).select("id", "block")


@query("callable_blocks", _block_sql(_CALLABLES, _CALLABLE_LISTS))
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    return contexts.node_blocks(nodes, edges, views.label_search(nodes, "token", "Method").select("id")).select("id", "block")


@query("resolved_nodes", f"{G} {_AROUND} SELECT seeds.id, count(*) FILTER (out = 1) AS outgoing_count, count(*) FILTER (out = 0) AS incoming_count, coalesce(string_agg(DISTINCT other, ',' ORDER BY other) FILTER (other IN (SELECT id FROM nodes)), '') AS neighbour_ids FROM seeds LEFT JOIN around ON around.id = seeds.id GROUP BY seeds.id")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    rows = contexts.resolved_nodes(nodes, edges, _seeds(nodes))
    return rows.withColumn("neighbour_ids", F.array_join("neighbour_ids", ","))


@query("edges_of_type", f"{G} {_AROUND} SELECT id, CASE out WHEN 1 THEN 'outgoing' ELSE 'incoming' END AS direction, other FROM around WHERE relationship = 'inherits'")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    return contexts.edges_of_type(edges, _seeds(nodes), "inherits")


@query("unknown_id_sample", f"{G} SELECT DISTINCT id FROM nodes ORDER BY id LIMIT 10")
def _(spark, d):
    return contexts.unknown_sample(adapter.graph(spark, d)[0])


@query("numbered_edges", f"{G} SELECT *, row_number() OVER (ORDER BY source, target, relationship, coalesce(decorator_name, '')) AS pos FROM edges")
def _(spark, d):
    return build.numbered(adapter.graph(spark, d)[1])


@query("view_not_in_master", f"{G} SELECT source, target FROM edges WHERE false")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    kept = [views.view(nodes, edges, name)[1] for name in views.VIEWS]
    return kept[0].unionByName(kept[1]).unionByName(kept[2]).exceptAll(edges.select(*views.EDGE_ORDER)).select("source", "target")


@query("view_kinds", f"""{G} SELECT relationship, count(*) AS n_views FROM (SELECT DISTINCT v, relationship FROM (VALUES {', '.join(f"('{n}', '{r}')" for n, (_, rs) in views.VIEWS.items() for r in rs)}) t(v, r) JOIN edges ON relationship = r
JOIN nodes t2 ON t2.id = target LEFT JOIN nodes s2 ON s2.id = source WHERE {' OR '.join(f"(v = '{n}' AND t2.type IN ({quoted(ts)}) AND (relationship = 'decorates' OR s2.type IN ({quoted(ts)})))" for n, (ts, _) in views.VIEWS.items())}) GROUP BY relationship""")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    kinds = [views.view(nodes, edges, name)[1].select("relationship").distinct() for name in views.VIEWS]
    return kinds[0].unionAll(kinds[1]).unionAll(kinds[2]).groupBy("relationship").agg(F.count("*").alias("n_views"))


@query("fingerprint", f"""WITH f AS ({_FILES}), h AS (SELECT sha256('{{"rel_path":"' || rel_path || '","mtime":' || mtime::VARCHAR || ',"size":' || size || '}}') AS h FROM f)
SELECT count(*) AS file_count, {' || '.join(f"lpad(lower(to_hex(bit_xor(('0x' || substr(h, {15 * k + 1}, 15))::BIGINT))), 15, '0')" for k in range(4))} AS digest FROM h""")
def _(spark, d):
    return repo_files.fingerprint(_files(spark, d))


@query("rank_diagnostics", f"{_SCORES}, total AS (SELECT question_id, id, ({' + '.join(resolve.SIGNALS)})::DOUBLE AS score FROM sig) SELECT question_id::BIGINT AS question_id, rank, id, score, score AS explained FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM total) WHERE rank <= 3")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    ranked = resolve.rank(nodes, edges, adapter.questions(spark), 3)
    total = F.aggregate(F.map_values(resolve.diagnostics(F.col("reason"))), F.lit(0), lambda a, x: a + x)
    return ranked.select("question_id", "rank", "id", "score", total.cast("double").alias("explained"))


_HEADS = f"""WITH {_INTENT}, kws AS (SELECT question_id, string_agg(w, ', ' ORDER BY o) AS k FROM kw GROUP BY question_id), ints AS (SELECT question_id, string_agg(intent, ', ' ORDER BY rank) AS i FROM intents GROUP BY question_id)"""


@query("context_heads", f"{_HEADS} SELECT q.question_id::BIGINT AS question_id, concat_ws(chr(10), 'QUESTION', question, '', 'DETECTED INTENT', coalesce(i, 'unknown'), '', 'KEYWORDS', coalesce(k, '(none)'), '', '') AS head FROM q LEFT JOIN kws ON kws.question_id = q.question_id LEFT JOIN ints ON ints.question_id = q.question_id")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    packed = answer.packages(nodes, edges, adapter.questions(spark))
    return packed.select("question_id", F.substring_index("context", answer.RULE, 1).alias("head"))


@query("context_sources", f"{_SCORES}, total AS (SELECT question_id, id, type, ({' + '.join(resolve.SIGNALS)})::DOUBLE AS score FROM sig), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM total) WHERE rank <= 5) SELECT question_id::BIGINT AS question_id, best.id, best.type, label, score, file_path FROM best JOIN nodes ON nodes.id = best.id")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    packed = answer.packages(nodes, edges, adapter.questions(spark))
    return packed.select("question_id", F.explode("sources").alias("s")).select("question_id", "s.id", "s.type", "s.label", "s.score", "s.file_path")
