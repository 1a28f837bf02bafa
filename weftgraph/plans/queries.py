"""Registered queries: each a Spark callable and the SQL another engine runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from ..operators import resolve, traverse, views
from . import adapter

G = adapter.WITH_GRAPH
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return register


def quoted(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


def values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


# -- graph tables and statistics


@query("graph_nodes", f"{G} SELECT * FROM nodes")
def _(spark, d):
    return adapter.graph(spark, d)[0]


@query("graph_edges", f"{G} SELECT * FROM edges")
def _(spark, d):
    return adapter.graph(spark, d)[1]


for _rel in vocab.RELATIONSHIPS:

    @query(f"edges_{_rel}", f"{G} SELECT source, target FROM edges WHERE relationship = '{_rel}'")
    def _(spark, d, rel=_rel):
        return adapter.graph(spark, d)[1].filter(F.col("relationship") == rel).select("source", "target")


@query("nodes_by_type", f"{G} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def _(spark, d):
    return views.counts_by(adapter.graph(spark, d)[0], "type", "n")


@query("edges_by_type", f"{G} SELECT relationship, count(*) AS n FROM edges GROUP BY relationship")
def _(spark, d):
    return views.counts_by(adapter.graph(spark, d)[1], "relationship", "n")


_PLACES = """, ends AS (
  SELECT source AS id, row(source, target, relationship, coalesce(decorator_name, ''), 0) AS place FROM edges
  UNION ALL SELECT target, row(source, target, relationship, coalesce(decorator_name, ''), 1) FROM edges),
degree AS (SELECT id, count(*) AS degree, min(place) AS place FROM ends GROUP BY id)"""


@query("degrees", f"{G} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id")
def _(spark, d):
    return views.degrees(adapter.graph(spark, d, keep=True)[1]).select("id", "degree")


@query("graph_top_degree_by_type", f"{G} {_PLACES} SELECT type, rank, id, degree FROM (SELECT type, nodes.id, degree, row_number() OVER (PARTITION BY type ORDER BY degree DESC, place) AS rank FROM degree JOIN nodes ON degree.id = nodes.id) WHERE rank <= 10")
def _(spark, d):
    return views.top_by_type(*adapter.graph(spark, d, keep=True))


@query("hotspots", f"{G} {_PLACES} SELECT rank, id, degree FROM (SELECT id, degree, row_number() OVER (ORDER BY degree DESC, place) AS rank FROM degree) WHERE rank <= 10")
def _(spark, d):
    return views.hotspots(adapter.graph(spark, d)[1])


for _name, (_types, _rels) in views.VIEWS.items():
    _e = f"""{G}, allowed AS (SELECT * FROM nodes WHERE type IN ({quoted(_types)})),
    kept AS (SELECT * FROM edges WHERE relationship IN ({quoted(_rels)}) AND target IN (SELECT id FROM allowed) AND (relationship = 'decorates' OR source IN (SELECT id FROM allowed)))"""

    @query(f"view_{_name}_edges", f"{_e} SELECT source, target, relationship, decorator_name FROM kept")
    def _(spark, d, name=_name):
        return views.view(*adapter.graph(spark, d, keep=True), name)[1]

    @query(f"view_{_name}_nodes", f"{_e} SELECT id, type, label FROM allowed WHERE id IN (SELECT source FROM kept UNION SELECT target FROM kept)")
    def _(spark, d, name=_name):
        return views.view(*adapter.graph(spark, d, keep=True), name)[0].select("id", "type", "label")


@query("import_graph", f"{G} SELECT source AS source_file, target AS imported_module FROM edges WHERE relationship = 'imports'")
def _(spark, d):
    return views.import_graph(adapter.graph(spark, d)[1])


@query("dangling_edges", f"{G} SELECT source, target, relationship, decorator_name FROM edges WHERE target NOT IN (SELECT id FROM nodes)")
def _(spark, d):
    return views.dangling(*adapter.graph(spark, d))


@query("label_search", f"{G} SELECT type, label, id FROM nodes WHERE contains(lower(label), 'router') AND type = 'Class'")
def _(spark, d):
    return views.label_search(adapter.graph(spark, d)[0], "Router", "Class").select("type", "label", "id")


_SEEDS = "SELECT id FROM nodes WHERE type = 'Class' AND contains(label, 'Router')"


def _seeds(nodes: DataFrame) -> DataFrame:
    return views.label_search(nodes, "Router", "Class").select("id")


_AROUND = f""", seeds AS ({_SEEDS}), around AS (
  SELECT source AS id, 1 AS out, target AS other, relationship, decorator_name, row(source, target, relationship, coalesce(decorator_name, ''), 0) AS place FROM edges WHERE source IN (SELECT id FROM seeds)
  UNION ALL SELECT target, 0, source, relationship, decorator_name, row(source, target, relationship, coalesce(decorator_name, ''), 0) FROM edges WHERE target IN (SELECT id FROM seeds))"""


@query("node_context", f"{G} {_AROUND} SELECT id, CASE out WHEN 1 THEN 'outgoing' ELSE 'incoming' END AS direction, relationship, count(*) AS n, string_agg(other, ',' ORDER BY place) AS others FROM around GROUP BY id, out, relationship")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    return views.node_context(nodes, edges, _seeds(nodes))


@query("neighbours", f"{G} {_AROUND} SELECT DISTINCT around.id, other, type FROM around JOIN nodes ON nodes.id = other")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    return views.neighbours(nodes, edges, _seeds(nodes))


def _context_sql(seeds: str, fields: dict, first: tuple) -> str:
    cols = []
    for name, (out, rel, types) in fields.items():
        hit = f"out = {out} AND relationship = '{rel}' AND " + (f"type = '{types}'" if types else "type IS NOT NULL")
        whole = f"coalesce(string_agg(other, ',' ORDER BY place) FILTER ({hit}), '')"
        cols.append(f"coalesce(min_by(other, place) FILTER ({hit}), '') AS {name}" if name in first else f"{whole} AS {name}")
    cols.append("coalesce(string_agg(other, ',' ORDER BY place) FILTER (out = 0 AND relationship = 'decorates'), '') AS decorators")
    around = _AROUND.replace(_SEEDS, seeds)
    return f"{G} {around} SELECT around.id, {', '.join(cols)} FROM around LEFT JOIN nodes ON nodes.id = other GROUP BY around.id"


@query("class_context", _context_sql(_SEEDS, views.CLASS_FIELDS, ("files",)))
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    return views.class_context(nodes, edges, _seeds(nodes))


_METHODS = "SELECT id FROM nodes WHERE type = 'Method' AND contains(label, 'parse_token')"


@query("callable_context", _context_sql(_METHODS, views.CALLABLE_FIELDS, ("owning_class", "overrides")))
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    return views.callable_context(nodes, edges, views.label_search(nodes, "parse_token", "Method").select("id"))


def _reach_sql(hops: int) -> str:
    return f"""{G}, both_ways AS (SELECT source AS id, target AS other FROM edges UNION ALL SELECT target, source FROM edges), h0 AS MATERIALIZED ({_SEEDS})""" + "".join(
        f", h{k} AS MATERIALIZED (SELECT id FROM h{k - 1} UNION SELECT id FROM nodes WHERE id IN (SELECT other FROM both_ways WHERE id IN (SELECT id FROM h{k - 1})))" for k in range(1, hops + 1)
    )


for _hops in (1, 2):

    @query(f"subgraph_{_hops}hop_nodes", f"{_reach_sql(_hops)} SELECT id, type FROM nodes WHERE id IN (SELECT id FROM h{_hops})")
    def _(spark, d, hops=_hops):
        nodes, edges = adapter.graph(spark, d, keep=True)
        return traverse.subgraph(nodes, edges, _seeds(nodes), hops)[0].select("id", "type")


@query("subgraph_1hop_edges", f"{_reach_sql(1)} SELECT source, target, relationship, decorator_name FROM edges WHERE source IN (SELECT id FROM h1) AND target IN (SELECT id FROM h1)")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    return traverse.subgraph(nodes, edges, _seeds(nodes), 1)[1]


@query("subgraph_summary", f"{_reach_sql(1)}, e1 AS (SELECT * FROM edges WHERE source IN (SELECT id FROM h1) AND target IN (SELECT id FROM h1)) SELECT (SELECT count(*) FROM h1) AS node_count, (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM nodes WHERE id IN (SELECT id FROM h1) GROUP BY type)) AS nodes_by_type, count(*) AS edge_count, string_agg(DISTINCT relationship, ',' ORDER BY relationship) AS edge_types FROM e1")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    return views.subgraph_summary(*traverse.subgraph(nodes, edges, _seeds(nodes), 1))


@query("intent_subgraph")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    return traverse.intent_reach(nodes, edges, _seeds(nodes).select(F.lit(0).alias("grp"), "id"), dict(zip(vocab.RELATIONSHIPS, vocab.HOPS["routing"], strict=True))).select("id")


_RANK_ROUNDS = """, ids AS (SELECT DISTINCT id FROM nodes), link AS (SELECT source, target, count(*) AS n FROM edges WHERE source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids) GROUP BY ALL),
outs AS (SELECT source AS id, sum(n) AS o FROM link GROUP BY source), base AS MATERIALIZED (SELECT ids.id, o FROM ids LEFT JOIN outs ON ids.id = outs.id), size AS (SELECT count(*)::DOUBLE AS c FROM ids),
r0 AS MATERIALIZED (SELECT id, o, 1.0::DOUBLE / c AS r FROM base, size)""" + "".join(
    f""", r{k} AS MATERIALIZED (SELECT base.id, base.o, 0.15::DOUBLE / c + 0.85::DOUBLE * (coalesce(got.g, 0) + (SELECT coalesce(sum(r), 0) FROM r{k - 1} WHERE o IS NULL) / c) AS r
FROM base CROSS JOIN size LEFT JOIN (SELECT target AS id, sum(n / o * r) AS g FROM link JOIN r{k - 1} ON source = r{k - 1}.id GROUP BY target) got ON got.id = base.id)"""
    for k in range(1, 31)
)
_METRICS = f"""{G} {_RANK_ROUNDS}, sums AS (SELECT id, count(*) AS degree, sum(o) AS out_degree, count(*) FILTER (o = 0 AND ref) AS reference_count FROM (
  SELECT source AS id, 1 AS o, relationship IN ({quoted(traverse.REFERENCES)}) AS ref FROM edges UNION ALL SELECT target, 0, relationship IN ({quoted(traverse.REFERENCES)}) FROM edges) GROUP BY id),
metrics AS (SELECT nodes.id, coalesce(degree, 0)::DOUBLE AS degree, coalesce(degree - out_degree, 0)::DOUBLE AS in_degree, coalesce(out_degree, 0)::DOUBLE AS out_degree, coalesce(reference_count, 0)::DOUBLE AS reference_count, r AS pagerank
FROM nodes LEFT JOIN sums ON sums.id = nodes.id LEFT JOIN r30 ON r30.id = nodes.id)"""


@query("pagerank", f"{G} {_RANK_ROUNDS} SELECT id, round(r * 1000, 6) AS pagerank FROM r30")
def _(spark, d):
    return traverse.pagerank(*adapter.graph(spark, d, keep=True)).select("id", F.round(F.col("pagerank") * 1000, 6).alias("pagerank"))


@query("importance_metrics", f"{_METRICS} SELECT id, degree, in_degree, out_degree, reference_count, round(pagerank * 1000, 6) AS pagerank FROM metrics")
def _(spark, d):
    return traverse.importance_metrics(*adapter.graph(spark, d, keep=True)).withColumn("pagerank", F.round(F.col("pagerank") * 1000, 6))


@query("importance_score", f"{_METRICS} SELECT id, round_even(0.3 * degree / max(degree) OVER () + 0.4 * reference_count / max(reference_count) OVER () + 0.3 * pagerank / max(pagerank) OVER (), 4) AS importance FROM metrics")
def _(spark, d):
    scores = traverse.importance_score(traverse.importance_metrics(*adapter.graph(spark, d, keep=True)))
    return scores.select("id", "importance")


@query("public_symbols", f"""{G} SELECT id FROM nodes WHERE type IN ('Class', 'Function', 'Method') AND NOT starts_with(label, '_') AND NOT contains(lower(coalesce(docstring, '')), 'deprecated')
AND NOT list_contains(string_split(lower(file_path), '/'), 'test') AND NOT starts_with(list_extract(string_split(lower(file_path), '/'), -1), 'test_') AND lower(label) NOT IN ({quoted(vocab.GENERIC_NAMES)})""")
def _(spark, d):
    nodes, _ = adapter.graph(spark, d)
    return nodes.filter(views.is_public(nodes)).select("id")


def _drawing_sql(name: str) -> str:
    types, rels = views.VIEWS[name]
    return f"""allowed AS (SELECT * FROM nodes WHERE type IN ({quoted(types)})), kept AS (SELECT * FROM edges WHERE relationship IN ({quoted(rels)}) AND target IN (SELECT id FROM allowed) AND (relationship = 'decorates' OR source IN (SELECT id FROM allowed))),
pairs AS (SELECT DISTINCT source, target FROM kept), drawn AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM pairs UNION ALL SELECT target FROM pairs) GROUP BY id)"""


_DRAWN = "SELECT drawn.id, coalesce(label, drawn.id) AS label, type, CASE type WHEN 'File' THEN '#4A90D9' WHEN 'Module' THEN '#7ED321' WHEN 'Class' THEN '#F5A623' WHEN 'Function' THEN '#9B59B6' WHEN 'Method' THEN '#E74C3C' ELSE '#95A5A6' END AS colour, {base} + 60 * degree AS size FROM drawn LEFT JOIN nodes ON nodes.id = drawn.id"
_DRAWN_EDGES = "SELECT source, target, relationship, CASE relationship WHEN 'imports' THEN '#7ED321' WHEN 'contains' THEN '#4A90D9' WHEN 'inherits' THEN '#E67E22' WHEN 'instantiates' THEN '#9B59B6' WHEN 'decorates' THEN '#1ABC9C' WHEN 'calls' THEN '#E74C3C' ELSE '#F39C12' END AS colour FROM kept"


@query("drawing_nodes", f"{G}, {_drawing_sql('call')} {_DRAWN.replace('{base}', '600')}")
def _(spark, d):
    return views.drawing(*adapter.graph(spark, d, keep=True), "call")[0]


@query("drawing_edges", f"{G}, {_drawing_sql('architecture')} {_DRAWN_EDGES}")
def _(spark, d):
    return views.drawing(*adapter.graph(spark, d, keep=True), "architecture")[1]


_PATH = "CASE length(id) % 6 WHEN 0 THEN 'app/tests/x.py' WHEN 1 THEN 'app/test_x.py' WHEN 2 THEN 'app/conftest.py' WHEN 3 THEN CAST(NULL AS STRING) WHEN 4 THEN 'app/contest.py' ELSE 'Test/x.py' END"


@query("test_symbols", f"{G} SELECT id, CASE length(id) % 6 WHEN 3 THEN contains(lower(id), 'test') WHEN 4 THEN false ELSE true END AS is_test FROM nodes")
def _(spark, d):
    nodes = adapter.graph(spark, d)[0].withColumn("file_path", F.expr(_PATH))
    return nodes.select("id", views.is_test(F.col("id"), F.col("file_path")).alias("is_test"))


# -- text


def _stem_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN suffix({x}, '{s}') AND length({x}) >= {len(s) + 3} THEN {x}[:length({x}) - {len(s)}]" for s in vocab.STEM_SUFFIXES) + " END"


_TOKENS = r"SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[ \t\n]+')) AS token FROM benchmark"


@query("stem_tokens", f"WITH t AS ({_TOKENS}) SELECT token, {_stem_sql('token')} AS stem FROM t")
def _(spark, d):
    tokens = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.split(F.lower("text"), r"[ \t\n]+")).alias("token")).distinct()
    return tokens.select("token", T.stem("token").alias("stem"))


_CAMEL = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '\s+'), lambda w: w <> '')"
_SNAKE = "CASE WHEN contains({x}, '_') THEN list_filter(string_split(lower({x}), '_'), lambda w: w <> '') ELSE [] END"


@query("label_words", f"{G} SELECT id, array_to_string({_CAMEL.format(x='label')}, ' ') AS camel, array_to_string({_SNAKE.format(x='label')}, ' ') AS snake FROM nodes")
def _(spark, d):
    return adapter.graph(spark, d)[0].select("id", F.array_join(T.camel_words("label"), " ").alias("camel"), F.array_join(T.snake_words("label"), " ").alias("snake"))


_VERBS = quoted(vocab.SYMBOL_VERBS)
_CLASSWORDS = r"regexp_extract_all(label, '[A-Z]?[a-z]+')"


@query("verb_noun", f"""{G}, w AS (SELECT id, type, label, list_filter(string_split(label, '_'), lambda x: x <> '') AS ws FROM nodes WHERE type IN ('Function', 'Method'))
SELECT id, CASE WHEN lower(ws[1]) IN ({_VERBS}) AND len(ws) > 1 THEN lower(ws[1]) END AS verb, lower(array_to_string(CASE WHEN lower(ws[1]) IN ({_VERBS}) AND len(ws) > 1 THEN ws[2:] ELSE ws END, ' ')) AS noun FROM w
UNION ALL SELECT id, NULL, lower(array_to_string({_CLASSWORDS}, ' ')) FROM nodes WHERE type = 'Class'""")
def _(spark, d):
    verb, noun = T.verb_noun("label", "type")
    return adapter.graph(spark, d)[0].filter(F.col("type").isin("Class", "Function", "Method")).select("id", verb.alias("verb"), noun.alias("noun"))


_CATEGORY = "CASE best.n WHEN 0 THEN 'Utilities' ELSE best.c END"
_CATEGORY_SQL = f"""{G}, t AS (SELECT id, lower(concat(id, ' ', label, ' ', coalesce(file_path, ''))) AS t FROM nodes WHERE type IN ('Class', 'Function', 'Method')), k(c, o, w) AS (VALUES {values((c, o, w) for o, (c, ws) in enumerate(vocab.CATEGORY_WORDS.items()) for w in ws)}),
h AS (SELECT id, c, o, count(*) AS n FROM t JOIN k ON contains(t, w) GROUP BY ALL), b AS (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY n DESC, o) AS r FROM h)"""


@query("category_infer", f"{_CATEGORY_SQL} SELECT t.id, coalesce(c, 'Utilities') AS category FROM t LEFT JOIN b ON b.id = t.id AND r = 1")
def _(spark, d):
    text = F.concat_ws(" ", "id", "label", F.coalesce("file_path", F.lit("")))
    return adapter.graph(spark, d)[0].filter(F.col("type").isin("Class", "Function", "Method")).select("id", T.category(text).alias("category"))


# -- questions

_Q = f"q AS ({adapter.QUESTIONS})"
_STOPS = quoted(vocab.STOP_WORDS)
_PUNCT = r"[!-/:-@\[-^`{-~]"
_KW = rf"""{_Q}, raw AS (SELECT question_id, question, unnest(list_filter(regexp_split_to_array(question, '\s+'), lambda w: w <> '')) AS raw, generate_subscripts(list_filter(regexp_split_to_array(question, '\s+'), lambda w: w <> ''), 1) AS i FROM q),
tok AS (SELECT *, regexp_replace(lower(raw), '{_PUNCT}', '', 'g') AS token, {_CAMEL.format(x='raw')} AS camel FROM raw),
c AS (
  SELECT question_id, i, 1 AS stage, unnest(camel) AS w, generate_subscripts(camel, 1) AS j, 0 AS m FROM tok WHERE len(camel) > 1
  UNION ALL SELECT question_id, i, 2, token, 0, 0 FROM tok WHERE token <> ''
  UNION ALL SELECT question_id, i, 3, {_stem_sql('token')}, 0, 0 FROM tok WHERE token <> '' AND token NOT IN ({_STOPS})
  UNION ALL SELECT question_id, i, 4, w, j, 0 FROM (SELECT question_id, i, unnest(string_split(token, '_')) AS w, generate_subscripts(string_split(token, '_'), 1) AS j FROM tok WHERE contains(token, '_'))
  UNION ALL SELECT question_id, i, 4, {_stem_sql('w')}, j, 1 FROM (SELECT question_id, i, unnest(string_split(token, '_')) AS w, generate_subscripts(string_split(token, '_'), 1) AS j FROM tok WHERE contains(token, '_'))),
kw AS (SELECT question_id, w, min(row(i, stage, j, m)) AS o FROM c WHERE w IS NOT NULL AND length(w) >= 2 AND w NOT IN ({_STOPS}) GROUP BY question_id, w)"""


@query("extract_keywords", f"WITH {_KW} SELECT q.question_id::BIGINT AS question_id, coalesce(string_agg(w, ' ' ORDER BY o), '') AS keywords FROM q LEFT JOIN kw ON kw.question_id = q.question_id GROUP BY q.question_id")
def _(spark, d):
    return adapter.questions(spark).select("question_id", F.array_join(resolve.keywords(F.col("question")), " ").alias("keywords"))


_PH = f"""ph(k, phrase, bonus) AS (VALUES {values((k, p, max(2, len(p.split()))) for k, (p, _, _) in enumerate(vocab.PHRASES))}), phi(k, intent) AS (VALUES {values((k, i) for k, (_, ints, _) in enumerate(vocab.PHRASES) for i in ints.split())}),
qp AS (SELECT question_id, k, bonus FROM q JOIN ph ON contains(replace(lower(question), '_', ' '), phrase) OR contains(lower(question), replace(phrase, ' ', '_')))"""
_INTENT = f"""{_KW}, {_PH}, lex(intent, o, w) AS (VALUES {values((i, o, w) for o, (i, ws) in enumerate(vocab.INTENT_WORDS.items()) for w in ws)}), decl AS (SELECT DISTINCT intent, o FROM lex),
tokens AS (SELECT question_id, w FROM kw UNION SELECT question_id, {_stem_sql('w')} FROM kw),
hit AS (SELECT question_id, intent, count(*) AS n FROM tokens JOIN lex ON lex.w = tokens.w GROUP BY ALL),
score AS (SELECT question_id, intent, sum(n) AS score, bool_or(l) AS lexical FROM (SELECT question_id, intent, n, true AS l FROM hit UNION ALL SELECT question_id, intent, bonus, false FROM qp JOIN phi ON phi.k = qp.k) GROUP BY ALL),
intents AS (SELECT question_id, score.intent, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, CASE WHEN lexical THEN o ELSE 100 + o END) AS rank FROM score JOIN decl ON decl.intent = score.intent)"""


@query("phrase_hits", f"WITH {_Q}, {_PH} SELECT question_id::BIGINT AS question_id, phrase FROM qp JOIN ph ON ph.k = qp.k")
def _(spark, d):
    table = F.create_map(*[F.lit(x) for k, (p, _, _) in enumerate(vocab.PHRASES) for x in (k, p)])
    return adapter.questions(spark).select("question_id", F.explode(resolve.phrases(F.col("question"))).alias("k")).select("question_id", F.element_at(table, F.col("k")).alias("phrase"))


@query("intent_rank", f"WITH {_INTENT} SELECT question_id::BIGINT AS question_id, rank::BIGINT AS rank, intent, score::BIGINT AS score FROM intents")
def _(spark, d):
    q = adapter.questions(spark)
    found = resolve.intent_scores(resolve.keywords(F.col("question")), resolve.phrases(F.col("question")))
    return q.select("question_id", F.posexplode(found).alias("rank", "s")).select("question_id", (F.col("rank") + 1).cast("long").alias("rank"), "s.intent", (-F.col("s.score")).cast("long").alias("score"))


_SYN = values(
    [(k, j, w) for k, ws in vocab.SYNONYMS.items() for j, w in enumerate(ws)] + [(k, 99, w) for s, (ks, ws) in resolve.SWITCHED.items() if resolve.TOGGLES[s] for k in ks for w in ws if w != k]
)
_EXPANDED = f"""{_KW}, syn(k, j, w) AS (VALUES {_SYN}),
more AS (SELECT question_id, syn.w FROM kw JOIN syn ON syn.k = kw.w UNION SELECT question_id, syn.w FROM kw JOIN syn ON syn.k = {_stem_sql('kw.w')}),
expanded AS (SELECT question_id, w, true AS base FROM kw UNION ALL SELECT question_id, w, false FROM more WHERE length(w) >= 2 AND w NOT IN ({_STOPS}) AND (question_id, w) NOT IN (SELECT (question_id, w) FROM kw))"""


@query("expand_keywords", f"WITH {_EXPANDED} SELECT question_id::BIGINT AS question_id, w AS keyword, base FROM expanded")
def _(spark, d):
    q = resolve.understood(adapter.questions(spark))
    return q.select("question_id", "keywords", F.explode("expanded").alias("keyword")).select("question_id", "keyword", F.array_contains("keywords", F.col("keyword")).alias("base"))


_HITS = f"""{G}, {_EXPANDED}, low AS (SELECT id, type, label, lower(label) AS l, lower(id) AS i, {_SNAKE.format(x='label')} AS snake FROM nodes),
hits AS (SELECT question_id, id, w, base, CASE WHEN l = w THEN 10 WHEN i = w THEN 8 ELSE (CASE WHEN contains(l, w) THEN 4 ELSE 0 END) + (CASE WHEN contains(i, w) THEN 2 ELSE 0 END) + (CASE WHEN list_contains(snake, w) THEN 3 ELSE 0 END) END AS points
FROM low JOIN expanded ON contains(l, w) OR contains(i, w) OR list_contains(snake, w))"""


@query("keyword_hits", f"{_HITS} SELECT question_id::BIGINT AS question_id, id, sum(points)::BIGINT AS points, count(*) FILTER (base) AS base_hits FROM hits GROUP BY question_id, id")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    rows = resolve.signals(nodes, edges, resolve.understood(adapter.questions(spark)))
    return rows.select("question_id", "id", F.col("keyword").alias("points"), F.size("base_hits").cast("long").alias("base_hits"))


_DATA_WORDS = " OR ".join(f"contains({{x}}, '{f}')" for f in vocab.DATA_DECORATORS)
_LAST = "list_extract(string_split(lower({x}), '.'), -1)"
_DATA = f"""marks AS (SELECT id, bool_or(rel = 'decorates' AND NOT o AND ({_DATA_WORDS.format(x=_LAST.format(x='name'))})) AS decorated, bool_or(rel = 'inherits' AND o AND ({_DATA_WORDS.format(x=_LAST.format(x='name'))})) AS derived,
  bool_or(rel IN ('calls', 'instantiates') OR rel = 'inherits' AND o) AS active FROM (SELECT source AS id, true AS o, relationship AS rel, target AS name FROM edges UNION ALL SELECT target, false, relationship, coalesce(decorator_name, source) FROM edges) GROUP BY id),
data AS (SELECT nodes.id, type IN ('Class', 'Function', 'Method') AND NOT ({' OR '.join(f"contains(replace(lower(label), '_', ''), '{f.replace('_', '')}')" for f in vocab.GRAPH_LABELS)})
  AND (type = 'Class' AND regexp_matches(lower(label), '{vocab.DATA_NAME}') OR coalesce(decorated, false) OR coalesce(derived, false) OR type = 'Class' AND NOT coalesce(active, false)) AS is_data FROM nodes LEFT JOIN marks ON marks.id = nodes.id)"""


@query("data_flags", f"{G}, {_DATA} SELECT id, is_data FROM data")
def _(spark, d):
    return resolve.data_holders(*adapter.graph(spark, d, keep=True)).select("id", "is_data")


_VALUES = f"verbs(intent, v) AS (VALUES {values((i, v) for i, vs in vocab.INTENT_VERBS.items() for v in vs if (i, v) != ('authentication', 'session'))}), forms(k, f) AS (VALUES {values((k, f.strip()) for k, (_, _, fs) in enumerate(vocab.PHRASES) for f in fs.split(','))})"
_ANY = "EXISTS (SELECT 1 FROM intents x WHERE x.question_id = s.question_id AND x.intent IN ({}))"
_SCORES = f"""{_HITS}, {_INTENT[_INTENT.index('ph(k'):]}, {_DATA}, {_VALUES}, deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id),
parts AS (SELECT DISTINCT id, unnest(list_concat(list_concat(snake, {_CAMEL.format(x='label')}), [l])) AS p FROM low),
av AS (SELECT DISTINCT question_id, v FROM intents JOIN verbs ON verbs.intent = intents.intent),
primary_intent AS (SELECT question_id, intent FROM intents WHERE rank = 1),
s AS (SELECT question_id, id, sum(points)::BIGINT AS keyword, count(*) FILTER (base) AS base_hits, count(*) FILTER (base AND (question_id, w) NOT IN (SELECT (question_id, v) FROM av)) AS subject FROM hits GROUP BY question_id, id),
cover AS (SELECT question_id, id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM kw WHERE kw.question_id = u.question_id AND (contains(kw.w, p) OR contains(p, kw.w)))) AS c FROM (SELECT question_id, s.id, unnest(snake) AS p FROM s JOIN low ON low.id = s.id) u WHERE length(p) >= 3 AND p NOT IN ({_STOPS}) GROUP BY ALL),
sig AS (SELECT s.question_id, s.id, low.type, keyword,
  CASE WHEN low.type IN ('Class', 'Function', 'Method') THEN 3 ELSE 0 END AS code_node,
  CASE WHEN low.type IN ('File', 'Module') AND NOT EXISTS (SELECT 1 FROM kw WHERE kw.question_id = s.question_id AND w IN ({quoted(vocab.FILE_WORDS)})) AND (p.intent IS NULL OR {_ANY.format(quoted(vocab.NOT_FILE_INTENTS))}) THEN -12 ELSE 0 END AS file_penalty,
  CASE WHEN coalesce(p.intent, 'unknown') <> 'visualization' AND EXISTS (SELECT 1 FROM parts WHERE parts.id = s.id AND p IN ({quoted(vocab.DRAWING_WORDS)})) THEN -4 ELSE 0 END AS drawing_penalty,
  CASE WHEN starts_with(low.label, '__') AND ends_with(low.label, '__') THEN -15 ELSE 0 END AS dunder_penalty,
  CASE WHEN starts_with(low.label, '_') AND NOT starts_with(low.label, '__') THEN -4 ELSE 0 END AS private_penalty,
  CASE WHEN p.intent IS NOT NULL AND low.type IN ('Class', 'Function', 'Method') THEN 6 ELSE 0 END AS intent_type,
  CASE WHEN low.type IN ('Function', 'Method') AND {_ANY.format(quoted((*vocab.IMPLEMENTATION_INTENTS, 'statistics', 'aggregation')))} THEN 5 ELSE 0 END AS callable,
  CASE WHEN low.type IN ('Class', 'Function', 'Method') AND subject > 0 AND EXISTS (SELECT 1 FROM parts JOIN av ON av.v = parts.p WHERE parts.id = s.id AND av.question_id = s.question_id) THEN 4 ELSE 0 END AS verb_label,
  7 * (SELECT count(DISTINCT qp.k) FROM qp JOIN forms ON forms.k = qp.k WHERE qp.question_id = s.question_id AND (contains(l, f) OR contains(i, f))) AS phrase,
  least(coalesce(degree, 0), 5) AS hotspot,
  CASE WHEN is_data AND {_ANY.format(quoted(vocab.IMPLEMENTATION_INTENTS))} THEN -15 ELSE 0 END AS data_penalty,
  CASE WHEN base_hits >= 2 THEN 5 ELSE 0 END AS multi_keyword, CASE WHEN p.intent IS NOT NULL AND subject > 0 THEN 4 ELSE 0 END AS subject_priority,
  CASE WHEN cover.c / cover.n >= 0.67 THEN 3 ELSE 0 END AS coverage, CASE WHEN base_hits = 0 THEN -4 ELSE 0 END AS generic_penalty
FROM s JOIN low ON low.id = s.id JOIN data ON data.id = s.id LEFT JOIN deg ON deg.id = s.id LEFT JOIN primary_intent p ON p.question_id = s.question_id LEFT JOIN cover ON cover.question_id = s.question_id AND cover.id = s.id)"""


@query("ranking_signals", f"{_SCORES} SELECT question_id::BIGINT AS question_id, id, type, {', '.join(f'{x}::BIGINT AS {x}' for x in resolve.SIGNALS)} FROM sig")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    return resolve.signals(nodes, edges, resolve.understood(adapter.questions(spark))).drop("hits", "base_hits")


@query("rank_topk", f"""{_SCORES}, total AS (SELECT question_id, id, type, ({' + '.join(resolve.SIGNALS)})::DOUBLE AS score FROM sig)
SELECT question_id::BIGINT AS question_id, rank, id, type, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM total) WHERE rank <= 10""")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    return resolve.rank(nodes, edges, adapter.questions(spark)).select("question_id", "rank", "id", "type", "score")


@query("ablation_topk")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    return resolve.ablation(nodes, edges, adapter.questions(spark), 5).select("config", "question_id", "rank", "id", "score")
