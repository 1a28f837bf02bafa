"""Registered queries on evaluation, question generation, answers and file listings."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from ..operators import answer, benchgen, evaluate, resolve, traverse
from ..sources import repo_files
from ..storage import cut
from . import adapter
from .queries import _CAMEL, _CATEGORY_SQL, _INTENT, _METRICS, _VERBS, G, query, quoted, values

# -- files: pages stand for files of a repository

_EXT = "CASE page_id % 12 WHEN 0 THEN '.py' WHEN 1 THEN '.MD' WHEN 2 THEN '.json' WHEN 3 THEN '.png' WHEN 4 THEN '' WHEN 5 THEN '.go' WHEN 6 THEN '.tar.gz' WHEN 7 THEN '.yml' WHEN 8 THEN '.txt' WHEN 9 THEN '.ts' WHEN 10 THEN '.html' ELSE '.svg' END"
_FILES = f"SELECT concat(CASE WHEN page_id % 10 = 0 THEN 'tests/' ELSE 'src/' END, 'f', CAST(page_id AS STRING), {_EXT}) AS rel_path, concat('f', CAST(page_id AS STRING), {_EXT}) AS name, CAST(length(html) AS BIGINT) AS size, CAST(page_id AS DOUBLE) AS mtime, false AS is_dir FROM pages"
_CLASSIFIED = f"""WITH f AS ({_FILES}), e AS (SELECT *, CASE WHEN regexp_extract(name, '^[.]*[^.].*([.][^.]*)$', 1) = '' THEN 'NO_EXTENSION' ELSE lower(regexp_extract(name, '^[.]*[^.].*([.][^.]*)$', 1)) END AS extension FROM f),
lang(x, l) AS (VALUES {values((e, lang) for e, (lang,) in vocab.LANGUAGES.items())}), c AS (SELECT e.*, l AS language, CASE {' '.join(f"WHEN extension IN ({quoted(xs)}) THEN '{k}'" for k, xs in vocab.FILE_CATEGORIES.items())} WHEN contains(lower(rel_path), 'test') THEN 'tests' ELSE 'other' END AS category FROM e LEFT JOIN lang ON x = extension)"""


def _files(spark, d) -> DataFrame:
    adapter.tables(spark, d, "pages")
    return spark.sql(_FILES)


for _c in ("extension", "language", "category"):

    @query(f"{_c}_distribution", f"{_CLASSIFIED} SELECT {_c}, count(*) AS n FROM c WHERE {_c} IS NOT NULL GROUP BY {_c}")
    def _(spark, d, c=_c):
        return repo_files.classified(_files(spark, d)).filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))


@query("scan_totals", f"WITH f AS ({_FILES}) SELECT count(*) AS files, sum(size)::BIGINT AS bytes FROM f")
def _(spark, d):
    return _files(spark, d).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("largest_files", f"WITH f AS ({_FILES}) SELECT rel_path, size FROM f ORDER BY size DESC, rel_path LIMIT 10")
def _(spark, d):
    return _files(spark, d).orderBy(F.desc("size"), "rel_path").limit(10).select("rel_path", "size")


@query("fingerprint_diff", f"WITH f AS ({_FILES}), n AS (SELECT rel_path, size + CASE WHEN mtime % 9 = 0 THEN 1 ELSE 0 END AS size FROM f WHERE mtime % 5 <> 0), o AS (SELECT rel_path, size FROM f WHERE mtime % 7 <> 0) SELECT coalesce(o.rel_path, n.rel_path) AS rel_path, CASE WHEN o.rel_path IS NULL THEN 'added' WHEN n.rel_path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.rel_path = n.rel_path WHERE o.rel_path IS NULL OR n.rel_path IS NULL OR o.size <> n.size")
def _(spark, d):
    f = _files(spark, d)
    new = f.filter("mtime % 5 <> 0").withColumn("size", F.col("size") + F.when(F.col("mtime") % 9 == 0, 1).otherwise(0))
    return repo_files.changed(f.filter("mtime % 7 <> 0"), new)


_MODULES = "SELECT DISTINCT concat(CASE p_partkey % 5 WHEN 0 THEN 'os' WHEN 1 THEN 'app' WHEN 2 THEN 'json' WHEN 3 THEN 'application' ELSE lower(replace(p_brand, '#', '_')) END, CASE p_partkey % 3 WHEN 0 THEN '' ELSE concat('.m', CAST(p_size AS STRING)) END) AS m FROM part"


@query("module_origin", f"SELECT m, CASE WHEN split_part(m, '.', 1) IN ({quoted(sorted(sys.stdlib_module_names))}) THEN 'stdlib' WHEN split_part(m, '.', 1) = 'app' THEN 'internal' ELSE 'third_party' END AS origin FROM ({_MODULES})")
def _(spark, d):
    adapter.tables(spark, d, "part")
    return spark.sql(_MODULES).select("m", T.module_origin("m", ("app",), tuple(sorted(sys.stdlib_module_names))).alias("origin"))


# -- retrieval metrics: events stand for retrieved items

_RUNS = "SELECT user_id, concat('r', CAST(user_id % 4 AS STRING)) AS repository, concat('i', CAST(event_id % 20 AS STRING)) AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events"
_EXPECTED = "SELECT DISTINCT user_id, concat('i', CAST(user_id % 20 AS STRING)) AS item FROM events UNION SELECT DISTINCT user_id, concat('i', CAST((user_id * 7 + 3) % 20 AS STRING)) FROM events"
_IR = f"""WITH run AS (SELECT * FROM ({_RUNS}) WHERE pos <= 10), want AS ({_EXPECTED}), hit AS (SELECT run.*, EXISTS (SELECT 1 FROM want WHERE want.user_id = run.user_id AND want.item = run.item) AS h FROM run),
m AS (SELECT hit.user_id, repository, min(pos) FILTER (h) AS first_hit_rank, coalesce(1.0::DOUBLE / min(pos) FILTER (h), 0) AS mrr, any_value(w.n) AS wanted,
{', '.join(f'(count(*) FILTER (h AND pos <= {n})) AS h{n}' for n in evaluate.CUTS)} FROM hit JOIN (SELECT user_id, count(*) AS n FROM want GROUP BY user_id) w ON w.user_id = hit.user_id GROUP BY hit.user_id, repository),
ir AS (SELECT user_id, repository, first_hit_rank, mrr, {', '.join(f'h{n} > 0 AS top_{n}, h{n} / wanted AS recall_{n}, h{n} / {n} AS precision_{n}' for n in evaluate.CUTS)} FROM m)"""


def _runs(spark, d) -> DataFrame:
    adapter.tables(spark, d, "events")
    got = spark.sql(_RUNS).filter("pos <= 10").groupBy("user_id", "repository").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("retrieved"))
    want = spark.sql(_EXPECTED).groupBy("user_id").agg(F.collect_set("item").alias("expected"))
    return evaluate.metrics(got.join(want, "user_id"))


_COLS = ", ".join(f"round({m}, 6) AS {m}" for m in evaluate.METRICS if not m.startswith("top"))


@query("ir_metrics", f"{_IR} SELECT user_id, repository, first_hit_rank, top_1, top_3, top_5, {_COLS} FROM ir")
def _(spark, d):
    m = _runs(spark, d)
    rounded = [F.round(c, 6).alias(c) for c in evaluate.METRICS if not c.startswith("top")]
    return m.select("user_id", "repository", F.col("first_hit_rank").cast("long").alias("first_hit_rank"), "top_1", "top_3", "top_5", *rounded)


_AVG = ", ".join(f"round_even(avg({m}::DOUBLE), 4) AS {m}" for m in (*[f"{x}_{n}" for n in evaluate.CUTS for x in ("recall", "precision")], "mrr")) + ", " + ", ".join(f"round_even(avg(top_{n}::INT), 4) AS top_{n}" for n in evaluate.CUTS)
_AVERAGES = f"{_IR}, a AS (SELECT CASE WHEN grouping(repository) = 1 THEN 'ALL' ELSE repository END AS repository, count(*) AS questions, {_AVG} FROM ir GROUP BY ROLLUP (repository))"


@query("ir_rollup", f"{_AVERAGES} SELECT * FROM a")
def _(spark, d):
    return evaluate.averages(_runs(spark, d))


@query("baseline_delta", f"{_AVERAGES} SELECT metric, value, baseline, round_even(value - baseline, 4) AS delta, CASE metric WHEN 'mrr' THEN printf('%.3f (%s%.3f)', round(value, 3), CASE WHEN value > baseline THEN '+' ELSE '' END, round(value - baseline, 3)) ELSE printf('%.1f%% (%s%.1f%%)', round(value * 100, 1), CASE WHEN value > baseline THEN '+' ELSE '' END, round((value - baseline) * 100, 1)) END AS text FROM (SELECT 'top_1' AS metric, top_1 AS value, 0.833::DOUBLE AS baseline FROM a WHERE repository = 'ALL' UNION ALL SELECT 'mrr', mrr, 0.879::DOUBLE FROM a WHERE repository = 'ALL')")
def _(spark, d):
    total = evaluate.averages(_runs(spark, d)).filter("repository = 'ALL'")
    return evaluate.against(total, {"top_1": 0.833, "mrr": 0.879})


# -- judge scores: made of labels, some fenced, some broken

_BODY = """concat('{"correctness": ', CAST(doc_id % 7 AS STRING), ', "groundedness": "', CAST(doc_id % 5 AS STRING), '.5", "completeness": ', CAST(quality * 5 AS STRING), ', "hallucination": ', CAST(5 - toxic AS STRING), ', "overall": ', CAST(3 + doc_id % 3 AS STRING), '}')"""
_JUDGE = f"SELECT doc_id AS question_id, concat('r', CAST(doc_id % 3 AS STRING)) AS repository, CASE doc_id % 6 WHEN 0 THEN {_BODY} WHEN 1 THEN concat('```json\n', {_BODY}, '\n```') WHEN 2 THEN concat('Here: ', {_BODY}, ' as asked') WHEN 3 THEN 'no verdict' WHEN 4 THEN {_BODY} ELSE '{{\"overall\": ' END AS judge_text FROM labels".replace("{{", "{")
_CLAMP = "greatest(1, least(5, round_even({x}, 0)::INT))"
_JUDGED = f"""WITH j AS (SELECT *, doc_id, quality, toxic FROM ({_JUDGE}) x JOIN labels ON doc_id = question_id), s AS (SELECT question_id, repository, doc_id % 6 IN (3, 5) AS bad,
{_CLAMP.format(x='(doc_id % 7)::DOUBLE')} AS c, {_CLAMP.format(x='(doc_id % 5) + 0.5::DOUBLE')} AS g, {_CLAMP.format(x='(quality * 5)::DOUBLE')} AS k, {_CLAMP.format(x='(5 - toxic)::DOUBLE')} AS h, {_CLAMP.format(x='(3 + doc_id % 3)::DOUBLE')} AS o FROM j),
scores AS (SELECT question_id, repository, bad, CASE WHEN bad THEN 1 ELSE c END AS correctness, CASE WHEN bad THEN 1 ELSE g END AS groundedness, CASE WHEN bad THEN 1 ELSE k END AS completeness, CASE WHEN bad THEN 1 ELSE h END AS hallucination, CASE WHEN bad THEN 1 ELSE o END AS overall, NOT bad AND o >= 4 AND h >= 4 AS passed FROM s)"""


def _judged(spark, d) -> DataFrame:
    adapter.tables(spark, d, "labels")
    return evaluate.judged(spark.sql(_JUDGE))


@query("judge_parse", f"{_JUDGED} SELECT question_id, repository, correctness, groundedness, completeness, hallucination, overall, passed FROM scores")
def _(spark, d):
    return _judged(spark, d).select("question_id", "repository", *evaluate.SCORES, "passed")


@query("judge_summary", f"{_JUDGED} SELECT CASE WHEN grouping(repository) = 1 THEN 'ALL' ELSE repository END AS repository, count(*) AS total, {', '.join(f'round_even(avg({s}), 2) AS {s}' for s in evaluate.SCORES)}, count(*) FILTER (passed) AS passes, round_even(count(*) FILTER (passed) / count(*), 4) AS pass_rate FROM scores GROUP BY ROLLUP (repository)")
def _(spark, d):
    return evaluate.judge_summary(_judged(spark, d))


@query("best_answers", f"{_JUDGED} SELECT question_id, overall FROM scores WHERE NOT bad ORDER BY overall DESC, question_id LIMIT 5")
def _(spark, d):
    return evaluate.extremes(_judged(spark, d))[0].select("question_id", "overall")


_MESSAGES = "SELECT doc_id, concat(CASE doc_id % 7 WHEN 0 THEN 'Too Many Requests' WHEN 1 THEN 'daily Quota' WHEN 2 THEN 'RATE_LIMIT hit' WHEN 3 THEN 'rate limited' WHEN 4 THEN 'timeout' WHEN 5 THEN 'RESOURCE_EXHAUSTED' ELSE '' END, ' ', CAST(420 + doc_id % 20 AS STRING)) AS message, CAST(CASE WHEN doc_id % 11 = 0 THEN 429 ELSE 500 END AS INT) AS code FROM labels"


@query("rate_limit_flag", f"SELECT doc_id, code = 429 OR len(list_filter(['429', 'rate limit', 'rate_limit', 'quota', 'resource_exhausted', 'too many requests'], lambda s: contains(lower(message), s))) > 0 AS limited FROM ({_MESSAGES})")
def _(spark, d):
    adapter.tables(spark, d, "labels")
    return spark.sql(_MESSAGES).select("doc_id", T.rate_limited(F.col("code"), F.lit(None).cast("string"), F.col("message")).alias("limited"))


# -- question generation

_FACTS = f"""{_CATEGORY_SQL}, pub AS (SELECT * FROM nodes WHERE type IN ('Class', 'Function', 'Method') AND NOT starts_with(label, '_') AND NOT contains(lower(coalesce(docstring, '')), 'deprecated')),
ws AS (SELECT id, type, label, CASE WHEN type = 'Class' THEN regexp_extract_all(label, '[A-Z]?[a-z]+') ELSE list_filter(string_split(label, '_'), lambda x: x <> '') END AS ws FROM pub),
vn AS (SELECT *, CASE WHEN type <> 'Class' AND lower(ws[1]) IN ({_VERBS}) AND len(ws) > 1 THEN lower(ws[1]) END AS verb FROM ws),
facts AS (SELECT vn.id, type, label, verb, lower(array_to_string(CASE WHEN verb IS NOT NULL THEN ws[2:] ELSE ws END, ' ')) AS noun, coalesce(c, 'Utilities') AS category, CASE WHEN type = 'Class' THEN 'class' WHEN verb IS NOT NULL THEN 'verb' ELSE 'noun' END AS kind FROM vn LEFT JOIN b ON b.id = vn.id AND r = 1)"""
_TPL = values((k, c2, f, t) for k, c, f, t in benchgen.TEMPLATES for c2 in (c.split() if k == "verb" else [c]))
_GENERATED = f"""{_FACTS}, tpl(kind, cond, family, t) AS (VALUES {_TPL}),
gen AS (SELECT id, label, category, family AS template_family, replace(replace(replace(t, '{{n}}', noun), '{{v}}', coalesce(verb, '')), '{{l}}', label) AS question FROM facts JOIN tpl ON tpl.kind = facts.kind AND
 (cond = '*' OR cond = CASE facts.kind WHEN 'verb' THEN verb ELSE category END OR cond = '-' AND CASE facts.kind WHEN 'verb' THEN verb NOT IN ({quoted(benchgen._NAMED['verb'])}) ELSE category NOT IN ({quoted(benchgen._NAMED['noun'])}) END))"""


@query("question_templates", f"{_GENERATED} SELECT * FROM gen")
def _(spark, d):
    return benchgen.generated(benchgen.facts(adapter.graph(spark, d)[0]))


_NEAR = """f AS (SELECT id, lower(label) AS n FROM facts), dn AS (SELECT n, count(*) - 1 AS n_same FROM f GROUP BY n),
near AS MATERIALIZED (SELECT a.n, b.n AS other FROM dn a JOIN dn b ON a.n <> b.n AND (levenshtein(a.n, b.n) <= 1 OR a.n || 'es' = b.n OR b.n || 'es' = a.n))"""


@query("near_identical", f"{_FACTS}, {_NEAR}, alike AS (SELECT n, string_agg(other, ',' ORDER BY other) AS others FROM near GROUP BY n) SELECT id, f.n AS name, n_same, coalesce(others, '') AS others FROM f JOIN dn ON dn.n = f.n LEFT JOIN alike ON alike.n = f.n WHERE n_same > 0 OR others IS NOT NULL")
def _(spark, d):
    return benchgen.near_identical(cut(benchgen.facts(adapter.graph(spark, d)[0])))


_UUID5 = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
_SHA1 = r"sha1('\x6B\xA7\xB8\x10\x9D\xAD\x11\xD1\x80\xB4\x00\xC0\x4F\xD4\x30\xC8'::BLOB || encode({x}))"


@query("question_uuid5", f"{_GENERATED} SELECT id, question, {_UUID5} AS question_id FROM (SELECT *, {_SHA1.replace('{x}', "'adapter:' || id || ':' || question")} AS h FROM gen)")
def _(spark, d):
    return benchgen.identified(benchgen.generated(benchgen.facts(adapter.graph(spark, d)[0])).withColumn("repository", F.lit("adapter"))).select("id", "question", "question_id")


# generated questions, and for every fifth length of an id such as each rule of the cascade rejects
_VARIED = """SELECT id, question FROM gen UNION ALL SELECT id, concat('Why is ', label, ' here?') FROM gen WHERE length(id) % 5 = 0 UNION ALL SELECT id, concat('How is ', label, ' made') FROM gen WHERE length(id) % 5 = 0
UNION ALL SELECT id, concat('What  is ', label, '?') FROM gen WHERE length(id) % 5 = 0 UNION ALL SELECT concat('no.', id), concat('What is ', label, '?') FROM gen WHERE length(id) % 5 = 0
UNION ALL SELECT id, concat('What build ', label, '?') FROM gen WHERE length(id) % 5 = 0 UNION ALL SELECT id, concat('How run a node_', right(label, 1), ' dummy util?') FROM gen WHERE length(id) % 5 = 0 UNION ALL SELECT id, 'What is it?' FROM gen WHERE length(id) % 5 = 0"""
_QUALITY = rf"""{_GENERATED}, {_METRICS[len(G) + 2:]}, imp AS (SELECT id, round_even(0.3 * degree / max(degree) OVER () + 0.4 * reference_count / max(reference_count) OVER () + 0.3 * pagerank / max(pagerank) OVER (), 4) AS importance FROM metrics), {_NEAR},
first AS (SELECT n, min(id) AS first FROM f GROUP BY n), second AS (SELECT f.n, min(id) AS second FROM f JOIN first ON first.n = f.n AND id <> first GROUP BY f.n), nearest AS (SELECT near.n, min(first) AS near FROM near JOIN first ON first.n = other GROUP BY near.n),
twin AS (SELECT id, least(CASE WHEN id <> first THEN first ELSE second END, near) AS twin FROM f JOIN first ON first.n = f.n LEFT JOIN second ON second.n = f.n LEFT JOIN nearest ON nearest.n = f.n),
asked AS (SELECT DISTINCT id, question FROM ({_VARIED})), words AS (SELECT *, list_filter(regexp_split_to_array(trim(lower(regexp_replace(question, '[^\w\s]', '', 'g'))), '\s+'), lambda w: length(w) > 1 AND w NOT IN ({quoted(vocab.QUESTION_STOP_WORDS)})) AS kw,
 lower(regexp_split_to_array(question, '\s+')[2]) AS v, len(list_filter(regexp_split_to_array(question, '\s+'), lambda w: w <> '')) AS n_words FROM asked),
texts AS (SELECT id, lower(id || ' ' || label) AS t, lower(id) AS i FROM facts), sets AS (SELECT DISTINCT kw FROM words WHERE len(kw) > 0),
hits AS (SELECT kw, count(*) AS n, list_sort(list(id))[:4] AS ids FROM sets JOIN texts ON len(list_filter(kw, lambda w: NOT contains(t, w))) = 0 GROUP BY kw),
nouns AS (SELECT DISTINCT list_filter(kw, lambda w: w <> v) AS ns FROM words WHERE v IN ({quoted(benchgen.GENERIC_VERBS)})), among AS (SELECT ns, count(*) AS n_alike FROM nouns JOIN texts ON len(list_filter(ns, lambda w: contains(i, w))) > 0 GROUP BY ns),
judged AS (SELECT words.id, question, CASE WHEN NOT (starts_with(question, 'How ') OR starts_with(question, 'What ')) THEN 'Rejection: Question must start with ''How'' or ''What''' WHEN NOT ends_with(question, '?') THEN 'Rejection: Question must end with ''?''' WHEN contains(question, '  ') THEN 'Rejection: Question contains double spaces'
 WHEN facts.id IS NULL THEN 'Rejection: Expected node ''' || words.id || ''' not found in public nodes' WHEN twin IS NOT NULL THEN 'Rejection: Ambiguous symbol naming (nearly identical to ' || twin || ')' WHEN len(words.kw) = 0 THEN 'Rejection: Question has no meaningful keywords'
 WHEN hits.n > 1 THEN 'Rejection: Ambiguous wording (matches other public symbols: ' || array_to_string(list_filter(ids, lambda x: x <> words.id)[:3], ', ') || ')' WHEN n_alike > 1 THEN 'Rejection: Uses generic verb ''' || v || ''' with ambiguous noun context' END AS reason,
 greatest(0.0, least(1.0, 0.6 * coalesce(importance, 0.0) + 0.4 * (1.0 - CASE WHEN {' OR '.join(f"contains(lower(question), '{w}')" for w in benchgen.VAGUE)} THEN 0.3 ELSE 0.0 END - CASE WHEN n_words < 4 OR n_words > 10 THEN 0.2 ELSE 0.0 END))) AS worth
 FROM words LEFT JOIN facts ON facts.id = words.id LEFT JOIN twin ON twin.id = words.id LEFT JOIN hits ON hits.kw = words.kw LEFT JOIN among ON v IN ({quoted(benchgen.GENERIC_VERBS)}) AND ns = list_filter(words.kw, lambda w: w <> v) LEFT JOIN imp ON imp.id = words.id)"""


@query("question_quality", f"{_QUALITY} SELECT id, question, CASE WHEN reason IS NULL THEN round_even(worth::DOUBLE, 4) ELSE 0.0::DOUBLE END AS quality_score, coalesce(reason, 'Accepted') AS generation_reason FROM judged")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    facts = cut(benchgen.facts(nodes))
    benchgen.generated(facts).createOrReplaceTempView("gen")
    asked = spark.sql(_VARIED).distinct()
    rows = benchgen.scored(asked, facts, traverse.importance_score(traverse.importance_metrics(nodes, edges)))
    reason = F.when(F.col("generation_reason").startswith("Accepted"), "Accepted").otherwise(F.col("generation_reason"))
    return rows.select("id", "question", "quality_score", reason.alias("generation_reason"))


@query("balanced_selection", f"{_GENERATED}, good AS (SELECT id, question, category, 'r' || (length(id) % 3)::INT AS repository, (length(question) % 10 / 10.0)::DOUBLE AS q FROM gen WHERE length(question) % 10 > 0), tt AS (SELECT *, row_number() OVER (PARTITION BY category, repository ORDER BY q DESC, id DESC, question DESC) AS turn FROM good), p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY turn, repository) AS place FROM tt) SELECT id, question, category, repository, place FROM p WHERE place <= ceil(100 / (SELECT count(DISTINCT category) FROM good))")
def _(spark, d):
    g = benchgen.generated(benchgen.facts(adapter.graph(spark, d)[0]))
    g = g.withColumn("repository", F.concat(F.lit("r"), (F.length("id") % 3).cast("string"))).withColumn("quality_score", F.length("question") % 10 / F.lit(10.0))
    return benchgen.balanced(g).select("id", "question", "category", "repository", F.col("place").cast("long").alias("place"))


# -- answers

_POLICY = f"""{_INTENT}, hops(policy, {', '.join('hops_' + r for r in vocab.RELATIONSHIPS)}) AS (VALUES {values((n, *h) for n, h in vocab.HOPS.items())}),
named AS (SELECT q.question_id, coalesce(hops.policy, 'default') AS policy, coalesce(rank, 0) AS rank FROM q LEFT JOIN intents ON intents.question_id = q.question_id LEFT JOIN hops ON hops.policy = intent)"""


@query("policy_merge", f"WITH {_POLICY} SELECT question_id::BIGINT AS question_id, CASE WHEN count(*) = 1 THEN any_value(named.policy) ELSE 'merged(' || string_agg(named.policy, '+' ORDER BY rank) || ')' END AS policy, {', '.join(f'max(hops_{r})::BIGINT AS hops_{r}' for r in vocab.RELATIONSHIPS)} FROM named JOIN hops ON hops.policy = named.policy GROUP BY question_id")
def _(spark, d):
    p = answer.policies(resolve.understood(adapter.questions(spark)))
    return p.select("question_id", "policy", *[F.col(f"hops_{r}").cast("long").alias(f"hops_{r}") for r in vocab.RELATIONSHIPS])


@query("context_packages")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    return answer.packages(nodes, edges, adapter.questions(spark)).select("question_id", "policy", "resolved", "node_count", "edge_count", "context")


@query("echo_answers")
def _(spark, d):
    nodes, edges = adapter.graph(spark, d, keep=True)
    return answer.answered(answer.prompts(answer.packages(nodes, edges, adapter.questions(spark)))).select("question_id", "status", "answer")
