"""Ranking graph nodes for natural-language questions, a batch of questions at a time.

A node is a candidate for a question only if one of the question's keywords is
in its label or id; such pairs are found by an equi-join (search.py), whatever
the number of questions.  Every signal is a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import camel_words, no_punctuation, snake_words, stem, words
from ..schemas import CODE_TYPES
from ..storage import cut
from .search import containing
from .views import degrees

#: Switches of single rules, as they are set by default.
TOGGLES = {
    "dto_fixes": False, "private_penalties": True, "dunder_penalties": True, "generate_build": False, "resolution_resolve": True, "retrieval_synonyms": True,
    "symbol_candidate": True, "file_module_penalty": True, "visualization_penalty": True, "verb_lexicon_cleanup": True,
}


def _keep(array: Column) -> Column:
    return F.array_distinct(F.filter(array, lambda w: (F.length(w) >= 2) & ~w.isin(*vocab.STOP_WORDS)))


def keywords(question: Column) -> Column:
    """Keywords in order: camel parts, the bare token, its stem, its snake parts and their stems."""

    def of(raw: Column) -> Column:
        token, camel = no_punctuation(F.lower(raw)), camel_words(raw)
        own = F.when(F.size(camel) > 1, camel).otherwise(words())
        plain = F.when(token != "", F.array(token, F.when(~token.isin(*vocab.STOP_WORDS), stem(token)))).otherwise(words())
        snake = F.when(token.contains("_"), F.flatten(F.transform(F.split(token, "_"), lambda p: F.array(p, stem(p))))).otherwise(words())
        return F.filter(F.concat(own, plain, snake), lambda w: w.isNotNull())

    return _keep(F.flatten(F.transform(F.filter(F.split(question, r"\s+"), lambda w: w != ""), of)))


def phrases(question: Column) -> Column:
    """Numbers of the phrases in a question."""
    low = F.lower(question)
    spaced = F.replace(low, F.lit("_"), F.lit(" "))
    hits = [F.when(spaced.contains(p) | low.contains(p.replace(" ", "_")), F.lit(k)) for k, (p, _, _) in enumerate(vocab.PHRASES)]
    return F.filter(F.array(*hits), lambda k: k.isNotNull())


def intent_scores(kws: Column, found: Column) -> Column:
    """Array of (score, order, intent) of the intents with a score, best first."""
    tokens = F.array_distinct(F.concat(kws, F.filter(F.transform(kws, stem), lambda s: s.isNotNull())))
    rows = []
    for order, (intent, lexicon) in enumerate(vocab.INTENT_WORDS.items()):
        hits = F.size(F.array_intersect(tokens, words(*lexicon)))
        bonus = [F.when(F.array_contains(found, k), max(2, len(p.split()))).otherwise(0) for k, (p, intents, _) in enumerate(vocab.PHRASES) if intent in intents.split()]
        first = F.when(hits > 0, order).otherwise(100 + order)  # by lexicon before by phrase
        rows.append(F.struct((-(hits + reduce(Column.__add__, bonus, F.lit(0)))).alias("score"), first.alias("order"), F.lit(intent).alias("intent")))
    return F.array_sort(F.filter(F.array(*rows), lambda r: r["score"] < 0))


#: Synonyms behind a switch: switch: (keywords, more synonyms)
SWITCHED = {
    "generate_build": (("generate", "generat"), ("build",)), "resolution_resolve": (("resolution", "resolu"), ("resolve",)),
    "retrieval_synonyms": (("retrieval", "retriever"), ("retriever", "retrieval", "retrieve")), "symbol_candidate": (("symbol", "symbols"), ("candidate",)),
}


def on(switch: str) -> Column:
    return F.col(f"on_{switch}")


def expanded(kws: Column) -> Column:
    """The keywords, then the synonyms of each and of its stem."""
    table = F.create_map(*[x for k, v in vocab.SYNONYMS.items() for x in (F.lit(k), words(*v))])

    def of(w: Column) -> Column:
        more = [F.when(on(s) & w.isin(*keys), F.array_remove(words(*ws), w)).otherwise(words()) for s, (keys, ws) in SWITCHED.items()]
        return F.concat(F.coalesce(table[w], words()), *more)

    with_stem = lambda w: F.concat(of(w), of(F.coalesce(stem(w), F.lit(""))))
    return F.array_distinct(F.concat(kws, _keep(F.flatten(F.transform(kws, with_stem)))))


def switched(questions: DataFrame, toggles: dict[str, bool] | None = None) -> DataFrame:
    """``questions`` plus a column for each switch, unless they have them."""
    t = toggles or TOGGLES
    return questions.withColumns({f"on_{k}": F.lit(v) for k, v in t.items() if f"on_{k}" not in questions.columns})


def understood(questions: DataFrame, toggles: dict[str, bool] | None = None) -> DataFrame:
    """``questions`` plus switches, keywords, phrases, intents (an array, best first), and expanded keywords."""
    questions = switched(questions, toggles)
    out = questions.withColumn("keywords", keywords(F.col("question"))).withColumn("phrases", phrases(F.col("question")))
    found = F.transform(intent_scores(F.col("keywords"), F.col("phrases")), lambda r: r["intent"])
    out = out.withColumn("intents", F.when(F.size(found) > 0, found).otherwise(words("unknown")))
    asks = F.arrays_overlap("intents", words(*vocab.IMPLEMENTATION_INTENTS))
    return out.withColumn("implementation", asks).withColumn("expanded", expanded(F.col("keywords")))


def data_holders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, is_data, of_data): code nodes that look like plain data, and methods of such classes."""
    last = F.lower(F.element_at(F.split("name", r"\."), -1))
    fragment = reduce(Column.__or__, [last.contains(f) for f in vocab.DATA_DECORATORS])
    rel, out = F.col("relationship"), F.col("out") == 1
    e = F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(1).alias("out"), F.col("target").alias("name")), F.struct(F.col("target").alias("id"), F.lit(0).alias("out"), F.coalesce("decorator_name", "source").alias("name")),
    ))
    ends = edges.filter("relationship IN ('decorates', 'inherits', 'calls', 'instantiates')").select(e.alias("e"), "relationship").select("e.*", "relationship")
    marks = ends.groupBy("id").agg(
        F.max(((rel == "decorates") & ~out & fragment).cast("int")).alias("decorated"),
        F.max(((rel == "inherits") & out & fragment).cast("int")).alias("derived"),
        F.max((rel.isin("calls", "instantiates") | (rel == "inherits") & out).cast("int")).alias("active"),
    )
    bare = F.lower(F.replace("label", F.lit("_"), F.lit("")))
    exempt = reduce(Column.__or__, [bare.contains(f) | F.lower("label").contains(f) for f in vocab.GRAPH_LABELS])
    is_class = F.col("type") == "Class"
    looks = (is_class & F.col("label").rlike(f"(?i){vocab.DATA_NAME}")) | (F.coalesce("decorated", F.lit(0)) == 1) | (F.coalesce("derived", F.lit(0)) == 1) | (is_class & (F.coalesce("active", F.lit(0)) == 0))
    own = nodes.select("id", "type", "label").join(marks, "id", "left").select("id", "type", (F.col("type").isin(*CODE_TYPES) & ~exempt & looks).alias("is_data"))
    inside = edges.filter("relationship = 'contains'").join(own.filter("is_data").select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
    return own.join(inside.withColumn("inside", F.lit(True)), "id", "left").select("id", "is_data", (F.coalesce("inside", F.lit(False)) & (F.col("type") == "Method")).alias("of_data"))


def _hit(kw: Column) -> Column:
    """What one keyword gives a node: (points, whether it hit)."""
    label, id_ = F.col("label_low"), F.col("id_low")
    partial = F.when(label.contains(kw), 4).otherwise(0) + F.when(id_.contains(kw), 2).otherwise(0) + F.when(F.array_contains("snake", kw), 3).otherwise(0)
    return F.when(label == kw, 10).when(id_ == kw, 8).otherwise(partial)


def signals(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """One row a candidate (question_id, id, type) with a column for each signal's points; ``asked`` comes from understood()."""
    facts = (
        nodes.select("id", "type", "label").join(degrees(edges).select("id", "degree"), "id", "left").join(data_holders(nodes, edges), "id", "left")
        .withColumn("label_low", F.lower("label")).withColumn("id_low", F.lower("id")).withColumn("snake", snake_words("label"))
        .withColumn("parts", F.array_distinct(F.concat("snake", camel_words("label"), F.array("label_low"))))
    )
    asked = cut(asked)  # long expressions over few rows: worked out once
    keys = [c for c in ("config", "question_id") if c in asked.columns]
    each = asked.select(*keys, F.explode("expanded").alias("keyword"))
    texts = facts.select("id", F.concat_ws("\n", "label_low", "id_low").alias("text"))
    pairs = each.join(containing(each.select("keyword").distinct(), texts), "keyword").select(*keys, "id").distinct()
    rows = pairs.join(asked, keys).join(facts, "id")
    hits = F.filter(F.transform("expanded", lambda k: F.struct(k.alias("k"), _hit(k).alias("p"))), lambda h: h["p"] > 0)
    rows = rows.withColumn("hits", hits).withColumn("base_hits", F.array_intersect(F.transform("hits", lambda h: h["k"]), "keywords"))
    intents, primary, kind = F.col("intents"), F.get("intents", F.lit(0)), F.col("type")
    has = lambda names: F.arrays_overlap(intents, words(*names))
    code, known = kind.isin(*CODE_TYPES), primary != "unknown"
    verbs = []
    for intent, vs in vocab.INTENT_VERBS.items():
        own = F.when(on("verb_lexicon_cleanup"), F.array_remove(words(*vs), "session")).otherwise(words(*vs)) if intent == "authentication" else words(*vs)
        verbs.append(F.when(F.array_contains(intents, intent), own).otherwise(words()))
    rows = rows.withColumn("verbs", F.array_distinct(F.concat(*verbs))).withColumn("subject", F.array_except("base_hits", "verbs"))
    label = F.col("label")
    dunder = label.startswith("__") & label.endswith("__")
    private = F.when(label.startswith("_") & ~label.startswith("__"), -4)
    inner = F.split("id", r"\.")
    inner = F.exists(F.slice(inner, F.lit(1), F.greatest(F.size(inner) - 1, F.lit(0))), lambda p: p.startswith("_") & ~p.startswith("__"))
    parts = F.filter("snake", lambda p: (F.length(p) >= 3) & ~p.isin(*vocab.STOP_WORDS))
    covered = F.size(F.filter(parts, lambda p: F.exists("keywords", lambda k: k.contains(p) | p.contains(k))))
    forms = [F.when(F.array_contains("phrases", k) & reduce(Column.__or__, [F.col("label_low").contains(f.strip()) | F.col("id_low").contains(f.strip()) for f in forms.split(",")]), 7).otherwise(0) for k, (_, _, forms) in enumerate(vocab.PHRASES)]
    files = kind.isin("File", "Module")
    made = {
        "keyword": F.aggregate("hits", F.lit(0), lambda a, h: a + h["p"]),
        "code_node": F.when(code, 3),
        "file_penalty": F.when(on("file_module_penalty"), F.when(files & ~F.arrays_overlap("keywords", words(*vocab.FILE_WORDS)) & has(vocab.NOT_FILE_INTENTS), -12)).when(files & F.col("implementation"), -8),
        "drawing_penalty": F.when(on("visualization_penalty") & (primary != "visualization") & F.arrays_overlap("parts", words(*vocab.DRAWING_WORDS)), -4),
        "dunder_penalty": F.when(on("dunder_penalties") & dunder, -15),
        "private_penalty": F.when(on("private_penalties"), F.coalesce(private, F.when(F.col("id").contains(".") & inner, -4))),
        "intent_type": F.when(known & code, 6),
        "callable": F.when(kind.isin("Method", "Function") & has((*vocab.IMPLEMENTATION_INTENTS, "statistics", "aggregation")), 5),
        "verb_label": F.when(code & (F.size("subject") > 0) & F.arrays_overlap("parts", "verbs"), 4),
        "phrase": reduce(Column.__add__, forms),
        "hotspot": F.least(F.coalesce("degree", F.lit(0)), F.lit(5)),
        "data_penalty": F.when(F.col("implementation") & (F.col("is_data") | on("dto_fixes") & F.col("of_data")), -15),
        "multi_keyword": F.when(F.size("base_hits") >= 2, 5),
        "subject_priority": F.when(known & (F.size("subject") > 0), 4),
        "coverage": F.when((F.size(parts) > 0) & (covered / F.size(parts) >= 0.67), 3),
        "generic_penalty": F.when(F.size("base_hits") == 0, -4),
    }
    config = ["config"] if "config" in asked.columns else []
    return rows.select(*config, "question_id", "id", "type", *[F.coalesce(c.cast("long"), F.lit(0)).cast("long").alias(n) for n, c in made.items()], "hits", "base_hits")


SIGNALS = (
    "keyword", "code_node", "file_penalty", "drawing_penalty", "dunder_penalty", "private_penalty", "intent_type", "callable", "verb_label", "phrase", "hotspot",
    "data_penalty", "multi_keyword", "subject_priority", "coverage", "generic_penalty",
)


def rank(nodes: DataFrame, edges: DataFrame, questions: DataFrame, k: int = 10, toggles: dict[str, bool] | None = None) -> DataFrame:
    """The k best nodes of each question (question_id, question): question_id, rank, id, type, score, reason."""
    scored = signals(nodes, edges, understood(questions, toggles))
    score = reduce(Column.__add__, [F.col(s) for s in SIGNALS]).cast("double")
    told = F.array_join(F.filter(F.array(*[F.when(F.col(s) != 0, F.format_string(f"{s} %+d", F.col(s))) for s in SIGNALS]), lambda x: x.isNotNull()), "; ")
    keys = [c for c in ("config", "question_id") if c in scored.columns]
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "id")).cast("long")
    ranked = scored.select(*keys, "id", "type", score.alias("score"), told.alias("reason")).withColumn("rank", best)
    return ranked.filter(F.col("rank") <= k)


def diagnostics(reason: Column) -> Column:
    """A reason's signals as a map of name to points."""
    return F.map_from_entries(F.transform(F.filter(F.split(reason, "; "), lambda x: x != ""), lambda x: F.struct(F.regexp_extract(x, r"^(.*) [-+]", 1), F.regexp_extract(x, r"([-+]\d+)$", 1).cast("int"))))


def ablation(nodes: DataFrame, edges: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """Ranks with all switches off, each alone on, and all on: config, then the columns of rank(). One pass over the nodes."""
    off = dict.fromkeys(TOGGLES, False)
    configs = {"baseline": off} | {name: off | {name: True} for name in TOGGLES} | {"all": dict.fromkeys(TOGGLES, True)}
    table = F.array(*[F.struct(F.lit(c).alias("config"), *[F.lit(v).alias(f"on_{n}") for n, v in t.items()]) for c, t in configs.items()])
    return rank(nodes, edges, questions.withColumn("c", F.explode(table)).select(*questions.columns, "c.*"), k)
