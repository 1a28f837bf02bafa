"""Questions generated from symbols by templates, scored, and balanced over categories and repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import category, nearly_same, question_keywords, uuid5, verb_noun
from .search import containing, matching
from .views import is_public

# Kind | condition | family | question. {n} noun, {v} verb, {l} label.
TEMPLATES = tuple(tuple(x.strip() for x in line.split("|")) for line in """
class | * | class_generic_work | How does the {n} work?
class | * | class_generic_purpose | What is the purpose of the {n}?
class | Retrieval | class_retrieval | How is retrieval performed using {l}?
class | Parsing | class_parsing | How is code parsed by the {l}?
verb | parse | verb_parse_plural | How are {n}s parsed?
verb | parse | verb_parse_implemented | How is {n} parsing implemented?
verb | extract | verb_extract_plural | How are {n}s extracted?
verb | extract | verb_extract_implemented | How is {n} extraction implemented?
verb | build construct | verb_build_constructed | How is the {n} constructed?
verb | build construct | verb_build_built | How is the {n} built?
verb | generate create | verb_generate_plural | How are {n}s generated?
verb | generate create | verb_generate_created | How is the {n} created?
verb | resolve | verb_resolve_plural | How are {n}s resolved?
verb | resolve | verb_resolve_work | How does {n} resolution work?
verb | get retrieve fetch collect | verb_retrieve_singular | How is a {n} retrieved?
verb | get retrieve fetch collect | verb_retrieve_plural_fetched | How are {n}s fetched?
verb | get retrieve fetch collect | verb_retrieve_plural_collected | How are {n}s collected?
verb | register add | verb_register_plural | How are {n}s registered?
verb | register add | verb_register_singular | How is a {n} registered?
verb | calculate compute | verb_compute_calculated | How are {n}s calculated?
verb | calculate compute | verb_compute_implemented | How is {n} computation implemented?
verb | visualize render plot | verb_visualize_plural | How are {n}s visualized?
verb | visualize render plot | verb_visualize_rendered | How is the {n} rendered?
verb | - | verb_noun_default | How is {n} {v}ed?
verb | - | verb_noun_process | How does the {v}_{n} process work?
noun | Parsing | noun_parsing | How is the parsing of {n} handled?
noun | Graph Construction | noun_graph_represented | How is {n} represented in the graph?
noun | Graph Construction | noun_graph_relationships | How are {n} relationships created?
noun | Retrieval | noun_retrieval | How is {n} retrieved?
noun | Routing | noun_routing | How are routes registered for {n}?
noun | CLI | noun_cli | How are {n} commands parsed?
noun | - | noun_generic_handled | How is {n} handled?
noun | - | noun_generic_implemented | How is {n} implemented?
""".strip().splitlines())  # fmt: skip

_NAMED = {"verb": tuple(v for k, c, *_ in TEMPLATES if k == "verb" for v in c.split() if c != "-"), "noun": tuple(c for k, c, *_ in TEMPLATES if k == "noun" and c != "-")}


def facts(nodes: DataFrame) -> DataFrame:
    """Public symbols with category, verb and noun."""
    verb, noun = verb_noun("label", "type")
    text = F.concat_ws(" ", "id", "label", F.coalesce("file_path", F.lit("")))
    return nodes.filter(is_public(nodes)).select("id", "type", "label", category(text).alias("category"), verb.alias("verb"), noun.alias("noun"))


def generated(symbols: DataFrame) -> DataFrame:
    """One row a candidate: id, label, category, template_family, question."""
    kind = F.when(F.col("type") == "Class", "class").when(F.col("verb").isNotNull() & (F.col("noun") != ""), "verb").otherwise("noun")
    noun = F.when(F.coalesce("noun", F.lit("")) == "", F.lower("label")).otherwise(F.col("noun"))
    made = []
    for k, when, family, text in TEMPLATES:
        key = F.col("verb") if k == "verb" else F.col("category")
        fits = kind == k
        if when == "-":
            fits &= ~key.isin(*_NAMED[k])
        elif when != "*":
            fits &= key.isin(*(when.split() if k == "verb" else [when]))
        filled = F.replace(F.replace(F.replace(F.lit(text), F.lit("{n}"), noun), F.lit("{v}"), F.coalesce("verb", F.lit(""))), F.lit("{l}"), F.col("label"))
        made.append(F.when(fits, F.struct(F.lit(family).alias("template_family"), F.trim(F.regexp_replace(filled, r"\s+", " ")).alias("question"))))
    rows = F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("c")
    return symbols.select("id", "label", "category", rows).select("id", "label", "category", "c.*")


def _last_name(symbols: DataFrame) -> DataFrame:
    return symbols.select("id", F.lower(F.element_at(F.split("label", r"\."), -1)).alias("name"))


def near_names(symbols: DataFrame) -> DataFrame:
    """(name, other): pairs of different names that are alike but for a plural ending or one edit.

    Such names have the same letters but for one gap or change, and so share one
    of their variants with a letter left out; candidates meet there by an
    equi-join, not a cross join.  Names with one variant in common are verified.
    """
    distinct = _last_name(symbols).select("name").distinct()
    n = F.length("name")
    left_out = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(F.col("name"), F.lit(1), i - 1), F.substring(F.col("name"), i + 1, n)))
    short = F.filter(F.array(F.when(F.col("name").endswith("es"), F.substring(F.col("name"), F.lit(1), n - 2)), F.col("name")), lambda x: x.isNotNull())
    keys = distinct.select("name", F.explode(F.array_distinct(F.concat(left_out, short))).alias("key"))
    other = keys.withColumnRenamed("name", "other")
    return keys.join(other, "key").filter((F.col("name") != F.col("other")) & nearly_same(F.col("name"), F.col("other"))).select("name", "other").distinct()


def near_identical(symbols: DataFrame) -> DataFrame:
    """(id, name, n_same, others): symbols whose name another symbol has as well (n_same of them) or nearly has (the names, sorted).

    Pairs are of names, with membership; ids of one name are counted, not paired.
    """
    names = _last_name(symbols)
    count = names.groupBy("name").agg((F.count("*") - 1).alias("n_same"))
    alike = near_names(symbols).groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("others"))  # as many as a name has one-letter variants in use
    return names.join(count, "name").join(alike, "name", "left").filter("n_same > 0 OR others IS NOT NULL").select("id", "name", "n_same", F.coalesce("others", F.lit("")).alias("others"))


def _twins(symbols: DataFrame) -> DataFrame:
    """(id, twin): of the symbols with an equal or nearly equal name, the least id other than its own."""
    names = _last_name(symbols)
    two = names.groupBy("name").agg(F.min("id").alias("first"))
    second = names.join(two.select("name", "first"), "name").filter("id <> first").groupBy("name").agg(F.min("id").alias("second"))
    near = near_names(symbols).join(two.select(F.col("name").alias("other"), F.col("first").alias("near")), "other").groupBy("name").agg(F.min("near").alias("near"))
    rows = names.join(two.select("name", "first"), "name").join(second, "name", "left").join(near, "name", "left")
    same = F.when(F.col("id") != F.col("first"), F.col("first")).otherwise(F.col("second"))
    return rows.withColumn("twin", F.least(same, "near")).filter("twin IS NOT NULL").select("id", "twin")


# Second words of a question that say little, and words that make it vague.
GENERIC_VERBS = ("build", "process", "handle", "execute", "run")
VAGUE = ("helper", "util", "temp", "tmp", "dummy")


def scored(candidates: DataFrame, symbols: DataFrame, importance: DataFrame) -> DataFrame:
    """``candidates`` plus quality_score and generation_reason: the first rule that rejects, or the score."""
    asked = candidates.withColumn("keywords", question_keywords("question"))
    verb = F.coalesce(F.get(F.split(F.lower("question"), r"\s+"), F.lit(1)), F.lit(""))
    asked = asked.withColumn("verb", F.when(verb.isin(*GENERIC_VERBS), verb)).withColumn("nouns", F.when(F.col("verb").isNotNull(), F.array_remove("keywords", F.col("verb"))))
    texts = symbols.select("id", F.lower(F.concat_ws(" ", "id", "label")).alias("text"))
    hits = matching(asked.select("keywords").distinct().filter(F.size("keywords") > 0), texts)
    nouns = asked.filter("nouns IS NOT NULL").select("nouns").distinct()
    ids = symbols.select("id", F.lower("id").alias("text"))
    met = containing(nouns.select(F.explode("nouns").alias("keyword")).distinct(), ids)
    among = nouns.select("nouns", F.explode("nouns").alias("keyword")).join(met, "keyword").groupBy("nouns").agg(F.count_distinct("id").alias("similar"))
    rows = asked.join(_twins(symbols), "id", "left").join(hits, "keywords", "left").join(among, "nouns", "left").join(importance, "id", "left").join(symbols.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    low = F.lower("question")
    words = F.size(F.filter(F.split("question", r"\s+"), lambda w: w != ""))
    vague = reduce(Column.__or__, [low.contains(w) for w in VAGUE])
    clarity = F.lit(1.0) - F.when(vague, 0.3).otherwise(0.0) - F.when((words < 4) | (words > 10), 0.2).otherwise(0.0)
    worth = F.coalesce("importance", F.lit(0.0))
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * worth + 0.4 * clarity)), 4)
    others = F.array_join(F.slice(F.array_remove("ids", F.col("id")), 1, 3), ", ")
    # The reasons, in the order of the rules.
    reason = (
        F.when(~(F.col("question").startswith("How ") | F.col("question").startswith("What ")), "Rejection: Question must start with 'How' or 'What'")
        .when(~F.col("question").endswith("?"), "Rejection: Question must end with '?'")
        .when(F.col("question").contains("  "), "Rejection: Question contains double spaces")
        .when(F.col("known").isNull(), F.concat(F.lit("Rejection: Expected node '"), "id", F.lit("' not found in public nodes")))
        .when(F.col("twin").isNotNull(), F.concat(F.lit("Rejection: Ambiguous symbol naming (nearly identical to "), "twin", F.lit(")")))
        .when(F.size("keywords") == 0, "Rejection: Question has no meaningful keywords")
        .when(F.coalesce("n", F.lit(0)) > 1, F.concat(F.lit("Rejection: Ambiguous wording (matches other public symbols: "), others, F.lit(")")))
        .when(F.coalesce("similar", F.lit(0)) > 1, F.concat(F.lit("Rejection: Uses generic verb '"), "verb", F.lit("' with ambiguous noun context")))
    )
    accepted = F.format_string("Accepted: Importance=%.2f, Clarity=%.2f", worth, clarity)
    return rows.withColumn("quality_score", F.when(reason.isNotNull(), 0.0).otherwise(score)).withColumn("generation_reason", F.coalesce(reason, accepted)).select(*candidates.columns, "quality_score", "generation_reason")


def balanced(candidates: DataFrame, total: int = 100) -> DataFrame:
    """An even share of questions for each category, repositories taking turns with their best."""
    good = candidates.filter("quality_score > 0")
    mine = F.row_number().over(W.partitionBy("category", "repository").orderBy(F.desc("quality_score"), F.desc("id"), F.desc("question")))
    turn = F.row_number().over(W.partitionBy("category").orderBy("turn", "repository"))
    kinds = good.agg(F.count_distinct("category").alias("kinds"))
    picked = good.withColumn("turn", mine).withColumn("place", turn).crossJoin(F.broadcast(kinds))  # kinds: one row
    return picked.filter(F.col("place") <= F.ceil(F.lit(total) / F.col("kinds"))).drop("kinds", "turn")


def identified(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("question_id", uuid5(F.concat_ws(":", "repository", "id", "question")))
