"""Scalar text functions as column expressions: they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(*items: str) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def stem(token: Column | str) -> Column:
    """The token without the first suffix that leaves three characters; null if none does."""
    token = _col(token)
    rules = [(token.endswith(s) & (F.length(token) - len(s) >= 3), F.substring(token, F.lit(1), F.length(token) - len(s))) for s in vocab.STEM_SUFFIXES]
    return reduce(lambda when, r: when.when(*r), rules[1:], F.when(*rules[0]))


def camel_words(text: Column | str) -> Column:
    """Lower-case words of a camel-case name; punctuation stays."""
    apart = F.regexp_replace(F.regexp_replace(_col(text), r"([a-z])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), r"\s+"), lambda w: w != "")


def snake_words(text: Column | str) -> Column:
    """Lower-case words between underscores; none without an underscore."""
    text = _col(text)
    return F.when(text.contains("_"), F.filter(F.split(F.lower(text), "_"), lambda w: w != "")).otherwise(words())


def name_words(label: Column | str) -> Column:
    """Words of a label's last dotted part: between underscores, or by case (digits go)."""
    last = F.element_at(F.split(_col(label), r"\."), -1)
    snake = F.filter(F.split(last, "_"), lambda w: w != "")
    return F.when(last.contains("_"), snake).otherwise(F.regexp_extract_all(last, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)"), F.lit(0)))


def no_punctuation(text: Column | str) -> Column:
    """Without ASCII punctuation, but for the underscore."""
    return F.regexp_replace(_col(text), r"[\p{Punct}&&[^_]]", "")


def question_keywords(question: Column | str) -> Column:
    bare = F.lower(F.regexp_replace(_col(question), r"(?U)[^\w\s]", ""))
    return F.filter(F.split(F.trim(F.regexp_replace(bare, r"\s+", " ")), " "), lambda w: (F.length(w) > 1) & ~w.isin(*vocab.QUESTION_STOP_WORDS))


def nearly_same(a: Column, b: Column) -> Column:
    """Equal but for case, a plural ending, or one edit."""
    a, b = F.lower(a), F.lower(b)
    plural = [F.concat(x, F.lit(e)) == y for x, y in ((a, b), (b, a)) for e in ("s", "es")]
    return reduce(Column.__or__, plural, a == b) | (F.levenshtein(a, b, 1) >= 0)


def extension(name: Column | str) -> Column:
    """Lower-case extension with its point; leading points don't begin one."""
    found = F.lower(F.regexp_extract(_col(name), r"^\.*[^.].*(\.[^.]*)$", 1))
    return F.when(found == "", "NO_EXTENSION").otherwise(found)


def language(ext: Column | str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for e, (lang,) in vocab.LANGUAGES.items() for x in (e, lang)]), _col(ext))


def file_category(ext: Column | str, rel_path: Column | str) -> Column:
    out = reduce(lambda when, c: when.when(_col(ext).isin(*c[1]), c[0]), list(vocab.FILE_CATEGORIES.items()), F.when(F.lit(False), ""))
    return out.when(F.lower(_col(rel_path)).contains("test"), "tests").otherwise("other")


def module_origin(module: Column | str, internal: tuple[str, ...], stdlib: tuple[str, ...]) -> Column:
    top = F.substring_index(_col(module), ".", 1)
    return F.when(top.isin(*stdlib), "stdlib").when(top.isin(*internal) if internal else F.lit(False), "internal").otherwise("third_party")


def verb_noun(label: Column | str, kind: Column | str) -> tuple[Column, Column]:
    """(verb, noun) of a symbol; the verb is null for classes and where the name starts with none."""
    parts = name_words(label)
    first = F.lower(F.get(parts, F.lit(0)))
    has = (_col(kind) != "Class") & first.isin(*vocab.SYMBOL_VERBS) & (F.size(parts) > 1)
    class_parts = F.regexp_extract_all(_col(label), F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)"), F.lit(0))
    rest = F.when(has, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).when(_col(kind) == "Class", class_parts).otherwise(parts)
    return F.when(has, first), F.lower(F.array_join(rest, " "))


def category(text: Column) -> Column:
    """The category with most fragments in the text, the first of equals; Utilities if none has any."""
    text = F.lower(text)
    hits = [F.struct(reduce(Column.__add__, [text.contains(w).cast("int") for w in ws]).alias("n"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, (c, ws) in enumerate(vocab.CATEGORY_WORDS.items())]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["c"]).otherwise("Utilities")


def uuid5(text: Column) -> Column:
    """Name-based UUID (SHA-1, DNS namespace) of a text."""
    space = "6ba7b8109dad11d180b400c04fd430c8"
    h = F.sha1(F.concat(F.unhex(F.lit(space)), text.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def judge_score(value: Column) -> Column:
    """A score as an integer from 1 to 5, rounded half to even; 1 where there is none."""
    number = F.bround(F.greatest(F.lit(-9.0), F.least(F.lit(9.0), value.try_cast("double"))), 0).cast("int")
    return F.when(value.try_cast("double").isNull(), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), number)))


def json_object(text: Column | str) -> Column:
    """The JSON object in a model's answer: as it is, inside a fence, or the longest braces; null if none parses."""
    text = F.trim(_col(text))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    inner = F.when(fenced != "", fenced).otherwise(text)
    braces = F.regexp_extract(inner, r"(?s)\{.*\}", 0)
    whole = F.try_parse_json(inner)
    is_object = F.schema_of_variant(whole).startswith("OBJECT")
    return F.when(whole.isNotNull() & is_object, inner).otherwise(F.when(F.try_parse_json(braces).isNotNull() & (braces != ""), braces))


def rate_limited(code: Column, status: Column, message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    # What providers say when they are asked too often.
    signs = ("429", "rate limit", "rate_limit", "quota", "resource_exhausted", "too many requests")
    said = reduce(Column.__or__, [text.contains(s) for s in signs])
    return F.coalesce(code == 429, F.lit(False)) | F.coalesce(F.lower(status).contains("resource_exhausted"), F.lit(False)) | said


def half_up(c: Column, digits: int) -> Column:
    """A double rounded to ``digits`` places as C's round() does it, ties of the scaled double away from zero; formats alone round its decimal digits, another number for some ties."""
    scale = F.lit(10.0**digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale
