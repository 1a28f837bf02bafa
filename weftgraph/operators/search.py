"""Which texts contain which keywords, by equi-joins: no nested loop, nothing broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut


def _grams(c: Column) -> Column:
    """Three-letter pieces of a text; the text itself where it is shorter."""
    n = F.length(c)
    return F.when(n < 3, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))))


def containing(keywords: DataFrame, texts: DataFrame) -> DataFrame:
    """(keyword, id) of texts (id, text) that contain a keyword (keyword, distinct).

    A keyword meets texts at its rarest piece of three letters, by an equi-join,
    and is verified there; one of fewer letters meets them at pieces made of one
    or two letters.
    """
    short = F.length("keyword") < 3
    t = F.col("text")
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.substring(t, i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    held = texts.select("id", "text", F.explode(F.array_distinct(F.concat(_grams(t), pairs, every))).alias("gram"))
    asked = keywords.select("keyword", F.explode(F.when(short, F.array("keyword")).otherwise(_grams(F.col("keyword")))).alias("gram"))
    often = held.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("often"))
    rare = cut(asked.join(often, "gram", "left").groupBy("keyword").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)), "gram")).alias("gram")))  # where keywords are few, the planner sees it, and texts stay where they are
    return held.join(rare, "gram").filter(F.col("text").contains(F.col("keyword"))).select("keyword", "id").distinct()


def matching(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(keywords, n, ids): of texts (id, text) that contain all keywords of a set, how many there are and the three least ids.

    Each set meets texts at its rarest keyword; the others are tested there.
    """
    each = sets.select("keywords", F.explode("keywords").alias("keyword"))
    met = cut(containing(each.select("keyword").distinct(), texts))
    often = met.groupBy("keyword").agg(F.count("*").alias("often"))
    rare = each.join(often, "keyword", "left").groupBy("keywords").agg(F.min_by("keyword", F.struct(F.coalesce("often", F.lit(0)), "keyword")).alias("keyword"))
    hits = rare.join(met, "keyword").join(texts, "id").filter(F.forall("keywords", lambda k: F.col("text").contains(k)))
    nth = F.row_number().over(W.partitionBy("keywords").orderBy("id"))
    first = hits.withColumn("nth", nth).filter("nth <= 4").groupBy("keywords").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return hits.groupBy("keywords").agg(F.count("*").alias("n")).join(first, "keywords")
