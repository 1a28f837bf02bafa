"""Operator 8: mix sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source has the same expected number of copies, its source's
target over its source's size.  The documents of a source are laid on a line in
the order (size, salt, doc_id), the salt being a hash of the id; document i ends at i times that rate, one offset
is added for the source, and a document is emitted once for each integer it
crosses.  Ordering by size makes the sample stratified, so that the words taken
stay within about one document of the target.

The rank on that line is made of three parts, none of which gathers a source in
one task: rows before this size (a window over the source's distinct sizes),
rows of this size in smaller salts (a window over at most ``salts`` counts), and
the row's number within (source, size, salt).

Targets are worked out in one task over one row a source, two numbers each.

Defined results: null text is size 0; a null source is a source of its own, last
in order; a null doc_id is salted by a hash of its text; rows that repeat an id
are separate documents, ordered by a hash of their text; an empty table gives an
empty table; result columns replace input columns of the same name, no other
name clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import documents, materialize, tucked, word_count

WEIGHTS = (5, 2, 1)
BUDGET = 1.5  # words to take, as a share of all words
MOST = 2.0  # a target's bound, as a multiple of its source's size
SALTS = 1024
SEED = "mix-17"
MADE = ("size", "source_size", "target", "copies", "taken")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``sizes`` (_key, _words) to (_key, source_size, target): shares by weight, capped, the excess reshared.

    Resharing until no target is above its cap ends where all uncapped sources
    have the same target per weight.  In the order of cap per weight the capped
    sources come first, so that running sums find that level without a loop.
    """
    by_key, by_cap = W.orderBy("_key"), W.orderBy("_full", "_key")
    before, all_rows = by_cap.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_no") % len(weights) + 1).cast("int"))
    src = (
        sizes.withColumn("_no", F.row_number().over(by_key) - 1)
        .withColumn("_weight", weight)
        .withColumn("_cap", F.lit(most) * F.col("_words"))
        .withColumn("_full", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.lit(budget) * F.sum("_words").over(all_rows))
        .withColumn("_weights", F.sum("_weight").over(all_rows))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weight_before", F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_capped", (F.col("_total") - F.col("_cap_before")) * F.col("_weight") >= F.col("_cap") * (F.col("_weights") - F.col("_weight_before")))
    )
    free_weight = F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("_weight"))).over(all_rows)
    free_words = F.col("_total") - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(all_rows)
    share = F.when(F.col("_capped"), F.col("_cap")).otherwise(free_words / free_weight * F.col("_weight"))
    return src.select("_key", F.col("_words").alias("source_size"), F.least(share, F.col("_cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, salts: int = SALTS, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) plus size, source_size, target, copies, taken."""
    packed, out = tucked(docs, "doc_id", "text", "source")
    return out(_placed(packed, weights, budget, most, salts, seed), *MADE)


def _placed(docs: DataFrame, weights, budget: float, most: float, salts: int, seed: str, texts: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, source and one struct) with MADE.

    Without ``texts`` the text is left behind, and words are counted once: what
    is drawn from is written.  With them, counting again is cheaper than another
    copy of the texts on disk.
    """
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    named = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    keyed = docs.withColumns({
        "size": word_count(), "_key": key, "_salt": F.pmod(F.conv(F.substring(named, 1, 8), 16, 10).cast("long"), F.lit(salts)), "_tie": F.xxhash64("text"),
    })
    keyed = keyed if texts else materialize(keyed.drop("text"), "op8-sizes")
    by_salt = keyed.groupBy("_key", "size", "_salt").agg(F.count("*").alias("_n"))
    by_size = by_salt.groupBy("_key", "size").agg(F.sum("_n").alias("_n"))
    targets = source_targets(by_size.groupBy("_key").agg(F.sum(F.col("size") * F.col("_n")).alias("_words")), weights, budget, most)
    sizes_before = W.partitionBy("_key").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    salts_before = W.partitionBy("_key", "size").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    per_size = by_size.select("_key", "size", F.coalesce(F.sum("_n").over(sizes_before), F.lit(0)).alias("_from")).join(targets, "_key")
    offsets = (
        by_salt.withColumn("_in_size", F.coalesce(F.sum("_n").over(salts_before), F.lit(0)))
        .join(per_size, ["_key", "size"])
        .select("_key", "size", "_salt", "source_size", "target", (F.col("_from") + F.col("_in_size")).alias("_before"))
    )
    one_offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_key"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("_before") + F.row_number().over(W.partitionBy("_key", "size", "_salt").orderBy("doc_id", "_tie"))
    placed = keyed.join(offsets, ["_key", "size", "_salt"]).withColumn("_rank", rank).withColumns({"_rate": rate, "_u": one_offset})
    crossed = F.floor(F.col("_rank") * F.col("_rate") + F.col("_u")) - F.floor((F.col("_rank") - 1) * F.col("_rate") + F.col("_u"))
    return placed.withColumn("copies", crossed.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))


def emit(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, salts: int = SALTS, seed: str = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it was drawn."""
    packed, out = tucked(docs, "doc_id", "text", "source")
    drawn = _placed(packed, weights, budget, most, salts, seed).filter("copies > 0")
    return out(drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    return _placed(docs, WEIGHTS, BUDGET, MOST, SALTS, SEED, texts=False).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 8))::BIGINT % 1024 AS salt
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS w, row_number() OVER (ORDER BY k) - 1 AS no FROM d GROUP BY k),
c AS (
  SELECT k, w, no, [5.0, 2.0, 1.0][no % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * w AS cap,
         1.5::DOUBLE * (sum(w) OVER ())::BIGINT AS total FROM s),
b AS (
  SELECT *, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM c),
f AS (SELECT *, (total - cap_before) * weight >= cap * (weights - weight_before) AS capped FROM b),
t AS (
  SELECT k, w, least(CASE WHEN capped THEN cap ELSE
         (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () * weight END, cap) AS target
  FROM f),
r AS (
  SELECT d.doc_id, d.size, t.w, t.target, CASE WHEN t.w > 0 THEN t.target / t.w ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-17' || d.k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY d.k ORDER BY d.size, d.salt, d.doc_id) AS rank
  FROM d JOIN t ON d.k = t.k)
SELECT doc_id, size, w AS source_size, target,
       (floor(rank * rate + u) - floor((rank - 1) * rate + u))::BIGINT * size AS taken
FROM r
"""
