"""Connected components of a link table, by alternating large-star and small-star steps.

Links never leave the executors.  A step is two shuffles over the links still
there; the number of steps follows the logarithm of the longest chain.  The
links are written to the shared folder after each round, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

ROUNDS = 64


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("_low")).select("a", F.least("a", "_low").alias("_low"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("_low").alias("b")).filter("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("_low"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("_low").alias("b"))
    return moved.union(low.select("a", F.col("_low").alias("b"))).filter("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.col("b") % 1000003)).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: comparable, not null) to (node, root): each node that has a link, its component's least node."""
    links = materialize(links.filter("a <> b").select("a", "b").distinct(), "links")
    state = _state(links)
    for _ in range(ROUNDS):
        if not state[0]:
            break
        links = materialize(_small(_large(links)), "links")
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError("links didn't settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
