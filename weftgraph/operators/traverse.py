"""Neighbourhood expansion, PageRank and importance: a fixed number of joins, lineage cut as they go."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..storage import cut
from .views import induced, place

REFERENCES = ("calls", "inherits", "instantiates", "imports")


def reach(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed group, id, hop) of nodes within ``hops`` edges, either way; ``seeds``: (grp, id).

    Only the frontier is joined in each hop; visited ids leave by an anti-join.
    """
    ids = nodes.select("id")
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other")))
    seen = seeds.select("grp", "id").distinct().join(ids, "id", "left_semi").select("grp", "id", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        there = frontier.join(both, "id").select("grp", F.col("other").alias("id")).distinct()
        frontier = there.join(ids, "id", "left_semi").join(seen.select("grp", "id"), ["grp", "id"], "left_anti").select("grp", "id", F.lit(hop).alias("hop"))
        if hop < hops:
            frontier = cut(frontier)
        seen = seen.unionByName(frontier)
    return seen


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` of the seeds (id), and the edges among them."""
    found = reach(nodes, edges, seeds.select(F.lit(0).alias("grp"), "id"), hops).select("id")
    return nodes.join(found, "id", "left_semi"), induced(edges, found)


def intent_reach(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, budgets: dict[str, int] | None = None, default: int = 1, strict: bool = True) -> DataFrame:
    """Ids reached under hop budgets for each relationship, carried along each path; ``seeds``: (grp, id).

    Budgets are the same for all groups, or a map column ``limits`` of the seeds.

    With ``strict`` only the first edge of a (node, relationship, hops used) is
    followed: out-edges before in-edges, in edge order, for the first entry that
    comes to the node (seeds by id, then order of discovery).  Without, all are.
    A level is one join of the frontier with the edges; there are at most as
    many as the budgets add up to.
    """
    relationships = list(vocab.RELATIONSHIPS)
    if budgets is not None:
        seeds = seeds.withColumn("limits", F.create_map(*[F.lit(x) for r in relationships for x in (r, budgets.get(r, default))]))
    started = cut(seeds.dropDuplicates(["grp", "id"]).join(nodes.select("id"), "id", "left_semi").select("grp", "id", "limits"))
    levels = started.agg(F.max(F.aggregate(F.map_values("limits"), F.lit(0), lambda a, x: a + x))).first()[0] or 0
    end = lambda id_, side, other: edges.select(F.col(id_).alias("id"), F.lit(side).alias("side"), F.col(other).alias("other"), "relationship", place(0).alias("place"))
    both = end("source", 0, "target").unionByName(end("target", 1, "source"))  # each end meets the frontier before rows are made of it
    ids = nodes.select("id")
    used0 = F.create_map(*[F.lit(x) for r in relationships for x in (r, 0)])
    seen = started.select("grp", "id")
    frontier = started.withColumn("ord", F.struct("id")).withColumn("used", used0)  # places in the order of discovery are compared, never numbered
    burned: DataFrame | None = None
    for _ in range(levels):
        steps = both.join(frontier, "id").withColumn("d", F.element_at("used", F.col("relationship"))).filter(F.col("d") < F.element_at("limits", F.col("relationship")))
        keys = ["grp", "id", "relationship", "d"]
        if burned is not None:
            steps = steps.join(burned, keys, "left_anti")
        if strict:
            first = F.row_number().over(W.partitionBy(*keys).orderBy("ord", "side", "place")) == 1
            steps = steps.withColumn("first", first).filter("first").drop("first")
        steps = cut(steps)
        if steps.isEmpty():
            break
        burned = steps.select(*keys).distinct() if burned is None else burned.unionByName(steps.select(*keys).distinct())
        used = F.map_zip_with("used", F.create_map(F.col("relationship"), F.lit(1)), lambda k, a, b: a + F.coalesce(b, F.lit(0)))
        there = steps.join(ids.withColumnRenamed("id", "other"), "other", "left_semi").select("grp", F.col("other").alias("id"), used.alias("used"), "limits", "ord", "side", "place", "relationship")
        there = there.withColumn("key", F.to_json("used"))  # maps can't be compared
        arrived = there.dropDuplicates(["grp", "id", "key"]) if not strict else there
        arrived = cut(arrived.select("grp", "id", "used", "limits", F.struct("ord", "side", "relationship", "place", "id").alias("ord")))
        seen = seen.unionByName(arrived.select("grp", "id")).distinct()
        frontier = arrived
    return seen


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 30, damping: float = 0.85) -> DataFrame:
    """(id, pagerank) after a fixed number of rounds from a uniform start.

    Parallel edges count; edges with an end that is no node don't; what stands
    on nodes without an edge out is dealt to all.  The links are aggregated,
    partitioned by source and kept so on disk; each round moves the ranks to
    them and sums them, with partial sums before the shuffle, so that a node
    with very many edges in is no hot key, and writes the new ranks.
    """
    ids = nodes.select("id").distinct()
    ends = edges.select("source", "target").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    ends = ends.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source").join(ids.select(F.col("id").alias("source")), "source", "left_semi")
    links = ends.groupBy("source", "target").agg(F.count("*").alias("n")).persist(StorageLevel.DISK_ONLY)
    out = links.groupBy(F.col("source").alias("id")).agg(F.sum("n").alias("out"))
    base = cut(ids.join(out, "id", "left"))
    count = base.count()
    if not count:
        links.unpersist()
        return ids.withColumn("pagerank", F.lit(0.0))
    ranks = base.withColumn("pagerank", F.lit(1.0 / count))
    for _ in range(rounds):
        lost = ranks.filter("out IS NULL").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("lost"))
        got = links.join(ranks.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("n") / F.col("out") * F.col("pagerank")).alias("got"))
        new = F.lit((1.0 - damping) / count) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.lit(float(count)))
        ranks = cut(base.join(got, "id", "left").crossJoin(F.broadcast(lost)).select("id", "out", new.alias("pagerank")))  # lost: one row
    links.unpersist()
    return ranks.select("id", "pagerank")


def importance_metrics(nodes: DataFrame, edges: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """(id, degree, in_degree, out_degree, reference_count, pagerank) of every node."""
    ranks = pagerank(nodes, edges) if ranks is None else ranks
    e = F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("out")), F.struct(F.col("target").alias("id"), F.lit(0).alias("out"))))
    ends = edges.select(e.alias("e"), F.col("relationship").isin(*REFERENCES).alias("ref")).select("e.*", "ref")
    sums = ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("out").alias("out_degree"), F.count_if(F.col("ref") & (F.col("out") == 0)).alias("reference_count"))
    zero = F.lit(0)
    return nodes.select("id").join(sums, "id", "left").join(ranks, "id", "left").select(
        "id", F.coalesce("degree", zero).cast("double").alias("degree"), F.coalesce(F.col("degree") - F.col("out_degree"), zero).cast("double").alias("in_degree"),
        F.coalesce("out_degree", zero).cast("double").alias("out_degree"), F.coalesce("reference_count", zero).cast("double").alias("reference_count"), "pagerank",
    )


def importance_score(metrics: DataFrame) -> DataFrame:
    """(id, importance): degree, references and PageRank, each over its greatest value."""
    top = metrics.agg(*[F.max(c).alias(f"max_{c}") for c in ("degree", "reference_count", "pagerank")])
    part = lambda c: F.when(F.col(f"max_{c}") > 0, F.col(c) / F.col(f"max_{c}")).otherwise(0.0)
    score = 0.3 * part("degree") + 0.4 * part("reference_count") + 0.3 * part("pagerank")
    return metrics.crossJoin(F.broadcast(top)).select("id", F.bround(score, 4).alias("importance"))  # top: one row
