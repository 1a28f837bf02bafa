"""Operator 1: SimHash near-dedup with covering locality-sensitive hashing.

A text's fingerprint has a bit set where more than half of its shingles' hashes
have it.  For radius r every bit position i gets a nonzero vector m(i) of r + 1
bits; there is a table for each nonzero vector v, whose mask holds the positions
with <m(i), v> = 1.  Any r positions leave some v orthogonal to all of their
vectors, so that two fingerprints at r or fewer bits agree under some mask: no
pair within the radius is lost, whatever it is.

Only distinct fingerprints take part.  Those that share a bucket with another
are compared without forming pairs: two fingerprints at distance 2 or less that
agree under a mask meet at a common neighbour, one flipped bit outside the mask
away from each.  All that meet at a neighbour are within the radius of each
other, so that linking each to the least of them keeps the components exact.
Work is linear in the fingerprints however full a bucket is.

Defined results: null and empty texts, and texts without a word, have
fingerprint 0 and are linked like any other; texts of fewer words than a shingle
are one shingle; rows may repeat; a null doc_id never names a component unless
all ids of it are null; empty tables give empty tables; result columns replace
input columns of the same name, no other name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard
from ._common import bounded_batches, documents, materialize, released, scratch, text_bytes, tucked
from .components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
AT_ONCE = 1 << 16  # shingles whose bits are summed at a time


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    import xxhash

    words = text.lower().split()  # bytes: lower() and white space are ASCII's
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    first = np.r_[0, end[:-1] + 1][:n].tolist()
    last = end[min(width, len(words)) - 1 :].tolist()
    digest, sums = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, n, AT_ONCE):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first[k : k + AT_ONCE], last[k : k + AT_ONCE], strict=True)), np.uint64)
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view(np.uint64)[0])


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask for each nonzero vector of radius + 1 bits; position i's own vector is i mod (2^(r+1) - 1), plus 1."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, width: int, carry: list[str], sets: bool = False) -> DataFrame:
    """``docs`` (text, ...) plus _fp, the fingerprint as a signed long, and with ``sets`` _node, the digest of the five-word shingle set."""
    bounded_batches(docs.sparkSession)
    added = ["_fp", "_node"] if sets else ["_fp"]
    through = [c for c in carry if c.lower() not in (*added, "_bytes")]
    rows = docs.select(*[F.col(f"`{c}`") for c in through], text_bytes().alias("_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_bytes")
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [x for i, x in enumerate(batch.schema.names) if i != at]
            made = [pa.array(np.array([fingerprint(t.as_py(), width) for t in batch["_bytes"]], np.uint64).view(np.int64))]
            if sets:
                made.append(pa.array(map(jaccard.node, jaccard.shingle_sets(batch["_bytes"].to_pylist())), pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, *made], [*names, *added])

    return rows.mapInArrow(released(run), T.StructType([rows.schema[c] for c in through] + [T.StructField(c, T.LongType()) for c in added]))


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp`` that have the components of all pairs within ``radius`` (1 or 2)."""
    if radius not in (1, 2):
        raise ValueError("common neighbours cover a radius of 1 or 2")
    masks = covering_masks(radius)
    fp = F.col("fp")
    buckets = fingerprints.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("table"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])).alias("b")).select("fp", "b.*")
    full = buckets.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1").select("table", "key")
    met = buckets.join(full, ["table", "key"], "left_semi")
    outside = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks])
    near = met.select("fp", F.explode(F.element_at(outside, F.col("table") + 1)).alias("flip")).select("fp", fp.bitwiseXOR(F.col("flip")).alias("at")).distinct()
    least = near.groupBy("at").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("at", "b")
    return near.join(least, "at").filter("fp <> b").select(fp.alias("a"), "b").distinct()


def _by_sets(rows: DataFrame) -> DataFrame:
    """Links of fingerprints whose rows have equal or similar shingle sets; ``rows``: _fp, _node, doc_id and text."""
    named = materialize(rows.select("_node", "_fp").distinct(), "op1-sets")
    least = named.groupBy("_node").agg(F.min("_fp").alias("b"))
    equal = named.join(least, "_node").select(F.col("_fp").alias("a"), "b")
    pairs = jaccard.links(rows)
    near = pairs.withColumnRenamed("b", "_b").join(least.select(F.col("_node").alias("a"), F.col("b").alias("x")), "a").join(least.select(F.col("_node").alias("_b"), F.col("b").alias("y")), "_b")
    return equal.union(near.select(F.col("x").alias("a"), F.col("y").alias("b"))).filter("a <> b")


def _rooted(docs: DataFrame, width: int, radius: int, carry: list[str], sets: bool = False) -> DataFrame:
    """``docs`` plus _fp, _root (the component's least fingerprint) and component_id.

    The fingerprints are computed once, over whole texts, and written with the
    carried columns to the shared folder.  ``sets`` also links rows of equal or
    similar shingle sets (jaccard.py).
    """
    rows = materialize(with_fingerprint(docs, width, carry, sets), "op1-fingerprints")
    classes = materialize(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("least")), "op1-classes")
    near = links(classes, radius)
    with scratch(docs.sparkSession):
        linked = materialize(components(near.union(_by_sets(rows)) if sets else near), "op1-roots", outer=True)
    rows = rows.select(*carry, "_fp")
    rooted = classes.join(linked, classes.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("_root"))
    named = rooted.groupBy("_root").agg(F.min("least").alias("component_id"))
    label = rooted.join(named, "_root").select(F.col("fp").alias("_fp"), "_root", "component_id")
    return rows.join(label, "_fp", "left")


def near_components(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) plus fingerprint (16 hex digits) and component_id."""
    if carry is None:
        packed, out = tucked(docs, "doc_id", "text")
        return out(near_components(packed, width, radius, packed.columns), "fingerprint", "component_id")
    made = _rooted(docs, width, radius, carry)
    return made.withColumn("fingerprint", F.lower(F.lpad(F.hex("_fp"), 16, "0"))).drop("_fp", "_root")


def keep_one(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, sets: bool = False) -> DataFrame:
    """The columns of ``docs``, of each component the row with the least doc_id (of rows that repeat it, one)."""
    packed, out = tucked(docs, "doc_id", "text")
    least = _rooted(packed, width, radius, packed.columns, sets).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    if not least.groupBy("_root").count().filter("count > 1").isEmpty():
        least = least.dropDuplicates(["_root"])
    return out(least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir, "doc_id", "text"), carry=["doc_id"]).select("doc_id", "fingerprint", "component_id")
