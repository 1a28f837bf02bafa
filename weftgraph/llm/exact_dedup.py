"""Operator 2: exact dedup with minimal perfect hashes over historical distinct digests.

The history's distinct SHA-256 digests are dealt to shards by digest.  Each
shard gets a minimal perfect hash: levels of bit arrays, each with a bit where
exactly one of the digests left over from the level above falls; the rank of
that bit is the digest's slot.  A slot holds the full digest and the locator of
its winner (doc_id, row count).  A batch is first reduced to distinct digests
(partial aggregation, so that a text with a third of all rows costs one row a
task), then each shard looks its own up: the 32 bytes in the slot decide, since
a hash of this kind also gives non-members a slot.  Members are repeats of the
history; non-members are grouped among themselves.

Defined results: null text is the empty text; null doc_ids are smaller than all
others; of rows that repeat both the id and the text of a winner one stays;
empty tables give empty tables; result columns replace input columns of the same
name, no other name clashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import documents, materialize, tucked

#: Digests of one shard at most, about: bounds a task's memory (some 100 bytes each).
SHARD_DIGESTS = 65_536
GAMMA = 1.5
LEVELS = 64

GROUP = "digest binary, keep_id long, keep_rows long, group_size long"
INDEX = "shard long, level_bits array<long>, bits binary, digests binary, keep_ids array<long>, keep_rows array<long>, sizes array<long>"


def _words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)


def _slots_at(words: np.ndarray, level: int, m: int) -> np.ndarray:
    mix = words[:, 1] ^ (words[:, 2] * np.uint64(2 * level + 1)) ^ (words[:, 3] >> np.uint64(level % 32))
    mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mix >> np.uint64(16)) % np.uint64(m)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of n distinct digests (n x 32 bytes) onto 0 .. n-1."""

    def __init__(self, level_bits: list[int], bits: np.ndarray):
        self.level_bits, self.bits = level_bits, bits
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        left, sizes, levels = _words(digests), [], []
        while len(left):
            if len(sizes) >= LEVELS:
                raise ValueError("digests repeat")
            m = max(8, int(len(left) * GAMMA))
            at = _slots_at(left, len(sizes), m)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slot(self, digests: np.ndarray) -> np.ndarray:
        """Slots; -1 where no level has a bit.  Non-members may get a slot of another digest."""
        words, out = _words(digests), np.full(len(digests), -1, np.int64)
        open_, start = np.arange(len(digests)), 0
        for level, m in enumerate(self.level_bits):
            at = start + _slots_at(words[open_], level, m)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_, start = open_[~hit], start + m
        return out


def _digests(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _build(table: pa.Table) -> pa.Table:
    digests = _digests(table["digest"])
    ph = PerfectHash.build(digests)
    order = np.argsort(ph.slot(digests))
    take = lambda c: [table[c].take(pa.array(order)).to_pylist()]
    return pa.table({
        "shard": pa.array([table["shard"][0].as_py()], pa.int64()), "level_bits": pa.array([ph.level_bits], pa.list_(pa.int64())), "bits": [np.packbits(ph.bits).tobytes()],
        "digests": [digests[order].tobytes()], "keep_ids": pa.array(take("keep_id"), pa.list_(pa.int64())), "keep_rows": pa.array(take("keep_rows"), pa.list_(pa.int64())), "sizes": pa.array(take("group_size"), pa.list_(pa.int64())),
    })


def _better(a: tuple, b: tuple) -> tuple:
    """The winner of two (doc_id, rows): the larger id, null least; equal ids add their rows."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1]
    return b if a[0] is None or (b[0] is not None and b[0] > a[0]) else a


def _lookup(index: pa.Table, batch: pa.Table) -> pa.Table:
    """All groups of a shard after the batch: members of the history with what the batch adds, then non-members."""
    new = list(zip(batch["keep_id"].to_pylist(), batch["keep_rows"].to_pylist(), batch["group_size"].to_pylist(), strict=True))
    asked = _digests(batch["digest"])
    if index.num_rows:
        row = {c: index[c][0].as_py() for c in index.column_names}
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["level_bits"])].astype(bool)
        ids, rows, sizes = row["keep_ids"], row["keep_rows"], row["sizes"]
        slot = PerfectHash(row["level_bits"], bits).slot(asked)
        member = slot >= 0
        member[member] = (held[slot[member]] == asked[member]).all(axis=1)
    else:
        held, ids, rows, sizes = np.zeros((0, 32), np.uint8), [], [], []
        slot, member = np.full(len(asked), -1), np.zeros(len(asked), bool)
    for i in np.flatnonzero(member):
        s = slot[i]
        ids[s], rows[s] = _better((ids[s], rows[s]), new[i][:2])
        sizes[s] += new[i][2]
    alone = np.flatnonzero(~member)
    return pa.table({
        "digest": pa.array([d.tobytes() for d in held] + [asked[i].tobytes() for i in alone], pa.binary()),
        "keep_id": pa.array(ids + [new[i][0] for i in alone], pa.int64()), "keep_rows": pa.array(rows + [new[i][1] for i in alone], pa.int64()), "group_size": pa.array(sizes + [new[i][2] for i in alone], pa.int64()),
    })


def with_digest(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))


def groups(docs: DataFrame) -> DataFrame:
    """Distinct digests of a batch with the winner's id, how many rows have that id, and the group's size."""
    by_id = docs.groupBy(F.col("_digest").alias("digest"), "doc_id").agg(F.count("*").alias("n"))
    top = F.max(F.struct("doc_id", "n"))
    return by_id.groupBy("digest").agg(top.alias("top"), F.sum("n").alias("group_size")).select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.n").alias("keep_rows"), "group_size")


def _shard(n: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(n))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row a shard over the distinct digests of ``history`` (columns of GROUP); can be kept as a table."""
    return history.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_build, INDEX)


def merge(index: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """The groups of history and batch together."""
    return index.groupBy("shard").cogroup(batch.withColumn("shard", _shard(shards)).groupBy("shard")).applyInArrow(_lookup, GROUP)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) plus keep_id, group_size, kept, text_sha256.

    The rows from the median id up are the history, indexed first; the others
    (null ids too) are looked up in it.  Shards are counted for all rows, so
    that neither side fills one.
    """
    packed, out = tucked(docs, "doc_id", "text")
    rows = with_digest(packed)
    middle, total = docs.agg(F.percentile_approx("doc_id", 0.5), F.count("*")).first()
    old = F.coalesce(F.col("doc_id") >= (0 if middle is None else middle), F.lit(False))
    shards = total // SHARD_DIGESTS + 1
    index = build_index(groups(rows.filter(old)), shards)
    repeated = materialize(merge(index, groups(rows.filter(~old)), shards).filter("group_size > 1"), "op2-groups")
    at = repeated.select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep"), F.col("keep_rows").alias("_rows"), F.col("group_size").alias("_size"))
    found = rows.join(at.hint("merge"), "_digest", "left")  # the same plan at every size
    wins = F.col("_size").isNull() | F.col("doc_id").eqNullSafe(F.col("_keep"))
    if repeated.filter("keep_rows > 1").isEmpty():
        found = found.withColumn("kept", wins)
    else:  # repeated rows win together: one of them stays
        tied = wins & (F.coalesce("_rows", F.lit(1)) > 1)
        first = F.row_number().over(W.partitionBy("_digest").orderBy(F.lit(1))) == 1
        found = found.filter(~tied).withColumn("kept", wins).unionByName(found.filter(tied).withColumn("kept", first))
    found = found.withColumns({
        "keep_id": F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep")),
        "group_size": F.coalesce("_size", F.lit(1)).cast("long"), "text_sha256": F.lower(F.hex("_digest")),
    })
    return out(found, "keep_id", "group_size", "kept", "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
