"""Pairs of texts whose sets of five-word shingles have a Jaccard similarity of at least 80 %, completely.

Prefix filter: shingles have one order, the hot ones last and the others by
hash.  Of a set of n, the first n - ceil(0.8 n) + 1 are its prefix; two sets at
or above the limit share a shingle of both prefixes.  Which shingles count as
hot comes from a sample of documents and only orders them: any choice finds the
same pairs, a good one compares fewer.  A shard answers which prefix shingles
stand in two documents (one packed exchange), and sets meet at those (another).

Two sets are compared where they meet first: an entry of a set at a shingle
carries up to FIRSTS shared shingles that come earlier in its prefix, and two
sets with one of those in common have met there, with all members of the group
if all have it.  At the first shingle that two prefixes share no earlier one can
be common, so that no pair is lost; later meetings go unnoticed only where the
first FIRSTS have none in common.

Sets that meet are compared by size and by parity bits (a lower bound of the
difference, so that no pair is lost), what passes by longer sketches of the same
kind, and what is left by the whole sets.  Where
more than FULL sets meet, each is first compared with a few others; what is
joined then needs no more comparisons, and all pairs of sets not joined yet are
compared by blocks, so that rows don't grow with the pairs.  Links have the
components of all pairs; pairs inside a component may be left out.

Defined results: sets are of lower-cased words; texts of fewer words than a
shingle are one shingle; texts without a word have equal (empty) sets.  Sets are
known by a 64-bit digest (``_node``), shingles by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, materialize, release, released, text_bytes
from .blocks import Chunk, Exchange, RunIndex, answered_bits, answers_of, blocks_table, dealt, first_of, keys_with_bits, mixed, packed_bits, read_keys_with_bits, runs, shard_of
from .components import components

SHINGLE = 5
FIRSTS = 4
PERCENT = 80
FULL = 32  # sets that meet at a shingle and are all compared at once
OTHERS = 4
AT_ONCE = 1 << 17  # pairs looked at together
BLOCK = 512
SAMPLE = 8000  # documents, about, that the hot shingles are taken from
HOT_FROM, HOT_MOST = 5, 50_000
WORDS64 = 4  # parity bits of a set, in 64-bit words
SKETCH = 1 << 15  # parity bits of a set at most, where pairs are looked at again

_ODD = np.random.default_rng(5).integers(1, 1 << 62, 64, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ENTRY = np.dtype([("key", "<u8"), ("node", "<i8"), ("size", "<i8"), ("bits", "<u8", (WORDS64,)), ("before", "<u8", (FIRSTS,))])


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    import xxhash

    words = [t.lower().split() for t in texts]  # bytes: lower() and white space are ASCII's
    known = {w: k for k, w in enumerate(set().union(*words))}
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    out = []
    for ws in words:
        at = table[np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))]
        short = min(width, len(ws))
        n = len(ws) - short + 1 if ws else 0
        made = np.full(n, short, np.uint64)
        for k in range(short):
            made += at[k : k + n] * _ODD[k]
        out.append(np.unique(mixed(made)))
    return out


def node(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def prefix(shingles: np.ndarray, hot: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The prefix of a set; ``hot``: sorted."""
    n = len(shingles)
    if not n:
        return shingles
    late = hot[np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)] == shingles if len(hot) else np.zeros(n, bool)
    return np.concatenate([shingles[~late], shingles[late]])[: n - -(-percent * n // 100) + 1]


def parity(shingles: np.ndarray) -> np.ndarray:
    counts = np.bincount((mixed(shingles) % np.uint64(64 * WORDS64)).astype(np.int64), minlength=64 * WORDS64)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<u8")


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bits again, about two a shingle (a power of two from 256 to SKETCH): enough to tell large sets apart."""
    bits = min(SKETCH, max(256, 1 << (2 * len(shingles) - 1).bit_length()))
    counts = np.bincount((mixed(shingles) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little")


def _differ(a: bytes, b: bytes) -> int:
    """A lower bound of the difference of two sets by their sketches; the longer one is folded."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class Sketches:
    """Sketches of some sets, compared many at a time; folded ones are kept by width."""

    def __init__(self, sketches: list[bytes]):
        words = [np.frombuffer(x, "<u8") for x in sketches]
        self.width = np.array([len(w) for w in words], np.int64)
        self.row, self.stacks = np.zeros(len(words), np.int64), {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.stacks[w, w] = np.stack([words[k] for k in at])

    def _folded(self, width: int, to: int) -> np.ndarray:
        if (width, to) not in self.stacks:
            wide = self._folded(width, 2 * to)
            self.stacks[width, to] = wide[:, :to] ^ wide[:, to:]
        return self.stacks[width, to]

    def differ(self, k: int, others: np.ndarray) -> np.ndarray:
        """Lower bounds of the differences of set k and ``others``."""
        out, own = np.zeros(len(others), np.int64), int(self.width[k])
        for w in np.unique(self.width[others]).tolist():
            at, to = np.flatnonzero(self.width[others] == w), min(w, own)
            one = self._folded(own, to)[self.row[k]]
            out[at] = np.bitwise_count(self._folded(w, to)[self.row[others[at]]] ^ one).sum(axis=1, dtype=np.int64)
        return out


def _possible(size_a, size_b, bits_a, bits_b, percent: int) -> np.ndarray:
    """Whether pairs can be at the limit: the difference of two such sets is at most (100 - percent) / (100 + percent) of their sizes' sum."""
    differ = np.maximum(np.bitwise_count(bits_a ^ bits_b).sum(axis=-1, dtype=np.int64), np.abs(size_a - size_b))
    return (100 + percent) * differ <= (100 - percent) * (size_a + size_b)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    low, high = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])] if len(low) else np.zeros(0, bool)
    both = np.stack([low[new], high[new]], axis=1)
    none = pa.nulls(len(both), pa.int64())
    return pa.table([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), none, none, pa.nulls(len(both), pa.binary())], ["a", "b", "grp", "size", "bits"])


MET = "a long, b long, grp long, size long, bits binary"


def _before(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each of ``keys``, in the order of their owner's prefix, up to FIRSTS of the first of that owner that come earlier; zeros for the rest."""
    first = runs(owner)
    count = np.diff(np.r_[first, len(owner)])
    start, out = np.repeat(first, count), np.zeros((len(keys), FIRSTS), np.uint64)
    for k in range(FIRSTS):
        late = np.flatnonzero(np.arange(len(keys)) - start > k)
        out[late, k] = keys[start[late] + k]
    return out


def _new(before_a: np.ndarray, before_b: np.ndarray) -> np.ndarray:
    """Whether pairs have no earlier shingle in common, as far as is known."""
    met = np.zeros(len(before_a), bool)
    for k in range(FIRSTS):
        met |= ((before_a[:, k, None] == before_b) & (before_b != 0)).any(axis=1)
    return ~met


def _all_met(before: np.ndarray) -> bool:
    """Whether the members of a group have all an earlier shingle in common; shingles of one member's are distinct."""
    return any(k and (before == k).any(axis=1).all() for k in before[0].tolist())


def _meet(entries: np.ndarray, percent: int) -> pa.Table:
    """Of sets that meet: pairs that may be similar, and the members of full groups."""
    entries = entries[np.lexsort((entries["node"], entries["key"]))]
    entries = entries[np.r_[True, (entries["key"][1:] != entries["key"][:-1]) | (entries["node"][1:] != entries["node"][:-1])]] if len(entries) else entries
    first = np.flatnonzero(np.r_[True, entries["key"][1:] != entries["key"][:-1]]) if len(entries) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(entries)])
    left, right, full = [], [], []

    def try_(x, y):
        fits = _new(entries["before"][x], entries["before"][y])
        x, y = x[fits], y[fits]
        fits = _possible(entries["size"][x], entries["size"][y], entries["bits"][x], entries["bits"][y], percent)
        left.append(entries["node"][x[fits]])
        right.append(entries["node"][y[fits]])

    for n in np.unique(count[(count > 1) & (count <= FULL)]).tolist():
        i, j = np.triu_indices(n, 1)
        starts = first[count == n]
        for k in range(0, len(starts), max(1, AT_ONCE // len(i))):
            some = starts[k : k + max(1, AT_ONCE // len(i)), None]
            try_((some + i).ravel(), (some + j).ravel())
    for a, n in zip(first[count > FULL].tolist(), count[count > FULL].tolist(), strict=True):
        if _all_met(entries["before"][a : a + n]):
            continue
        x = np.arange(a, a + n)
        full.append(x)
        for other in np.argsort(mixed(entries["node"][x].view(np.uint64) ^ entries["key"][a]))[:OTHERS]:
            try_(x, np.full(n, a + other))
    pairs = _pairs(np.concatenate(left), np.concatenate(right)) if left else _pairs(np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not full:
        return pairs
    rows = entries[np.concatenate(full)]
    bits = [r.tobytes() for r in rows["bits"]]
    members = [pa.array(np.ascontiguousarray(rows["node"])), pa.nulls(len(rows), pa.int64()), pa.array(np.ascontiguousarray(rows["key"]).view(np.int64)), pa.array(np.ascontiguousarray(rows["size"])), pa.array(bits, pa.binary())]
    return pa.concat_tables([pairs, pa.table(members, pairs.schema.names)])


def _rows_of(docs: DataFrame, width: int, make, schema: str) -> DataFrame:
    """``docs`` (_bytes) in batches to what ``make`` gives for the list of shingle sets and the batch."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield make(shingle_sets(batch["_bytes"].to_pylist(), width), batch)

    return docs.mapInArrow(released(run), schema)


def hot_shingles(docs: DataFrame, width: int = SHINGLE) -> np.ndarray:
    """The shingles put last, sorted; at most HOT_MOST."""
    share = max(1, docs.count() // SAMPLE)
    some = docs.select(text_bytes().alias("_bytes")).filter(F.pmod(F.xxhash64("_bytes"), F.lit(share)) == 0)

    def each(sets, _):
        joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        keys, n = np.unique(joined, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    counted = _rows_of(some, width, each, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_FROM)
    return np.sort(np.array([r["key"] for r in counted.orderBy(F.desc("n"), "key").limit(HOT_MOST).collect()], np.int64).view(np.uint64))


class Prefixes:
    """The distinct sets of a chunk: digest, size, parity bits and sketch of each, and the shingles of its prefix."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, bits: np.ndarray, length: np.ndarray, keys: np.ndarray, sketches: list[bytes]):
        self.nodes, self.sizes, self.bits, self.length, self.keys, self.sketches = nodes, sizes, bits, length, keys, sketches
        self.owner = np.repeat(np.arange(len(nodes)), length)

    @staticmethod
    def pack(texts: list[bytes], width: int, hot: np.ndarray, percent: int) -> bytes:
        sets = {node(s): s for s in shingle_sets(texts, width) if len(s)}
        firsts = [prefix(s, hot, percent) for s in sets.values()]
        sketches = [sketch(s) for s in sets.values()]
        counts = [np.array(x, np.int64) for x in ([len(sets)], list(sets), [len(s) for s in sets.values()], [len(p) for p in firsts], [len(x) for x in sketches])]
        parts = [*counts, *map(parity, sets.values()), *firsts, *sketches]
        return b"".join(x.tobytes() for x in parts)

    @classmethod
    def unpack(cls, raw: bytes) -> Prefixes:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        nodes, sizes, length, sketched = np.frombuffer(raw, np.int64, 4 * n, 8).reshape(4, n)
        bits = np.frombuffer(raw, "<u8", WORDS64 * n, 8 + 32 * n).reshape(n, WORDS64)
        keys = np.frombuffer(raw, "<u8", int(length.sum()), 8 + (32 + 8 * WORDS64) * n)
        end = len(raw) - int(sketched.sum()) + np.cumsum(sketched)
        return cls(nodes, sizes, bits, length, keys, [raw[b - k : b] for b, k in zip(end.tolist(), sketched.tolist(), strict=True)])


def _met(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """MET rows, and (_node, size, sketch) of each chunk's sets."""
    hot = hot_shingles(docs, width)
    exchange = Exchange(docs, lambda chunk: Prefixes.pack(chunk.texts, width, hot, percent), texts=False)
    shards = exchange.shards

    def ask(chunk: Chunk):
        sets = Prefixes.unpack(chunk.notes)
        low, least, _ = first_of(sets.keys, sets.owner, np.minimum)
        many = least != first_of(sets.keys, sets.owner, np.maximum)[1]
        for s, at in dealt(shard_of(low, shards)):
            yield s, 0, keys_with_bits(low[at], many[at])

    def resolve(blocks: list[dict]):
        index, got = RunIndex(np.add), []
        for b in blocks:
            keys, many = read_keys_with_bits(b["payload"])
            got.append(keys)
            index.add(keys, many.astype(np.int64) + 1)
        for b, keys in zip(blocks, got, strict=True):
            yield b["chunk"], 0, packed_bits(index.find(keys) > 1)

    def entries(chunk: Chunk, answers: list[dict]) -> pa.Table:
        sets = Prefixes.unpack(chunk.notes)
        if not len(sets.keys):
            return blocks_table([])
        low, _, place = first_of(sets.keys, sets.owner, np.minimum)
        shared = answered_bits(answers_of(answers, 0), shard_of(low, shards))[place]
        keys, owner = sets.keys[shared], sets.owner[shared]
        made = np.zeros(len(keys), _ENTRY)
        made["key"], made["node"], made["size"], made["bits"] = keys, sets.nodes[owner], sets.sizes[owner], sets.bits[owner]
        made["before"] = _before(keys, owner)
        return blocks_table([(s, chunk.name, 0, made[at].tobytes()) for s, at in dealt(shard_of(keys, shards))] if len(keys) else [])

    def meet(table: pa.Table) -> pa.Table:
        made = _meet(np.concatenate([np.frombuffer(p, _ENTRY) for p in table["payload"].to_pylist()]), percent)
        release()
        return made

    sent = exchange.meet(exchange.answer(exchange.ask(ask), resolve), entries, "shard long, chunk binary, kind int, payload binary")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sets = Prefixes.unpack(Chunk.unpack(row).notes)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(sets.nodes)), pa.array(np.ascontiguousarray(sets.sizes)), pa.array(sets.sketches, pa.binary())], ["_node", "size", "sketch"])

    known = exchange.table.select("chunk", "notes").mapInArrow(sketches, "_node long, size long, sketch binary")
    return materialize(sent.groupBy("shard").applyInArrow(meet, MET), "jaccard-met"), known


def _likely(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), distinct, those that their sketches don't rule out; ``known``: (_node, size, sketch), repeats included."""
    pairs = materialize(pairs.select("a", "b").distinct(), "jaccard-pairs")
    wanted = pairs.select(F.col("a").alias("_node")).union(pairs.select(F.col("b").alias("_node"))).distinct()
    own = known.join(wanted, "_node", "left_semi").dropDuplicates(["_node"])
    side = lambda c, n: own.select(F.col("_node").alias(c), F.col("size").alias(f"size_{n}"), F.col("sketch").alias(f"sketch_{n}"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "size_x", "size_y", "sketch_x", "sketch_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch["size_x"].to_numpy(), batch["size_y"].to_numpy()
            differ = np.array([_differ(s, t) for s, t in zip(batch["sketch_x"].to_pylist(), batch["sketch_y"].to_pylist(), strict=True)], np.int64)
            fits = (100 + percent) * np.maximum(differ, np.abs(x - y)) <= (100 - percent) * (x + y)
            yield batch.select(["a", "b"]).filter(pa.array(fits))

    return materialize(both.mapInArrow(released(run), "a long, b long"), "jaccard-likely")


def _verified(docs: DataFrame, pairs: DataFrame, known: DataFrame, width: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose whole sets are similar; ``docs``: doc_id, text and _node."""
    pairs = _likely(pairs, known, percent)
    wanted = pairs.select(F.col("a").alias("_node")).union(pairs.select(F.col("b").alias("_node"))).distinct()
    named = docs.join(wanted, "_node", "left_semi").groupBy("_node").agg(F.min("doc_id").alias("_first"))  # one document of each set: its texts stay where they are
    texts = docs.join(named.withColumnRenamed("_node", "_wanted"), (F.col("_node") == F.col("_wanted")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi").select("_node", text_bytes().alias("_bytes"))

    def each(sets, batch):
        return pa.RecordBatch.from_arrays([batch["_node"], pa.array([s.tobytes() for s in sets], pa.binary())], ["_node", "_set"])

    sets = materialize(_rows_of(texts, width, each, "_node long, _set binary"), "jaccard-sets")
    both = pairs.join(sets.select(F.col("_node").alias("a"), F.col("_set").alias("x")), "a").join(sets.select(F.col("_node").alias("b"), F.col("_set").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return materialize(both.mapInArrow(released(run), "a long, b long").distinct(), "jaccard-links")


def _across(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of two blocks of a group (or within one), of different roots, that their sketches don't rule out."""
    i, j, block = table["i"][0].as_py(), table["j"][0].as_py(), table["block"].to_numpy()
    names, size, root = table["a"].to_numpy(), table["size"].to_numpy(), table["root"].to_numpy()
    bits, sketches = np.frombuffer(b"".join(table["bits"].to_pylist()), "<u8").reshape(-1, WORDS64), Sketches(table["sketch"].to_pylist())
    one, two, left, right = np.flatnonzero(block == i), np.flatnonzero(block == j), [], []
    for k in one.tolist():
        at = two[root[two] != root[k]]
        at = at[names[at] > names[k]] if i == j else at
        at = at[_possible(size[k], size[at], bits[k], bits[at], percent)]
        at = at[(100 + percent) * sketches.differ(k, at) <= (100 - percent) * (size[k] + size[at])]
        left.append(np.full(len(at), names[k]))
        right.append(names[at])
    return _pairs(np.concatenate(left), np.concatenate(right)).select(["a", "b"]) if left else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def links(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) of nodes that have the components of all similar pairs; ``docs``: doc_id, text and _node."""
    met, known = _met(docs.select("doc_id", "text"), width, percent)
    first = _verified(docs, met.filter("grp IS NULL"), known, width, percent)
    full = met.filter("grp IS NOT NULL").select("a", "grp", "size", "bits")
    if full.isEmpty():
        return first
    rooted = full.join(components(first).withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    sketches = known.select(F.col("_node").alias("a"), "sketch").join(full.select("a").distinct(), "a", "left_semi").dropDuplicates(["a"])
    rooted = materialize(rooted.join(sketches, "a"), "jaccard-full")
    open_ = rooted.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("low <> high")
    dealt = rooted.join(open_.select("grp", "blocks"), "grp").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    more = dealt.select("grp", "i", "j", "block", "a", "size", "bits", "sketch", "root").groupBy("grp", "i", "j").applyInArrow(lambda t: _across(t, percent), "a long, b long")
    return first.union(_verified(docs, more, known, width, percent))
