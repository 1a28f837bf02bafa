"""Packed exchange between chunks of documents and shards of keys.

Operators that ask of every window of every text whether it stands elsewhere
would need a row a window.  Here a chunk, some megabytes of documents, packs
what it asks of each shard into one row, the shard answers with bits, and the
chunk's texts meet the answers again.  A key that many documents of a chunk hold
is asked once, so that hot keys cost at most one entry a chunk.

The chunks are cut once and written to the shared folder with the notes that the
operator makes of them (hashes, anchors); every pass reads what was written, so
that a lost executor repeats a pass over the same chunks and nothing is hashed
twice.  A chunk's name is a digest of its ids and texts; a chunk whose answers
are missing is an error rather than a wrong result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, materialize, release, released, text_bytes

#: Bytes of text in a chunk, and of all texts for each shard: both bound a task's memory.
CHUNK_BYTES = 4 << 20
SHARD_BYTES = 16 << 20
#: Stands for a null doc_id: it is larger than all others.
NO_ID = np.iinfo(np.int64).max

BLOCK = "shard long, chunk binary, kind int, payload binary"
PACKED = "chunk binary, ids binary, nulls binary, sizes binary, texts binary, notes binary, n_bytes long"


class Chunk:
    def __init__(self, ids: list[int | None], texts: list[bytes], name: bytes = b"", notes: bytes = b""):
        self.ids, self.texts, self.name, self.notes = ids, texts, name, notes

    @property
    def numbers(self) -> np.ndarray:
        return np.array([NO_ID if i is None else i for i in self.ids], np.int64)

    def packed(self, notes: bytes, texts: bool) -> pa.RecordBatch:
        import zstandard

        ids, nulls = self.numbers.tobytes(), bytes(i is None for i in self.ids)
        sizes, joined = np.array([len(t) for t in self.texts], np.int64), b"".join(self.texts)
        name = hashlib.blake2b(ids + nulls + sizes.tobytes(), digest_size=16)
        name.update(joined)
        row = (name.digest(), ids, nulls, sizes.tobytes(), zstandard.compress(joined, 3) if texts else b"", zstandard.compress(notes, 3))
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in row], pa.array([len(joined)], pa.int64())], ["chunk", "ids", "nulls", "sizes", "texts", "notes", "n_bytes"])

    @classmethod
    def unpack(cls, row: dict) -> Chunk:
        """From a row of PACKED, of which columns may be absent."""
        import zstandard

        ids, texts, notes = [], [], b""
        if "ids" in row:
            ids = [None if null else int(i) for i, null in zip(np.frombuffer(row["ids"], np.int64), row["nulls"], strict=True)]
        if row.get("texts"):
            sizes = np.frombuffer(row["sizes"], np.int64)
            joined = zstandard.decompress(row["texts"], max_output_size=max(1, int(sizes.sum())))
            ends = np.cumsum(sizes)
            texts = [joined[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        if "notes" in row:
            notes = zstandard.decompress(row["notes"])
        return cls(ids, texts, row["chunk"], notes)


def _cut(batches: Iterable[pa.RecordBatch], chunk_bytes: int) -> Iterator[Chunk]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch["doc_id"].to_pylist(), batch["_bytes"].to_pylist(), strict=True):
            if texts and size + len(t) > chunk_bytes:
                yield Chunk(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if texts:
        yield Chunk(ids, texts)


def _blocks(rows: list[tuple[int, bytes, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["shard", "chunk", "kind", "payload"])


class Exchange:
    """The documents of one operator call, cut into chunks that are written once with the notes ``prepare`` makes.

    ``texts``: whether later passes see the texts; else the notes must hold what they need.
    ``path``: a folder in which the chunks stay; else they go to the shared folder until the driver ends.
    """

    def __init__(self, docs: DataFrame, prepare: Callable[[Chunk], bytes], texts: bool = True, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES, path: str | None = None):
        bounded_batches(docs.sparkSession)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_bytes"))

        def run(batches):
            for chunk in _cut(batches, chunk_bytes):
                yield chunk.packed(prepare(chunk), texts)

        packed = rows.mapInArrow(released(run), PACKED)
        if path:
            packed.write.option("compression", "zstd").parquet(path)
        self.table = docs.sparkSession.read.schema(PACKED).parquet(path) if path else materialize(packed, "packed")
        total = self.table.agg(F.sum("n_bytes")).first()[0] or 0
        self.shards = max(8, -(-total // shard_bytes))

    def ask(self, question: Callable[[Chunk], Iterable[tuple[int, int, bytes]]]) -> DataFrame:
        """BLOCK rows of every chunk: ``question`` gives (shard, kind, payload) from its notes."""

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    if rows := [(shard, row["chunk"], kind, payload) for shard, kind, payload in question(Chunk.unpack(row))]:
                        yield _blocks(rows)

        return self.table.select("chunk", "notes").mapInArrow(released(run), BLOCK)

    def answer(self, blocks: DataFrame, resolve: Callable[[list[dict]], Iterable[tuple[bytes, int, bytes]]]) -> DataFrame:
        """Each shard's blocks, ordered by chunk, to (chunk, kind, payload)."""

        def run(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["chunk"]))
            shard = rows[0]["shard"]
            made = pa.Table.from_batches([_blocks([(shard, *r) for r in resolve(rows)])])
            release()
            return made

        return blocks.groupBy("shard").applyInArrow(run, BLOCK)

    def meet(self, answers: DataFrame, use: Callable[[Chunk, list[dict]], pa.Table], schema: str) -> DataFrame:
        """Each chunk with its answers, ordered by shard and kind."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                raise RuntimeError("answers without their chunk")
            got: dict[tuple[int, int], dict] = {}
            for r in right.to_pylist():  # equal chunks have equal questions and get equal answers
                got[r["shard"], r["kind"]] = r
            rows = [got[k] for k in sorted(got)]
            made = use(Chunk.unpack(left.slice(0, 1).to_pylist()[0]), rows)
            release()
            return pa.concat_tables([made] * left.num_rows)

        return self.table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


class RunIndex:
    """Sorted immutable runs of keys with a value each; ``join`` combines the values of equal keys.

    A new run is merged with the last one while that is less than twice its
    size, so that there are logarithmically many runs and each key is moved
    logarithmically often.
    """

    def __init__(self, join: np.ufunc):
        self.join, self.levels = join, []

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        run = self._unique(keys[order], values[order])
        while self.levels and len(self.levels[-1][0]) < 2 * len(run[0]):
            run = self._merged(self.levels.pop(), run)
        self.levels.append(run)

    def _unique(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = runs(keys)
        return keys[first], self.join.reduceat(values, first) if len(first) else values

    def _merged(self, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        keys, values = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(keys, kind="stable")
        return self._unique(keys[order], values[order])

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        while len(self.levels) > 1:
            b = self.levels.pop()
            self.levels.append(self._merged(self.levels.pop(), b))
        return self.levels[0] if self.levels else (np.zeros(0), np.zeros(0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all in the index."""
        held, values = self.compact()
        return values[np.searchsorted(held, keys)]


def first_of(keys: np.ndarray, values: np.ndarray, join: np.ufunc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys, their joined values, and each entry's place among them."""
    order = np.argsort(keys, kind="stable")
    first = runs(keys[order])
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
    return keys[order][first], join.reduceat(values[order], first) if len(first) else values, place


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(shards)).astype(np.int64)


def dealt(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of the shards that have entries."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    first = runs(shard[order])
    for a, b in zip(first, np.r_[first[1:], len(order)], strict=True):
        yield int(shard[order[a]]), order[a:b]


def answers_of(rows: list[dict], kind: int) -> dict[int, bytes]:
    return {r["shard"]: r["payload"] for r in rows if r["kind"] == kind}


def answered_bits(rows: dict[int, bytes], shard: np.ndarray) -> np.ndarray:
    """The bits that shards answered for entries dealt by ``shard``."""
    out = np.zeros(len(shard), bool)
    for s, at in dealt(shard):
        if s not in rows:
            raise RuntimeError("a chunk without its answers")
        out[at] = unpacked_bits(rows[s], len(at))
    return out


def keys_with_bits(keys: np.ndarray, bits: np.ndarray) -> bytes:
    """n 64-bit keys and a bit each: n / 8 bytes and 8 n."""
    return np.packbits(bits).tobytes() + keys.tobytes()


def read_keys_with_bits(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(payload) * 8 // 65
    bits = np.frombuffer(payload, np.uint8, len(payload) - 8 * n)
    return np.frombuffer(payload, "<u8", n, len(bits)), np.unpackbits(bits, count=n).astype(bool)


def blocks_table(rows: list[tuple[int, bytes, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_blocks(rows)])


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Places 0 .. n-1 within ``width`` of a start."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge)[:n] > 0


def packed_bits(bits: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.packbits(bits).tobytes(), 1)


def unpacked_bits(payload: bytes, n: int) -> np.ndarray:
    import zstandard

    return np.unpackbits(np.frombuffer(zstandard.decompress(payload, max_output_size=n // 8 + 1), np.uint8), count=n).astype(bool)
