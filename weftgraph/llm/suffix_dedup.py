"""Operator 4: exact substring dedup of bytes with per-shard suffix arrays.

Each window of WIDTH bytes has an anchor, the least hash of its GRAM-byte grams.
Equal windows have equal anchors, and neighbouring windows mostly share theirs,
so that a text falls into stretches of windows with one anchor.  A first
exchange finds which anchors stand in one place only; their windows can't
repeat.  The other stretches go to the shard of their anchor, where all windows
that could be equal meet.  There a suffix array is sorted (Larsson-Sadakane),
common prefixes are found (Kasai), and a window repeats if it shares WIDTH bytes
with a neighbour in the array.

An anchor in more than HOT places is split into up to PARTS sub-shards by the
stretches' bytes, each with a suffix array of its own.  Each pair of sub-shards
is merged in a task of its own, by binary search of the one's windows in the
other's suffix array.  The pairs would grow with the square of the places;
beyond HOT * PARTS places, an anchor's windows are therefore dealt one by one,
by a 128-bit hash of their bytes, and repeat if that hash is met twice.  Such
entries fall evenly on the shards whatever passage is common.

The anchors are found once, when the chunks are packed, and kept with them.
Stretches, and windows dealt one by one, are asked once a chunk if their bytes
are equal, with a mark if they stand there twice.

Defined results: null and empty texts have 0 bytes; texts of fewer bytes than
WIDTH keep all; rows may repeat, their windows then stand elsewhere; null
doc_ids are texts like any other; empty tables give empty tables; of other
columns none is carried, whatever its name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import documents
from .blocks import Chunk, Exchange, blocks_table, cover, dealt, first_of, mixed, packed_bits, runs, shard_of, sliding_min, unpacked_bits
from .suffix_arrays import SuffixArray

WIDTH = 400
GRAM = 64
HOT = 4096  # places of an anchor in one sub-shard
PARTS = 4  # sub-shards of an anchor at most
ONE_BY_ONE = 65535  # stands for the number of sub-shards where windows are dealt one by one
FINE = 8  # for those, so many times as many shards
BATCH = 2 << 20  # bytes in one suffix array, unless one anchor has more
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text binary, kept_sha256 string"

_BYTE = np.random.default_rng(7).integers(1, 1 << 63, (3, 256), np.int64).astype(np.uint64)
_DIGEST = np.dtype("S16")  # sorts and compares faster than a pair of integers


class Stretches:
    """The stretches of a chunk's texts: windows side by side that have one anchor."""

    def __init__(self, start: np.ndarray, windows: np.ndarray, anchor: np.ndarray, places: np.ndarray):
        """``places``: in how many places of the chunk each distinct anchor's gram stands."""
        self.start, self.windows, self.anchor, self.places = start, windows, anchor, places
        self.distinct, self.which = np.unique(anchor, return_inverse=True)

    @classmethod
    def find(cls, texts: list[bytes], width: int) -> Stretches:
        size = np.array([len(t) for t in texts], np.int64)
        text = b"".join(texts)
        grams = min(GRAM, width)
        anchor, gram = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(text) >= width:
            gram = mixed(_rolling(_BYTE[0][np.frombuffer(text, np.uint8)], grams))
            anchor = sliding_min(gram, width - grams + 1)
        count = np.maximum(size - width + 1, 0)
        window = np.arange(count.sum()) + np.repeat(np.cumsum(size) - size - (np.cumsum(count) - count), count)  # starts
        owner = np.repeat(np.arange(len(size)), count)
        own = anchor[window]
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])]) if len(own) else np.zeros(0, np.int64)
        return cls(window[first], np.diff(np.r_[first, len(own)]), own[first], cls._places(np.unique(own[first]), gram))

    @staticmethod
    def _places(distinct: np.ndarray, gram: np.ndarray) -> np.ndarray:
        if not len(distinct):
            return np.zeros(0, np.int64)
        low = np.uint64((1 << 20) - 1)
        maybe = np.zeros(1 << 20, bool)
        maybe[(distinct & low).astype(np.int64)] = True
        some = gram[maybe[(gram & low).astype(np.int64)]]
        at = np.minimum(np.searchsorted(distinct, some), len(distinct) - 1)
        return np.bincount(at[distinct[at] == some], minlength=len(distinct))

    def packed(self) -> bytes:
        sizes = np.array([len(self.start), len(self.distinct)], np.int64)
        return b"".join(x.tobytes() for x in (sizes, self.start, self.windows.astype(np.int32), self.anchor, np.minimum(self.places, 65535).astype(np.uint16)))

    @classmethod
    def unpack(cls, raw: bytes) -> Stretches:
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        start, windows, anchor = np.frombuffer(raw, np.int64, n, 16), np.frombuffer(raw, np.int32, n, 16 + 8 * n), np.frombuffer(raw, np.uint64, n, 16 + 12 * n)
        return cls(start, windows.astype(np.int64), anchor, np.frombuffer(raw, np.uint16, m, 16 + 20 * n))


def _rolling(symbols: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of each ``width`` neighbouring symbols, by doubling."""
    out, have = symbols, 1
    while have < width:
        step = min(have, width - have)
        out = out[: len(out) - step] * np.uint64(pow(0x9E3779B97F4A7C15, step, 1 << 64)) + out[step:]
        have += step
    return out


def _task(anchor: int, a: int, b: int) -> int:
    """The name of a task for a pair of an anchor's sub-shards, beyond all shards' numbers.

    Two tasks that come to one name are worked on together: more is compared, nothing lost.
    """
    return 1 << 62 | int.from_bytes(hashlib.blake2b(b"%d %d %d" % (anchor, a, b), digest_size=8).digest(), "little") >> 2


OWN, LEFT, RIGHT, NOTE, SINGLE = range(1, 6)  # kinds of blocks: of one shard; the sides of a pair; a chunk's own note; windows


class Plan:
    """What a chunk asks of which shard, in order; made the same way before and after."""

    def __init__(self, chunk: Chunk, parts: Stretches, split: np.ndarray, shards: int, width: int):
        """``split``: for each distinct anchor 0 (one place), the number of its sub-shards, or ONE_BY_ONE."""
        self.members: list[list[int]] = []  # stretches of each distinct one
        self.string: list[bytes] = []
        self.anchor: list[int] = []
        self.ask: dict[tuple[int, int], list[int]] = {}  # (shard, kind) -> distinct stretches
        self.single: list[int] = []  # distinct stretches whose windows are dealt one by one
        known: dict[bytes, int] = {}
        many = split[parts.which] if len(parts.which) else split
        home, text = shard_of(parts.anchor, shards), b"".join(chunk.texts)
        for k in np.flatnonzero(many).tolist():
            s = text[parts.start[k] : parts.start[k] + parts.windows[k] + width - 1]
            if (d := known.get(s)) is not None:
                self.members[d].append(k)
                continue
            d = known[s] = len(self.string)
            self.members.append([k])
            self.string.append(s)
            self.anchor.append(int(parts.anchor[k]))
            if many[k] == ONE_BY_ONE:
                self.single.append(d)
            else:
                for where in self._tasks(int(parts.anchor[k]), s, int(many[k]), int(home[k])):
                    self.ask.setdefault(where, []).append(d)
        self._windows(shards, width)

    @staticmethod
    def _tasks(anchor: int, s: bytes, split: int, home: int) -> list[tuple[int, int]]:
        if split == 1:
            return [(home, OWN)]
        own = int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little") % split
        return [(_task(anchor, min(own, k), max(own, k)), OWN if own == k else LEFT if own < k else RIGHT) for k in range(split)]

    def _windows(self, shards: int, width: int) -> None:
        """Distinct hashes of the windows dealt one by one, whether each stands twice here, and each window's place among them."""
        joined = np.frombuffer(b"".join(self.string[d] for d in self.single), np.uint8)
        count = np.array([len(self.string[d]) - width + 1 for d in self.single], np.int64)
        self.count = count
        if not len(count):
            self.hash, self.twice, self.place, self.shard = np.zeros(0, _DIGEST), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        at = np.arange(count.sum()) + np.repeat(np.cumsum(count + width - 1) - (count + width - 1) - (np.cumsum(count) - count), count)
        both = np.stack([mixed(_rolling(_BYTE[k][joined], width)[at]) for k in (1, 2)], axis=1)
        times = np.repeat([len(self.members[d]) for d in self.single], count)
        self.hash, times, self.place = first_of(np.ascontiguousarray(both).view(_DIGEST).ravel(), times, np.add)
        self.twice = times > 1
        self.shard = shards + shard_of(np.ascontiguousarray(self.hash).view("<u8")[::2], FINE * shards)

    def blocks(self, name: bytes):
        for (s, kind), asked in self.ask.items():
            yield s, name, kind, _packed(self, asked)
        for s, at in dealt(self.shard):
            yield s, name, SINGLE, packed_bits(self.twice[at]) + self.hash[at].tobytes()

    def found(self, answers: list[dict], width: int) -> list[np.ndarray]:
        """Which windows of each distinct stretch repeat."""
        got = {(r["shard"], r["kind"]): r["payload"] for r in answers}
        bits = [np.zeros(len(s) - width + 1, bool) for s in self.string]
        for where, asked in self.ask.items():
            found, at = unpacked_bits(got[where], sum(len(bits[d]) for d in asked)), 0
            for d in asked:
                bits[d] |= found[at : at + len(bits[d])]
                at += len(bits[d])
        if self.single:
            again = np.zeros(len(self.hash), bool)
            for s, at in dealt(self.shard):
                again[at] = unpacked_bits(got[s, SINGLE], len(at))
            for d, own in zip(self.single, np.split(again[self.place], np.cumsum(self.count)[:-1]), strict=True):
                bits[d] = own
        return bits


def _packed(plan: Plan, asked: list[int]) -> bytes:
    import zstandard

    strings = [plan.string[d] for d in asked]
    head = np.array([len(asked)] + [len(s) for s in strings], np.int64).tobytes()
    head += np.array([plan.anchor[d] for d in asked], np.uint64).tobytes() + bytes(len(plan.members[d]) > 1 for d in asked)
    return zstandard.compress(head + b"".join(strings), 3)


def _unpacked(payload: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.decompress(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    size = np.frombuffer(raw, np.int64, n, 8)
    anchor = np.frombuffer(raw, np.uint64, n, 8 + 8 * n)
    twice = np.frombuffer(raw, np.uint8, n, 8 + 16 * n).astype(bool)
    end = np.cumsum(size) + 8 + 17 * n
    return [raw[a:b] for a, b in zip((end - size).tolist(), end.tolist(), strict=True)], anchor, twice


class Shard:
    """Distinct stretches of one side of a task, and which of their windows repeat."""

    def __init__(self, width: int):
        self.width, self.number, self.string, self.anchor, self.twice = width, {}, [], [], []

    def add(self, strings: list[bytes], anchor: np.ndarray, twice: np.ndarray) -> list[int]:
        out = []
        for s, a, t in zip(strings, anchor.tolist(), twice.tolist(), strict=True):
            k = self.number.setdefault(s, len(self.string))
            if k == len(self.string):
                self.string.append(s)
                self.anchor.append(a)
                self.twice.append(t)
            else:
                self.twice[k] = True
            out.append(k)
        return out

    def settle(self) -> None:
        self.bits = [np.full(len(s) - self.width + 1, t) for s, t in zip(self.string, self.twice, strict=True)]

    def batches(self, all_: bool):
        """Whole anchors, up to BATCH bytes; unless ``all_``, without those whose only stretch is known to repeat."""
        if not self.string:
            return
        anchor = np.array(self.anchor, np.uint64)
        order = np.argsort(anchor, kind="stable")
        first = runs(anchor[order])
        batch, size = [], 0
        for a, b in zip(first, np.r_[first[1:], len(order)], strict=True):
            own = order[a:b].tolist()
            if not all_ and len(own) == 1 and self.twice[own[0]]:
                continue
            more = sum(len(self.string[k]) for k in own)
            if batch and size + more > BATCH:
                yield batch
                batch, size = [], 0
            batch += own
            size += more
        if batch:
            yield batch

    def mark(self, batch: list[int], found: np.ndarray) -> None:
        at = 0
        for k in batch:
            n = len(self.bits[k])
            self.bits[k] |= found[at : at + n]
            at += n


def _singles(blocks: list[dict]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """(chunk, hashes, whether each stands twice there); the bits come compressed, before n hashes of 16 bytes."""
    import zstandard

    out = []
    for b in blocks:
        reader = zstandard.ZstdDecompressor().decompressobj()
        raw = np.frombuffer(reader.decompress(b["payload"]), np.uint8)
        rest = reader.unused_data
        out.append((b["chunk"], digests := np.frombuffer(rest, _DIGEST), np.unpackbits(raw, count=len(digests)).astype(bool)))
    return out


def suffix_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_text (bytes), kept_sha256."""
    exchange = Exchange(docs, lambda chunk: Stretches.find(chunk.texts, width).packed())
    shards, hot, parts_most = exchange.shards, HOT, PARTS

    def ask_anchors(chunk: Chunk):
        parts = Stretches.unpack(chunk.notes)
        for s, at in dealt(shard_of(parts.distinct, shards)):
            yield s, 0, parts.distinct[at].tobytes() + parts.places[at].tobytes()

    def resolve_anchors(blocks: list[dict]):
        asked = [(np.frombuffer(b["payload"], np.uint64, n := len(b["payload"]) // 10), np.frombuffer(b["payload"], np.uint16, n, 8 * n)) for b in blocks]
        keys, number = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
        places = np.bincount(number, np.concatenate([p for _, p in asked])).astype(np.int64)
        cut = -(-places // hot)
        split = np.where(places < 2, 0, np.where(cut > parts_most, ONE_BY_ONE, cut)).astype(np.uint16)
        for b, (k, _) in zip(blocks, asked, strict=True):
            yield b["chunk"], 0, split[np.searchsorted(keys, k)].tobytes()

    def splits(parts: Stretches, answers: list[dict]) -> np.ndarray:
        got = {r["shard"]: r["payload"] for r in answers if r["kind"] == 0}
        out = np.zeros(len(parts.distinct), np.int64)
        for s, at in dealt(shard_of(parts.distinct, shards)):
            if s not in got:
                raise RuntimeError("a chunk without its answers")
            out[at] = np.frombuffer(got[s], np.uint16)
        return out

    def ask_stretches(chunk: Chunk, answers: list[dict]) -> pa.Table:
        import zstandard

        parts = Stretches.unpack(chunk.notes)
        split = splits(parts, answers)
        out = list(Plan(chunk, parts, split, shards, width).blocks(chunk.name))
        if len(split):
            out.append((int.from_bytes(chunk.name[:6], "big") % shards, chunk.name, NOTE, zstandard.compress(split.astype(np.uint16).tobytes(), 3)))
        return blocks_table(out)

    def resolve_stretches(blocks: list[dict]):
        sides, asked = {kind: Shard(width) for kind in (OWN, LEFT, RIGHT)}, []
        for b in blocks:
            if b["kind"] == NOTE:  # on its way
                yield b["chunk"], NOTE, b["payload"]
            elif b["kind"] != SINGLE:
                asked.append((b["chunk"], b["kind"], sides[b["kind"]].add(*_unpacked(b["payload"]))))
        for side in sides.values():
            side.settle()
        own, left, right = sides.values()
        for batch in own.batches(False):
            own.mark(batch, SuffixArray([own.string[k] for k in batch]).repeated(width))
        others = [(other, SuffixArray([right.string[k] for k in other])) for other in right.batches(True)]
        for batch in left.batches(True):
            a = SuffixArray([left.string[k] for k in batch])
            for other, b in others:
                left.mark(batch, a.found_in(b, width))
                right.mark(other, b.found_in(a, width))
        for chunk, kind, mine in asked:
            yield chunk, kind, packed_bits(np.concatenate([sides[kind].bits[k] for k in mine]))
        if singles := _singles([b for b in blocks if b["kind"] == SINGLE]):
            keys, number = np.unique(np.concatenate([k for _, k, _ in singles]), return_inverse=True)
            again = np.bincount(number, np.concatenate([t for _, _, t in singles]) + 1) > 1
            for chunk, mine, _ in singles:
                yield chunk, SINGLE, packed_bits(again[np.searchsorted(keys, mine)])

    def remove(chunk: Chunk, answers: list[dict]) -> pa.Table:
        import zstandard

        parts = Stretches.unpack(chunk.notes)
        size = [len(t) for t in chunk.texts]
        gone = np.zeros(sum(size), bool)  # windows, at their starts
        if len(parts.distinct):
            note = [r["payload"] for r in answers if r["kind"] == NOTE]
            if len(note) != 1:
                raise RuntimeError("a chunk without its answers")
            plan = Plan(chunk, parts, np.frombuffer(zstandard.decompress(note[0]), np.uint16).astype(np.int64), shards, width)
            for members, bits in zip(plan.members, plan.found(answers, width), strict=True):
                for k in members:
                    gone[parts.start[k] : parts.start[k] + parts.windows[k]] |= bits if len(members) == 1 else True
        out, a = [], 0
        for i, t in zip(chunk.ids, chunk.texts, strict=True):
            own = gone[a : a + len(t)]
            a += len(t)
            if not own.any():
                out.append((i, len(t), 0, 0, t, hashlib.sha256(t).hexdigest()))
                continue
            covered = cover(np.flatnonzero(own), width, len(t))
            kept = np.frombuffer(t, np.uint8)[~covered].tobytes()
            spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
            out.append((i, len(t), int(covered.sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256"])

    first = exchange.answer(exchange.ask(ask_anchors), resolve_anchors)
    stretches = exchange.meet(first, ask_stretches, "shard long, chunk binary, kind int, payload binary")
    return exchange.meet(exchange.answer(stretches, resolve_stretches), remove, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
