"""Operator 7: token counts by rank-synchronous array merging.

The texts of a batch are cut into pre-tokens.  Those not met before are held as
one ragged numpy array of symbols; in each step every sequence finds its
lowest-rank adjacent pair and all sequences apply theirs at once, until none has
a pair with a rank.  What survives is counted.  A table bounded in pre-tokens and
their length keeps the counts of those already met.

Applying all places of a sequence's pair in one step equals the one-by-one order
if no two merges make the same token: a pair with the new symbol then has a
higher rank.  Loading checks that and otherwise applies the leftmost place only.

Per document, Arrow batches, no shuffle.  Defined results: null is the empty
text, 0 tokens; special strings inside a text are one token each, as the library
takes them; repeated rows get equal results; other columns pass through, result
columns replace input columns of the same name, no other name clashes; empty
tables give empty tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, documents, released, tucked

LIMIT = 1024
MEMO = 1 << 19  # pre-tokens, and texts between spaces, whose counts a worker keeps
KEPT = 64  # characters of such a text at most
LEFT = 1 << 16  # of either that may stay when a task ends
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STEP_SYMBOLS = 1 << 20  # symbols merged at a time
UNEVEN = 1 << 50  # stands for the count of what can't be cut at spaces
NONE = np.int64(1 << 40)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ArrayMerger:
    """Merge rules as arrays: pairs' packed ids to ranks, ranks to what they make."""

    def __init__(self, merges: list[tuple[int, int, int]], size: int):
        """``merges``: (left id, right id, made id) in rank order; ids are below ``size``."""
        left, right, made = np.array(merges, np.int64).T
        self.size, self.made = size, made
        self.levels = self._table(left * size + right)
        self.all_places = len(np.unique(made)) == len(made)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE without one: probes of a table whose collisions went to further levels."""
        want = left * self.size + right
        out = np.full(len(want), NONE)
        open_ = np.arange(len(want))
        for keys, ranks, more in self.levels:
            asked = want[open_]
            at = self._slot(asked, len(keys))
            hit = keys[at] == asked
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit & more[at]]
            if not len(open_):
                break
        return out

    @staticmethod
    def _slot(packed: np.ndarray, n: int) -> np.ndarray:
        return ((packed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)

    def _table(self, packed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        levels, left = [], np.arange(len(packed))
        while len(left):
            n = 1 << max(4, (4 * len(left)).bit_length() + len(levels) % 2)
            keys, ranks, more = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            at = self._slot(packed[left], n)
            _, first = np.unique(at, return_index=True)
            keys[at[first]], ranks[at[first]] = packed[left[first]], left[first]
            rest = np.delete(np.arange(len(left)), first)
            more[at[rest]] = True
            levels.append((keys, ranks, more))
            left = left[rest]
        return levels

    def settle(self, symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Merge ragged sequences of the given lengths; the symbols left stand at their first place, -1 elsewhere."""
        final = np.full(len(symbol), -1, np.int64)
        owner, place = np.repeat(np.arange(len(length)), length), np.arange(len(symbol))
        rank = self._pair_ranks(symbol, owner)
        while len(symbol):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[start, len(symbol)])
            best = np.minimum.reduceat(rank, start)
            live = best < NONE
            if not live.all():  # sequences without a pair leave
                keep = np.repeat(live, size)
                final[place[~keep]] = symbol[~keep]
                symbol, owner, rank, place = symbol[keep], owner[keep], rank[keep], place[keep]
                best, size = best[live], size[live]
            hit = np.flatnonzero(rank == np.repeat(best, size))
            if not len(hit):
                break
            if self.all_places:
                hit = self._apart(hit)
            else:
                hit = hit[np.r_[True, owner[hit][1:] != owner[hit][:-1]]]
            symbol[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[hit] = True
            symbol, owner, rank, place, changed = symbol[keep], owner[keep], rank[keep], place[keep], changed[keep]
            near = np.flatnonzero(changed | np.r_[changed[1:], False])  # pairs that have a new symbol
            rank[near] = self._pair_ranks(symbol, owner, near)
        return final

    @staticmethod
    def _apart(hit: np.ndarray) -> np.ndarray:
        """Of overlapping places (runs of neighbours, as in aaaa) every other one from the left."""
        run = np.cumsum(np.r_[True, hit[1:] != hit[:-1] + 1]) - 1
        first = hit[np.r_[True, hit[1:] != hit[:-1] + 1]]
        return hit[(hit - first[run]) % 2 == 0]

    def _pair_ranks(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The rank of the pair that starts at each place, or at the places ``at``."""
        at = np.arange(len(symbol)) if at is None else at
        out = np.full(len(at), NONE)
        inside = np.flatnonzero(at < len(symbol) - 1)
        inside = inside[owner[at[inside]] == owner[at[inside] + 1]]
        out[inside] = self.ranks(symbol[at[inside]], symbol[at[inside] + 1])
        return out


def merge_pairs(spec: dict) -> list[tuple[str, str]]:
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]


class Counter:
    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        self.merger = ArrayMerger([(vocab[a], vocab[b], vocab[a + b]) for a, b in merge_pairs(spec)], max(vocab.values()) + 1)
        self.byte_id = np.array([vocab[c] for _, c in sorted(byte_symbols().items())], np.int64)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.cut = regex.compile(PATTERN).findall
        self.memo: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.long: list[str] = []  # in the tables for this batch only

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stand between them."""
        if self.special is None or "<|" not in text:
            return self.cut(text), 0
        parts = self.special.split(text)
        return [w for p in parts for w in self.cut(p)], len(parts) - 1

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        out, end, k = np.zeros(len(words), np.int64), np.cumsum(length), 0
        while k < len(words):
            last = max(k + 1, int(np.searchsorted(end, (end[k - 1] if k else 0) + STEP_SYMBOLS, "right")))
            size = length[k:last]
            left = self.merger.settle(self.byte_id[np.frombuffer(b"".join(words[k:last]), np.uint8)], size) >= 0
            out[k:last] = np.add.reduceat(left, np.cumsum(size) - size)
            k = last
        return out

    def _new(self, words: list[str]) -> None:
        """Put the counts of pre-tokens not met before into the memo."""
        new = list(dict.fromkeys(w for w in words if w not in self.memo))
        self.long += [w for w in new if len(w) > KEPT]
        self.memo.update(zip(new, self.counts([w.encode() for w in new]).tolist(), strict=True))

    def _of(self, cuts: list[list[str]]) -> list[int]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        self._new([w for words in cuts for w in words])
        return [sum(map(self.memo.__getitem__, words)) for words in cuts]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text.

        Where all its spaces stand single between other characters, a text is
        cut at them first: what stands between two never depends on what is
        beyond, so that its count, with the space before it, is kept as well.
        """
        split = [[] if "<|" in t else t.split(" ") for t in texts]
        if len(self.spaced) > MEMO:
            self.spaced.clear()
        self._new_spaced(list(set().union(*split).difference(self.spaced)))
        of, out, other = self.spaced.__getitem__, [], []
        for i, parts in enumerate(split):
            n = sum(map(of, parts)) if parts else UNEVEN
            if n < UNEVEN:
                n -= of(parts[0])  # it has no space before it
            else:
                other.append(i)
            out.append(n)
        plain = [i for i, n in enumerate(out) if n < UNEVEN]
        for i, n in zip(plain, self._of([self.cut(split[i][0]) for i in plain]), strict=True):
            out[i] += n
        cuts = [self.pieces(texts[i]) for i in other]
        for i, n, (_, special) in zip(other, self._of([words for words, _ in cuts]), cuts, strict=True):
            out[i] = n + special
        for w in self.long:
            self.memo.pop(w, None)
            self.spaced.pop(w, None)
        self.long = []
        return out

    def forget(self, most: int) -> None:
        """Empty the tables if one has more than ``most`` entries."""
        if max(len(self.memo), len(self.spaced)) > most:
            self.memo, self.spaced = {}, {}

    def _new_spaced(self, new: list[str]) -> None:
        self.long += [x for x in new if len(x) > KEPT]
        even = [x for x in new if x and not x[0].isspace() and not x[-1].isspace()]
        self.spaced.update(dict.fromkeys(new, UNEVEN))
        if even:
            pieces = self.cut(" " + " ".join(even))
            end = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            begin = np.cumsum(np.fromiter(map(len, even), np.int64, len(even)) + 1)
            first = np.searchsorted(end, np.r_[0, begin[:-1]], "right")
            tokens = np.add.reduceat(self.counts([x.encode() for x in pieces]), first)
            self.spaced.update(zip(even, tokens.tolist(), strict=True))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (text, ...) plus n_bytes, n_tokens, over_limit."""
    if carry is None:
        packed, out = tucked(docs, "text")
        return out(token_counts(packed, path, limit, packed.columns), "n_bytes", "n_tokens", "over_limit")
    bounded_batches(docs.sparkSession)
    made = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    taken = {f.name for f in made} | {"_text"}
    through = [c for c in carry if c.lower() not in taken]
    rows = docs.select(*[F.col(f"`{c}`") for c in through], F.coalesce(F.col("text"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        count = own.count
        for batch in batches:
            texts = batch["_text"].to_pylist()
            n = count(texts)
            at = batch.schema.get_field_index("_text")
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [x for i, x in enumerate(batch.schema.names) if i != at]
            result = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns + result, names + [f.name for f in made])
        own.forget(LEFT)

    return rows.mapInArrow(released(run), T.StructType([rows.schema[c] for c in through] + made))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), carry=["doc_id"])
