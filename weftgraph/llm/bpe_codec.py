"""Operator 5: BPE encoding and decoding with forced-boundary splitting.

A merge only ever makes a vocabulary token.  Two neighbouring bytes that stand
side by side inside no token can therefore never end in one symbol: between them
lies a certain cut.  Pre-tokens are cut there, the fragments are encoded on
their own, many at a time, and their ids are concatenated; a table bounded in
words and their length keeps the codes of words.

Text between white space is the unit that is normalised (NFC, lower case) and
pre-tokenised, since none of these steps looks across white space.

Per document, Arrow batches, no shuffle.  Defined results: null is the empty
text (no ids); special strings inside a text become their own id, as the
library takes them; a text of any length is encoded whole; repeated rows get
equal results; other columns pass through, result columns replace input columns
of the same name, no other name clashes; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, documents, released, tucked
from .token_counts import ArrayMerger, byte_symbols, merge_pairs

MEMO = 1 << 18  # words whose codes a worker keeps
KEPT = 64  # characters of such a word at most
LEFT = 1 << 16  # words that may stay when a task ends
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Codec:
    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.merger = ArrayMerger([(vocab[a], vocab[b], vocab[a + b]) for a, b in merge_pairs(spec)], max(vocab.values()) + 1)
        self.token = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.number = {i: str(i) for i in self.token}
        symbols = byte_symbols()
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[symbols[b] + self.end] for b in range(256)], np.int64)
        byte_of = {c: b for b, c in symbols.items()}
        inside = {p for t in vocab for p in pairwise(t.removesuffix(self.end))}
        #: joined[a, b]: some token holds byte b right after byte a
        self.joined = np.zeros((256, 256), bool)
        for a, b in inside:
            self.joined[byte_of[a], byte_of[b]] = True
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.pieces = regex.compile(PATTERN).findall
        self.space = regex.compile(r"\p{White_Space}+").split
        self.odd = regex.compile("[\x1c-\x1f]").search  # white space to str.split, not to the vocabulary
        self.ids: dict[str, str] = {}  # word -> its ids, joined by a space
        self.text: dict[str, str] = {}  # word -> its tokens, joined by a space

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after the other, and where each pre-token's begin and end."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = np.cumsum(length)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbol = self.inner[raw]
        symbol[end - 1] = self.last[raw[end - 1]]
        cut = np.ones(len(raw) + 1, bool)
        cut[1:-1] = ~self.joined[raw[:-1], raw[1:]]  # certain cuts
        cut[end] = True
        left = self.merger.settle(symbol, np.diff(np.flatnonzero(cut)))
        return left[left >= 0], np.r_[0, np.cumsum(left >= 0)[end - 1]]

    def learn(self, new: list[str]) -> None:
        """Put the codes of words not met before into the table."""
        whole = " ".join(new)
        pieces = self.pieces(whole)
        ids, bound = self.encode([x.encode() for x in pieces])
        end = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        stop = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        bound = bound[np.r_[0, np.searchsorted(end, stop, "left") + 1]].tolist()
        number, token = self.number, self.token
        listed = ids.tolist()
        for word, (a, b) in zip(new, pairwise(bound), strict=True):
            own = listed[a:b]
            self.ids[word] = " ".join([number[i] for i in own])
            self.text[word] = " ".join([token[i] for i in own])

    def words(self, text: str) -> list[str]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()
        return [w for w in self.space(text) if w] if self.odd(text) else text.split()

    def code(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(tokens, ids joined by a space, decoded text) of each text."""
        cut = [self._marked(t) if "<|" in t else self.words(t) for t in texts]
        if len(self.ids) > MEMO:
            self.ids.clear()
            self.text.clear()
        for content, i in self.special.items():
            self.ids["\x1c" + content], self.text["\x1c" + content] = str(i), content
        new = set().union(*cut).difference(self.ids)
        closed = [w for w in new if w[-1] in ",." and w[-2:-1].isalpha()]  # a word and a point are two pre-tokens
        bare = list(new.difference(closed).union([w[:-1] for w in closed], ",.").difference(self.ids))
        for k in range(0, len(bare), 65536):
            self.learn(bare[k : k + 65536])
        for w in closed:
            self.ids[w] = f"{self.ids[w[:-1]]} {self.ids[w[-1]]}"
            self.text[w] = f"{self.text[w[:-1]]} {self.text[w[-1]]}"
        ids, decoded, out = self.ids.__getitem__, self.text.__getitem__, []
        for words in cut:
            joined = " ".join(map(ids, words))
            out.append((joined.count(" ") + 1 if joined else 0, joined, " ".join(map(decoded, words))))
        for w in [w for w in new.union(bare) if len(w) > KEPT]:
            self.ids.pop(w, None)
            self.text.pop(w, None)
        return out

    def forget(self, most: int) -> None:
        """Empty the table if it has more than ``most`` words."""
        if len(self.ids) > most:
            self.ids, self.text = {}, {}

    def _marked(self, text: str) -> list[str]:
        """Words, with special strings found first and marked by a character that no word here begins with."""
        out: list[str] = []
        for k, part in enumerate(self.cut_special(text)):
            out += ["\x1c" + part] if k % 2 else self.words(part)
        return out


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_codes(docs: DataFrame, path: str, carry: list[str] | None = None, texts: bool = True) -> DataFrame:
    """``docs`` (text, ...) plus n_tokens, ids_sha256, decoded_sha256 and, with ``texts``, the ids and the decoded text."""
    if carry is None:
        packed, out = tucked(docs, "text")
        return out(bpe_codes(packed, path, packed.columns, texts), "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if texts else []))
    bounded_batches(docs.sparkSession)
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if texts:
        made += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    taken = {f.name for f in made} | {"_text"}
    through = [c for c in carry if c.lower() not in taken]
    rows = docs.select(*[F.col(f"`{c}`") for c in through], F.coalesce(F.col("text"), F.lit("")).alias("_text"))

    def sha(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        code = own.code
        for batch in batches:
            coded = code(batch["_text"].to_pylist())
            at = batch.schema.get_field_index("_text")
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [x for i, x in enumerate(batch.schema.names) if i != at]
            result = [pa.array([n for n, _, _ in coded], pa.int64()), pa.array([sha(x) for _, x, _ in coded]), pa.array([sha(x) for _, _, x in coded])]
            if texts:
                result += [pa.array([list(map(int, x.split())) for _, x, _ in coded], pa.list_(pa.int32())), pa.array([x for _, _, x in coded])]
            yield pa.RecordBatch.from_arrays(columns + [r.cast(pa.string()) if pa.types.is_null(r.type) else r for r in result], names + [f.name for f in made])
        own.forget(LEFT)

    return rows.mapInArrow(released(run), T.StructType([rows.schema[c] for c in through] + made))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_codes(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"], texts=False)
