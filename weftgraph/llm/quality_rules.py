"""Operator 3: quality rules by compression bands.

A text's bytes over its zstandard frame's is low for noise (keys, base64, random
printable characters) and high for repetition.  It grows with length, so the
limits are given for classes of length; the lower ones lie between base64, also
in words, and clean text, which is nearer to them the shorter it is.  Scripts of
two or three bytes a character have few repeats of bytes and lower limits of
their own.  Noise of fewer than 256 bytes and noise of few different characters
(hexadecimal digits, shuffled letters) compress like clean text and are not told
apart.  The whole
document is held against its class, and every full chunk of CHUNK bytes, with
the last CHUNK bytes, against one band, which finds a long text that is junk in
part; more than CHUNK_SHARE of its chunks must be outside.
The base counts (words, symbols, repeated lines and 5-word windows) come with
it; ``base_failed`` documents are rejected whatever their ratio.

Per document, Arrow batches, no shuffle.  Defined results: null and empty texts
have no words and fail the base rule; ratios at a limit are inside it; a text of
any length is measured whole; repeated rows get equal results; other columns
pass through, result columns replace input columns of the same name, no other
name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, documents, released, text_bytes, tucked

LEVEL = 3
CHUNK = 4096
CHUNK_BAND = (1.45, 4.5)
CHUNK_SHARE = 0.25
#: Lowest ratios of texts and chunks with more than WIDE_SHARE of their bytes outside ASCII.
WIDE_CHUNK_LOW = 1.15
WIDE_LOWS = {128: 0.9, 256: 1.1, 512: 1.1, 1024: 1.2, 4096: 1.25, 16384: 1.25, 65536: 1.25}
WIDE_SHARE = 0.25
#: (bytes from, lowest ratio, highest ratio).  Below 128 bytes the frame's own bytes rule the ratio.
BANDS = ((0, 0.0, 2.5), (128, 1.0, 2.5), (256, 1.25, 3.2), (512, 1.32, 3.2), (1024, 1.4, 3.8), (4096, 1.45, 4.5), (16384, 1.45, 5.5), (65536, 1.45, 6.5))
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

_SYMBOLS = b"#*$%&|<>"
_NOT_ASCII = bytes(range(0x80, 0x100))
_NOT_WORD_STARTS = bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r"  # continuation bytes and white space

RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("doc_ratio", T.DoubleType()), T.StructField("bad_chunks", T.LongType()), T.StructField("n_chunks", T.LongType())]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows that occur twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key, span = ids[:n], len(number)
    for k in range(1, window):
        if span > (1 << 62) // len(number):  # the packed key would overflow: rank it, which keeps it exact
            key, span = np.unique(key, return_inverse=True)[1].astype(np.int64), n
        key, span = key * len(number) + ids[k : n + k], span * len(number)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _wide(text: bytes) -> bool:
    return len(text) - len(text.translate(None, _NOT_ASCII)) > WIDE_SHARE * len(text)


def _chunk_outside(chunk: bytes, compress) -> bool:
    low, high = CHUNK_BAND
    return _outside(CHUNK / len(compress(chunk)), WIDE_CHUNK_LOW if _wide(chunk) else low, high)


def _outside(ratio: float, low: float, high: float) -> bool:
    return ratio < low or ratio > high


def measure(text: bytes, compress) -> tuple:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    repeated = repeat_words(words)
    ratio = len(text) / len(compress(text)) if text else 0.0
    size, low, high = next(b for b in reversed(BANDS) if len(text) >= b[0])
    low = WIDE_LOWS.get(size, low) if _wide(text) else low
    starts = [*range(0, len(text) - CHUNK + 1, CHUNK)]
    if starts and len(text) % CHUNK:
        starts.append(len(text) - CHUNK)
    n_chunks = len(starts)
    bad = sum(_chunk_outside(text[k : k + CHUNK], compress) for k in starts)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)
    kept = not failed and not _outside(ratio, low, high) and bad <= CHUNK_SHARE * n_chunks
    return (
        len(words), len(text.translate(None, _NOT_WORD_STARTS)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated, ratio, bad, n_chunks, failed, kept,
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in batches:
        rows = [measure(t.as_py(), compress) for t in batch["_text"]]
        at = batch.schema.get_field_index("_text")
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        names = [n for i, n in enumerate(batch.schema.names) if i != at]
        made = [pa.array([r[k] for r in rows], {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for k, f in enumerate(RESULT)]
        yield pa.RecordBatch.from_arrays(columns + made, names + RESULT.names)


def quality_rules(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (text, ...) plus the measures; ``carry``: input columns to pass through (all)."""
    if carry is None:
        packed, out = tucked(docs, "text")
        return out(quality_rules(packed, packed.columns), *RESULT.names)
    bounded_batches(docs.sparkSession)
    taken = {n.lower() for n in RESULT.names} | {"_text"}
    through = [c for c in carry if c.lower() not in taken]
    rows = docs.select(*[F.col(f"`{c}`") for c in through], text_bytes().alias("_text"))
    schema = T.StructType([rows.schema[c] for c in through] + RESULT.fields)
    return rows.mapInArrow(released(_measure_batches), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"])
