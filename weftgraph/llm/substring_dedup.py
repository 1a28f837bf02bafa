"""Operator 10: substring dedup over word windows with a log-structured fingerprint index.

The fingerprint of a window of WINDOW words is its anchor, the least hash of its
ANCHOR-word grams, which neighbouring windows mostly share.  A WindowIndex keeps
what it has seen in a folder: the words of each batch, packed by chunk, and runs
of fingerprints: per shard the sorted anchors with the chunks that hold them.
Runs are immutable.  A new batch is sorted, merge-joined with the runs, shard by
shard, and becomes a run of its own; two runs of like size are compacted into
one, so that there are logarithmically many.

Windows whose anchor is shared, within the batch or with history, are verified:
batch and history ask shards with a 128-bit digest of their words, two
independent 64-bit hashes, and the least doc_id that has them (history comes
before all of the batch).  A window is removed from documents with a larger one.
The words themselves are not sent: two different windows would have to agree in
both hashes to be taken for one.

Every window is decided; an anchor only saves asking for windows that can't
repeat.  Exchanges carry packed arrays, one entry a key and chunk, so that a
passage shared by a third of all documents is one entry a chunk.

Defined results: null and empty texts have no words and keep the empty text; a
null doc_id counts as larger than all others, and rows of equal id (or two null
ids) don't remove each other's words within a batch; texts of fewer words than a
window are kept; empty tables give empty tables; of other columns none is
carried, whatever its name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, materialize, release, temporary
from .blocks import BLOCK, PACKED, Chunk, Exchange, RunIndex, answered_bits, answers_of, blocks_table, cover, dealt, first_of, keys_with_bits, mixed, packed_bits, read_keys_with_bits, runs, shard_of, sliding_min, unpacked_bits

WINDOW = 13
ANCHOR = 5
RESULT = "doc_id long, n_words long, n_removed long, kept_text binary, kept_sha256 string"


_ODD = np.random.default_rng(13).integers(1, 1 << 62, (3, 64), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _window_hash(words: np.ndarray, width: int, row: int) -> np.ndarray:
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += words[k : k + n] * _ODD[row, k]
    return mixed(out)


class Words:
    """The words of a chunk as two 64-bit hashes each; windows are numbered through the documents in order."""

    def __init__(self, known: list[bytes], number: list[np.ndarray], window: int):
        """``known``: the distinct words; ``number``: of each document, its words' places among them."""
        import xxhash

        self.known, self.number, self.window = known, number, window
        self.table = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known)), "<u8").reshape(-1, 2)
        self.count = np.array([max(0, len(n) - window + 1) for n in number], np.int64)
        self.begin = np.r_[0, np.cumsum(self.count)]

    @staticmethod
    def pack(texts: list[bytes]) -> bytes:
        words = [t.split() for t in texts]  # bytes: white space is ASCII's
        known = {w: k for k, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        number = np.fromiter((known[w] for ws in words for w in ws), "<u4", sum(map(len, words)))
        joined, planes = b" ".join(known), -(-max(1, len(known) - 1).bit_length() // 8)
        head = np.array([len(texts), len(joined), planes, *map(len, words)], np.int64)
        return head.tobytes() + joined + number.view(np.uint8).reshape(-1, 4).T[:planes].tobytes()  # low bytes first: the others are mostly alike

    @classmethod
    def unpack(cls, raw: bytes, window: int) -> Words:
        n, size, planes = np.frombuffer(raw, np.int64, 3).tolist()
        length, at = np.frombuffer(raw, np.int64, n, 24), 24 + 8 * n
        number = sum(np.frombuffer(raw, np.uint8, int(length.sum()), at + size + k * int(length.sum())).astype(np.int64) << 8 * k for k in range(planes))
        return cls(raw[at : at + size].split(), np.split(number, np.cumsum(length)[:-1]) if n else [], window)

    def anchors(self) -> np.ndarray:
        """The anchor of each window."""
        width = min(ANCHOR, self.window)
        out = [sliding_min(_window_hash(self.table[n, 0], width, 0), self.window - width + 1) for n, c in zip(self.number, self.count, strict=True) if c]
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def digests(self, wanted: np.ndarray) -> np.ndarray:
        """128-bit digests (two columns) of the windows marked."""
        out = []
        for n, c, b in zip(self.number, self.count, self.begin, strict=False):
            if c and (mine := wanted[b : b + c]).any():
                out.append(np.stack([_window_hash(self.table[n, k], self.window, k + 1)[mine] for k in (0, 1)], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


_DIGEST = np.dtype("S16")  # sorts and compares faster than a pair of integers


def _half(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view("<u8")[::2]


def _ask(words: Words, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors of a chunk, whether two of its documents have them, and each window's place among them."""
    owner = words.owners()
    low, least, place = first_of(anchors, owner, np.minimum)
    most = first_of(anchors, owner, np.maximum)[1]
    return low, least != most, place


RUN = "shard long, keys binary, refs binary, names binary, many binary"
HISTORY, HELD = 4, 5  # kinds of blocks: windows of history; anchors of a history chunk that the batch shares


def _run_row(shard: int, keys: np.ndarray, refs: np.ndarray, names: list[bytes], many: np.ndarray) -> pa.Table:
    order = np.argsort(keys, kind="stable")
    row = (keys[order].tobytes(), refs[order].astype(np.uint32).tobytes(), b"".join(names), np.packbits(many[order]).tobytes())
    return pa.table([pa.array([shard], pa.int64()), *[pa.array([x], pa.binary()) for x in row]], ["shard", "keys", "refs", "names", "many"])


def _new_run(table: pa.Table) -> pa.Table:
    """A shard's blocks of a batch to a run: its anchors sorted, each with the chunk that has it, and whether two of the chunk's documents do."""
    blocks = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    keys, many = zip(*[read_keys_with_bits(b["payload"]) for b in blocks], strict=True)
    made = _run_row(blocks[0]["shard"], np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys]), [b["chunk"] for b in blocks], np.concatenate(many))
    release()
    return made


def _compacted(table: pa.Table) -> pa.Table:
    """A shard's rows of several runs to one."""
    keys, refs, names, before = [], [], [], 0
    for row in table.to_pylist():
        keys.append(np.frombuffer(row["keys"], "<u8"))
        refs.append(np.frombuffer(row["refs"], np.uint32).astype(np.int64) + before)
        names.append(row["names"])
        before += len(row["names"]) // 16
    joined = np.concatenate(keys)
    return _run_row(table["shard"][0].as_py(), joined, np.concatenate(refs), names, np.zeros(len(joined), bool))


def _shared(new: pa.Table, old: pa.Table) -> pa.Table:
    """A shard's run of the batch, merge-joined with the runs before: bits for the batch's chunks, shared anchors for those of history."""
    if not new.num_rows:
        return blocks_table([])
    row = new.to_pylist()[0]
    keys, refs = np.frombuffer(row["keys"], "<u8"), np.frombuffer(row["refs"], np.uint32).astype(np.int64)
    many = np.unpackbits(np.frombuffer(row["many"], np.uint8), count=len(keys))
    first = runs(keys)
    mine, shared, out = keys[first], np.add.reduceat(many.astype(np.int64) + 1, first) > 1, []
    for run in old.to_pylist():
        held, where = np.frombuffer(run["keys"], "<u8"), np.frombuffer(run["refs"], np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(held, mine), len(held) - 1)
        shared |= held[at] == mine
        hit = mine[np.minimum(np.searchsorted(mine, held), len(mine) - 1)] == held
        for ref, places in dealt(where[hit]):
            out.append((0, run["names"][16 * ref : 16 * ref + 16], HELD, held[hit][places].tobytes()))
    answer = np.repeat(shared, np.diff(np.r_[first, len(keys)]))
    for ref, places in dealt(refs):
        out.append((row["shard"], row["names"][16 * ref : 16 * ref + 16], 0, packed_bits(answer[places])))
    made = blocks_table(out)
    release()
    return made


class _Dedup:
    """One batch against itself and history."""

    def __init__(self, docs: DataFrame, window: int, shards: int | None = None, path: str | None = None):
        self.exchange = Exchange(docs, lambda chunk: Words.pack(chunk.texts), texts=False, path=path)
        self.steps = _Steps(window, shards or self.exchange.shards)

    def asked(self) -> DataFrame:
        """BLOCK rows of the anchors of each chunk."""
        return self.exchange.ask(self.steps.anchors)

    def result(self, seen: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """``seen``: what _shared() gives; ``history``: PACKED rows of earlier batches."""
        steps = self.steps
        windows = self.exchange.meet(seen.filter("kind = 0"), steps.windows, BLOCK)
        if history is not None:
            held = seen.filter(f"kind = {HELD}")
            windows = windows.unionByName(history.select("chunk", "notes").groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(lambda left, right: steps.old(left, right), BLOCK))
        return self.exchange.meet(self.exchange.answer(windows, _resolve_windows), steps.remove, RESULT)


class _Steps:
    """What is done with a chunk on the executors."""

    def __init__(self, window: int, shards: int):
        self.window, self.shards = window, shards

    def anchors(self, chunk: Chunk):
        words = Words.unpack(chunk.notes, self.window)
        keys, many, _ = _ask(words, words.anchors())
        for s, at in dealt(shard_of(keys, self.shards)):
            yield s, 0, keys_with_bits(keys[at], many[at])

    def _verify(self, chunk: Chunk, words: Words, wanted: np.ndarray):
        digest = np.ascontiguousarray(words.digests(wanted)).view(_DIGEST).ravel()
        return first_of(digest, chunk.numbers[words.owners()[wanted]], np.minimum)

    def _asking(self, name: bytes, kind: int, digest: np.ndarray, least: np.ndarray) -> list:
        out = []
        for s, at in dealt(shard_of(_half(digest), self.shards)):
            ids, number = np.unique(least[at], return_inverse=True)
            part = np.array([len(at), len(ids)], np.int64).tobytes() + ids.tobytes() + number.astype(_number(len(ids))).tobytes()
            out.append((s, name, kind, part + digest[at].tobytes()))
        return out

    def windows(self, chunk: Chunk, answers: list[dict]) -> pa.Table:
        words = Words.unpack(chunk.notes, self.window)
        keys, _, place = _ask(words, words.anchors())
        wanted = answered_bits(answers_of(answers, 0), shard_of(keys, self.shards))[place] if len(keys) else np.zeros(0, bool)
        out = []
        if wanted.any():
            digest, least, _ = self._verify(chunk, words, wanted)
            out = self._asking(chunk.name, 1, digest, least)
        if len(wanted):
            out.append((int.from_bytes(chunk.name[:6], "big") % self.shards, chunk.name, 2, packed_bits(wanted)))
        return blocks_table(out)

    def old(self, left: pa.Table, right: pa.Table) -> pa.Table:
        """The windows of a chunk of history whose anchors the batch shares."""
        if not left.num_rows or not right.num_rows:
            return blocks_table([])
        chunk = Chunk.unpack(left.slice(0, 1).to_pylist()[0])
        words = Words.unpack(chunk.notes, self.window)
        keys = np.unique(np.concatenate([np.frombuffer(p, "<u8") for p in right["payload"].to_pylist()]))
        anchors = words.anchors()
        wanted = keys[np.minimum(np.searchsorted(keys, anchors), len(keys) - 1)] == anchors
        digest = np.unique(np.ascontiguousarray(words.digests(wanted)).view(_DIGEST).ravel())
        made = blocks_table(self._asking(chunk.name, HISTORY, digest, np.full(len(digest), np.iinfo(np.int64).min)))
        release()
        return made

    def remove(self, chunk: Chunk, answers: list[dict]) -> pa.Table:
        words = Words.unpack(chunk.notes, self.window)
        total = int(words.begin[-1])
        gone = np.zeros(total, bool)
        if total:
            note = list(answers_of(answers, 2).values())
            if len(note) != 1:
                raise RuntimeError("a chunk without its answers")
            wanted = unpacked_bits(note[0], total)
            if wanted.any():
                digest, least, place = self._verify(chunk, words, wanted)
                elsewhere = answered_bits(answers_of(answers, 1), shard_of(_half(digest), self.shards))[place]
                gone[wanted] = elsewhere | (chunk.numbers[words.owners()[wanted]] > least[place])
        out, known = [], np.array(words.known, object)
        for k, own in enumerate(words.number):
            covered = cover(np.flatnonzero(gone[words.begin[k] : words.begin[k + 1]]), self.window, len(own))
            kept = b" ".join(known[own[~covered]].tolist())
            out.append((chunk.ids[k], len(own), int(covered.sum()), kept, hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def _number(m: int) -> np.dtype:
    """What holds places among m ids."""
    return np.dtype(np.uint8 if m <= 256 else np.uint16 if m <= 65536 else np.uint32)


def _resolve_windows(blocks: list[dict]):
    asked, index = [], RunIndex(np.minimum)
    for b in blocks:
        if b["kind"] == 2:  # a chunk's own note, on its way
            yield b["chunk"], 2, b["payload"]
            continue
        raw = b["payload"]
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        kind = _number(m)
        ids = np.frombuffer(raw, np.int64, m, 16)[np.frombuffer(raw, kind, n, 16 + 8 * m)]
        digest = np.frombuffer(raw, _DIGEST, n, 16 + 8 * m + kind.itemsize * n)
        index.add(digest, ids)
        if b["kind"] != HISTORY:
            asked.append((b["chunk"], digest, ids))
    for chunk, digest, ids in asked:
        yield chunk, 1, packed_bits(index.find(digest) < ids)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_text (UTF-8), kept_sha256; a batch without history."""
    batch = _Dedup(docs, window)
    return batch.result(batch.asked().groupBy("shard").applyInArrow(lambda table: _shared(run := _new_run(table), run.slice(0, 0)), BLOCK))


class WindowIndex:
    """An index of all windows seen, in a folder that driver and executors share: runs/, chunks/ and, written first, head/.

    ``room``: how many times the first batch the corpus may grow to with shards
    of about SHARD_BYTES of text; beyond it shards only get larger.  One writer
    at a time; a batch whose run was not written to its end is not in the index.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, room: int = 16):
        self.spark, self.path, self.room, self.window, self.shards = spark, path.rstrip("/"), room, window, None
        if self._whole("head"):
            row = spark.read.schema("shards int, window int").parquet(f"{self.path}/head").first()
            self.shards, self.window = row["shards"], row["window"]

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _whole(self, name: str) -> bool:
        fs, path = self._fs(f"{name}/_SUCCESS")
        return fs.exists(path)

    def runs(self) -> list[tuple[int, int, int]]:
        """(first batch, last batch, bytes of text) of the live runs, oldest first: whole ones that no larger one covers."""
        fs, path = self._fs("runs")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        whole = sorted(tuple(map(int, n.split("-"))) for n in names if self._whole(f"runs/{n}"))
        return [r for r in whole if not any(x != r and x[0] <= r[0] and r[1] <= x[1] for x in whole)]

    def _read(self, runs_: list[tuple[int, int, int]]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*[f"{self.path}/runs/{a}-{b}-{n}" for a, b, n in runs_])

    def add(self, docs: DataFrame) -> DataFrame:
        """The rows of substring_dedup() for a new batch, held against all batches before it as well; the batch is in the index afterwards."""
        self.compact()
        live = self.runs()
        number = live[-1][1] + 1 if live else 0
        fs, old = self._fs(f"chunks/{number}")
        fs.delete(old, True)  # of a batch that was not finished
        batch = _Dedup(docs, self.window, self.shards, f"{self.path}/chunks/{number}")
        if self.shards is None:
            self.shards = batch.steps.shards = self.room * batch.steps.shards
            self.spark.range(1).selectExpr(f"{self.shards} AS shards", f"{self.window} AS window").write.mode("overwrite").parquet(f"{self.path}/head")
        run = (number, number, batch.exchange.table.agg(F.sum("n_bytes")).first()[0] or 0)
        batch.asked().groupBy("shard").applyInArrow(_new_run, RUN).write.parquet(f"{self.path}/runs/{'-'.join(map(str, run))}")
        new = self._read([run])
        if live:
            seen = new.groupBy("shard").cogroup(self._read(live).drop("many").groupBy("shard")).applyInArrow(lambda left, right: _shared(left, right), BLOCK)
        else:
            seen = new.groupBy("shard").applyInArrow(lambda table: _shared(table, table.slice(0, 0)), BLOCK)
        seen = materialize(seen, "op10-shared")
        history = self.spark.read.schema(PACKED).parquet(*[f"{self.path}/chunks/{k}" for k in range(number)]) if number else None
        return batch.result(seen, history)

    def compact(self) -> None:
        """Merge the last run into the one before while that is less than twice its size; the merged run takes their place once it is whole.

        Done before a batch is added, when no batch reads the runs any more.
        """
        live = self.runs()
        while len(live) > 1 and live[-2][2] < 2 * live[-1][2]:
            a, b = live[-2:]
            merged = (a[0], b[1], a[2] + b[2])
            self._read([a, b]).groupBy("shard").applyInArrow(_compacted, RUN).write.mode("overwrite").parquet(f"{self.path}/runs/{'-'.join(map(str, merged))}")
            for run in (a, b):
                fs, path = self._fs("runs/" + "-".join(map(str, run)))
                fs.delete(path, True)
            live = self.runs()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches, the lower half of the ids first, through an index of their own."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    low = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    index = WindowIndex(spark, temporary(spark, "op10-index"), room=2)
    parts = [index.add(docs.filter(low)), index.add(docs.filter(~low))]
    return parts[0].unionByName(parts[1]).select("doc_id", "n_words", "n_removed", "kept_sha256")


_NEXT = " || ' ' || ".join(["x", *[f"lead(x, {k}) OVER o" for k in range(1, WINDOW)]])
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
word AS MATERIALIZED (SELECT r, doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
win AS MATERIALIZED (SELECT * FROM (SELECT r, doc_id, k, {_NEXT} AS s FROM word WINDOW o AS (PARTITION BY r ORDER BY k)) WHERE s IS NOT NULL),
first AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(k, k + {WINDOW})) AS k FROM win JOIN first ON first.s = win.s WHERE doc_id > least OR doc_id IS NULL AND least IS NOT NULL),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.k) AS t, count(*) AS n FROM word LEFT JOIN gone ON gone.r = word.r AND gone.k = word.k WHERE gone.k IS NULL GROUP BY word.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.r = d.r
"""
