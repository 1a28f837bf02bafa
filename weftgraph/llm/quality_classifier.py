"""Operator 6: quality classifier by co-training.

Two logistic models see a document in different ways: one its text (hashed words
and the make-up of its characters), the other its metadata (language, source,
length).  Both start from the labelled rows.  In each round each of them scores
all documents without a label and hands the ones that it is surest of, with its
labels, to the other, which learns from them; a document on which the two
disagree is handed to neither.  Held-out labelled rows then calibrate both
(Platt), and the mean of the calibrated log-odds scores all documents.

Documents become sparse features once, whole texts, in Arrow batches; these are
written to the shared folder, some tenths of the texts, and every round reads
them.  A round's surest documents are found by partition, then over all, so that
the driver gets SURE of each view and kind.  Only the labelled rows that are
fitted are bounded, by LABELLED ids in the order of a hash; labelled rows beyond
it count as unlabelled.

Defined results: null text is the empty text, other nulls are a value of their
own; rows with a null label or id are not labelled, of several labels of an id
the largest counts; of rows that repeat an id one is fitted, and of documents
with equal features one is handed over; equal confidence goes by a digest of the
features; repeated rows get equal scores; without labelled rows of both kinds
every score is 0.5 and all are kept; empty tables give empty tables; result
columns replace input columns of the same name, no other name clashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, documents, materialize, released, tucked

LABELLED = 5000
HELD_OUT = 5  # one in so many labelled rows calibrates
WORD_SLOTS = 2048
MADE_UP = 8  # measures of a text's characters
META_SLOTS = 256
ROUNDS = 5
SURE = 50  # pseudo-labels of each kind that a view hands over in a round
STEPS = 300
KEEP_GOOD = 0.99  # share of held-out good documents that the threshold keeps
MEMO = 1 << 18

_slots: dict[str, int] = {}


def text_view(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of a text's words and their values, and the measures of its characters."""
    import xxhash

    made = np.zeros(MADE_UP, np.float32)
    words = text.lower().split()
    if not words:
        made[-1] = 1
        return np.zeros(0, np.uint16), np.zeros(0, np.float16), made
    if len(_slots) > MEMO:
        _slots.clear()
    for w in set(words).difference(_slots):
        _slots[w] = xxhash.xxh64_intdigest(w) % WORD_SLOTS
    seen = np.bincount(np.fromiter(map(_slots.__getitem__, words), np.int64, len(words)), minlength=WORD_SLOTS)
    slots = np.flatnonzero(seen)
    part = np.log1p(seen[slots])
    n, raw = len(text), text.encode()
    symbols = n - len(text.translate(dict.fromkeys(map(ord, "#*$%&|<>{}[]=_~^!"))))
    digits, upper = sum(map(raw.count, b"0123456789")), sum(map(raw.count, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    made[:] = (10 * symbols / n, 10 * digits / n, 5 * upper / n, len(set(words)) / len(words), sum(map(len, words)) / len(words) / 10, math.log(len(words)) / 5, raw.count(b"\n") / len(words), 0)
    for w in [w for w in set(words) if len(w) > 64]:
        del _slots[w]
    return slots.astype(np.uint16), (part / np.linalg.norm(part)).astype(np.float16), made


def meta_view(lang, source, n_chars) -> np.ndarray:
    """Distinct slots of a document's metadata."""
    import xxhash

    size = -1 if n_chars is None else int(math.log2(max(1, abs(n_chars))))
    return np.unique([xxhash.xxh64_intdigest(f"{kind}={value!r}") % META_SLOTS for kind, value in (("lang", lang), ("source", source), ("size", size), ("lang-size", (lang, size)))]).astype(np.uint16)


class Rows:
    """Features of documents, ragged: slots and values of words one after the other, measures, slots of metadata."""

    def __init__(self, slots: list[bytes], values: list[bytes], made: list[bytes], meta: list[bytes]):
        self.n = len(slots)
        self.slots, self.values = np.frombuffer(b"".join(slots), np.uint16), np.frombuffer(b"".join(values), np.float16).astype(np.float64)
        self.owner = np.repeat(np.arange(self.n), [len(x) // 2 for x in slots])
        self.made = np.frombuffer(b"".join(made), np.float32).reshape(self.n, MADE_UP)
        self.meta = np.frombuffer(b"".join(meta), np.uint16)
        self.meta_owner = np.repeat(np.arange(self.n), [len(x) // 2 for x in meta])

    @classmethod
    def of(cls, batch) -> Rows:
        return cls(*[batch[c].to_pylist() for c in ("slots", "values", "made", "meta")])

    def dense(self) -> list[np.ndarray]:
        """Both views as matrices, for the bounded rows that are fitted."""
        text, meta = np.zeros((self.n, WORD_SLOTS + MADE_UP), np.float32), np.zeros((self.n, META_SLOTS), np.float32)
        text[self.owner, self.slots] = self.values
        text[:, WORD_SLOTS:] = self.made
        meta[self.meta_owner, self.meta] = 1
        return [text, meta]

    def odds(self, views: list[Logistic]) -> list[np.ndarray]:
        text, meta = (v.w.astype(np.float64) for v in views)
        t = np.bincount(self.owner, text[self.slots] * self.values, self.n) + self.made.astype(np.float64) @ text[WORD_SLOTS:] + views[0].b
        return [t, np.bincount(self.meta_owner, meta[self.meta], self.n) + views[1].b]


class Logistic:
    """Weights by full-batch Adam with a ridge; classes weigh alike."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = STEPS):
        w, b, m, v = np.zeros(x.shape[1] + 1, np.float64), 0, 0, 0
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) / len(y)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-(x @ w[:-1].astype(np.float32) + w[-1])))
            e = (p - y) * weight
            g = np.r_[x.T @ e.astype(np.float32) + ridge * w[:-1], e.sum()]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w, self.b = w[:-1].astype(np.float32), float(w[-1])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b


def platt(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn raw log-odds into calibrated ones, by Newton steps on smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        r = p * (1 - p) + 1e-9
        g = np.array([((p - target) * odds).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(r * odds * odds).sum() + 1e-3, (r * odds).sum()], [(r * odds).sum(), r.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return max(a, 0.0), b


class Model:
    """Both views, calibrated: fixed size, whatever the data."""

    def __init__(self, views: list[Logistic], scales: list[tuple[float, float]], threshold: float):
        self.views, self.scales, self.threshold = views, scales, threshold

    def scores(self, odds: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Probabilities by view and together, of raw log-odds by view."""
        scaled = [a * o + b for o, (a, b) in zip(odds, self.scales, strict=True)]
        prob = lambda o: 1 / (1 + np.exp(-np.clip(o, -30, 30)))
        return [prob(o) for o in scaled], prob(np.mean(scaled, axis=0))


FEATURES = [T.StructField("slots", T.BinaryType()), T.StructField("values", T.BinaryType()), T.StructField("made", T.BinaryType()), T.StructField("meta", T.BinaryType())]


def features(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``docs`` (text, lang, source, n_chars, ...): the columns ``carry`` and the features."""
    bounded_batches(docs.sparkSession)
    inner = {"_text": F.col("text"), "_lang": F.col("lang"), "_source": F.col("source"), "_n": F.col("n_chars").cast("long")}
    own = frozenset(inner)
    through = [c for c in carry if c.lower() not in own]
    rows = docs.select(*[F.col(f"`{c}`") for c in through], *[c.alias(n) for n, c in inner.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [text_view(t or "") for t in b["_text"].to_pylist()]
            metas = [meta_view(*r).tobytes() for r in zip(b["_lang"].to_pylist(), b["_source"].to_pylist(), b["_n"].to_pylist(), strict=True)]
            keep = [i for i, c in enumerate(b.schema.names) if c not in own]
            columns = [*[pa.array([x[k].tobytes() for x in texts], pa.binary()) for k in range(3)], pa.array(metas, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.columns[i] for i in keep] + columns, [b.schema.names[i] for i in keep] + [f.name for f in FEATURES])

    return rows.mapInArrow(released(run), T.StructType([rows.schema[c] for c in through] + FEATURES))


_PICKED = "view int, kind int, sure double, digest long, doc_id long, slots binary, values binary, made binary, meta binary"


def surest(rows: DataFrame, views: list[Logistic], taken: np.ndarray, sure: int) -> list[list]:
    """For each view the rows it is surest of, at most ``sure`` of each kind, without those the views label differently; ``taken``: ids to leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        best: dict[tuple[int, int], dict[int, tuple]] = {(v, k): {} for v in (0, 1) for k in (0, 1)}
        for b in batches:
            found, ids = Rows.of(b), b["doc_id"].to_pylist()
            number = np.array([0 if i is None else i for i in ids], np.int64)
            known = np.array([i is None for i in ids], bool) | np.isin(number, taken)
            for v, odds in enumerate(found.odds(views)):
                for kind in (0, 1):
                    how = odds if kind else -odds
                    at = np.flatnonzero(~known & (how > 0))
                    own = best[v, kind]
                    floor = min((x[0] for x in own.values()), default=0.0) if len(own) >= sure else 0.0
                    at = at[how[at] >= floor]
                    new: set[int] = set()
                    for i in at[np.argsort(-how[at], kind="stable")].tolist():
                        parts = [b[c][i].as_py() for c in ("slots", "values", "made", "meta")]
                        digest = xxhash.xxh3_64_intdigest(b"\0".join(parts)) >> 1
                        if len(new) >= sure and float(how[i]) < last and digest not in new:
                            break
                        new.add(digest)
                        last = float(how[i])
                        if digest not in own or ids[i] < own[digest][1]:
                            own[digest] = (last, ids[i], *parts)
                    for d in sorted(own, key=lambda d: (-own[d][0], d))[sure:]:
                        del own[d]
        rows_ = [(v, kind, x[0], d, *x[1:]) for (v, kind), own in best.items() for d, x in own.items()]
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows_], t) for k, t in enumerate(kinds)], [f.split(" ")[0] for f in _PICKED.split(", ")])

    met = rows.mapInArrow(released(run), _PICKED)
    one = met.groupBy("view", "kind", "digest").agg(F.min_by(F.struct("sure", "doc_id", "slots", "values", "made", "meta"), "doc_id").alias("r")).select("view", "kind", "digest", "r.*")
    nth = F.row_number().over(W.partitionBy("view", "kind").orderBy(F.desc("sure"), "digest"))
    got = one.withColumn("nth", nth).filter(F.col("nth") <= sure).orderBy("view", "kind", "nth").collect()  # four times ``sure`` rows at most
    label = [{r["digest"]: r["kind"] for r in got if r["view"] == v} for v in (0, 1)]
    odd = {d for d, kind in label[0].items() if label[1].get(d, kind) != kind}
    return [[r for r in got if r["view"] == v and r["digest"] not in odd] for v in (0, 1)]


def _rows(got: list) -> Rows:
    return Rows(*[[bytes(r[c]) for r in got] for c in ("slots", "values", "made", "meta")])


def co_train(rows: DataFrame, labelled: list[np.ndarray], y: np.ndarray, ids: np.ndarray, rounds: int = ROUNDS, sure: int = SURE) -> Model | None:
    """Models of both views; ``rows``: features of all documents, ``labelled``: both views of the labelled ones (ids)."""
    held = np.arange(len(y)) % HELD_OUT == 0
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        return None
    xs, ys = [x[~held] for x in labelled], [y[~held], y[~held]]
    views, taken = [Logistic(x, k) for x, k in zip(xs, ys, strict=True)], np.sort(ids)
    for _ in range(rounds):
        picked = surest(rows, views, taken, sure)
        if not any(picked):
            break
        for v, other in ((0, picked[1]), (1, picked[0])):  # what one is sure of, the other learns
            if other:
                xs[v] = np.concatenate([xs[v], _rows(other).dense()[v]])
                ys[v] = np.r_[ys[v], [float(r["kind"]) for r in other]]
        taken = np.unique(np.r_[taken, [r["doc_id"] for own in picked for r in own]])
        views = [Logistic(x, k) for x, k in zip(xs, ys, strict=True)]
    test = [v(x[held]) for v, x in zip(views, labelled, strict=True)]
    model = Model(views, [platt(o, y[held]) for o in test], 0.5)
    good = np.sort(model.scores(test)[1][y[held] > 0])
    model.threshold = min(0.5, float(good[int((1 - KEEP_GOOD) * len(good))]) - 1e-6)
    return model


def fit_features(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    """Co-train on written features (doc_id and FEATURES); ``labels``: doc_id, quality (0 or 1)."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    one = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.max(F.struct("slots", "values", "made", "meta")).alias("r"))  # the broadcast has at most ``labelled`` ids
    got = one.select("doc_id", "label", "r.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    if not got:
        return None
    return co_train(rows, _rows(got).dense(), np.array([r["label"] for r in got], np.float64), np.array([r["doc_id"] for r in got], np.int64))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    """Co-train on all of ``docs`` (doc_id, text, lang, source, n_chars)."""
    return fit_features(_written(docs), labels, labelled)


def _written(docs: DataFrame) -> DataFrame:
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    return materialize(features(narrow, ["doc_id"]), "op6-features")


SCORES = [*[T.StructField(n, T.DoubleType()) for n in ("text_score", "meta_score", "score")], T.StructField("kept", T.BooleanType())]


def score_features(rows: DataFrame, model: Model | None) -> DataFrame:
    """Features replaced by text_score, meta_score, score and kept; other columns pass."""
    own = {f.name for f in FEATURES}
    through = [c for c in rows.columns if c not in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if model is None or not n:
                result = [np.full(n, 0.5)] * 3 + [np.ones(n, bool)]
            else:
                (p, q), both = model.scores(Rows.of(b).odds(model.views))
                result = [p, q, both, both >= model.threshold]
            keep = [i for i, c in enumerate(b.schema.names) if c not in own]
            yield pa.RecordBatch.from_arrays([b.columns[i] for i in keep] + [pa.array(r) for r in result], [b.schema.names[i] for i in keep] + [f.name for f in SCORES])

    return rows.mapInArrow(released(run), T.StructType([rows.schema[c] for c in through] + SCORES))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (text, lang, source, n_chars, ...) plus text_score, meta_score, score, kept."""
    packed, out = tucked(docs, "text", "lang", "source", "n_chars")
    return out(score_features(features(packed, packed.columns), model), *[f.name for f in SCORES])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written(documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_features(rows, fit_features(rows, labels))
