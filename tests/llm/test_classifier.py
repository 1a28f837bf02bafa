"""Co-training: held-out accuracy, both views, calibration, and odd rows."""

import random

import numpy as np

from weftgraph.llm import quality_classifier as qc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n, seed):
    r = random.Random(seed)
    out, labels = [], []
    for k in range(n):
        good = k % 3 > 0
        words = [r.choice("river stone garden letter winter evening".split() if good else "click win $$$ free 4u!!! bonus".split()) for _ in range(r.randint(8, 40))] + [r.choice("the of and to in".split()) for _ in range(10)]
        out.append((k, " ".join(words), "en", "books" if good == (r.random() < 0.85) else "forum", len(words) * 6))
        labels.append((k, int(good)))
    return out, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(600, 3)
    odd = [(None, None, None, None, None), (9001, "", "en", "books", 0), (9002, "x" * 200_000, "en", "forum", 200_000), rows[0], rows[0]]
    docs = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    known = spark.createDataFrame([*labels[:200], (3, None), (None, 1)], "doc_id long, quality int")
    model = qc.fit(docs, known)
    got = qc.score(docs.withColumn("score", docs.doc_id), model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    fresh = [r for r in got if r["doc_id"] is not None and 200 <= r["doc_id"] < 600]
    assert np.mean([(r["score"] > 0.5) == bool(truth[r["doc_id"]]) for r in fresh]) > 0.97
    assert np.mean([(r["meta_score"] > 0.5) == bool(truth[r["doc_id"]]) for r in fresh]) > 0.75
    assert np.mean([r["kept"] for r in fresh if truth[r["doc_id"]]]) > 0.95  # the threshold is set to keep 99 in 100
    same = {r["score"] for r in got if r["doc_id"] == 0}
    assert len(same) == 1


def test_without_labels(spark):
    docs = spark.createDataFrame(corpus(5, 1)[0], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert qc.fit(docs, none) is None
    assert {(r["score"], r["kept"]) for r in qc.score(docs, None).collect()} == {(0.5, True)}
    assert qc.score(docs.limit(0), qc.fit(docs.limit(0), none)).count() == 0


def test_platt_orders_and_calibrates():
    r = np.random.default_rng(1)
    y = (r.random(2000) < 0.7).astype(float)
    odds = 5 * (y - 0.5) + r.normal(size=2000) * 3
    a, b = qc.platt(odds, y)
    p = 1 / (1 + np.exp(-(a * odds + b)))
    assert a > 0 and abs(p.mean() - y.mean()) < 0.02


def test_the_fit_does_not_depend_on_how_rows_lie(spark):
    rows, labels = corpus(400, 5)
    copies = [(1000 + k, *rows[7][1:]) for k in range(300)]  # more copies of one text than a round hands over
    docs = spark.createDataFrame(rows + copies, SCHEMA)
    known = spark.createDataFrame([*labels[:100], (3, 0), (3, 1)], "doc_id long, quality int")
    scores = []
    for n in (1, 7):
        model = qc.fit(docs.repartition(n), known)
        scores.append({r["doc_id"]: (r["text_score"], r["meta_score"]) for r in qc.score(docs, model).collect()})
    assert scores[0] == scores[1]


def test_each_view_teaches_the_other(spark):
    """Views hand over what they are surest of; what they label differently goes to neither."""
    rows, _ = corpus(200, 7)
    feats = qc._written(spark.createDataFrame(rows, SCHEMA))
    text, meta = np.zeros(qc.WORD_SLOTS + qc.MADE_UP, np.float32), np.zeros(qc.META_SLOTS, np.float32)

    def view(w, b):
        out = qc.Logistic.__new__(qc.Logistic)
        out.w, out.b = w, b
        return out

    assert qc.surest(feats, [view(text, 1.0), view(meta, -1.0)], np.zeros(0, np.int64), 500) == [[], []]  # they disagree on all
    same = qc.surest(feats, [view(text, 1.0), view(meta, 1.0)], np.array([0, 1, 2]), 5)
    assert [len(x) for x in same] == [5, 5] and all(r["kind"] == 1 and r["doc_id"] > 2 for own in same for r in own)
    matrix = qc._rows(same[0]).dense()
    assert matrix[0].shape == (5, qc.WORD_SLOTS + qc.MADE_UP) and set(matrix[1].sum(axis=1)) <= {3.0, 4.0}
    odds = qc._rows(same[0]).odds([view(np.ones_like(text), 0.5), view(np.ones_like(meta), 0.5)])
    assert np.allclose(odds[0], matrix[0].sum(axis=1) + 0.5, atol=1e-3) and np.allclose(odds[1], matrix[1].sum(axis=1) + 0.5)
