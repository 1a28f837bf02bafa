"""Suffix arrays and byte-level substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from weftgraph.llm import suffix_dedup
from weftgraph.llm.suffix_arrays import SuffixArray


def texts(seed, n=40, letters="ab"):
    r = random.Random(seed)
    common = "".join(r.choice("abcd") for _ in range(60))
    out = []
    for _ in range(n):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 80)))
        if r.random() < 0.5:
            k = r.randint(0, len(t))
            t = t[:k] + common[r.randint(0, 20) :] + t[k:]
        out.append(t)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_prefixes_and_search(seed):
    strings = [t.encode() for t in texts(seed, 12) if t]
    sa = SuffixArray(strings)
    flat = [0 if b is None else b + 1 for s in strings for b in [*s, None]]
    order = sorted(range(len(flat)), key=lambda i: flat[i:])
    assert sa.array.tolist() == order
    lcp = sa.common_prefixes(10_000)
    for k in range(1, len(order)):
        a, b, n = order[k - 1], order[k], 0
        while max(a, b) + n < len(flat) and flat[a + n] == flat[b + n]:
            n += 1
        assert lcp[k] == n
    other = [t.encode() for t in texts(seed + 100, 12) if t] + strings[:1]
    windows = [s[i : i + 8] for s in strings for i in range(len(s) - 7)]
    assert sa.found_in(SuffixArray(other), 8).tolist() == [any(w in o for o in other) for w in windows]
    everywhere = [s[i : i + 8] for s in strings for i in range(len(s) - 7)]
    assert sa.repeated(8).tolist() == [everywhere.count(w) > 1 for w in windows]


def brute(rows, width):
    count = {}
    for _, t in rows:
        for i in range(len(t) - width + 1):
            count[t[i : i + width]] = count.get(t[i : i + width], 0) + 1
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


# (3, 1000): anchors are split, and sub-shards merged by binary search; (3, 1), (3, 4): windows of hot anchors are dealt one by one
@pytest.mark.parametrize(("hot", "parts"), [(4096, 4), (3, 1000), (3, 4), (3, 1)])
def test_query_matches_brute_force(spark, monkeypatch, hot, parts):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PARTS", parts)
    monkeypatch.setattr(suffix_dedup, "BATCH", 300)
    rows = [(k, t) for k, t in enumerate(texts(9, 60, "abcde"))] + [(None, None), (None, "é" * 40), (5, "é" * 40), (7, "a" * 100), (7, "a" * 100), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").repartition(3)
    got = sorted([tuple(r) for r in suffix_dedup.suffix_dedup(df, 24).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()], key=str)
    assert got == brute([(d, (t or "").encode()) for d, t in rows], 24)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_bytes long")
    assert suffix_dedup.suffix_dedup(df).count() == 0
