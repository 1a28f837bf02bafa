"""The near-dedup stage of the pipeline against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from weftgraph.llm import jaccard, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def near_texts(copies):
    r = random.Random(12)
    fresh = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n)]
    passage, out = fresh(40), []
    for n in (6, 12, 40, 150, 600):
        for _ in range(6):
            base = fresh(n)
            out.append(base)
            for edits in (1, 1, max(1, n // 60), max(1, n // 40), max(1, n // 30)):
                copy = list(base)
                for _ in range(edits):
                    copy[r.randrange(n)] = fresh(1)[0]
                out.append(copy)
    out += [fresh(r.randint(3, 60)) + passage for _ in range(copies)]
    base = fresh(120)
    for _ in range(copies):
        copy = list(base)
        for _ in range(r.randint(1, 5)):
            copy[r.randrange(120)] = fresh(1)[0]
        out.append(copy)
    return [" ".join(x) for x in out] + ["", None, "one", "One", "a b c d e f", "A B  c d e f"]


def roots(sets, linked):
    root = list(range(len(sets)))

    def of(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if of(a) != of(b) and linked(a, b):
                root[max(of(a), of(b))] = min(of(a), of(b))
    return [of(k) for k in range(len(sets))]


def test_near_stage_finds_all_pairs(spark):
    texts = near_texts(170)  # more than jaccard.FULL meet
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    sets, prints = [shingles(t) for t in texts], [simhash.fingerprint((t or "").encode()) for t in texts]
    want = set(roots(sets, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2 or alike(sets[a], sets[b])))
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()} == want
    assert 200 < len(want) < len(set(roots(sets, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)))


def test_filters_lose_no_pair():
    import numpy as np

    sets = jaccard.shingle_sets([(t or "").encode() for t in near_texts(30)])
    hot = np.sort(np.concatenate(sets))[::7]
    for a in sets:
        for b in sets:
            if len(a) and len(b) and jaccard.similar(a, b):
                assert len(np.intersect1d(jaccard.prefix(a, hot), jaccard.prefix(b, hot)))
                assert jaccard._possible(len(a), len(b), jaccard.parity(a), jaccard.parity(b), jaccard.PERCENT)


def test_sketches_bound_differences_from_below():
    import numpy as np

    from weftgraph.llm import jaccard

    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 62, n).astype(np.uint64)) for n in (3, 40, 130, 500, 500, 5000)]
    sets += [np.unique(np.r_[s[: len(s) * 9 // 10], r.integers(0, 1 << 62, 5).astype(np.uint64)]) for s in sets]
    made = [jaccard.sketch(s).tobytes() for s in sets]
    table, every = jaccard.Sketches(made), np.arange(len(sets))
    for k, s in enumerate(sets):
        true = [len(np.setxor1d(s, t)) for t in sets]
        got = table.differ(k, every)
        assert got.tolist() == [jaccard._differ(made[k], m) for m in made] and all(g <= t for g, t in zip(got, true, strict=True)) and got[k] == 0
    assert table.differ(0, every[:0]).tolist() == []
    assert table.differ(5, np.array([11]))[0] > 0.8 * len(np.setxor1d(sets[5], sets[11]))  # and not far from them


def test_sets_that_share_many_shingles_meet_once(spark):
    r = random.Random(4)

    def copies(n):
        base = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
        return [" ".join(base[:k] + [f"edit{k}"] + base[k + 1 :]) for k in r.sample(range(500), n)]

    few, many = copies(24), copies(jaccard.FULL + 8)
    docs = spark.createDataFrame(list(enumerate(few + many)), "doc_id long, text string").repartition(3)
    nodes = [jaccard.node(jaccard.shingle_sets([t.encode()])[0]) for t in few]
    met = [(x["a"], x["b"], x["grp"]) for x in jaccard._met(docs, jaccard.SHINGLE, jaccard.PERCENT)[0].collect()]
    pairs = [(a, b) for a, b, grp in met if grp is None and a in nodes]
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in nodes for b in nodes if a != b}
    assert len(pairs) < 1.2 * 24 * 23 / 2  # not once for each of the shards their shingles fall on
    members = [a for a, _, grp in met if grp is not None]
    assert len(set(members)) == len(many) and len(members) <= 2 * jaccard.FIRSTS * len(many)  # nor once for each shingle


def test_first_meetings_keep_every_pair():
    import numpy as np

    r = np.random.default_rng(8)
    for _ in range(200):
        sets = [np.sort(r.choice(np.arange(1, 40, dtype=np.uint64), r.integers(1, 25), replace=False)) for _ in range(6)]
        keys, owner = np.concatenate(sets), np.repeat(np.arange(6), [len(s) for s in sets])
        before = jaccard._before(keys, owner)
        for k, x in enumerate(before):
            own = sets[owner[k]]
            assert [v for v in x.tolist() if v] == own[own < keys[k]][: jaccard.FIRSTS].tolist()
        met = set()
        for key in np.unique(keys):
            at = np.flatnonzero(keys == key)
            x, y = np.meshgrid(at, at)
            new = jaccard._new(before[x.ravel()], before[y.ravel()]) & (x.ravel() < y.ravel())
            if jaccard._all_met(before[at]):
                assert not new.any()
            met |= set(zip(owner[x.ravel()[new]].tolist(), owner[y.ravel()[new]].tolist(), strict=True))
        assert met == {(a, b) for a in range(6) for b in range(a + 1, 6) if len(np.intersect1d(sets[a], sets[b]))}
