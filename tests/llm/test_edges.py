"""Clashing column names, far and missing ids, very long words, and the pipeline's stages against brute force."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import zstandard

import corpus_pipeline
from weftgraph.llm import bpe_codec, exact_dedup, html_text, mixing, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, token_counts

BASE = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["_rest", "_text", "_key", "_salt", "_tie", "_rank", "_rate", "_u", "_before", "_digest", "_keep", "_rows", "_size", "_fp", "_node", "_root", "_bytes", "_html", "_lang", "_source", "_n", "_copy", "_from", "_wanted", "_first"]
RESULTS = ["kept", "n_words", "doc_ratio", "keep_id", "size", "target", "taken", "copies", "component_id", "fingerprint", "n_tokens", "ids", "score"]


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(11)
    rows = []
    for k in range(60):
        t = words(r, r.randint(12, 60))
        rows.append((k, t, "en", f"s{k % 4}", len(t)))
        if k % 5 == 0:
            rows += [(100 + k, t, "en", "s0", len(t)), (200 + k, t.upper(), None, None, len(t)), (300 + k, t + " " + words(r, 1), "en", "s1", None)]
    rows += [(None, rows[3][1], None, None, None), (None, None, None, None, None), (500, "", "en", "s1", 0), rows[0], rows[0]]
    return spark.createDataFrame(rows, BASE).repartition(3)


def clashing(docs):
    for k, c in enumerate([*CLASHING, *RESULTS]):
        docs = docs.withColumn(c, docs.doc_id.cast("string") if k % 2 else docs.n_chars)
    return docs


OPERATORS = {
    "simhash": (simhash.near_components, {"fingerprint", "component_id"}),
    "exact": (exact_dedup.exact_dedup, {"keep_id", "group_size", "kept", "text_sha256"}),
    "rules": (quality_rules.quality_rules, set(quality_rules.RESULT.names)),
    "codec": (lambda d: bpe_codec.bpe_codes(d, public_tokenizers.path("word_bpe_49k.json")), {"n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"}),
    "counts": (lambda d: token_counts.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")), {"n_bytes", "n_tokens", "over_limit"}),
    "score": (lambda d: quality_classifier.score(d, None), {"text_score", "meta_score", "score", "kept"}),
    "mix": (mixing.mix, set(mixing.MADE)),
    "html": (lambda d: html_text.html_text(d.withColumnRenamed("text", "html")), {"text", "n_chars"}),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_pass_through_whatever_their_names(docs, name):
    operator, made = OPERATORS[name]
    before = clashing(docs)
    got = operator(before)
    names = [c for c in (["html" if name == "html" and c == "text" else c for c in before.columns]) if c not in made]
    assert set(got.columns) == {*names, *made}
    same = [c for c in names if c not in ("html", "text")]
    assert Counter(map(tuple, got.select(*same).collect())) == Counter(map(tuple, before.select(*same).collect()))


@pytest.mark.parametrize("operator", [suffix_dedup.suffix_dedup, substring_dedup.substring_dedup])
def test_dedup_of_spans_drops_other_columns(docs, operator):
    assert operator(clashing(docs)).count() == docs.count()


@pytest.mark.parametrize("stage", range(5))
def test_stages_leave_columns_alone(spark, docs, stage):
    before = clashing(docs)
    after = corpus_pipeline.STAGES[stage][1](spark, before, None)
    if stage < 4:
        assert after.columns == before.columns
        rows = set(map(tuple, before.collect()))
        assert all(tuple(r) in rows for r in after.collect())
    else:
        assert after.count() == docs.count()


@pytest.mark.parametrize("ids", ["far", "null", "steps"])
def test_exact_dedup_and_mixing_split_any_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 50)
    name = {"far": lambda k: 1 << 60 if k == 0 else k, "null": lambda k: None, "steps": lambda k: 1024 * k}[ids]
    rows = [(name(k), f"text {k % 300}", "en", "s", 6) for k in range(400)]
    df = spark.createDataFrame(rows, BASE).repartition(3)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t].append(i)
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == 400 and sum(r["kept"] for r in got) == 300
    assert all(r["group_size"] == len(groups[r["text"]]) and r["keep_id"] == max(groups[r["text"]], key=lambda i: i or 0) for r in got)
    seen = []
    real = exact_dedup.merge
    monkeypatch.setattr(exact_dedup, "merge", lambda index, batch, shards: (seen.append(shards), real(index, batch, shards))[1])
    exact_dedup.exact_dedup(df)
    assert seen[0] >= 8  # however ids are spread
    mixed = mixing._placed(df.select("doc_id", "text", "source"), mixing.WEIGHTS, mixing.BUDGET, mixing.MOST, 64, "x")
    assert mixed.select("_salt").distinct().count() > 40
    assert abs(mixed.agg({"taken": "sum"}).first()[0] - 1.5 * 800) <= 4


def test_long_words_are_not_kept_in_tables():
    from tokenizers import Tokenizer

    p5, p7 = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(2)
    texts = ["ab" * 600_000, "x" * 1_000_001 + ".", "é漢" * 100_000, "".join(r.choice("acgt") for _ in range(200_000)), "short words stay here"]
    codec, counter = bpe_codec.Codec(p5), token_counts.Counter(p7)
    for _ in range(2):
        coded, counted = codec.code(texts), counter.count(texts)
    assert max(map(len, [*codec.ids, *codec.text, *counter.memo, *counter.spaced])) <= 64
    one, other = Tokenizer.from_file(p5), Tokenizer.from_file(p7)
    for t, (n, ids, decoded), m in zip(texts, coded, counted, strict=True):
        want = one.encode(t, add_special_tokens=False).ids
        assert n == len(want) and ids == " ".join(map(str, want)) and decoded == one.decode(want, skip_special_tokens=False)
        assert m == len(other.encode(t, add_special_tokens=False).ids)


# -- the pipeline's stages by other means


def brute_quality(rows):
    def kept(t):
        raw, w = t.encode(), t.split()
        if len(w) < 10:
            return False
        at = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(at)
        if 100 * len({i + k for i, x in enumerate(at) if n[x] > 1 for k in range(5)}) > 20 * len(w):
            return False
        ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b))
        low, high = next((low, high) for size, low, high in reversed(quality_rules.BANDS) if len(raw) >= size)
        parts = [raw[k : k + 4096] for k in range(0, len(raw) - 4095, 4096)]
        if parts and len(raw) % 4096:
            parts.append(raw[-4096:])
        return low <= ratio(raw) <= high and 4 * sum(not 1.45 <= ratio(p) <= 4.5 for p in parts) <= len(parts)

    return [r for r in rows if r[1] and kept(r[1])]


def brute_exact(rows):
    best = {}
    for r in rows:
        if r[1] not in best or (r[0] is not None and (best[r[1]][0] is None or r[0] > best[r[1]][0])):
            best[r[1]] = r
    return list(best.values())


def brute_near(rows):
    sets, prints = [], []
    for r in rows:
        w = r[1].encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        prints.append(simhash.fingerprint(r[1].encode()))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 2 or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_stages_match_brute_force(spark, docs):
    r = random.Random(4)
    noise = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/ ") for _ in range(9000))
    more = [(900, noise, "en", "s1", 9000), (901, "the same line again\n" * 50, "en", "s1", 1000), (902, " ".join(f"item {k} " + "-" * 70 for k in range(300)), "en", "s1", 1), (903, words(r, 3000), "en", "s2", 1)]
    before = docs.unionByName(spark.createDataFrame(more, BASE))
    for name, stage, brute in (("quality", corpus_pipeline.quality, brute_quality), ("exact", corpus_pipeline.exact, brute_exact), ("near", corpus_pipeline.near, brute_near)):
        rows = list(map(tuple, before.collect()))
        want = brute(rows)
        after = stage(spark, before, None)
        assert sorted(map(str, map(tuple, after.collect()))) == sorted(map(str, want)), name
        assert len(want) < len(rows), name
        before = spark.createDataFrame(after.collect(), BASE)
    drawn = {(x["doc_id"], x["text"]): x["copies"] for x in mixing.mix(before).collect()}
    mixed = Counter((x["doc_id"], x["text"]) for x in corpus_pipeline.mix(spark, before, None).collect())
    assert mixed == {k: n for k, n in drawn.items() if n}
