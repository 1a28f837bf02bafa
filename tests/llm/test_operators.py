"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from weftgraph.llm import bpe_codec, components, exact_dedup, html_text, mixing, quality_rules, simhash, substring_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and parse graph node café naïve 漢字 it's don't 12 3.5 a,b <|endoftext|> x\x1cy … ﬁ Σας İx".split(" ")


def some_texts(seed=1, n=60):
    r = random.Random(seed)
    out = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 60))) for _ in range(n)]
    out += [o.replace(" ", "\n", 2).replace(" ", "  \t", 1) for o in out[:10]]
    return out + ["", " ", "\n\t ", "word", "a" * 3000, "é" * 500, "La La " * 400, " lead", "trail ", "a b   c", "é ẹ̇", "H̱"]


def rows(texts):
    r = random.Random(5)
    base = [(k, t, "en", f"s{min(k % 7, 3)}", len(t)) for k, t in enumerate(texts)]
    base += [(None, None, None, None, None), (None, "word", None, None, None), (3, None, "en", "s0", 0), (1000, base[0][1], "en", "s1", 1), base[2], base[2], (-5, base[1][1], "en", "é", 2)]
    r.shuffle(base)
    return base


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(some_texts()), SCHEMA).repartition(3)
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def ordered(it):
    return sorted(it, key=str)


def test_exact_dedup(spark, docs, empty):
    got = exact_dedup.exact_dedup(docs.withColumnRenamed("lang", "kept")).collect()
    assert len(got) == docs.count() and "source" in got[0].asDict()
    groups = {}
    for r in docs.collect():
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    kept = Counter(r["text"] or "" for r in got if r["kept"])
    assert kept == Counter(dict.fromkeys(groups, 1))
    for r in got:
        ids = groups[r["text"] or ""]
        best = max(ids, key=lambda i: (i is not None, i or 0))
        assert (r["keep_id"], r["group_size"]) == (best, len(ids)) and (not r["kept"] or r["doc_id"] == best)
        assert r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_perfect_hash():
    import numpy as np

    d = np.frombuffer(b"".join(hashlib.sha256(b"%d" % k).digest() for k in range(5000)), np.uint8).reshape(-1, 32)
    h = exact_dedup.PerfectHash.build(d[:4000])
    assert sorted(h.slot(d[:4000]).tolist()) == list(range(4000))
    assert ((h.slot(d[4000:]) >= -1) & (h.slot(d[4000:]) < 4000)).all()


def test_quality_rules(docs, empty):
    def base(t):
        w = plain_words(t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines, seen, dup = [x for x in (t or "").split("\n") if plain_words(x)], set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)

    for r in quality_rules.quality_rules(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(r["text"])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_bands():
    import zstandard

    r, c = random.Random(3), zstandard.ZstdCompressor(level=3).compress
    prose = " ".join("".join(r.choice(["th", "er", "on", "an", "ed", "ing", "or"]) for _ in range(r.randint(1, 4))) for _ in range(3000)).encode()
    noise = " ".join("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(200)).encode()
    stamp = " ".join(f"item {k} " + "-" * 70 for k in range(400)).encode()
    assert quality_rules.measure(prose, c)[-1] and not quality_rules.measure(stamp, c)[-1]
    assert quality_rules.measure(noise, c)[-5] < 1.5


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_token_counts(docs, empty, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    for r in token_counts.token_counts(docs, path, limit=50).collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 50)
    assert token_counts.token_counts(empty, path).count() == 0


def test_bpe_codec(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for r in bpe_codec.bpe_codes(docs, path).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe_codec.bpe_codes(empty, path).count() == 0


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs.withColumnRenamed("lang", "target")).collect()
    assert len(got) == docs.count()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == len(plain_words(r["text"])) and r["taken"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    share, free = {}, set(size)
    while True:  # reshare until none is above
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in size if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            break
        free -= over
    for s in size:
        assert abs(target[s] - share.get(s, 2 * size[s])) < 1e-6
        assert abs(taken[s] - target[s]) <= 2 * max(r["size"] for r in got if r["source"] == s)
    assert ordered(mixing.mix(docs.repartition(5)).select("doc_id", "text", "taken").collect()) == ordered(mixing.mix(docs).select("doc_id", "text", "taken").collect())
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).columns == empty.columns
    assert mixing.emit(docs).count() == sum(r["copies"] for r in got)


PAGES = [
    ("<html><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy now, really</div><article><h1>T &amp; U</h1><p>One, two,\n three.<p>Four <b>five</b><br>six.</article><aside>side</aside><div id=comments><p>Nice, I agree, thanks</p></div><footer>f</footer></body></html>", "T & U\nOne, two, three.\nFour five six."),
    ("<body><div class='header'>Site</div><div id='c'><p>First paragraph, with commas, and length enough to count.</p><p>Second one, just as long as the first one was.</p></div><ul class=menu><li><a href=1>a</a></ul><form>f<input></form><script>if (a</b>) {'</p>'}</script>", "Site\nFirst"),
    (None, ""), ("", ""), ("just text", "just text"), ("<p>x", "x"), ("<!-- <p>no</p> --><p>yes &lt;ok&gt; &#233;</p>", "yes <ok> é"), ("<p" + ">" * 3, ">>"),
]


def test_html_text(spark):
    df = spark.createDataFrame([(k, "u", h) for k, (h, _) in enumerate(PAGES)] + [(0, "u", PAGES[0][0]), (None, None, "<p>z</p>")], "page_id long, url string, html string")
    got = {}
    for r in html_text.html_text(df.withColumn("text", df.url)).collect():
        assert r["n_chars"] == len(r["text"])
        assert got.setdefault(r["page_id"], r["text"]) == r["text"]
    for k, (_, text) in enumerate(PAGES):
        if k == 1:
            assert "First paragraph" in got[k] and "Second one" in got[k] and "Site" not in got[k].split("\n")[1:] and not re.search(r"\ba\b\n|f$|if \(", got[k])
        else:
            assert got[k] == text
    assert html_text.html_text(df.limit(0)).count() == 0
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep"


def brute_fingerprint(t, width):
    import xxhash

    w = plain_words("".join(c.lower() if c.isascii() else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + width]), seed=42).intdigest() for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(values, near):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in values:
        for b in values:
            if a < b and near(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_simhash(docs, empty):
    got = simhash.near_components(docs).collect()
    fps = {r["doc_id"]: None for r in got}
    all_ = [(r["doc_id"], brute_fingerprint(r["text"], 3)) for r in got]
    root = joined(sorted({f for _, f in all_}), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, f in all_:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    for r, (_, f) in zip(got, all_, strict=True):
        assert r["fingerprint"] == f"{f:016x}" and r["component_id"] == least.get(root[f])
    assert len(fps) and simhash.near_components(empty).count() == 0
    assert simhash.keep_one(docs).select("doc_id").count() == len(set(root.values()))


def test_links_of_fingerprints(spark):
    r = random.Random(8)
    centres = [r.getrandbits(64) for _ in range(12)]
    fps = set(centres)
    for c in centres:
        for _ in range(12):
            f = c
            for _ in range(r.randint(1, 3)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
            c = r.choice([c, f])
    signed = {simhash._signed(f): f for f in fps}
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    assert all((signed[x["a"]] ^ signed[x["b"]]).bit_count() <= 2 for x in links.collect())
    want = joined(sorted(signed), lambda a, b: (signed[a] ^ signed[b]).bit_count() <= 2)
    got = {x["node"]: x["root"] for x in components.components(links).collect()}
    assert {s: got.get(s, s) for s in signed} == want
    masks = simhash.covering_masks()
    assert len(masks) == 7 and all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))


def test_components_chain(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)]
    random.Random(1).shuffle(pairs)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}


def brute_windows(rows, width):
    first, big = {}, 1 << 63
    for d, t in rows:
        w = plain_words(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, big), big if d is None else d)
    out = []
    for d, t in rows:
        w = plain_words(t)
        gone = {i + k for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < (big if d is None else d) for k in range(width)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return ordered(out)


def test_substring_dedup(spark, empty):
    r = random.Random(4)
    passage = [r.choice("abcdefgh") for _ in range(25)]
    data = []
    for d in range(60):
        w = [r.choice("abcdefgh") for _ in range(r.randint(0, 40))]
        if d % 3 == 0:
            w[5:5] = passage[r.randint(0, 5) :]
        data.append((d, " ".join(w)))
    data += [(None, " ".join(passage)), (None, " ".join(passage)), (4, " ".join(passage)), (4, None), (70, ""), (71, data[3][1]), (71, data[3][1])]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    for width in (6, 13):
        got = substring_dedup.substring_dedup(df, width).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert ordered(tuple(x) for x in got) == brute_windows(data, width)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_pipeline(spark, docs, empty, tmp_path):
    prose = random.Random(11)
    more = [(2000 + k, " ".join(f"w{prose.randrange(5000)}" for _ in range(80)), "en", f"s{k % 3}", 1) for k in range(30)]
    table = docs.unionByName(spark.createDataFrame([*more, (3000, more[0][1], "en", "s0", 1)], SCHEMA))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    current, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, str(tmp_path))
        ids.append((name, Counter(r["doc_id"] for r in current.select("doc_id").collect())))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert current.columns == docs.columns
    steps = dict(ids)
    clean = {d for d, *_ in more} | {3000}
    assert clean <= set(steps["quality rules"])
    assert 2000 not in steps["exact dedup"] and clean - {2000} <= set(steps["exact dedup"])
    assert clean - {2000} <= set(steps["SimHash near-dedup"]) and max(steps["SimHash near-dedup"].values()) == 1
    assert steps["mixing to target weights"] == steps["BPE encoding and decoding"] and max(steps["mixing to target weights"].values()) <= 2
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, empty, "").count()
