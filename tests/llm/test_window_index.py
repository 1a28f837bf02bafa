"""The window index: batches one by one give what a whole run gives; runs are kept, compacted, and survive a lost writer."""

import random
import shutil

import pytest

from weftgraph.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string"


def texts(seed, n):
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") for _ in range(20)] for _ in range(4)]
    out = []
    for k in range(n):
        w = [r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passages)[r.randint(0, 4) :]
        out.append((k, " ".join(w)))
    return out


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("cuts", [[50], [10, 20, 30, 40, 50, 60, 70, 80, 90], [1, 2, 95]])
def test_batches_equal_the_whole(spark, tmp_path, cuts):
    data = texts(len(cuts), 100) + [(100, None), (101, ""), (102, texts(len(cuts), 100)[5][1])]
    whole = rows(sd.substring_dedup(spark.createDataFrame(data, SCHEMA), 6))
    assert sum(r[2] for r in whole) > 100
    got, path = [], str(tmp_path / "index")
    for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
        index = sd.WindowIndex(spark, path, window=6)  # opened anew for each batch
        got += rows(index.add(spark.createDataFrame(data[a:b], SCHEMA).repartition(2)))
    assert sorted(got, key=str) == whole
    index = sd.WindowIndex(spark, path)
    index.compact()
    runs = index.runs()
    assert runs[0][0] == 0 and runs[-1][1] == len(cuts) and all(x[1] + 1 == y[0] for x, y in zip(runs, runs[1:], strict=False))
    assert all(x[2] >= 2 * y[2] for x, y in zip(runs, runs[1:], strict=False))  # like sizes are merged


def test_an_unfinished_batch_is_not_in_the_index(spark, tmp_path):
    data, path = texts(9, 40), tmp_path / "index"
    sd.WindowIndex(spark, str(path), window=6).add(spark.createDataFrame(data[:20], SCHEMA)).count()
    shutil.copytree(path / "chunks" / "0", path / "chunks" / "1")  # a writer that was lost before its run
    (path / "runs" / "1-1-5").mkdir()
    index = sd.WindowIndex(spark, str(path))
    assert index.window == 6 and [r[:2] for r in index.runs()] == [(0, 0)]
    shutil.rmtree(path / "runs" / "1-1-5")
    got = rows(index.add(spark.createDataFrame(data[20:], SCHEMA)))
    assert got == [r for r in rows(sd.substring_dedup(spark.createDataFrame(data, SCHEMA), 6)) if r[0] >= 20]


def test_history_comes_first_whatever_its_ids(spark, tmp_path):
    index = sd.WindowIndex(spark, str(tmp_path / "i"), window=3)
    assert rows(index.add(spark.createDataFrame([(9, "a b c d"), (10, "x y")], SCHEMA)))[1][2] == 0
    assert [r[2] for r in rows(index.add(spark.createDataFrame([(1, "z a b c")], SCHEMA)))] == [3]
    assert index.add(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r[2] for r in rows(index.add(spark.createDataFrame([(None, "a b c d")], SCHEMA)))] == [4]


def test_query_runs_through_an_index(spark, tmp_path):
    data = texts(3, 60) + [(None, texts(3, 60)[4][1])]
    df = spark.createDataFrame(data, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(sd.query(spark, str(tmp_path))) == rows(sd.substring_dedup(df))
    df.limit(0).write.parquet(str(tmp_path / "e/documents.parquet"))
    assert sd.query(spark, str(tmp_path / "e")).count() == 0
