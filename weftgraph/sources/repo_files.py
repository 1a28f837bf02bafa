"""Files of a checkout as a Spark data source, with the summaries made of them.

``binaryFile`` skips names that begin with ``_`` or ``.``, and so every
``__init__.py``; this source lists all.  Paths are grouped, FILES_A_TASK to a
partition, and contents are read by the executors only if they are asked for.
The checkout must be on storage that driver and executors mount alike.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import vocab
from ..functions.text import extension, file_category, language

FILES_A_TASK = 256


class _Paths(InputPartition):
    def __init__(self, paths: list[tuple[str, bool]]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str, skip: frozenset[str], content: bool):
        self.root, self.skip, self.content = os.path.abspath(root), skip, content

    def partitions(self) -> list[_Paths]:
        found: list[tuple[str, bool]] = []
        for top, dirs, files in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if d not in self.skip)
            found += [(os.path.join(top, d), True) for d in dirs] + [(os.path.join(top, f), False) for f in sorted(files)]
        return [_Paths(found[k : k + FILES_A_TASK]) for k in range(0, len(found), FILES_A_TASK)] or [_Paths([])]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        for path, is_dir in partition.paths:
            rel = os.path.relpath(path, self.root).replace(os.sep, "/")
            try:
                stat = os.stat(path)
                body = None
                if self.content and not is_dir:
                    with open(path, "rb") as f:
                        body = f.read()
            except OSError:
                continue  # unreadable files are no part of the repository
            yield (path, rel, os.path.basename(path), int(stat.st_size), float(stat.st_mtime), rel.count("/") + 1, is_dir, body)


class RepoFiles(DataSource):
    """Options: path; skip (names of directories, comma-separated); content (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return "path string, rel_path string, name string, size bigint, mtime double, depth int, is_dir boolean, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], frozenset(filter(None, self.options.get("skip", "").split(","))), self.options.get("content", "false") == "true")


def repo_files(spark: SparkSession, path: str, skip: tuple[str, ...] = vocab.EXCLUDED_DIRS, content: bool = False) -> DataFrame:
    spark.dataSource.register(RepoFiles)
    return spark.read.format("repo_files").options(path=path, skip=",".join(skip), content=str(content).lower()).load()


def python_sources(spark: SparkSession, path: str) -> DataFrame:
    """(rel_path, content) of the Python files that are no tests."""
    files = repo_files(spark, path, vocab.SKIPPED_SOURCE_DIRS, True).filter("NOT is_dir")
    name = F.col("name")
    return files.filter(name.endswith(".py") & ~name.startswith("test_") & ~name.endswith("_test.py")).select("rel_path", "content")


def fingerprint(files: DataFrame) -> DataFrame:
    """(file_count, digest) of a listing: changes with any path, time or size. Hashes of the files are joined by exclusive or, in any order."""
    h = F.sha2(F.to_json(F.struct("rel_path", "mtime", "size")), 256)
    part = lambda k: F.lower(F.lpad(F.hex(F.coalesce(F.bit_xor(F.conv(F.substring(h, 15 * k + 1, 15), 16, 10).cast("long")), F.lit(0))), 15, "0"))
    return files.filter("NOT is_dir").agg(F.count("*").alias("file_count"), F.concat(*[part(k) for k in range(4)]).alias("digest"))


def source_listing(spark: SparkSession, path: str) -> DataFrame:
    return repo_files(spark, path, (*vocab.SKIPPED_SOURCE_DIRS, ".cache")).filter(F.col("name").endswith(".py") & ~F.col("name").startswith("test_") & ~F.col("name").endswith("_test.py"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel_path, change) between two listings: added, removed or modified."""
    o, n = old.filter("NOT is_dir").select("rel_path", F.struct("mtime", "size").alias("o")), new.filter("NOT is_dir").select("rel_path", F.struct("mtime", "size").alias("n"))
    both = o.join(n, "rel_path", "full")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified")
    return both.select("rel_path", kind.alias("change")).filter("change IS NOT NULL")


def stale(saved: dict | None, nodes_exist: bool, digest: str) -> list[str]:
    """Why a cached graph can't be used, in order; none if it can."""
    if saved is None:
        return ["fingerprint missing or unreadable"]
    return [*([] if nodes_exist else ["graph missing"]), *([] if saved["digest"] == digest else ["files changed"])]


def cache_key(path: str) -> str:
    name = os.path.basename(os.path.abspath(path))
    return re.sub(r"[^A-Za-z0-9_.-]", "_", name) + "_" + hashlib.sha256(os.path.abspath(path).encode()).hexdigest()[:8]


def classified(files: DataFrame) -> DataFrame:
    out = files.filter("NOT is_dir").withColumn("extension", extension("name"))
    return out.withColumn("language", language("extension")).withColumn("category", file_category("extension", "rel_path"))


def framework(spark: SparkSession, files: DataFrame) -> str | None:
    """Web framework named in the first manifest that names one; ``files`` with content."""
    order = F.when(F.col("rel_path") == "pyproject.toml", 0).when(F.col("rel_path") == "requirements.txt", 1)
    text = F.lower(F.col("content").cast("string"))
    found = reduce(lambda w, n: w.when(text.contains(n.lower()), n), ("Django", "Flask"), F.when(text.contains("fastapi"), "FastAPI"))
    row = files.filter(order.isNotNull()).select(order.alias("o"), found.alias("f")).filter("f IS NOT NULL").orderBy("o").first()
    return row["f"] if row else None


def repository_type(found: str | None) -> str:
    return "Backend API" if found in ("FastAPI", "Django", "Flask") else "General Software Project"


def summary(spark: SparkSession, path: str) -> dict:
    """Totals, distributions, top-level directories and the ten largest files of a checkout."""
    files = repo_files(spark, path)
    kinds = classified(files).cache()
    count = lambda c: {r[0]: r[1] for r in kinds.filter(F.col(c).isNotNull()).groupBy(c).count().collect()}  # noqa: E731  few kinds
    totals = files.agg(F.count_if(~F.col("is_dir")), F.count_if("is_dir"), F.sum(F.when(~F.col("is_dir"), F.col("size")))).first()
    found = framework(spark, repo_files(spark, path, content=True).filter("depth = 1"))
    out = {
        "repository_name": os.path.basename(path.rstrip("/")), "repository_path": path, "framework": found, "repository_type": repository_type(found),
        "total_files": totals[0], "total_directories": totals[1], "repository_size_bytes": totals[2] or 0, "language_distribution": count("language"),
        "file_extension_distribution": count("extension"), "file_category_distribution": count("category"),
        "top_level_directories": sorted(r[0] for r in files.filter("is_dir AND depth = 1").select("name").collect()),
        "largest_files": [{"file": r[0], "size_bytes": r[1]} for r in kinds.orderBy(F.desc("size"), "rel_path").select("rel_path", "size").limit(10).collect()],
    }
    kinds.unpersist()
    return out


def internal_packages(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Top-level directories that are Python packages."""
    rows = repo_files(spark, path).filter("depth = 2 AND name = '__init__.py'").select(F.substring_index("rel_path", "/", 1)).distinct().collect()
    return tuple(sorted(r[0] for r in rows))
