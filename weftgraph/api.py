"""Entry points from a checkout's path to its summary, graph, and a cached graph."""

from __future__ import annotations

import os
import shutil
import subprocess

from pyspark.sql import DataFrame, SparkSession

from .operators import build, parse
from .schemas import EDGES, NODES
from .sources import repo_files


def analyze(spark: SparkSession, path: str) -> dict:
    """Summary of a checkout."""
    return repo_files.summary(spark, path)


def build_graph(spark: SparkSession, path: str, internal: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a checkout; with ``internal`` its own packages are told from third parties."""
    packages = repo_files.internal_packages(spark, path) if internal else ()
    return build.build_graph(parse.parse(repo_files.python_sources(spark, path)), packages)


def _saved(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """A table of the cache that was written to its end, or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    done = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    return spark.read.schema(schema).parquet(folder) if done else None


def cache_reasons(spark: SparkSession, path: str, cache: str) -> list[str]:
    """Why the cached graph of a checkout can't be used, in order; none if it can."""
    digest = repo_files.fingerprint(repo_files.source_listing(spark, path)).first()["digest"]
    root = f"{cache.rstrip('/')}/{repo_files.cache_key(path)}/{digest[:16]}"
    print_ = _saved(spark, f"{root}/fingerprint", "file_count long, digest string")
    row = print_.first() if print_ is not None else None
    whole = all(_saved(spark, f"{root}/{t}", s) is not None for t, s in (("nodes", NODES), ("edges", EDGES)))
    return repo_files.stale(row.asDict() if row else None, whole, digest)


def clear_cache(spark: SparkSession, path: str, cache: str) -> bool:
    """Delete what is cached of a checkout; whether there was anything."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{cache.rstrip('/')}/{repo_files.cache_key(path)}")
    return bool(folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True))


def cached_graph(spark: SparkSession, path: str, cache: str) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges, whether they came from the cache): tables in ``cache``, a folder Spark can write, keyed by the files' digest.

    A digest has its own folder, and its fingerprint is written last, so that a
    cache that was not finished is never read.  Errors of reading are raised.
    """
    print_ = repo_files.fingerprint(repo_files.source_listing(spark, path))
    digest = print_.first()["digest"]
    root = f"{cache.rstrip('/')}/{repo_files.cache_key(path)}/{digest[:16]}"
    hit = not cache_reasons(spark, path, cache)
    if not hit:
        nodes, edges = build_graph(spark, path)
        nodes.write.mode("overwrite").parquet(f"{root}/nodes")
        edges.write.mode("overwrite").parquet(f"{root}/edges")
        print_.write.mode("overwrite").parquet(f"{root}/fingerprint")
    return spark.read.schema(NODES).parquet(f"{root}/nodes"), spark.read.schema(EDGES).parquet(f"{root}/edges"), hit


def clone(url: str, folder: str) -> str:
    """Clone a repository into ``folder`` with git, in place of what is there; its path. The folder's name is the last part of the URL."""
    name = url.rstrip("/").rsplit("/", 1)[-1]
    target = os.path.join(folder, name)
    if not name or name in (".", ".."):
        raise ValueError(f"no repository name in {url!r}")
    if os.path.isdir(target):
        shutil.rmtree(target)
    os.makedirs(folder, exist_ok=True)
    done = subprocess.run(["git", "clone", "--", url, target], capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git clone failed: {done.stderr.strip()}")
    return target


def repository_path(name: str, own: dict[str, str], urls: dict[str, str], folder: str) -> str:
    """Where a repository is: one of ``own`` by name, or a checkout in ``folder``, cloned if it isn't there."""
    if name in own:
        return own[name]
    path = os.path.join(folder, name.lower())
    return path if os.path.isdir(path) else clone(urls[name], folder)
