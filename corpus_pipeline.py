"""Training-data pipeline over ``documents``: rules, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns a DataFrame; all but the last return the columns of ``documents``.
The stages see whole texts and carry whole rows.  No stage is SQL as a whole
(compression, fingerprint components, BPE), so that ORACLE_SQL is None; the
tests hold each stage, on its own input, against a brute-force version.

Defined results: what each operator's docstring says of nulls, empty and long
texts and ties holds for its stage; of rows that repeat an id and a text one
stays after exact dedup; a null id is kept like any other; an empty table passes
every stage empty; columns beside doc_id, text and source pass through untouched,
whatever their names; the last stage returns doc_id and what encoding makes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe_codec, exact_dedup, mixing, quality_rules, simhash
from weftgraph.llm._common import documents, materialize, tucked


def _kept(docs: DataFrame, decide) -> DataFrame:
    """The rows of ``docs`` that an operator keeps, its columns out of the way of what the operator adds."""
    packed, out = tucked(docs, "doc_id", "text")
    return out(decide(packed).filter("kept"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, quality_rules.quality_rules)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, exact_dedup.exact_dedup)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, sets=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.bpe_codes(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing to target weights", mix),
    ("BPE encoding and decoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
