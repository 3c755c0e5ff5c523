"""A training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept,
and is written before the next one starts. All but the last return the columns
of ``documents``:

* ``language``: documents without a language go;
* ``near_duplicates``: one document of each group stays, the smallest id; documents link
  whose SimHash fingerprints differ in two bits or fewer;
* ``decontamination``: documents that hold a benchmark item go;
* ``mixing``: documents are kept as often as the mix of their source takes them;
* ``tokens``: the token files' digest, one row per document.

Nulls, empty tables and repeated rows are handled as each operator's module says.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lookalike.llm import decontaminate, language_id, mixture, simhash_dedup, token_files
from lookalike.llm.common import ship, table
from lookalike.sources.scratch import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return language_id.keep_identified(docs, language_id.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixture.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: The stages are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
