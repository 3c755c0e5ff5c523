"""One query per operator of this subpackage, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lookalike.llm import (
    decontaminate,
    edit_counts,
    embedding_dedup,
    language_id,
    lexical_search,
    license_scan,
    maxent_lm,
    mixture,
    simhash_dedup,
    spelling,
    suffix_dedup,
    token_files,
    toxicity,
)
from lookalike.llm.common import table
from lookalike.llm.oracles import SEARCH, SPELLING


#: The vocabulary file of the queries that count or write tokens.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.log_likelihoods(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn(docs.where(~language_id.held_out()))
    predicted = language_id.identify(docs, profiles).withColumn("held_out", language_id.held_out())
    return predicted.select("doc_id", "held_out", "lang_pred", "score")


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    revised = docs.select("doc_id", "text", edit_counts.revision(F.col("text"), F.col("doc_id")).alias("edits"))
    found = edit_counts.recounted(edit_counts.token_trees(revised, TOKENIZER), TOKENIZER)
    return found.drop("chars", "tokens")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs.where(~toxicity.held_out()), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out())
    return scored.select("doc_id", "held_out", "score", "predicted", "sentences", "offending")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.spelling_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: build for name, build in list(globals().items()) if name.startswith("op") and name[2:3].isdigit()
}

#: The other operators cannot be said in SQL; tests hold them against brute force.
ORACLES: dict[str, str] = {"op12_lexical_search": SEARCH, "op13_spelling_variants": SPELLING}
