"""Partitions follow the bytes, not a fixed number."""

import pytest
from pyspark.sql import functions as F

from lookalike.operators.code_trees import code_tree_nodes
from lookalike.operators.pairs import pair_slots, slot_sides
from lookalike.operators.parts import CODE_TEXT_BYTES, GRAM_TEXT_BYTES, parts_for, row_bytes
from lookalike.operators.tfidf import gram_counts

PARTS = 40


@pytest.fixture
def long_texts(spark):
    """``PARTS`` documents of the text of one partition each; one word, so that they are cheap."""
    return spark.range(PARTS).select(F.col("id").alias("doc_id"), F.expr(f"repeat('x', {GRAM_TEXT_BYTES})").alias("text"))


def test_slots_get_partitions_by_the_bytes_of_their_sides(spark, long_texts):
    pairs = spark.range(1, PARTS).select(F.lit(0).cast("bigint").alias("doc1"), F.col("id").alias("doc2"))
    sides = slot_sides(pair_slots(pairs), long_texts, ["text"])
    assert sides.rdd.getNumPartitions() >= PARTS


def test_counted_grams_get_partitions_by_the_bytes_of_their_texts(long_texts):
    counted = gram_counts(long_texts, ["doc_id"], F.col("text"), longest=1)
    assert counted.rdd.getNumPartitions() >= PARTS
    assert counted.count() == PARTS


def test_code_trees_get_partitions_by_the_bytes_of_their_texts(spark):
    files = spark.range(PARTS).select(F.col("id").alias("doc_id"), F.expr(f"concat(repeat(' ', {CODE_TEXT_BYTES}), 'a;')").alias("text"))
    assert code_tree_nodes(files).rdd.getNumPartitions() >= PARTS


def test_small_empty_and_null_rows_get_a_partition_for_every_core(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.createDataFrame([(1, "abc", [1]), (2, None, None)], "doc_id LONG, text STRING, shapes ARRAY<INT>")
    for name, kind in (("text", "string"), ("shapes", "array<int>")):
        assert parts_for(rows, row_bytes(kind, name), GRAM_TEXT_BYTES) == cores
        assert parts_for(rows.limit(0), row_bytes(kind, name), GRAM_TEXT_BYTES) == cores
    assert parts_for(rows, row_bytes("string", "text"), 1) == max(3, cores)
