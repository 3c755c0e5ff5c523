"""Frequencies of grams from compressed blocks are those of plain rows."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lookalike.operators import gram_blocks
from lookalike.operators.tfidf import gram_counts


def test_frequencies_are_those_of_plain_rows(spark):
    texts = [(i, f"alpha beta w{i % 5} ünï {i % 3}. alpha beta gamma w{i % 7}") for i in range(60)] + [(1, "alpha"), (99, None)]
    tf = gram_counts(spark.createDataFrame(texts, "doc_id BIGINT, text STRING"), ["doc_id"], F.col("text"))
    plain = tf.groupBy("gram").agg(F.sum("tf").alias("corpus_frequency"), F.count(F.lit(1)).alias("document_frequency"))
    for buckets in (1, 5):
        found = gram_blocks.gram_frequencies(tf, buckets)
        assert found.dtypes == plain.dtypes
        assert sorted(found.collect()) == sorted(plain.collect())


@pytest.mark.parametrize("most, wide", [(3, 1 << 30), (40, 1 << 10), (10_000, 1 << 30)])
def test_blocks_are_small_and_lose_nothing(monkeypatch, most, wide):
    monkeypatch.setattr(gram_blocks, "PACKED_ROWS", most)
    monkeypatch.setattr(gram_blocks, "WIDE_BYTES", wide)
    grams = [f"some words {i % 500}" for i in range(2_000)] + ["", "x"]
    rows = [(len(g) % 3, g, 1 + i % 2, 1) for i, g in enumerate(grams)]
    names = ["bucket", "gram", "cf", "df"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]

    def batch(some):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    packed = pa.Table.from_batches(gram_blocks.pack(batch(rows[i : i + 10]) for i in range(0, len(rows), 10)))
    if most == 10_000:
        assert packed.nbytes < 502 * 8
    cf, df = Counter(), Counter()
    for _, gram, n, m in rows:
        cf[gram] += n
        df[gram] += m
    found = pa.Table.from_batches(gram_blocks.unpack(packed.sort_by("bucket").to_batches(7))).to_pylist()
    assert len(found) == len(cf)
    assert all(r["cf"] == cf[r["gram"]] and r["df"] == df[r["gram"]] for r in found)
