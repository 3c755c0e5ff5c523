"""Near duplicates by SimHash fingerprints, found in a byte-position inverted index.

A fingerprint has eight bytes. Two fingerprints that differ in at most two bits
share at least six bytes at the same positions. That is the count filter: a
posting of the index is a set of six positions with their bytes, and a pair
meets in a posting exactly if its tally of shared positional bytes reaches six.
What can still differ there are two bytes, so a posting holds at most 65,536
distinct fingerprints, whatever the size of the corpus. Inside a posting pairs
are verified bit by bit and reported as links to one member of each local
group, so links grow with the postings and not with their squares.

Defined results: a null or blank text has fingerprint zero and is linked like
any other; repeated rows get equal rows; a null ``doc_id`` belongs to its group
but never names it (a group of nulls only has a null ``component_id``); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lookalike.llm.common import components, text_bytes
from lookalike.sources.scratch import written

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
BYTES = 8
#: Shingles whose bits are spread out at a time.
BLOCK = 1 << 14


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' hashes.

    ``bytes.lower`` and ``bytes.split`` know ASCII only: A-Z, and the blanks
    0x20 and 0x09 to 0x0D.
    """
    words = text.lower().split()
    if not words:
        return 0
    runs = [words[i:] for i in range(min(shingle_words, len(words)))]
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    n = len(runs[-1])
    hashes = np.fromiter(map(digest, map(b" ".join, zip(*runs))), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        block = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of ``docs (doc_id, text)``; ``fp`` holds the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(text) for _, text in text_bytes(batch)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def positional_postings(fps: DataFrame, shared: int = BYTES - MAX_BITS) -> DataFrame:
    """Postings ``(positions, bytes, members)`` with more than one distinct fingerprint."""
    masks = [
        sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(BYTES), shared)
    ]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    def posting(i: int, mask: int) -> Column:
        return F.struct(F.lit(i).alias("positions"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bytes"))

    # Few narrow rows become many: adaptive execution must not merge them before.
    tasks = 2 * fps.sparkSession.sparkContext.defaultParallelism
    keys = fps.repartition(tasks, "fp").select("fp", F.inline(F.array(*(posting(i, m) for i, m in enumerate(signed)))))
    grouped = keys.groupBy("positions", "bytes").agg(F.count(F.lit(1)).alias("n"), F.collect_list("fp").alias("members"))
    return grouped.where("n > 1").select("members")


def links_in_posting(members: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly the groups of ``members`` under ``max_bits`` or fewer bits.

    Neighbours are looked up by flipping bits among those in which the members
    differ at all, 16 at most, so the work is linear in the members.
    """
    members = np.unique(members)
    apart = int(np.bitwise_or.reduce(members ^ members[0]))
    bits = [1 << b for b in range(64) if apart >> b & 1]
    flips = [sum(c) for k in range(1, max_bits + 1) for c in combinations(bits, k)]
    label = np.arange(len(members))
    left, right = [], []
    for flip in flips:
        other = members ^ np.uint64(flip)
        at = np.minimum(np.searchsorted(members, other), len(members) - 1)
        hit = np.flatnonzero((members[at] == other) & (other > members))
        left.append(hit)
        right.append(at[hit])
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    far = np.flatnonzero(label != np.arange(len(members)))
    return members[far], members[label[far]]


def near_links(fps: DataFrame) -> DataFrame:
    """``(a, b)`` links between distinct fingerprints, enough for their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            lists = batch.column(0)
            values = lists.flatten().to_numpy().view(np.uint64)
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            for i in range(len(lists)):
                found.append(links_in_posting(values[ends[i] : ends[i + 1]]))
            a, b = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in zip(*found)) if found else ([], [])
            arrays = [pa.array(np.asarray(x, np.uint64).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    return positional_postings(fps).mapInArrow(run, "a long, b long")


def _grouped(fps: DataFrame) -> DataFrame:
    """``(fp, first_id, root)`` of the distinct fingerprints in ``fps (doc_id, fp)``; equal roots are one group."""
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(near_links(first.select("fp")), "simhash-links")
    return first.join(roots, first.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )


def simhash_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs``."""
    rows = written(fingerprints(docs), "simhash-fingerprints")
    member = _grouped(rows)
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = member.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, unchanged.

    The smallest id stays, of rows with that id the first one; a row without an id
    stays only if its whole group has none. Rows are written with their fingerprint
    and a number, so that a row is the same one in all steps.
    """
    fp, serial = (next(n for n in (base + "_" * i for i in range(99)) if n not in docs.columns) for base in ("fp", "serial"))
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(text_at).cast(pa.string())], ["text"])
            fps = np.fromiter((fingerprint(text) for _, text in text_bytes(texts)), np.uint64, batch.num_rows)
            numbers = pa.array(at + np.arange(batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(fps.view(np.int64)), numbers], [*batch.schema.names, fp, serial]
            )
            at += batch.num_rows

    schema = StructType([*docs.schema.fields, StructField(fp, LongType()), StructField(serial, LongType())])
    rows = written(docs.mapInArrow(run, schema), "simhash-rows")
    marks = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(serial).alias("serial"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "serial")
    least = marks.join(_grouped(marks).select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("least"))
    stay = least.select(F.col("least.serial").alias(serial))
    return rows.join(stay, serial, "left_semi").select(*docs.columns)
