"""Frequencies of grams over a corpus, with grams packed into blocks before they are shuffled.

Most grams of a corpus occur once, so adding them up in every task leaves nearly all of them,
and a row of Spark takes some 60 bytes for a gram and its two counts. Here a task sorts the grams it
has, and those whose first characters have the same hash go into a compressed block, where
neighbours share their beginning. The blocks of a bucket meet in one task, which adds them up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lookalike.sources.shipping import ship

#: Characters of a gram that decide where it goes.
PREFIX = 8
#: Rows that a task adds up at a time.
PACKED_ROWS = 1_600_000
#: Text whose grams make a bucket: some three million rows, or 120 MB.
BUCKET_TEXT_BYTES = 8 << 20
#: Rows of a batch that leaves a task.
BATCH_ROWS = 65_536

_ROWS = pa.schema([("gram", pa.string()), ("cf", pa.int64()), ("df", pa.int64())])
#: Where 32-bit offsets might not reach. Arrow adds up rows with wider ones six times as slowly.
WIDE_BYTES = 1 << 30
_ZSTD = pa.Codec("zstd")

def _added(rows: pa.Table) -> pa.Table:
    """Rows ``(gram, cf, df)`` with each gram once; of a ``bucket`` beside them the one of the gram."""
    if rows.nbytes > WIDE_BYTES:
        rows = rows.set_column(rows.column_names.index("gram"), "gram", rows.column("gram").cast(pa.large_string()))
    sums = [("cf", "sum"), ("df", "sum"), *([("bucket", "min")] if "bucket" in rows.column_names else [])]
    found = rows.group_by("gram", use_threads=False).aggregate(sums)
    return found.rename_columns([name.split("_")[0] for name in found.column_names])


def encoded(rows: pa.RecordBatch) -> bytes:
    """``rows (gram, cf, df)`` without nulls as bytes: lengths and counts byte by byte, and the characters, compressed."""
    n, grams = len(rows), rows.column("gram")
    offsets = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + n + 1]
    numbers = (np.diff(offsets).astype("<i8"), *(rows.column(c).to_numpy().astype("<i8", copy=False) for c in ("cf", "df")))
    places = np.concatenate([x.view(np.uint8).reshape(n, 8).T.ravel() for x in numbers])
    text = grams.buffers()[2][offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else b""
    plain = places.tobytes() + bytes(text)
    head = np.array([n, len(plain)], "<i8").tobytes()
    return head + _ZSTD.compress(plain, asbytes=True)


def decoded(block: bytes) -> pa.Table:
    n, size = np.frombuffer(block, "<i8", 2)
    plain = _ZSTD.decompress(block[16:], int(size))
    places = np.frombuffer(plain, np.uint8, 24 * n)
    length, cf, df = (np.ascontiguousarray(x.reshape(8, n).T).view("<i8").ravel() for x in np.split(places, 3))
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    grams = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), plain.slice(24 * n)])
    return pa.table([grams, pa.array(cf), pa.array(df)], schema=_ROWS)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(bucket, block)`` of rows ``(bucket, gram, cf, df)``."""
    held, rows = [], 0

    def blocks() -> Iterator[pa.RecordBatch]:
        table = _added(pa.Table.from_batches(held)).sort_by("gram").combine_chunks()
        order = np.argsort(table.column("bucket").to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        bucket = table.column("bucket").to_numpy()
        edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
        plain = table.select(["gram", "cf", "df"]).cast(_ROWS).to_batches()
        packed = [encoded(plain[0].slice(lo, hi - lo)) for lo, hi in zip(edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int32()), pa.array(packed, pa.binary())], ["bucket", "block"])

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= PACKED_ROWS:
            yield from blocks()
            held, rows = [], 0
    if rows:
        yield from blocks()


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(gram, cf, df)`` of rows ``(bucket, block)`` in the order of their buckets."""
    now, held, rows = None, [], 0

    def added() -> pa.Table:
        return _added(pa.concat_tables(held, promote_options="permissive"))

    def ended() -> Iterator[pa.RecordBatch]:
        for batch in added().to_batches(BATCH_ROWS) if held else ():
            yield batch.cast(_ROWS)

    for batch in batches:
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block")):
            if bucket != now:
                yield from ended()
                now, held, rows = bucket, [], 0
            held.append(decoded(block.as_py()))
            rows += len(held[-1])
            if rows >= max(PACKED_ROWS, len(held[0])):
                # What is alike is added up on the way, again when as much has come.
                held, rows = [added()], 0
    yield from ended()


def gram_frequencies(tf: DataFrame, buckets: int) -> DataFrame:
    """``(gram, corpus_frequency, document_frequency)`` of ``tf (..., gram, tf)``, a row for each gram of a document."""
    ship(tf.sparkSession)
    bucket = F.pmod(F.xxhash64(F.substring("gram", 1, PREFIX)), F.lit(buckets)).cast("int").alias("bucket")
    rows = tf.select(bucket, "gram", F.col("tf").alias("cf"), F.lit(1).cast("bigint").alias("df"))
    blocks = rows.mapInArrow(pack, "bucket INT, block BINARY").repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    found = blocks.mapInArrow(unpack, "gram STRING, cf BIGINT, df BIGINT")
    return found.select("gram", F.col("cf").alias("corpus_frequency"), F.col("df").alias("document_frequency"))
