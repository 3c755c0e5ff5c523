"""What several operators share: reading, text buffers, polynomial hashes, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lookalike.sources.scratch import written
from lookalike.sources.shipping import ship

#: Text bytes handled at a time inside a task. A longer text is handled alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_digest(column: str) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_chunks(
    batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` of consecutive whole texts.

    The bytes are a view of the Arrow buffer; offsets are relative to it. A null
    text is an empty one.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if n == 0:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    if texts.null_count:
        # Spark leaves no bytes behind a null, but Arrow does not promise it.
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        if np.any((np.diff(offsets) > 0) & ~valid):
            texts = texts.fill_null("")
            yield from text_chunks(pa.RecordBatch.from_arrays([texts], [column]), column, limit)
            return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, bytes]]:
    """``(row, UTF-8 bytes)`` of every text, null as empty."""
    for lo, hi, data, offsets in text_chunks(batch, column):
        whole = data.tobytes()
        for i in range(hi - lo):
            yield lo + i, whole[offsets[i] : offsets[i + 1]]


# --- polynomial hashes of byte ranges, modulo 2**64 -------------------------------------

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= _M1
        x ^= x >> np.uint64(27)
        x *= _M2
        x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """Hash of any range of one byte string in constant time.

    Every byte stands for a random 64-bit value, multiplied by a power of an odd
    number that follows its position. Differences of prefix sums, brought back
    to position zero by the inverse power, depend on the range's bytes only.
    """

    def __init__(self, seed: int):
        state = mixed(np.arange(1, 258, dtype=np.uint64) + np.uint64(seed * 1000))
        self.values = state[:256]
        self.base = int(state[256]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("_up", self.base), ("_down", self.inverse)):
                    powers = np.full(size, np.uint64(base))
                    powers[0] = 1
                    setattr(self, name, np.multiply.accumulate(powers))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._powers(n + 1)
        out = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.values[data] * self._up[:n], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((prefix[end] - prefix[start]) * self._down[start] + (end - start).astype(np.uint64))


# --- connected components ---------------------------------------------------------------


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the smallest node.

    Alternates two rounds until nothing changes: every node hands its larger
    neighbours its smallest neighbour, then its smaller ones. The work per round
    is linear in the edges. Every round is a written table, so lineage stays
    short and a lost executor costs one round. Minima are aggregated before the
    shuffle and the joins are plain ones, which adaptive execution splits where
    a hub has many edges.
    """

    def directed(rows: DataFrame) -> DataFrame:
        return rows.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    rows = written(directed(edges), name)
    seen = state(rows)
    while seen[0]:
        both = rows.union(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        grown = directed(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = grown.groupBy("a").agg(F.min("b").alias("m"))
        shrunk = grown.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.toDF("a", "b"))
        rows = written(directed(shrunk), name)
        now = state(rows)
        if now == seen:
            break
        seen = now
    roots = rows.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(rows.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
