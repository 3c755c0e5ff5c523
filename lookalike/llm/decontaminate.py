"""Benchmark decontamination with SimHash over item-sized windows.

A document is contaminated by a benchmark item if one of its windows of as many
words as the item holds at least ``THRESHOLD`` of the item's five-word shingles,
weighted by their length. Windows are placed so that a shared shingle stands
where the item has it; a window that shares no shingle has similarity zero, so
leaving it out loses nothing. Every such window gets a SimHash fingerprint. A
multi-index over the fingerprints of the items of that size retrieves all items
within ``RADIUS`` bits: of eight bytes, one at least differs in no more than
``RADIUS // 8`` bits, so looking up every byte in a table of bytes within that
distance finds them all. Retrieved items are then verified exactly, on the
shingles' bytes. A window at the threshold differs from its item in 13 bits on
average, with a deviation of 3, which the radius covers.

The items are the stated query set. They come to the driver and to the tasks in
blocks of at most ``ITEM_BLOCK``, one pass over the documents for each block.

Defined results: null and blank texts match nothing; items without words match
nothing; an item of fewer than five words is one shingle; repeated rows get
equal rows; without items or documents the result is empty; other columns are
ignored by ``matches`` and passed through by ``keep_clean``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lookalike.llm.words import HashSet, Words, hash_of, normalized, shingles_of, word_chunks

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RADIUS = 24
#: Items that are matched in one pass; their shingles take a few kilobytes each.
ITEM_BLOCK = 20_000
#: Shingles of windows whose bits are spread out at a time.
WINDOW_SHINGLES = 1 << 16

_NEAR = np.array([[(a ^ b).bit_count() for b in range(256)] for a in range(256)]) <= RADIUS // 8


def simhash(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingle hashes ``(n, m)`` with weights ``(n, m)``."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(*hashes.shape, 8), axis=2, bitorder="little")
    ones = np.einsum("nmb,nm->nb", bits.astype(np.float32), weights.astype(np.float32))
    above = 2 * ones > weights.sum(axis=1, keepdims=True)
    return np.packbits(above, axis=1, bitorder="little").view("<u8").ravel()


class Items:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids: list[int] = []
        self.words: list[int] = []
        self.shingles: list[Counter] = []
        postings: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = normalized((text or "").encode("utf-8", "replace")).split()
            runs = shingles_of(words, SHINGLE_WORDS)
            if not runs:
                continue
            for offset, run in enumerate(runs):
                postings.setdefault((min(len(words), SHINGLE_WORDS), run), []).append((len(self.ids), offset))
            self.ids.append(item_id)
            self.words.append(len(words))
            self.shingles.append(Counter(runs))
        self.by_length: dict[int, tuple[HashSet, list, list]] = {}
        for length in sorted({n for n, _ in postings}):
            runs = sorted((hash_of(run), run) for n, run in postings if n == length)
            found = HashSet(np.array([h for h, _ in runs], np.uint64))
            self.by_length[length] = (found, [r for _, r in runs], [postings[length, r] for _, r in runs])
        self.total = [sum(n * len(run) for run, n in c.items()) for c in self.shingles]
        prints = [self._print(c) for c in self.shingles]
        self.sizes = {
            size: np.array([i for i, n in enumerate(self.words) if n == size]) for size in sorted(set(self.words))
        }
        self.prints = {size: np.array([prints[i] for i in own], np.uint64) for size, own in self.sizes.items()}

    @staticmethod
    def _print(shingles: Counter) -> int:
        runs = list(shingles.elements())
        hashes = np.array([[hash_of(r) for r in runs]], np.uint64)
        return int(simhash(hashes, np.array([[len(r) for r in runs]], float))[0])

    def within(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(window, item)`` of all fingerprints that differ in ``RADIUS`` bits or fewer."""
        own = self.prints[size]
        item_bytes = own.astype("<u8").view(np.uint8).reshape(-1, 8)
        print_bytes = prints.astype("<u8").view(np.uint8).reshape(-1, 8)
        retrieved = np.zeros((len(prints), len(own)), bool)
        for block in range(8):
            # Row b lists the items whose byte is near b.
            retrieved |= _NEAR[:, item_bytes[:, block]][print_bytes[:, block]]
        window, item = np.nonzero(retrieved)
        near = np.bitwise_count(prints[window] ^ own[item]) <= RADIUS
        return window[near], self.sizes[size][item[near]]

    def similarity(self, item: int, window: Counter) -> float:
        shared = sum(len(run) * min(n, window[run]) for run, n in self.shingles[item].items())
        return shared / self.total[item]

    def scan(self, chunk: Words) -> dict[tuple[int, int], tuple[float, int]]:
        """Best ``(similarity, first word)`` of every ``(document, item)`` that match."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for length, (known, runs, postings) in self.by_length.items():
            hashes, inside = chunk.runs(length)
            at, place = known.find(hashes)
            at, place = at[inside[at]], place[inside[at]]
            wanted: dict[int, set[tuple[int, int]]] = {}
            docs = chunk.document(at)
            for word, which, doc in zip(at.tolist(), place.tolist(), docs.tolist()):
                if chunk.run(word, length) != runs[which]:
                    continue
                lo, hi = int(chunk.first[doc]), int(chunk.first[doc + 1])
                for item, offset in postings[which]:
                    size = self.words[item]
                    start = max(lo, min(word - offset, hi - size))
                    wanted.setdefault(size, set()).add((start, doc))
            for size, windows in wanted.items():
                ordered = sorted(windows)
                step = max(1, WINDOW_SHINGLES // size)
                for i in range(0, len(ordered), step):
                    self._verify(chunk, hashes, length, size, ordered[i : i + step], best)
        return best

    def _verify(self, chunk: Words, hashes: np.ndarray, length: int, size: int, windows: list, best: dict) -> None:
        start = np.array([w for w, _ in windows])
        end = chunk.first[np.array([d for _, d in windows]) + 1]
        at = start[:, None] + np.arange(size - length + 1)
        real = at + length <= end[:, None]
        at = np.minimum(at, len(hashes) - length)
        weights = np.where(real, chunk.ends[at + length - 1] - chunk.starts[at], 0)
        prints = simhash(np.where(real, hashes[at], np.uint64(0)), weights)
        counted: dict[int, Counter] = {}
        for w, item in zip(*(x.tolist() for x in self.within(size, prints))):
            if w not in counted:
                counted[w] = Counter(chunk.run(int(a), length) for a in at[w][real[w]])
            similarity = self.similarity(item, counted[w])
            if similarity >= THRESHOLD:
                word, doc = windows[w]
                place = word - int(chunk.first[doc])
                known = best.get((doc, item))
                if known is None or (-similarity, place) < (-known[0], known[1]):
                    best[doc, item] = (similarity, place)


def item_blocks(benchmark: DataFrame, limit: int = ITEM_BLOCK) -> Iterator[Items]:
    """The items in blocks of about ``limit``, dealt by a hash of the id."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-rows.count() // limit))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        yield Items([(r["item_id"], r["text"]) for r in part.collect()])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words)``: the best window of each match."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for chunk in word_chunks(batch):
                    best = sorted(items.scan(chunk).items())
                    columns = [
                        pa.array([ids[chunk.row + doc] for (doc, _), _ in best], pa.int64()),
                        pa.array([items.ids[i] for (_, i), _ in best], pa.int64()),
                        pa.array([s for _, (s, _) in best], pa.float64()),
                        pa.array([w for _, (_, w) in best], pa.int64()),
                        pa.array([items.words[i] for (_, i), _ in best], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        found = part if found is None else found.union(part)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, unchanged."""
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for chunk in word_chunks(batch):
                    keep[[chunk.row + doc for doc, _ in items.scan(chunk)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
