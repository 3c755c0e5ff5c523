"""Ranked lexical search: the best documents of each item, by grouping documents on presence masks.

Texts are read once per block of items: every document becomes its length and the
counts of the block's terms in it. Ranking then works on these counts alone. In a
batch of documents each term of an item is a bitmap; together the bitmaps give every
document a mask of the terms it holds. Documents with the same mask share a highest
possible score, so the distinct masks are evaluated by descending maximum, and an item
is finished as soon as its tenth score lies above all maxima that are left. A task
keeps the best documents of each item only; the tasks' lists are merged by Spark.

A first, small part of the documents gives every item a score that its tenth document
reaches at least. Tasks start from there, so they hand on few rows; the result does
not depend on which part it was.

Items are dealt into blocks of bounded size (``BLOCK_ITEMS``, ``BLOCK_TERMS``), each of
which is a pass of its own; whatever a task is handed therefore has a bound.

Defined results: a null or blank text has no terms and is never found; an item without
terms has no rows; rows of equal ``item_id`` are separate items with the same name;
repeated documents are separate rows, each with its own rank; a null ``doc_id`` comes
last among equal scores; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lookalike.llm.common import text_bytes
from lookalike.sources.scratch import written

#: Documents returned for an item.
BEST = 10
#: A block of items closes with this many items or distinct terms. An item that has
#: more terms by itself is a block of its own.
BLOCK_ITEMS, BLOCK_TERMS = 2_000, 1 << 16
#: Documents that give the first lower bounds.
SEED_ROWS = 10_000
#: Counts (documents by terms) of one item that are held at a time.
CELLS = 1 << 22

# Fixed values of the score: letter case and separators, and the length correction.
_TERM_BYTES = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256)).lower()
SCALE, LENGTH_SHARE, PERCENT = 1_000_000_000, 75, 100

_NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters beyond ASCII; only A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


@dataclass(frozen=True)
class Block:
    """Items whose terms are numbered together; ``repeats`` holds a term's occurrences in the item."""

    ids: list[int | None]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    number: dict[bytes, int]


def blocks_of(items: Iterable[tuple[int | None, str | None]], most_items: int, most_terms: int) -> Iterator[Block]:
    block = Block([], [], [], {})
    for item_id, text in items:
        counts = Counter(terms_of((text or "").encode("utf-8", "replace")))
        if not counts:
            continue
        new = sum(t not in block.number for t in counts)
        if block.ids and (len(block.ids) >= most_items or len(block.number) + new > most_terms):
            yield block
            block = Block([], [], [], {})
        places = [block.number.setdefault(t, len(block.number)) for t in counts]
        block.ids.append(item_id)
        block.terms.append(np.array(places, np.int64))
        block.repeats.append(np.array(list(counts.values()), np.int64))
    if block.ids:
        yield block


def term_counts(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, counts)`` of every document that has a term; ``n`` counts all of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, found, counts, ends = [], [], [], [], [0]
            for row, text in text_bytes(batch):
                words = terms_of(text)
                if not words:
                    continue
                hits = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
                places, times = np.unique(hits[hits >= 0], return_counts=True)
                rows.append(row)
                sizes.append(len(words))
                found.append(places)
                counts.append(times)
                ends.append(ends[-1] + len(places))
            offsets = pa.array(ends, pa.int32())
            flat = [pa.array(np.concatenate(x) if x else [], pa.int32()) for x in (found, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64())]
                + [pa.ListArray.from_arrays(offsets, x) for x in flat],
                ["doc_id", "n", "terms", "counts"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


@dataclass(frozen=True)
class Corpus:
    """Documents that have a term, and all of their terms with repeats."""

    documents: int
    terms: int

    def length_factor(self, n: np.ndarray) -> np.ndarray:
        """``100 - 75 + (75 n N) div L``, exact also where the product exceeds 64 bits."""
        scale = LENGTH_SHARE * self.documents
        if len(n) and int(n.max()) * scale > np.iinfo(np.int64).max:
            share = np.array([int(x) * scale // self.terms for x in n], np.int64)
        else:
            share = n * scale // self.terms
        return PERCENT - LENGTH_SHARE + share

    def weight(self, holding: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * holding + 1)))


def parts(counts: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """What occurrences of a term contribute, before its weight."""
    return (SCALE * counts) // (1000 * counts + 8 * factor)


class _Postings:
    """The counts of one batch of documents, as arrays and by term."""

    def __init__(self, batch: pa.RecordBatch, corpus: Corpus):
        self.doc_id = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        self.factor = corpus.length_factor(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
        per_doc = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc = np.repeat(np.arange(batch.num_rows), per_doc)
        self.term = batch.column(2).flatten().to_numpy().astype(np.int64)
        self.count = batch.column(3).flatten().to_numpy().astype(np.int64)

    def by_term(self, terms: int) -> np.ndarray:
        """Order the postings by term; returns where each term starts."""
        order = np.argsort(self.term, kind="stable")
        self.doc, self.term, self.count = self.doc[order], self.term[order], self.count[order]
        return np.searchsorted(self.term, np.arange(terms + 1))


def term_statistics(counted: DataFrame, corpus: Corpus, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Per term: documents that hold it, and its largest part in any of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, most = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
        for batch in batches:
            p = _Postings(batch, corpus)
            holding += np.bincount(p.term, minlength=terms)
            np.maximum.at(most, p.term, parts(p.count, p.factor[p.doc]))
        at = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(holding[at]), pa.array(most[at])], ["t", "df", "most"])

    found = counted.mapInArrow(run, "t long, df long, most long").groupBy("t").agg(F.sum("df"), F.max("most"))
    holding, most = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
    for t, df, part in found.toLocalIterator():
        holding[t], most[t] = df, part
    return holding, most


class _Best:
    """The best documents of one item so far."""

    def __init__(self, size: int, floor: int):
        self.size, self.floor = size, max(1, floor)
        self.score, self.doc_id = np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> int:
        """A score below this one cannot enter any more."""
        return max(self.floor, int(self.score[-1])) if len(self.score) == self.size else self.floor

    def add(self, score: np.ndarray, doc_id: np.ndarray) -> None:
        enters = score >= self.least()
        score = np.concatenate([self.score, score[enters]])
        doc_id = np.concatenate([self.doc_id, doc_id[enters]])
        order = np.lexsort((doc_id, -score))[: self.size]
        self.score, self.doc_id = score[order], doc_id[order]


def search_masks(
    best: _Best, counts: np.ndarray, factor: np.ndarray, doc_id: np.ndarray, weight: np.ndarray, most: np.ndarray
) -> int:
    """Enter the documents of ``counts (document, term)`` into ``best``; returns how many were scored.

    ``weight`` is a term's weight times its occurrences in the item, ``most`` its largest part.
    """
    bits = np.packbits(counts > 0, axis=1)
    holds = np.flatnonzero(bits.any(axis=1))
    if not len(holds):
        return 0
    # Equal masks lie together: compare them as opaque strings of bytes.
    names = np.ascontiguousarray(bits[holds]).view(f"V{bits.shape[1]}").ravel()
    _, first, group, size = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
    highest = np.unpackbits(bits[holds[first]], axis=1, count=counts.shape[1]).astype(np.int64) @ (weight * most)
    members = np.argsort(group, kind="stable")
    ends = np.cumsum(size)
    order = np.argsort(-highest, kind="stable")
    scored, at, step = 0, 0, 1
    while at < len(order):
        # A mask whose maximum equals the tenth score may still hold a smaller id.
        some = order[at : at + step]
        some = some[highest[some] >= best.least()]
        if not len(some):
            break
        rows = holds[np.concatenate([members[ends[g] - size[g] : ends[g]] for g in some])]
        best.add(parts(counts[rows], factor[rows, None]) @ weight, doc_id[rows])
        scored += len(rows)
        at, step = at + step, step * 2
    return scored


def best_of_parts(
    counted: DataFrame, block: Block, corpus: Corpus, weight: np.ndarray, most: np.ndarray, size: int, floors: np.ndarray
) -> DataFrame:
    """``(item, doc_id, score)``: the best documents of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = [_Best(size, int(f)) for f in floors]
        for batch in batches:
            postings = _Postings(batch, corpus)
            starts = postings.by_term(len(block.number))
            for best, terms, repeats in zip(bests, block.terms, block.repeats):
                weights = weight[terms] * repeats
                rows = max(1, CELLS // len(terms))
                for low in range(0, batch.num_rows, rows):
                    high = min(low + rows, batch.num_rows)
                    counts = np.zeros((high - low, len(terms)), np.int64)
                    for j, t in enumerate(terms):
                        docs = postings.doc[starts[t] : starts[t + 1]]
                        a, b = np.searchsorted(docs, (low, high)) + starts[t]
                        counts[postings.doc[a:b] - low, j] = postings.count[a:b]
                    search_masks(best, counts, postings.factor[low:high], postings.doc_id[low:high], weights, most[terms])
        item = np.repeat(np.arange(len(bests)), [len(b.score) for b in bests])
        doc_id = np.concatenate([b.doc_id for b in bests])
        score = np.concatenate([b.score for b in bests])
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(doc_id, mask=doc_id == _NO_ID), pa.array(score)], ["item", "doc_id", "score"]
        )

    return counted.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(found: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def _search_block(docs: DataFrame, block: Block, size: int) -> DataFrame:
    spark = docs.sparkSession
    counted = written(term_counts(docs, block.number), "search-counts")
    n, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    corpus = Corpus(n, total)
    holding, most = term_statistics(counted, corpus, len(block.number))
    weight = np.array([corpus.weight(int(h)) for h in holding], np.int64)
    common = block, corpus, weight, most, size
    floors = np.zeros(len(block.ids), np.int64)
    seeds = _ranked(best_of_parts(counted.limit(SEED_ROWS), *common, floors), size)
    for item, score in seeds.where(F.col("rank") == size).select("item", "score").collect():
        floors[item] = score
    ranked = _ranked(best_of_parts(counted, *common, floors), size)
    names = spark.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, best: int = BEST, block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``best`` documents ``(doc_id, text)`` of each item ``(item_id, text)``."""
    spark = docs.sparkSession
    queue = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    result = None
    for block in blocks_of(queue.toLocalIterator(), block_items, block_terms):
        part = written(_search_block(docs, block, best), "search-block")
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return result
