"""Whole texts as normalized words in numpy arrays, for many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lookalike.llm.common import RangeHash, text_chunks

#: ASCII letters and digits stay, in lower case; other ASCII characters part words.
_KEPT = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_HASH = RangeHash(seed=5)


def normalized(text: bytes) -> bytes:
    """Lower-cased words, punctuation dropped, joined by single blanks."""
    return b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_KEPT).split())


def hash_of(run: bytes) -> int:
    """The hash that :class:`Words` gives to the same run of words."""
    prefix = _HASH.prefix(np.frombuffer(run, np.uint8))
    return int(_HASH.ranges(prefix, np.array([0]), np.array([len(run)]))[0])


def shingles_of(words: list[bytes], length: int) -> list[bytes]:
    """Runs of ``length`` words; the whole sequence if there are fewer words."""
    if len(words) <= length:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + length]) for i in range(len(words) - length + 1)]


@dataclass
class Words:
    """The words of several documents, one after the other.

    ``first[d]:first[d + 1]`` are the words of document ``d``, which is row
    ``row + d`` of its batch.
    """

    row: int
    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    prefix: np.ndarray

    def document(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, side="right") - 1

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the run of ``length`` words from each word, and whether it ends in its document."""
        n = len(self.starts)
        inside = np.zeros(n, bool)
        if n < length:
            return np.zeros(n, np.uint64), inside
        sizes = np.diff(self.first)
        left = np.repeat(self.first[1:], sizes) - np.arange(n)
        inside = left >= length
        hashes = np.zeros(n, np.uint64)
        hashes[: n - length + 1] = _HASH.ranges(self.prefix, self.starts[: n - length + 1], self.ends[length - 1 :])
        return hashes, inside

    def run(self, word: int, length: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word + length - 1]]


def word_chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[Words]:
    """The documents of a batch in chunks of about a megabyte; a longer text is one chunk."""
    for lo, hi, data, offsets in text_chunks(batch, column):
        whole = data.tobytes()
        parts = [normalized(whole[offsets[i] : offsets[i + 1]]) for i in range(hi - lo)]
        # A newline cannot be part of a normalized text, so it ends every document.
        joined = b"\n".join(parts) + b"\n"
        array = np.frombuffer(joined, np.uint8)
        gaps = np.flatnonzero((array == 32) | (array == 10))
        starts = np.concatenate([[0], gaps[:-1] + 1])
        real = gaps > starts
        ends_of_docs = np.cumsum([len(p) + 1 for p in parts])
        starts, ends = starts[real], gaps[real]
        first = np.concatenate([[0], np.searchsorted(starts, ends_of_docs)])
        yield Words(lo, joined, starts, ends, first, _HASH.prefix(array))


class HashSet:
    """Fast test of many hashes against a small set."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.sorted = np.unique(np.asarray(hashes, np.uint64))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.sorted >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``hashes`` holds a member, and which member (its place in order)."""
        if not len(self.sorted):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.maybe[hashes >> self.shift])
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        hit = self.sorted[place] == hashes[at]
        return at[hit], place[hit]
