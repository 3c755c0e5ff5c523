"""License scans: MinHash bands over overlapping windows, then exact containment.

Templates are grouped by length. For a group whose longest template has ``w``
words the text is cut into windows of ``w`` plus one stride of ``w / 2`` words
(rounded), so a passage as long as the template lies wholly in a window. Of a
window's five-word shingles ``BANDS`` independent minima are taken, one row per
band; a template is retrieved if a minimum is also its own. A window that holds
a share ``c`` of a template's ``s`` shingles, and ``t`` shingles itself, has a
Jaccard similarity of ``j = c s / (s + t - c s)`` with it and is retrieved with
probability ``1 - (1 - j) ** BANDS``. Groups span a factor of two in length, so at
the threshold ``j`` is at least 0.2 and the probability 0.9996 with 35 bands, for
passages of one window; most passages lie in two.

Retrieved templates are verified on the shingles' bytes: a passage of as many
words as the template must hold at least ``THRESHOLD`` of its shingles. Templates
of five words or fewer are one shingle, which is its own minimum in any band, so
one band finds every occurrence.

Defined results: null and blank texts match nothing; templates without words
match nothing; repeated rows get equal rows; without templates or documents the
result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lookalike.llm.common import mixed
from lookalike.llm.words import HashSet, Words, hash_of, normalized, shingles_of, word_chunks

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS = 35

# Notices by which works name their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "all-rights-reserved": "All rights reserved.",
}


class Group:
    """Templates of similar length with their signatures."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], shingle: int):
        self.shingle = shingle
        self.names = [name for name, _ in templates]
        self.words = [len(words) for _, words in templates]
        self.shingles = [Counter(shingles_of(words, shingle)) for _, words in templates]
        hashes = [np.array([hash_of(r) for r in c], np.uint64) for c in self.shingles]
        longest = max(self.words)
        single = longest <= shingle
        self.stride = 1 if single else max(1, round(longest / 2))
        #: Strides that a window spans.
        self.span = 1 if single else -(-longest // self.stride) + 1
        self.bands = []
        for band in range(1 if single else BANDS):
            minima = np.array([banded(h, band).min() for h in hashes])
            found = HashSet(minima, bits=16)
            owners = [np.flatnonzero(minima == m).tolist() for m in found.sorted]
            self.bands.append((found, owners))

    def scan(self, chunk: Words) -> Iterator[tuple[int, int, float, int]]:
        """``(document, template, containment, first word in the chunk)``, repeats included."""
        hashes, inside = chunk.runs(self.shingle)
        n = len(hashes)
        if not inside.any():
            return
        blocks = np.arange(0, n, self.stride)
        retrieved: set[tuple[int, int]] = set()
        for band, (found, owners) in enumerate(self.bands):
            keyed = np.where(inside, banded(hashes, band), np.uint64(2**64 - 1))
            low = np.minimum.reduceat(keyed, blocks) if self.stride > 1 else keyed
            window = low.copy()
            for k in range(1, self.span):
                window[:-k] = np.minimum(window[:-k], low[k:])
            at, place = found.find(window)
            for w, p in zip(at.tolist(), place.tolist()):
                retrieved.update((w, owner) for owner in owners[p])
        for window, template in sorted(retrieved):
            yield from self._verify(chunk, window * self.stride, template)

    def _verify(self, chunk: Words, word: int, template: int) -> Iterator[tuple[int, int, float, int]]:
        """Passages as long as the template that start in the window and hold enough of it."""
        wanted, size, n = self.shingles[template], self.words[template], self.shingle
        total = sum(wanted.values())
        docs = chunk.document(np.array([word, min(word + self.stride * self.span, len(chunk.starts)) - 1]))
        for doc in range(int(docs[0]), int(docs[1]) + 1):
            lo, hi = int(chunk.first[doc]), int(chunk.first[doc + 1])
            first, last = max(lo, word), min(hi - n, word + self.stride * self.span - 1)
            runs = [chunk.run(w, n) for w in range(first, min(hi - n, last + size - n) + 1)]
            if not runs:
                continue
            held = [r in wanted for r in runs]
            width = size - n + 1
            for i in range(min(len(runs), last - first + 1)):
                # A best passage starts with a shared shingle, or lies at the end of its document.
                if not held[i] and i + width < len(runs):
                    continue
                found = Counter(r for r, h in zip(runs[i : i + width], held[i : i + width]) if h)
                share = sum(min(c, wanted[r]) for r, c in found.items()) / total
                if share >= THRESHOLD:
                    yield doc, template, share, first + i


def banded(hashes: np.ndarray, band: int) -> np.ndarray:
    """The hash function of a band."""
    with np.errstate(over="ignore"):
        return (hashes ^ _KEYS[2 * band]) * (_KEYS[2 * band + 1] | np.uint64(1))


_KEYS = mixed(np.arange(1, 2 * BANDS + 1, dtype=np.uint64))


def grouped(templates: dict[str, str]) -> list[Group]:
    """Templates by shingle length, then by powers of two of their length."""
    by: dict[tuple[int, int], list] = {}
    for name in sorted(templates):
        words = normalized((templates[name] or "").encode()).split()
        if words:
            shingle = min(len(words), SHINGLE_WORDS)
            by.setdefault((shingle, 0 if len(words) <= shingle else len(words).bit_length()), []).append((name, words))
    return [Group(own, shingle) for (shingle, _), own in sorted(by.items())]


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``(doc_id, license, containment, first_word, passages)`` of every license of a document.

    ``passages`` counts its separate places, ``first_word`` is the best one.
    """
    groups = grouped(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for chunk in word_chunks(batch):
                rows = []
                for group in groups:
                    places: dict[tuple[int, int], dict[int, float]] = {}
                    for doc, template, share, word in group.scan(chunk):
                        places.setdefault((doc, template), {})[word] = share
                    for (doc, template), found in places.items():
                        best = min(found, key=lambda w: (-found[w], w))
                        passages, end = 0, -1
                        for word in sorted(found):
                            if word >= end:
                                passages, end = passages + 1, word + group.words[template]
                        place = best - int(chunk.first[doc])
                        rows.append((ids[chunk.row + doc], group.names[template], found[best], place, passages))
                columns = list(zip(*sorted(rows, key=repr))) or [()] * 5
                types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    ["doc_id", "license", "containment", "first_word", "passages"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, containment double, first_word long, passages long")
