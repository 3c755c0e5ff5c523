"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams of one to three letters, most frequent
first. A document is compared with every language's profile by the out-of-place
distance: the sum, over the document's n-grams, of how far each one's rank is
from its rank in the profile, or a fixed penalty where the profile lacks it.

Profiles are learned from a bounded sample of the labelled rows (at most about
``SAMPLE_PER_LANGUAGE`` of each language, chosen by a hash of id and text, and never
none). Every
document is compared by its whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0;
rows with a null language are not learned from; without any learned language
every document is ``und``; equal distances go to the language that sorts first;
repeated rows get equal rows; an empty table gives an empty result; other
columns are ignored by ``identify`` and passed through by ``keep_identified``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lookalike.llm.common import id_digest, text_bytes

UNKNOWN = "und"
#: N-grams in a profile, of a language or a document.
PROFILE_SIZE = 400
LONGEST = 3
#: Labelled rows of a language to learn from, about; the documented bound.
SAMPLE_PER_LANGUAGE = 20_000
#: Code points take 21 bits, so three fit in 63.
SHIFT = np.int64(21)
BLANK = 32
#: Code points of a long text that are counted at a time.
BLOCK = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a text, codes ascending.

    Letters are lower-cased; everything between words counts as one blank, and
    the text starts and ends with one. A blank alone is not an n-gram.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(_letters()[points], points, BLANK).astype(np.int64)
    inner = np.ones(len(points), bool)
    inner[1:] = (points[1:] != BLANK) | (points[:-1] != BLANK)
    points = points[inner]
    if not np.any(points != BLANK):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edges = [np.full(int(points[i] != BLANK), BLANK) for i in (0, -1)]
    points = np.concatenate([edges[0], points, edges[1]])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(points), BLOCK):
        part = points[at : at + BLOCK + LONGEST - 1]
        starts = min(BLOCK, len(part))
        codes, grams = [], np.zeros(starts, np.int64)
        for k in range(LONGEST):
            grams = (grams[: max(0, len(part) - k)] << SHIFT) | part[k : k + starts]
            codes.append(grams if k else grams[grams != BLANK])
        found.append(np.unique(np.concatenate(codes), return_counts=True))
    if len(found) == 1:
        return found[0]
    codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([n for _, n in found])).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of all profiled n-grams: one row per code, one column per language."""

    languages: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    def predict(self, text: str) -> tuple[str, float]:
        grams = ranked(*gram_counts(text), self.size)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
        known = self.codes[at] == grams
        apart = np.abs(self.ranks[at[known]] - np.flatnonzero(known)[:, None])
        distance = np.minimum(apart, self.size).sum(axis=0) + self.size * np.count_nonzero(~known)
        best = int(np.argmin(distance))
        return self.languages[best], 1.0 - float(distance[best]) / (self.size * len(grams))


def learn(rows: DataFrame, size: int = PROFILE_SIZE, sample: int = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Profiles of ``rows (doc_id, text, lang)``; rows without a language are skipped.

    Only the profiles come to the driver: ``size`` rows per language.
    """
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang is not null")
    sizes = {lang: n for lang, n in rows.groupBy("lang").count().collect()}
    share = F.lit(1.0)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    large = [lang for lang, n in sizes.items() if n > sample]
    if large:
        # However rows repeat, a language keeps the rows that are drawn first.
        least = rows.where(F.col("lang").isin(large)).groupBy("lang").agg(F.min(place).alias("least"))
        for lang, first in least.collect():
            share = F.when(F.col("lang") == lang, F.lit(max(sample / sizes[lang], first))).otherwise(share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            kept: dict[str, list] = {}
            for i, text in text_bytes(batch):
                kept.setdefault(langs[i], []).append(gram_counts(text.decode("utf-8", "replace")))
            for lang, found in kept.items():
                codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(back, np.concatenate([k for _, k in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"]
                )

    counted = rows.where(place <= share).select("text", "lang").mapInArrow(count, "lang string, code long, n long")
    totals = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    found = top.select("lang", "code", (F.col("rank") - 1).alias("rank")).toPandas()
    languages = tuple(sorted(found["lang"].unique()))
    codes = np.unique(found["code"].to_numpy(np.int64))
    # Beyond any rank, so that the distance to it is the penalty.
    ranks = np.full((len(codes), len(languages)), 2 * size, np.int64)
    column = {lang: j for j, lang in enumerate(languages)}
    ranks[np.searchsorted(codes, found["code"]), [column[x] for x in found["lang"]]] = found["rank"]
    return Profiles(languages, codes, ranks, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(text.decode("utf-8", "replace")) for _, text in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The rows of ``docs`` whose text has a language, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(text.decode("utf-8", "replace"))[0] != UNKNOWN for _, text in text_bytes(batch)]
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    """Rows that take no part in learning."""
    return id_digest("doc_id") % 3 == 1
