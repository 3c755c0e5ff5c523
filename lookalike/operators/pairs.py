"""Bring the two documents of every pair together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lookalike.operators.numbering import number_rows, shuffle_bucket, shuffle_hash
from lookalike.operators.parts import GRAM_TEXT_BYTES, parts_for, row_bytes
from lookalike.sources.scratch import written

#: The two columns that identify a pair.
PAIR = ["doc1", "doc2"]
#: The two columns that identify a slot: up to ``PLACES`` pairs of one first document.
SLOT = ["doc1", "slot"]
PLACES = 8


def pair_sides(pairs: DataFrame, documents: DataFrame, payload: list[str]) -> DataFrame:
    """``(doc1, doc2, side, *payload)``: one row per pair side that exists.

    Each document is shuffled once to meet its pairs, then the sides are
    shuffled by pair, so everything computed per pair afterwards is local.
    ``pairs`` must not repeat a pair. A document with very many pairs makes a
    large partition of pair sides; the shuffle after the join lets adaptive
    execution split it.
    """
    ends = F.array(
        F.struct(F.lit(1).alias("side"), F.col("doc1").alias("doc_id")),
        F.struct(F.lit(2).alias("side"), F.col("doc2").alias("doc_id")),
    )
    sides = pairs.select(*PAIR, F.inline(ends))
    met = sides.join(documents.select("doc_id", *payload), "doc_id")
    # In this order the shuffle differs from one that made ``pairs`` distinct.
    # Spark would otherwise drop it for that one, whose few small partitions of
    # ids adaptive execution has merged by then.
    return met.select(*PAIR, "side", *payload).repartition("doc2", "doc1")


def pair_slots(pairs: DataFrame) -> DataFrame:
    """``(doc1, doc2, slot, place)``: the pairs of a first document in slots of ``PLACES``.

    In a list of stars the first document of a star is in all of its pairs. It comes to a
    slot once, so what is made of it is made once for all pairs there, and a star of any
    size is dealt over as many slots as it needs. ``pairs`` must not repeat a pair.
    """
    digest = shuffle_hash(0, "doc2")
    numbered = number_rows(pairs.select(*PAIR), ["doc1"], shuffle_bucket(digest), [digest, F.col("doc2")], "_nth")
    slot = F.floor((F.col("_nth") - 1) / PLACES).alias("slot")
    return written(numbered.select(*PAIR, slot, (F.pmod(F.col("_nth") - 1, F.lit(PLACES)) + 1).cast("int").alias("place")), "pair-slots")


def slot_sides(slots: DataFrame, documents: DataFrame, payload: list[str]) -> DataFrame:
    """``(doc1, slot, place, *payload)``: the documents of every slot, the first one at place 0.

    Every document is shuffled once to meet its slots, and then by slot, so everything
    computed per pair afterwards is local. The partitions are as many as the bytes of the
    sides need; ``documents`` is read once more to add these up.
    """
    seconds = slots.select(*SLOT, "place", F.col("doc2").alias("doc_id"))
    firsts = slots.where("place = 1").select(*SLOT, F.lit(0).alias("place"), F.col("doc1").alias("doc_id"))
    sides = firsts.unionByName(seconds)
    kinds = dict(documents.select(*payload).dtypes)
    size = sum((row_bytes(kinds[c], c) for c in payload), F.lit(0))
    sizes = sides.select("doc_id").join(documents.select("doc_id", size.alias("_bytes")), "doc_id")
    parts = parts_for(sizes, F.col("_bytes"), GRAM_TEXT_BYTES)
    met = sides.join(documents.select("doc_id", *payload), "doc_id")
    return met.select(*SLOT, "place", *payload).repartition(parts, "slot", "doc1")


def per_place(value: Callable[[int], Column]) -> list[Column]:
    """``value`` of every place of a slot."""
    return [value(place) for place in range(1, PLACES + 1)]


def pairs_of_slots(results: DataFrame, slots: DataFrame) -> DataFrame:
    """Give the rows ``(doc1, slot, place, ...)`` of ``results`` their pairs."""
    named = results.join(slots, [*SLOT, "place"])
    return named.select(*PAIR, *(c for c in results.columns if c not in (*SLOT, "place")))


def pair_texts(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """``(doc1, doc2, text1, text2)`` of the pairs whose documents both exist."""
    sides = pair_sides(pairs, documents, ["text"])

    def texts(side: int) -> DataFrame:
        return sides.where(F.col("side") == side).select(*PAIR, F.col("text").alias(f"text{side}"))

    both = texts(1).join(texts(2), PAIR)
    return both.where(F.col("text1").isNotNull() & F.col("text2").isNotNull())
