"""TF-IDF similarity of the two texts of a pair, and TF-IDF over a corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lookalike.functions.text import NO_GRAM, explode_grams, strip_comments
from lookalike.operators.pairs import PLACES, SLOT, pair_slots, pairs_of_slots, per_place, slot_sides
from lookalike.operators.parts import GRAM_TEXT_BYTES, parts_for

# Default decision threshold and n-gram range.
TFIDF_THRESHOLD = 0.45
LONGEST_GRAM = 3

#: Smooth idf over two texts: 1 for a gram in both, this for a gram in one.
LONE_IDF = math.log(3.0 / 2.0) + 1.0


def gram_counts(documents: DataFrame, key: list[str], text: Column, longest: int = LONGEST_GRAM) -> DataFrame:
    """Term frequency: ``(*key, gram, tf)``.

    The texts are shuffled by key before they are cut, because their grams,
    even counted per task, are several times larger. The partitions are as many
    as the bytes of the texts need.
    """
    texts = documents.select(*key, text.alias("_text"))
    placed = texts.repartition(parts_for(texts, F.octet_length("_text"), GRAM_TEXT_BYTES), *key)
    grams = explode_grams(placed, F.col("_text"), key, longest)
    return grams.groupBy(*key, "gram").agg(F.count(F.lit(1)).alias("tf"))


def cosine_from_sums(shared1: Column, all1: Column, shared2: Column, all2: Column, dot: Column) -> Column:
    """Cosine of two L2-scaled TF-IDF rows fitted on these two texts alone.

    ``shared``/``all`` are sums of squared term frequencies over the grams in
    both texts and over all grams of a text. Zero where a side has no grams.
    """
    k2 = F.lit(LONE_IDF * LONE_IDF)
    square1 = shared1 + k2 * (all1 - shared1)
    square2 = shared2 + k2 * (all2 - shared2)
    return F.when((all1 > 0) & (all2 > 0), dot / F.sqrt(square1 * square2)).otherwise(F.lit(0.0))


def tfidf_from_slots(sides: DataFrame, slots: DataFrame, longest: int = LONGEST_GRAM) -> DataFrame:
    """``(doc1, doc2, tfidf_similarity)`` from the rows of ``slot_sides``.

    Grams are counted once per slot, with a counter for the first document and one for
    each place; the sums of all pairs of a slot come from the same rows.
    """
    grams = explode_grams(sides, strip_comments(F.col("text")), [*SLOT, "place"], longest, sentinel=True)
    counters = [F.count_if(F.col("place") == place).alias(f"n{place}") for place in range(PLACES + 1)]
    tf = grams.groupBy(*SLOT, "gram").agg(*counters)
    real, x = F.col("gram") != NO_GRAM, F.col("n0")

    def total(condition: Column, value: Column, name: str) -> Column:
        return F.sum(F.when(condition, value).otherwise(F.lit(0))).alias(name)

    sums = [total(real, x * x, "all1")]
    for place in range(1, PLACES + 1):
        y = F.col(f"n{place}")
        both = real & (x > 0) & (y > 0)
        sums += [
            total(both, x * x, f"shared1_{place}"),
            total(both, y * y, f"shared2_{place}"),
            total(both, x * y, f"dot_{place}"),
            total(real, y * y, f"all2_{place}"),
            F.bool_or(~real & (x > 0) & (y > 0)).alias(f"complete_{place}"),
        ]

    def scored(place: int) -> Column:
        shared1, shared2, dot, all2 = (F.col(f"{c}_{place}") for c in ("shared1", "shared2", "dot", "all2"))
        cosine = cosine_from_sums(shared1, F.col("all1"), shared2, all2, dot)
        return F.struct(F.lit(place).alias("place"), F.col(f"complete_{place}").alias("complete"), cosine.alias("tfidf_similarity"))

    found = tf.groupBy(*SLOT).agg(*sums).select(*SLOT, F.inline(F.array(*per_place(scored))))
    return pairs_of_slots(found.where("complete").drop("complete"), slots)


def tfidf_similarity(pairs: DataFrame, documents: DataFrame, longest: int = LONGEST_GRAM) -> DataFrame:
    """Score pairs ``(doc1, doc2)`` against ``documents (doc_id, text)``.

    A pair with a missing document is left out; one without a common gram
    scores 0.
    """
    slots = pair_slots(pairs)
    return tfidf_from_slots(slot_sides(slots, documents, ["text"]), slots, longest)
