"""Run both scorers on the same pairs, decide, compare and combine them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lookalike.operators.metrics import confusion_counts, with_scores
from lookalike.operators.pairs import PAIR, pair_slots, slot_sides
from lookalike.operators.structure import (
    COMPARISON_THRESHOLD,
    ONCE,
    matches_from_slots,
    text_shapes,
    with_structure_score,
)
from lookalike.operators.tfidf import TFIDF_THRESHOLD, tfidf_from_slots

#: Steps of the weight grid, from structure alone to TF-IDF alone.
WEIGHT_STEPS = 10


def decide(score: Column, threshold: float) -> Column:
    return (score >= F.lit(threshold)).cast("int")


def score_both(pairs: DataFrame, documents: DataFrame, leaf_rule: str = ONCE) -> DataFrame:
    """Both similarities of each pair of texts.

    The texts meet their pairs once; both scorers then work on the same partitions.
    """
    slots = pair_slots(pairs)
    sides = slot_sides(slots, documents, ["text"])
    structure = with_structure_score(matches_from_slots(sides, slots, text_shapes(F.col("text")), leaf_rule))
    return tfidf_from_slots(sides, slots).join(structure.select(*PAIR, "structure_similarity"), PAIR)


def with_decisions(
    scored: DataFrame,
    tfidf_threshold: float = TFIDF_THRESHOLD,
    structure_threshold: float = COMPARISON_THRESHOLD,
) -> DataFrame:
    """Add the 0/1 decision of each method, and against ``label`` who was right."""
    decided = scored.withColumn(
        "tfidf_prediction", decide(F.col("tfidf_similarity"), tfidf_threshold)
    ).withColumn("structure_prediction", decide(F.col("structure_similarity"), structure_threshold))
    tfidf_right = F.col("tfidf_prediction") == F.col("label")
    structure_right = F.col("structure_prediction") == F.col("label")
    return decided.select(
        "*",
        tfidf_right.alias("tfidf_correct"),
        structure_right.alias("structure_correct"),
        (tfidf_right & structure_right).alias("both_correct"),
        (~tfidf_right & ~structure_right).alias("both_wrong"),
    )


def agreement(compared: DataFrame) -> DataFrame:
    """Accuracy of each method, and how often both are right or wrong."""

    def share(flag: str) -> Column:
        return F.avg(F.col(flag).cast("double"))

    return compared.agg(
        F.count(F.lit(1)).alias("pairs"),
        share("tfidf_correct").alias("tfidf_accuracy"),
        share("structure_correct").alias("structure_accuracy"),
        F.count_if("both_correct").alias("both_correct"),
        share("both_correct").alias("both_correct_share"),
        F.count_if("both_wrong").alias("both_wrong"),
        share("both_wrong").alias("both_wrong_share"),
    )


def hybrid_grid(scored: DataFrame, threshold: float = TFIDF_THRESHOLD, steps: int = WEIGHT_STEPS) -> DataFrame:
    """Quality of ``w * tfidf + (1 - w) * structure`` for every weight of the grid.

    Each row is repeated once per weight inside its task and summed there; the
    shuffle carries one row per weight and task.
    """
    weights = F.array(*(F.lit(i / steps) for i in range(steps + 1)))
    weighted = scored.select("label", "tfidf_similarity", "structure_similarity", F.explode(weights).alias("weight"))
    w = F.col("weight")
    combined = w * F.col("tfidf_similarity") + (1 - w) * F.col("structure_similarity")
    decided = weighted.select("weight", "label", decide(combined, threshold).alias("prediction"))
    return with_scores(confusion_counts(decided, ["weight"]))


def simplex(parts: int, steps: int = WEIGHT_STEPS) -> list[tuple[int, ...]]:
    """All ways to share ``steps`` among ``parts``, in order."""
    if parts == 1:
        return [(steps,)]
    return [(first, *rest) for first in range(steps + 1) for rest in simplex(parts - 1, steps - first)]


def weighted_grid(
    scored: DataFrame, scores: list[str], threshold: float = TFIDF_THRESHOLD, steps: int = WEIGHT_STEPS
) -> DataFrame:
    """Quality of every weighted mean of several scores, ``(w_<score>..., tp, tn, fp, fn, ...)``.

    Weights are shares of ``steps`` that sum to it. Each row is decided once per point
    inside its task and counted there; the shuffle carries one row per point and task.
    """
    names = [f"w_{score}" for score in scores]
    points = [F.struct(*(F.lit(w).alias(n) for w, n in zip(point, names))) for point in simplex(len(scores), steps)]
    weighted = scored.select("label", *scores, F.inline(F.array(*points)))
    total = sum((F.col(n) * F.col(score) for n, score in zip(names, scores)), F.lit(0.0))
    decided = weighted.select(*names, "label", decide(total / steps, threshold).alias("prediction"))
    return with_scores(confusion_counts(decided, names))


def best_weight(grid: DataFrame) -> DataFrame:
    """The weight with the highest F1; the lowest one on a tie."""
    best = F.max_by(F.struct("weight", "f1"), F.struct(F.col("f1"), -F.col("weight")))
    return grid.agg(best.alias("best")).select("best.*")
