"""Match the tree nodes of two documents and score the pair.

Per number of children, each node matches at most one node with the same hash.
Nodes without children match at most once per pair by default (leaf rule
``once``); with ``all`` they are matched like any other node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lookalike.operators.pairs import PAIR, PLACES, SLOT, pair_sides, pair_slots, pairs_of_slots, per_place, slot_sides
from lookalike.operators.trees import text_tree
from lookalike.sources.scratch import written

# Decision thresholds of the scoring job and of the comparison.
STRUCTURE_THRESHOLD = 0.6
COMPARISON_THRESHOLD = 0.45

ONCE, ALL = "once", "all"
#: Marks one extra row per document, so that empty documents stay in the pair.
PRESENCE = -1


def node_shapes(nodes: DataFrame) -> DataFrame:
    """``(doc_id, shapes)``: the distinct (children, hash) pairs of a document with counts.

    One row per document, no longer than the document itself.
    """
    counts = nodes.groupBy("doc_id", "num_children", "hash_value").agg(F.count(F.lit(1)).alias("nodes"))
    return counts.groupBy("doc_id").agg(
        F.collect_list(F.struct("num_children", "hash_value", "nodes")).alias("shapes")
    )


def text_shapes(text: Column) -> Column:
    """Same array straight from a text, one entry per node."""
    return F.transform(
        text_tree(text),
        lambda n: F.struct(n["num_children"], n["hash_value"], F.lit(1).cast("bigint").alias("nodes")),
    )


def check_leaf_rule(leaf_rule: str) -> None:
    if leaf_rule not in (ONCE, ALL):
        raise ValueError(f"leaf_rule must be '{ONCE}' or '{ALL}', got {leaf_rule!r}")


def matches_from_slots(
    sides: DataFrame, slots: DataFrame, shapes: Column, leaf_rule: str = ONCE
) -> DataFrame:
    """``(doc1, doc2, similar_nodes, nodes1, nodes2)`` from the rows of ``slot_sides``."""
    check_leaf_rule(leaf_rule)
    present = F.array(
        F.struct(
            F.lit(PRESENCE).alias("num_children"),
            F.lit(0).cast("bigint").alias("hash_value"),
            F.lit(1).cast("bigint").alias("nodes"),
        )
    )
    rows = sides.select(*SLOT, "place", F.inline(F.concat(present, shapes)))

    def nodes_at(place: int) -> Column:
        return F.sum(F.when(F.col("place") == place, F.col("nodes")).otherwise(F.lit(0))).alias(f"n{place}")

    merged = rows.groupBy(*SLOT, "num_children", "hash_value").agg(*(nodes_at(p) for p in range(PLACES + 1)))
    real, is_leaf = F.col("num_children") != PRESENCE, F.col("num_children") == 0

    def total(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(F.lit(0)))

    sums = [total(real, F.col("n0")).alias("nodes1")]
    for place in range(1, PLACES + 1):
        common = F.least("n0", f"n{place}")
        leaf_matches = F.max(F.when(is_leaf & (common > 0), F.lit(1)).otherwise(F.lit(0)))
        inner = total(real & ~is_leaf, common)
        similar = total(real, common) if leaf_rule == ALL else inner + leaf_matches
        sums += [
            similar.cast("bigint").alias(f"similar_{place}"),
            total(real, F.col(f"n{place}")).alias(f"nodes2_{place}"),
            F.bool_or(~real & (common > 0)).alias(f"complete_{place}"),
        ]

    def scored(place: int) -> Column:
        return F.struct(
            F.lit(place).alias("place"),
            F.col(f"complete_{place}").alias("complete"),
            F.col(f"similar_{place}").alias("similar_nodes"),
            F.col("nodes1"),
            F.col(f"nodes2_{place}").alias("nodes2"),
        )

    found = merged.groupBy(*SLOT).agg(*sums).select(*SLOT, F.inline(F.array(*per_place(scored))))
    return pairs_of_slots(found.where("complete").drop("complete"), slots)


def with_structure_score(matches: DataFrame) -> DataFrame:
    """Add the Dice score of the matched nodes; 0 when a side has no nodes."""
    both = (F.col("nodes1") > 0) & (F.col("nodes2") > 0)
    dice = 2.0 * F.col("similar_nodes") / (F.col("nodes1") + F.col("nodes2"))
    return matches.withColumn("structure_similarity", F.when(both, dice).otherwise(F.lit(0.0)))


def structural_score(
    pairs: DataFrame, nodes: DataFrame, documents: DataFrame, leaf_rule: str = ONCE
) -> DataFrame:
    """Score pairs from a node table; ``documents`` lists the ids that exist.

    A document without nodes (for instance an unparsable one) scores 0.
    """
    shapes = documents.select("doc_id").join(node_shapes(nodes), "doc_id", "left")
    none = F.array().cast("array<struct<num_children:int,hash_value:bigint,nodes:bigint>>")
    # Written, because the slots ask for their size before they read them.
    filled = written(shapes.select("doc_id", F.coalesce("shapes", none).alias("shapes")), "node-shapes")
    slots = pair_slots(pairs)
    sides = slot_sides(slots, filled, ["shapes"])
    return with_structure_score(matches_from_slots(sides, slots, F.col("shapes"), leaf_rule))


def text_structural_score(pairs: DataFrame, documents: DataFrame, leaf_rule: str = ONCE) -> DataFrame:
    """Score pairs of prose documents by their text trees."""
    slots = pair_slots(pairs)
    sides = slot_sides(slots, documents, ["text"])
    return with_structure_score(matches_from_slots(sides, slots, text_shapes(F.col("text")), leaf_rule))


def matched_pairs(pairs: DataFrame, nodes: DataFrame, leaf_rule: str = ONCE) -> DataFrame:
    """The matched nodes themselves: ``doc1, doc2, num_children, hash_value, position1, position2``.

    Equal nodes of a document are numbered by position and joined number by
    number. Under leaf rule ``once`` the leaf match of a pair is the common
    leaf hash that is lowest, at its first position on both sides.
    """
    check_leaf_rule(leaf_rule)
    shape = ["num_children", "hash_value"]
    turn = F.row_number().over(Window.partitionBy("doc_id", *shape).orderBy("position"))
    numbered = nodes.withColumn("turn", turn)
    if leaf_rule == ONCE:
        numbered = numbered.where((F.col("num_children") > 0) | (F.col("turn") == 1))
    node = F.struct(*shape, "turn", "position")
    bags = numbered.groupBy("doc_id").agg(F.collect_list(node).alias("nodes"))
    sides = pair_sides(pairs, bags, ["nodes"]).select(*PAIR, "side", F.inline("nodes"))

    def position(side: int) -> Column:
        return F.min(F.when(F.col("side") == side, F.col("position")))

    met = (
        sides.groupBy(*PAIR, *shape, "turn")
        .agg(position(1).alias("position1"), position(2).alias("position2"))
        .where(F.col("position1").isNotNull() & F.col("position2").isNotNull())
    )
    if leaf_rule == ONCE:
        lowest = F.min("hash_value").over(Window.partitionBy(*PAIR, "num_children"))
        met = met.withColumn("lowest", lowest).where(
            (F.col("num_children") > 0) | (F.col("hash_value") == F.col("lowest"))
        )
    return met.select(*PAIR, *shape, "position1", "position2")


def matched_pair_lists(matches: DataFrame) -> DataFrame:
    """One row per pair with the list of its matched nodes."""
    item = F.struct("num_children", "hash_value", "position1", "position2")
    return matches.groupBy(*PAIR).agg(F.sort_array(F.collect_list(item)).alias("similar_nodes"))
