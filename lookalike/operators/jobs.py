"""From a pair manifest and source files to one result table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lookalike.functions.text import pair_text
from lookalike.operators import compare
from lookalike.operators.code_trees import code_tree_nodes
from lookalike.operators.pairs import PAIR, pair_texts
from lookalike.operators.structure import ONCE, STRUCTURE_THRESHOLD, structural_score, text_structural_score
from lookalike.sources.documents import SOURCE_PATTERN, many_small_files, read_documents, resolve_pairs
from lookalike.sources.manifest import known_sources
from lookalike.sources.scratch import written


def manifest_texts(manifest: DataFrame, files: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolved pairs as ``doc1, doc2`` next to the manifest, and the files as documents.

    A file's path is its id. ``files`` lists ``folder, file, path``, several folders may
    share a path; ``texts`` has ``path, text`` once for each path. Manifest rows without
    both files are left out, as are those of unknown sources.
    """
    found = resolve_pairs(known_sources(manifest), files)
    pairs = found.withColumnsRenamed({"path1": "doc1", "path2": "doc2"})
    return pairs, texts.select(F.col("path").alias("doc_id"), "text")


def score_manifest(
    manifest: DataFrame,
    files: DataFrame,
    texts: DataFrame,
    threshold: float = STRUCTURE_THRESHOLD,
    leaf_rule: str = ONCE,
) -> DataFrame:
    """``folder, file1, file2, label, dataset, structure_score, similar_nodes, prediction``."""
    pairs, documents = manifest_texts(manifest, files, texts)
    scores = text_structural_score(pairs.select(*PAIR).distinct(), documents, leaf_rule)
    return pairs.join(scores, PAIR).select(
        "folder",
        "file1",
        "file2",
        "label",
        F.col("source_dataset").alias("dataset"),
        F.col("structure_similarity").alias("structure_score"),
        "similar_nodes",
        compare.decide(F.col("structure_similarity"), threshold).alias("prediction"),
    )


def compare_manifest(manifest: DataFrame, files: DataFrame, texts: DataFrame, leaf_rule: str = ONCE) -> DataFrame:
    """Both similarities of every pair, the decisions, and who was right."""
    pairs, documents = manifest_texts(manifest, files, texts)
    scores = compare.score_both(pairs.select(*PAIR).distinct(), documents, leaf_rule)
    decided = compare.with_decisions(pairs.join(scores, PAIR))
    return decided.select(
        "folder",
        "file1",
        "file2",
        "label",
        F.col("source_dataset").alias("dataset"),
        "tfidf_similarity",
        "structure_similarity",
        "tfidf_prediction",
        "structure_prediction",
        "tfidf_correct",
        "structure_correct",
        "both_correct",
        "both_wrong",
    )


def tree_files(spark: SparkSession, root: str, pattern: str = SOURCE_PATTERN) -> tuple[DataFrame, DataFrame]:
    """The source files below ``root`` as ``(path, folder, file, text)``, and the nodes of their trees by path.

    Files are read once. One that is no UTF-8 has a NULL text, and like one that does not
    parse it has no nodes; see ``file_rejects``.
    """
    with many_small_files(spark):
        files = written(read_documents(spark, root, pattern, strict=True), "files")
    sources = files.where(F.col("text").isNotNull()).select(F.col("path").alias("doc_id"), "text")
    return files, written(code_tree_nodes(sources), "file-nodes")


def score_files(pairs: DataFrame, files: DataFrame, nodes: DataFrame, leaf_rule: str = ONCE) -> DataFrame:
    """Score pairs ``(doc1, doc2)`` of paths; a pair with a rejected side scores 0, one with a missing file is left out."""
    return structural_score(pairs, nodes, files.select(F.col("path").alias("doc_id")), leaf_rule)


def file_rejects(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(path, problem)`` of the files that take no part: not UTF-8, or without a tree."""
    rooted = nodes.where("position = 0").select(F.col("doc_id").alias("path"))
    bare = files.join(rooted, "path", "left_anti")
    problem = F.when(F.col("text").isNull(), "not UTF-8").otherwise("no tree")
    return bare.select("path", problem.alias("problem"))


def training_texts(manifest: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """``pair_id, label, text`` of a manifest split, ready for the classifier."""
    pairs, documents = manifest_texts(manifest, files, texts)
    both = pair_texts(pairs.select(*PAIR).distinct(), documents)
    return pairs.join(both, PAIR).select("pair_id", "label", pair_text(F.col("text1"), F.col("text2")).alias("text"))
