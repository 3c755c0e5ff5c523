"""Turn the file listings of the two raw corpora into one pair manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lookalike.operators.numbering import number_rows, range_bucket, with_even_bucket
from lookalike.sources.documents import COMPARED_FILE, ORIGINAL_FILE, SOURCE_SUFFIX
from lookalike.sources.manifest import MANIFEST_COLUMNS

# Layout of the graded corpus and the formats of the new names.
ORIGINAL_PATH = r"(?:^|/)([cC]ase-(\d+))/Original/[^/]+\.java$"
UNRELATED_PATH = r"(?:^|/)([cC]ase-(\d+))/non-plagiarized/(\d+)/[^/]+\.java$"
COPIED_PATH = r"(?:^|/)([cC]ase-(\d+))/plagiarized/L([1-6])/(\d+)/[^/]+\.java$"
CASE_FORMAT = "c%02d"
PROBLEM_FORMAT = "p%02d"
PAIR_FORMAT = "pair_%06d"
UNRELATED_FORMAT = "%s_orig_np%02d"
COPIED_FORMAT = "%s_orig_L%dv%02d"

#: Values of ``order1`` that are summed together when pairs are numbered.
FIRST_ORDERS = 4096


def graded_versions(files: DataFrame) -> DataFrame:
    """Parse ``path`` into ``case_orig, case_number, level, version``; level 0 is unrelated work.

    One row per version folder with its first file by name. Other paths, and
    folders whose name is no number or one beyond 64 bits, are skipped; the
    latter are in ``unnumbered_versions``.
    """
    path = F.col("path")

    def part(group: int) -> Column:
        unrelated = F.regexp_extract(path, UNRELATED_PATH, group if group < 3 else 3)
        copied = F.regexp_extract(path, COPIED_PATH, group if group < 3 else 4)
        return F.when(path.rlike(UNRELATED_PATH), unrelated).otherwise(copied)

    level = F.when(path.rlike(UNRELATED_PATH), 0).otherwise(F.regexp_extract(path, COPIED_PATH, 3).try_cast("int"))
    versions = files.where(path.rlike(UNRELATED_PATH) | path.rlike(COPIED_PATH)).select(
        part(1).alias("case_orig"),
        part(2).try_cast("int").alias("case_number"),
        level.alias("level"),
        part(3).try_cast("bigint").alias("version"),
        "path",
    )
    versions = versions.where(F.col("case_number").isNotNull() & F.col("version").isNotNull())
    keys = ["case_orig", "case_number", "level", "version"]
    return versions.groupBy(*keys).agg(F.min("path").alias("path"))


def unnumbered_versions(files: DataFrame) -> DataFrame:
    """Reject table: paths of versions whose case or version number is too large."""
    path = F.col("path")
    too_large = [
        path.rlike(pattern)
        & (
            F.regexp_extract(path, pattern, 2).try_cast("int").isNull()
            | F.regexp_extract(path, pattern, last).try_cast("bigint").isNull()
        )
        for pattern, last in ((UNRELATED_PATH, 3), (COPIED_PATH, 4))
    ]
    return files.where(too_large[0] | too_large[1]).select("path")


def number_versions(versions: DataFrame) -> DataFrame:
    """Add ``version_number``: 1, 2, 3... per case and level in numeric order."""
    groups = ["case_orig", "case_number", "level"]
    numbered = number_rows(
        with_even_bucket(versions, groups, "version"), groups, F.col("_even"), [F.col("version")], "version_number"
    )
    return numbered.drop("_even")


def graded_pairs(files: DataFrame) -> DataFrame:
    """Manifest rows of the graded corpus, with ``path1, path2``.

    Each version is compared with the original of its case (its first file by
    name); cases without an original are skipped.
    """
    path = F.col("path")
    originals = (
        files.where(path.rlike(ORIGINAL_PATH))
        .groupBy(F.regexp_extract(path, ORIGINAL_PATH, 1).alias("case_orig"))
        .agg(F.min("path").alias("path1"))
    )
    versions = graded_versions(files)
    numbered = number_versions(versions).withColumnRenamed("path", "path2")
    met = numbered.join(originals, "case_orig")
    case_id = F.format_string(CASE_FORMAT, F.col("case_number"))
    unrelated = F.col("level") == 0
    folder = F.when(
        unrelated, F.format_string(UNRELATED_FORMAT, case_id, F.col("version_number"))
    ).otherwise(F.format_string(COPIED_FORMAT, case_id, F.col("level"), F.col("version_number")))
    level = F.col("level").cast("string")
    return met.select(
        folder.alias("folder_name"),
        case_id.alias("case_id"),
        "case_orig",
        F.lit(ORIGINAL_FILE).alias("file1"),
        F.lit(COMPARED_FILE).alias("file2"),
        F.when(unrelated, 0).otherwise(1).alias("label"),
        F.when(unrelated, "none").otherwise(F.concat(F.lit("level_"), level)).alias("plagiarism_level"),
        F.lit("ir_plag").alias("source_dataset"),
        F.when(unrelated, "original_vs_nonplagiarized")
        .otherwise(F.concat(F.lit("original_vs_l"), level))
        .alias("comparison_type"),
        "path1",
        "path2",
        F.col("case_number").cast("bigint").alias("order1"),
        F.col("level").cast("bigint").alias("order2"),
        # Dense where versions may be sparse, and in the same order.
        F.col("version_number").cast("bigint").alias("order3"),
    )


def last_labels(labels: DataFrame) -> DataFrame:
    """``(folder_name, problem, verdict)``: a key that comes twice keeps its last row."""
    key = F.concat_ws("_", "sub1", "sub2")
    last = F.max_by(F.struct("problem", "verdict"), "line_order")
    return labels.groupBy(key.alias("folder_name")).agg(last.alias("last")).select("folder_name", "last.*")


def contest_folders(files: DataFrame) -> DataFrame:
    """Folders of the contest corpus whose name holds two submissions, with their files.

    ``sub1, sub2`` come from the name, split at its first underscore;
    ``path1, path2`` are NULL when the file of that submission is missing.
    """
    ids = F.split("folder", "_", 2)
    named = files.where(F.col("folder").contains("_")).select(
        F.col("folder").alias("folder_name"), ids[0].alias("sub1"), ids[1].alias("sub2"), "file", "path"
    )

    def path_of(sub: str):
        return F.min(F.when(F.col("file") == F.concat(F.col(sub), F.lit(SOURCE_SUFFIX)), F.col("path")))

    return named.groupBy("folder_name", "sub1", "sub2").agg(
        path_of("sub1").alias("path1"), path_of("sub2").alias("path2")
    )


def label_contest_folders(folders: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``problem, verdict`` by the exact folder name; NULL where no label matches."""
    return folders.join(last_labels(labels), "folder_name", "left")


def unlabelled_folders(folders: DataFrame, labels: DataFrame) -> DataFrame:
    """Folders without a label."""
    return folders.join(last_labels(labels), "folder_name", "left_anti").select("folder_name")


def contest_pairs(files: DataFrame, labels: DataFrame) -> DataFrame:
    """Manifest rows of the contest corpus, with ``path1, path2``."""
    labelled = label_contest_folders(contest_folders(files), labels)
    complete = labelled.where(
        F.col("verdict").isNotNull() & F.col("path1").isNotNull() & F.col("path2").isNotNull()
    )
    copied = F.col("verdict") == 1
    return complete.select(
        "folder_name",
        F.format_string(PROBLEM_FORMAT, F.col("problem")).alias("case_id"),
        F.concat(F.lit("problem-"), F.col("problem").cast("string")).alias("case_orig"),
        F.concat("sub1", F.lit(SOURCE_SUFFIX)).alias("file1"),
        F.concat("sub2", F.lit(SOURCE_SUFFIX)).alias("file2"),
        F.col("verdict").alias("label"),
        F.when(copied, "contest_level").otherwise("none").alias("plagiarism_level"),
        F.lit("conplag").alias("source_dataset"),
        F.lit("contest_submission_pair").alias("comparison_type"),
        "path1",
        "path2",
        F.conv(F.substring(F.md5("folder_name"), 1, 4), 16, 10).cast("bigint").alias("order1"),
        F.conv(F.substring(F.md5("folder_name"), 5, 4), 16, 10).cast("bigint").alias("order2"),
        F.lit(0).cast("bigint").alias("order3"),
    )


def unify(*corpora: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One manifest with ``pair_id`` numbered over all corpora in the given order.

    Inside a corpus the order is ``order1, order2, order3``, then the folder name.
    """
    rows = None
    for place, corpus in enumerate(corpora):
        placed = corpus.withColumn("_corpus", F.lit(place))
        rows = placed if rows is None else rows.unionByName(placed)
    # Corpus first, then order1; zero-padded text sorts like the numbers do.
    bucket = F.format_string("%03d-%019d-%019d-%019d", "_corpus", "order1", "order2", range_bucket(F.col("order3")))
    coarse = F.format_string("%03d-%019d", "_corpus", range_bucket(F.col("order1"), FIRST_ORDERS))
    order = [F.col(c) for c in ("_corpus", "order1", "order2", "order3", "folder_name")]
    numbered = number_rows(rows, [], bucket, order, "_number", coarse=coarse)
    named = numbered.withColumn("pair_id", F.format_string(PAIR_FORMAT, F.col("_number")))
    return named.select(*MANIFEST_COLUMNS, *extra)


def source_counts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Per source: folders, and how many hold exactly two source files."""
    source_files = F.count_if(F.col("file").endswith(SOURCE_SUFFIX))
    counts = files.groupBy(F.col("folder").alias("folder_name")).agg(source_files.alias("_files"))
    folders = manifest.select("folder_name", "source_dataset").join(counts, "folder_name", "left")
    return folders.groupBy("source_dataset").agg(
        F.count(F.lit(1)).alias("folders"), F.count_if(F.col("_files") == 2).alias("with_two_files")
    )
