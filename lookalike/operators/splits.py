"""Seeded shuffles, stratified splits and their profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lookalike.operators.numbering import number_rows, shuffle_bucket, shuffle_hash

# Default ratios, seed, split names and the ratio tolerance.
TRAIN_RATIO = 0.7
VALIDATION_RATIO = 0.1
TEST_RATIO = 0.2
SIMPLE_TRAIN_RATIO = 0.8
SEED = 42
TRAIN, VALIDATION, TEST = "train", "validation", "test"
RATIO_TOLERANCE = 0.001


def check_ratios(*ratios: float) -> None:
    if abs(sum(ratios) - 1.0) > RATIO_TOLERANCE:
        raise ValueError(f"split ratios must sum to 1, got {sum(ratios)}")


def seeded_shuffle(
    df: DataFrame, key: list[str], seed: int = SEED, strata: list[str] = (), name: str = "shuffle_rank"
) -> DataFrame:
    """Number the rows of each stratum in a random order fixed by ``seed``.

    ``key`` identifies a row. The size of the stratum comes along as
    ``stratum_size``.
    """
    digest = shuffle_hash(seed, *key)
    return number_rows(
        df, list(strata), shuffle_bucket(digest), [digest, *(F.col(k) for k in key)], name, "stratum_size"
    )


def share_of(size: Column, ratio: float) -> Column:
    """Whole rows in a share; the product is a double, as in float arithmetic."""
    return F.floor(size * F.lit(float(ratio)))


def stratified_split(
    df: DataFrame,
    key: list[str],
    strata: list[str],
    train: float = TRAIN_RATIO,
    validation: float = VALIDATION_RATIO,
    test: float = TEST_RATIO,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split``: per stratum the first share is train, then validation; the rest is test."""
    check_ratios(train, validation, test)
    ranked = seeded_shuffle(df, key, seed, strata)
    rank, size = F.col("shuffle_rank"), F.col("stratum_size")
    n_train, n_validation = share_of(size, train), share_of(size, validation)
    split = (
        F.when(rank <= n_train, TRAIN).when(rank <= n_train + n_validation, VALIDATION).otherwise(TEST)
    )
    return ranked.withColumn("split", split).drop("shuffle_rank", "stratum_size")


def shuffle_within_splits(split_rows: DataFrame, key: list[str], seed: int = SEED) -> DataFrame:
    """Number each split in its own random order; every split has its own seed."""
    own_seed = (
        F.when(F.col("split") == TRAIN, seed).when(F.col("split") == VALIDATION, seed + 1).otherwise(seed + 2)
    )
    digest = F.md5(F.concat_ws("|", own_seed.cast("string"), *(F.col(k).cast("string") for k in key)))
    return number_rows(
        split_rows, ["split"], shuffle_bucket(digest), [digest, *(F.col(k) for k in key)], "row_in_split"
    )


def simple_split(
    df: DataFrame, key: list[str], train: float = SIMPLE_TRAIN_RATIO, seed: int = SEED
) -> DataFrame:
    """Train/test split of the whole shuffled table."""
    ranked = seeded_shuffle(df, key, seed)
    in_train = F.col("shuffle_rank") <= share_of(F.col("stratum_size"), train)
    return ranked.withColumn("split", F.when(in_train, TRAIN).otherwise(TEST)).drop(
        "shuffle_rank", "stratum_size"
    )


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, 1))


def split_profile(split_rows: DataFrame) -> DataFrame:
    """Per split: sizes, label and source shares, distinct cases. Empty splits have no row."""
    size = F.count(F.lit(1))
    positives = F.count_if(F.col("label") == 1)
    graded = F.count_if(F.col("source_dataset") == "ir_plag")
    contest = F.count_if(F.col("source_dataset") == "conplag")
    return split_rows.groupBy("split").agg(
        size.alias("pairs"),
        positives.alias("positives"),
        percent(positives, size).alias("positive_pct"),
        (size - positives).alias("negatives"),
        percent(size - positives, size).alias("negative_pct"),
        graded.alias("ir_plag"),
        percent(graded, size).alias("ir_plag_pct"),
        contest.alias("conplag"),
        percent(contest, size).alias("conplag_pct"),
        F.count_distinct("case_id").alias("cases"),
    )


def split_levels(split_rows: DataFrame) -> DataFrame:
    """Positives per split and level, most frequent level first."""
    return (
        split_rows.where(F.col("label") == 1)
        .groupBy("split", "plagiarism_level")
        .agg(F.count(F.lit(1)).alias("pairs"))
        .orderBy("split", F.desc("pairs"), "plagiarism_level")
    )


def split_shares(split_rows: DataFrame) -> DataFrame:
    """Size of each split and its share of all rows."""
    sizes = split_rows.groupBy("split").agg(F.count(F.lit(1)).alias("pairs"))
    # One row per split name, so the unpartitioned total is harmless.
    whole = F.sum("pairs").over(Window.partitionBy(F.lit(0)))
    return sizes.withColumn("total_pairs", whole).select(
        "split", "pairs", percent(F.col("pairs"), F.col("total_pairs")).alias("pairs_pct"), "total_pairs"
    )


def manifest_profile(manifest: DataFrame) -> DataFrame:
    """Totals, per source and per level of the positives, in one pass.

    ``part`` says what a row describes: ``all``, ``source`` or ``level``.
    """
    size = F.count(F.lit(1))
    positives = F.count_if(F.col("label") == 1)
    level = F.when(F.col("label") == 1, F.col("plagiarism_level"))
    sets = manifest.select("source_dataset", level.alias("level"), "label").groupingSets(
        [[], [F.col("source_dataset")], [F.col("level")]], F.col("source_dataset"), F.col("level")
    )
    rows = sets.agg(
        F.grouping_id().alias("_grouping"),
        size.alias("pairs"),
        positives.alias("positives"),
        percent(positives, size).alias("positive_pct"),
    )
    part = F.when(F.col("_grouping") == 3, "all").when(F.col("_grouping") == 1, "source").otherwise("level")
    name = F.coalesce("source_dataset", "level", F.lit("all"))
    named = rows.where((F.col("_grouping") != 2) | F.col("level").isNotNull())
    return named.select(
        part.alias("part"), name.alias("name"), "pairs", "positives", "positive_pct"
    )
