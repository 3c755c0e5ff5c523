"""Row numbers over groups of any size.

A plain window sorts a whole group in one task. Here every group is cut into
buckets along the sort order; rows are numbered inside their bucket and shifted
by what the earlier buckets hold. The bucket must be a deterministic expression
that never decreases along the sort order, so a recomputed task gives the same
numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Unique whole-number keys per bucket, at most.
RANGE_WIDTH = 65_536
#: Buckets of a shuffle order: the first four hex digits of a digest.
SHUFFLE_DIGITS = 4


def shuffle_hash(seed: int, *keys: str) -> Column:
    """Digest that orders rows at random, the same way on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def shuffle_bucket(digest: Column) -> Column:
    return F.substring(digest, 1, SHUFFLE_DIGITS)


def range_bucket(number: Column, width: int = RANGE_WIDTH) -> Column:
    return F.floor(number / F.lit(width))


#: Buckets of a group whose numbers may lie anywhere, and the accuracy of their bounds.
EVEN_BUCKETS = 256
BOUND_ACCURACY = 10_000


def with_even_bucket(df: DataFrame, groups: Sequence[str], number: str, name: str = "_even") -> DataFrame:
    """Add ``name``, which never decreases with ``number`` and cuts every group about evenly.

    Bounds are approximate quantiles per group, so numbers may be dense, sparse or
    like hashes. The table of bounds has a row per group; the join is a plain one.
    """
    shares = [i / EVEN_BUCKETS for i in range(1, EVEN_BUCKETS)]
    bounds = df.groupBy(*groups).agg(
        F.array_distinct(F.percentile_approx(number, shares, BOUND_ACCURACY)).alias("_bounds")
    )
    keys = {g: f"_of_{g}" for g in groups}
    met = df.join(bounds.withColumnsRenamed(keys), [F.col(g).eqNullSafe(F.col(k)) for g, k in keys.items()])
    below = F.size(F.filter("_bounds", lambda bound: bound < F.col(number)))
    return met.withColumn(name, below).drop("_bounds", *keys.values())


def _group_key(groups: Sequence[str]) -> Column:
    """One key for all group columns; as a struct it also matches NULL values."""
    return F.struct(*groups) if groups else F.lit(0)


def _earlier_rows(counts: DataFrame, within: list[str], along: str) -> DataFrame:
    """Add ``_shift``, the rows of earlier buckets, and ``_size``, those of all."""
    whole = Window.partitionBy(*within)
    before = whole.orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "*",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"),
        F.sum("_rows").over(whole).alias("_size"),
    )


def number_rows(
    df: DataFrame,
    groups: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    name: str,
    size_name: str | None = None,
    coarse: Column | None = None,
) -> DataFrame:
    """Add ``name``: 1, 2, 3... per group along ``order``, and the group size.

    The rows are shuffled once, by group and bucket. When a group may have very
    many buckets, ``coarse`` gives wider ones along the same order: buckets are
    then summed inside a coarse bucket, and only coarse ones over the group.
    """
    keys = ["_group", "_bucket"]
    placed = df.withColumn("_group", _group_key(groups)).withColumn("_bucket", bucket)
    if coarse is None:
        counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        shifts = _earlier_rows(counts, ["_group"], "_bucket").drop("_rows")
    else:
        counts = placed.withColumn("_coarse", coarse).groupBy(*keys, "_coarse").agg(F.count(F.lit(1)).alias("_rows"))
        inner = _earlier_rows(counts, ["_group", "_coarse"], "_bucket").withColumnRenamed("_shift", "_inner")
        wide = counts.groupBy("_group", "_coarse").agg(F.sum("_rows").alias("_rows"))
        outer = _earlier_rows(wide, ["_group"], "_coarse").drop("_rows")
        both = inner.drop("_rows", "_size").join(outer, ["_group", "_coarse"])
        shifts = both.select(*keys, (F.col("_inner") + F.col("_shift")).alias("_shift"), "_size")
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    joined = placed.withColumn("_local", local).join(shifts, keys)
    out = [*df.columns, (F.col("_local") + F.col("_shift")).alias(name)]
    if size_name:
        out.append(F.col("_size").alias(size_name))
    return joined.select(*out)

