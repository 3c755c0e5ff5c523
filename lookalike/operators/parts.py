"""How many partitions rows need, so that what a task makes of them fits into its memory.

Grams and nodes take some hundred times the bytes of their text. A fixed number of
partitions makes tasks that grow with the input, until they sort and spill all they
make; a number that follows the bytes keeps every task as large as on a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Text whose grams, counted, take some 500 MB.
GRAM_TEXT_BYTES = 4 << 20
#: Source code whose nodes, sorted for some ten windows, take about a gigabyte.
CODE_TEXT_BYTES = 1 << 20


def row_bytes(kind: str, name: str) -> Column:
    """Bytes of a column's values: of the characters of a text, about a structure for each entry of an array."""
    if kind.startswith("array"):
        return 24 * F.coalesce(F.size(name), F.lit(0))
    return F.coalesce(F.octet_length(name), F.lit(0))


def parts_for(rows: DataFrame, size: Column, at_most: int) -> int:
    """Partitions of about ``at_most`` bytes each for ``rows`` of ``size`` bytes, one for every core at least."""
    total = rows.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // at_most))
