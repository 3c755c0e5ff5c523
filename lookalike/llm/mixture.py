"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of a source are a stream of equal blocks. Targets decide how many blocks of
the mix each source gets, and its shards share them by their words. Sainte-Lague gives
the seats one by one to the highest quotient ``votes / (2 * seats + 1)``; for a house
that may be of any size this is ``votes / divisor``, rounded, and the divisor here is
the block itself. So every quota is an expression of its own row: sources are ranked,
weighed and apportioned as a table, and none of them comes to the driver. A shard is a
seeded part of a source that one task can order. Its blocks are taken as often as its
quota holds whole rounds, and a seeded run of blocks once more.

Blocks have ``BLOCK_WORDS`` words, fewer where the smallest target would not hold
``FINEST`` of them, so that small sources are rounded no more coarsely than large ones.

Defined results: a null text has size 0 and takes nothing; a null source is a
source of its own, last in order; repeated rows and rows without an id are
separate documents, told apart by source, text and a number within equal rows; an
empty table gives an empty result;
other columns are ignored by ``mix`` and passed through by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lookalike.operators.numbering import number_rows, range_bucket
from lookalike.sources.scratch import written

# What a word is, and the weights that sources repeat in order.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)

#: No document is taken more often than this.
MAX_REPEATS = 3
#: Words of a block, at most, and blocks that the smallest target holds, at least.
BLOCK_WORDS = 20
FINEST = 20
#: Documents of a shard, about. One task orders a shard.
SHARD_ROWS = 1_000
SEED = 17
#: What tells rows apart; ``nth`` is the number within rows that are equal otherwise.
KEY = ("doc_id", "source", "digest", "nth")


def sizes(docs: DataFrame, row: Column) -> DataFrame:
    """``(row, doc_id, source, digest, size)``; the size is the number of words."""
    text = F.col("text").cast("string")
    count = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col("source").cast("string").alias("source")
    return docs.select(row.alias("row"), "doc_id", source, F.xxhash64(text).alias("digest"), count.alias("size"))


def ranked_sources(by_source: DataFrame) -> DataFrame:
    """``by_source`` with ``rank``, from 0 in code-point order, null last.

    Sorted in ranges by Spark; a range is shifted by the rows of the earlier ones.
    """
    placed = by_source.orderBy(F.asc_nulls_last("source")).withColumn("_place", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_range", F.shiftright("_place", 33)), "mixture-ranks")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    shifts = ranges.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    rank = F.col("_shift") + F.col("_place") - F.shiftleft("_range", 33)
    return placed.join(shifts, "_range").select(*by_source.columns, rank.alias("rank"))


def with_targets(ranked: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to ``(source, words, rank)``: shares by repeating weights, none above ``most`` times its words.

    A source is full where the common level reaches ``most`` times its words; what it
    cannot take raises the level for the others. The level only rises, and a round that
    fills no further source ends the search. Sums are exact, so reruns agree.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = written(ranked.withColumn("weight", weight.cast("decimal(18,6)")), "mixture-weights")
    holds = F.col("words") > 0
    level, filled = 0.0, -1
    while True:
        full = holds & (F.col("weight").cast("double") * level >= most * F.col("words"))
        total, in_full, open_, now = weighed.agg(
            F.coalesce(F.sum("words"), F.lit(0)),
            F.coalesce(F.sum(F.when(full, F.col("words"))), F.lit(0)),
            F.coalesce(F.sum(F.when(holds & ~full, F.col("weight"))), F.lit(0)),
            F.count_if(full),
        ).first()
        if now == filled or not open_:
            target = F.when(full, most * F.col("words")).when(holds, F.col("weight").cast("double") * level)
            return weighed.withColumn("target", F.coalesce(target.cast("double"), F.lit(0.0))).drop("weight")
        level, filled = float((total - most * in_full) / open_), now


def quota(votes: Column, divisor: Column | int) -> Column:
    """Seats by the highest quotients ``votes / (2 k + 1)`` down to half the divisor."""
    return F.floor(votes / divisor + 0.5).cast("long")


def _seeded(*columns: Column | str) -> Column:
    return F.xxhash64(F.lit(SEED), *columns)


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every document.

    Only sizes are shuffled, never texts.
    """
    taken = _mixed(sizes(docs, F.monotonically_increasing_id()), block_words, shard_rows)
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def _mixed(found_sizes: DataFrame, block_words: int, shard_rows: int) -> DataFrame:
    """``(row, *KEY, size, source_size, target, taken)`` of ``sizes``."""
    serial = written(found_sizes, "mixture-sizes")
    numbered = number_rows(serial, KEY[:-1], range_bucket(F.col("row")), [F.col("row")], "nth")
    rows = written(numbered.select("row", *KEY, "size"), "mixture-rows")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("documents"))
    plan = written(with_targets(ranked_sources(by_source)), "mixture-plan")
    smallest = plan.where("words > 0").agg(F.min("target")).first()[0] or 0.0
    block = max(1, min(block_words, int(smallest // FINEST)))
    plan = plan.select(
        F.col("source").alias("_source"),
        F.col("words").alias("source_size"),
        "target",
        F.ceil(F.col("documents") / shard_rows).alias("shards"),
    )

    # The plan has a row per source; whether it is broadcast is left to Spark and its size limit.
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.withColumn("shard", F.pmod(_seeded(*KEY, F.lit("shard")), F.col("shards")))
    cell = ["source", "shard"]
    shards = placed.groupBy(*cell).agg(
        F.sum("size").alias("shard_words"), F.first("source_size").alias("all"), F.first("target").alias("votes")
    )
    # A shard's votes are its share of the source's target; a source of one shard has all of them.
    votes = F.col("votes") * (F.col("shard_words") / F.col("all"))
    won = F.least(quota(votes, block) * block, F.col("shard_words") * MAX_REPEATS)
    given = shards.where("shard_words > 0").select(
        F.col("source").alias("_source"),
        F.col("shard").alias("_shard"),
        "shard_words",
        won.alias("won"),
        F.greatest(F.lit(1), F.round(F.col("shard_words") / block)).cast("long").alias("blocks"),
    )
    given = given.withColumn("rounds", F.expr("won div shard_words"))
    extra = F.round((F.col("won") % F.col("shard_words")) * F.col("blocks") / F.col("shard_words"))
    given = given.withColumn("extra", extra.cast("long"))
    given = given.withColumn("first", F.pmod(_seeded("_source", "_shard"), F.col("blocks")))

    met = F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))
    joined = placed.drop("_source").join(given, met, "left")
    order = Window.partitionBy(*cell).orderBy(_seeded(*KEY), *KEY).rowsBetween(Window.unboundedPreceding, 0)
    ended = joined.withColumn("_end", F.sum("size").over(order)).withColumn("_start", F.col("_end") - F.col("size"))
    return ended.select("row", *KEY, "size", "source_size", "target", _taken().cast("long").alias("taken"))


def _taken() -> Column:
    """Words of ``[_start, _end)`` in whole rounds and in the run of extra blocks.

    Block ``b`` covers ``[b * words div blocks, (b + 1) * words div blocks)``. The run
    starts at a seeded block and goes on at the shard's first one after its last.
    """
    run = "greatest(0, least(_end, {1}) - greatest(_start, {0}))"
    begin = "(first * shard_words) div blocks"
    end = "(least(first + extra, blocks) * shard_words) div blocks"
    around = "(greatest(first + extra - blocks, 0) * shard_words) div blocks"
    return F.expr(f"if(size = 0, 0, size * rounds + {run.format(begin, end)} + {run.format('0', around)})")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    A document of which the mix takes a fraction of a round is kept once more or
    not by a seeded draw with that probability, so texts stay whole and the
    sources' shares hold on average.
    """
    names = ("_times", "_copy", "_row")
    times, copy, row = (next(n for n in (base + "_" * i for i in range(99)) if n not in docs.columns) for base in names)
    # Written with its number, so that a row is the same one in the mix and in the join.
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "mixture-documents")
    taken = _mixed(sizes(keyed, F.col(row)), BLOCK_WORDS, SHARD_ROWS).where("size > 0")
    draw = F.pmod(_seeded(*KEY, F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    whole = taken.select(F.col("row").alias(row), F.floor(F.col("taken") / F.col("size") + draw).cast("int").alias(times))
    joined = keyed.join(whole.where(F.col(times) > 0), row)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
