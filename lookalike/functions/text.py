"""Column expressions that turn source text into words and word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Patterns that decide what counts as a comment and as a word.
LINE_COMMENT = r"//[^\n]*\n"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
WORD = r"[\p{L}\p{N}_]+"
PAIR_MARKER = " [SEP] "

#: Pseudo-gram that every text yields once, so that a text without words still
#: takes part in the aggregation. It cannot collide: real grams are not empty.
NO_GRAM = ""


def strip_comments(text: Column) -> Column:
    """Drop line comments, then block comments.

    A line comment counts only when a newline ends it; the newline stays.
    """
    without_lines = F.regexp_replace(text, LINE_COMMENT, "\n")
    return F.regexp_replace(without_lines, BLOCK_COMMENT, "")


def normalize(text: Column) -> Column:
    """Strip comments, collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(strip_comments(text), BLANKS, " "))


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def pair_text(left: Column, right: Column) -> Column:
    """One training text for a pair, with a marker between its two sides."""
    return F.concat(left, F.lit(PAIR_MARKER), right)


def grams_at(tokens: Column, i: Column, longest: int, shortest: int = 1) -> Column:
    """Array of the n-grams that start at ``i``; NULL where the text ends first."""
    runs = [F.get(tokens, i)]
    for n in range(1, longest):
        runs.append(F.concat(runs[-1], F.lit(" "), F.get(tokens, i + n)))
    return F.array(*runs[shortest - 1 :])


def explode_grams(
    df: DataFrame, text: Column, keep: list[str], longest: int = 3, sentinel: bool = False
) -> DataFrame:
    """One row ``(*keep, gram)`` per n-gram occurrence.

    With ``sentinel`` every input row also yields one ``NO_GRAM`` row. The
    grams are built from array positions by two generators in one codegen
    stage; nothing is sorted or shuffled. The outer form keeps Spark from adding
    a filter on the number of words, which would cut every text twice.
    """
    return explode_word_grams(df, words(text), keep, longest, sentinel)


def explode_word_grams(
    df: DataFrame, tokens: Column, keep: list[str], longest: int = 3, sentinel: bool = False
) -> DataFrame:
    """The same from an array of words."""
    if sentinel:
        tokens = F.concat(F.array(F.lit(NO_GRAM)), F.coalesce(tokens, F.array().cast("array<string>")))
    rows = df.select(*keep, tokens.alias("_words"))
    rows = rows.select(*keep, "_words", F.posexplode_outer("_words").alias("_at", "_word"))
    here = grams_at(F.col("_words"), F.col("_at"), longest)
    if sentinel:
        alone = F.array(F.lit(NO_GRAM))
        here = F.when(F.col("_at") == 0, alone).otherwise(here)
    return rows.select(*keep, F.explode(here).alias("gram")).where(F.col("gram").isNotNull())
