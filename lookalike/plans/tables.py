"""Pair lists and file listings derived from the given tables.

``documents`` stand for source files and ``labels.quality`` for the verdict.
Two corpora of pairs are read off the documents, each linear in their number:

* graded: every document of a ``source`` against the first one of that source;
* contest: every document against the first one that has the same longest line,
  so copies and near copies meet.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lookalike.functions.text import words
from lookalike.operators.pairs import PAIR
from lookalike.operators.trees import SENTENCE

# Path formats of the file listing.
ORIGINAL_FORMAT = "graded/case-%02d/Original/%d.java"
UNRELATED_FORMAT = "graded/case-%02d/non-plagiarized/%d/%d.java"
COPIED_FORMAT = "graded/case-%02d/plagiarized/L%d/%d/%d.java"
CONTEST_FORMAT = "contest/%s/%s.java"
LEVELS = 6
PROBLEMS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def star(members: DataFrame, group: str) -> DataFrame:
    """``(group, doc1, doc2)``: each member of a group with its first one.

    The first members come from a partial aggregation. A group may hold any
    share of the rows: the join back is a plain one, whose large partitions
    adaptive execution splits.
    """
    firsts = members.groupBy(group).agg(F.min("doc_id").alias("doc1"))
    met = members.join(firsts, group)
    return met.where(F.col("doc_id") != F.col("doc1")).select(group, "doc1", F.col("doc_id").alias("doc2"))


def source_number(source: str) -> Column:
    return F.regexp_extract(source, r"(\d+)", 1).try_cast("int")


def problem_number() -> Column:
    """Contest problem of a pair, by its first document."""
    return F.pmod("doc1", F.lit(PROBLEMS)).cast("int")


def case_pairs(keys: DataFrame) -> DataFrame:
    """``source, doc1, doc2`` of the graded corpus."""
    return star(keys.select("doc_id", "source"), "source")


def longest_line(text: Column) -> Column:
    """The line with most characters; the greatest of several."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(F.length(x).alias("n"), x.alias("line")))
    return F.array_max(lines)["line"]


def document_keys(documents: DataFrame) -> DataFrame:
    """``doc_id, source, line_key``: all that the pair lists need of a document."""
    line_key = F.sha2(longest_line(F.col("text")), 256).alias("line_key")
    return documents.select("doc_id", "source", line_key)


def copy_pairs(keys: DataFrame) -> DataFrame:
    """``doc1, doc2`` of the contest corpus."""
    return star(keys.select("doc_id", "line_key"), "line_key").select(*PAIR)


def all_pairs(keys: DataFrame) -> DataFrame:
    """The pairs of both corpora, each once."""
    return case_pairs(keys).select(*PAIR).unionByName(copy_pairs(keys)).distinct()


def labelled_pairs(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled pairs of both corpora in manifest terms; a pair may be in both."""
    verdicts = labels.select(F.col("doc_id").alias("doc2"), F.col("quality").alias("label"))
    copied = F.col("label") == 1
    level = F.concat(F.lit("level_"), (F.pmod("doc2", F.lit(LEVELS)) + 1).cast("string"))
    graded = case_pairs(keys).join(verdicts, "doc2").select(
        F.lit("ir_plag").alias("source_dataset"),
        F.format_string("c%02d", source_number("source")).alias("case_id"),
        *PAIR,
        "label",
        F.when(copied, level).otherwise("none").alias("plagiarism_level"),
    )
    contest = copy_pairs(keys).join(verdicts, "doc2").select(
        F.lit("conplag").alias("source_dataset"),
        F.format_string("p%02d", problem_number()).alias("case_id"),
        *PAIR,
        "label",
        F.when(copied, "contest_level").otherwise("none").alias("plagiarism_level"),
    )
    return graded.unionByName(contest)


def host_pairs(pages: DataFrame) -> DataFrame:
    """Every page against the first page of its host."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host")
    return star(pages.select(F.col("page_id").alias("doc_id"), host), "host").select(*PAIR)


# --- the same corpora as file listings -------------------------------------------


def submission(doc: str) -> Column:
    """Submission id of a document: its number as eight hex digits."""
    return F.lpad(F.lower(F.hex(F.col(doc))), 8, "0")


def contest_folder() -> Column:
    """Folder of a contest pair; every other one has its two names reversed."""
    names = [submission("doc1"), submission("doc2")]
    return F.when(F.pmod("doc2", F.lit(2)) == 1, F.concat_ws("_", *reversed(names))).otherwise(
        F.concat_ws("_", *names)
    )


def graded_listing(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """``path, doc_id`` in the layout of the graded corpus; versions are the labelled documents."""
    originals = keys.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    original_files = originals.select(
        F.format_string(ORIGINAL_FORMAT, source_number("source"), F.col("doc_id")).alias("path"), "doc_id"
    )
    number = source_number("source")
    versions = case_pairs(keys).join(
        labels.select(F.col("doc_id").alias("doc2"), F.col("quality").alias("label")), "doc2"
    )
    doc = F.col("doc2")
    level = F.pmod(doc, F.lit(LEVELS)) + 1
    path = F.when(F.col("label") == 1, F.format_string(COPIED_FORMAT, number, level, doc, doc)).otherwise(
        F.format_string(UNRELATED_FORMAT, number, doc, doc)
    )
    return original_files.unionByName(versions.select(path.alias("path"), doc.alias("doc_id")))


def contest_listing(keys: DataFrame) -> DataFrame:
    """``path, folder, file, doc_id``: two files in the folder of every contest pair."""
    folders = copy_pairs(keys).withColumn("folder", contest_folder())
    ends = F.explode(F.array("doc1", "doc2"))
    return folders.select("folder", ends.alias("doc_id")).select(
        F.format_string(CONTEST_FORMAT, F.col("folder"), submission("doc_id")).alias("path"),
        "folder",
        F.concat(submission("doc_id"), F.lit(".java")).alias("file"),
        "doc_id",
    )


def contest_labels(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """Raw label rows of the contest folders. Each key comes twice; the later row has the verdict."""
    verdicts = labels.select(F.col("doc_id").alias("doc2"), "quality", "toxic")
    rows = copy_pairs(keys).join(verdicts, "doc2").withColumn("folder", contest_folder())
    lines = F.array(
        F.struct(F.col("toxic").alias("verdict"), F.lit(1).alias("line_order")),
        F.struct(F.col("quality").alias("verdict"), F.lit(2).alias("line_order")),
    )
    names = F.split("folder", "_", 2)
    return rows.select(names[0].alias("sub1"), names[1].alias("sub2"), problem_number().alias("problem"), F.inline(lines))


# --- source code made from the documents -------------------------------------------

# The statement a sentence becomes, by its number of words; <w> is its first
# word, <n> that number. Strings and comments hold brackets on purpose.
CODE_STATEMENTS = (
    "int <w> = <n>;",
    '<w>(a, "<w>; { <n>");',
    "if (a < <n>) { <w> = a - b / 2; } else { b++; }",
    "for (int i = 0; i < <n>; i++) { <w>(i, b).next(); }",
    "while (<w> != null) { a += <w>.size(1) % 3 + 'x'; }",
    "/* <w> { */ List<String> <w> = new Map(a, b * 2); // done )",
    "return f(<w>, a - g(b + 1) * 2);",
)
#: Documents with this remainder have a bracket too many.
BROKEN_CODE = (50, 7)
#: The files of documents with this remainder end in a byte that is no UTF-8.
BROKEN_BYTES = (40, 13)


def code_texts(documents: DataFrame) -> DataFrame:
    """``doc_id, text``: a class per document, a method per line, a statement per sentence."""

    def statement(words_: Column) -> Column:
        def filled(pattern: str) -> Column:
            parts = re.split(r"<([wn])>", pattern)
            values = {"w": words_[0], "n": F.size(words_).cast("string")}
            return F.concat(*(values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)))

        kind = F.pmod(F.size(words_), F.lit(len(CODE_STATEMENTS)))
        return F.array(*(filled(p) for p in CODE_STATEMENTS))[kind]

    def sentences(line: Column) -> Column:
        cut = F.transform(F.regexp_extract_all(line, F.lit(SENTENCE), F.lit(0)), words)
        return F.filter(cut, lambda w: F.size(w) > 0)

    def method(own: Column) -> Column:
        body = F.array_join(F.transform(own, statement), "\n")
        return F.concat(F.lit("public int "), own[0][0], F.lit("(int a, String b) {\n"), body, F.lit("\n}"))

    lines = F.filter(F.transform(F.split("text", "\n"), sentences), lambda own: F.size(own) > 0)
    every, at = BROKEN_CODE
    end = F.when(F.pmod("doc_id", F.lit(every)) == at, "\n}}").otherwise("\n}")
    head = F.concat(F.lit("class D"), F.col("doc_id").cast("string"), F.lit(" {\n"))
    return documents.select("doc_id", F.concat(head, F.array_join(F.transform(lines, method), "\n"), end).alias("text"))
