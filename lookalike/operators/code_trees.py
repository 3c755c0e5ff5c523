"""Node tables of source code with brackets and semicolons, by running sums over tokens.

A file becomes a tree without a grammar. One pattern cuts it into tokens. Brackets give
every token a level and the bracket it lies in. Inside braces, statements run from one
end (a semicolon, or the brace that closes a block) to the next; a statement is a node
from its first token on, typed by the words and signs it holds outside inner brackets.
A called name is a node that lasts to its closing bracket, a binary operator one that
lasts to the next comma, semicolon or closing bracket, and literals and parameters are
leaves. So every node is a run of tokens, and its depth is the number of runs open before.

Operators named in ``CUTTING_OPERATORS`` count with their own value alone, like other
cutting nodes. A file whose brackets do not match has no nodes at all, nor has one
without tokens; scores against it are 0. A null text has no nodes.

The files are shuffled once, by document, and cut into tokens by Spark. The running sums
are numpy's, over many files at a time (``code_runs``): as windows of Spark, some ten sorts
of every token and node row took 40 times as long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lookalike.operators import code_runs
from lookalike.operators.code_runs import (  # noqa: F401 - the language, as its readers know it from here
    ASSIGNING,
    BEFORE_EXPRESSIONS,
    BINARY,
    CLASS_WORDS,
    CUTTING_OPERATORS,
    GOES_ON,
    KINDS,
    LITERAL_WORDS,
    NEVER_CALLED,
    ROOT,
)
from lookalike.operators.parts import CODE_TEXT_BYTES, parts_for
from lookalike.operators.trees import NODE_VALUES, OTHER_NODE_VALUE
from lookalike.sources.shipping import ship

#: Comments, strings, characters, numbers, words, operators and brackets.
TOKEN = (
    r"(?s)/\*.*?\*/|//[^\n]*"
    r"|\"[^\"\n]*\"|'[^'\n]*'"
    r"|\d[\p{L}\p{N}_.]*|[\p{L}_$][\p{L}\p{N}_$]*"
    r"|&&|\|\||\+\+|--|<<|>>|->|::|[-+*/%&|^=<>!]=|[-+*/%&|^=<>!~?:;,.(){}\[\]@]"
)

#: A sign after a backslash never ends a string; both are set aside before the cut, so that no
#: pattern has to loop over escapes.
ESCAPED, ASIDE = r"\\[^\n]", "__"

TREE = "array<struct<depth: int, kind: int, line: int, is_cut: boolean>>"
NODES = "array<struct<position: int, kind: int, depth: int, children: int, hash: bigint, line: int>>"


def code_tokens(text: Column) -> Column:
    """The tokens of a text, comments and line ends among them."""
    return F.regexp_extract_all(F.regexp_replace(text, ESCAPED, ASIDE), F.lit(f"{TOKEN}|\n"), F.lit(0))


def _trees(tokens: pa.Array) -> pa.Array:
    parts = [pa.array([], pa.list_(_struct(TREE_FIELDS)))]
    for lo, hi, *found in code_runs.slices(tokens):
        nodes = code_runs.tree(*found)
        parts.append(code_runs.as_lists(hi - lo, nodes["doc"], {c: pa.array(nodes[c], kind) for c, kind in TREE_FIELDS.items()}))
    return pa.concat_arrays(parts)


def _nodes(tokens: pa.Array) -> pa.Array:
    base = np.array([NODE_VALUES.get(kind, OTHER_NODE_VALUE) for kind in KINDS])
    parts = [pa.array([], pa.list_(_struct(NODE_FIELDS)))]
    for lo, hi, *found in code_runs.slices(tokens):
        nodes = code_runs.hashed(code_runs.tree(*found), base)
        lost = nodes["position"] < 0
        fields = {c: pa.array(nodes[c], kind, mask=lost) for c, kind in NODE_FIELDS.items()}
        parts.append(code_runs.as_lists(hi - lo, nodes["doc"], fields))
    return pa.concat_arrays(parts)


TREE_FIELDS = {"depth": pa.int32(), "kind": pa.int32(), "line": pa.int32(), "is_cut": pa.bool_()}
NODE_FIELDS = {
    "position": pa.int32(),
    "kind": pa.int32(),
    "depth": pa.int32(),
    "children": pa.int32(),
    "hash": pa.int64(),
    "line": pa.int32(),
}


def _struct(fields: dict[str, pa.DataType]) -> pa.DataType:
    return pa.struct([pa.field(name, kind) for name, kind in fields.items()])


def _per_file(files: DataFrame, build, kind: str) -> DataFrame:
    """``(doc_id, nodes)``: what ``build`` makes of the tokens of each document, which stays where it was shuffled to."""
    ship(files.sparkSession)

    def made(tokens: pa.Array) -> pa.Array:
        return build(tokens)

    made.__annotations__ = {"tokens": pa.Array, "return": pa.Array}
    texts = files.select("doc_id", "text").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    return texts.select("doc_id", F.arrow_udf(made, kind)(F.transform("texts", code_tokens)).alias("nodes"))


def _kind_name() -> Column:
    return F.get(F.array(*map(F.lit, KINDS)), F.col("node.kind")).alias("node_type")


def code_tree(files: DataFrame) -> DataFrame:
    """``doc_id, position, depth, node_type, line_number, is_cut`` of ``files (doc_id, text)``."""
    trees = _per_file(files, _trees, TREE).select("doc_id", F.posexplode("nodes").alias("position", "node"))
    return trees.select("doc_id", "position", "node.depth", _kind_name(), F.col("node.line").alias("line_number"), "node.is_cut")


def code_tree_nodes(files: DataFrame) -> DataFrame:
    """Node table of source files ``(doc_id, text)``; the texts are shuffled once, by document.

    The partitions are as many as the bytes of the texts need.
    """
    texts = files.select("doc_id", "text")
    parts = parts_for(texts, F.octet_length("text"), CODE_TEXT_BYTES)
    found = _per_file(texts.repartition(parts, "doc_id"), _nodes, NODES).select("doc_id", F.explode("nodes").alias("node"))
    return found.select(
        "doc_id",
        "node.position",
        _kind_name(),
        "node.depth",
        F.col("node.children").alias("num_children"),
        F.col("node.hash").alias("hash_value"),
        F.col("node.line").alias("line_number"),
    )
