"""Tree nodes of documents with child counts and additive subtree hashes.

A node table has one row per node: ``doc_id, position`` (preorder, from 0),
``node_type, num_children, hash_value, line_number``. The hash of a node is the
base value of its type plus the hashes of its children. A node of a cutting
type counts with its base value alone; the nodes below it still have rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lookalike.functions.text import WORD, words

# Base value per node type, and the value of every other type.
NODE_VALUES = {
    "MethodDeclaration": 100,
    "ClassDeclaration": 200,
    "VariableDeclaration": 50,
    "BinaryOperation": 20,
    "Assignment": 30,
    "IfStatement": 40,
    "ForStatement": 60,
    "WhileStatement": 65,
    "FunctionCall": 20,
    "Parameter": 15,
    "Literal": 10,
}
OTHER_NODE_VALUE = 5

# Node types of prose trees and their base values.
TEXT_VALUES = {
    "document": 200,
    "line": 100,
    "sentence": 50,
    "word_short": 10,
    "word_middle": 15,
    "word_long": 20,
}
SHORT_WORD, LONG_WORD = 3, 8
SENTENCE = r"[^.!?]+"

# Markup: what is no element, what a tag looks like, elements without content.
NOT_ELEMENTS = r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
TAG = r"</?[a-zA-Z][^>]*>"
TAG_NAME = r"^</?([a-zA-Z][^\s/>]*)"
VOID_TAGS = ("p", "b", "br", "meta", "img", "hr", "input", "link")
TAG_VALUES = {"html": 200, "body": 100, "article": 60, "div": 50, "nav": 40, "ul": 30, "li": 20, "p": 15, "a": 10}


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, although ``use`` names it often."""
    return F.transform(F.array(value), use)[0]


def base_value(node_type: Column, values: dict[str, int] = NODE_VALUES, other: int = OTHER_NODE_VALUE) -> Column:
    """Base value of a node type, by a literal map."""
    pairs = [F.lit(v) for item in values.items() for v in item]
    return F.coalesce(F.create_map(*pairs)[node_type], F.lit(other)).cast("bigint")


def text_tree(text: Column) -> Column:
    """Nodes of the tree document > line > sentence > word, in preorder.

    An array of structs built inside the row, so that extraction needs no
    shuffle. Blank lines and sentences without words are no nodes.
    """

    def node(kind, children, value, line):
        return F.struct(
            kind.alias("node_type"),
            children.cast("int").alias("num_children"),
            value.cast("bigint").alias("hash_value"),
            line.cast("int").alias("line_number"),
        )

    def by_length(word: Column, short: Column, middle: Column, long: Column) -> Column:
        size = F.length(word)
        return F.when(size <= SHORT_WORD, short).when(size < LONG_WORD, middle).otherwise(long)

    kinds = ("word_short", "word_middle", "word_long")

    def sentence_nodes(sentence: Column, line: Column) -> Column:
        def leaf(word: Column) -> Column:
            kind = by_length(word, *(F.lit(k) for k in kinds))
            value = by_length(word, *(F.lit(TEXT_VALUES[k]).cast("bigint") for k in kinds))
            return node(kind, F.lit(0), value, line)

        return F.transform(words(sentence), leaf)

    def total(nodes: Column) -> Column:
        return F.aggregate(nodes, F.lit(0).cast("bigint"), lambda s, n: s + n["hash_value"])

    def with_root(kind: str, subtrees: Column, line: Column) -> Column:
        """Put a root before an array of non-empty subtrees; the first node of each is its child."""

        def rooted(trees: Column) -> Column:
            children = F.transform(trees, lambda t: t[0])
            root = node(F.lit(kind), F.size(trees), total(children) + TEXT_VALUES[kind], line)
            return F.concat(F.array(root), F.flatten(trees))

        return bind(subtrees, rooted)

    def line_nodes(text_line: Column, number: Column) -> Column:
        bags = F.filter(
            F.transform(
                F.regexp_extract_all(text_line, F.lit(SENTENCE), F.lit(0)),
                lambda s: sentence_nodes(s, number),
            ),
            lambda leaves: F.size(leaves) > 0,
        )
        sentences = F.transform(
            bags, lambda leaves: with_root("sentence", F.transform(leaves, lambda n: F.array(n)), number)
        )
        return with_root("line", sentences, number)

    lines = F.filter(
        F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("text"), (i + 1).alias("number"))),
        lambda x: x["text"].rlike(WORD),
    )
    subtrees = F.transform(lines, lambda x: line_nodes(x["text"], x["number"]))
    tree = with_root("document", subtrees, F.lit(1))
    # A text without words leaves the root alone, without children.
    return F.filter(tree, lambda n: (n["node_type"] != "document") | (n["num_children"] > 0))


def text_tree_nodes(documents: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Node table of prose documents."""
    return documents.select(*key, F.posexplode(text_tree(F.col("text"))).alias("position", "node")).select(
        *key, "position", "node.*"
    )


def tag_tree(pages: DataFrame) -> DataFrame:
    """Elements of marked-up pages: ``doc_id, position, depth, node_type, line_number``.

    ``pages`` has ``doc_id, html``; lines are counted after comments, scripts and
    styles are taken out. An end tag closes the innermost open
    element whatever its name; elements of ``VOID_TAGS`` are leaves and their
    end tags are ignored; what is still open at the end closes there.
    """
    cleaned = F.regexp_replace("html", NOT_ELEMENTS, "")
    found = F.regexp_extract_all(cleaned, F.lit(TAG), F.lit(0))
    # The text before each tag; what follows the last one drops out with its NULL tag.
    both = F.arrays_zip(found.alias("tag"), F.split(cleaned, TAG).alias("before"))
    tags = pages.select("doc_id", F.posexplode(both).alias("seq", "both")).select(
        "doc_id", "seq", "both.tag", "both.before"
    )
    tags = tags.where(F.col("tag").isNotNull())

    def breaks(text: str) -> Column:
        return F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))

    up_to_here = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    line = 1 + F.sum(breaks("before") + breaks("tag")).over(up_to_here) - breaks("tag")
    tags = tags.withColumn("line_number", line.cast("int"))
    name = F.lower(F.regexp_extract("tag", TAG_NAME, 1))
    is_end = F.col("tag").startswith("</")
    is_void = F.col("node_type").isin(*VOID_TAGS) | F.col("tag").endswith("/>")
    kinds = (
        tags.withColumn("node_type", name)
        .withColumn("is_end", is_end)
        .withColumn("is_void", is_void)
        .where(~(F.col("is_end") & F.col("is_void")))
    )
    step = F.when(F.col("is_end"), -1).when(F.col("is_void"), 0).otherwise(1)
    along = Window.partitionBy("doc_id").orderBy("seq")
    depth = F.sum(step).over(along.rowsBetween(Window.unboundedPreceding, 0)) + F.col("is_void").cast("int")
    return (
        kinds.withColumn("depth", depth.cast("int"))
        .where(~F.col("is_end"))
        .select("doc_id", (F.row_number().over(along) - 1).alias("position"), "depth", "node_type", "line_number")
    )


def subtree_hashes(
    tree: DataFrame,
    values: dict[str, int] = NODE_VALUES,
    other: int = OTHER_NODE_VALUE,
    cutting: Sequence[str] = (),
) -> DataFrame:
    """Add ``num_children`` and ``hash_value`` to a tree given by preorder and depth.

    Depth may fall by any amount from row to row but grows by one at most. No
    recursion: a subtree is a run of rows, so its sum is a difference of
    running sums. A tree with a column ``base`` or ``is_cut`` says itself what a node
    counts and whether it cuts; a ``line_number`` is kept. Every node becomes an open event and a close event at its
    level, where it meets its partner, and a child event one level up. All
    windows share the partitioning by document, so there is one shuffle.
    """
    doc = Window.partitionBy("doc_id")
    running = doc.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    own_cuts = "is_cut" in tree.columns
    is_cut = F.col("is_cut") if own_cuts else F.col("node_type").isin(*cutting) if cutting else F.lit(False)
    base = F.col("base").cast("bigint") if "base" in tree.columns else base_value(F.col("node_type"), values, other)
    line = F.col("line_number") if "line_number" in tree.columns else F.lit(None).cast("int")
    rows = tree.select(
        "doc_id",
        "position",
        "depth",
        "node_type",
        base.alias("base"),
        is_cut.alias("is_cut"),
        line.alias("line_number"),
        F.lead("depth").over(doc.orderBy("position")).alias("next_depth"),
        F.min("depth").over(running).alias("top_depth"),
    ).withColumn("total", F.sum("base").over(running))

    def event(kind: str, level: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), level.alias("level"))

    depth, next_depth = F.col("depth"), F.col("next_depth")
    # Levels above every node so far were never opened, so none closes there.
    last_closed = F.greatest(F.coalesce(next_depth, F.col("top_depth")), F.col("top_depth"))
    closed = F.when(last_closed <= depth, F.sequence(depth, last_closed, F.lit(-1))).otherwise(
        F.array().cast("array<int>")
    )
    events = rows.select(
        "*",
        F.posexplode(
            F.concat(
                F.array(event("child", depth - 1), event("open", depth)),
                F.transform(closed, lambda level: event("close", level)),
            )
        ).alias("part", "event"),
    ).select("*", "event.kind", "event.level")
    level = Window.partitionBy("doc_id", "level").orderBy("position", "part")
    level = level.rowsBetween(Window.unboundedPreceding, 0)
    node = F.struct("position", "node_type", "depth", "base", "is_cut", "total", "children_before", "line_number")
    paired = events.withColumn(
        "children_before", F.sum((F.col("kind") == "child").cast("int")).over(level)
    ).withColumn("opened", F.last(F.when(F.col("kind") == "open", node), ignorenulls=True).over(level))
    if cutting or own_cuts:
        paired = _totals_outside_cuts(paired)
    opened = F.col("opened")
    value = F.when(opened["is_cut"], opened["base"]).otherwise(
        F.col("total") - opened["total"] + opened["base"]
    )
    return paired.where(F.col("kind") == "close").select(
        "doc_id",
        opened["position"].alias("position"),
        opened["node_type"].alias("node_type"),
        opened["depth"].alias("depth"),
        (F.col("children_before") - opened["children_before"]).cast("int").alias("num_children"),
        value.alias("hash_value"),
        opened["line_number"].alias("line_number"),
    )


def _totals_outside_cuts(paired: DataFrame) -> DataFrame:
    """Restate ``total`` so that nodes inside a cut do not count for those outside.

    Nodes of one subtree that lie under the same number of cutting ancestors
    as its root are exactly those that count for the root, so the running sum
    is taken per number of enclosing cuts.
    """
    events = Window.partitionBy("doc_id").orderBy("position", "part")
    kind, opened = F.col("kind"), F.col("opened")
    begins = (kind == "open") & F.col("is_cut")
    ends = (kind == "close") & opened["is_cut"]
    step = F.when(begins, 1).when(ends, -1).otherwise(0)
    up_to_here = F.sum(step).over(events.rowsBetween(Window.unboundedPreceding, 0))
    nested = paired.where(kind != "child").withColumn("cuts", up_to_here - begins.cast("int"))
    own = F.when(kind == "open", F.col("base")).otherwise(F.lit(0))
    per_cuts = Window.partitionBy("doc_id", "cuts").orderBy("position", "part")
    summed = nested.withColumn("total", F.sum(own).over(per_cuts.rowsBetween(Window.unboundedPreceding, 0)))
    level = Window.partitionBy("doc_id", "level").orderBy("position", "part")
    again = F.last(F.when(kind == "open", F.col("total")), ignorenulls=True).over(
        level.rowsBetween(Window.unboundedPreceding, 0)
    )
    return summed.withColumn("opened", opened.withField("total", again))


def tag_tree_nodes(pages: DataFrame, cutting: Sequence[str] = ()) -> DataFrame:
    """Node table of marked-up pages (``doc_id, html``)."""
    return subtree_hashes(tag_tree(pages), TAG_VALUES, OTHER_NODE_VALUE, cutting)
