import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lookalike.functions.text import normalize, words
from lookalike.operators import structure, trees
from lookalike.operators.tfidf import tfidf_similarity


def test_normalize_order_of_comments(spark):
    texts = {
        1: "a // see http://x\nb",
        2: "keep // no newline",
        3: "a /* x\ny */ b",
        4: "a // open /* \nb */ c",
        5: " \t a\n\n b ",
    }
    df = spark.createDataFrame(list(texts.items()), "id INT, t STRING")
    got = {r.id: r.n for r in df.select("id", normalize(F.col("t")).alias("n")).collect()}
    assert got == {1: "a b", 2: "keep // no newline", 3: "a b", 4: "a b */ c", 5: "a b"}


def test_words_are_unicode(spark):
    df = spark.createDataFrame([("Été_1, ÑU! x",)], "t STRING")
    assert df.select(words(F.col("t")).alias("w")).first().w == ["été_1", "ñu", "x"]


def test_pair_cosine_cases(spark):
    texts = {1: "a b", 2: "a c", 3: "a b", 4: "x y z", 5: "", 6: "?!", 7: "b // gone\n a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING")
    wanted = {
        (1, 2): 1 / (1 + 2 * (1 + math.log(1.5)) ** 2),
        (2, 1): 1 / (1 + 2 * (1 + math.log(1.5)) ** 2),
        (1, 3): 1.0,
        (1, 4): 0.0,
        (1, 5): 0.0,
        (5, 5): 0.0,
        (1, 6): 0.0,
    }
    pairs = spark.createDataFrame([*wanted, (1, 99)], "doc1 BIGINT, doc2 BIGINT")
    got = {(r.doc1, r.doc2): r.tfidf_similarity for r in tfidf_similarity(pairs, docs).collect()}
    assert set(got) == set(wanted)  # the pair with a missing document is left out
    assert all(abs(got[p] - wanted[p]) < 1e-12 for p in wanted)
    assert got[1, 3] == 1.0


def _shape(node_rows):
    return Counter((r[2], r[3]) for r in node_rows)


def test_matches_equal_multiset_intersection(spark):
    rng = random.Random(7)
    rows = [
        (doc, position, rng.choice([0, 0, 1, 2]), rng.randrange(4))
        for doc in range(20)
        for position in range(rng.randrange(0, 12))
    ]
    nodes = spark.createDataFrame(rows, "doc_id BIGINT, position INT, num_children INT, hash_value BIGINT")
    docs = spark.range(20).withColumnRenamed("id", "doc_id")
    all_pairs = [(a, b) for a in range(20) for b in range(20)]
    pairs = spark.createDataFrame(all_pairs, "doc1 BIGINT, doc2 BIGINT")
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
    for rule in (structure.ONCE, structure.ALL):
        scored = structure.structural_score(pairs, nodes, docs, rule).collect()
        listed = structure.matched_pairs(pairs, nodes, rule)
        lists = Counter((r.doc1, r.doc2) for r in listed.collect())
        assert len(scored) == len(all_pairs)
        for r in scored:
            common = _shape(by_doc[r.doc1]) & _shape(by_doc[r.doc2])
            leaves = sum(n for (children, _), n in common.items() if children == 0)
            wanted = sum(common.values()) - (leaves - min(leaves, 1) if rule == structure.ONCE else 0)
            size = len(by_doc[r.doc1]) + len(by_doc[r.doc2])
            empty = not by_doc[r.doc1] or not by_doc[r.doc2]
            assert r.similar_nodes == wanted == lists[r.doc1, r.doc2]
            assert abs(r.structure_similarity - (0 if empty else 2 * wanted / size)) < 1e-12


def test_leaf_match_is_lowest_hash_at_first_positions(spark):
    rows = [(1, 0, 0, 9), (1, 1, 0, 5), (1, 2, 0, 5), (2, 0, 0, 9), (2, 4, 0, 5)]
    nodes = spark.createDataFrame(rows, "doc_id BIGINT, position INT, num_children INT, hash_value BIGINT")
    pairs = spark.createDataFrame([(1, 2)], "doc1 BIGINT, doc2 BIGINT")
    listed = structure.matched_pair_lists(structure.matched_pairs(pairs, nodes)).first().similar_nodes
    assert [tuple(n) for n in listed] == [(0, 5, 1, 4)]


def _walk(nodes, values, cutting):
    """Children and hash of every node of a preorder list of (depth, type)."""
    result = []
    for at, (depth, kind) in enumerate(nodes):
        children = []
        for later in range(at + 1, len(nodes)):
            if nodes[later][0] <= depth:
                break
            if nodes[later][0] == depth + 1:
                children.append(later)
        result.append((kind, children))

    def value(at):
        kind, children = result[at]
        return values[kind] if kind in cutting else values[kind] + sum(value(c) for c in children)

    return [(len(children), value(at)) for at, (_, children) in enumerate(result)]


def test_subtree_hashes_equal_a_tree_walk(spark):
    rng = random.Random(3)
    values = {"a": 1, "b": 10, "cut": 100, "dig": 1000}
    forest = {}
    for doc in range(60):
        depth, nodes = 1, []
        for _ in range(rng.randrange(1, 25)):
            nodes.append((depth, rng.choice(list(values))))
            depth = rng.randint(max(1, depth - 3), depth + 1)
        forest[doc] = nodes
    rows = [(doc, i, d, t) for doc, nodes in forest.items() for i, (d, t) in enumerate(nodes)]
    tree = spark.createDataFrame(rows, "doc_id BIGINT, position INT, depth INT, node_type STRING")
    for cutting in ((), ("cut", "dig")):
        got = trees.subtree_hashes(tree, values, 5, cutting).collect()
        assert len(got) == len(rows)
        wanted = {doc: _walk(nodes, values, cutting) for doc, nodes in forest.items()}
        for r in got:
            assert (r.num_children, r.hash_value) == wanted[r.doc_id][r.position]


def test_end_tags_without_start_do_not_repeat_nodes(spark):
    pages = spark.createDataFrame([(1, "<a></a></x><p>t</p><i><u>"), (2, "no tags")], "doc_id BIGINT, html STRING")
    got = trees.tag_tree_nodes(pages).orderBy("position").collect()
    assert [(r.position, r.node_type, r.num_children) for r in got] == [
        (0, "a", 0), (1, "p", 0), (2, "i", 1), (3, "u", 0),
    ]


def test_text_tree(spark):
    docs = spark.createDataFrame([(1, "Ab c. Longworded!\n\n?!\nmiddle"), (2, "..\n")], "doc_id BIGINT, text STRING")
    got = trees.text_tree_nodes(docs).orderBy("position").collect()
    assert [(r.node_type, r.num_children, r.hash_value, r.line_number) for r in got] == [
        ("document", 2, 605, 1),
        ("line", 2, 240, 1),
        ("sentence", 2, 70, 1),
        ("word_short", 0, 10, 1),
        ("word_short", 0, 10, 1),
        ("sentence", 1, 70, 1),
        ("word_long", 0, 20, 1),
        ("line", 1, 165, 4),
        ("sentence", 1, 65, 4),
        ("word_middle", 0, 15, 4),
    ]
