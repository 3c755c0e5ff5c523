"""Trees of source code: a file by hand, scores of edited files, files that do not parse."""

import re

import pyarrow as pa
import pytest

from lookalike.operators import code_runs, code_trees, structure

FILE = """package a.b; // class in a remark {
public class Main extends Base {
  int count = 1;
  /* void lost() { */
  public int twice(int a, List<String> names) {
    if (a < 2) { return call(a, "x } y") - 3 * 4; } else { count += 'c'; }
    for (int i = 0; i < a; i++) { names.add(new Item(i)); }
    return (a + 1);
  }
}
"""

# Position, depth, type, line of every node.
NODES = [
    (0, 0, "CompilationUnit", 1),
    (1, 1, "Statement", 1),
    (2, 1, "ClassDeclaration", 2),
    (3, 2, "VariableDeclaration", 3),
    (4, 3, "Literal", 3),
    (5, 2, "MethodDeclaration", 5),
    (6, 3, "Parameter", 5),
    (7, 3, "Parameter", 5),
    (8, 3, "IfStatement", 6),
    (9, 4, "BinaryOperation", 6),
    (10, 5, "Literal", 6),
    (11, 4, "Statement", 6),
    (12, 5, "FunctionCall", 6),
    (13, 6, "Literal", 6),
    (14, 5, "BinaryOperation", 6),
    (15, 6, "Literal", 6),
    (16, 6, "BinaryOperation", 6),
    (17, 7, "Literal", 6),
    (18, 3, "Assignment", 6),
    (19, 4, "Assignment", 6),
    (20, 5, "Literal", 6),
    (21, 3, "ForStatement", 7),
    (22, 4, "Literal", 7),
    (23, 4, "BinaryOperation", 7),
    (24, 4, "Statement", 7),
    (25, 5, "FunctionCall", 7),
    (26, 6, "FunctionCall", 7),
    (27, 3, "Statement", 8),
    (28, 4, "BinaryOperation", 8),
    (29, 5, "Literal", 8),
]


@pytest.fixture(scope="module")
def nodes_of(spark):
    def build(*texts):
        files = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return files, code_trees.code_tree_nodes(files)

    return build


def test_a_file_by_hand(nodes_of):
    rows = sorted(nodes_of(FILE)[1].collect(), key=lambda r: r.position)
    found = [(r.position, r.depth, r.node_type, r.line_number) for r in rows]
    expected = list(NODES)
    # What follows else is a statement of its own.
    expected[18] = (18, 3, "Statement", 6)
    assert found == expected


def test_hashes_add_up_but_for_cutting_operators(nodes_of):
    rows = {r.position: r for r in nodes_of(FILE)[1].collect()}
    assert rows[16].hash_value == 20 + 10 and rows[14].hash_value == 20
    assert rows[12].hash_value == 20 + 10 and rows[11].hash_value == 5 + 30 + 20
    assert rows[8].hash_value == 40 + 30 + rows[11].hash_value and rows[8].num_children == 2
    assert rows[2].hash_value == 200 + rows[3].hash_value + rows[5].hash_value
    assert rows[0].num_children == 2


def test_files_that_do_not_parse_have_no_nodes(spark, nodes_of):
    bad = ["class A { ", "class A } {", "int f( ] ;", "}", "", None, " \n// only a remark", "x = '(';"]
    files, nodes = nodes_of(*bad, FILE, FILE.replace("twice", "thrice"))
    counts = {r.doc_id: r["count"] for r in nodes.groupBy("doc_id").count().collect()}
    assert counts.keys() == {7, 8, 9} and counts[7] == 3 and counts[8] == counts[9] == len(NODES)
    pairs = spark.createDataFrame([(0, 8), (8, 9), (7, 8), (5, 6)], "doc1 long, doc2 long")
    scored = {(r.doc1, r.doc2): r for r in structure.structural_score(pairs, nodes, files, structure.ALL).collect()}
    assert scored[0, 8].structure_similarity == 0 and scored[5, 6].structure_similarity == 0
    assert scored[8, 9].structure_similarity == 1.0
    assert 0 < scored[7, 8].structure_similarity < 0.5


def test_unended_statements_close_with_their_bracket(nodes_of):
    text = "enum Color { RED, GREEN(1) }\nint[] a = {1, 2};\nrun(x -> { go(x); }, 5);"
    rows = sorted(nodes_of(text)[1].collect(), key=lambda r: r.position)
    assert [(r.depth, r.node_type) for r in rows] == [
        (0, "CompilationUnit"),
        (1, "ClassDeclaration"),
        (2, "Statement"),
        (3, "FunctionCall"),
        (4, "Literal"),
        (1, "VariableDeclaration"),
        (2, "Statement"),
        (3, "Literal"),
        (3, "Literal"),
        (1, "Statement"),
        (2, "FunctionCall"),
        (3, "Statement"),
        (4, "FunctionCall"),
        (3, "Literal"),
    ]


def test_long_strings_and_comments(nodes_of):
    text = 'x = "' + "a\\\\\\\"" * 3_000 + '"; /* ' + "* { " * 20_000 + "*/ y(" + "1, " * 2_000 + "1);"
    rows = nodes_of(text)[1].collect()
    assert len(rows) == 1 + 2 + 2 + 2_001


def test_files_are_shuffled_once_and_no_token_rows_are_sorted(nodes_of):
    plan = nodes_of(FILE, "f(1);")[1]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and plan.count("Exchange") == 1


def test_slices_of_files_give_the_same_nodes(monkeypatch):
    def tokens(text):
        return re.findall(r"\"[^\"]*\"|\w+|[^\s\w]|\n", re.sub(r"//[^\n]*|/\*.*?\*/", "", text))

    files = pa.array([[tokens(FILE)], [], [["}"]], [tokens("f(1);\ng(2);"), tokens("h(3);")], [tokens(FILE)]])
    whole = code_trees._nodes(files)
    assert [len(x) for x in whole[1:4]] == [0, 0, 10] and len(whole[0]) == len(whole[4]) > 20
    for most in (1, 20, 1_000):
        monkeypatch.setattr(code_runs, "SLICE_TOKENS", most)
        assert code_trees._nodes(files).equals(whole)
        assert code_trees._nodes(files[2:]).equals(whole[2:])
