import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lookalike.operators import jobs, structure
from lookalike.operators.pairs import PLACES, pair_slots
from lookalike.operators.tfidf import tfidf_similarity
from lookalike.sources.documents import problem_samples, write_files, write_split_documents


def test_manifest_to_results(spark):
    texts = {
        "c01/original.java": "one two three. four five six", "c01/compared.java": "one two three. four five six",
        "b_a/a.java": "alpha beta gamma", "b_a/b.java": "other words here",
    }
    listing = [(p.split("/")[0], p.split("/")[1], p) for p in texts]
    # Another folder shares a path.
    listing += [("c02", "original.java", "c01/original.java"), ("c02", "compared.java", "b_a/a.java")]
    files = spark.createDataFrame(listing, "folder STRING, file STRING, path STRING")
    documents = spark.createDataFrame(list(texts.items()), "path STRING, text STRING")
    manifest = spark.createDataFrame(
        [
            ("1", "c01", "original.java", "compared.java", 1, "ir_plag"), ("2", "c02", "original.java", "compared.java", 0, "ir_plag"),
            ("3", "a_b", "a.java", "b.java", 0, "conplag"), ("4", "gone", "x", "y", 1, "ir_plag"), ("5", "c01", "a", "b", 1, "other_source"),
        ],
        "pair_id STRING, folder_name STRING, file1 STRING, file2 STRING, label INT, source_dataset STRING",
    )
    found = {r.folder: r for r in jobs.compare_manifest(manifest, files, documents, "all").collect()}
    assert set(found) == {"c01", "c02", "b_a"}
    assert abs(found["c01"].tfidf_similarity - 1) < 1e-12 and found["c01"].structure_similarity == 1.0
    assert found["c01"].both_correct and found["b_a"].tfidf_similarity == 0.0 and found["b_a"].tfidf_correct
    scored = {r.folder: r for r in jobs.score_manifest(manifest, files, documents, leaf_rule="all").collect()}
    assert scored["c01"].structure_score == 1.0 and scored["c01"].prediction == 1
    assert scored["c01"].similar_nodes == 10 and scored["c01"].dataset == "ir_plag"
    training = {r.pair_id: r.text for r in jobs.training_texts(manifest, files, documents).collect()}
    assert training["2"] == "one two three. four five six [SEP] alpha beta gamma" and set(training) == {"1", "2", "3"}


def test_files_from_a_folder(spark, tmp_path):
    code = "class A { int f(int a) { return a - 1; } }"
    rows = [(1, code), (2, code.replace("1", "2")), (3, "class B {"), (4, "int b = 1;")]
    written = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    write_files(written, str(tmp_path / "files"))
    (tmp_path / "files" / "doc=5").mkdir()
    (tmp_path / "files" / "doc=5" / "bad.txt").write_bytes(b"class C { }\xff\xfe")
    files, nodes = jobs.tree_files(spark, str(tmp_path / "files"), "*.txt")
    path = {int(r.path.split("doc=")[1].split("/")[0]): r.path for r in files.collect()}
    assert path.keys() == {1, 2, 3, 4, 5}
    rejects = {r.path: r.problem for r in jobs.file_rejects(files, nodes).collect()}
    assert rejects == {path[3]: "no tree", path[5]: "not UTF-8"}
    pairs = [(path[1], path[2]), (path[1], path[3]), (path[1], path[4]), (path[3], path[5]), (path[1], "gone")]
    scored = jobs.score_files(spark.createDataFrame(pairs, "doc1 STRING, doc2 STRING"), files, nodes, structure.ALL)
    found = {(r.doc1, r.doc2): r.structure_similarity for r in scored.collect()}
    assert found.keys() == set(pairs[:4])
    assert found[pairs[0]] == 1.0 and found[pairs[1]] == found[pairs[3]] == 0.0 and 0 < found[pairs[2]] < 1


def test_stars_of_any_size_are_dealt_in_slots(spark):
    texts = [(i, f"alpha beta w{i % 5} w{i % 7}. gamma w{i % 3}") for i in range(60)]
    documents = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    pairs = [(0, i) for i in range(1, 60)] + [(1, 2), (7, 3), (3, 7), (5, 99), (98, 5)]
    table = spark.createDataFrame(pairs, "doc1 BIGINT, doc2 BIGINT").repartition(3)
    slots = pair_slots(table).collect()
    assert len(slots) == len(pairs) and len({(r.doc1, r.slot, r.place) for r in slots}) == len(pairs)
    assert {r.place for r in slots} == set(range(1, PLACES + 1)) and max(r.slot for r in slots) == 58 // PLACES
    found = {(r.doc1, r.doc2): r.tfidf_similarity for r in tfidf_similarity(table, documents).collect()}
    assert found.keys() == set(pairs[:-2])
    # A pair alone has the score it has among others.
    for pair in ((0, 35), (0, 3), (1, 2), (3, 7)):
        alone = tfidf_similarity(table.where(f"doc1 = {pair[0]} and doc2 = {pair[1]}"), documents).first()
        assert abs(alone.tfidf_similarity - found[pair]) < 1e-12
    assert abs(found[7, 3] - found[3, 7]) < 1e-12 and abs(found[0, 35] - 1) < 0.5


def test_first_bad_folders(spark):
    manifest = spark.createDataFrame([(f"f{i:02}",) for i in range(30)], "folder_name STRING")
    files = spark.createDataFrame([(f"f{i:02}", "a.java") for i in range(0, 30, 2)], "folder STRING, file STRING")
    found = [tuple(r) for r in problem_samples(manifest, files, 3).orderBy("problem", "nth").collect()]
    assert found == [
        ("archivos faltantes", 1, "f00"), ("archivos faltantes", 2, "f02"), ("archivos faltantes", 3, "f04"),
        ("carpeta no existe", 1, "f01"), ("carpeta no existe", 2, "f03"), ("carpeta no existe", 3, "f05"),
    ]


def test_writing_a_split_replaces_only_that_split(spark, tmp_path):
    path = str(tmp_path / "splits")
    first = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "doc_id INT, text STRING, split STRING")
    write_split_documents(first, path)
    write_split_documents(first.selectExpr("doc_id + 10 as doc_id", "text", "split").where("split = 'test'"), path)
    assert sorted((r.doc_id, r.split) for r in spark.read.parquet(path).collect()) == [(1, "train"), (12, "test")]


def test_files_hold_the_bytes_of_their_texts(spark, tmp_path):
    rows = [(1, b"a\nb"), (2, b"c\xff"), (3, None), (4, b"x"), (4, b"x"), (None, b"y")]
    table = spark.createDataFrame(rows, "doc_id BIGINT, bytes BINARY")
    write_files(table.select("doc_id", F.col("bytes").cast("string").alias("text")), str(tmp_path / "files"))
    found = {p.parent.name: p.read_bytes() for p in (tmp_path / "files").glob("*/*.txt")}
    ids = {"1": b"a\nb\n", "2": b"c\xff\n", "3": b"\n", "4": b"x\nx\n", "__HIVE_DEFAULT_PARTITION__": b"y\n"}
    assert found == {f"doc={name}": text for name, text in ids.items()}
    assert not [*(tmp_path / "files").glob("*/.*")]
    with pytest.raises(AnalysisException):
        write_files(table.select("doc_id", F.lit("z").alias("text")), str(tmp_path / "files"))


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    write_files(spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a;").alias("text")), str(tmp_path / "files"))
    files, nodes = jobs.tree_files(spark, str(tmp_path / "files"), "*.txt")
    assert files.count() == 200 and nodes.count() == 400
    assert len(files.inputFiles()) <= spark.sparkContext.defaultParallelism
