import pytest
from pyspark.sql import Window, functions as F

from lookalike.operators import compare, metrics, splits
from lookalike.operators.numbering import number_rows, range_bucket, with_even_bucket
from lookalike.plans import tables
from lookalike.sources import corpora, documents as files, manifest as manifests


@pytest.mark.parametrize("group", ["if(id % 10 > 0, 0, id)", "id % 4000", "id"])
def test_star_with_one_hot_group_and_with_thousands(spark, group):
    rows = spark.range(12_000).selectExpr(f"{group} AS g", "id AS doc_id")
    first, expected = {}, set()
    for r in rows.orderBy("doc_id").collect():
        if first.setdefault(r.g, r.doc_id) != r.doc_id:
            expected.add((r.g, first[r.g], r.doc_id))
    assert {tuple(r) for r in tables.star(rows, "g").collect()} == expected


def test_number_rows_equals_a_window(spark):
    df = spark.range(500).select(F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"), (F.col("id") * 37 % 1009).alias("v"))
    got = number_rows(df, ["g"], range_bucket(F.col("v"), 50), [F.col("v")], "n", "size")
    w = Window.partitionBy("g")
    wanted = df.select("*", F.row_number().over(w.orderBy("v")).alias("n"), F.count("*").over(w).alias("size"))
    want = sorted(map(repr, map(tuple, wanted.collect())))
    assert sorted(map(repr, map(tuple, got.collect()))) == want
    wide = range_bucket(F.col("v"), 300)
    got = number_rows(df, ["g"], range_bucket(F.col("v"), 50), [F.col("v")], "n", "size", coarse=wide)
    assert sorted(map(repr, map(tuple, got.collect()))) == want


@pytest.mark.parametrize("value", ["id", "id * 1000003", "xxhash64(id)", "id % 5"])
def test_even_buckets_number_any_values(spark, value):
    df = spark.range(3000).selectExpr("if(id % 11 > 0, if(id % 3 > 0, 1, 2), null) AS g", f"{value} AS v", "id")
    placed = with_even_bucket(df, ["g"], "v")
    got = number_rows(placed, ["g"], F.col("_even"), [F.col("v"), F.col("id")], "n").drop("_even")
    wanted = df.select("*", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).alias("n"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
    if value != "id % 5":
        assert placed.where("g = 1").groupBy("_even").count().agg(F.max("count")).first()[0] < 60


def test_split_sizes_use_float_floor(spark):
    df = spark.range(90).select("id", F.lit("s").alias("source_dataset"), F.lit(1).alias("label"))
    split = splits.stratified_split(df, ["id"], ["source_dataset", "label"])
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"train": 62, "validation": 9, "test": 19}
    assert split.select("id").distinct().count() == 90
    with pytest.raises(ValueError):
        splits.check_ratios(0.7, 0.1, 0.1)


def _predictions(spark, tp, fp, fn, tn):
    rows = [(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn + [(0, 0)] * tn
    return spark.createDataFrame(rows, "label INT, prediction INT")


def test_report_of_published_counts(spark):
    report = metrics.class_report(_predictions(spark, 102, 11, 21, 144)).collect()
    got = {r["class"]: r for r in report}
    one, zero = got["Plagio"], got["No Plagio"]
    assert [round(one[c], 4) for c in ("precision", "recall", "f1")] == [0.9027, 0.8293, 0.8644]
    assert [round(zero[c], 4) for c in ("precision", "recall", "f1")] == [0.8727, 0.9290, 0.9000]
    assert (one.support, zero.support) == (123, 155)
    assert abs(got["accuracy"].f1 - 0.8848920863309353) < 1e-12


def test_metrics_of_one_class(spark):
    df = spark.createDataFrame([(0, 0, 0.2), (0, 0, 0.9)], "label INT, prediction INT, score DOUBLE")
    assert metrics.roc_auc(df).first().auc is None
    scored = metrics.with_scores(metrics.confusion_counts(df)).first()
    assert (scored.precision, scored.recall, scored.f1, scored.accuracy) == (0.0, 0.0, 0.0, 1.0)
    assert metrics.score_stats(df.limit(1).withColumn("source_dataset", F.lit("x")), "score").first()["std"] is None


def test_auc_and_curve_against_pair_counting(spark):
    rows = [((i * 7) % 3 % 2, ((i * 13) % 17) / 17) for i in range(120)]
    df = spark.createDataFrame(rows, "label INT, score DOUBLE")
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wanted = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(metrics.roc_auc(df).first().auc - wanted) < 1e-12
    full = metrics.roc_curve(df, drop_collinear=False).orderBy(F.desc("threshold")).collect()
    assert len(full) == 18 and (full[0].fpr, full[0].tpr) == (0.0, 0.0) and (full[-1].fpr, full[-1].tpr) == (1.0, 1.0)
    for r in full[1:]:
        assert abs(r.tpr - sum(s >= r.threshold for s in pos) / len(pos)) < 1e-12
        assert abs(r.fpr - sum(s >= r.threshold for s in neg) / len(neg)) < 1e-12
    for points in (full, metrics.roc_curve(df).orderBy(F.desc("threshold")).collect()):
        area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(points, points[1:]))
        assert abs(area - wanted) < 1e-12


def test_auc_and_curve_per_group(spark):
    rows = [("a" if i % 4 else None, (i * 7) % 3 % 2, ((i * 13) % 17) / 17) for i in range(120)]
    rows += [("one class", 1, 0.3), ("one class", 1, 0.3)]
    df = spark.createDataFrame(rows, "source STRING, label INT, score DOUBLE")
    found = {r.source: r for r in metrics.roc_auc(df, by=["source"]).collect()}
    points = metrics.roc_curve(df, by=["source"], drop_collinear=False).orderBy(F.desc("threshold")).collect()
    assert found.keys() == {"a", None, "one class"}
    assert found["one class"].auc is None and found["one class"].positives == 2
    for source in ("a", None):
        pos = [s for g, y, s in rows if g == source and y == 1]
        neg = [s for g, y, s in rows if g == source and y == 0]
        wanted = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        assert abs(found[source].auc - wanted) < 1e-12
        own = [r for r in points if r.source == source]
        area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(own, own[1:]))
        assert abs(area - wanted) < 1e-12 and len(own) == len({*pos, *neg}) + 1


def test_decisions_and_weights(spark):
    rows = [(1, 2, 1, 0.45, 0.2), (1, 3, 0, 0.44, 0.9), (1, 4, 1, 0.1, 0.1)]
    df = spark.createDataFrame(
        rows, "doc1 INT, doc2 INT, label INT, tfidf_similarity DOUBLE, structure_similarity DOUBLE"
    )
    flags = [(r.both_correct, r.both_wrong) for r in compare.with_decisions(df).orderBy("doc2").collect()]
    assert flags == [(False, False), (False, False), (False, True)]
    grid = compare.hybrid_grid(df)
    assert grid.count() == 11
    assert compare.best_weight(grid).first().weight == 1.0


def test_weights_of_three_scores(spark):
    rows = [(1, 0.9, 0.1, 0.2), (0, 0.5, 0.4, 0.1), (1, 0.2, 0.3, 0.9), (0, 0.1, 0.6, 0.2)]
    df = spark.createDataFrame(rows, "label INT, a DOUBLE, b DOUBLE, c DOUBLE")
    grid = {(r.w_a, r.w_b, r.w_c): r for r in compare.weighted_grid(df, ["a", "b", "c"], 0.45, 4).collect()}
    assert len(grid) == 15 and all(sum(point) == 4 for point in grid)
    for (a, b, c), r in grid.items():
        marked = [(y, (a * x[0] + b * x[1] + c * x[2]) / 4 >= 0.45) for y, *x in rows]
        assert (r.tp, r.fp) == (marked.count((1, True)), marked.count((0, True)))
        assert (r.tn, r.fn) == (marked.count((0, False)), marked.count((1, False)))
    assert compare.simplex(1, 3) == [(3,)]


def test_resolve_pairs(spark):
    listing = [
        ("c01_orig_np01", "original.java"), ("c01_orig_np01", "compared.java"),
        ("b_a", "a.java"), ("b_a", "b.java"), ("x_y", "x.java"), ("x_y", "y.java"), ("y_x", "x.java"), ("y_x", "y.java"),
        ("one", "only.java"), ("free", "z.java"), ("free", "k.java"), ("free", "q.txt"), ("free", "m.java"),
    ]
    found = spark.createDataFrame([(a, b, f"{a}/{b}") for a, b in listing], "folder STRING, file STRING, path STRING")
    asked = spark.createDataFrame(
        [
            ("1", "c01_orig_np01", "o", "c", "ir_plag"), ("2", "a_b", "a.java", "b.java", "conplag"),
            ("3", "x_y", "x.java", "y.java", "conplag"), ("4", "one", "a", "b", "other"),
            ("5", "free", None, None, "other"), ("6", "gone", "a", "b", "ir_plag"), ("7", "p_q", "p.java", "q.java", "conplag"),
        ],
        "pair_id STRING, folder_name STRING, file1 STRING, file2 STRING, source_dataset STRING",
    )
    got = {r.pair_id: (r.path1, r.path2) for r in files.resolve_pairs(asked, found).collect()}
    assert got == {
        "1": ("c01_orig_np01/original.java", "c01_orig_np01/compared.java"),
        "2": ("b_a/a.java", "b_a/b.java"),
        "3": ("x_y/x.java", "x_y/y.java"),
        "5": ("free/k.java", "free/m.java"),
    }
    problems = {r.folder_name: r.problem for r in files.problem_pairs(asked, found).collect()}
    assert problems["one"] == "archivos faltantes" and problems["gone"] == "carpeta no existe"
    assert files.usable_pairs(asked, found).count() == 3


def test_labels_last_row_wins_and_order_counts(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("sub1,sub2,problem,verdict\n1e5,22,3,0\naa,bb,4,1\n1e5,22,3,1\n")
    labels = manifests.read_labels(spark, str(tmp_path / "labels.csv"))
    folders = [("1e5_22", "1e5.java"), ("1e5_22", "22.java"), ("bb_aa", "aa.java"), ("bb_aa", "bb.java"), ("plain", "x.java")]
    found = spark.createDataFrame([(a, b, f"{a}/{b}") for a, b in folders], "folder STRING, file STRING, path STRING")
    rows = corpora.contest_pairs(found, labels).collect()
    assert [(r.folder_name, r.label, r.case_id, r.plagiarism_level) for r in rows] == [("1e5_22", 1, "p03", "contest_level")]
    missing = corpora.unlabelled_folders(corpora.contest_folders(found), labels).collect()
    assert [r.folder_name for r in missing] == ["bb_aa"]


def test_graded_corpus_to_manifest(spark, tmp_path):
    paths = [
        "case-07/Original/T.java", "case-07/non-plagiarized/10/A.java", "case-07/non-plagiarized/2/A.java",
        "case-07/non-plagiarized/2/B.java", "case-07/non-plagiarized/old/A.java", "case-07/plagiarized/L3/5/A.java",
        "case-07/plagiarized/L9/5/A.java", "case-08/plagiarized/L1/1/A.java", "case-07/non-plagiarized/3/note.txt",
    ]
    pairs = corpora.graded_pairs(spark.createDataFrame([(p,) for p in paths], "path STRING"))
    unified = corpora.unify(pairs, extra=["path2"])
    assert [(r.pair_id, r.folder_name, r.label, r.comparison_type, r.path2) for r in unified.orderBy("pair_id").collect()] == [
        ("pair_000001", "c07_orig_np01", 0, "original_vs_nonplagiarized", "case-07/non-plagiarized/2/A.java"),
        ("pair_000002", "c07_orig_np02", 0, "original_vs_nonplagiarized", "case-07/non-plagiarized/10/A.java"),
        ("pair_000003", "c07_orig_L3v01", 1, "original_vs_l3", "case-07/plagiarized/L3/5/A.java"),
    ]
    path = str(tmp_path / "manifest")
    manifests.write_csv(unified.drop("path2"), path)
    back = manifests.known_sources(manifests.read_manifest(spark, path))
    assert back.schema == manifests.MANIFEST_SCHEMA and back.count() == 3


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "m.csv").write_text("folder_name,pair_id,label\nf1,p1,1\n")
    manifest = manifests.read_manifest(spark, str(tmp_path / "m.csv"))
    assert manifest.columns == ["pair_id", "folder_name", "label"]
    assert [tuple(r) for r in manifest.collect()] == [("p1", "f1", 1)]
    assert manifests.known_sources(manifest).count() == 1
    (tmp_path / "l.csv").write_text("problem,verdict,sub1,sub2\n19,1,a,b\n")
    assert manifests.read_labels(spark, str(tmp_path / "l.csv")).first()[:4] == ("a", "b", 19, 1)
    (tmp_path / "bad.csv").write_text("folder_name,label\nf1,1\n")
    with pytest.raises(ValueError, match="pair_id"):
        manifests.read_manifest(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "p.csv").write_text("Probability,TrueLabel,Predicted\n0.25,1,0\n")
    assert [tuple(r) for r in manifests.read_predictions(spark, str(tmp_path / "p.csv")).collect()] == [(1, 0, 0.25)]


def test_large_version_numbers(spark):
    big = str(2**41)
    paths = [
        "case-01/Original/T.java", f"case-01/plagiarized/L1/{big}/A.java", "case-01/plagiarized/L2/3/A.java",
        f"case-01/plagiarized/L1/{10**21}/A.java", "case-01/plagiarized/L1/7/A.java",
    ]
    files_ = spark.createDataFrame([(p,) for p in paths], "path STRING")
    unified = corpora.unify(corpora.graded_pairs(files_)).orderBy("pair_id")
    assert [r.folder_name for r in unified.collect()] == ["c01_orig_L1v01", "c01_orig_L1v02", "c01_orig_L2v01"]
    assert [r.path for r in corpora.unnumbered_versions(files_).collect()] == [paths[3]]


@pytest.mark.parametrize("scale, shift", [(1e-5, 0.5), (2e6, -1e6), (1.0, 0.0)])
def test_roc_of_crowded_and_of_wide_scores(spark, scale, shift):
    rows = [(int(i * 31 % 7 < 3), (i * 137 % 1009) / 1009 * scale + shift) for i in range(2000)]
    df = spark.createDataFrame(rows, "label INT, score DOUBLE")
    scores = sorted({s for _, s in rows})
    at = {s: i for i, s in enumerate(scores)}
    pos, neg = [0] * len(scores), [0] * len(scores)
    for y, s in rows:
        (pos if y else neg)[at[s]] += 1
    below, wanted = 0, 0.0
    for p, n in zip(pos, neg):
        wanted += p * (below + n / 2)
        below += n
    assert abs(metrics.roc_auc(df).first().auc - wanted / sum(pos) / sum(neg)) < 1e-12
    assert metrics.roc_curve(df, drop_collinear=False).count() == len(scores) + 1


def test_read_documents_drops_bad_bytes(spark, tmp_path):
    folder = tmp_path / "a_b"
    folder.mkdir()
    (folder / "a.java").write_bytes("é ok".encode())
    (folder / "b.java").write_bytes(b"x\xffy")
    (folder / "c.txt").write_bytes(b"no")
    (folder / "d.java").write_bytes("a\ufffdb\x01a\x01".encode() + b"\xff\xc3")
    got = {r.file: (r.folder, r.text) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.java": ("a_b", "é ok"), "b.java": ("a_b", "xy"), "d.java": ("a_b", "a\ufffdb\x01a\x01")}
    strict = files.read_documents(spark, str(tmp_path), strict=True)
    assert sorted(r.file for r in files.unreadable(strict).collect()) == ["b.java", "d.java"]
