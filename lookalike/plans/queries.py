"""One query per operator, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lookalike.functions.text import normalize, pair_text, words
from lookalike.operators import candidates, code_trees, compare, jobs, metrics, splits, structure, trees
from lookalike.operators.classify import PairClassifier, corpus_tfidf, cross_fitted, summary_of_splits
from lookalike.operators.gram_blocks import BUCKET_TEXT_BYTES, gram_frequencies
from lookalike.operators.pairs import PAIR, pair_texts
from lookalike.operators.parts import parts_for
from lookalike.operators.tfidf import TFIDF_THRESHOLD, gram_counts, tfidf_similarity
from lookalike.plans import tables
from lookalike.sources import corpora, documents as files, manifest as manifests
from lookalike.sources.scratch import scratch_path, written

DIGITS = 6
#: Digits of what an iterative solver yields.
MODEL_DIGITS = 4
#: So tight that those digits of a probability do not depend on the passes.
MODEL_TOLERANCE = 1e-10
#: Coefficients vary more for the same probabilities: they need more passes and give a digit less.
COEFFICIENT_DIGITS, COEFFICIENT_TOLERANCE = 3, 1e-12
#: The scores of the three-way hybrid and the names of their weights.
THREE_WAY = {"tfidf_similarity": "tfidf", "structure_similarity": "structure", "probability": "classifier"}
MANIFEST_KEY = ["source_dataset", "doc1", "doc2"]
ODD_TAGS = "\n<my-tag><x:y\na='1'></X:Y>\n\n<h1 /></my-tag>"


def rounded(name: str) -> Column:
    return F.round(name, DIGITS).alias(name)


class Inputs:
    """The given tables of one directory, each opened when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def documents(self) -> DataFrame:
        return tables.table(self.spark, self.sf_dir, "documents")

    @cached_property
    def keys(self) -> DataFrame:
        """Ids, sources and longest lines, written once, so that pair lists read no text again."""
        return written(tables.document_keys(self.documents), "document-keys")

    @cached_property
    def labels(self) -> DataFrame:
        return tables.table(self.spark, self.sf_dir, "labels")

    @cached_property
    def benchmark(self) -> DataFrame:
        return tables.table(self.spark, self.sf_dir, "benchmark")

    @cached_property
    def pages(self) -> DataFrame:
        return tables.table(self.spark, self.sf_dir, "pages")

    @cached_property
    def html(self) -> DataFrame:
        """Pages with a few elements of unusual names at their end."""
        return self.pages.select(F.col("page_id").alias("doc_id"), F.concat("html", F.lit(ODD_TAGS)).alias("html"))

    @cached_property
    def code(self) -> DataFrame:
        """The documents as source code, written once, because it is read for its size as well."""
        return written(tables.code_texts(self.documents), "code-texts")

    def labelled(self) -> DataFrame:
        return tables.labelled_pairs(self.keys, self.labels)

    def scored(self, leaf_rule: str = structure.ALL) -> DataFrame:
        """Labelled pairs with both similarities; trees of prose consist mostly of leaves."""
        labelled = self.labelled()
        scores = compare.score_both(labelled.select(*PAIR).distinct(), self.documents, leaf_rule)
        return labelled.join(scores, PAIR)

    def tfidf_scored(self) -> DataFrame:
        """Labelled pairs with ``score`` and ``prediction`` of the TF-IDF method."""
        labelled = self.labelled()
        scores = tfidf_similarity(labelled.select(*PAIR).distinct(), self.documents)
        decided = scores.select(
            *PAIR,
            F.round("tfidf_similarity", DIGITS).alias("score"),
            compare.decide(F.col("tfidf_similarity"), TFIDF_THRESHOLD).alias("prediction"),
        )
        return labelled.join(decided, PAIR)

    def listing(self) -> DataFrame:
        """Every file of the unified corpus after renaming: ``folder, file, path, doc_id``."""
        contest = tables.contest_listing(self.keys)
        raw = tables.graded_listing(self.keys, self.labels)
        graded = corpora.graded_pairs(raw)
        ends = F.array(
            F.struct(F.lit("original.java").alias("file"), F.col("path1").alias("path")),
            F.struct(F.lit("compared.java").alias("file"), F.col("path2").alias("path")),
        )
        placed = graded.select(F.col("folder_name").alias("folder"), F.inline(ends))
        return placed.unionByName(contest.select("folder", "file", "path"))

    def file_texts(self) -> DataFrame:
        """``path, text`` of the files in the raw corpora."""
        contest = tables.contest_listing(self.keys).select("path", "doc_id")
        graded = tables.graded_listing(self.keys, self.labels)
        owners = contest.unionByName(graded)
        return owners.join(self.documents.select("doc_id", "text"), "doc_id").select("path", "text")

    def unified(self, *extra: str) -> DataFrame:
        graded = corpora.graded_pairs(tables.graded_listing(self.keys, self.labels))
        contest = corpora.contest_pairs(
            tables.contest_listing(self.keys), tables.contest_labels(self.keys, self.labels)
        )
        return corpora.unify(graded, contest, extra=extra)

    def split(self) -> DataFrame:
        return splits.stratified_split(self.labelled(), MANIFEST_KEY, ["source_dataset", "label"])


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[build.__name__] = build
    return build


# --- text ------------------------------------------------------------------------


@query
def normalize_text(t: Inputs) -> DataFrame:
    """Comments and all sorts of white space are appended, because the raw pages hold none."""
    remarks = "\n// drop http://x.y\nkeep /* a\nb */ tail /* open // end\nlast // stays"
    remarks += " a\u00a0b\u2003 c\u2028\x1d\u3000d\u200be\x0b\x85"
    text = normalize(F.concat("html", F.lit(remarks)))
    return t.pages.select("page_id", text.alias("normalized"))


@query
def tokenize_counts(t: Inputs) -> DataFrame:
    tokens = words(F.col("text"))
    return t.documents.select(
        "doc_id",
        F.size(tokens).cast("bigint").alias("words"),
        F.size(F.array_distinct(tokens)).cast("bigint").alias("distinct_words"),
    )


@query
def ngram_tf(t: Inputs) -> DataFrame:
    return gram_counts(t.documents, ["doc_id"], F.col("text"))


@query
def ngram_df(t: Inputs) -> DataFrame:
    """Corpus and document frequency of every n-gram."""
    tf = gram_counts(t.documents, ["doc_id"], F.col("text"))
    return gram_frequencies(tf, parts_for(t.documents, F.octet_length("text"), BUCKET_TEXT_BYTES))


# --- corpora and manifests ----------------------------------------------------------


@query
def version_numbers(t: Inputs) -> DataFrame:
    raw = tables.graded_listing(t.keys, t.labels)
    return corpora.number_versions(corpora.graded_versions(raw)).select(
        "case_orig", "level", "version", F.col("version_number").cast("bigint").alias("version_number"), "path"
    )


@query
def label_lookup(t: Inputs) -> DataFrame:
    folders = corpora.contest_folders(tables.contest_listing(t.keys))
    labels = tables.contest_labels(t.keys, t.labels)
    return corpora.label_contest_folders(folders, labels).select("folder_name", "problem", "verdict")


@query
def label_missing(t: Inputs) -> DataFrame:
    folders = corpora.contest_folders(tables.contest_listing(t.keys))
    return corpora.unlabelled_folders(folders, tables.contest_labels(t.keys, t.labels))


@query
def union_manifest(t: Inputs) -> DataFrame:
    return t.unified().drop("pair_id")


@query
def pair_ids(t: Inputs) -> DataFrame:
    return t.unified().select("pair_id", "folder_name")


@query
def pair_resolve(t: Inputs) -> DataFrame:
    """File names of contest pairs are put in order, so half of the folders are reversed."""
    names = [F.least("file1", "file2").alias("file1"), F.greatest("file1", "file2").alias("file2")]
    contest = F.col("source_dataset") == "conplag"
    unified = t.unified()
    kept = ["pair_id", "folder_name", "source_dataset"]
    asked = unified.where(contest).select(*kept, *names).unionByName(
        unified.where(~contest).select(*kept, "file1", "file2")
    )
    return files.resolve_pairs(asked, t.listing()).select("folder_name", "folder", "path1", "path2")


@query
def pair_verify(t: Inputs) -> DataFrame:
    """Against the contest files of labelled documents, so folders and files are missing."""
    present = tables.contest_listing(t.keys).join(t.labels, "doc_id", "left_semi")
    return files.verify_folders(t.unified(), present).select("folder_name", "problem")


@query
def source_counts(t: Inputs) -> DataFrame:
    return corpora.source_counts(t.unified(), t.listing())


@query
def manifest_profile(t: Inputs) -> DataFrame:
    return splits.manifest_profile(t.labelled())


@query
def manifest_csv_roundtrip(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "manifest")
    manifests.write_csv(t.unified(), path)
    return manifests.known_sources(manifests.read_manifest(t.spark, path)).drop("pair_id")


# --- splits ---------------------------------------------------------------------------


@query
def seeded_shuffle(t: Inputs) -> DataFrame:
    ranked = splits.seeded_shuffle(t.labelled(), MANIFEST_KEY)
    return ranked.select(*MANIFEST_KEY, F.col("shuffle_rank").cast("bigint").alias("shuffle_rank"))


@query
def stratified_split(t: Inputs) -> DataFrame:
    return t.split().select(*MANIFEST_KEY, "label", "split")


@query
def split_order(t: Inputs) -> DataFrame:
    ordered = splits.shuffle_within_splits(t.split(), MANIFEST_KEY)
    return ordered.select(*MANIFEST_KEY, "split", F.col("row_in_split").cast("bigint").alias("row_in_split"))


@query
def simple_split(t: Inputs) -> DataFrame:
    return splits.simple_split(t.labelled(), MANIFEST_KEY).select(*MANIFEST_KEY, "split")


@query
def split_profile(t: Inputs) -> DataFrame:
    return splits.split_profile(t.split())


@query
def split_levels(t: Inputs) -> DataFrame:
    return splits.split_levels(t.split())


@query
def split_shares(t: Inputs) -> DataFrame:
    return splits.split_shares(t.split())


@query
def split_partitioned_write(t: Inputs) -> DataFrame:
    """Documents of every split below its own directory, read back."""
    path = scratch_path(t.spark, "splits")
    ends = t.split().select("split", F.explode(F.array("doc1", "doc2")).alias("doc_id")).distinct()
    files.write_split_documents(t.documents.join(ends, "doc_id"), path)
    written = t.spark.read.parquet(path)
    return written.select("split", "doc_id", F.length("text").cast("bigint").alias("length"))


# --- scoring --------------------------------------------------------------------------


@query
def tfidf_pair_similarity(t: Inputs) -> DataFrame:
    scores = tfidf_similarity(tables.all_pairs(t.keys), t.documents)
    return scores.select(*PAIR, rounded("tfidf_similarity"))


@query
def tfidf_pair_decision(t: Inputs) -> DataFrame:
    scores = tfidf_similarity(tables.all_pairs(t.keys), t.documents)
    return scores.select(
        *PAIR, compare.decide(F.col("tfidf_similarity"), TFIDF_THRESHOLD).alias("tfidf_prediction")
    )


@query
def text_classes(t: Inputs) -> DataFrame:
    return candidates.text_classes(t.documents)


@query
def similar_documents(t: Inputs) -> DataFrame:
    """All pairs of different texts that are near copies, found without a pair list."""
    return candidates.similar_texts(t.documents).select(*PAIR, rounded("tfidf_similarity"))


@query
def benchmark_matches(t: Inputs) -> DataFrame:
    """All documents that reach the decision threshold for a benchmark item."""
    found = candidates.similar_to_items(t.benchmark, t.documents)
    return found.select("item_id", "doc_id", rounded("tfidf_similarity"))


@query
def text_tree_nodes(t: Inputs) -> DataFrame:
    return trees.text_tree_nodes(t.documents.select("doc_id", "text").repartition("doc_id"))


@query
def code_tree_nodes(t: Inputs) -> DataFrame:
    """Trees of source code; every fiftieth file has a bracket too many and no nodes."""
    return code_trees.code_tree_nodes(t.code)


@query
def code_structural_score(t: Inputs) -> DataFrame:
    """Pairs of source files by their trees, files without nodes included."""
    scored = structure.structural_score(tables.all_pairs(t.keys), code_trees.code_tree_nodes(t.code), t.code)
    return scored.select(*PAIR, "similar_nodes", "nodes1", "nodes2", rounded("structure_similarity"))


@query
def tag_tree_nodes(t: Inputs) -> DataFrame:
    return trees.tag_tree_nodes(t.html)


@query
def tag_tree_cut(t: Inputs) -> DataFrame:
    """The same trees with lists as cutting type."""
    nodes = trees.tag_tree_nodes(t.html, cutting=["ul"])
    return nodes.select("doc_id", "position", "hash_value")


@query
def tag_tree_cut_some(t: Inputs) -> DataFrame:
    """The same trees, cut at some nodes of a type only: lists at even depths."""
    tree = trees.tag_tree(t.html)
    some = tree.withColumn("is_cut", (F.col("node_type") == "ul") & (F.col("depth") % 2 == 0))
    nodes = trees.subtree_hashes(some, trees.TAG_VALUES)
    return nodes.select("doc_id", "position", "hash_value")


def _page_matches(t: Inputs, leaf_rule: str = structure.ONCE) -> DataFrame:
    return structure.structural_score(
        tables.host_pairs(t.pages), trees.tag_tree_nodes(t.html), t.html, leaf_rule
    )


@query
def structural_match_count(t: Inputs) -> DataFrame:
    return _page_matches(t).select(*PAIR, "similar_nodes", "nodes1", "nodes2")


@query
def structural_match_pairs(t: Inputs) -> DataFrame:
    return structure.matched_pairs(tables.host_pairs(t.pages), trees.tag_tree_nodes(t.html))


@query
def structural_match_lists(t: Inputs) -> DataFrame:
    """One row per pair with its matched nodes; the list as its length and a digest of its text."""
    matches = structure.matched_pairs(tables.host_pairs(t.pages), trees.tag_tree_nodes(t.html))
    lists = structure.matched_pair_lists(matches)

    def item(node: Column) -> Column:
        fields = ("num_children", "hash_value", "position1", "position2")
        return F.concat_ws(":", *(node[c].cast("string") for c in fields))

    as_text = F.array_join(F.transform("similar_nodes", item), ",")
    return lists.select(*PAIR, F.size("similar_nodes").cast("bigint").alias("nodes"), F.md5(as_text).alias("digest"))


@query
def structural_score(t: Inputs) -> DataFrame:
    scored = _page_matches(t)
    return scored.select(
        *PAIR,
        rounded("structure_similarity"),
        compare.decide(F.col("structure_similarity"), structure.STRUCTURE_THRESHOLD).alias("prediction"),
    )


@query
def structural_score_all_leaves(t: Inputs) -> DataFrame:
    return _page_matches(t, structure.ALL).select(*PAIR, rounded("structure_similarity"))


@query
def text_structural_score(t: Inputs) -> DataFrame:
    scored = structure.text_structural_score(tables.all_pairs(t.keys), t.documents)
    return scored.select(*PAIR, "similar_nodes", rounded("structure_similarity"))


# --- comparison and metrics -------------------------------------------------------------


def _compared(t: Inputs, leaf_rule: str) -> DataFrame:
    compared = compare.with_decisions(t.scored(leaf_rule))
    flags = ["tfidf_correct", "structure_correct", "both_correct", "both_wrong"]
    return compared.select(
        *MANIFEST_KEY,
        "label",
        rounded("tfidf_similarity"),
        rounded("structure_similarity"),
        "tfidf_prediction",
        "structure_prediction",
        *flags,
    )


@query
def compare_methods(t: Inputs) -> DataFrame:
    return _compared(t, structure.ALL)


@query
def compare_methods_once(t: Inputs) -> DataFrame:
    """Under the default rule, by which leaves match once."""
    return _compared(t, structure.ONCE)


@query
def manifest_scores(t: Inputs) -> DataFrame:
    """Manifest, files, scores and decisions in one go."""
    scored = jobs.score_manifest(t.unified(), t.listing(), t.file_texts())
    return scored.withColumn("structure_score", F.round("structure_score", DIGITS))


@query
def manifest_compare(t: Inputs) -> DataFrame:
    compared = jobs.compare_manifest(t.unified(), t.listing(), t.file_texts())
    return compared.withColumns({c: F.round(c, DIGITS) for c in ("tfidf_similarity", "structure_similarity")})


@query
def training_texts(t: Inputs) -> DataFrame:
    """The classifier's texts of the unified manifest, as their length and digest."""
    made = jobs.training_texts(t.unified(), t.listing(), t.file_texts())
    return made.select("pair_id", "label", F.length("text").cast("bigint").alias("length"), F.md5("text").alias("digest"))


@query
def problem_samples(t: Inputs) -> DataFrame:
    """The first ten folders, by name, that cannot be used, for each reason."""
    present = tables.contest_listing(t.keys).join(t.labels, "doc_id", "left_semi")
    return files.problem_samples(t.unified(), present)


def _tree_files(t: Inputs) -> tuple[DataFrame, DataFrame]:
    """Source files of all documents, written and read back; some end in a byte that is no UTF-8."""
    every, at = tables.BROKEN_BYTES
    bad = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))).cast("string")
    made = tables.code_texts(t.documents)
    made = made.select("doc_id", F.when(F.pmod("doc_id", F.lit(every)) == at, bad).otherwise(F.col("text")).alias("text"))
    root = scratch_path(t.spark, "files")
    files.write_files(made, root)
    return jobs.tree_files(t.spark, root, "*.txt")


def _document_of(path: str) -> Column:
    return F.regexp_extract(path, r"/doc=(\d+)/", 1).cast("bigint")


@query
def file_scores(t: Inputs) -> DataFrame:
    """From a folder of source files to the scores of their pairs."""
    read, nodes = _tree_files(t)
    paths = read.select(_document_of("path").alias("doc"), "path")
    pairs = tables.all_pairs(t.keys)
    for side in PAIR:
        pairs = pairs.join(paths.select(F.col("doc").alias(side), F.col("path").alias(f"{side}_path")), side)
    pairs = pairs.select(*(F.col(f"{side}_path").alias(side) for side in PAIR))
    scored = jobs.score_files(pairs, read, nodes)
    named = (_document_of(side).alias(side) for side in PAIR)
    return scored.select(*named, "similar_nodes", "nodes1", "nodes2", rounded("structure_similarity"))


@query
def file_rejects(t: Inputs) -> DataFrame:
    return jobs.file_rejects(*_tree_files(t)).select(_document_of("path").alias("doc_id"), "problem")


@query
def predictions_roundtrip(t: Inputs) -> DataFrame:
    """Prediction rows written as CSV and read back by name."""
    scored = t.tfidf_scored().select(
        F.col("score").alias("Probability"), F.col("label").alias("TrueLabel"), F.col("prediction").alias("Predicted")
    )
    path = scratch_path(t.spark, "predictions")
    manifests.write_csv(scored, path)
    return manifests.read_predictions(t.spark, path)


@query
def agreement(t: Inputs) -> DataFrame:
    row = compare.agreement(compare.with_decisions(t.scored()))
    shares = {"tfidf_accuracy", "structure_accuracy", "both_correct_share", "both_wrong_share"}
    return row.select(*(rounded(c) if c in shares else c for c in row.columns))


@query
def hybrid_weights(t: Inputs) -> DataFrame:
    grid = compare.hybrid_grid(t.scored())
    ratios = ["precision", "recall", "f1", "accuracy"]
    return grid.select("weight", "tp", "tn", "fp", "fn", *(rounded(c) for c in ratios))


@query
def hybrid_best(t: Inputs) -> DataFrame:
    grid = compare.hybrid_grid(t.scored()).withColumn("f1", F.round("f1", DIGITS))
    return compare.best_weight(grid)


@query
def score_stats(t: Inputs) -> DataFrame:
    return metrics.score_stats(t.tfidf_scored(), "score")


@query
def label_means(t: Inputs) -> DataFrame:
    return metrics.label_means(t.tfidf_scored(), "score")


@query
def confusion(t: Inputs) -> DataFrame:
    return metrics.confusion_matrix(t.tfidf_scored(), ["source_dataset"])


@query
def class_report(t: Inputs) -> DataFrame:
    report = metrics.class_report(t.tfidf_scored())
    return report.select("class", rounded("precision"), rounded("recall"), rounded("f1"), "support")


@query
def accuracy(t: Inputs) -> DataFrame:
    return metrics.accuracy(t.tfidf_scored(), ["source_dataset"]).select(
        "source_dataset", rounded("accuracy"), "pairs"
    )


@query
def roc_curve(t: Inputs) -> DataFrame:
    """The origin, whose threshold is infinity, has a NULL threshold here."""
    points = metrics.roc_curve(t.tfidf_scored())
    threshold = F.nullif("threshold", F.lit(float("inf"))).alias("threshold")
    return points.select(threshold, rounded("fpr"), rounded("tpr"))


@query
def roc_curve_by_source(t: Inputs) -> DataFrame:
    points = metrics.roc_curve(t.tfidf_scored(), by=["source_dataset"])
    threshold = F.nullif("threshold", F.lit(float("inf"))).alias("threshold")
    return points.select("source_dataset", threshold, rounded("fpr"), rounded("tpr"))


@query
def roc_auc_by_level(t: Inputs) -> DataFrame:
    """Per dataset and level; a level has one class only, the pairs without one the other."""
    found = metrics.roc_auc(t.tfidf_scored(), by=["source_dataset", "plagiarism_level"])
    every = metrics.roc_auc(t.tfidf_scored(), by=["source_dataset"])
    every = every.withColumn("plagiarism_level", F.lit(None).cast("string"))
    return found.unionByName(every).select("source_dataset", "plagiarism_level", "positives", "negatives", rounded("auc"))


@query
def roc_auc(t: Inputs) -> DataFrame:
    return metrics.roc_auc(t.tfidf_scored()).select("positives", "negatives", rounded("auc"))


# --- classifier -------------------------------------------------------------------------


@query
def corpus_tfidf_top(t: Inputs) -> DataFrame:
    # Cutting costs far more than moving a text, and a table may be stored in one piece.
    texts = t.documents.select("doc_id", "text").repartition("doc_id")
    weighted = corpus_tfidf(texts, ["doc_id"], F.col("text"))
    return weighted.select("doc_id", "gram", "tf", "df", rounded("weight"))


def _training_texts(t: Inputs) -> DataFrame:
    """Labelled pairs with their split and their joint raw text."""
    split = t.split()
    both = pair_texts(split.select(*PAIR).distinct(), t.documents)
    joint = both.select(*PAIR, pair_text(F.col("text1"), F.col("text2")).alias("text"))
    texts = split.join(joint, PAIR).select(*MANIFEST_KEY, "label", "split", "text")
    return written(texts.repartition(*MANIFEST_KEY), "training-texts")


def _fitted(
    t: Inputs, optimize: bool = False, tolerance: float = MODEL_TOLERANCE
) -> tuple[PairClassifier, DataFrame]:
    texts = _training_texts(t)
    train = texts.where(F.col("split") == splits.TRAIN)
    return PairClassifier(3, tolerance=tolerance).fit(train, MANIFEST_KEY, optimize), texts


def _rounded_predictions(model: PairClassifier, texts: DataFrame, keep: list[str]) -> DataFrame:
    found = model.predictions(texts, keep)
    return found.withColumn("Probability", F.round("Probability", MODEL_DIGITS))


@query
def lr_predictions(t: Inputs) -> DataFrame:
    model, texts = _fitted(t)
    held_out = texts.where(F.col("split") != splits.TRAIN)
    return _rounded_predictions(model, held_out, [*MANIFEST_KEY, "split"])


@query
def lr_penalized_intercept(t: Inputs) -> DataFrame:
    """The same model with the intercept in the penalty."""
    texts = _training_texts(t)
    model = PairClassifier(3, tolerance=1e-8, penalize_intercept=True)
    model.fit(texts.where(F.col("split") == splits.TRAIN), MANIFEST_KEY)
    held_out = texts.where(F.col("split") != splits.TRAIN)
    return _rounded_predictions(model, held_out, [*MANIFEST_KEY, "split"])


@query
def lr_grid(t: Inputs) -> DataFrame:
    model, _ = _fitted(t, optimize=True)
    return t.spark.createDataFrame(model.grid, "c DOUBLE, penalty STRING, mean_f1 DOUBLE")


@query
def feature_importance(t: Inputs) -> DataFrame:
    """The strongest features with their coefficients, rounded."""
    found = _fitted(t, tolerance=COEFFICIENT_TOLERANCE)[0].feature_importance(20)
    rounded_ = (F.round(c, COEFFICIENT_DIGITS).alias(c) for c in ("coefficient", "abs_coefficient"))
    return found.select("feature", *rounded_, "rank_in_sign")


@query
def model_roundtrip(t: Inputs) -> DataFrame:
    """Saved, loaded and applied to the test split."""
    model, texts = _fitted(t)
    path = scratch_path(t.spark, "model")
    model.save(path)
    return _rounded_predictions(PairClassifier.load(path), texts.where(F.col("split") == splits.TEST), MANIFEST_KEY)


@query
def hybrid_three_way(t: Inputs) -> DataFrame:
    """Weights of both similarities and the classifier; its probabilities are out of fold."""
    texts = _training_texts(t).where(F.col("split") == splits.TRAIN)
    out_of_fold = cross_fitted(texts, MANIFEST_KEY, longest=3, tolerance=MODEL_TOLERANCE)
    similar = t.scored().select(*MANIFEST_KEY, "tfidf_similarity", "structure_similarity")
    rows = out_of_fold.join(similar, MANIFEST_KEY)
    grid = compare.weighted_grid(rows, ["tfidf_similarity", "structure_similarity", "probability"])
    weights = [F.col(f"w_{score}").alias(name) for score, name in THREE_WAY.items()]
    return grid.select(*weights, "tp", "tn", "fp", "fn", rounded("f1"), rounded("accuracy"))


@query
def lr_summary(t: Inputs) -> DataFrame:
    model, texts = _fitted(t)
    predicted = model.predictions(texts, ["split"])
    summary = summary_of_splits(predicted)
    return summary.select("Método", *(rounded(c) for c in summary.columns[1:]))
