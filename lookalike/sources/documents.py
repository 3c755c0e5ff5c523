"""Source files as rows, and finding the two files of a pair."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# File pattern and the two file names of a graded pair.
SOURCE_PATTERN = "*.java"
SOURCE_SUFFIX = ".java"
ORIGINAL_FILE = "original.java"
COMPARED_FILE = "compared.java"

#: What opening a file counts when files are dealt to tasks. Spark's 4 MB put four source files into one.
SMALL_FILE_BYTES = 64 << 10


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_of(path: Column) -> Column:
    """Last folder of a path."""
    return F.element_at(F.split(path, "/"), -2)


def stem(name: Column) -> Column:
    """File name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def read_documents(spark: SparkSession, root: str, pattern: str = SOURCE_PATTERN, strict: bool = False) -> DataFrame:
    """``(path, folder, file, text)`` of all matching files below ``root``.

    Bytes that are no UTF-8 are dropped, or with ``strict`` such a file has a
    NULL text (see ``unreadable``). Files are read by the tasks, one per row.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(root)
    )
    raw = F.col("content").cast("string")
    if strict:
        text = F.try_validate_utf8(raw)
    else:
        # A file may hold the replacement character itself; it is set aside while bad bytes are marked by it.
        aside = raw
        for old, new in (("\x01", "\x01a"), ("\ufffd", "\x01b")):
            aside = F.replace(aside, F.lit(old), F.lit(new))
        clean = F.replace(F.make_valid_utf8(aside), F.lit("\ufffd"), F.lit(""))
        for old, new in (("\x01b", "\ufffd"), ("\x01a", "\x01")):
            clean = F.replace(clean, F.lit(old), F.lit(new))
        text = F.when(F.is_valid_utf8(raw), raw).otherwise(clean)
    return files.select(
        "path", folder_of(F.col("path")).alias("folder"), base_name(F.col("path")).alias("file"), text.alias("text")
    )


def _shared_folder(spark: SparkSession, root: str) -> str | None:
    """``root`` as a folder that tasks can open, if it lies in the file system of the machines and is new."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(context._jsc.hadoopConfiguration())
    whole = store.makeQualified(path).toUri()
    if whole.getScheme() != "file" or store.exists(path):
        return None
    store.mkdirs(path)
    return whole.getPath()


def write_files(documents: DataFrame, root: str) -> None:
    """Write each text of ``documents (doc_id, text)``, ids once, to a file below ``root/doc=<doc_id>``.

    Bytes are written as they are, valid or not; a newline ends the file. In a folder that all
    machines share, tasks write the files themselves: Hadoop's local file system starts several
    processes for each file it makes.
    """
    rows = documents.select(F.col("doc_id").alias("doc"), F.col("text").alias("value")).repartition("doc")
    whole_ids = dict(rows.dtypes)["doc"] in ("tinyint", "smallint", "int", "bigint")
    folder = _shared_folder(documents.sparkSession, root) if whole_ids else None
    if folder is None:
        rows.write.partitionBy("doc").text(root)
        return

    def write(batches):
        import os
        import uuid

        import pyarrow as pa

        own, doc, out, made = uuid.uuid4().hex, None, None, 0

        def end():
            # A file has its name when it is whole; another try of the task replaces it.
            if out is not None:
                out.close()
                os.replace(out.name, out.name.removesuffix(f".{own}"))

        for batch in batches:
            for this, value in zip(batch.column("name").to_pylist(), batch.column("value")):
                if this != doc:
                    end()
                    os.makedirs(f"{folder}/doc={this}", exist_ok=True)
                    doc, out, made = this, open(f"{folder}/doc={this}/part-00000.txt.{own}", "wb"), made + 1
                out.write((value.as_py() or b"") + b"\n")
        end()
        yield pa.RecordBatch.from_pydict({"files": pa.array([made], pa.int64())})

    name = F.coalesce(F.col("doc").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    ready = rows.sortWithinPartitions("doc").select(name.alias("name"), F.col("value").cast("binary").alias("value"))
    ready.mapInArrow(write, "files BIGINT").agg(F.sum("files")).collect()


@contextmanager
def many_small_files(spark: SparkSession) -> Iterator[None]:
    """Read many small files in few tasks: while this lasts, opening one counts as few bytes, and a task lists many folders."""
    folders = 8 * spark.sparkContext.defaultParallelism
    meant = {
        "spark.sql.files.openCostInBytes": str(SMALL_FILE_BYTES),
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(folders),
    }
    kept = {key: spark.conf.get(key) for key in meant}
    try:
        for key, value in meant.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def unreadable(documents: DataFrame) -> DataFrame:
    """Reject table: the files without a text."""
    return documents.where(F.col("text").isNull()).select("path", "folder", "file")


def resolve_pairs(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Find the two files of every manifest row: adds ``folder, path1, path2``.

    ``files`` lists ``(folder, file, path)``. Graded pairs have fixed file
    names in their folder. A folder belongs to one pair, so these joins are
    not skewed. Contest pairs lie in a folder named after both
    submissions, in either order; the given order wins when both exist. Other
    pairs take the first two source files of their folder by name. Rows
    without both files are left out.
    """
    source = F.col("source_dataset")
    graded = (source == "ir_plag") & F.col("folder_name").isNotNull()
    contest = (source == "conplag") & F.col("file1").isNotNull() & F.col("file2").isNotNull()
    named = manifest.select(
        "*",
        F.when(graded, "graded").when(contest, "contest").otherwise("other").alias("_kind"),
        stem(F.col("file1")).alias("_stem1"),
        stem(F.col("file2")).alias("_stem2"),
    )
    straight = F.concat_ws("_", "_stem1", "_stem2")
    reverse = F.concat_ws("_", "_stem2", "_stem1")
    folders = F.when(F.col("_kind") == "contest", F.array(straight, reverse)).otherwise(F.array("folder_name"))
    places = named.select("*", F.posexplode(folders).alias("_try", "folder")).where(F.col("folder").isNotNull())
    existing = files.select("folder").distinct()
    places = places.join(existing, "folder", "left_semi")
    # Both folder orders may exist; there are at most two rows per pair.
    chosen = (
        places.withColumn("_rank", F.row_number().over(Window.partitionBy("pair_id").orderBy("_try")))
        .where(F.col("_rank") == 1)
        .drop("_try", "_rank")
    )
    wanted = chosen.where(F.col("_kind") != "other").select(
        "*",
        F.when(F.col("_kind") == "graded", F.lit(ORIGINAL_FILE)).otherwise(F.col("file1")).alias("_want1"),
        F.when(F.col("_kind") == "graded", F.lit(COMPARED_FILE)).otherwise(F.col("file2")).alias("_want2"),
    )
    listing = files.select("folder", "file", "path")

    def locate(rows: DataFrame, want: str, found: str) -> DataFrame:
        side = listing.select("folder", F.col("file").alias(want), F.col("path").alias(found))
        return rows.join(side, ["folder", want])

    direct = locate(locate(wanted, "_want1", "path1"), "_want2", "path2")
    by_name = F.row_number().over(Window.partitionBy("folder").orderBy("file"))
    # row_number <= 2 is cut per task before the shuffle, however full a folder is.
    first_two = (
        listing.where(F.col("file").endswith(SOURCE_SUFFIX)).withColumn("_at", by_name).where(F.col("_at") <= 2)
    )
    two = (
        first_two.groupBy("folder")
        .agg(F.min_by("path", "_at").alias("path1"), F.max_by("path", "_at").alias("path2"), F.count("_at").alias("_n"))
        .where(F.col("_n") == 2)
    )
    fallback = chosen.where(F.col("_kind") == "other").join(two, "folder")
    out = [*manifest.columns, "folder", "path1", "path2"]
    return direct.select(*out).unionByName(fallback.select(*out))


def verify_folders(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``problem``: NULL, or why the folder of the pair cannot be used."""
    source_files = F.count_if(F.col("file").endswith(SOURCE_SUFFIX))
    counts = files.groupBy(F.col("folder").alias("folder_name")).agg(source_files.alias("_files"))
    checked = manifest.join(counts, "folder_name", "left")
    # The two reasons.
    problem = F.when(F.col("_files").isNull(), "carpeta no existe").when(F.col("_files") < 2, "archivos faltantes")
    return checked.select(*manifest.columns, problem.alias("problem"))


def usable_pairs(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return verify_folders(manifest, files).where(F.col("problem").isNull()).drop("problem")


def problem_pairs(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return verify_folders(manifest, files).where(F.col("problem").isNotNull()).select("folder_name", "problem")


#: Folders shown of each problem.
SAMPLE_SIZE = 10


def problem_samples(manifest: DataFrame, files: DataFrame, size: int = SAMPLE_SIZE) -> DataFrame:
    """``(problem, nth, folder_name)``: the first ``size`` folders of each problem, by name."""
    by_name = Window.partitionBy("problem").orderBy("folder_name")
    # Numbers up to ``size`` are cut per task before the shuffle.
    numbered = problem_pairs(manifest, files).distinct().withColumn("nth", F.row_number().over(by_name))
    return numbered.where(F.col("nth") <= size).select("problem", "nth", "folder_name")


def write_split_documents(split_files: DataFrame, path: str) -> None:
    """Write documents below one directory per split.

    ``split_files`` has a ``split`` column. Only the splits present in it are
    replaced. Every writing task keeps a file per split it holds.
    """
    (
        split_files.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("split")
        .parquet(path)
    )
