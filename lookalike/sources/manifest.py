"""Read and write pair manifests, label files and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Column order of the manifest, and its sources.
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("pair_id", T.StringType()),
        T.StructField("folder_name", T.StringType()),
        T.StructField("case_id", T.StringType()),
        T.StructField("case_orig", T.StringType()),
        T.StructField("file1", T.StringType()),
        T.StructField("file2", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("plagiarism_level", T.StringType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("comparison_type", T.StringType()),
    ]
)
MANIFEST_COLUMNS = MANIFEST_SCHEMA.fieldNames()
#: What scoring a pair can do without.
OPTIONAL_COLUMNS = ("case_id", "case_orig", "file1", "file2", "plagiarism_level", "source_dataset", "comparison_type")
LABEL_SCHEMA = T.StructType(
    [
        T.StructField("sub1", T.StringType()),
        T.StructField("sub2", T.StringType()),
        T.StructField("problem", T.IntegerType()),
        T.StructField("verdict", T.IntegerType()),
    ]
)
PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("TrueLabel", T.IntegerType()),
        T.StructField("Predicted", T.IntegerType()),
        T.StructField("Probability", T.DoubleType()),
    ]
)
KNOWN_SOURCES = ("ir_plag", "conplag")


def by_name(table: DataFrame, schema: T.StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``schema``, found by name and cast; optional ones may be absent."""
    missing = [f.name for f in schema if f.name not in table.columns and f.name not in optional]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    known = [f for f in schema if f.name in table.columns]
    return table.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in known))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest CSV with header; ids stay strings. Parquet when the path says so.

    Columns may stand in any order; those a pair can do without may be absent.
    """
    if path.rstrip("/").endswith(".parquet"):
        return by_name(spark.read.parquet(path), MANIFEST_SCHEMA, OPTIONAL_COLUMNS)
    return by_name(spark.read.option("header", True).csv(path), MANIFEST_SCHEMA, OPTIONAL_COLUMNS)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Raw label CSV with ``line_order``, which sorts rows as they stand in the files."""
    place = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )
    labels = spark.read.option("header", True).csv(path).select("*", place.alias("line_order"))
    named = T.StructType([*LABEL_SCHEMA.fields, labels.schema["line_order"]])
    return by_name(labels, named)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return by_name(spark.read.option("header", True).csv(path), PREDICTION_SCHEMA)


def known_sources(manifest: DataFrame, sources: tuple[str, ...] = KNOWN_SOURCES) -> DataFrame:
    """Keep the rows of the known sources; a manifest without that column stays whole."""
    if "source_dataset" not in manifest.columns:
        return manifest
    return manifest.where(F.col("source_dataset").isin(*sources))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
