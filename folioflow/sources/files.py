"""Text sources and sinks: JSON Lines manifests, label lists, reports, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST_SCHEMA = (
    "id string, category string, source_split string, dataset_split string, splits array<string>, image_zip string, image_member string, "
    "label_zip string, label_member string, annotation_count int, sample_count int"
)


def read_manifest(spark: SparkSession, path: str, schema: str | StructType = MANIFEST_SCHEMA, strict: bool = True) -> DataFrame:
    """Rows of a JSON Lines manifest. ``strict`` fails on a broken line when it is read; else such lines are left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def not_empty(rows: DataFrame, what: str) -> DataFrame:
    """``rows``, which must have some; reads them as far as the first."""
    if rows.isEmpty():
        raise ValueError(f"{what} is empty")
    return rows


def cases(manifest: DataFrame, split: str, limit: int | None = None) -> DataFrame:
    """Rows that carry a split tag, in the order of id; ``limit`` keeps the first."""
    rows = manifest.filter(F.array_contains("splits", split)).orderBy("id")
    return rows if limit is None else rows.limit(limit)


def write_manifest(rows: DataFrame, path: str) -> None:
    """JSON Lines with sorted keys; null cells are written as such. The committer makes it appear at once."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})).write.mode("overwrite").text(path)


def read_label_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(image, label) of a tab-separated list; only the first tab separates. ``limit`` keeps the first by image."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).filter(F.col("value").contains("\t")).select(parts[0].alias("image"), parts[1].alias("label"))
    return rows if limit is None else rows.orderBy("image", "label").limit(limit)


def write_label_lists(rows: DataFrame, path: str, image: str = "image", label: str = "label", variant: str = "variant") -> None:
    """One tab-separated list a variant."""
    rows.select(variant, F.concat_ws("\t", image, label).alias("value")).write.mode("overwrite").partitionBy(variant).text(path)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(file, aggregate) of JSON reports that have an object ``aggregate``; other files are ignored."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.try_parse_json("value").alias("_v"))
    return raw.select("file", F.try_variant_get("_v", "$.aggregate", "variant").alias("_a")).filter(F.schema_of_variant("_a").startswith("OBJECT")).select("file", F.to_json("_a").alias("aggregate"))


def write_report(rows: DataFrame, path: str) -> None:
    """One JSON object a row."""
    rows.write.mode("overwrite").json(path)


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, sha256) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"))


#: Limits of feedback fields (fixed values).
MOST_ID, MOST_TEXT = 64, 100_000


def feedback_problem(analysis_id, accepted, corrected):
    """invalid_id, missing_correction or too_long, else null: rejected rows need a corrected text."""
    blank = F.trim(F.coalesce(corrected, F.lit(""))) == ""
    return (
        F.when(F.coalesce(F.length(analysis_id), F.lit(0)).between(1, MOST_ID) == F.lit(False), "invalid_id")
        .when((F.coalesce(accepted.cast("int"), F.lit(0)) == 0) & blank, "missing_correction")
        .when(F.length(corrected) > MOST_TEXT, "too_long")
    )


def append_feedback(rows: DataFrame, path: str) -> None:
    """Valid feedback rows, appended as Parquet with the time of writing."""
    valid = rows.filter(feedback_problem(F.col("analysis_id"), F.col("accepted"), F.col("corrected_text")).isNull())
    valid.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)
