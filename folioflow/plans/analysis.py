"""Whole analyses: images to quality, lines, reading order and summary; engines compared side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import lines as line_ops
from folioflow.operators import quality, summary
from folioflow.sources.recognizer import Recognizer, recognize


def assessed(images: DataFrame) -> DataFrame:
    """``images`` with metrics, reasons and verdict; the metrics come from one Arrow pass, the verdict is SQL."""
    measured = images.withColumn("metrics", quality.image_metrics("data", "height", "width", "nChannels"))
    seen = (F.col("metrics.foreground"), F.col("metrics.focus"), F.col("metrics.contrast"))
    return measured.withColumn("reasons", quality.reasons(*seen)).withColumn("status", quality.verdict(*seen))


def ordered_lines(recognized: DataFrame, key: str) -> DataFrame:
    """Lines renumbered in reading order."""
    placed = line_ops.reading_order(recognized, [key], "line_id").select(key, "line_id", F.col("place").alias("_place"))
    return recognized.join(placed, [key, "line_id"]).drop("line_id").withColumnRenamed("_place", "line_id")


def analyze(images: DataFrame, key: str, engine: Callable[[], Recognizer]) -> DataFrame:
    """(key, status, reasons, metrics, confidence, text, summary fields, coverage) of every image.

    Pages to be retaken are not recognised: their text and summary are null. Failures of single pages are the engine's to
    report as no lines; ``error_code`` 503 marks pages that passed and gave none.
    """
    checked = assessed(images).select(key, "data", "height", "width", "nChannels", "metrics", "reasons", "status")
    lines = ordered_lines(recognize(checked.filter("status = 'pass'"), key, engine), key)
    confidence = line_ops.weighted_confidence(lines, [key]).select(key, F.round("confidence", 2).alias("confidence"))
    made = summary.extractive_summary(summary.page_lines(lines, [key], "line_id"))
    made = made.withColumn("text", F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).withColumn("coverage", summary.citation_coverage(F.col("overview_ids"), F.col("key_points"), F.col("actions")))
    joined = checked.drop("data", "height", "width", "nChannels").join(confidence, key, "left").join(made, key, "left")
    return joined.withColumn("error_code", F.when((F.col("status") == "pass") & F.col("text").isNull(), 503))


def compare(images: DataFrame, key: str, engines: dict[str, Callable[[], Recognizer]]) -> DataFrame:
    """(branch, metric, value): characters, confidence and coverage of each engine's analyses, in long form."""
    parts = None
    for name, engine in engines.items():
        part = analyze(images, key, engine).select(F.lit(name).alias("branch"), F.length(F.regexp_replace("text", "\\s", "")).cast("double").alias("characters"), F.col("confidence").cast("double").alias("confidence"), F.col("coverage").cast("double").alias("coverage"))
        parts = part if parts is None else parts.unionByName(part)
    means = parts.groupBy("branch").agg(*(F.round(F.avg(c), 4).alias(c) for c in ("characters", "confidence", "coverage")))
    return means.unpivot(["branch"], ["characters", "confidence", "coverage"], "metric", "value")
