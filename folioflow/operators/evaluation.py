"""Evaluation runs: recognised pages against their references, per document and in the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.metrics import character_error_rate, numeric_scores, word_error_rate, word_scores
from folioflow.functions.text import visible_count, words
from folioflow.operators import lines as line_ops

#: From which rate and length on an alignment is for review (fixed values).
REVIEW_RATE, REVIEW_LENGTH = 1.0, 2.0


def recognized_text(lines: DataFrame, keys: list[str], order: str = "line_id") -> DataFrame:
    """(keys, hypothesis, lines, model_confidence): a page's lines joined by line breaks, in order."""
    item = F.struct(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("text"))
    joined = lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "\n").alias("hypothesis"), F.count("*").alias("lines"))
    confidence = line_ops.weighted_confidence(lines, keys).select(*keys, F.round("confidence", 2).alias("model_confidence"))
    return joined.join(confidence, keys)


def measured(pairs: DataFrame, keys: list[str], reference: str = "reference", hypothesis: str = "hypothesis", ordered: bool = True) -> DataFrame:
    """``pairs`` (unique keys) with word and number scores, sizes, length ratio and, with ``ordered``, the rates of ordered
    texts (cer, wer) and ``alignment_review_required``. Null texts are empty ones; scores have four digits, the ratio three."""
    pairs = pairs.withColumn(reference, F.coalesce(reference, F.lit(""))).withColumn(hypothesis, F.coalesce(hypothesis, F.lit("")))
    scores = lambda made, name: made.select(*keys, *(F.round(c, 4).alias(f"{name}_{c}") for c in ("precision", "recall", "f1")), F.col("matched").alias(f"matched_{name}s"), F.col("references").alias(f"reference_{name}s"), F.col("hypotheses").alias(f"recognized_{name}s"))
    both = pairs.join(scores(word_scores(pairs, keys, reference, hypothesis), "word"), keys).join(scores(numeric_scores(pairs, keys, reference, hypothesis), "numeric"), keys)
    ratio = F.coalesce(F.try_divide(F.col("characters"), F.col("reference_characters")), F.lit(0.0))
    sized = both.withColumn("characters", visible_count(F.col(hypothesis))).withColumn("reference_characters", visible_count(F.col(reference)))
    if ordered:
        sized = sized.withColumn("_r", words(F.col(reference))).withColumn("_h", words(F.col(hypothesis)))
        sized = sized.withColumn("cer", F.round(character_error_rate(F.col(reference), F.col(hypothesis)), 4)).withColumn("wer", F.round(word_error_rate(F.col("_r"), F.col("_h")), 4)).drop("_r", "_h")
        sized = sized.withColumn("alignment_review_required", (F.col("cer") > REVIEW_RATE) & (ratio >= REVIEW_LENGTH))
    return sized.withColumn("output_reference_length_ratio", F.round(ratio, 3))


def _mean(column: str, digits: int = 4) -> Column:
    return F.round(F.avg(F.col(column).cast("decimal(20,6)")), digits).cast("double").alias(f"mean_{column}")


def profile_aggregate(documents: DataFrame, profile: str) -> DataFrame:
    """Per profile: documents, mean and median cer, mean wer, word and number f1, confidence and time, and how many
    alignments are for review, with the mean cer of the others (null if there are none)."""
    return documents.groupBy(profile).agg(
        F.count("*").alias("documents"), _mean("cer"), F.round(F.median("cer"), 4).alias("median_cer"), _mean("wer"), _mean("word_f1"), _mean("numeric_f1"),
        _mean("model_confidence", 2), _mean("ocr_ms", 2), F.count_if("alignment_review_required").alias("alignment_review_required"),
        F.round(F.avg(F.when(~F.col("alignment_review_required"), F.col("cer"))), 4).alias("mean_cer_without_review_flags"),
    )


def variant_aggregate(documents: DataFrame, variant: str, conditions: list[str]) -> DataFrame:
    """Eleven measures per variant, over all and per value of each condition, in one pass (grouping sets).

    ``level`` names the condition (all for none), ``value`` its value. Time means have two digits, others four; rectified and
    illumination_normalized are counts.
    """
    sets = [[variant], *([c, variant] for c in conditions)]
    grouped = documents.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in [variant, *conditions]))
    level, value = F.lit("all"), F.lit(None).cast("string")
    for c in conditions:
        level, value = F.when(F.grouping(c) == 0, c).otherwise(level), F.when(F.grouping(c) == 0, F.col(c).cast("string")).otherwise(value)
    made = grouped.agg(
        level.alias("level"), value.alias("value"), F.count("*").alias("documents"), _mean("reading_order_cer"), F.round(F.median("reading_order_cer"), 4).alias("median_reading_order_cer"),
        _mean("word_precision"), _mean("word_recall"), _mean("word_f1"), _mean("numeric_f1"), _mean("model_confidence"), _mean("ocr_ms", 2),
        F.count_if("rectified").alias("rectified"), F.count_if("illumination_normalized").alias("illumination_normalized"),
    )
    return made.drop(*conditions)


def model_aggregate(documents: DataFrame) -> DataFrame:
    """(documents, mean_cer, mean_wer, mean_word_f1, mean_numeric_f1, mean_ms) over all documents of a model."""
    means = documents.withColumnRenamed("elapsed_ms", "ms")
    return means.agg(F.count("*").alias("documents"), _mean("cer"), _mean("wer"), _mean("word_f1"), _mean("numeric_f1"), _mean("ms", 2))
