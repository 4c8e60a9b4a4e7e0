"""Queries of the training-data operators over a corpus directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import leakage, mixture, ocr_repair, overlap, pii, sample, sentences, splits
from folioflow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: splits.broken_groups(table(s, d, "documents")),
    "p1_splits": lambda s, d: splits.assign_splits(table(s, d, "documents"), table(s, d, "manifest")),
    "p2_found": lambda s, d: ocr_repair.find_noise(table(s, d, "ocr_line_data"), table(s, d, "ocr_line"), table(s, d, "lexicon")),
    "p2_pages": lambda s, d: ocr_repair.readable_pages(table(s, d, "ocr_line_data"), table(s, d, "ocr_line"), table(s, d, "lexicon")),
    "p5_found": lambda s, d: pii.find_mentions(table(s, d, "annotations"), table(s, d, "feedback")).select("src", "row_id", "pii_type", "start_pos"),
    "p5_redacted": lambda s, d: pii.deidentify(table(s, d, "annotations"), table(s, d, "feedback")),
    "p6_found": lambda s, d: overlap.found_pairs(table(s, d, "documents"), table(s, d, "annotations")),
    "p6_report": lambda s, d: overlap.overlap_report(table(s, d, "documents"), table(s, d, "annotations")),
    "p7_sample": lambda s, d: sample.corpus_sample(table(s, d, "manifest"), table(s, d, "documents")),
    "p8_found": lambda s, d: leakage.leaks(table(s, d, "documents"), table(s, d, "benchmark_items")),
    "p8_report": lambda s, d: leakage.leak_report(leakage.leaks(table(s, d, "documents"), table(s, d, "benchmark_items")), table(s, d, "benchmark_items")),
    "p9_found": lambda s, d: mixture.starved_sources(table(s, d, "documents"), table(s, d, "source_targets")),
    "p9_selected": lambda s, d: mixture.selected_documents(table(s, d, "documents"), table(s, d, "source_targets")),
    "p9_shares": lambda s, d: mixture.share_report(mixture.selected_documents(table(s, d, "documents"), table(s, d, "source_targets")), table(s, d, "source_targets")),
    "p10_found": lambda s, d: sentences.sentence_units(table(s, d, "documents")),
    "p10_units": lambda s, d: sentences.units_with_text(table(s, d, "documents")),
}
