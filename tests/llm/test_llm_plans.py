"""Plans of the training-data operators."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from folioflow.llm import queries

CORPUS = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(CORPUS).exists(), reason="no test corpus")


def plan(spark, name):
    return queries.QUERIES[name](spark, CORPUS)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "columns"), [("p8_found", "doc_id:bigint,dataset_split:string,text:string"), ("p10_found", "doc_id:bigint,text:string,lang:string")])
def test_scanning_queries_neither_shuffle_nor_join(spark, name, columns):
    text = plan(spark, name)
    assert "Exchange" not in text and "Join" not in text
    assert {tuple(sorted(c.split(","))) for c in re.findall(r"ReadSchema: struct<([^>]*)>", text)} == {tuple(sorted(columns.split(",")))}


def test_leaks_filter_at_the_scan(spark):
    text = plan(spark, "p8_found")
    assert "EqualTo(dataset_split,train)" in text and "IsNotNull(text)" in text


@pytest.mark.parametrize("name", ["p1_found", "p1_splits", "p2_found", "p5_found", "p6_found", "p9_selected"])
def test_no_pairs_of_everything(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_the_sample_is_made_of_one_checkpoint_a_table(spark):
    text = plan(spark, "p7_sample")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "FileScan" not in text


def test_the_sample_reads_identifiers_and_times_only(spark):
    from pyspark.sql import functions as F

    from folioflow.llm import sample
    from folioflow.sources.tables import table

    kept, sample.cut_lineage = sample.cut_lineage, lambda df: df
    try:
        made = sample.frozen_sample(table(spark, CORPUS, "manifest"), F.col("id"), "received_at", 0.1)
        read = set(re.findall(r"ReadSchema: struct<([^>]*)>", made._jdf.queryExecution().executedPlan().toString()))
    finally:
        sample.cut_lineage = kept
    assert read == {"id:string,received_at:timestamp_ntz"}
