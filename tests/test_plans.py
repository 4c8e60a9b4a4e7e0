"""Plans: what reaches the scan, and what is not shuffled."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow import catalog

CORPUS = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(CORPUS).exists(), reason="no test corpus")


def plan(spark, name):
    frame = catalog.QUERIES[name](spark, CORPUS)
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "columns"), [("stable_bucket", {"document_id"}), ("split_contract", {"source_split", "dataset_split"}), ("duplicate_ids", {"id"}), ("quality_verdict", {"event_id", "value", "props"})])
def test_scans_read_only_what_is_needed(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))
    assert read and all({c.split(":")[0] for c in schema.split(",")} == columns for schema in read)


def test_filters_reach_the_scan(spark):
    assert "EqualTo(dataset_split,final)" in plan(spark, "final_topn")
    assert "GreaterThan(sample_count,0)" in plan(spark, "prefix_index")


@pytest.mark.parametrize("name", ["quality_verdict", "candidate_routing", "relative_stem", "crop_rect", "project_boxes", "p4_found", "p4_words", "char_error_rate", "valid_char_ratio", "strip_markup"])
def test_row_wise_queries_do_not_shuffle(spark, name):
    text = plan(spark, name)
    assert "Join" not in text and ("Exchange" not in text or name == "crop_rect")


@pytest.mark.parametrize("name", ["sample_locate", "pair_two_stage", "effects_vs_base", "selector_report", "replacement_probe"])
def test_joins_are_equi_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_k_per_group_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "threshold_tags")
    assert "TakeOrderedAndProject" in plan(spark, "final_topn")


def test_hot_keys_are_dealt_out(spark):
    from folioflow.plans.skew import join_hot

    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 3 + [3])], "k int, i int")
    keyed = rows.filter("k < 3").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("low"))
    want = sorted(map(tuple, rows.join(keyed.drop("n"), "k").select("k", "i", "low").collect()))
    for hot in (2, 10, 1000):
        assert sorted(map(tuple, join_hot(rows, keyed, ["k"], ["i"], "n", hot, 4).select("k", "i", "low").collect())) == want


def test_starts_of_blocks(spark):
    from folioflow.plans.ranks import block_starts

    totals = [(i * 3, i % 7 + 1) for i in range(200)]
    got = {r.b: r._start for r in block_starts(spark.createDataFrame(totals, "b long, n long"), "b", "n", width=16).collect()}
    assert got == {b: sum(n for _, n in totals[:i]) for i, (b, _) in enumerate(totals)}
