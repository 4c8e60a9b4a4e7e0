from __future__ import annotations

import random
from collections import defaultdict
from hashlib import sha256
from statistics import fmean, median

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import index, lines, manifest, quality, report, sampling, summary
from folioflow.plans import ranks


def test_bottom_k_and_prefix_in_hash_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.randrange(0, 9), sha256(str(i).encode()).hexdigest()) for i in range(800)]
    frame = spark.createDataFrame(rows, "g string, k int, n int, h string")
    limits = spark.createDataFrame([("a", 100), ("b", 0)], "g string, limit long")
    got = {r.k for r in ranks.below_limit(frame, ["g"], ["h", "k"], "h", limits, "limit", bits=4).collect()}
    assert got == {k for _, k, _, _ in sorted((r for r in rows if r[0] == "a"), key=lambda r: (r[3], r[1]))[:100]}
    before = {r.k: r.preceding for r in ranks.preceding_total(frame, ["g"], ["h", "k"], "h", "n", bits=5).collect()}
    for group in "ab":
        total = 0
        for _, k, n, _ in sorted((r for r in rows if r[0] == group), key=lambda r: (r[3], r[1])):
            assert before[k] == total
            total += n


def test_stratified_split_sizes(spark):
    rows = [(i, "x" if i < 25 else "y" if i < 30 else "z" if i < 31 else None) for i in range(36)]
    made = sampling.stratified_split(spark.createDataFrame(rows, "k int, c string"), "k", "c").groupBy("c").agg(F.count_if(F.col("assigned") == "dev").alias("n")).collect()
    assert {r.c: r.n for r in made} == {"x": 2, "y": 1, "z": 0, None: 1}
    with pytest.raises(ValueError):
        sampling.stratified_split(spark.createDataFrame(rows, "k int, c string"), "k", "c", 0.5)


def test_turn_taking_agrees_with_a_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abbbbc"), rng.randrange(0, 6)) for i in range(60)]
    frame = spark.createDataFrame(rows, "k int, c string, n int")
    queues = defaultdict(list)
    for k, c, n in sorted(rows, key=lambda r: (sha256(str(r[0]).encode()).hexdigest()[:16], r[0])):
        queues[c].append((k, n))

    def turns(queues):
        queues = {c: list(q) for c, q in sorted(queues.items())}
        while any(queues.values()):
            for q in queues.values():
                if q:
                    yield q.pop(0)

    want = [k for k, _ in turns(queues)][:17]
    assert [r.k for r in sampling.balanced_sample(frame, "k", "c", 17).orderBy("position").collect()] == want
    spent, chosen = 0, []
    for k, n in turns({c: [x for x in q if x[1] > 0] for c, q in queues.items()}):
        if spent >= 31:
            break
        chosen.append(k)
        spent += n
    assert sorted(r.k for r in sampling.budget_sample(frame, "k", "c", "n", 31).collect()) == sorted(chosen)


def test_index_and_location(spark):
    frame = spark.createDataFrame([(11, 2), (22, 3), (33, 1), (44, 0)], "k long, n int")
    made = index.prefix_index(frame, "k", "n")
    assert sorted((r.k, r.first, r.end) for r in made.collect()) == [(11, 0, 2), (22, 2, 5), (33, 5, 6)]
    asked = spark.createDataFrame([(0,), (2,), (5,), (6,)], "i long")
    assert sorted((r.i, r.k, r.place) for r in index.locate(made, "k", asked, "i").collect()) == [(0, 11, 0), (2, 22, 0), (5, 33, 0)]


def test_batches_cover_each_rank_once_and_resume(spark):
    rng = random.Random(2)
    sizes = {i: rng.randrange(0, 9) for i in range(90)}
    frame = spark.createDataFrame(list(sizes.items()), "k long, n int")
    order = sorted((k for k, n in sizes.items() if n), key=lambda k: (sha256(f"epoch:2:{k}".encode()).hexdigest(), k))
    for rank in range(2):
        samples = [(k, i) for k in order[rank::2] for i in range(sizes[k])]
        got = defaultdict(list)
        for r in index.rank_batches(frame, "k", "n", 2, 2, 16, rank).collect():
            got[r.batch] += [(r.k, i) for i in range(r.first, r.last + 1)]
        assert {b: sorted(v) for b, v in got.items()} == {b: sorted(samples[16 * b : 16 * b + 16]) for b in range(len(samples) // 16)}
    assert min(r.batch for r in index.rank_batches(frame, "k", "n", 2, 2, 16, 0, resume=3).collect()) == 3


def test_replacements_are_valid(spark):
    frame = spark.range(50).select(F.col("id").alias("i"), (F.col("id") % 3 != 0).alias("ok"), F.lit("s").alias("split"))
    got = index.replaced(frame, "i", "ok", "split", 50).collect()
    assert len(got) == 50 and all(r.used % 3 and (r.attempt == 0) == (r.used == r.i) for r in got)
    assert all(r.used is None for r in index.replaced(frame.withColumn("ok", F.lit(False)), "i", "ok", "split", 50).collect())


def test_reading_order_agrees_with_nearest_row_search(spark):
    rng = random.Random(6)
    pages = {p: [(i, rng.randrange(60), rng.randrange(60), rng.randrange(1, 14)) for i in range(rng.randrange(1, 14))] for p in range(40)}
    frame = spark.createDataFrame([(p, *b) for p, bs in pages.items() for b in bs], "p int, id int, x int, y int, height int")
    got = defaultdict(list)
    for r in lines.reading_order(frame, ["p"], "id").orderBy("p", "place").collect():
        got[r.p].append(r.id)
    for p, boxes in pages.items():
        limit, rows = max(3.0, 0.55 * median(max(1, b[3]) for b in boxes)), []
        for b in sorted(boxes, key=lambda b: (b[2] + b[3] / 2, b[1], b[0])):
            centre = b[2] + b[3] / 2
            near = min(rows, key=lambda r: abs(fmean(x[2] + x[3] / 2 for x in r) - centre), default=None)
            if near is not None and abs(fmean(x[2] + x[3] / 2 for x in near) - centre) <= limit:
                near.append(b)
            else:
                rows.append([b])
        rows.sort(key=lambda r: min(b[2] for b in r))
        assert got[p] == [b[0] for r in rows for b in sorted(r, key=lambda b: (b[1], b[2], b[0]))]


def test_candidates(spark):
    frame = spark.createDataFrame([(1, "p", 70.0, 0), (1, "o", 72.0, 1), (2, "p", 70.0, 0), (2, "o", 74.0, 1), (3, "p", 70.0, 0), (3, "o", 73.0, 1)], "k int, s string, v double, i int")
    assert {r.k: r.s for r in lines.choose_candidate(frame, ["k"], "s", "v", "i", "p").collect()} == {1: "p", 2: "o", 3: "p"}
    routed = lambda *v: spark.range(1).select(lines.extra_strategies(*(F.lit(x) for x in v)).alias("x")).first().x
    assert routed(80.0, 0.1, 0.0) == [] and routed(60.0, 0.01, 0.08) == ["normalized", "sparse", "binary"] and routed(80.0, 0.5, 0.06) == ["normalized"]


def test_words_to_lines_and_confidence(spark):
    words = [(1, 0, "가나", 90.0, 5, 5, 10, 10), (1, 1, "다", 60.0, 20, 4, 10, 12), (1, 2, " ", 99.0, 0, 0, 1, 1), (1, 3, "x", -1.0, 0, 0, 1, 1)]
    row = lines.words_to_lines(spark.createDataFrame(words, "l int, i int, word string, confidence double, x int, y int, width int, height int"), ["l"], "i").first()
    assert tuple(row) == (1, "가나 다", 80.0, 5, 4, 25, 12, 0)


def test_quality(spark):
    rng = np.random.default_rng(0)
    page = np.where(rng.random((160, 240)) < 0.1, 20, 240).astype(np.uint8)
    focus, foreground, contrast, light = quality.grey_metrics(page)
    assert focus > quality.FOCUS and 0.05 < foreground < 0.2 and 40 < contrast <= 100 and light < 0.1
    assert quality.grey_metrics(np.full((40, 40), 255, np.uint8))[:3] == (0.0, 0.0, 0.0)
    verdict = lambda *v: spark.range(1).select(quality.verdict(*map(F.lit, v)).alias("x"), quality.reasons(*map(F.lit, v)).alias("y")).first()
    assert tuple(verdict(0.0, 100.0, 50.0)) == ("retake", ["blank"]) and tuple(verdict(0.1, 10.0, 50.0)) == ("pass", ["blur"]) and verdict(0.1, 10.0, 5.0).x == "retake"
    raw = spark.createDataFrame([(bytearray(np.repeat(page[..., None], 3, 2).tobytes()), 160, 240, 3)], "data binary, height int, width int, nChannels int")
    assert raw.select(quality.image_metrics("data", "height", "width", "nChannels").alias("m")).first().m.foreground == pytest.approx(foreground)


def test_contrast_is_in_percent_and_pale_pages_are_low():
    rng = np.random.default_rng(0)
    for paper, ink, low in ((200, 185, True), (240, 20, False)):
        page = np.where(rng.random((160, 240)) < 0.1, ink, paper).astype(np.uint8)
        assert (quality.grey_metrics(page)[2] < quality.CONTRAST) == low


def test_summary(spark):
    frame = spark.createDataFrame([(1, i, t) for i, t in enumerate(["제목", "", "둘", "신청 기간", "넷", "다섯", "여섯"])] + [(2, 0, None)], "p int, i int, text string")
    made = {r.p: r for r in summary.extractive_summary(summary.page_lines(frame, ["p"], "i")).collect()}
    assert made[1].title == "제목" and made[1].overview == "제목 둘 신청 기간" and made[1].overview_ids == [1, 3, 4]
    assert [f.ids for f in made[1].key_points] == [[3], [4], [5], [6]] and [f.ids for f in made[1].actions] == [[4]]
    assert made[2].title is None and made[2].key_points == []
    ids = spark.createDataFrame([([1, 1, 9],), ([0, 9],), ([3, 2],)], "c array<int>").select(summary.clean_ids(F.col("c"), F.lit(3)).alias("x")).collect()
    assert [r.x for r in ids] == [[1], [], [2, 3]]


def test_effects_and_selectors(spark):
    rows = [(1, "raw", 0.8, 5), (1, "new", 0.9, 5), (2, "raw", 0.8, 7), (2, "new", 0.8, 6), (3, "raw", 0.9, 1), (3, "new", 0.7, 9)]
    frame = spark.createDataFrame(rows, "d int, v string, m double, n int")
    assert tuple(report.effects(frame, "d", "v", "raw", "m").first()) == ("new", 3, -0.0333, 1, 1)
    got = {r.rule: (r.mean, r.picks, r.agreements) for r in report.selectors(frame, "d", "v", "raw", "new", "m", {"always_base": None, "always_other": None, "more": "n", "best": "m"}).collect()}
    assert got == {"always_base": (0.8333, 0, 2), "always_other": (0.8, 3, 1), "more": (0.7667, 1, 1), "best": (0.8667, 1, 3)}


def test_pairing_and_identifiers(spark):
    images = spark.createDataFrame([("img/a/x-1.JPG",), ("img/b/x-2.jpg",), ("img/c/dup.jpg",), ("img/d/dup.jpg",), ("img/e/only.png",)], "path string")
    labels = spark.createDataFrame([("lab/a/X-1.json", None), ("lab\\b\\x-2.json", None), ("lab/q/dup.json", "dup.jpg"), ("lab/q/z.json", "only.png"), (None, None)], "path string, declared string")
    got = [(r.image, r.paired_by) for r in manifest.pair_labels(labels, images.withColumnRenamed("path", "i"), "path", "declared", "i").collect()]
    assert sorted(got, key=str) == sorted([("img/a/x-1.JPG", "relative_stem"), ("img/b/x-2.jpg", "relative_stem"), (None, "missing"), ("img/e/only.png", "file_name"), (None, "missing")], key=str)
    ids = manifest.disambiguate(images.withColumn("n", F.monotonically_increasing_id()), "path", ["path"]).orderBy("path").collect()
    assert [r.document_id for r in ids] == ["x-1", "x-2", "dup", "d__dup", "only"]
    with pytest.raises(Exception, match="repeated"):
        manifest.assert_unique(images.union(images), ["path"]).collect()
    assert manifest.assert_unique(images, ["path"]).count() == 5


def test_rejections(spark):
    notes = [(None, [1.0, 1, 5, 5]), (" ", [1.0, 1, 5, 5]), ("x" * 26, [1.0, 1, 5, 5]), ("x", None), ("x", [1.0, 1, 5]), ("x", [1.0, 1, 1, 5]), ("x", [1.0, float("nan"), 5, 5]), ("x", [1.0, 1, 5, 5])]
    frame = spark.createDataFrame([((t, b and [float(v) for v in b]),) for t, b in notes], "annotation struct<text:string,bbox:array<double>>")
    assert {r.reason: r.n for r in manifest.rejection_counts(frame).collect()} == {"empty": 2, "too_long": 1, "invalid_bbox": 4, "valid": 1}


def test_length_profile_is_nearest_rank(spark):
    values = [0, 0] + [random.Random(1).randrange(1, 40) for _ in range(77)]
    row = report.length_profile(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()
    kept = sorted(v for v in values if v)
    assert (row.labels, row.empty, row.p95, row.p99, row.longest, row.over) == (77, 2, kept[round(0.95 * 76)], kept[round(0.99 * 76)], kept[-1], sum(v > 25 for v in kept))
    assert report.length_profile(spark.createDataFrame([], "v int"), "v").first().labels == 0


def test_cited_lines(spark):
    facts = spark.createDataFrame([(1, "f", [2, 9]), (1, "g", [])], "p int, fact string, ids array<int>")
    frame = spark.createDataFrame([(1, 2, "zwei"), (1, 3, "drei")], "p int, line_id int, text string")
    assert [tuple(r) for r in summary.cited_lines(facts, frame, ["p"], "ids", "line_id").collect()] == [(1, 2, "f", "zwei")]
