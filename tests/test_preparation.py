"""Manifests, indexes and training samples over small tables; evaluation against plain Python."""

from __future__ import annotations

import json
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.operators import evaluation, preparation

MEMBERS = "zip_path string, member_path string, kind string, label_id string"


def label(name=None, notes=(), **more):
    image = {} if name is None else {"image.file.name": name}
    return json.dumps({"images": [image | more], "annotations": list(notes)}, ensure_ascii=False)


def note(text, box, i=1):
    return {"id": i, "annotation.text": text, "annotation.bbox": box}


def corpus(spark):
    members = [("i.zip", f"img/a/p{i}.jpg", "image", "x") for i in range(20)] * 2
    members += [("i.zip", "img/b/p1.jpg", "image", "x"), ("i.zip", "img/c/only.jpg", "image", "x"), ("j.zip", "img/c/only.jpg", "image", "x"), ("i.zip", "lab/a/p1.json", "label", "x"), (None, None, "image", None)]
    good = [note("가", [1, 1, 5, 5]), note("", [1, 1, 5, 5]), note("나", [1, 1, 0, 5]), note("다", "x"), note("x" * 26, [1, 1, 5, 5]), None, 3]
    records = [(i, "l.zip", f"lab/a/p{i}.json", label(f"p{i}.jpg", good, **{"image.category": "c"})) for i in range(20)]
    records += [(100, "l.zip", "lab/b/P1.json", label("p1.jpg")), (101, "l.zip", "lab/z/q.json", label("dir/only.jpg")), (102, "l.zip", "lab/z/none.json", label("gone.jpg")), (103, "l.zip", "lab/z/bad.json", "{"),
                (104, "l.zip", "lab/z/empty.json", '{"images": []}'), (105, "l.zip", "lab/a/p2.json", label("p2.jpg")), (106, None, None, None), (107, "l.zip", "lab/z/list.json", "[1]"), (108, "l.zip", "lab/z/odd.json", '{"images": [3]}')]
    return spark.createDataFrame([(*r, "x") for r in records], "label_id long, label_zip string, label_member string, payload string, image string"), spark.createDataFrame(members, MEMBERS)


def test_manifest_of_paired_labels(spark):
    records, members = corpus(spark)
    examined = preparation.examined_labels(records, members)
    outcome = {r.label_member: r.outcome for r in examined.collect()}
    assert Counter(outcome.values()) == {"paired": 22, "missing_image": 1, "invalid_label": 3, "no_image_record": 2}
    rows = {r.label_member: r for r in preparation.build_manifest(examined, "training").collect()}
    assert rows["lab/a/p1.json"].id == "p1" and rows["lab/b/P1.json"].id == "b__p1" and rows["lab/z/q.json"].id == "only"
    assert rows["lab/b/P1.json"].image_member == "img/b/p1.jpg" and rows["lab/z/q.json"].image_zip == "i.zip" and rows["lab/z/q.json"].category == "unknown"
    assert (rows["lab/a/p3.json"].annotation_count, rows["lab/a/p3.json"].sample_count) == (7, 1) and (rows["lab/z/q.json"].annotation_count, rows["lab/z/q.json"].sample_count) == (0, 0)
    assert Counter(r.dataset_split for r in rows.values() if r.category == "c") == {"train": 18, "dev": 2}
    final = preparation.build_manifest(examined, "validation").collect()
    assert {(r.dataset_split, *r.splits) for r in final} == {("final", "final")}
    report = {r.measure: r.n for r in preparation.build_report(examined, members).collect()}
    assert report == {"paired": 22, "missing_image": 1, "invalid_label": 3, "no_image_record": 2, "labels_seen": 28, "images_indexed": 22, "ambiguous_names": 1}
    assert [r.label_member for r in preparation.build_examples(examined, "missing_image").collect()] == ["lab/z/none.json"]
    with pytest.raises(ValueError):
        preparation.build_manifest(examined, "other")
    with pytest.raises(Exception, match="repeated"):
        preparation.examined_labels(records, members.union(spark.createDataFrame([("k.zip", "other/a/p1.png", "image", "x")], MEMBERS)), strict=True).collect()
    assert preparation.build_manifest(preparation.examined_labels(records.limit(0), members.limit(0)), "training").count() == 0


def test_indexes_hold_the_contract(spark):
    rows = [(i, f"d{i}", "c", "training", "dev" if i % 4 == 0 else "train", i % 3) for i in range(24)]
    frame = spark.createDataFrame(rows, "k long, id string, category string, source_split string, dataset_split string, sample_count int")
    made = preparation.sample_indexes(preparation.checked_index_rows(frame), "k", 3).collect()
    train = sorted((r.first, r.end, r.k) for r in made if r.part == "train")
    assert [k for *_, k in train] == [i for i in range(24) if i % 4 and i % 3] and all(a[1] == b[0] for a, b in zip(train, train[1:]))
    assert 3 <= max(r.end for r in made if r.part == "dev") <= 4
    for bad in ((90, "d90", "c", "validation", "final", 1), (90, "d90", "c", "training", None, 1), (90, "d90", "c", "training", "dev", -1), (90, "d1", "c", "training", "dev", 1)):
        with pytest.raises(Exception, match="no training row|repeated"):
            preparation.checked_index_rows(frame.union(spark.createDataFrame([bad], frame.schema))).collect()


def test_training_samples(spark):
    notes = [("a", 1, 2, ("zwei", [10.0, 10, 20, 20])), ("a", 2, 1, ("eins", [1.0, 1, 20, 20])), ("a", 2, 1, ("eins", [1.0, 1, 20, 20])), ("a", 3, 3, ("", [1.0, 1, 20, 20])), ("b", 4, None, ("drei", [5.0, 5, 9, 9])), (None, 5, 1, ("x", None))]
    notes = [(d, k, i, (t, box and [float(v) for v in box])) for d, k, i, (t, box) in notes]
    frame = spark.createDataFrame(notes, "document_id string, ann_key long, id int, annotation struct<text:string,bbox:array<double>>")
    keyed = preparation.numbered_samples(frame, "document_id").withColumn("key", F.when(F.col("document_id") == "a", 1).otherwise(2))
    asked = spark.createDataFrame([(0,), (1,), (2,), (3,)], "n long")
    got = sorted((r.n, r.document_id, r.label) for r in preparation.training_samples(asked, "n", keyed, "document_id", "key", 1).collect())
    assert got == [(0, "a", "eins"), (1, "a", "zwei"), (2, "b", "drei")]
    seeds = [{r.n: r.seed for r in preparation.training_samples(asked, "n", keyed, "document_id", "key", e).collect()} for e in (1, 1, 2)]
    assert seeds[0] == seeds[1] != seeds[2]
    assert {r.variant for r in preparation.training_samples(asked, "n", keyed, "document_id", "key", 1, train=False).collect()} == {"clean"}
    assert [r.document_id for r in preparation.not_subset(frame, spark.createDataFrame([("a",), (None,)], "document_id string"), "document_id").collect()] == ["b"]


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(last[j] + 1, new[-1] + 1, last[j - 1] + (x != y)))
        last = new
    return last[-1]


def test_measures_agree_with_plain_python(spark):
    texts = [("한글 문서 2024.5", "한글 문셔 2024.5"), ("가나 다", ""), ("", "가"), (None, None), ("a b", "a b c d e f g h"), ("신청 3,000원", "신청3,000원 신청"), ("각", "\u1100\u1161\u11a8")]
    frame = spark.createDataFrame([(i, *t, "x") for i, t in enumerate(texts)], "i int, reference string, hypothesis string, matched string")
    rate = lambda d, n, m: (0.0 if not m else 1.0) if not n else round(d / n, 4)
    for r in evaluation.measured(frame.drop("matched"), ["i"]).collect():
        a, b = (unicodedata.normalize("NFC", t or "") for t in texts[r.i])
        x, y = "".join(a.split()), "".join(b.split())
        assert r.cer == rate(plain_distance(x, y), len(x), len(y)) and r.wer == rate(plain_distance(a.split(), b.split()), len(a.split()), len(b.split()))
        own, there = Counter(a.split()), Counter(b.split())
        if r.i in (0, 1, 4):
            assert r.matched_words == (own & there).total() + (r.i == 0) * 1
        assert r.output_reference_length_ratio == (round(len("".join((texts[r.i][1] or "").split())) / len("".join((texts[r.i][0] or "").split())), 3) if x else 0.0)
        assert r.alignment_review_required == (r.cer > 1 and r.output_reference_length_ratio >= 2)


def test_pages_are_joined_in_order(spark):
    lines = spark.createDataFrame([(1, 2, "b", 50.0), (1, 1, "aaa", 90.0), (1, 3, None, 10.0)], "p int, line_id int, text string, confidence double")
    row = evaluation.recognized_text(lines, ["p"]).first()
    assert (row.hypothesis, row.lines) == ("aaa\nb\n", 3) and row.model_confidence == round((3 * 90 + 50 + 10) / 5, 2)


def test_summaries(spark):
    texts = ['{"annotation":{"corrected_summary":{"corrected_type5":{"errors":[{"type":"x"},{"type":"y"}]},"corrected_all":{"text":"t"}}}}', '{"annotation":{"corrected_summary":null}}', "{}", None, '{"annotation":{"corrected_summary":{"corrected_all":{"text":""}}}}']
    got = preparation.summary_rows(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string"), "p").orderBy("i").collect()
    assert [(r.error_count, r.has_corrected_all) for r in got] == [(2, True), (0, False), (0, False), (0, False), (0, False)]
