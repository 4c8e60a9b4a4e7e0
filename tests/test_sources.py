from __future__ import annotations

import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folioflow.sources import archives, files, recognizer
from folioflow.streaming import feedback


def png(width, height):
    rows = b"".join(b"\x00" + b"\xff\xff\xff" * width for _ in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "1.Training"
    folder.mkdir()
    with zipfile.ZipFile(folder / "images.zip", "w") as z:
        z.writestr("root/a/x.jpg", b"1")
        z.writestr("root/b/x.jpg", b"2")
        z.writestr("root/3/y.png", b"3")
    with zipfile.ZipFile(folder / "labels.zip", "w") as z:
        z.writestr("root/a/x.json", json.dumps({"images": [{"image.file.name": "x.jpg"}]}))
        z.writestr("root/b/bad.json", "{")
        z.writestr("root/b/list.json", "[]")
        z.writestr("root/b/k.json", json.dumps({"가": 1}, ensure_ascii=False).encode("cp949"))
    (folder / "broken.zip").write_bytes(b"no archive")
    return tmp_path


def test_archives_are_classified_indexed_and_read(spark, corpus):
    listed = archives.archive_files(spark, str(corpus))
    assert {r.s for r in listed.select(archives.split_of("path").alias("s")).collect()} == {"training"}
    found = archives.members(listed, payload=True).cache()
    kinds = {r.archive.rsplit("/", 1)[1]: (r.kind, r.images, r.labels) for r in archives.classify(found).collect()}
    assert kinds == {"images.zip": ("image", 3, 0), "labels.zip": ("label", 0, 4), "broken.zip": ("empty", 0, 0)}
    assert {(r.stem, r.ambiguous) for r in archives.image_index(found).collect()} == {("a/x", True), ("b/x", True), ("3/y", False)}
    read = archives.labels(found)
    assert {r.member: r.readable for r in read.collect()} == {"root/a/x.json": True, "root/b/bad.json": False, "root/b/list.json": False, "root/b/k.json": True}
    assert tuple(archives.label_counts(read).select("labels", "broken").first()) == (4, 2)
    assert [r.template for r in archives.photo_groups(found).collect()] == ["3"]
    with pytest.raises(Exception, match="no JSON object"):
        archives.labels(found, strict=True).collect()
    found.unpersist()


def test_archive_sets(spark):
    rows = [("i", "image", "training"), ("h", "image", "training"), ("l", "label", "training"), ("e", "empty", "training"), ("m", "label", "validation")]
    frame = spark.createDataFrame(rows, "archive string, kind string, split string")
    assert [tuple(r) for r in archives.archive_sets(frame.filter("split = 'training'")).collect()] == [("training", ["h", "i"], ["l"])]
    with pytest.raises(Exception, match="missing in validation"):
        archives.archive_sets(frame).collect()
    with pytest.raises(Exception, match="in one archive: m"):
        archives.archive_sets(frame.withColumn("kind", F.when(F.col("archive") == "m", "mixed").otherwise(F.col("kind")))).collect()
    with pytest.raises(Exception, match="list is empty"):
        files.not_empty(frame.limit(0), "list")
    assert files.not_empty(frame, "list").count() == 5


def test_uploads_and_images(spark, tmp_path):
    for name, data in (("a.png", png(40, 32)), ("b.png", png(8, 8)), ("c.gif", b"x")):
        (tmp_path / name).write_bytes(data)
    codes = {r.path.rsplit("/", 1)[1]: r.error_code for r in archives.uploads(spark, str(tmp_path)).collect()}
    assert codes == {"a.png": None, "b.png": None, "c.gif": 415}
    usable = archives.images(spark, str(tmp_path))
    assert [(r.height, r.width) for r in usable.select("height", "width").collect()] == [(32, 40)]

    class Fake:
        def lines(self, data, height, width, channels):
            return [("line", 90.0, 0, 0, width, height)]

    read = recognizer.recognize(usable.withColumn("id", F.lit("p")), "id", Fake)
    assert tuple(read.first()) == ("p", 1, "line", 90.0, 0, 0, 40, 32)
    merged = recognizer.with_fallback(read.filter("false"), read, "id")
    assert merged.first().engine == "fallback"


def test_detector_arrays(spark):
    frame = spark.createDataFrame([([" 가 ", " ", "b"], [0.9234, 0.5, 1.2], [[1], [2], [3]])], "t array<string>, s array<double>, b array<array<int>>")
    got = frame.select(recognizer.detector_lines(F.col("t"), F.col("s"), F.col("b")).alias("x")).first().x
    assert [(x.text, x.confidence, x.box) for x in got] == [("가", 92.34, [1]), ("b", 100.0, [3])]


def test_manifest_files(spark, tmp_path):
    rows = spark.createDataFrame([("b", ["smoke"], None), ("a", ["smoke", "x"], "z"), ("c", [], "z")], "id string, splits array<string>, category string")
    files.write_manifest(rows, str(tmp_path / "m"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "m")).collect())
    assert lines[0] == '{"category":"z","id":"a","splits":["smoke","x"]}'
    back = files.read_manifest(spark, str(tmp_path / "m"))
    assert back.count() == 3 and [r.id for r in files.cases(back, "smoke", 1).collect()] == ["a"]
    (tmp_path / "bad").write_text('{"id": 1\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_manifest(spark, str(tmp_path / "bad")).collect()
    assert files.read_manifest(spark, str(tmp_path / "bad"), strict=False).count() == 0
    files.write_label_lists(spark.createDataFrame([("i.jpg", "a\tb", "clean")], "image string, label string, variant string"), str(tmp_path / "l"))
    assert tuple(files.read_label_list(spark, str(tmp_path / "l/variant=clean")).first()) == ("i.jpg", "a\tb")


def test_reports_and_checksums(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"aggregate": {"n": 1}}')
    (tmp_path / "b.json").write_text('{"aggregate": 3}')
    (tmp_path / "c.json").write_text("{")
    assert [tuple(r) for r in files.read_reports(spark, str(tmp_path)).collect()] == [("a.json", '{"n":1}')]
    assert files.checksums(spark, str(tmp_path)).count() == 3


def test_feedback_stream_keeps_valid_rows_once(spark, tmp_path):
    rows = [{"id": 1, "analysis_id": "a", "accepted": 1, "created_at": "2024-04-11T13:16:35+09:00"}, {"id": 1, "analysis_id": "a", "accepted": 1, "created_at": "2024-04-11T13:16:35+09:00"}, {"id": 2, "analysis_id": "a", "accepted": 0, "created_at": "2024-04-11T13:16:35Z"}, {"id": 3, "analysis_id": "", "accepted": 1, "created_at": "2024-04-11T13:16:35Z"}, {"id": 4, "analysis_id": "b", "accepted": 0, "corrected_text": "x", "created_at": "2024-04-12T00:00:00Z"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    feedback.append_stream(feedback.feedback_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 4]
    files.append_feedback(spark.createDataFrame([(9, "a", 1, None)], "id long, analysis_id string, accepted int, corrected_text string"), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1


def test_roots_and_unique_files(spark, tmp_path):
    folder = tmp_path / "data" / "set" / "2.Validation"
    folder.mkdir(parents=True)
    with zipfile.ZipFile(folder / "a[1].zip", "w") as z:
        z.writestr("x.jpg", b"1")
    assert archives.dataset_root(spark, str(tmp_path / "data")) == f"{tmp_path}/data/set"
    assert archives.dataset_root(spark, str(tmp_path / "data" / "set")) == f"{tmp_path}/data/set"
    assert archives.unique_file(spark, str(tmp_path), "a[1].zip").endswith("set/2.Validation/a[1].zip")
    with pytest.raises(ValueError):
        archives.unique_file(spark, str(tmp_path), "none.zip")
    (tmp_path / "data" / "two" / "valid").mkdir(parents=True)
    (tmp_path / "data" / "two" / "valid" / "b.zip").write_bytes((folder / "a[1].zip").read_bytes())
    with pytest.raises(ValueError):
        archives.dataset_root(spark, str(tmp_path / "data"))


def test_windows_of_a_stream_close_late(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(datetime(2024, 1, 1) + timedelta(hours=h), "a", 1.0) for h in range(60)]
    spark.createDataFrame(rows, "ts timestamp_ntz, kind string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, kind string, value double").parquet(str(tmp_path / "in"))
    counted = feedback.windowed_counts(stream, "ts", "kind", "value")
    counted.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.start.day, r.n) for r in spark.table("closed").collect()) == [(1, 24), (2, 24)]
