from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import pixels
from folioflow.operators import experiments, images
from folioflow.plans import analysis


def test_profiles_and_runs(spark):
    assert experiments.profiles(spark).count() == 10
    made = experiments.runs(spark.range(3), experiments.profiles(spark, ["paddle", "paddle_native_order", "baseline"])).collect()
    assert len(made) == 9 and len({(r.shared) for r in made}) == 2
    with pytest.raises(ValueError):
        experiments.profiles(spark, ["nothing"])


def test_photo_cases_rotate_light(spark):
    frame = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("b", "1")], "archive string, template string")
    cases = experiments.photo_cases(frame, "archive", "template", 2)
    got = {(r.archive, r.template, r.deformation): r.light for r in cases.collect()}
    assert len(got) == 18
    for place, (archive, template) in enumerate([("a", "1"), ("a", "2"), ("b", "1")]):
        assert [got[archive, template, d] for d in experiments.DEFORMATIONS] == [experiments.LIGHTS[(place + i) % 3] for i in range(6)]
    files = spark.createDataFrame([("x/1/warped_document_curled_color.jpg",), ("x/1/other.jpg",)], "path string")
    named = experiments.by_file_name(cases, files, "file", "path").collect()
    assert {(r.deformation, r.light) for r in named} == {("curled", "color")} and "1-curled-color" in {r.case_id for r in named}


def test_stage_graph(spark, tmp_path):
    folder, ran = str(tmp_path / "run"), []
    stages = {"c": (["a", "b"], lambda a, b: a.union(b)), "a": ([], lambda: spark.range(3)), "b": (["a"], lambda a: a.selectExpr("id + 10 as id"))}
    assert experiments.run_stages(folder, 1, stages, "x") == ["a", "b", "c"] and spark.read.parquet(f"{folder}/c").count() == 6
    assert experiments.run_stages(folder, 1, stages, "x") == [] and experiments.run_stages(folder, 1, stages, "y") == ["a", "b", "c"]
    (tmp_path / "run" / "b" / "_SUCCESS").unlink()
    assert experiments.run_stages(folder, 1, stages, "y") == ["b", "c"]
    with pytest.raises(ValueError):
        experiments.run_stages(folder, 1, {"a": (["z"], lambda z: z)})


def test_generations_of_other_data(spark):
    frame = spark.createDataFrame([("x", 200, 1, 0, True, "p"), ("y", 300, 1, 0, True, None), ("w", 100, 0, 0, True, "q")], "name string, global_step int, epoch int, recovery_step int, complete boolean, data_fingerprint string")
    assert experiments.latest_complete(frame, "p").first().name == "x" and experiments.latest_complete(frame, "z").count() == 0


def test_generations(spark):
    frame = spark.createDataFrame([("x", 200, 1, 0, True), ("y", 300, 1, 0, True), ("z", 400, 1, 0, False), ("w", 100, 0, 0, True)], "name string, global_step int, epoch int, recovery_step int, complete boolean")
    assert experiments.latest_complete(frame).first().name == "y"
    assert [r.name for r in experiments.superseded(frame, 2).collect()] == ["w"]
    assert experiments.latest_complete(frame.limit(0)).count() == 0


def test_stages_run_once(spark, tmp_path):
    folder = str(tmp_path / "stage")
    assert experiments.run_stage(folder, 1, spark.range(3)) and not experiments.run_stage(folder, 1, spark.range(3))
    assert experiments.run_stage(folder, 2, spark.range(4)) and spark.read.parquet(folder).count() == 4


def test_pixels():
    rng = np.random.default_rng(1)
    page = np.where(rng.random((60, 90)) < 0.1, 10, 230).astype(np.uint8)
    lit = np.clip(page * np.linspace(0.5, 1, 90), 0, 255).astype(np.uint8)
    assert pixels.illumination_variation(lit) > pixels.illumination_variation(page)
    assert pixels.illumination_variation(pixels.normalize_illumination(lit)) < pixels.illumination_variation(lit)
    for name in ("clean", "camera", "scan", "normalized"):
        a, b = pixels.variant(page, name, "k"), pixels.variant(page, name, "k")
        assert a.shape == page.shape and a.dtype == np.uint8 and (a == b).all()
    assert (pixels.variant(page, "camera", "k") != pixels.variant(page, "camera", "other")).any()
    assert pixels.crop(page, 2, 3, 12, 9).shape == (6, 10)
    corners = np.array([[70, 50], [10, 5], [75, 8], [8, 52]])
    assert pixels.order_corners(corners).tolist() == [[10, 5], [75, 8], [70, 50], [8, 52]]
    assert (pixels.rectify(page, np.array([[0, 0], [89, 0], [89, 59], [0, 59]]))[:58, :88] == page[:58, :88]).mean() > 0.5
    with pytest.raises(ValueError):
        pixels.variant(page, "nothing", "k")


def test_equalisation_and_thresholds():
    rng = np.random.default_rng(2)
    page = np.where(rng.random((90, 130)) < 0.15, 120, 150).astype(np.uint8)
    even = pixels.equalized(page)
    assert even.shape == page.shape and even.dtype == np.uint8 and even.std() > page.std()
    assert (np.argsort([even[page == 120].mean(), even[page == 150].mean()]) == [0, 1]).all()
    inked = np.where(page == 120, 20, 240).astype(np.uint8)
    assert set(np.unique(pixels.binarized(inked))) == {0, 255} and ((pixels.binarized(inked) == 0) == (inked == 20)).mean() > 0.99
    assert pixels.equalized(page[:3, :5]).shape == (3, 5) and pixels.binarized(page[:2, :2]).shape == (2, 2)
    small = pixels.area_resize(page, 16, 16)
    assert small.shape == (16, 16) and small.mean() == pytest.approx(page.mean())
    assert pixels.area_resize(np.array([[0, 30, 60]]), 1, 2).tolist() == [[10.0, 50.0]]


def photographed():
    ground = np.full((200, 260), 30, np.uint8)
    y, x = np.mgrid[0:200, 0:260]
    page = (y > 20 + x * 0.05) & (y < 180 - x * 0.03) & (x > 30 + y * 0.04) & (x < 230 - y * 0.05)
    ground[page] = 225
    ground[60:64, 80:180] = 40
    return ground


def test_corners_of_a_page():
    photo = photographed()
    corners = pixels.order_corners(pixels.page_corners(photo))
    assert np.abs(corners - [[32, 22], [228, 32], [221, 173], [37, 178]]).max() < 6
    assert pixels.page_corners(np.full((80, 90), 200, np.uint8)) is None
    assert pixels.page_corners(np.where(np.random.default_rng(1).random((80, 90)) < 0.5, 10, 240).astype(np.uint8)) is None


def test_png_is_read_back():
    import struct
    import zlib

    page = photographed()
    data, at, parts = pixels.png(page), 8, {}
    while at < len(data):
        size, name = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        parts[name], at = data[at + 8 : at + 8 + size], at + 12 + size
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(200, 261)
    assert struct.unpack(">II", parts[b"IHDR"][:8]) == (260, 200) and (lines[:, 1:] == page).all()


def test_crops_and_photo_variants(spark, tmp_path):
    page = photographed()
    bgr = np.repeat(page[..., None], 3, 2)
    pages = spark.createDataFrame([("a", bytearray(page.tobytes()), 200, 260, 1, "x"), ("b", bytearray(bgr.tobytes()), 200, 260, 3, "x"), ("c", bytearray(page.tobytes()), 200, 260, 1, "x")], "doc string, data binary, height int, width int, nChannels int, label string")
    rows = [("a", 1, "eins", 70, 50, 190, 80, "clean", "k"), ("a", 2, "zwei", -5, 190, 40, 900, "camera", "k"), ("b", 3, "drei", 70, 50, 190, 80, "camera_filtered", "k"), ("b", 4, None, 300, 5, 310, 9, "clean", "k"), ("z", 5, "x", 1, 1, 9, 9, "clean", "k")]
    samples = spark.createDataFrame(rows, "doc string, s long, label string, left long, top long, right long, bottom long, variant string, seed string")
    got = {r.s: r for r in images.cropped(pages, samples, "doc", "s", png=False).collect()}
    assert set(got) == {1, 2, 3} and (got[1].height, got[1].width, got[2].height, got[2].width) == (30, 120, 10, 40) and got[1].label == "eins"
    assert bytes(got[1].pixels) == page[50:80, 70:190].tobytes() and len(got[3].pixels) == 30 * 120
    images.write_crops(images.cropped(pages, samples, "doc", "s"), str(tmp_path / "crops"))
    assert spark.read.parquet(str(tmp_path / "crops")).filter("variant = 'camera'").first().label == "zwei"
    made = {(r.doc, r.variant): r for r in images.photo_variants(pages, "doc").collect()}
    assert len(made) == 15 and bytes(made["a", "raw"].pixels) == page.tobytes() == bytes(made["b", "paddle_unwarp"].pixels)
    assert made["a", "perspective"].rectified and made["a", "perspective"].width < 220 and not made["a", "perspective"].illumination_normalized
    assert made["a", "illumination"].illumination_normalized and not made["a", "illumination"].rectified and made["a", "combined"].rectified
    with pytest.raises(ValueError):
        images.photo_variants(pages, "doc", ["other"])


def test_analysis_of_good_and_blank_pages(spark):
    class Fake:
        def lines(self, data, height, width, channels):
            return [("신청 기간", 90.0, 0, 50, 20, 10), ("제목", 80.0, 0, 5, 20, 10)]

    rng = np.random.default_rng(0)
    good = np.where(rng.random((120, 160)) < 0.1, 20, 240).astype(np.uint8)
    rows = [("good", bytearray(good.tobytes()), 120, 160, 1, "x"), ("blank", bytearray(np.full((120, 160), 255, np.uint8).tobytes()), 120, 160, 1, "x")]
    frame = spark.createDataFrame(rows, "id string, data binary, height int, width int, nChannels int, text string")
    got = {r.id: r for r in analysis.analyze(frame, "id", Fake).collect()}
    assert got["good"].title == "제목" and got["good"].text == "제목\n신청 기간" and got["good"].coverage == 100.0 and got["good"].error_code is None
    assert got["blank"].status == "retake" and got["blank"].text is None and got["blank"].error_code is None
    compared = {(r.branch, r.metric): r.value for r in analysis.compare(frame, "id", {"one": Fake, "two": Fake}).collect()}
    assert compared["one", "characters"] == compared["two", "characters"] == 6.0
    assert frame.select(F.lit(1)).count() == 2
