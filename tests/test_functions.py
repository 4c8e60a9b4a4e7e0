from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from folioflow.functions import geometry, hashing, ids, metrics, text


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'array<double>'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "axc", 1 / 3), ("가나다", "가나", 1 / 3), ("", "", 0.0), (None, "x", 1.0), ("a b", "ab", 0.0), ("a", "bcd", 3.0)])
def test_character_error_rate(spark, a, b, want):
    assert one(spark, metrics.character_error_rate(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


@pytest.mark.parametrize(("a", "b", "want"), [("one two three", "one 2 three", 1 / 3), ("", "", 0.0), ("x", "", 1.0), ("a a b", "a b", 1 / 3)])
def test_word_error_rate(spark, a, b, want):
    frame = spark.createDataFrame([(a, b)], "a string, b string").select(text.words(F.col("a")).alias("a"), text.words(F.col("b")).alias("b"))
    assert frame.select(metrics.word_error_rate(F.col("a"), F.col("b")).alias("x")).first().x == pytest.approx(want)


def test_token_distance_fails_beyond_its_characters(spark, monkeypatch):
    frame = spark.createDataFrame([(["a", "b"], ["a", "c"])], "a array<string>, b array<string>")
    monkeypatch.setattr(metrics, "MOST_TOKENS", 3)
    assert frame.select(metrics.token_distance(F.col("a"), F.col("b"))).first()[0] == 1
    monkeypatch.setattr(metrics, "MOST_TOKENS", 2)
    with pytest.raises(Exception, match="distinct tokens"):
        frame.select(metrics.token_distance(F.col("a"), F.col("b"))).collect()


def test_multiset_scores(spark):
    rows = [(1, "Alpha beta", "BETA alpha"), (2, "x x y", "x y"), (3, "", ""), (4, "a", None), (5, None, "b"), (6, "ß", "SS")]
    got = {r.k: (r.precision, round(r.recall, 4), round(r.f1, 4)) for r in metrics.word_scores(spark.createDataFrame(rows, "k int, a string, b string"), ["k"], "a", "b").collect()}
    assert got == {1: (1, 1, 1), 2: (1, 0.6667, 0.8), 3: (1, 1, 1), 4: (0, 0, 0), 5: (0, 0, 0), 6: (1, 1, 1)}
    numbers = metrics.numeric_scores(spark.createDataFrame([(1, "2024-01-02 및 5.5%", "5.5% 2024-01-02")], "k int, a string, b string"), ["k"], "a", "b").first()
    assert (numbers.f1, numbers.references) == (1.0, 2)


def test_score_bundle(spark):
    row = metrics.score_bundle(spark.createDataFrame([(1, "a b 3", "a b 3", 12.345)], "k int, a string, b string, ms double"), ["k"], "a", "b", "ms").first()
    assert (row.cer, row.wer, row.word_f1, row.numeric_f1, row.characters) == (0, 0, 1, 1, 3)


def test_normal_forms(spark):
    assert one(spark, text.label_text(F.col("a")), a=unicodedata.normalize("NFD", " 한글\t 둘 ")) == "한글 둘"
    assert one(spark, text.label_text(F.col("a")), a=None) == ""
    assert one(spark, text.alphanumeric_tokens(F.col("a")), a="가나 Ａb_c-１") == ["가나", "ab", "c", "1"]
    assert one(spark, text.markdown_text(F.col("a")), a="# T\n![i](u) [link](u) <b>x</b>\n```\ncode\n```\n- *it*") == "T link x it"
    assert one(spark, text.valid_ratio(F.col("a")), a="가a1. ☃") == pytest.approx(0.8)
    assert one(spark, text.valid_ratio(F.col("a")), a="  ") == 0


def test_identifiers(spark):
    for spelled in ("ab12-000000001-p003", "AB12_000000001_P003", "ab12000000001p003", "ＡＢ12-000000001-p003"):
        assert one(spark, ids.volume_key(F.col("a")), a=spelled) == "ab12000000001"
    assert one(spark, ids.page_key(F.col("a")), a=" - ") is None


def test_crop_rectangle(spark):
    crop = lambda *b: one(spark, geometry.crop_rectangle(*(F.col(c) for c in "abcd"), F.lit(50), F.lit(30), 0.1), a=b[0], b=b[1], c=b[2], d=b[3])
    assert tuple(crop(0.0, 0.0, 20.0, 10.0)) == (0, 0, 22, 12)
    assert tuple(crop(40.0, 20.0, 20.0, 10.0)) == (38, 18, 50, 30)
    assert crop(0.0, 0.0, 1.0, 10.0) is None and crop(float("nan"), 0.0, 20.0, 10.0) is None and crop(90.0, 0.0, 20.0, 10.0) is None


def test_boxes(spark):
    frame = spark.createDataFrame([([[3.2, 6.9], [85.0, 6.5], [84.1, 26.0], [3.9, 25.1]],)], "p array<array<double>>")
    assert tuple(frame.select(geometry.polygon_box(F.col("p")).alias("x")).first().x) == (3, 6, 82, 20)
    same = geometry.project_box(*(F.lit(v) for v in (10.0, 20.0, 30.0, 5.0)), [1, 0, 0, 0, 1, 0, 0, 0, 1], 100, 100)
    assert tuple(spark.range(1).select(same.alias("x")).first().x) == (10, 20, 30, 5)


def test_fingerprint_ignores_order_but_counts_repeats(spark):
    print_of = lambda rows: hashing.table_fingerprint(spark.createDataFrame(rows, "a int, b string")).first().fingerprint
    assert print_of([(1, "x"), (2, None)]) == print_of([(2, None), (1, "x")])
    assert len({print_of([(1, "x")]), print_of([(1, "x")] * 2), print_of([(1, None)]), print_of([(1, "")]), print_of([])}) == 5


def test_percent_boxes_and_results(spark):
    box = geometry.percent_box(*(F.lit(v) for v in (10, 20, 30, 40)), F.lit(200), F.lit(400))
    assert tuple(spark.range(1).select(box.alias("x")).first().x) == (5.0, 5.0, 15.0, 10.0)
    assert one(spark, text.result_text(F.col("a")), a='{"markdown_texts": ["# a", "b"]}') == "# a\nb"
    assert one(spark, text.result_text(F.col("a")), a='{"markdown_texts": "x"}') == "x"
    assert one(spark, text.result_text(F.col("a")), a="plain") == "plain"


def test_settings():
    from folioflow.settings import Settings, unquoted

    assert unquoted(" 'x' ") == "x" and unquoted('"') == '"'
    got = Settings.load({"FOLIOFLOW_PRIMARY_BIAS": '"2.5"', "FOLIOFLOW_MAX_LABEL_LENGTH": "", "OTHER": "1"})
    assert (got.primary_bias, got.max_label_length) == (2.5, 25)
    with pytest.raises(ValueError):
        Settings.load({"FOLIOFLOW_DEV_FRACTION": "0.7"})
