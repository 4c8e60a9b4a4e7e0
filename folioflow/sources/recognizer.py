"""Recognition engines behind one small protocol, run where the images are."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

LINE_SCHEMA = "line_id int, text string, confidence double, x int, y int, width int, height int"


class Recognizer(Protocol):
    def lines(self, data: bytes, height: int, width: int, channels: int) -> list[tuple[str, float, int, int, int, int]]: ...


def recognize(images: DataFrame, key: str, build: Callable[[], Recognizer]) -> DataFrame:
    """(key, line fields) of all images. ``build`` makes an engine once per task; images without lines give no row."""
    kind = images.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = build()
        for frame in frames:
            rows = []
            for k, data, h, w, c in zip(frame["key"], frame["data"], frame["height"], frame["width"], frame["nChannels"], strict=True):
                rows += [(k, i, *line) for i, line in enumerate(engine.lines(data, h, w, c), 1)]
            yield pd.DataFrame(rows, columns=[key, "line_id", "text", "confidence", "x", "y", "width", "height"])

    return images.select(F.col(key).alias("key"), "data", "height", "width", "nChannels").mapInPandas(run, f"`{key}` {kind}, {LINE_SCHEMA}")


@F.pandas_udf(ArrayType(StringType()))
def nfc_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda each: None if each is None else [None if t is None else unicodedata.normalize("NFC", t) for t in each])


def result_payload(result: Column) -> Column:
    """The part of a detector's JSON result that holds its arrays: under ``res``, or the whole."""
    return F.coalesce(F.get_json_object(result, "$.res"), result)


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Lines of the primary engine, or of the other where the primary has none; ``engine`` tells which."""
    spare = fallback.join(primary.select(key).distinct(), key, "left_anti")
    return primary.withColumn("engine", F.lit("primary")).unionByName(spare.withColumn("engine", F.lit("fallback")))


def detector_lines(texts: Column, scores: Column, boxes: Column) -> Column:
    """Parallel detector arrays as line structs: trimmed texts in NFC without empty ones, scores as percent (0 to 100).

    A text without a score has 0.
    """
    line = lambda z: F.struct(F.trim(z["0"]).alias("text"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(z["1"], F.lit(0.0)) * 100)), 2).alias("confidence"), z["2"].alias("box"))
    zipped = F.zip_with(F.arrays_zip(nfc_each(texts).alias("a"), scores.alias("b")), boxes, lambda p, b: F.struct(p["a"].alias("0"), p["b"].alias("1"), b.alias("2")))
    return F.filter(F.transform(zipped, line), lambda x: x["text"] != "")
