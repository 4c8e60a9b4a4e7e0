"""Pixels in tables: crops of pages, their variants, prepared photos. One Arrow pass where the page's bytes are.

Pages come as Spark's image source gives them (data, height, width, nChannels: BGR, BGRA or grey bytes). Pixels leave as
grey bytes with their size, and as PNG where they are to be written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import pixels
from folioflow.operators.experiments import VARIANTS

_IMAGE = ("data", "height", "width", "nChannels")


def _grey(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for data, h, w, c in zip(*(batch.column(n).to_pylist() for n in _IMAGE), strict=True):
        yield pixels.grey(np.frombuffer(data, np.uint8).reshape(h, w, c))


def cropped(pages: DataFrame, samples: DataFrame, key: str, sample: str, png: bool = True) -> DataFrame:
    """(key, sample, label, variant, height, width, pixels): each sample's crop of its page, in its variant.

    ``samples``: key, sample, label, left, top, right, bottom, variant, seed. A page's samples travel to it as one list, so
    its bytes are moved once. Rectangles are cut to the page; those of which nothing is left give no row, nor do pages
    without samples or samples without a page.
    """
    kind = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    fields = ("label", "left", "top", "right", "bottom", "variant", "seed")
    lists = samples.groupBy(key).agg(F.collect_list(F.struct(F.col(sample).alias("sample"), *fields)).alias("_samples"))
    joined = pages.select(F.col(key), *_IMAGE).join(lists, key).select(F.col(key).alias("key"), *_IMAGE, "_samples")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (page, wanted) in enumerate(zip(_grey(batch), batch.column("_samples").to_pylist(), strict=True)):
                for s in wanted:
                    cut = pixels.crop(page, max(0, s["left"]), max(0, s["top"]), s["right"], s["bottom"])
                    if cut.size:
                        made = pixels.variant(cut, s["variant"], s["seed"])
                        rows.append((i, s["sample"], s["label"], s["variant"], *made.shape, pixels.png(made) if png else made.tobytes()))
            column = lambda n: [r[n] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(column(0), pa.int64())), pa.array(column(1), batch.column("_samples").type.value_type.field("sample").type), pa.array(column(2), pa.string()), pa.array(column(3), pa.string()), pa.array(column(4), pa.int32()), pa.array(column(5), pa.int32()), pa.array(column(6), pa.binary())],
                names=[key, sample, "label", "variant", "height", "width", "pixels"],
            )

    return joined.mapInArrow(run, f"`{key}` {kind[key]}, `{sample}` {kind[sample]}, label string, variant string, height int, width int, pixels binary")


def write_crops(crops: DataFrame, folder: str) -> None:
    """Crops with their labels and sizes as Parquet, a folder a variant: many small images to a file, not a file each."""
    crops.write.mode("overwrite").partitionBy("variant").parquet(folder)


def photo_variants(photos: DataFrame, key: str, names: list[str] | None = None, trigger: float = 0.1) -> DataFrame:
    """(key, variant, height, width, pixels, rectified, illumination_normalized, illumination_variation) of each photo.

    A variant that straightens does so where the page's corners are found; one that normalises does where the light
    varies by more than ``trigger`` (always, where it does nothing else). An unknown name is an error.
    """
    known = {name: (rectify, normalize) for name, rectify, normalize in VARIANTS}
    chosen = list(dict.fromkeys(names if names is not None else known))
    if set(chosen) - set(known):
        raise ValueError(f"unknown variants {sorted(set(chosen) - set(known))}")
    kind = photos.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, page in enumerate(_grey(batch)):
                for name in chosen:
                    rectify, normalize = known[name]
                    made, corners = page, pixels.page_corners(page) if rectify else None
                    if corners is not None:
                        made = pixels.rectify(page, corners)
                    varies = pixels.illumination_variation(made) if normalize else None
                    even = normalize and (not rectify or varies > trigger)
                    made = pixels.normalize_illumination(made) if even else made
                    rows.append((i, name, *made.shape, made.tobytes(), corners is not None, even, varies))
            column = lambda n: [r[n] for r in rows]
            types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(column(0), pa.int64())), *(pa.array(column(n), t) for n, t in enumerate(types, 1))],
                names=[key, "variant", "height", "width", "pixels", "rectified", "illumination_normalized", "illumination_variation"],
            )

    return photos.select(F.col(key).alias("key"), *_IMAGE).mapInArrow(run, f"`{key}` {kind}, variant string, height int, width int, pixels binary, rectified boolean, illumination_normalized boolean, illumination_variation double")
