"""Boxes: crop rectangles, boxes of polygons, projection through a homography. Built-in arithmetic only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(*values: Column) -> Column:
    test = F.lit(True)
    for v in values:
        test = test & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return test


def crop_rectangle(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column, padding: float = 0.06) -> Column:
    """struct(left, top, right, bottom) of a padded crop within the image, or null.

    Null for values that are missing, not finite, or sides below 2, and for crops of less than 2 pixels. Padding is at
    least 2 and rounds half to even.
    """
    x, y, width, height = (v.cast("double") for v in (x, y, width, height))
    pad = lambda side: F.greatest(F.lit(2), F.bround(side * padding).cast("long"))
    left, top = (F.greatest(F.lit(0), F.floor(a).cast("long") - pad(s)) for a, s in ((x, width), (y, height)))
    right = F.least(image_width.cast("long"), F.ceil(x + width).cast("long") + pad(width))
    bottom = F.least(image_height.cast("long"), F.ceil(y + height).cast("long") + pad(height))
    fits = finite(x, y, width, height) & (width >= 2) & (height >= 2)
    return F.when(fits, F.when((right - left >= 2) & (bottom - top >= 2), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))))


def polygon_box(points: Column) -> Column:
    """struct(x, y, width, height) around points (array of arrays of two numbers); sides of at least 1."""
    xs, ys = F.transform(points, lambda p: p[0].cast("double")), F.transform(points, lambda p: p[1].cast("double"))
    x, y = F.floor(F.array_min(xs)), F.floor(F.array_min(ys))
    side = lambda v, low: F.greatest(F.lit(1), F.ceil(F.array_max(v)) - low)
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side(xs, x).cast("int").alias("width"), side(ys, y).cast("int").alias("height"))


def project_box(x: Column, y: Column, width: Column, height: Column, matrix: list[float], image_width: int, image_height: int, digits: int = 6) -> Column:
    """The box around a box's corners after a homography (row-major 3 x 3), floored, ceiled and clamped to the image."""
    a, b, c, d, e, f, g, h, i = (F.lit(float(v)) for v in matrix)
    corners = [(x, y), (x + width, y), (x + width, y + height), (x, y + height)]
    scale = [g * u + h * v + i for u, v in corners]
    xs = [F.round((a * u + b * v + c) / s, digits) for (u, v), s in zip(corners, scale, strict=True)]
    ys = [F.round((d * u + e * v + f) / s, digits) for (u, v), s in zip(corners, scale, strict=True)]
    clamp = lambda v, most: F.greatest(F.lit(0), F.least(F.lit(most), v.cast("long")))
    left, top = clamp(F.floor(F.least(*xs)), image_width - 1), clamp(F.floor(F.least(*ys)), image_height - 1)
    right, bottom = clamp(F.ceil(F.greatest(*xs)), image_width), clamp(F.ceil(F.greatest(*ys)), image_height)
    return F.struct(left.alias("x"), top.alias("y"), F.greatest(F.lit(1), right - left).cast("long").alias("width"), F.greatest(F.lit(1), bottom - top).cast("long").alias("height"))


def percent_box(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """struct(left, top, width, height) of a box as percentages of its image, for overlays; null for an empty image."""
    share = lambda v, whole: F.round(F.try_divide(100.0 * v, whole), 4)
    return F.struct(share(x, image_width).alias("left"), share(y, image_height).alias("top"), share(width, image_width).alias("width"), share(height, image_height).alias("height"))
