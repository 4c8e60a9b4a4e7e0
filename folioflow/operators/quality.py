"""Page quality: metrics of grey images as an Arrow UDF, and the verdict over them in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folioflow.functions.pixels import area_resize, equalized, grey, threshold

#: Limits of the verdict, contrast in percent of the full scale (fixed values).
FOREGROUND, FOCUS, CONTRAST = (0.001, 0.70), 80.0, 12.0
#: Reasons in their order (fixed values).
BLANK, BLUR, LOW_CONTRAST = "blank", "blur", "low_contrast"


def reasons(foreground: Column, focus: Column, contrast: Column) -> Column:
    """blank, blur and low_contrast, as far as they apply."""
    blank = (foreground < FOREGROUND[0]) | (foreground > FOREGROUND[1])
    return F.array_compact(F.array(F.when(blank, BLANK), F.when(focus < FOCUS, BLUR), F.when(contrast < CONTRAST, LOW_CONTRAST)))


def verdict(foreground: Column, focus: Column, contrast: Column) -> Column:
    """retake for blank pages and for blurry ones of low contrast, else pass."""
    blank = (foreground < FOREGROUND[0]) | (foreground > FOREGROUND[1])
    return F.when(blank | ((focus < FOCUS) & (contrast < CONTRAST)), "retake").otherwise("pass")


def grey_metrics(page: np.ndarray) -> tuple[float, float, float, float]:
    """(focus, foreground, contrast, illumination) of a grey image (uint8 rows x columns).

    Focus is the variance of the Laplacian and illumination the deviation of 16 x 16 area means over the full scale, both of
    the image as it is. Ink is what lies below Otsu's threshold of the equalised image: foreground is its share, contrast
    the distance of paper and ink means in percent of the full scale.
    """
    g = page.astype(np.float64)
    edge = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    laplacian = edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:] - 4 * g
    even = equalized(page)
    ink = even <= threshold(even) if even.min() < even.max() else np.zeros(even.shape, bool)
    contrast = max(0.0, 100 * (float(even[~ink].mean()) - float(even[ink].mean())) / 255) if ink.any() and not ink.all() else 0.0
    small = area_resize(page, *(max(2, min(16, n)) for n in page.shape))
    return round(float(laplacian.var()), 4), round(float(ink.mean()), 5), round(contrast, 2), round(float(small.std() / 255), 5)


_METRICS = StructType([StructField(n, DoubleType()) for n in ("focus", "foreground", "contrast", "illumination")])


@F.pandas_udf(_METRICS)
def image_metrics(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
    """Metrics of raw images as Spark's image source gives them (BGR, BGRA or grey bytes)."""
    rows = []
    for raw, h, w, c in zip(data, height, width, channels, strict=True):
        rows.append(grey_metrics(grey(np.frombuffer(raw, np.uint8).reshape(h, w, c))))
    return pd.DataFrame(rows, columns=_METRICS.names)
