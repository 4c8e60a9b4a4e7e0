"""Recognised words and lines: grouping, confidence, reading order, candidate scoring and choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import valid_ratio, visible_count


def _weight(text: Column) -> Column:
    return F.greatest(F.lit(1), visible_count(text))


def _weighted_mean(confidence: str, weight: Column) -> Column:
    """Mean of confidences by weight; null for nothing. Summed as decimals, so that the order of rows does not matter."""
    return F.try_divide(F.sum(F.col(confidence).cast("decimal(18,6)") * weight).cast("double"), F.sum(weight))


def words_to_lines(words: DataFrame, keys: list[str], position: str, text: str = "word", confidence: str = "confidence") -> DataFrame:
    """One row a line: text, confidence, x, y, width, height, first position; words in order of position.

    Blank words and negative confidences are dropped. Confidence is weighted by visible characters, two digits.
    """
    used = words.filter((F.trim(F.col(text)) != "") & (F.col(confidence) >= 0))
    w = _weight(F.col(text))
    return used.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda x: x[text]), " ").alias("text"),
        F.round(_weighted_mean(confidence, w), 2).alias("confidence"),
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"),
        (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"), F.min(position).alias("first"),
    )


def weighted_confidence(lines: DataFrame, keys: list[str], text: str = "text", confidence: str = "confidence") -> DataFrame:
    """(keys, n, confidence): confidence weighted by visible characters; 0 for nothing."""
    w = _weight(F.col(text))
    return lines.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.coalesce(_weighted_mean(confidence, w), F.lit(0.0)), 6).alias("confidence"))


def reading_order(boxes: DataFrame, page: list[str], box: str, share: float = 0.55, least: float = 3.0) -> DataFrame:
    """(page, box, row, place): visual rows from top to bottom, within them from left to right; places from 1.

    A fold over the boxes by centre joins each to the row before it if their centres are within a share of the page's
    median height of the row's mean centre. Equals comparing with all rows, since centres ascend.
    """
    item = F.struct((F.col("y") + F.col("height") / 2).alias("c"), F.col("x").alias("x"), F.col(box).alias("id"), F.col("y").alias("y"))
    pages = boxes.groupBy(*page).agg(F.array_sort(F.collect_list(item)).alias("_items"), F.greatest(F.lit(float(least)), F.median(F.greatest(F.lit(1), "height")) * share).alias("_tol"))
    start = F.struct(F.lit(0).alias("row"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("rows"))

    def step(state: Column, x: Column) -> Column:
        joins = (state["n"] > 0) & (F.abs(x["c"] - F.try_divide(state["sum"], state["n"])) <= F.col("_tol"))
        joins = F.coalesce(joins, F.lit(False))
        row = F.when(joins, state["row"]).otherwise(state["row"] + 1)
        return F.struct(
            row.alias("row"), F.when(joins, state["sum"] + x["c"]).otherwise(x["c"]).alias("sum"),
            F.when(joins, state["n"] + 1).otherwise(F.lit(1)).alias("n"), F.concat(state["rows"], F.array(row)).alias("rows"),
        )

    folded = pages.withColumn("_rows", F.aggregate("_items", start, step, lambda s: s["rows"]))
    each = folded.select(*page, F.explode(F.arrays_zip("_items", "_rows")).alias("_z")).select(*page, F.col("_z._items.id").alias(box), F.col("_z._items.x").alias("_x"), F.col("_z._items.y").alias("_y"), F.col("_z._rows").alias("_row"))
    top = each.withColumn("_top", F.min("_y").over(Window.partitionBy(*page, "_row")))
    order = Window.partitionBy(*page).orderBy("_top", "_row", "_x", "_y", box)
    rank = Window.partitionBy(*page).orderBy("_top", "_row")
    return top.select(*page, box, F.dense_rank().over(rank).alias("row"), F.row_number().over(order).alias("place"))


def recognition_score(confidence: Column, ratio: Column, count: Column) -> Column:
    """0.80 confidence + 15 valid ratio + 5 coverage (logarithmic, full at 500 characters), three digits; 0 without text."""
    coverage = F.least(F.lit(1.0), F.log1p(count) / F.log(F.lit(501.0)))
    return F.when(count == 0, 0.0).otherwise(F.round(0.80 * confidence + 15.0 * ratio + 5.0 * coverage, 3))


def score_pages(lines: DataFrame, keys: list[str], text: str = "text", confidence: str = "confidence", order: str = "line_id") -> DataFrame:
    """(keys, characters, valid_ratio, confidence, score) of each page or candidate."""
    w = _weight(F.col(text))
    page = lines.groupBy(*keys).agg(
        F.round(F.coalesce(_weighted_mean(confidence, w), F.lit(0.0)), 6).alias("confidence"),
        F.sum(visible_count(F.col(text))).alias("characters"), F.sum(valid_ratio(F.col(text)) * visible_count(F.col(text))).alias("_valid"),
    )
    ratio = F.coalesce(F.try_divide(F.col("_valid"), F.col("characters")), F.lit(0.0))
    return page.select(*keys, "characters", F.round(ratio, 6).alias("valid_ratio"), "confidence", F.round(recognition_score(F.col("confidence"), ratio, F.col("characters")), 3).alias("score"))


#: Advantage of the primary strategy in choosing (fixed value).
PRIMARY_BIAS = 3.0


def choose_candidate(candidates: DataFrame, keys: list[str], strategy: str, score: str, ordinal: str, primary: str, bias: float = PRIMARY_BIAS) -> DataFrame:
    """Each key's best candidate; the primary strategy's score counts ``bias`` more, the first of equal ones wins."""
    adjusted = F.col(score) + F.when(F.col(strategy) == primary, bias).otherwise(0.0)
    best = Window.partitionBy(*keys).orderBy(adjusted.desc(), F.col(ordinal))
    return candidates.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank").withColumn("adjusted", adjusted)


#: Limits of extra recognition runs: score, sparse foreground, uneven light, strongly uneven light (fixed values).
DIFFICULT, SPARSE, UNEVEN, VERY_UNEVEN = 72.0, 0.035, 0.055, 0.075


def extra_strategies(score: Column, foreground: Column, illumination: Column) -> Column:
    """Strategies to run besides the primary one, in order: normalized, sparse or block, binary."""
    hard = score < DIFFICULT
    return F.array_compact(F.array(
        F.when(hard | (illumination >= UNEVEN), "normalized"),
        F.when(hard, F.when(foreground <= SPARSE, "sparse").otherwise("block")),
        F.when(hard & (illumination >= VERY_UNEVEN), "binary"),
    ))
