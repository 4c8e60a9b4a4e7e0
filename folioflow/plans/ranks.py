"""Exact bottom-k and running totals in hash order without gathering a group in one task.

A group (a source, an arrival batch) may hold a third of all rows, so a window over the whole group is out. Hash
order is cut into 2**bits equal ranges instead: per (group, range) totals are pre-aggregated map-side, the running
total over at most 2**bits rows a group tells which ranges lie wholly below a limit, and only the one range that
the limit falls into is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_BITS = 12


def hash_range(hex_key: Column, bits: int = RANGE_BITS) -> Column:
    """The range number of a lower-case hex digest: its leading ``bits`` bits."""
    digits = (bits + 3) // 4
    return F.shiftright(F.conv(F.substring(hex_key, 1, digits), 16, 10).cast("int"), digits * 4 - bits)


def below_limit(rows: DataFrame, group: list[str], order: list[str], hex_key: str, limits: DataFrame, limit: str, size: str | None = None, bits: int = RANGE_BITS) -> DataFrame:
    """Rows whose preceding total (of ``size``, or of rows) within ``group`` in the order of ``order`` is below ``limit``.

    ``order`` starts with the hex digest column ``hex_key`` and must be total. ``limits`` has one row per group. Adds
    ``preceding``. With unit sizes this is the exact bottom-k; with token sizes the last row may overshoot the limit.
    """
    amount = F.col(size).cast("long") if size else F.lit(1).cast("long")
    rows = rows.withColumn("_range", hash_range(F.col(hex_key), bits))
    totals = rows.groupBy(*group, "_range").agg(F.sum(amount).alias("_total"))
    running = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = totals.withColumn("_start", F.sum("_total").over(running) - F.col("_total"))
    kept = starts.join(limits, group).filter(F.col("_start") < F.col(limit))
    near = rows.join(kept.select(*group, "_range", "_start", "_total", limit), [*group, "_range"])
    whole = near.filter(F.col("_start") + F.col("_total") <= F.col(limit)).withColumn("preceding", F.lit(None).cast("long"))
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (
        near.filter(F.col("_start") + F.col("_total") > F.col(limit))
        .withColumn("preceding", F.col("_start") + F.sum(amount).over(within) - amount)
        .filter(F.col("preceding") < F.col(limit))
    )
    return whole.unionByName(edge).drop("_range", "_start", "_total", limit)


def preceding_total(rows: DataFrame, group: list[str], order: list[str], hex_key: str, size: str, bits: int = RANGE_BITS) -> DataFrame:
    """``rows`` with ``preceding``: the exact total of ``size`` before the row within ``group`` in hash order.

    Two-level prefix sum: per-range totals (at most 2**bits rows a group) give each range its start.
    """
    rows = rows.withColumn("_range", hash_range(F.col(hex_key), bits))
    totals = rows.groupBy(*group, "_range").agg(F.sum(F.col(size).cast("long")).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(starts, [*group, "_range"])
        .withColumn("preceding", F.col("_start") + F.coalesce(F.sum(F.col(size).cast("long")).over(within), F.lit(0)))
        .drop("_range", "_start")
    )


def block_starts(totals: DataFrame, block: str, total: str, group: list[str] | None = None, width: int = 1 << 12) -> DataFrame:
    """(group, block, _start): the total of all blocks before each one, for integer blocks with one row each in their group.

    A level above the blocks is summed first, so no task orders more than ``width`` blocks, or more upper ones than a group's
    blocks by ``width``.
    """
    group = group or []
    upper = totals.withColumn("_upper", F.floor(F.col(block) / width))
    before = (Window.partitionBy(*group) if group else Window).orderBy("_upper").rowsBetween(Window.unboundedPreceding, -1)
    tops = upper.groupBy(*group, "_upper").agg(F.sum(total).alias("_sum")).select(*group, "_upper", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*group, "_upper").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return upper.join(tops, [*group, "_upper"]).select(*group, block, (F.col("_base") + F.coalesce(F.sum(total).over(within), F.lit(0))).alias("_start"))
