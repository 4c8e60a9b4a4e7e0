"""Stable keys: SHA-256 prefixes as text for ordering, as decimals for buckets; fingerprints of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_key(value: Column) -> Column:
    """The first 64 bits of SHA-256 as 16 hex digits; their text order is the unsigned numeric order."""
    return F.substring(F.sha2(value, 256), 1, 16)


def seeded_key(seed: str, value: Column) -> Column:
    """The full SHA-256 of ``seed:value``."""
    return F.sha2(F.concat_ws(":", F.lit(seed), value), 256)


def bucket(value: Column, buckets: int = 100) -> Column:
    """The stable key modulo ``buckets`` (unsigned 64 bits do not fit a long, so it goes through a decimal)."""
    return (F.conv(stable_key(value), 16, 10).cast("decimal(20,0)") % F.lit(buckets)).cast("int")


def table_fingerprint(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, fingerprint) of a table's content, whatever its order.

    Each row's digest is taken of its JSON form with sorted columns. Digests are summed in four 64-bit limbs, so repeats
    count and nothing is sorted or gathered; the sums' digest is the fingerprint. Null cells differ from empty ones.
    """
    columns = sorted(columns or rows.columns)
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    limbs = [F.sum(F.conv(F.substring("_d", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"_s{i}") for i in range(5)]
    summed = rows.select(digest.alias("_d")).agg(F.count("*").alias("rows"), *limbs)
    return summed.select("rows", F.sha2(F.concat_ws("-", F.col("rows").cast("string"), *(F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("string") for i in range(5))), 256).alias("fingerprint"))
