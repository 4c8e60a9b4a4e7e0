"""Joins of rows to one row a key where some keys have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more rows than HOT are dealt out to SALTS groups.
HOT, SALTS = 1_000_000, 64


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], spread: list[str], count: str, hot: int | None = None, salts: int | None = None) -> DataFrame:
    """The inner join of ``rows`` with ``keyed`` (one row a key, which has ``count`` rows); ``count`` is dropped.

    Rows of hot keys are dealt out by a hash of ``spread``, the key's one row is repeated for each salt. The list of hot
    keys that is broadcast holds at most one key per ``hot`` rows.
    """
    hot, salts = HOT if hot is None else hot, SALTS if salts is None else salts
    heavy = keyed.filter(F.col(count) > hot).select(*keys, F.lit(True).alias("_hot"))
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    spread_out = keyed.withColumn("_salt", F.explode(F.when(F.col(count) > hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(count)
    return dealt.join(spread_out, [*keys, "_salt"]).drop("_salt")
