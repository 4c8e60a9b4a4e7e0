"""Evaluation reports: per profile, per condition, effects against a base, selectors, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile_report(records: DataFrame, profile: str, rate: str, flag: Column, means: dict[str, str], digits: int = 4) -> DataFrame:
    """(profile, n, mean and median of ``rate``, flagged, mean of unflagged rates, further means) per profile.

    The mean of unflagged rates is null where all are flagged.
    """
    return records.groupBy(profile).agg(
        F.count("*").alias("n"), F.round(F.avg(rate), digits).alias("mean_rate"), F.round(F.median(rate), digits).alias("median_rate"),
        F.count_if(flag).alias("flagged"), F.round(F.avg(F.when(~F.coalesce(flag, F.lit(False)), F.col(rate))), digits).alias("mean_unflagged"),
        *(F.round(F.avg(c), digits).alias(name) for name, c in means.items()),
    )


def histogram(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.groupBy(*keys).agg(F.count("*").alias("n"))


def condition_report(records: DataFrame, variant: str, conditions: list[str], measure: str, digits: int = 4) -> DataFrame:
    """Means per variant: over all, and per value of each condition, in one pass (grouping sets).

    ``level`` names the condition ('all' for none); values of other conditions are null.
    """
    sets = [[variant], *([c, variant] for c in conditions)]
    grouped = records.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in [variant, *conditions]))
    level = F.lit("all")
    for c in conditions:
        level = F.when(F.grouping(c) == 0, c).otherwise(level)
    return grouped.agg(level.alias("level"), F.count("*").alias("n"), F.round(F.avg(measure), digits).alias("mean"), F.round(F.median(measure), digits).alias("median"))


def effects(records: DataFrame, document: str, variant: str, base: str, measure: str, digits: int = 4) -> DataFrame:
    """(variant, documents, gain, wins, losses) of each other variant against the base, document by document.

    The gain is the difference of means that were rounded first; ties are neither wins nor losses. Only documents that
    have both variants count; (document, variant) is unique.
    """
    low = records.filter(F.col(variant) == base).select(document, F.col(measure).alias("_base"))
    both = records.filter(F.col(variant) != base).join(low, document)
    return both.groupBy(variant).agg(
        F.count("*").alias("documents"), F.round(F.round(F.avg(measure), digits) - F.round(F.avg("_base"), digits), digits).alias("gain"),
        F.count_if(F.col(measure) > F.col("_base")).alias("wins"), F.count_if(F.col(measure) < F.col("_base")).alias("losses"),
    )


def selectors(records: DataFrame, document: str, variant: str, base: str, other: str, measure: str, rules: dict[str, str | None], digits: int = 4) -> DataFrame:
    """(rule, mean, picks, agreements, documents): how well rules choose between two variants.

    A rule names a column and picks ``other`` where it is strictly greater there; always_base and always_other name none
    (None). Agreement is with the choice by ``measure`` itself, which keeps the base on ties.
    """
    fields = sorted({measure, *(c for c in rules.values() if c)})
    side = lambda name: records.filter(F.col(variant) == name).select(document, *(F.col(c).alias(f"{c}_{'b' if name == base else 'o'}") for c in fields))
    both = side(base).join(side(other), document)
    best = F.col(f"{measure}_o") > F.col(f"{measure}_b")
    picks = [F.struct(F.lit(rule).alias("rule"), (F.lit(rule == "always_other") if c is None else F.col(f"{c}_o") > F.col(f"{c}_b")).alias("pick")) for rule, c in rules.items()]
    each = both.withColumn("_r", F.explode(F.array(*picks))).select("_r.rule", "_r.pick", F.when(F.col("_r.pick"), F.col(f"{measure}_o")).otherwise(F.col(f"{measure}_b")).alias("_m"), (F.col("_r.pick") == best).alias("_agrees"))
    return each.groupBy("rule").agg(F.round(F.avg("_m"), digits).alias("mean"), F.count_if("pick").alias("picks"), F.count_if("_agrees").alias("agreements"), F.count("*").alias("documents"))


def recognition_report(pairs: DataFrame, reference: str, hypothesis: str, confidence: str, rate: Column) -> DataFrame:
    """(n, mean_rate, exact, mean_confidence) over all pairs; null means for none."""
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg(rate), 4).alias("mean_rate"), F.round(F.avg((F.col(reference) == F.col(hypothesis)).cast("int")), 4).alias("exact"), F.round(F.avg(confidence), 4).alias("mean_confidence"))


def length_profile(lengths: DataFrame, length: str, long: int = 25) -> DataFrame:
    """(labels, empty, mean, p95, p99, longest, over): nearest-rank percentiles from the counts of each length.

    The rank of a fraction f is round(f * (n - 1)), half to even. Lengths are pre-aggregated, so the running count runs
    over distinct lengths only.
    """
    counts = lengths.filter(F.col(length) > 0).groupBy(F.col(length).alias("v")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = counts.agg(F.sum("n").alias("_all"))
    placed = counts.withColumn("_upto", F.sum("n").over(upto)).crossJoin(F.broadcast(total))
    at = lambda f: F.min(F.when(F.col("_upto") > F.bround(f * (F.col("_all") - 1)), F.col("v")))
    profile = placed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("labels"), F.round(F.try_divide(F.sum(F.col("v") * F.col("n")), F.sum("n")), 3).alias("mean"),
        at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("v").alias("longest"), F.coalesce(F.sum(F.when(F.col("v") > long, F.col("n"))), F.lit(0)).alias("over"),
    )
    return profile.crossJoin(F.broadcast(lengths.agg(F.count_if(F.col(length) == 0).alias("empty"))))


def branch_metrics(rows: DataFrame, branch: str, measures: dict[str, str]) -> DataFrame:
    """Long form (branch, metric, value): one row per branch and measure."""
    means = rows.groupBy(branch).agg(*(F.round(F.avg(c), 4).alias(name) for name, c in measures.items()))
    return means.unpivot([branch], list(measures), "metric", "value")
