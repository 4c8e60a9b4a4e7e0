"""Deterministic splits and samples in hash order. No category is ever gathered in one task: see plans.ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.hashing import seeded_key, stable_key
from folioflow.plans.ranks import below_limit


def _check_fraction(fraction: float) -> None:
    if not 0 < fraction < 0.5:
        raise ValueError("fraction must be in (0, 0.5)")


def stratified_split(rows: DataFrame, key: str, category: str, fraction: float = 0.1) -> DataFrame:
    """``rows`` with ``assigned``: in each category the first max(1, round(fraction * n)) by hash are dev, others train.

    Rounding is half to even; a category of one row has no dev row. Null categories are one category. Keys are unique.
    """
    _check_fraction(fraction)
    group = F.coalesce(F.col(category).cast("string"), F.lit("unknown"))
    hashed = rows.select(F.col(key).alias("_key"), group.alias("_group"), F.sha2(F.concat_ws(":", group, F.col(key).cast("string")), 256).alias("_hash"))
    sizes = hashed.groupBy("_group").agg(F.count("*").alias("_n"))
    limits = sizes.select("_group", F.when(F.col("_n") <= 1, 0).otherwise(F.greatest(F.lit(1), F.bround(F.col("_n") * fraction).cast("long"))).cast("long").alias("_limit"))
    dev = below_limit(hashed, ["_group"], ["_hash", "_key"], "_hash", limits, "_limit").select(F.col("_key").alias(key), F.lit("dev").alias("_dev"))
    return rows.join(dev, key, "left").withColumn("assigned", F.coalesce("_dev", F.lit("train"))).drop("_dev")


def top_by_hash(rows: DataFrame, count: int, seed: str, key: Column, within: list[str] | None = None) -> DataFrame:
    """The ``count`` rows of least seeded hash, of each group or of all, with ``rank`` from 1."""
    hashed = rows.withColumn("_hash", seeded_key(seed, key))
    if within is None:
        return hashed.orderBy("_hash").limit(count).withColumn("rank", F.row_number().over(Window.orderBy("_hash"))).drop("_hash")
    ranked = hashed.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy("_hash")))
    return ranked.filter(F.col("rank") <= count).drop("_hash")


#: Tags of a benchmark by rank within the category: the first 2, 10, 50 rows (fixed values).
TAGS = (("smoke", 2), ("regression", 10), ("research", 50))


def threshold_tags(rows: DataFrame, key: str, category: str, seed: str = "seed", tags: tuple[tuple[str, int], ...] = TAGS) -> DataFrame:
    """``rows`` with ``tags``: all whose threshold is not below the row's hash rank in its category.

    Only rows up to the greatest threshold are ranked; the others get an empty list.
    """
    ranked = top_by_hash(rows.select(key, category), max(n for _, n in tags), seed, F.col(key).cast("string"), [category])
    tagged = ranked.select(key, F.array_compact(F.array(*(F.when(F.col("rank") <= n, name) for name, n in tags))).alias("tags"))
    return rows.join(tagged, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


#: Slots a page may serve to evaluate, by what its text mentions (fixed values).
SLOTS = (
    ("date", "(?:신청|접수|기간|20\\d{2}\\s*[.\\-/년])"),
    ("amount", "(?:지원금|금액|\\d[\\d,]*\\s*(?:원|만원|억원))"),
    ("contact", "(?:문의|연락처|0\\d{1,2}[- )]\\d{3,4}-\\d{4})"),
)


def slot_candidates(text: Column) -> Column:
    """Names of the slots whose pattern the text matches."""
    return F.array_compact(F.array(*(F.when(text.rlike(pattern), name) for name, pattern in SLOTS)))


def slot_sample(rows: DataFrame, key: str, slots: str, count: int = 10) -> DataFrame:
    """(slot, key, rank): the first rows of each slot by slot-seeded hash."""
    each = rows.select(key, F.explode(slots).alias("slot"))
    hashed = each.withColumn("_hash", F.sha2(F.concat_ws(":", "slot", F.col(key).cast("string")), 256))
    ranked = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy("_hash", key)))
    return ranked.filter(F.col("rank") <= count).select("slot", key, "rank")


def _turns(rows: DataFrame, key: str, category: str, most: int, order: Column | None = None) -> DataFrame:
    """Rows by turn: each category's place in hash order, as far as ``most`` rows can reach. Null is a category, unknown."""
    hashed = rows.withColumn(category, F.coalesce(F.col(category), F.lit("unknown"))).withColumn("_hash", stable_key(F.col(key).cast("string")) if order is None else order)
    ranked = hashed.withColumn("turn", F.row_number().over(Window.partitionBy(category).orderBy("_hash", key)))
    return ranked.filter(F.col("turn") <= most)


def balanced_sample(rows: DataFrame, key: str, category: str, most: int) -> DataFrame:
    """``most`` rows taken in turns from the categories (in their order), by hash within each; with ``position`` from 1."""
    if most < 1:
        raise ValueError("most must be positive")
    taken = _turns(rows, key, category, most).orderBy("turn", category, "_hash", key).limit(most)
    return taken.withColumn("position", F.row_number().over(Window.orderBy("turn", category, "_hash", key))).drop("_hash", "turn")


def budget_sample(rows: DataFrame, key: str, category: str, size: str, budget: int, order: Column | None = None) -> DataFrame:
    """Rows in turns until their sizes reach the budget; the last may overshoot. Rows of size 0 or less are left out.

    Within a category rows come by the hash of their key, or by ``order`` (a hash of one's own).

    Every row kept has size 1 at least, so turns beyond ``budget`` cannot be reached and are not ranked.
    """
    usable = _turns(rows.filter(F.col(size) > 0), key, category, budget, order)
    before = Window.orderBy("turn", category, "_hash", key).rowsBetween(Window.unboundedPreceding, -1)
    first = usable.orderBy("turn", category, "_hash", key).limit(budget)
    return first.withColumn("preceding", F.coalesce(F.sum(size).over(before), F.lit(0))).filter(F.col("preceding") < budget).drop("_hash", "turn")


def capped_train_dev(rows: DataFrame, key: str, category: str, split: str, most: int) -> DataFrame:
    """A balanced sample of ``most`` rows, a tenth of them (one at least, if there are more) from dev, the rest from train."""
    dev = max(1, round(0.1 * most)) if most > 1 else 0
    parts = [balanced_sample(rows.filter(F.col(split) == name), key, category, n).withColumn("part", F.lit(name)) for name, n in (("train", most - dev), ("dev", dev)) if n]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def sample_variant(document: Column, annotation: Column, seed: str = "variant", share: int = 45) -> Column:
    """camera for ``share`` of a hundred buckets of the annotation's hash, else clean."""
    from folioflow.functions.hashing import bucket

    return F.when(bucket(F.concat(F.lit(f"{seed}:"), document.cast("string"), F.lit(":"), annotation.cast("string"))) < share, "camera").otherwise("clean")
