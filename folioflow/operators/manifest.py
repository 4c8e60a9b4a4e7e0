"""Manifests: pairing labels with images, identifiers, validity of annotations, quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.geometry import finite
from folioflow.functions.ids import base_name
from folioflow.functions.text import label_text


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_stem(path: Column) -> Column:
    """A member path without its first folder and suffix, in lower case: what image and label of a page share."""
    inner = F.regexp_replace(slashed(path), "^[^/]+/(?=.)", "")
    return F.lower(F.regexp_replace(inner, "(?<=[^/])\\.[^./]+$", ""))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(slashed(path)), "(?<=.)\\.[^.]+$", "")


def portable(path: Column, root: str) -> Column:
    """A path relative to ``root`` if it lies below it, with forward slashes."""
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    clean = slashed(path)
    return F.when(clean.startswith(prefix), F.substring(clean, len(prefix) + 1, 1 << 20)).otherwise(clean)


def image_names(images: DataFrame, member: str) -> DataFrame:
    """(base, member) of file names that only one image has."""
    named = images.select(base_name(slashed(F.col(member))).alias("base"), F.col(member).alias("member"))
    return named.groupBy("base").agg(F.count("*").alias("_n"), F.min("member").alias("member")).filter("_n = 1").select("base", "member")


def pair_labels(labels: DataFrame, images: DataFrame, label_path: str, declared: str, image_path: str, scope: list[str] | None = None) -> DataFrame:
    """``labels`` with ``image`` and ``paired_by``: relative_stem, file_name (declared and unique) or missing.

    A label is paired by its relative stem if an image has it, else by its declared file name among those that only one
    image has. Image stems must be unique in ``scope``; of repeated ones the least path is taken.
    """
    scope = scope or []
    by_stem = images.groupBy(*scope, relative_stem(F.col(image_path)).alias("_stem")).agg(F.min(image_path).alias("_by_stem"))
    by_name = image_names(images, image_path).withColumnsRenamed({"base": "_base", "member": "_by_name"})
    joined = (
        labels.withColumn("_stem", relative_stem(F.col(label_path))).withColumn("_base", F.col(declared))
        .join(by_stem, [*scope, "_stem"], "left").join(by_name, "_base", "left")
    )
    how = F.when(F.col("_by_stem").isNotNull(), "relative_stem").when(F.col("_by_name").isNotNull(), "file_name").otherwise("missing")
    return joined.withColumn("image", F.coalesce("_by_stem", "_by_name")).withColumn("paired_by", how).drop("_stem", "_base", "_by_stem", "_by_name")


def pair_by_name(labels: DataFrame, images: DataFrame, declared: str, name: str, member: str, position: str) -> DataFrame:
    """Labels with the image of their declared name; of images of one name the last counts, labels without are dropped."""
    last = images.groupBy(F.col(name).alias("_name")).agg(F.max(F.struct(position, member)).alias("_last")).select("_name", F.col(f"_last.{member}").alias("image"))
    return labels.join(last, labels[declared] == last["_name"]).drop("_name")


def unmatched(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("left_only", "right_only")) -> DataFrame:
    """(side, key) of the keys that only one of both has; null keys are none."""
    a, b = (d.select(key).filter(F.col(key).isNotNull()).distinct() for d in (left, right))
    return a.join(b, key, "left_anti").select(F.lit(names[0]).alias("side"), key).unionAll(b.join(a, key, "left_anti").select(F.lit(names[1]), key))


def leaked_keys(rows: DataFrame, key: str, split: str, first: str, second: str, examples: int | None = 10) -> DataFrame:
    """Keys that are in both splits, in order; ``examples`` bounds the report."""
    both = rows.filter(F.col(split).isin(first, second)).groupBy(key).agg(F.min(split).alias("_a"), F.max(split).alias("_b")).filter("_a <> _b").select(key).orderBy(key)
    return both if examples is None else both.limit(examples)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with ``copies``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def assert_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, failing on evaluation if a key occurs twice."""
    repeated = duplicates(rows, keys).limit(1).agg(F.count("*").alias("_n"))
    checked = repeated.select(F.assert_true(F.col("_n") == 0, F.lit(f"repeated {keys}")).isNull().alias("_ok"))
    return rows.crossJoin(F.broadcast(checked)).filter("_ok").drop("_ok")


def disambiguate(rows: DataFrame, path: str, order: list[str]) -> DataFrame:
    """``rows`` with ``document_id``: the path's stem for its first user in ``order``, the joined relative stem for later ones.

    The first user is a minimum per stem, combined before it is shuffled, so a stem of very many rows is no hot group.
    """
    rows = rows.withColumn("_short", stem(F.col(path)))
    first = rows.groupBy("_short").agg(F.min(F.struct(*order)).alias("_first"))
    joined = rows.join(first, rows["_short"].eqNullSafe(first["_short"])).drop(first["_short"])
    named = F.when(F.struct(*order).eqNullSafe(F.col("_first")), F.col("_short")).otherwise(F.replace(relative_stem(F.col(path)), F.lit("/"), F.lit("__")))
    return joined.withColumn("document_id", named).drop("_short", "_first")


#: Longest label text of a usable sample (fixed value).
MAX_LABEL = 25


def rejection(text: Column, bbox: Column, max_length: int = MAX_LABEL, least_side: float = 2) -> Column:
    """Why an annotation makes no sample: empty, too_long or invalid_bbox, in this order; null if it does.

    A box has exactly four finite numbers and sides of ``least_side`` at least (a null text is an empty one).
    """
    label = label_text(text)
    numbers = [F.try_element_at(bbox, F.lit(i)) for i in (1, 2, 3, 4)]
    sound = bbox.isNotNull() & (F.size(bbox) == 4) & finite(*numbers) & (numbers[2] >= least_side) & (numbers[3] >= least_side)
    return F.when(label == "", "empty").when(F.length(label) > max_length, "too_long").when(~F.coalesce(sound, F.lit(False)), "invalid_bbox")


def rejection_counts(annotations: DataFrame, max_length: int = MAX_LABEL) -> DataFrame:
    """(reason, n) with reason ``valid`` for usable annotations."""
    reason = F.coalesce(rejection(F.col("annotation.text"), F.col("annotation.bbox"), max_length), F.lit("valid"))
    return annotations.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def sample_counts(annotations: DataFrame, document: str, max_length: int = MAX_LABEL) -> DataFrame:
    """(document, annotations, samples): all and usable annotations of each document."""
    usable = rejection(F.col("annotation.text"), F.col("annotation.bbox"), max_length).isNull()
    return annotations.groupBy(document).agg(F.count("*").alias("annotations"), F.count_if(usable).alias("samples"))


#: (source_split, dataset_split) that may occur together (fixed values).
SPLIT_CONTRACT = (("training", "train"), ("training", "dev"), ("validation", "final"))


def split_violations(rows: DataFrame, source: str, split: str, contract: tuple[tuple[str, str], ...] = SPLIT_CONTRACT) -> DataFrame:
    """(source, split, n) of pairs the contract does not know; rows without split are not held to it."""
    allowed = F.lit(False)
    for a, b in contract:
        allowed = allowed | ((F.col(source) == a) & (F.col(split) == b))
    return rows.filter(F.col(split).isNotNull() & ~F.coalesce(allowed, F.lit(False))).groupBy(source, split).agg(F.count("*").alias("n"))


def reference_text(annotations: DataFrame, document: str) -> DataFrame:
    """(document, n, reference): a document's annotation texts in the order of id and key, joined by blanks."""
    one = F.struct(F.coalesce("id", F.lit(0)).alias("id"), "ann_key", F.coalesce("annotation.text", F.lit("")).alias("text"))
    grouped = annotations.groupBy(document).agg(F.array_sort(F.collect_set(one)).alias("_notes"))
    return grouped.select(document, F.size("_notes").cast("long").alias("n"), F.array_join(F.transform("_notes", lambda x: x["text"]), " ").alias("reference"))


def manifest_statistics(manifest: DataFrame) -> DataFrame:
    """(label_zip, rows, pages, without_image, without_label, annotations, samples) per label archive."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return manifest.groupBy("label_zip").agg(
        F.count("*").alias("rows"), F.countDistinct("id").alias("pages"), F.count_if(blank("image_member")).alias("without_image"),
        F.count_if(blank("label_member")).alias("without_label"), F.sum("annotation_count").alias("annotations"), F.sum("sample_count").alias("samples"),
    )


def examples(rows: DataFrame, condition: Column, order: list[str], most: int = 20) -> DataFrame:
    """The first rows in ``order`` that a condition holds for (a top-k report)."""
    return rows.filter(condition).orderBy(*order).limit(most)
