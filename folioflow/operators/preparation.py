"""Corpora made ready: manifests of paired pages, benchmark manifests, sample indexes, the table of training samples.

Each step takes tables and gives tables; what is written where is ``experiments.run_stages``' and the caller's. Reports
that name examples are top-k reports in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.geometry import crop_rectangle
from folioflow.functions.hashing import stable_key
from folioflow.functions.ids import base_name
from folioflow.functions.text import label_text
from folioflow.operators import manifest as pages
from folioflow.operators import nested, sampling
from folioflow.operators.index import locate, prefix_index

#: Page area that crops are cut from where images are not at hand.
AREA = (1654, 2339)


def label_heads(records: DataFrame, key: str = "label_id", payload: str = "payload") -> DataFrame:
    """(key, has_image, file_name, category, annotation_count, sample_count) of every readable label record.

    The image is the first of the record's list; without an object there ``has_image`` is false. Places of the annotation
    list count whatever they hold, samples are annotations that ``manifest.rejection`` accepts.
    """
    image = F.get(F.col("tree.images"), F.lit(0))
    heads = nested.trees(records, key, payload).select(
        F.col("key").alias(key), image.isNotNull().alias("has_image"), image["file_name"].alias("file_name"), image["category"].alias("category"),
        F.coalesce(F.array_size("tree.annotations"), F.lit(0)).alias("annotation_count"),
    )
    notes = nested.flatten(records, "annotations", key, payload)
    usable = pages.rejection(F.col("text"), F.from_json("bbox", "array<double>")).isNull()
    samples = notes.groupBy(key).agg(F.count_if(usable).cast("int").alias("sample_count"))
    return heads.join(samples, key, "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))


def examined_labels(records: DataFrame, members: DataFrame, strict: bool = False) -> DataFrame:
    """Label records, one per (label_zip, label_member), with what became of each.

    ``outcome`` is invalid_label (no JSON object), no_image_record, missing_image or paired. Images are paired by relative
    stem, else by a file name that only one image has. Two images of one stem are an error with ``strict``, else the first by
    path counts. A record delivered again counts once, the smallest label_id. Adds ``file_name``, ``category``, counts,
    ``image_member``, ``image_zip``, ``paired_by``.
    """
    images = members.filter("kind = 'image' and trim(member_path) <> ''").select("zip_path", "member_path").distinct()
    if strict:
        stems = images.withColumn("stem", pages.relative_stem(F.col("member_path")))
        images = pages.assert_unique(stems, ["stem"]).drop("stem")
    once = records.groupBy("label_zip", "label_member").agg(F.min("label_id").alias("label_id"))
    labels = once.join(label_heads(records), "label_id", "left")
    declared = base_name(pages.slashed(F.col("file_name")))
    paired = pages.pair_labels(labels.withColumn("_declared", F.when(declared != "", declared)), images.select("member_path").distinct(), "label_member", "_declared", "member_path")
    where = images.groupBy(F.col("member_path").alias("image")).agg(F.min("zip_path").alias("image_zip"))
    outcome = (
        F.when(F.col("has_image").isNull(), "invalid_label").when(~F.col("has_image"), "no_image_record")
        .when(F.col("image").isNull(), "missing_image").otherwise("paired")
    )
    return paired.join(where, "image", "left").withColumn("outcome", outcome).withColumnRenamed("image", "image_member").drop("_declared")


def build_manifest(examined: DataFrame, split: str, fraction: float = 0.1, strict: bool = False) -> DataFrame:
    """Manifest rows of the paired labels: (id, category, source_split, dataset_split, splits, image_zip, image_member,
    label_zip, label_member, annotation_count, sample_count).

    An id is the stem of the declared file name, or the joined relative stem of the label where none is declared or where a
    label before it (by archive and member) has that id. Ids that still repeat are an error with ``strict``. Validation rows
    are final; of training rows the first share of each category by hash is dev.
    """
    if split not in ("training", "validation"):
        raise ValueError(f"unknown split {split}")
    rows = examined.filter("outcome = 'paired'").withColumn("_short", pages.stem(F.coalesce("file_name", F.lit(""))))
    joined = F.replace(pages.relative_stem(F.col("label_member")), F.lit("/"), F.lit("__"))
    first = rows.filter("_short <> ''").groupBy("_short").agg(F.min(F.struct("label_zip", "label_member")).alias("_first"))
    named = rows.join(first, "_short", "left").withColumn("id", F.when((F.col("_short") != "") & (F.struct("label_zip", "label_member") == F.col("_first")), F.col("_short")).otherwise(joined))
    if strict:
        named = pages.assert_unique(named, ["id"])
    named = named.withColumn("category", F.coalesce("category", F.lit("unknown")))
    if split == "training":
        # Rows are told apart by their label, since ids may repeat; the split goes by category and id.
        keyed = named.withColumn("_key", F.concat_ws(":", "id", "label_zip", "label_member"))
        placed = sampling.stratified_split(keyed, "_key", "category", fraction).withColumnRenamed("assigned", "dataset_split").withColumn("splits", F.array().cast("array<string>"))
    else:
        placed = named.withColumn("dataset_split", F.lit("final")).withColumn("splits", F.array(F.lit("final")))
    return placed.select(
        "id", "category", F.lit(split).alias("source_split"), "dataset_split", "splits", "image_zip", "image_member", "label_zip", "label_member", "annotation_count", "sample_count"
    )


def build_report(examined: DataFrame, members: DataFrame) -> DataFrame:
    """(measure, n): images, ambiguous file names, labels seen and what became of them."""
    images = members.filter("kind = 'image' and trim(member_path) <> ''").select("member_path").distinct()
    names = images.groupBy(base_name(pages.slashed(F.col("member_path"))).alias("_base")).agg(F.count("*").alias("_n"))
    outcomes = examined.groupBy(F.col("outcome").alias("measure")).agg(F.count("*").alias("n"))
    known = examined.sparkSession.createDataFrame([(m,) for m in ("invalid_label", "no_image_record", "missing_image", "paired")], "measure string")
    return (
        known.join(outcomes, "measure", "left").select("measure", F.coalesce("n", F.lit(0)).alias("n"))
        .unionAll(examined.agg(F.lit("labels_seen").alias("measure"), F.count("*").alias("n")))
        .unionAll(images.agg(F.lit("images_indexed").alias("measure"), F.count("*").alias("n")))
        .unionAll(names.agg(F.lit("ambiguous_names").alias("measure"), F.count_if(F.col("_n") > 1).alias("n")))
    )


def build_examples(examined: DataFrame, outcome: str, most: int = 20) -> DataFrame:
    """(label_zip, label_member): the first labels of an outcome."""
    return pages.examples(examined, F.col("outcome") == outcome, ["label_zip", "label_member"], most).select("label_zip", "label_member")


def benchmark_manifest(rows: DataFrame, text: str, key: str = "id", category: str = "category") -> DataFrame:
    """``rows`` (unique ``key``) with ``splits``, ``slot_candidates``, ``slot_benchmark`` and ``golden_review_candidate``.

    splits are thresholds of the hash rank within the category; slots are what the text mentions, their benchmark the first
    ten of each by slot-seeded hash, and eight of all those by hash are for review.
    """
    tagged = sampling.threshold_tags(rows, key, category).withColumnRenamed("tags", "splits").withColumn("slot_candidates", sampling.slot_candidates(F.coalesce(text, F.lit(""))))
    top = sampling.slot_sample(tagged, key, "slot_candidates").groupBy(key).agg(F.array_sort(F.collect_list("slot")).alias("slot_benchmark"))
    golden = sampling.top_by_hash(top.select(key), 8, "golden", F.col(key).cast("string")).select(key, F.lit(True).alias("_golden"))
    joined = tagged.join(top, key, "left").join(golden, key, "left")
    return joined.withColumn("slot_benchmark", F.coalesce("slot_benchmark", F.array().cast("array<string>"))).withColumn("golden_review_candidate", F.coalesce("_golden", F.lit(False))).drop("_golden")


def summary_rows(records: DataFrame, payload: str) -> DataFrame:
    """``records`` with ``error_count`` and ``has_corrected_all`` of a corrected summary; absent levels count as empty.

    The fields' paths are fixed values.
    """
    errors = F.from_json(F.get_json_object(payload, "$.annotation.corrected_summary.corrected_type5.errors"), "array<string>")
    text = F.get_json_object(payload, "$.annotation.corrected_summary.corrected_all.text")
    return records.withColumn("error_count", F.coalesce(F.array_size(errors), F.lit(0))).withColumn("has_corrected_all", F.coalesce(text != "", F.lit(False)))


def checked_index_rows(rows: DataFrame) -> DataFrame:
    """Manifest rows that an index may be built of; others are errors on evaluation.

    source_split is training, dataset_split train or dev, sample_count not negative, and ids do not repeat.
    """
    fine = (F.col("source_split") == "training") & F.col("dataset_split").isin("train", "dev") & (F.col("sample_count") >= 0)
    checked = rows.withColumn("_ok", F.assert_true(F.coalesce(fine, F.lit(False)), F.concat(F.lit("no training row: "), F.coalesce(F.col("id"), F.lit("null")))).isNull()).filter("_ok").drop("_ok")
    return pages.assert_unique(checked, ["source_split", "id"])


def sample_indexes(rows: DataFrame, key: str, dev_samples: int) -> DataFrame:
    """(part, key, first, end): sample numbers of train documents by key, and of dev documents in turns of categories.

    Dev documents are taken by category in hash order until ``dev_samples`` samples are reached; the last may overshoot.
    """
    train = prefix_index(rows.filter("dataset_split = 'train'"), key, "sample_count").withColumn("part", F.lit("train"))
    seeded = stable_key(F.concat_ws(":", F.lit("dev"), F.coalesce("category", F.lit("unknown")), F.col("id")))
    dev = sampling.budget_sample(rows.filter("dataset_split = 'dev'"), key, "category", "sample_count", dev_samples, seeded)
    placed = dev.select(F.col(key), F.col("preceding").alias("first"), (F.col("preceding") + F.col("sample_count")).alias("end"), F.lit("dev").alias("part"))
    return train.select("part", key, "first", "end").unionByName(placed.select("part", key, "first", "end"))


def numbered_samples(annotations: DataFrame, document: str, area: tuple[Column, Column] | None = None) -> DataFrame:
    """(document, place, ann_key, id, label, left, top, right, bottom): usable annotations of each document, numbered from 0.

    Exactly repeated rows count once. The order is by id and key; annotations whose crop would be empty are not usable.
    """
    width, height = area or (F.lit(AREA[0]), F.lit(AREA[1]))
    box = F.col("annotation.bbox")
    rows = annotations.filter(F.col(document).isNotNull()).select(document, "ann_key", "id", "annotation").distinct()
    fine = rows.filter(pages.rejection(F.col("annotation.text"), box).isNull())
    cut = fine.select(document, "ann_key", "id", label_text(F.col("annotation.text")).alias("label"), crop_rectangle(*(F.try_element_at(box, F.lit(i)) for i in (1, 2, 3, 4)), width, height).alias("_r")).filter("_r is not null")
    order = Window.partitionBy(document).orderBy("id", "ann_key", "label", "_r.left", "_r.top")
    return cut.withColumn("place", (F.row_number().over(order) - 1).cast("long")).select(document, "place", "ann_key", "id", "label", "_r.*")


def training_samples(asked: DataFrame, number: str, samples: DataFrame, document: str, key: str, epoch: int, train: bool = True) -> DataFrame:
    """The samples of global numbers: their annotation, crop and, in training, variant and its seed.

    ``samples`` are ``numbered_samples`` with an integer ``key`` of the document; global numbers run over documents by key.
    Numbers beyond the last sample are left out.
    """
    sizes = samples.groupBy(key).agg(F.count("*").alias("_n"))
    located = locate(prefix_index(sizes, key, "_n"), key, asked, number)
    found = located.join(samples, [key, "place"])
    annotation = F.coalesce(F.col("id").cast("string"), F.col("place").cast("string"))
    variant = sampling.sample_variant(F.col(document), annotation) if train else F.lit("clean")
    seed = stable_key(F.concat_ws(":", F.col(document), annotation, "variant", F.lit(str(epoch))))
    return found.withColumn("variant", variant).withColumn("seed", seed)


def not_subset(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Keys of ``part`` that ``whole`` has not; empty if it is a subset. Null keys are none."""
    return part.select(key).filter(F.col(key).isNotNull()).distinct().join(whole.select(key), key, "left_anti")
