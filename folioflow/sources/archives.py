"""ZIP archives of page images and label files, read where they lie.

Archives are listed and fetched by the ``binaryFile`` source; members are unpacked by ``mapInPandas``, one archive at a
time within a task. Filters and projections on archive paths reach the listing.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.ids import base_name
from folioflow.operators.manifest import relative_stem

IMAGE_SUFFIXES, LABEL_SUFFIX = (".jpg", ".jpeg", ".png"), ".json"
#: Names of split folders, lower case (fixed values).
SPLIT_FOLDERS = {"training": ("training", "train", "학습"), "validation": ("validation", "valid", "검증")}


def archive_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all ZIP files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(root).select("path", "content")


def split_of(path_column: str = "path"):
    """training or validation by the folders of a path, else null."""
    lower, found = F.lower(path_column), F.lit(None).cast("string")
    for split, names in SPLIT_FOLDERS.items():
        found = F.when(lower.rlike("/[^/]*(?:" + "|".join(names) + ")[^/]*/"), split).otherwise(found)
    return found


def dataset_root(spark: SparkSession, folder: str) -> str:
    """The folder itself, or its only child, that holds a validation folder with archives; else an error."""
    names = "|".join(SPLIT_FOLDERS["validation"])
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(folder).select("path")
    base = folder.rstrip("/").rsplit("/", 1)[-1]
    pattern = f"/{re.escape(base)}/(?:([^/]+)/)?[^/]*(?i:{names})[^/]*/"
    roots = [r[0] for r in listed.filter(F.col("path").rlike(pattern)).select(F.regexp_extract("path", pattern, 1)).distinct().limit(2).collect()]
    if len(roots) != 1:
        raise ValueError(f"{folder} holds {len(roots) or 'no'} dataset roots")
    return folder.rstrip("/") + (f"/{roots[0]}" if roots[0] else "")


def unique_file(spark: SparkSession, folder: str, name: str) -> str:
    """The path of the only file below a folder with exactly this name; else an error. Brackets are literal."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").filter(F.element_at(F.split("path", "/"), -1) == name).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{name} is {'missing' if not found else 'not unique'} below {folder}")
    return found[0].path


def members(files: DataFrame, payload: bool = False) -> DataFrame:
    """(archive, position, member, kind, size, payload) of all files in the archives, in their stored order.

    Without ``payload`` only the directories are read. Unreadable archives give one row of kind ``broken``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for i, info in enumerate(archive.infolist()):
                            if info.is_dir():
                                continue
                            name = info.filename.lower()
                            kind = "image" if name.endswith(IMAGE_SUFFIXES) else "label" if name.endswith(LABEL_SUFFIX) else "other"
                            rows.append((path, i, info.filename, kind, info.file_size, archive.read(info) if payload else None))
                except zipfile.BadZipFile:
                    rows = [(path, 0, "", "broken", len(content), None)]
                yield pd.DataFrame(rows, columns=["archive", "position", "member", "kind", "size", "payload"])

    return files.mapInPandas(run, "archive string, position int, member string, kind string, size long, payload binary")


def classify(found: DataFrame) -> DataFrame:
    """(archive, images, labels, kind): archives by what they hold; ``mixed`` holds both, ``empty`` neither."""
    counted = found.groupBy("archive").agg(F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "label").alias("labels"))
    kind = F.when((F.col("images") > 0) & (F.col("labels") > 0), "mixed").when(F.col("images") > 0, "image").when(F.col("labels") > 0, "label").otherwise("empty")
    return counted.withColumn("kind", kind)


def archive_sets(classified: DataFrame, split: str = "split") -> DataFrame:
    """(split, image_archives, label_archives) of classified archives with a column ``split``, each list sorted.

    Errors on evaluation: an archive that holds images and labels, and a split without one of both kinds.
    """
    mixed = F.when(F.col("kind") == "mixed", F.raise_error(F.concat(F.lit("images and labels in one archive: "), F.col("archive"))).cast("string")).otherwise(F.col("archive"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("_archive")))).alias(f"{kind}_archives")
    sets = classified.filter(F.col(split).isNotNull()).withColumn("_archive", mixed).filter("_archive is not null").groupBy(split).agg(of("image"), of("label"))
    whole = F.assert_true((F.size("image_archives") > 0) & (F.size("label_archives") > 0), F.concat(F.lit("images or labels are missing in "), F.col(split)))
    return sets.withColumn("_ok", whole.isNull()).filter("_ok").drop("_ok")


def image_index(found: DataFrame) -> DataFrame:
    """(archive, member, stem, base, ambiguous): images with the keys labels are paired by; ambiguous base names mark."""
    images = found.filter("kind = 'image'").select("archive", "member", relative_stem(F.col("member")).alias("stem"), base_name(F.replace("member", F.lit("\\"), F.lit("/"))).alias("base"))
    shared = images.groupBy("base").agg((F.count("*") > 1).alias("ambiguous"))
    return images.join(shared, "base").select("archive", "member", "stem", "base", "ambiguous")


def _decoded(payload: bytes | None) -> str | None:
    if payload is None:
        return None
    for encoding in ("utf-8-sig", "utf-16", "cp949"):
        try:
            return payload.decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


def labels(found: DataFrame, strict: bool = False) -> DataFrame:
    """(archive, position, member, payload, readable) of label members; UTF-8 (with or without mark), UTF-16 or CP949.

    ``strict`` fails on the first payload that is no JSON object; else ``readable`` tells.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, fine = [], []
            for member, payload in zip(frame["member"], frame["payload"], strict=True):
                text = _decoded(payload)
                try:
                    good = text is not None and isinstance(json.loads(text), dict)
                except ValueError:
                    good = False
                if strict and not good:
                    raise ValueError(f"{member} is no JSON object")
                texts.append(text)
                fine.append(good)
            yield pd.DataFrame({"archive": frame["archive"], "position": frame["position"], "member": frame["member"], "payload": texts, "readable": fine})

    return found.filter("kind = 'label'").select("archive", "position", "member", "payload").mapInPandas(run, "archive string, position int, member string, payload string, readable boolean")


def label_counts(read: DataFrame) -> DataFrame:
    """(archive, labels, broken) of label archives."""
    return read.groupBy("archive").agg(F.count("*").alias("labels"), F.count_if(~F.col("readable")).alias("broken"))


def photo_groups(found: DataFrame) -> DataFrame:
    """(archive, template, member): images at least three folders deep whose second folder is a number."""
    parts = F.split("member", "/")
    return found.filter("kind = 'image'").withColumn("_p", parts).filter((F.size("_p") >= 3) & F.try_element_at("_p", F.lit(2)).rlike("^[0-9]+$")).select("archive", F.element_at("_p", 2).alias("template"), "member")


def uploads(spark: SparkSession, folder: str, most_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """(path, length, error_code) of files in a landing folder: 415 for other types, 400 for empty, 413 for too large.

    Spark's listing leaves files of no bytes out; 400 is for sources that give them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    code = F.when(~F.lower("path").rlike("\\.(jpe?g|png)$"), 415).when(F.col("length") == 0, 400).when(F.col("length") > most_bytes, 413)
    return files.withColumn("error_code", code)


def images(spark: SparkSession, folder: str, least_side: int = 32, most_pixels: int = 20_000_000) -> DataFrame:
    """Decoded images (origin, height, width, nChannels, data) whose sides and size are usable."""
    decoded = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder).select("image.*")
    return decoded.filter((F.least("height", "width") >= least_side) & (F.col("height").cast("long") * F.col("width") <= most_pixels))
