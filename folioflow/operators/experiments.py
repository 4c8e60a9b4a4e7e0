"""Experiments: which profiles run on which cases, photo cases, runs kept and resumed, stages that are ready."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Recognition profiles: name, image, page segmentation mode (0: a detector), whether lines are put in reading order (fixed
#: values). ``adaptive`` chooses image and mode itself.
PROFILES = (
    ("baseline", "gray", 3, False),
    ("best_gray_psm3", "gray", 3, False),
    ("best_normalized_psm3", "normalized", 3, False),
    ("best_sauvola_psm3", "sauvola", 3, False),
    ("best_gray_psm4", "gray", 4, False),
    ("best_gray_psm6", "gray", 6, False),
    ("best_gray_psm11", "gray", 11, False),
    ("adaptive", "adaptive", 3, False),
    ("paddle", "colour", 0, True),
    ("paddle_native_order", "colour", 0, False),
)
#: Profiles that differ in the languages of recognition only are told apart by this one (fixed value).
OWN_LANGUAGE = "baseline"
#: Ways a page is deformed and lit in the photo set, and the files that show them (fixed values).
DEFORMATIONS = ("perspective", "curled", "fewfold", "multifold", "crumpleseasy", "crumpleshard")
LIGHTS = ("bright", "color", "shadow")
PHOTO_FILE = "warped_document_{0}_{1}.jpg"
#: Preparations of a photo that are compared, and which of them straighten and normalise (fixed values).
VARIANTS = (
    ("raw", False, False),
    ("perspective", True, False),
    ("illumination", False, True),
    ("combined", True, True),
    ("paddle_unwarp", False, False),
)


def profiles(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """The profile table, or the named rows of it; an unknown name is an error."""
    known = {p[0] for p in PROFILES}
    unknown = sorted(set(names or ()) - known)
    if unknown:
        raise ValueError(f"unknown profiles {unknown}")
    return spark.createDataFrame([p for p in PROFILES if names is None or p[0] in names], "profile string, image string, psm int, ordered boolean")


def runs(cases: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each case with each profile (the profile table has at most a few rows). ``shared`` numbers runs whose recognition
    is the same and differs in the order of lines only."""
    key = F.dense_rank().over(Window.orderBy("image", "psm", F.col("profile") == OWN_LANGUAGE))
    return cases.join(F.broadcast(chosen.withColumn("shared", key)), how="cross")


def photo_cases(templates: DataFrame, archive: str, template: str, per_archive: int) -> DataFrame:
    """(archive, template, deformation, light, file, case_id): the first templates of each archive in all deformations.

    The light rotates over deformations, templates and archives, the latter by ``per_archive`` each; both follow each
    other by name. Archives are few, one row each.
    """
    known = templates.select(archive, template).distinct()
    local = F.row_number().over(Window.partitionBy(archive).orderBy(template)) - 1
    offsets = known.select(archive).distinct().withColumn("_offset", (F.row_number().over(Window.orderBy(archive)) - 1) * per_archive)
    placed = known.withColumn("_local", local).filter(F.col("_local") < per_archive).join(offsets, archive)
    each = placed.select(archive, template, "_local", "_offset", F.posexplode(F.array(*map(F.lit, DEFORMATIONS))).alias("_d", "deformation"))
    light = F.element_at(F.array(*map(F.lit, LIGHTS)), (F.pmod(F.col("_offset") + F.col("_local") + F.col("_d"), F.lit(len(LIGHTS))) + 1).cast("int"))
    named = each.select(archive, template, "deformation", light.alias("light"))
    begin, middle, end = PHOTO_FILE.replace("{0}", "\0").replace("{1}", "\0").split("\0")
    return named.withColumn("file", F.concat(F.lit(begin), "deformation", F.lit(middle), "light", F.lit(end))).withColumn("case_id", F.concat_ws("-", template, "deformation", "light"))


def by_file_name(cases: DataFrame, files: DataFrame, name: str, path: str) -> DataFrame:
    """Cases with the file whose base name they call for."""
    named = files.select(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1).alias(name), path)
    return cases.join(named, name)


def run_stages(folder: str, version: int, stages: dict[str, tuple[list[str], Callable[..., DataFrame]]], fingerprint: str | None = None) -> list[str]:
    """Run the stages that are not ready in the order of their inputs; the names of those that ran.

    ``stages``: name -> (names of the stages it reads, function of their outputs). A stage whose input was made again is
    made again. Unknown inputs and circles are errors.
    """
    ran: list[str] = []
    done: dict[str, DataFrame] = {}
    while len(done) < len(stages):
        ready = [n for n, (needs, _) in stages.items() if n not in done and all(i in done for i in needs)]
        if not ready:
            raise ValueError(f"stages {sorted(set(stages) - set(done))} wait for each other or for unknown ones")
        for name in ready:
            needs, make = stages[name]
            made = make(*(done[i] for i in needs))
            if run_stage(f"{folder}/{name}", version, made, any(i in ran for i in needs), fingerprint):
                ran.append(name)
            done[name] = made.sparkSession.read.parquet(f"{folder}/{name}")
    return ran


def latest_complete(generations: DataFrame, fingerprint: str | None = None) -> DataFrame:
    """The newest checkpoint generation that is complete: by step, epoch, recovery step, name.

    With ``fingerprint`` only generations trained on that data (column ``data_fingerprint``) count; null ones do not.
    """
    newest = F.max(F.struct("global_step", "epoch", "recovery_step", "name")).alias("_n")
    if fingerprint is not None:
        generations = generations.filter(F.col("data_fingerprint") == fingerprint)
    return generations.filter("complete").agg(newest).select("_n.*").filter("name is not null")


def superseded(generations: DataFrame, keep: int = 3) -> DataFrame:
    """Complete generations beyond the newest ``keep`` (two at least), which may be deleted."""
    if keep < 2:
        raise ValueError("at least two generations are kept")
    order = Window.orderBy(F.desc("global_step"), F.desc("epoch"), F.desc("recovery_step"), F.desc("name"))
    return generations.filter("complete").withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") > keep).drop("_rank")


def stage_ready(folder: str, version: int, fingerprint: str | None = None) -> bool:
    """Whether a stage's output is complete, of this schema version and made from the same data (local or mounted folders)."""
    state = os.path.join(folder, "_state.json")
    if not (os.path.exists(os.path.join(folder, "_SUCCESS")) and os.path.exists(state)):
        return False
    with open(state, encoding="utf-8") as f:
        kept = json.load(f)
    return kept.get("version") == version and (fingerprint is None or kept.get("fingerprint") == fingerprint)


def run_stage(folder: str, version: int, make: DataFrame, force: bool = False, fingerprint: str | None = None) -> bool:
    """Write a stage as Parquet unless it is ready; the state is written last. Returns whether it ran.

    ``fingerprint`` names the input data (``functions.hashing.table_fingerprint``); a stage of other data is made again.
    """
    if not force and stage_ready(folder, version, fingerprint):
        return False
    make.write.mode("overwrite").parquet(folder)
    with open(os.path.join(folder, "_state.json.part"), "w", encoding="utf-8") as f:
        json.dump({"version": version, "fingerprint": fingerprint}, f)
    os.replace(os.path.join(folder, "_state.json.part"), os.path.join(folder, "_state.json"))
    return True
