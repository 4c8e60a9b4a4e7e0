"""A sample that is the same on every run and only gains members as data grows: frozen batch bottom-k.

A record arrives with its first delivery. Of a frozen batch exactly ceil(rate * size) of its records with the smallest
salted hashes are members for good.

``extend_sample`` keeps frozen batches in a folder: what a call delivers that no batch holds yet is one new batch, so
nothing that arrives later, whatever its times say, can change a frozen one. ``frozen_sample`` has no store and takes the
day of a record's first arrival for its batch, frozen once a record of a later day has arrived; it is the same as long as
later deliveries carry later arrival times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.ids import page_key
from folioflow.plans.lineage import cut_lineage
from folioflow.plans.ranks import below_limit


def frozen_sample(records: DataFrame, key: Column, arrived: str, rate: float, salt: str = "sample") -> DataFrame:
    """(key, batch, hash) of the sampled records.

    ``key`` identifies a record, in any spelling that means the same; null keys and null arrivals are no records.
    The newest batch is still open and has no members yet. Ties cannot occur: keys are distinct within a batch and
    order equal hashes. Row order, partitioning, repeats and extra columns do not matter; an empty table gives none.
    """
    if not 0 < rate <= 1:
        raise ValueError("rate must be in (0, 1]")
    days = records.select(key.alias("key"), F.to_date(arrived).alias("_day")).filter("key is not null and _day is not null")
    first = days.groupBy("key").agg(F.min("_day").alias("batch"), F.max("_day").alias("_last"))
    # Read three times below; made and shuffled once.
    hashed = cut_lineage(first.withColumn("hash", F.sha2(F.concat_ws(":", F.lit(salt), F.col("key")), 256)))
    newest = hashed.agg(F.max("_last")).first()[0]
    frozen = hashed.filter(F.col("batch") < F.lit(newest)).drop("_last")
    sizes = frozen.groupBy("batch").agg(F.ceil(F.count("*") * F.lit(rate)).cast("long").alias("_keep"))
    return below_limit(frozen, ["batch"], ["hash", "key"], "hash", sizes, "_keep").select("key", "batch", "hash")


def extend_sample(folder: str, records: DataFrame, key: Column, rate: float, salt: str = "sample") -> DataFrame:
    """(key, batch, hash) of all members after ``records`` were delivered; batches are numbered from 0.

    ``folder`` (shared by all executors) holds one Parquet folder a batch, with all of its keys and whether they are
    members. Keys of former batches are left out, null keys are no records, repeats and extra columns do not matter. A
    batch that was not written to its end counts as never begun, so a call may be repeated after a failure; one that brings
    nothing new writes nothing. One call at a time may extend a folder.
    """
    if not 0 < rate <= 1:
        raise ValueError("rate must be in (0, 1]")
    spark = records.sparkSession
    done = _batches(spark, folder)
    new = records.select(key.alias("key")).filter("key is not null").distinct()
    if done:
        new = new.join(spark.read.parquet(*(f"{folder}/{n}" for n in done)).select("key"), "key", "left_anti")
    hashed = cut_lineage(new.withColumn("hash", F.sha2(F.concat_ws(":", F.lit(salt), F.col("key")), 256)).withColumn("batch", F.lit(done[-1] + 1 if done else 0)))
    sizes = hashed.groupBy("batch").agg(F.ceil(F.count("*") * F.lit(rate)).cast("long").alias("_keep"))
    if hashed.limit(1).count():
        members = below_limit(hashed, ["batch"], ["hash", "key"], "hash", sizes, "_keep").select("key", F.lit(True).alias("member"))
        whole = hashed.join(members, "key", "left").select("key", "hash", "batch", F.coalesce("member", F.lit(False)).alias("member"))
        done.append(done[-1] + 1 if done else 0)
        whole.write.mode("overwrite").parquet(f"{folder}/{done[-1]}")
    if not done:
        return hashed.select("key", "batch", "hash")
    return spark.read.parquet(*(f"{folder}/{n}" for n in done)).filter("member").select("key", "batch", "hash")


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that were written to their end, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path)]
    marked = lambda n: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    return sorted(int(n) for n in names if n.isdigit() and marked(n))


def corpus_sample(manifest: DataFrame, documents: DataFrame, rate: float = 0.05, salt: str = "sample") -> DataFrame:
    """(src, key, batch): the samples of manifest.id (by received_at) and documents.document_id (by created_at).

    One salt serves both, so a page with a small hash tends to be in both samples.
    """
    pages = frozen_sample(manifest, page_key(F.col("id")), "received_at", rate, salt).withColumn("src", F.lit("manifest"))
    docs = frozen_sample(documents, page_key(F.col("document_id")), "created_at", rate, salt).withColumn("src", F.lit("documents"))
    return pages.unionByName(docs).select("src", "key", F.date_format("batch", "yyyy-MM-dd").alias("batch"))
