"""Sample index over documents: prefix sums, location of global sample numbers, epoch order, batches, replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.hashing import stable_key
from folioflow.plans.ranks import block_starts, preceding_total

BLOCK = 1 << 12
#: Seed of replacement numbers, and how many numbers are tried, the first included (fixed values).
RETRY, ATTEMPTS = "stream-retry", 32


def prefix_index(rows: DataFrame, key: str, size: str) -> DataFrame:
    """(key, first, end): running sample numbers [first, end) in the order of an integer key; empty rows are left out.

    Totals of key blocks, and of blocks of blocks, give block starts; only a block is ordered in one task.
    """
    used = rows.filter(F.col(size) > 0).select(F.col(key).alias("key"), F.col(size).cast("long").alias("_n")).withColumn("_block", F.floor(F.col("key") / BLOCK))
    starts = block_starts(used.groupBy("_block").agg(F.sum("_n").alias("_total")), "_block", "_total")
    upto = Window.partitionBy("_block").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = used.join(starts, "_block").withColumn("end", F.col("_start") + F.sum("_n").over(upto))
    return ended.select(F.col("key").alias(key), (F.col("end") - F.col("_n")).alias("first"), "end")


#: Sample numbers a bucket spans.
SPAN = 1 << 10


def locate(index: DataFrame, key: str, asked: DataFrame, number: str, span: int = SPAN) -> DataFrame:
    """``asked`` with the document and the place within it of each global sample number; unknown numbers are left out.

    A range join by buckets: a document stands in every bucket that its samples reach (one, for most), so rows grow with
    documents and not with samples.
    """
    bucket = F.explode(F.sequence(F.floor(F.col("first") / span), F.floor((F.col("end") - 1) / span)))
    ranges = index.select(F.col(key), "first", "end", bucket.alias("_bucket"))
    joined = asked.withColumn("_bucket", F.floor(F.col(number) / span)).join(ranges, "_bucket")
    return joined.filter((F.col(number) >= F.col("first")) & (F.col(number) < F.col("end"))).select(*asked.columns, key, (F.col(number) - F.col("first")).alias("place"))


def epoch_order(rows: DataFrame, key: str, epoch: int, seed: str = "epoch") -> DataFrame:
    """``rows`` with ``turn`` from 0: a permutation of the keys by epoch-seeded hash, numbered by a two-level count."""
    hashed = rows.withColumn("_hash", F.sha2(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col(key).cast("string")), 256)).withColumn("_one", F.lit(1))
    return preceding_total(hashed, [], ["_hash", key], "_hash", "_one").withColumnRenamed("preceding", "turn").drop("_hash", "_one")


def rank_batches(rows: DataFrame, key: str, size: str, epoch: int, world: int, batch_size: int, rank: int | None = None, resume: int = 0, seed: str = "epoch") -> DataFrame:
    """(rank, batch, key, first, last): which samples of which documents make up the full batches of one rank, or of all.

    Documents are shuffled by epoch, dealt to ranks in turn and kept together; the last incomplete batch is dropped, and
    batches below ``resume`` are skipped. first and last are places within the document. All ranks take one pass.
    """
    dealt = epoch_order(rows.filter(F.col(size) > 0), key, epoch, seed).withColumn("rank", F.pmod("turn", F.lit(world)).cast("int"))
    dealt = dealt if rank is None else dealt.filter(F.col("rank") == rank)
    blocked = dealt.withColumn("_block", F.floor(F.col("turn") / (BLOCK * world)))
    totals = blocked.groupBy("rank", "_block").agg(F.sum(size).alias("_total"))
    starts = block_starts(totals, "_block", "_total", ["rank"])
    before = Window.partitionBy("rank", "_block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocked.join(starts, ["rank", "_block"]).withColumn("_begin", F.col("_start") + F.coalesce(F.sum(size).over(before), F.lit(0)))
    # One row a rank.
    full = totals.groupBy("rank").agg(F.floor(F.sum("_total") / batch_size).alias("_full"))
    end = F.col("_begin") + F.col(size)
    pieces = placed.withColumn("batch", F.explode(F.sequence(F.floor(F.col("_begin") / batch_size), F.floor((end - 1) / batch_size))))
    kept = pieces.join(F.broadcast(full), "rank").filter((F.col("batch") < F.col("_full")) & (F.col("batch") >= resume))
    first = F.greatest(F.lit(0), F.col("batch") * batch_size - F.col("_begin"))
    last = F.least(F.col(size), (F.col("batch") + 1) * batch_size - F.col("_begin")) - 1
    return kept.select("rank", F.col("batch").cast("long").alias("batch"), key, first.cast("long").alias("first"), last.cast("long").alias("last"))


def replacement(number: Column, split: Column, attempt: Column, total: Column) -> Column:
    """The sample number that stands in at an attempt: a hash of split, number and attempt, modulo the total."""
    text = F.concat_ws(":", F.lit(RETRY), split, number.cast("string"), attempt.cast("string"))
    return (F.conv(stable_key(text), 16, 10).cast("decimal(20,0)") % total).cast("long")


def tried_numbers(number: Column, split: Column, total: int, attempts: int = ATTEMPTS) -> Column:
    """The numbers tried in turn, the first one the number itself.

    An attempt's number is its hash (``replacement``); if it was tried before, the next one (modulo the total) that was not.
    Once all numbers were tried the hash stays.
    """

    def step(tried: Column, attempt: Column) -> Column:
        at = lambda k: (replacement(number, split, attempt, F.lit(total)) + k) % total
        free = F.filter(F.sequence(F.lit(0), F.least(F.size(tried), F.lit(total - 1))), lambda k: ~F.array_contains(tried, at(k)))
        return F.concat(tried, F.array(at(F.coalesce(F.get(free, F.lit(0)), F.lit(0)).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(attempts - 1)), F.array(number.cast("long")), step)


def replaced(samples: DataFrame, number: str, valid: str, split: str, total: int, attempts: int = ATTEMPTS, strict: bool = False) -> DataFrame:
    """(number, used, attempt): each sample number and the valid one used for it, itself at attempt 0.

    Only failing numbers go through the attempts: all their candidates are made at once and joined with the valid
    numbers. Numbers whose candidates all fail have a null ``used``; with ``strict`` they are an error on evaluation.
    """
    good = samples.filter(F.col(valid)).select(F.col(number).alias("used"))
    failing = samples.filter(~F.coalesce(F.col(valid), F.lit(False)))
    tried = failing.select(number, F.posexplode(tried_numbers(F.col(number), F.col(split), total, attempts)).alias("attempt", "used")).filter("attempt > 0")
    first = tried.join(good, "used", "left_semi").groupBy(number).agg(F.min(F.struct("attempt", "used")).alias("_hit"))
    used = F.col("_hit.used")
    if strict:
        used = F.coalesce(used, F.raise_error(F.concat(F.lit("no valid sample stands in for "), F.col(number).cast("string"))).cast("long"))
    moved = failing.select(number).join(first, number, "left").select(number, used.alias("used"), F.col("_hit.attempt").cast("int").alias("attempt"))
    return samples.filter(F.col(valid)).select(number, F.col(number).alias("used"), F.lit(0).alias("attempt")).unionAll(moved)


def batch_count(rows: DataFrame, size: str, world: int, batch_size: int, resume: int = 0, drop_last: bool = True) -> DataFrame:
    """(batches): how many batches a rank announces for an epoch, from the samples of all ranks; never below 0."""
    each = F.floor(F.coalesce(F.sum(F.when(F.col(size) > 0, F.col(size))), F.lit(0)) / world) / batch_size
    return rows.agg(F.greatest(F.lit(0), (F.floor(each) if drop_last else F.ceil(each)) - resume).cast("long").alias("batches"))
