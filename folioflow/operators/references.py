"""References to records that do not exist: which field names a member that is missing, deleted or still to come.

Parent keys are integers within a key space (archive, path apart from its last two numbers). Sorted parent keys are
compressed into contiguous runs; references are as-of matched to the preceding run start, and a key beyond that run's
end has no parent. In the same ordered pass a reference that has a parent is held against the parent's life spans,
again as-of: the latest end among the spans begun by then tells whether one of them still lives.

Spaces are cut into blocks of 2**BLOCK_BITS keys and runs end at block borders, so a space that holds a third of all
rows is spread over many tasks. Repeated spans are combined before they are shuffled. Blocks that very many references
name are salted: their references are dealt out and their runs and spans, which are few, are repeated for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.ids import base_name, member_key
from folioflow.operators.nested import _items, bound, readable
from folioflow.plans.lineage import cut_lineage

BLOCK_BITS = 16
#: Blocks with more references than HOT are dealt out to SALTS groups.
HOT, SALTS = 1_000_000, 64
_NUMBERS = "^(.*?)([0-9]{1,12})([^0-9]*)([0-9]{1,6})([^0-9]*)$"
_FOREVER = "9999-12-31 00:00:00"
_SEP = "\u0001"


def integer_key(path: Column) -> Column:
    """struct(space, key): a path with its last two numbers cut out, and those numbers as one integer; reversible.

    A path without two numbers is a space of its own with the key 0.
    """
    parts = F.split(F.regexp_replace(path, _NUMBERS, f"$1{_SEP}$2{_SEP}$3{_SEP}$4{_SEP}$5"), _SEP)
    split = lambda x: F.when(
        F.size(x) == 5,
        F.struct(F.concat_ws("#", F.lit("n"), x[0], F.length(x[1]), x[2], F.length(x[3]), x[4]).alias("space"), F.concat(x[1], x[3]).cast("long").alias("key")),
    ).otherwise(F.struct(F.concat(F.lit("p#"), x[0]).alias("space"), F.lit(0).cast("long").alias("key")))
    return F.transform(F.array(parts), split)[0]


def _keyed(rows: DataFrame, scope: Column, path: str, *keep: str) -> DataFrame:
    """Rows with their key space (as the 16 bytes of its digest, to keep shuffled rows short) and key."""
    coded = rows.select(scope.alias("_scope"), integer_key(F.col(path)).alias("_k"), *keep)
    return coded.select(F.unhex(F.md5(F.concat_ws("|", "_scope", "_k.space"))).alias("space"), F.col("_k.key").alias("key"), *keep)


def _block() -> Column:
    return F.shiftright("key", BLOCK_BITS).alias("block")


def key_runs(parents: DataFrame) -> DataFrame:
    """Maximal runs of contiguous keys within a block: (space, block, start, end). ``parents`` may repeat keys."""
    place = F.dense_rank().over(Window.partitionBy("space", "block").orderBy("key"))
    islands = parents.select("space", _block(), "key").withColumn("_island", F.col("key") - place)
    return islands.groupBy("space", "block", "_island").agg(F.min("key").alias("start"), F.max("key").alias("end")).drop("_island")


def _salted(rows: DataFrame, hot: DataFrame, salt: Column) -> DataFrame:
    """``rows`` with a salt: 0, or ``salt`` in hot blocks. ``hot`` has at most one row per HOT references."""
    return rows.join(F.broadcast(hot), ["space", "block"], "left").withColumn("salt", F.when(F.col("_hot"), salt).otherwise(F.array(F.lit(0)))).drop("_hot").withColumn("salt", F.explode("salt"))


def dangling(references: DataFrame, members: DataFrame, hot_block: int = HOT) -> DataFrame:
    """References that do not hold: (field, row_id, at, state) with state missing, late or deleted.

    ``references``: field, row_id, space, key, at; ``members``: space, key, added, until. A reference holds if a span
    with added <= at < until exists. A reference without ``at`` is none.
    """
    refs = cut_lineage(references.filter("at is not null").select("space", _block(), "key", "at", "field", "row_id"))
    # Runs and life spans are both made of the spans, which are normalised and shuffled once.
    spans = cut_lineage(members.groupBy("space", "key", "added").agg(F.max("until").alias("until")))
    hot = refs.groupBy("space", "block").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_block).select("space", "block", F.lit(True).alias("_hot"))
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    none = F.lit(None)
    asked = _salted(refs, hot, F.array(F.pmod(F.xxhash64("field", "row_id"), F.lit(SALTS)).cast("int")))
    begun = _salted(key_runs(spans).select("space", "block", F.col("start").alias("key"), "end"), hot, every)
    lived = _salted(spans.select("space", _block(), "key", "added", "until"), hot, every)
    columns = ("space", "block", "salt", "key")
    # Runs come before spans, and spans before the references of the same key and time.
    line = (
        begun.select(*columns, none.cast("timestamp_ntz").alias("time"), F.lit(0).cast("byte").alias("kind"), "end", none.cast("timestamp_ntz").alias("until"), none.cast("string").alias("field"), none.cast("long").alias("row_id"))
        .unionAll(lived.select(*columns, "added", F.lit(1).cast("byte"), none.cast("long"), "until", none.cast("string"), none.cast("long")))
        .unionAll(asked.select(*columns, "at", F.lit(2).cast("byte"), none.cast("long"), none.cast("timestamp_ntz"), "field", "row_id"))
    )
    order = (F.col("key"), F.col("time").asc_nulls_first(), F.col("kind"))
    before = Window.partitionBy("space", "block", "salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("space", "block", "salt", "key").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("space", "block", "salt", "key")
    matched = line.select(
        "kind", "field", "row_id", F.col("time").alias("at"), "key", F.last("end", ignorenulls=True).over(before).alias("_reach"),
        F.max("until").over(same).alias("_until"), F.max(F.when(F.col("kind") == 1, F.col("time"))).over(whole).alias("_last"),
    ).filter("kind = 2")
    state = (
        F.when(F.col("_reach").isNull() | (F.col("key") > F.col("_reach")), "missing")
        .when(F.coalesce(F.col("_until") > F.col("at"), F.lit(False)), None)
        .when(F.col("_last") > F.col("at"), "late").otherwise("deleted")
    )
    return matched.select("field", "row_id", "at", state.alias("state")).filter("state is not null")


def _archive(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def archive_references(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """All references of the manifest's members and of the first image of every readable label payload.

    Null and blank names are no references. Extra columns are ignored. Names are filtered as they stand, before they are
    normalised, so that the normaliser runs once a name.
    """
    member = lambda kind: F.struct(F.lit(f"manifest.{kind}_member").alias("field"), F.concat_ws("|", F.lit(kind), _archive(F.col(f"{kind}_zip"))).alias("scope"), F.col(f"{kind}_member").alias("path"))
    by_member = manifest.select("row_id", F.col("scanned_at").alias("at"), F.explode(F.array(member("image"), member("label"))).alias("_m")).select("row_id", "at", "_m.*")
    texts = labels.select("label_id", "scanned_at", F.explode(readable(F.col("payload"))).alias("_text"))
    first = F.get(_items(F.from_json("_text", "images string")["images"]), F.lit(0))
    name = bound(F.from_json(first, "`image.file.name` string")["image.file.name"], lambda x: base_name(F.replace(x, F.lit("\\"), F.lit("/"))))
    by_name = texts.select(F.col("label_id").alias("row_id"), F.col("scanned_at").alias("at"), F.lit("image.file.name").alias("field"), F.lit("name").alias("scope"), F.explode(F.array_compact(F.array(name))).alias("path"))
    named = by_member.unionAll(by_name).filter("trim(path) <> ''")
    return _keyed(named.withColumn("path", member_key(F.col("path"))), F.col("scope"), "path", "field", "row_id", "at")


def archive_spans(members: DataFrame) -> DataFrame:
    """Life spans of archive members under both of their keys: (archive, path), and for images the bare file name."""
    path = F.replace("member_path", F.lit("\\"), F.lit("/"))
    keys = F.array(
        F.struct(F.concat_ws("|", F.col("kind"), _archive(F.col("zip_path"))).alias("scope"), path.alias("path")),
        F.when(F.col("kind") == "image", F.struct(F.lit("name").alias("scope"), base_name(path).alias("path"))),
    )
    rows = members.filter("added_at is not null").select(F.col("added_at").alias("added"), F.coalesce("deleted_at", F.lit(_FOREVER).cast("timestamp_ntz")).alias("until"), F.explode(F.array_compact(keys)).alias("_k"))
    named = rows.select("added", "until", "_k.scope", "_k.path").filter("trim(path) <> ''")
    return _keyed(named.withColumn("path", member_key(F.col("path"))), F.col("scope"), "path", "added", "until")


def orphan_references(manifest: DataFrame, labels: DataFrame, members: DataFrame) -> DataFrame:
    """(ref_field, row_id, ref_month, ref_state) of every reference that does not hold at its row's scanned_at."""
    found = dangling(archive_references(manifest, labels), archive_spans(members))
    return found.select(F.col("field").alias("ref_field"), "row_id", F.date_format("at", "yyyy-MM").alias("ref_month"), F.col("state").alias("ref_state"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references per field, month and state."""
    return found.groupBy("ref_field", "ref_month", "ref_state").agg(F.count("*").alias("n_refs"))
