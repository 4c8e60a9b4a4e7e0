"""Splits that keep related records together: connected components, then hash ranges.

Records that share a volume or a staff author, also through each other, form a group. Groups are the connected
components of the graph of records and entities, found by alternating large-star and small-star rounds; each round
only needs minima per vertex, which Spark combines map-side, and a join with one row a vertex, for which very large
vertices are dealt out (``plans.skew``), so a volume or author that holds a third of all records costs no task more than
its share. A group's identifier is hashed into proportional split ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.ids import narrow, volume_key
from folioflow.plans.lineage import cut_lineage
from folioflow.plans.skew import join_hot

SPLITS = (("train", 0.8), ("dev", 0.1), ("final", 0.1))


def staff_number(author: Column) -> Column:
    """S and eight digits, however written (width, case, separators), else null."""
    compact = F.regexp_replace(F.upper(narrow(author)), "[\\s\\p{P}\\p{S}\\p{Z}\\p{Cf}]+", "")
    found = F.regexp_extract(compact, "(?<![A-Z])S([0-9]{8})(?![0-9])", 1)
    return F.when(found != "", found)


def _minima(pairs: DataFrame, by: str, value: str) -> DataFrame:
    return pairs.groupBy(by).agg(F.min(value).alias("_low"), F.count("*").alias("_n"))


def _large_star(edges: DataFrame) -> DataFrame:
    """For each vertex, its larger neighbours are linked to the smallest of its neighbourhood."""
    both = edges.select(F.col("v").alias("a"), F.col("u").alias("b")).unionAll(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    low = _minima(both, "a", "b").select("a", F.least("a", "_low").alias("_low"), "_n")
    return join_hot(both.filter("b > a"), low, ["a"], ["b"], "_n").select(F.col("b").alias("u"), F.col("_low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """For each vertex, its smaller neighbours and itself are linked to the smallest of them. Edges run from u to v < u."""
    low = _minima(edges, "u", "v")
    moved = join_hot(edges, low, ["u"], ["v"], "_n").select(F.col("v").alias("u"), F.col("_low").alias("v"))
    return moved.unionAll(low.select("u", F.col("_low").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of all vertices with an edge; component is the smallest vertex that can be reached.

    ``edges`` (u, v) are undirected; self loops, repeats and nulls are dropped. Goes on until a round changes nothing, which
    takes O(log² n) rounds; each round's edges are written to the checkpoint folder. Two aggregates a round, not the edges,
    reach the driver.
    """
    edges = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen = cut_lineage(edges), None
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        # Small-star leaves every u with its edges to v < u; stars only when no v is a u and each u has one v.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
        seen = state


def related_groups(records: DataFrame, entities: list[Column], vertex: str = "doc_id") -> DataFrame:
    """(vertex, group_id) of every record: the smallest record that shares entities with it, also through others.

    A null entity links nothing; a record without links is its own group. ``vertex`` must be unique and not null;
    rows where it is null are left out. Each entity's records are linked to its smallest record (a star), which
    needs one pre-aggregated minimum an entity instead of pairs.
    """
    keyed = records.filter(F.col(vertex).isNotNull()).select(F.col(vertex).alias("u"), F.posexplode(F.array(*entities)).alias("_kind", "_entity"))
    keyed = keyed.filter("_entity is not null")
    stars = keyed.groupBy("_kind", "_entity").agg(F.min("u").alias("v"), F.max("u").alias("_other"), F.count("*").alias("_n")).filter("v <> _other").drop("_other")
    edges = join_hot(keyed, stars, ["_kind", "_entity"], ["u"], "_n").select("u", "v")
    parts = connected_components(edges)
    return (
        records.filter(F.col(vertex).isNotNull()).select(F.col(vertex).alias("vertex")).join(parts, "vertex", "left")
        .select(F.col("vertex").alias(vertex), F.coalesce("component", "vertex").alias("group_id"))
    )


def document_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, group_id): documents of one volume or one staff author, also through each other."""
    return related_groups(documents, [volume_key(F.col("document_id")), staff_number(F.col("author"))])


def broken_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, group_id) of all documents of a group whose non-null delivered dataset_splits differ.

    Documents without split are listed with their group but do not make it differ. doc_id is unique; rows without it are
    left out. Blank and unknown authors and null document_ids link nothing; other columns are not read.
    """
    groups = document_groups(documents)
    labelled = groups.join(documents.select("doc_id", "dataset_split"), "doc_id")
    mixed = labelled.groupBy("group_id").agg(F.min("dataset_split").alias("_a"), F.max("dataset_split").alias("_b")).filter("_a <> _b").select("group_id")
    return groups.join(mixed, "group_id", "left_semi").select("doc_id", "group_id")


def hash_split(group: Column, splits: tuple[tuple[str, float], ...] = SPLITS, seed: str = "split") -> Column:
    """The split whose share of the 64-bit hash range the group's hash falls into; shares are normalised to sum to 1."""
    place = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), group.cast("string")), 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    total, bound, chosen = sum(w for _, w in splits), 0.0, None
    for name, weight in splits[:-1]:
        bound += weight / total
        chosen = F.when(place < bound, name) if chosen is None else chosen.when(place < bound, name)
    return F.lit(splits[0][0]) if chosen is None else chosen.otherwise(splits[-1][0])


def assign_splits(documents: DataFrame, manifest: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS, seed: str = "split") -> DataFrame:
    """(src, row_id, group_key, dataset_split) for all documents and all manifest pages.

    A group's key is its smallest volume, or its smallest document where none has one, so pages of a volume that no
    document names are split alike. Empty tables give no rows; null identifiers form groups of one.
    """
    docs = document_groups(documents).join(documents.select("doc_id", volume_key(F.col("document_id")).alias("volume")), "doc_id")
    names = docs.groupBy("group_id").agg(F.coalesce(F.min("volume"), F.concat(F.lit("doc:"), F.min("doc_id").cast("string"))).alias("group_key"))
    volumes = docs.filter("volume is not null").select("volume", "group_id").distinct().join(names, "group_id").select("volume", "group_key")
    pages = manifest.select(F.col("row_id"), volume_key(F.col("id")).alias("volume")).join(volumes, "volume", "left")
    rows = docs.join(names, "group_id").select(F.lit("documents").alias("src"), F.col("doc_id").alias("row_id"), "group_key").unionAll(
        pages.select(F.lit("manifest"), "row_id", F.coalesce("group_key", "volume", F.concat(F.lit("row:"), F.col("row_id").cast("string"))))
    )
    return rows.withColumn("dataset_split", hash_split(F.col("group_key"), splits, seed))
