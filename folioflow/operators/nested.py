"""Deeply nested label records as flat tables, one per level, linked to their parents.

Two steps. ``label_tree`` (JVM) turns the payload text into one nested column: broken payloads become null, payloads
wrapped in a JSON string or led by a byte-order mark are unwrapped, and a single object in place of a list becomes a
list of one. ``flatten`` then works on Arrow buffers only: list offsets give each child's parent index, keys and
parent places are propagated by a vectorised take, and no row is parsed or looped over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Levels from the top: name of the flat table -> path of list fields in the tree.
LEVELS: dict[str, tuple[str, ...]] = {
    "images": ("images",),
    "annotations": ("annotations",),
    "words": ("annotations", "words"),
    "alternatives": ("annotations", "words", "alternatives"),
}
#: Value columns of each flat table.
VALUES: dict[str, tuple[str, ...]] = {
    "images": ("file_name", "category", "width", "capture"),
    "annotations": ("id", "text", "bbox", "review"),
    "words": ("word", "conf"),
    "alternatives": ("word", "score"),
}
_MARKS = "^[\\s\\uFEFF\\u200B]+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unwrapped(text: Column) -> Column:
    inner = lambda bare: F.get(F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<string>"), F.lit(0))
    return bound(F.regexp_replace(text, _MARKS, ""), lambda bare: F.when(bare.startswith('"'), F.regexp_replace(inner(bare), _MARKS, "")).otherwise(bare))


def object_text(payload: Column) -> Column:
    """The JSON object in a payload as text, unwrapped from up to two string layers and leading marks, else null.

    Null, empty, truncated, scalar and array payloads give null.
    """
    return bound(F.rtrim(_unwrapped(_unwrapped(payload))), lambda text: F.when(text.startswith("{") & text.endswith("}"), text))


def valid_object(text: Column) -> Column:
    """``text`` where the whole of it parses as JSON, else null."""
    return bound(text, lambda x: F.when(F.try_parse_json(x).isNotNull(), x))


def _items(raw: Column) -> Column:
    """Raw JSON of a list's places; an object in place of the list is its only item; anything else is null."""
    return bound(raw, lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).when(x.startswith("{"), F.array(x)))


def _objects(raw: Column, schema: str) -> Column:
    """The list's places parsed by ``schema``; places that hold no object (or text that spells one) are null."""
    return F.transform(_items(raw), lambda x: F.when(x.startswith("{"), F.from_json(x, schema)))


def label_tree(text: Column) -> Column:
    """images and annotations of a valid label object, with annotation words and their alternatives.

    Scalars are kept as text, since ids and numbers come in mixed JSON types; absent and null fields are null.
    """
    return bound(F.from_json(text, "images string, annotations string"), _tree)


def _tree(top: Column) -> Column:
    images = F.transform(
        _objects(top["images"], "`image.file.name` string, `image.category` string, `image.width` string, `image.capture` string"),
        lambda x: F.when(x.isNotNull(), F.struct(x["image.file.name"].alias("file_name"), x["image.category"].alias("category"), x["image.width"].alias("width"), x["image.capture"].alias("capture"))),
    )
    word = lambda w: F.when(
        w.isNotNull(),
        F.struct(w["word"].alias("word"), w["conf"].alias("conf"), _objects(w["alternatives"], "word string, score string").alias("alternatives")),
    )
    note = lambda a: F.when(
        a.isNotNull(),
        F.struct(
            a["id"].alias("id"), a["annotation.text"].alias("text"), a["annotation.bbox"].alias("bbox"), a["annotation.review"].alias("review"),
            F.transform(_objects(a["annotation.words"], "word string, conf string, alternatives string"), word).alias("words"),
        ),
    )
    notes = F.transform(_objects(top["annotations"], "id string, `annotation.text` string, `annotation.bbox` string, `annotation.review` string, `annotation.words` string"), note)
    return F.struct(images.alias("images"), notes.alias("annotations"))


def _descend(batch: pa.RecordBatch, key: str, path: tuple[str, ...]) -> tuple[pa.Array, pa.Array, pa.Array, pa.StructArray]:
    """Keys, places, parent places and structs of all objects at ``path``, by offsets and takes."""
    keys, structs = batch.column(key), batch.column("tree")
    place: pa.Array | None = None
    parent: pa.Array | None = None
    for step in path:
        lists = pc.struct_field(structs, step)
        index = pc.list_parent_indices(lists)
        children = pc.list_flatten(lists)
        text = pc.cast(_ordinals(index), pa.string())
        parent = None if place is None else pc.take(place, index)
        place = text if parent is None else pc.binary_join_element_wise(parent, text, ".")
        keys = pc.take(keys, index)
        structs = children
        if structs.null_count:
            real = pc.is_valid(structs)
            keys, place, structs = keys.filter(real), place.filter(real), structs.filter(real)
            parent = None if parent is None else parent.filter(real)
    return keys, place, parent if parent is not None else pa.nulls(len(place), pa.string()), structs


def _ordinals(index: pa.Array) -> pa.Array:
    """0-based place of each child in its list, from the ascending parent indices."""
    at = index.to_numpy(zero_copy_only=False)
    if not len(at):
        return pa.array([], pa.int64())
    first = np.concatenate([[True], at[1:] != at[:-1]])
    starts = np.flatnonzero(first)
    return pa.array(np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at)))))


def readable(payload: Column) -> Column:
    """The valid object text of a payload as an array of one, or an empty one: exploded, it is not evaluated again."""
    return F.array_compact(F.array(valid_object(object_text(payload))))


def trees(records: DataFrame, key: str = "label_id", payload: str = "payload") -> DataFrame:
    """(key, tree) of every readable record; unreadable ones give no row."""
    return records.select(F.col(key).alias("key"), F.explode(readable(F.col(payload))).alias("_text")).select("key", label_tree(F.col("_text")).alias("tree"))


def flatten(records: DataFrame, level: str, key: str = "label_id", payload: str = "payload") -> DataFrame:
    """The flat table of one level: (key, node, parent, values).

    ``node`` is the object's 0-based place from the top, joined by dots; ``parent`` the place of its parent object
    (null at the top level). Nulls in a list take a place but give no row. Other columns of ``records`` are not read.
    Record delivered twice under two keys give rows under both; an empty table gives no rows.
    """
    path, values = LEVELS[level], VALUES[level]
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, place, parent, structs = _descend(batch, "key", path)
            yield pa.RecordBatch.from_arrays([keys, place, parent, *(pc.struct_field(structs, v) for v in values)], names=[key, "node", "parent", *values])

    return trees(records, key, payload).mapInArrow(run, f"`{key}` {kind}, node string, parent string, " + ", ".join(f"{v} string" for v in values))


def list_paths(schema: StructType) -> dict[str, tuple[str, ...]]:
    """The lists of structs of a nested schema: dotted name -> path, parents before children."""
    found: dict[str, tuple[str, ...]] = {}

    def walk(fields: StructType, path: tuple[str, ...]) -> None:
        for field in fields:
            if isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, StructType):
                found[".".join((*path, field.name))] = (*path, field.name)
                walk(field.dataType.elementType, (*path, field.name))

    walk(schema, ())
    return found


def flatten_column(records: DataFrame, key: str, column: str, path: tuple[str, ...]) -> DataFrame:
    """The flat table of the list at ``path`` of a nested column: (key, node, parent, all fields that are no lists of structs).

    As ``flatten``, for any schema: names that are ``key``, node or parent get ``_`` behind. Null records and lists, and
    nulls in lists, give no row; optional fields are null where they are absent.
    """
    level = records.schema[column].dataType
    for step in path:
        level = level[step].dataType.elementType
    fields = [f for f in level if not (isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType))]
    names = [f.name + "_" if f.name in (key, "node", "parent") else f.name for f in fields]
    schema = StructType([StructField(key, records.schema[key].dataType), StructField("node", StringType()), StructField("parent", StringType()), *(StructField(n, f.dataType) for n, f in zip(names, fields, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, place, parent, structs = _descend(batch, "key", path)
            yield pa.RecordBatch.from_arrays([keys, place, parent, *(pc.struct_field(structs, f.name) for f in fields)], names=schema.names)

    return records.filter(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).alias("tree")).mapInArrow(run, schema)


def nodes(records: DataFrame, key: str = "label_id", payload: str = "payload") -> DataFrame:
    """(key, child, node) of every object on every level, from one pass over the trees."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, path in LEVELS.items():
                keys, place, _, _ = _descend(batch, "key", path)
                yield pa.RecordBatch.from_arrays([keys, pa.repeat(level, len(keys)), place], names=[key, "child", "node"])

    return trees(records, key, payload).mapInArrow(run, f"`{key}` {kind}, child string, node string")
