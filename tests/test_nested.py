from __future__ import annotations

import json

from folioflow.operators import nested


def brute(payload):
    for _ in range(3):
        if payload is None:
            return None
        try:
            value = json.loads(payload.lstrip("﻿​ \n"))
        except ValueError:
            return None
        if not isinstance(value, str):
            return value if isinstance(value, dict) else None
        payload = value
    return None


def items(x):
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else []


def places(label_id, payload):
    root, out = brute(payload), []
    if root is None:
        return out
    out += [(label_id, "images", str(i)) for i, x in enumerate(items(root.get("images"))) if isinstance(x, dict)]
    for i, a in enumerate(items(root.get("annotations"))):
        if isinstance(a, dict):
            out.append((label_id, "annotations", str(i)))
            for j, w in enumerate(items(a.get("annotation.words"))):
                if isinstance(w, dict):
                    out.append((label_id, "words", f"{i}.{j}"))
                    out += [(label_id, "alternatives", f"{i}.{j}.{k}") for k, x in enumerate(items(w.get("alternatives"))) if isinstance(x, dict)]
    return out


WORD = {"word": "가", "conf": 0.5, "alternatives": [None, {"word": "나", "score": 0.1}, {"word": "다"}]}
GOOD = {"images": [{"image.file.name": "a.jpg"}, None, {"image.width": 3}], "annotations": [{"id": 1, "annotation.text": "x", "annotation.words": [None, WORD, WORD]}, None, {"id": "2", "annotation.words": WORD}, {"annotation.words": None}]}
PAYLOADS = [
    json.dumps(GOOD), "﻿" + json.dumps(GOOD, indent=1), json.dumps(json.dumps(GOOD, ensure_ascii=False)), json.dumps("﻿" + json.dumps(GOOD)), json.dumps([GOOD]), "null", "", "{", None,
    json.dumps(GOOD)[:-9], '{"images": {"image.file.name": "b.jpg"}, "annotations": null}', '{"annotations": {"id": 3, "annotation.words": {"word": "z"}}}', '"plain"', "{}", json.dumps({"images": [], "annotations": [[], 5, "x", {}]}),
    json.dumps({"annotations": [{"annotation.words": [{"word": "w" * 20_000, "alternatives": {"word": "v"}}] * 500}]}),
]


def frame(spark):
    return spark.createDataFrame([(i, p, "clash", "x") for i, p in enumerate(PAYLOADS)] + [(99, PAYLOADS[0], "clash", "x")], "label_id long, payload string, key string, tree string")


def test_nodes_agree_with_a_recursive_walk(spark):
    want = sorted(x for i, p in [*enumerate(PAYLOADS), (99, PAYLOADS[0])] for x in places(i, p))
    assert sorted(tuple(r) for r in nested.nodes(frame(spark)).collect()) == want


def test_flat_tables_keep_values_and_parents(spark):
    words = [tuple(r) for r in nested.flatten(frame(spark), "words").filter("label_id = 0").collect()]
    assert words == [(0, "0.1", "0", "가", "0.5"), (0, "0.2", "0", "가", "0.5"), (0, "2.0", "2", "가", "0.5")]
    notes = [tuple(r)[:5] for r in nested.flatten(frame(spark), "annotations").filter("label_id = 0").collect()]
    assert notes == [(0, "0", None, "1", "x"), (0, "2", None, "2", None), (0, "3", None, None, None)]
    for level, values in nested.VALUES.items():
        assert nested.flatten(frame(spark), level).columns == ["label_id", "node", "parent", *values]


def test_every_child_has_its_parent(spark):
    parents = {(r.label_id, r.node) for r in nested.flatten(frame(spark), "words").collect()}
    assert all((r.label_id, r.parent) in parents for r in nested.flatten(frame(spark), "alternatives").collect())


def test_empty_table(spark):
    assert nested.nodes(spark.createDataFrame([], "label_id long, payload string")).count() == 0


def test_any_nested_column(spark):
    schema = "k int, doc struct<title:string, parts:array<struct<node:int, tags:array<string>, size:struct<w:int>, lines:array<struct<text:string, parent:int>>>>, notes:array<struct<k:string>>>"
    docs = [(1, ("t", [(7, ["a"], (3,), [("x", 1), None, ("y", None)]), None, (8, None, None, None)], None)), (2, None), (None, (None, [], [("n",)])), (3, ("u", [(9, [], None, [("z", 2)])], [("m",), None]))]
    frame = spark.createDataFrame(docs, schema)
    assert nested.list_paths(frame.schema["doc"].dataType) == {"parts": ("parts",), "parts.lines": ("parts", "lines"), "notes": ("notes",)}
    rows = lambda *path: sorted((tuple(r) for r in nested.flatten_column(frame, "k", "doc", path).collect()), key=repr)
    assert rows("parts") == sorted([(1, "0", None, 7, ["a"], (3,)), (1, "2", None, 8, None, None), (3, "0", None, 9, [], None)], key=repr)
    assert rows("parts", "lines") == sorted([(1, "0.0", "0", "x", 1), (1, "0.2", "0", "y", None), (3, "0.0", "0", "z", 2)], key=repr)
    assert rows("notes") == sorted([(None, "0", None, "n"), (3, "0", None, "m")], key=repr)
    assert nested.flatten_column(frame, "k", "doc", ("parts",)).columns == ["k", "node", "parent", "node_", "tags", "size"]
    assert nested.flatten_column(frame.limit(0), "k", "doc", ("parts",)).count() == 0
