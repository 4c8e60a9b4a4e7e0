from __future__ import annotations

import random
import unicodedata
from datetime import datetime, timedelta

from folioflow.operators import references

BASE = datetime(2024, 1, 1)
MANIFEST = "row_id long, image_zip string, image_member string, label_zip string, label_member string, scanned_at timestamp_ntz, space string, key int"
LABELS = "label_id long, scanned_at timestamp_ntz, payload string, row_id string"
MEMBERS = "zip_path string, member_path string, kind string, added_at timestamp_ntz, deleted_at timestamp_ntz, field string"


def plain(path):
    return unicodedata.normalize("NFC", path.replace("\\", "/")).lower()


def expected(manifest, labels, members):
    spans = {}
    for zip_path, path, kind, added, deleted, _ in members:
        if path is None or added is None or not path.strip():
            continue
        spans.setdefault((kind, zip_path, plain(path)), []).append((added, deleted))
        if kind == "image":
            spans.setdefault(("name", None, plain(path).split("/")[-1]), []).append((added, deleted))
    asked = []
    for row_id, image_zip, image, label_zip, label, at, *_ in manifest:
        asked += [("manifest.image_member", row_id, ("image", image_zip, image), at), ("manifest.label_member", row_id, ("label", label_zip, label), at)]
    for label_id, at, name, _ in labels:
        asked.append(("image.file.name", label_id, ("name", None, name and name.replace("\\", "/").split("/")[-1]), at))
    out = set()
    for field, row_id, (kind, zip_path, path), at in asked:
        if path is None or not path.strip() or at is None:
            continue
        found = spans.get((kind, zip_path, plain(path)))
        if not found:
            state = "missing"
        elif any(a <= at and (d is None or d > at) for a, d in found):
            continue
        else:
            state = "late" if any(a > at for a, _ in found) else "deleted"
        out.add((field, row_id, at.strftime("%Y-%m"), state))
    return out


def test_references_agree_with_brute_force_and_hot_blocks_change_nothing(spark):
    rng = random.Random(5)
    day = lambda: BASE + timedelta(days=rng.randrange(90), hours=rng.randrange(3))
    paths = [f"원천/교육/ab-{n:06d}-p{p:03d}.jpg" for n in range(6) for p in (1, 2, 3, 7)] + ["no numbers.jpg", "x/y/only-12.jpg", "한글/12345678901234567890-99999999.jpg", None, "", " "]
    members = []
    for path in paths:
        for _ in range(rng.choice([0, 1, 1, 3])):
            added = day()
            members.append((rng.choice(["a.zip", "b.zip"]), path, "image", added, rng.choice([None, added + timedelta(days=rng.randrange(20))]), "x"))
            members.append(("l.zip", path and path.replace(".jpg", ".json"), "label", added, None, "x"))
    members += members[:7]
    spell = lambda p: p and rng.choice([p, p.upper(), p.replace("/", "\\"), unicodedata.normalize("NFD", p)])
    manifest = [(i, rng.choice(["a.zip", "b.zip"]), spell(p), "l.zip", spell(p and p.replace(".jpg", ".json")), rng.choice([day(), None]) if i % 9 == 0 else day(), "s", 1) for i, p in enumerate(rng.choices(paths, k=120))]
    labels = [(i, day(), p and p.split("/")[-1], "z") for i, p in enumerate(rng.choices(paths, k=40))]
    import json

    payloads = [(i, at, json.dumps({"images": [{"image.file.name": name}, {"image.file.name": "other.jpg"}]}), x) for i, at, name, x in labels]
    frames = spark.createDataFrame(manifest, MANIFEST), spark.createDataFrame(payloads, LABELS), spark.createDataFrame(members, MEMBERS)
    want = expected(manifest, labels, members)
    found = [tuple(r) for r in references.orphan_references(*frames).collect()]
    assert set(found) == want and len(found) == len(want)
    keyed = references.archive_references(frames[0], frames[1]), references.archive_spans(frames[2])
    assert {(r.field, r.row_id, r.state) for r in references.dangling(*keyed, hot_block=3).collect()} == {(f, i, s) for f, i, _, s in want}


def test_runs_are_maximal_and_end_at_blocks(spark):
    keys = [1, 2, 3, 3, 7, (1 << 16) - 1, 1 << 16, (1 << 16) + 1]
    found = references.key_runs(spark.createDataFrame([("s", k) for k in keys], "space string, key long")).collect()
    assert {(r.start, r.end) for r in found} == {(1, 3), (7, 7), ((1 << 16) - 1, (1 << 16) - 1), (1 << 16, (1 << 16) + 1)}


def test_empty_tables_have_no_orphans(spark):
    empty = spark.createDataFrame([], MANIFEST), spark.createDataFrame([], LABELS), spark.createDataFrame([], MEMBERS)
    assert references.orphan_references(*empty).count() == 0
    assert references.orphan_report(references.orphan_references(*empty)).count() == 0
