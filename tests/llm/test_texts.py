from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import leakage, overlap, pii, sentences, textforms

HANGUL = [chr(c) for c in range(0xAC00, 0xAC00 + 2000)]


def sentence(rng, n):
    return " ".join("".join(rng.choices(HANGUL, k=rng.randrange(2, 6))) for _ in range(n))


def test_alignment_scores_agree_with_a_plain_table():
    rng = random.Random(1)
    pairs = [(np.array(rng.choices(range(3), k=rng.randrange(1, 12)), np.uint32), np.array(rng.choices(range(3), k=rng.randrange(1, 15)), np.uint32)) for _ in range(50)]

    def plain(a, b):
        best, last = 0, [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(0, last[j] + (1 if x == y else -2), last[j + 1] - 2, new[j] - 2))
            best, last = max(best, *new), new
        return best

    assert textforms.local_scores(pairs).tolist() == [plain(a, b) for a, b in pairs]
    assert textforms.local_scores([]).tolist() == []


def test_edit_distance():
    points = lambda s: textforms.code_points(s)
    assert [textforms.edit_distance(points(a), points(b)) for a, b in (("kitten", "sitting"), ("", "abc"), ("한글날", "한굴"), ("", ""))] == [3, 3, 2, 0]


def test_distance_by_bits_agrees_with_rows():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc가나", k=rng.randrange(90))) for _ in range(2))
        assert textforms.masked_distance(textforms.letter_masks(a), len(a), b) == textforms.edit_distance(textforms.code_points(a), textforms.code_points(b))


def item_index(items):
    texts = [(i, textforms.compact(t)) for i, t in items]
    grams = [(i, t, textforms.rolling_hashes(textforms.folded(t), min(leakage.GRAM, max(1, len(t)))).tolist()) for i, t in texts]
    held = Counter(g for _, _, all_ in grams for g in set(all_))
    return leakage.ItemIndex.build([(i, t, {g: held[g] for g in all_}) for i, t, all_ in grams])


def test_simhash_lookup_finds_all_windows_within_the_radius():
    rng = random.Random(2)
    index = item_index([(1, sentence(rng, 60)), (2, sentence(rng, 30))])
    for key, (prints, *_) in index.tables.items():
        probe = prints[:: max(1, len(prints) // 20)].copy()
        for i in range(len(probe)):
            for bit in rng.sample(range(64), leakage.RADIUS + (i % 2)):
                probe[i] ^= np.uint64(1) << np.uint64(bit)
        at, to = index.near(key, probe)
        want = {(i, j) for i in range(len(probe)) for j in range(len(prints)) if int(np.bitwise_count(probe[i] ^ prints[j])) <= leakage.RADIUS}
        assert set(zip(at.tolist(), to.tolist(), strict=True)) == want


def test_simhash_windows_agree_with_bit_counting():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 2**63, 200, dtype=np.uint64)
    for width, grid in ((8, 8), (32, 8), (32, 1), (5, 1), (40, 4)):
        got = leakage.simhashes(leakage.bit_counts(grams, grid), width, grid)
        bits = ((grams[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(int)
        # Bits come in the order of the counters: eight lanes of every eighth bit.
        want = [sum(1 << (b % 8 * 8 + b // 8) for b in range(64) if bits[s : s + width, b].sum() > width // 2) for s in range(0, (len(grams) // grid - width // grid) * grid + 1, grid)]
        assert got.tolist() == want


def test_leaks_whole_part_noisy_and_alike(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, 40)) for i in range(1, 6)] + [(9, None), (10, ""), (11, "!!"), (12, sentence(rng, 4))]
    text = dict(items)
    noise = lambda t: "".join(rng.choice(HANGUL) if rng.random() < 0.03 else c for c in t)
    docs = [
        (1, "train", sentence(rng, 50) + text[1] + sentence(rng, 30)), (2, "train", noise(text[2])), (3, "train", sentence(rng, 9) + text[3][: int(len(text[3]) * 0.7)]),
        (4, "train", sentence(rng, 9) + text[4][: int(len(text[4]) * 0.3)] + sentence(rng, 9)), (5, "dev", text[5]), (6, "train", None), (7, "train", ""), (8, None, text[1]),
        (9, "train", sentence(rng, 400_000) + text[5].replace(" ", "\n") + sentence(rng, 10)), (10, "train", text[1] + text[2]), (11, "train", text[12]), (11, "train", text[12]),
    ]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, dataset_split string, text string, item_id string")
    tests = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    got = sorted(tuple(r) for r in leakage.leaks(frame, tests).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (9, 5), (10, 1), (10, 2), (11, 12), (11, 12)]
    assert leakage.leaks(frame.limit(0), tests).count() == 0
    assert leakage.leaks(frame, tests.limit(0)).count() == 0
    old, leakage.ITEM_CHARS = leakage.ITEM_CHARS, 300
    try:
        assert sorted(tuple(r) for r in leakage.leaks(frame, tests).collect()) == got
    finally:
        leakage.ITEM_CHARS = old


def test_windowing_keeps_every_shared_run():
    rng = random.Random(5)
    for _ in range(60):
        size = rng.choice([5, 20, 30, 50, 80, 180, 400])
        _, gram, window = overlap.GRAMS[overlap.gram_numbers(np.array([size]))[0]]
        run = "".join(rng.choices(HANGUL, k=gram + window - 1))
        a, b = ("".join(rng.choices(HANGUL, k=rng.randrange(90))) + run + "".join(rng.choices(HANGUL, k=rng.randrange(90))) for _ in range(2))
        assert set(overlap.fingerprints(a, size)[0].tolist()) & set(overlap.fingerprints(b, size)[0].tolist())


def test_winnowing_agrees_with_plain_windows():
    rng = random.Random(8)
    texts = [textforms.code_points("".join(rng.choices("abc", k=k))) for k in (0, 1, 2, 3, 4, 5, 9, 40, 3, 77)]
    for gram, window in ((2, 1), (3, 1), (4, 2), (6, 3), (10, 4)):
        want = []
        for i, t in enumerate(texts):
            h = textforms.rolling_hashes(t, min(gram, len(t))).tolist() if len(t) else []
            at = {min(range(s, min(s + window, len(h))), key=lambda p: (h[p], p)) for s in range(max(1, len(h) - window + 1))} if h else set()
            first = {}
            for p in sorted(at):
                first.setdefault(h[p], p)
            want += [(i, x, p) for x, p in first.items()]
        assert sorted(zip(*(c.tolist() for c in overlap.winnowed(texts, gram, window)), strict=True)) == sorted(want)


def altered(rng, text, rate, kind):
    out = list(text)
    for at in rng.sample(range(len(text)), int(len(text) * rate)):
        out[at] = rng.choice(HANGUL) if kind == "other" else "" if kind == "gone" and rng.random() < 0.5 else out[at] + rng.choice(HANGUL) if kind == "gone" else out[at]
    return "".join(out)


@pytest.mark.parametrize("kind", ["other", "gone"])
@pytest.mark.parametrize("size", [12, 24, 40, 47, 48, 59, 61, 72, 80, 100, 150, 169, 171, 200, 300, 341, 400, 600])
def test_pairs_up_to_a_fifth_become_candidates_and_pass(size, kind):
    # At every size and rate, also next to a change of the gram; short texts have few grams to lose.
    rng = random.Random(size)
    for rate in (0.05, 0.1, 0.12, 0.15, 0.18, 0.2):
        hit, tries = 0, 60
        for _ in range(tries):
            a = "".join(rng.choices(HANGUL, k=size))
            b = altered(rng, a, rate, kind)
            most = int(max(len(a), len(b)) * overlap.DISTANCE)
            x, y = overlap.letter_bits(a), overlap.letter_bits(b)
            assert max(np.bitwise_count(x & ~y).sum(), np.bitwise_count(y & ~x).sum()) <= most
            assert overlap.aligned_distance(a, b, most) <= most
            hit += bool(set(overlap.fingerprints(a)[0].tolist()) & set(overlap.fingerprints(b, len(a))[0].tolist()))
        assert hit >= (0.95 if size >= 40 else 0.9) * tries - 2, (rate, hit)


NOTES = "ann_key long, document_id string, id int, annotation struct<text:string,bbox:array<double>>, page string, class string"
PAGES = "doc_id long, document_id string, dataset_split string, source string, side string"


def test_overlaps_agree_with_all_pairs(spark):
    rng = random.Random(6)
    base = [sentence(rng, 24) for _ in range(12)]
    pages, notes, key = [], [], 0
    for i in range(60):
        text = base[i % 12] if rng.random() < 0.6 else sentence(rng, rng.choice([2, 20]))
        rate = rng.choice([0, 0, 0.03, 0.06, 0.5])
        text = "".join(rng.choice(HANGUL) if c != " " and rng.random() < rate else c for c in text)
        page = f"ab12-{i:09d}-p001"
        pages.append((i, rng.choice([page, page.upper(), page.replace("-", "")]), rng.choice(["train", "train", "dev", "final", None]), "s", "x"))
        words = text.split()
        for n, part in enumerate([words[:7], words[7:14], words[14:]]):
            key += 1
            notes.append((key, page, n, (" ".join(part), None), "x", "y"))
            if rng.random() < 0.3:
                notes.append(notes[-1])
    notes += [(9999, pages[0][1], None, (None, None), "x", "y"), (None, None, None, None, None, None), (10_000, "ab12-000000001-p001", 9, ("  ", []), "x", "y")]
    rng.shuffle(notes)
    joined = {}
    for k, page, n, note, *_ in sorted({(k, p, n, t and t[0]) for k, p, n, t, *_ in notes if k and t and (t[0] or "").strip()}):
        joined.setdefault(page.replace("-", "").lower(), []).append((n, k, note))
    text = {p: textforms.compact(" ".join(t for _, _, t in sorted(v))) for p, v in joined.items()}
    want = set()
    for i, p, s, *_ in pages:
        for j, q, t, *_ in pages:
            a, b = (text.get(x.replace("-", "").lower()) for x in (p, q))
            if s == "train" and t in ("dev", "final") and a and b and textforms.edit_distance(textforms.code_points(a), textforms.code_points(b)) <= 0.2 * max(len(a), len(b)):
                want.add((min(i, j), max(i, j)))
    frames = spark.createDataFrame(pages, PAGES), spark.createDataFrame(notes, NOTES)
    got = [tuple(r) for r in overlap.found_pairs(*frames).collect()]
    assert set(got) == want and len(got) == len(want) and want
    assert overlap.overlap_report(*frames).agg({"n_pairs": "sum"}).first()[0] == len(want)
    assert overlap.found_pairs(frames[0].limit(0), frames[1]).count() == overlap.found_pairs(frames[0], frames[1].limit(0)).count() == 0


def test_boilerplate_is_salted_and_copies_are_counted_by_class(spark, monkeypatch):
    rng = random.Random(9)
    common = sentence(rng, 12)
    pages, notes = [], []
    for i in range(60):
        text = common + sentence(rng, 3) if i % 3 else common
        page = f"ab12-{i:09d}-p001"
        pages.append((i, page, rng.choice(["train", "dev", "final"]), "s", "x"))
        notes.append((i, page, 0, (text, None), "x", "y"))
    frames = spark.createDataFrame(pages, PAGES), spark.createDataFrame(notes, NOTES)
    want = sorted(map(tuple, overlap.found_pairs(*frames).collect()))
    report = sorted(map(tuple, overlap.overlap_report(*frames).collect()), key=str)
    assert sum(r[3] for r in report) == len(want) == len(set(want)) > 100
    monkeypatch.setattr(overlap, "HEAVY", 2)
    monkeypatch.setattr(overlap, "SALTS", 3)
    assert sorted(map(tuple, overlap.found_pairs(*frames).collect())) == want
    assert sorted(map(tuple, overlap.overlap_report(*frames).collect()), key=str) == report


@pytest.mark.parametrize(("sizes", "rate", "least"), [((90, 240), 0.2, 38), ((62, 66), 0.18, 38), ((40, 60), 0.2, 36)])
def test_near_same_pages_with_spread_differences(spark, sizes, rate, least):
    rng = random.Random(7)
    signs = [chr(c) for c in range(0xAC00, 0xAC00 + 900)]
    pages, notes = [], []
    for i in range(40):
        text = [rng.choice(signs) for _ in range(rng.randint(*sizes))]
        other = text[: 59 if rate == 0.18 else None]
        for j in rng.sample(range(len(other)), int((rate * len(text)) - (len(text) - len(other)))):
            other[j] = rng.choice(signs)
        for side, t in enumerate((text, other)):
            page = f"ab12-{2 * i + side:09d}-p001"
            pages.append((2 * i + side, page, ("train", "dev")[side], "s", "x"))
            notes.append((2 * i + side, page, 0, ("".join(t), None), "x", "y"))
    got = {tuple(r) for r in overlap.found_pairs(spark.createDataFrame(pages, PAGES), spark.createDataFrame(notes, NOTES)).collect()}
    assert len(got) >= least and got <= {(2 * i, 2 * i + 1) for i in range(40)}


def near_same(a, b):
    return textforms.edit_distance(textforms.code_points(a), textforms.code_points(b)) <= overlap.DISTANCE * max(len(a), len(b))


@pytest.mark.parametrize("blocks", [None, (3, 2)])
def test_every_pair_within_a_fifth_is_found(spark, monkeypatch, blocks):
    # An edit at every fifth letter leaves runs of four only; in forms all that pages share may be what all pages have.
    if blocks:
        monkeypatch.setattr(overlap, "HEAVY", blocks[0])
        monkeypatch.setattr(overlap, "SALTS", blocks[1])
    rng = random.Random(12)
    common = "".join(rng.choices(HANGUL, k=90))
    texts = []
    for size in (1, 2, 4, 5, 6, 9, 10, 15, 20, 31, 60, 85, 86, 120, 150, 169, 212, 240, 265, 330, 700):
        for signs in (HANGUL, "abcdefghijklmnopqrstuvwxyz0123456789"):
            a = "".join(rng.choices(signs, k=size))
            for kind in ("other", "gone", "more"):
                places = range(4, size, 5)
                texts += [a, "".join("" if i in places and kind == "gone" else c + rng.choice(signs) if i % 4 == 3 and kind == "more" else rng.choice(signs) if i in places and kind == "other" else c for i, c in enumerate(a))]
    for _ in range(20):
        a = common + "".join(rng.choices(HANGUL, k=40))
        texts += [a, "".join(rng.choice(HANGUL) if i % 5 == 2 else c for i, c in enumerate(a)), "".join(rng.choice(HANGUL) if i < 90 and i % 4 == 2 else c for i, c in enumerate(a))]
    sides = [("train", "dev", "final")[i % 3] for i in range(len(texts))]
    for i in range(0, len(texts) - 1, 2):
        sides[i : i + 2] = rng.choice([("train", "dev"), ("final", "train")])
    pages = [(i, f"ab12-{i:09d}-p001", side, "s", "x") for i, side in enumerate(sides)]
    notes = [(i, page, 0, (text, None), "x", "y") for (i, page, *_), text in zip(pages, texts, strict=True)]
    compact = [textforms.compact(t) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if (sides[i] == "train") != (sides[j] == "train") and abs(len(compact[i]) - len(compact[j])) <= overlap.DISTANCE * max(len(compact[i]), len(compact[j])) and near_same(compact[i], compact[j])}
    got = sorted(map(tuple, overlap.found_pairs(spark.createDataFrame(pages, PAGES), spark.createDataFrame(notes, NOTES)).collect()))
    assert got == sorted((j, i) for i, j in want) and len(got) > 100


def bitmaps(texts, words):
    bits = [b"".join(overlap.letter_bits(t, words * times, gram).tobytes() for gram, times, least in overlap.LEVELS if words >= least) for t in texts]
    return overlap.Bitmaps.of(pa.table({"class": range(len(texts)), "chars": np.array([len(t) for t in texts], np.int32), "words": np.full(len(texts), words, np.int32), "bits": bits}))


@pytest.mark.parametrize("signs", [HANGUL, "etaoinshrdlu"])
def test_bitmaps_never_rule_out_a_near_same_pair(signs):
    rng = random.Random(13)
    for size in (3, 8, 17, 40, 100, 130, 211, 212, 270, 530, 1100):
        texts = ["".join(rng.choices(signs, k=size)) for _ in range(30)]
        others = [altered(rng, t, rate, kind) for t in texts for rate in (0.1, 0.2) for kind in ("other", "gone")]
        words = overlap.band_words(int(math.log(size) / math.log(1 / (1 - overlap.DISTANCE))))
        left, right = bitmaps(texts, words), bitmaps(others, words)
        near = {(j // 4, j) for j in range(len(others)) if near_same(texts[j // 4], others[j])}
        for x, y in ((left, right), (left.folded_to(words // 2), right.folded_to(words // 2))):
            assert near and near <= {(x.numbers[i], y.numbers[j]) for p, q in overlap.near_bitmaps(x, y) for i, j in zip(p.tolist(), q.tolist(), strict=True)}


def test_distances_above_the_bound_end_early():
    rng = random.Random(14)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(1, 40))) for _ in range(2))
        far, most = textforms.edit_distance(textforms.code_points(a), textforms.code_points(b)), rng.randrange(30)
        assert (got := textforms.masked_distance(textforms.letter_masks(a), len(a), b, most)) == far or got > most < far
        assert (overlap.aligned_distance(a, b, most) <= most) == (far <= most)


@pytest.mark.parametrize("size", [24, 40, 60, 99, 120, 180, 240, 480, 1000, 4000])
def test_items_with_a_tenth_of_wrong_letters(size):
    rng = random.Random(size)
    signs = [chr(c) for c in range(0xAC00, 0xAC00 + 900)]
    tries = 40 if size < 1000 else 10
    for rate, part, share in ((0.05, 1, 0.95), (0.1, 1, 0.9), (0.06, 0.8, 0.9)):
        if size < 60 and part < 1:
            continue
        items = [(i, "".join(rng.choice(signs) for _ in range(size))) for i in range(tries)]
        texts = []
        for _, t in items:
            kept = list(t[: int(size * part)])
            for j in rng.sample(range(len(kept)), int(len(kept) * rate)):
                kept[j] = rng.choice(signs)
            texts.append("".join(rng.choice(signs) for _ in range(rng.randrange(90))) + "".join(kept) + "".join(rng.choice(signs) for _ in range(200)))
        hits = set(item_index(items).search(texts))
        assert hits <= {(i, i) for i in range(tries)}
        assert len(hits) >= share * tries - 2, (rate, part, len(hits))


def test_shingles_are_needed_for_a_score():
    rng = random.Random(12)
    for _ in range(400):
        item = "".join(rng.choices("abcdefgh", k=rng.randrange(8, 60)))
        text = list(item[rng.randrange(3) :])
        for _ in range(rng.randrange(6)):
            text[rng.randrange(len(text))] = rng.choice(["", "x", "ab"])
        a, b = (textforms.code_points(t) for t in (item, "".join(text) or "x"))
        if textforms.local_scores([(a, b)])[0] > leakage.SHARE * len(a):
            own, there = (Counter(textforms.rolling_hashes(t, leakage.GRAM).tolist()) for t in (a, b))
            assert (own & there).total() >= leakage.needed(len(a))


@pytest.mark.parametrize("every", [24, 30, 45, 60])
def test_noisy_leaks_of_long_items(every):
    rng = random.Random(every)
    signs = [chr(c) for c in range(0xAC00, 0xAC00 + 900)]
    items = [(i, "".join(rng.choice(signs) for _ in range(600))) for i in range(20)]
    texts = ["".join(rng.choice(signs) if j % every == every // 2 else c for j, c in enumerate(t)) for _, t in items]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(90))) + t for t in texts]
    assert set(item_index(items).search(texts)) == {(i, i) for i in range(20)}


GIVEN, LATIN = frozenset({"가온", "세찬"}), frozenset({"orla", "quillby"})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("성명: 김가온", [("NAME", 4)]), ("담당 남 궁세찬 주무관", [("NAME", 3)]), ("가람시 가온 조례", []), ("QUILLBY Orla 님", [("NAME", 0)]), ("quillby@mail.example", [("EMAIL", 0)]),
        ("연락처 (02)0627-7007", [("PHONE", 5)]), ("☎ ＋82 10-0749-0716", [("PHONE", 3)]), ("공일공-공팔육오-구팔삼팔", [("PHONE", 0)]), ("예산과목 299-013-289", []), ("사업자등록번호 647-44-65054", []),
        ("휴대 01O-0l36-5537", [("PHONE", 3)]), ("주민등록번호 ８４１００８–１４００７４５", [("ID_NUMBER", 7)]), ("(M38660382)", [("ID_NUMBER", 1)]), ("17-14-958718-31", [("ID_NUMBER", 0)]),
        ("raon.b골뱅이inbox.invalid / nuri [at] mail . example", [("EMAIL", 0), ("EMAIL", 25)]), ("주소: 단비시 여울길 292, 120동 1505호", [("ADDRESS", 4)]), ("가람시 새빛동 338-32번지 거주", [("ADDRESS", 0)]),
        ("93 Fallow Road, Apt 48, Fennelby 거주", [("ADDRESS", 0)]), ("은하로 일대 산책로 12개소", []), ("2025-02-15 ~ 2026.01.01.", []), ("v1.15 mandatory 10:30~12:40", []), (None, []), ("", []), (" \n", []),
    ],
)
def test_mentions(text, want):
    assert [(k, a) for k, a, _ in pii.mentions(text, GIVEN, LATIN)] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("john at example dot com", [("EMAIL", 0, 23)]), ("write to jane dot doe at mail dot example dot org today", [("EMAIL", 9, 49)]), ("anna punkt maier ät post punkt de", [("EMAIL", 0, 33)]), ("nuri 골뱅이 mail 점 example", [("EMAIL", 0, 23)]),
        ("nuri(アット)mail(ドット)example", [("EMAIL", 0, 25)]), ("look at this dot on the map", []), ("arrive at nine dot", []),
        ("call zero one zero, five five two one, nine nine zero four", [("PHONE", 5, 58)]), ("null eins sieben drei vier fünf sechs sieben acht neun", [("PHONE", 0, 54)]), ("공 일 공 오 오 이 일 구 구 영 사", [("PHONE", 0, 21)]),
        ("电话〇一〇五五二一九九〇四", [("PHONE", 2, 13)]), ("ศูนย์ แปด หนึ่ง สอง สาม สี่ ห้า หก เจ็ด แปด", [("PHONE", 0, 43)]), ("one two three four", []), ("二〇二四年", []),
        ("wohnhaft Lindenstraße 12, 10115 Berlin", [("ADDRESS", 9, 38)]), ("Am Markt 3 b", [("ADDRESS", 0, 12)]), ("住在北京市海淀区中关村大街27号", [("ADDRESS", 0, 16)]), ("東京都千代田区丸の内1丁目9番1号", [("ADDRESS", 0, 17)]), ("อยู่ 99/1 หมู่ 4 ถนนพหลโยธิน", [("ADDRESS", 5, 28)]), ("im Jahr 2024 und Absatz 3", []),
        ("Contact: Imogen Farrow", [("NAME", 9, 22)]), ("대리인: 표다온", [("NAME", 5, 8)]), ("Ansprechpartner: Jürgen Köhler", [("NAME", 17, 30)]), ("姓名：王小明", [("NAME", 3, 6)]), ("氏名: 山田 太郎", [("NAME", 4, 9)]), ("ชื่อ: นายสมชาย ใจดี", [("NAME", 9, 19)]),
        ("Contact the office", []), ("이름은 없음", []), ("姓名不详", []), ("Name: n/a", []),
    ],
)
def test_mentions_in_words_and_other_languages(text, want):
    assert pii.mentions(text) == want


def test_texts_that_are_passed_over_hold_nothing():
    import pyarrow as pa

    rng = random.Random(17)
    held = ["성명: 김가온", "Contact: Imogen Farrow", "담당 박세찬 주무관", "이가온이", "orla QUILLBY", "nuri@mail.example", "raon.b골뱅이inbox.invalid", "nuri [ at ] mail . example", "x (AT) y.org", "nuri at mail.example", "john at example dot com", "010-0136-5537", "(02) 0627 - 7007", "+82 10-0749-0716",
            "01O-0l36-5537", "０１０－０２２９－９６２３", "공일공-공팔육오-구팔삼팔", "공 일 공 오 오 이 일 구 구 영 사", "zero one zero, five five two one, nine nine zero four", "841008-1400745", "841008 - 1400745", "M38660382", "17-14-958718-31",
            "단비시 여울길 292, 120동 1505호", "가람시 새빛동 338-32번지", "도담군  들길 3", "93 Fallow Road, Apt 48", "Lindenstraße 12", "Am Markt 3 b", "北京市海淀区中关村大街27号", "姓名：王小明", "어제 이가온 씨가", "Q. Quillby"]
    texts = [rng.choice(["", "그리고 ", "page ", "\n", "( "]) + h + rng.choice(["", " 거주", ", not", "\n2", ")"]) for h in held for _ in range(8)] + ["plain words only", "제12조 제3항", "", None, "가나다 라마"]
    some = set(pii.may_mention(pa.array(texts), GIVEN, LATIN).to_pylist())
    assert sum(bool(pii.mentions(t, GIVEN, LATIN)) for t in texts) > 200
    assert not [t for i, t in enumerate(texts) if i not in some and pii.mentions(t, GIVEN, LATIN)] and not some & set(range(len(texts) - 5, len(texts)))
    disguised = set(pii._matching(pa.array(texts), pii._MAY_DISGUISE).to_pylist())
    assert not [t for i, t in enumerate(texts) if i not in disguised and t and pii.plain(t) != (t, None)] and len(disguised) < 0.8 * len(texts)
    learnt = set(pii._matching(pa.array(texts), (pii._LABEL_WORDS, pii._FAR)).to_pylist())
    assert not [t for i, t in enumerate(texts) if i not in learnt and t and list(pii.labelled_names(t))]


def test_plain_form_maps_back():
    for text in ("Ｓ–００１ ﬁn ㎏ nuri @ mail.example", "가나 공일공-공팔육오-구팔삼팔 x (at) y", "á plain"):
        form, at = pii.plain(text)
        assert at is None or (at.shape == (len(form), 2) and (np.diff(at, axis=0) >= 0).all() and (at[:, 0] < at[:, 1]).all() and at.max(initial=0) <= len(text))


def test_placeholders_and_whole_tables(spark):
    notes = [(i, "d", 1, (t, None), "x") for i, t in enumerate(["성명: 김가온", "신청인 이가온", "담당 박가온 주무관", None, "", "x" * 50_000 + " 010-0136-5537", "이가온"])]
    frame = spark.createDataFrame(notes + notes[:2], "ann_key long, document_id string, id int, annotation struct<text:string,bbox:array<double>>, src string")
    back = spark.createDataFrame([(1, "a", 0, "어제 이가온 씨가 nuri@mail.example 로", None), (2, "a", 0, None, None)], "id long, analysis_id string, accepted int, corrected_text string, text string")
    found = sorted(tuple(r)[:4] for r in pii.find_mentions(frame, back).collect())
    assert found == [("annotations", 0, "NAME", 4), ("annotations", 1, "NAME", 4), ("annotations", 2, "NAME", 3), ("annotations", 5, "PHONE", 50_001), ("annotations", 6, "NAME", 0), ("feedback", 1, "EMAIL", 10), ("feedback", 1, "NAME", 3)]
    safe = {(r.src, r.row_id): r.text for r in pii.deidentify(frame, back).collect()}
    assert safe["feedback", 1] == "어제 [NAME] 씨가 [EMAIL] 로" and safe["annotations", 4] == ""
    assert pii.find_mentions(frame.limit(0), back.limit(0)).count() == 0


RARE = ["신청인 임로운", "성명: 한가람", "위 본인 남궁로운은(는) 이에 동의함", "Applicant: PENWICK Hollis", "위임받은 T. Penwick에게", "담당 한가람 주무관", "어제 류새온 씨가", "The signature reads Orla Dovecote, not"]


@pytest.mark.parametrize("text", RARE)
def test_announced_names_need_no_count(text):
    assert [k for k, _, _ in pii.mentions(text)] == ["NAME"]


@pytest.mark.parametrize("text", ["담당 주무관 부재", "신청인 연락처 없음", "본인 주소는 같음", "신청인 정보를 적음", "Applicant: Phone Number", "일본인 정치가는", "The heading reads Market Square", "전 담당 주무관", "임로운"])
def test_form_words_are_no_names(text):
    assert pii.mentions(text) == []


def test_names_beyond_the_broadcast_are_joined(spark, monkeypatch):
    texts = [*RARE[:2], *["성명: 김가온", "신청인 Orla Quillby", "담당 박세찬 주무관"] * 3, "이가온과 남 궁세찬, ORLA Quillby", "정가온은 Q. Quillby의 대리", None, ""]
    notes = spark.createDataFrame([(i, "d", 1, (t, None), "x") for i, t in enumerate(texts)], "ann_key long, document_id string, id int, annotation struct<text:string,bbox:array<double>>, src string")
    back = spark.createDataFrame([(1, "a", 0, "어제 이가온 Orla Quillby nuri@mail.example", None), (2, "a", 0, None, None)], "id long, analysis_id string, accepted int, corrected_text string, text string")
    want = [sorted(map(tuple, f(notes, back).collect())) for f in (pii.find_mentions, pii.deidentify)]
    assert sum(r[2] == "NAME" for r in want[0]) == 18
    monkeypatch.setattr(pii, "MOST_PARTS", 1)
    assert [sorted(map(tuple, f(notes, back).collect())) for f in (pii.find_mentions, pii.deidentify)] == want


@pytest.mark.parametrize(
    ("lang", "units"),
    [
        ("en", ["Dr. Ames saw No. 4 at 8.30 a.m. on Sept. 16, 2024.", "Was it late?", '"It is. Please wait," he said.', "Others left at 9 p.m.", "Forms (e.g. ver. 2.5) stay..."]),
        ("ko", ["2025. 8. 12. 기준 93.1%가 늘었습니다.", "“왜 안 됩니까?”라는 질문이 있었다.", "정비를 추진함.", "자세한 내용은 www.a-1.example/n.2 참고", ]),
        ("de", ["Am 24. März galt Abs. 5 Nr. 3 z. B. für Anträge usw. weiter.", "Er sagte: „Bitte warten Sie. Danke.“, so das Protokoll.", "Ende!"]),
        ("zh", ["费用为1.5元。", "“为什么推迟了？”居民多次询问。", "他说：“结束。请办理。”", "好……再说！"]),
        ("ja", ["終わります。", "「なぜか。」という意見がある。", "費用は12.5円です！"]),
    ],
)
def test_units_stand_where_rules_say(lang, units):
    joint = "" if lang in ("zh", "ja") else " "
    text, want = "﻿ ", []
    for u in units:
        want.append(len(text))
        text += u + joint
    assert sentences.unit_starts(text, lang) == want


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [("en", "He wrote: “" + "It is so. " * 100 + "End.” Then he left.", 2), ("de", "Er schrieb: „" + "So ist es. " * 100 + "Ende.“ Dann ging er.", 2), ("zh", "他说：“" + "结束了。" * 200 + "”然后走了。", 2), ("ja", "「" + "終わります。" * 100 + "」という意見がある。", 1), ("ko", "“" + "왜 안 됩니까? " * 100 + "네.”라는 질문이 있었다.", 1), ("en", "“Open. " + "It is so. " * 60 + "\n\nNext ”here.", 62)],
)
def test_a_long_quotation_belongs_to_its_sentence(lang, text, want):
    assert len(sentences.unit_starts(text, lang)) == want


def test_no_rule_looks_back_further(monkeypatch):
    rng = random.Random(13)
    parts = {"ko": ["2025. 8. 12. 기준", "늘었습니다.", "1. 대상: ", "\n", "“왜?”라는 ", "www.a-1.example "], "en": ["Dr. ", "at 8.30 a.m. ", "(e.g. ", "late? ", "\n2. ", "“Is it?” ", "etc. "], "de": ["Am 24. ", "z. B. ", "Nr. 3 ", "Ende! ", "\n\n", "„So. So.“ "], "zh": ["1.5元。", "“为什么？”", "他说：“结束。”", "\n"], "ja": ["終わります。", "「なぜか。」と", "\n"], "th": ["ฝ่าย ", "ฯลฯ ", "703 ", "Ver.2 ", "! "]}
    texts = [(g, "".join(rng.choice(p) + rng.choice(["", "x" * rng.randrange(200), " word"]) for _ in range(40))) for g, p in parts.items() for _ in range(40)]
    near = [sentences.unit_starts(t, g) for g, t in texts]
    monkeypatch.setattr(sentences, "REACH", 100_000)
    assert [sentences.unit_starts(t, g) for g, t in texts] == near


def test_units_of_lists_headings_wraps_and_nothing():
    text = "정비 계획\n1. 대상: 시민\n2. 기간: 2024. 1. 2.\n3. 문의: 12. 3.부터\n\n새벽에 12.\n10.부터 멈춘다. 다음입니다 끝"
    cut = sentences.unit_starts(text, "ko")
    assert [text[a:b].strip() for a, b in zip(cut, [*cut[1:], len(text)], strict=True)] == ["정비 계획", "1. 대상: 시민", "2. 기간: 2024. 1. 2.", "3. 문의: 12. 3.부터", "새벽에 12.\n10.부터 멈춘다.", "다음입니다", "끝"]
    thai = "ฝ่าย ฯลฯ ร่วม Ver.2.1 ใช้ 703 คน ประกาศผล\nอีกเรื่อง"
    assert [thai[i] for i in sentences.unit_starts(thai, "th")] == ["ฝ", "ป", "อ"]
    assert sentences.unit_starts("", "ko") == sentences.unit_starts("﻿ \n", "en") == [] and sentences.unit_starts("x", None) == [0]
    assert sentences.unit_starts("Wort. " * 30_000, "de")[-1] == 6 * 29_999


def test_units_of_a_table(spark):
    frame = spark.createDataFrame([(1, "One. Two.", "en", "x"), (2, None, "en", "x"), (3, "", None, "x"), (4, "A? B!", None, "x"), (4, "A? B!", None, "x")], "doc_id long, text string, lang string, key string")
    assert sorted(tuple(r) for r in sentences.sentence_units(frame).collect()) == [(1, 0), (1, 5), (4, 0), (4, 0), (4, 3), (4, 3)]
    assert [r.unit for r in sentences.units_with_text(frame).filter("doc_id = 1").orderBy("unit_no").collect()] == ["One.", "Two."]
    assert sentences.sentence_units(frame.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["x" * 60_000, ". " * 30_000, "a." * 30_000, " " * 100_000, "1-" * 30_000, "가" * 60_000, "\"a. " * 20_000, "(at) " * 20_000, "0 " * 30_000, "1. x\n" + "y. " * 30_000, "\n" * 60_000])
def test_long_odd_texts_take_linear_time(text):
    import time

    began = time.process_time()
    pii.mentions(text, GIVEN, LATIN)
    list(pii.labelled_names(text))
    for lang in ("ko", "en", "de", "zh", "ja", "th"):
        sentences.unit_starts(text, lang)
    list(item_index([(1, "abc def ghi jkl mno")]).search([text]))
    overlap.fingerprints(textforms.compact(text))
    assert time.process_time() - began < 20
