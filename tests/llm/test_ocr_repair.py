from __future__ import annotations

import random

import pytest

from folioflow.llm import ocr_repair
from folioflow.llm.ocrwords import Lexicon, jamo, within

TERMS = ["committee", "supporting", "self-employed", "of", "and", "을", "위원회는", "재적위원", "과반수의", "출석으로", "개의한다", "보고한다", "교육", "교육과정은", "게시판과"]
LEX = Lexicon(TERMS)


@pytest.mark.parametrize(
    ("token", "want"),
    [
        ("committee", None), ("Committee", None), ("commlttee", "committee"), ("cornmittee", "committee"), ("supp`orting", "supporting"), ("0f", "of"), ("arid", "and"), ("보교한다.", "보고한다"), ("보·고한다", "보고한다"),
        ("위원외는", "위원회는"), ("다솜군", None), ("2024.", None), ("787일", None), ("Pebblewick", None), ("", None), ("—", None), ("게시판", None),
    ],
)
def test_corrections(token, want):
    assert LEX.correction(token) == want


@pytest.mark.parametrize(
    ("end", "start", "want"),
    [("과반", "수의", "과반수의"), ("과반-", "수의,", "과반수의"), ("sup¬", "porting", "supporting"), ("self-", "employed", "self-employed"), ("교육", "과정은", "교육과정은"), ("교육", "게시판과", None), ("of", "and", None), ("", "x", None), ("583–", "646", None), ("보교-", "한다.", "보고한다")],
)
def test_words_broken_at_line_ends(end, start, want):
    assert LEX.broken(end, start) == want


def test_lexicon_lookup_agrees_with_comparing_all():
    rng = random.Random(1)
    for _ in range(300):
        word = list(rng.choice([t for t in TERMS if not t.isascii()]))
        k = rng.randrange(len(word))
        word[k] = chr(ord(word[k]) + rng.choice([1, 28, 588, -1]))
        token = "".join(word)
        near = sorted((t for t in TERMS if within(jamo(token), jamo(t), 1)), key=lambda t: (jamo(token) != jamo(t), t))
        assert LEX.correction(token) == (near[0] if near and token not in TERMS else None)


@pytest.mark.parametrize(("text", "want"), [("- 12 -", 12), ("Page l", 1), ("제9쪽", 9), ("[3]", 3), ("8 / 48", 8), ("p. lO", 10), ("· S ·", 5), ("２", 2), ("한다.", None), ("285,521", None), ("제63회 회의록", None), (None, None), ("", None)])
def test_page_numbers(text, want):
    assert ocr_repair.page_number(text) == want


def volume(pages=5):
    """Lines of a volume, and the noise planted in them."""
    lines, noise = [], []
    for page in range(1, pages + 1):
        page_id, y = f"a{page}", 90
        rows = []
        if page > 1:
            rows.append(("Parks C0mmittee Minutes" if page == 3 else "Parks Committee Minutes", 30, "header"))
        rows.append(("수의 출석으로 개의한다. 위원회는 재적위원 과반수의 출석으로" if page > 1 else "위원회는 재적위원 과반수의 출석으로 개의한다. 위원회는", y, None))
        rows.append(("보교한다. 교육과정은 재적위원 과반수의 출석으로 개의한다. 재적-", y + 50, "both"))
        rows.append(("위원 과반수의 2024 출석으로 개의한다. 위원회는 재적위원 과반", y + 100, "broken_word" if page < pages else None))
        rows.append((f"- {page} -", 2240, "page_number"))
        for i, (text, at, kind) in enumerate(rows, 1):
            lines.append(("v1", page, "s", page_id, i, text, 90.0, 100, at, 13 * len(text), 30))
            for k in ("broken_word", "misread") if kind == "both" else (kind,) if kind else ():
                noise.append(("ocr_line_data", page_id, i, k))
    return lines, noise


DATA = "volume_id string, page_no int, strategy string, analysis_id string, line_id int, text string, confidence double, x int, y int, width int, height int"
ONE = "analysis_id string, id int, text string, confidence double, bbox struct<x:int,y:int,width:int,height:int>, volume string"


def frames(spark):
    lines, noise = volume()
    lines += lines[3:9] + [(None, None, None, "lone", 1, None, None, None, None, None, None), (None, None, None, None, 1, "x", None, None, None, None, None), ("v2", 1, "s", "long", 1, "보고한다 " * 20_000 + "보교한다", 1.0, 1, 90, 9, 9)]
    random.Random(3).shuffle(lines)
    noise += [("ocr_line_data", "long", 1, "misread"), ("ocr_line", "u", 1, "broken_word"), ("ocr_line", "u", 3, "page_number")]
    single = [("u", 1, "위원회는 재적", 1.0, (1, 80, 90, 9), "x"), ("u", 2, "위원 25", 1.0, (1, 120, 90, 9), "x"), ("u", 3, "[4]", 1.0, (1, 2240, 9, 9), "x"), ("w", 1, "25", 1.0, (1, 700, 9, 9), "x"), ("w", None, None, None, None, None)]
    return spark.createDataFrame(lines, DATA), spark.createDataFrame(single * 2, ONE), spark.createDataFrame([(t, "ko") for t in TERMS] + [(None, None)], "term string, lang string"), noise


def test_noise_is_found_where_it_was_planted(spark):
    data, one, terms, noise = frames(spark)
    found = sorted(tuple(r) for r in ocr_repair.find_noise(data, one, terms).collect())
    assert found == sorted(noise)


def test_pages_read_as_paragraphs(spark):
    data, one, terms, _ = frames(spark)
    text = {r.analysis_id: r.text for r in ocr_repair.readable_pages(data, one, terms).collect()}
    assert text["a2"] == "출석으로 개의한다. 위원회는 재적위원 과반수의 출석으로 보고한다. 교육과정은 재적위원 과반수의 출석으로 개의한다. 재적위원 과반수의 2024 출석으로 개의한다. 위원회는 재적위원 과반수의"
    assert text["u"] == "위원회는 재적위원 25" and text["lone"] == ""


def test_nothing(spark):
    data, one, terms, _ = frames(spark)
    assert ocr_repair.find_noise(data.limit(0), one.limit(0), terms).count() == 0
    assert ocr_repair.find_noise(data, one, terms.limit(0)).filter("noise in ('broken_word', 'misread')").count() == 0


@pytest.mark.parametrize("text", ["가" * 60_000, "x" * 60_000, "-" * 60_000, "1 " * 30_000, "o0" * 30_000, "'a" * 30_000])
def test_long_odd_lines_take_linear_time(text):
    import time

    began = time.process_time()
    mark = {"pages": 3, "shift": 0, "support": 2, "banded": 2, "loose": 2, "running": ["x" * 50], "frequent": []}
    ocr_repair.Page(ocr_repair.PageReader(LEX, {"top": (0, 48), "bottom": (2100, 2339)}), [text] * 3, [1, 2, 3], [30] * 3, [1] * 3, 1, mark)
    ocr_repair.repeated_forms([(ocr_repair.edge_form(text), 2), ("x" * 50, 1)], 3)
    assert time.process_time() - began < 10


def scanned(pages, title, rng, chapter=None):
    """Lines of a volume whose every page bears a number and ``title``, two letters of it wrong on each page."""
    out = []
    for page in range(1, pages + 1):
        head = list(title if chapter is None or page // chapter % 2 else "위원회는 교육과정은 보고한다")
        for at in rng.sample([i for i, c in enumerate(head) if c != " "], 2):
            head[at] = chr(0xAC00 + rng.randrange(11172))
        body = [" ".join(rng.choices(TERMS, k=9)) for _ in range(3)]
        for i, (text, y) in enumerate([(f"- {page} -", 20), ("".join(head), 80), *((b, 140 + 50 * k) for k, b in enumerate(body))], 1):
            out.append(("v", page, "s", f"a{page}", i, text, 90.0, 100, y, 13 * len(text), 30))
    return out


@pytest.mark.parametrize(("pages", "title", "chapter"), [(5, "단비시의회 재무위원회 임시회 회의록", None), (300, "단비시의회 재무위원회 임시회 회의록", None), (300, "재적위원 과반수의 출석으로 교육과정은 위원회는", None), (10_000, "단비시의회 재무위원회 임시회 회의록", 40)])
def test_headers_with_wrong_letters_on_every_page(spark, pages, title, chapter):
    lines = scanned(pages, title, random.Random(pages), chapter)
    data = spark.createDataFrame(lines, DATA)
    terms = spark.createDataFrame([(t, "ko") for t in TERMS], "term string, lang string")
    found = [tuple(r) for r in ocr_repair.find_noise(data, spark.createDataFrame([], ONE), terms).filter("noise = 'header'").select("analysis_id", "line_id").collect()]
    assert set(found) <= {(f"a{p}", 2) for p in range(1, pages + 1)} and len(found) == len(set(found)) >= 0.99 * pages


def test_repeated_forms_agree_with_comparing_all():
    rng = random.Random(4)
    for _ in range(60):
        base = ["".join(rng.choices("abcdefghijkl", k=rng.randrange(3, 30))) for _ in range(4)]
        forms = {}
        for _ in range(rng.randrange(1, 40)):
            form = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                form[rng.randrange(len(form))] = rng.choice(["", "x", "yz"])
            if "".join(form):
                forms["".join(form)] = rng.randrange(1, 3)
        pages = rng.randrange(1, 60)
        total = {a: sum(n for b, n in forms.items() if a == b or ocr_repair.alike(a, b)) for a in forms}
        running, frequent = ocr_repair.repeated_forms(list(forms.items()), pages)
        assert set(running) == {f for f, n in total.items() if n >= max(2, -(-pages * 12 // 100))}
        assert set(frequent) == {f for f, n in total.items() if n >= max(3, -(-pages * 3 // 10))}


def test_pages_without_number_and_of_one_number(spark):
    lines, noise = volume()
    lines += [("v1", None, "s", "none", 1, "- 3 -", 90.0, 1, 2240, 9, 9), ("v1", 2, "s", "z2", 1, "수의 출석으로 개의한다.", 90.0, 1, 90, 9, 9)]
    terms = spark.createDataFrame([(t, "ko") for t in TERMS], "term string, lang string")
    found = sorted(tuple(r) for r in ocr_repair.find_noise(spark.createDataFrame(lines, DATA), spark.createDataFrame([], ONE), terms).collect())
    assert found == sorted([*noise, ("ocr_line_data", "none", 1, "page_number")])
