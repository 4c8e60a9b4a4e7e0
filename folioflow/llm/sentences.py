"""Sentence units by cascading rule tables of break and no-break regular-expression pairs.

A rule says whether a position is a boundary if the text before it ends with one expression and the text from it on
begins with another. Tables are tried in order (paragraphs, lists, quotations, the language, defaults) and the first
rule that matches decides. Positions to decide are where a sentence-ending sign (with the closing quotes that belong to
it), a line break or, in Thai, a blank stands.

Two things no pair of expressions can say are marked beforehand: which lines are list items (numbers must continue the
item before, so a date broken across lines is none) and which stretches are quotations. They appear in the expressions
as ITEM and as a position's table choice.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands before the first character of a list item, in what rules see.
ITEM = "\x02"
#: Characters before a position that rules see.
REACH = 120

_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_HAS_WIDE = re.compile("[\uff01-\uff5e]")
_BLANK = re.compile("[\\s\ufeff\u200b]*")
_LINE = re.compile("[^\\n]*\\n?")
_BREAK = re.compile("\\n")

Rule = tuple[bool, str, str]


@dataclass(frozen=True)
class Table:
    """Rules in order; each (boundary, before, after)."""

    rules: tuple[Rule, ...]


PARAGRAPHS = Table(((True, "", r"[^\S\n]*\n[^\S\n\ufeff]*\n"),))

LISTS = Table((
    (True, "", rf"\s*\n[\s\ufeff]*{ITEM}"),
    (False, rf"(?:^|\n)\s*{ITEM}?(?:\d{{1,2}}|[a-z]|[가나다라마바사아자차카타파하])\.", r" "),
    (True, rf"(?:^|\n)\s*{ITEM}[^\n]*", r"[^\S\n]*\n"),
))

_ENGLISH = (
    "dr|mrs|mr|ms|messrs|prof|rev|hon|st|no|nos|art|arts|para|paras|sec|ch|fig|vs|e\\.g|i\\.e|viz|cf|incl|excl|approx|dept|est|ver|vol|ed|eds|pp|ca|al|"
    "jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec|mon|tue|tues|wed|thu|thurs|fri|sat|sun"
)
_GERMAN = "dr|prof|hr|fr|st|str|nr|nrn|abs|art|ziff|bzw|gem|ca|vgl|ggf|evtl|inkl|exkl|zzgl|tel|bd|jh|mio|mrd|lt|sog|max|min|z|b|d|h|u|a|o|i|v|e|s"

_MISREAD = {"o": "[o0]", "l": "[l1i]", "i": "[il1]", "e": "[ec]", "c": "[ce]", "s": "[s5]", "b": "[b8]"}


def _noisy(words: str) -> str:
    """Alternatives of words as they stand or with letters that scanning confuses."""
    return "".join(_MISREAD.get(c, c) for c in words)


LANGUAGES: dict[str, Table] = {
    "ko": Table((
        # Dates, decimals, section numbers: a figure never ends a sentence.
        (False, r"\d\.", r""),
        (False, rf"(?i:\b(?:{_noisy('vol|ver|rev|no')}|v|p|pp|dr|mr|mrs|ms|st|co|inc|ltd))\.", r"\s*\S"),
        # A sentence may end without a period.
        (False, r"니다|\u1102\u1175\u1103\u1161", r"\s*(?:라고|라는|라며|만\b)"),
        (True, r"니다|\u1102\u1175\u1103\u1161", r"\s"),
        # Names and addresses of the web go on without a blank.
        (False, r"[A-Za-z0-9_-]\.", r"[A-Za-z0-9_-]"),
        (True, r"[.!?。]+[)\]]*", r""),
    )),
    "en": Table((
        (False, rf"(?i:(?<![a-z0-9])(?:{_noisy(_ENGLISH)})\.)", r"\s*\S"),
        (False, r"\b[ap]\.m\.", r"\s+[a-z(\d]"),
        (False, r"\b[AP]\.M\.", r"\s+(?:ON|LOCAL|SHARP|WITHOUT|AND|TO|AT|FOR|IN)\b"),
        (False, r"\b(?i:etc)\.", r"[\s)]*[a-z,;]"),
        (False, r"(?:^|[\s(.])[A-Z]\.", r"\s*[A-Z]\."),
        (False, r"(?:\.\.\.|…)", r"\s+[a-z]"),
        (True, r"[.!?]+[)\]]*", r"\s|$"),
        (True, r"[a-z]{3}[.!?]", r"[A-Z][a-z]"),
        (False, r"", r""),
    )),
    "de": Table((
        (False, r"(?<!\d)\d{1,2}\.", r"\s*\S"),
        (False, rf"(?i:(?<![a-zäöüß])(?:{_GERMAN})\.)", r"\s*\S"),
        (False, r"\b(?:usw|etc|u\.a)\.", r"\s*[a-zäöü,;)]"),
        (False, r"(?:\.\.\.|…)", r"\s+[a-zäöü]"),
        (True, r"[.!?]+[)\]]*", r"\s|$"),
        (True, r"[a-zäöüß]{3}[.!?]", r"[A-ZÄÖÜ][a-zäöü]"),
        (False, r"", r""),
    )),
    "zh": Table(((False, r"\.", r""), (True, r"[。!?｡]+[)）\]]*", r""))),
    "ja": Table(((False, r"\.", r""), (True, r"[。!?｡]+[)）\]]*", r""))),
    "th": Table((
        (True, r"[!?]+", r"\s"),
        (False, r"[0-9A-Za-z๐-๙ฯ.,:%)\]&/+-]", r"\s"),
        (False, r"", r"\s+[0-9A-Za-z๐-๙ฯ(\[&/+-]"),
        (True, r"", r"\s"),
    )),
}

#: After a quotation that ends with a sentence-ending sign.
QUOTATIONS: dict[str, Table] = {
    "ko": Table(((False, "", r"\s*(?:라|이라|하고|하는|고\b|며|는\b|란\b)"), (False, "", r"\S"), (True, "", r"\s|$"))),
    "en": Table(((False, "", r"\s*(?:[a-z,;:)]|(?:AND|ASKED|SAID|WROTE)\b)"), (True, "", r"\s|$"), (False, "", ""))),
    "de": Table(((False, "", r"\s*(?:[a-zäöü,;:)])"), (True, "", r"\s|$"), (False, "", ""))),
    "zh": Table(((True, r"[:：]\s*[“\"「][^“”\"「」]*[。!?][”\"」]", ""), (False, "", r"\S"), (True, "", r"\s*\n\s*[“\"]"), (False, "", ""))),
    "ja": Table(((False, "", r"\s*(?:と|って|、|。|の|が|は|を|に)"), (True, "", ""))),
    "th": LANGUAGES["th"],
}

#: Where a quotation opens and closes, however long it is. It does not cross a blank line. What is inside holds no sign of
#: the kind, so it is never read again (possessive) and all quotations of a text take linear time.
_INNER = r"[^{0}\n]*+(?:\n(?![^\S\n]*\n)[^{0}\n]*+)*+"
_CURLY = "“" + _INNER.format("“”") + "”"
_STRAIGHT = r"(?:(?<=[\s(])|^)\"(?=\S)" + _INNER.format('"') + r"(?<=\S)\""
_STRAIGHT_CJK = r"\"" + _INNER.format('"') + r"\""
QUOTES = {
    "ko": _CURLY + "|" + _STRAIGHT,
    "en": _CURLY + "|" + _STRAIGHT,
    "de": "„" + _INNER.format("„“”") + "[“”]|" + _STRAIGHT,
    "zh": _CURLY + "|「" + _INNER.format("「」") + "」|" + _STRAIGHT_CJK,
    "ja": "「" + _INNER.format("「」") + "」|『" + _INNER.format("『』") + "』|" + _STRAIGHT_CJK,
    "th": _CURLY + "|" + _STRAIGHT,
}
_QUOTE_SIGN = re.compile("[“”„「」『』\"]")

#: Positions to decide: the end of a sentence-ending sign, a line break, and what else ends sentences in a language.
_SIGNS = {"ko": r"[.!?。]+|니다(?=\s)|\u1102\u1175\u1103\u1161(?=\s)", "en": r"[.!?…]+", "de": r"[.!?…]+", "zh": r"[。!?｡]+", "ja": r"[。!?｡]+", "th": r"[!?]+|(?<=\S)(?=\s)"}

_ITEMS = (
    ("n.", re.compile(r"(\d{1,2})\. (?=[^\d\s])")),
    ("n)", re.compile(r"\(?(\d{1,2})\)\s+(?=\S)")),
    ("a.", re.compile(r"([a-z])[.)] (?=\S)")),
    ("가.", re.compile(r"([가나다라마바사아자차카타파하])[.)] (?=\S)")),
    ("•", re.compile(r"([○●•▪■□◦※·*–-]) +(?=\S)")),
)
_SYLLABLES = "가나다라마바사아자차카타파하"
_MAY_LIST = re.compile(r"(?m)^[^\S\n\ufeff]*\ufeff?(?:\(?\d{1,2}[.)] |[a-z가-하][.)] |[○●•▪■□◦※·*–-] )")


class _Compiled:
    def __init__(self, lang: str) -> None:
        build = lambda table: [(yes, re.compile(f"(?:{before})\\Z") if before else None, re.compile(after) if after else None) for yes, before, after in table.rules]
        self.shared = build(PARAGRAPHS) + build(LISTS)
        self.paragraphs = build(PARAGRAPHS)
        self.language = build(LANGUAGES[lang])
        self.quotation = build(QUOTATIONS[lang])
        self.quotes = re.compile(QUOTES[lang])
        self.scan = re.compile(rf"(?:{_SIGNS[lang]})|[^\S\n]*\n\s*")


def decide(rules: list, before: str, text: str, at: int) -> bool | None:
    """What the first matching rule says, or None."""
    for yes, left, right in rules:
        if (right is None or right.match(text, at)) and (left is None or left.search(before)):
            return yes
    return None


_TABLES: dict[str, _Compiled] = {}


def tables(lang: str | None) -> _Compiled:
    """The compiled cascade of a language; unknown ones use English rules."""
    key = lang if lang in LANGUAGES else "en"
    if key not in _TABLES:
        _TABLES[key] = _Compiled(key)
    return _TABLES[key]


def _ordinal(kind: str, mark: str) -> int:
    return int(mark) if kind in ("n.", "n)") else ord(mark) - 96 if kind == "a." else _SYLLABLES.index(mark) + 1 if kind == "가." else 1


def item_starts(text: str) -> set[int]:
    """Offsets of the first characters of list items.

    A numbered item is the first of its list or follows the item before it. A first item does not follow a line that
    ends in a figure and a period unless that line is an item (else it is a date that goes on).
    """
    found: set[int] = set()
    if not _MAY_LIST.search(text):
        return found
    last: tuple[str, int] | None = None
    figure = False
    for line in _LINE.finditer(text):
        bare = line.group()
        begin = line.start() + _BLANK.match(bare).end()
        if begin >= line.end():
            if bare:
                last, figure = None, False
            continue
        current = None
        for kind, mark in _ITEMS:
            m = mark.match(text, begin)
            if m:
                n = _ordinal(kind, m.group(1))
                if kind == "•" or (last is not None and last == (kind, n - 1)) or (n == 1 and (last is not None or not figure)):
                    current = (kind, n)
                    found.add(begin)
                break
        last = current
        tail = bare.rstrip()
        figure = tail[-1:] == "." and tail[-2:-1].isdigit()
    return found


def unit_starts(text: str, lang: str | None) -> list[int]:
    """Offsets of the first characters of all units; a blank text has none."""
    size = len(text)
    start = _BLANK.match(text).end()
    if start >= size:
        return []
    if _HAS_WIDE.search(text):
        text = text.translate(_WIDE)
    rules = tables(lang)
    items = item_starts(text)
    ends, inside = {}, []
    if _QUOTE_SIGN.search(text):
        inside = [(m.start(), m.end()) for m in rules.quotes.finditer(text)]
        ends = {b: a for a, b in inside}
    starts, q, last_at = [start], 0, -1
    breaks = [-1, *(m.start() for m in _BREAK.finditer(text))] if items else []
    for m in rules.scan.finditer(text):
        at = m.end() if m.group().strip() or m.end() == m.start() else m.start()
        if at <= last_at:
            continue
        while q < len(inside) and inside[q][1] <= m.start():
            q += 1
        closing = False
        if q < len(inside) and inside[q][0] < at < inside[q][1]:
            if at != inside[q][1] - 1:
                continue
            at, closing = at + 1, True
        while at < size and text[at] in ")）]":
            at += 1
        to = _BLANK.match(text, at).end()
        if to >= size:
            break
        last_at = at
        from_line = text.rfind("\n", max(0, at - REACH), at) + 1
        low = max(from_line, at - REACH, 0)
        before = text[low:at]
        if items:
            line = breaks[bisect.bisect_left(breaks, at) - 1] + 1
            first = _BLANK.match(text, line).end()
            if first in items and first < at:
                before = "\n" + ITEM + (before[first - low :] if first >= low else before)
            elif low == line:
                before = "\n" + before
            if to in items and "\n" in text[at:to]:
                starts.append(to)
                continue
        elif low == from_line and (low == 0 or text[low - 1] == "\n"):
            before = "\n" + before
        answer = decide(rules.shared, before, text, at)
        if answer is None:
            if closing:
                if lang == "zh":
                    # From the sign before the quotation on.
                    opening = inside[q][0]
                    while opening and text[opening - 1].isspace():
                        opening -= 1
                    before = text[max(0, opening - 1) : at]
                answer = decide(rules.quotation, before, text, at)
            elif m.group().strip() or m.end() == m.start():
                answer = decide(rules.language, before, text, at)
            elif lang == "th":
                answer = decide(rules.language, before, text, at)
            else:
                answer = None
        if answer:
            starts.append(to)
    return sorted(set(starts))


def sentence_units(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start_pos) of every unit of every text, in code points from 0.

    Null and blank texts have no units; texts in languages without a table use the English one. Texts are taken whole,
    one after the other within their partition; nothing is shuffled.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unit_starts(t, g) for t, g in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)]
            sizes = np.array([len(f) for f in found], np.int64)
            rows = pa.array(np.repeat(np.arange(len(found)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(rows), pa.array([x for f in found for x in f], pa.int64())], names=[key, "start_pos"])

    return documents.filter("text is not null").select(F.col(key).alias("key"), "text", "lang").mapInArrow(run, f"`{key}` {kind}, start_pos bigint")


def units_with_text(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, unit_no, start_pos, unit): the units themselves, without outer blanks, numbered from 0."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, starts, units = [], [], [], []
            for i, (text, lang) in enumerate(zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)):
                found = unit_starts(text, lang)
                for n, (a, b) in enumerate(zip(found, [*found[1:], len(text)], strict=False)):
                    rows.append(i)
                    number.append(n)
                    starts.append(a)
                    units.append(text[a:b].rstrip("\ufeff\u200b \t\r\n\u00a0\u3000"))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), pa.array(number, pa.int64()), pa.array(starts, pa.int64()), pa.array(units, pa.string())], names=[key, "unit_no", "start_pos", "unit"])

    return documents.filter("text is not null").select(F.col(key).alias("key"), "text", "lang").mapInArrow(run, f"`{key}` {kind}, unit_no bigint, start_pos bigint, unit string")
