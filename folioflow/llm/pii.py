"""Personal information in free text: offset-preserving deobfuscation, detection, typed placeholders.

Transducers rewrite a text step by step into a plain form and keep, for every character of it, the place in the source
it came from: compatibility forms and homoglyphs, letters that stand for digits within numbers, spelled-out digits,
at and dot disguises. Detectors work on the plain form; the spans they find are mapped back, so offsets and
replacements refer to the source as it was delivered.

Names have no shape of their own. Where a form's label or a title announces one it is a name, however rare
(``_announced``). Elsewhere it is one if labels announce its parts anywhere in the corpus (``announced_parts``).
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁոΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινі", "ABEKMHOPCTYXaeopcyxijsdnABEZHIKMNOPTYXoivi", strict=True))
DASHES = dict.fromkeys("‐‑‒–—―−﹣－ｰ", "-")
SPELLED = dict(zip("공영일이삼사오육칠팔구", "00123456789", strict=True))
LOOKALIKE = dict(zip("OoQIl|BSZ", "000111852", strict=True))
#: Frequent Korean family names.
FAMILY = (
    "김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황 안 송 류 유 홍 전 고 문 양 손 배 백 허 남 심 노 하 곽 성 차 주 우 구 민 진 지 엄 채 원 천 방 공 현 함 변 염 여 추 도 소 석 선 설 마 길 연 위 표 명 기 반 왕 금 옥 육 인 맹 제 모 탁 국 "
    "남궁 제갈 선우 황보 독고 사공 서문 동방"
).split()
#: Up to MOST_PARTS name parts are broadcast, more are joined to the texts.
MOST_PARTS = 200_000
STREETS = "Road|Street|Lane|Avenue|Court|Quay|Row|Drive|Close|Way|Place|Terrace|Square|Hill|Gardens|Crescent|Walk|Mews|Boulevard"
#: Words that stand before a name, by language: those that need no colon, then those that do.
LABELS: dict[str, tuple[str, str]] = {
    "ko": ("성명, 신청인, 담당자, 담당, 보호자, 예금주, 위임받은, 본인, 이름은, 신고인, 대리인, 민원인, 수령인, 청구인, 임차인, 임대인, 대표자, 작성자, 제출자", "이름, 성함, 연락인, 수신인, 발신인, 세대주, 책임자, 확인자"),
    "en": ("Applicant, Signature reads, signature reads, Name reads, name reads, Signed by, signed by, Prepared by, prepared by", "Name, name, Contact, Guardian, Recipient, Attn, Attention, Claimant, Representative, Tenant, Landlord, Resident"),
    "de": ("Antragsteller, Antragstellerin, Sachbearbeiter, Sachbearbeiterin, Unterzeichnet von, unterzeichnet von", "Name, Kontakt, Ansprechpartner, Ansprechpartnerin, Empfänger, Empfängerin, Mieter, Mieterin, Vertreter, Vertreterin"),
    "zh": ("", "姓名, 联系人, 申请人, 负责人, 代理人, 收件人, 监护人"),
    "ja": ("", "氏名, 名前, 申請者, 申請人, 担当, 担当者, 保護者, 代理人, 受取人"),
    "th": ("", "ชื่อ, ชื่อ-สกุล, ผู้ติดต่อ, ผู้ยื่นคำขอ, ผู้รับ, ผู้ปกครอง"),
}
#: Words for the at sign and the dot in mail addresses.
AT_WORDS, DOT_WORDS = "at|ät|aet|골뱅이|アット|艾特|แอท", "dot|punkt|점|닷|ドット|点|จุด"
#: Ends of host names that are believed where signs are words ("meet at this dot on the map" is no address).
HOST_ENDS = "com|org|net|edu|gov|int|info|biz|dev|app|example|invalid|test|localhost|kr|jp|cn|de|th|uk|eu|ch|fr|io|co|tv|tw|hk|sg|au|nz"
#: Digits as words, 0 to 9 (several words for one digit by ``/``).
DIGIT_WORDS = {
    "en": "zero/oh one two three four five six seven eight nine", "de": "null eins zwei/zwo drei vier fünf sechs sieben acht neun", "ko": "공/영 일 이 삼 사 오 육 칠 팔 구",
    "zh": "〇/零 一/幺 二 三 四 五 六 七 八 九", "th": "ศูนย์ หนึ่ง สอง สาม สี่ ห้า หก เจ็ด แปด เก้า",
}
#: So many digits spelled one after the other are a number.
SPELLED_RUN = 8

_ONE = {**HOMOGLYPHS, **DASHES}
_DIGIT = re.compile(r"\d")
#: Without these a rewriting has nothing to do.
_AT_HINT = re.compile(rf"[@\[{{<(]|골뱅이|\s(?i:at)\s")
_REWRITE_HINTS = (re.compile(r"\d\D?\d|\d[OoQIl|BSZ]"), re.compile("[공영][일이삼사오육칠팔구공영]"), _AT_HINT, re.compile("@"), re.compile(r"[(\[{]|\s(?i:dot)\s"))
_PLAIN = re.compile(r"[\x00-\x7f가-힣]*\Z")
_REWRITES: tuple[tuple[re.Pattern, object], ...] = (
    # Letters that stand for digits, within a number of five or more signs.
    (re.compile(r"(?<![A-Za-z0-9])(?=[0-9OoQIl|BSZ() .+-]{0,24}\d[0-9OoQIl|BSZ() .+-]{0,24}\d)(?:[0-9OoQIl|BSZ]{2,14}[-) .]{1,2}){1,3}[0-9OoQIl|BSZ]{4,14}(?![A-Za-z0-9])", re.ASCII), LOOKALIKE),
    # Digits spelled out one by one.
    (re.compile(r"(?<![가-힣])[공영][일이삼사오육칠팔구공영]{1,2}[- .]?[공영일이삼사오육칠팔구]{3,4}[- .]?[공영일이삼사오육칠팔구]{4}"), SPELLED),
    # At signs in disguise, then dots in what follows them.
    (re.compile(rf"(?<=[A-Za-z0-9])\s*(?:[(\[{{<]\s*(?i:{AT_WORDS}|@)\s*[)\]}}>]|골뱅이|\s@\s|\s(?:at|AT)\s(?=[\w-]+\s*(?:[.]|[(\[]dot)))\s*(?=[A-Za-z0-9])"), "@"),
    (re.compile(r"(?<=[A-Za-z0-9])(?:\s+@|@\s+)(?=[A-Za-z0-9])"), "@"),
    (re.compile(rf"(?<=[A-Za-z0-9])\s*(?:[(\[{{]\s*(?i:{DOT_WORDS})\s*[)\]}}]|\s(?:dot|DOT)\s)\s*(?=[A-Za-z0-9])"), "."),
)

_AT, _DOT = rf"\s{{1,3}}(?:{AT_WORDS})\s{{1,3}}", rf"\s{{1,3}}(?:{DOT_WORDS})\s{{1,3}}"
_WORDED_MAIL = re.compile(rf"(?i)(?<![\w.@-])[a-z0-9][a-z0-9_+-]{{0,63}}(?:{_DOT}[a-z0-9_+-]{{1,63}}){{0,4}}{_AT}(?:[a-z0-9-]{{1,63}}{_DOT}){{1,4}}(?:{HOST_ENDS})(?![\w-])")
_WORDED_SIGN = re.compile(rf"(?i){_AT}|{_DOT}")
_DOT_WORD = re.compile(_DOT, re.I)
_SPELLING = {w: str(n) for words in DIGIT_WORDS.values() for n, several in enumerate(words.split()) for w in several.split("/")}
_DIGIT_SIGNS, _DIGIT_WORD = "".join(w for w in _SPELLING if len(w) == 1), "|".join(sorted((w for w in _SPELLING if len(w) > 1), key=len, reverse=True))
_SPELLED_SIGNS = re.compile(rf"(?<![가-힣])(?:[{_DIGIT_SIGNS}][ .,-]{{0,2}}){{{SPELLED_RUN - 1},}}[{_DIGIT_SIGNS}]")
_SPELLED_WORDS = re.compile(rf"(?i)(?<![a-zäöü\u0e00-\u0e7f])(?:(?:{_DIGIT_WORD})[ .,-]{{0,2}}){{{SPELLED_RUN - 1},}}(?:{_DIGIT_WORD})(?![a-zäöü])")
_SPELLED_PART = re.compile(rf"(?i)({_DIGIT_WORD}|[{_DIGIT_SIGNS}])|[ .,-]+")
_MAY_SPELL = re.compile(rf"[{_DIGIT_SIGNS}][ .,-]{{0,2}}[{_DIGIT_SIGNS}][ .,-]{{0,2}}[{_DIGIT_SIGNS}]")
_THAI = re.compile("[\u0e00-\u0e7f]{3}")


def _worded(text: str) -> list[tuple[int, int, str]]:
    """(start, end, what it stands for) of words for signs in mail addresses and for digits in numbers."""
    edits: list[tuple[int, int, str]] = []
    if _DOT_WORD.search(text):
        for mail in _WORDED_MAIL.finditer(text):
            edits += [(sign.start(), sign.end(), "." if _DOT_WORD.fullmatch(sign.group()) else "@") for sign in _WORDED_SIGN.finditer(text, mail.start(), mail.end())]
    if len(text) < SPELLED_RUN:
        return edits
    plainest = text.isascii()
    runs = [*_SPELLED_SIGNS.finditer(text)] if not plainest and _MAY_SPELL.search(text) else []
    # Words have blanks or hyphens between them, or are of a script without blanks.
    if text.count(" ") + text.count("-") >= SPELLED_RUN - 1 or not plainest and _THAI.search(text):
        runs += _SPELLED_WORDS.finditer(text)
    for run in runs:
        for part in _SPELLED_PART.finditer(text, run.start(), run.end()):
            digit = _SPELLING.get((part.group(1) or "").casefold())
            # A blank only keeps spelled digits apart.
            edits.append((part.start(), part.end(), digit if digit else "" if not part.group().strip() else "-"))
    return sorted(edits)


def plain(text: str) -> tuple[str, np.ndarray | None]:
    """(plain form, where each of its characters begins and ends in the source); None where both are the same."""
    at: np.ndarray | None = None
    if not _PLAIN.match(text):
        chars, places = [], []
        for i, c in enumerate(text):
            for d in _ONE.get(c) or (c if c.isascii() else unicodedata.normalize("NFKC", c)):
                chars.append(_ONE.get(d, d))
                places.append(i)
        text, at = "".join(chars), np.array([places, places], np.int64).reshape(2, -1).T + (0, 1)
    edits = _worded(text)
    if edits:
        text, at = _rewritten(text, at, edits)
    for (pattern, to), hint in zip(_REWRITES, _REWRITE_HINTS, strict=True):
        if not hint.search(text) or not pattern.search(text):
            continue
        if isinstance(to, dict):
            text = pattern.sub(lambda m, to=to: "".join(to.get(c, c) for c in m.group()), text)
        else:
            text, at = _rewritten(text, at, [(m.start(), m.end(), to) for m in pattern.finditer(text)])
    return text, at


def _rewritten(text: str, at: np.ndarray | None, edits: list[tuple[int, int, str]]) -> tuple[str, np.ndarray]:
    """The text with edits (in order; each replaced by at most one sign) applied, and the offsets kept."""
    last, parts, first, final = 0, [], [], []
    for begin, end, to in edits:
        parts += [text[last:begin], to]
        first += range(last, begin)
        final += range(last, begin)
        if to:
            first.append(begin)
            final.append(end - 1)
        last = end
    first += range(last, len(text))
    final += range(last, len(text))
    begins, ends = np.array(first, np.int64), np.array(final, np.int64)
    return "".join([*parts, text[last:]]), np.stack([begins, ends + 1] if at is None else [at[begins, 0], at[ends, 1]], axis=1)


PHONE = re.compile(
    r"(?:(?<![\w+./-])|(?<=[一-鿿]))(?:\+\d{1,3}[ -]?\(?\d{1,4}\)?[ -]{1,2}\d{3,4}[ -]{1,2}\d{4}|\(?0\d{1,2}\)?[-. ]{0,2}\d{3,4}[-. ]{0,2}\d{4}|\(\d{3}\)\s{0,2}\d{3}-\d{4}|\d{3}-\d{4})(?![\d]|-\d|[.]\d)"
)
EMAIL = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9](?:[A-Za-z0-9_.+-]{0,63}[A-Za-z0-9_])?@[A-Za-z0-9][A-Za-z0-9-]*(?:\s?\.\s?[A-Za-z][A-Za-z0-9-]*)+")
ID_NUMBER = re.compile(
    r"(?<![\w-])(?:\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\s{0,2}-?\s{0,2}[1-8]\d{6}|\d{2}-\d{2}-\d{6}-\d{2}|[MSRGD]\d{8})(?![\w]|-\d)(?<!\d{14})"
    r"|(?<=번호)(?:\d{6}-?[1-8]\d{6}|\d{2}-\d{2}-\d{6}-\d{2}|[MSRGD]\d{8})(?!\w)"
)
_TOWN = r"(?:(?<![가-힣])|(?<=사업장)|(?<=주소)|(?<=배송지가))[가-힣]{1,4}[시군]"
ADDRESSES: tuple[tuple[re.Pattern, re.Pattern], ...] = tuple((re.compile(p), re.compile(hint)) for p, hint in (
    (_TOWN + r"\s*(?:[가-힣]{1,4}?[구읍면동]\s*){0,2}(?:[가-힣]{1,6}?(?:대로|로|길)(?:\s*\d{1,4}번?길)?\s*\d{1,4}(?:-\d{1,4})?(?![\d가-힣])|\d{1,4}(?:-\d{1,4})?\s*번지)(?:,\s*\d{1,4}동\s*\d{1,4}호)?", "[시군]"),
    (rf"(?<![\w.,$€£-])\d{{1,4}}\s+[A-Za-z]{{2,}}\s+(?i:{STREETS})\b(?:,\s*(?i:Apt|Unit|Flat|Suite)\.?\s*\d+)?(?:,\s*[A-Z][A-Za-z]+)?", r"\d\s+[A-Za-z]"),
    # German: street, number, maybe postcode and town.
    (r"\b(?:[A-ZÄÖÜ][\wäöüß-]{1,30}(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm)|(?:Am|An der|Im|Zum|Zur)\s[A-ZÄÖÜ][\wäöüß-]{2,30})\s+\d{1,4}(?:\s?[a-z]\b)?(?:,\s*\d{5}\s+[A-ZÄÖÜ][\wäöüß-]+)?", r"[a-zäöüß.]\s+\d"),
    # Chinese and Japanese: from the town or prefecture to the number; Thai: number, then road.
    (r"[一-鿿]{2,8}?[省市区县](?:[一-鿿]{1,8}?[市区县镇]){0,2}[一-鿿]{1,10}?[路街道巷]\s*\d{1,5}[号弄](?:\s*\d{1,4}[号室楼])?", "[号弄]"),
    (r"[一-鿿]{1,3}[都道府県][一-鿿ぁ-んァ-ヶ]{1,8}?[市区町村郡][一-鿿ぁ-んァ-ヶ]{0,12}?\d{1,4}(?:(?:丁目|番地?|号|[-−])\d{0,4}){1,4}", "[都道府県]"),
    (r"(?<![\d/])\d{1,4}(?:/\d{1,4})?\s*(?:หมู่\s*\d{1,2}\s*)?(?:ถนน|ถ\.|ซอย|ซ\.)\s*[\u0e00-\u0e7f]{2,30}(?:\s*\d{1,4})?", "ถ|ซ"),
))

_FAMILY = sorted(FAMILY, key=len, reverse=True)
#: Words of forms that look like a name behind a label: whole ones, and nouns that a particle follows.
FORM_WORDS = frozenset("주무관 공무원 조사관 심사관 연구원 상담원 안내원 전문가 지도사 위원장 이사장 구청장 신청인 신청자 신청서 신분증 연락처 서명란 성명란 명의자 전화번 주민번 인감증 이메일 이용자 임차인 임대인 기재란".split())
FORM_NOUNS = frozenset("주소 서명 성명 성함 이름 명의 전화 신분 여부 지역 기관 인감 정보 연락 장소 현장 진술 기록 인적 고지 진단 신고 신청 지원 소속 심사 조사 안내 전부".split())
ENGLISH_FORM_WORDS = frozenset("name number address phone mobile email date signature office department code section title service services report".split())


def _form_word(name: str) -> bool:
    """Whether what a label seems to announce is another word of the form, not a name."""
    if name[0].isascii():
        return any(w in ENGLISH_FORM_WORDS for w in name.casefold().replace(".", " ").split())
    return name[:3] in FORM_WORDS or (len(name) == 3 and name[:2] in FORM_NOUNS and name[2] in "은는이가을를의로도에와과란")


def labelled_names(text: str) -> Iterator[tuple[str, str]]:
    """(kind, part) of the names that a label announces: given names in Hangul, both parts of Latin ones."""
    form = plain(text)[0] if text else ""
    for a, b in _labelled(form):
        if not _TAUGHT.match(form, b):
            continue
        name = form[a:b]
        if name[0].isascii():
            yield from (("latin", part.casefold()) for part in name.replace(".", " ").split() if len(part) > 2)
        elif "가" <= name[0] <= "힣":
            name = re.sub(r"\s", "", name)
            family = next((f for f in _FAMILY if name.startswith(f) and len(name) - len(f) == 2), None)
            # A long one that may be a short name with a particle teaches nothing.
            if family and not (len(family) > 1 and name[0] in FAMILY and name[-1] in "은는이가을를의"):
                yield "given", name[len(family) :]


def _hangul_name(families: str) -> re.Pattern:
    return re.compile(
        r"(?:(?<![가-힣])|(?<=담당)|(?<=성명)|(?<=신청인)|(?<=보호자)|(?<=본인)|(?<=예금주)|(?<=위임받은))"
        rf"(?:{families})\s{{0,2}}([가-힣]{{2}})(?=[^가-힣]|$|주무관|은|는|이|가|을|를|의|님|씨|에게|께|와|과|도|로|라고)"
    )


#: Family names of two syllables, then of one: what is no known name with the one may be with the other.
_HANGUL_NAMES = (
    _hangul_name("|".join(f"{f}|{f[0]}\\s{{1,2}}{f[1:]}" for f in _FAMILY if len(f) > 1)),
    _hangul_name("|".join(f for f in _FAMILY if len(f) == 1)),
)
_LATIN_WORD = re.compile(r"[A-Za-z]{3,}")
_LATIN_NAME = re.compile(r"(?<![A-Za-z0-9@._-])([A-Za-z]{3,}\s{1,2}|[A-Za-z]\.\s{0,2})([A-Za-z]{3,})(?![A-Za-z0-9@_-]|\.[A-Za-z])")


_FAMILIES = ("|".join(f"{f}|{f[0]}\\s{{1,2}}{f[1:]}" for f in _FAMILY if len(f) > 1), "|".join(f for f in _FAMILY if len(f) == 1))
_AFTER = r"(?=[^가-힣]|$|주무관|은|는|이|가|을|를|의|님|씨|에게|께|와|과|도|로|라고)"
_ENDS = r"(?![A-Za-z0-9@_-]|\.[A-Za-z])"
#: What may stand behind a name that teaches its parts.
_TAUGHT = re.compile(r"\s*(?:\(인\)|주무관|,|$|은\(는\)|이고|\(|\s)")


def _label(*languages: str) -> tuple[re.Pattern, frozenset[str]]:
    """(the languages' labels with what follows, those that need no colon); letters before them are looked for by hand."""
    bare, colon = ([w for g in languages for w in LABELS[g][i].split(", ") if w] for i in (0, 1))
    words = "|".join(w.replace(" ", r"\s+") for w in sorted({*bare, *colon}, key=lambda w: (-len(w), w)))
    return re.compile(rf"({words})(\s{{0,2}}[:：]\s{{0,2}}|\s{{1,2}})"), frozenset(bare)


_LETTER = re.compile(r"[A-Za-zÄÖÜäöüß가-힣一-鿿\u0e00-\u0e7f]")
_LATIN_SHAPE = rf"(?:[A-ZÄÖÜ][a-zäöüß]+\s{{1,2}}[A-ZÄÖÜ][a-zäöüß]+|[A-Z]{{3,}}\s{{1,2}}[A-Z][a-z]+|[A-Z]\.\s{{0,2}}[A-Z][a-z]+){_ENDS}"
#: (labels, shapes of names behind them) for names in Hangul and Latin letters, in Chinese, Japanese and Thai.
_ANNOUNCED = (
    (_label("ko", "en", "de"), tuple(re.compile(p) for p in (*(rf"(?:{f})\s{{0,2}}[가-힣]{{2}}{_AFTER}" for f in _FAMILIES), _LATIN_SHAPE))),
    (_label("zh"), (re.compile(r"[一-鿿]{2,4}(?![一-鿿ぁ-んァ-ヶ])"),)),
    (_label("ja"), (re.compile(r"[一-鿿]{1,4}(?:[ \u3000][一-鿿ぁ-んァ-ヶ]{1,6}|[一-鿿]{0,3}(?![一-鿿ぁ-んァ-ヶ]))"),)),
    (_label("th"), (re.compile(r"(?:นางสาว|นาย|นาง)?\s?[\u0e00-\u0e7f]{2,30}\s[\u0e00-\u0e7f]{2,40}(?![\u0e00-\u0e7f])"),)),
)
_THAI_TITLE = re.compile(r"(?:นางสาว|นาย|นาง)\s?")
_FAR_SCRIPT = re.compile(r"[一-鿿\u0e00-\u0e7f]")
#: Behind a title the name is one word in Hangul: a family name's syllable that stands apart may be any word.
_TITLE_HINT = re.compile("주무관|[님씨]")
_TITLE = re.compile(r"(?:\s?주무관|\s[님씨](?![가-힣]{3}))")
_TITLED = re.compile(rf"(?:(?<![가-힣])(?:{'|'.join(_FAMILY)})[가-힣]{{2}}|(?<![A-Za-z0-9@._-])(?:[A-Z][a-z]+\s|[A-Z]{{3,}}\s|[A-Z]\.\s?)[A-Z][a-z]+)(?={_TITLE.pattern})")


def _labelled(form: str) -> Iterator[tuple[int, int]]:
    """Spans of names that a label stands before."""
    for (label, bare), shapes in _ANNOUNCED if _FAR_SCRIPT.search(form) else _ANNOUNCED[:1]:
        for at in label.finditer(form):
            if (not at.group(2).strip() and " ".join(at.group(1).split()) not in bare) or (at.start() and _LETTER.match(form, at.start() - 1)):
                continue
            m = next(filter(None, (p.match(form, at.end()) for p in shapes)), None)
            if m and not _form_word(re.sub(r"\s", " " if m.group()[0].isascii() else "", m.group())):
                title = _THAI_TITLE.match(form, m.start(), m.end())
                yield title.end() if title else m.start(), m.end()


def _announced(form: str) -> Iterator[tuple[int, int]]:
    """Spans of names that a label stands before or a title behind, whatever their parts."""
    yield from _labelled(form)
    if _TITLE_HINT.search(form) and _TITLE.search(form):
        yield from (m.span() for m in _TITLED.finditer(form) if not _form_word(m.group()))


def _names(form: str, given: frozenset[str], latin: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Spans of names by shape whose parts are known; a shape with unknown parts is tried again one sign further."""
    # Few texts hold a known part at all.
    hangul = given and not form.isascii() and not given.isdisjoint(map(add, form, form[1:]))
    latin_too = latin and not latin.isdisjoint(map(str.casefold, _LATIN_WORD.findall(form)))
    for pattern, known in (*((p, lambda m: m.group(1) in given) for p in _HANGUL_NAMES if hangul), *((p, lambda m: m.group(2).casefold() in latin and (m.group(1)[1] == "." or m.group(1).strip().casefold() in latin)) for p in (_LATIN_NAME,) if latin_too)):
        m = pattern.search(form)
        while m:
            if known(m):
                yield m.span()
            m = pattern.search(form, m.end() if known(m) else m.start() + 1)


def asked_parts(text: str | None) -> set[tuple[str, str]]:
    """(kind, part) of all that ``_names`` may look up for a text."""
    asked: set[tuple[str, str]] = set()
    form = plain(text)[0] if text and _HINT.search(text) else ""
    for pattern in (*_HANGUL_NAMES, _LATIN_NAME):
        m = pattern.search(form)
        while m:
            asked.update([("given", m.group(1))] if pattern is not _LATIN_NAME else [("latin", g.strip().casefold()) for g in m.groups()])
            m = pattern.search(form, m.start() + 1)
    return asked


DETECTORS = (("EMAIL", EMAIL, re.compile("@")), ("ID_NUMBER", ID_NUMBER, re.compile(r"\d{6}|\d\d-\d\d-\d")), ("PHONE", PHONE, re.compile(r"\d\d\d")), *(("ADDRESS", *a) for a in ADDRESSES))
_HINT = re.compile(r"[0-9０-９@＠]|[가-힣]{3}|[가-힣]{1,2} [가-힣]{2}|[공영] ?일|[A-Za-zＡ-Ｚａ-ｚ]{3}|[一-鿿〇]{2}|[\u0e00-\u0e7f]{3}|[A-ZＡ-Ｚ]\.")


def mentions(text: str | None, given: frozenset[str] = frozenset(), latin: frozenset[str] = frozenset(), disguised: bool = True) -> list[tuple[str, int, int]]:
    """(type, start, end) of the personal information in a text, as source offsets in order, without overlaps.

    A mention starts at its first letter or digit. Where detectors overlap the earlier kind in DETECTORS, then NAME,
    keeps its span. Null and blank texts have none; a text is searched as a whole, however long. One that is known to be its
    own plain form need not be rewritten (``disguised``).
    """
    if not text or not _HINT.search(text):
        return []
    form, at = plain(text) if disguised else (text, None)
    found: list[tuple[int, int, str]] = []
    spans = [(kind, m.span()) for kind, pattern, hint in (DETECTORS if _DIGIT.search(form) else DETECTORS[:1]) if hint.search(form) for m in pattern.finditer(form)] + [("NAME", span) for span in (*_names(form, given, latin), *_announced(form))]
    for kind, (a, b) in spans:
        while a < b and not form[a].isalnum():
            a += 1
        i = bisect.bisect(found, (a, b, kind))
        if a < b and (i == 0 or found[i - 1][1] <= a) and (i == len(found) or b <= found[i][0]):
            found.insert(i, (a, b, kind))
    return [(kind, a, b) if at is None else (kind, int(at[a, 0]), int(at[b - 1, 1])) for a, b, kind in found]


_LABEL_WORDS = "|".join(sorted({w.split(" ")[-1] for g in LABELS for i in (0, 1) for w in LABELS[g][i].split(", ") if w}))
_FAR = "[^\\x00-\\x7f가-힣]"
#: What a text must have to hold a mention, but for names by their parts; searched in Arrow buffers (no look-around there):
#: signs that may be something else, seven signs that may be digits, mail signs, address words beside digits, labels and
#: titles, words for digits and dots.
_MAY_MENTION = tuple((
    _FAR,
    r"(?:[0-9OoQIl|BSZ][-.()+\s]{0,6}){7}",
    r"@|골뱅이|[(\[{<]\s*(?i:at|ät|aet)|\s(?i:at)\s",
    r"[시군][\s가-힣]*[0-9]",
    rf"[0-9]\s+[A-Za-z]+\s+(?i:{STREETS})",
    r"(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm|(?:Am|An der|Im|Zum|Zur)\s[A-ZÄÖÜ][a-zäöüß-]+)\s+[0-9]",
    rf"{_LABEL_WORDS}|주무관|[님씨]",
    rf"[{_DIGIT_SIGNS}][ .,-]{{0,2}}[{_DIGIT_SIGNS}][ .,-]{{0,2}}[{_DIGIT_SIGNS}]",
    rf"(?i:{_DIGIT_WORD})[ .,-]{{0,2}}(?i:{_DIGIT_WORD})[ .,-]{{0,2}}(?i:{_DIGIT_WORD})",
    rf"\s(?i:{DOT_WORDS})\s",
))
#: What a text must have for its plain form to differ from it.
_MAY_DISGUISE = (
    _FAR, r"[0-9][-) .]{0,2}[OoQIl|BSZ]|[OoQIl|BSZ][-) .]{0,2}[0-9]", rf"\s@|@\s|골뱅이|[(\[{{<]\s*(?i:{AT_WORDS}|@)|\s(?i:at)\s|[(\[{{]\s*(?i:{DOT_WORDS})", *_MAY_MENTION[-3:], f"[공영][{''.join(SPELLED)}]",
)
#: Up to so many known parts are searched for in the buffers; with more every text is read.
MOST_SEARCHED = 2_000


def _matching(texts: pa.Array, patterns: tuple[str, ...]) -> pa.Array:
    """Places of the texts that match one of the patterns (nulls match none)."""
    found = [pc.fill_null(pc.match_substring_regex(texts, p), False).to_numpy(zero_copy_only=False) for p in patterns]
    return pa.array(np.flatnonzero(np.logical_or.reduce(found)))


def may_mention(texts: pa.Array, given: frozenset[str], latin: frozenset[str]) -> pa.Array:
    """Places of all texts that ``mentions`` may find something in, given the known parts of names."""
    if len(given) + len(latin) > MOST_SEARCHED:
        return pa.array(np.arange(len(texts)))
    parts = ("|".join(map(re.escape, sorted(given))), "(?i:" + "|".join(map(re.escape, sorted(latin))) + ")" if latin else "")
    return _matching(texts, (*_MAY_MENTION, *(p for p in parts if p)))


def redacted(text: str | None, given: frozenset[str] = frozenset(), latin: frozenset[str] = frozenset()) -> str | None:
    """The text with every mention replaced by its type in brackets; null stays null."""
    if text is None:
        return None
    parts, last = [], 0
    for kind, a, b in mentions(text, given, latin):
        # A dialling sign or an area code's bracket belongs to the number.
        if kind == "PHONE" and a > last and (text[a - 1] in "+＋" or (text[a - 1] in "(（" and ")" in text[a:b].replace("）", ")"))):
            a -= 1
        parts += [text[last:a], f"[{kind}]"]
        last = b
    return "".join([*parts, text[last:]])


def free_texts(annotations: DataFrame, feedback: DataFrame) -> DataFrame:
    """(src, row_id, text) of both tables, repeated rows as often as they come."""
    notes = annotations.select(F.lit("annotations").alias("src"), F.col("ann_key").alias("row_id"), F.col("annotation.text").alias("text"))
    return notes.unionAll(feedback.select(F.lit("feedback"), "id", "corrected_text")).filter("text is not null")


def _pairs(texts: DataFrame, of: Callable[[str], Iterable[tuple[str, str]]], patterns: tuple[str, ...] = ()) -> DataFrame:
    """(digest, kind, part) of the name parts that ``of`` finds in each text (that matches one of ``patterns``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if patterns:
                batch = batch.take(_matching(batch.column("text"), patterns))
            rows = [(d, *p) for d, t in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True) for p in of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["digest", "kind", "part"])

    return texts.mapInArrow(run, "digest string, kind string, part string")


def announced_parts(texts: DataFrame) -> DataFrame:
    """(kind, part): given names in Hangul and parts of Latin names that a label announces in any text.

    Only texts with a word of LABELS, or with signs that may be one in disguise, are read one by one.
    """
    return _pairs(texts.select(F.lit(None).cast("string").alias("digest"), "text"), labelled_names, (_LABEL_WORDS, _FAR)).select("kind", "part").distinct()


def _sets(parts: Iterable) -> tuple[frozenset[str], frozenset[str]]:
    parts = [tuple(p) for p in parts]
    return frozenset(p for k, p in parts if k == "given"), frozenset(p for k, p in parts if k == "latin")


def _with_names(texts: DataFrame, act: Callable[[pa.RecordBatch, tuple | list], pa.RecordBatch], schema: str) -> DataFrame:
    """``act`` on batches of texts and the known parts of names: one tuple for all, or a list of those each may ask for.

    Up to MOST_PARTS parts are broadcast; more never reach the driver, each text is joined to those it asks for.
    """
    parts = announced_parts(texts.select("text"))
    rows = parts.limit(MOST_PARTS + 1).collect()
    if len(rows) <= MOST_PARTS:
        shared = texts.sparkSession.sparkContext.broadcast(_sets(rows))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield act(batch, shared.value)

        return texts.mapInArrow(run, schema)
    marked = texts if "digest" in texts.columns else texts.withColumn("digest", _digest())
    known = _pairs(marked.select("digest", "text").distinct(), asked_parts).join(parts, ["kind", "part"])
    known = known.groupBy("digest").agg(F.collect_list(F.array("kind", "part")).alias("known"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield act(batch, [_sets(k or ()) for k in batch.column("known").to_pylist()])

    return marked.join(known, "digest", "left").select("src", "row_id", "digest", "text", "known").mapInArrow(run_joined, schema)


def _digest():
    return F.substring(F.sha2("text", 256), 1, 32)


def find_mentions(annotations: DataFrame, feedback: DataFrame) -> DataFrame:
    """(src, row_id, pii_type, start_pos, end_pos) of all mentions in both tables.

    Null and blank texts have none, exactly repeated rows count once, rows of one key with different texts count each
    (of mentions that begin alike the longest), other columns are not read; empty tables give no rows.
    """

    def act(batch: pa.RecordBatch, names: tuple | list) -> pa.RecordBatch:
        texts = batch.column("text")
        some = may_mention(texts, *names) if isinstance(names, tuple) else pa.array(np.arange(len(texts)))
        each = repeat(names) if isinstance(names, tuple) else names
        texts = texts.take(some)
        disguised = np.zeros(len(texts), bool)
        disguised[_matching(texts, _MAY_DISGUISE)] = True
        rows = [(i, *m) for i, t, n, d in zip(some.to_pylist(), texts.to_pylist(), each, disguised.tolist()) for m in mentions(t, *n, d)]
        at = pa.array([r[0] for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("src").take(at), batch.column("row_id").take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
            names=["src", "row_id", "pii_type", "start_pos", "end_pos"],
        )

    found = _with_names(free_texts(annotations, feedback), act, "src string, row_id bigint, pii_type string, start_pos bigint, end_pos bigint")
    return found.groupBy("src", "row_id", "pii_type", "start_pos").agg(F.max("end_pos").alias("end_pos"))


def deidentify(annotations: DataFrame, feedback: DataFrame) -> DataFrame:
    """(src, row_id, text) with typed placeholders, one row for each distinct text of a key; null texts are left out."""

    def act(batch: pa.RecordBatch, names: tuple | list) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        some = may_mention(batch.column("text"), *names).to_pylist() if isinstance(names, tuple) else range(len(texts))
        for i in some:
            texts[i] = redacted(texts[i], *(names if isinstance(names, tuple) else names[i]))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("src", "row_id", "digest")), pa.array(texts, pa.string())], names=["src", "row_id", "digest", "text"])

    made = _with_names(free_texts(annotations, feedback).withColumn("digest", _digest()), act, "src string, row_id bigint, digest string, text string")
    return made.dropDuplicates(["src", "row_id", "digest"]).drop("digest")
