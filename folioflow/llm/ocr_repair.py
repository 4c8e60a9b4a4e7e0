"""Noise in text from scanned pages: running headers, page numbers, broken words, misread words; readable paragraphs.

Pages are the unit of work. A first pass reads only their edges: bare page numbers are validated by their sequence
within a volume, which also gives the bands of the page where they stand; what stands at an edge besides them is a
running header or footer if it is repeated, up to recognition noise, on enough of the pages around (``BLOCK``). The
second pass classifies whole pages, joins words broken at line ends by the vocabulary, and finds words that are near
neighbours of a vocabulary form. Words that go on across pages are settled by a join of neighbouring pages.

A volume that holds a third of all lines is only ever aggregated (edge forms by block of pages, page-number offsets) or
joined by page, never gathered.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.ocrwords import Lexicon, core, within
from folioflow.llm.textforms import letter_masks, masked_distance
from folioflow.plans.lineage import cut_lineage

SLACK = 12
#: Pages in a block. Forms of running lines are compared with those of their block and its two neighbours, so chapters
#: may have lines of their own, and work on a volume grows with its pages.
BLOCK = 32
#: A running line stands on at least two pages and this share of those around it; on three and FREQUENT of them, it may be
#: of vocabulary words only and stand anywhere at the edge.
REPEATED, FREQUENT = 0.12, 0.3
#: Where this share of the pages around (two at least) has a line that stands apart, a line behind a page number may have
#: a form of its own: with few pages left and right ones do not repeat.
SLOTTED = 0.5
#: A running line is at most this long, against the page's longest other line, unless it stands in a number band.
SHORT = 0.75
#: Greatest edit distance of two folded forms of one running line, as a share of the longer.
NOISE = 0.34
#: A vocabulary of up to so many terms is broadcast (with index some 1 KB a term and worker process).
MOST_TERMS = 500_000

_CONFUSED = str.maketrans("OoQIl|!SBZ", "0001111582")
_NUMBER = re.compile(r"[^\w]*(?:제|p|P)?\W{0,2}([0-9OoQIl|!SBZ]{1,5})(?:\s*/\s*[0-9OoQIl|!SBZ]{1,5})?\W*(\w{0,2})\W*")
_WORDED = re.compile(r"\W*([^\W\d_]{1,4})\W{0,3}([0-9OoQIl|!SBZ]{1,5})\W*([^\W\d_]{0,3})\W*")
_FOLDS = {**dict.fromkeys("iljtf1|!", "l"), **dict.fromkeys("oaecdqgu0", "o"), **dict.fromkeys("hb8", "b"), **dict.fromkeys("s5z2", "s"), **dict.fromkeys("mnrvw", "n")}


def page_number(text: str) -> int | None:
    """The number of a line that bears nothing but a page number (digits may be misread), else None."""
    plain = unicodedata.normalize("NFKC", text or "").strip()
    m = _NUMBER.fullmatch(plain)
    if m and m.group(2).casefold() in ("", "쪽", "면", "p"):
        digits = m.group(1)
    else:
        m = _WORDED.fullmatch(plain)
        if not m or not any(within(m.group(1).casefold(), w, 1) for w in ("page", "p", "pg", "제")) or (m.group(3) and not within(m.group(3), "쪽", 1)):
            return None
        digits = m.group(2)
    number = digits.translate(_CONFUSED)
    return int(number) if number.isdigit() else None


def edge_form(text: str) -> str:
    """A running line in a form that noise, case, spacing and an attached page number hardly change."""
    plain = unicodedata.normalize("NFKC", text or "").strip()
    tokens = plain.split()
    for at in (0, -1):
        if len(tokens) > 1 and re.fullmatch(r"\W*[0-9OoQIl|!SBZ]{1,4}\W*", tokens[at]):
            tokens.pop(at)
    return "".join(_FOLDS.get(c, c) for c in "".join(tokens).casefold() if c.isalnum() or c in "|!")


def alike(a: str, b: str) -> bool:
    """Whether two forms are the same running line up to noise."""
    most = int(max(len(a), len(b)) * NOISE)
    if abs(len(a) - len(b)) > most:
        return False
    return masked_distance(letter_masks(a), len(a), b) <= most


def repeated_forms(forms: list[tuple[str, int]], pages: int) -> tuple[list[str], list[str]]:
    """(running, frequent) forms among (form, pages that have it), counting the pages of all forms alike.

    A bitmap of letters bounds the distance of two forms from below, so only few are compared letter by letter, the most
    frequent ones first and no more than needed.
    """
    need, often = max(2, math.ceil(pages * REPEATED)), max(3, math.ceil(pages * FREQUENT))
    forms = sorted(forms, key=lambda f: (-f[1], f[0]))
    letters = np.zeros((len(forms), 2), np.uint64)
    for i, (form, _) in enumerate(forms):
        for c in set(form):
            k = ord(c) * 40503 % 128
            letters[i, k >> 6] |= np.uint64(1 << (k & 63))
    sizes = np.array([len(f) for f, _ in forms])
    running, frequent = [], []
    for i, (form, n) in enumerate(forms):
        if n < often:
            most = (np.maximum(sizes, len(form)) * NOISE).astype(int)
            more, less = (np.bitwise_count(x).sum(axis=1) for x in (letters[i] & ~letters, letters & ~letters[i]))
            masks = letter_masks(form)
            for j in np.flatnonzero((np.abs(sizes - len(form)) <= most) & (more <= most) & (less <= most)).tolist():
                if j != i and masked_distance(masks, len(form), forms[j][0]) <= most[j]:
                    n += forms[j][1]
                    if n >= often:
                        break
        if n >= need:
            running.append(form)
        if n >= often:
            frequent.append(form)
    return running, frequent


def scanned_pages(ocr_line_data: DataFrame, ocr_line: DataFrame) -> DataFrame:
    """One row per page of both tables: (src, volume, page_no, analysis_id, lines), exact repeats counted once.

    ``lines`` holds (id, y, width, text) in reading order. Lines without text are kept as empty; pages without volume or
    number stand alone.
    """
    volume = ocr_line_data.select(
        F.lit("ocr_line_data").alias("src"), F.when(F.col("page_no").isNotNull(), F.col("volume_id")).alias("volume"), "page_no", "analysis_id",
        F.struct(F.col("line_id").alias("id"), "y", "width", F.coalesce("text", F.lit("")).alias("text")).alias("line"),
    )
    single = ocr_line.select(
        F.lit("ocr_line").alias("src"), F.lit(None).cast("string").alias("volume"), F.lit(None).cast("int").alias("page_no"), "analysis_id",
        F.struct("id", F.col("bbox.y").alias("y"), F.col("bbox.width").alias("width"), F.coalesce("text", F.lit("")).alias("text")).alias("line"),
    )
    return volume.unionAll(single).filter("analysis_id is not null").groupBy("src", "volume", "page_no", "analysis_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _edges(n: int) -> tuple[list[int], list[int]]:
    """Positions of the two first and the two last of ``n`` lines, outermost first."""
    return list(range(min(2, n))), [i for i in range(n - 1, max(n - 3, 1 if n > 1 else 0) - 1, -1) if i > 1 or n <= 2]


def _nested(column: pa.ListArray) -> list[list]:
    """A list column as Python lists, from its flat values (a nested conversion costs several times as much)."""
    flat, out, at = column.flatten().to_pylist(), [], 0
    for size in column.value_lengths().to_pylist():
        out.append(flat[at : at + (size or 0)])
        at += size or 0
    return out


def may_run(text: str) -> bool:
    """Whether a line has letters enough for a running line and does not end a sentence."""
    return not text.rstrip().endswith((".", ",")) and sum(map(str.isalpha, text)) >= 5


def stands_apart(text: str, longest: int) -> bool:
    """Whether a line is no part of a wrapped paragraph: clearly shorter than the page's lines, without a sentence end."""
    text = text.strip()
    return len(text) <= SHORT * longest and may_run(text)


def _longest_other(longest: list[int], size: int) -> int:
    """The size of the longest other line, given those of the two longest lines."""
    return (longest[1] if len(longest) > 1 else 0) if longest and size == longest[0] else longest[0] if longest else 0


def _edge_rows(pages: DataFrame) -> DataFrame:
    """(volume, page_no, place, y, number, form, apart, behind) of the edge lines of volume pages.

    ``behind`` marks lines right below a page number at the top that may be running ones. Only edge lines leave the JVM.
    """
    names = ("volume", "page_no", "place", "y", "number", "form", "apart", "behind")
    schema = pa.schema(list(zip(names, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("volume", "page_no", "n")] + [_nested(batch.column(c)) for c in ("texts", "ys", "longest")]
            for volume, page, n, texts, ys, longest in zip(*columns, strict=True):
                for place, positions in zip(("top", "bottom"), _edges(n), strict=True):
                    for order, i in enumerate(positions):
                        # The first two lines, then the last two.
                        text, y = (v[i if i < 2 else len(v) - n + i] for v in (texts, ys))
                        number = page_number(text)
                        if order == 0:
                            numbered = number is not None
                        elif number is not None or not numbered:
                            continue
                        rows.append((volume, page, place, y, number, None if number is not None else edge_form(text), stands_apart(text, _longest_other(longest, len(text))), order > 0 and place == "top" and may_run(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(len(names))], schema=schema)

    ends = F.when(F.size("lines") <= 2, F.col("lines")).otherwise(F.concat(F.slice("lines", 1, 2), F.slice("lines", F.greatest(F.size("lines") - 1, F.lit(3)), 2)))
    sizes = F.slice(F.sort_array(F.transform("lines", lambda x: F.length(x["text"])), False), 1, 2)
    cut = pages.filter("volume is not null").select("volume", "page_no", F.size("lines").alias("n"), ends.alias("_ends"), sizes.alias("longest"))
    return cut.select("volume", "page_no", "n", F.col("_ends.text").alias("texts"), F.col("_ends.y").alias("ys"), "longest").mapInArrow(run, "volume string, page_no int, place string, y int, number long, form string, apart boolean, behind boolean")


def _block() -> Column:
    return F.floor(F.col("page_no") / BLOCK).alias("block")


def _around(counts: DataFrame, *keys: str) -> DataFrame:
    """Sums over each block and its two neighbours."""
    spread = counts.withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    return spread.groupBy("volume", "block", *keys).agg(*(F.sum(c).alias(c) for c in counts.columns if c not in ("volume", "block", *keys)))


def volume_marks(edges: DataFrame) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """((volume, block, shift, support, pages, banded, loose, running, frequent), bands): what edges tell.

    shift is the difference of printed and counted page numbers that most (``support``) of the volume's pages share.
    Around each block of pages: how many pages there are, how many have a line in a number band or one that may be a
    running one, and which forms are repeated. bands say where page numbers stand.
    """
    numbered = edges.filter("number is not null").withColumn("shift", F.col("number") - F.col("page_no"))
    shifts = numbered.groupBy("volume", "shift").agg(F.countDistinct("page_no").alias("_pages"))
    best = shifts.groupBy("volume").agg(F.max(F.struct("_pages", -F.abs("shift"), "shift")).alias("_best")).select("volume", "_best.shift", F.col("_best._pages").alias("support"))
    held = numbered.join(best.filter("support > 1"), ["volume", "shift"])
    spans = lambda rows: {r["place"]: (r["low"], r["high"]) for r in rows.groupBy("place").agg(F.percentile_approx("y", 0.01).alias("low"), F.percentile_approx("y", 0.99).alias("high")).collect() if r["low"] is not None}
    # Where no volume has a sequence, all that look like page numbers tell.
    bands = spans(held) or spans(numbered)
    banded = F.lit(False)
    for place, (low, high) in bands.items():
        banded = banded | ((F.col("place") == place) & F.col("y").between(low - SLACK, high + SLACK))
    lines = edges.withColumn("_may", F.col("form") != "").withColumn("banded", banded)
    in_band, apart = F.col("_may") & F.col("banded"), F.col("_may") & F.expr("banded or apart")
    by_page = lines.groupBy("volume", "page_no").agg(F.max(in_band).cast("int").alias("banded"), F.max(apart).cast("int").alias("loose"))
    sizes = _around(by_page.groupBy("volume", _block()).agg(F.count("*").alias("pages"), F.sum("banded").alias("banded"), F.sum("loose").alias("loose")))
    forms = lines.filter("_may and (banded or apart or behind)").groupBy("volume", _block(), "form").agg(F.size(F.collect_set("page_no")).alias("n"))
    lists = _around(forms, "form").groupBy("volume", "block").agg(F.collect_list(F.struct("form", "n")).alias("forms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, kept = batch.column("forms").flatten(), []
            pairs, at = list(zip(flat.field("form").to_pylist(), flat.field("n").to_pylist(), strict=True)), 0
            for size, pages in zip(batch.column("forms").value_lengths().to_pylist(), batch.column("pages").to_pylist(), strict=True):
                kept.append(repeated_forms(pairs[at : at + size], pages))
                at += size
            names = ("volume", "block", "shift", "support", "pages", "banded", "loose")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array([k[i] for k in kept], pa.list_(pa.string())) for i in (0, 1))], names=[*names, "running", "frequent"])

    # Forms of a block are those of its pages and their neighbours' pages.
    about = sizes.join(lists, ["volume", "block"], "left").join(best, "volume", "left").select("volume", "block", "shift", "support", "pages", "banded", "loose", F.coalesce("forms", F.array().cast("array<struct<form:string,n:bigint>>")).alias("forms"))
    return about.mapInArrow(run, "volume string, block bigint, shift bigint, support bigint, pages bigint, banded bigint, loose bigint, running array<string>, frequent array<string>"), bands


class PageReader:
    """Classifies the lines of one page."""

    def __init__(self, lexicon: Lexicon, bands: dict[str, tuple[int, int]]) -> None:
        self.lexicon, self.bands = lexicon, bands

    def _inside(self, y: int | None, place: str) -> bool:
        if place not in self.bands:
            return False
        low, high = self.bands[place]
        return low - SLACK <= (y or 0) <= high + SLACK

    def _numbered(self, text: str, y: int | None, place: str, page: int | None, mark: dict | None) -> bool:
        number = page_number(text)
        if number is None or not self._inside(y, place):
            return False
        clean = not re.search(r"[OoQIl|!SBZ]", re.sub(r"(?i)page|p\.", "", text))
        return page is None or not clean or not mark or not mark["support"] or mark["support"] < 2 or number - page == mark["shift"]

    def _foreign(self, text: str) -> int:
        """2 if a word of the line is neither of the vocabulary nor a figure or a place, 1 if it may be a misread one.

        A line with Latin words in lower case is running text.
        """
        most = 0
        for token in text.split():
            word = core(token)
            if word[:1].isascii() and word[:1].islower() and len(word) > 1:
                return 0
            if sum(map(str.isalpha, word)) < 2 or word in self.lexicon or word.casefold() in self.lexicon.folded:
                continue
            if not re.fullmatch(r"[가-힣]{1,4}[시군구]|제?\d+\w{0,2}", word):
                most = max(most, 2 if self.lexicon.correction(token) is None else 1)
        return most

    def _running(self, text: str, y: int | None, longest: int, place: str, behind_number: bool, mark: dict) -> bool:
        form = edge_form(text)
        if len(form) < 3:
            return False
        if self._inside(y, place):
            return (mark["banded"] or 0) > 1 or form in mark["running"]
        apart, behind = stands_apart(text, longest), behind_number and place == "top" and may_run(text)
        if not apart and not behind:
            return False
        if form in mark["frequent"]:
            return True
        pages = mark["pages"] or 1
        alone = behind and apart and math.ceil(pages * REPEATED) <= 1 and (mark["loose"] or 0) >= max(2, pages * SLOTTED)
        if not alone and form not in mark["running"]:
            return False
        if form in mark["running"]:
            return self._foreign(text) > 0
        # Without a repetition the line may be running text; what a word broken on the page before left of it tells nothing.
        parts = text.split()
        begun = len(parts) > 1 and not parts[0].isascii()
        return self._foreign(" ".join(parts[begun:])) > 1 and not any(t.endswith((".", ",")) and core(t) in self.lexicon for t in parts)

    def kinds(self, texts: list[str], ys: list[int | None], page: int | None = None, mark: dict | None = None) -> dict[int, str]:
        """header or page_number of the page's edge lines, by position."""
        found: dict[int, str] = {}
        longest = sorted(map(len, texts), reverse=True)[:2]
        for place, positions in zip(("top", "bottom"), _edges(len(texts)), strict=True):
            for order, i in enumerate(positions):
                if i in found or order and positions[0] not in found:
                    continue
                if "page_number" not in (found.get(p) for p in positions) and self._numbered(texts[i], ys[i], place, page, mark):
                    found[i] = "page_number"
                elif mark and self._running(texts[i], ys[i], _longest_other(longest, len(texts[i])), place, order > 0, mark):
                    found[i] = "header"
        return found


def _lexicon(spark, terms: DataFrame) -> Broadcast:
    rows = [r[0] for r in terms.select("term").filter("term is not null").distinct().limit(MOST_TERMS + 1).collect()]
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a lexicon of more than {MOST_TERMS} terms is not broadcast")
    return spark.sparkContext.broadcast(tuple(sorted(rows)))


@lru_cache(maxsize=2)
def _indexed(terms: tuple[str, ...]) -> Lexicon:
    """One index per vocabulary and worker process."""
    return Lexicon(list(terms))


class Page:
    """What is settled within a page: noise of its lines, its text, and the open ends for its neighbours.

    ``first`` and ``last`` are (line id, token, whether it is a misread whole word unless it goes on from or on the
    neighbouring page), of the first and last line of running text.
    """

    __slots__ = ("noise", "first", "last", "text")

    def __init__(self, reader: PageReader, texts: list[str], ids: list, ys: list, widths: list | None, page: int | None, mark: dict | None) -> None:
        words = reader.lexicon
        kinds = reader.kinds(texts, ys, page, mark)
        self.noise = [(ids[i], kind) for i, kind in kinds.items()]
        self.first = self.last = self.text = None
        body, tokens = [], []
        for i, text in enumerate(texts):
            parts = text.split() if i not in kinds else None
            if parts:
                body.append(i)
                tokens.append(parts)
        known, correction = words.known, words.correction
        broken = [words.broken(tokens[n][-1], tokens[n + 1][0]) for n in range(len(body) - 1)]
        self.noise += [(ids[i], "broken_word") for i, whole in zip(body, broken) if whole]
        final, repaired = len(body) - 1, []
        for n, (i, parts) in enumerate(zip(body, tokens, strict=True)):
            fixed = [known[t] if t in known else correction(t) for t in parts]
            begins, ends = n > 0 and broken[n - 1], n < final and broken[n]
            inner = fixed[1 if begins or n == 0 else 0 : len(fixed) - (1 if ends or n == final else 0)]
            if any(inner):
                self.noise.append((ids[i], "misread"))
            if n == 0:
                self.first = ids[i], parts[0], bool(fixed[0]) and (len(parts) > 1 or n != final and not ends)
            if n == final:
                self.last = ids[i], parts[-1], bool(fixed[-1]) and (not begins or len(parts) > 1)
            if widths is not None:
                line = [t if not w else t.replace(core(t), w) for t, w in zip(parts, fixed, strict=True)]
                if begins:
                    line = line[1:]
                if ends:
                    tail = re.sub(r"^.*?(\W*)$", r"\1", tokens[n + 1][0])
                    line[-1:] = [re.match(r"\W*", parts[-1]).group() + broken[n] + tail] if line or not begins else [broken[n] + tail]
                repaired.append(line)
        if widths is not None:
            self.text = _paragraphs(repaired, [widths[i] or 0 for i in body])


def _paragraphs(parts: list[list[str]], widths: list[int]) -> str:
    """Lines joined to paragraphs: a line that ends a sentence well before the margin ends its paragraph."""
    margin = max(widths, default=0)
    out: list[list[str]] = [[]]
    for words, width in zip(parts, widths, strict=True):
        out[-1] += words
        if words and words[-1].endswith((".", "!", "?", "。")) and width < 0.8 * margin:
            out.append([])
    return "\n\n".join(" ".join(p) for p in out if p)


_PAGE = (("src", pa.string()), ("volume", pa.string()), ("page_no", pa.int32()), ("analysis_id", pa.string()))


def read_pages(pages: DataFrame, terms: Broadcast, made: Callable[[tuple, Page], Iterator[tuple]], columns: tuple, kinds: str, texts: bool = False) -> DataFrame:
    """Rows that ``made`` gives for each page's key (src, volume, page_no, analysis_id) and reading, after that key."""
    marks, bands = volume_marks(cut_lineage(_edge_rows(pages)))
    joined = pages.withColumn("block", _block()).join(marks, ["volume", "block"], "left")
    fields = [*_PAGE, *columns]
    mark_names = ("shift", "support", "pages", "banded", "loose")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PageReader(_indexed(terms.value), bands)
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c, _ in _PAGE), strict=True))
            marks = list(zip(*(batch.column(c).to_pylist() for c in mark_names), strict=True))
            lines = [_nested(batch.column(c)) for c in ("texts", "ids", "ys", "widths")]
            running, frequent = (_nested(batch.column(c)) for c in ("running", "frequent"))
            rows = []
            for key, mark, text, ids, ys, widths, r, f in zip(keys, marks, *lines, running, frequent, strict=True):
                about = None if key[1] is None else dict(zip(mark_names, mark, strict=True)) | {"running": r, "frequent": f}
                rows += [(*key, *row) for row in made(key, Page(reader, text, ids, ys, widths if texts else None, key[2], about))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])

    width = F.col("lines.width") if texts else F.array().cast("array<int>")
    return joined.select(*(c for c, _ in _PAGE), *mark_names, "running", "frequent", F.col("lines.text").alias("texts"), F.col("lines.id").alias("ids"), F.col("lines.y").alias("ys"), width.alias("widths")).mapInArrow(run, "src string, volume string, page_no int, analysis_id string, " + kinds)


def _across(ends: DataFrame, terms: Broadcast) -> DataFrame:
    """(volume, page_no, analysis_id, whole): the words that a page's last line breaks off, completed by the next page.

    ``ends``: volume, page_no, analysis_id, first_token, last_token of pages with running text.
    """
    heads = ends.groupBy("volume", (F.col("page_no") - 1).alias("page_no")).agg(F.min(F.struct("analysis_id", "first_token")).alias("_next")).select("volume", "page_no", "_next.first_token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _indexed(terms.value)
        for batch in batches:
            wholes = [words.broken(a, b) for a, b in zip(batch.column("last_token").to_pylist(), batch.column("first_token").to_pylist(), strict=True)]
            at = pa.array([i for i, w in enumerate(wholes) if w], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("volume", "page_no", "analysis_id")), pa.array([w for w in wholes if w], pa.string())], names=["volume", "page_no", "analysis_id", "whole"])

    return ends.select("volume", "page_no", "analysis_id", "last_token").join(heads, ["volume", "page_no"]).mapInArrow(run, "volume string, page_no int, analysis_id string, whole string")


def find_noise(ocr_line_data: DataFrame, ocr_line: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(src, analysis_id, line_id, noise) of all noisy lines; see the module for the kinds.

    Exactly repeated rows count once; lines without text or number in the page are kept in their place and are not noisy;
    rows without analysis_id are no page; pages without volume or number stand alone. Of two pages of one number the one
    with the smaller analysis_id goes on from the page before. Empty tables, and an empty lexicon, give what is left to
    find.
    """

    def made(key: tuple, page: Page) -> Iterator[tuple]:
        noise = set(page.noise)
        if page.first and key[1] is None:
            noise.update((i, "misread") for i, _, misread in (page.first, page.last) if misread)
        elif page.first:
            yield page.first[0], "first", page.first[1], page.first[2]
            yield page.last[0], "last", page.last[1], page.last[2]
        for line, kind in noise:
            yield line, kind, None, None

    pages = cut_lineage(scanned_pages(ocr_line_data, ocr_line))
    terms = _lexicon(pages.sparkSession, lexicon)
    read = cut_lineage(read_pages(pages, terms, made, (("line_id", pa.int32()), ("noise", pa.string()), ("token", pa.string()), ("misread", pa.bool_())), "line_id int, noise string, token string, misread boolean"))
    first, last = read.filter("noise = 'first'"), read.filter("noise = 'last'")
    ends = last.select("volume", "page_no", "analysis_id", F.col("token").alias("last_token")).join(first.select("volume", "page_no", "analysis_id", F.col("token").alias("first_token")), ["volume", "page_no", "analysis_id"])
    wholes = _across(ends, terms)
    before = wholes.select("volume", (F.col("page_no") + 1).alias("page_no"))
    row = lambda rows, kind: rows.select("src", "analysis_id", "line_id", F.lit(kind).alias("noise"))
    return (
        read.filter("token is null").select("src", "analysis_id", "line_id", "noise")
        .unionAll(row(last.join(wholes, ["volume", "page_no", "analysis_id"], "left_semi"), "broken_word"))
        .unionAll(row(last.filter("misread").join(wholes, ["volume", "page_no", "analysis_id"], "left_anti"), "misread"))
        .unionAll(row(first.filter("misread").join(before, ["volume", "page_no"], "left_anti"), "misread"))
        .distinct()
    )


def readable_pages(ocr_line_data: DataFrame, ocr_line: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(src, volume, page_no, analysis_id, text): each page's running text in paragraphs, words whole and corrected.

    A word that goes on on the next page stands on the page where it begins. Pages without running text are empty.
    """

    def made(key: tuple, page: Page) -> Iterator[tuple]:
        yield page.first and page.first[1], page.last and page.last[1], page.text

    pages = cut_lineage(scanned_pages(ocr_line_data, ocr_line))
    columns = (("first_token", pa.string()), ("last_token", pa.string()), ("text", pa.string()))
    terms = _lexicon(pages.sparkSession, lexicon)
    read = cut_lineage(read_pages(pages, terms, made, columns, "first_token string, last_token string, text string", texts=True))
    wholes = _across(read.filter("volume is not null and first_token is not null").drop("src", "text"), terms)
    before = wholes.groupBy("volume", (F.col("page_no") + 1).alias("page_no")).agg(F.min("whole").alias("before"))
    both = read.join(wholes, ["volume", "page_no", "analysis_id"], "left").join(before, ["volume", "page_no"], "left")
    text = F.when(F.col("before").isNotNull(), F.regexp_replace("text", r"^\S+\s*", "")).otherwise(F.col("text"))
    text = F.when(F.col("whole").isNotNull(), F.concat(F.regexp_replace(text, r"\S+$", ""), F.col("whole"))).otherwise(text)
    return both.select("src", "volume", "page_no", "analysis_id", text.alias("text"))
