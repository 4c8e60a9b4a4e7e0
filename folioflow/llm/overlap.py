"""Same or near-same pages across splits: all pairs by size and bitmaps, seed chains, alignment.

Texts are compared without spacing, case, width and punctuation. Equal texts form a class and only classes are
compared, so copies cost nothing. No seed is in every pair that differs by a fifth (an edit every five letters leaves
runs of four), so every training class is held against every held-out class whose size allows it. That is done on
bitmaps of letters and of grams, which bound the distance from below and never rule out a near-same pair; one
comparison is a few machine words. Bands of sizes and groups of classes in them make blocks of bounded work, into
which the bitmaps alone are shuffled; texts are joined only to pairs that may be near-same.

Those are verified by chaining the collinear seeds of both (the smallest rolling hash of every window of grams) and
aligning what lies between them and, where that is too far, by aligning the whole.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioflow.functions.ids import page_key
from folioflow.llm.mixture import source_key
from folioflow.llm.textforms import code_points, compact, edit_distance, folded, letter_masks, masked_distance, rolling_hashes
from folioflow.plans.lineage import cut_lineage

#: Greatest edit distance, as a share of the longer text.
DISTANCE = 0.2
#: (gram, window) of the seeds of texts from so many letters on.
GRAMS = ((0, 2, 1), (12, 3, 1), (24, 4, 2), (36, 5, 2), (48, 6, 3), (72, 8, 3), (170, 10, 4), (340, 12, 5))
#: Training classes of a block, and held-out classes that one copy of it meets, in HEAVY.
HEAVY, SALTS = 32_768, 8
#: Mean size up to which a block may have HEAVY classes; longer ones are fewer.
LETTERS = 256
#: Texts of so many letters are first aligned as a whole.
MASKED = 4096
#: Words of 64 bits of a letter bitmap, if nothing else is asked for.
WORDS = 8
#: (gram, words, least words): bitmaps of a class, in multiples of the words of its letter bitmap. In long texts most
#: letters and pairs of letters are the same anyway.
LEVELS = ((1, 1, 0), (2, 2, 0), (4, 8, 16))
_BOUNDS = np.array([low for low, _, _ in GRAMS])


def gram_numbers(sizes: np.ndarray) -> np.ndarray:
    """The row of GRAMS for texts of so many letters."""
    return np.searchsorted(_BOUNDS, sizes, side="right") - 1


def winnowed(texts: list[np.ndarray], gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, position) of the smallest gram hash of every window of each text, equal hashes once.

    A text with fewer grams than a window has one fingerprint, one shorter than a gram that of the whole of it.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    own, hashes, places = [], [], []
    for i in np.flatnonzero((sizes > 0) & (sizes < gram)):
        own.append([i])
        hashes.append(rolling_hashes(texts[i], int(sizes[i])))
        places.append([0])
    long = np.flatnonzero(sizes >= gram)
    if len(long):
        line = np.concatenate([texts[i] for i in long])
        h = rolling_hashes(line, gram)
        begin = np.cumsum(sizes[long]) - sizes[long]
        grams = sizes[long] - gram + 1
        # Windows lie within one text; a text with fewer grams than a window has one of all of them.
        windows = np.maximum(1, grams - window + 1)
        number = np.repeat(np.arange(len(long)), windows)
        first = np.arange(len(number)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[number]
        reach = np.minimum(window, grams)[number]
        best = first.copy()
        for step in range(1, window):
            at = np.minimum(first + step, len(h) - 1)
            best = np.where((step < reach) & (h[at] < h[best]), at, best)
        keep = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (number[1:] != number[:-1])])
        number, best = number[keep], best[keep]
        own.append(long[number])
        hashes.append(h[best])
        places.append(best - begin[number])
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    o, x, p = (np.concatenate(part) for part in (own, hashes, places))
    order = np.lexsort((p, x, o))
    o, x, p = o[order], x[order], p[order].astype(np.int64)
    once = np.r_[True, (o[1:] != o[:-1]) | (x[1:] != x[:-1])]
    return o[once].astype(np.int64), x[once], p[once]


def fingerprints(text: str, longer: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a compact text in the gram of a text of ``longer`` letters (its own if not given)."""
    _, gram, window = GRAMS[int(gram_numbers(np.array([len(text) if longer is None else longer]))[0])]
    _, hashes, places = winnowed([folded(text)], gram, window)
    return hashes, places


def letter_bits(text: str, words: int = WORDS, gram: int = 1) -> np.ndarray:
    """Bitmap of the letters or grams of a compact text, equal ones told apart by their count.

    Each edit adds or takes one letter, so a text has at least as many letters more than another as it has bits more.
    """
    points = code_points(text)
    points = np.sort(points.astype(np.uint64) if gram == 1 else rolling_hashes(points, gram))
    if not len(points):
        return np.zeros(words, np.uint64)
    new = np.r_[True, points[1:] != points[:-1]]
    place = np.arange(len(points))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    bit = ((points * np.uint64(1 << 20) + nth.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(64 * words)
    flags = np.zeros(64 * words, np.uint8)
    flags[bit.astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def chain(left: tuple, right: tuple) -> list[tuple[int, int]]:
    """Longest collinear chain of non-overlapping seeds that both texts select: (position, position), ascending."""
    by_hash = dict(zip(right[0].tolist(), right[1].tolist(), strict=True))
    seeds = sorted((p, by_hash[h]) for h, p in zip(left[0].tolist(), left[1].tolist(), strict=True) if h in by_hash)
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(seeds)
    for i, (_, q) in enumerate(seeds):
        k = bisect.bisect_left(tails, q)
        back[i] = at[k - 1] if k else -1
        tails[k : k + 1], at[k : k + 1] = [q], [i]
    best, i = [], at[-1] if at else -1
    while i >= 0:
        best.append(seeds[i])
        i = back[i]
    return best[::-1]


class Texts:
    """Fingerprints and letter counts of the texts of a batch, each made once."""

    def __init__(self) -> None:
        self.made: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        self.letters: dict[str, Counter[str]] = {}
        self.bits: dict[str, dict[str, int]] = {}
        self.size = 0

    def prints(self, text: str, longer: int) -> tuple[np.ndarray, np.ndarray]:
        key = text, int(gram_numbers(np.array([longer]))[0])
        if key not in self.made:
            self.made[key] = fingerprints(text, longer)
        return self.made[key]

    def counted(self, text: str) -> Counter[str]:
        if text not in self.letters:
            self.letters[text] = Counter(text)
        return self.letters[text]

    def masks(self, text: str) -> dict[str, int]:
        if text not in self.bits:
            # Masks take far more room than their text, so they are not kept for a whole batch.
            if self.size > 1_000_000:
                self.bits, self.size = {}, 0
            self.bits[text] = letter_masks(text)
            self.size += len(text)
        return self.bits[text]


def aligned_distance(a: str, b: str, most: int, texts: Texts | None = None) -> int:
    """Edit distance of two compact texts along their seed chain, or a number above ``most``.

    Seeds count as aligned in place; the stretches between, before and after them are aligned exactly. Where that is
    above ``most`` the texts are aligned as a whole. Letters that one text has more of than the other are edits at least.
    """
    texts = texts or Texts()
    longer, other = (a, b) if len(a) >= len(b) else (b, a)
    counts = texts.counted(other)
    if sum(max(0, k - counts[c]) for c, k in texts.counted(longer).items()) > most:
        return most + 1
    # Most pairs are far apart; that shows soon in columns of bits, which are long in long texts, however.
    if len(longer) <= MASKED and masked_distance(texts.masks(longer), len(longer), other, most) > most:
        return most + 1
    x, y = code_points(a), code_points(b)
    total, i, j = 0, 0, 0
    for p, q in [*chain(texts.prints(a, len(a)), texts.prints(b, len(a))), (len(x), len(y))]:
        if p < i or q < j:
            continue
        total += edit_distance(x[i:p], y[j:q], most - total)
        if total > most:
            return masked_distance(texts.masks(longer), len(longer), other, most)
        # A seed matches in its folded form; only the part that is the same as it stands is skipped.
        same = 0
        while p + same < len(x) and q + same < len(y) and x[p + same] == y[q + same]:
            same += 1
        i, j = p + same, q + same
    return total


@F.pandas_udf(StringType())
def compact_text(text):
    return text.map(compact)


def page_texts(annotations: DataFrame) -> DataFrame:
    """(page, text): a page's non-blank annotation texts, each ann_key once, in the order of id, in compact form."""
    rows = annotations.select(page_key(F.col("document_id")).alias("page"), "id", "ann_key", F.col("annotation.text").alias("text")).filter("page is not null and trim(text) <> ''")
    once = lambda x, i: (i == 0) | x["ann_key"].isNull() | ~x["ann_key"].eqNullSafe(F.element_at(F.col("_notes"), F.when(i > 0, i).otherwise(1))["ann_key"])
    joined = rows.groupBy("page").agg(F.array_sort(F.collect_set(F.struct("id", "ann_key", "text"))).alias("_notes"))
    return joined.select("page", compact_text(F.array_join(F.transform(F.filter("_notes", once), lambda x: x["text"]), " ")).alias("text")).filter("text <> ''")


class Places(NamedTuple):
    """Where classes are compared: in each band of sizes, training classes lie in groups, each group in copies.

    A group has at most HEAVY classes on average, a copy meets at most SALTS * HEAVY held-out ones; ``first`` is the
    number of the band's first block.
    """

    first: int
    groups: int
    copies: int


def band_of(size: Column) -> Column:
    """Band of a number of letters; near-same texts lie in the same or in neighbouring bands. Rises with the size."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / math.log(1 / (1 - DISTANCE))).cast("int")


def band_words(band: int) -> int:
    """Words of the letter bitmap in a band, a power of two: at least two bits a letter of its longest texts."""
    return 1 << max(1, math.ceil(math.log2((1 - DISTANCE) ** -(band + 1) / 32)))


def places(classes: DataFrame) -> tuple[dict[int, Places], int]:
    """(places of each band with training classes, number of blocks). One row a band reaches the driver."""
    trained = F.col("trains").cast("int")
    counts = classes.groupBy(band_of(F.length("text")).alias("band")).agg(F.sum(trained).alias("n"), F.sum(trained * F.length("text")).alias("letters"), F.sum(F.col("tests").cast("int")).alias("m"))
    rows = {r["band"]: r for r in counts.collect()}
    found, blocks = {}, 0
    for band in sorted(rows):
        if not rows[band]["n"]:
            continue
        groups = max(1, -(-rows[band]["n"] // HEAVY), -(-rows[band]["letters"] // (HEAVY * LETTERS)))
        copies = max(1, -(-sum(rows[k]["m"] for k in range(band - 1, band + 2) if k in rows) // (HEAVY * SALTS)))
        found[band] = Places(blocks, groups, copies)
        blocks += groups * copies
    return found, blocks


def _bitmaps(classes: DataFrame, found: dict[int, Places]) -> DataFrame:
    """(block, test, class, chars, words, bits): the bitmaps of each class (see LEVELS), in each block where it is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in pa.Table.from_batches([whole]).to_batches(max_chunksize=1000)):
            out: dict[str, list] = {k: [] for k in ("blocks", "test", "class", "chars", "words", "bits")}
            for number, text, chars, trains, tests, band, low, high in zip(*(batch.column(c).to_pylist() for c in ("class", "text", "chars", "trains", "tests", "band", "low", "high")), strict=True):
                at = []
                if trains:
                    first, groups, copies = found[band]
                    start = first + number % groups * copies
                    at.append((False, list(range(start, start + copies))))
                if tests:
                    near = [found[k] for k in range(low, high + 1) if k in found]
                    at.append((True, [first + group * copies + number % copies for first, groups, copies in near for group in range(groups)]))
                words = band_words(band)
                bits = np.concatenate([letter_bits(text, words * times, gram) for gram, times, least in LEVELS if words >= least]).tobytes()
                for test, blocks in at:
                    for k, v in zip(out, (blocks, test, number, chars, words, bits), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.list_(pa.int32()), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=list(out))

    size = F.length("text")
    # A letter more on either side, so that no rounding leaves out a band.
    low, high = band_of(F.floor(size * (1 - DISTANCE)) - 1), band_of(F.ceil(size / (1 - DISTANCE)) + 1)
    rows = classes.select("class", "text", size.alias("chars"), "trains", "tests", band_of(size).alias("band"), low.alias("low"), high.alias("high"))
    made = rows.mapInArrow(run, "blocks array<int>, test boolean, class bigint, chars int, words int, bits binary")
    return made.select(F.explode("blocks").alias("block"), "test", "class", "chars", "words", "bits")


class Bitmaps:
    """Classes with bitmaps of ``words`` words (times those of LEVELS), in the order of their size."""

    def __init__(self, numbers: np.ndarray, chars: np.ndarray, words: int, bits: list[np.ndarray]) -> None:
        self.numbers, self.chars, self.words, self.bits = numbers, chars, words, bits
        self.most = np.floor(chars * DISTANCE).astype(np.int32)
        self.ones = [np.bitwise_count(level).sum(axis=1, dtype=np.int32) for level in bits]
        self.columns = np.ascontiguousarray(bits[0].T)

    @classmethod
    def of(cls, rows: pa.Table) -> Bitmaps:
        """Of rows (class, chars, words, bits) of as many words."""
        numbers, chars, words = rows["class"].to_numpy(), rows["chars"].to_numpy(), rows["words"][0].as_py()
        order = np.argsort(chars, kind="stable")
        flat = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(order), -1)[order]
        ends = np.cumsum([words * times for _, times, least in LEVELS if words >= least])
        return cls(numbers[order], chars[order], words, np.split(flat, ends[:-1], axis=1))

    def folded_to(self, words: int) -> Bitmaps:
        """The same with fewer words: a bit lies where its number modulo the new size says."""
        if words == self.words:
            return self
        levels = [level for level, (_, _, least) in zip(self.bits, LEVELS, strict=False) if words >= least]
        small = [np.bitwise_or.reduce(level.reshape(len(level), self.words // words, -1), axis=1) for level in levels]
        return Bitmaps(self.numbers, self.chars, words, small)


def near_bitmaps(left: Bitmaps, right: Bitmaps) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places in left, in right) that sizes and bitmaps allow to be near-same; every pair is compared.

    One edit takes at most as many grams of a text as a gram has letters, so a text has at most that many bits for each
    edit which the other has not.
    """
    # Three words fit into a byte; 64 * words bits and a fifth of 64 * words letters at most fit into two up to 255 words.
    number = np.int16 if left.words < 256 else np.int32
    most_x, ones_x = left.most.astype(number), left.ones[0].astype(number)
    rooms = [np.empty(32 * 4096, kind) for kind in (np.uint64, np.uint8, np.uint8, number, number, number)]
    for top in range(0, len(right.chars), 32):
        rows = slice(top, top + 32)
        sizes, most_y, ones_y = right.chars[rows], right.most[rows, None].astype(number), right.ones[0][rows, None].astype(number)
        begin, end = np.searchsorted(left.chars, [int(sizes[0] * (1 - DISTANCE)) - 1, int(sizes[-1] / (1 - DISTANCE)) + 2])
        for start in range(begin, end, 4096):
            part = slice(start, min(end, start + 4096))
            shape = len(sizes), part.stop - start
            both, count, few, common, most, ones = (room[: shape[0] * shape[1]].reshape(shape) for room in rooms)
            common[:] = 0
            for word in range(0, left.words, 3):
                few[:] = 0
                for x, y in zip(left.columns[word : word + 3, part], right.columns[word : word + 3, rows], strict=True):
                    np.bitwise_and(x, y[:, None], out=both)
                    few += np.bitwise_count(both, out=count)
                common += few
            common += np.maximum(most_x[part], most_y, out=most)
            at = np.flatnonzero(common >= np.maximum(ones_x[part], ones_y, out=ones))
            i, j = at % shape[1] + start, at // shape[1] + top
            fits = np.abs(left.chars[i] - right.chars[j]) <= np.maximum(left.most[i], right.most[j])
            i, j = i[fits], j[fits]
            for level, (gram, _, _) in enumerate(LEVELS[: min(len(left.bits), len(right.bits))]):
                if level and len(i):
                    keep = np.zeros(len(i), bool)
                    for k in range(0, len(i), 2048):
                        p, q = i[k : k + 2048], j[k : k + 2048]
                        shared = np.bitwise_count(left.bits[level][p] & right.bits[level][q]).sum(axis=1, dtype=np.int32)
                        keep[k : k + 2048] = shared + gram * np.maximum(left.most[p], right.most[q]) >= np.maximum(left.ones[level][p], right.ones[level][q])
                    i, j = i[keep], j[keep]
            if len(i):
                yield i, j


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows that come block by block, the training classes of each first; held-out ones stream by."""
    block, parts, sides = None, [], {}
    for batch in batches:
        blocks, tests = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "test"))
        edges = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (tests[1:] != tests[:-1])) + 1).tolist(), len(blocks)]
        for start, end in itertools.pairwise(edges):
            if start == end:
                continue
            if blocks[start] != block:
                block, parts, sides = blocks[start], [], {}
            run = pa.Table.from_batches([batch.slice(start, end - start)])
            if not tests[start]:
                parts.append(run)
                continue
            if parts:
                # All of a block's training classes are of one band, so of one number of words.
                made = Bitmaps.of(pa.concat_tables(parts))
                parts, sides = [], {made.words: made}
            for size in np.unique(run["words"].to_numpy()).tolist() if sides else []:
                most = max(sides)
                right = Bitmaps.of(run.filter(pc.field("words") == size)).folded_to(min(size, most))
                if right.words not in sides:
                    sides[right.words] = sides[most].folded_to(right.words)
                left = sides[right.words]
                for i, j in near_bitmaps(left, right):
                    a, b = left.numbers[i], right.numbers[j]
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): all classes whose sizes and bitmaps allow them to be near-same, each pair once; a trains, b tests."""
    found, blocks = places(classes)
    rows = _bitmaps(classes, found).repartitionById(max(1, blocks), F.col("block")).sortWithinPartitions("block", "test")
    return rows.mapInArrow(_compared, "a bigint, b bigint")


def class_pairs(classes: DataFrame) -> DataFrame:
    """(a, b, distance, chars): near-same classes, a with training and b with held-out members.

    ``classes``: class (bigint, unique), text (compact, unique), trains, tests.
    """
    texts = classes.select("class", "text")
    both = candidate_pairs(classes).join(texts.withColumnsRenamed({"class": "a", "text": "x"}), "a").join(texts.withColumnsRenamed({"class": "b", "text": "y"}), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, far, chars, texts = [], [], [], Texts()
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                n = max(len(x), len(y))
                d = aligned_distance(x, y, int(n * DISTANCE), texts)
                if d <= n * DISTANCE:
                    keep.append(i)
                    far.append(d)
                    chars.append(n)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(far, pa.int64()), pa.array(chars, pa.int64())], names=["a", "b", "distance", "chars"])

    return both.select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint, distance bigint, chars bigint")


def _side(split: Column) -> Column:
    return F.when(split == "train", "train").when(split.isin("dev", "final"), "test")


def overlapping_classes(documents: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b, coverage), (class, doc_id, side)): classes of near-same pages across the splits, and their members.

    coverage is the share of the longer text that both have in common; a class with members on both sides is linked to
    itself. Documents without split or without non-blank annotations are no members; a document delivered twice is two.
    """
    pages = documents.select("doc_id", page_key(F.col("document_id")).alias("page"), _side(F.col("dataset_split")).alias("side")).filter("page is not null and side is not null")
    # A page's side flags travel with its text, so texts shuffle once and only pages of some document go on.
    sides = pages.groupBy("page").agg(F.bool_or(F.col("side") == "train").alias("trains"), F.bool_or(F.col("side") == "test").alias("tests"))
    texts = page_texts(annotations).join(sides, "page").withColumn("digest", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    texts = cut_lineage(texts)
    classes = texts.groupBy("digest").agg(F.min("text").alias("text"), F.bool_or("trains").alias("trains"), F.bool_or("tests").alias("tests"))
    # Numbers are fixed by the checkpoint, whichever way the rows lay.
    classes = cut_lineage(classes.withColumn("class", F.monotonically_increasing_id()))
    same = classes.filter("trains and tests").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("coverage"))
    near = class_pairs(classes).select("a", "b", (1 - F.col("distance") / F.col("chars")).alias("coverage"))
    members = pages.join(texts.select("page", "digest"), "page").join(classes.select("digest", "class"), "digest").select("class", "doc_id", "side")
    return near.unionAll(same), members


def overlapping_pairs(documents: DataFrame, annotations: DataFrame) -> DataFrame:
    """(train_id, test_id, coverage) of every pair of a training and a held-out document with near-same pages.

    See ``overlapping_classes`` for what is in no pair. An empty table gives no pairs.
    """
    links, members = overlapping_classes(documents, annotations)
    return (
        links.join(members.filter("side = 'train'").select(F.col("class").alias("a"), F.col("doc_id").alias("train_id")), "a")
        .join(members.filter("side = 'test'").select(F.col("class").alias("b"), F.col("doc_id").alias("test_id")), "b")
        .select("train_id", "test_id", "coverage")
    )


def found_pairs(documents: DataFrame, annotations: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first."""
    return overlapping_pairs(documents, annotations).select(F.least("train_id", "test_id").alias("doc_id_a"), F.greatest("train_id", "test_id").alias("doc_id_b"))


def overlap_report(documents: DataFrame, annotations: DataFrame) -> DataFrame:
    """(dataset_split, source, n_docs, n_pairs, mean_coverage): overlaps per held-out split and source.

    Counted from classes and the number of their training members; pairs of documents are not made.
    """
    links, members = overlapping_classes(documents, annotations)
    trained = members.filter("side = 'train'").groupBy(F.col("class").alias("a")).agg(F.count("*").alias("_k"))
    hits = links.join(trained, "a").groupBy(F.col("b").alias("class")).agg(F.sum("_k").alias("_pairs"), F.sum(F.col("_k") * F.col("coverage")).alias("_covered"))
    about = documents.select("doc_id", "dataset_split", source_key(F.col("source")).alias("source"))
    return (
        hits.join(members.filter("side = 'test'"), "class").join(about, "doc_id").groupBy("dataset_split", "source")
        .agg(F.count("*").alias("n_docs"), F.sum("_pairs").alias("n_pairs"), F.round(F.sum("_covered") / F.sum("_pairs"), 4).alias("mean_coverage"))
    )
