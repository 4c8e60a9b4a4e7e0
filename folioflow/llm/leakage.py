"""Evaluation texts that leak into the training corpus: SimHash windows, multi-index Hamming blocks, verification.

The evaluation items are the stated query set. Each gets SimHash fingerprints of all its windows of one width, which
follows from the item's size (``WIDTHS``): a stretch that holds half of the item, and the whole item with a tenth of its
letters wrong, also hold such a window on the corpus grid. Windows as large as the item itself find neither: with half
of its shingles the fingerprint of a window is as far off as that of any other text.
Corpus texts are fingerprinted at every ``grid``-th position for each width in use. Fingerprints are cut into
RADIUS + 1 blocks; two that differ in at most RADIUS bits agree in a block, so looking all blocks up finds every window
pair within the radius. The stretches around them are verified by their shingles, as many as an alignment over half the
item cannot do without and a share of their idf weight (weights count all items), and then by local alignment.

The corpus is only scanned: no shuffle, no row leaves its task but the found ones. The driver passes the items on in
blocks of bounded size, one broadcast and one scan a block; fingerprints and lookup tables are made by the executors.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.textforms import compact, folded, local_scores, rolling_hashes

GRAM = 3
#: (shingles of the item from which on, width in shingles, grid). A window is met by any clean run of
#: width + grid + 1 letters; with a tenth of its letters wrong at random an item has one in 9 of 10 cases or more.
WIDTHS = ((3840, 40, 4), (1920, 32, 4), (960, 24, 4), (480, 16, 4), (240, 12, 4), (98, 8, 4), (48, 6, 2), (24, 4, 1), (8, 3, 1))
RADIUS = 3
#: Characters of items that one scan's broadcast may hold (an executor's index takes about 150 bytes each).
ITEM_CHARS = 1_000_000
#: Share of the item that must stand in one stretch, in units of the alignment score (matches less two an error).
SHARE = 0.5
#: A candidate goes on to alignment if its stretch holds this share of the item's weighted shingles.
CONTAINED = 0.1
#: Characters fingerprinted at a time.
CHUNK = 1 << 20
#: Bits of the table that tells which shingles an item has.
TABLE_BITS = 16
_ONES = np.uint64(0x0101010101010101)


def item_width(size: int) -> tuple[int, int]:
    """(width, grid) for an item of ``size`` shingles."""
    for least, width, grid in WIDTHS:
        if size >= least:
            return width, grid
    return max(1, size // 2), 1


def bit_counts(grams: np.ndarray, grid: int) -> np.ndarray:
    """Running counts (modulo 256) of the set bits of all grams before every ``grid``-th one, a column a bit."""
    blocks = len(grams) // grid
    sums = np.empty((blocks, 8), np.uint64)
    for lane in range(8):
        # Eight counters to a word; a grid of grams cannot overflow them.
        bits = (grams[: blocks * grid] >> np.uint64(lane)) & _ONES
        sums[:, lane] = bits.reshape(blocks, grid).sum(axis=1, dtype=np.uint64) if grid > 1 else bits
    counts = np.zeros((blocks + 1, 64), np.uint8)
    np.cumsum(sums.view(np.uint8), axis=0, dtype=np.uint8, out=counts[1:])
    return counts


def simhashes(counts: np.ndarray, width: int, grid: int) -> np.ndarray:
    """64-bit SimHash of each window of ``width`` grams (below 256, a multiple of ``grid``), at every ``grid``-th gram."""
    span = width // grid
    if len(counts) <= span:
        return np.zeros(0, np.uint64)
    return np.packbits((counts[span:] - counts[:-span]) > width // 2, axis=1, bitorder="little").view(np.uint64)[:, 0]


def needed(size: int) -> float:
    """Shingles of an item of ``size`` letters that a stretch has whole if its alignment scores more than SHARE of it.

    Matches fall into one run more than there are errors, a run has GRAM - 1 shingles less than letters, and the score
    is matches less two an error.
    """
    return SHARE * size - (GRAM - 1)


@dataclass
class ItemIndex:
    """Fingerprints of all windows of a block of items, by (width, grid), with one lookup table a Hamming block."""

    ids: list[int]
    points: list[np.ndarray]
    #: Weight of each shingle of each item.
    weights: list[dict[int, float]]
    #: Distinct prints, the first of each one's places in owner and offset, these, and the lookups.
    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]
    shingles: dict[int, tuple[Counter[int], float]] = field(default_factory=dict)
    present: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def build(cls, items: list[tuple[int, str, dict[int, int]]]) -> ItemIndex:
        """``items``: (id, compact text, how many items hold each of its shingles)."""
        ids, points, weights, windows = [], [], [], defaultdict(list)
        for item, text, held in items:
            p = folded(text)
            if not len(p):
                continue
            grams = rolling_hashes(p, min(GRAM, len(p)))
            key = item_width(len(grams))
            windows[key].append((len(ids), simhashes(bit_counts(grams, 1), key[0], 1)))
            ids.append(item)
            points.append(p)
            weights.append({g: 1.0 / math.log2(1.0 + n) for g, n in held.items()})
        tables = {}
        for key, parts in windows.items():
            every = np.concatenate([x for _, x in parts])
            order = np.argsort(every, kind="stable")
            owner = np.concatenate([np.full(len(x), i, np.int64) for i, x in parts])[order]
            offset = np.concatenate([np.arange(len(x)) for _, x in parts])[order]
            prints, first = np.unique(every[order], return_index=True)
            lookups = []
            for block in range(RADIUS + 1):
                value = ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
                order = np.argsort(value, kind="stable").astype(np.int32)
                lookups.append((np.searchsorted(value[order], np.arange(0x10001)), order))
            tables[key] = (prints, np.append(first, len(every)), owner, offset, lookups)
        return cls(ids, points, weights, tables)

    def near(self, key: tuple[int, int], prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``prints`` and item prints that differ in at most RADIUS bits; a pair may come more than once."""
        own, *_, lookups = self.tables[key]
        at, to = [], []
        for block, (starts, order) in enumerate(lookups):
            value = ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
            first = starts[value]
            left, right = _spread(first, starts[value + 1] - first)
            right = order[right]
            close = np.bitwise_count(prints[left] ^ own[right]) <= RADIUS
            at.append(left[close])
            to.append(right[close])
        return np.concatenate(at), np.concatenate(to)

    def _present(self, item: int) -> np.ndarray:
        if item not in self.present:
            self.present[item] = np.zeros(1 << TABLE_BITS, np.uint8)
            self.present[item][_place(rolling_hashes(self.points[item], min(GRAM, len(self.points[item]))))] = 1
        return self.present[item]

    def contained(self, item: int, stretch: np.ndarray) -> bool:
        """Whether the stretch holds as many of the item's shingles as needed, and CONTAINED of their weight."""
        k, weights = min(GRAM, len(self.points[item])), self.weights[item]
        if item not in self.shingles:
            own = Counter(rolling_hashes(self.points[item], k).tolist())
            self.shingles[item] = own, sum(n * weights[g] for g, n in own.items())
        own, whole = self.shingles[item]
        there = Counter(rolling_hashes(stretch, k).tolist())
        both = {g: min(n, own[g]) for g, n in there.items() if g in own}
        return sum(both.values()) >= needed(len(self.points[item])) and sum(n * weights[g] for g, n in both.items()) >= CONTAINED * whole

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """(text number, item id) of every text that holds more than SHARE of an item in one stretch."""
        begin = 0
        while begin < len(texts):
            end, size, parts = begin, 0, []
            while end < len(texts) and (not parts or size < CHUNK):
                parts.append(folded(compact(texts[end])))
                size += len(parts[-1])
                end += 1
            yield from ((begin + i, self.ids[item]) for i, item in self._search(parts))
            begin = end

    def _hits(self, line: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """(item, text, band) numbers of window pairs; a band is 32 letters wide, of where the item would begin."""
        longest = max(w for w, _ in self.tables)
        bands = np.int64(len(line) // 32 + 2)
        deepest = max(len(p) for p in self.points) // 32 + 2
        for base in range(0, max(1, len(line)), CHUNK):
            piece = line[base : base + CHUNK + longest + GRAM + 4]
            grams = rolling_hashes(piece, min(GRAM, max(1, len(piece))))
            for grid in sorted({g for _, g in self.tables}):
                counts = bit_counts(grams, grid)
                for width in sorted(w for w, g in self.tables if g == grid):
                    prints = simhashes(counts, width, grid)
                    at, to = self.near((width, grid), prints)
                    start = at * grid + base
                    text = np.minimum(np.searchsorted(ends, start, side="right"), len(ends) - 1)
                    whole = start + width + GRAM - 1 <= ends[text]
                    _, first, owner, offset, _ = self.tables[width, grid]
                    left, right = _spread(first[to[whole]], first[to[whole] + 1] - first[to[whole]])
                    start, text = start[whole][left], text[whole][left]
                    band = (start - begins[text] - offset[right]) // 32 + deepest
                    yield np.unique((owner[right] * len(ends) + text) * (bands + deepest) + band)

    def _search(self, parts: list[np.ndarray]) -> set[tuple[int, int]]:
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        line = np.concatenate(parts) if len(parts) > 1 else parts[0]
        if not self.tables or not len(line):
            return set()
        found = np.unique(np.concatenate(list(self._hits(line, begins, ends))))
        deepest = max(len(p) for p in self.points) // 32 + 2
        rest, band = np.divmod(found, np.int64(len(line) // 32 + 2) + deepest)
        items, texts = np.divmod(rest, len(ends))
        lengths = np.array([len(p) for p in self.points])[items]
        middle = (band - deepest) * 32
        low = np.maximum(0, middle - lengths // 8 - 32)
        high = np.minimum(sizes[texts], middle + lengths + lengths // 8 + 64)
        tasks: list[tuple[int, int, np.ndarray]] = []
        places = np.append(_place(rolling_hashes(line, min(GRAM, len(line)))), np.zeros(min(GRAM, len(line)), np.int64))
        edges = np.flatnonzero(np.r_[True, items[1:] != items[:-1], True]) if len(items) else []
        for a, b in zip(edges[:-1], edges[1:]):
            item = int(items[a])
            left, right = _spread(begins[texts[a:b]] + low[a:b], np.maximum(1, high[a:b] - low[a:b]))
            held = np.bincount(left, weights=self._present(item)[places[right]], minlength=b - a)
            close = np.flatnonzero(held >= needed(len(self.points[item]))) + a
            last = -1
            for i in close.tolist():
                text, x, y = int(texts[i]), int(low[i]), int(high[i])
                if last >= 0 and tasks[last][0] == text and x <= tasks[last][2]:
                    tasks[last] = (text, tasks[last][1], max(y, tasks[last][2]), item)
                else:
                    last = len(tasks)
                    tasks.append((text, x, y, item))
        work = [(t, item, parts[t][x:y]) for t, x, y, item in tasks]
        work = sorted((w for w in work if self.contained(w[1], w[2])), key=lambda w: len(w[2]))
        hits = set()
        for i in range(0, len(work), 64):
            some = work[i : i + 64]
            scores = local_scores([(self.points[item], stretch) for _, item, stretch in some])
            hits.update((text, item) for (text, item, _), s in zip(some, scores.tolist(), strict=True) if s > SHARE * len(self.points[item]))
        return hits


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first, first + 1, ... (``many`` of them) of every entry, and the entry each belongs to."""
    left = np.repeat(np.arange(len(many)), many)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


def counted_items(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, grams, held): compact texts, their distinct shingles and how many items of all hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [compact(t) for t in batch.column("text").to_pylist()]
            grams = [np.unique(rolling_hashes(folded(t), min(GRAM, len(t)))).view(np.int64) if t else np.zeros(0, np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string()), pa.array([g.tolist() for g in grams], pa.list_(pa.int64()))], names=["key", "text", "grams"])

    kind = items.schema[key].dataType.simpleString()
    made = items.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null").mapInArrow(run, f"key {kind}, text string, grams array<bigint>")
    each = made.filter("text <> ''").dropDuplicates(["key", "text"]).select(F.struct("key", "text").alias("row"), F.explode("grams").alias("gram"))
    held = each.groupBy("gram").agg(F.count("*").cast("int").alias("held"))
    listed = each.join(held, "gram").groupBy("row").agg(F.collect_list("gram").alias("grams"), F.collect_list("held").alias("held"))
    return listed.select("row.key", "row.text", "grams", "held")


def item_blocks(counted: DataFrame) -> Iterator[list[tuple]]:
    """The query set in blocks of at most ITEM_CHARS characters (or one item), one after the other."""
    block: list[tuple] = []
    size = 0
    for row in counted.orderBy("key", "text").toLocalIterator():
        if block and size + len(row["text"]) > ITEM_CHARS:
            yield block
            block, size = [], 0
        block.append((row["key"], row["text"], row["grams"], row["held"]))
        size += len(row["text"])
    if block:
        yield block


@lru_cache(maxsize=1)
def _index(block) -> ItemIndex:
    """One index per broadcast block and worker process."""
    return ItemIndex.build([(key, text, dict(zip(np.array(grams, np.int64).view(np.uint64).tolist(), held, strict=True))) for key, text, grams, held in block.value])


def leaks(documents: DataFrame, items: DataFrame, split: str = "train") -> DataFrame:
    """(doc_id, item_id) of every document of the split that holds more than half of an item in one stretch.

    Spelling noise, spacing and form (width, case, punctuation) aside; whole texts are searched. Null and empty texts
    and items hold nothing; repeated documents are found each, repeated items once; items with the same text are found
    alike. The result does not depend on how items are laid out in blocks.
    """
    corpus = documents.filter((F.col("dataset_split") == split) & F.col("text").isNotNull()).select("doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    context, found = documents.sparkSession.sparkContext, None
    for block in item_blocks(counted_items(items, "item_id", "text")):
        shared = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for batch in batches:
                pairs = list(index.search(batch.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([i for i, _ in pairs], pa.int64())), pa.array([x for _, x in pairs], pa.int64())],
                    names=["doc_id", "item_id"],
                )

        part = corpus.mapInArrow(run, f"doc_id {kind}, item_id bigint")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else documents.sparkSession.createDataFrame([], f"doc_id {kind}, item_id bigint")


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """(eval_set, lang, n_items, n_leaked, n_documents): which part of each evaluation set leaked."""
    hit = found.groupBy("item_id").agg(F.count("*").alias("_docs"))
    return (
        items.select("item_id", "eval_set", "lang").join(hit, "item_id", "left")
        .groupBy("eval_set", "lang").agg(F.count("*").alias("n_items"), F.count("_docs").alias("n_leaked"), F.coalesce(F.sum("_docs"), F.lit(0)).alias("n_documents"))
    )
