"""Comparable forms of text: letters and digits only, apart from spelling variants, and rolling hashes over them."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_OTHER = re.compile(r"[\W_]+")
#: Letters that scanning confuses with digits or each other, folded for seeds (not for verification of distances).
CONFUSED = {"o": "0", "l": "1", "i": "1", "q": "9", "b": "8", "s": "5", "z": "2", "c": "e"}
_FOLD = np.arange(0x110000, dtype=np.uint32)
for _from, _to in CONFUSED.items():
    _FOLD[ord(_from)] = ord(_to)


def compact(text: str | None) -> str:
    """Letters and digits of a text in NFKC and without case; spacing and punctuation are gone."""
    return "" if not text else _OTHER.sub("", unicodedata.normalize("NFKC", text).casefold())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def folded(text: str) -> np.ndarray:
    """Code points of a compact text with confusable letters folded."""
    return _FOLD[code_points(text)]


_STEP = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def rolling_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams of code points, mixed so that any bits may be used."""
    n = len(points) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    wide = points.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _STEP + wide[i : i + n] + np.uint64(1)
    h ^= h >> np.uint64(31)
    h *= _A
    h ^= h >> np.uint64(27)
    h *= _B
    h ^= h >> np.uint64(31)
    return h


def local_scores(pairs: list[tuple[np.ndarray, np.ndarray]], mismatch: int = 2, gap: int = 2) -> np.ndarray:
    """Best local alignment score of each pair (match 1), all pairs of a call at once.

    Rows run over the first sequence; the horizontal gap recurrence is a running maximum. Shorter sequences are
    padded by codes that match nothing.
    """
    if not pairs:
        return np.zeros(0, np.int32)
    rows, width = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    left = np.full((rows, len(pairs)), 0xFFFFFFFF, np.uint32)
    right = np.full((len(pairs), width), 0xFFFFFFFE, np.uint32)
    for i, (a, b) in enumerate(pairs):
        left[: len(a), i] = a
        right[i, : len(b)] = b
    slope = (gap * np.arange(width + 1)).astype(np.int32)
    score = np.zeros((len(pairs), width + 1), np.int32)
    best = np.zeros(len(pairs), np.int32)
    bonus = np.int32(1 + mismatch)
    for row in left:
        step = score[:, :-1] + (right == row[:, None]) * bonus
        step -= mismatch
        new = np.zeros_like(score)
        np.maximum(step, score[:, 1:] - gap, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        new += slope
        np.maximum.accumulate(new, axis=1, out=new)
        new -= slope
        score = new
        np.maximum(best, score.max(axis=1), out=best)
    return best


def edit_distance(a: np.ndarray, b: np.ndarray, most: int | None = None) -> int:
    """Unit-cost edit distance of two code point arrays, a row at a time, or a number above ``most``."""
    if len(a) > len(b):
        a, b = b, a
    slope = np.arange(len(b) + 1)
    last = slope.copy()
    for i, x in enumerate(a):
        new = np.empty_like(last)
        new[0] = i + 1
        np.minimum(last[1:] + 1, last[:-1] + (b != x), out=new[1:])
        last = np.minimum.accumulate(new - slope) + slope
        if most is not None and last.min() > most:
            return most + 1
    return int(last[-1])


def letter_masks(text: str) -> dict[str, int]:
    """For each letter the places where it stands in the text, as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def masked_distance(masks: dict[str, int], size: int, other: str, most: int | None = None) -> int:
    """Edit distance of the text of ``size`` letters that ``masks`` stand for and another (columns of bits, after Myers).

    Where it is above ``most``, if that is given, any number above it.
    """
    full = (1 << size) - 1
    last, up, down, far = 1 << size >> 1, full, 0, size
    if not size:
        return len(other)
    # Each letter that is left can take one from the distance at most.
    end = None if most is None else most + len(other)
    for place, c in enumerate(other):
        if end is not None and far + place > end:
            return most + 1
        same = masks.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        far += bool(more & last) - bool(less & last)
        more, less, same = more << 1 | 1, less << 1, same | down
        up, down = (less | ~(same | more)) & full, more & same & full
    return far
