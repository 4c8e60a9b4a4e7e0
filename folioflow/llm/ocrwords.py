"""Words under recognition noise: lexicon lookup by deletion neighbourhoods over jamo or letters."""

from __future__ import annotations

import re
from array import array
from itertools import repeat

import numpy as np

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
#: Letter groups that scanning takes for one another; both sides of a comparison are folded.
GROUPS = (("rn", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("ri", "n"))
_AS_LETTERS = str.maketrans("015869|!", "olsbgqll")
#: Signs that end a line inside a word.
MARKS = "-‐‑­¬~=–"
LONG = 7


def core(token: str) -> str:
    """A token without outer punctuation."""
    return _EDGE.sub("", token)


def jamo(word: str) -> str:
    """Hangul syllables as initial, vowel and final (code points of their own); other characters as they are."""
    out = []
    for c in word:
        n = ord(c) - 0xAC00
        if 0 <= n < 11172:
            out.append(chr(0xE000 + n // 588))
            out.append(chr(0xE100 + n % 588 // 28))
            if n % 28:
                out.append(chr(0xE200 + n % 28))
        else:
            out.append(c)
    return "".join(out)


def _grouped(word: str) -> str:
    for a, b in GROUPS:
        word = word.replace(a, b)
    return word


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two short strings is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(last[j + 1] + 1, new[j] + 1, last[j] + (x != y)))
        if min(new) > most:
            return False
        last = new
    return last[-1] <= most


def _deletions(word: str, most: int) -> set[str]:
    found, layer = {word}, {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        found |= layer
    return found


class Lexicon:
    """Correct forms, and the one a noisy token most likely stands for.

    The deletions of all forms are kept as sorted hashes with the number of their form (some 12 bytes each), so that large
    vocabularies fit beside the pages.
    """

    def __init__(self, terms: list[str]) -> None:
        self.terms = frozenset(terms)
        self.folded = frozenset(t.casefold() for t in terms)
        self.bare = {_INNER.sub("", t): t for t in sorted(terms)}
        self.forms = [(form, term) for term in sorted(self.terms) for form in sorted(self._forms(_INNER.sub("", term)))]
        hashes, owners = array("q"), array("i")
        for i, (form, _) in enumerate(self.forms):
            deletions = _deletions(form, self._most(form))
            hashes.extend(map(hash, deletions))
            owners.extend(repeat(i, len(deletions)))
        keys = np.array(hashes, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], np.array(owners, np.int32)[order]
        self.longest = max((len(f) for f, _ in self.forms), default=0)
        self.known: dict[str, str | None] = {}

    def _near(self, form: str) -> set[int]:
        """Numbers of the forms that have a deletion in common with this one (or one of the same hash)."""
        asked = np.fromiter(map(hash, _deletions(form, self._most(form))), np.int64)
        first, last = np.searchsorted(self.keys, asked, "left"), np.searchsorted(self.keys, asked, "right")
        found: set[int] = set()
        for i in np.flatnonzero(first < last).tolist():
            found.update(self.owners[first[i] : last[i]].tolist())
        return found

    @staticmethod
    def _most(form: str) -> int:
        return 2 if len(form) >= LONG and form[0].isascii() else 1

    @staticmethod
    def _forms(word: str) -> set[str]:
        if not word.isascii():
            return {jamo(word)}
        return {word, _grouped(word)} if word else set()

    def __contains__(self, word: str) -> bool:
        return word in self.terms

    def correction(self, token: str) -> str | None:
        """The lexicon form that a token, outer punctuation aside, was misread from; None for right forms and others.

        Stray signs inside the word are dropped. Numbers, and whatever is no near neighbour of a form, have none.
        """
        if token not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[token] = self._correction(token)
        return self.known[token]

    def _correction(self, token: str) -> str | None:
        word = core(token)
        if not word or word in self.terms or word[:1].isupper() and word.casefold() in self.folded:
            return None
        bare = _INNER.sub("", word)
        if bare != word and bare in self.bare:
            return self.bare[bare]
        letters = sum(c.isalpha() for c in bare)
        if not letters or (letters < len(bare) and not bare.isascii()) or letters * 2 < len(bare):
            return None
        best: tuple[int, str] | None = None
        for variant in {bare, bare.translate(_AS_LETTERS)} if bare.isascii() else {bare}:
            if variant in self.bare:
                return self.bare[variant]
            for form in self._forms(variant):
                if len(form) > self.longest + 2:
                    continue
                for i in self._near(form):
                    other, term = self.forms[i]
                    for most in (0, 1, 2):
                        if most > min(self._most(other), self._most(form)) or best and most >= best[0] and term >= best[1]:
                            break
                        if within(form, other, most):
                            best = min(best, (most, term)) if best else (most, term)
                            break
        return best[1] if best else None

    def broken(self, end: str, start: str) -> str | None:
        """The form that the last token of a line and the first of the next make together, if the line ends inside it.

        With a mark at the line's end the halves may carry noise; without one they must make the form exactly.
        """
        if not end or not start:
            return None
        marked = end[-1] in MARKS
        left, right = end.rstrip(MARKS) if marked else end, core(start)
        left = re.sub(r"^[\W_]+", "", left)
        if not left or not right or not left[-1].isalnum() or not start[0].isalnum():
            return None
        for whole in (left + right, f"{left}-{right}") if marked else (left + right,):
            if whole in self.terms:
                return None if not marked and left in self.terms and right in self.terms else whole
        if marked and left not in self.terms:
            return self.correction(left + right)
        return None
