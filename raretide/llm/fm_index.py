"""FM-index of a delimited vocabulary, searched for words that differ by one edit. NumPy only, many queries at a time."""

from __future__ import annotations

import numpy as np

# Intervals of more rows are extended letter by letter, smaller ones row by row.
FEW_ROWS = 48
# Queries searched together.
TOGETHER = 4096


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words one after the other, and the length of each word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.array([len(w) for w in words], np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Rows of a text whose symbols at ends of words are unique, by prefix doubling up to the longest word."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        behind = np.full(n, -1, np.int64)
        behind[: max(0, n - step)] = rank[step:]
        key = rank * (n + 1) + behind + 1
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Suffix-rank intervals over words with a delimiter before, between and behind them.

    ``words`` are distinct and in code-point order, so that the delimiter can be searched like a letter and its rows
    number the words. Row k of the delimiters precedes word k.
    """

    def __init__(self, words: list[str]):
        letters, lengths = code_points(words)
        self.words, self.alphabet = len(words), np.unique(letters)
        self.letters = len(self.alphabet)
        ends = np.concatenate([[0], np.cumsum(lengths + 1)])
        text = np.zeros(ends[-1] + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        codes = np.searchsorted(self.alphabet, letters) + 1
        text[inside] = codes + len(ends)  # above all delimiters, which are unique here
        text[ends] = np.arange(len(ends))
        rows = suffix_array(text)
        text[inside], text[ends] = codes, 0
        self.rows = len(text)
        self.before = text[rows - 1]  # the letter in front of each suffix
        self.before[rows == 0] = -1
        self.occurrences = np.sort((self.before * (self.rows + 1) + np.arange(self.rows))[self.before >= 0])

    def codes(self, letters: np.ndarray) -> np.ndarray:
        """Symbols of code points; -1 for those that no word has."""
        if not self.letters:
            return np.full(len(letters), -1, np.int64)
        place = np.searchsorted(self.alphabet, letters)
        place[place == self.letters] = 0
        return np.where(self.alphabet[place] == letters, place + 1, -1)

    def extend(self, symbol: np.ndarray | int, row: np.ndarray) -> np.ndarray:
        """End of the interval ``row`` after one more symbol to the left: rows that start with less, and those in front of ``row``."""
        # The wrapped-round delimiter is no occurrence, but letters stand behind it.
        return np.searchsorted(self.occurrences, symbol * (self.rows + 1) + row) + (symbol > 0)

    def _any_letter(self, lo: np.ndarray, hi: np.ndarray):
        """(origin, symbol, lo, hi) of all extensions of the intervals by one letter."""
        few = hi - lo <= FEW_ROWS
        some = np.flatnonzero(few)
        size = (hi - lo)[some]
        origin = np.repeat(some, size)
        row = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(some) else lo[some], size) + np.arange(size.sum())
        symbol = self.before[row]
        real = symbol > 0
        origin, row, symbol = origin[real], row[real], symbol[real]
        first = self.extend(symbol, row)
        out = [(origin, symbol, first, first + 1)]
        many = np.flatnonzero(~few)
        if len(many):
            origin, symbol = np.repeat(many, self.letters), np.tile(np.arange(1, self.letters + 1), len(many))
            a, b = self.extend(symbol, lo[origin]), self.extend(symbol, hi[origin])
            real = b > a
            out.append((origin[real], symbol[real], a[real], b[real]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def one_edit(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, word number) of words one inserted, deleted or replaced code point away from a query, the
        edit being in front of the last ``exact`` code points. Pairs may repeat."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for first in range(0, len(queries), TOGETHER):
            q, w = self._search(queries[first: first + TOGETHER], exact[first: first + TOGETHER])
            found.append((q + first, w))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _search(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letters, lengths = code_points(queries)
        symbols = self.codes(letters)
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        # The exact half, from the delimiter behind a word leftwards.
        q = np.arange(len(queries))
        lo, hi = np.ones(len(q), np.int64), np.full(len(q), self.words + 1, np.int64)
        left = lengths.copy()
        for step in range(int(exact.max(initial=0))):
            going = exact[q] > step
            c = symbols[start[q] + np.maximum(left - 1, 0)]
            lo, hi = np.where(going, self.extend(c, lo), lo), np.where(going, self.extend(c, hi), hi)
            left = np.where(going, left - 1, left)
            open_ = (hi > lo) & (~going | (c > 0))
            q, lo, hi, left = q[open_], lo[open_], hi[open_], left[open_]
        # The other half: at each place one edit, or the next letter as it is.
        once: list[tuple[np.ndarray, ...]] = []
        while len(q):
            origin, symbol, a, b = self._any_letter(lo, hi)
            once.append((q[origin], a, b, left[origin]))  # a letter more
            other = left > 0
            c = np.where(other, symbols[start[q] + np.maximum(left - 1, 0)], -1)
            changed = other[origin] & (symbol != c[origin])
            once.append((q[origin][changed], a[changed], b[changed], left[origin][changed] - 1))
            once.append((q[other], lo[other], hi[other], left[other] - 1))  # a letter less
            q, lo, hi, left, c = q[other], lo[other], hi[other], left[other] - 1, c[other]
            lo, hi = self.extend(c, lo), self.extend(c, hi)
            open_ = (hi > lo) & (c > 0)
            q, lo, hi, left = q[open_], lo[open_], hi[open_], left[open_]
        # After the edit the rest is exact, up to the delimiter in front of the word.
        out_q, out_w = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if once:
            q, lo, hi, left = (np.concatenate(x) for x in zip(*once, strict=True))
            while len(q):
                c = np.where(left > 0, symbols[start[q] + np.maximum(left - 1, 0)], 0)
                lo, hi = self.extend(c, lo), self.extend(c, hi)
                open_ = (hi > lo) & (c >= 0)
                done = open_ & (left == 0)
                out_q.append(q[done])
                out_w.append(lo[done])
                open_ &= left > 0
                q, lo, hi, left = q[open_], lo[open_], hi[open_], left[open_] - 1
        return np.concatenate(out_q), np.concatenate(out_w)
