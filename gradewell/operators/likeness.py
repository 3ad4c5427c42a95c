"""How like two texts are, for many pairs at once, and keys that like texts must share.

The ratio of two texts is the percentage of their characters in a longest common subsequence. Their distance, the characters outside of
it, is length + length - 2 * common; a ratio of r or more bounds it by (100 - r) % of both lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

WORD = 64  # places of a text in one number
LONG = 512  # texts beyond this are compared one by one, by numbers of any length
LANES = 1 << 14  # pairs compared at once


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def fuzzy_ratio(a: str | None, b: str | None) -> int:
    """Percentage of characters in the longest common subsequence, rounded half to even; 0 if either is missing."""
    if a is None or b is None:
        return 0
    return 100 if a == b else round(200 * common_subsequence(a, b) / (len(a) + len(b)))


class Texts:
    """Texts as numbered characters: where each character stands in each text, and how often."""

    def __init__(self, texts: Sequence[str]):
        self.texts = texts
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        kept = ["" if len(t) > LONG else t for t in texts]
        flat = np.frombuffer("".join(kept).encode("utf-32-le"), dtype=np.uint32)
        letters, codes = np.unique(flat, return_inverse=True)
        n, width = len(texts), max(1, max(map(len, kept), default=1))
        self.size = len(letters) + 1
        rows = np.repeat(np.arange(n), [len(t) for t in kept])
        places = np.concatenate([np.arange(len(t)) for t in kept]) if len(flat) else np.zeros(0, dtype=np.int64)
        self.codes = np.full((width, n), self.size - 1, dtype=np.int64)  # the last code stands for no character
        self.codes[places, rows] = codes
        self.counts = np.zeros((n, self.size), dtype=np.int32)
        np.add.at(self.counts, (rows, codes), 1)
        self.words = -(-width // WORD)
        self.masks = np.zeros((self.words, n * self.size), dtype=np.uint64)
        np.bitwise_or.at(self.masks, (places // WORD, rows * self.size + codes), np.uint64(1) << (places % WORD).astype(np.uint64))

    def at_most(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair a bound of the common subsequence: the characters that both have, whatever their order."""
        step = max(64, (1 << 21) // self.size)
        parts = [np.minimum(self.counts[i[at : at + step]], self.counts[j[at : at + step]]).sum(1) for at in range(0, len(i), step)]
        out = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
        long = (self.length[i] > LONG) | (self.length[j] > LONG)
        return np.where(long, np.minimum(self.length[i], self.length[j]), out)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common subsequences of pairs."""
        out = np.zeros(len(i), dtype=np.int64)
        long = (self.length[i] > LONG) | (self.length[j] > LONG)
        for k in np.flatnonzero(long).tolist():
            out[k] = common_subsequence(self.texts[i[k]], self.texts[j[k]])
        short = np.flatnonzero(~long)
        short = short[np.argsort(-self.length[j[short]], kind="stable")]
        for at in range(0, len(short), LANES):
            lanes = short[at : at + LANES]
            out[lanes] = self._common(i[lanes], j[lanes])
        return out

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Rows of bits of all pairs, one character of the second texts at a time; these come with falling lengths."""
        words = max(1, -(-int(self.length[i].max()) // WORD))
        rows = [np.full(len(i), ~np.uint64(0)) for _ in range(words)]
        base, lengths = i * self.size, self.length[j]
        for k in range(int(lengths[0])):
            n = int(np.searchsorted(-lengths, -k, side="left"))  # pairs whose second text has a character here
            spot = base[:n] + self.codes[k, j[:n]]
            carry = None
            for w in range(words):
                row = rows[w][:n]
                hit = row & self.masks[w][spot]
                total = row + hit
                rest = row - hit
                if words > 1:
                    over = total < row
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                np.bitwise_or(total, rest, out=row)
        return WORD * words - sum(np.bitwise_count(r).astype(np.int64) for r in rows)


def ratios(a: Sequence[Sequence[str | None]], b: Sequence[Sequence[str | None]], i: np.ndarray, j: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean ratio over columns of the pairs a[i], b[j], each a row of one text for each column, and the ratio of each column.

    A mean of -1 stands where a bound shows that it is less than low: by lengths, then by counts of characters, before any subsequence is sought.
    """
    width = len(a[0]) if len(a) else 1
    j = j + len(a)
    texts = [[x[c] or "" for x in a] + [y[c] or "" for y in b] for c in range(width)]
    there = [np.array([x[c] is not None for x in a] + [y[c] is not None for y in b], dtype=bool) for c in range(width)]
    lengths = [np.array([len(t) for t in own], dtype=np.int64) for own in texts]

    def shares(pairs: np.ndarray, of) -> np.ndarray:
        p, q = i[pairs], j[pairs]
        out = np.zeros((width, len(pairs)))
        for c in range(width):
            n = lengths[c][p] + lengths[c][q]
            share = np.where(n > 0, np.rint(200.0 * of(c, p, q) / np.maximum(n, 1)), 100.0)
            out[c] = np.where(there[c][p] & there[c][q], share, 0.0)
        return out

    mean, each = np.full(len(i), -1.0), np.zeros((width, len(i)))
    left = np.arange(len(i))
    left = left[shares(left, lambda c, p, q: np.minimum(lengths[c][p], lengths[c][q])).mean(0) >= low]
    if len(left):
        held = [Texts(own) for own in texts]
        parts = [left[at : at + LANES] for at in range(0, len(left), LANES)]
        left = np.concatenate([part[shares(part, lambda c, p, q: held[c].at_most(p, q)).mean(0) >= low] for part in parts])
    if len(left):
        each[:, left] = shares(left, lambda c, p, q: held[c].common(p, q))
        mean[left] = each[:, left].mean(0)
    return mean, each


# ---- keys that like texts share


def most_apart(n: int, m: int, low: float) -> int:
    """The largest distance of texts of n and m characters whose ratio rounds to low or more."""
    return math.floor((n + m) * (100.5 - low) / 100 + 1e-9)


def longest_partner(n: int, low: float) -> int:
    """The longest text that can have a ratio of low to one of n characters."""
    return math.floor(n * (200.5 - low) / (low - 0.5) + 1e-9)


def segments(m: int, low: float) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text of m characters of which one at least differs by one character or none from what a shorter like text has for it.

    Of D edits at most, two or more for each of D // 2 + 1 pieces would be too many.
    """
    k = most_apart(m, m, low) // 2 + 1
    return [(m * p // k, m * (p + 1) // k) for p in range(k)]


PLACE = 32  # characters that share a place


def piece_keys(text: str, low: float) -> Iterator[tuple[str, int]]:
    """Keys (letters, place) of a text as the longer one: each piece whole and without one of its characters, at all places that edits can move it to."""
    m = len(text)
    far = most_apart(m, m, low)
    for start, end in segments(m, low):
        piece = text[start:end]
        for letters in {piece, *(piece[:k] + piece[k + 1 :] for k in range(len(piece)))}:
            for place in range(max(0, start - far) // PLACE, (start + far) // PLACE + 1):
                yield letters, place


def window_keys(text: str, low: float) -> Iterator[tuple[str, int]]:
    """Keys (letters, place) of a text as the shorter one: windows of the sizes that pieces of its partners have, those one longer without one character, those one shorter as they are."""
    n = len(text)
    sizes = {e - s for m in range(n, longest_partner(n, low) + 1) for s, e in segments(m, low)}
    wanted = {s + d for s in sizes for d in (-1, 0)}
    for start in range(n + 1):
        found = {text[start : start + s] for s in wanted if 0 <= s <= n - start}
        for s in sizes:
            if s + 1 <= n - start:
                window = text[start : start + s + 1]
                found.update(window[:k] + window[k + 1 :] for k in range(s + 1))
        for letters in found:
            yield letters, start // PLACE
