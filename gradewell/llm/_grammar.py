"""Cheapest repairs of role sequences: min-plus matrices for symbols, and for the rules of a Re-Pair grammar over them.

A symbol is a row: its role's initial (s, u, a, or o for any other), as a capital if its text is truncated, or b and d for a blank and a
repeated row, which must go. A matrix has for each two states of the grammar (s?(ua)+)? the cheapest edits that lead from one to the other
over the symbols, as cost and audit; of equally cheap ones the ASCII-least. At equal cost no audit begins another, since further letters would be
inserts and cost more: so the least of a product is made of least parts.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

ALPHABET = "suaoSUAObd"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
EMITS = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {AFTER_U: "user", AFTER_A: "assistant"}
#: From the best state the rest of any other state's path can be had for so much more: a state beyond that is on no cheapest path.
DETOUR = DELETE + INSERT

Rope = str | tuple  # a text, or two ropes
Matrix = tuple  # of four rows of four cells: None or (cost, rope)
SHORT = 128  # letters that are copied rather than linked


def join(a: Rope, b: Rope) -> Rope:
    if not a or not b:
        return a or b
    return a + b if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= SHORT else (a, b)


def letters(rope: Rope):
    """The pieces of a rope, from the left."""
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += (top[1], top[0])


def text_of(rope: Rope) -> str:
    return "".join(letters(rope))


def before(a: Rope, b: Rope) -> bool:
    """Whether a comes before b; reads no further than their first difference."""
    if a is b:
        return False
    x, y, s, t = letters(a), letters(b), "", ""
    while True:
        s, t = s or next(x, ""), t or next(y, "")
        if not s or not t:
            return not s and bool(t)
        n = min(len(s), len(t))
        if s[:n] != t[:n]:
            return s[:n] < t[:n]
        s, t = s[n:], t[n:]


def better(new, old) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and before(new[1], old[1]))


def times(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for row in a:
        best = [None] * 4
        for k, left in enumerate(row):
            if left is None:
                continue
            for j, right in enumerate(b[k]):
                if right is None or (best[j] is not None and left[0] + right[0] > best[j][0]):
                    continue
                cell = (left[0] + right[0], join(left[1], right[1]))
                if better(cell, best[j]):
                    best[j] = cell
        out.append(tuple(best))
    return tuple(out)


def _closed_inserts() -> Matrix:
    """Any number of inserts; more than two lead nowhere new."""
    one = [[None] * 4 for _ in range(4)]
    for c in "ua":
        for i, j in EMITS[c].items():
            one[i][j] = (INSERT, "I")
    none = tuple(tuple((0, "") if i == j else None for j in range(4)) for i in range(4))
    some = tuple(tuple(none[i][j] or one[i][j] for j in range(4)) for i in range(4))
    return times(some, some)


INSERTS = _closed_inserts()


@lru_cache(None)
def of_symbol(symbol: str) -> Matrix:
    """Inserts, then one edit of the row."""
    edit = [[None] * 4 for _ in range(4)]

    def offer(i, j, cost, letter):
        if better((cost, letter), edit[i][j]):
            edit[i][j] = (cost, letter)

    for i in range(4):
        offer(i, i, DELETE, "D")
    if symbol not in "bd":
        more = TRUNCATED if symbol.isupper() else 0
        for i, j in EMITS.get(symbol.lower(), {}).items():
            offer(i, j, more, "K")
        for c in "ua":
            for i, j in EMITS[c].items():
                offer(i, j, REROLE + more, "R")
    return times(INSERTS, tuple(map(tuple, edit)))


class Grammar:
    """Rules of two symbols each, in rounds; the symbols of a string are replaced round by round."""

    def __init__(self, rounds: list[dict[tuple[int, int], int]] | None = None):
        self.rounds = rounds or []
        self._matrices = dict(enumerate(map(of_symbol, ALPHABET)))
        self._of_text = lru_cache(4096)(self._product)

    def __reduce__(self):
        return Grammar, (self.rounds,)

    @property
    def size(self) -> int:
        return len(ALPHABET) + sum(map(len, self.rounds))

    def with_round(self, pairs: list[tuple[int, int]]) -> Grammar:
        return Grammar([*self.rounds, {p: self.size + i for i, p in enumerate(pairs)}])

    def parse(self, text: str) -> list[int]:
        seq = [ALPHABET.index(c) for c in text]
        for rules in self.rounds:
            out, i = [], 0
            while i < len(seq):
                new = rules.get((seq[i], seq[i + 1])) if i + 1 < len(seq) else None
                out.append(seq[i] if new is None else new)
                i += 1 if new is None else 2
            seq = out
        return seq

    def pairs(self, text: str) -> Counter:
        """Adjacent pairs of the parsed text; of a run of one symbol, those that do not overlap."""
        seq, found, i = self.parse(text), Counter(), 0
        while i + 1 < len(seq):
            found[seq[i], seq[i + 1]] += 1
            i += 2 if i + 2 < len(seq) and seq[i] == seq[i + 1] == seq[i + 2] else 1
        return found

    def matrix(self, symbol: int) -> Matrix:
        """One matrix for each rule, made of those of its two symbols; rules only name earlier ones."""
        if not self._matrices.get(symbol):
            for rules in self.rounds:
                for (a, b), made in rules.items():
                    self._matrices[made] = times(self._matrices[a], self._matrices[b])
        return self._matrices[symbol]

    def _product(self, text: str) -> Matrix:
        seq = self.parse(text)
        out = self.matrix(seq[0])
        for symbol in seq[1:]:
            out = times(out, self.matrix(symbol))
        return out

    def of_text(self, text: str) -> Matrix:
        """The matrix of a string of symbols, shared by all that have it."""
        return self._of_text(text)


def apart(pairs: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Of pairs in order of worth those that can be replaced in one round: no symbol ends one and begins another."""
    firsts, lasts, out = set(), set(), []
    for a, b in pairs:
        if len(out) < most and a not in lasts and b not in firsts and (a != b or (a not in firsts and b not in lasts)):
            firsts.add(a)
            lasts.add(b)
            out.append((a, b))
    return out


class Path:
    """The cheapest way through the strings of one conversation, string by string.

    Kept for each string are four pointers back. Where all ways in use come from one state, what lies before is settled and no longer compared.
    """

    def __init__(self):
        self.cells, self.back, self.cost = {START: (0, "")}, [], 0

    def add(self, matrix: Matrix) -> None:
        best, back = {}, [None] * 4
        for i, left in self.cells.items():
            for j, right in enumerate(matrix[i]):
                if right is not None and (j not in best or left[0] + right[0] <= best[j][0]):
                    cell = (left[0] + right[0], join(left[1], right[1]))
                    if better(cell, best.get(j)):
                        best[j], back[j] = cell, i
        least = min(c for c, _ in best.values())
        best = {j: cell for j, cell in best.items() if cell[0] <= least + DETOUR}
        came = {back[j] for j in best}
        if len(came) == 1:
            (i,) = came
            self.cost += self.cells[i][0]
            best = {j: matrix[i][j] for j in best}
        self.cells = best
        self.back.append(bytes(4 if b is None else b for b in back))

    def ways(self) -> tuple[list[tuple[int, int]], int, str]:
        """(state before, state after) of each string, the state at the end, and the inserts that close the sequence."""
        best = None
        for i, cell in self.cells.items():
            for j in (START, AFTER_A):
                last = INSERTS[i][j]
                if last is not None:
                    cell_ = (cell[0] + last[0], join(cell[1], last[1]))
                    if better(cell_, best and best[0]):
                        best = (cell_, i, last[1])
        state, ways = best[1], []
        for back in reversed(self.back):
            ways.append((back[state], state))
            state = back[state]
        return ways[::-1], best[1], best[2]


def edited(symbols: str, audit: str, state: int):
    """The edits of an audit: (letter, index of the row or None, role or None if kept, state after)."""
    row = 0
    for letter in audit:
        role, at = None, None
        if letter in "RI":
            state = EMITS["u"].get(state, AFTER_A)
            role = ROLES[state]
        elif letter == "K":
            state = EMITS[symbols[row].lower()][state]
        if letter != "I":
            at, row = row, row + 1
        yield letter, at, role, state
