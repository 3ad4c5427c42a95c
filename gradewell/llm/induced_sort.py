"""Suffix and common-prefix arrays by external induced sorting.

Suffixes that begin a fall after a rise (left-most S) are named by their
substrings; the string of names is sorted by recursion, and its order seeds two
sweeps that induce the order of all other suffixes. A sweep takes suffix tuples
(symbol, position, common prefix with the neighbour) from a priority queue and pushes
each one's predecessor back. Among equal symbols tuples come out as they came in, so the queue is
a set of runs sorted by symbol, merged by sizes; runs beyond the memory limit live in scratch files. A pushed
tuple's common prefix is one more than the least value swept since the last push
to the same symbol, and the recursion's common prefixes tell where those of its seeds begin to be compared.

Tuples are moved in blocks by numpy: as many symbols at once as do not push into each other. So strings of
few symbols and of very many take the same way, at every depth. The recursion ends at a string of names that fits into the memory limit:
it is sorted there by doubling prefixes. Texts, names and finished tuples beyond the limit are files mapped into memory.

Scratch files are a task's own, like Spark's spill files, and go when it ends;
a repeated task makes its own again.
"""

from __future__ import annotations

import itertools
import os
import tempfile
from collections.abc import Callable

import numpy as np

BLOCK = 1 << 17  # tuples swept at once
FAN = 8  # runs of one size that become one
FAR = np.int32(1 << 30)
WORK = 48  # bytes of memory for each name of a string that is sorted in memory


class Scratch:
    """A task's folder: arrays of more than limit bytes are files mapped into memory."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.names = folder, limit, itertools.count()

    def space(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.limit or not n:
            return np.empty(n, dtype=dtype)
        return np.memmap(os.path.join(self.folder, str(next(self.names))), dtype=dtype, mode="w+", shape=(n,))

    def keep(self, x: np.ndarray, small: bool = False) -> np.ndarray:
        """x, moved to a file if it is large, or if small is set."""
        if not len(x) or not small and x.nbytes <= self.limit:
            return x
        out = np.memmap(os.path.join(self.folder, str(next(self.names))), dtype=x.dtype, mode="w+", shape=x.shape)
        out[:] = x
        return out


class Queue:
    """Tuples by symbol, first in first out among equal ones; of the runs, the largest go to disk beyond limit bytes."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.runs, self.held = scratch, [], 0  # a run: level, symbols, positions, common prefixes, how many were taken, bytes in memory

    def push(self, symbol: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Tuples sorted by symbol."""
        self._add(0, symbol, pos, lcp)
        while len(self.runs) >= FAN and self.runs[-FAN][0] == self.runs[-1][0]:
            last = self.runs[-FAN:]
            if sum(len(r[1]) - r[4] for r in last) * 20 > max(self.scratch.limit, 1 << 12):
                last[-1][0] = -1  # too much to merge in memory: these stay runs
                break
            symbol, pos, lcp = (np.concatenate([r[i][r[4] :] for r in last]) for i in (1, 2, 3))
            order = np.argsort(symbol, kind="stable")
            del self.runs[-FAN:]
            self.held -= sum(r[5] for r in last)
            self._add(last[0][0] + 1, symbol[order], pos[order], lcp[order])

    def _add(self, level: int, *columns: np.ndarray) -> None:
        if not len(columns[0]):
            return
        size = sum(c.nbytes for c in columns)
        self.runs.append([level, *columns, 0, size])
        self.held += size
        while self.held > self.scratch.limit:
            r = max(self.runs, key=lambda r: r[5])
            r[1:4] = [self.scratch.keep(c, small=True) for c in r[1:4]]
            self.held -= r[5]
            r[5] = 0

    def least(self) -> int | None:
        """The smallest symbol held."""
        self.held -= sum(r[5] for r in self.runs if r[4] == len(r[1]))
        self.runs = [r for r in self.runs if r[4] < len(r[1])]
        return min((int(r[1][r[4]]) for r in self.runs), default=None)

    def peek(self, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tuples of symbols under a bound, in order."""
        parts = [(r, r[4] + int(np.searchsorted(r[1][r[4] :], below))) for r in self.runs]
        parts = [(r, e) for r, e in parts if e > r[4]]
        if not parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        symbol, pos, lcp = (np.concatenate([r[i][r[4] : e] for r, e in parts]) for i in (1, 2, 3))
        order = np.argsort(symbol, kind="stable")
        return symbol[order], pos[order], lcp[order]

    def drop(self, below: int) -> None:
        for r in self.runs:
            r[4] += int(np.searchsorted(r[1][r[4] :], below))

    def size(self, below: int) -> int:
        return sum(int(np.searchsorted(r[1][r[4] :], below)) for r in self.runs)

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next block of tuples of the smallest symbol."""
        parts, n = [], 0
        for r in self.runs:
            e = min(r[4] + int(np.searchsorted(r[1][r[4] :], symbol, "right")), r[4] + BLOCK - n)
            if e > r[4]:
                parts.append((r[2][r[4] : e], r[3][r[4] : e]))
                n += e - r[4]
                r[4] = e
            if n >= BLOCK:
                break
        if not parts:
            return None
        return np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])


class _Least:
    """Least values of ranges of one block."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of values[a..b], b included, a <= b."""
        k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int32)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            v = self.levels[level]
            out[at] = np.minimum(v[a[at]], v[b[at] - (1 << int(level)) + 1])
        return out


def _kinds(text: np.ndarray) -> np.ndarray:
    """True for S: the suffix is smaller than the next one. The last symbol is the smallest and alone."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = text[change] < text[change + 1]
    out = np.repeat(np.append(rises, True), np.diff(np.concatenate([[-1], change, [n - 1]])))
    return out


def _run_ends(text: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, len(text))


def _seed_names(text: np.ndarray, kinds: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each seed to the next, by (symbol, kind); equal substrings have one rank."""
    length = np.append(np.diff(seeds) + 1, 1)
    group = np.zeros(len(seeds), dtype=np.int64)
    active, depth = np.arange(len(seeds)), 0
    while len(active):
        # four symbols with their kinds at a time; beyond the end nothing, which is below all
        key = np.zeros(len(active), dtype=np.uint64)
        for j in range(2):
            inside = depth + j < length[active]
            at = np.where(inside, seeds[active] + depth + j, 0)
            value = np.where(inside, text[at].astype(np.uint64) * np.uint64(2) + kinds[at] + np.uint64(1), np.uint64(0))
            key = (key << np.uint64(32)) | value
        order = np.lexsort((key, group[active]))
        a, k = active[order], key[order]
        g = group[a]
        new = np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]))
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        # a member's rank is the old one plus the members that come before its new group
        base = np.repeat(first, np.diff(np.append(first, len(g))))
        starts = np.flatnonzero(new)
        group[a] = g + (starts[np.cumsum(new) - 1] - base)
        size = np.diff(np.append(starts, len(g)))[np.cumsum(new) - 1]
        depth += 2
        active = np.sort(a[(size > 1) & (length[a] > depth)])
    return np.unique(group, return_inverse=True)[1]


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names in memory, by doubling prefixes."""
    rank, step = names.astype(np.int64), 1
    while True:
        nxt = np.full(len(rank), -1, dtype=np.int64)
        nxt[:-step] = rank[step:] if step < len(rank) else nxt[:-step]
        key = rank * (len(rank) + 2) + nxt + 1
        order = np.argsort(key)  # equal keys get one rank, so their order does not matter
        k = key[order]
        rank[order] = np.cumsum(np.append(0, k[1:] != k[:-1]))
        if rank[order[-1]] == len(rank) - 1:
            return order
        step *= 2


class _Swept:
    """Least common prefix swept since the last push to each symbol; a push costs what it pushes, however many symbols there are."""

    def __init__(self, symbols: int):
        self.block = np.full(symbols, -1, dtype=np.int64)  # of the last push
        self.rest = np.full(symbols, -1, dtype=np.int32)  # least after it in its block; nothing pushed yet: the first has nothing in common
        self.at, self.low, self.top, self.now = np.zeros(64, dtype=np.int64), np.zeros(64, dtype=np.int32), 0, 0  # blocks that are least of all from them on

    def since(self, symbol: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.at[: self.top], self.block[symbol] + 1)
        later = np.append(self.low[: self.top], FAR)[i]
        return np.minimum(self.rest[symbol], later)

    def end(self, least: int, symbol: np.ndarray, rest: np.ndarray) -> None:
        """A block is done: its least, the symbols that it pushed to, and the least after each one's last push."""
        top = int(np.searchsorted(self.low[: self.top], least))
        if top == len(self.at):
            self.at, self.low = np.append(self.at, self.at), np.append(self.low, self.low)
        self.at[top], self.low[top], self.top = self.now, least, top + 1
        self.block[symbol], self.rest[symbol] = self.now, rest
        self.now += 1


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, known: np.ndarray) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to most; known is what they have in common at least."""
    out, n, wide = np.minimum(known, most).astype(np.int32), len(text), 8 // text.itemsize
    if 1 < wide <= n:
        # eight bytes of symbols at once, while they are equal
        eights = np.ndarray((n - wide + 1,), dtype=np.uint64, buffer=text, strides=(text.itemsize,))
        active = np.flatnonzero(out < most)
        while len(active):
            x, y = a[active] + out[active], b[active] + out[active]
            ok = (x < len(eights)) & (y < len(eights))
            active, x, y = active[ok], x[ok], y[ok]
            active = active[eights[x] == eights[y]]
            out[active] += wide
            active = active[out[active] < most]
        np.minimum(out, most, out=out)
    active = np.flatnonzero(out < most)
    while len(active):
        x, y = a[active] + out[active], b[active] + out[active]
        ok = (x < n) & (y < n)
        active, x, y = active[ok], x[ok], y[ok]
        active = active[text[x] == text[y]]
        out[active] += 1
        active = active[out[active] < most]
    return out


def sort(text: np.ndarray, sink: Callable[[np.ndarray, np.ndarray], None], most: int, memory: int = 64 << 20, symbols: int | None = None) -> None:
    """Suffixes of text from the largest to the smallest, to sink(positions, common prefixes with the suffix given before).

    text: integers whose last is 0 and the only 0. Common prefixes are exact up to most. memory: bytes that a queue, or an array, holds; more go to disk.
    """
    with tempfile.TemporaryDirectory(prefix="induced-") as folder:
        scratch = Scratch(folder, memory)
        _sort(scratch.keep(text), sink, most, symbols or int(text.max()) + 1, scratch)


def _order(names: np.ndarray, most: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a string of names in order, and the names that each has in common with the one before."""
    m, distinct = len(names), int(names.max()) + 1
    order, common = scratch.space(m, np.int64), scratch.space(m, np.int32)
    common[0] = 0
    if distinct == m:
        order[names] = np.arange(m)
        common[:] = 0
        return order, common
    if m * WORK <= scratch.limit:
        common[:] = 0
        order[:] = _doubled(names)
        return order, common
    at = m

    def sink(pos: np.ndarray, lcp: np.ndarray) -> None:
        # from the largest: what a suffix has in common with the one given before belongs to that one
        nonlocal at
        order[at - len(pos) : at] = pos[::-1]
        own = lcp[::-1]
        common[at - len(pos) + 1 : min(at + 1, m)] = own[: min(at + 1, m) - (at - len(pos) + 1)]
        at -= len(pos)

    _sort(scratch.keep(names), sink, most, distinct, scratch)
    return order, common


def _sort(text: np.ndarray, sink, most: int, symbols: int, scratch: Scratch) -> None:
    n = len(text)
    if n == 1:
        sink(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int32))
        return
    kinds, ends = scratch.keep(_kinds(text)), scratch.keep(_run_ends(text))
    places = np.flatnonzero(kinds[1:] & ~kinds[:-1]) + 1
    # the end symbol is a seed, so there is one at least; its name is the smallest
    order, common = _order(_seed_names(text, kinds, places), most, scratch)
    seeds = places[order]
    known = places[np.minimum(order[:-1] + common[1:], len(places) - 1)] - seeds[:-1]
    seed_lcp = np.append(np.int32(0), _common(text, seeds[:-1], seeds[1:], most, known))
    seed_symbol = text[seeds].astype(np.int64)
    del order, common, known, places
    fall_at = np.concatenate([[0], np.cumsum(np.bincount(text[~kinds], minlength=symbols))])
    fall_pos, fall_lcp = scratch.space(int(fall_at[-1]), np.int64), scratch.space(int(fall_at[-1]), np.int32)
    last_fall = np.full(symbols, -1, dtype=np.int64)
    swept = _Swept(symbols)

    def run(pos: np.ndarray) -> np.ndarray:
        return ends[np.searchsorted(ends, pos, "right")] - pos

    def induce(queue: Queue, pos: np.ndarray, lcp: np.ndarray, wanted: np.ndarray, down: bool) -> None:
        """Push the predecessors of the wanted tuples of a block, with their common prefixes."""
        m = len(pos)
        at = np.flatnonzero(wanted)
        if not len(at):
            swept.end(int(lcp.min()), at, at)
            return
        ranges = _Least(np.ascontiguousarray(lcp))
        target = text[pos[at] - 1].astype(np.int64)
        if down:
            target = symbols - 1 - target
        by = np.argsort(target.astype(np.uint16) if symbols <= 1 << 16 else target, kind="stable")
        at, target = at[by], target[by]
        first = np.append(True, target[1:] != target[:-1])
        value = ranges.of(np.where(first, 0, np.append(0, at[:-1] + 1)), at)
        opening = np.flatnonzero(first)
        value[opening] = np.minimum(value[opening], swept.since(target[opening]))
        queue.push(target, pos[at] - 1, np.minimum(value + 1, most).astype(np.int32))
        pushed, last = target[opening], at[np.append(opening[1:], len(at)) - 1]
        kept, open_ = np.full(len(pushed), FAR), last < m - 1
        kept[open_] = ranges.of(last[open_] + 1, np.full(int(open_.sum()), m - 1))
        swept.end(int(lcp.min()), pushed, kept)

    def before(pos: np.ndarray) -> np.ndarray:
        return text[np.maximum(pos - 1, 0)].astype(np.int64)

    def shut(target: np.ndarray, c0: int, c1: int) -> int:
        """Up to where symbols from c0 on, under c1, push nothing into each other."""
        inside = target[target < c1]
        return c1 if not len(inside) else max(c0, int(inside.min()))

    # rising: falls in their order from the seeds
    queue, at, width = Queue(scratch), 0, 1
    while True:
        c0 = min((c for c in (queue.least(), int(seed_symbol[at]) if at < len(seeds) else None) if c is not None), default=None)
        if c0 is None:
            break
        c1 = min(c0 + width, symbols)
        to = at + int(np.searchsorted(seed_symbol[at:], c1))
        if width > 1 and queue.size(c1) + to - at <= BLOCK:
            symbol, pos, lcp = queue.peek(c1)
            own = before(pos)
            wanted = (pos > 0) & (own >= symbol)
            s_before = before(seeds[at:to])
            end = shut(np.concatenate([own[wanted], s_before[seeds[at:to] > 0]]), c0, c1)
            if end > c0:
                width = width * 2 if end == c1 else max(1, end - c0)
                c1, n_here = end, int(np.searchsorted(symbol, end))
                symbol, pos, lcp, wanted = symbol[:n_here], pos[:n_here], lcp[:n_here], wanted[:n_here]
                to = at + int(np.searchsorted(seed_symbol[at:to], end))
                queue.drop(end)
                # falls of one symbol stand together already: the places of a whole symbol are known
                if n_here:
                    here = int(fall_at[symbol[0]])
                    fall_pos[here : here + n_here], fall_lcp[here : here + n_here] = pos, lcp
                    last_fall[symbol] = pos
                s_symbol, s_pos, s_lcp = seed_symbol[at:to], seeds[at:to], seed_lcp[at:to].copy()
                if to > at:
                    first = np.flatnonzero(np.append(True, s_symbol[1:] != s_symbol[:-1]))
                    f = last_fall[s_symbol[first]]
                    both = np.minimum(np.minimum(run(np.maximum(f, 0)), run(s_pos[first])), most)
                    s_lcp[first] = np.where(f >= 0, both, 0)
                by = np.argsort(np.concatenate([2 * symbol, 2 * s_symbol + 1]), kind="stable")
                pos, lcp, wanted = np.concatenate([pos, s_pos])[by], np.concatenate([lcp, s_lcp])[by], np.concatenate([wanted, s_pos > 0])[by]
                induce(queue, pos, lcp, wanted, False)
                at = to
                continue
        width, here = 2, int(fall_at[c0])
        while (block := queue.pop(c0)) is not None:
            pos, lcp = block
            fall_pos[here : here + len(pos)], fall_lcp[here : here + len(pos)] = pos, lcp
            here += len(pos)
            last_fall[c0] = pos[-1]
            induce(queue, pos, lcp, (pos > 0) & (before(pos) >= c0), False)
        to = at + int(np.searchsorted(seed_symbol[at:], c0, "right"))
        if to > at:
            lcp = seed_lcp[at:to].copy()
            lcp[0] = min(int(run(last_fall[c0 : c0 + 1])[0]), int(run(seeds[at : at + 1])[0]), most) if last_fall[c0] >= 0 else 0
            for i in range(at, to, BLOCK):
                j = min(i + BLOCK, to)
                induce(queue, seeds[i:j], lcp[i - at : j - at], seeds[i:j] > 0, False)
            at = to

    # falling: rises from the falls, all from the largest; a key is a symbol counted from the end
    swept = _Swept(symbols)
    queue, width, last_rise = Queue(scratch), 1, np.full(symbols, -1, dtype=np.int64)
    queue.push(np.array([symbols - 1]), np.array([n - 1]), np.zeros(1, dtype=np.int32))
    left = np.flatnonzero(np.diff(fall_at))[::-1]  # symbols with falls, the largest first
    at = 0
    while True:
        c0 = min((k for k in (queue.least(), symbols - 1 - int(left[at]) if at < len(left) else None) if k is not None), default=None)
        if c0 is None:
            break
        c1 = min(c0 + width, symbols)
        low, high = int(fall_at[symbols - c1]), int(fall_at[symbols - c0])
        if width > 1 and queue.size(c1) + high - low <= BLOCK:
            key, pos, lcp = queue.peek(c1)
            f_pos, f_next = fall_pos[low:high][::-1], fall_lcp[low:high][::-1]
            f_key = symbols - 1 - text[f_pos].astype(np.int64)
            own, f_own = symbols - 1 - before(pos), symbols - 1 - before(f_pos)
            wanted, f_wanted = (pos > 0) & (own >= key), (f_pos > 0) & (f_own > f_key)
            end = shut(np.concatenate([own[wanted], f_own[f_wanted]]), c0, c1)
            if end > c0:
                width = width * 2 if end == c1 else max(1, end - c0)
                n_here, f_here = int(np.searchsorted(key, end)), int(np.searchsorted(f_key, end))
                key, pos, lcp, wanted = key[:n_here], pos[:n_here], lcp[:n_here], wanted[:n_here]
                f_key, f_pos, f_wanted = f_key[:f_here], f_pos[:f_here], f_wanted[:f_here]
                queue.drop(end)
                last_rise[key] = pos
                if f_here:
                    # a fall holds what it has in common with the one before it, which here comes after
                    f_lcp = np.append(np.int32(0), f_next[: f_here - 1]).astype(np.int32)
                    first = np.flatnonzero(np.append(True, f_key[1:] != f_key[:-1]))
                    r = last_rise[f_key[first]]
                    both = np.minimum(np.minimum(run(np.maximum(r, 0)), run(f_pos[first])), most)
                    f_lcp[first] = np.where(r >= 0, both, 0)
                    by = np.argsort(np.concatenate([2 * key, 2 * f_key + 1]), kind="stable")
                    pos, lcp, wanted = np.concatenate([pos, f_pos])[by], np.concatenate([lcp, f_lcp])[by], np.concatenate([wanted, f_wanted])[by]
                sink(pos, lcp)
                induce(queue, pos, lcp, wanted, True)
                while at < len(left) and symbols - 1 - left[at] < end:
                    at += 1
                continue
        width, c = 2, symbols - 1 - c0
        while (block := queue.pop(c0)) is not None:
            pos, lcp = block
            last_rise[c0] = pos[-1]
            sink(pos, lcp)
            induce(queue, pos, lcp, (pos > 0) & (before(pos) <= c), True)
        low, high = int(fall_at[c]), int(fall_at[c + 1])
        carry = 0
        if high > low and last_rise[c0] >= 0:
            carry = min(int(run(last_rise[c0 : c0 + 1])[0]), int(run(last_fall[c : c + 1])[0]), most)
        for j in range(high, low, -BLOCK):
            i = max(low, j - BLOCK)
            pos, held = np.array(fall_pos[i:j][::-1]), np.array(fall_lcp[i:j][::-1])
            lcp = np.append(np.int32(carry), held[:-1]).astype(np.int32)
            carry = int(held[-1])
            sink(pos, lcp)
            induce(queue, pos, lcp, (pos > 0) & (before(pos) < c), True)
        while at < len(left) and left[at] >= c:
            at += 1
