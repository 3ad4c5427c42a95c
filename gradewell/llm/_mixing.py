"""Logistic mixing of hashed-context bit predictors over coded texts, all places of a block abreast.

A text is a row of symbols: its words and one end, each under a prefix code; a word without a code of its own is
an escape, followed by its bytes and a stop under a second code. So a text is bits, and every bit is predicted: by
counts of zeros and ones under N contexts hashed with the code's bits so far, and by the symbol that followed the same
words, or the same letters, earlier in the text. A gate (place in the code, which contexts were met, how the guesses of this text went)
selects weights that mix these logits; a table refines the mixed logit. Contexts are known before a block is read, so places
of a block are worked on at once, one bit of all codes after the other.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np

from gradewell.llm._words import Words, mix, prefix_hash, span_hash

N = 5  # words: none, the last one, two, three, the last but one; bytes of a word: the last one to four, all so far
K = N + 2  # with the guess and a constant
BITS = 20  # of a table's slots: the model has one size however large the corpus is
STATES = 5  # no guess, one that failed in this code, or how many in a row were right before: none, some, three or more
PLACES = 16  # of a bit in its code that gates tell apart
GATES = 2 * PLACES * 4 * STATES
CELLS, SPREAD = 33, 12.0
CONSTANT = np.float32(0.1)
STOP = 0x20  # ends a word that is spelled: no word holds it
END_HASH, START_HASH = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
BLOCK = 1 << 17  # symbols worked on at once
PIECE = 1 << 15  # bits or slots worked on at once, so that what is made on the way stays near
SPARSE = 4  # slots a bit: with more of them a block's logits are made for its bits, else once a slot
ONE, TWO = np.uint32(0x27D4EB2F), np.uint32(0xC2B2AE35)


def prefix_code(weights: list[float], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a Huffman code; small weights are raised so that no code is much longer than longest bits."""
    least = max(sum(weights), 1) / (1 << longest)
    heap = [(max(w, least), i, [i]) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    lengths = np.zeros(len(weights), dtype=np.int64)
    while len(heap) > 1:
        (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
        lengths[x + y] += 1
        heapq.heappush(heap, (a + b, min(i, j), x + y))
    values, now, last = np.zeros(len(weights), dtype=np.int64), 0, 0
    for i in np.lexsort((np.arange(len(weights)), lengths)).tolist():
        now <<= int(lengths[i]) - last
        values[i], last = now, int(lengths[i])
        now += 1
    return values.astype(np.uint32), lengths.astype(np.uint8)


class Codes:
    """Codes of words, of the end and the escape, and of bytes.

    Frequent words are ranked; ranks in [2^k - 1, 2^(k+1) - 1) are one class with k further bits, classes, end and escape have a Huffman code.
    """

    def __init__(self, hashes: np.ndarray, times: np.ndarray, others: int, ends: int, bytes_seen: np.ndarray):
        order = np.lexsort((hashes, -times))
        hashes, times = hashes[order], times[order]
        rank = np.arange(1, len(hashes) + 1, dtype=np.int64)
        kind = np.frexp(rank.astype(np.float64))[1] - 1
        weights = np.bincount(kind, times, minlength=0).tolist() if len(rank) else []
        value, length = prefix_code([*weights, max(others, 1), max(ends, 1)], 12)
        self.escape, self.end = (int(value[-2]), int(length[-2])), (int(value[-1]), int(length[-1]))
        own = (value[kind].astype(np.int64) << kind | (rank - (1 << kind))).astype(np.uint32)
        size = (length[kind] + kind).astype(np.uint8)
        by = np.argsort(hashes)
        self.hashes, self.times, self.value, self.length = hashes[by], times[by], own[by], size[by]
        # where hashes of the same upper bits begin: about one hash each
        self.upper = max(len(hashes).bit_length(), 1)
        self.first = np.searchsorted(self.hashes, np.arange(1 << self.upper, dtype=np.uint64) << np.uint64(64 - self.upper)).astype(np.int32)
        self.byte_value, self.byte_length = prefix_code((bytes_seen + 1).tolist(), 16)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words among the coded ones, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = self.first.take((hashes >> np.uint64(64 - self.upper)).astype(np.intp), mode="clip").astype(np.intp)
        met = self.hashes.take(at, mode="clip")
        left = np.flatnonzero(met < hashes)
        while len(left):
            at[left] += 1
            left = left[at[left] < len(self.hashes)]
            met[left] = self.hashes[at[left]]
            left = left[met[left] < hashes[left]]
        return np.where(met == hashes, at, -1)


@dataclass
class Symbols:
    """Symbols of one kind, in the order of their texts: code, contexts, the guess and its state, and the text of each."""

    kind: int
    value: np.ndarray
    length: np.ndarray
    context: np.ndarray
    guess: np.ndarray
    guess_length: np.ndarray
    state: np.ndarray
    text: np.ndarray

    def block(self, a: int, b: int) -> Symbols:
        """A part, longest codes first: at each bit those that go on are a prefix."""
        by = np.argsort(-self.length[a:b].astype(np.int16), kind="stable")
        return Symbols(self.kind, *(x[..., a:b].take(by, axis=-1, mode="clip") for x in (self.value, self.length, self.context, self.guess, self.guess_length, self.state, self.text)))


@dataclass
class Coded:
    """Texts of one slice: words as spans and hashes, their places among the coded words, symbols of words and of spelled bytes."""

    words: Words
    found: np.ndarray
    parts: tuple[Symbols, Symbols] = field(repr=False)


def _upper(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32)


def _guesses(ids: np.ndarray, keys: list[np.ndarray], start: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The latest earlier place of the text under the last key that has one (-1: none), and how the guesses from start on went."""
    same, at = np.full(len(ids), -1, dtype=np.int64), np.arange(len(ids))
    salt = mix(np.arange(int(text[-1]) + 1, dtype=np.uint64)).take(text) if len(text) else np.zeros(0, dtype=np.uint64)
    low = np.uint64((1 << len(ids).bit_length()) - 1)
    for key in keys:
        key = key ^ salt
        # sorting the keys' upper bits together with the places costs less than sorting places by keys
        both = np.sort(key & ~low | at.astype(np.uint64))
        again = np.flatnonzero((both[1:] ^ both[:-1]) <= low)
        here, there = (both[again + 1] & low).astype(np.int64), (both[again] & low).astype(np.int64)
        own = (key[here] == key[there]) & (text[here] == text[there])
        same[here[own]] = there[own]
    some = same >= 0
    right = some & (ids[same] == ids)
    wrong = np.where(right, -1, at)
    np.maximum.accumulate(wrong, out=wrong)
    run = np.zeros(len(ids), dtype=np.int64)
    run[1:] = at[:-1] - wrong[:-1]
    run = np.minimum(run, at - start)
    return same, (np.uint8(2) + (run > 0) + (run > 2)) * some


def encode(codes: Codes, raw: np.ndarray, off: np.ndarray) -> Coded:
    w = Words(raw, off)
    found = codes.find(w.hash)
    texts = len(off) - 1
    count = np.diff(w.off) + 1
    text = np.repeat(np.arange(texts), count)
    first = w.off[:-1] + np.arange(texts)
    start = first[text]
    of_word = np.arange(len(w)) + w.text_of()
    ends = first + count - 1
    ids = np.empty(len(text), dtype=np.uint64)
    value, length = np.full(len(text), codes.end[0], dtype=np.uint32), np.full(len(text), codes.end[1], dtype=np.uint8)
    ids[ends], ids[of_word] = END_HASH, w.hash
    if len(codes.hashes):
        # -1 is behind the last code
        value[of_word] = np.append(codes.value, np.uint32(codes.escape[0])).take(found, mode="wrap")
        length[of_word] = np.append(codes.length, np.uint8(codes.escape[1])).take(found, mode="wrap")
    else:
        value[of_word], length[of_word] = codes.escape
    one, last, before = (np.empty_like(ids) for _ in range(3))
    for own, nearer in ((one, ids), (last, one), (before, last)):
        own[1:] = nearer[:-1]
        own[first] = START_HASH
    with np.errstate(over="ignore"):
        w1 = mix(one + np.uint64(1))
        w2 = mix(w1 ^ last)
        w3 = mix(w2 ^ before)
        skip = mix(last + np.uint64(5))
    context = np.stack([np.zeros(len(text), dtype=np.uint32), _upper(w1), _upper(w2), _upper(w3), _upper(skip)])
    same, state = _guesses(ids, [w1, w2], start, text)
    some = same >= 0
    words = Symbols(0, value, length, context, value.take(same, mode="wrap") * some, length.take(same, mode="wrap") * some, state, text)
    return Coded(w, found, (words, _spelled(codes, w, np.flatnonzero(found < 0))))


def _spelled(codes: Codes, w: Words, rare: np.ndarray) -> Symbols:
    """Bytes and stops of the words that have no code."""
    size = w.end[rare] - w.start[rare] + 1
    at = np.concatenate([[0], np.cumsum(size)])
    total = int(at[-1])
    s = np.full(total, STOP, dtype=np.uint8)
    inner = np.ones(total, dtype=bool)
    inner[at[1:] - 1] = False
    index = np.repeat(w.start[rare] - at[:-1], size) + np.arange(total)
    s[inner] = w.raw[index[inner]]
    start, place = np.repeat(at[:-1], size), np.arange(total)
    context = np.empty((N, total), dtype=np.uint32)
    near = np.zeros(total, dtype=np.uint64)
    for k in range(1, 5):
        byte = np.where(place - k >= start, s[np.maximum(place - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        near |= byte << np.uint64(9 * (k - 1))
        context[k - 1] = _upper(mix(near + np.uint64(k << 40)))
    so_far = span_hash(prefix_hash(s), start, place)
    context[4] = _upper(so_far)
    text = np.repeat(w.text_of()[rare], size)
    same, state = _guesses(s, [so_far], start, text)
    value, length = codes.byte_value[s], codes.byte_length[s]
    some = same >= 0
    return Symbols(1, value, length, context, value.take(same, mode="wrap") * some, length.take(same, mode="wrap") * some, state, text)


@dataclass
class Model:
    """Logits by context, mixing weights by gate, and the refinement of the mixed logit by kind and place."""

    logits: np.ndarray = field(default_factory=lambda: np.zeros((N, 1 << BITS), dtype=np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.tile(np.array([0.3] * N + [2.0, 0.3], dtype=np.float32), (GATES, 1)))  # a guess is right more often than not
    cells: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, PLACES, CELLS)))  # bit, kind, place, logit


def no_counts() -> np.ndarray:
    """By context, zeros of all slots and ones of all slots: each of these tables is half as large as one of pairs, and stays nearer."""
    return np.zeros((N, 2, 1 << BITS), dtype=np.float32)


def logits_of(counts: np.ndarray) -> np.ndarray:
    return np.log((counts[..., 1, :] + np.float32(0.4)) / (counts[..., 0, :] + np.float32(0.4)))


def _logits(counts: np.ndarray, out: np.ndarray) -> None:
    """logits_of() one context's counts, in place and piece by piece."""
    for a, e in _pieces(counts.shape[-1]):
        own, zeros = out[a:e], counts[0, a:e] + np.float32(0.4)
        np.add(counts[1, a:e], np.float32(0.4), out=own)
        own /= zeros
        np.log(own, out=own)


def _pieces(n: int):
    return ((a, min(a + PIECE, n)) for a in range(0, n, PIECE))


def _tops(x: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and guesses from the highest bit on, how many bits the guess holds for (the first wrong one included), and whether there is one."""
    top = x.value << (np.uint8(32) - x.length)
    some = x.guess_length > 0
    guess = x.guess << (np.uint8(32) - x.guess_length)  # all bits are shifted out where there is none
    apart = np.frexp((top ^ guess).astype(np.float64))[1]
    return top, guess, np.minimum(33 - apart, x.guess_length).astype(np.uint8), some.view(np.uint8)


def _level(x: Symbols, tops: tuple, b: int, a: int, e: int, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of codes a to e, which have more than b bits: bit b, the sign of the guess (0: none) and the state; their slots go to slot."""
    top, guess, until, some = (y[a:e] for y in tops)
    node = (top >> np.uint32(32 - b)) | np.uint32(1 << b) if b else np.ones(e - a, dtype=np.uint32)
    exact = not x.kind and b < BITS  # without context the table is exact
    if exact:
        slot[0] = node
    node = node * ONE
    node += np.uint32(x.kind)
    for k in range(exact, N):
        own = slot[k]
        np.bitwise_xor(x.context[k, a:e], node, out=own)
        own *= TWO
        own >>= np.uint32(32 - BITS)
    holds = until > b
    sign = (((guess >> np.uint32(31 - b)) & np.uint32(1)).astype(np.int8) * np.int8(2) - np.int8(1)) * holds
    return (top >> np.uint32(31 - b)) & np.uint32(1), sign, np.maximum(x.state[a:e] * holds, some)


@dataclass
class Levels:
    """Bits of codes, one level after the other (where each ends): values, signs of guesses, states, and by context slots and then logits."""

    ends: list[int]
    bit: np.ndarray
    sign: np.ndarray
    state: np.ndarray
    slots: np.ndarray

    @property
    def known(self) -> np.ndarray:
        """Logits come where slots were."""
        return self.slots.view(np.float32)


def _levels(x: Symbols, sizes: list[int]) -> Levels:
    ends, tops = [0, *np.cumsum(sizes).tolist()], _tops(x)
    n = ends[-1]
    y = Levels(ends, np.empty(n, dtype=np.uint8), np.empty(n, dtype=np.float32), np.empty(n, dtype=np.uint8), np.empty((N, n), dtype=np.uint32))
    for b, m in enumerate(sizes):
        for a, e in _pieces(m):
            i, j = ends[b] + a, ends[b] + e
            y.bit[i:j], y.sign[i:j], y.state[i:j] = _level(x, tops, b, a, e, y.slots[:, i:j])
    return y


def _gates(known: np.ndarray, state: np.ndarray, kind: int, b: int) -> tuple[np.ndarray, int]:
    """Gates, counted from the first of the kind and place, and that one."""
    met = (known[2] != 0) * np.uint8(2) + (known[1] != 0)
    return met * np.uint8(STATES) + state, (kind * PLACES + min(b, PLACES - 1)) * 4 * STATES


def _mixed(known: np.ndarray, sign: np.ndarray, state: np.ndarray, kind: int, b: int, weights: np.ndarray) -> np.ndarray:
    """The mixed logit of the contexts' logits, the guess and a constant."""
    gate, first = _gates(known, state, kind, b)
    gate = gate.astype(np.intp)
    own = np.ascontiguousarray(weights[first : first + 4 * STATES].T)
    t = (own[N + 1] * CONSTANT).take(gate, mode="clip")
    t += sign * own[N].take(gate, mode="clip")
    for k in range(N):
        t += known[k] * own[k].take(gate, mode="clip")
    return np.clip(t, -SPREAD, SPREAD, out=t)


def _blocks(coded: Coded):
    for part in coded.parts:
        for a in range(0, len(part.value), BLOCK):
            x = part.block(a, min(a + BLOCK, len(part.value)))
            # how many codes have more than 0, 1, 2, ... bits
            yield x, (len(x.length) - np.searchsorted(x.length[::-1], np.arange(int(x.length[0])), "right")).tolist()


def _move(known: np.ndarray, sign: np.ndarray, state: np.ndarray, bit: np.ndarray, kind: int, b: int, weights: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Mixes as _mixed() and moves the weights. Places of one gate are brought together first, so that its weights meet them at once; mixed logits and bits are given in that order."""
    gate, first = _gates(known, state, kind, b)
    order = np.argsort(gate, kind="stable")
    ends = np.searchsorted(gate.take(order, mode="clip"), np.arange(4 * STATES + 1, dtype=np.uint8)).tolist()
    spans = [(first + g, ends[g], ends[g + 1]) for g in range(4 * STATES) if ends[g] < ends[g + 1]]
    x = np.empty((K, len(order)), dtype=np.float32)
    for k in range(N):
        known[k].take(order, out=x[k], mode="clip")
    sign.take(order, out=x[N], mode="clip")
    x[N + 1] = CONSTANT
    bit, t = bit.take(order, mode="clip"), np.empty(len(order), dtype=np.float32)
    for g, i, j in spans:
        np.matmul(weights[g], x[:, i:j], out=t[i:j])
    np.clip(t, -SPREAD, SPREAD, out=t)
    p = np.negative(t)
    np.exp(p, out=p)
    p += 1
    np.reciprocal(p, out=p)
    error, slope = bit - p, p * (1 - p)
    pulls = [x[:, i:j] @ error[i:j] for _, i, j in spans]
    x *= x
    for (g, i, j), pull in zip(spans, pulls, strict=True):
        weights[g] += rate * pull.astype(np.float64) / (x[:, i:j] @ slope[i:j] + 8)
    return t, bit


def learn(coded: Coded, counts: np.ndarray, weights: np.ndarray, cells: np.ndarray, rate: float = 0.3) -> None:
    """One online pass: every block is predicted from what was counted before it, then weights, refinement and counts take it in."""
    table = np.empty(1 << BITS, dtype=np.float32)
    for x, sizes in _blocks(coded):
        y = _levels(x, sizes)
        _count(y, counts, table)
        for b, (i, j) in enumerate(pairwise(y.ends)):
            t, bit = _move(y.known[:, i:j], y.sign[i:j], y.state[i:j], y.bit[i:j], x.kind, b, weights, rate)
            cell = ((t + np.float32(SPREAD)) * np.float32((CELLS - 1) / (2 * SPREAD)) + np.float32(0.5)).astype(np.int64)
            cell += np.uint8(CELLS) * bit
            cells[:, x.kind, min(b, PLACES - 1)] += np.bincount(cell, minlength=2 * CELLS).reshape(2, CELLS)
        del y  # before the next block's take room


def _count(y: Levels, counts: np.ndarray, table: np.ndarray) -> None:
    """Logits of what was counted before take the slots' place, then the bits are counted: of one context after the other, zeros before ones, so that one table is near at a time."""
    n = y.ends[-1]
    one = y.bit.view(bool)
    pieces = [(a, e, np.flatnonzero(~one[a:e]), np.flatnonzero(one[a:e])) for a, e in _pieces(n)]
    zeros = n - int(np.count_nonzero(one))
    moved, few = np.empty(n, dtype=np.uint32), SPARSE * n < table.size
    for k in range(N):
        if not few:
            _logits(counts[k], table)
        to = [0, zeros]
        for a, e, *sides in pieces:
            slot, at = y.slots[k, a:e], y.slots[k, a:e].astype(np.intp)
            for side, places in enumerate(sides):
                slot.take(places, out=moved[to[side] : to[side] + len(places)], mode="clip")
                to[side] += len(places)
            if few:
                _logits(counts[k].take(at, axis=1, mode="clip"), y.known[k, a:e])
            else:
                table.take(at, out=y.known[k, a:e], mode="clip")
        for side, own in enumerate((moved[:zeros], moved[zeros:])):
            for a, e in _pieces(len(own)):
                np.add.at(counts[k, side], own[a:e].astype(np.intp), np.float32(1))


FINE = 1 << 15  # steps of a mixed logit, 0.0007 apart, whose final logarithms are tabled


def final_logs(model: Model) -> np.ndarray:
    """Natural logs of the final probability of a zero and of a one, by kind, place and step of the mixed logit: half the mixed one, half the refined.

    Both come from one probability, so at every step they are those of a distribution.
    """
    near = np.arange(CELLS) * (2 * SPREAD / (CELLS - 1)) - SPREAD
    prior = 1 / (1 + np.exp(-near))
    refined = (model.cells[1] + 20 * prior) / (model.cells.sum(axis=0) + 20)
    t = np.arange(FINE + 1) * (2 * SPREAD / FINE) - SPREAD
    out = np.empty((2, PLACES, 2, FINE + 1), dtype=np.float32)
    for kind in range(2):
        for place in range(PLACES):
            p = 0.5 * (1 / (1 + np.exp(-t)) + np.interp(t, near, refined[kind, place]))
            out[kind, place] = np.log([1 - p, p])
    return out.reshape(2, PLACES, -1)


def score(model: Model, coded: Coded, texts: int, final: np.ndarray | None = None) -> np.ndarray:
    """Natural log of the probability of each text: of all its bits. final: final_logs() of the model, for who asks many times."""
    final, out = final_logs(model) if final is None else final, np.zeros(texts)
    for x, sizes in _blocks(coded):
        value, y = np.zeros(len(x.length)), _levels(x, sizes)
        for k in range(N):
            for i, j in _pieces(y.ends[-1]):
                model.logits[k].take(y.slots[k, i:j].astype(np.intp), out=y.known[k, i:j], mode="clip")
        for b, m in enumerate(sizes):
            for a, e in _pieces(m):
                i, j = y.ends[b] + a, y.ends[b] + e
                t = _mixed(y.known[:, i:j], y.sign[i:j], y.state[i:j], x.kind, b, model.weights)
                t += np.float32(SPREAD)
                t *= np.float32(FINE / (2 * SPREAD))
                t += np.float32(0.5)
                step = t.astype(np.intp)
                step += y.bit[i:j] * np.uint32(FINE + 1)
                value[a:e] += final[x.kind, min(b, PLACES - 1)].take(step, mode="clip")
        out += np.bincount(x.text, value, minlength=texts)
        del y
    return out
