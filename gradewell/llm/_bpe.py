"""Byte-level BPE over whole Arrow columns: vectorised pre-tokens, and one encoding for each distinct pre-token.

A vocabulary file of the library `tokenizers` is read; results are those of the
library without added tokens. Texts that hold a special token's string, or a
code point whose class may differ between Unicode versions, are given to the library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache, cached_property

import ahocorasick
import numpy as np

from gradewell.llm._words import bytes_hash, equal_spans

JOINED = 1 << 18  # bytes of pre-tokens that one pass counts, unless one alone has more
PARTING = "\u0100"  # stands for no byte
LETTER, NUMBER, SPACE, OTHER = range(4)
#: Unicode White_Space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all code points the class and whether it is the same in every Unicode version, and which blocks of 256 have been looked up."""
    return np.full(0x110000, OTHER, dtype=np.uint8), np.zeros(0x110000, dtype=bool), np.zeros(0x1100, dtype=bool)


def _classes(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point, and whether it is the same in every Unicode version; looked up for the blocks that cp has."""
    kind, sure, ready = _tables()
    met = np.flatnonzero(np.bincount(cp >> 8, minlength=1))
    old = unicodedata.ucd_3_2_0.category
    for block in met[~ready[met]].tolist():
        for i in range(block << 8, (block + 1) << 8):
            c = chr(i)
            now = unicodedata.category(c)
            if now[0] in "LN":
                kind[i] = LETTER if now[0] == "L" else NUMBER
            sure[i] = now != "Cn" and old(c)[0] == now[0]
        spaces = [i for i in SPACES if i >> 8 == block]
        kind[spaces], sure[spaces] = SPACE, True
        ready[block] = True
    return kind[cp], sure[cp]


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pretokens(cp: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of pre-tokens among code points; edges: the first code point of each text, and the end.

    A run of white space keeps all but its last character when something follows;
    a last space joins what follows. An apostrophe that opens a run takes s, t, m, d, re, ve or ll with it.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _classes(cp)[0]
    start = np.empty(n, dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    first = np.zeros(n + 1, dtype=bool)
    first[edges] = True
    start |= first[:n]
    runs = np.flatnonzero(start)
    run_kind = kind[runs]
    followed = np.append(~first[runs[1:]], False)  # by another run of the same text
    spaced = np.flatnonzero((run_kind == SPACE) & followed)
    after = runs[spaced + 1]
    start[after - 1] = True
    start[after[cp[after - 1] == 0x20]] = False
    # contractions
    quote = np.flatnonzero((run_kind == OTHER) & followed & (cp[runs] == 0x27))
    if len(quote):
        at = runs[quote]
        ok = start[at] & (runs[quote + 1] == at + 1) & (run_kind[quote + 1] == LETTER)
        at, nxt = at[ok], quote[ok] + 1
        ends = np.append(runs, n)[nxt + 1]
        x = cp[at + 1]
        y = np.where(ends - at > 2, cp[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(x, [0x73, 0x74, 0x6D, 0x64])
        two = ((x == 0x72) | (x == 0x76)) & (y == 0x65) | (x == 0x6C) & (y == 0x6C)
        take = np.where(one, 1, np.where(two, 2, 0))
        hit = take > 0
        start[at[hit] + 1] = False
        more = hit & (at + 1 + take < ends)
        start[at[more] + 1 + take[more]] = True
    return np.flatnonzero(start)


OVERHEAD = 200  # bytes of two byte strings and their place in a dictionary


class Bpe:
    """A vocabulary, its pair tests and a bounded memo of distinct pre-tokens."""

    MEMO = 400_000  # pairs that are remembered
    BYTES, KEPT = 64 << 20, 256  # of remembered words and values; a longer word is worked out each time it comes

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["normalizer"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        to_byte = _byte_chars()
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(a != b and a in b for a in self.special for b in self.special) or any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} has special tokens that hold each other or take what stands around them")
        self.special_pattern = re.compile(b"|".join(re.escape(t.encode()) for t in self.special)) if self.special else None
        self.ids = {bytes(to_byte[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in self.special}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {tuple(bytes(to_byte[c] for c in part) for part in m): r for r, m in enumerate(merges)}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.memo: dict[bytes, bytes] = {}
        self.held = 0
        self._fast = self._ranked()

    @cached_property
    def endings(self) -> ahocorasick.Automaton:
        """Finds all tokens that end at a place in one pass, for counts; bytes stand as characters of the same number."""
        out = ahocorasick.Automaton()
        for b, t in self.ids.items():
            out.add_word(b.decode("latin-1"), (t, len(b)))
        out.make_automaton()
        return out

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token by applying merges in the order of their rank."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ids[p] for p in parts]

    def _ranked(self):
        """An encoder by ids as ranks, if ids and merges have one order; else None, and merge() is used."""
        import tiktoken

        order = [self.ids[a + b] for a, b in sorted(self.rank, key=self.rank.get)]
        if any(x >= y for x, y in zip(order, order[1:], strict=False)) or (order and max(self.ids[bytes([b])] for b in range(256)) >= order[0]):
            return None
        return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=self.ids, special_tokens={})

    def _joins(self, a: int, b: int) -> bool:
        """Whether b may follow a: encoding their bytes together gives these two tokens."""
        both = self.bytes_of[a] + self.bytes_of[b]
        # the encoder gives a token of the vocabulary whole, without its merges
        return (self._fast._encode_single_piece(both) if self._fast and both not in self.ids else self.merge(both)) == [a, b]

    def count_words(self, words: list[bytes]) -> list[bytes]:
        """Dynamic programme over pre-tokens: the counts of tokens of all byte prefixes of each, as 32-bit numbers.

        A prefix ends in that one token which is compatible with the last token of the prefix before it.
        """
        out, a = [], 0
        while a < len(words):
            b, size = a + 1, len(words[a])
            while b < len(words) and size < JOINED:
                size += len(words[b])
                b += 1
            out += self._count_joined(words[a:b])
            a = b
        return out

    def _count_joined(self, words: list[bytes]) -> list[bytes]:
        # no token holds the separator, whose place begins the next word: no token before it, none counted
        text = PARTING.join([w.decode("latin-1") for w in words])
        last, count, done = [-1] * (len(text) + 1), [0] * (len(text) + 1), -1
        pairs, whole, joins = self.pairs, self.whole, self._joins
        if len(pairs) > self.MEMO:
            pairs.clear()
        for end, (t, k) in self.endings.iter(text):
            if end == done:
                continue
            before = end + 1 - k
            if (u := last[before]) < 0:
                if (ok := whole.get(t)) is None:
                    ok = whole[t] = self.merge(self.bytes_of[t]) == [t]
            elif (ok := pairs.get(u << 32 | t)) is None:
                ok = pairs[u << 32 | t] = joins(u, t)
            if ok:
                last[end + 1] = t
                count[end + 1] = count[before] + 1
                done = end
        counts = np.array(count, dtype="<u4")
        if len(counts) - np.count_nonzero(counts) != len(words):
            raise ValueError("a byte is missing from the vocabulary")
        data, out, at = counts.tobytes(), [], 4
        for w in words:
            out.append(data[at : at + 4 * len(w)])
            at += 4 * len(w) + 4
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit numbers."""
        encode = self._fast._encode_single_piece if self._fast else self.merge
        return [np.array(encode(w), dtype="<u4").tobytes() for w in words]

    def forget(self) -> None:
        """Let go of remembered words: a worker that waits for other work holds none."""
        self.memo.clear()
        self.held = 0

    def per_word(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For byte spans: what make gives for a list of words, as (flat values, values of each distinct word as offsets, the distinct word of each span)."""
        _, at, which = np.unique(bytes_hash(raw, start, end), return_index=True, return_inverse=True)
        # spans of one hash are compared: one that differs from the first of its hash is a word of its own
        size = end - start
        other = np.flatnonzero((size != size[at[which]]) | ~equal_spans(raw, start, start[at[which]], size))
        which[other] = len(at) + np.arange(len(other))
        at = np.concatenate([at, other])
        memo = self.memo
        if self.held > self.BYTES:
            self.forget()
        data = raw.tobytes()
        words = [data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        new = list(dict.fromkeys(w for w in words if w not in memo))
        once = {}
        for w, value in zip(new, make(new), strict=True):
            if len(w) <= self.KEPT:
                memo[w] = value
                self.held += len(w) + len(value) + OVERHEAD
            else:
                once[w] = value
        parts = [memo[w] if w in memo else once[w] for w in words]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        return np.frombuffer(b"".join(parts), dtype="<u4"), np.concatenate([[0], np.cumsum(sizes)]), which


def expand(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each occurrence in turn, and the offsets of the occurrences."""
    sizes = np.diff(offsets)[which]
    out = np.concatenate([[0], np.cumsum(sizes)])
    index = np.repeat(offsets[:-1][which] - out[:-1], sizes) + np.arange(out[-1])
    return flat[index], out


@cache
def load(path: str, purpose: str) -> Bpe:
    """One vocabulary for each worker and purpose; the memo of a purpose holds one kind of value."""
    return Bpe(path)


class Encoded:
    """Spans of pre-tokens of one slice of texts; odd: texts that hold a special token's string, for the library."""

    def __init__(self, bpe: Bpe, raw: np.ndarray, off: np.ndarray):
        text = raw.tobytes()
        self.cp = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        width = 1 + (self.cp >= 0x80).astype(np.int64) + (self.cp >= 0x800) + (self.cp >= 0x10000)
        self.byte_at = np.concatenate([[0], np.cumsum(width)])
        if self.byte_at[-1] != len(raw):
            raise ValueError("text is not valid UTF-8")
        self.edges = np.searchsorted(self.byte_at, off)
        at = pretokens(self.cp, self.edges[:-1][np.diff(self.edges) > 0])
        unsure = np.unique(np.searchsorted(self.edges, np.flatnonzero(~_classes(self.cp)[1]), "right") - 1)
        if len(unsure):
            # the library's own pre-tokens, of which each character stands for a byte
            parts, done = [], 0
            for t in unsure.tolist():
                parts.append(at[(at >= done) & (at < self.edges[t])])
                sizes = [len(w) for w, _ in bpe.library.pre_tokenizer.pre_tokenize_str(text[off[t] : off[t + 1]].decode())]
                parts.append(np.searchsorted(self.byte_at, off[t] + np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)))
                done = self.edges[t + 1]
            at = np.concatenate([*parts, at[at >= done]])
        self.first_cp = at
        self.start = self.byte_at[at]
        self.end = np.append(self.start[1:], len(raw)) if len(at) else self.start
        self.words_at = np.searchsorted(self.start, off)  # the first pre-token of each text, and the end
        self.odd = np.zeros(len(off) - 1, dtype=bool)
        for s in bpe.special:
            mark, i = s.encode(), 0
            while mark and (i := text.find(mark, i)) >= 0:
                self.odd[np.searchsorted(off, i, "right") - 1] = True
                i += 1
