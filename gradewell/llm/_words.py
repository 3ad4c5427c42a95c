"""Vectorised word splitting and hashing over the UTF-8 buffers of Arrow columns.

Both word classes used here are unions of whole byte ranges, so splitting bytes
equals splitting code points: a byte of 0x80 or more always belongs to a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LONG = 512  # bytes of a span that is hashed eight bytes a round
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)], dtype=np.uint64)
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

#: Byte classes: anything but ASCII white space; ASCII digits and letters plus all non-ASCII.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes of text worked on at once; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            for key, base in (("up", _B), ("down", _B_INV)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number, zeros beyond the end."""
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def bytes_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes a round, each through mix(), so that no arithmetic of the bytes survives; long spans by BLAKE2."""
    size = end - start
    out = mix(size.astype(np.uint64) + _B)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    eights = _eights(raw)
    active = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, h = start[active], size[active], out[active]
    while len(active):
        x = eights[at]
        short = left < 8
        x[short] &= _MASKS[left[short]]
        h = mix(h ^ x)
        more = left > 8
        done = ~more
        out[active[done]] = h[done]
        active, at, left, h = active[more], at[more] + 8, left[more] - 8, h[more]
    return out


def equal_spans(raw: np.ndarray, start: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes from start are those from other, for each of many spans."""
    eights, out = _eights(raw), np.ones(len(start), dtype=bool)
    active = np.flatnonzero((size > 0) & (start != other))
    at, to, left = start[active], other[active], size[active]
    while len(active):
        x = eights[at] ^ eights[to]
        short = left < 8
        x[short] &= _MASKS[left[short]]
        out[active[x != 0]] = False
        more = (left > 8) & (x == 0)
        active, at, to, left = active[more], at[more] + 8, to[more] + 8, left[more] - 8
    return out


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of values (bytes or 64-bit hashes); span_hash() turns two of them into a span's hash.

    For hashed contexts and anchors only, where different spans may share a value: bytes_hash() is for identity.
    """
    up, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def spans_hash(prefix: np.ndarray, first: int, end: int, size: int) -> np.ndarray:
    """span_hash() of the spans of one size from each place of a range."""
    _, down = _powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[first + size : end + size] - prefix[first:end]) * down[first:end] + np.uint64(size))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; null is the empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of about limit bytes, whole texts only."""
    if not len(column):
        return
    raw, off = text_buffers(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


class Words:
    """The words of several texts: byte spans, offsets of each text's words, 64-bit hashes of the lower-cased words."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, member: np.ndarray = SPACED, lower: bool = True):
        inside = member[raw]
        n = len(raw)
        edge = np.zeros(n + 1, dtype=bool)
        edge[off] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.off = np.searchsorted(self.start, off)
        self.raw = LOWER[raw] if lower else raw
        self.hash = bytes_hash(self.raw, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The text's index of each word."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def shingles(self, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and their offsets by text; with short, the whole of a text of fewer words."""
        count = np.diff(self.off)
        runs = np.maximum(count - k + 1, 0)
        if short:
            runs = np.where((runs == 0) & (count > 0), 1, runs)
        offsets = np.concatenate([[0], np.cumsum(runs)])
        first = np.repeat(self.off[:-1] - offsets[:-1], runs) + np.arange(offsets[-1])
        size = np.minimum(k, np.repeat(count, runs))
        h = mix(size.astype(np.uint64) + _B)
        for j in range(k):
            word = self.hash[np.minimum(first + j, len(self.hash) - 1)] if len(self.hash) else h
            h = np.where(j < size, mix(h ^ word), h)
        return h, offsets
