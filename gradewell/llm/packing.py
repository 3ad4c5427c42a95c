"""Bounded-space online packing of token pieces into windows.

A text's ids are cut into whole windows and a rest. Each partition keeps a
fixed number of open windows: a rest goes to the fullest window that it fits;
when none fits, the fullest window is emitted, after its gap, if it is not
tiny, was filled by a cut from the rest. What is still open at a partition's
end is merged with that of up to MERGED other partitions and cut to fill windows.

Edge cases: a null text is empty and gives its closing id alone; repeated rows
are packed each for itself; an empty table gives no rows; columns other than the two
named are dropped. A partition holds at most OPEN windows, and a merge at most
MERGED * OPEN of them, however large the input is. A lost executor repeats
its tasks with the same result: sequence ids come from the partition's number.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import _bpe
from gradewell.llm._store import store, table
from gradewell.llm._words import slices
from gradewell.llm.token_counts import default_vocabulary

WINDOW, OPEN, MERGED, LEAST_CUT = 1024, 64, 32, 16
CLOSING_ID = 0
PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Open windows of one partition, sorted by their free room."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN, least_cut: int = LEAST_CUT):
        self.window, self.limit, self.least_cut = window, open_windows, least_cut
        self.rooms: list[tuple[int, int]] = []  # (free, number), ascending
        self.held: dict[int, list] = {}
        self.next = 0

    def add(self, piece: tuple) -> Iterator[tuple[int, list]]:
        """piece: (doc, start, length, doc_tokens, ids); yields windows that close, as (number, [(offset, piece)])."""
        while True:
            size = piece[2]
            i = bisect.bisect_left(self.rooms, (size, -1))
            if i < len(self.rooms):
                free, number = self.rooms.pop(i)
                yield from self._put(number, free, piece)
                return
            if size == self.window or len(self.rooms) < self.limit:
                number, self.next = self.next, self.next + 1
                self.held[number] = []
                yield from self._put(number, self.window, piece)
                return
            free, number = self.rooms.pop(0)
            rest = piece
            if free >= self.least_cut:
                head, rest = cut(piece, free)
                self.held[number].append((self.window - free, head))
            yield number, self.held.pop(number)
            piece = rest

    def _put(self, number: int, free: int, piece: tuple) -> Iterator[tuple[int, list]]:
        self.held[number].append((self.window - free, piece))
        if free == piece[2]:
            yield number, self.held.pop(number)
        else:
            bisect.insort(self.rooms, (free - piece[2], number))

    def rest(self) -> Iterator[tuple[int, list]]:
        yield from self.held.items()


def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    doc, start, length, total, ids = piece
    return (doc, start, n, total, ids[: 4 * n]), (doc, start + n, length - n, total, ids[4 * n :])


def token_ids(bpe: _bpe.Bpe, raw: np.ndarray, off: np.ndarray, closing: int = CLOSING_ID) -> Iterator[bytes]:
    """Each text's ids and the closing id, as little-endian unsigned 32-bit numbers."""
    x = _bpe.Encoded(bpe, raw, off)
    flat, offsets, which = bpe.per_word(raw, x.start, x.end, bpe.encode_words)
    ids, at = _bpe.expand(flat, offsets, which)
    data, ends = ids.astype("<u4").tobytes(), (4 * at[x.words_at]).tolist()
    tail = int(closing).to_bytes(4, "little")
    for t in range(len(off) - 1):
        if x.odd[t]:
            text = raw[off[t] : off[t + 1]].tobytes().decode()
            yield np.array(bpe.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() + tail
        else:
            yield data[ends[t] : ends[t + 1]] + tail


def pack(df: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str | None = None, window: int = WINDOW, open_windows: int = OPEN, least_cut: int = LEAST_CUT) -> DataFrame:
    """One row a piece: id, start, length, doc_tokens, sequence_id, offset and ids (binary, unsigned 32-bit)."""
    path = vocabulary or default_vocabulary()
    kind = dict(df.dtypes)[id_column]
    id_type = df.select(id_column).limit(0).toArrow().schema.field(0).type
    names = [id_column, "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "batch"]
    types = [id_type, *[pa.int64()] * 5, pa.binary(), pa.int64()]

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = _bpe.load(path, "ids"), Packer(window, open_windows, least_cut)
        partition = TaskContext.get().partitionId()
        rows: list[tuple] = []
        base = partition << 36

        def emit(done: Iterator[tuple[int, list]], group: int | None) -> None:
            for number, pieces in done:
                rows.extend((p[0], p[1], p[2], p[3], base + number, o, p[4], group) for o, p in pieces)

        for batch in batches:
            for a, b, raw, off in slices(batch.column(1)):
                for doc, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), token_ids(bpe, raw, off), strict=True):
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        size = min(window, n - start)
                        emit(packer.add((doc, start, size, n, ids[4 * start : 4 * (start + size)])), None)
                yield frame(rows)
                rows.clear()
        bpe.forget()
        emit(packer.rest(), partition // MERGED)
        yield frame(rows)

    first = store(df.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, {PIECES}, batch long"), "packed")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sequence_id", "offset"])
        out, number, free = [], int(rows["sequence_id"].iloc[0]) + (1 << 35), window
        for piece in zip(rows[id_column], rows["start"], rows["length"], rows["doc_tokens"], rows["ids"], strict=True):
            while piece[2] > free:
                head, piece = cut(piece, free)
                out.append((*head[:4], number, window - free, head[4]))
                number, free = number + 1, window
            out.append((*piece[:4], number, window - free, piece[4]))
            free -= piece[2]
            if not free:
                number, free = number + 1, window
        return pd.DataFrame(out, columns=names[:-1])

    closed = first.where("batch is null").drop("batch")
    merged = first.where("batch is not null").groupBy("batch").applyInPandas(merge, f"`{id_column}` {kind}, {PIECES}")
    return closed.unionByName(merged)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest(pack(docs))
