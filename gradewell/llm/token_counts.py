"""Token counts at every prefix of a text by dynamic programming over its pre-tokens.

A prefix of a text is split like the text but in its last pre-token, and the
last token of a prefix inside a pre-token is the one that is compatible with
the last token of the prefix before it. One pass thus gives the exact count at
every code-point prefix; truncation to a budget and checks against a limit are
look-ups. Two places differ from the plain rule and are set apart: the end of a
run of white space whose last character is split off only because something
follows, and a cut inside 've, 're or 'll.

A special token's string is one token and parts the text, as in the library; a prefix that ends inside of one holds its beginning
as plain text, so the programme runs on what stands before it with that beginning.

Edge cases: a null text counts as empty, with no tokens; repeated rows are
counted alike; an empty table gives no rows; columns other than the two named are dropped.
There is no shuffle; a slice of about 2 MB, or one longer text, is in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import _bpe
from gradewell.llm._store import table
from gradewell.llm._words import slices

LIMIT = 1024


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def prefix_counts(bpe: _bpe.Bpe, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """For each text the token count of each of its code-point prefixes, the empty one first."""
    data = raw.tobytes()
    spans = [m.span() for m in bpe.special_pattern.finditer(data)] if bpe.special_pattern else []
    if not spans:
        return _plain_counts(bpe, raw, off)
    # parts of texts, each with all but the last byte of the special string that follows; that string's code points, or 0
    parts, lengths, first, at = [], [], [0], 0
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        while at < len(spans) and spans[at][0] < b:
            # a span cannot cross a text's end unless the texts' bytes make one together
            s, e = spans[at]
            at += 1
            if e <= b and s >= a:
                parts.append(data[a : e - 1])
                lengths.append(len(data[s:e].decode()))
                a = e
        parts.append(data[a:b])
        lengths.append(0)
        first.append(len(parts))
    counts = _plain_counts(bpe, np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        base, own = 0, []
        for c, n in zip(counts[a:b], lengths[a:b], strict=True):
            own.append(base + c)
            base += int(c[len(c) - n]) + 1 if n else 0
        out.append(np.concatenate(own))
    return out


def _plain_counts(bpe: _bpe.Bpe, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """prefix_counts() of texts in which no special string counts."""
    x = _bpe.Encoded(bpe, raw, off)
    flat, offsets, which = bpe.per_word(raw, x.start, x.end, bpe.count_words)
    inside, _ = _bpe.expand(flat, offsets, which)
    last = flat[offsets[1:] - 1][which].astype(np.int64) if len(which) else np.zeros(0, dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(last)])
    by_byte = inside.astype(np.int64) + np.repeat(before[:-1], x.end - x.start)
    at_cp = np.concatenate([[0], by_byte[x.byte_at[1:] - 1]])  # counted from the slice's start
    kind = _bpe._classes(x.cp)[0]
    first = x.first_cp
    size = np.diff(np.append(first, len(x.cp)))
    inner = np.zeros(len(first), dtype=bool)
    inner[:-1] = ~np.isin(first[1:], x.edges)  # another pre-token of the same text follows
    # white space whose last character was split off: the prefix that ends with it is one pre-token
    split = np.flatnonzero(inner & (kind[first + size - 1] == _bpe.SPACE) & (kind[first] == _bpe.SPACE))
    for i in split.tolist():
        end = first[i] + size[i] + 1
        if x.cp[end - 1] == 0x20 or kind[end - 1] == _bpe.SPACE:
            run = raw[x.byte_at[first[i]] : x.byte_at[end]].tobytes()
            at_cp[end] = before[i] + _count(bpe, run)
    quote = np.flatnonzero((size == 3) & (x.cp[first] == 0x27) & (kind[np.minimum(first + 1, len(kind) - 1)] == _bpe.LETTER)) if len(first) else []
    at_cp[first[quote] + 2] = before[quote] + 2
    out = []
    for t in range(len(off) - 1):
        a, b = x.edges[t], x.edges[t + 1]
        out.append(at_cp[a : b + 1] - (before[x.words_at[t]]))
        out[-1][0] = 0
    return out


def _count(bpe: _bpe.Bpe, word: bytes) -> int:
    if word not in bpe.memo:
        bpe.memo[word] = bpe.count_words([word])[0]
    return int.from_bytes(bpe.memo[word][-4:], "little")


def count_tokens(df: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = LIMIT, prefixes: bool = False) -> DataFrame:
    """id, n_bytes, n_tokens, cut_chars (code points of the longest prefix of at most limit tokens), and with prefixes the counts of all prefixes."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe.load(path, "counts")
        for batch in batches:
            for a, b, raw, off in slices(batch.column(1)):
                counts = prefix_counts(bpe, raw, off)
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(off), type=pa.int64()),
                    pa.array([int(c[-1]) for c in counts], type=pa.int64()),
                    pa.array([_longest(c, limit) for c in counts], type=pa.int64()),
                ]
                if prefixes:
                    columns.append(pa.array([c.tolist() for c in counts], type=pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(df.dtypes)[id_column]
    names = [id_column, "n_bytes", "n_tokens", "cut_chars"] + ["prefix_tokens"] * prefixes
    schema = f"`{id_column}` {kind}, n_bytes long, n_tokens long, cut_chars long" + ", prefix_tokens array<long>" * prefixes
    return df.select(id_column, text).mapInArrow(run, schema)


def _longest(counts: np.ndarray, limit: int) -> int:
    """Code points of the longest prefix within the limit; counts may fall by one place when a letter completes a token."""
    if counts[-1] <= limit:
        return len(counts) - 1
    return int(np.flatnonzero(counts <= limit)[-1])


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "cut_chars")
