"""Removal of repeated byte strings by suffix arrays over shards.

Every window of MATCH bytes has one anchor: the smallest of the hashes of its
KMER-byte substrings. Equal windows have equal anchors, so neighbouring windows
of one anchor form a region, and only regions of one anchor hash can repeat each other.

1. Texts become regions: (anchor hash, hash of the whole region, document, start).
2. Sorted by these, an equal region that comes later is repeated as a whole; a
   region whose anchor no other region has repeats nothing. Of what is left, the
   first of each kind of region, only its bytes can tell.
3. These regions' bytes are dealt into shards by anchor. Equal windows have their
   anchor in one place, so windows whose bytes around it stand in no other region
   are left out (a comparison of hashes, which only says what is different), and
   external induced sorting (induced_sort) gives the suffixes of a shard in order with their
   common prefixes: neighbours with MATCH bytes in common are one string, of
   which all but the earliest occurrence are covered.
4. Covered windows are merged to spans by document and cut from the text.

An anchor of many different regions is dealt to several shards by ranges of the
anchor's place in the window, since windows that are equal have it in one place. One of
more than PARTS * HOT regions has too many for any shard: its windows become regions of
their own, each keyed by its whole content, and step 2 settles them as it settles equal regions.

Edge cases: a null text is empty and loses nothing; texts shorter than MATCH
lose nothing; doc_id gives the order and identifies a document: rows that repeat it
and its text do not repeat each other, and of different texts of one doc_id only one is looked at (one_text()), the others lose nothing; an empty table gives no rows; columns other
than the two named are not looked at. doc_id is an integer; rows of a null one lose nothing and are nobody's earlier text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import induced_sort
from gradewell.llm._store import one_text, store, table
from gradewell.llm._words import bytes_hash, mix, prefix_hash, slices, span_hash, spans_hash, text_buffers

MATCH, KMER = 100, 24
HOT = 2000  # different regions of one anchor in one shard
PARTS = 8  # shards of one anchor
FEW = 250_000  # ids in a broadcast: 16 MB at most; more are joined by a shuffle
SHARD = 16_384  # regions sorted together, about 2 MB; a task takes one shard after the other
SHARD_MEMORY = 64 << 20
BLOCK = 1 << 15  # windows whose anchors are looked for at once
BINS = 4  # ranges of an anchor's place in a window: the windows of one range that have one anchor share 81 bytes at least


def regions_of(raw: np.ndarray, off: np.ndarray, match: int = MATCH, kmer: int = KMER) -> tuple[np.ndarray, ...]:
    """Text, start, windows, the anchor's place in the first window, anchor hash and region hash of each region."""
    empty = tuple(np.zeros(0, dtype=d) for d in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(raw)
    if n < match:
        return empty
    prefix = prefix_hash(raw)
    anchor, width = np.empty(n - match + 1, dtype=np.int64), match - kmer + 1
    # windows in blocks that stay near; a k-mer's place in its block rides in the low bits: the smallest is unique, and the leftmost of equal ones
    bits = np.uint64((BLOCK + width).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    for a in range(0, len(anchor), BLOCK):
        b = min(a + BLOCK, len(anchor))
        key = spans_hash(prefix, a, b + width - 1, kmer)
        key &= ~low
        key |= np.arange(len(key), dtype=np.uint64)
        step = 1
        while 2 * step <= width:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if width > step:
            key = np.minimum(key[: len(key) - (width - step)], key[width - step :])
        np.add(key & low, a, out=anchor[a:b], casting="unsafe")
    # regions begin where the anchor changes and where a text begins, and end there or with the last window of their text
    first = np.union1d(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, off[:-1][np.diff(off) >= match])
    t = np.searchsorted(off, first, "right") - 1
    end = np.minimum(np.append(first[1:], len(anchor)), off[t + 1] - match + 1)
    inside = first < end
    first, end, t = first[inside], end[inside], t[inside]
    if not len(first):
        return empty
    a = anchor[first]
    return t, first - off[t], end - first, a - first, span_hash(prefix, a, a + kmer), bytes_hash(raw, first, end - 1 + match)


def _again(*columns: np.ndarray) -> np.ndarray:
    """Rows that are equal to the one before."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[:1] = False
    for c in columns:
        out[1:] &= c[1:] == c[:-1]
    return out


PLACES = "anchor long, region long, doc long, start long, shape long"


def _places(anchor: np.ndarray, region: np.ndarray, doc: np.ndarray, start: np.ndarray, shape: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Regions of one slice as rows of PLACES: equal ones meet here already, so a frequent passage leaves one row a slice for its hot anchor."""
    order = np.lexsort((start, doc, region))
    # a repeated row is the same place again, not an earlier one
    order = order[~_again(region[order], doc[order], start[order])]
    late = np.zeros(len(region), dtype=bool)
    r = region[order]
    late[order[1:][r[1:] == r[:-1]]] = True
    order.sort()
    with np.errstate(over="ignore"):
        spread = mix(doc.view(np.uint64) + mix(start.view(np.uint64)))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.where(late, spread, anchor).view(np.int64)[order]),
            pa.array(region.view(np.int64)[order], mask=late[order]),
            pa.array(doc[order]),
            pa.array(start[order]),
            pa.array(shape[order]),
        ],
        names=["anchor", "region", "doc", "start", "shape"],
    )


def _regions(docs: DataFrame, doc_id: str, text: str, match: int, kmer: int) -> DataFrame:
    """anchor, region, doc, start, shape: regions that repeat an earlier one of the same slice have a null region and a spread anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, off in slices(batch.column(1)):
                t, start, windows, place, anchor, region = regions_of(raw, off, match, kmer)
                doc = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)[t]
                yield from _places(anchor, region, doc, start, windows * 256 + place)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, PLACES)


def _sorted_out(regions: DataFrame) -> DataFrame:
    """anchor, doc, start, shape, open: repeated regions (open false), and first ones whose anchor has other regions (open true)."""
    ordered = regions.repartition("anchor").sortWithinPartitions("anchor", "region", "doc", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # last: the anchor and region read last; held: the only first region so far of the anchor read last
        last, held, several, place = None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            # a repeated row of the documents brings the same places again: each counts once
            whole = [batch.column(0).to_numpy(), batch.column(1).fill_null(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), batch.column(3).to_numpy()]
            again = _again(*whole)
            again[0] = place == tuple(int(c[0]) for c in whole)
            place = tuple(int(c[-1]) for c in whole)
            if again.any():
                batch = batch.filter(pa.array(~(again & batch.column(1).is_valid().to_numpy(zero_copy_only=False))))
            n = batch.num_rows
            if not n:
                continue
            anchor = batch.column(0).to_numpy()
            late = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            region = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            same_anchor = np.append(last is not None and anchor[0] == last[0], anchor[1:] == anchor[:-1])
            same = same_anchor & np.append(last is not None and region[0] == last[1], (region[1:] == region[:-1])) & ~late
            # a late row never stands between: nulls sort first
            same[1:] &= ~late[:-1]
            if last is not None and last[2]:
                same[0] = False
            first = np.flatnonzero(~same & ~late)
            fa = anchor[first]
            follows = np.append(len(fa) > 0 and several is not None and fa[0] == several, fa[1:] == fa[:-1]) if len(fa) else np.zeros(0, dtype=bool)
            followed = np.append(fa[1:] == fa[:-1], False) if len(fa) else follows
            out = [batch.filter(pa.array(same | late)).select([0, 2, 3, 4]).append_column("open", pa.array(np.zeros(int((same | late).sum()), dtype=bool)))]
            keep = follows | followed
            if len(fa):
                if held is not None and follows[0]:
                    out.append(held)
                opened = batch.take(pa.array(first[keep])).select([0, 2, 3, 4])
                out.append(opened.append_column("open", pa.array(np.ones(opened.num_rows, dtype=bool))))
                several = int(fa[-1])
                held = None
                if not keep[-1]:
                    row = batch.take(pa.array(first[-1:])).select([0, 2, 3, 4])
                    held = row.append_column("open", pa.array([True]))
            last = (int(anchor[-1]), int(region[-1]), bool(late[-1]))
            yield from (x for x in out if x.num_rows)

    return ordered.mapInArrow(run, "anchor long, doc long, start long, shape long, open boolean")


def _only(docs: DataFrame, doc_id: str, wanted: DataFrame) -> DataFrame:
    """Rows of docs whose id is in wanted (one column, doc)."""
    ids = wanted.select(F.col("doc").alias(doc_id)).distinct()
    few = ids.limit(FEW + 1).count() <= FEW
    return docs.join(F.broadcast(ids) if few else ids, doc_id, "left_semi")


def _bytes(docs: DataFrame, doc_id: str, text: str, opened: DataFrame, match: int) -> DataFrame:
    """shard, doc, start, shape, body: the bytes of open regions, hot anchors dealt by the anchor's place."""
    # at most one in HOT open regions names such an anchor: a short list, so regions of one anchor need not meet in a task
    hot = store(opened.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > HOT), "hot-anchors")
    hot = F.broadcast(hot) if hot.count() <= FEW else hot
    parts = F.least(F.lit(PARTS), F.ceil(F.coalesce("c", F.lit(0)) / HOT)).cast("int")
    by_doc = (
        opened.join(hot, "anchor", "left").withColumn("parts", F.greatest(F.lit(1), parts))
        .groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "shape", "parts")).alias("regions"))
    )
    span = match - KMER + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("shape", pa.int64()), ("body", pa.binary())])
        for batch in batches:
            rows: list[tuple] = []
            for doc, body, regions in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = memoryview(body.as_buffer()) if body.is_valid else memoryview(b"")
                for x in regions:
                    windows, place = divmod(x["shape"], 256)
                    for part in range(x["parts"]):
                        # windows whose anchor lies in this part's range of places: place falls by one with each window
                        low, high = span * part // x["parts"], span * (part + 1) // x["parts"]
                        a, b = max(0, place - high + 1), min(windows, place - low + 1)
                        if a < b:
                            rows.append(((x["anchor"] + part) & ((1 << 63) - 1), doc, x["start"] + a, (b - a) * 256 + place - a, bytes(data[x["start"] + a : x["start"] + b - 1 + match])))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema=schema)

    texts = _only(docs.select(F.col(doc_id).cast("long").alias(doc_id), text), doc_id, by_doc).dropDuplicates([doc_id])
    both = texts.withColumnRenamed(doc_id, "doc").join(by_doc, "doc").select("doc", text, "regions")
    return both.mapInArrow(run, "shard long, doc long, start long, shape long, body binary")


def _windows(docs: DataFrame, doc_id: str, text: str, crowded: DataFrame, match: int) -> DataFrame:
    """anchor, region, doc, start, shape: the windows of crowded regions, each a region whose anchor is its whole content."""
    by_doc = crowded.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "shape")).alias("regions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2)
            count = own.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            at = np.concatenate([[0], np.cumsum(count)])
            flat = own.flatten()
            anchors, starts, shapes = (flat.field(i).to_numpy() for i in range(3))
            for a, b, raw, off in slices(batch.column(1)):
                here = slice(int(at[a]), int(at[b]))
                t = np.repeat(np.arange(b - a), count[a:b])
                windows = shapes[here] // 256
                of = np.repeat(np.arange(len(t)), windows)
                start = starts[here][of] + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
                doc = batch.column(0).slice(a, b - a).to_numpy().astype(np.int64)[t[of]]
                first = off[t[of]] + start
                content = bytes_hash(raw, first, first + match)
                with np.errstate(over="ignore"):
                    key = mix(content + mix(anchors[here][of].view(np.uint64)))
                yield from _places(key, content, doc, start, np.full(len(of), 256))

    texts = _only(docs.select(F.col(doc_id).cast("long").alias(doc_id), text), doc_id, by_doc).dropDuplicates([doc_id])
    both = texts.withColumnRenamed(doc_id, "doc").join(by_doc, "doc").select("doc", text, "regions")
    return both.mapInArrow(run, PLACES)


def _alike(raw: np.ndarray, at: np.ndarray, windows: np.ndarray, place: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, first window and end of runs of windows whose bytes that the whole bin of places has in common stand in another piece too.

    Equal windows have their anchor in one place, so they agree in these bytes as in all others, and a window of no run has no equal one.
    """
    span, prefix = match - KMER + 1, prefix_hash(raw)
    found = []
    for i in range(BINS):
        low, high = span * i // BINS, span * (i + 1) // BINS
        # place falls by one with each window
        a, b = np.maximum(0, place - high + 1), np.minimum(windows, place - low + 1)
        x = np.flatnonzero(a < b)
        anchor = at[x] + place[x]
        # spans of one hash and different bytes only bring a run that the sort finds to be different
        _, kind, times = np.unique(span_hash(prefix, anchor - low, anchor - high + 1 + match), return_inverse=True, return_counts=True)
        x = x[times[kind] > 1]
        found.append((x, a[x], b[x]))
    piece, a, b = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((a, piece))
    piece, a, b = piece[order], a[order], b[order]
    new = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (a[1:] != b[:-1]))[: len(piece)])
    return piece[new], a[new], b[np.append(new[1:], len(b))[: len(new)] - 1]


def _covered(pieces: DataFrame, shards: int, match: int, memory: int) -> DataFrame:
    """doc, start, end: spans of windows that start earlier in their shard, by the suffix array of what may be alike in each shard's regions."""
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(shards)).cast("long"))
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", "doc", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            number = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column(0)[-1].as_py() != number[a]:
                    yield from _of_shard(held, match, memory)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from _of_shard(held, match, memory)

    return ordered.mapInArrow(run, "doc long, start long, end long")


def _of_shard(batches: list[pa.RecordBatch], match: int, memory: int) -> Iterator[pa.RecordBatch]:
    """doc, start, end of one shard: its rows are shard, doc, start, shape, body, in the order of documents and starts."""
    doc, start, shape = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (1, 2, 3))
    buffers = [text_buffers(b.column(4)) for b in batches]
    raw = np.concatenate([r for r, _ in buffers])
    begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in buffers]))])
    piece, low, high = _alike(raw, begin, shape // 256, shape % 256, match)
    if not len(piece):
        return
    doc, start, count = doc[piece], start[piece] + low, high - low
    size = count - 1 + match
    at = np.concatenate([[0], np.cumsum(size + 1)])
    # 0 ends the whole, 1 each run; bytes follow
    text = np.ones(at[-1] + 1, dtype=np.uint16)
    text[-1] = 0
    of = np.arange(size.sum())
    before = np.cumsum(size) - size
    text[of + np.repeat(at[:-1] - before, size)] = raw[of + np.repeat(begin[piece] + low - before, size)].astype(np.uint16) + 2
    del raw, buffers, of
    starts_window = np.zeros(len(text), dtype=bool)
    starts_window[np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())] = True
    covered = np.zeros(len(text), dtype=bool)
    group: list[np.ndarray] = []

    def close() -> None:
        if group:
            pos = np.concatenate(group)
            if len(pos) > 1:
                covered[pos] = True
                covered[pos.min()] = False
            group.clear()

    def sink(pos: np.ndarray, lcp: np.ndarray) -> None:
        # runs stand in the order of documents and starts, so the first place in the shard is the earliest
        cuts = np.flatnonzero(lcp < match)
        if not len(cuts):
            group.append(pos.copy())
            return
        if cuts[0]:
            group.append(pos[: cuts[0]].copy())
        close()
        size = np.diff(np.append(cuts, len(pos)))
        whole = np.flatnonzero(size[:-1] > 1)
        if len(whole):
            index = np.repeat(cuts[whole], size[whole]) + np.arange(size[whole].sum()) - np.repeat(np.cumsum(size[whole]) - size[whole], size[whole])
            members = pos[index]
            least = np.minimum.reduceat(members, np.cumsum(size[whole]) - size[whole])
            covered[members] = True
            covered[least] = False
        group.append(pos[cuts[-1] :].copy())

    induced_sort.sort(text, sink, match, memory, 258)
    close()
    hit = np.flatnonzero(covered & starts_window)
    if not len(hit):
        return
    r = np.searchsorted(at, hit, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (r[1:] != r[:-1])]))
    last = hit[np.append(new[1:], len(hit)) - 1]
    r = r[new]
    first = start[r] + hit[new] - at[r]
    yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(first), pa.array(start[r] + last - at[r] + match)], names=["doc", "start", "end"])


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", match: int = MATCH, memory: int = SHARD_MEMORY) -> DataFrame:
    """doc, spans: the spans of bytes (start, end) covered by an earlier string, sorted, for documents that have any."""
    docs = docs.where(F.col(doc_id).isNotNull())
    found = store(_sorted_out(_regions(docs, doc_id, text, match, KMER)), "regions")
    opened = found.where("open")
    # at most one in PARTS * HOT open regions names such an anchor
    crowds = store(opened.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > PARTS * HOT).select("anchor"), "crowds")
    n_crowds = crowds.count()
    if n_crowds:
        keys = F.broadcast(crowds) if n_crowds <= FEW else crowds
        single = _sorted_out(_windows(docs, doc_id, text, opened.join(keys, "anchor", "left_semi"), match)).where("not open")
        found = found.where("not open").select("doc", "start", "shape").unionByName(store(single, "windows").select("doc", "start", "shape")).withColumn("open", F.lit(False))
        opened = opened.join(keys, "anchor", "left_anti")
    pieces = _bytes(docs, doc_id, text, opened, match)
    within = _covered(pieces, max(1, math.ceil(opened.count() / SHARD)), match, memory)
    whole = found.where("not open").select("doc", "start", (F.col("start") + F.floor(F.col("shape") / 256) - 1 + match).alias("end"))
    return whole.unionByName(within).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _cut(docs: DataFrame, spans: DataFrame, doc_id: str, text: str, out: str, make) -> DataFrame:
    """make(bytes, merged spans) of each document that has spans, as columns out."""
    kind = dict(docs.dtypes)[doc_id]
    names = [doc_id] + [c.strip().split(" ")[0] for c in out.split(",")]
    schema = f"`{doc_id}` {kind}, {out}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, own in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                rows.append(make(body.as_buffer().to_pybytes() if body.is_valid else b"", _merged(own)))
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=names)

    held = _only(docs.select(doc_id, text), doc_id, spans)
    return held.join(spans.withColumnRenamed("doc", doc_id), doc_id).select(doc_id, text, "spans").mapInArrow(run, schema)


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["start"], s["end"]))
    return out


def _kept(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(body[at:a])
        at = b
    return b"".join([*parts, body[at:]])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", match: int = MATCH, memory: int = SHARD_MEMORY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs, others = one_text(docs.select(doc_id, text), doc_id, text)
    spans = store(repeated_spans(docs, doc_id, text, match, memory), "spans")

    def digest(body: bytes, own: list[tuple[int, int]]) -> tuple:
        return len(body), sum(b - a for a, b in own), len(own), hashlib.sha256(_kept(body, own)).hexdigest()

    changed = _cut(docs, spans, doc_id, text, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", digest)
    zero = F.lit(0).cast("long")
    body = F.coalesce(F.col(text), F.lit(""))
    ids = spans.select(F.col("doc").alias(doc_id))
    few = ids.limit(FEW + 1).count() <= FEW
    whole = [F.octet_length(body).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(body, 256).alias("kept_sha256")]
    untouched = docs.select(doc_id, *whole).join(F.broadcast(ids) if few else ids, doc_id, "left_anti")
    out = untouched.unionByName(changed)
    return out if others is None else out.unionByName(others.select(doc_id, *whole))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated spans, cut at whole characters; documents of which nothing is left go. Rows that repeat a document stay as many."""
    docs, others = one_text(docs, "doc_id", "text")
    spans = store(repeated_spans(docs), "spans")

    def rest(body: bytes, own: list[tuple[int, int]]) -> tuple:
        inner = []
        for a, b in own:
            # a character that a span cuts through stays
            while a < b and a < len(body) and body[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
                b -= 1
            inner.append((a, b))
        return (_kept(body, inner).decode("utf-8"),)

    # one row a document, whose id its rows meet
    changed = _cut(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), spans, "doc_id", "text", "rest string", rest)
    # the document rides along as one struct, so its columns may have any names
    whole = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_document"))
    new = F.col("_document").withField("text", F.col("rest"))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.length("rest").cast(dict(docs.dtypes)["n_chars"]))
    untouched = whole.join(spans.select(F.col("doc").alias("doc_id")), "doc_id", "left_anti").select("_document.*")
    out = untouched.unionByName(whole.join(changed, "doc_id").where("rest != ''").select(new.alias("_document")).select("_document.*"))
    return out if others is None else out.unionByName(others)
