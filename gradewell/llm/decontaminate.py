"""Benchmark decontamination as a prefix-filtered set join.

An item's window is ten consecutive words (all of a shorter item). Its tokens
are its five-word shingles. A document word run can only be a window if all of
its shingles are shingles of items, so documents keep just such runs, found
with a bitmap sized by the items. Shingles are ordered by how often these runs hold
them; each window is joined by its rarest one only, the offset of that shingle
fixes where the window would start and end, and what stands there is compared word by word.

Edge cases: a null or empty text has no words; an item without words is
ignored; repeated items count once by item_id; repeated documents are judged
row by row; an empty table on either side gives no hits; columns other than id and text are
ignored. A frequent passage only adds rows in proportion to where it occurs; the
join is an equi-join that AQE can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm._store import store, table
from gradewell.llm._words import ALNUM, Words, slices

WINDOW, SHINGLE = 10, 5
SPARE, LEAST_BITS, MOST_BITS = 4, 16, 28  # the bitmap of item shingles has 2^SPARE bits for each, 32 MB at most: a fuller one lets more runs through, with the same result
CHUNK = 64  # shingles of a run in one row


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, words (joined by blanks), n and the shingles (hashes, in order) of each window."""
    kind = dict(items.dtypes)[item_id]
    id_type = items.select(item_id).limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, off in slices(batch.column(1)):
                w = Words(raw, off, ALNUM)
                parts = [w.raw[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(w.start, w.end, strict=True)]
                of = {k: w.shingles(k, False) for k in range(1, shingle + 1)}
                rows = []
                for t, key in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    first, n = int(w.off[t]), int(w.off[t + 1] - w.off[t])
                    size = min(n, window)
                    k = min(size, shingle)
                    for i in range(n - size + 1 if n else 0):
                        hashes, at = of[k]
                        rows.append((key, " ".join(parts[first + i : first + i + size]), size, hashes[at[t] + i : at[t] + i + size - k + 1].view(np.int64).tolist()))
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(cols, [id_type, pa.string(), pa.int32(), pa.list_(pa.int64())], strict=True)],
                    names=["item_id", "words", "n", "shingles"],
                )

    return items.select(item_id, text).mapInArrow(run, f"item_id {kind}, words string, n int, shingles array<long>")


def bitmap(found: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """Packed bits of all shingles, and for each shingle size the fewest shingles of a window."""
    total = found.agg(F.sum(F.size("shingles"))).first()[0] or 0
    size = min(max(total.bit_length() + SPARE, LEAST_BITS), MOST_BITS)
    bits = (
        found.select(F.explode("shingles").alias("h"))
        .select(F.col("h").bitwiseAND((1 << size) - 1).alias("b"))
        .groupBy(F.shiftright("b", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (size - 6), dtype=np.uint64)
    out[bits["at"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    sizes = found.groupBy(F.least("n", F.lit(SHINGLE)).alias("k")).agg(F.min(F.size("shingles")).alias("least")).collect()
    return out.view(np.uint8), {r["k"]: r["least"] for r in sizes}


def runs(docs: DataFrame, bits: np.ndarray, least: dict[int, int], doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """row, doc_id, n_words and the runs of each document whose shingles are all shingles of items."""
    kind = dict(docs.dtypes)[doc_id]
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    mask = np.uint64(8 * len(bits) - 1)
    run_type = pa.struct([("k", pa.int32()), ("start", pa.int64()), ("shingles", pa.list_(pa.int64())), ("words", pa.list_(pa.string()))])

    def of_slice(w: Words, held: np.ndarray) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(w.off) - 1)]
        for k, fewest in least.items():
            hashes, at = w.shingles(k, False)
            place = (hashes & mask).astype(np.int64)
            hit = np.flatnonzero((held[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
            if not len(hit):
                continue
            t = np.searchsorted(at, hit, "right") - 1
            new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(t) > 0)]))
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(hit)], strict=True):
                if b - a < fewest:
                    continue
                text_at = int(t[a])
                first = int(hit[a] - at[text_at])
                # long runs are dealt in pieces that overlap by a window
                for c in range(0, max(1, b - a - (window - k)), CHUNK):
                    n = min(CHUNK + window - k, b - a - c)
                    word = int(w.off[text_at]) + first + c
                    out[text_at].append({
                        "k": k,
                        "start": first + c,
                        "shingles": hashes[hit[a] + c : hit[a] + c + n].view(np.int64).tolist(),
                        "words": [w.raw[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(w.start[word : word + n + k - 1].tolist(), w.end[word : word + n + k - 1].tolist(), strict=True)],
                    })
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b, raw, off in slices(batch.column(1)):
                w = Words(raw, off, ALNUM)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + b - a)),
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(w.off), type=pa.int64()),
                        pa.array(of_slice(w, held), type=pa.list_(run_type)),
                    ],
                    names=["row", doc_id, "n_words", "runs"],
                )
                row += b - a

    schema = f"row long, `{doc_id}` {kind}, n_words long, runs array<struct<k: int, start: long, shingles: array<long>, words: array<string>>>"
    return docs.select(doc_id, text).mapInArrow(run, schema)


def match(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, items (sorted as strings)."""
    of_items = store(windows(items, item_id, text), "item-windows")
    bits, least = bitmap(of_items)
    base = store(runs(docs, bits, least, doc_id, text), "item-runs")

    found = base.where(F.size("runs") > 0).select("row", F.explode("runs").alias("r"))
    occurs = found.select("row", "r.k", "r.start", "r.words", F.posexplode("r.shingles").alias("pos", "shingle"))
    rarity = occurs.groupBy("k", "shingle").agg(F.count("*").alias("times"))
    distinct = of_items.groupBy("words").agg(F.any_value("n").alias("n"), F.any_value("shingles").alias("shingles"))
    tokens = distinct.select(
        F.col("words").alias("window"), "n", F.size("shingles").alias("of"),
        F.least("n", F.lit(SHINGLE)).alias("k"), F.posexplode("shingles").alias("offset", "shingle"),
    )
    # a window of which some shingle occurs nowhere cannot occur; of the others the rarest shingle is the prefix
    prefix = (
        tokens.join(rarity, ["k", "shingle"])
        .groupBy("window", "n", "of", "k")
        .agg(F.min(F.struct("times", "offset", "shingle")).alias("p"), F.count("*").alias("present"))
        .where("present = of")
        .select("window", "n", "k", "p.offset", "p.shingle")
    )
    first = F.col("pos") - F.col("offset")
    hits = (
        occurs.join(prefix, ["k", "shingle"])
        .where((first >= 0) & (first + F.col("n") <= F.size("words")))
        .where(F.array_join(F.slice("words", first + 1, F.col("n")), " ") == F.col("window"))
        .select("row", "window", (F.col("start") + first).alias("at"), (F.col("start") + first + F.col("n")).alias("end"))
        .distinct()
    )
    hits = store(hits, "item-hits")
    covered = F.aggregate(
        F.sort_array(F.collect_set(F.struct("at", "end"))),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["end"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(acc["end"], x["at"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    words_hit = hits.groupBy("row").agg(covered.alias("n_hit"))
    members = of_items.select(F.col("words").alias("window"), "item_id").distinct()
    by_row = (
        hits.select("row", "window").distinct().join(members, "window").select("row", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    return (
        base.select("row", doc_id, "n_words").join(words_hit, "row", "left").join(by_row, "row", "left")
        .select(doc_id, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    bad = match(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
