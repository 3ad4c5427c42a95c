"""Language-model scores by online logistic context mixing.

A text is its lower-cased words and one end. Words are coded in bits, frequent ones by a code of their own and others
by their letters, and every bit of every token of every text is predicted by the mixing model of _mixing: counts
under hashed contexts, combined by gated weights and refined.

1. Words of the training texts are counted (a join key for the base score); the most frequent, VOCABULARY at most, get codes.
2. Tasks go through the training texts once, online: predict a block, move the weights and the refinement, count it: every block, of words and of
   letters. Counts are summed over tasks, weights averaged; which texts a task has, and so the weights, follows from how the table lies in files. Nothing of a held-out text enters a model or a count.
3. All texts are scored with the model; what followed the same words earlier in a text is its only state.

The mixing tables and the vocabulary have a fixed largest size, whatever the corpus; word counts grow with it and meet texts by
joins: base_score is the smoothed word count model.

Edge cases: a null or empty text is its end alone; rows that repeat a doc_id are scored each;
with no training text all counts are zero and an untrained model predicts; an empty
table gives no rows; a very long word or text is one row of work and its size is held once;
columns other than the two named are ignored; bits_per_byte is over the text's UTF-8 bytes, an empty text counting as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import _mixing
from gradewell.llm._store import store, table
from gradewell.llm._words import Words, slices

VOCABULARY = 1 << 19  # words with a code: 12 bytes each in a broadcast
HELD_WORDS = 1 << 20  # distinct words that a counting task holds before it gives their counts on
BLOCK = 1 << 12  # slots of one order in one row of summed counts
TASK_BYTES, MOST_BYTES, TASKS = 16 << 20, 64 << 20, 24  # a training task holds one table: small inputs make few, large ones have at most MOST_BYTES in each
WIDE = 16  # training tasks whose sums are taken in one round
WORD, BYTE, ROW = range(3)


def _held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def counted(texts: DataFrame) -> DataFrame:
    """kind, key, times of texts (one column): words by hash, bytes by value, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, size, seen, rows = [], [], 0, np.zeros(256, dtype=np.int64), 0

        def frame(kind: int, key: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(key), pa.array(times)], names=["kind", "key", "times"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, times = np.concatenate(held), np.concatenate(sizes)
            distinct, which = np.unique(keys, return_inverse=True)
            return distinct, np.bincount(which, times).astype(np.int64)

        for batch in batches:
            rows += batch.num_rows
            for _, _, raw, off in slices(batch.column(0)):
                w = Words(raw, off)
                seen += np.bincount(w.raw, minlength=256)
                distinct, times = np.unique(w.hash, return_counts=True)
                held.append(distinct)
                sizes.append(times)
                size += len(distinct)
                if size > HELD_WORDS:
                    distinct, times = merged()
                    held, sizes, size = [distinct], [times], len(distinct)
                    if size > HELD_WORDS // 2:
                        yield frame(WORD, distinct.view(np.int64), times)
                        held, sizes, size = [], [], 0
        if held:
            distinct, times = merged()
            yield frame(WORD, distinct.view(np.int64), times)
        yield frame(BYTE, np.arange(256), seen)
        yield frame(ROW, np.zeros(1, dtype=np.int64), np.array([rows]))

    return texts.mapInArrow(run, "kind int, key long, times long").groupBy("kind", "key").agg(F.sum("times").alias("times")).where("times > 0")


def codes_of(counts: DataFrame, most: int = VOCABULARY) -> tuple[_mixing.Codes, int, int, int]:
    """Codes of the words met twice or more often, the most frequent ones if they are more than most; numbers of words, of distinct words and of texts."""
    words = counts.where(F.col("kind") == WORD)
    n, v = words.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*")).first()
    # words by frequency, to the eighth of an octave: a few hundred rows
    octave = F.floor(F.log2("times") * 8).cast("int")
    by = words.where("times > 1").groupBy(octave.alias("o")).agg(F.count("*").alias("c")).collect()
    held, least = 0, None
    for o, c in sorted(((r["o"], r["c"]) for r in by), reverse=True):
        held += c
        if held > most:
            break
        least = o
    rows = words.where((F.col("times") > 1) & (octave >= least)).select("key", "times").toArrow() if least is not None else None
    hashes = rows["key"].to_numpy().view(np.uint64) if rows else np.zeros(0, dtype=np.uint64)
    times = rows["times"].to_numpy() if rows else np.zeros(0, dtype=np.int64)
    seen = np.zeros(256, dtype=np.int64)
    ends = 0
    for r in counts.where(F.col("kind") != WORD).collect():  # 257 rows
        if r["kind"] == BYTE:
            seen[r["key"]] = r["times"]
        else:
            ends = r["times"]
    return _mixing.Codes(hashes, times, n - int(times.sum()), ends, seen), n, v, ends


def train(texts: DataFrame, codes: _mixing.Codes) -> _mixing.Model:
    """One online pass over all training texts (one column) in tasks; counts summed by blocks of slots, weights averaged.

    Tasks emit the blocks that they touched. The sums are taken in two rounds, so that of many tasks no sum reads more than the root of their number.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(codes)
    model = _mixing.Model()
    n_weights = model.weights.size

    def row(block: int, part: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part], pa.int32()), pa.array([data], type=pa.binary())], names=["block", "part", "data"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, state, mass, part = None, None, 0, TaskContext.get().partitionId()
        for batch in batches:
            for _, _, raw, off in slices(batch.column(0)):
                if counts is None:
                    counts, state = _mixing.no_counts(), _mixing.Model()
                coded = _mixing.encode(shared.value, raw, off)
                _mixing.learn(coded, counts, state.weights, state.cells)
                mass += len(coded.parts[0].value)
                del coded  # before the next slice's takes room
        if counts is None:
            return
        flat = counts.reshape(-1, 2 * BLOCK)
        for i in range(len(flat)):
            if flat[i].any():
                yield row(i, part, pa.compress(flat[i].astype(np.uint32).tobytes(), codec="zstd", asbytes=True))
        yield row(-1, part, np.concatenate([state.weights.reshape(-1).astype(np.float64) * mass, state.cells.reshape(-1), [mass]]).tobytes())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of one block and part lie together: one sum is held, however many tasks there are
        now, total = None, None

        def done() -> pa.RecordBatch:
            return row(*now, total.tobytes() if now[0] < 0 else pa.compress(np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes(), codec="zstd", asbytes=True))

        for batch in batches:
            for b, p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = x.as_buffer()
                value = np.frombuffer(data) if b < 0 else np.frombuffer(pa.decompress(data, decompressed_size=8 * BLOCK, codec="zstd"), dtype=np.uint32).astype(np.float64)
                if (b, p) != now:
                    if total is not None:
                        yield done()
                    now, total = (b, p), value.copy()
                else:
                    total += value
        if total is not None:
            yield done()

    schema = "block long, part int, data binary"
    parts, tasks = texts.mapInArrow(learn, schema), texts.rdd.getNumPartitions()
    for roots in (math.ceil(math.sqrt(tasks)), 1):
        if roots == 1 or tasks > WIDE:
            parts = parts.withColumn("part", F.col("part") % roots).repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(summed, schema)
    # one table of a fixed size
    counts = _mixing.no_counts()
    flat = counts.reshape(-1, 2 * BLOCK)
    for batch in parts.toArrow().to_batches():
        for block, data in zip(batch["block"].to_pylist(), batch["data"], strict=True):
            if block < 0:
                row = np.frombuffer(data.as_buffer())
                model.weights = (row[:n_weights] / row[-1]).reshape(model.weights.shape).astype(np.float32)
                model.cells = row[n_weights:-1].reshape(model.cells.shape)
            else:
                flat[block] = np.frombuffer(pa.decompress(data.as_buffer(), decompressed_size=8 * BLOCK, codec="zstd"), dtype=np.uint32)
    model.logits = _mixing.logits_of(counts)
    shared.unpersist()
    return model


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[doc_id]
    known = docs.where(~_held_out(doc_id)).select(text)
    counts = store(counted(known), "lm-words")
    codes, n_words, distinct, n_ends = codes_of(counts)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = max(1, min(math.ceil(size / TASK_BYTES), TASKS), math.ceil(size / MOST_BYTES))
    model = train(known.coalesce(tasks), codes)
    shared = spark.sparkContext.broadcast((codes, model))
    train_tokens = n_words + n_ends
    total = train_tokens + 0.1 * (distinct + bool(n_ends) + 1)
    end_value = math.log10((n_ends + 0.1) / total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, model = shared.value
        # a copy of the task's own lies in large pages, a table read out of a message does not
        model = _mixing.Model(np.array(model.logits), model.weights, model.cells)
        final = _mixing.final_logs(model)
        # of words without a code, the counts come by a join
        value, row = np.append(np.log10((codes.times + 0.1) / total), 0.0), TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, raw, off in slices(batch.column(1)):
                n = b - a
                coded = _mixing.encode(codes, raw, off)
                text_of, rare = coded.words.text_of(), coded.found < 0
                own = np.bincount(text_of[rare], minlength=n)
                cuts = np.concatenate([[0], np.cumsum(own)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        batch.column(0).slice(a, n),
                        batch.column(2).slice(a, n),
                        pa.array(np.diff(off), type=pa.int64()),
                        pa.array(np.diff(coded.words.off) + 1, type=pa.int64()),
                        pa.array(np.bincount(text_of[~rare], minlength=n) + (n_ends > 0), type=pa.int64()),
                        pa.array(np.bincount(text_of, value[coded.found], minlength=n) + end_value),
                        pa.array(_mixing.score(model, coded, n, final)),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(coded.words.hash[rare].view(np.int64))),
                    ],
                    names=["row", "id", "held_out", "n_bytes", "n_tokens", "n_coded", "base", "score", "rare"],
                )
                row += n
                del coded  # before the next slice's takes room

    schema = f"row long, id {kind}, held_out boolean, n_bytes long, n_tokens long, n_coded long, base double, score double, rare array<long>"
    scored = store(docs.select(doc_id, text, _held_out(doc_id).alias("held_out")).mapInArrow(run, schema), "lm-scores")
    words = counts.where(F.col("kind") == WORD).select(F.col("key").alias("word"), "times")
    asked = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("n"))
    times = F.coalesce("times", F.lit(0))
    of_rare = (
        asked.join(words, "word", "left").groupBy("row")
        .agg(F.sum(F.col("n") * F.log10((times + 0.1) / total)).alias("rare_base"), F.sum(F.when(times > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    )
    return scored.drop("rare").join(of_rare, "row", "left").select(
        F.col("id").alias(doc_id), "held_out", "n_tokens",
        (F.col("n_coded") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") / math.log(10)).alias("score"),
        (-F.col("score") / math.log(2) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
