"""Exact and fuzzy duplicates of questions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.operators.likeness import common_subsequence, fuzzy_ratio, piece_keys, ratios, window_keys  # noqa: F401
from gradewell.operators.timewise import with_last, with_range
from gradewell.sources.shared import settled

BLOCK = 512  # texts compared with another block at once
FEW_PAIRS = 1 << 26  # pairs that blocks compare without a look at pieces
PIECES_FROM = 82  # below this ratio pieces are of four characters or fewer
ROWS = 4096  # rows that are compared at once
DEARER = 8  # pairs of a block that cost as much as two texts that meet by a piece
BAND = math.log(1.1)  # lengths within a tenth share a band
RANGE = 65_536  # row numbers that one window holds
SENT = 64 << 20  # bytes of queries, in all their bands, that are sent to every task
COPIES = 1000  # known rows of one text that meet its queries as one list
OPENED = 4 << 20  # rows of a result that one task opens


def exact_flags(df: DataFrame, columns: Sequence[str], name: str = "is_duplicate", keep: str | bool = "first", row: str = "row_id") -> DataFrame:
    """Flags rows that repeat another on columns, nulls being equal: all but the first, all but the last, or, with keep False, all.

    The row that stays is found by an aggregate and met by its row number, so a text of many copies is no hot key.
    """
    kept = df.groupBy(*columns).agg((F.max(row) if keep == "last" else F.min(row)).alias("_kept"), F.count("*").alias("_n"))
    kept = (kept.where("_n = 1") if keep is False else kept).select(F.col("_kept").alias(row), F.lit(False).alias(name))
    return df.join(kept, row, "left").withColumn(name, F.coalesce(name, F.lit(True))).select(*df.columns, name)


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Values that occur more than once, with their number."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


@F.pandas_udf(T.IntegerType())
def fuzz_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """fuzzy_ratio() of two columns, many rows at once."""
    out = np.zeros(len(a), dtype="int32")
    for at in range(0, len(a), ROWS):
        x, y = ([None if pd.isna(t) else t for t in side[at : at + ROWS]] for side in (a, b))
        names = {t: k for k, t in enumerate(dict.fromkeys([*x, *y]))}
        rows = [[t] for t in names]
        out[at : at + ROWS] = ratios(rows, rows, np.array([names[t] for t in x]), np.array([names[t] for t in y]), 0)[1][0]
    return pd.Series(out)


def _classes(df: DataFrame, columns: Sequence[str], by: Sequence[str], row: str) -> DataFrame:
    """_id, _by and _text of every class: rows that agree in all columns and in by, named by their smallest row."""
    text = F.array(*[F.col(c).cast("string") for c in columns])
    classes = df.groupBy(*by, *columns).agg(F.min(row).cast("long").alias("_id"))
    return settled(classes.select("_id", (F.xxhash64(*by) if by else F.lit(0).cast("long")).alias("_by"), text.alias("_text")))


def fuzzy_links(df: DataFrame, columns: Sequence[str], low: float, strict: bool = True, high: float | None = None, by: Sequence[str] = (), row: str = "row_id", how: str | None = None) -> DataFrame:
    """a, b, ratio: different texts whose mean ratio is above low (not below, unless strict) and, if given, below high.

    Texts that agree in all columns (and in by) are one class, so copies form no pairs. A mean of low or more needs one column of as much: texts
    meet by any column that allows it. They meet in blocks of like length, whose pairs are dropped by bounds or
    compared many at a time; where that would be more than FEW_PAIRS and low is PIECES_FROM or more they meet by the pieces that
    like texts must share, unless frequent pieces would make more pairs than blocks do. All ways are exact; how ("pieces" or "blocks") names one.
    """
    classes = _classes(df, columns, by, row)
    if how is None:
        how = "blocks"
        if low >= PIECES_FROM:
            pairs = _compared(_placed(classes, low)[1], low)
            if pairs > FEW_PAIRS and _meetings(_keys(classes, low)) * DEARER < pairs:
                how = "pieces"
    found = _by_pieces(classes, low) if how == "pieces" else _by_blocks(classes, low)
    above = F.col("ratio") > low if strict else F.col("ratio") >= low
    return found.where(above if high is None else above & (F.col("ratio") < high))


def _texts(classes: DataFrame) -> DataFrame:
    """A row for each class and column that has a text: _id, _by, _c and t."""
    return classes.select("_id", "_by", F.posexplode("_text").alias("_c", "t")).where(F.col("t").isNotNull())


def _placed(classes: DataFrame, low: float) -> tuple[DataFrame, DataFrame]:
    """Texts with their block, and the number of blocks of each band of lengths: at thresholds that bound no lengths there is one band."""
    length = F.greatest(F.length("t"), F.lit(1))
    band = F.floor(F.log(length) / BAND).cast("int") if low > 0.5 else F.lit(0)
    rows = _texts(classes).withColumn("_band", band)
    sizes = rows.groupBy("_by", "_c", "_band").agg(F.count("*").alias("_n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("_salts"))
    rows = rows.join(sizes.drop("_n"), ["_by", "_c", "_band"]).withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int"))
    return rows.select("_by", "_c", F.struct("_band", "_salt").alias("k"), "_id"), sizes


def _reach(low: float) -> int:
    """How many bands apart like texts can be: of lengths n <= m a ratio is 200 n / (n + m) at most."""
    return math.ceil(math.log((200 - low + 0.5) / (low - 0.5)) / BAND) + 1 if low > 0.5 else 0


def _compared(sizes: DataFrame, low: float) -> float:
    """How many pairs blocks compare."""
    ahead = sizes.select("_by", "_c", F.col("_n").alias("_m"), F.explode(F.sequence(F.col("_band"), F.col("_band") + _reach(low))).alias("_band"))
    return sizes.join(ahead, ["_by", "_c", "_band"]).agg(F.coalesce(F.sum(F.col("_n").cast("double") * F.col("_m")), F.lit(0.0))).first()[0]


def _block_pairs(sizes: DataFrame, low: float) -> DataFrame:
    """_by, _c, x, y, _pair: blocks whose lengths allow the ratio, each pair once."""
    reach = _reach(low)
    blocks = sizes.select("_by", "_c", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), "_band").select("_by", "_c", F.struct("_band", "_salt").alias("k"))
    near = blocks.select("_by", "_c", F.col("k").alias("x"), F.explode(F.sequence(F.col("k._band"), F.col("k._band") + reach)).alias("_band"))
    pairs = near.join(blocks.select("_by", "_c", F.col("k._band").alias("_band"), F.col("k").alias("y")), ["_by", "_c", "_band"]).where(F.col("x") <= F.col("y"))
    return pairs.select("_by", "_c", "x", "y", F.xxhash64("_by", "_c", "x", "y").alias("_pair"))


def _by_blocks(classes: DataFrame, low: float) -> DataFrame:
    """Pairs of blocks, each compared in one task; a pair of texts counts in the first column that has the ratio."""
    rows, sizes = _placed(classes, low)
    pairs = _block_pairs(sizes, low)
    rows = rows.join(classes.select("_id", "_text"), "_id")
    sent = lambda side, left, which: rows.join(which.select("_by", "_c", F.col(side).alias("k"), "_pair"), ["_by", "_c", "k"]).select("_pair", "_c", "_id", "_text", F.lit(left).alias("_left"))
    dealt = sent("x", True, pairs).unionByName(sent("y", False, pairs.where("x != y")))

    def compare(own: pd.DataFrame) -> pd.DataFrame:
        first = own["_left"].to_numpy()
        a, b = own[first], own[~first]
        inner = not len(b)
        b = a if inner else b
        i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
        x, y = a["_id"].to_numpy()[i], b["_id"].to_numpy()[j]
        if inner:
            once = x < y
            i, j, x, y = i[once], j[once], x[once], y[once]
        c = int(own["_c"].iloc[0])
        mean, each = ratios(a["_text"].tolist(), b["_text"].tolist(), i, j, low)
        # a pair that also meets by an earlier column counts there
        hit = (mean >= low) & (each[c] >= low)
        for earlier in range(c):
            hit &= each[earlier] < low
        return pd.DataFrame({"a": np.minimum(x, y)[hit], "b": np.maximum(x, y)[hit], "ratio": mean[hit]})

    return dealt.groupBy("_pair").applyInPandas(compare, "a long, b long, ratio double")


def _keys(classes: DataFrame, low: float) -> DataFrame:
    """_key, _id, n, long: the keys of every text in both of its parts, as the longer and as the shorter text of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, by, c, t in zip(*(b.column(k).to_pylist() for k in ("_id", "_by", "_c", "t")), strict=True):
                for long, keys in ((True, piece_keys(t, low)), (False, window_keys(t, low))):
                    letters, places = zip(*set(keys), strict=True)
                    n = len(places)
                    yield pa.RecordBatch.from_arrays([pa.array([v] * n, k) for v, k in ((i, pa.int64()), (by, pa.int64()), (c, pa.int32()), (len(t), pa.int32()), (long, pa.bool_()))] + [pa.array(letters, pa.string()), pa.array(places, pa.int32())], names=["_id", "_by", "_c", "n", "long", "letters", "place"])

    rows = _texts(classes).mapInArrow(run, "_id long, _by long, _c int, n int, long boolean, letters string, place int")
    return rows.select(F.xxhash64("_by", "_c", "letters", "place").alias("_key"), "_id", "n", "long")


def _meetings(keys: DataFrame) -> float:
    """How many pairs meet in equal keys."""
    sizes = keys.groupBy("_key").agg(F.count_if("long").alias("p"), F.count_if(~F.col("long")).alias("q"))
    return sizes.agg(F.coalesce(F.sum(F.col("p").cast("double") * F.col("q")), F.lit(0.0))).first()[0]


def piece_pairs(classes: DataFrame, low: float) -> DataFrame:
    """a, b, x, y: the pairs of classes to compare: a shared key, lengths and places that allow the ratio, and an edit distance that allows it.

    An edit distance, in which a changed letter counts once, is never above the distance of the ratio.
    """
    keys = _keys(classes, low)
    p = keys.where("long").select("_key", F.col("_id").alias("p"), F.col("n").alias("m"))
    q = keys.where("not long").select("_key", F.col("_id").alias("q"), "n")
    apart = lambda n, m: F.floor((n + m) * ((100.5 - low) / 100) + 1e-9).cast("int")
    fits = ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("q") < F.col("p")))) & (F.col("m") - F.col("n") <= apart(F.col("n"), F.col("m")))
    met = p.join(q, "_key").where(fits).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    x, y = classes.select(F.col("_id").alias("a"), F.col("_text").alias("x")), classes.select(F.col("_id").alias("b"), F.col("_text").alias("y"))
    width = classes.select(F.size("_text")).first()
    near = F.lit(False)
    for c in range(width[0] if width else 0):
        s, t = F.get("x", F.lit(c)), F.get("y", F.lit(c))
        near = near | F.coalesce(F.call_function("levenshtein", s, t, apart(F.length(s), F.length(t))) >= 0, F.lit(False))
    return met.join(x, "a").join(y, "b").where(near)


def _by_pieces(classes: DataFrame, low: float) -> DataFrame:
    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = np.arange(len(f))
            mean = ratios(f["x"].tolist(), f["y"].tolist(), at, at, low)[0] if len(f) else np.zeros(0)
            hit = mean >= low
            yield pd.DataFrame({"a": f["a"].to_numpy()[hit], "b": f["b"].to_numpy()[hit], "ratio": mean[hit]})

    return piece_pairs(classes, low).mapInPandas(compare, "a long, b long, ratio double")


def _members(df: DataFrame, columns: Sequence[str], by: Sequence[str], row: str) -> DataFrame:
    """Each row with its class and the mean ratio of the class to itself: a missing text is like no other, not even a missing one.

    Classes are found by an aggregate and joined back, one row each, so copies of one text do not pass through one task.
    """
    held = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    keys = [*by, *columns]
    classes = df.groupBy(*keys).agg(F.min(row).alias("_class")).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_class")
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    own = df.select(F.col(row).alias("_j"), *keys, (100.0 * held / len(columns)).alias("_own"))
    return own.join(classes, on).select("_j", "_class", "_own")


def _latest_before(both: DataFrame, members: DataFrame) -> DataFrame:
    """_j and _ratio: the ratio of each row to the latest earlier row of the classes that its own is linked to.

    The rows of the two classes of a link stand in order, dealt by ranges of row numbers; a range begins with the
    last row of those before it, so a window holds at most two rows for each of RANGE numbers.
    """
    none = F.lit(None).cast("long")
    mine = both.join(members, "_class").select("_class", "_other", "ratio", F.col("_j").cast("long").alias("_j"), none.alias("_i"))
    theirs = both.join(members.select(F.col("_class").alias("_other"), "_j"), "_other").select("_class", "_other", "ratio", none.alias("_j"), F.col("_j").cast("long").alias("_i"))
    at = F.coalesce("_j", "_i")
    rows = mine.unionByName(theirs).withColumn("_range", F.floor(at / RANGE))
    key = ["_class", "_other", "_range"]
    ahead = Window.partitionBy("_class", "_other").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begun = rows.groupBy(*key).agg(F.max("_i").alias("_most")).select(*key, F.max("_most").over(ahead).alias("_begun"))
    inside = Window.partitionBy(*key).orderBy(at, F.col("_j").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    last = rows.withColumn("_i", F.last("_i", ignorenulls=True).over(inside)).where("_j is not null").join(begun, key)
    last = last.withColumn("_i", F.coalesce("_i", "_begun")).where("_i is not null")
    return last.groupBy("_j").agg(F.max_by("ratio", "_i").alias("_ratio"))


def fuzzy_flags(df: DataFrame, columns: Sequence[str], threshold: float, name: str = "is_fuzzy_duplicate", by: Sequence[str] = (), row: str = "row_id", versions: bool = False, ratios: bool = False) -> DataFrame:
    """Flags each row that has an earlier row of a mean ratio above threshold.

    With versions, "duplicate" for flagged rows and "original" for others that a
    later row repeats; with ratios, the ratio to the latest earlier row that it repeats, whose
    cost is the rows of both classes for each link. Without ratios a class needs only the first and last row of those it is linked to.
    """
    links = settled(fuzzy_links(df, columns, threshold, by=by, row=row))
    both = links.select(F.col("a").alias("_class"), F.col("b").alias("_other"), "ratio").unionByName(links.select(F.col("b").alias("_class"), F.col("a").alias("_other"), "ratio"))
    members = _members(df, columns, by, row)
    own = members.where(F.col("_own") > threshold).select("_class", F.col("_class").alias("_other"), F.col("_own").alias("ratio")).distinct()
    both = both.unionByName(own)
    # a class is named by its first row
    ends = both.groupBy("_class").agg(F.min("_other").alias("_first"))
    if versions:
        latest = members.groupBy(F.col("_class").alias("_other")).agg(F.max("_j").alias("_latest"))
        ends = ends.join(both.join(latest, "_other").groupBy("_class").agg(F.max("_latest").alias("_latest")), "_class")
    found = members.join(ends, "_class").select(F.col("_j").alias(row), *ends.columns[1:])
    out = df.join(found, row, "left").withColumn(name, F.coalesce(F.col(row) > F.col("_first"), F.lit(False)))
    if versions:
        out = out.withColumn("version", F.when(F.col(name), "duplicate").when(F.col(row) < F.col("_latest"), "original"))
    if ratios:
        out = out.join(_latest_before(both, members).select(F.col("_j").alias(row), F.col("_ratio").alias("fuzzy_ratio")), row, "left")
    kept = [*df.columns, *(["fuzzy_ratio"] if ratios else []), name, *(["version"] if versions else [])]
    return out.select(*[F.col(f"`{c}`") for c in kept])


def staged_flags(df: DataFrame, columns: Sequence[str], threshold: float, row: str = "row_id") -> DataFrame:
    """Exact duplicates first, fuzzy ones among the rest; is_duplicate and is_fuzzy_duplicate."""
    exact = exact_flags(df, columns, row=row)
    fuzzy = fuzzy_flags(exact.where("not is_duplicate"), columns, threshold, row=row).select(row, "is_fuzzy_duplicate")
    return exact.join(fuzzy, row, "left").withColumn("is_fuzzy_duplicate", F.coalesce("is_fuzzy_duplicate", F.lit(False)))


def sweep(df: DataFrame, columns: Sequence[str], thresholds: Sequence[float], row: str = "row_id") -> DataFrame:
    """A flag for each threshold from one comparison at the lowest."""
    found = fuzzy_links(df, columns, min(thresholds), row=row).groupBy(F.col("b").alias("_class")).agg(F.max("ratio").alias("_best"))
    out = df.join(_members(df, columns, (), row).withColumnRenamed("_j", row), row).join(found, "_class", "left")
    best = F.greatest(F.when(F.col(row) != F.col("_class"), F.col("_own")), F.coalesce("_best", F.lit(0.0)))
    return out.select(*df.columns, *[(best > t).alias(f"above_{t:g}") for t in thresholds])


def flag_totals(df: DataFrame, flags: dict[float, str]) -> DataFrame:
    """threshold, n and percent of rows whose flag is set, for each threshold's flag."""
    of = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(f)).alias("n"), F.round(100.0 * F.count_if(F.col(f)) / F.count("*"), 6).alias("percent")) for t, f in flags.items()]
    return df.agg(F.array(*of).alias("_of")).select(F.inline("_of"))


def pair_report(df: DataFrame, columns: Sequence[str], low: float, high: float, row: str = "row_id") -> DataFrame:
    """Each row's later partners of a mean ratio within [low, high), as an array of (row, ratio)."""
    links = fuzzy_links(df, columns, low, strict=False, high=high, row=row)
    return links.groupBy(F.col("a").alias(row)).agg(F.sort_array(F.collect_list(F.struct(F.col("b").alias("row"), "ratio"))).alias("partners"))


def audit(df: DataFrame, flag: str, low: float, question: str, columns: Sequence[str], row: str = "row_id", many: int = 4, high: float = 80) -> DataFrame:
    """Each flagged row with whether another row is like it above low, by its question or else by all columns, and whether more than many are above high."""

    def found(own: Sequence[str], name: str) -> DataFrame:
        links = settled(fuzzy_links(df, own, low, strict=False, row=row))
        members = _members(df, own, (), row)
        size = members.groupBy("_class").agg(F.count("*").alias("_s"), F.min("_own").alias("_own"))
        both = links.select(F.col("a").alias("_class"), F.col("b").alias("_o"), "ratio").unionByName(links.select(F.col("b").alias("_class"), F.col("a").alias("_o"), "ratio"))
        rest = both.join(size.select(F.col("_class").alias("_o"), "_s"), "_o").groupBy("_class").agg(F.sum("_s").alias("_l"), F.sum(F.when(F.col("ratio") >= high, F.col("_s")).otherwise(0)).alias("_h"))
        # a class's copies are like each other unless their texts are missing
        copies = size.select("_class", (F.col("_s") - 1).alias("_c"), "_own")
        hits = copies.join(rest, "_class", "left")
        of = lambda c, t: F.coalesce(c, F.lit(0)) + F.when(F.col("_own") >= t, F.col("_c")).otherwise(0)
        hits = hits.select("_class", of("_l", low).alias(name), of("_h", high).alias(f"{name}_high"))
        return members.join(hits, "_class").select(F.col("_j").alias(row), name, f"{name}_high")

    out = df.where(F.coalesce(F.col(flag), F.lit(False))).select(row).join(found([question], "_q"), row).join(found(columns, "_a"), row)
    return out.select(row, ((F.col("_q") > 0) | (F.col("_a") > 0)).alias("has_match"), ((F.col("_q_high") > many) | (F.col("_a_high") > many)).alias("many_matches"))


def similar_to(df: DataFrame, text: str, column: str, threshold: float) -> DataFrame:
    """Rows of a ratio above threshold to one text, with the ratio."""
    return df.withColumn("ratio", fuzz_ratio(F.col(column), F.lit(text))).where(F.col("ratio") > threshold)


def fuzzy_matches(queries: DataFrame, known: DataFrame, query: str, text: str, low: float, high: float = 100.0, most_queries: int = 10_000) -> DataFrame:
    """Rows of known within [low, high] of each query text.

    Ratios are found between different texts, so copies are compared once. Known rows of one text are dealt into lists of about COPIES; a query meets
    the lists of its partners and these are opened last, so no join forms the rows of the result and no list grows with the input. Texts meet by bands
    of length, of which each query has all that allow the ratio. Up to most_queries texts of SENT bytes are sent to all tasks; more are dealt in blocks
    of that number, and each known text meets every block of its band.
    """
    a, b = F.length("_x"), F.length("_y")
    fits = 200 * F.least(a, b) >= (low - 0.5) * (a + b)
    banded = low > 0.5
    band = lambda length: F.floor(F.log(F.greatest(length, F.lit(1))) / BAND).cast("int") if banded else F.when(length >= 0, 0)
    reach = math.ceil(math.log((200 - low + 0.5) / (low - 0.5)) / BAND) + 1 if banded else 0
    asked = queries.select(F.col(query).alias("_x")).where("_x is not null").distinct()
    at = known.columns.index(text)
    rows = settled(known.toDF(*[f"_k{k}" for k in range(len(known.columns))]).withColumnRenamed(f"_k{at}", "_y").where("_y is not null"))
    there = settled(rows.groupBy("_y").agg(F.count("*").alias("_n"), F.ceil(F.count("*") / COPIES).cast("int").alias("_lists")))
    dealt = asked.withColumn("_band", F.explode(F.sequence(band(a) - reach, band(a) + reach)))
    # few texts are still compared by all tasks
    places = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = there.repartition(places).withColumn("_band", band(b))
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_x")), F.lit(0))).first()
    if n <= most_queries and size * (2 * reach + 1) <= SENT:
        joined = placed.join(F.broadcast(dealt), "_band")
    else:
        blocks = F.lit(max(2, math.ceil(n / most_queries)))
        dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("_x"), blocks).cast("int"))
        joined = placed.withColumn("_block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))).join(dealt, ["_band", "_block"])
    like = settled(joined.where(fits).select("_x", "_y", "_n", "_lists", fuzz_ratio("_x", "_y").alias("_ratio")).where(F.col("_ratio").between(low, high)))
    # rows that agree in all columns are told apart by their place in the settled table
    listed = rows.withColumn("_at", F.xxhash64(F.monotonically_increasing_id())).join(there.drop("_n"), "_y").withColumn("_list", F.pmod("_at", "_lists").cast("int"))
    others = [f"_k{k}" for k in range(len(known.columns)) if k != at]
    listed = listed.groupBy("_y", "_list").agg(F.collect_list(F.struct(*others or [F.lit(True).alias("_there")])).alias("_rows"))
    asking = queries.toDF(*[f"_q{k}" for k in range(len(queries.columns))])
    partners = asking.join(like, F.col(f"_q{queries.columns.index(query)}") == F.col("_x")).withColumn("_list", F.explode(F.sequence(F.lit(0), F.col("_lists") - 1)))
    # lists are small for what they open into, so places are numbered by the rows of the result
    n = partners.agg(F.sum(F.col("_n") / F.col("_lists"))).first()[0] or 0
    places = max(places, math.ceil(n / OPENED))
    opened = partners.repartition(places, "_y", "_list").join(listed.repartition(places, "_y", "_list"), ["_y", "_list"]).select("_y", *asking.columns, "_ratio", F.inline("_rows"))
    return opened.select(
        *[F.col("_y" if k == at else f"_k{k}").alias(c) for k, c in enumerate(known.columns)],
        *[F.col(f"_q{k}").alias(c) for k, c in enumerate(queries.columns)],
        F.col("_ratio").alias("ratio"),
    )


def candidate_report(queries: DataFrame, known: DataFrame, query: str, text: str, low: float, high: float = 100.0, row: str = "row_id", seed: str | None = None) -> DataFrame:
    """Each query with the rows of known within [low, high], best first, as an array of (row, ratio); with seed, a query's own row of that number stands first."""
    found = fuzzy_matches(queries.select(query).distinct(), known, query, text, low, high)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("ratio")).alias("_r"), F.col(row).alias("row"), "ratio")))
    partners = F.transform(listed, lambda x: F.struct(x["row"].alias("row"), x["ratio"].alias("ratio")))
    by = found.groupBy(query).agg(partners.alias("partners"))
    if seed is None:
        return by
    own = F.array(F.struct(F.col(seed).alias("row"), F.lit(100).alias("ratio")))
    rest = F.filter(F.coalesce("partners", F.array().cast("array<struct<row:bigint,ratio:int>>")), lambda x: x["row"] != F.col(seed))
    return queries.join(by, query, "left").select(seed, query, F.concat(own.cast("array<struct<row:bigint,ratio:int>>"), rest).alias("partners"))


def in_order(df: DataFrame, column: str, row: str = "row_id", by: Sequence[str] = ()) -> DataFrame:
    """Whether a column never falls from a row to the next in the order of rows, by group; a missing value is neither above nor below.

    A group of many rows is dealt to ranges of row numbers, each of which knows the last value before it.
    """
    held = df.select(*by, F.col(row).cast("long").alias("_at"), F.struct(F.col(column).alias("v")).alias("_value"))
    if not by:
        held = held.withColumn("_all", F.lit(0))
    keys = list(by) or ["_all"]
    seen = with_last(with_range(held, keys, "_at"), keys, ["_at"], "_value", "_before", inclusive=False)
    ok = F.coalesce(F.col("_value.v") >= F.col("_before.v"), F.lit(True))
    return seen.withColumn("_ok", ok).groupBy(*by).agg(F.bool_and("_ok").alias("in_order"))


def register(spark) -> None:
    """fuzz_ratio(a, b) for SQL."""
    spark.udf.register("fuzz_ratio", fuzz_ratio)


def either(*flags: Column) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out
