"""Joins and frames in time that hold for hot keys: rows of one key are dealt to ranges of time, and what a range needs of those before it is carried over its border.

Edge cases: rows without a key or time match nothing and have no streaks, but stay in the results of left joins and frames with nulls; equal
times lie in one range, so a range grows with rows of the very same time; repeated rows are rows of their own; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 100_000  # rows of a key that one range should hold
CUTS = 5_000  # ranges of a key at most: its cuts are one array
STEP = 2  # interval lengths of one level differ by a factor of 2^STEP at most


def _micros(time: str | Column) -> Column:
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def with_range(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """df and _range: keys of more than ROWS rows are cut at quantiles of the number column at, all others are one range."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > ROWS)
    most = hot.agg(F.max("_n")).first()[0]
    if most is None:
        return df.withColumn("_range", F.lit(0))
    parts = min(math.ceil(most / ROWS), CUTS)
    cuts = F.percentile_approx(at, [k / parts for k in range(1, parts)], max(10_000, 2 * parts)) if parts > 1 else F.array().cast("array<bigint>")
    found = df.join(hot.select(*keys), list(keys), "left_semi").groupBy(*keys).agg(cuts.alias("_cuts"))
    own = F.size(F.filter("_cuts", lambda c: c <= F.col(at)))
    return df.join(found, list(keys), "left").withColumn("_range", F.coalesce(own, F.lit(0))).drop("_cuts")


def with_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, inclusive: bool) -> DataFrame:
    """df and name: the last value that is not null up to each row in the order of its key (before it, unless inclusive). df has _range.

    Ranges are windows of their own; the last value of each is one row of an aggregate, and these are carried on in order.
    """
    group = [*keys, "_range"]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ends = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    ranges = df.groupBy(*group).agg(F.lit(1).alias("_one")).join(ends, group, "left")
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begun = ranges.select(*group, F.last("_last", ignorenulls=True).over(ahead).alias("_begun"))
    out = df.withColumn(name, F.last(value, ignorenulls=True).over(inside)).join(begun, group)
    return out.withColumn(name, F.coalesce(name, "_begun")).drop("_begun")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, values: Sequence[str], within: float | None = None) -> DataFrame:
    """left with the values of the latest row of right of the same keys that is not later, and not more than within seconds earlier; nulls where there is none.

    Of right rows of one time the one with the greatest values counts.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    known = F.lit(True)
    for c in [*keys, time]:
        known = known & F.col(c).isNotNull()
    rows = left.where(known).select(*keys, _micros(time).alias("_at"), F.lit(1).alias("_side"), whole.alias("_row"))
    there = F.lit(True)
    for c in [*keys, right_time]:
        there = there & F.col(c).isNotNull()
    found = right.where(there).select(*keys, _micros(right_time).alias("_at"), F.lit(0).alias("_side"), F.struct(_micros(right_time).alias("_then"), *values).alias("_found"))
    # of one time one row is enough: a hot time of the right side is one row of each key
    found = found.groupBy(*keys, "_at", "_side").agg(F.max("_found").alias("_found"))
    both = with_range(rows.unionByName(found, allowMissingColumns=True), keys, "_at")
    out = with_last(both, keys, ["_at", "_side"], "_found", "_latest", True).where("_side = 1")
    near = F.col("_latest") if within is None else F.when(F.col("_at") - F.col("_latest._then") <= round(within * 1_000_000), F.col("_latest"))
    out = out.select("_row.*", near.alias("_latest")).select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"_latest.{v}").alias(v) for v in values])
    return out.unionByName(left.where(~known), allowMissingColumns=True)


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows of equal keys whose times [start, end) overlap, as structs left and right; each pair once.

    Every interval lies in bins of the power of 2^STEP that is next above its length, two at most. It is offered there, and in the
    bins around it of every greater power that the other side has, so intervals meet at the level of the longer of them: no interval is opened to more
    bins than twice the levels, however long it is, and short ones do not meet in the bins of long ones. Rows that lie outside of the
    times that the other side has for their keys are left out before, and keys and times move once. Empty intervals overlap nothing.
    """
    names = [f"_k{i}" for i in range(len(keys))]

    def placed(df: DataFrame, name: str) -> DataFrame:
        a, b = _micros(start), _micros(end)
        own = df.where(b > a).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], a.alias("_a"), b.alias("_b"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in _moved(df)]).alias(name))
        return own.withColumn("_level", (F.ceil(F.log2((F.col("_b") - F.col("_a")).cast("double")) / STEP) * STEP).cast("int"))

    def _moved(df: DataFrame) -> dict[str, str]:
        """Columns that a row is given back from its keys and times."""
        kinds = dict(df.dtypes)
        return {t: f for t, f in ((start, "_a"), (end, "_b")) if kinds[t] == "timestamp"} | dict(zip(keys, names, strict=True))

    def near(df: DataFrame, other: DataFrame) -> DataFrame:
        """Rows within the times of the other side's rows of their keys."""
        known = other.groupBy(*names).agg(F.min("_a").alias("_first"), F.max("_b").alias("_last"))
        found = df.join(known, names) if names else df.crossJoin(F.broadcast(known))
        return found.where((F.col("_a") < F.col("_last")) & (F.col("_b") > F.col("_first"))).drop("_first", "_last")

    x, y = placed(left, "left"), placed(right, "right")
    x, y = near(x, y), near(y, x)
    # 64 at most
    levels = {name: sorted(r[0] for r in df.select("_level").distinct().collect()) for name, df in (("left", x), ("right", y))}
    on = [*names, "_at", "_bin"]

    def bins(df: DataFrame, up: bool, own: bool, at: str) -> DataFrame:
        """Rows by level and bin: of the own level, of greater ones that the side named at has, or both."""
        wanted = F.filter(F.lit(levels[at] or [0]), lambda v: ((v > F.col("_level")) & F.lit(up)) | ((v == F.col("_level")) & F.lit(own)))
        size = F.pow(F.lit(2.0), F.col("_at")).cast("long")
        opened = df.withColumn("_at", F.explode(wanted))
        first, last = F.floor(F.col("_a") / size), F.floor((F.col("_b") - 1) / size)
        return opened.withColumn("_bin", F.explode(F.sequence(first, last))).drop("_level")

    def whole(df: DataFrame, name: str, times: dict[str, str]) -> Column:
        moved = _moved(df)
        back = lambda c: F.timestamp_micros(times[moved[c]]) if moved[c] in times else F.col(moved[c])
        return F.struct(*[(back(c) if c in moved else F.col(f"{name}.`{c}`")).alias(c) for c in df.columns]).alias(name)

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnsRenamed({"_a": "_c", "_b": "_d"})
        later = F.greatest("_a", "_c")
        overlap = (F.col("_a") < F.col("_d")) & (F.col("_c") < F.col("_b"))
        once = F.floor(later / F.pow(F.lit(2.0), F.col("_at")).cast("long")) == F.col("_bin")
        # opened rows do not pass through the driver, however few they are
        pairs = a.join(b.hint("merge"), on).where(overlap & once)
        return pairs.select(whole(left, "left", {"_a": "_a", "_b": "_b"}), whole(right, "right", {"_a": "_c", "_b": "_d"}))

    return met(bins(x, False, True, "left"), bins(y, True, True, "left")).unionByName(met(bins(x, True, False, "right"), bins(y, False, True, "right")))


def rolling(df: DataFrame, keys: Sequence[str], time: str, seconds: float, values: Mapping[str, Callable[[], Column] | tuple[Callable[[], Column], Callable[[Column, Column], Column]]]) -> DataFrame:
    """df with aggregates over the rows of equal keys in the last seconds up to each row's time, rows of that time included.

    Time is cut into stretches of that length. Where every aggregate comes with a function that merges two of its results, a frame is the rest of the stretch before
    and the beginning of its own: both run over their stretch once, so the work does not grow with the rows of a frame. Otherwise
    a row also stands in the next stretch, where it is seen but not kept, and every frame is aggregated anew; no window holds more than two stretches.
    """
    width = round(seconds * 1_000_000)
    known = F.col(time).isNotNull()
    rows = df.where(known).withColumn("_at", _micros(time)).withColumn("_own", F.floor(F.col("_at") / width))
    if all(isinstance(v, tuple) for v in values.values()):
        out = _merged_frames(df, rows, keys, width, values)
    else:
        rows = rows.withColumn("_stretch", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
        w = Window.partitionBy(*keys, "_stretch").orderBy("_at").rangeBetween(-width, 0)
        out = rows.select("*", *[(v[0] if isinstance(v, tuple) else v)().over(w).alias(name) for name, v in values.items()]).where("_own = _stretch")
        out = out.drop("_at", "_own", "_stretch")
    return out.unionByName(df.where(~known), allowMissingColumns=True)


def _merged_frames(df: DataFrame, rows: DataFrame, keys: Sequence[str], width: int, values: Mapping[str, tuple]) -> DataFrame:
    """rolling() by merges: the rest of a stretch from each of its times on is carried a width further, where the first that is not earlier than a row's time is the row's."""
    own = Window.partitionBy(*keys, "_own")
    until = lambda order: own.orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    of = lambda w: F.struct(*[make().over(w).alias(f"v{k}") for k, (make, _) in enumerate(values.values())])
    group = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    held = rows.select(*group, "_own", "_at", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), of(until(F.col("_at"))).alias("_begun"), of(until(-F.col("_at"))).alias("_rest"))
    names = [f"_k{i}" for i in range(len(keys))]
    carried = held.select(*names, (F.col("_own") + 1).alias("_own"), (F.col("_at") + width).alias("_at"), F.lit(0).alias("_side"), "_rest")
    both = held.drop("_rest").withColumn("_side", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    seen = Window.partitionBy(*names, "_own").orderBy(F.col("_at").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_rest", F.last("_rest", ignorenulls=True).over(seen)).where("_side = 1")
    whole = [F.when(F.col("_rest").isNull(), F.col(f"_begun.v{k}")).otherwise(merge(F.col(f"_rest.v{k}"), F.col(f"_begun.v{k}"))).alias(name) for k, (name, (_, merge)) in enumerate(values.items())]
    return out.select("_row.*", *whole)


def added(a: Column, b: Column) -> Column:
    """Merges two counts or sums, of which either may be missing."""
    return F.coalesce(a + b, a, b)


def streaks(df: DataFrame, keys: Sequence[str], time: str, flag: str, tie: str) -> DataFrame:
    """keys, start, end, n of every run of rows whose flag is true, in the order of time and, at one time, of tie; a null flag ends a run."""
    group, order = [*keys, "_range"], ["_at", tie]
    known = F.col(time).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = df.where(known).select(*keys, F.col(time).alias("_time"), _micros(time).alias("_at"), tie, F.coalesce(flag, F.lit(False)).alias("_flag"))
    rows = with_last(with_range(rows, keys, "_at"), keys, order, "_flag", "_before", False)
    rows = rows.withColumn("_opens", (F.col("_flag") & ~F.coalesce("_before", F.lit(False))).cast("long"))
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    opened = rows.groupBy(*group).agg(F.sum("_opens").alias("_sum")).select(*group, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_begun"))
    numbered = rows.withColumn("_run", F.sum("_opens").over(inside)).join(opened, group).where("_flag")
    return numbered.groupBy(*keys, (F.col("_run") + F.col("_begun")).alias("_run")).agg(F.min("_time").alias("start"), F.max("_time").alias("end"), F.count("*").alias("n")).drop("_run")
