"""Columns by place and name, rows by number: the table edits that question files need."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.sources.shared import settled


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


def column_at(df: DataFrame, place: int) -> Column:
    """The column at a place, negative ones counting from the end."""
    return _named(df.columns[place])


def insert_columns(df: DataFrame, place: int, columns: Mapping[str, Column]) -> DataFrame:
    """df with new columns before the one at place."""
    own = [_named(c) for c in df.columns]
    return df.select(*own[:place], *[c.alias(name) for name, c in columns.items()], *own[place:])


def drop_columns(df: DataFrame, names: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
    """df without named columns, if it has them, and without those that begin with a prefix."""
    return df.select(*[_named(c) for c in df.columns if c not in names and not c.startswith(tuple(prefixes))])


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in this order; a name that df lacks is an error."""
    return df.select(*map(_named, names))


def rename_at(df: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """New names by place."""
    return df.toDF(*[names.get(i, c) for i, c in enumerate(df.columns)])


def without_rows(df: DataFrame, rows: Sequence[int], row: str = "row_id") -> DataFrame:
    """df without the rows of a list that the caller holds."""
    listed = df.sparkSession.createDataFrame([(r,) for r in rows], f"`{row}` {dict(df.dtypes)[row]}")
    return df.join(F.broadcast(listed), row, "left_anti")  # as long as the argument


def from_row(df: DataFrame, first: int, row: str = "row_id") -> DataFrame:
    """Rows from a number on, such as those below a second heading."""
    return df.where(_named(row) >= first)


def preview(df: DataFrame, n: int, row: str = "row_id", last: bool = False) -> DataFrame:
    """The first or last n rows."""
    return df.orderBy(_named(row).desc() if last else _named(row)).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """n_rows and n_columns."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in each of the columns."""
    return df.na.drop(subset=list(columns))


def flagged(df: DataFrame, flag: str, complement: bool = False) -> DataFrame:
    """Rows whose flag is set, or with complement all others: a missing flag is not set."""
    held = F.coalesce(_named(flag), F.lit(False))
    return df.where(~held if complement else held)


def without_topic(df: DataFrame, column: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose text does not hold the pattern, and the others; a missing text holds nothing."""
    marked = df.withColumn("_hit", F.coalesce(_named(column).rlike(pattern), F.lit(False)))
    return marked.where("not _hit").drop("_hit"), marked.where("_hit").drop("_hit")


def for_inference(df: DataFrame, place: int = 6, letters: str = "EFG", drop: Sequence[str] = ()) -> DataFrame:
    """A question file of four choices in the shape of one of seven: empty choices at their place, other columns dropped."""
    empty = {f"Answer {x}": F.lit(None).cast("string") for x in letters}
    return drop_columns(insert_columns(df, place, empty), drop)


def zipped(lists: Mapping[str, str]) -> Column:
    """Parallel lists (new name: column) as one list of objects."""
    pairs = F.arrays_zip(*[_named(c) for c in lists.values()])
    return F.transform(pairs, lambda x: F.struct(*[x[c].alias(name) for name, c in lists.items()]))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null, as JSON needs it."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(_named(c)), _named(c)).alias(c) if kinds[c] in ("double", "float") else _named(c) for c in df.columns])


def date_stamp(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def numbered(df: DataFrame, order: str, name: str, by: Sequence[str] = (), start: int = 0) -> DataFrame:
    """df with each row's place in the order, by group if given; order tells rows apart.

    Rows are dealt by ranges, numbered within each and moved by what stands before their range: neither a table
    nor a hot group passes through one task.
    """
    ranged = settled(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()))
    at = F.row_number().over(Window.partitionBy("_part", *by).orderBy(order)) - 1
    sizes = ranged.groupBy("_part", *by).agg(F.count("*").alias("_size"))
    # one row for each range and group
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("_part").alias("_p"), *[_named(c).alias(f"_by{i}") for i, c in enumerate(by)], F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_before"))
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        on = on & _named(c).eqNullSafe(F.col(f"_by{i}"))
    out = ranged.withColumn("_at", at).join(before, on)
    return out.select(*[_named(c) for c in df.columns], (F.col("_at") + F.col("_before") + start).alias(name))


def beside(frames: Sequence[DataFrame], row: str = "row_id") -> DataFrame:
    """Tables side by side by row number, each row that any of them has: an outer alignment of any number of tables in one shuffle.

    A row number that one table holds twice is an error when it runs, as are column names that two tables share. Rows without a number align with nothing
    and are left out.
    """
    names = [c for f in frames for c in f.columns if c != row]
    if len(set(names)) < len(names):
        raise ValueError(f"columns of several tables: {sorted({c for c in names if names.count(c) > 1})}")
    parts = None
    for i, f in enumerate(frames):
        own = f.where(_named(row).isNotNull()).select(_named(row), F.struct(*[_named(c) for c in f.columns if c != row], F.lit(True).alias("_there")).alias(f"_t{i}"))
        parts = own if parts is None else parts.unionByName(own, allowMissingColumns=True)
    held = [f"_t{i}" for i in range(len(frames))]
    twice = [F.count(t).alias(f"_n{t}") for t in held]
    met = parts.groupBy(row).agg(*[F.first(t, ignorenulls=True).alias(t) for t in held], F.greatest(*twice, F.lit(0)).alias("_most"))
    bad = F.raise_error(F.concat(F.lit(f"a table has {row} twice: "), _named(row).cast("string")))
    one = F.when(F.col("_most") > 1, bad.cast(dict(met.dtypes)[row])).otherwise(_named(row))
    return met.select(one.alias(row), *[F.col(f"_t{i}.`{c}`").alias(c) for i, f in enumerate(frames) for c in f.columns if c != row])
