"""Joins that look values up, with the rules on missing, repeated and many matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_match(df: DataFrame, keys: DataFrame, on: str, order: str, values: Sequence[str], must: bool = False) -> DataFrame:
    """The values of the first row of keys with the same key; with must, a row without one is an error when it runs."""
    first = keys.groupBy(on).agg(F.min_by(F.struct(*values), F.col(order)).alias("_found"))
    out = df.join(first, on, "left")
    if must:
        miss = F.raise_error(F.concat(F.lit(f"no match for {on} "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
        out = out.withColumn("_found", F.when(F.col("_found").isNull(), miss.cast(dict(first.dtypes)["_found"])).otherwise(F.col("_found")))
    return out.select("*", *[F.col("_found")[v].alias(v) for v in values]).drop("_found")


def mean_lookup(df: DataFrame, scores: DataFrame, left: str, right: str, value: str, name: str) -> DataFrame:
    """The mean of all scores of a row's key; null without any."""
    means = scores.groupBy(F.col(right).alias(left)).agg(F.avg(value).alias(name))
    return df.join(means, left, "left")


def mean_over_list(df: DataFrame, scores: DataFrame, row: str, keys: str, right: str, value: str, name: str) -> DataFrame:
    """The mean over all of a row's keys that have a score, a key given twice counting twice; null without any."""
    means = scores.groupBy(F.col(right).alias("_key")).agg(F.avg(value).alias("_mean"))
    opened = df.select(row, F.explode(keys).alias("_key"))
    found = opened.join(means, "_key").groupBy(row).agg(F.avg("_mean").alias(name))
    return df.join(found, row, "left")


def unmatched(df: DataFrame, scores: DataFrame, left: str, right: str) -> DataFrame:
    """How many rows, and how many distinct keys, have no match."""
    missing = df.join(scores.select(F.col(right).alias(left)).distinct(), left, "left_anti")
    return missing.agg(F.count("*").alias("rows"), F.count_distinct(left).alias("keys"))


def delete_unique(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is wanted, where the key occurs once in df; a key that repeats stays."""
    once = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key)
    gone = wanted.select(key).distinct().join(once, key, "left_semi")
    return df.join(gone, key, "left_anti")


def exactly_one(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key with its value; a key with another number of values than one is an error when it runs."""
    n = F.count_distinct(value)
    bad = F.raise_error(F.concat(F.lit(f"not one {value} for "), F.col(key).cast("string"))).cast("string")
    return df.groupBy(key).agg(n.alias("_n"), F.min(value).alias("_v")).select(key, F.when(F.col("_n") != 1, bad).otherwise(F.col("_v").cast("string")).alias(value))


def with_override(general: DataFrame, local: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cached rows of both places; a group of rows that the local place has replaces the general one's."""
    return general.join(local.select(*keys).distinct(), list(keys), "left_anti").unionByName(local)


def same_keys(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of one schema hold the same set of rows."""
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def pick_rows(df: DataFrame, places: DataFrame, row: str = "row_id", order: str = "pos") -> DataFrame:
    """Rows by a list of places (order, row), in its order, repeats kept."""
    return places.join(df, row).orderBy(order)


def subsets_of_categories(df: DataFrame, mapping: DataFrame, level: str | None = None) -> DataFrame:
    """Rows joined to the benchmark files that a mapping (category, array of (file, level)) gives their category."""
    files = mapping.select("category", F.explode("subsets").alias("s")).select("category", "s.file", "s.level")
    return df.join(files.where(F.col("level") == level) if level else files, "category")


def collect_by(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each key's values in order, such as a provider's models."""
    listed = F.sort_array(F.collect_list(F.struct(order, value)))
    return df.groupBy(key).agg(F.transform(listed, lambda x: x[value]).alias(f"{value}s"))
