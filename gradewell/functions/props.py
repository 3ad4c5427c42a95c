"""Typed paths into JSON columns, and maps merged by key."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_paths(df: DataFrame, column: str, paths: Mapping[str, tuple[str, str]]) -> DataFrame:
    """df with a column for each path: name -> (path, type). A text that is no JSON, a path that is not there and a value of another kind are null.

    The text is parsed once, into a variant.
    """
    parsed = df.withColumn("_variant", F.explode(F.array(F.try_parse_json(column))))
    return parsed.select(*[F.col(f"`{c}`") for c in df.columns], *[F.try_variant_get("_variant", path, kind).alias(name) for name, (path, kind) in paths.items()])


def merged(a: Column, b: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Two maps as one: a key of both has join of their values, a key of one its own value; a missing map is an empty one."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(join(x, y)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def sums_by_key(df: DataFrame, by: Sequence[str], key: str, value: str, name: str) -> DataFrame:
    """by and a map from each key, a missing one left out, to the sum of its values: added by key before groups meet, so a map is as long as its keys."""
    parts = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.sum(value).alias("_v"))
    return parts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "_v")))).alias(name))
