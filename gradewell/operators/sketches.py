"""Distinct counts and quantiles by sketches: made once for the finest groups and united for every coarser one."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG = 15  # 2^LG registers of a distinct count
#: Relative error of a distinct count at six standard deviations (those of united sketches, which are wider than those of a single one, 0.83),
#: so that none of many groups exceeds it, and rank error of a quantile sketch of the default size, in nearly all cases.
DISTINCT_ERROR = 6 * 1.04 / math.sqrt(1 << LG)
RANK_ERROR = 0.0265


def sketched(df: DataFrame, by: Sequence[str], item: str, value: str) -> DataFrame:
    """A row for each finest group: its number of rows and its sketches, which a table can keep."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(item, F.lit(LG)).alias("items"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("values"))


def united(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones, without the rows."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("values").alias("values"))


def estimates(parts: DataFrame, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """n_items and quantiles (null without values) in the place of the sketches."""
    empty = F.kll_sketch_get_n_double("values") == 0
    of = [F.when(~empty, F.kll_sketch_get_quantile_double("values", F.lit(q))).alias(f"q{round(100 * q)}") for q in quantiles]
    own = [c for c in parts.columns if c not in ("items", "values")]
    return parts.select(*own, F.hll_sketch_estimate("items").alias("n_items"), *of)
