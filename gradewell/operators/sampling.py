"""Samples, splits, copies and permutations of question sets. Order is by a hash of the id, so results do not depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.operators.columns import numbered


def draw(row: str, seed: int) -> Column:
    """A row's place in a draw: the MD5 of its id and the seed."""
    return F.md5(F.concat(F.col(row).cast("string"), F.lit(f":{seed}")).cast("binary"))


def sample_rows(df: DataFrame, fraction: float, row: str = "row_id", seed: int = 42) -> DataFrame:
    """Exactly floor(fraction * rows) rows: the first ones by draw().

    Draws are counted in 65,536 ranges; whole ranges are taken by a filter, and only the range in which the share ends is sorted.
    """
    drawn = df.withColumn("_draw", draw(row, seed)).withColumn("_range", F.conv(F.substring("_draw", 1, 4), 16, 10).cast("int"))
    counts = sorted((r["_range"], r["n"]) for r in drawn.groupBy("_range").agg(F.count("*").alias("n")).collect())
    left, last = int(fraction * sum(n for _, n in counts)), -1
    for last, n in counts:
        if n > left:
            break
        left -= n
    else:
        last = 1 << 16
    whole = drawn.where(F.col("_range") < last)
    rest = drawn.where(F.col("_range") == last).orderBy("_draw", row).limit(left)
    return whole.unionByName(rest).select(*df.columns)


def stratified(df: DataFrame, by: str, size: int, row: str = "row_id", seed: int = 42) -> DataFrame:
    """The same number of rows of each category, or all of a smaller one."""
    w = Window.partitionBy(by).orderBy(draw(row, seed), F.col(row))
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= size).drop("_place")


def stratum_size(df: DataFrame, by: str, fraction: float) -> int:
    """Rows of each category that keep about a fraction of all, no more than the smallest category has."""
    found = df.groupBy(by).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.sum("n").alias("total"), F.count("*").alias("kinds")).first()
    return min(found["least"], int(fraction * found["total"] / found["kinds"])) if found["kinds"] else 0


# The age groups that each pool of few-shot examples draws from, in the order of drawing.
POOLS = (
    ("Pre-primary", ("Pre-primary", "Pre-primary, Primary", "All")),
    ("Primary", ("Primary", "Primary, Secondary", "Pre-primary, Primary", "All")),
    ("Secondary", ("Secondary", "Primary, Secondary", "All")),
)


def few_shot(df: DataFrame, n: int, by: str, age: str = "age_group", row: str = "row_id", seed: int = 42, pools=POOLS) -> DataFrame | None:
    """n examples of each category, as many from each pool of age groups, none drawn twice; None unless pools divide n."""
    if n % len(pools):
        return None
    size = n // len(pools)
    taken = None
    for place, (_, groups) in enumerate(pools):
        left = df.where(F.col(age).isin(*groups))
        if taken is not None:
            left = left.join(taken.select(row), row, "left_anti")
        chosen = stratified(left, by, size, row, seed + place).withColumn("pool", F.lit(place))
        taken = chosen if taken is None else taken.unionByName(chosen)
    return taken


def split(df: DataFrame, examples: DataFrame, row: str = "row_id") -> DataFrame:
    """df with is_example set on the rows of examples."""
    marked = examples.select(row).distinct().withColumn("is_example", F.lit(True))
    return df.join(marked, row, "left").withColumn("is_example", F.coalesce("is_example", F.lit(False)))


def replicate(df: DataFrame, copies: int, row: str = "row_id") -> DataFrame:
    """Each row so many times, copies adjacent: rep counts them, and the new row_id is row_id * copies + rep."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn(row, F.col(row) * copies + F.col("rep"))


def pick_replicates(df: DataFrame, run: int, copies: int, by: Sequence[str], row: str = "row_id") -> DataFrame:
    """One copy of each question for a run, by even steps from place run to the last place of the category.

    df has a row for each question and copy, in the order of row, copies adjacent.
    Of n questions, question i gives its copy run + floor((copies - 1 - run) * i / (n - 1)).
    """
    placed = numbered(df, row, "_at", by)
    # one row a category
    sizes = placed.groupBy(*by).agg((F.count("*") / copies).alias("_n"))
    out = placed.join(sizes, list(by))
    i, rep = F.floor(F.col("_at") / copies), F.col("_at") % copies
    step = F.when(F.col("_n") > 1, F.floor((copies - 1 - run) * i / (F.col("_n") - 1))).otherwise(0)
    return out.where(rep == run + step).select(*df.columns)


def swap_answer(choices: Sequence[str], answer: str, new: Column) -> list[Column]:
    """Choice columns with the right answer moved to position new, by swapping two cells, and the key renamed."""
    letters = "ABCDEFG"[: len(choices)]
    cells = F.array(*[F.col(c) for c in choices])
    old_at = F.array_position(F.array(*[F.lit(x) for x in letters]), F.col(answer)).cast("int")
    new_at = F.array_position(F.array(*[F.lit(x) for x in letters]), new).cast("int")
    out = []
    for i, c in enumerate(choices, start=1):
        out.append(F.when(new_at == i, F.get(cells, old_at - 1)).when(old_at == i, F.get(cells, new_at - 1)).otherwise(F.col(c)).alias(c))
    return [*out, new.alias(answer)]


def all_positions(df: DataFrame, choices: Sequence[str], answer: str = "answer", row: str = "row_id") -> DataFrame:
    """Each question once as it is and once for every other position of its answer; variant orders them, the original first."""
    letters = [F.lit(x) for x in "ABCDEFG"[: len(choices)]]
    fanned = df.withColumn("_new", F.explode(F.array(*letters)))
    fanned = fanned.withColumn("variant", F.when(F.col("_new") == F.col(answer), 0).otherwise(F.ascii("_new") - 64 + F.when(F.col("_new") > F.col(answer), -1).otherwise(0)))
    rest = [c for c in df.columns if c not in (*choices, answer)]
    return fanned.select(*rest, "variant", *swap_answer(choices, answer, F.col("_new")))
