"""Accuracy and bad-format rates of predictions in long form: one row a question and model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.functions.responses import clean_key, correct, parse_choice


def rates(prediction: str = "pred", answer: str = "answer", scale: float = 1.0) -> list[Column]:
    """accuracy, bad_format and n: a missing prediction is wrong and stays in the count."""
    right = correct(F.col(prediction), F.col(answer)).cast("double")
    bad = F.col(prediction).isNull().cast("double")
    return [(F.avg(right) * scale).alias("accuracy"), (F.avg(bad) * scale).alias("bad_format"), F.count("*").alias("n")]


def score(df: DataFrame, by: Sequence[str], **options) -> DataFrame:
    return df.groupBy(*by).agg(*rates(**options))


def score_grains(df: DataFrame, grains: Sequence[Sequence[str]], scale: float = 100.0, **options) -> DataFrame:
    """Rates at several grains in one pass; a column that a grain lacks is null there, and grain tells the grains apart."""
    columns = list(dict.fromkeys(c for g in grains for c in g))
    sets = [[F.col(c) for c in g] for g in grains]
    grain = F.grouping_id(*columns).alias("grain")
    return df.groupingSets(sets, *[F.col(c) for c in columns]).agg(grain, *rates(scale=scale, **options)).select(*columns, "grain", "accuracy", "bad_format", "n")


def accuracy_by_category(df: DataFrame, categories: Sequence[str] | None = None, column: str = "category", model: str = "model_id", threshold: float = 0.05) -> DataFrame:
    """Rates over the given categories together, in percent; a category given twice counts twice, and rows of no category drop out.

    Models whose bad-format rate reaches the threshold are left out.
    """
    if categories is None:
        held = df.where(F.col(column).isNotNull())
    else:
        wanted = df.sparkSession.createDataFrame([(c,) for c in categories], f"`{column}` string")
        held = df.join(F.broadcast(wanted), column)  # as long as the argument
    return score(held, [model], scale=100.0).where(F.col("bad_format") < threshold * 100)


def parsed(responses: DataFrame, response: str = "resps", answer: str = "answers") -> DataFrame:
    """Responses with pred, the letter read from each, and answer, the cleaned key."""
    return responses.withColumn("pred", parse_choice(F.col(response))).withColumn("answer", clean_key(F.col(answer)))


def wide_table(scores: DataFrame, row: str, column: str, value: str, values: Sequence[str], first_only: bool = False) -> DataFrame:
    """Scores with a column for each of values; with first_only, rows without the first value vanish."""
    out = scores.groupBy(row).pivot(column, list(values)).agg(F.first(value))
    return out.where(F.col(f"`{values[0]}`").isNotNull()) if first_only and values else out


def reliable(df: DataFrame, question: str, by: Sequence[str]) -> DataFrame:
    """Share of questions, in percent, that are right in every one of their copies."""
    right = F.bool_and(correct(F.col("pred"), F.col("answer"))).alias("all_right")
    return df.groupBy(question, *by).agg(right).groupBy(*by).agg((F.avg(F.col("all_right").cast("double")) * 100).alias("reliability"), F.count("*").alias("n"))


def by_position(df: DataFrame, by: Sequence[str], positions: Sequence[str] = "ABCD") -> DataFrame:
    """Accuracy by the position of the right answer; a position without questions is null. One pass: positions are opened after the sums."""
    right = correct(F.col("pred"), F.col("answer")).cast("double")
    of = [F.struct(F.lit(p).alias("position"), F.avg(F.when(F.col("answer") == p, right)).alias("accuracy")) for p in positions]
    return df.groupBy(*by).agg(F.array(*of).alias("_of")).select(*by, F.inline("_of"))


def mean_of_positions(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The plain mean of the accuracies by position, whatever the number of questions of each."""
    return score(df, [*by, "answer"]).groupBy(*by).agg(F.avg("accuracy").alias("accuracy"))


def one_letter(df: DataFrame, letter: str, by: Sequence[str], said: Sequence[str] = ()) -> DataFrame:
    """Accuracy over questions whose answer is one letter, how many predictions could be read, and how many said each given letter."""
    counts = [F.count_if(F.col("pred") == x).alias(f"said_{x}") for x in said]
    return df.where(F.col("answer") == letter).groupBy(*by).agg(F.avg(correct(F.col("pred"), F.col("answer")).cast("double")).alias("accuracy"), F.count("*").alias("n"), F.count("pred").alias("n_read"), *counts)


def counts_by_hue(df: DataFrame, column: str, hue: str) -> DataFrame:
    """Counts by two columns, and by the first alone to order bars by."""
    counts = df.groupBy(column, hue).agg(F.count("*").alias("n"))
    return counts.withColumn("of_category", F.sum("n").over(Window.partitionBy(column)))  # a row for each hue


def arrays_of_question(df: DataFrame, question: str, order: Sequence[str], category: str = "category") -> DataFrame:
    """The category of each question text, or "Multiple", and its answers and predictions as arrays, in the order given."""
    listed = F.sort_array(F.collect_list(F.struct(*order, F.coalesce("pred", F.lit("")).alias("_pred"), "answer", "pred")))
    kinds = F.count_distinct(category) + F.max(F.col(category).isNull().cast("int"))
    out = df.groupBy(question).agg(F.when(kinds == 1, F.min(category)).otherwise("Multiple").alias("category"), F.count("*").alias("copies"), listed.alias("_all"))
    return out.select(question, "category", "copies", F.col("_all.answer").alias("answers"), F.col("_all.pred").alias("preds"))


def category_of_question(df: DataFrame, question: str, category: str = "category") -> DataFrame:
    """The category of each question text, or "Multiple"; null counts as a category of its own."""
    kinds = F.count_distinct(category) + F.max(F.col(category).isNull().cast("int"))
    return df.groupBy(question).agg(F.when(kinds == 1, F.min(category)).otherwise("Multiple").alias("category"), F.count("*").alias("copies"))


def bar_statistics(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """What bars with error bars show: mean, least, most and standard error."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("standard_error"))


def frequencies(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Counts of values, without nulls."""
    return df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))


def flag_shares(df: DataFrame, flags: Sequence[str], *by: str) -> DataFrame:
    """Percentage of rows with each flag; a missing flag is not set."""
    return df.groupBy(*by).agg(*[(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")) * 100).alias(f) for f in flags])


def null_profile(df: DataFrame) -> DataFrame:
    return df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def one_value(df: DataFrame, column: str, message: str = "more than one value") -> DataFrame:
    """df, failing when it runs if the column has two values or more."""
    check = df.agg(F.assert_true(F.count_distinct(column) <= 1, message).alias("_ok"))
    return df.crossJoin(F.broadcast(check)).where("_ok is null").drop("_ok")  # one row
