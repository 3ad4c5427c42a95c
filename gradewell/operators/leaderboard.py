"""Records of leaderboards and the baselines of teachers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.cleaning import cost, decimal_comma, exam_code, second_of_two


def with_registry(scores: DataFrame, models: DataFrame, combined: bool = False) -> DataFrame:
    """Scores with what is known of each model; a model that the registry lacks has nulls."""
    price = cost(F.col("input_cost"), F.col("output_cost"), combined).alias("cost")
    return scores.join(models.select("model_id", "provider", "open", "size", price), "model_id", "left")


def record(*columns: str) -> Column:
    """A row's columns as one JSON object; what is missing is null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def by_provider(models: DataFrame) -> DataFrame:
    """provider, document: its models as JSON."""
    listed = F.sort_array(F.collect_list(F.struct("model_id", "size", "open")))
    return models.groupBy("provider").agg(F.to_json(F.struct(F.count("*").alias("n_models"), listed.alias("models"))).alias("document"))


def teacher_scores(results: DataFrame, old_years: tuple[str, ...] = ("2017", "2018")) -> DataFrame:
    """By year and exam: number of teachers and mean score; later years keep theirs behind a comma, and rows without any drop out."""
    new = F.when(F.col("year").isin(*old_years), decimal_comma(F.col("PROM_DOM_DOCENTE"))).otherwise(second_of_two(F.col("PTJE_FINAL")).try_cast("double"))
    held = results.withColumn("score", new).where(F.col("year").isin(*old_years) | F.col("score").isNotNull())
    out = held.groupBy("year", "CAT_PRUEBA").agg(F.count_distinct("MRUN").alias("n_teachers"), F.avg("score").alias("score_mean"))
    return out.withColumn("exam", exam_code(F.col("CAT_PRUEBA")))


def domain_scores(results: DataFrame, domain: str = "ENSEÑANZA") -> DataFrame:
    """Rows of the domain whose name holds a word."""
    return results.where(F.coalesce(F.col("GLOSA_DOMINIO").contains(domain), F.lit(False)))
