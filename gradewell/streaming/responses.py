"""Running scores of responses that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions.responses import correct


def arriving(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def once(events: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each response once, however often it is delivered within the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def running_scores(responses: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and bad-format rates so far; the state is one row a group."""
    right = correct(F.col("pred"), F.col("answer")).cast("double")
    return responses.groupBy(*by).agg(F.avg(right).alias("accuracy"), F.avg(F.col("pred").isNull().cast("double")).alias("bad_format"), F.count("*").alias("n"))


def tumbling_counts(events: DataFrame, time: str, width: str, by: list[str], delay: str = "10 minutes") -> DataFrame:
    """Counts by window; a window is final once the watermark has passed it."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
