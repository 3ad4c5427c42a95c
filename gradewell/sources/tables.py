"""Reading question sets, responses and results; writing leaderboards."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path, PureWindowsPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.functions.cleaning import missing_to_null
from gradewell.sources.providers import KEYS, Retry, answer

QUESTION_COLUMNS = ("Source", "Question", *[f"Answer {x}" for x in "ABCDEFG"], "Correct answer")


def strings(*names: str) -> T.StructType:
    """A schema of text columns: nothing is inferred, so "10" stays "10"."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], header: bool = True, sep: str = ",", missing: bool = True) -> DataFrame:
    """Quoted texts may hold line breaks; cells that say they are missing become null."""
    options = {"header": header, "multiLine": True, "quote": '"', "escape": '"', "sep": sep, "enforceSchema": True}
    df = spark.read.options(**options).schema(strings(*columns)).csv(list(path) if not isinstance(path, str) else path)
    return missing_to_null(df) if missing else df


def read_csv_without_long_rows(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";") -> DataFrame:
    """Rows of too many fields are skipped, rows of too few are kept with nulls."""
    options = {"header": True, "sep": sep, "mode": "PERMISSIVE", "enforceSchema": True}
    df = spark.read.options(**options).schema(strings(*columns, "_overflow")).csv(path)
    return missing_to_null(df.where("_overflow is null").drop("_overflow"))


def read_files_with_origin(spark: SparkSession, path: str, columns: Sequence[str], marker: str, **options) -> DataFrame:
    """All CSV files below path, with the part of each file's path after marker as column origin."""
    df = spark.read.options(header=True, multiLine=True, escape='"', recursiveFileLookup=True, pathGlobFilter="*.csv", **options).schema(strings(*columns)).csv(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), marker, -1), -1)
    return missing_to_null(df.withColumn("origin", F.url_decode(name)))


def count_rows_by_folder(spark: SparkSession, path: str, prefix: str, columns: Sequence[str]) -> DataFrame:
    """n_rows and n_folders over the first CSV file of each folder whose name has the prefix."""
    df = spark.read.options(header=True, multiLine=True, escape='"', recursiveFileLookup=True, pathGlobFilter="*.csv").schema(strings(*columns)).csv(path)
    at = F.split(F.col("_metadata.file_path"), "/", -1)
    named = df.select(F.get(at, F.size(at) - 2).alias("folder"), F.element_at(at, -1).alias("file")).where(F.col("folder").startswith(prefix))
    by_file = named.groupBy("folder", "file").agg(F.count("*").alias("n"))
    first = by_file.groupBy("folder").agg(F.min_by("n", "file").alias("n"))
    return first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_folders"))


def list_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path, folder, name, bytes of all files below path whose names end with suffix; their contents are not read."""
    files = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(path).select("path", "length")
    at = F.split("path", "/", -1)
    named = files.select("path", F.url_decode(F.get(at, F.size(at) - 2)).alias("folder"), F.url_decode(F.element_at(at, -1)).alias("name"), F.col("length").alias("bytes"))
    return named.where(F.endswith("name", F.lit(suffix)))


def read_json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_pages(spark: SparkSession, path: str, extract, first: int = 1, last: int | None = None) -> DataFrame:
    """path, page, text, error of documents; extract(bytes) yields the text of each page, such as a PDF library or an OCR model gives.

    Where it fails, the pages so far are kept and the one it failed at has the error. One task reads a file; read_page_ranges() of workbooks parts it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    for page, text in enumerate(extract(bytes(content)), start=1):
                        if last is not None and page > last:
                            break
                        rows.append((page, text, None))
                except Exception as e:  # noqa: BLE001 - any failure of a library is a row
                    rows.append((len(rows) + 1, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame([(name, *r) for r in rows if r[0] >= first], columns=["path", "page", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def question_set(test: DataFrame, examples: DataFrame | None, name: str, row: str = "row_id") -> DataFrame:
    """Examples and questions of one set as one table with is_example; both carry row, their place in their file."""
    shown = [] if examples is None else [examples.withColumn("is_example", F.lit(True))]
    asked = test.withColumn("is_example", F.lit(False))
    out = asked
    for e in shown:
        out = e.unionByName(asked, allowMissingColumns=True)
    return out.withColumn("question_set", F.lit(name))


def local_path(text: str | None, root: str | Path) -> Path | None:
    """A path of either system's spelling, looked up as it is and under root/data."""
    if text is None:
        return None
    path = Path(PureWindowsPath(text).as_posix())
    for p in (path, Path(root) / "data" / path):
        if p.exists():
            return p
    raise FileNotFoundError(text)


def read_config(path: str | Path) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def config_text(values: Mapping) -> str:
    """A question set's configuration as YAML."""
    import yaml

    return yaml.safe_dump(dict(values), sort_keys=False, allow_unicode=True)


def ask(prompts: DataFrame, provider, keys: Sequence[str] = KEYS) -> DataFrame:
    """Responses of a provider, asked once each; a failed call is an empty text with success false and its reason."""
    return answer(prompts, provider, keys, retry=Retry(attempts=1))


def write_cache(responses: DataFrame, path: str) -> None:
    """Responses by question set and model; a later write replaces the groups that it holds."""
    responses.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("question_set", "model_id").parquet(path)


def write_leaderboard(table: DataFrame, path: str) -> None:
    # one file; the exchange keeps the work before it apart from the one task that writes
    table.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(records: DataFrame, path: str) -> None:
    """A JSON object a line; a number that is not one fails the write."""
    checked = records
    for c, t in records.dtypes:
        if t in ("double", "float"):
            nan = F.raise_error(F.lit(f"{c} is not a number")).cast(t)
            checked = checked.withColumn(c, F.when(F.isnan(c), nan).otherwise(F.col(c)))
    checked.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, category: str = "category") -> None:
    """Test and example questions of each category in folders of their own."""
    from gradewell.functions.cleaning import slug

    out = df.withColumn("split", F.when(F.col("is_example"), "dev").otherwise("test")).withColumn("category_slug", slug(F.col(category)))
    out.write.mode("overwrite").option("header", True).partitionBy("split", "category_slug").csv(path)


def markdown(table: DataFrame, sort: str) -> str:
    """A leaderboard as text, best first: every row, fetched part by part."""
    rows = table.orderBy(F.desc(sort), *[c for c in table.columns if c != sort]).toLocalIterator()
    lines = [table.columns, ["---"] * len(table.columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
