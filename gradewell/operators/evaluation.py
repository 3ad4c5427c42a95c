"""A benchmark's whole run: questions and models, cached or asked responses, scores, predictions beside the questions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions.responses import with_prompts
from gradewell.operators import scoring
from gradewell.operators.columns import column_at, numbered
from gradewell.operators.lookups import with_override
from gradewell.sources import tables
from gradewell.sources.shared import settled
from gradewell.sources.providers import Limit, Retry, answer, answer_into

#: What a few-shot example has in the place of a prediction.
EXAMPLE = "Few-shot example"
GROUP = ["question_set", "model_id"]


@dataclass(frozen=True)
class Run:
    """responses: one row a question and model, with pred; summary: rates by set and model; full: questions with a prediction column for each model."""

    responses: DataFrame
    summary: DataFrame
    full: DataFrame


def load_questions(spark: SparkSession, root: str | Path, name: str, columns: Sequence[str] = tables.QUESTION_COLUMNS) -> DataFrame:
    """The question set of configs/questions/<name>.yaml: its examples, then its questions, with row_id, is_example, question, choices c1.. and answer.

    Files are read by place, so their headings may have any names; an example file's rows are those of example_rows.
    """
    config = tables.read_config(Path(root) / "configs" / "questions" / f"{name}.yaml")
    wanted = list(config.get("example_rows") or [])

    def rows(key: str) -> DataFrame | None:
        path = tables.local_path(config.get(f"{key}_file"), root)
        if path is None:
            return None
        header = config.get(f"{key}_header") is not None
        # one file is one partition, whose rows are numbered in order
        df = tables.read_csv(spark, str(path), [*columns, "Category"], header=header).withColumn("row_id", F.monotonically_increasing_id())
        cells = {f"c{i}": column_at(df, c) for i, c in enumerate(config["choice_cols"], start=1)}
        return df.select("row_id", column_at(df, config["question_col"]).alias("question"), *[c.alias(n) for n, c in cells.items()], column_at(df, config["answer_col"]).alias("answer"), "Category")

    test, examples = rows("test"), rows("example")
    shown = None
    if examples is not None and wanted:
        shown = examples.where(F.col("row_id").isin(wanted))
        test = test.withColumn("row_id", F.col("row_id") + len(wanted))
    return tables.question_set(test, shown, name).withColumnRenamed("Category", "category")


def load_models(root: str | Path, name: str) -> dict[str, str]:
    """Model ids and their shown names, from configs/models/<name>.yaml."""
    return {str(k): str(v) for k, v in (tables.read_config(Path(root) / "configs" / "models" / f"{name}.yaml") or {}).items()}


def configs(root: str | Path, pattern: str = "*") -> list[str]:
    """Names of question sets whose files match, in all folders below configs/questions."""
    return sorted(p.stem for p in (Path(root) / "configs" / "questions").rglob(f"{pattern}.yaml"))


def run(questions: DataFrame, models: Sequence[str], cached: DataFrame | None = None, local: DataFrame | None = None, provider: Callable[[str, str], str] | None = None, cache: str | None = None, choices: Sequence[str] = ("c1", "c2", "c3", "c4"), limits: Mapping[str, Limit] | None = None, retry: Retry = Retry(attempts=1), settle: bool = False) -> Run:
    """Cached responses where a set and model have any, a local group before a general one; the provider is asked for the others.

    questions: question_set, row_id, is_example, question, choices, answer. cached and local: question_set, model_id, row_id, resps. Given a
    cache folder, what the provider said is written there part by part, and a run that is started again asks only for what is not there. Groups that neither has are left out. With settle, parsed responses are stored
    once for all that is made of them.
    """
    held = cached if local is None else with_override(cached, local, GROUP) if cached is not None else local
    names = F.array(*[F.lit(m) for m in models])
    asked = questions.where(~F.coalesce(F.col("is_example"), F.lit(False)))
    columns = ["question_set", "model_id", "row_id", "resps"]
    if held is not None:
        held = held.where(F.col("model_id").isin(list(models))).select(*columns)
    if provider is not None:
        prompts = with_prompts(questions, "question", choices, "answer", "question_set").select("question_set", "row_id", "prompt", F.explode(names).alias("model_id"))
        if held is not None:
            prompts = prompts.join(held.select(*GROUP).distinct(), GROUP, "left_anti")
        said = answer(prompts, provider, limits=limits, retry=retry) if cache is None else answer_into(prompts, provider, cache, limits, retry)
        held = said.select(*columns) if held is None else held.unionByName(said.select(*columns))
    answered = asked.select("question_set", "row_id", "category", F.col("answer").alias("answers")).join(held, ["question_set", "row_id"])
    responses = settled(scoring.parsed(answered)) if settle else scoring.parsed(answered)
    summary = scoring.score(responses, GROUP)
    wide = responses.groupBy("question_set", "row_id").pivot("model_id", list(models)).agg(F.first("pred"))
    full = questions.join(wide.toDF("question_set", "row_id", *[f"pred_{m}" for m in models]), ["question_set", "row_id"], "left")
    full = full.select(*questions.columns, *[F.when(F.col("is_example"), EXAMPLE).otherwise(F.col(f"`pred_{m}`")).alias(f"pred_{m}") for m in models])
    return Run(responses, summary, full)


def leaderboard(done: Run, categories: Sequence[str], shown: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """accuracy and bad_format in percent: a row for each model, a column for each category, and Overall over all questions."""
    grains = scoring.score_grains(done.responses, [["model_id", "category"], ["model_id"]])
    named = grains.withColumn("category", F.when(F.col("grain") == 0, F.col("category")).otherwise("Overall"))
    if shown:
        from gradewell.functions.cleaning import lookup

        named = named.withColumn("model_id", lookup(F.col("model_id"), shown))
    columns = [*categories, "Overall"]
    return scoring.wide_table(named, "model_id", "category", "accuracy", columns), scoring.wide_table(named, "model_id", "category", "bad_format", columns)


def questions_per_category(questions: DataFrame) -> DataFrame:
    """category, n: questions without their few-shot examples."""
    return questions.groupBy("category").agg(F.count_if(~F.coalesce(F.col("is_example"), F.lit(False))).alias("n"))


def scored_questions(done: Run, offset: int = 0) -> DataFrame:
    """Questions with predictions, without examples, and question_id: the row's place among all sets' rows, so examples leave gaps."""
    key = F.struct("question_set", "row_id")
    placed = numbered(done.full.withColumn("_key", key), "_key", "question_id", start=offset).drop("_key")
    return placed.where(~F.coalesce(F.col("is_example"), F.lit(False)))


def collect_runs(runs: Mapping[str, Run], kinds: Sequence[str] | None = None) -> DataFrame:
    """Responses of several runs as one table with the run's name; names that are not among kinds are an error."""
    if kinds is not None and (other := set(runs) - set(kinds)):
        raise ValueError(f"unknown experiments: {sorted(other)}")
    out = None
    for name, r in runs.items():
        own = r.responses.withColumn("experiment", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


@dataclass(frozen=True)
class Collected:
    """accuracy and bad_format: a row for each model, a column for each set; sizes: questions of each set without its examples; full: all of them with predictions."""

    accuracy: DataFrame
    bad_format: DataFrame
    sizes: DataFrame
    full: DataFrame


def collect_sets(done: Run, sets: Sequence[str]) -> Collected:
    """The rates of several question sets that one run answered, each set being a category of its own; models that a set lacks are null there."""
    by_set = scoring.score(done.responses, GROUP)
    wide = [scoring.wide_table(by_set, "model_id", "question_set", rate, list(sets)) for rate in ("accuracy", "bad_format")]
    asked = done.full.where(~F.coalesce(F.col("is_example"), F.lit(False))).withColumn("category", F.col("question_set"))
    return Collected(*wide, asked.groupBy("question_set").agg(F.count("*").alias("n")), asked)


def load_sets(spark: SparkSession, root: str | Path, names: Sequence[str], category: str | None = None, guard: bool = True) -> DataFrame:
    """Several question sets as one table, told apart by question_set. With a category all rows have it; else, with guard, a set of several categories is an error."""
    out = None
    for name in names:
        own = load_questions(spark, root, name)
        if category is not None:
            own = own.withColumn("category", F.lit(category))
        elif guard and own.where("not is_example").select("category").distinct().limit(2).count() > 1:
            raise ValueError(f"more than one category in {name}")
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no question sets")
    return out


def read_caches(spark: SparkSession, folder: str, sets: Sequence[str], models: Sequence[str]) -> DataFrame | None:
    """Cached responses <folder>/<set>/<model>.csv (answers, resps, success), their rows numbered after the examples of their set by cached_rows(); None if there are none."""
    found = None
    for name in sets:
        for model in models:
            path = Path(folder) / name / f"{model}.csv"
            if path.exists():
                # one file is one partition, whose rows are numbered in order
                own = tables.read_csv(spark, str(path), ["answers", "resps", "success"], missing=False).select(F.lit(name).alias("question_set"), F.lit(model).alias("model_id"), F.monotonically_increasing_id().alias("row_id"), "resps")
                found = own if found is None else found.unionByName(own)
    return found


def after_examples(cached: DataFrame, questions: DataFrame) -> DataFrame:
    """Cached responses with the row numbers of their questions: a cache has no rows for the examples, which come first."""
    shown = questions.where("is_example").groupBy("question_set").agg(F.count("*").alias("_shown"))
    moved = cached.join(F.broadcast(shown), "question_set", "left")  # a row for each question set of one run
    return moved.withColumn("row_id", F.col("row_id") + F.coalesce("_shown", F.lit(0))).drop("_shown")


def publish(done: Run, categories: Sequence[str], path: str, shown: Mapping[str, str] | None = None, offset: int = 0) -> str:
    """Writes accuracy, bad_format and the full table as CSV below path, and gives the ranking as text."""
    accuracy, bad = leaderboard(done, categories)
    tables.write_leaderboard(accuracy, f"{path}/accuracy")
    tables.write_leaderboard(bad, f"{path}/bad_format")
    scored_questions(done, offset).write.mode("overwrite").option("header", True).csv(f"{path}/full")
    return tables.markdown(leaderboard(done, categories, shown)[0].select("model_id", "Overall"), "Overall")


def experiment_configs(files: Sequence[str], template: Mapping, counts: Mapping[str, int], prefix: str = "", suffix: str = "_test") -> dict[str, str]:
    """Configuration texts of question files by name: <prefix><name><suffix>.csv has its examples, of which counts tells the number, in the file with _dev for _test."""
    out = {}
    for f in sorted(files):
        p = Path(f)
        if p.suffix != ".csv" or not p.stem.startswith(prefix) or not p.stem.endswith(suffix):
            continue
        name = p.stem.removesuffix(suffix)
        example = f.replace("test", "dev")
        out[name] = tables.config_text({**template, "test_file": f.replace("data/", ""), "example_file": example.replace("data/", ""), "example_rows": list(range(counts.get(name, 0)))})
    return out


def write_configs(spark: SparkSession, folder: str | Path, target: str | Path, template: Mapping, prefix: str = "", suffix: str = "_test") -> list[Path]:
    """experiment_configs() of the files in <folder>/test as YAML files in target; the rows of <folder>/dev tell how many examples each has."""
    files = [f"{folder}/test/{p.name}" for p in sorted((Path(folder) / "test").glob("*.csv"))]
    rows = spark.read.options(header=True, multiLine=True, escape='"').csv(str(Path(folder) / "dev")) if (Path(folder) / "dev").exists() else None
    counts = {}
    if rows is not None:
        named = rows.groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")).agg(F.count("*").alias("n"))
        counts = {Path(unquote(r.file)).stem.replace("dev", "test").removesuffix(suffix): r.n for r in named.collect()}  # a row for each file
    Path(target).mkdir(parents=True, exist_ok=True)
    out = []
    for name, text in experiment_configs(files, template, counts, prefix, suffix).items():
        out.append(Path(target) / f"{name}.yaml")
        out[-1].write_text(text, encoding="utf-8")
    return out
