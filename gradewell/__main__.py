"""Run a benchmark from the command line: question sets and models by their configurations, cached responses, leaderboards as files.

    python -m gradewell --root FOLDER --questions SET... --models CONFIG [--cache FOLDER] [--output FOLDER] [--category NAME] [--offset N]
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from gradewell.operators import evaluation


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gradewell", description=__doc__.split("\n")[0])
    out.add_argument("--root", required=True, help="folder that has configs/ and data/")
    out.add_argument("--questions", nargs="+", required=True, help="names of question sets; one with * stands for all that match")
    out.add_argument("--models", required=True, help="name of the list of models")
    out.add_argument("--cache", help="cached responses, <cache>/<set>/<model>.csv; data/cache of the root if not given")
    out.add_argument("--output", help="folder of the results; data/results of the root if not given")
    out.add_argument("--category", help="one category for all questions, in the place of their own")
    out.add_argument("--offset", type=int, default=0, help="what question ids begin with")
    return out


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    """The ranking as text; accuracy, bad_format and the full table are written below the output folder."""
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("gradewell").getOrCreate()
    sets = [name for q in args.questions for name in (evaluation.configs(args.root, q) if "*" in q else [q])]
    models = evaluation.load_models(args.root, args.models)
    questions = evaluation.load_sets(spark, args.root, sets, args.category)
    cached = evaluation.read_caches(spark, args.cache or str(Path(args.root) / "data" / "cache"), sets, list(models))
    if cached is None:
        raise SystemExit("no cached responses: ask a provider first (gradewell.sources.providers)")
    done = evaluation.run(questions, list(models), evaluation.after_examples(cached, questions), settle=True)
    categories = sorted(r.category for r in questions.where("not is_example").select("category").distinct().collect() if r.category is not None)  # one for each set
    target = args.output or str(Path(args.root) / "data" / "results")
    return evaluation.publish(done, categories, f"{target}/{args.models}", models, args.offset)


if __name__ == "__main__":
    print(main())
