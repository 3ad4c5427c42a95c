"""Quality rules: a threshold table compiled into one Spark projection.

Edge cases: a null text counts as empty and has no words; an empty text fails
the base rule (fewer than ten words). Repeated rows are judged alike; an empty table
gives no rows. judge() keeps all columns; one that has the name of a measure gives its place to the measure. There is no shuffle so a hot key or a very long text needs no special care.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm._store import table

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: What judge() adds.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_length", "symbol_ratio", "bang_ratio", "stop_word_ratio",
    "duplicate_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio", "base_failed", "kept",
)

#: Frequent function words of the languages that the rules know.
STOP_WORDS = (
    "the of and to a in is that for it was with on by as be this are at from "
    "de la le et les des en un du une que est pour par dans qui sur au pas avec "
    "der die und den von zu das sich mit auf für nicht im ist dem ein eine als "
    "el y los las se del por con no su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text while low <= metric <= high; texts of fewer than min_words words pass."""

    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


RULES = (
    Rule("mean_word_length", 2.5, 12.0, min_words=20),
    Rule("symbol_ratio", high=0.1),
    Rule("bang_ratio", high=0.3, min_words=20),
    Rule("stop_word_ratio", low=0.05, min_words=50),
    Rule("duplicate_line_ratio", high=0.5, min_words=50),
    Rule("bullet_line_ratio", high=0.9, min_words=50),
    Rule("ellipsis_line_ratio", high=0.3, min_words=50),
)


def _deleted(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _with_repeat_words(df: DataFrame, hashes: str, k: int = 5) -> DataFrame:
    """df and n_repeat_words: words in k-word windows that occur twice or more, in time n log n for each text.

    Only texts with a repeat sort their windows; the union of the repeated spans
    is a sum over neighbours, so no pair of equal windows is ever formed. Each
    step is a column of its own: a lambda would evaluate an inlined step again for each element.
    """
    at = lambda i, j: F.get(hashes, i + j)
    windows = F.when(
        F.size(hashes) > k,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[at(i, j) for j in range(k)])),
    ).otherwise(F.array().cast("array<bigint>"))
    out = df.withColumn("_windows", windows)
    pairs = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_order", F.when(repeats, F.sort_array(pairs)).otherwise(F.slice(pairs, 1, 0)))
    near = lambda x, i, j: F.get("_order", i + j)["h"] == x["h"]
    held = F.transform("_order", lambda x, i: F.when(near(x, i, -1) | near(x, i, 1), x["i"]))
    out = out.withColumn("_held", F.sort_array(F.filter(held, lambda x: x.isNotNull())))
    total = F.aggregate(
        "_held",
        F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(k), x - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return out.withColumn("n_repeat_words", total.cast("long"))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df and the counts that the rules are made of: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios."""
    whole = F.coalesce(F.col(text), F.lit(""))
    spaced = F.translate(whole, SPACE, " " * len(SPACE))
    own = [F.col(f"`{c}`") for c in df.columns if c not in MEASURES]
    out = df.select(F.struct(*own or [F.lit(0)]).alias("_row"), whole.alias("_text"), F.filter(F.split(spaced, " ", -1), lambda w: w != "").alias("_words"))
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    out = out.select("*", lines.alias("_lines"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    out = _with_repeat_words(out, "_hashes")
    n, count = F.size("_words"), lambda c: F.greatest(c, F.lit(1)).cast("double")
    words, n_lines = F.col("_words"), F.size("_lines")
    length = F.length("_text")
    word_chars = F.length(_deleted(F.col("_text"), SPACE))
    symbols = length - F.length(_deleted(F.col("_text"), SYMBOLS))
    dup_lines = n_lines - F.size(F.array_distinct("_lines"))
    return out.select(
        *(["_row.*"] if own else []),
        n.cast("long").alias("n_words"),
        word_chars.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (word_chars / count(n)).alias("mean_word_length"),
        (symbols / count(n)).alias("symbol_ratio"),
        ((length - F.length(F.translate("_text", "!", ""))) / count(n)).alias("bang_ratio"),
        (F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))) / count(n)).alias("stop_word_ratio"),
        (dup_lines / count(n_lines)).alias("duplicate_line_ratio"),
        (F.size(F.filter("_lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))) / count(n_lines)).alias("bullet_line_ratio"),
        (F.size(F.filter("_lines", lambda x: x.endswith("...") | x.endswith("…"))) / count(n_lines)).alias("ellipsis_line_ratio"),
    )


def compile_rules(rules=RULES) -> Column:
    """One boolean expression: true where every rule of the table holds."""
    verdict = F.lit(True)
    for r in rules:
        m = F.col(r.metric)
        holds = F.lit(True)
        if r.low is not None:
            holds = holds & (m >= r.low)
        if r.high is not None:
            holds = holds & (m <= r.high)
        verdict = verdict & ((F.col("n_words") < r.min_words) | holds)
    return verdict


def judge(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """measure(), base_failed (under ten words, or over a fifth of them repeated in five-word windows) and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measure(df, text).withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    # the document rides along as one struct, so its columns may have any names; beside a row number, which is
    # not deterministic, the verdict is computed once: the filter does not repeat it below
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_document"), "text")
    judged = judge(whole).select("_document", "kept", F.monotonically_increasing_id().alias("_row"))
    return judged.where("kept and _row >= 0").select("_document.*")
