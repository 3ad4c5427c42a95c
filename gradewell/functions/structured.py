"""Answers that should be JSON, read by a schema and checked field by field.

A field that a record must have is given by its path; broken records go to a quarantine with every reason, so that they can be
asked for again. Edge cases: a null or empty answer is no JSON; text around the outermost braces (a fence, a remark) is left out;
fields that the schema does not have are ignored; columns of any names ride along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = ("A", "B", "C", "D")
CHOICES = ", ".join(f"{x}: string" for x in LETTERS)
#: A question in two languages, as an answer to the prompt that asks for it.
PARAGRAPH = f"question_spanish string, choices_spanish struct<{CHOICES}>, question_english string, choices_english struct<{CHOICES}>"
PARAGRAPH_FIELDS = tuple(f"{part}_{lang}{choice}" for lang in ("spanish", "english") for part, choice in (("question", ""), *(("choices", f".{x}") for x in LETTERS)))
BROKEN = "_broken"


def json_part(text: Column) -> Column:
    """From the first brace to the last; null if there is none."""
    start, end = F.locate("{", text), F.length(text) - F.locate("}", F.reverse(text)) + 1
    return F.when((start > 0) & F.contains(text, F.lit("}")) & (end > start), F.substring(text, start, end - start + 1))


def read_answers(df: DataFrame, column: str, schema: str = PARAGRAPH, required: Sequence[str] = PARAGRAPH_FIELDS) -> DataFrame:
    """df with answer, a struct of schema, and reasons, an array of what is wrong with it: none for a sound record.

    Reasons are "not JSON", "wrong type" (JSON that the schema cannot hold), and "missing" or "empty" with the path of a required field.
    """
    kind = T.StructType.fromDDL(schema)
    kind = T.StructType([*kind.fields, T.StructField(BROKEN, T.StringType())])
    part = json_part(F.col(f"`{column}`"))
    # an exploded array of one keeps each reading from being repeated for every field that is checked
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), once(part, "_part"))
    read = F.from_json("_part", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    out = out.select("_row", once(F.struct(read.alias("r"), F.try_parse_json("_part").isNull().alias("no_json")), "_x"))
    out = out.select("_row", F.col("_x.r").alias("_read"), F.when(F.col("_x.no_json"), "not JSON").when(F.col(f"_x.r.{BROKEN}").isNotNull(), "wrong type").alias("_whole"))
    checks = [F.col("_whole")]
    for path in required:
        value = F.col(f"_read.{path}")
        checks.append(F.when(F.col("_whole").isNull() & value.isNull(), f"missing {path}").when(F.col("_whole").isNull() & (F.btrim(value.cast("string"), F.lit(" \t\n\r")) == ""), f"empty {path}"))
    answer = F.struct(*[F.col(f"_read.{f}").alias(f) for f in kind.names if f != BROKEN])
    return out.select("_row.*", answer.alias("answer"), F.array_compact(F.array(*checks)).alias("reasons"))


def parted(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound records with their fields as columns, and the quarantine: all else with its reasons."""
    sound = F.size("reasons") == 0
    fields = [F.col(f"answer.{f.name}").alias(f.name) for f in read.schema["answer"].dataType.fields]
    own = [F.col(f"`{c}`") for c in read.columns if c not in ("answer", "reasons")]
    return read.where(sound).select(*own, *fields), read.where(~sound).select(*own, "reasons")
