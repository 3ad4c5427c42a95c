"""Column functions that clean questions, answers, names of exams and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.responses import strip

# Cell texts that count as missing when a file is read.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def missing_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    own = set(columns or [c for c, t in df.dtypes if t == "string"])
    return df.select(*[F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) if c in own else F.col(c) for c in df.columns])


def lookup(value: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """A value's entry in a small map; null, or default, where it has none."""
    if not mapping:
        return default if default is not None else F.lit(None).cast("string")
    found = F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*mapping.items())]), value)
    return found if default is None else F.coalesce(found, default)


def replace_in_turn(value: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Whole values replaced pair after pair, each seeing the results before it; the chain is closed to one map first."""
    closed: dict[str, str] = {}
    for old, new in pairs:
        for k, v in closed.items():
            if v == old:
                closed[k] = new
        closed.setdefault(old, new)
    return lookup(value, {k: v for k, v in closed.items() if k != v}, value)


def replace_literals(value: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def without_final_stop(choice: Column) -> Column:
    return F.regexp_replace(choice, r"\.\z", "")


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def is_primary(age_group: Column) -> Column:
    return F.coalesce((age_group.contains("Primary") & ~age_group.contains("Pre-Primary")) | (age_group == "All"), F.lit(False))


def is_secondary(age_group: Column) -> Column:
    return F.coalesce(age_group.contains("Secondary") | (age_group == "All"), F.lit(False))


def differs(column: Column, value) -> Column:
    """Not equal, where null differs from every value."""
    return ~F.coalesce(column == value, F.lit(False))


def contains_pattern(column: Column, pattern: str) -> Column:
    return F.coalesce(column.rlike(pattern), F.lit(False))


def first_part(value: Column) -> Column:
    return F.get(F.split(value, ",", -1), F.lit(0))


def second_of_two(value: Column) -> Column:
    """What stands after the comma of a value with exactly one."""
    parts = F.split(value, ",", -1)
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(1)))


def decimal_comma(value: Column) -> Column:
    """A number written with a comma; null where it is none."""
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("double")


def exam_name(path: Column, marker: str = "EN_") -> Column:
    """The exam's name in a file's path: the first two parts after the marker."""
    after = F.get(F.split(path, marker, -1), F.lit(1))
    return F.array_join(F.slice(F.split(after, "_", -1), 1, 2), " ")


def exam_key(origin: Column) -> Column:
    """struct(name, year): a file's name without digits and extension, upper case with underscores, and the year of its last two digits."""
    stem = F.regexp_replace(origin, r"(?i)\.xlsx\z", "")
    name = F.upper(F.replace(F.regexp_replace(stem, r"(?U)\d+", ""), F.lit(" "), F.lit("_")))
    return F.struct(name.alias("name"), F.concat(F.lit("20"), F.right(stem, F.lit(2))).alias("year"))


def exam_code(code: Column) -> Column:
    return F.trim(F.substring_index(F.replace(code, F.lit("-"), F.lit("_")), "(", 1))


def slug(category: Column) -> Column:
    return F.lower(F.replace(F.replace(category, F.lit(" PCK"), F.lit("")), F.lit(" "), F.lit("_")))


def without_suffix(category: Column, suffix: str = " PCK") -> Column:
    return F.when(F.endswith(category, F.lit(suffix)), F.substring(category, F.lit(1), F.length(category) - len(suffix))).otherwise(category)


def cost(rate_in: Column, rate_out: Column, combined: bool = False) -> Column:
    """A model's price: the input rate, or four fifths of it and a fifth of the output rate; a single rate stands for both."""
    return F.when(rate_out.isNull(), rate_in).otherwise(0.8 * rate_in + 0.2 * rate_out) if combined else rate_in


def question_number(paragraph: Column) -> Column:
    """The number before the first "digits and a stop"."""
    return F.nullif(F.regexp_extract(paragraph, r"(?U)(\d+)\.", 1), F.lit("")).try_cast("int")


def leading_number(text: Column) -> Column:
    """struct(number, rest): leading digits and what follows; a number of n digits takes n - 1 more characters of the rest."""
    digits = F.regexp_extract(text, r"(?U)\A(\d+)", 1)
    n = F.length(digits)
    rest = F.substring(text, n + F.greatest(n - 1, F.lit(0)) + 1, F.length(text))
    return F.struct(F.nullif(digits, F.lit("")).try_cast("int").alias("number"), rest.alias("rest"))


def complete_choices(*choices: Column) -> Column:
    """Whether all choices are there and not empty."""
    out = F.lit(True)
    for c in choices:
        out = out & F.coalesce(F.length(c) > 0, F.lit(False))
    return out


def page_number(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"\APage (\d+)\z", 1), F.lit("")).try_cast("int")


def paragraphs(text: Column) -> Column:
    """Numbered paragraphs, each from "digits and a stop" past a letter D to the next number or the end, stripped."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)(\d+\..*?D.*?(?=\d+\.|\z))"), 1)
    return F.transform(found, strip)


def without_last_line(text: Column) -> Column:
    """A page's text without its last line, which holds the page's number."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.slice(lines, F.lit(1), F.size(lines) - 1), "\n")
