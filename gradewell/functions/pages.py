"""A page's lines as paragraphs, one question each."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def _opens(line: str, last: str) -> bool:
    """Whether a line begins with the number after last; numbers of three digits are not looked for."""
    wanted = str(int(last) + 1) if last.isdigit() else ""
    return 1 <= len(wanted) <= 2 and line.startswith(wanted)


def segment(text: str | None) -> Iterator[str]:
    """Paragraphs from a number to the end of the choice D; none unless the page begins with a digit."""
    lines = (text or "").split("\n")
    if not lines[0][:1].isdigit():
        return
    held: list[str] = []
    number, closing = "", False
    for line in lines:
        if closing and _opens(line, number):
            yield "\n".join(held)
            held, number, closing = [], "", False
        held.append(line)
        if closing:
            continue
        if line.startswith("D"):
            closing = True
        elif not number:
            number = line[: len(line) - len(line.lstrip("0123456789"))]
    if held:
        yield "\n".join(held) if closing else "\n".join(held).strip()


@udtf(returnType="place int, paragraph string", useArrow=True)
class SegmentPage:
    def eval(self, text: str):
        yield from enumerate(segment(text))


def register(spark: SparkSession) -> None:
    """segment_page(text) as a table function for SQL."""
    spark.udtf.register("segment_page", SegmentPage)
