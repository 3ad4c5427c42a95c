"""Sheets and pages as Spark data sources: a partition for each sheet of a workbook, or for each range of a document's pages.

A workbook is a zip of XML: sheets are read and written as streams, so a task holds a row at a time (and, of other writers' files, their table
of shared strings). Files are opened where the partition runs; paths may be local ones that the whole cluster shares, or any that
pyarrow's file systems open. Filters on sheet, row and page reach the partitions: readers set spark.sql.python.filterPushdown.enabled, without
which Spark does not read sources that take filters.

Edge cases: a sheet's first row names its columns, of which missing ones are null and others left out; a cell without a value is null, an empty
text stays one; an empty sheet gives no rows; control characters are written in the format's own escapes. A page that cannot be read is a row with an error and no
text, and the pages after it are still read.
"""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Fixed values of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
ROWS = 1_048_576  # of a sheet, its heading included
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


# ---- files


def _local(path: str) -> str | None:
    return re.sub("^file:/+", "/", path) if path.startswith("file:") else path if "://" not in path else None


def opened(path: str):
    """A file that can be read at any place."""
    where = _local(path)
    if where is not None:
        return open(where, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def listed(path: str, suffix: str = "") -> list[str]:
    """The file of a path, or those below it whose names end with suffix; names that begin with a dot or underscore are left out."""
    where = _local(path)
    if where is not None:
        if os.path.isfile(where):
            return [where]
        found = [os.path.join(d, f) for d, _, names in os.walk(where) for f in names]
    else:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [path]
        scheme = path.split("://")[0] + "://"
        found = [scheme + f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File]
    return sorted(f for f in found if f.endswith(suffix) and os.path.basename(f)[0] not in "._")


# ---- ranges that filters ask for


@dataclass
class Range:
    first: int = 1
    last: float = float("inf")

    def narrow(self, f) -> bool:
        """Whether a filter is one of a range, which it then narrows."""
        if isinstance(f, EqualTo):
            self.first, self.last = max(self.first, f.value), min(self.last, f.value)
        elif isinstance(f, GreaterThan):
            self.first = max(self.first, f.value + 1)
        elif isinstance(f, GreaterThanOrEqual):
            self.first = max(self.first, f.value)
        elif isinstance(f, LessThan):
            self.last = min(self.last, f.value - 1)
        elif isinstance(f, LessThanOrEqual):
            self.last = min(self.last, f.value)
        else:
            return False
        return True


def _asked(options) -> Range:
    return Range(int(options.get("first", 1)), float(options.get("last", "inf")))


# ---- sheets


def _text(raw: str) -> str:
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), raw)


def _written(text: str) -> str:
    held = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(re.sub("[\x00-\x08\x0b-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", held))


def sheet_names(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of sheets, in order, with the file of each."""
    files = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    at = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return [(s.get("name"), at(files[s.get(RELATION)])) for s in sheets]


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        out, root = [], None
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            root = e if root is None else root
            if event == "end" and e.tag == f"{MAIN}si":
                out.append(_text("".join(t.text or "" for t in e.iter(f"{MAIN}t"))))
                root.clear()
        return out


def _place(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_rows(book: zipfile.ZipFile, member: str) -> Iterator[tuple[int, dict[int, str]]]:
    """Number and cells, by place and as text, of each row."""
    shared = _shared(book)
    with book.open(member) as f:
        number, held = 0, []
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            if event == "start" and e.tag in (f"{MAIN}worksheet", f"{MAIN}sheetData"):
                held.append(e)
            if event == "start" or e.tag != f"{MAIN}row":
                continue
            number, cells = int(e.get("r") or number + 1), {}
            for k, c in enumerate(e.iter(f"{MAIN}c")):
                kind, value = c.get("t"), c.find(f"{MAIN}v")
                if kind == "inlineStr":
                    text = _text("".join(t.text or "" for t in c.iter(f"{MAIN}t")))
                elif value is None:
                    continue
                else:
                    text = shared[int(value.text)] if kind == "s" else _text(value.text or "") if kind == "str" else value.text
                cells[_place(c.get("r")) if c.get("r") else k] = text
            yield number, cells
            for parent in held:  # the parser goes on in the open element, which would keep all rows
                parent.clear()


@dataclass
class Sheet(InputPartition):
    path: str
    name: str
    member: str
    first: int
    last: float

    def __init__(self, path, name, member, first, last):
        self.path, self.name, self.member, self.first, self.last = path, name, member, first, last


class SheetReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.columns = schema.names
        self.path, self.range, self.names = options["path"], _asked(options), None
        if options.get("sheets"):
            self.names = set(options["sheets"].split("\n"))

    def pushFilters(self, filters):
        for f in filters:
            own = f.attribute if hasattr(f, "attribute") else None
            if own == ("sheet",) and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = values if self.names is None else self.names & values
            elif own != ("row",) or not self.range.narrow(f):
                yield f

    def partitions(self):
        out = []
        for path in listed(self.path, ".xlsx"):
            with opened(path) as f, zipfile.ZipFile(f) as book:
                out += [Sheet(path, name, member, self.range.first, self.range.last) for name, member in sheet_names(book) if self.names is None or name in self.names]
        return out

    def read(self, partition):
        with opened(partition.path) as f, zipfile.ZipFile(f) as book:
            places = None
            for number, (_, cells) in enumerate(sheet_rows(book, partition.member)):
                if places is None:
                    heading = {v: k for k, v in reversed(cells.items())}
                    places = [heading.get(c, -1) for c in self.columns]
                elif number > partition.last:
                    break
                elif number >= partition.first:
                    own = {"origin": partition.path, "sheet": partition.name, "row": number}
                    yield tuple(own[c] if c in own else cells.get(k) for c, k in zip(self.columns, places, strict=True))


@dataclass
class Part(WriterCommitMessage):
    path: str | None
    number: int

    def __init__(self, path, number):
        self.path, self.number = path, number


class SheetWriter(DataSourceWriter):
    """A workbook for each partition, written beside its place and moved there when all are done."""

    def __init__(self, schema: T.StructType, options, overwrite: bool):
        self.columns, self.overwrite = schema.names, overwrite
        self.folder = _local(options["path"])
        if self.folder is None:
            raise ValueError("workbooks are written to a path that the whole cluster mounts")
        self.single = options.get("single") == "true"

    def write(self, rows) -> Part:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        parent = os.path.dirname(self.folder) if self.single else self.folder
        os.makedirs(parent, exist_ok=True)
        path = os.path.join(parent, f".part-{uuid.uuid4().hex}.xlsx")
        write_book(path, self.columns, rows)
        return Part(path, number)

    def commit(self, messages) -> None:
        if self.single:
            (part,) = messages
            os.replace(part.path, self.folder)
            return
        if self.overwrite:
            for f in listed(self.folder, ".xlsx"):
                os.remove(f)
        run = uuid.uuid4().hex[:8]
        for m in messages:
            os.replace(m.path, os.path.join(self.folder, f"part-{m.number:05d}-{run}.xlsx"))

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


def write_book(path: str, columns: Sequence[str], rows) -> None:
    """Rows under a heading; a further sheet begins where one is full."""
    line = lambda n, values: f'<row r="{n}">' + "".join(_cell(v) for v in values) + "</row>"
    rows, more, names = iter(rows), True, []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        while more or not names:
            names.append(f"Sheet{len(names) + 1}")
            with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as f:
                f.write(f'{HEAD}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{line(1, columns)}'.encode())
                more = False
                for n, row in enumerate(rows, start=2):
                    f.write(line(n, row).encode())
                    if n == ROWS:
                        more = True
                        break
                f.write(b"</sheetData></worksheet>")
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        sheets = "".join(f'<sheet name="{s}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        book.writestr("_rels/.rels", f'{HEAD}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        own = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>{own}</Types>')


def _cell(v) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f"<c><v>{v!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_written(str(v))}</t></is></c>'


class Sheets(DataSource):
    """spark.read.format("sheets").schema(text columns, and origin, sheet and row if wanted).load(path)."""

    @classmethod
    def name(cls):
        return "sheets"

    def reader(self, schema):
        return SheetReader(schema, self.options)

    def writer(self, schema, overwrite):
        return SheetWriter(schema, self.options, overwrite)


def read_sheets(spark: SparkSession, path: str, columns: Sequence[str], sheets: Sequence[str] | None = None, first: int = 1, last: int | None = None) -> DataFrame:
    """Text columns of all sheets below path, or of those named, with origin, sheet and row (1 is the first below the heading)."""
    spark.dataSource.register(Sheets)
    spark.conf.set(PUSHDOWN, True)
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField("origin", T.StringType()), T.StructField("sheet", T.StringType()), T.StructField("row", T.LongType())])
    options = {"first": first} | ({"last": last} if last is not None else {}) | ({"sheets": "\n".join(sheets)} if sheets is not None else {})
    return spark.read.format("sheets").schema(schema).options(**options).load(path)


def write_sheets(table: DataFrame, path: str, single: bool = False) -> None:
    """A workbook for each partition of table in the folder path; with single, one workbook of that name, written by one task."""
    table.sparkSession.dataSource.register(Sheets)
    out = table.repartition(1) if single else table
    out.write.format("sheets").mode("overwrite").option("single", str(single).lower()).save(path)


# ---- pages


@dataclass
class Pages(InputPartition):
    path: str
    first: int
    last: int

    def __init__(self, path, first, last):
        self.path, self.first, self.last = path, first, last


def form_feeds(content: bytes) -> list[bytes]:
    """Pages of a text: what stands between form feeds; one at the end opens no page."""
    return content.removesuffix(b"\f").split(b"\f")


def read_page_ranges(spark: SparkSession, path: str, extract: Callable[[bytes, int, int], Iterator[str]], count: Callable[[bytes], int], first: int = 1, last: int | None = None, chunk: int = 16, suffix: str = "") -> DataFrame:
    """path, page, text, error of the pages first to last of every file, in partitions of at most chunk pages.

    count(content) tells how many pages a file has; extract(content, page, last) yields their texts from page on, such as a PDF library or an OCR model does.
    Where it fails the page is a row with the error, and reading goes on with the next.
    """

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.range = options["path"], Range(first, float("inf") if last is None else last)

        def pushFilters(self, filters):
            for f in filters:
                if getattr(f, "attribute", None) != ("page",) or not self.range.narrow(f):
                    yield f

        def partitions(self):
            out = []
            for name in listed(self.path, suffix):
                with opened(name) as f:
                    n = count(f.read())
                begin, end = max(1, self.range.first), int(min(n, self.range.last))
                out += [Pages(name, at, min(at + chunk - 1, end)) for at in range(begin, end + 1, chunk)]
            return out or [Pages("", 1, 0)]

        def read(self, p):
            page = p.first
            if page <= p.last:
                with opened(p.path) as f:
                    content = f.read()
            while page <= p.last:
                try:
                    for text in extract(content, page, p.last):
                        yield (p.path, page, text, None)
                        page += 1
                        if page > p.last:
                            return
                    return
                except Exception as e:  # noqa: BLE001 - any failure of a library is a row
                    yield (p.path, page, None, f"{type(e).__name__}: {e}")
                    page += 1

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "pages"

        def schema(self):
            return "path string, page int, text string, error string"

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Source)
    spark.conf.set(PUSHDOWN, True)
    return spark.read.format("pages").load(path)
