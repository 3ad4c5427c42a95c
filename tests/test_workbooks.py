import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from gradewell.sources import workbooks as W

ODD = ["plain", "", " two\nlines ", '<&> "x"', "_x0041_", "bell\x07 cr\r", "é🫨", None]


def test_sheets_come_back_as_written(spark, tmp_path):
    rows = [(i, ODD[i % len(ODD)], i / 4, i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "n int, text string, half double, even boolean").repartition(3)
    path = str(tmp_path / "books")
    W.write_sheets(df, path)
    W.write_sheets(df, path)  # a later write takes the place of the first
    got = W.read_sheets(spark, path, ["text", "n", "absent", "half", "even"]).collect()
    assert sorted((int(r.n), r.text, float(r.half), r.even == "1") for r in got) == sorted(rows) and {r.absent for r in got} == {None}
    assert len(W.listed(path, ".xlsx")) == 3 and not [f for f in (tmp_path / "books").iterdir() if f.name.startswith(".part")]
    W.write_sheets(df, str(tmp_path / "one.xlsx"), single=True)
    assert W.read_sheets(spark, str(tmp_path / "one.xlsx"), ["n"]).count() == 40


def test_full_sheets_go_on_in_the_next(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ROWS", 4)
    W.write_book(str(tmp_path / "b.xlsx"), ["n"], [(i,) for i in range(7)])
    W.write_book(str(tmp_path / "empty.xlsx"), ["n"], [])
    df = W.read_sheets(spark, str(tmp_path), ["n"])
    got = sorted((r.sheet, r.row, r.n) for r in df.collect())
    assert got == [("Sheet1", 1, "0"), ("Sheet1", 2, "1"), ("Sheet1", 3, "2"), ("Sheet2", 1, "3"), ("Sheet2", 2, "4"), ("Sheet2", 3, "5"), ("Sheet3", 1, "6")]
    assert df.rdd.getNumPartitions() == 4
    # ranges and names reach the partitions, as options and as filters
    few = W.read_sheets(spark, str(tmp_path), ["n"], sheets=["Sheet2"], first=2, last=2)
    assert [r.n for r in few.collect()] == ["4"] and few.rdd.getNumPartitions() == 1
    asked = df.where((F.col("sheet") == "Sheet2") & (F.col("row") >= 2))
    assert sorted(r.n for r in asked.collect()) == ["4", "5"]


def test_other_writers_files(spark, tmp_path):
    """Shared strings with runs, cells without places, numbers and truth values, as office programs write them."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "o.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Q" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId7" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>key</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c><c r="AA1" t="str"><v>far</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="AA3" t="b"><v>1</v></c></row></sheetData></worksheet>')
    got = W.read_sheets(spark, str(tmp_path), ["key", "far"]).collect()
    assert [(r.key, r.far, r.sheet, r.row) for r in got] == [("two runs", "1", "Q", 1)]


def test_page_ranges_keep_what_can_be_read(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\f".join(b"%d" % i for i in range(1, 41)) + b"\f")
    (tmp_path / "b.txt").write_bytes(b"only")

    def extract(content, page, last):
        for p, text in enumerate(W.form_feeds(content)[page - 1 : last], start=page):
            if p % 10 == 0:
                raise OSError(p)
            yield text.decode()

    count = lambda content: len(W.form_feeds(content))
    pages = W.read_page_ranges(spark, str(tmp_path), extract, count, first=3, last=32, chunk=7)
    got = {r.page: (r.text, r.error) for r in pages.collect()}
    assert got == {p: (None, f"OSError: {p}") if p % 10 == 0 else (str(p), None) for p in range(3, 33)}
    assert pages.rdd.getNumPartitions() == 5  # 30 pages in sevens; the other file has none of them
    few = W.read_page_ranges(spark, str(tmp_path), extract, count, chunk=7).where("page between 8 and 9")
    assert sorted(r.page for r in few.collect()) == [8, 9]
    assert W.read_page_ranges(spark, str(tmp_path), extract, count, first=90).collect() == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("no")).cast("long")).alias("n")).repartition(2)
    with pytest.raises(Exception, match="no"):
        W.write_sheets(bad, str(tmp_path / "x"))
    assert W.listed(str(tmp_path / "x"), ".xlsx") == []


def test_rows_that_were_read_are_let_go(tmp_path):
    path = str(tmp_path / "b.xlsx")
    W.write_book(path, ["n", "text"], ((i, f"row {i}") for i in range(30_000)))
    with zipfile.ZipFile(path) as book:
        tracemalloc.start()
        n = sum(1 for _ in W.sheet_rows(book, "xl/worksheets/sheet1.xml"))
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
    assert n == 30_001 and most < 3 << 20
