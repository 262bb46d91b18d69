"""Workbooks: what is written reads back, and what fails leaves nothing."""

import datetime as dt
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from noticeflow.sources import workbook

SCHEMA = "id long, title string, score double, day date"
ROWS = [(1, "plain", 1.5, dt.date(2024, 1, 2)), (2, None, None, None), (3, " <&> \"x\" ' \n two\r\nlines\x0b ", 2.0, None), (2**60, "é 你好 😀", -0.1, None), (5, "", 1e300, None)]


def sheets(spark, path):
    out = {}
    for r in workbook.read(spark, f"file://{path}").orderBy("sheet", "row").collect():
        out.setdefault(r.sheet, []).append((r.row, r.cells))
    return out


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    empty = df.where("false").select("id")
    workbook.write(f"file://{tmp_path}/a.xlsx", [("One", df, [F.col("id")]), ("Two & more", df.select("title", "id"), [F.desc("id")]), ("None", empty, [])])
    got = sheets(spark, tmp_path / "a.xlsx")
    assert got["One"] == [(1, ["id", "title", "score", "day"]), (2, ["1", "plain", "1.5", "2024-01-02"]), (3, ["2", None, None, None]), (4, ["3", " <&> \"x\" ' \n two\r\nlines ", "2", None]), (5, ["5", "", "1e+300", None]), (6, [str(2**60), "é 你好 😀", "-0.1", None])]
    assert [r[1][1] for r in got["Two & more"]] == ["id", str(2**60), "5", "3", "2", "1"] and got["None"] == [(1, ["id"])]
    assert os.listdir(tmp_path) == ["a.xlsx"]
    found = workbook.records(workbook.read(spark, f"file://{tmp_path}").where("sheet = 'One'"), "book").collect()
    assert sorted(r.raw["id"] for r in found) == sorted(["1", "2", "3", "5", str(2**60)]) and {r.source for r in found} == {"book"}
    assert next(r.raw for r in found if r.raw["id"] == "2") == {"id": "2"}


def test_many_rows_keep_their_order_and_go_on_in_another_sheet(spark, tmp_path):
    df = spark.range(1000).repartition(7)
    workbook.write(f"file://{tmp_path}/deep/b.xlsx", [("Numbers", df, [F.desc("id")])], most=300)
    got = sheets(spark, tmp_path / "deep" / "b.xlsx")
    assert [len(got[s]) for s in ("Numbers", "Numbers (2)", "Numbers (3)", "Numbers (4)")] == [300, 300, 300, 101]
    assert [c[0] for s in sorted(got) for _, c in got[s]] == ["id", *[str(i) for i in range(999, -1, -1)]]


def test_sheets_that_go_on_are_read_as_one(spark, tmp_path):
    df, name = spark.range(1000).repartition(7), "Numbers of a name of 31 letters"
    workbook.write(f"file://{tmp_path}/b.xlsx", [(name, df, [F.desc("id")]), ("Numbers (2)", df.limit(3), [F.desc("id")])], most=90)
    got = workbook.read(spark, f"file://{tmp_path}/b.xlsx", whole=True)
    rows = [(r.row, r.cells[0]) for r in got.where(F.col("sheet") == name).orderBy("row").collect()]
    assert rows == [(1, "id"), *[(i + 2, str(999 - i)) for i in range(1000)]]
    assert got.where("sheet = 'Numbers (2)'").count() == 4 and got.select("sheet").distinct().count() == 2
    assert workbook.records(got.where(F.col("sheet") == name), "book").count() == 1000
    assert workbook.read(spark, f"file://{tmp_path}/b.xlsx").select("sheet").distinct().count() == 13


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    df = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("x"), "id")
    with pytest.raises(Exception, match="broken"):
        workbook.write(f"file://{tmp_path}/c.xlsx", [("S", df, [])])
    assert os.listdir(tmp_path) == []


def test_other_writers_forms(spark, tmp_path):
    """Shared strings, cell references with gaps, booleans, row numbers."""
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{workbook._MAIN}" xmlns:r="{workbook._LINKS}"><sheets><sheet name="S" sheetId="1" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbook._MAIN}"><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{workbook._MAIN}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2" t="s"><v>1</v></c></row><row r="3"><c r="A3"/></row><row r="9"><c r="A9" t="b"><v>1</v></c><c r="B9"><v>2.5</v></c></row></sheetData></worksheet>')
    got = sheets(spark, tmp_path / "d.xlsx")["S"]
    assert [r for r, _ in got] == [2, 9] and got[0][1] == [None, "a", *[None] * 24, "bc"] and got[1][1] == ["TRUE", "2.5"]


def test_ranked_workbook(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i % 3}", (i * 37) % 50) for i in range(60)], "id long, portal string, score int")
    workbook.ranked_workbook(df, f"file://{tmp_path}/r.xlsx", "portal", "score", "id", F.col("id") >= 50)
    got = sheets(spark, tmp_path / "r.xlsx")
    scores = [int(c[2]) for _, c in got["Ranked"][1:]]
    assert scores == sorted(scores, reverse=True) and len(scores) == 60 and len(got["New"]) == 11 and [c[1:3] for _, c in got["Portals"]] == [["n", "n_new"], ["20", "3"], ["20", "3"], ["20", "4"]]
